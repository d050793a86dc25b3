"""Problem 9: filling containers of fixed capacity by vector best-fit.

Every text is an item of n tokens. A container has three capacities:

* tokens: ``capacity_tokens``;
* documents: ``capacity_tokens / TOKENS_PER_DOC``, which bounds the separate segments in a container;
* attention cost, the sum of the squared piece lengths: ``ATTENTION_SHARE`` of the squared token capacity. A piece that is
  above that alone opens a container whose attention capacity is the whole square, as it must go somewhere.

An item goes to an open container with room in every dimension; of all such containers, the one whose weighted squared
residuals (tokens, documents, attention) are smallest after placement takes it, of equal ones that with the least room. Only
a text above the token capacity is cut, into full pieces and a rest. Null and empty texts are items of 0 tokens. An empty
table gives an empty result. Kinds of container without a positive capacity hold nothing and give no rows.

Items are packed in buckets chosen by hash, longest first; containers that stay under ``DISSOLVE_BELOW`` are dissolved and
their items packed again, in as many buckets as the number of loose items asks for, so a bucket holds about ``BUCKET_ITEMS``
items at every level. A level that places less than ``WORTH`` of its items for good is the last (items of six tenths of the
capacity leave room in any order): its containers stand as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.tokenize import TOKENIZER, count_tokens
from lexiscope.session import cut_lineage

BUCKET_ITEMS = 20_000
MAX_KINDS = 1000
MAX_TASKS = 4096
DISSOLVE_BELOW = 0.98
WORTH = 0.3
TOKENS_PER_DOC = 32
ATTENTION_SHARE = 0.6
#: containers compared at first; more only where they can still be better
FIRST = 32
WEIGHTS = (1.0, 0.05, 0.05)
PLACED = "container_kind string, capacity_tokens int, container_id string, doc_id bigint, piece int, start_token int, n_tokens int, loose boolean"


def limits(capacity: int) -> tuple[int, float]:
    """Documents and attention cost that a container of this token capacity holds."""
    return max(1, capacity // TOKENS_PER_DOC), ATTENTION_SHARE * float(capacity) ** 2


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int | None = None, max_cost: float | None = None) -> np.ndarray:
    """Container number of each item; ``sizes`` is sorted from long to short and has no item above ``capacity``.

    Open containers are kept in order of their room for tokens. The score of the first few that fit bounds how much room the
    best can have, as the residual of tokens alone is above it beyond; all up to there are compared. A container that can
    take nothing more, by the smallest item, is closed.
    """
    own_docs, own_cost = limits(capacity)
    docs_cap, cost_cap = max_docs or own_docs, own_cost if max_cost is None else max_cost
    n = len(sizes)
    where = np.empty(n, dtype=np.int64)
    # open containers by (room, number): room for tokens, number, documents and attention cost left
    rooms, number, docs, cost = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64), np.empty(n + 1, np.int64), np.empty(n + 1)
    n_open = n_made = 0
    smallest = int(sizes[-1]) if n else 0
    w_tokens, w_docs, w_cost = WEIGHTS

    def scores(lo: int, hi: int, s: int, square: float) -> np.ndarray:
        left = cost[lo:hi] - square
        out = w_tokens * ((rooms[lo:hi] - s) / capacity) ** 2 + w_docs * ((docs[lo:hi] - 1) / docs_cap) ** 2 + w_cost * (left / cost_cap) ** 2
        out[left < 0] = math.inf
        return out

    for i, s in enumerate(map(int, sizes)):
        square = float(s) * s
        best, best_score = -1, math.inf
        lo, step = int(rooms[:n_open].searchsorted(s)), FIRST
        while lo < n_open and w_tokens * ((rooms[lo] - s) / capacity) ** 2 < best_score:
            hi = min(n_open, lo + step)
            own = scores(lo, hi, s, square)
            at = int(own.argmin())
            if own[at] < best_score:
                best, best_score = lo + at, float(own[at])
            lo, step = hi, 4 * step
        if best >= 0:
            room, k, docs_left, cost_left = int(rooms[best]), int(number[best]), int(docs[best]), float(cost[best])
        else:
            # a piece above the limit alone leaves what the squared capacity has beside it
            best, room, k, docs_left, cost_left = n_open, capacity, n_made, docs_cap, cost_cap if square <= cost_cap else float(capacity) ** 2
            n_made, n_open = n_made + 1, n_open + 1
        where[i] = k
        room, docs_left, cost_left = room - s, docs_left - 1, cost_left - square
        if room >= smallest and docs_left >= 1 and cost_left >= smallest * smallest:
            # its room is less than before: it moves toward the front
            at = int(rooms[:best].searchsorted(room))
            at += int(number[at : at + int(rooms[at:best].searchsorted(room, "right"))].searchsorted(k))
            for column, value in ((rooms, room), (number, k), (docs, docs_left), (cost, cost_left)):
                column[at + 1 : best + 1] = column[at:best]
                column[at] = value
        else:
            for column in (rooms, number, docs, cost):
                column[best : n_open - 1] = column[best + 1 : n_open]
            n_open -= 1
    return where


def _pack_bucket(level: int):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        capacity = int(items.capacity_tokens.iloc[0])
        no = best_fit(items.n_tokens.to_numpy(), capacity)
        fill = np.bincount(no, weights=items.n_tokens.to_numpy())
        prefix = f"{items.container_kind.iloc[0]}-{capacity}-{level}-{items.bucket.iloc[0]}-"
        items["container_id"] = [f"{prefix}{k}" for k in no]
        items["loose"] = fill[no] < DISSOLVE_BELOW * capacity
        return items[[c.split()[0] for c in PLACED.split(", ")]]

    return pack


def items_of(docs: DataFrame, capacities: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per piece and kind of container: container_kind, capacity_tokens, doc_id, piece, start_token, n_tokens."""
    sized = docs.select("doc_id", count_tokens("text", path).alias("tokens"))
    kinds = [tuple(r) for r in capacities.select("container_kind", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(MAX_KINDS + 1).collect()]
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    if not kinds:
        kinds_col = F.array().cast("array<struct<container_kind:string,capacity_tokens:int>>")
    else:
        kinds_col = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in kinds])
    per_kind = sized.select("doc_id", "tokens", F.explode(kinds_col).alias("k")).select("k.*", "doc_id", "tokens")
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity_tokens")) - 1).cast("int")
    return per_kind.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "container_kind", "capacity_tokens", "doc_id", "piece",
        (F.col("piece") * F.col("capacity_tokens")).alias("start_token"),
        F.least(F.col("capacity_tokens"), F.col("tokens") - F.col("piece") * F.col("capacity_tokens")).alias("n_tokens"),
    )


def pack(docs: DataFrame, capacities: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Placement of every piece: container_kind, capacity_tokens, container_id, doc_id, piece, start_token, n_tokens."""
    items = cut_lineage(items_of(docs, capacities, path))
    done, level = [], 0
    while True:
        sizes = [r["count"] for r in items.groupBy("container_kind", "capacity_tokens").count().collect()]  # one row per kind
        total, buckets = sum(sizes), max(1, math.ceil(max(sizes, default=0) / BUCKET_ITEMS))
        if not total:
            break
        items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(buckets)).cast("int"))
        # as many partitions as buckets, which adaptive execution leaves alone: rows are few bytes, but each costs a search
        spread = items.repartition(min(MAX_TASKS, buckets * len(sizes)), "container_kind", "capacity_tokens", "bucket")
        placed = cut_lineage(spread.groupBy("container_kind", "capacity_tokens", "bucket").applyInPandas(_pack_bucket(level), PLACED))
        loose = placed.where("loose").count()
        if buckets == 1 or loose > (1 - WORTH) * total:
            done.append(placed)
            break
        done.append(placed.where(~F.col("loose")))
        items, level = placed.where("loose").drop("loose", "container_id"), level + 1
    out = done[0] if done else docs.sparkSession.createDataFrame([], PLACED)
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("loose")


def fill_report(placed: DataFrame) -> DataFrame:
    """Per kind: containers, pieces, tokens, the share of room left over, and how full and how often full each capacity is."""
    n = F.col("n_tokens").cast("double")
    each = placed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"), F.sum(n * n).alias("cost"), F.max(n * n).alias("top"))
    most_docs = F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") / TOKENS_PER_DOC))
    square = F.pow("capacity_tokens", F.lit(2))
    most_cost = F.when(F.col("top") > ATTENTION_SHARE * square, square).otherwise(ATTENTION_SHARE * square)
    each = each.withColumn("docs_fill", F.col("pieces") / most_docs).withColumn("attention_fill", F.col("cost") / most_cost)
    return each.groupBy("container_kind", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("unused_share"),
        F.avg("docs_fill").alias("docs_fill"), F.avg("attention_fill").alias("attention_fill"), F.count_if(F.col("docs_fill") >= 1).alias("full_of_docs"), F.count_if(F.col("attention_fill") > 0.97).alias("full_of_attention"),
        F.max(F.col("used") - F.col("capacity_tokens")).alias("worst_overfill"),
    )
