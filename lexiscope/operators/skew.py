"""Per-key results without stragglers: fragment-replicate by estimated load.

1. Load per key comes from one map-side combined count.
2. A key whose load exceeds a task's fair share is cut into proportionate shards; keys of middling load are bin-packed
   onto tasks, longest first; the long tail is spread by hash. Only keys above ``fair / 16`` are planned one by one. At
   most ``16 * tasks`` keys can be that large, so the plan's size is bounded by the number of tasks, not by the data.
3. Fact rows carry (key, shard). The matching side is replicated to the shards of a large key, and only to those.
4. A shard is chosen by the hash of the artifact, so one artifact is always in one shard, and distinct counts of the
   shards add up exactly. Sums, counts and histograms add up anyway.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAN_FRACTION = 16


@dataclass(frozen=True)
class ShardPlan:
    """``shards``: keys cut into several shards; ``task``: task of a packed (key, shard); ``tasks``: their number."""

    tasks: int
    fair: float
    shards: dict
    task: dict


def key_loads(facts: DataFrame, key: str) -> DataFrame:
    """(key, load): rows per value of ``key``. Null is a key of its own. An empty table gives no rows."""
    return facts.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("load"))


def plan_shards(loads: DataFrame, tasks: int) -> ShardPlan:
    """Cut and bin-pack the keys whose load matters; ``loads`` has (key, load)."""
    total = loads.agg(F.sum("load")).first()[0] or 0
    fair = max(1.0, total / tasks)
    large = loads.where((F.col("load") > fair / PLAN_FRACTION) & F.col("key").isNotNull())
    pieces, shards = [], {}
    for key, load in sorted(map(tuple, large.collect()), key=lambda kl: (-kl[1], kl[0])):
        n = math.ceil(load / fair)
        if n > 1:
            shards[key] = n
        pieces += [(load / n, key, i) for i in range(n)]
    heap = [(0.0, t) for t in range(tasks)]
    task = {}
    for load, key, i in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        used, t = heapq.heappop(heap)
        task[key, i] = t
        heapq.heappush(heap, (used + load, t))
    return ShardPlan(tasks, fair, shards, task)


def _key(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit(""))


def _look_up(df: DataFrame, mapping: dict, by: Column, default: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the mapping's value, or the default. A plan has at most ``PLAN_FRACTION`` entries a task, hence the broadcast."""
    if not mapping:
        return df.withColumn(name, default)
    plan = df.sparkSession.createDataFrame(sorted(mapping.items()), "_plan_key string, _plan_value int")
    joined = df.withColumn("_plan_by", by).join(F.broadcast(plan), F.col("_plan_by") == F.col("_plan_key"), "left")
    return joined.withColumn(name, F.coalesce("_plan_value", default)).drop("_plan_by", "_plan_key", "_plan_value")


def _slots(spark, tasks: int) -> list[int]:
    """For each task an integer that Spark's hash partitioning sends to it, so that a packed placement survives a shuffle."""
    ids = spark.range(tasks * 40 + 1000).select(F.col("id").cast("int").alias("id"))
    rows = ids.groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("t")).agg(F.min("id").alias("id")).collect()
    return [i for _, i in sorted(map(tuple, rows))]


def shard_facts(facts: DataFrame, key: str, within: list[str], plan: ShardPlan) -> DataFrame:
    """``facts`` with ``_shard``. ``within`` decides the shard: rows with equal values in it stay together."""
    known = _look_up(facts, plan.shards, _key(key), F.lit(1), "_shards")
    return known.withColumn("_shard", F.pmod(F.xxhash64(*within), F.col("_shards")).cast("int")).drop("_shards")


def place(sharded: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    """``sharded`` with ``_slot``, one shuffle: planned (key, shard) pairs on their task, the tail by hash.

    Groupings that include ``_slot`` need no further exchange.
    """
    slots = _slots(sharded.sparkSession, plan.tasks)
    packed = {f"{i}\x1f{name}": slots[t] for (name, i), t in plan.task.items()}
    where = F.concat(F.col("_shard").cast("string"), F.lit("\x1f"), _key(key))
    tail = F.element_at(F.array(*[F.lit(s) for s in slots]), F.pmod(F.xxhash64(_key(key)), F.lit(plan.tasks)).cast("int") + 1)
    return _look_up(sharded, packed, where, tail, "_slot").repartition(plan.tasks, "_slot")


def replicate(side: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    """``side`` with ``_shard``: rows of a large key once for each of its shards, all other rows once."""
    known = _look_up(side, plan.shards, _key(key), F.lit(1), "_shards")
    return known.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))).drop("_shards")


def balanced_join(facts: DataFrame, side: DataFrame, key: str, within: list[str], plan: ShardPlan, how: str = "left") -> DataFrame:
    """Join on ``key`` with the large keys fragmented and the matching side replicated to their fragments."""
    return shard_facts(facts, key, within, plan).join(replicate(side, key, plan), [key, "_shard"], how).drop("_shard")


def joined_evenly(facts: DataFrame, side: DataFrame, key: str, within: list[str]) -> DataFrame:
    """``balanced_join`` with a plan made from the loads of ``facts``; rows without a match have null."""
    return balanced_join(facts, side, key, within, plan_shards(key_loads(facts, key), tasks_for(facts)))


def key_profile(facts: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    """Rows, distinct artifacts and lifetimes of every key.

    Columns: key_value, n_rows, n_artifacts, n_removed, mean_days, max_days, median_days. An artifact is the pair
    (artifact_type, artifact_id). Days of observed removals only; null where a key has none. Each task first reduces its
    own shard to one row per (key, shard).
    """
    days = F.when(F.col("is_censored") == 0, F.col("time_to_event_days"))
    base = facts.select(key, "artifact_type", "artifact_id", days.alias("days"))
    # combined map-side first, so that a much repeated artifact is one row; its rows share a shard, hence shard counts add up
    pairs = shard_facts(base, key, ["artifact_type", "artifact_id"], plan).select(key, "_shard", "artifact_type", "artifact_id").distinct()
    artifacts = (
        place(pairs, key, plan).groupBy("_slot", key, "_shard").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col(key).alias("key_value")).agg(F.sum("n").alias("n_artifacts"))
    )
    per_days = base.groupBy(key, "days").agg(F.count(F.lit(1)).alias("n"))
    with_days = F.col("days").isNotNull()
    profile = per_days.groupBy(F.col(key).alias("key_value")).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(with_days, F.col("n"))), F.lit(0)).alias("n_removed"),
        (F.sum(F.col("days") * F.col("n")) / F.sum(F.when(with_days, F.col("n")))).alias("mean_days"),
        F.max("days").alias("max_days"),
        F.percentile("days", F.lit(0.5), F.when(with_days, F.col("n")).otherwise(F.lit(0))).alias("median_days"),
    )
    both = profile.alias("p").join(artifacts.alias("a"), F.col("p.key_value").eqNullSafe(F.col("a.key_value")))
    return both.select("p.key_value", "n_rows", "n_artifacts", "n_removed", "mean_days", "max_days", "median_days")


def tasks_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dominant_keys(facts: DataFrame, fields: list[str], share_of: int = 50) -> DataFrame:
    """(field_name, key_value): values, as stored, that hold at least 1/``share_of`` of all rows; nulls are no value.

    One pass: every row gives one (field, value) pair per field, counted map-side. The total is the sum of the loads.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key_value")) for f in fields]))
    loads = facts.select(*fields).select(pairs.alias("p")).groupBy("p.field_name", "p.key_value").agg(F.count(F.lit(1)).alias("load"))
    total = loads.groupBy("field_name").agg(F.sum("load").alias("total"))
    return (
        loads.join(F.broadcast(total), "field_name")  # one row per field
        .where((F.col("load") * share_of >= F.col("total")) & F.col("key_value").isNotNull())
        .select("field_name", "key_value")
    )
