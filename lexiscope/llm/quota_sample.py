"""Problem 2: a sample with target shares per category, by the cube method.

A record key (repository, artifact type and phrase trimmed and in lower case, artifact) is one unit. With N distinct units
the sample size is S = floor(N / ``FRACTION``); a category wants max(min_rows, ceil(share * S)) units. Every unit of a
category gets the inclusion probability wanted / available, at most 1; units outside all categories get 0.

Flight: the balancing variables are the indicators of the categories, so the kernel of the balancing equations is spanned
by vectors that raise one unit of a category and lower another. Each step moves along such a vector until one of the
two reaches 0 or 1; the sum of probabilities of every category stays as it is. Buckets of units, chosen by hash, fly by
themselves and leave at most one undecided unit per category; these merge upward, ``FAN_IN`` buckets at a time, and fly
again. Landing decides what is left at the top, at most one unit per category, by its rounded probability.

The sums are whole numbers, so the sample meets every target that can be met; ``report`` states what was drawn, the
residual and the categories that cannot be met. Defined cases: null type or phrase matches no category; repeated rows
are one unit; a repeated category takes its largest share and floor; null shares and floors are 0; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.session import cut_lineage

FRACTION = 10
BUCKET_UNITS = 50_000
FAN_IN = 64
MAX_TASKS = 4096
MAX_BROADCAST = 10_000
EPS = 1e-9
KEY = ["repo_full_name", "artifact_type", "artifact_id", "matched_expression"]
CATEGORY = ["artifact_type", "matched_expression"]
UNIT = "repo_full_name string, artifact_type string, artifact_id string, matched_expression string, pi double"


def _tidy(name: str) -> Column:
    return F.lower(F.trim(name)).alias(name)


def units(occurrences: DataFrame) -> DataFrame:
    return occurrences.select("repo_full_name", _tidy("artifact_type"), "artifact_id", _tidy("matched_expression")).distinct()


def demands(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """(category, target_share, min_rows, available, wanted, pi) of every wanted category."""
    n = keys.count()
    wanted = F.greatest(F.col("min_rows").cast("bigint"), F.ceil(F.col("target_share") * F.lit(n // FRACTION)))
    goal = targets.select(*map(_tidy, CATEGORY), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"))
    goal = goal.groupBy(*CATEGORY).agg(F.max("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"))
    have = keys.groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("available"))
    out = goal.join(have, CATEGORY, "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("wanted", wanted)
    return out.withColumn("pi", F.when(F.col("available") > 0, F.least(F.lit(1.0), F.col("wanted") / F.col("available"))).otherwise(F.lit(0.0)))


def fly(pi: np.ndarray, category: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 but for at most one unit per category; sums per category are kept."""
    pi = pi.copy()
    open_: dict = {}
    for i in rng.permutation(len(pi)):
        p = pi[i]
        if p <= EPS or p >= 1 - EPS:
            continue
        c = category[i]
        j = open_.pop(c, None)
        if j is None:
            open_[c] = i
            continue
        q = pi[j]
        up, down = min(1 - p, q), min(p, 1 - q)  # along (+1, -1) and (-1, +1) until a bound
        if rng.random() * (up + down) < down:
            p, q = p + up, q - up
        else:
            p, q = p - down, q + down
        pi[i], pi[j] = p, q
        for k, x in ((i, p), (j, q)):
            if EPS < x < 1 - EPS:
                open_[c] = k
    return np.where(pi > 1 - EPS, 1.0, np.where(pi < EPS, 0.0, pi))


def _fly_bucket(seed: int, level: int, landing: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(KEY, ignore_index=True)  # the same order on every attempt
        rng = np.random.default_rng([seed, level, int(frame.bucket.iloc[0])])
        category = pd.factorize(frame.artifact_type.astype(str) + "\x1f" + frame.matched_expression.astype(str))[0]
        pi = fly(frame.pi.to_numpy(), category, rng)
        frame["pi"] = np.where(pi >= 0.5, 1.0, 0.0) if landing else pi
        return frame[[*KEY, "pi"]]

    return run


def draw(occurrences: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sample, report). The sample has the columns of ``KEY``; the report one row per wanted category."""
    keys = cut_lineage(units(occurrences))
    demand = cut_lineage(demands(keys, targets))
    buckets = max(1, math.ceil(keys.count() / BUCKET_UNITS))
    wanted = demand.select(*CATEGORY, "pi")
    if demand.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    with_pi = keys.join(wanted, CATEGORY).select(*KEY, "pi")
    sure = with_pi.where(F.col("pi") >= 1 - EPS).select(*KEY)
    flying = with_pi.where((F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
    drawn, level = [sure], 0
    while True:
        landing = buckets == 1
        flown = cut_lineage(flying.repartition(min(MAX_TASKS, buckets), "bucket").groupBy("bucket").applyInPandas(_fly_bucket(seed, level, landing), UNIT))
        drawn.append(flown.where(F.col("pi") == 1.0).select(*KEY))
        if landing:
            break
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
        flying = flown.where((F.col("pi") > 0) & (F.col("pi") < 1)).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
    sample = drawn[0]
    for d in drawn[1:]:
        sample = sample.unionByName(d)
    got = sample.groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("drawn"))
    report = demand.drop("pi").join(got, CATEGORY, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.withColumn("residual", F.col("drawn") - F.col("wanted"))
    return sample, report.withColumn("is_met", F.col("residual") >= 0)
