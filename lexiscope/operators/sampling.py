"""Reproducible samples: the order of a draw is the md5 of key and seed, never a random number.

Ranks are filtered by a constant before quotas are joined, so Spark limits every group before the shuffle and no group
arrives whole in one task, however large its stratum is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(key: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed))))


def first_per_group(df: DataFrame, group: list[str], key: list[str], seed: int, most: int) -> DataFrame:
    """At most ``most`` rows of each group in the order of the draw, with their rank ``rn``."""
    w = Window.partitionBy(*group).orderBy(draw_order(key, seed), *key) if group else Window.orderBy(draw_order(key, seed), *key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def first_rows(df: DataFrame, key: list[str], seed: int, n: int) -> DataFrame:
    """``n`` rows in the order of the draw; every task keeps its own n."""
    return df.orderBy(draw_order(key, seed), *key).limit(n)


def allocate(sizes: dict, total: int) -> dict:
    """Rows per stratum: in proportion, at least one, repaired by steps of one from the largest stratum on."""
    n = sum(sizes.values())
    out = {k: max(1, min(round(total * s / n), s)) for k, s in sizes.items()} if n else {}
    order = sorted(sizes, key=lambda k: (-sizes[k], str(k)))
    diff, i = total - sum(out.values()), 0
    while diff and order and i < 10_000:
        k = order[i % len(order)]
        if diff > 0 and out[k] < sizes[k]:
            out[k], diff = out[k] + 1, diff - 1
        elif diff < 0 and out[k] > 1:
            out[k], diff = out[k] - 1, diff + 1
        i += 1
    return out


def stratified(df: DataFrame, stratum: str, key: list[str], total: int, seed: int) -> DataFrame:
    """A sample in proportion to the strata, at least one row each. Strata, not rows, reach the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    quotas = allocate(sizes, total)
    if not quotas:
        return df.limit(0)
    quota = F.lit(0)
    for k, q in quotas.items():
        quota = F.when(F.col(stratum).eqNullSafe(F.lit(k)), q).otherwise(quota)
    return first_per_group(df, [stratum], key, seed, max(quotas.values())).where(F.col("rn") <= quota).drop("rn")


def census_or_sample(df: DataFrame, group: list[str], key: list[str], cap: int, seed: int) -> DataFrame:
    """Groups of at most ``cap`` rows whole, of the others ``cap`` rows."""
    return first_per_group(df, group, key, seed, cap).drop("rn")
