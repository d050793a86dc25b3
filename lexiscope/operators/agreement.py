"""Agreement between raters, resolution of labels and precision; every measure is an aggregate with column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions import stats as S


def binary_cells(a: Column, b: Column) -> list[Column]:
    """Cells of the 2 x 2 table of two truth columns: both, only a, only b, neither."""
    return [F.count_if(a & b).alias("a"), F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(~a & ~b).alias("d")]


def with_agreement(cells: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x) for x in "abcd")
    return cells.withColumn("po", S.ratio(a + d, a + b + c + d)).withColumn("kappa", S.kappa2(a, b, c, d)).withColumn("ac1", S.ac1(a, b, c, d))


def pairwise(votes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All pairs of raters on their common items. ``votes``: item_id, rater, vote (and ``by``), one row per item and rater.

    An item's votes are as many as its raters, so the pairs of an item stay few; the join is an equi-join on the item.
    """
    by = by or []
    left = votes.select("item_id", *by, F.col("rater").alias("rater_a"), F.col("vote").alias("x"))
    right = votes.select("item_id", F.col("rater").alias("rater_b"), F.col("vote").alias("y"))
    pairs = left.join(right, "item_id").where(F.col("rater_a") < F.col("rater_b"))
    return with_agreement(pairs.groupBy(*by, "rater_a", "rater_b").agg(F.count(F.lit(1)).alias("n"), *binary_cells(F.col("x"), F.col("y"))))


def categorical(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa and AC1 for any number of categories, per group of ``by``; ``pairs`` has x and y, the two raters' categories.

    One category gives kappa 1, as does a chance agreement of 1; no pair gives no row.
    """
    by = by or []
    cells = pairs.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    margin = (
        cells.select(*by, F.col("x").alias("c"), F.col("n").alias("px"), F.lit(0).alias("py")).unionByName(cells.select(*by, F.col("y").alias("c"), F.lit(0).alias("px"), F.col("n").alias("py")))
        .groupBy(*by, "c").agg(F.sum("px").alias("px"), F.sum("py").alias("py"))
    )
    sums = margin.groupBy(*by).agg(F.count(F.lit(1)).alias("q"), F.sum(F.col("px").cast("double") * F.col("py")).alias("cross"), F.collect_list((F.col("px") + F.col("py")).cast("double")).alias("both"))
    one = total.join(sums, by) if by else total.join(sums)  # one row by one row, in each group
    n, q = F.col("total").cast("double"), F.col("q")
    po, pe = F.col("same") / n, F.col("cross") / (n * n)
    chance = F.aggregate(F.transform("both", lambda b: b / (2 * n) * (1 - b / (2 * n))), F.lit(0.0), lambda s, x: s + x) / F.nullif(q - 1, F.lit(0))
    return one.where("total > 0").select(
        *by, F.col("total").alias("n"), q.alias("categories"), po.alias("po"),
        F.when((q < 2) | (pe == 1), 1.0).otherwise(S.ratio(po - pe, 1 - pe)).alias("kappa"),
        F.when(q < 2, 1.0).otherwise(S.ratio(po - chance, 1 - chance)).alias("ac1"),
    )


def fleiss(votes: DataFrame, k: int) -> DataFrame:
    """Fleiss' kappa and AC1 over the items that all ``k`` raters judged."""
    items = votes.groupBy("item_id").agg(F.count_if("vote").alias("yes"), F.count(F.lit(1)).alias("raters")).where(F.col("raters") == k)
    yes, no = F.col("yes").cast("double"), k - F.col("yes").cast("double")
    sums = items.agg(F.count(F.lit(1)).alias("n"), F.avg((yes * yes + no * no - k) / (k * (k - 1))).alias("p_mean"), F.avg(yes / k).alias("p_yes"))
    pe = F.col("p_yes") * F.col("p_yes") + (1 - F.col("p_yes")) * (1 - F.col("p_yes"))
    pa = 2 * F.col("p_yes") * (1 - F.col("p_yes"))
    return sums.select("n", F.col("p_mean").alias("po"), S.ratio(F.col("p_mean") - pe, 1 - pe).alias("kappa"), S.ratio(F.col("p_mean") - pa, 1 - pa).alias("ac1"))


def majority(votes: DataFrame) -> DataFrame:
    """(item_id, n_true, n_votes, is_true, is_unanimous): strict majority of the votes that are not null."""
    agg = votes.where(F.col("vote").isNotNull()).groupBy("item_id").agg(F.count_if("vote").alias("n_true"), F.count(F.lit(1)).alias("n_votes"))
    return agg.withColumn("is_true", 2 * F.col("n_true") > F.col("n_votes")).withColumn("is_unanimous", F.col("n_true").isin(0) | (F.col("n_true") == F.col("n_votes")))


def resolve(annotations: DataFrame, tie_breakers: list[str]) -> DataFrame:
    """One label per item: the tie-breaker's if there is one, else the unanimous one, else unresolved.

    The tie-breaker's first row by annotator decides; an item of one rater is marked as such.
    """
    tb = F.col("annotator_id").isin(tie_breakers)
    votes = annotations.where(F.col("is_ubw").isNotNull())
    agg = votes.groupBy("item_id").agg(
        F.min_by(F.when(tb, F.col("is_ubw")), F.when(tb, F.col("annotator_id"))).alias("tie"),
        F.count_if(~tb & F.col("is_ubw")).alias("yes"), F.count_if(~tb & ~F.col("is_ubw")).alias("no"),
        F.count_distinct(F.when(~tb, F.col("annotator_id"))).alias("n_primary"), F.count_if(tb).alias("n_tie"),
    )
    same = (F.col("yes") == 0) | (F.col("no") == 0)
    return agg.select(
        "item_id", F.when(F.col("n_tie") > 0, F.col("tie")).when(same, F.col("yes") > 0).alias("label"),
        F.when(F.col("n_tie") > 0, "desempate").when(~same, "unresolved").when(F.col("n_primary") >= 2, "consenso").otherwise("single_anotador").alias("resolution"), "n_primary",
    )


def precision(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, tp, precision, low, high, is_alert) of resolved labels with at least two raters or a tie-break."""
    kept = labels.where((F.col("resolution") != "unresolved") & (F.col("resolution") != "single_anotador"))
    agg = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("tp"))
    low, high = S.wilson(F.col("tp"), F.col("n"))
    return agg.withColumn("precision", S.ratio(F.col("tp"), F.col("n"))).withColumn("low", low).withColumn("high", high).withColumn("is_alert", F.col("precision") < 0.5)


def error_correlation(errors: DataFrame) -> DataFrame:
    """Pearson correlation of the error columns of every pair of raters; null where one of them never varies."""
    left = errors.select("item_id", F.col("rater").alias("rater_a"), F.col("error").alias("x"))
    right = errors.select("item_id", F.col("rater").alias("rater_b"), F.col("error").alias("y"))
    pairs = left.join(right, "item_id").where(F.col("rater_a") < F.col("rater_b"))
    n, x, y = F.count(F.lit(1)).cast("double"), F.col("x").cast("double"), F.col("y").cast("double")
    agg = pairs.groupBy("rater_a", "rater_b").agg(n.alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = F.sqrt((F.col("n") * F.col("sx") - F.col("sx") ** 2) * (F.col("n") * F.col("sy") - F.col("sy") ** 2))  # errors are 0 or 1
    return agg.select("rater_a", "rater_b", F.col("n").cast("bigint").alias("n"), S.ratio(cov, var).alias("rho"), S.ratio(F.col("sxy"), F.col("sx") + F.col("sy") - F.col("sxy")).alias("jaccard"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
