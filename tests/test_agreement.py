import pytest
from pyspark.sql import functions as F

from lexiscope.functions import stats as S
from lexiscope.operators import agreement as A


@pytest.mark.parametrize("cells,kappa,ac1", [((242, 1, 7, 19), 0.8101288160, 0.9647473176), ((243, 0, 7, 19), 0.8306197715, 0.9692664257), ((246, 3, 4, 16), 0.8064947076, 0.9699347762)])
def test_two_raters(spark, cells, kappa, ac1):
    r = A.with_agreement(spark.createDataFrame([cells], "a int, b int, c int, d int")).first()
    assert r.kappa == pytest.approx(kappa, abs=1e-9) and r.ac1 == pytest.approx(ac1, abs=1e-9)


@pytest.mark.parametrize("k,n,low,high", [(357, 385, 0.8969, 0.9492), (104, 110, 0.8861, 0.9748), (84, 93, 0.8262, 0.9482), (0, 0, None, None)])
def test_wilson(spark, k, n, low, high):
    lo, hi = S.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(lo.alias("l"), hi.alias("h")).first()
    if low is None:
        assert r.l in (None, 0.0) and r.h in (None, 1.0)
    else:
        assert (round(r.l, 4), round(r.h, 4)) == (low, high)


def test_judge_golden(spark):
    r = spark.range(1).select(S.kappa2(*map(F.lit, (331, 8, 16, 16))).alias("k"), S.mcc(*map(F.lit, (331, 8, 16, 16))).alias("m")).first()
    assert r.k == pytest.approx(0.5372141372, abs=1e-9) and r.m == pytest.approx(0.5437225042, abs=1e-9)
    assert spark.range(1).select(S.mcc(*map(F.lit, (347, 24, 0, 0))).alias("m")).first().m is None


def test_resolution(spark):
    rows = [("tie", "a", True), ("tie", "b", False), ("tie", "z", False), ("same", "a", True), ("same", "b", True), ("diff", "a", True), ("diff", "b", False), ("one", "a", False), ("none", "a", None)]
    got = {r.item_id: (r.resolution, r.label) for r in A.resolve(spark.createDataFrame(rows, "item_id string, annotator_id string, is_ubw boolean"), ["z"]).collect()}
    assert got == {"tie": ("desempate", False), "same": ("consenso", True), "diff": ("unresolved", None), "one": ("single_anotador", False)}


def test_majority(spark):
    rows = [("x", True), ("x", True), ("x", False), ("y", True), ("y", False), ("z", None)]
    got = {r.item_id: r.is_true for r in A.majority(spark.createDataFrame(rows, "item_id string, vote boolean")).collect()}
    assert got == {"x": True, "y": False}


def test_categorical_extremes(spark):
    one = A.categorical(spark.createDataFrame([("a", "a")] * 3, "x string, y string")).first()
    assert one.kappa == 1.0 and one.ac1 == 1.0
    assert A.categorical(spark.createDataFrame([], "x string, y string")).count() == 0


def test_constant_errors_have_no_correlation(spark):
    rows = [(i, r, int(r == "a" and i % 2)) for i in range(6) for r in "ab"]
    assert A.error_correlation(spark.createDataFrame(rows, "item_id int, rater string, error int")).first().rho is None


def test_finite_sample(spark):
    got = [r[0] for r in spark.createDataFrame([(5000,), (784,)], "n bigint").select(S.finite_sample(385.0, F.col("n"))).collect()]
    assert got == [385, 259]


def test_bootstrap_draws_with_replacement(spark):
    """The interval of resampled shares against the binomial's, and the same on every run."""
    from lexiscope.plans.agreement import resampled

    judges = spark.createDataFrame([("a", 40, 30), ("b", 1, 1), ("c", 12000, 6000)], "rater string, alerts bigint, right bigint")
    got = {r.rater: (r.low, r.high) for r in resampled(judges, 400).collect()}
    assert abs(got["a"][0] - 0.6) <= 0.05 and abs(got["a"][1] - 0.875) <= 0.05 and got["b"] == (1.0, 1.0) and abs(got["c"][0] - 0.491) < 0.004
    assert got == {r.rater: (r.low, r.high) for r in resampled(judges, 400).collect()}
