import random

from pyspark.sql import functions as F

from lexiscope.llm import splits


def test_components_of_a_bundle_are_alike(spark):
    """However many components there are: a plan for bundles is then a plan for rows."""
    r = random.Random(2)
    rows = [(f"o/{i}", *(r.randint(8, 14) for _ in splits.TYPES)) for i in range(1500)]
    comps = spark.createDataFrame(rows, "repository string, " + ", ".join(f"{t} bigint" for t in splits.TYPES)).withColumn("n_rows", sum((F.col(t) for t in splits.TYPES), F.lit(0)))
    kinds = splits.bundled(comps).groupBy("bundle").agg(F.count_distinct(*splits.TYPES).alias("n"))
    assert kinds.where("n > 1").count() == 0


def test_splits_hold_what_was_planned(spark, make_occurrences):
    r = random.Random(8)
    rows = [dict(repo_full_name=f"o/{i}", artifact_type="pr_body", artifact_id=str(k)) for i in range(900) for k in range(r.choice([1, 2, 33, 34, 35]))]
    shares = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double")
    repos = spark.createDataFrame([], "repo_full_name string, html_url string, clone_url string")
    got = {x.split_name: x.n for x in splits.assign(make_occurrences(rows), repos, shares).groupBy("split_name").agg(F.sum("n_rows").alias("n")).collect()}
    assert sum(got.values()) == len(rows) and abs(got["train"] - 0.8 * len(rows)) <= 1
