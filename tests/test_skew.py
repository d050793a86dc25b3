import random
from collections import Counter, defaultdict
from statistics import median

from pyspark.sql import functions as F

from lexiscope.operators import skew

SCHEMA = "k string, artifact_type string, artifact_id string, is_censored int, time_to_event_days bigint, n string, days string, key string"


def facts(spark, n=3000):
    r = random.Random(3)
    rows = []
    for i in range(n):
        k = r.choice(["hot"] * 25 + ["warm", None] + [f"k{j}" for j in range(40)])
        rows.append((k, r.choice(["a", "b", None]), r.choice([None, "1", str(i % 70), "7"]), r.choice([0, 1, None]), r.choice([None, 0, 5, i % 90]), "x", "y", "z"))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_profile_against_brute_force(spark):
    rows, df = facts(spark)
    plan = skew.plan_shards(skew.key_loads(df, "k"), 4)
    assert plan.shards["hot"] >= 2
    got = {r.key_value: r for r in skew.key_profile(df, "k", plan).collect()}
    by = defaultdict(list)
    for row in rows:
        by[row[0]].append(row)
    assert set(got) == set(by)
    for k, own in by.items():
        days = [d for _, _, _, c, d, *_ in own if c == 0 and d is not None]
        assert got[k].n_rows == len(own) and got[k].n_artifacts == len({(a, b) for _, a, b, *_ in own}) and got[k].n_removed == len(days)
        assert got[k].max_days == max(days, default=None) and (not days or abs(got[k].median_days - median(days)) < 1e-9)


def test_planned_tasks_are_even(spark):
    _, df = facts(spark)
    plan = skew.plan_shards(skew.key_loads(df, "k"), 6)
    sizes = Counter(r[0] for r in skew.place(skew.shard_facts(df.withColumn("u", F.monotonically_increasing_id()), "k", ["u"], plan), "k", plan).select(F.spark_partition_id()).collect())
    assert max(sizes.values()) < 2.2 * 3000 / 6


def test_join_equals_plain_join(spark):
    _, df = facts(spark)
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 4), (None, 9)], "k string, v int")
    plan = skew.plan_shards(skew.key_loads(df, "k"), 4)
    agg = lambda d: sorted(map(tuple, d.groupBy("k").agg(F.count("*"), F.sum("v")).collect()), key=str)
    assert agg(skew.balanced_join(df, side, "k", ["artifact_id"], plan)) == agg(df.join(side, "k", "left"))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = skew.plan_shards(skew.key_loads(df, "k"), 4)
    assert skew.key_profile(df, "k", plan).count() == 0 and skew.dominant_keys(df, ["k", "artifact_id"]).count() == 0


def test_dominant(spark):
    df = spark.createDataFrame([("a", "x")] * 49 + [("b", None)], "f string, g string")
    assert sorted(map(tuple, skew.dominant_keys(df, ["f", "g"]).collect())) == [("f", "a"), ("f", "b"), ("g", "x")]
