from lexiscope.plans import sampling as L
from lexiscope.plans.texts import KEY, NEAR_MISS


def pool(spark, flags):
    rows = [("r", "commit_message", f"a{i:03d}", "hack", f) for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, "repo_full_name string, artifact_type string, artifact_id string, matched_expression string, flags array<string>")


def test_near_misses_fill_up_from_other_flagged_records(spark):
    first, second = list(NEAR_MISS)[:2]
    got = L.near_miss_pool(pool(spark, [[first]] * 30 + [[second]] * 3 + [[]] * 20), 24).select(*KEY).collect()
    ids = [r.artifact_id for r in got]
    assert len(ids) == len(set(ids)) == 24  # 4 and 3 by quota, 17 more of the first pattern; the other patterns are empty
    assert {"a030", "a031", "a032"} <= set(ids) and max(ids) < "a033"


def test_near_misses_end_where_nothing_is_flagged(spark):
    first = next(iter(NEAR_MISS))
    assert L.near_miss_pool(pool(spark, [[first]] * 5 + [[]] * 9), 24).count() == 5
    assert L.near_miss_pool(pool(spark, [[]] * 4), 24).count() == 0


def test_near_misses_keep_the_quota_of_each_pattern(spark):
    got = L.near_miss_pool(pool(spark, [[n] for n in NEAR_MISS for _ in range(6)]), 12)
    assert got.count() == 12
    assert got.join(pool(spark, [[n] for n in NEAR_MISS for _ in range(6)]), KEY).selectExpr("flags[0] AS f").groupBy("f").count().where("count <> 2").count() == 0
