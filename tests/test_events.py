from lexiscope.operators import events as E


def test_pairing(spark):
    rows = [("p", t, i, s) for i, (t, s) in enumerate(zip([1, 2, 3, 4, 5], "-++-+"))]
    df = spark.createDataFrame(rows, "path string, t int, seq int, sign string")
    got = sorted((r.created_at, r.removed_at, r.is_censored) for r in E.pair_events(df, ["path"], "t", "seq").collect())
    assert got == [(2, 4, 0), (5, None, 1)]
    assert E.pair_events(df.limit(0), ["path"], "t", "seq").count() == 0


def test_diffs(spark):
    text = "\n".join([
        "diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "@@ -3,2 +5,3 @@", "-old", "+new", "++skipped", "+next", "@@ -20 +30 @@", "+far",
        "diff --git a/y.c b/y.c", "@@ -1 +1 @@", "-gone", "@@ -9,0 +8 @@", "+here",
    ])
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "id string, diff_text string")
    got = [(r.path, r.sign, r.text, r.line_no) for r in E.parse_diffs(df, ["id"]).orderBy("pos").collect()]
    # a line that starts with ++ after its sign is skipped and does not advance the number
    assert got == [("x.py", "-", "old", 3), ("x.py", "+", "new", 5), ("x.py", "+", "+skipped", 6), ("x.py", "+", "next", 7), ("x.py", "+", "far", 30), ("y.c", "-", "gone", 1), ("y.c", "+", "here", 8)]


def test_kaplan_meier(spark, tmp_path):
    from lexiscope.plans.report import win_km

    rows = [("code_comment", 1, 0), ("code_comment", 2, 0), ("code_comment", 2, 1), ("code_comment", 3, 0), ("pr_body", 9, 0), ("code_comment", None, 0)]
    spark.createDataFrame(rows, "artifact_type string, time_to_event_days bigint, is_censored int").write.parquet(str(tmp_path / "occurrences.parquet"))
    assert [round(r.survival, 6) for r in win_km(spark, str(tmp_path)).orderBy("t").collect()] == [0.75, 0.5, 0.0]
