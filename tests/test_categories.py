from lexiscope.operators import agreement as A
from lexiscope.plans import agreement as G
from lexiscope.plans import report as R


def test_tie_break_holds_differing_categories(spark, tmp_path):
    rows = [("label", True, "A", False, None), ("category", True, "A", True, "B"), ("same", True, "A", True, "A"), ("missing", True, "A", True, None), ("false", False, "A", False, "B"), ("null", None, None, True, "A")]
    long = [(i, r, v, c) for i, va, ca, vb, cb in rows for r, v, c in (("an01", va, ca), ("an02", vb, cb))]
    spark.createDataFrame(long + long[:2], "item_id string, annotator_id string, is_ubw boolean, category_confirmed string").write.parquet(str(tmp_path / "annotations_long.parquet"))
    assert {r.item_id for r in G.smp_tiebreak_whole(spark, str(tmp_path)).collect()} == {"label", "category", "missing"}


def test_agreement_on_category_per_artifact(spark):
    pairs = [("p", "A", "A"), ("p", "A", "B"), ("p", "B", "B"), ("q", "C", "A"), ("q", "C", "C")]
    long = [(f"i{k}", r, True, c) for k, (_, x, y) in enumerate(pairs) for r, c in (("an01", x), ("an02", y))] + [("i0", "an03", False, "A")]
    v = spark.createDataFrame(long, "item_id string, rater string, vote boolean, category string")
    art = spark.createDataFrame([(f"i{k}", p) for k, (p, _, _) in enumerate(pairs)], "item_id string, artifact string")
    got = {r.artifact: r for r in G.category_agreement(v, art).collect()}
    assert set(got) == {"all", "p", "q"} and {r.rater_b for r in got.values()} == {"an02"}
    for name, r in got.items():
        want = A.categorical(spark.createDataFrame([(x, y) for p, x, y in pairs if name in ("all", p)], "x string, y string")).first()
        assert (r.n, r.categories, r.po, r.kappa, r.ac1) == tuple(want)


def test_all_slots_and_totals_by_pattern(spark, make_occurrences):
    rows = make_occurrences([{"matched_expression": " Hack", "body_text": "ugly but fine"}, {"matched_expression": "hack", "body_text": "nothing"}, {"matched_expression": "kludge", "body_text": "none"}])
    got = {tuple(r) for r in R.frequency_by_pattern(rows).select("pattern", "total", "slot", "word", "n").collect()}
    assert got == {("hack", 2, "pre_but", "ugly", 1), ("hack", 2, "post_but", "fine", 1), ("kludge", 1, None, None, None)}
