import pytest
from pyspark.sql import functions as F

from lexiscope.operators import learning as M
from lexiscope.plans import learning as L


@pytest.fixture(scope="module")
def texts_root(spark, tmp_path_factory):
    """Items whose label stands in their text only; every vote is the same."""
    root = tmp_path_factory.mktemp("texts")
    true = lambda i: i % 2 == 0
    place = [(f"i{i:02d}", " Temp Fix" if i % 3 else "temp fix", f"u{i}", true(i)) for i in range(40)]
    spark.createDataFrame(place + place[:3], "item_id string, matched_expression string, url string, gold_is_ubw boolean").write.parquet(f"{root}/nao_unanimes.parquet")
    bodies = [(f"u{i}", "TEMP FIX", f"{'honest workaround' if true(i) else 'roadmap meeting'} of case {i} and {i % 7}") for i in range(40)]
    spark.createDataFrame(bodies, "url string, matched_expression string, body_text string").write.parquet(f"{root}/occurrences.parquet")
    spark.createDataFrame([(f"i{i:02d}", "an01", True) for i in range(40)], "item_id string, annotator_id string, is_ubw boolean").write.parquet(f"{root}/annotations_long.parquet")
    return str(root)


def test_logistic_regression_reads_the_texts(spark, texts_root):
    r = L.ml_logreg(spark, texts_root).first()
    assert (r.n, r.tp, r.tn, r.kappa) == (8, 4, 4, 1.0)  # stratified: four of each class


def test_boosted_trees_read_the_texts(spark, texts_root):
    rows = L.item_terms(spark, texts_root, 1)
    r = M.confusion(L._predicted(rows, "fold0", 0, lambda n: L.boosted(n, 3))).first()
    assert (r.tp, r.tn) == (4, 4)
    b = L.boosted(32)
    assert (b.getMaxIter(), b.getMaxDepth()) == (200, 3)


def test_cross_validation_predicts_every_row_once_a_repeat(spark, texts_root):
    assert (L.REPEATS, L.FOLDS) == (5, 5)
    out = L.cross_validated(L.item_terms(spark, texts_root, 2), L.logistic, 2).orderBy("repeat").collect()
    assert [(r.repeat, r.n, r.tp, r.tn) for r in out] == [(0, 40, 20, 20), (1, 40, 20, 20)]
    assert all((r.kappa_mean, r.kappa_std, r.mcc_mean, r.mcc_std) == (1.0, 0.0, 1.0, 0.0) for r in out)


def test_vectors_are_the_tfidf_of_the_training_texts(spark):
    docs = spark.createDataFrame([(1, "ugly hack here ugly"), (2, "ugly hack there"), (3, "a hack there")], "id int, t string")
    terms = docs.withColumn("terms", M.tokens("t"))
    train, test = M.text_vectors(terms, terms.where("id = 1"), "terms")
    want = {(r.id, round(r.weight, 9)) for r in M.tfidf(docs, "id", "t", 2).collect()}
    assert {(r.id, round(float(x), 9)) for r in train.collect() for x in r.features.values} == want
    assert test.first().features == train.where("id = 1").first().features
    assert M.vocabulary(terms, "terms", 2, 2) == ["hack", "ugly"]


def test_pairs_of_words(spark):
    rows = spark.createDataFrame([("One two, three",), ("one",), ("",), ("a b",)], "t string").select(M.tokens("t").alias("x")).collect()
    assert [r.x for r in rows] == [["one", "two", "three", "one two", "two three"], ["one"], [], []]


def test_neighbours_in_blocks(spark, monkeypatch):
    import random

    r = random.Random(2)
    v = spark.createDataFrame([(i, [r.random() for _ in range(6)]) for i in range(60)], "vec_id bigint, embedding array<double>")
    once = sorted(map(tuple, M.nearest(v, v, 3).collect()))
    monkeypatch.setattr(M, "MAX_QUERIES", 17)
    assert sorted(map(tuple, M.nearest(v, v, 3).collect())) == once
