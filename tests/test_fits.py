"""All fits of the cross-validation over terms that are counted once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.operators import learning as M
from lexiscope.plans import learning as L


@pytest.fixture(scope="module")
def docs(spark):
    import random

    r = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    text = lambda i: " ".join(r.choices(words[: 40 + 20 * (i % 2)], k=r.randint(0, 14))) + (f" twice{i} twice{i}" if i % 9 == 0 else "")
    rows = [(float(i % 2), text(i), i // 2 % 5, i // 3 % 5) for i in range(200)]
    return spark.createDataFrame(rows, "label double, t string, fold0 int, fold1 int").select("label", M.tokens("t").alias("terms"), "fold0", "fold1").persist()


def test_a_term_twice_in_one_text_is_of_one_text(docs):
    assert not [w for w in M.vocabulary(docs, "terms") if "twice" in w]


def test_terms_counted_once_are_those_of_every_fold(docs):
    _, idf = M.fold_vectors(docs, "terms", {"fold0": 5, "fold1": 5}, max_features=70)
    assert sorted(idf) == [(f, k) for f in ("fold0", "fold1") for k in range(5)]
    for (fold, k), own in idf.items():
        train = docs.where(F.col(fold) != k)
        n, df = train.count(), {r.w: r["count"] for r in train.select(F.explode(F.array_distinct("terms")).alias("w")).groupBy("w").count().collect()}
        want = [np.log((n + 1) / (df[w] + 1)) + 1 for w in M.vocabulary(train, "terms", 2, 70)]
        assert np.allclose(np.sort(own[own > 0]), np.sort(want))


def test_fits_are_those_of_the_library(docs):
    counted, idf = M.fold_vectors(docs, "terms", {"fold0": 5, "fold1": 5})
    few = {h: idf[h] for h in (("fold0", 0), ("fold1", 3))}
    told = M.logistic_by_fold(M.chunks(counted, ["fold0", "fold1"]), few, 2000, 1e-9).collect()
    for fold, k in few:
        want = L._predicted(docs, fold, k, lambda n: L.logistic(n).setTol(1e-10)).groupBy("label", "prediction").count().collect()
        assert {(r.label, r.prediction): r.n for r in told if (r.fold, r.held) == (fold, k)} == {(r.label, r.prediction): r["count"] for r in want}


def test_fits_are_not_jobs_of_their_own(spark, docs):
    """Every step of every fit was a job: 25 fits of 100 steps did not end in time."""
    group = "fits"
    spark.sparkContext.setJobGroup(group, group)
    assert [(r.repeat, r.n) for r in L.cross_validated(docs, L.logistic, 2).orderBy("repeat").collect()] == [(0, 200), (1, 200)]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(jobs) < 60
