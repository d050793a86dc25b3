"""Boosted trees over columns spread over tasks."""

import numpy as np
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from lexiscope.operators import boosting as B
from lexiscope.plans import learning as L


class Alone:
    own = 0

    def __call__(self, text):
        return [text]


def _table(n=300, width=12, seed=5):
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, width)) < 0.4, r.random((n, width)).round(1), 0.0)
    return x, ((x[:, 2] > 0.3) ^ (x[:, 7] > 0)).astype(float)


def test_a_split_is_the_best_of_all():
    x, y = _table()
    g, h, (row, column) = 0.5 - y, np.full(len(y), 0.25), np.nonzero(x)
    columns = B.sorted_columns(row, column, x[row, column], x.shape[1])
    gain, c, at = B.best_splits(g, h, np.ones(len(y), int), [1], columns, np.ones(x.shape[1], bool))[0]
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + B.PENALTY)
    every = {(k, v): part(x[:, k] >= v) + part(x[:, k] < v) - part(g == g) for k in range(x.shape[1]) for v in set(x[:, k]) - {0}}
    assert abs(gain - max(every.values())) < 1e-6 and abs(every[c, columns["value"][at]] - gain) < 1e-6


def test_trees_of_many_tasks_are_those_of_one(spark):
    """One stage grows all trees; before, every level of every tree was a job of its own over all columns as dense rows."""
    x, y = _table()
    train = spark.createDataFrame([(float(v), 1.0, SparseVector(x.shape[1], np.flatnonzero(r), r[r > 0])) for r, v in zip(x, y)], ["label", "weight", "features"])
    train = train.repartition(3).persist()
    boosted = L.boosted(len(y), 40)
    spark.sparkContext.setJobGroup("trees", "trees")
    model = boosted.fit(train)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("trees")
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(model.trees) == 40 and len(jobs) < 15
    kept = train.select(F.monotonically_increasing_id().alias("id"), "label", "features").orderBy("id").collect()
    x, y = np.array([r.features.toArray() for r in kept]), np.array([r.label for r in kept])
    row, column = np.nonzero(x)
    alone = B.grown(y, np.ones(len(y)), B.sorted_columns(row, column, x[row, column], x.shape[1]), x.shape[1], 40, 3, 0.1, 0.8, 0.8, 42, Alone())
    assert [t["splits"] for t in alone] == [t["splits"] for t in model.trees]
    assert np.allclose([t["leaves"] for t in alone], [t["leaves"] for t in model.trees])
    assert model.transform(train).where("label = prediction").count() > 0.95 * len(y)
    every = [np.arange(x.shape[1])] * len(x)
    assert np.allclose(B.margins(model.trees, every, list(x)), B.margins(alone, [np.flatnonzero(r) for r in x], [r[r > 0] for r in x]))
    train.unpersist()
