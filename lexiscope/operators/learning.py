"""TF-IDF as relations, cosine neighbours in blocks, and classifiers of Spark ML on small feature sets."""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.session import cut_lineage

MAX_QUERIES = 50_000


def tokens(text: str):
    """Words of two or more letters, and pairs of neighbouring words."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: F.length(w) >= 2)
    after = lambda ws, at: F.slice(ws, F.lit(at), F.greatest(F.size(ws) - 1, F.lit(0)))
    both = lambda ws: F.concat(ws, F.zip_with(after(ws, 1), after(ws, 2), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.element_at(F.transform(F.array(words), both), 1)  # in a lambda, for the text is split once and not per pair


def tfidf(docs: DataFrame, id_col: str, text_col: str, min_df: int = 1) -> DataFrame:
    """(id, term, weight): sublinear term frequency, smooth inverse document frequency, unit length.

    Counts are combined map-side. The document frequency goes back over the term by a join whose right side has one row
    per term, so adaptive execution can split a term that is everywhere.
    """
    n = docs.select(id_col).distinct().count()
    tf = docs.select(id_col, F.explode(tokens(text_col)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("c"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    raw = tf.join(df, "term").select(id_col, "term", ((1 + F.log("c")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("weight"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows with the largest cosine for every query, itself left out.

    The stated queries are split by hash into blocks of about ``MAX_QUERIES``; each block meets every row once as a matrix
    product, each task keeps k per query, and the final rank sees tasks times k rows per query. Exact. The driver holds one
    block at a time, and a block's result is written before the next is read.
    """
    q = queries.select(id_col, vec_col)
    blocks = max(1, -(-q.count() // MAX_QUERIES))
    out = None
    for b in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b)
        found = _nearest_of_block(vectors, own.toPandas(), k, id_col, vec_col)
        found = found if blocks == 1 else cut_lineage(found)
        out = found if out is None else out.unionByName(found)
    return out


def _nearest_of_block(vectors: DataFrame, frame: pd.DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    ids = frame[id_col].to_numpy(np.int64)
    block = np.array(frame[vec_col].tolist(), dtype=np.float32).reshape(len(frame), -1)
    block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_s, best_i = np.full((len(ids), k), -2.0, np.float32), np.full((len(ids), k), -1, np.int64)
        for b in batches:
            if not len(b) or not len(ids):
                continue
            own = b[id_col].to_numpy(np.int64)
            m = np.array(b[vec_col].tolist(), dtype=np.float32)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            for lo in range(0, len(ids), 2000):
                s = block[lo : lo + 2000] @ m.T
                s[ids[lo : lo + 2000][:, None] == own[None, :]] = -2
                both_s, both_i = np.concatenate([best_s[lo : lo + 2000], s], 1), np.concatenate([best_i[lo : lo + 2000], np.broadcast_to(own, s.shape)], 1)
                top = np.argsort(-both_s, axis=1, kind="stable")[:, :k]
                best_s[lo : lo + 2000], best_i[lo : lo + 2000] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both_i, top, 1)
        hit = best_i >= 0
        yield pd.DataFrame({"query_id": np.repeat(ids, k)[hit.ravel()], "id": best_i[hit], "score": best_s[hit].astype(np.float64)})

    found = vectors.select(id_col, vec_col).mapInPandas(search, "query_id bigint, id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fold_of(key: str, label: str, repeat: int, folds: int = 5):
    """A fold per row, from the hash of key and repetition."""
    return F.pmod(F.xxhash64(key, F.lit(repeat)), F.lit(folds)).cast("int")


def stratified_fold(key: str, label: str, repeat: int, folds: int = 5):
    """A fold per row, equally many of each class in each; only key and label are sorted, by class."""
    w = Window.partitionBy(label).orderBy(F.md5(F.concat_ws("|", F.col(key), F.lit(str(repeat)))), key)
    return F.pmod(F.row_number().over(w), F.lit(folds)).cast("int")


def _terms_of_each(docs: DataFrame, terms_col: str, *others: str) -> DataFrame:
    """(doc, ..., term); the number is given in a step of its own, for beside ``explode`` it would be one per term."""
    return docs.select(F.monotonically_increasing_id().alias("doc"), *others, terms_col).select("doc", *others, F.explode(terms_col).alias("term"))


def vocabulary(docs: DataFrame, terms_col: str, min_df: int = 2, max_features: int = 20_000) -> list[str]:
    """The most frequent terms of at least ``min_df`` documents; at most ``max_features`` terms reach the driver."""
    each = _terms_of_each(docs, terms_col).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("c"))
    n = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("n")).where(F.col("df") >= min_df)
    return [r.term for r in n.orderBy(F.desc("n"), "term").limit(max_features).select("term").collect()]


def _sublinear(v):
    return Vectors.sparse(v.size, v.indices, 1 + np.log(v.values))


def text_vectors(train: DataFrame, test: DataFrame, terms_col: str, min_df: int = 2, max_features: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Both with ``features``, the TF-IDF of their terms as in ``tfidf``; terms and document frequencies are those of ``train`` alone."""
    from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer

    words = vocabulary(train, terms_col, min_df, max_features)
    if not words:
        raise ValueError(f"no term stands in {min_df} training texts")
    count = CountVectorizerModel.from_vocabulary(words, inputCol=terms_col, outputCol="counts")
    tf = F.udf(_sublinear, VectorUDT())
    counted = [count.transform(d).withColumn("tf", tf("counts")) for d in (train, test)]
    idf = IDF(inputCol="tf", outputCol="idf").fit(counted[0]).idf.toArray() + 1
    scale, unit = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="raw"), Normalizer(p=2.0, inputCol="raw", outputCol="features")
    return tuple(unit.transform(scale.transform(d)).drop("counts", "tf", "raw") for d in counted)


def fold_vectors(rows: DataFrame, terms_col: str, folds: dict[str, int], min_df: int = 2, max_features: int = 20_000) -> tuple[DataFrame, dict[tuple[str, int], np.ndarray]]:
    """Labels, folds and counts of all terms that any fold needs, and for each fold held out (column, number) the inverse document
    frequencies of those terms among the other rows, 0 for a term that is not in their ``vocabulary``.

    ``folds`` has for each column of folds how many there are. Terms are counted once for all folds: the rows outside a fold have
    what all have without what the fold has.
    """
    from pyspark.ml.feature import CountVectorizerModel

    each = _terms_of_each(rows, terms_col, *folds).groupBy("doc", *folds, "term").agg(F.count(F.lit(1)).alias("c"))
    held = [(name, k) for name, count in folds.items() for k in range(count)]
    outside = [(F.count_if(F.col(name) != k).alias(f"df{i}"), F.sum(F.when(F.col(name) != k, F.col("c"))).alias(f"n{i}")) for i, (name, k) in enumerate(held)]
    stats = cut_lineage(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *[x for pair in outside for x in pair]).where(F.col("df") >= min_df).drop("df"))
    found = [stats.where(F.col(f"df{i}") >= min_df).orderBy(F.desc(f"n{i}"), "term").limit(max_features).select("term", f"df{i}").collect() for i in range(len(held))]
    if not all(found):
        raise ValueError(f"no term stands in {min_df} training texts")
    words = sorted({r.term for f in found for r in f})  # at most max_features of each fold, and nearly the same in all
    place, sizes = {w: k for k, w in enumerate(words)}, rows.agg(*[F.count_if(F.col(name) != k) for name, k in held]).first()
    idf = {h: np.zeros(len(words)) for h in held}
    for h, f, n in zip(held, found, sizes):
        idf[h][[place[r[0]] for r in f]] = np.log((n + 1) / (np.array([r[1] for r in f]) + 1)) + 1
    counted = CountVectorizerModel.from_vocabulary(words, inputCol=terms_col, outputCol="counts").transform(rows)
    v = F.unwrap_udt("counts")
    return counted.select("label", *folds, v["indices"].alias("places"), v["values"].alias("counts")), idf


#: bytes of a chunk of texts: places, weights, sizes, labels and folds
CHUNK_SCHEMA = "chunk binary"


def chunks(counted: DataFrame, folds: list[str]) -> DataFrame:
    """The counts of ``fold_vectors`` in chunks of many texts, which are small and quickly read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, counts = b.column("places"), b.column("counts")
            sizes = np.diff(places.offsets.to_numpy()).astype(np.int32)
            own = {f: b.column(f).to_numpy().astype(np.int8) for f in folds}
            data = (places.flatten().to_numpy().astype(np.int32), (1 + np.log(counts.flatten().to_numpy())).astype(np.float32), sizes, b.column("label").to_numpy(), own)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(data), 1)], pa.binary())], ["chunk"])

    return counted.mapInArrow(pack, CHUNK_SCHEMA)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int, tol: float, memory: int = 10) -> np.ndarray:
    """The least of a convex function, which returns value and gradient; until ten steps gain less than ``tol`` of the value each."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    values = [value]
    for _ in range(most):
        d, a = -g, []
        for s, y in reversed(steps):
            a.append((s @ d) / (s @ y))
            d = d - a[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), k in zip(steps, reversed(a)):
            d = d + (k - (y @ d) / (s @ y)) * s
        slope, t = g @ d, 1.0 if steps else 1.0 / max(np.linalg.norm(g), 1e-300)
        if not slope < 0:
            return x
        low, high = 0.0, math.inf
        for _ in range(40):  # a step that gains enough and is long enough (weak Wolfe conditions)
            new, ng = f(x + t * d)
            if not new <= value + 1e-4 * t * slope:
                high = t
            elif ng @ d < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < math.inf else 2 * t
        if not new < value:
            return x
        if (y := ng - g) @ d > 0:
            steps = [*steps[-memory + 1 :], (t * d, y)]
        x, value, g = x + t * d, new, ng
        values.append(value)
        if len(values) > 10 and values[-11] - value <= 10 * tol * max(abs(value), 1e-300):
            return x
    return x


def logistic_by_fold(chunked: DataFrame, idf: dict[tuple[str, int], np.ndarray], most: int, tol: float) -> DataFrame:
    """(fold, held, label, prediction, n): a class-balanced logistic regression for every fold held out, one task each, which sees
    the chunks of all texts; the penalty is half the squared weights against the summed loss."""
    held = list(idf)

    def fit(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        fold, of = held[key[0]]
        scale, train, test, out = idf[fold, of], [], [], []
        for blob in rows["chunk"]:
            places, tf, sizes, label, folds = pickle.loads(zlib.decompress(blob))
            x, of_row, outside = tf * scale[places], np.repeat(np.arange(len(sizes)), sizes), folds[fold] != of
            norm = np.sqrt(np.bincount(of_row, x * x, len(sizes)))
            x = (x / np.where(norm > 0, norm, 1)[of_row]).astype(np.float32)
            for own, into in ((outside, train), (~outside, test)):
                some = own[of_row] & (x > 0)
                into.append((places[some], x[some], np.bincount(of_row[some], minlength=len(sizes))[own], label[own]))
        y = np.concatenate([p[3] for p in train])
        classes = [c for c in (0.0, 1.0) if (y == c).any()]
        if len(classes) < 2:
            w, b = np.zeros(len(scale)), 2 * classes[0] - 1
        else:
            n = len(y)
            weight = [n / (2 * (y == c).sum()) for c in (0.0, 1.0)]

            def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
                value, g = v[:-1] @ v[:-1] / 2, np.append(v[:-1], 0.0)
                for places, x, sizes, label in train:
                    z = _products(places, x, sizes, v[:-1]) + v[-1]
                    share = np.where(label == 1, weight[1], weight[0])
                    value += share @ (np.logaddexp(0, z) - label * z)
                    r = share * (0.5 * (1 + np.tanh(z / 2)) - label)
                    g[:-1] += np.bincount(places, x * np.repeat(r, sizes), len(scale))
                    g[-1] += r.sum()
                return value / n, g / n

            w, b = np.split(lbfgs(loss, np.append(np.zeros(len(scale)), math.log((y == 1).sum() * weight[1] / ((y == 0).sum() * weight[0]))), most, tol), [len(scale)])
        for places, x, sizes, label in test:
            told = (_products(places, x, sizes, w) + b > 0).astype(float)
            out.append(pd.DataFrame({"label": label, "prediction": told}))
        counts = pd.concat(out).groupby(["label", "prediction"]).size().reset_index(name="n")
        return counts.assign(fold=fold, held=of)[["fold", "held", "label", "prediction", "n"]]

    each = chunked.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(len(held) - 1))))
    # one partition a fit: by hash several would meet in one task
    return each.repartitionById(len(held), "fit").groupBy("fit").applyInPandas(fit, "fold string, held int, label double, prediction double, n long")


def _products(places: np.ndarray, x: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each text the sum of its terms' weights in ``w``; 0 for one without terms."""
    out, there = np.zeros(len(sizes)), sizes > 0
    if there.any():
        out[there] = np.add.reduceat(x * w[places], (np.cumsum(sizes) - sizes)[there])
    return out


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # two classes
    total = sum(n.values())
    w = F.lit(1.0)
    for value, count in n.items():
        w = F.when(F.col(label) == value, total / (len(n) * count)).otherwise(w)
    return df.withColumn("weight", w)


def confusion(predicted: DataFrame, label: str = "label") -> DataFrame:
    p, g = F.col("prediction") == 1, F.col(label) == 1
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))
