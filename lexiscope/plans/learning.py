"""Queries of features, neighbours and classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiscope.functions import stats as S
from lexiscope.operators import learning as M
from lexiscope.operators.boosting import Boosted
from lexiscope.plans.agreement import ERR, JUDGE_NAMES, errors, gold, items, votes
from lexiscope.plans.registry import query
from lexiscope.session import cut_lineage
from lexiscope.sources.tables import load

TFIDF_SQL = """WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^\\w]+'), lambda x: length(x) >= 2) AS ws FROM part),
t AS (SELECT p_partkey, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
c AS (SELECT p_partkey, term, count(*) AS c FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(DISTINCT p_partkey) AS n FROM part),
r AS (SELECT p_partkey, term, (1 + ln(c)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN d USING (term), n)
SELECT p_partkey, term, w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)) AS weight FROM r"""


@query("ml_tfidf", TFIDF_SQL)
def ml_tfidf(spark, root):
    return M.tfidf(load(spark, root, "part"), "p_partkey", "p_name")


@query("join_knn")
def join_knn(spark, root):
    """The five nearest of every vector whose id is divisible by 20, against all vectors."""
    v = load(spark, root, "embeddings")
    return M.nearest(v, v.where("vec_id % 20 = 0"), 5)


@query("ml_knn_exemplars")
def ml_knn_exemplars(spark, root):
    """Three exemplars per query: the best of either class, then the best of the rest, from least to most alike."""
    v = load(spark, root, "embeddings")
    near = M.nearest(v, v.where("vec_id % 20 = 0"), 50).join(v.select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("positive")), "id")
    in_class = F.row_number().over(Window.partitionBy("query_id", "positive").orderBy(F.desc("score"), "id"))
    first = near.withColumn("c", in_class).withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("c") > 1).cast("int"), F.desc("score"), "id"))).where("turn <= 3")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return first.select("query_id", "id", "positive", "score", place.alias("place"))


def vote_features(spark, root):
    """(item_id, label, features): votes of all judges as 1, -1 or 0, alerts, length of the text, codes of phrase and kind of artifact.

    Codes are places in the order of the values, which are few.
    """
    from pyspark.ml.feature import VectorAssembler

    v = votes(spark, root).withColumn("x", F.when(F.col("vote"), 1).when(~F.col("vote"), -1).otherwise(0))
    wide = v.groupBy("item_id").pivot("rater", JUDGE_NAMES).agg(F.max("x")).na.fill(0)
    alerts = sum(((F.col(j) == -1).cast("int") for j in JUDGE_NAMES), F.lit(0))
    length = item_texts(spark, root).select("item_id", "label", F.length("text").alias("body_len"))
    about = items(spark, root)
    for name in ("artifact", "expression"):
        codes = about.select(name).distinct().withColumn(f"{name}_code", F.dense_rank().over(Window.orderBy(name)))  # kinds and phrases: a few dozen
        about = about.join(F.broadcast(codes), name, "left")
    rows = length.join(wide.withColumn("alerts", alerts), "item_id").join(about.select("item_id", "artifact_code", "expression_code"), "item_id", "left").na.fill(0)
    return VectorAssembler(inputCols=[*JUDGE_NAMES, "alerts", "body_len", "artifact_code", "expression_code"], outputCol="features").transform(rows).select("item_id", "label", "features")


def item_texts(spark, root):
    """(item_id, label, text): every item with a gold label and the text of its occurrence, by url and phrase; empty where there is none."""
    phrase = F.lower(F.trim("matched_expression")).alias("phrase")
    place = load(spark, root, "nao_unanimes").groupBy("item_id").agg(F.min(F.struct("url", phrase)).alias("p")).select("item_id", "p.*")
    body = load(spark, root, "occurrences").select("url", phrase, "body_text").join(place.select("url", "phrase").distinct(), ["url", "phrase"], "left_semi").groupBy("url", "phrase").agg(F.min("body_text").alias("text"))
    rows = gold(spark, root).select("item_id", F.col("gold").cast("double").alias("label")).join(place, "item_id").join(body, ["url", "phrase"], "left")
    return rows.select("item_id", "label", F.coalesce("text", F.lit("")).alias("text"))


def item_terms(spark, root, repeats):
    """(item_id, label, terms, fold0, fold1, ...), written once, as every fold reads it again."""
    rows = item_texts(spark, root)
    folds = rows.select("item_id", "label").select("item_id", *[M.stratified_fold("item_id", "label", r).alias(f"fold{r}") for r in range(repeats)])
    return cut_lineage(rows.select("item_id", "label", M.tokens("text").alias("terms")).join(folds, "item_id"))


TFIDF_TEXTS_SQL = """WITH i AS (SELECT item_id, min((url, lower(trim(matched_expression)))) AS p FROM nao_unanimes GROUP BY 1 HAVING bool_or(gold_is_ubw) IS NOT NULL),
b AS (SELECT (url, lower(trim(matched_expression))) AS p, min(body_text) AS body FROM occurrences GROUP BY 1),
x AS (SELECT item_id, coalesce(body, '') AS body FROM i LEFT JOIN b USING (p)),
w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'), lambda x: length(x) >= 2) AS ws FROM x),
t AS (SELECT item_id, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
c AS (SELECT item_id, term, count(*) AS c FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM x),
r AS (SELECT item_id, term, (1 + ln(c)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN d USING (term), n)
SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM r"""


@query("ml_tfidf_texts", TFIDF_TEXTS_SQL)
def ml_tfidf_texts(spark, root):
    """The TF-IDF of the items' texts, terms of two or more items."""
    return M.tfidf(item_texts(spark, root), "item_id", "text", 2)


ERROR_LENGTHS_SQL = TFIDF_TEXTS_SQL.split(",\nw AS")[0] + f""", e AS {ERR}
SELECT rater, count(*) FILTER (WHERE error = 0) AS n_right, count(*) FILTER (WHERE error = 1) AS n_wrong,
 quantile_cont(length(body)::DOUBLE, 0.5) FILTER (WHERE error = 0) AS median_right, quantile_cont(length(body)::DOUBLE, 0.5) FILTER (WHERE error = 1) AS median_wrong FROM e JOIN x USING (item_id) GROUP BY rater"""


@query("agg_error_lengths", ERROR_LENGTHS_SQL)
def agg_error_lengths(spark, root):
    """Median length of the texts that each judge got right, and of those it got wrong."""
    e = errors(spark, root).join(item_texts(spark, root).select("item_id", F.length("text").cast("double").alias("length")), "item_id")
    right, wrong = (F.when(F.col("error") == k, F.col("length")) for k in (0, 1))
    return e.groupBy("rater").agg(F.count(right).alias("n_right"), F.count(wrong).alias("n_wrong"), F.percentile(right, F.lit(0.5)).alias("median_right"), F.percentile(wrong, F.lit(0.5)).alias("median_wrong"))


def logistic(n):
    """The penalty is half the squared weights against the summed loss, of ``n`` training rows."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(weightCol="weight", maxIter=2000, regParam=1.0 / n, standardization=False)


def boosted(n, trees=200):
    return Boosted(trees, depth=3, rate=0.1, rows_share=0.8, columns_share=0.8, seed=42)


def _predicted(rows, fold, of, model):
    """Label and prediction of the rows of fold ``of``, by a model that saw the others only."""
    train, test = M.text_vectors(M.with_class_weight(rows.where(F.col(fold) != of)), rows.where(F.col(fold) == of), "terms")
    train = train.select("label", "weight", "features").persist()
    fitted = model(train.count()).fit(train)
    out = cut_lineage(fitted.transform(test).select("label", "prediction"))
    train.unpersist()
    return out


def _measured(out):
    cells = [F.col(x) for x in ("tp", "fp", "fn", "tn")]
    return out.withColumn("kappa", S.kappa2(*cells)).withColumn("mcc", S.mcc(*cells))


@query("ml_logreg")
def ml_logreg(spark, root):
    """TF-IDF of the items' texts and a class-balanced logistic regression, judged on the held-out fold."""
    return _measured(M.confusion(_predicted(item_terms(spark, root, 1), "fold0", 0, logistic)))


@query("ml_gbt")
def ml_gbt(spark, root):
    """TF-IDF of the items' texts and 200 boosted trees of depth 3, judged on the held-out fold."""
    return _measured(M.confusion(_predicted(item_terms(spark, root, 1), "fold0", 0, boosted)))


MIN_NEGATIVES = 10


def _fit(rows, model):
    """Measures on the held-out fold; none where fewer than ``MIN_NEGATIVES`` negatives are there to learn from."""
    rows = cut_lineage(M.with_class_weight(rows).withColumn("fold", M.fold_of("item_id", "label", 0)))
    train, test = rows.where("fold > 0"), rows.where("fold = 0")
    if train.where("label = 0").count() < MIN_NEGATIVES:
        return _measured(M.confusion(test.limit(0).withColumn("prediction", F.lit(0.0)))).limit(0)
    return _measured(M.confusion(model.fit(train).transform(test)))


@query("ml_aggregator")
def ml_aggregator(spark, root):
    """A trained aggregation of the judges' votes, judged on the held-out fold."""
    from pyspark.ml.classification import GBTClassifier

    return _fit(vote_features(spark, root), GBTClassifier(weightCol="weight", maxIter=10, maxDepth=3, stepSize=0.1, seed=7))


REPEATS, FOLDS = 5, 5


def cross_validated(rows, model, repeats=REPEATS):
    """One row per repetition, each of out-of-fold predictions of all rows; mean and population deviation over the repetitions.

    Terms are counted and numbered once for all folds, and every fit of ``model``, a logistic regression, is a task.
    """
    folds = {f"fold{r}": FOLDS for r in range(repeats)}
    counted, idf = M.fold_vectors(rows, "terms", folds)
    fit = model(1)  # its penalty is stated for any number of rows
    told = cut_lineage(M.logistic_by_fold(cut_lineage(M.chunks(counted, [*folds])), idf, fit.getMaxIter(), fit.getTol() / 10))
    p, g, n = F.col("prediction") == 1, F.col("label") == 1, lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    cells = {"tp": p & g, "fp": p & ~g, "fn": ~p & g, "tn": ~p & ~g}
    of = F.substring_index("fold", "fold", -1).cast("int").alias("repeat")
    out = told.groupBy(of).agg(F.sum("n").alias("n"), *[n(c).alias(k) for k, c in cells.items()]).select("n", *cells, "repeat")
    each = Window.partitionBy()
    spread = {f"{m}_{n}": f(m).over(each) for m in ("kappa", "mcc") for n, f in (("mean", F.avg), ("std", F.stddev_pop))}
    return _measured(out).withColumns(spread)


@query("ml_cv")
def ml_cv(spark, root):
    """Kappa and MCC per repetition of a five-fold cross-validation of the logistic regression over the items' texts."""
    return cross_validated(item_terms(spark, root, REPEATS), logistic)
