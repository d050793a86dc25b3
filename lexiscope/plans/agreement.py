"""Queries of votes, labels, judges and precision over annotations_long and nao_unanimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiscope.functions import stats as S
from lexiscope.operators import agreement as A
from lexiscope.plans.registry import query
from lexiscope.sources.tables import load

RATERS = ["wendell", "bruno", "miguel"]
Z = S.Z
V = "(SELECT item_id, annotator_id AS rater, bool_or(is_ubw) AS vote FROM annotations_long GROUP BY ALL)"
R = "(SELECT DISTINCT item_id, rater, vote FROM (" + " UNION ALL ".join(f"SELECT item_id, '{r}' AS rater, voto__{r} AS vote FROM nao_unanimes" for r in RATERS) + "))"
G = "(SELECT item_id, bool_or(gold_is_ubw) AS gold FROM nao_unanimes GROUP BY item_id HAVING bool_or(gold_is_ubw) IS NOT NULL)"
ART = "(SELECT item_id, min(artifact_type) AS artifact, min(sample_stratum) AS stratum, min(matched_expression) AS expression FROM annotations_long GROUP BY item_id)"


def votes(spark, root):
    """One vote per item and annotator; repeated rows are one, contradicting ones count as true."""
    return load(spark, root, "annotations_long").groupBy("item_id", F.col("annotator_id").alias("rater")).agg(F.bool_or("is_ubw").alias("vote"))


def raters(spark, root):
    wide = load(spark, root, "nao_unanimes")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(f"voto__{r}").alias("vote")) for r in RATERS]))
    return wide.select("item_id", each.alias("v")).select("item_id", "v.rater", "v.vote").distinct()


def gold(spark, root):
    return load(spark, root, "nao_unanimes").groupBy("item_id").agg(F.bool_or("gold_is_ubw").alias("gold")).where("gold IS NOT NULL")


def items(spark, root):
    return load(spark, root, "annotations_long").groupBy("item_id").agg(F.min("artifact_type").alias("artifact"), F.min("sample_stratum").alias("stratum"), F.min("matched_expression").alias("expression"))


def judged(spark, root):
    """Votes of the judges beside the recorded gold; a null vote is an abstention."""
    return votes(spark, root).join(gold(spark, root), "item_id")


MAJ = f"""SELECT item_id, count(*) FILTER (WHERE vote) AS n_true, count(*) AS n_votes, 2 * count(*) FILTER (WHERE vote) > count(*) AS is_true,
 count(*) FILTER (WHERE vote) IN (0, count(*)) AS is_unanimous FROM {{v}} WHERE vote IS NOT NULL GROUP BY item_id"""


@query("agg_vote_majority", MAJ.format(v=R))
def agg_vote_majority(spark, root):
    return A.majority(raters(spark, root))


RES = """(WITH a AS (SELECT item_id, min(is_ubw) FILTER (WHERE annotator_id = 'an01') AS tie, count(*) FILTER (WHERE annotator_id <> 'an01' AND is_ubw) AS yes,
  count(*) FILTER (WHERE annotator_id <> 'an01' AND NOT is_ubw) AS no, count(DISTINCT annotator_id) FILTER (WHERE annotator_id <> 'an01') AS n_primary, count(*) FILTER (WHERE annotator_id = 'an01') AS n_tie
  FROM (SELECT DISTINCT item_id, annotator_id, bool_or(is_ubw) OVER (PARTITION BY item_id, annotator_id) AS is_ubw FROM annotations_long WHERE is_ubw IS NOT NULL) GROUP BY item_id)
SELECT item_id, CASE WHEN n_tie > 0 THEN tie WHEN yes = 0 OR no = 0 THEN yes > 0 END AS label,
 CASE WHEN n_tie > 0 THEN 'desempate' WHEN NOT (yes = 0 OR no = 0) THEN 'unresolved' WHEN n_primary >= 2 THEN 'consenso' ELSE 'single_anotador' END AS resolution, n_primary FROM a)"""


def resolved(spark, root):
    rows = votes(spark, root).select("item_id", F.col("rater").alias("annotator_id"), F.col("vote").alias("is_ubw"))
    return A.resolve(rows, ["an01"])


@query("agg_resolution", f"SELECT * FROM {RES}")
def agg_resolution(spark, root):
    return resolved(spark, root)


def wilson_sql(k, n, z=Z):
    p, zz = f"({k} / {n}::DOUBLE)", f"{z * z}e0"
    centre = f"({p} + {zz} / (2 * {n})) / (1 + {zz} / {n})"
    half = f"{z}e0 * sqrt({p} * (1 - {p}) / {n} + {zz} / (4.0e0 * {n} * {n})) / (1 + {zz} / {n})"
    return f"greatest({centre} - {half}, 0.0)", f"least({centre} + {half}, 1.0)"


LOW, HIGH = wilson_sql("tp", "n")
PREC = "SELECT {by}, n, tp, tp / n::DOUBLE AS precision, " + LOW + " AS low, " + HIGH + " AS high, tp / n::DOUBLE < 0.5 AS is_alert FROM (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE label) AS tp FROM " + RES + " r JOIN " + ART + " t USING (item_id) WHERE resolution NOT IN ('unresolved', 'single_anotador') GROUP BY {by})"


@query("agg_precision_wilson", PREC.format(by="artifact"))
def agg_precision_wilson(spark, root):
    return A.precision(resolved(spark, root).join(items(spark, root), "item_id"), ["artifact"])


query("agg_precision_by_expression", PREC.format(by="expression"))(lambda spark, root: A.precision(resolved(spark, root).join(items(spark, root), "item_id"), ["expression"]))


@query("fn_wilson", PREC.format(by="stratum"))
def fn_wilson(spark, root):
    return A.precision(resolved(spark, root).join(items(spark, root), "item_id"), ["stratum"])


WEIGHTS = "(SELECT lower(trim(artifact_type)) AS artifact, count(*) / sum(count(*)) OVER ()::DOUBLE AS weight FROM occurrences GROUP BY 1)"


def weights(spark, root):
    n = load(spark, root, "occurrences").groupBy(F.lower(F.trim("artifact_type")).alias("artifact")).agg(F.count(F.lit(1)).alias("n_population"))
    return n.withColumn("weight", F.col("n_population") / F.sum("n_population").over(Window.partitionBy()).cast("double"))


@query("agg_strata_weights", "SELECT lower(trim(artifact_type)) AS artifact, count(*) AS n_population, count(*) / (sum(count(*)) OVER ())::DOUBLE AS weight FROM occurrences GROUP BY 1")
def agg_strata_weights(spark, root):
    return weights(spark, root)


@query("agg_precision_reweighted", "WITH w AS (SELECT lower(trim(artifact_type)) AS artifact, count(*) / (sum(count(*)) OVER ())::DOUBLE AS weight FROM occurrences GROUP BY 1), p AS (" + PREC.format(by="artifact") + ") SELECT sum(weight * precision) AS precision, sum(weight) AS coverage FROM p JOIN w USING (artifact)")
def agg_precision_reweighted(spark, root):
    p = agg_precision_wilson(spark, root).join(weights(spark, root), "artifact")
    return p.agg(F.sum(F.col("weight") * F.col("precision")).alias("precision"), F.sum("weight").alias("coverage"))


@query("agg_specificity", f"""
WITH f AS (SELECT DISTINCT item_id, unnest(string_split(near_miss_flags, ';')) AS flag FROM annotations_long WHERE near_miss_flags IS NOT NULL AND near_miss_flags <> ''),
j AS (SELECT flag, label FROM f JOIN {RES} r USING (item_id) WHERE label IS NOT NULL)
SELECT flag, count(*) AS n, count(*) FILTER (WHERE NOT label) AS n_rejected, count(*) FILTER (WHERE NOT label) / count(*)::DOUBLE AS specificity FROM (SELECT * FROM j UNION ALL SELECT '(total)', label FROM j) GROUP BY flag""")
def agg_specificity(spark, root):
    flags = load(spark, root, "annotations_long").where("near_miss_flags <> ''").select("item_id", F.explode(F.split("near_miss_flags", ";")).alias("flag")).distinct()
    j = flags.join(resolved(spark, root), "item_id").where("label IS NOT NULL").select("flag", "label")
    both = j.unionByName(j.withColumn("flag", F.lit("(total)")))
    return both.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label")).alias("n_rejected")).withColumn("specificity", S.ratio(F.col("n_rejected"), F.col("n")))


PAIRS = """SELECT {by} l.rater AS rater_a, r.rater AS rater_b, count(*) AS n, count(*) FILTER (WHERE l.vote AND r.vote) AS a, count(*) FILTER (WHERE l.vote AND NOT r.vote) AS b,
 count(*) FILTER (WHERE NOT l.vote AND r.vote) AS c, count(*) FILTER (WHERE NOT l.vote AND NOT r.vote) AS d FROM {v} l JOIN {v} r ON l.item_id = r.item_id AND l.rater < r.rater {more} WHERE l.vote IS NOT NULL AND r.vote IS NOT NULL GROUP BY {by} l.rater, r.rater"""
MEASURES = """(a + d) / (a + b + c + d)::DOUBLE AS po,
 ((a + d) / (a + b + c + d)::DOUBLE - ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d)::DOUBLE * (a + b + c + d))) / nullif(1 - ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d)::DOUBLE * (a + b + c + d)), 0) AS kappa,
 ((a + d) / (a + b + c + d)::DOUBLE - 2 * ((2 * a + b + c) / (2.0e0 * (a + b + c + d))) * (1 - (2 * a + b + c) / (2.0e0 * (a + b + c + d)))) / nullif(1 - 2 * ((2 * a + b + c) / (2.0e0 * (a + b + c + d))) * (1 - (2 * a + b + c) / (2.0e0 * (a + b + c + d))), 0) AS ac1"""


@query("agg_pairwise_kappa", f"SELECT *, {MEASURES} FROM (" + PAIRS.format(v=V, by="", more="") + ")")
def agg_pairwise_kappa(spark, root):
    return A.pairwise(votes(spark, root).where("vote IS NOT NULL"))


@query("agg_cohen_kappa_2x2", f"SELECT *, {MEASURES} FROM (" + PAIRS.format(v=R, by="", more="") + ")")
def agg_cohen_kappa_2x2(spark, root):
    return A.pairwise(raters(spark, root).where("vote IS NOT NULL"))


CATS = f"(SELECT l.confidence AS x, r.confidence AS y FROM (SELECT item_id, min(confidence) AS confidence FROM annotations_long WHERE annotator_id = 'an01' GROUP BY 1) l JOIN (SELECT item_id, min(confidence) AS confidence FROM annotations_long WHERE annotator_id = 'an02' GROUP BY 1) r USING (item_id) WHERE l.confidence IS NOT NULL AND r.confidence IS NOT NULL)"


@query("agg_cohen_kappa", f"""
WITH p AS {CATS}, t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE x = y) AS same FROM p),
m AS (SELECT c, sum(px) AS px, sum(py) AS py FROM (SELECT x AS c, 1 AS px, 0 AS py FROM p UNION ALL SELECT y, 0, 1 FROM p) GROUP BY c),
s AS (SELECT count(*) AS q, sum(px::DOUBLE * py) AS pxy, sum((px + py) / (2 * n) * (1 - (px + py) / (2 * n))) AS chance FROM m, t)
SELECT n::BIGINT AS n, q AS categories, same / n AS po, CASE WHEN q < 2 OR pxy / (n * n) = 1 THEN 1 ELSE (same / n - pxy / (n * n)) / (1 - pxy / (n * n)) END AS kappa,
 CASE WHEN q < 2 THEN 1 ELSE (same / n - chance / (q - 1)) / (1 - chance / (q - 1)) END AS ac1 FROM t, s""")
def agg_cohen_kappa(spark, root):
    """Two raters over several categories: the confidence they state."""
    rows = load(spark, root, "annotations_long")
    of = lambda r, c: rows.where(F.col("annotator_id") == r).groupBy("item_id").agg(F.min("confidence").alias(c))
    return A.categorical(of("an01", "x").join(of("an02", "y"), "item_id").dropna().select("x", "y"))


query("agg_gwet_ac1", f"SELECT rater_a, rater_b, ac1 FROM (SELECT *, {MEASURES} FROM (" + PAIRS.format(v=R, by="", more="") + "))")(lambda spark, root: agg_cohen_kappa_2x2(spark, root).select("rater_a", "rater_b", "ac1"))


@query("agg_fleiss", f"""
WITH i AS (SELECT item_id, count(*) FILTER (WHERE vote) AS y, count(*) AS k FROM {R} WHERE vote IS NOT NULL GROUP BY 1 HAVING count(*) = 3),
s AS (SELECT count(*) AS n, avg((y * y + (3 - y) * (3 - y) - 3) / 6.0e0) AS po, avg(y / 3.0e0) AS p FROM i)
SELECT n, po, (po - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))) AS kappa, (po - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)) AS ac1 FROM s""")
def agg_fleiss(spark, root):
    return A.fleiss(raters(spark, root).where("vote IS NOT NULL"), 3)


BY_ART = PAIRS.format(v=V, by="t.artifact,", more=f"JOIN {ART} t ON t.item_id = l.item_id")


@query("agg_agreement_report", f"SELECT 'all' AS artifact, *, {MEASURES} FROM (" + PAIRS.format(v=V, by="", more="") + f") WHERE rater_a = 'an01' UNION ALL SELECT *, {MEASURES} FROM ({BY_ART}) WHERE rater_a = 'an01'")
def agg_agreement_report(spark, root):
    """The first annotator against the others, overall and per kind of artifact."""
    v = votes(spark, root).where("vote IS NOT NULL").join(items(spark, root).select("item_id", "artifact"), "item_id")
    both = v.withColumn("artifact", F.explode(F.array(F.lit("all"), F.col("artifact"))))
    left = both.where("rater = 'an01'").select("item_id", "artifact", F.col("rater").alias("rater_a"), F.col("vote").alias("x"))
    right = v.where("rater > 'an01'").select("item_id", F.col("rater").alias("rater_b"), F.col("vote").alias("y"))
    cells = left.join(right, "item_id").groupBy("artifact", "rater_a", "rater_b").agg(F.count(F.lit(1)).alias("n"), *A.binary_cells(F.col("x"), F.col("y")))
    return A.with_agreement(cells)


def categories(spark, root):
    """Vote and confirmed category per item and annotator; the category is that of the true rows."""
    rows = load(spark, root, "annotations_long")
    return rows.groupBy("item_id", F.col("annotator_id").alias("rater")).agg(F.bool_or("is_ubw").alias("vote"), F.min(F.when(F.col("is_ubw"), F.col("category_confirmed"))).alias("category"))


def category_agreement(v, artifacts):
    """Agreement on the category where both votes are true, of the first annotator with the others, overall and per kind of artifact."""
    v = v.where("vote AND category IS NOT NULL").join(artifacts, "item_id")
    left = v.where("rater = 'an01'").select("item_id", F.explode(F.array(F.lit("all"), F.col("artifact"))).alias("artifact"), F.col("rater").alias("rater_a"), F.col("category").alias("x"))
    right = v.where("rater > 'an01'").select("item_id", F.col("rater").alias("rater_b"), F.col("category").alias("y"))
    return A.categorical(left.join(right, "item_id"), ["artifact", "rater_a", "rater_b"])


@query("agg_agreement_category")
def agg_agreement_category(spark, root):
    """The part of the agreement report on category_confirmed; that on the label is agg_agreement_report."""
    return category_agreement(categories(spark, root), items(spark, root).select("item_id", "artifact"))


@query("agg_agreement_by_stratum", f"SELECT *, {MEASURES} FROM (" + PAIRS.format(v=V, by="t.stratum,", more=f"JOIN {ART} t ON t.item_id = l.item_id") + ")")
def agg_agreement_by_stratum(spark, root):
    v = votes(spark, root).where("vote IS NOT NULL").join(items(spark, root).select("item_id", "stratum"), "item_id")
    return A.pairwise(v, ["stratum"])


CELLS = "count(*) FILTER (WHERE vote AND gold) AS tp, count(*) FILTER (WHERE vote AND NOT gold) AS fp, count(*) FILTER (WHERE NOT vote AND gold) AS fn, count(*) FILTER (WHERE NOT vote AND NOT gold) AS tn"
PEN = "count(*) FILTER (WHERE coalesce(vote, true) AND gold) AS a, count(*) FILTER (WHERE coalesce(vote, true) AND NOT gold) AS b, count(*) FILTER (WHERE NOT coalesce(vote, true) AND gold) AS c, count(*) FILTER (WHERE NOT coalesce(vote, true) AND NOT gold) AS d"
K2 = "((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (nullif(tp + fp + fn + tn, 0)::DOUBLE * (tp + fp + fn + tn))) / nullif(1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (nullif(tp + fp + fn + tn, 0)::DOUBLE * (tp + fp + fn + tn)), 0)"
KPEN = K2.replace("tp", "a").replace("fp", "b").replace("fn", "c").replace("tn", "d")
MCC = "(tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0)"
JUDGES = f"(SELECT rater, count(*) AS n, count(*) FILTER (WHERE vote IS NULL) AS abstained, count(*) FILTER (WHERE NOT vote) AS alerts, count(*) FILTER (WHERE NOT gold) AS negatives, {CELLS}, {PEN} FROM {V} v JOIN {G} g USING (item_id) GROUP BY rater)"


def judge_cells():
    v, g, p = F.col("vote"), F.col("gold"), F.coalesce("vote", F.lit(True))
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("abstained"), F.count_if(~v).alias("alerts"), F.count_if(~g).alias("negatives"),
        F.count_if(v & g).alias("tp"), F.count_if(v & ~g).alias("fp"), F.count_if(~v & g).alias("fn"), F.count_if(~v & ~g).alias("tn"),
        F.count_if(p & g).alias("a"), F.count_if(p & ~g).alias("b"), F.count_if(~p & g).alias("c"), F.count_if(~p & ~g).alias("d"),
    ]


def judge_measures(df):
    tp, fp, fn, tn, a, b, c, d = (F.col(x) for x in ("tp", "fp", "fn", "tn", "a", "b", "c", "d"))
    return (
        df.withColumn("alert_precision", S.ratio(tn, F.col("alerts"))).withColumn("coverage", S.ratio(tn, F.col("negatives"))).withColumn("accuracy", S.ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("mcc", S.mcc(tp, fp, fn, tn)).withColumn("kappa", S.kappa2(tp, fp, fn, tn)).withColumn("kappa_penalised", S.kappa2(a, b, c, d)).drop("a", "b", "c", "d")
    )


def agreement_by_class(df):
    """``judge_measures`` with AC1 and how often a judge agrees on positives and on negatives, each with its Wilson interval."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = df.withColumn("ac1", S.ac1(tp, fp, fn, tn))
    for name, k, n in (("positives", tp, tp + fn), ("negatives", tn, tn + fp)):
        low, high = S.wilson(k, n)
        out = out.withColumns({f"on_{name}": S.ratio(k, n), f"on_{name}_low": low, f"on_{name}_high": high})
    return out


JM = f"tn / nullif(alerts, 0)::DOUBLE AS alert_precision, tn / nullif(negatives, 0)::DOUBLE AS coverage, (tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS accuracy, {MCC} AS mcc, {K2} AS kappa, {KPEN} AS kappa_penalised"


@query("agg_judge_metrics", f"SELECT rater, n, abstained, alerts, negatives, tp, fp, fn, tn, {JM} FROM {JUDGES}")
def agg_judge_metrics(spark, root):
    return judge_measures(judged(spark, root).groupBy("rater").agg(*judge_cells()))


AC1 = "((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE - 2 * q * (1 - q)) / nullif(1 - 2 * q * (1 - q), 0)"
POS, NEG = wilson_sql("tp", "(tp + fn)"), wilson_sql("tn", "(tn + fp)")


@query("agg_judge_report", f"""SELECT rater, tp, fp, fn, tn, {AC1} AS ac1, tp / nullif(tp + fn, 0)::DOUBLE AS on_positives, {POS[0]} AS on_positives_low, {POS[1]} AS on_positives_high,
 tn / nullif(tn + fp, 0)::DOUBLE AS on_negatives, {NEG[0]} AS on_negatives_low, {NEG[1]} AS on_negatives_high
 FROM (SELECT *, (2 * tp + fp + fn) / nullif(2 * (tp + fp + fn + tn), 0)::DOUBLE AS q FROM {JUDGES})""")
def agg_judge_report(spark, root):
    """AC1 and the agreement in either direction, beside the measures of agg_judge_metrics."""
    rows = agreement_by_class(agg_judge_metrics(spark, root))
    return rows.select("rater", "tp", "fp", "fn", "tn", "ac1", *[f"on_{c}{x}" for c in ("positives", "negatives") for x in ("", "_low", "_high")])


@query("fn_mcc", f"SELECT rater, {MCC} AS mcc FROM {JUDGES}")
def fn_mcc(spark, root):
    return agg_judge_metrics(spark, root).select("rater", "mcc")


@query("fn_kappa_band", f"SELECT rater, CASE WHEN k < 0 THEN 'poor' WHEN k < 0.2 THEN 'slight' WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate' WHEN k < 0.8 THEN 'substantial' WHEN k IS NOT NULL THEN 'almost perfect' END AS band FROM (SELECT rater, {K2} AS k FROM {JUDGES})")
def fn_kappa_band(spark, root):
    return agg_judge_metrics(spark, root).select("rater", S.kappa_band(F.col("kappa")).alias("band"))


@query("agg_by_dimension", f"""
WITH j AS (SELECT rater, vote, gold, CASE WHEN count(*) OVER (PARTITION BY rater, expression) < 10 THEN '(outros)' ELSE expression END AS expression FROM {V} v JOIN {G} g USING (item_id) JOIN {ART} t USING (item_id))
SELECT rater, expression, n, abstained, alerts, negatives, tp, fp, fn, tn, {JM} FROM (SELECT rater, expression, count(*) AS n, count(*) FILTER (WHERE vote IS NULL) AS abstained, count(*) FILTER (WHERE NOT vote) AS alerts, count(*) FILTER (WHERE NOT gold) AS negatives, {CELLS}, {PEN} FROM j GROUP BY ALL)""")
def agg_by_dimension(spark, root):
    """Judges by phrase; phrases with fewer than ten items of a judge are one group."""
    j = judged(spark, root).join(items(spark, root).select("item_id", "expression"), "item_id")
    cells = j.groupBy("rater", "expression").agg(*judge_cells())
    sums = [F.sum(c).alias(c) for c in ("n", "abstained", "alerts", "negatives", "tp", "fp", "fn", "tn", "a", "b", "c", "d")]
    return judge_measures(cells.withColumn("expression", F.when(F.col("n") < 10, "(outros)").otherwise(F.col("expression"))).groupBy("rater", "expression").agg(*sums))


@query("agg_kappa_vs_rater", f"""
WITH p AS (SELECT v.rater AS judge, r.rater AS rater, count(*) AS n, count(*) FILTER (WHERE v.vote AND r.vote) AS a, count(*) FILTER (WHERE v.vote AND NOT r.vote) AS b, count(*) FILTER (WHERE NOT v.vote AND r.vote) AS c, count(*) FILTER (WHERE NOT v.vote AND NOT r.vote) AS d
 FROM {V} v JOIN {R} r USING (item_id) WHERE v.vote IS NOT NULL AND r.vote IS NOT NULL GROUP BY ALL)
SELECT judge, avg(kappa) AS mean_kappa, min(kappa) AS min_kappa FROM (SELECT *, {MEASURES} FROM p) GROUP BY judge""")
def agg_kappa_vs_rater(spark, root):
    v = votes(spark, root).where("vote IS NOT NULL").select("item_id", F.col("rater").alias("judge"), F.col("vote").alias("x"))
    r = raters(spark, root).where("vote IS NOT NULL").select("item_id", "rater", F.col("vote").alias("y"))
    k = A.with_agreement(v.join(r, "item_id").groupBy("judge", "rater").agg(*A.binary_cells(F.col("x"), F.col("y"))))
    return k.groupBy("judge").agg(F.avg("kappa").alias("mean_kappa"), F.min("kappa").alias("min_kappa"))


ERR = f"(SELECT item_id, rater, (vote <> gold)::INTEGER AS error FROM {V} v JOIN {G} g USING (item_id) WHERE vote IS NOT NULL)"
CORR = f"""SELECT rater_a, rater_b, n, (n * sxy - sx * sy)::DOUBLE / nullif(sqrt((n * sx - sx * sx)::DOUBLE * (n * sy - sy * sy)), 0) AS rho, sxy / nullif(sx + sy - sxy, 0)::DOUBLE AS jaccard
FROM (SELECT l.rater AS rater_a, r.rater AS rater_b, count(*) AS n, sum(l.error) AS sx, sum(r.error) AS sy, sum(l.error * r.error) AS sxy FROM {ERR} l JOIN {ERR} r ON l.item_id = r.item_id AND l.rater < r.rater GROUP BY ALL)"""


def errors(spark, root):
    return judged(spark, root).where("vote IS NOT NULL").select("item_id", "rater", (F.col("vote") != F.col("gold")).cast("int").alias("error"))


@query("agg_error_corr", CORR)
def agg_error_corr(spark, root):
    return A.error_correlation(errors(spark, root))


query("set_jaccard_errors", f"SELECT rater_a, rater_b, jaccard FROM ({CORR})")(lambda spark, root: A.error_correlation(errors(spark, root)).select("rater_a", "rater_b", "jaccard"))


@query("agg_effective_votes", f"SELECT avg(rho) AS mean_rho, 12 / (1 + 11 * avg(rho)) AS effective_votes FROM ({CORR})")
def agg_effective_votes(spark, root):
    mean = A.error_correlation(errors(spark, root)).agg(F.avg("rho").alias("mean_rho"))
    return mean.withColumn("effective_votes", S.ratio(F.lit(12.0), 1 + 11 * F.col("mean_rho")))


RULES = f"(SELECT item_id, any_value(gold) AS gold, count(*) AS k, count(*) FILTER (WHERE NOT vote) AS alerts FROM {V} v JOIN {G} g USING (item_id) GROUP BY item_id)"


@query("agg_rules", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS alerts, count(*) FILTER (WHERE {c} AND NOT gold) / nullif(count(*) FILTER (WHERE {c}), 0)::DOUBLE AS precision, count(*) FILTER (WHERE {c} AND NOT gold) / nullif(count(*) FILTER (WHERE NOT gold), 0)::DOUBLE AS coverage FROM {RULES}" for n, c in [("majority", "2 * alerts > k"), ("at_least_two", "alerts >= 2"), ("unanimity", "alerts = k")]))
def agg_rules(spark, root):
    """Alerts, precision and coverage when judges' votes are joined by a rule."""
    per = judged(spark, root).groupBy("item_id").agg(F.any_value("gold").alias("gold"), F.count(F.lit(1)).alias("k"), F.count_if(~F.col("vote")).alias("alerts"))
    rules = {"majority": 2 * F.col("alerts") > F.col("k"), "at_least_two": F.col("alerts") >= 2, "unanimity": F.col("alerts") == F.col("k")}
    flat = per.select("gold", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("hit")) for n, c in rules.items()])).alias("r")).select("gold", "r.*")
    agg = flat.groupBy("rule").agg(F.count_if("hit").alias("alerts"), F.count_if(F.col("hit") & ~F.col("gold")).alias("right"), F.count_if(~F.col("gold")).alias("negatives"))
    return agg.select("rule", "alerts", S.ratio(F.col("right"), F.col("alerts")).alias("precision"), S.ratio(F.col("right"), F.col("negatives")).alias("coverage"))


@query("agg_ensemble", f"SELECT item_id, CASE WHEN count(DISTINCT vote) = 1 THEN CASE WHEN bool_or(vote) THEN 'aceito' ELSE 'alerta' END ELSE 'incerto' END AS label, count(DISTINCT vote) = 1 AS models_agree FROM {V} WHERE vote IS NOT NULL GROUP BY item_id")
def agg_ensemble(spark, root):
    agg = votes(spark, root).where("vote IS NOT NULL").groupBy("item_id").agg(F.count_distinct("vote").alias("q"), F.bool_or("vote").alias("any"))
    return agg.select("item_id", F.when(F.col("q") > 1, "incerto").when(F.col("any"), "aceito").otherwise("alerta").alias("label"), (F.col("q") == 1).alias("models_agree"))


PENALISED = f"(SELECT rater, {KPEN} AS kappa FROM {JUDGES})"


@query("agg_llm_vs_human", f"SELECT rater, kappa, kappa >= 0.61 AS is_kept FROM {PENALISED}")
def agg_llm_vs_human(spark, root):
    return agg_judge_metrics(spark, root).select("rater", F.col("kappa_penalised").alias("kappa"), (F.col("kappa_penalised") >= 0.61).alias("is_kept"))


@query("win_rank_judges", f"SELECT rater, kappa, row_number() OVER (ORDER BY kappa DESC NULLS LAST, rater) AS rank FROM {PENALISED}")
def win_rank_judges(spark, root):
    rows = agg_judge_metrics(spark, root).select("rater", F.col("kappa_penalised").alias("kappa"))  # one row per judge
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("kappa").desc_nulls_last(), "rater")))


@query("agg_bootstrap_ci")
def agg_bootstrap_ci(spark, root):
    """Percentile interval of each judge's alert precision over 2000 resamples."""
    return resampled(agg_judge_metrics(spark, root).where("alerts > 0").select("rater", "alerts", F.col("tn").alias("right")))


def resampled(judges, runs=2000):
    """(rater, low, high): percentiles of the share right over resamples of each judge's alerts.

    A resample draws as many alerts as there are, with replacement: draw i of a run takes the alert whose place is a hash of
    (rater, run, i), the right ones standing first. Draws are made by ten thousand and counted where they are made, so no
    list of a judge's alerts is held anywhere.
    """
    size = 10_000
    parts = judges.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("alerts") - 1) / size)))).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    draws = parts.repartition("rater", "run").withColumn("i", F.explode(F.sequence(F.col("part") * size, F.least(F.col("alerts"), (F.col("part") + 1) * size) - 1)))
    hit = F.pmod(F.xxhash64("rater", "run", "i"), F.col("alerts")) < F.col("right")
    share = draws.groupBy("rater", "run").agg((F.count_if(hit) / F.count(F.lit(1))).alias("x"))
    return share.groupBy("rater").agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))


@query("agg_error_breakdown", f"""
WITH e AS (SELECT e.*, t.artifact, (m.n_true NOT IN (0, m.n_votes)) AS disputed FROM {ERR} e JOIN {ART} t USING (item_id) LEFT JOIN ({MAJ.format(v=R)}) m USING (item_id))
SELECT artifact, count(*) AS n, sum(error)::BIGINT AS n_errors, avg(error) AS rate, count(*) FILTER (WHERE error = 1 AND disputed) AS n_disputed FROM e GROUP BY artifact""")
def agg_error_breakdown(spark, root):
    m = A.majority(raters(spark, root)).select("item_id", (~F.col("is_unanimous")).alias("disputed"))
    e = errors(spark, root).join(items(spark, root), "item_id").join(m, "item_id", "left")
    return e.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("n_errors"), F.avg("error").alias("rate"), F.count_if((F.col("error") == 1) & F.col("disputed")).alias("n_disputed"))


@query("agg_error_phrases", f"""SELECT expression, count(*) AS n, sum(error)::BIGINT AS n_errors, avg(error) AS rate, count(DISTINCT item_id) AS n_items FROM {ERR} e JOIN {ART} t USING (item_id) GROUP BY expression HAVING count(DISTINCT item_id) >= 5""")
def agg_error_phrases(spark, root):
    """Error rate of the judges by phrase, for phrases of five or more items."""
    e = errors(spark, root).join(items(spark, root).select("item_id", "expression"), "item_id")
    out = e.groupBy("expression").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("n_errors"), F.avg("error").alias("rate"), F.count_distinct("item_id").alias("n_items"))
    return out.where("n_items >= 5")


@query("agg_run_status", f"SELECT rater, count(*) AS n_items, (SELECT count(DISTINCT item_id) FROM annotations_long) - count(*) AS n_missing, count(*) FILTER (WHERE vote IS NULL) AS n_abstained FROM {V} GROUP BY rater")
def agg_run_status(spark, root):
    v = votes(spark, root)
    total = load(spark, root, "annotations_long").agg(F.count_distinct("item_id").alias("t")).first()[0]
    return v.groupBy("rater").agg(F.count(F.lit(1)).alias("n_items"), (F.lit(total) - F.count(F.lit(1))).alias("n_missing"), F.count_if(F.col("vote").isNull()).alias("n_abstained"))


@query("flt_coverage", f"SELECT v.* FROM {V} v JOIN (SELECT rater FROM {V} WHERE vote IS NOT NULL GROUP BY rater HAVING count(*) >= 0.4 * (SELECT count(DISTINCT item_id) FROM annotations_long)) k USING (rater) WHERE vote IS NOT NULL")
def flt_coverage(spark, root):
    """Votes of the judges who voted on at least two fifths of the items."""
    v = votes(spark, root).where("vote IS NOT NULL")
    total = load(spark, root, "annotations_long").agg(F.count_distinct("item_id").alias("t")).first()[0]
    kept = v.groupBy("rater").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 0.4 * total).select("rater")
    return v.join(kept, "rater", "left_semi")


JUDGE_NAMES = [f"an{i:02d}" for i in range(1, 13)]


@query("join_votes_wide", f"SELECT g.item_id, g.gold, " + ", ".join(f"bool_or(vote) FILTER (WHERE rater = '{j}') AS {j}" for j in JUDGE_NAMES) + f" FROM {G} g LEFT JOIN {V} v USING (item_id) GROUP BY ALL")
def join_votes_wide(spark, root):
    """Gold beside every judge's vote: one pivot and one join, not a join per judge."""
    wide = votes(spark, root).groupBy("item_id").pivot("rater", JUDGE_NAMES).agg(F.bool_or("vote"))
    return gold(spark, root).join(wide, "item_id", "left")


@query("join_pair_annotators", f"SELECT item_id, l.vote AS vote_a, r.vote AS vote_b FROM {V} l JOIN {V} r USING (item_id) WHERE l.rater = 'an01' AND r.rater = 'an02'")
def join_pair_annotators(spark, root):
    v = votes(spark, root)
    of = lambda r, c: v.where(F.col("rater") == r).select("item_id", F.col("vote").alias(c))
    return of("an01", "vote_a").join(of("an02", "vote_b"), "item_id")


@query("smp_tiebreak", f"SELECT item_id, l.vote AS vote_a, r.vote AS vote_b FROM {V} l JOIN {V} r USING (item_id) WHERE l.rater = 'an01' AND r.rater = 'an02' AND l.vote <> r.vote")
def smp_tiebreak(spark, root):
    return join_pair_annotators(spark, root).where("vote_a <> vote_b")


VC = "(SELECT item_id, annotator_id AS rater, bool_or(is_ubw) AS vote, min(category_confirmed) FILTER (WHERE is_ubw) AS category FROM annotations_long GROUP BY ALL)"


@query("smp_tiebreak_whole", f"SELECT item_id, l.vote AS vote_a, r.vote AS vote_b, l.category AS category_a, r.category AS category_b FROM {VC} l JOIN {VC} r USING (item_id) WHERE l.rater = 'an01' AND r.rater = 'an02' AND (l.vote <> r.vote OR (l.vote AND r.vote AND (l.category <> r.category OR l.category IS NULL OR r.category IS NULL)))")
def smp_tiebreak_whole(spark, root):
    """The tie-break batch: items that differ in the label or, both being true, in the category; a category that is not given differs."""
    v = categories(spark, root)
    of = lambda r, x: v.where(F.col("rater") == r).select("item_id", F.col("vote").alias(f"vote_{x}"), F.col("category").alias(f"category_{x}"))
    both = of("an01", "a").join(of("an02", "b"), "item_id").select("item_id", "vote_a", "vote_b", "category_a", "category_b")
    return both.where("vote_a <> vote_b OR (vote_a AND vote_b AND NOT coalesce(category_a = category_b, false))")


@query("join_stratum", "SELECT a.item_id, a.annotator_id, s.sample_stratum FROM (SELECT DISTINCT item_id, annotator_id FROM annotations_long) a LEFT JOIN (SELECT item_id, min(sample_stratum) AS sample_stratum FROM annotations_long GROUP BY 1) s USING (item_id)")
def join_stratum(spark, root):
    rows = load(spark, root, "annotations_long")
    strata = rows.groupBy("item_id").agg(F.min("sample_stratum").alias("sample_stratum"))
    return rows.select("item_id", "annotator_id").distinct().join(strata, "item_id", "left")


@query("set_diff_ids", "WITH e AS (SELECT DISTINCT item_id FROM nao_unanimes), g AS (SELECT DISTINCT item_id FROM annotations_long) SELECT 'missing' AS side, item_id FROM e WHERE item_id NOT IN (SELECT item_id FROM g WHERE item_id IS NOT NULL) UNION ALL SELECT 'unexpected', item_id FROM g WHERE item_id NOT IN (SELECT item_id FROM e WHERE item_id IS NOT NULL)")
def set_diff_ids(spark, root):
    e, g = (load(spark, root, t).select("item_id").distinct() for t in ("nao_unanimes", "annotations_long"))
    side = lambda a, b, n: a.join(b, "item_id", "left_anti").select(F.lit(n).alias("side"), "item_id")
    return side(e, g, "missing").unionByName(side(g, e, "unexpected"))


@query("set_subset_check", "SELECT count(*) AS n_outside FROM (SELECT DISTINCT item_id FROM annotations_long) a WHERE NOT EXISTS (SELECT 1 FROM nao_unanimes n WHERE n.item_id = a.item_id)")
def set_subset_check(spark, root):
    a = load(spark, root, "annotations_long").select("item_id").distinct()
    return a.join(load(spark, root, "nao_unanimes").select("item_id"), "item_id", "left_anti").agg(F.count(F.lit(1)).alias("n_outside"))


@query("set_union_long", f"SELECT item_id, rater, vote FROM {V} UNION ALL SELECT item_id, rater, vote FROM {R}")
def set_union_long(spark, root):
    return votes(spark, root).unionByName(raters(spark, root))


@query("snk_html_ui", "SELECT item_id, annotator_id, is_ubw IS NOT NULL AND trim(coalesce(observacao, '')) <> '' AS is_complete FROM annotations_long")
def snk_html_ui(spark, root):
    """Only answers with a label and a note are complete."""
    done = F.col("is_ubw").isNotNull() & (F.trim(F.coalesce("observacao", F.lit(""))) != "")
    return load(spark, root, "annotations_long").select("item_id", "annotator_id", done.alias("is_complete"))
