"""Descriptive report, survival, curation, duplicates and audit over the occurrences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiscope.functions import lexicon as L
from lexiscope.functions import stats as S
from lexiscope.functions import text as T
from lexiscope.operators import skew
from lexiscope.plans.registry import query
from lexiscope.plans.texts import BUNDLE_SQL, CODE, K, KEY, KIND, LEXICON_SQL, LIBRARY_SQL, VENDORED_SQL, bot_sql, code, kind, normal_sql, occ
from lexiscope.sources.tables import load

BODY_SQL = "lower(regexp_replace(body_text, '^\\s+|\\s+$', '', 'g'))"


def rows_():
    return F.count(F.lit(1))


def body_():
    return F.lower(T.strip("body_text"))


def phrase_():
    return F.lower(F.trim("matched_expression"))


def share(df, of="n"):
    return df.withColumn("share", F.col(of) / F.sum(of).over(Window.partitionBy()).cast("double"))


@query("agg_overview", """SELECT count(*) AS n, count(DISTINCT repo_full_name) AS repos, count(DISTINCT matched_expression) AS expressions, count(DISTINCT primary_language) AS languages,
 min(created_at)::TIMESTAMP AS first_at, max(created_at)::TIMESTAMP AS last_at, CAST(trunc(quantile_cont(length(body_text)::DOUBLE, 0.5)) AS BIGINT) AS median_chars FROM occurrences""")
def agg_overview(spark, root):
    return occ(spark, root).agg(
        rows_().alias("n"), F.count_distinct("repo_full_name").alias("repos"), F.count_distinct("matched_expression").alias("expressions"), F.count_distinct("primary_language").alias("languages"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.percentile(F.length("body_text"), F.lit(0.5)).cast("bigint").alias("median_chars"),
    )


@query("agg_by_artifact", f"""SELECT {KIND} AS artifact, count(*) AS n, count(DISTINCT repo_full_name) AS repos, quantile_cont(length(body_text)::DOUBLE, 0.5) AS median_chars, quantile_cont(length(body_text)::DOUBLE, 0.9) AS p90_chars,
 count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM occurrences GROUP BY 1""")
def agg_by_artifact(spark, root):
    chars = F.length("body_text")
    return share(occ(spark, root).groupBy(kind().alias("artifact")).agg(rows_().alias("n"), F.count_distinct("repo_full_name").alias("repos"), F.percentile(chars, F.lit(0.5)).alias("median_chars"), F.percentile(chars, F.lit(0.9)).alias("p90_chars")))


@query("agg_by_expression", f"""WITH o AS (SELECT lower(trim(matched_expression)) AS expression, count(*) AS n, count(DISTINCT repo_full_name) AS repos FROM occurrences GROUP BY 1)
SELECT lex.expression, lex.category, coalesce(n, 0) AS n, coalesce(repos, 0) AS repos, coalesce(n, 0) / (sum(coalesce(n, 0)) OVER ())::DOUBLE AS share FROM {LEXICON_SQL} LEFT JOIN o ON o.expression = lex.expression""")
def agg_by_expression(spark, root):
    """Rows and repositories of every phrase of the lexicon, those without rows included."""
    seen = occ(spark, root).groupBy(phrase_().alias("expression")).agg(rows_().alias("n"), F.count_distinct("repo_full_name").alias("repos"))
    lex = spark.createDataFrame([(p, c) for p, c, _, _ in L.ENTRIES], "expression string, category string")
    return share(lex.join(seen, "expression", "left").na.fill(0, ["n", "repos"]))


REPOS = "(SELECT repo_full_name, count(*) AS n FROM occurrences GROUP BY 1)"


def per_repo(spark, root):
    return occ(spark, root).groupBy("repo_full_name").agg(rows_().alias("n"))


@query("agg_by_repo", f"""SELECT count(*) AS repos, quantile_cont(n::DOUBLE, 0.5) AS median, avg(n) AS mean, quantile_cont(n::DOUBLE, 0.9) AS p90, max(n) AS largest, count(*) FILTER (WHERE n = 1) / count(*)::DOUBLE AS share_single, count(*) FILTER (WHERE n >= 3) / count(*)::DOUBLE AS share_three FROM {REPOS}""")
def agg_by_repo(spark, root):
    n = F.col("n")
    return per_repo(spark, root).agg(
        rows_().alias("repos"), F.percentile(n, F.lit(0.5)).alias("median"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.9)).alias("p90"), F.max(n).alias("largest"),
        S.ratio(F.count_if(n == 1), rows_()).alias("share_single"), S.ratio(F.count_if(n >= 3), rows_()).alias("share_three"),
    )


@query("win_topshare", f"""WITH r AS (SELECT n, row_number() OVER (ORDER BY n DESC, repo_full_name) AS rank, count(*) OVER () AS repos, sum(n) OVER () AS total FROM {REPOS})
SELECT sum(n) FILTER (WHERE rank <= 10) / max(total)::DOUBLE AS top_10, sum(n) FILTER (WHERE rank <= greatest(1, repos // 100)) / max(total)::DOUBLE AS top_percent FROM r""")
def win_topshare(spark, root):
    """Share of the ten largest repositories and of the largest percent, by counting sizes instead of ranking all of them."""
    sizes = per_repo(spark, root).groupBy("n").agg(rows_().alias("repos"))
    w = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per size
    ranked = sizes.withColumn("before", F.coalesce(F.sum("repos").over(w), F.lit(0)))
    total, repos = sizes.agg(F.sum(F.col("n") * F.col("repos")), F.sum("repos")).first()
    taken = lambda k: F.sum(F.least(F.greatest(F.lit(k) - F.col("before"), F.lit(0)), F.col("repos")) * F.col("n")) / F.lit(float(total))
    return ranked.agg(taken(10).alias("top_10"), taken(max(1, repos // 100)).alias("top_percent"))


@query("agg_by_year", "SELECT year(created_at) AS year, count(*) AS n, count(DISTINCT repo_full_name) AS repos, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM occurrences WHERE created_at IS NOT NULL GROUP BY 1")
def agg_by_year(spark, root):
    return share(occ(spark, root).where("created_at IS NOT NULL").groupBy(F.year("created_at").alias("year")).agg(rows_().alias("n"), F.count_distinct("repo_full_name").alias("repos")))


query("win_share", f"SELECT *, n / (sum(n) OVER (PARTITION BY artifact))::DOUBLE AS share FROM (SELECT {KIND} AS artifact, primary_language, count(*) AS n FROM occurrences GROUP BY 1, 2)")(
    lambda spark, root: occ(spark, root).groupBy(kind().alias("artifact"), "primary_language").agg(rows_().alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("artifact")).cast("double"))
)


@query("agg_by_language", "SELECT primary_language, count(*) AS n FROM occurrences WHERE primary_language IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def agg_by_language(spark, root):
    """The fifteen most frequent languages; a report."""
    return occ(spark, root).where("primary_language IS NOT NULL").groupBy("primary_language").agg(rows_().alias("n")).orderBy(F.desc("n"), "primary_language").limit(15)


@query("agg_top_plus_tail", """WITH r AS (SELECT lower(trim(matched_expression)) AS e, count(*) AS n FROM occurrences GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, e) AS rank FROM r)
SELECT CASE WHEN rank <= 8 THEN e ELSE 'others' END AS expression, sum(n)::BIGINT AS n, count(*) AS members FROM k GROUP BY 1""")
def agg_top_plus_tail(spark, root):
    n = occ(spark, root).groupBy(phrase_().alias("e")).agg(rows_().alias("n"))
    top = n.orderBy(F.desc("n"), "e").limit(8).withColumn("is_top", F.lit(True)).select("e", "is_top")
    named = n.join(top, "e", "left").withColumn("expression", F.when(F.col("is_top"), F.col("e")).otherwise("others"))
    return named.groupBy("expression").agg(F.sum("n").alias("n"), rows_().alias("members"))


KINDS = ["code_comment", "commit_message", "issue_body", "pr_body"]


@query("agg_crosstab_pct", "SELECT primary_language, " + ", ".join(f"count(*) FILTER (WHERE {KIND} = '{k}') / count(*)::DOUBLE AS {k}" for k in KINDS) + ", count(*) AS n FROM occurrences WHERE primary_language IS NOT NULL GROUP BY 1")
def agg_crosstab_pct(spark, root):
    wide = occ(spark, root).where("primary_language IS NOT NULL").withColumn("k", kind()).groupBy("primary_language").pivot("k", KINDS).count().na.fill(0)
    n = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return wide.withColumn("n", n).select("primary_language", *[(F.col(k) / F.col("n")).alias(k) for k in KINDS], "n")


@query("agg_monthly_pivot", "SELECT strftime(created_at, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (WHERE {KIND} = '{k}') AS {k}" for k in KINDS) + ", count(*) AS total FROM occurrences WHERE created_at IS NOT NULL GROUP BY 1")
def agg_monthly_pivot(spark, root):
    wide = occ(spark, root).where("created_at IS NOT NULL").select(F.date_format("created_at", "yyyy-MM").alias("month"), kind().alias("k")).groupBy("month").pivot("k", KINDS).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0])))


@query("agg_event_summary", f"SELECT {KIND} AS artifact, count(*) AS n, count(*) FILTER (WHERE is_censored = 0) AS observed, count(*) FILTER (WHERE is_censored = 0) / count(*)::DOUBLE AS rate, quantile_cont(time_to_event_days::DOUBLE, 0.5) FILTER (WHERE is_censored = 0) AS median_days FROM occurrences GROUP BY 1")
def agg_event_summary(spark, root):
    seen = F.col("is_censored") == 0
    return occ(spark, root).groupBy(kind().alias("artifact")).agg(rows_().alias("n"), F.count_if(seen).alias("observed"), S.ratio(F.count_if(seen), rows_()).alias("rate"), F.percentile(F.when(seen, F.col("time_to_event_days")), F.lit(0.5)).alias("median_days"))


@query("win_km", f"""
WITH t AS (SELECT time_to_event_days AS t, count(*) AS n, count(*) FILTER (WHERE is_censored = 0) AS d FROM occurrences WHERE {KIND} = 'code_comment' AND time_to_event_days >= 0 GROUP BY 1),
r AS (SELECT t, d, sum(n) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM t)
SELECT t, d AS events, at_risk::BIGINT AS at_risk, product(1 - d / at_risk::DOUBLE) OVER (ORDER BY t) AS survival FROM r""")
def win_km(spark, root):
    """Kaplan-Meier curve of code comments: one row per distinct lifetime, then two running windows over those rows."""
    t = occ(spark, root).where((kind() == "code_comment") & (F.col("time_to_event_days") >= 0)).groupBy(F.col("time_to_event_days").alias("t")).agg(rows_().alias("n"), F.count_if(F.col("is_censored") == 0).alias("d"))
    w = Window.orderBy("t")
    r = t.withColumn("at_risk", F.sum("n").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return r.select("t", F.col("d").alias("events"), "at_risk", F.product(1 - F.col("d") / F.col("at_risk")).over(w).alias("survival"))


@query("agg_threshold", f"""WITH c AS (SELECT repo_full_name, {KIND} AS k, count(*) AS n FROM occurrences GROUP BY 1, 2), m AS (SELECT repo_full_name, max(n) AS most FROM c GROUP BY 1)
SELECT count(*) AS repos, count(*) FILTER (WHERE most >= 3) AS kept, count(*) FILTER (WHERE most < 3) / count(*)::DOUBLE AS excluded, count(*) FILTER (WHERE most < 3) / count(*)::DOUBLE > 0.4 AS is_alert FROM m""")
def agg_threshold(spark, root):
    m = most_per_repo(spark, root)
    low = F.count_if(F.col("most") < 3)
    return m.agg(rows_().alias("repos"), F.count_if(F.col("most") >= 3).alias("kept"), S.ratio(low, rows_()).alias("excluded"), (S.ratio(low, rows_()) > 0.4).alias("is_alert"))


def most_per_repo(spark, root):
    return occ(spark, root).groupBy("repo_full_name", kind().alias("k")).agg(rows_().alias("n")).groupBy("repo_full_name").agg(F.max("n").alias("most"))


@query("snk_threshold_split", f"SELECT {', '.join('o.' + k for k in KEY)} FROM occurrences o JOIN (SELECT repo_full_name FROM (SELECT repo_full_name, {KIND} AS k, count(*) AS n FROM occurrences GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 3) m USING (repo_full_name)")
def snk_threshold_split(spark, root):
    """Records of repositories with three or more of one kind."""
    facts = occ(spark, root).select(*KEY)
    kept = most_per_repo(spark, root).where("most >= 3").select("repo_full_name", F.lit(1).alias("hit"))
    return skew.joined_evenly(facts, kept, "repo_full_name", ["artifact_id"]).where("hit = 1").select(*KEY)


@query("agg_summary_survey", """WITH e AS (SELECT max(created_at) AS e FROM occurrences), w AS (SELECT unnest([12, 24, 1200]) AS months)
SELECT months, count(*) AS n, count(DISTINCT repo_full_name) AS repos, count(DISTINCT author_hash) AS authors, count(DISTINCT CASE WHEN author_email IS NOT NULL THEN author_hash END) AS with_address, count(*) FILTER (WHERE is_censored = 0) AS removed
FROM occurrences, e, w WHERE created_at > e - to_months(months::INTEGER) AND created_at <= e GROUP BY months""")
def agg_summary_survey(spark, root):
    """Conditional counts over overlapping windows: each record is exploded into the windows it lies in."""
    rows = occ(spark, root).select("created_at", "repo_full_name", "author_hash", "author_email", "is_censored")
    end = F.lit(rows.agg(F.max("created_at")).first()[0]).cast("timestamp")
    months = F.filter(F.array(F.lit(12), F.lit(24), F.lit(1200)), lambda m: (F.col("created_at") > end - F.make_interval(months=m)) & (F.col("created_at") <= end))
    return rows.withColumn("months", F.explode(months)).groupBy("months").agg(
        rows_().alias("n"), F.count_distinct("repo_full_name").alias("repos"), F.count_distinct("author_hash").alias("authors"),
        F.count_distinct(F.when(F.col("author_email").isNotNull(), F.col("author_hash"))).alias("with_address"), F.count_if(F.col("is_censored") == 0).alias("removed"),
    )


# ---- duplicates ----------------------------------------------------------------------------------------------------

CLUSTERS = f"(SELECT {BODY_SQL} AS body, count(DISTINCT repo_full_name) AS repos, count(*) AS n FROM occurrences GROUP BY 1 HAVING count(DISTINCT repo_full_name) >= 2)"


def clusters(spark, root):
    """(h, repos, n): texts in two or more repositories, keyed by the hash of the text; counted over distinct pairs."""
    pairs = occ(spark, root).select(F.sha2(body_(), 256).alias("h"), "repo_full_name").groupBy("h", "repo_full_name").agg(rows_().alias("n"))
    return pairs.groupBy("h").agg(F.count("repo_full_name").alias("repos"), F.sum("n").alias("n")).where("repos >= 2")


@query("agg_cross_repo_clusters", f"SELECT CASE WHEN repos = 2 THEN '2' WHEN repos <= 5 THEN '3-5' WHEN repos <= 20 THEN '6-20' ELSE '21+' END AS band, count(*) AS clusters, sum(n)::BIGINT AS n FROM {CLUSTERS} GROUP BY 1")
def agg_cross_repo_clusters(spark, root):
    r = F.col("repos")
    band = F.when(r == 2, "2").when(r <= 5, "3-5").when(r <= 20, "6-20").otherwise("21+")
    return clusters(spark, root).groupBy(band.alias("band")).agg(rows_().alias("clusters"), F.sum("n").alias("n"))


@query("agg_top_clusters", f"SELECT sha256(body) AS h, repos, n FROM {CLUSTERS} ORDER BY repos DESC, n DESC, h LIMIT 8")
def agg_top_clusters(spark, root):
    """The eight texts in most repositories; a report."""
    return clusters(spark, root).orderBy(F.desc("repos"), F.desc("n"), "h").limit(8).select("h", "repos", F.col("n"))


@query("agg_repo_pairs", f"""WITH c AS (SELECT body FROM {CLUSTERS} WHERE repos <= 5), p AS (SELECT DISTINCT {BODY_SQL} AS body, repo_full_name FROM occurrences)
SELECT a.repo_full_name AS repo_a, b.repo_full_name AS repo_b, count(*) AS shared FROM p a JOIN p b ON a.body = b.body AND a.repo_full_name < b.repo_full_name JOIN c ON c.body = a.body GROUP BY 1, 2""")
def agg_repo_pairs(spark, root):
    """Pairs of repositories with common texts, of texts in two to five repositories; at most ten pairs per text by that rule."""
    kept = clusters(spark, root).where("repos <= 5").select("h")
    p = occ(spark, root).select(F.sha2(body_(), 256).alias("h"), "repo_full_name").distinct().join(kept, "h")
    a, b = p.withColumnRenamed("repo_full_name", "repo_a"), p.withColumnRenamed("repo_full_name", "repo_b")
    return a.join(b, "h").where("repo_a < repo_b").groupBy("repo_a", "repo_b").agg(rows_().alias("shared"))


@query("agg_cluster_filter", f"""WITH c AS (SELECT body FROM {CLUSTERS} WHERE repos >= 3)
SELECT {', '.join('o.' + k for k in KEY)} FROM occurrences o WHERE NOT ({KIND} = 'code_comment' AND {BODY_SQL} IN (SELECT body FROM c))""")
def agg_cluster_filter(spark, root):
    """Records without code comments whose text stands in three or more repositories."""
    big = clusters(spark, root).where("repos >= 3").select("h")
    is_code = F.coalesce(kind() == "code_comment", F.lit(False))
    # other records have nothing to compare: they do not go through the join, where all of them would meet in one task
    rows = occ(spark, root).where(is_code).select(*KEY, F.sha2(body_(), 256).alias("h"))
    return rows.join(big, "h", "left_anti").select(*KEY).unionByName(occ(spark, root).where(~is_code).select(*KEY))


@query("agg_cluster_removed", f"""WITH c AS (SELECT body, repos FROM {CLUSTERS}), r AS (SELECT coalesce(c.repos, 1) >= 3 AS is_clustered, o.is_censored FROM occurrences o LEFT JOIN c ON c.body = {BODY_SQL.replace('body_text', 'o.body_text')} WHERE {KIND.replace('artifact_type', 'o.artifact_type')} = 'code_comment')
SELECT is_clustered, count(*) AS n, count(*) FILTER (WHERE is_censored = 0) AS removed, count(*) FILTER (WHERE is_censored = 0) / count(*)::DOUBLE AS removal_rate FROM r GROUP BY 1""")
def agg_cluster_removed(spark, root):
    """Removal rate of code comments whose text stands in three or more repositories, and of the others."""
    big = clusters(spark, root).where("repos >= 3").select("h", F.lit(True).alias("big"))
    per = occ(spark, root).where(kind() == "code_comment").groupBy(F.sha2(body_(), 256).alias("h")).agg(rows_().alias("n"), F.count_if(F.col("is_censored") == 0).alias("removed"))
    out = per.join(big, "h", "left").groupBy(F.coalesce("big", F.lit(False)).alias("is_clustered")).agg(F.sum("n").alias("n"), F.sum("removed").alias("removed"))
    return out.withColumn("removal_rate", S.ratio(F.col("removed"), F.col("n")))


@query("agg_context_copies", f"WITH c AS (SELECT {BODY_SQL} AS body, count(DISTINCT repo_full_name) AS copies FROM occurrences GROUP BY 1) SELECT {K}, copies FROM occurrences o JOIN c ON c.body = {BODY_SQL}")
def agg_context_copies(spark, root):
    rows = occ(spark, root).select(*KEY, F.sha2(body_(), 256).alias("h"))
    copies = rows.select("h", "repo_full_name").distinct().groupBy("h").agg(rows_().alias("copies"))
    return rows.join(copies, "h").select(*KEY, "copies")


FIRST = f"(SELECT {K}, {BODY_SQL} AS body, row_number() OVER (PARTITION BY repo_full_name, {BODY_SQL} ORDER BY created_at NULLS LAST, artifact_id, matched_expression, artifact_type) AS rn FROM occurrences)"


@query("win_dedup_first", f"SELECT {K} FROM {FIRST} WHERE rn = 1")
def win_dedup_first(spark, root):
    """The first record of each text per repository, as the minimum of a struct: combined map-side, no sort of a large group."""
    rows = occ(spark, root).select("repo_full_name", F.sha2(body_(), 256).alias("h"), F.struct(F.col("created_at").isNull().alias("late"), "created_at", "artifact_id", "matched_expression", "artifact_type").alias("r"))
    return rows.groupBy("repo_full_name", "h").agg(F.min("r").alias("r")).select("repo_full_name", "r.artifact_type", "r.artifact_id", "r.matched_expression")


@query("win_keep_last", "SELECT user_id, event_type, max(ts)::TIMESTAMP AS ts, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def win_keep_last(spark, root):
    """The last line of a log per key."""
    return load(spark, root, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("win_topk_per_group", f"SELECT {KIND} AS artifact, repo_full_name, n FROM (SELECT {KIND} AS k, repo_full_name, count(*) AS n, row_number() OVER (PARTITION BY {KIND} ORDER BY count(*) DESC, repo_full_name) AS rn FROM occurrences GROUP BY 1, 2) q(artifact, repo_full_name, n, rn) WHERE rn <= 5".replace(f"SELECT {KIND} AS artifact, repo_full_name, n FROM", "SELECT artifact, repo_full_name, n FROM"))
def win_topk_per_group(spark, root):
    n = occ(spark, root).groupBy(kind().alias("artifact"), "repo_full_name").agg(rows_().alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("artifact").orderBy(F.desc("n"), "repo_full_name"))).where("rn <= 5").drop("rn")


@query("win_running_budget", "SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events")
def win_running_budget(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, root, "events").select("user_id", "event_id", F.sum("value").over(w).alias("spent"))


@query("agg_frequency_slots", """WITH s AS (SELECT 'pre_but' AS slot, nullif(lower(trim(regexp_extract(body_text, '(?i)([\\w''-]+(?:\\s+[\\w''-]+){0,2})\\s+but\\b', 1), ' ')), '') AS word FROM occurrences
 UNION ALL SELECT 'pre_works', nullif(lower(trim(regexp_extract(body_text, '(?i)([\\w''-]+(?:\\s+[\\w''-]+){0,2})\\s+works?\\b', 1), ' ')), '') FROM occurrences), n AS (SELECT slot, word, count(*) AS n FROM s WHERE word IS NOT NULL GROUP BY 1, 2)
SELECT slot, word, n FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n DESC, word) AS rn FROM n) WHERE rn <= 20""")
def agg_frequency_slots(spark, root):
    """The twenty most frequent fillers of each slot; a report."""
    s = T.slots("body_text")
    flat = occ(spark, root).select(F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), s[k].alias("word")) for k in ("pre_but", "pre_works")])).alias("f")).select("f.*").where("word IS NOT NULL")
    n = flat.groupBy("slot", "word").agg(rows_().alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "word"))).where("rn <= 20").drop("rn")


SLOT_RX = {"pre_but": "(?i)([\\w''-]+(?:\\s+[\\w''-]+){0,2})\\s+but\\b", "pre_works": "(?i)([\\w''-]+(?:\\s+[\\w''-]+){0,2})\\s+works?\\b", "post_but": "(?i)\\bbut\\b\\s+(.{1,40})"}
PATTERN_SQL = "lower(trim(matched_expression))"


@query("agg_frequency_by_pattern", "WITH s AS (" + " UNION ALL ".join(f"SELECT {PATTERN_SQL} AS pattern, '{k}' AS slot, nullif(lower(trim(regexp_extract(body_text, '{rx}', 1), ' ')), '') AS word FROM occurrences" for k, rx in SLOT_RX.items()) + f"""),
n AS (SELECT pattern, slot, word, count(*) AS n FROM s WHERE word IS NOT NULL GROUP BY ALL), t AS (SELECT {PATTERN_SQL} AS pattern, count(*) AS total FROM occurrences GROUP BY 1)
SELECT pattern, total, slot, word, n FROM t LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern, slot ORDER BY n DESC, word) AS rn FROM n) WHERE rn <= 20) USING (pattern)""")
def agg_frequency_by_pattern(spark, root):
    return frequency_by_pattern(occ(spark, root))


def frequency_by_pattern(rows):
    """Per phrase its total and the twenty most frequent fillers of all three slots; a phrase without fillers has one row."""
    s = T.slots("body_text")
    pattern = F.lower(F.trim("matched_expression")).alias("pattern")
    flat = rows.select(pattern, F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), s[k].alias("word")) for k in SLOT_RX])).alias("f")).select("pattern", "f.*").where("word IS NOT NULL")
    n = flat.groupBy("pattern", "slot", "word").agg(rows_().alias("n"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("pattern", "slot").orderBy(F.desc("n"), "word"))).where("rn <= 20").drop("rn")
    return rows.groupBy(pattern).agg(rows_().alias("total")).join(top, "pattern", "left")


@query("agg_bot_removed", f"SELECT lower(coalesce(author_login, author_name)) AS identity, count(*) AS n FROM occurrences WHERE {bot_sql('author_login')} OR {bot_sql('author_name')} GROUP BY 1")
def agg_bot_removed(spark, root):
    bots = occ(spark, root).where(T.is_bot("author_login") | T.is_bot("author_name"))
    return bots.groupBy(F.lower(F.coalesce("author_login", "author_name")).alias("identity")).agg(rows_().alias("n"))


SPAN_SQL = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000e0) AS BIGINT)"


@query("agg_release_counters", f"""WITH c AS (SELECT max(greatest(created_at, coalesce(removed_at, created_at))) AS cutoff FROM {CODE}), t AS (SELECT {BODY_SQL} AS body, count(DISTINCT repo_full_name) AS copies FROM {CODE} GROUP BY 1),
r AS (SELECT o.*, c.cutoff, t.copies, contains({normal_sql('o.body_text')}, ' ' || trim(regexp_replace(lower(o.matched_expression), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ') AS seen FROM {CODE} o CROSS JOIN c JOIN t ON t.body = {BODY_SQL.replace('body_text', 'o.body_text')})
SELECT count(*) AS source_rows, count(*) FILTER (WHERE seen) AS output_rows, count(*) FILTER (WHERE NOT seen) AS without_visible_expression, count(DISTINCT repo_full_name) AS repositories, count(DISTINCT primary_language) AS languages,
 count(DISTINCT lower(trim(matched_expression))) AS expressions, count(*) FILTER (WHERE length(body_text) >= 2000) AS at_2000_chars, count(*) FILTER (WHERE contains(body_text, chr(10))) AS with_line_breaks, count(*) FILTER (WHERE NOT contains(body_text, chr(10))) AS without_line_breaks,
 count(*) FILTER (WHERE copies > 1) AS in_several_repositories, count(*) FILTER (WHERE is_censored = 1 AND time_to_event_days <> {SPAN_SQL.format(a='created_at', b='cutoff')}) AS censored_to_recompute,
 count(*) FILTER (WHERE is_censored = 1 AND removed_at IS NOT NULL) AS censored_but_removed, count(*) FILTER (WHERE is_censored = 0 AND removed_at IS NULL) AS observed_without_removal, count(*) FILTER (WHERE removed_at < created_at) AS removed_before_creation,
 count(*) FILTER (WHERE is_censored = 0 AND time_to_event_days <> {SPAN_SQL.format(a='created_at', b='removed_at')}) AS observed_days_differ, count(*) FILTER (WHERE created_at IS NULL) AS undated FROM r""")
def agg_release_counters(spark, root):
    """The counters of a release of code comments, and the checks of their lifetimes; the cut-off is the last date of the data."""
    rows = code(spark, root)
    cutoff = F.lit(rows.agg(F.max(F.unix_micros(F.greatest("created_at", F.coalesce("removed_at", "created_at"))))).first()[0])
    h = F.sha2(body_(), 256)
    copies = rows.select(h.alias("h"), "repo_full_name").distinct().groupBy("h").agg(rows_().alias("copies"))
    needle = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("matched_expression"), "[^a-z0-9]+", " ")), F.lit(" "))
    span = lambda a, b: F.floor((b - F.unix_micros(a)) / 86_400_000_000)
    r = rows.withColumn("h", h).join(copies, "h").withColumn("seen", T.lines_normal("body_text").contains(needle))
    held, breaks, days = F.col("is_censored") == 1, F.col("body_text").contains("\n"), F.col("time_to_event_days")
    return r.agg(
        rows_().alias("source_rows"), F.count_if("seen").alias("output_rows"), F.count_if(~F.col("seen")).alias("without_visible_expression"), F.count_distinct("repo_full_name").alias("repositories"), F.count_distinct("primary_language").alias("languages"),
        F.count_distinct(F.lower(F.trim("matched_expression"))).alias("expressions"), F.count_if(F.length("body_text") >= 2000).alias("at_2000_chars"), F.count_if(breaks).alias("with_line_breaks"), F.count_if(~breaks).alias("without_line_breaks"),
        F.count_if(F.col("copies") > 1).alias("in_several_repositories"), F.count_if(held & (days != span("created_at", cutoff))).alias("censored_to_recompute"),
        F.count_if(held & F.col("removed_at").isNotNull()).alias("censored_but_removed"), F.count_if((F.col("is_censored") == 0) & F.col("removed_at").isNull()).alias("observed_without_removal"), F.count_if(F.col("removed_at") < F.col("created_at")).alias("removed_before_creation"),
        F.count_if((F.col("is_censored") == 0) & (days != span("created_at", F.unix_micros("removed_at")))).alias("observed_days_differ"), F.count_if(F.col("created_at").isNull()).alias("undated"),
    )


@query("agg_release_stats", f"""SELECT count(*) AS n, count(DISTINCT repo_full_name) AS repos, count(*) FILTER (WHERE is_censored = 0) AS removed, count(*) FILTER (WHERE length(body_text) >= 2000) AS at_limit, count(DISTINCT body_text) AS contexts,
 count(*) FILTER (WHERE created_at IS NULL) AS undated, count(*) FILTER (WHERE primary_language IS NULL) AS no_language FROM occurrences WHERE {KIND} = 'code_comment'""")
def agg_release_stats(spark, root):
    return occ(spark, root).where(kind() == "code_comment").agg(
        rows_().alias("n"), F.count_distinct("repo_full_name").alias("repos"), F.count_if(F.col("is_censored") == 0).alias("removed"), F.count_if(F.length("body_text") >= 2000).alias("at_limit"),
        F.count_distinct(F.sha2("body_text", 256)).alias("contexts"), F.count_if(F.col("created_at").isNull()).alias("undated"), F.count_if(F.col("primary_language").isNull()).alias("no_language"),
    )


# ---- audit ---------------------------------------------------------------------------------------------------------

_ROW_CHECKS = {
    "1.1": ("time_to_event_days < 0", "time_to_event_days < 0"),
    "1.2": ("time_to_event_days = 0", "time_to_event_days = 0"),
    "1.3": ("removed_at < created_at", "removed_at < created_at"),
    "1.4": ("is_censored = 1 AND removed_at IS NOT NULL",) * 2,
    "1.5": ("is_censored = 0 AND removed_at IS NULL",) * 2,
    "1.6": ("time_to_event_days > repo_age_days",) * 2,
    "4.1": (f"contains(lower(coalesce(author_login, '')), 'bot') AND NOT {bot_sql('author_login', False)}", None),
    "4.2": ("contains(lower(coalesce(author_name, '')), 'bot') AND NOT contains(lower(coalesce(author_login, '')), 'bot')",) * 2,
}


@query("agg_audit_rows", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {sql}) AS c{k.replace('.', '_')}" for k, (sql, _) in _ROW_CHECKS.items()) + ", count(*) AS total FROM occurrences")
def agg_audit_rows(spark, root):
    """Checks of single rows, all in one pass."""
    leak = F.lower(F.coalesce("author_login", F.lit(""))).contains("bot") & ~T.is_bot("author_login", suffixes=False)
    checks = [F.count_if(F.expr(e) if e else leak).alias(f"c{k.replace('.', '_')}") for k, (_, e) in _ROW_CHECKS.items()]
    return occ(spark, root).agg(*checks, rows_().alias("total"))


@query("agg_audit_duplicates", f"""SELECT '3.1' AS check_id, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM occurrences GROUP BY repo_full_name, artifact_type, {BODY_SQL} HAVING count(*) > 1)) AS n
UNION ALL SELECT '3.2', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM occurrences GROUP BY {K} HAVING count(*) > 1))""")
def agg_audit_duplicates(spark, root):
    rows = occ(spark, root)
    over = lambda keys, name: rows.groupBy(*keys).agg(rows_().alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(name).alias("check_id"), "n")
    return over(["repo_full_name", "artifact_type", F.sha2(body_(), 256)], "3.1").unionByName(over(KEY, "3.2"))


def _cross(a, b):
    return f"SELECT coalesce(sum(x.n * y.n), 0)::BIGINT FROM (SELECT repo_full_name, {BODY_SQL} AS body, count(*) AS n FROM occurrences WHERE {KIND} = '{a}' GROUP BY 1, 2) x JOIN (SELECT repo_full_name, {BODY_SQL} AS body, count(*) AS n FROM occurrences WHERE {KIND} = '{b}' GROUP BY 1, 2) y USING (repo_full_name, body)"


@query("join_cross_artifact", f"SELECT '3.3' AS check_id, ({_cross('commit_message', 'pr_body')}) AS n UNION ALL SELECT '3.4', ({_cross('issue_body', 'pr_body')})")
def join_cross_artifact(spark, root):
    """Equal texts of two kinds in one repository; both sides are counted per text first, so no pairs are expanded."""
    n = occ(spark, root).groupBy(kind().alias("k"), "repo_full_name", F.sha2(body_(), 256).alias("h")).agg(rows_().alias("n"))
    of = lambda k, c: n.where(F.col("k") == k).select("repo_full_name", "h", F.col("n").alias(c))
    both = lambda a, name: of(a, "x").join(of("pr_body", "y"), ["repo_full_name", "h"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("n")).select(F.lit(name).alias("check_id"), "n")
    return both("commit_message", "3.3").unionByName(both("issue_body", "3.4"))


@query("agg_audit_paths", f"SELECT count(*) AS total, count(*) FILTER (WHERE {VENDORED_SQL}) AS c5_1, count(*) FILTER (WHERE {LIBRARY_SQL}) AS c5_2, count(*) FILTER (WHERE {BUNDLE_SQL}) AS c5_3, CASE WHEN count(*) FILTER (WHERE {LIBRARY_SQL}) / count(*)::DOUBLE >= 0.02 THEN 'alta' WHEN count(*) FILTER (WHERE {LIBRARY_SQL}) > 0 THEN 'média' ELSE 'info' END AS severity FROM {CODE}")
def agg_audit_paths(spark, root):
    lib = F.count_if(T.is_known_library("path"))
    return code(spark, root).agg(
        rows_().alias("total"), F.count_if(T.is_vendored("path")).alias("c5_1"), lib.alias("c5_2"), F.count_if(T.is_bundle("path")).alias("c5_3"),
        F.when(S.ratio(lib, rows_()) >= 0.02, "alta").when(lib > 0, "média").otherwise("info").alias("severity"),
    )


@query("smp_removal_audit", f"""WITH r AS (SELECT {K}, row_number() OVER (PARTITION BY repo_full_name ORDER BY md5(concat_ws('|', artifact_id, matched_expression)), artifact_id, matched_expression) AS rn FROM (SELECT DISTINCT {K} FROM {CODE} WHERE is_censored = 0))
SELECT {K} FROM r WHERE rn = 1 ORDER BY md5(repo_full_name), repo_full_name LIMIT 50""")
def smp_removal_audit(spark, root):
    """One removal per repository, fifty repositories: a sampling operator."""
    rows = code(spark, root).where("is_censored = 0").select(*KEY)
    first = rows.groupBy("repo_full_name").agg(F.min(F.struct(F.md5(F.concat_ws("|", "artifact_id", "matched_expression")), "artifact_id", "matched_expression", "artifact_type")).alias("r"))
    return first.orderBy(F.md5("repo_full_name"), "repo_full_name").limit(50).select("repo_full_name", "r.artifact_type", "r.artifact_id", "r.matched_expression")


LONG_AUDIT = ["1.1", "1.2", "1.3", "1.4", "1.5", "1.6", "4.1", "4.2"]


def _severity_sql(n):
    return f"CASE WHEN {n} = 0 THEN 'info' WHEN {n} / total::DOUBLE >= 0.02 THEN 'alta' ELSE 'média' END"


@query("agg_audit", "WITH r AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE {sql}) AS c{k.replace('.', '_')}" for k, (sql, _) in _ROW_CHECKS.items()) + ", count(*) AS total FROM occurrences) "
       + " UNION ALL ".join(f"SELECT '{k}' AS check_id, c{k.replace('.', '_')} AS n, total, round(100.0 * c{k.replace('.', '_')} / total, 2)::DOUBLE AS pct, {_severity_sql('c' + k.replace('.', '_'))} AS severity FROM r" for k in LONG_AUDIT))
def agg_audit(spark, root):
    """The checks of single rows as one long table with shares and severities; an empty corpus gives no shares."""
    wide = agg_audit_rows(spark, root)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(f"c{k.replace('.', '_')}").alias("n")) for k in LONG_AUDIT])).alias("c")
    rate = S.ratio(F.col("n"), F.col("total"))
    long = wide.select(each, "total").select("c.*", "total")
    return long.select("check_id", "n", "total", F.round(100 * rate, 2).alias("pct"), F.when(F.col("n") == 0, "info").when(rate >= 0.02, "alta").otherwise("média").alias("severity"))
