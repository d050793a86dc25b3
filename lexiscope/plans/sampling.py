"""Samples, pools, batches and exemplars."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import stats as S
from lexiscope.operators import sampling as P
from lexiscope.plans.agreement import resolved
from lexiscope.plans.registry import query
from lexiscope.plans.texts import K, KEY, KIND, NEAR_MISS, kind, near_miss_flags, occ
from lexiscope.session import cut_lineage
from lexiscope.sources.tables import load

SEED = 42
ORDER_SQL = "md5(concat_ws('|', " + ", ".join(f"coalesce({k}, '')" for k in KEY) + ", '{seed}'))"
U = f"(SELECT {K}, {KIND} AS kind, min(category_ubw) AS category, min(body_text) AS body FROM occurrences GROUP BY ALL)"


def order_sql(seed=SEED):
    return ORDER_SQL.format(seed=seed) + f", {K}"


def units(spark, root):
    """One row per stored record key."""
    return occ(spark, root).groupBy(*KEY).agg(F.min("category_ubw").alias("category"), F.min("body_text").alias("body")).withColumn("kind", kind())


@query("smp_stratified")
def smp_stratified(spark, root):
    return P.stratified(units(spark, root), "kind", KEY, 385, SEED).select(*KEY, "kind")


@query("smp_calibration", f"SELECT {K}, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {order_sql()}) AS rn FROM {U}) WHERE rn <= 50")
def smp_calibration(spark, root):
    return P.first_per_group(units(spark, root), ["kind"], KEY, SEED, 50).select(*KEY, "kind")


@query("smp_census_cap", f"SELECT {K} FROM (SELECT *, row_number() OVER (ORDER BY {order_sql()}) AS rn FROM {U} WHERE category = 'C') WHERE rn <= 300")
def smp_census_cap(spark, root):
    """All records of the rare category, or 300 of them."""
    return P.first_rows(units(spark, root).where("category = 'C'"), KEY, SEED, 300).select(*KEY)


WATCH = f"(SELECT lower(trim(matched_expression)) AS e FROM {U} GROUP BY 1 HAVING count(*) < 50)"


@query("smp_watchlist", f"SELECT {K} FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(matched_expression)) ORDER BY {order_sql()}) AS rn FROM {U} WHERE lower(trim(matched_expression)) IN (SELECT e FROM {WATCH})) WHERE rn <= 30")
def smp_watchlist(spark, root):
    """Up to thirty records of every phrase with fewer than fifty."""
    u = units(spark, root).withColumn("e", F.lower(F.trim("matched_expression")))
    rare = u.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n < 50").select("e")
    return P.first_per_group(u.join(rare, "e", "left_semi"), ["e"], KEY, SEED, 30).select(*KEY)


def frame(spark, root):
    """What the pools need of each record, without its text, written once: each pool depends on what the earlier ones took."""
    u = units(spark, root).withColumn("flags", near_miss_flags("body")).withColumn("e", F.lower(F.trim("matched_expression")))
    return cut_lineage(u.drop("body"))


def near_miss_pool(pool, n_target=120):
    """For each pattern its quota, each record taken by the first pattern that reaches it; then other flagged records up to the target."""
    per = max(1, n_target // len(NEAR_MISS))
    flagged = cut_lineage(pool.where(F.size("flags") > 0).select(*KEY, "flags"))
    taken = None
    for name in NEAR_MISS:
        left = flagged.where(F.array_contains("flags", name))
        if taken is not None:
            left = left.join(taken, KEY, "left_anti")
        new = P.first_rows(left, KEY, SEED, per).select(*KEY)
        taken = cut_lineage(new if taken is None else taken.unionByName(new))
    short = n_target - taken.count()
    if short <= 0:
        return taken
    return cut_lineage(taken.unionByName(P.first_rows(flagged.join(taken, KEY, "left_anti"), KEY, SEED, short).select(*KEY)))


@query("smp_near_miss")
def smp_near_miss(spark, root):
    return near_miss_pool(frame(spark, root))


@query("smp_pools_v2")
def smp_pools_v2(spark, root):
    """Disjoint pools in order: calibration, watch, near miss, main; a record belongs to the first that drew it."""
    u = frame(spark, root).where("kind <> 'issue_body'")
    calibration = cut_lineage(P.stratified(u, "kind", KEY, 200, SEED).select(*KEY, F.lit("calibration").alias("pool")))
    rest = u.join(calibration, KEY, "left_anti")
    rare = rest.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n < 50").select("e")
    watch = cut_lineage(P.first_per_group(rest.join(rare, "e", "left_semi"), ["e"], KEY, SEED, 30).select(*KEY, F.lit("watch").alias("pool")))
    rest = cut_lineage(rest.join(watch, KEY, "left_anti"))
    near = near_miss_pool(rest, 60).withColumn("pool", F.lit("near_miss"))
    main = P.stratified(rest.join(near, KEY, "left_anti"), "kind", KEY, 385, SEED).select(*KEY, F.lit("main").alias("pool"))
    return calibration.unionByName(watch).unionByName(near).unionByName(main)


@query("smp_pools_v1")
def smp_pools_v1(spark, root):
    """The older design: fifty per kind for calibration, the rare category whole, watch list, near misses, main sample."""
    u = frame(spark, root)
    calibration = cut_lineage(P.first_per_group(u, ["kind"], KEY, SEED, 50).select(*KEY, F.lit("calibration").alias("pool")))
    rest = u.join(calibration, KEY, "left_anti")
    census = cut_lineage(P.first_rows(rest.where("category = 'C'"), KEY, SEED, 300).select(*KEY, F.lit("census_c").alias("pool")))
    rest = cut_lineage(rest.where("category IN ('A', 'B')").join(census, KEY, "left_anti"))
    rare = rest.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n < 50").select("e")
    watch = cut_lineage(P.first_per_group(rest.join(rare, "e", "left_semi"), ["e"], KEY, SEED, 30).select(*KEY, F.lit("watch").alias("pool")))
    rest = cut_lineage(rest.join(watch, KEY, "left_anti"))
    near = near_miss_pool(rest, 60).withColumn("pool", F.lit("near_miss"))
    stratum = F.concat_ws("|", "category", "kind")
    main = P.stratified(rest.join(near, KEY, "left_anti").withColumn("stratum", stratum), "stratum", KEY, 385, SEED).select(*KEY, F.lit("main").alias("pool"))
    return calibration.unionByName(census).unionByName(watch).unionByName(near).unionByName(main)


@query("smp_srs", f"SELECT {K} FROM {U} WHERE kind = 'code_comment' ORDER BY {order_sql(7)} LIMIT 269")
def smp_srs(spark, root):
    """A simple random sample of code comments."""
    return P.first_rows(units(spark, root).where("kind = 'code_comment'"), KEY, 7, 269).select(*KEY)


@query("smp_quota_census", f"SELECT {K} FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(matched_expression)) ORDER BY {order_sql()}) AS rn FROM {U}) WHERE rn <= 30")
def smp_quota_census(spark, root):
    """Thirty records per phrase, all where there are fewer."""
    u = units(spark, root).withColumn("e", F.lower(F.trim("matched_expression")))
    return P.census_or_sample(u, ["e"], KEY, 30, SEED).select(*KEY)


@query("smp_audit")
def smp_audit(spark, root):
    """Every unresolved item and 15 % of the others, with the reason."""
    r = resolved(spark, root)
    doubtful = r.where("resolution = 'unresolved'").select("item_id", F.lit("incerto").alias("reason"))
    sure = r.where("resolution <> 'unresolved'")
    n = sure.count()
    part = P.first_rows(sure, ["item_id"], SEED, int(round(n * 0.15))).select("item_id", F.lit("amostra").alias("reason"))
    return doubtful.unionByName(part)


@query("smp_split_main", "SELECT item_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', coalesce(item_id, ''), '42')), item_id) <= 200 THEN 'medicao' ELSE 'paralelizacao' END AS stage FROM (SELECT DISTINCT item_id FROM annotations_long)")
def smp_split_main(spark, root):
    i = load(spark, root, "annotations_long").select("item_id").distinct()
    first = P.first_rows(i, ["item_id"], SEED, 200).withColumn("stage", F.lit("medicao"))
    return i.join(first, "item_id", "left").select("item_id", F.coalesce("stage", F.lit("paralelizacao")).alias("stage"))


@query("smp_batches", "SELECT item_id, annotator, md5(concat_ws('|', item_id, annotator, '42')) AS position FROM (SELECT DISTINCT item_id FROM nao_unanimes) CROSS JOIN (VALUES ('r1'), ('r2'), ('r3')) a(annotator)")
def smp_batches(spark, root):
    """One blind copy per annotator; ``position`` sorts each copy in its own order."""
    i = load(spark, root, "nao_unanimes").select("item_id").distinct()
    each = i.select("item_id", F.explode(F.array(F.lit("r1"), F.lit("r2"), F.lit("r3"))).alias("annotator"))
    return each.withColumn("position", F.md5(F.concat_ws("|", "item_id", "annotator", F.lit("42"))))


@query("win_concat_order", "SELECT item_id, 'cc' || lpad(CAST(row_number() OVER (ORDER BY md5(concat_ws('|', item_id, '42')), item_id) AS VARCHAR), 4, '0') AS shown FROM (SELECT item_id FROM (SELECT DISTINCT item_id FROM nao_unanimes) ORDER BY md5(concat_ws('|', item_id, '42')), item_id LIMIT 400)")
def win_concat_order(spark, root):
    """Ids in order of presentation for a batch of 400 items."""
    from pyspark.sql import Window

    batch = P.first_rows(load(spark, root, "nao_unanimes").select("item_id").distinct(), ["item_id"], SEED, 400)
    n = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", "item_id", F.lit("42"))), "item_id"))
    return batch.select("item_id", F.concat(F.lit("cc"), F.lpad(n.cast("string"), 4, "0")).alias("shown"))


@query("smp_repo_sample", "SELECT repo_full_name FROM (SELECT DISTINCT repo_full_name FROM occurrences) ORDER BY md5(concat_ws('|', coalesce(repo_full_name, ''), '42')), repo_full_name LIMIT 100")
def smp_repo_sample(spark, root):
    return P.first_rows(occ(spark, root).select("repo_full_name").distinct(), ["repo_full_name"], SEED, 100)


E_SQL = "(SELECT item_id, bool_or(gold_is_ubw) AS gold, max(coalesce(obs__wendell, obs__bruno, obs__miguel)) IS NOT NULL AS has_note FROM nao_unanimes GROUP BY 1 HAVING bool_or(gold_is_ubw) IS NOT NULL)"


def exemplar_pool(spark, root):
    rows = load(spark, root, "nao_unanimes").groupBy("item_id").agg(F.bool_or("gold_is_ubw").alias("gold"), F.max(F.coalesce("obs__wendell", "obs__bruno", "obs__miguel")).isNotNull().alias("has_note"))
    return rows.where("gold IS NOT NULL")


@query("smp_exemplars_fixed", f"SELECT item_id, gold, rn FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY has_note DESC, md5(concat_ws('|', item_id, '42')), item_id) AS rn FROM {E_SQL}) WHERE rn <= 4")
def smp_exemplars_fixed(spark, root):
    """Four exemplars of each class, those with a note first."""
    from pyspark.sql import Window

    w = Window.partitionBy("gold").orderBy(F.desc("has_note"), F.md5(F.concat_ws("|", "item_id", F.lit("42"))), "item_id")
    return exemplar_pool(spark, root).withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("item_id", "gold", "rn")


@query("smp_exemplars_cc", f"SELECT item_id, gold, 2 * rn - CASE WHEN gold THEN 1 ELSE 0 END AS place FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY item_id) AS rn FROM {E_SQL}) WHERE rn <= 3")
def smp_exemplars_cc(spark, root):
    """Three of each class, interleaved."""
    from pyspark.sql import Window

    w = Window.partitionBy("gold").orderBy("item_id")
    rows = exemplar_pool(spark, root).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return rows.select("item_id", "gold", (2 * F.col("rn") - F.col("gold").cast("int")).alias("place"))


@query("fn_fpc", f"SELECT kind, count(*) AS n, CASE WHEN count(*) < 5000 THEN least(CAST(ceil(385 / (1 + 384 / count(*)::DOUBLE)) AS BIGINT), count(*)) ELSE 385 END AS sample FROM {U} GROUP BY kind")
def fn_fpc(spark, root):
    return units(spark, root).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("sample", S.finite_sample(385.0, F.col("n")))
