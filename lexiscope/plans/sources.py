"""Queries of record building, joins, set operations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import lexicon as L
from lexiscope.functions import text as T
from lexiscope.operators import events as E
from lexiscope.operators import skew
from lexiscope.plans.registry import query
from lexiscope.plans.texts import CODE, DAYS_SQL, K, KEY, KIND, LEXICON_SQL, code, kind, normal_sql, occ
from lexiscope.sources import files
from lexiscope.sources.tables import load

N_SQL = "count(*)"


def repos(spark, root):
    return load(spark, root, "repos")


@query("src_repo_normalize", """SELECT DISTINCT repo_full_name, split_part(repo_full_name, '/', 1) AS owner, split_part(repo_full_name, '/', 2) AS name, coalesce(nullif(stars, 0), nullif(forks, 0)) AS weight,
 coalesce(nullif(html_url, ''), 'https://forge.example/' || repo_full_name) AS html_url FROM repos""")
def src_repo_normalize(spark, root):
    """Alternatives are tried in turn; 0 and '' count as missing."""
    full = F.col("repo_full_name")
    return repos(spark, root).select(
        full, F.split_part(full, F.lit("/"), F.lit(1)).alias("owner"), F.split_part(full, F.lit("/"), F.lit(2)).alias("name"),
        F.coalesce(F.nullif("stars", F.lit(0)), F.nullif("forks", F.lit(0))).alias("weight"),
        F.coalesce(F.nullif("html_url", F.lit("")), F.concat(F.lit("https://forge.example/"), full)).alias("html_url"),
    ).distinct()


PAGE = "regexp_extract(html_url, 'forge\\.example/([^/]+/[^/]+)$', 1)"


@query("src_canonicalize", f"""WITH c AS (SELECT repo_full_name, CASE WHEN html_url IS NULL OR {PAGE} = '' THEN repo_full_name ELSE {PAGE} END AS canonical FROM (SELECT repo_full_name, max(html_url) AS html_url FROM repos GROUP BY 1))
SELECT lower(canonical) AS canonical, min_by(repo_full_name, (lower(repo_full_name) <> lower(canonical), repo_full_name)) AS kept, count(*) AS n_names FROM c GROUP BY 1""")
def src_canonicalize(spark, root):
    """One row per repository after renames, compared without case; the row of the current name is preferred."""
    page = F.nullif(F.regexp_extract("html_url", r"forge\.example/([^/]+/[^/]+)$", 1), F.lit(""))
    names = repos(spark, root).groupBy("repo_full_name").agg(F.max("html_url").alias("html_url")).withColumn("canonical", F.coalesce(page, "repo_full_name"))
    order = F.struct(F.lower("repo_full_name") != F.lower("canonical"), F.col("repo_full_name"))
    return names.groupBy(F.lower("canonical").alias("canonical")).agg(F.min_by("repo_full_name", order).alias("kept"), F.count(F.lit(1)).alias("n_names"))


@query("src_search_batches")
def src_search_batches(spark, root):
    """Repositories packed into queries of at most 256 characters: greedily within slices of the hash, each at most some thousands."""
    import pandas as pd

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        batch, used, out = 0, 40, []
        for name in sorted(group.repo_full_name):
            need = len("repo:") + len(name) + 1
            if out and used + need > 256 and used > 40:
                batch, used = batch + 1, 40
            used += need
            out.append((f"{group.slice.iloc[0]}-{batch}", name))
        return pd.DataFrame(out, columns=["batch", "repo_full_name"])

    names = repos(spark, root).select("repo_full_name").where("repo_full_name IS NOT NULL").distinct()
    slices = max(1, names.count() // 2000)
    return names.withColumn("slice", F.pmod(F.xxhash64("repo_full_name"), F.lit(slices)).cast("int")).groupBy("slice").applyInPandas(pack, "batch string, repo_full_name string")


CUT = "TIMESTAMPTZ '2026-07-23 23:59:59+00'"


def cutoff():
    return F.timestamp_micros(F.lit(1784851199000000))


@query("src_issue_pr", f"""SELECT {K}, regexp_replace(body_text, '^\\s+|\\s+$', '', 'g') AS body, removed_at::TIMESTAMP AS resolved_at, CASE WHEN removed_at IS NULL THEN 1 ELSE 0 END AS censored,
 CASE WHEN created_at IS NOT NULL THEN {DAYS_SQL.format(s='created_at', e=f'coalesce(removed_at, {CUT})')} END AS days, sha256(lower(trim(author_login))) AS author FROM occurrences WHERE {KIND} IN ('issue_body', 'pr_body')""")
def src_issue_pr(spark, root):
    """Items of an issue search, as JSON, to records: trimmed body, time of resolution, censoring, identity."""
    rows = occ(spark, root).where(kind().isin("issue_body", "pr_body"))
    state = F.when(F.col("removed_at").isNotNull(), "closed").otherwise("open")
    item = F.to_json(F.struct(F.col("body_text").alias("body"), F.struct(F.col("author_login").alias("login")).alias("user"), F.unix_micros("created_at").alias("created"), F.unix_micros("removed_at").alias("closed"), state.alias("state")))
    shape = "body string, user struct<login string>, created bigint, closed bigint, state string"
    i = rows.select(*KEY, F.from_json(item, shape).alias("i")).select(*KEY, "i.*")
    resolved = F.when(F.col("state") == "closed", F.timestamp_micros("closed"))
    return i.select(
        *KEY, T.strip("body").alias("body"), resolved.alias("resolved_at"), F.when(resolved.isNull(), 1).otherwise(0).alias("censored"),
        F.when(F.col("created").isNotNull(), T.floor_days(F.timestamp_micros("created"), F.coalesce(resolved, cutoff()))).alias("days"), F.sha2(F.lower(F.trim("user.login")), 256).alias("author"),
    )


@query("src_commit", f"""SELECT {K}, regexp_replace(body_text, '^\\s+|\\s+$', '', 'g') AS message, 1 AS censored, CASE WHEN created_at IS NOT NULL THEN {DAYS_SQL.format(s='created_at', e=CUT)} END AS days FROM occurrences WHERE {KIND} = 'commit_message'""")
def src_commit(spark, root):
    """Commits to records, always censored."""
    rows = occ(spark, root).where(kind() == "commit_message")
    return rows.select(*KEY, T.strip("body_text").alias("message"), F.lit(1).alias("censored"), F.when(F.col("created_at").isNotNull(), T.floor_days("created_at", cutoff())).alias("days"))


@query("src_cap_fallback", f"SELECT repo_full_name, lower(trim(matched_expression)) AS expression, count(*) AS n, count(*) >= 1000 AS is_capped FROM occurrences GROUP BY 1, 2")
def src_cap_fallback(spark, root):
    """Searches that reached the limit of 1000 results and have to be repeated in parts."""
    n = occ(spark, root).groupBy("repo_full_name", F.lower(F.trim("matched_expression")).alias("expression")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("is_capped", F.col("n") >= 1000)


#: fixed values: the structural patterns as a line search knows them
ADJ = "ugly|janky|hacky|messy|dirty|crude|brittle|fragile|sloppy|kludgy|kludge|hackish|gross|nasty|clunky|jury-rigged"
GREP = {
    "but_works": f"({ADJ}).{{0,25}}but.{{0,40}}works",
    "concessive_works": "(although|though|despite|in spite of).{0,60}works",
    "but_passes_tests": "but.{0,25}pass(es|ed|ing)?.{0,20}(tests|ci|suite|build)",
    "concessive_passes_tests": "(although|though|despite).{0,50}pass(es|ed|ing)?.{0,20}(tests|ci|suite|build)",
}


@query("src_git_grep", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT p.pattern, doc_id, i AS line_no, array_to_string(ls[greatest(i - 1, 1):least(i + 1, len(ls))], chr(10)) AS context FROM l, (VALUES """ + ", ".join(f"('{n}', '(?i){rx}')" for n, rx in GREP.items()) + """) AS p(pattern, rx) WHERE regexp_matches(ls[i], p.rx)""")
def src_git_grep(spark, root):
    """Lines that match a structural pattern, with one line on either side; a row per pattern and line."""
    ls = F.split("text", "\n")
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike(f"(?i){rx}"), F.lit(n)) for n, rx in GREP.items()]))
    lines = load(spark, root, "documents").select("doc_id", ls.alias("ls"), F.posexplode(ls).alias("p", "line")).withColumn("pattern", F.explode(hit))
    lo = F.greatest(F.col("p"), F.lit(1))
    return lines.select("pattern", "doc_id", (F.col("p") + 1).alias("line_no"), F.array_join(F.slice("ls", lo, F.least(F.col("p") + 2, F.size("ls")) - lo + 1), "\n").alias("context"))


@query("src_jsonl", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src_jsonl(spark, root):
    return load(spark, root, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def diffs(spark, root):
    """Diff texts made of the code records: one file, one hunk of added lines from line 10 on."""
    head = F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n@@ -0,0 +10,9 @@\n", "path", "path", "path", "path")
    body = F.array_join(F.transform(F.split("body_text", "\n"), lambda l: F.concat(F.lit("+"), l)), "\n")
    rows = code(spark, root).where(~F.col("body_text").rlike(r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).groupBy("repo_full_name", "artifact_id").agg(F.min("path").alias("path"), F.min("body_text").alias("body_text"))
    return rows.select("repo_full_name", "artifact_id", F.concat(head, body).alias("diff_text"))


DIFF_SQL = f"""(WITH r AS (SELECT repo_full_name, artifact_id, min(path) AS path, min(body_text) AS body_text FROM {CODE} WHERE NOT regexp_matches(body_text, '[\\r\\x0b\\x0c\\x1c-\\x1e]') GROUP BY 1, 2),
l AS (SELECT repo_full_name, artifact_id, path, unnest(string_split(body_text, chr(10))) AS text, generate_subscripts(string_split(body_text, chr(10)), 1) AS pos FROM r),
c AS (SELECT * FROM l WHERE NOT starts_with(text, '++'))
SELECT repo_full_name, artifact_id, path, '+' AS sign, text, 9 + row_number() OVER (PARTITION BY repo_full_name, artifact_id ORDER BY pos) AS line_no FROM c)"""


@query("fn_diff_parse", f"SELECT * FROM {DIFF_SQL}")
def fn_diff_parse(spark, root):
    return E.parse_diffs(diffs(spark, root), ["repo_full_name", "artifact_id"]).drop("pos")


@query("src_git_log", f"SELECT repo_full_name, artifact_id, path, sign, text, line_no FROM {DIFF_SQL} WHERE contains({normal_sql('text')}, ' temporary fix ')")
def src_git_log(spark, root):
    """Changed lines that hold a phrase, from diff texts."""
    return fn_diff_parse(spark, root).where(T.has_phrase("text", "temporary fix"))


@query("src_git_log_phrases", f"SELECT repo_full_name, artifact_id, path, sign, line_no, expression FROM {DIFF_SQL} d JOIN {LEXICON_SQL} ON contains({normal_sql('text')}, needle)")
def src_git_log_phrases(spark, root):
    """Changed lines with every phrase of the lexicon that they hold."""
    held = F.array_compact(F.array(*[F.when(T.has_phrase("text", p), F.lit(p)) for p, *_ in L.ENTRIES]))
    return fn_diff_parse(spark, root).select("repo_full_name", "artifact_id", "path", "sign", "line_no", F.explode(held).alias("expression"))


SIGNED = "(SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN '+' ELSE '-' END AS sign FROM events)"


def signed(spark, root):
    sign = F.when(F.col("event_type").isin("click", "view", "signup"), "+").otherwise("-")
    return load(spark, root, "events").select("user_id", "ts", "event_id", sign.alias("sign"))


@query("win_pair_events", f"""WITH l AS (SELECT *, lag(sign) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM {SIGNED}), t AS (SELECT * FROM l WHERE (l IS NULL AND sign = '+') OR sign <> l),
p AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS removed_at FROM t)
SELECT user_id, ts::TIMESTAMP AS created_at, removed_at::TIMESTAMP AS removed_at, CASE WHEN removed_at IS NULL THEN 1 ELSE 0 END AS is_censored FROM p WHERE sign = '+'""")
def win_pair_events(spark, root):
    return E.pair_events(signed(spark, root), ["user_id"], "ts", "event_id")


@query("win_nearest_commit", f"""WITH c AS (SELECT repo_full_name, artifact_id AS sha, created_at AS made FROM occurrences WHERE {KIND} = 'commit_message' AND created_at IS NOT NULL),
r AS (SELECT DISTINCT repo_full_name, date_trunc('month', removed_at) AS month, removed_at FROM {CODE} WHERE removed_at IS NOT NULL)
SELECT r.repo_full_name, r.removed_at::TIMESTAMP AS removed_at, min_by(sha, (abs(epoch_us(made) - epoch_us(r.removed_at)), sha)) AS sha FROM r JOIN c USING (repo_full_name) GROUP BY r.repo_full_name, r.removed_at""")
def win_nearest_commit(spark, root):
    """For every removal the commit of its repository nearest in time.

    No pairs are formed: commits and removals are one ordered stream per (repository, month); each removal sees the last
    commit before it and the first after it, carried over months by one more window over the months' first and last commits.
    """
    from pyspark.sql import Window

    c = occ(spark, root).where((kind() == "commit_message") & F.col("created_at").isNotNull()).select("repo_full_name", F.col("created_at").alias("at"), F.col("artifact_id").alias("sha"), F.lit(0).alias("is_removal")).distinct()
    r = code(spark, root).where("removed_at IS NOT NULL").select("repo_full_name", F.col("removed_at").alias("at"), F.lit(None).cast("string").alias("sha"), F.lit(1).alias("is_removal")).distinct()
    both = c.unionByName(r).withColumn("month", F.trunc("at", "month"))
    commit = F.when(F.col("is_removal") == 0, F.struct("at", "sha"))
    months = both.groupBy("repo_full_name", "month").agg(F.max(F.when(F.col("is_removal") == 0, F.struct("at", F.struct((-F.unix_micros("at")).alias("k"), "sha")))).alias("x"), F.min(commit).alias("first"), F.max_by(commit, F.when(F.col("is_removal") == 0, F.col("at"))).alias("last_any"), F.max(F.when(F.col("is_removal") == 0, F.col("at"))).alias("last_at"))
    wm = Window.partitionBy("repo_full_name").orderBy("month")
    carried = months.select(
        "repo_full_name", "month",
        F.last(F.when(F.col("last_at").isNotNull(), F.col("last_at")), True).over(wm.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first(F.col("first"), True).over(wm.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    # of commits at one instant the smallest sha stands for all
    one = c.groupBy("repo_full_name", "at").agg(F.min("sha").alias("sha"))
    w = Window.partitionBy("repo_full_name", "month").orderBy("at", "is_removal")
    prev = F.last(F.when(F.col("is_removal") == 0, F.col("at")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(F.when(F.col("is_removal") == 0, F.col("at")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("p", prev).withColumn("n", nxt).where("is_removal = 1").join(carried, ["repo_full_name", "month"])
    near = seen.select("repo_full_name", F.col("at").alias("removed_at"), F.explode(F.array(F.coalesce("p", "before"), F.coalesce("n", F.col("after.at")))).alias("at")).where("at IS NOT NULL")
    d = F.abs(F.unix_micros("at") - F.unix_micros("removed_at"))
    return near.join(one, ["repo_full_name", "at"]).groupBy("repo_full_name", "removed_at").agg(F.min_by("sha", F.struct(d, F.col("sha"))).alias("sha"))


def _shared_folder(spark, name):
    import uuid

    from lexiscope.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("src_csv", f"SELECT {K}, replace(replace(body_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body_text FROM occurrences")
def src_csv(spark, root):
    """The records through CSV and back: quotes, blanks and line breaks in fields survive; every kind of line break becomes one."""
    at = _shared_folder(spark, "csv")
    files.write_csv(occ(spark, root).select(*KEY, "body_text"), at)
    back = files.read_csv(spark, at, ", ".join(f"{c} string" for c in [*KEY, "body_text"]))
    return back.withColumn("body_text", F.regexp_replace("body_text", r"\r\n|\r", "\n"))


@query("src_repos", "SELECT repo_full_name, stars FROM repos")
def src_repos(spark, root):
    """Repositories from stored pages of a search: JSON lines with an array of items."""
    at = _shared_folder(spark, "pages")
    item = F.struct("repo_full_name", "stars")
    pages = repos(spark, root).withColumn("page", F.pmod(F.xxhash64("repo_full_name", "stars"), F.lit(4096))).groupBy("page").agg(F.collect_list(item).alias("items"))
    pages.select("items").write.json(at)
    return files.read_pages(spark, at, "repo_full_name:string,stars:int")


@query("snk_append", f"SELECT {KIND} AS kind, 2 * count(*) AS n FROM occurrences GROUP BY 1")
def snk_append(spark, root):
    """Two appended batches are read as one table."""
    at = _shared_folder(spark, "append")
    for _ in range(2):
        files.append(occ(spark, root).select(kind().alias("kind")), at)
    return spark.read.parquet(at).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("src_json_manifest", "SELECT 'occurrences' AS name, count(*) AS n_rows FROM occurrences UNION ALL SELECT 'repos', count(*) FROM repos UNION ALL SELECT 'documents', count(*) FROM documents")
def src_json_manifest(spark, root):
    """A manifest as JSON lines, written and read back."""
    at = _shared_folder(spark, "manifest")
    out = None
    for t in ("occurrences", "repos", "documents"):
        n = load(spark, root, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    out.select(F.to_json(F.struct("name", "n_rows")).alias("value")).write.text(at)
    return files.read_jsonl(spark, at, "name string, n_rows bigint")[0]


# ---- joins and sets ------------------------------------------------------------------------------------------------


@query("join_label_left", f"SELECT {', '.join('o.' + k for k in KEY)}, l.label FROM occurrences o LEFT JOIN (SELECT repo_full_name, url, bool_or(gold_is_ubw) AS label FROM nao_unanimes GROUP BY 1, 2) l ON o.repo_full_name = l.repo_full_name AND o.url = l.url")
def join_label_left(spark, root):
    labels = load(spark, root, "nao_unanimes").groupBy("repo_full_name", "url").agg(F.bool_or("gold_is_ubw").alias("label"))
    return occ(spark, root).select(*KEY, "url").join(labels, ["repo_full_name", "url"], "left").select(*KEY, "label")


CI = "(SELECT lower(repo_full_name) AS low, max(stars) AS stars FROM repos GROUP BY 1)"


@query("join_lookup_ci", f"SELECT {', '.join('o.' + k for k in KEY)}, r.stars FROM occurrences o JOIN {CI} r ON lower(o.repo_full_name) = r.low")
def join_lookup_ci(spark, root):
    """Lookup without regard to case; unmatched rows are dropped, ``join_lookup_unmatched`` counts them."""
    low = repos(spark, root).groupBy(F.lower("repo_full_name").alias("low")).agg(F.max("stars").alias("stars"))
    facts = occ(spark, root).select(*KEY, F.lower("repo_full_name").alias("low"))
    found = skew.joined_evenly(facts, low.withColumn("hit", F.lit(1)), "low", ["artifact_id"])
    return found.where("hit = 1").select(*KEY, "stars")


@query("join_lookup_unmatched", f"SELECT repo_full_name, count(*) AS n FROM occurrences o WHERE NOT EXISTS (SELECT 1 FROM {CI} r WHERE r.low = lower(o.repo_full_name)) GROUP BY 1")
def join_lookup_unmatched(spark, root):
    low = repos(spark, root).select(F.lower("repo_full_name").alias("low")).distinct()
    per = occ(spark, root).groupBy("repo_full_name").agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.lower("repo_full_name"))
    return per.join(low, "low", "left_anti").select("repo_full_name", "n")


@query("join_gold_to_corpus", """SELECT count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.url = g.url AND lower(trim(o.matched_expression)) = lower(trim(g.matched_expression)))) AS n_missing FROM (SELECT DISTINCT url, matched_expression FROM nao_unanimes) g""")
def join_gold_to_corpus(spark, root):
    """Gold items whose (url, phrase) has no record; a release must have none."""
    g = load(spark, root, "nao_unanimes").select("url", "matched_expression").distinct().withColumn("e", F.lower(F.trim("matched_expression")))
    o = occ(spark, root).select("url", F.lower(F.trim("matched_expression")).alias("e")).distinct().withColumn("hit", F.lit(1))
    return g.join(o, ["url", "e"], "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNull()).alias("n_missing"))


@query("join_one_to_one", "WITH l AS (SELECT item_id, count(*) AS n FROM (SELECT DISTINCT item_id, repo_full_name FROM nao_unanimes) GROUP BY 1), r AS (SELECT item_id, count(*) AS n FROM (SELECT DISTINCT item_id, artifact_type FROM annotations_long) GROUP BY 1) SELECT (SELECT count(*) FROM l JOIN r USING (item_id)) AS n, (SELECT coalesce(max(n), 0) FROM l) <= 1 AND (SELECT coalesce(max(n), 0) FROM r) <= 1 AS is_one_to_one")
def join_one_to_one(spark, root):
    left = load(spark, root, "nao_unanimes").select("item_id", "repo_full_name").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("l"))
    right = load(spark, root, "annotations_long").select("item_id", "artifact_type").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("r"))
    both = left.join(right, "item_id", "full")
    ok = F.coalesce(F.max(F.greatest(F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0)))), F.lit(0)) <= 1
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n"), ok.alias("is_one_to_one"))


def known(spark, root):
    """Records with hit = 1 where their repository has a row; a large repository is cut into shards, its row goes to each."""
    side = repos(spark, root).select("repo_full_name").distinct().withColumn("hit", F.lit(1))
    return skew.joined_evenly(occ(spark, root).select(*KEY), side, "repo_full_name", ["artifact_id"])


query("join_semi", f"SELECT {K} FROM occurrences o WHERE EXISTS (SELECT 1 FROM repos r WHERE r.repo_full_name = o.repo_full_name)")(lambda spark, root: known(spark, root).where("hit = 1").select(*KEY))
query("join_anti", f"SELECT {K} FROM occurrences o WHERE NOT EXISTS (SELECT 1 FROM repos r WHERE r.repo_full_name = o.repo_full_name)")(lambda spark, root: known(spark, root).where("hit IS NULL").select(*KEY))


@query("join_diff_backup", "SELECT 'only_records' AS side, repo_full_name FROM (SELECT DISTINCT repo_full_name FROM occurrences EXCEPT SELECT repo_full_name FROM repos) UNION ALL SELECT 'only_repos', repo_full_name FROM (SELECT DISTINCT repo_full_name FROM repos EXCEPT SELECT repo_full_name FROM occurrences)")
def join_diff_backup(spark, root):
    o, r = occ(spark, root).select("repo_full_name").distinct(), repos(spark, root).select("repo_full_name").distinct()
    side = lambda a, b, n: a.join(b, "repo_full_name", "left_anti").select(F.lit(n).alias("side"), "repo_full_name")
    return side(o, r, "only_records").unionByName(side(r, o, "only_repos"))


@query("set_union_dedup", "WITH u AS (SELECT item_id, gold_is_ubw AS v, 1 AS rank FROM nao_unanimes UNION ALL SELECT item_id, is_ubw, 0 FROM annotations_long) SELECT item_id, max_by(v, (rank, coalesce(v, false))) AS v FROM u WHERE v IS NOT NULL GROUP BY item_id")
def set_union_dedup(spark, root):
    """Two sources stacked; per key the row of the higher rank."""
    a = load(spark, root, "nao_unanimes").select("item_id", F.col("gold_is_ubw").alias("v"), F.lit(1).alias("rank"))
    b = load(spark, root, "annotations_long").select("item_id", F.col("is_ubw").alias("v"), F.lit(0).alias("rank"))
    return a.unionByName(b).where("v IS NOT NULL").groupBy("item_id").agg(F.max_by("v", F.struct("rank", "v")).alias("v"))


@query("set_merge_sources", "SELECT item_id, string_agg(DISTINCT annotator_id, ';' ORDER BY annotator_id) AS sources FROM annotations_long GROUP BY item_id")
def set_merge_sources(spark, root):
    return load(spark, root, "annotations_long").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("annotator_id")), ";").alias("sources"))


@query("snk_upsert", "WITH b AS (SELECT repo_full_name, max(stars) AS stars FROM repos GROUP BY 1), c AS (SELECT repo_full_name, max(repo_stars) AS stars FROM occurrences WHERE repo_stars IS NOT NULL GROUP BY 1) SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo_full_name = b.repo_full_name) UNION ALL SELECT * FROM c")
def snk_upsert(spark, root):
    base = repos(spark, root).groupBy("repo_full_name").agg(F.max("stars").alias("stars"))
    changes = occ(spark, root).where("repo_stars IS NOT NULL").groupBy("repo_full_name").agg(F.max("repo_stars").alias("stars"))
    return files.upsert(base, changes, ["repo_full_name"])


@query("agg_scalability_dlq", "SELECT user_id, count(*) AS attempts, count(*) >= 3 AS is_dead FROM events WHERE event_type = 'error' GROUP BY 1")
def agg_scalability_dlq(spark, root):
    """Attempts per key of a dead-letter log; three and more are skipped from then on."""
    n = load(spark, root, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"))
    return n.withColumn("is_dead", F.col("attempts") >= 3)
