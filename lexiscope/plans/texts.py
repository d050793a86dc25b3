"""Queries of predicates and scalar functions, row by row over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import lexicon as L
from lexiscope.functions import text as T
from lexiscope.functions import windows as W
from lexiscope.plans.registry import query
from lexiscope.sources.tables import load

KEY = ["repo_full_name", "artifact_type", "artifact_id", "matched_expression"]
K = ", ".join(KEY)
KIND = "lower(trim(artifact_type))"


def occ(spark, root):
    return load(spark, root, "occurrences")


def kind():
    return F.lower(F.trim("artifact_type"))


def code(spark, root):
    return occ(spark, root).where(kind() == "code_comment").withColumn("path", F.regexp_replace("artifact_id", r":\d+$", ""))


CODE = f"(SELECT *, regexp_replace(artifact_id, ':[0-9]+$', '') AS path FROM occurrences WHERE {KIND} = 'code_comment')"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def normal_sql(c: str) -> str:
    return (
        "(' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(" + c + "), '[\\r\\n]+', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', ' ' || chr(10) || ' ', 'g'), ' ') || ' ')"
    )


LEXICON_SQL = "(VALUES " + ", ".join(f"('{p}', '{c}', ' {n} ')" for p, c, n, _ in L.ENTRIES) + ") AS lex(expression, category, needle)"


@query("fn_norm_line", f"SELECT {K}, {normal_sql('body_text')} AS normal FROM occurrences")
def fn_norm_line(spark, root):
    return occ(spark, root).select(*KEY, T.lines_normal("body_text").alias("normal"))


@query("flt_phrase", f"SELECT {K}, contains({normal_sql('body_text')}, ' ' || trim(regexp_replace(lower(matched_expression), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ') AS is_there FROM occurrences")
def flt_phrase(spark, root):
    """Whether a record's own phrase stands in its text."""
    wanted = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("matched_expression"), "[^a-z0-9]+", " ")), F.lit(" "))
    return occ(spark, root).select(*KEY, T.lines_normal("body_text").contains(wanted).alias("is_there"))


@query("join_theta_phrase", f"SELECT {K}, expression, category FROM occurrences, {LEXICON_SQL} WHERE contains({normal_sql('body_text')}, needle)")
def join_theta_phrase(spark, root):
    """Every phrase of the lexicon in every text; the lexicon is inlined, so there is no nested-loop join."""
    rows = occ(spark, root).select(*KEY, T.lines_normal("body_text").alias("normal"))
    return rows.select(*KEY, F.explode(T.phrase_matches("normal")).alias("m")).select(*KEY, "m.expression", "m.category")


@query("fn_category", "SELECT DISTINCT matched_expression, c.category FROM occurrences LEFT JOIN " + LEXICON_SQL.replace("lex(expression, category, needle)", "c(expression, category, needle)") + " ON lower(trim(matched_expression)) = c.expression")
def fn_category(spark, root):
    return occ(spark, root).select("matched_expression").distinct().select("matched_expression", T.category_of("matched_expression").alias("category"))


@query("flt_path_only", f"""
WITH t AS (SELECT {K}, list_filter(regexp_split_to_array(body_text, '\\s+'), lambda x: contains(lower(x), 'stopgap')) AS hits FROM occurrences)
SELECT {K}, len(hits) > 0 AND len(list_filter(hits, lambda x: NOT (contains(x, '/') OR contains(x, chr(92)) OR regexp_matches(x, '\\.\\w{{1,4}}(:\\d+){{0,2}}[):,;.\"'']*$')))) = 0 AS is_path_only FROM t""")
def flt_path_only(spark, root):
    return occ(spark, root).select(*KEY, T.path_only("body_text", "stopgap").alias("is_path_only"))


@query("flt_path_window", f"""
WITH t AS (SELECT {K}, lower(body_text) AS b, instr(lower(body_text), 'stopgap') AS pos_ FROM occurrences)
SELECT {K}, pos_ > 0 AND ((pos_ > 1 AND substr(b, pos_ - 1, 1) IN ('/', chr(92))) OR substr(b, pos_ + 7, 1) IN ('/', chr(92))
  OR contains(b, 'file "') OR contains(b, '.py"') OR contains(b, '.js"') OR contains(b, 'line ') OR contains(b, '/src/') OR contains(b, '/lib/') OR contains(b, '/tools/')) AS near_path FROM t""")
def flt_path_window(spark, root):
    return occ(spark, root).select(*KEY, T.path_near("body_text", "stopgap").alias("near_path"))


@query("fn_extension", f"SELECT {K}, lower(regexp_extract(list_extract(string_split(path, '/'), -1), '[^.](\\.[^.]+)$', 1)) AS extension FROM {CODE}")
def fn_extension(spark, root):
    return code(spark, root).select(*KEY, T.extension("path").alias("extension"))


@query("flt_comment", f"""
WITH l AS (SELECT repo_full_name, artifact_id, matched_expression, artifact_type, ltrim(line, ' ' || chr(9) || chr(13)) AS s,
                  lower(regexp_extract(list_extract(string_split(path, '/'), -1), '[^.](\\.[^.]+)$', 1)) AS e
           FROM (SELECT *, unnest(string_split(body_text, chr(10))) AS line FROM {CODE})),
q AS (SELECT *, CASE WHEN e IN ('.py', '.rb') THEN instr(s, '#') WHEN e IN ({quoted(L.LINE_COMMENTS['//'])}) THEN instr(s, '//') ELSE 0 END AS pos_ FROM l)
SELECT {K}, count(*) AS n_lines, count(*) FILTER (WHERE
   (pos_ > 0 AND (length(substr(s, 1, pos_ - 1)) - length(replace(substr(s, 1, pos_ - 1), '"', ''))) % 2 = 0 AND (length(substr(s, 1, pos_ - 1)) - length(replace(substr(s, 1, pos_ - 1), '''', ''))) % 2 = 0)
   OR (e IN ({quoted(L.BLOCK_COMMENTS['/*'])}) AND contains(s, '/*')) OR (e = '.py' AND (contains(s, chr(34) || chr(34) || chr(34)) OR contains(s, '''''''')))) AS n_comments
FROM q GROUP BY ALL""")
def flt_comment(spark, root):
    """Lines and comment lines of every code record."""
    lines = code(spark, root).select(*KEY, T.extension("path").alias("e"), F.explode(F.split("body_text", "\n")).alias("line"))
    return lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_comment("line", "e")).alias("n_comments"))


VENDORED_SQL = (
    "(len(list_filter([" + quoted(L.VENDORED_MARKERS) + "], lambda m: contains(CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END, m))) > 0 OR lower(list_extract(string_split(path, '/'), -1)) IN (" + quoted(L.VENDORED_FILES)
    + ") OR regexp_matches(lower(list_extract(string_split(path, '/'), -1)), '\\.min\\.(js|css)$') OR regexp_matches(path, '" + L.VERSION_FOLDER + "'))"
)


@query("flt_vendored", f"SELECT {K}, {VENDORED_SQL} AS is_vendored FROM {CODE}")
def flt_vendored(spark, root):
    return code(spark, root).select(*KEY, T.is_vendored("path").alias("is_vendored"))


LIBRARY_SQL = "regexp_matches(lower(path), '(^|/)(" + "|".join(L.KNOWN_LIBRARIES) + ")(/|-|_|\\.|$)')"
BUNDLE_SQL = "regexp_matches(lower(path), '\\.min\\.(js|css)$|[-_][0-9a-f]{8,}\\.js$')"


@query("flt_known_libs", f"SELECT {K}, {LIBRARY_SQL} AS is_library FROM {CODE}")
def flt_known_libs(spark, root):
    return code(spark, root).select(*KEY, T.is_known_library("path").alias("is_library"))


@query("flt_bundle", f"SELECT {K}, {BUNDLE_SQL} AS is_bundle FROM {CODE}")
def flt_bundle(spark, root):
    return code(spark, root).select(*KEY, T.is_bundle("path").alias("is_bundle"))


def bot_sql(c: str, suffixes: bool = True) -> str:
    more = f" OR ends_with(lower({c}), '-bot') OR ends_with(lower({c}), '-robot')" if suffixes else ""
    return f"coalesce(contains(lower({c}), '[bot]') OR lower({c}) IN ({quoted(L.BOT_LOGINS)}){more}, false)"


@query("flt_bot", f"SELECT {K}, {bot_sql('author_login')} AS bot_login, {bot_sql('author_name')} AS bot_name FROM occurrences")
def flt_bot(spark, root):
    return occ(spark, root).select(*KEY, T.is_bot("author_login").alias("bot_login"), T.is_bot("author_name").alias("bot_name"))


@query("flt_bot_stale", f"SELECT {K}, {bot_sql('author_login', False)} AS bot_login FROM occurrences")
def flt_bot_stale(spark, root):
    return occ(spark, root).select(*KEY, T.is_bot("author_login", suffixes=False).alias("bot_login"))


#: fixed values: the wide pattern of automated identities
WIDE_BOT = r"\[bot\]|dependabot|renovate|github-actions|greenkeeper|snyk-bot|codecov|imgbot|allcontributors|semantic-release|pre-commit-ci|mergify|copilot|(^|[-_.])bot($|[-_@.])|robot$"
IDENTITY = ["author_name", "author_login", "author_email"]


@query("flt_bot_wide", f"SELECT {K}, " + " OR ".join(f"regexp_matches(coalesce(lower(trim({c})), ''), '{WIDE_BOT}')" for c in IDENTITY) + " AS is_bot FROM occurrences")
def flt_bot_wide(spark, root):
    hit = F.lit(False)
    for c in IDENTITY:
        hit = hit | F.coalesce(F.lower(F.trim(c)), F.lit("")).rlike(WIDE_BOT)
    return occ(spark, root).select(*KEY, hit.alias("is_bot"))


STOP_SQL = """(len(list_filter(regexp_split_to_array(body_text, '\\s+'), lambda x: contains(lower(x), 'stopgap'))) > 0 AND len(list_filter(regexp_split_to_array(body_text, '\\s+'), lambda x: contains(lower(x), 'stopgap') AND NOT (contains(x, '/') OR contains(x, chr(92)) OR regexp_matches(x, '\\.\\w{1,4}(:\\d+){0,2}[):,;."'']*$')))) = 0)"""


@query("flt_content", f"""SELECT {K}, CASE WHEN {bot_sql('author_login')} OR {bot_sql('author_name')} THEN 'bot'
  WHEN NOT contains({normal_sql('body_text')}, ' ' || trim(regexp_replace(lower(matched_expression), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ') THEN 'phrase_absent'
  WHEN lower(trim(matched_expression)) = 'stopgap' AND {STOP_SQL} THEN 'path_only' END AS reason FROM occurrences""")
def flt_content(spark, root):
    """The first reason to reject a record; null keeps it."""
    wanted = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("matched_expression"), "[^a-z0-9]+", " ")), F.lit(" "))
    reason = (
        F.when(T.is_bot("author_login") | T.is_bot("author_name"), "bot").when(~T.lines_normal("body_text").contains(wanted), "phrase_absent")
        .when((F.lower(F.trim("matched_expression")) == "stopgap") & T.path_only("body_text", "stopgap"), "path_only")
    )
    return occ(spark, root).select(*KEY, reason.alias("reason"))


@query("flt_email_usable", f"SELECT {K}, coalesce(regexp_matches(lower(trim(author_email)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AND NOT contains(lower(author_email), 'noreply') AND NOT contains(lower(author_email), 'no-reply'), false) AS is_usable FROM occurrences")
def flt_email_usable(spark, root):
    mail = F.lower(F.trim("author_email"))
    usable = mail.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & ~mail.contains("noreply") & ~mail.contains("no-reply")
    return occ(spark, root).select(*KEY, F.coalesce(usable, F.lit(False)).alias("is_usable"))


GUARD = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
BENIGN = r"redacted|example\.(com|org|net)|@users\.noreply\.github\.com|^noreply@"


@query("flt_pii_guard", f"""
WITH t AS (SELECT {K}, list_filter(regexp_split_to_array(body_text, '[ \\n\\t<>\",]'), lambda x: NOT contains(x, '/') AND contains(x, '@')) AS tokens FROM occurrences)
SELECT {K}, len(list_filter(flatten(list_transform(tokens, lambda x: regexp_extract_all(x, '{GUARD}'))), lambda m: NOT regexp_matches(lower(m), '{BENIGN}'))) AS n_addresses FROM t""")
def flt_pii_guard(spark, root):
    """Addresses in prose: in tokens without a slash, and not of a known harmless form."""
    tokens = F.filter(F.split("body_text", r"[ \n\t<>\",]"), lambda x: ~x.contains("/") & x.contains("@"))
    found = F.flatten(F.transform(tokens, lambda x: F.regexp_extract_all(x, F.lit(GUARD), F.lit(0))))
    return occ(spark, root).select(*KEY, F.size(F.filter(found, lambda m: ~F.lower(m).rlike(BENIGN))).alias("n_addresses"))


#: fixed values: patterns of texts that only look like an admission
NEAR_MISS = {
    "string_teste_fixture": r"(?i)\b(def\s+test_|assert\s|pytest|fixture|mock)\b",
    "citacao_terceiro": r"(?i)\b(said|commented|reviewer|reopened|reported|according to|called it|revisor comentou)\b",
    "negacao": r"(?i)\b(not\s+a|isn't\s+a|n't\s+a|never\s+a|no longer\s+a|not really\s+a|não é\s)\b",
    "remocao_undo": r"(?i)\b(remove[sd]?|deleted?|delete this|root cause fixed|no longer needed|refactor.*remove)\b",
    "tooling_generated": r"(?i)(AUTO-GENERATED|auto-generated|DO NOT EDIT|codegen|generated by)",
    "nao_tecnico": r"(?i)\b(onboarding|process|workflow|meeting|roadmap|HR)\b",
}


def near_miss_flags(text):
    return F.array_compact(F.array(*[F.when(T.col(text).rlike(p), F.lit(n)) for n, p in NEAR_MISS.items()]))


NEAR_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(body_text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in NEAR_MISS.items()) + "], lambda x: x IS NOT NULL), ';')"


@query("flt_near_miss", f"SELECT {K}, {NEAR_SQL} AS flags FROM occurrences")
def flt_near_miss(spark, root):
    return occ(spark, root).select(*KEY, F.array_join(near_miss_flags("body_text"), ";").alias("flags"))


@query("flt_time_window", """
WITH e AS (SELECT max(created_at) AS e FROM occurrences), w AS (SELECT unnest([12, 18, 24]) AS months)
SELECT months, count(*) AS n FROM occurrences, e, w WHERE created_at > e - to_months(months::INTEGER) AND created_at <= e GROUP BY months""")
def flt_time_window(spark, root):
    """Records of the last 12, 18 and 24 months up to the newest, left-open."""
    rows = occ(spark, root).select("created_at")
    end = F.lit(rows.agg(F.max("created_at")).first()[0]).cast("timestamp")
    months = F.filter(F.array(F.lit(12), F.lit(18), F.lit(24)), lambda m: (F.col("created_at") > end - F.make_interval(months=m)) & (F.col("created_at") <= end))
    return rows.select(F.explode(months).alias("months")).groupBy("months").agg(F.count(F.lit(1)).alias("n"))


@query("flt_artifact_scope", f"SELECT {KIND} AS artifact, count(*) AS n FROM occurrences WHERE {KIND} IN ('code_comment', 'commit_message', 'pr_body') GROUP BY 1")
def flt_artifact_scope(spark, root):
    return occ(spark, root).where(kind().isin("code_comment", "commit_message", "pr_body")).groupBy(kind().alias("artifact")).agg(F.count(F.lit(1)).alias("n"))


# ---- scalar functions ----------------------------------------------------------------------------------------------


@query("fn_slots", f"""
SELECT {K}, nullif(lower(trim(regexp_extract(body_text, '(?i)([\\w''-]+(?:\\s+[\\w''-]+){{0,2}})\\s+but\\b', 1), ' ')), '') AS pre_but,
 nullif(lower(trim(regexp_extract(body_text, '(?i)([\\w''-]+(?:\\s+[\\w''-]+){{0,2}})\\s+works?\\b', 1), ' ')), '') AS pre_works,
 nullif(lower(trim(regexp_extract(body_text, '(?i)\\bbut\\b\\s+([^\\n\\r]{{1,40}})', 1), ' ')), '') AS post_but FROM occurrences""")
def fn_slots(spark, root):
    return occ(spark, root).select(*KEY, T.slots("body_text").alias("s")).select(*KEY, "s.*")


LITERAL = [(p, p.replace(" ", "_")) for p in W.LITERALS]


@query("fn_literal_pattern", f"SELECT {K}, " + ", ".join(f"regexp_matches(body_text, '(?i)\\b{p}\\b') AS {n}" for p, n in LITERAL) + " FROM occurrences")
def fn_literal_pattern(spark, root):
    return occ(spark, root).select(*KEY, *[F.col("body_text").rlike(rf"(?i)\b{p}\b").alias(n) for p, n in LITERAL])


@query("fn_find_matches")
def fn_find_matches(spark, root):
    """Windows of 30 characters around each match of each pattern, overlapping ones too, by pattern and position."""
    return occ(spark, root).select(*KEY, F.inline(W.find_matches("body_text")))


@query("fn_artifact_split", f"""
SELECT {K}, regexp_extract(artifact_id, '^(.*):(\\d+)$', 1) AS path, TRY_CAST(regexp_extract(artifact_id, '^(.*):(\\d+)$', 2) AS INTEGER) AS line,
 regexp_extract(url, '/blob/([0-9a-f]+)/', 1) AS sha, TRY_CAST(regexp_extract(url, '#L(\\d+)$', 1) AS INTEGER) AS url_line FROM {CODE}""")
def fn_artifact_split(spark, root):
    get = lambda c, rx, g: F.regexp_extract(c, rx, g)
    return code(spark, root).select(
        *KEY, get("artifact_id", r"^(.*):(\d+)$", 1).alias("path"), get("artifact_id", r"^(.*):(\d+)$", 2).try_cast("int").alias("line"),
        get("url", r"/blob/([0-9a-f]+)/", 1).alias("sha"), get("url", r"#L(\d+)$", 1).try_cast("int").alias("url_line"),
    )


@query("fn_permalink", f"SELECT {K}, 'https://forge.example/' || repo_full_name || '/blob/' || regexp_extract(url, '/blob/([0-9a-f]+)/', 1) || '/' || path || '#L' || regexp_extract(artifact_id, ':(\\d+)$', 1) AS permalink FROM {CODE}")
def fn_permalink(spark, root):
    link = F.format_string("https://forge.example/%s/blob/%s/%s#L%s", "repo_full_name", F.regexp_extract("url", r"/blob/([0-9a-f]+)/", 1), "path", F.regexp_extract("artifact_id", r":(\d+)$", 1))
    return code(spark, root).select(*KEY, link.alias("permalink"))


DAYS_SQL = "greatest(0, CAST(floor((epoch_us({e}) - epoch_us({s})) / 86400000000.0) AS BIGINT))"


@query("fn_days", f"SELECT {K}, {DAYS_SQL.format(s='created_at', e='removed_at')} AS days FROM occurrences WHERE created_at IS NOT NULL AND removed_at IS NOT NULL")
def fn_days(spark, root):
    return occ(spark, root).where("created_at IS NOT NULL AND removed_at IS NOT NULL").select(*KEY, T.floor_days("created_at", "removed_at").alias("days"))


@query("fn_lifetimes_recompute", f"""
WITH c AS (SELECT *, TIMESTAMPTZ '2026-07-23 23:59:59+00' AS cutoff FROM occurrences),
d AS (SELECT {KIND} AS artifact, is_censored, time_to_event_days AS old, created_at, removed_at,
      CASE WHEN is_censored = 1 THEN {DAYS_SQL.format(s='created_at', e='cutoff')} ELSE time_to_event_days END AS new, cutoff FROM c)
SELECT artifact, count(*) AS n, count(*) FILTER (WHERE new IS DISTINCT FROM old) AS n_changed, count(*) FILTER (WHERE is_censored = 1 AND removed_at IS NOT NULL) AS censored_with_end,
  count(*) FILTER (WHERE is_censored = 0 AND removed_at IS NULL) AS observed_without_end, count(*) FILTER (WHERE removed_at < created_at) AS end_before_start,
  count(*) FILTER (WHERE created_at > cutoff) AS after_cutoff, count(*) FILTER (WHERE new < 0) AS negative FROM d GROUP BY artifact""")
def fn_lifetimes_recompute(spark, root):
    """Censored lifetimes against one cutoff, with the consistency checks counted."""
    cutoff = F.timestamp_micros(F.lit(1784851199000000))
    new = F.when(F.col("is_censored") == 1, F.when(F.col("created_at").isNotNull(), T.floor_days("created_at", cutoff)).otherwise(F.lit(0))).otherwise(F.col("time_to_event_days"))
    return occ(spark, root).withColumn("new", new).groupBy(kind().alias("artifact")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("new").eqNullSafe(F.col("time_to_event_days"))).alias("n_changed"),
        F.count_if((F.col("is_censored") == 1) & F.col("removed_at").isNotNull()).alias("censored_with_end"),
        F.count_if((F.col("is_censored") == 0) & F.col("removed_at").isNull()).alias("observed_without_end"),
        F.count_if(F.col("removed_at") < F.col("created_at")).alias("end_before_start"), F.count_if(F.col("created_at") > cutoff).alias("after_cutoff"),
        F.count_if(F.col("new") < 0).alias("negative"),
    )


FIRST_SQL = "coalesce(nullif(author_email, ''), nullif(author_login, ''), nullif(author_name, ''))"


@query("fn_author_hash", f"SELECT {K}, sha256(lower(trim({FIRST_SQL}))) AS hash FROM occurrences")
def fn_author_hash(spark, root):
    return occ(spark, root).select(*KEY, T.author_hash("author_email", "author_login", "author_name").alias("hash"))


@query("fn_author_key", f"""SELECT {K}, coalesce('login:' || nullif(regexp_extract(lower(trim(author_email)), '^(?:\\d+\\+)?([^@]+)@users\\.noreply\\.', 1), ''), 'email:' || nullif(lower(trim(author_email)), ''),
 'login:' || nullif(lower(trim(author_login)), ''), 'name:' || nullif(lower(trim(author_name)), '')) AS key FROM occurrences""")
def fn_author_key(spark, root):
    return occ(spark, root).select(*KEY, T.author_key("author_email", "author_login", "author_name").alias("key"))


@query("fn_export_hash", f"SELECT {K}, sha256('pepper' || author_hash) AS salted FROM occurrences")
def fn_export_hash(spark, root):
    return occ(spark, root).select(*KEY, F.sha2(F.concat(F.lit("pepper"), "author_hash"), 256).alias("salted"))


@query("fn_hmac")
def fn_hmac(spark, root):
    return occ(spark, root).select(*KEY, T.keyed_hash("author_hash", b"a key for tests").alias("keyed"))


@query("fn_record_id", f"SELECT {K}, 'rec_' || substr(sha256(" + " || chr(31) || ".join(f"coalesce({c}, '')" for c in KEY) + "), 1, 24) AS record_id FROM occurrences")
def fn_record_id(spark, root):
    return occ(spark, root).select(*KEY, T.record_id(*KEY).alias("record_id"))


@query("fn_candidate_key", f"SELECT {K}, concat_ws('|', {K}) AS candidate FROM occurrences")
def fn_candidate_key(spark, root):
    return occ(spark, root).select(*KEY, F.concat_ws("|", *KEY).alias("candidate"))


@query("fn_pii_mask")
def fn_pii_mask(spark, root):
    return T.mask_secrets(occ(spark, root).select(*KEY, "body_text"), "body_text").select(*KEY, "masked")


@query("agg_pii_counts")
def agg_pii_counts(spark, root):
    """Per kind of artifact: rows, rows with a masked piece, and pieces of every label."""
    masked = T.mask_secrets(occ(spark, root).select(kind().alias("artifact"), "body_text"), "body_text")
    counts = [F.sum(T.mask_count("masked", x)).alias(x) for x in T.MASK_LABELS]
    return masked.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("masked").contains("[PII_")).alias("with_any"), *counts)


@query("fn_pii_truncate", f"SELECT {K}, CASE WHEN author_email IS NULL THEN NULL WHEN contains(author_email, '@') THEN substr(author_email, 1, 1) || '***@' || regexp_extract(author_email, '@(.*)$', 1) ELSE substr(author_email, 1, 4) || '…' END AS shown FROM occurrences")
def fn_pii_truncate(spark, root):
    """An address that can be shown as an example: first letter and domain."""
    mail = F.col("author_email")
    shown = F.when(mail.contains("@"), F.concat(F.substring(mail, 1, 1), F.lit("***@"), F.regexp_extract(mail, "@(.*)$", 1))).when(mail.isNotNull(), F.concat(F.substring(mail, 1, 4), F.lit("…")))
    return occ(spark, root).select(*KEY, shown.alias("shown"))


@query("fn_iso_parse", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS text, date_trunc('second', ts)::TIMESTAMP AS parsed FROM events")
def fn_iso_parse(spark, root):
    """Text in ISO form and back; what is no date becomes null."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return load(spark, root, "events").select("event_id", text.alias("text")).withColumn("parsed", F.try_to_timestamp("text"))


@query("fn_to_int", "SELECT event_id, CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS INTEGER) AS whole, CAST(trunc(TRY_CAST(event_type AS DOUBLE)) AS INTEGER) AS none FROM events")
def fn_to_int(spark, root):
    cut = lambda c: F.col(c).cast("string").try_cast("double").try_cast("int")
    return load(spark, root, "events").select("event_id", cut("value").alias("whole"), cut("event_type").alias("none"))


@query("fn_bool", "SELECT item_id, annotator_id, lower(trim(CAST(is_ubw AS VARCHAR))) = 'true' AS flag FROM annotations_long")
def fn_bool(spark, root):
    return load(spark, root, "annotations_long").select("item_id", "annotator_id", (F.lower(F.trim(F.col("is_ubw").cast("string"))) == "true").alias("flag"))


@query("fn_squeeze", f"SELECT {K}, substr(regexp_replace(regexp_replace(body_text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 200) AS short FROM occurrences")
def fn_squeeze(spark, root):
    return occ(spark, root).select(*KEY, T.squeeze("body_text", 200).alias("short"))


@query("fn_center_window", f"""
WITH t AS (SELECT *, instr(lower(body_text), lower(trim(matched_expression))) AS pos_, length(body_text) AS n FROM occurrences),
s AS (SELECT *, greatest(1, least(greatest(pos_, 1) - 100, n - 200 + 1)) AS lo FROM t)
SELECT {K}, CASE WHEN n <= 200 THEN body_text ELSE (CASE WHEN lo > 1 THEN '…' ELSE '' END) || substr(body_text, lo, 200) || (CASE WHEN lo + 199 < n THEN '…' ELSE '' END) END AS window FROM s""")
def fn_center_window(spark, root):
    return occ(spark, root).select(*KEY, T.center_window("body_text", "matched_expression", 200).alias("window"))


@query("src_context_window", f"""
WITH t AS (SELECT *, string_split(body_text, chr(10)) AS ls FROM {CODE}), b AS (SELECT *, greatest(1, 4 - 3) AS lo, least(len(ls), 4 + 3) AS hi FROM t)
SELECT {K}, substr(array_to_string(ls[lo:hi], chr(10)), 1, 2000) AS context FROM b""")
def src_context_window(spark, root):
    """Three lines on either side of the fourth line of each code record."""
    return code(spark, root).select(*KEY, T.context_lines("body_text", F.lit(4)).alias("context"))


@query("win_nearest_line", f"""
WITH l AS (SELECT {K}, unnest(string_split(body_text, chr(10))) AS line, generate_subscripts(string_split(body_text, chr(10)), 1) AS i FROM {CODE})
SELECT {K}, min_by(i, (abs(i - 4), i)) FILTER (WHERE contains(lower(line), lower(trim(matched_expression)))) AS line FROM l GROUP BY ALL""")
def win_nearest_line(spark, root):
    return code(spark, root).select(*KEY, T.nearest_line("body_text", "matched_expression", F.lit(4)).alias("line")).distinct()


@query("fn_context_rebuild")
def fn_context_rebuild(spark, root):
    """Three lines around the nearest line with the phrase; null without the phrase."""
    rows = code(spark, root).withColumn("at", T.nearest_line("body_text", "matched_expression", F.lit(4)))
    return rows.select(*KEY, F.when(F.col("at").isNotNull(), T.context_lines("body_text", F.col("at"))).alias("context"))


@query("fn_visible", f"SELECT {K}, contains({normal_sql('body_text')}, ' ' || trim(regexp_replace(lower(matched_expression), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ') OR contains(lower(body_text), lower(trim(matched_expression))) AS is_visible FROM occurrences")
def fn_visible(spark, root):
    wanted = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("matched_expression"), "[^a-z0-9]+", " ")), F.lit(" "))
    plain = F.lower("body_text").contains(F.lower(F.trim("matched_expression")))
    return occ(spark, root).select(*KEY, (T.lines_normal("body_text").contains(wanted) | plain).alias("is_visible"))


#: replies as judges write them: form and, for each word, the label it must give; the words are fixed values
REPLIES = [
    '{"label": "@"}', '```json\\n{"label": "@", "rationale": "it says so"}\\n```', '```\\n{"rationale": "x", "label": "@"}\\n```', '  {"label": " @ "}\\n',
    '{"label": "@"', 'The label is @.', '{"verdict": "@"}', '{"label": 1}', '```json\\n{"label": "@",}\\n```', '',
]
READABLE = 4
LABEL_WORDS = {"accept": "UBW-verdadeiro", "Accept": "UBW-verdadeiro", "reject": "não-UBW", "REJECT": "não-UBW", "unsure": "incerto", "ubw-verdadeiro": "UBW-verdadeiro", "não-UBW": "não-UBW", "perhaps": "incerto"}


@query("fn_label_json", f"""WITH k AS (SELECT event_id, CAST(event_id % {len(REPLIES)} AS INTEGER) AS form, CAST(event_id // {len(REPLIES)} % {len(LABEL_WORDS)} AS INTEGER) AS word FROM events)
SELECT event_id, CASE WHEN form < {READABLE} THEN [{', '.join("'" + v + "'" for v in LABEL_WORDS.values())}][word + 1] ELSE 'incerto' END AS label FROM k""")
def fn_label_json(spark, root):
    """The label of replies that are plain, fenced, padded, broken, empty or without a label, in English or canonical words."""
    form = F.element_at(F.array(*[F.lit(r.replace("\\n", "\n")) for r in REPLIES]), (F.col("event_id") % len(REPLIES) + 1).cast("int"))
    word = F.element_at(F.array(*map(F.lit, LABEL_WORDS)), (F.floor(F.col("event_id") / len(REPLIES)) % len(LABEL_WORDS) + 1).cast("int"))
    return load(spark, root, "events").select("event_id", T.reply_label(F.replace(form, F.lit("@"), word)).alias("label"))


@query("fn_slug", "SELECT DISTINCT matched_expression, regexp_replace(regexp_replace(lower(matched_expression), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM occurrences")
def fn_slug(spark, root):
    return occ(spark, root).select("matched_expression", T.slug("matched_expression").alias("slug")).distinct()


@query("fn_estimate_tokens", f"SELECT {K}, CAST(round_even(length(body_text) / 5.57e0 + length(matched_expression) / 4.77e0, 0) AS BIGINT) AS tokens FROM occurrences")
def fn_estimate_tokens(spark, root):
    return occ(spark, root).select(*KEY, F.bround(F.length("body_text") / F.lit(5.57) + F.length("matched_expression") / F.lit(4.77)).cast("bigint").alias("tokens"))


@query("fn_month", "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM occurrences WHERE created_at IS NOT NULL GROUP BY 1")
def fn_month(spark, root):
    return occ(spark, root).where("created_at IS NOT NULL").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_chars", f"SELECT {K}, length(body_text) AS n FROM occurrences")
def fn_chars(spark, root):
    return occ(spark, root).select(*KEY, F.length("body_text").alias("n"))
