"""Column functions on texts, paths, names, hashes and dates; all built in, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiscope.functions import lexicon as L

MICROS_PER_DAY = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(x: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(col(x), F.lit(" \t\n\x0b\f\r"))


def lines_normal(text: Column | str) -> Column:
    """The text for phrase matching: each line lower-cased, runs of other signs as one space, lines kept apart."""
    n = F.regexp_replace(F.lower(col(text)), r"[\r\n]+", "\n")
    n = F.regexp_replace(n, r"[^a-z0-9\n]+", " ")
    n = F.regexp_replace(n, r" ?\n ?", " \n ")
    return F.concat(F.lit(" "), F.trim(n), F.lit(" "))


def has_phrase(text: Column | str, phrase: str) -> Column:
    """Whole-token phrase within one line."""
    return lines_normal(text).contains(f" {L.needle(phrase)} ")


def phrase_matches(normal: Column | str, entries=None) -> Column:
    """Array of (expression, category) of the lexicon that a normalised text holds; no join against the lexicon."""
    rows = [F.struct(F.lit(p).alias("expression"), F.lit(c).alias("category"), F.lit(f" {n} ").alias("needle")) for p, c, n, _ in (entries or L.ENTRIES)]
    hit = F.filter(F.array(*rows), lambda e: col(normal).contains(e["needle"]))
    return F.transform(hit, lambda e: F.struct(e["expression"].alias("expression"), e["category"].alias("category")))


def category_of(phrase: Column | str) -> Column:
    pairs = [x for p, c in L.CATEGORY.items() for x in (F.lit(p), F.lit(c))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(col(phrase))))


def path_only(text: Column | str, phrase: str) -> Column:
    """Every occurrence of the phrase lies in a blank-separated token that is a path or a file name."""
    tokens = F.filter(F.split(col(text), r"(?U)\s+"), lambda t: F.lower(t).contains(phrase.lower()))
    is_path = lambda t: t.contains("/") | t.contains("\\") | t.rlike(r"\.\w{1,4}(:\d+){0,2}[):,;.\"']*$")
    return (F.size(tokens) > 0) & F.forall(tokens, is_path)


def path_near(window: Column | str, phrase: str) -> Column:
    """The first occurrence touches a slash, or the window holds a mark of a stack trace."""
    low, p = F.lower(col(window)), phrase.lower()
    at = F.instr(low, p)
    before, after = F.substring(low, at - 1, F.lit(1)), F.substring(low, at + len(p), F.lit(1))
    #: fixed values: marks of paths and stack traces
    marks = ['file "', '.py"', '.js"', "line ", "/src/", "/lib/", "/tools/"]
    marked = F.exists(F.array(*map(F.lit, marks)), lambda m: low.contains(m))
    return (at > 0) & (((at > 1) & before.isin("/", "\\")) | after.isin("/", "\\") | marked)


def extension(path: Column | str) -> Column:
    """The last suffix with its dot, or ''."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def is_comment(line: Column | str, ext: Column | str) -> Column:
    """A line mark after an even number of quotes, or a block opener anywhere; first occurrence of each mark."""
    s = F.regexp_replace(col(line), r"^\s+", "")
    even = lambda pre, q: F.length(pre) - F.length(F.replace(pre, F.lit(q), F.lit("")))
    out = F.lit(False)
    for mark, exts in L.LINE_COMMENTS.items():
        at = F.instr(s, mark)
        pre = F.substring(s, F.lit(1), at - 1)
        out = out | (col(ext).isin(exts) & (at > 0) & (even(pre, '"') % 2 == 0) & (even(pre, "'") % 2 == 0))
    for mark, exts in L.BLOCK_COMMENTS.items():
        out = out | (col(ext).isin(exts) & s.contains(mark))
    return out


def is_vendored(path: Column | str) -> Column:
    p = col(path)
    rooted = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    name = F.lower(F.element_at(F.split(p, "/"), -1))
    return F.exists(F.array(*map(F.lit, L.VENDORED_MARKERS)), lambda m: rooted.contains(m)) | name.isin(L.VENDORED_FILES) | name.rlike(r"\.min\.(js|css)$") | p.rlike(L.VERSION_FOLDER)


def is_known_library(path: Column | str) -> Column:
    return F.lower(col(path)).rlike("(^|/)(" + "|".join(L.KNOWN_LIBRARIES) + r")(/|-|_|\.|$)")


def is_bundle(path: Column | str) -> Column:
    return F.lower(col(path)).rlike(r"\.min\.(js|css)$|[-_][0-9a-f]{8,}\.js$")


def is_bot(name: Column | str, suffixes: bool = True) -> Column:
    low = F.lower(col(name))
    out = low.contains("[bot]") | low.isin(L.BOT_LOGINS)
    if suffixes:
        out = out | low.endswith("-bot") | low.endswith("-robot")
    return F.coalesce(out, F.lit(False))


def slots(window: Column | str) -> Column:
    """Words before 'but' and before 'works', and what follows 'but'; null where there is none."""
    words = r"(?i)([\w'-]+(?:\s+[\w'-]+){0,2})\s+"
    get = lambda rx: F.nullif(F.lower(F.trim(F.regexp_extract(col(window), rx, 1))), F.lit(""))
    return F.struct(get(words + r"but\b").alias("pre_but"), get(words + r"works?\b").alias("pre_works"), get(r"(?i)\bbut\b\s+(.{1,40})").alias("post_but"))


def floor_days(start: Column | str, end: Column | str) -> Column:
    """Whole elapsed days, at least 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(MICROS_PER_DAY)))


def author_hash(email: Column | str, login: Column | str, name: Column | str) -> Column:
    first = F.coalesce(*[F.nullif(col(c), F.lit("")) for c in (email, login, name)])
    return F.sha2(F.lower(F.trim(first)), 256)


def author_key(email: Column | str, login: Column | str, name: Column | str) -> Column:
    """One prefixed identity: the login in a no-reply address, else e-mail, login, name."""
    mail = F.lower(F.trim(col(email)))
    alias = F.nullif(F.regexp_extract(mail, r"^(?:\d+\+)?([^@]+)@users\.noreply\.", 1), F.lit(""))
    full = lambda c: F.nullif(F.lower(F.trim(col(c))), F.lit(""))
    prefix = lambda p, c: F.when(c.isNotNull(), F.concat(F.lit(p), c))
    return F.coalesce(prefix("login:", alias), prefix("email:", F.nullif(mail, F.lit(""))), prefix("login:", full(login)), prefix("name:", full(name)))


def keyed_hash(value: Column | str, key: bytes) -> Column:
    """HMAC-SHA256 of a text from built-in functions; the two key pads are constants."""
    import hashlib

    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), col(value).cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def record_id(*parts: Column | str, prefix: str = "rec_") -> Column:
    """Prefix and 24 hexadecimal digits of the hash of the parts, null as ''."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def squeeze(text: Column | str, n: int) -> Column:
    return F.substring(strip(F.regexp_replace(col(text), r"(?U)\s+", " ")), 1, n)


def center_window(text: Column | str, phrase: Column | str, limit: int) -> Column:
    """``limit`` characters around the phrase, with … where text was left out; the start where there is no phrase."""
    at = F.instr(F.lower(col(text)), F.lower(F.trim(col(phrase))))
    start = F.greatest(F.lit(1), F.least(F.greatest(at, F.lit(1)) - F.lit(limit // 2), F.length(col(text)) - F.lit(limit) + 1))
    cut = F.substring(col(text), start, F.lit(limit))
    out = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + limit - 1 < F.length(col(text)), "…").otherwise(""))
    return F.when(F.length(col(text)) <= limit, col(text)).otherwise(out)


def context_lines(text: Column | str, line: Column | str, around: int = 3, limit: int = 2000) -> Column:
    """``around`` lines on either side of a line, at most ``limit`` characters."""
    ls = F.split(col(text), "\n")
    lo = F.greatest(F.lit(1), col(line) - around)
    hi = F.least(F.size(ls), col(line) + around)
    return F.substring(F.array_join(F.slice(ls, lo, F.greatest(hi - lo + 1, F.lit(0))), "\n"), 1, limit)


def nearest_line(text: Column | str, phrase: Column | str, expected: Column | str) -> Column:
    """Number of the line with the phrase that is nearest to the expected one; null without the phrase."""
    rows = F.transform(F.split(col(text), "\n"), lambda l, i: F.struct(F.abs(i + 1 - col(expected)).alias("d"), (i + 1).alias("line"), l.alias("text")))
    hit = F.filter(rows, lambda r: F.lower(r["text"]).contains(F.lower(F.trim(col(phrase)))))
    return F.try_element_at(F.array_sort(F.transform(hit, lambda r: F.struct(r["d"], r["line"]))), F.lit(1))["line"]


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


#: fixed values: kinds of secret and identity, their patterns and a text that must be there before a pattern is tried
MASKS = [
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", ["-----BEGIN"]),
    ("url_credential", r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s'\"<>]+:[^\s'\"<>@]+@[^\s'\"<>/]+", ["://"]),
    ("coauthor_trailer", r"(?im)^\s*Co-authored-by:\s*.+$", ["o-authored-by:", "O-AUTHORED-BY:", "o-Authored-By:"]),
    ("signedoff_trailer", r"(?im)^\s*Signed-off-by:\s*.+$", ["igned-off-by:", "IGNED-OFF-BY:", "igned-Off-By:"]),
    ("token_github_pat_classic", r"\bgh[pousr]_[A-Za-z0-9]{20,255}\b", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]),
    ("token_github_pat_fine_grained", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", ["github_pat_"]),
    ("token_aws_access_key_id", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", ["AKIA", "ASIA"]),
    ("token_google_api_key", r"\bAIza[0-9A-Za-z_\-]{35}\b", ["AIza"]),
    ("token_slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,72}\b", ["xox"]),
    ("token_stripe_key", r"\bsk_(?:live|test)_[A-Za-z0-9]{10,99}\b", ["sk_live_", "sk_test_"]),
    ("token_npm_token", r"\bnpm_[A-Za-z0-9]{36}\b", ["npm_"]),
    ("token_jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b", ["eyJ"]),
    ("token_generic_bearer", r"\bBearer\s+[A-Za-z0-9\-_.=]{12,}\b", ["Bearer"]),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ["@"]),
]
MENTION = r"(?<![\w@./])@(?!(?i:" + "|".join(L.ANNOTATIONS) + r")(?![A-Za-z0-9]|-+\w))[A-Za-z0-9][A-Za-z0-9-]{0,38}\b"


def mask_secrets(df, column: str, out: str = "masked"):
    """``df`` with ``out``: the texts of ``column`` after staged masking.

    Each pattern runs only on texts that hold its sign. Stages are projections one after another: nested in one
    expression, a stage that reads its input three times would triple the plan with every step.
    """
    df = df.withColumn(out, F.col(column))
    for label, pattern, signs in [*MASKS, ("mention", MENTION, ["@"])]:
        sign = F.lit(False)
        for s in signs:
            sign = sign | F.col(out).contains(s)
        df = df.withColumn(out, F.when(sign, F.regexp_replace(out, pattern, f"[PII_{label.upper()}_REDACTED]")).otherwise(F.col(out)))
    return df


MASK_LABELS = [label for label, *_ in MASKS] + ["mention"]


def mask_count(masked: Column | str, label: str) -> Column:
    return F.regexp_count(col(masked), F.lit(rf"\[PII_{label.upper()}_REDACTED\]"))


#: fixed values: the labels a judge may give, by the word used
REPLY_LABELS = {"accept": "UBW-verdadeiro", "ubw-verdadeiro": "UBW-verdadeiro", "reject": "não-UBW", "não-ubw": "não-UBW", "unsure": "incerto", "incerto": "incerto"}


def reply_label(raw) -> Column:
    """The label in a judge's reply: JSON with a text ``label``, which may be fenced; all else is 'incerto', as is null."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    # a variant keeps the type of the label, which must be text
    label = F.try_variant_get(F.try_parse_json(bare), "$.label", "string")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(bare), "$.label", "variant")) == "STRING"
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in REPLY_LABELS.items() for x in kv]), F.lower(F.trim(label)))
    return F.coalesce(F.when(is_text, mapped), F.lit("incerto"))
