"""Diff texts to line events, and line events to lifetimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
FILE = r"^diff --git a/(.+) b/(.+)$"


def parse_diffs(diffs: DataFrame, key: list[str], text: str = "diff_text") -> DataFrame:
    """(key..., path, sign, text, line_no, pos) of every added or deleted line of unified diffs.

    Path and hunk start run down the lines of one diff; a line's number is the start plus the lines of its sign before it
    in the hunk. Changed lines that start with ``++`` or ``--`` look like file headers and are skipped without advancing the
    number. A diff without a header gives nothing; null texts give nothing.
    """
    lines = diffs.select(*key, F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("pos", "line"))
    w = Window.partitionBy(*key).orderBy("pos")
    header = F.nullif(F.regexp_extract("line", FILE, 2), F.lit(""))
    is_hunk = F.col("line").rlike(HUNK)
    seen = (
        lines.withColumn("path", F.last(header, True).over(w))
        .withColumn("hunk", F.sum(is_hunk.cast("int")).over(w))
        .withColumn("old", F.last(F.when(is_hunk, F.regexp_extract("line", HUNK, 1).try_cast("int")), True).over(w))
        .withColumn("new", F.last(F.when(is_hunk, F.regexp_extract("line", HUNK, 2).try_cast("int")), True).over(w))
    )
    marked = seen.where(F.col("path").isNotNull() & ~F.col("line").startswith("+++") & ~F.col("line").startswith("---"))
    changed = marked.withColumn("sign", F.substring("line", 1, 1)).where(F.col("sign").isin("+", "-"))
    in_hunk = Window.partitionBy(*key, "path", "hunk", "sign").orderBy("pos")
    start = F.coalesce(F.when(F.col("sign") == "+", F.col("new")).otherwise(F.col("old")), F.lit(0))
    return changed.select(*key, "path", "sign", F.expr("substring(line, 2)").alias("text"), (start + F.row_number().over(in_hunk) - 1).alias("line_no"), "pos")


def pair_events(events: DataFrame, key: list[str], at: str, seq: str, sign: str = "sign") -> DataFrame:
    """Lifetimes: the first ``+`` opens, the next ``-`` closes; repeated signs and a leading ``-`` count for nothing.

    ``events`` has the key columns, a time, an input order and a sign. Result: key..., created_at, removed_at (null: still
    open), is_censored. Groups are as fine as (repository, path, phrase), so no group grows with the corpus.
    """
    w = Window.partitionBy(*key).orderBy(at, seq)
    before = F.lag(sign).over(w)
    turns = events.withColumn("_l", before).where((F.col("_l").isNull() & (F.col(sign) == "+")) | (F.col(sign) != F.col("_l")))
    closed = turns.withColumn("removed_at", F.lead(at).over(w)).where(F.col(sign) == "+")
    return closed.select(*key, F.col(at).alias("created_at"), "removed_at", F.col("removed_at").isNull().cast("int").alias("is_censored"))
