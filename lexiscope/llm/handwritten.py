"""Problem 1: generated, minified, vendored and data files among code records.

A file is (repository, path); artifact_id is ``path:line``. A file is not hand-written when any of its records shows

* ``copy``: at least ``COPY_SHARE`` of the record's winnowing fingerprints occur in ``MIN_REPOSITORIES`` or more unrelated
  repositories. Related are repositories of the same name (forks, renames), and those that hold the same path (a moved or
  forked tree); a vendored copy is put into each tree's own place.
* ``vendored`` / ``generated`` / ``minified``: its path is one that tools and package managers write to, or
* ``generated`` / ``minified`` / ``data``: its text is marked by a generator, has the shape of minified code, or is a table.

The three kinds of evidence find different files. Winnowing finds code that recurs, whatever its place and marks; it cannot
find what stands once, and a generated, minified or data file usually does, as does a window of a vendored file that no other
repository here holds. For those the shape of the text, the generator's own mark and the folder are all there is to go by.
``evidence`` tells them apart, ``evidence_report`` counts them, and ``kinds`` leaves any of them out.

Fingerprints: words of the code without comment lines, indentation and punctuation, shingles of five words, the minimum
hash of each window of four. Shingles that recur everywhere (loop headers) are evidence only together: the share decides.

Defined cases: null or empty texts have no fingerprints and no content evidence; an artifact_id without a line is all path;
a null artifact_id or repository is never a found file. Repeated records count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.session import cut_lineage

SHINGLE = 5
WINNOW = 4
COPY_SHARE = 0.8
MIN_REPOSITORIES = 3
WORD = re.compile(r"[^\W_]\w*")
COMMENT_LINE = re.compile(r"(?m)^[ \t]*(//|#|/\*|\*|--).*$")

#: fixed values: folders that package managers and build tools fill
VENDOR_FOLDERS = [
    "vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd-party", "3rd_party", "node_modules", "bower_components",
    "jspm_packages", "pods", "carthage", "site-packages", "dist-packages", "godeps", "_vendor", "_deps", "deps", "external", "externals", "extern", "bundled",
]
GENERATED_FOLDERS = ["generated", "generated-sources", "generated-src", "autogenerated", "__generated__", "gen"]
#: fixed values: names that generators and bundlers give to files
GENERATED_FILE = (
    r"(\.pb\.(go|cc|h|rs|dart|swift)|_pb2(_grpc)?\.pyi?|_pb\.(js|ts|rb)|\.g(en|enerated)?\.(go|cs|ts|js|dart|py|java|rs|h|c|cc|cpp)|_(gen|generated)\.(go|h|c|cc|cpp|py|ts|js|rs|java)"
    r"|\.designer\.(cs|vb)|\.g\.i\.cs|\.tab\.(c|h|cc|cpp|hpp)|\.yy\.(c|cc|cpp))$|(^|/)(zz_generated\.|lex\.[^/]*\.c$|moc_|qrc_|ui_[^/]*\.h$|mock_[^/]*\.gen\.)"
)
MINIFIED_FILE = r"([.-]min\.(js|css|mjs)|\.bundle\.(js|mjs)|\.umd\.(js|mjs)|\.chunk\.(js|mjs|css)|[.-][0-9a-f]{6,}\.(js|mjs|css)|(^|/)[0-9a-f]{16,}\.(js|mjs|css))$"
DIST_FILE = r"(^|/)dist/[^/]+\.(js|mjs|css)$"
VERSIONED_FOLDER = r"(^|/)[a-z][a-z0-9_]*-[0-9]+\.[0-9]+(\.[0-9]+)*/"
#: fixed values: what generators write about their output, at the start of a line of comment
GENERATED_MARK = (
    r"(?im)^[ \t]*(//|#|/\*+|\*|--|;|<!--)[ \t]*(code generated by .*do not edit|auto-?generated (file|by|from|code)|this (file|code) (is|was) (auto-?|automatically |machine[- ])?(generated|produced|created|written|emitted)"
    r"|<auto-?generated>|@generated\b|generated (from|by) .*(edits are overwritten|do not (edit|modify)|at build time)|automatically generated|output of .*(regenerate|do not edit|not by hand)|.*(manual|hand) (changes|edits) (will|are|get) (be )?(lost|overwritten))"
)


def path_of(artifact_id: Column) -> Column:
    return F.regexp_replace(artifact_id, r":[0-9]+$", "")


def path_evidence(path: Column) -> Column:
    """vendored, generated, minified or null, by path alone."""
    low = F.lower(path)
    folders = F.slice(F.split(low, "/"), 1, F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0)))
    within = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    return (
        F.when(within(VENDOR_FOLDERS) | low.rlike(VERSIONED_FOLDER), "vendored")
        .when(within(GENERATED_FOLDERS) | low.rlike(GENERATED_FILE), "generated")
        .when(low.rlike(MINIFIED_FILE) | low.rlike(DIST_FILE), "minified")
    )


def text_evidence(text: Column) -> Column:
    """generated, minified, data or null, by the record's text.

    Minified: a line of 200 or more characters whose share of blanks is under 7 % and that has many brackets; a long
    line of prose in a string has a blank every few letters. Data: of the text without comment lines, at least 70 % are
    number literals with their commas, or quoted runs of 60 or more characters without a blank.
    """
    long_lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda l: F.length(l) >= 200)
    blanks = lambda l: F.length(l) - F.length(F.translate(l, " \t", ""))
    brackets = lambda l: F.length(l) - F.length(F.translate(l, "(){}[];,", ""))
    minified = F.exists(long_lines, lambda l: (blanks(l) < 0.07 * F.length(l)) & (brackets(l) > 0.1 * F.length(l)))
    code = F.regexp_replace(text, r"(?m)^[ \t]*(//|#|/\*|\*|--).*$", "")
    rest = F.regexp_replace(code, r"(0[xX][0-9a-fA-F]+|[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?),|[\"'][^\"'\s]{60,}[\"'],?", "")
    solid = lambda c: F.length(F.translate(c, " \t\r\n", ""))
    data = (solid(code) >= 80) & (solid(rest) <= 0.3 * solid(code))
    return F.when(text.rlike(GENERATED_MARK), "generated").when(minified, "minified").when(data, "data")


def winnow(text: str | None) -> list[int]:
    """Distinct fingerprints of the code in one text, without its comment lines, which differ between copies."""
    words = WORD.findall(COMMENT_LINE.sub("", text)) if text else []
    if len(words) < SHINGLE:
        return []
    import xxhash

    codes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    keys = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            keys = (keys ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(31)
    if n > WINNOW:
        keys = np.lib.stride_tricks.sliding_window_view(keys, WINNOW).min(axis=1)
    return np.unique(keys).view(np.int64).tolist()


def _winnow_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([winnow(t) for t in texts], dtype=object)


def code_records(occurrences: DataFrame) -> DataFrame:
    """Distinct code records with repo, path and text; artifact_type is trimmed and compared in lower case."""
    kept = occurrences.where((F.lower(F.trim("artifact_type")) == "code_comment") & F.col("repo_full_name").isNotNull() & F.col("artifact_id").isNotNull())
    return kept.select("repo_full_name", "artifact_id", "body_text").withColumn("path", path_of(F.col("artifact_id")))


def copied_files(records: DataFrame) -> DataFrame:
    """(repo_full_name, path) of files with a record whose fingerprints largely recur in unrelated repositories.

    Fingerprints belong to texts: a text that a third of all records share is one row here. They are counted over distinct
    (fingerprint, repository name) and (fingerprint, path) pairs, both combined map-side, so a fingerprint of many records
    arrives as one row per task and name. A text's share of recurring fingerprints is summed map-side too, over a join whose
    right side has one row per fingerprint; texts that are copies go back to their records by a join on the text, again with
    one row per key on the right.
    """
    # the counts, the texts and the records all need the fingerprints: they are made once and written, without the texts
    prints = cut_lineage(records.select(
        "repo_full_name", "path", F.xxhash64("body_text").alias("text_id"),
        F.pandas_udf(_winnow_all, "array<bigint>")(F.col("body_text")).alias("prints"),
    ).where(F.size("prints") > 0))
    name = F.lower(F.regexp_replace(F.regexp_replace(F.trim("repo_full_name"), r"%2[Ff]", "/"), r"(/tree/[^/]*)?(\.git)?/*\s*$", ""))
    flat = prints.select("path", F.explode("prints").alias("print"), F.regexp_extract(name, r"([^/\s]+)$", 1).alias("name"))
    by_name = flat.select("print", "name").distinct().groupBy("print").agg(F.count(F.lit(1)).alias("names"))
    by_path = flat.select("print", "path").distinct().groupBy("print").agg(F.count(F.lit(1)).alias("paths"))
    recurring = by_name.where(F.col("names") >= MIN_REPOSITORIES).join(by_path.where(F.col("paths") >= MIN_REPOSITORIES), "print").select("print")
    texts = prints.select("text_id", F.size("prints").alias("n"), F.explode("prints").alias("print")).distinct()
    hits = texts.join(recurring, "print").groupBy("text_id").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"))
    copies = hits.where(F.col("hits") >= COPY_SHARE * F.col("n")).select("text_id")
    return prints.select("repo_full_name", "path", "text_id").join(copies, "text_id", "left_semi").select("repo_full_name", "path").distinct()


#: kinds of evidence, from the strongest; a file's reason is the first that holds
EVIDENCE = ["copy", "text", "path"]


def evidence(occurrences: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(repo_full_name, path, copy, text, path_class) of every file with some evidence of ``kinds`` (all by default).

    ``copy``: whether its fingerprints recur; ``text`` and ``path_class``: generated, minified, data, vendored or null. The
    path lists are a prior that can be left out: ``kinds=["copy", "text"]``.
    """
    kinds = EVIDENCE if kinds is None else kinds
    records = code_records(occurrences)
    none = F.lit(None).cast("string")
    by_path, by_text = path_evidence(F.col("path")) if "path" in kinds else none, text_evidence(F.col("body_text")) if "text" in kinds else none
    out = records.select("repo_full_name", "path", F.lit(False).alias("copy"), by_text.alias("text"), by_path.alias("path_class")).where(F.col("text").isNotNull() | F.col("path_class").isNotNull())
    if "copy" in kinds:
        out = out.unionByName(copied_files(records).select("repo_full_name", "path", F.lit(True).alias("copy"), none.alias("text"), none.alias("path_class")))
    return out.groupBy("repo_full_name", "path").agg(F.max("copy").alias("copy"), F.min("text").alias("text"), F.min("path_class").alias("path_class"))


def classify(occurrences: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(repo_full_name, path, reason) of every file that is not hand-written; reason is the first kind of evidence that holds."""
    reason = F.when(F.col("copy"), "copy").otherwise(F.coalesce("text", "path_class"))
    return evidence(occurrences, kinds).select("repo_full_name", "path", reason.alias("reason"))


def evidence_report(occurrences: DataFrame) -> DataFrame:
    """(path_class, text, copy, files): how many files each combination of evidence found."""
    return evidence(occurrences).groupBy("path_class", "text", "copy").agg(F.count(F.lit(1)).alias("files"))


def found_records(occurrences: DataFrame) -> DataFrame:
    """(repo_full_name, artifact_id) of the code records that lie in such files."""
    records = code_records(occurrences).select("repo_full_name", "path", "artifact_id")
    return records.join(classify(occurrences), ["repo_full_name", "path"], "left_semi").select("repo_full_name", "artifact_id").distinct()


def hand_written(occurrences: DataFrame) -> DataFrame:
    """The table without the records in such files; all columns, records of other types untouched."""
    is_code = F.coalesce((F.lower(F.trim("artifact_type")) == "code_comment") & F.col("artifact_id").isNotNull(), F.lit(False))
    files = classify(occurrences).select(F.col("repo_full_name").alias("_repo"), F.col("path").alias("_file"))
    match = (F.col("repo_full_name") == F.col("_repo")) & (path_of(F.col("artifact_id")) == F.col("_file"))
    # other records do not go through the join: without a path, those of a large repository would meet in one task
    return occurrences.where(is_code).join(files, match, "left_anti").union(occurrences.where(~is_code))
