"""File sources and sinks: CSV with line breaks in fields, tolerant JSON lines, pages, manifests, append and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Quoted fields may hold line breaks, doubled quotes and backslashes; NUL bytes are removed from texts."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[F.regexp_replace(c, "\x00", "").alias(c) if c in texts else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Texts keep their blanks at the ends and their line breaks; null and '' stay apart."""
    out = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("escapeQuotes", True).option("quoteAll", False)
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): blank lines are skipped, lines that are no JSON object are kept apart to be counted."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    ok = F.col("r._corrupt").isNull() & F.col("r").isNotNull()
    return parsed.where(ok).select("r.*").drop("_corrupt"), parsed.where(~ok).select("value")


def read_pages(spark: SparkSession, path: str, item: str, cap: int | None = None) -> DataFrame:
    """Items of paginated responses stored as JSON lines with an ``items`` array."""
    items = spark.read.schema(f"items array<struct<{item}>>").json(path).select(F.inline("items"))
    return items.limit(cap) if cap else items


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those of the same key. A null key equals no key."""
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def file_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
