"""Session factory and the one place that knows where shared intermediate files go."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def create(app: str = "lexiscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, as every query here assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; invent one only for a local master without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexiscope-checkpoint-")
    sc.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files, so a lost executor costs one re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled_once(df: DataFrame) -> DataFrame:
    """``df``, whose last shuffle is written once for all that read it."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def _shared_path(spark: SparkSession, key: str) -> str:
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lexiscope-kept/{key}"


def remembered_table(spark: SparkSession, key: str, make: Callable[[], DataFrame], anew: bool = False) -> DataFrame:
    """The table that ``make`` returns, written once per ``key`` to the shared folder and read from there.

    The key must tell all that the table depends on. A table is complete when its success mark is there. ``anew`` makes it
    in any case, for the query whose own work it is; others then read what that one left.
    """
    path = _shared_path(spark, key)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if anew or not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remembered(spark: SparkSession, key: str, make: Callable[[], bytes], anew: bool = False) -> bytes:
    """What ``make`` returns, made once per ``key`` and kept in the shared folder, so that several queries share a fitted model."""
    return bytes(remembered_table(spark, key, lambda: spark.createDataFrame([(bytearray(make()),)], "blob binary").coalesce(1), anew).first().blob)


def fingerprint(df: DataFrame) -> str:
    """A key of all rows of ``df``, by one pass over them; the order of rows does not matter."""
    from pyspark.sql import functions as F

    row = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns])
    other = F.xxhash64(row, F.lit(1))
    seen = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.bit_xor(other), F.sum(F.pmod(row, F.lit(2**31 - 1))), F.sum(F.pmod(other, F.lit(2**31 - 1)))).first()
    return hashlib.sha256(repr(tuple(seen)).encode()).hexdigest()[:32]
