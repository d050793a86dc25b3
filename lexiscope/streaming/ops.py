"""Incremental runs on Structured Streaming: windowed counts, compaction, resumption, dead letters, stateful pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.session import ensure_checkpoint_dir

PAIRED = "user_id bigint, created_at timestamp, removed_at timestamp, is_censored int"


def read_files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling_counts(stream: DataFrame, at: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per window and key; rows later than the watermark are dropped, as the state must end."""
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(stream: DataFrame, at: str, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Rows per session of a key."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def pair_stateful(stream: DataFrame, key: str, at: str, seq: str, late: str = "40 days") -> DataFrame:
    """Lifetimes from a stream of signed events, state per key: the open event's time.

    Events of one trigger are ordered by time and input order; an event older than the state's last one is ignored, which
    is this library's policy for late events. Closed intervals are emitted at once; open ones when their key times out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            opened, last = state.get
            state.remove()
            if opened is not None:
                yield pd.DataFrame({"user_id": [k[0]], "created_at": [pd.Timestamp(opened, unit="us")], "removed_at": [pd.NaT], "is_censored": [1]})
            return
        opened, last = state.get if state.exists else (None, -1)
        frame = pd.concat(list(batches)).sort_values([at, seq], kind="stable")
        out = []
        for t, sign in zip(frame[at], frame["sign"]):
            us = int(pd.Timestamp(t).value // 1000)
            if us < last:
                continue
            last = us
            if sign == "+" and opened is None:
                opened = us
            elif sign == "-" and opened is not None:
                out.append((k[0], pd.Timestamp(opened, unit="us"), pd.Timestamp(us, unit="us"), 0))
                opened = None
        state.update((opened, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["user_id", "created_at", "removed_at", "is_censored"])

    marked = stream.withWatermark(at, late)
    return marked.groupBy(key).applyInPandasWithState(step, PAIRED, "opened bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; rows go to Parquet files once each."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(out).awaitTermination()


def skip_done(batch: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch whose key is not among those already written."""
    return batch.join(done.select(*key).distinct(), key, "left_anti")


def run_compacting(stream: DataFrame, key: list[str], order: list[str], target: str, checkpoint: str) -> int | None:
    """Keep the last row per key of a log: every batch is merged with the table so far and written as a new version.

    ``target`` holds folders v=0, v=1, ...; the number of the last one is returned, None if there was nothing to read.
    A repeated batch writes its own version again from the one before; versions older than that are removed.
    """
    versions: list[int] = []

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch
        if number:
            both = spark.read.parquet(f"{target}/v={number - 1}").unionByName(batch)
        rest = [c for c in both.columns if c not in key]
        last = both.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r"))
        last.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).write.mode("overwrite").parquet(f"{target}/v={number}")
        versions.append(number)
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    ensure_checkpoint_dir(stream.sparkSession)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return max(versions, default=None)


def dead_letters(attempts: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """Keys that failed ``most`` times and are not tried again."""
    return attempts.groupBy(*key).agg(F.count(F.lit(1)).alias("attempts")).where(F.col("attempts") >= most)
