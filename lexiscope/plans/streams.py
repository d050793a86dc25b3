"""Streaming twins of batch queries: the events are read as a stream of files, run to the end, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiscope.plans.registry import query
from lexiscope.session import ensure_checkpoint_dir
from lexiscope.streaming import ops

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _source(spark, root):
    return ops.read_files(spark, f"{root}/events.parquet*", spark.read.parquet(f"{root}/events.parquet").schema.simpleString()[7:-1].replace(":", " ")).withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _complete(spark, df, mode="complete"):
    """Rows of the last state of an aggregation; the state is one row per window and key."""
    at = _place(spark)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out")

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_tumbling_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, root):
    return _complete(spark, ops.tumbling_counts(_source(spark, root), "ts", "event_type"))


@query("stream_session_counts", """WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, true) AS is_new FROM events),
s AS (SELECT *, sum(is_new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM l) SELECT min(ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM s GROUP BY user_id, no""")
def stream_session_counts(spark, root):
    return _complete(spark, ops.session_counts(_source(spark, root), "ts", "user_id"))


@query("stream_keep_last", "SELECT user_id, event_type, max(ts)::TIMESTAMP AS ts, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def stream_keep_last(spark, root):
    at = _place(spark)
    last = ops.run_compacting(_source(spark, root).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"], f"{at}/table", f"{at}/check")
    return spark.read.parquet(f"{at}/table/v={last}")


@query("stream_pair_events", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN '+' ELSE '-' END AS sign FROM events),
l AS (SELECT *, lag(sign) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM g), t AS (SELECT * FROM l WHERE (l IS NULL AND sign = '+') OR sign <> l),
p AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS removed_at FROM t)
SELECT user_id, ts::TIMESTAMP AS created_at, removed_at::TIMESTAMP AS removed_at FROM p WHERE sign = '+' AND removed_at IS NOT NULL""")
def stream_pair_events(spark, root):
    """Closed lifetimes from the stateful operator; equal to those of the batch query."""
    at = _place(spark)
    sign = F.when(F.col("event_type").isin("click", "view", "signup"), "+").otherwise("-")
    paired = ops.pair_stateful(_source(spark, root).select("user_id", "ts", "event_id", sign.alias("sign")), "user_id", "ts", "event_id")
    ops.run_to_end(paired, f"{at}/out", f"{at}/check")
    return spark.read.schema(ops.PAIRED).parquet(f"{at}/out").where("is_censored = 0").select("user_id", "created_at", "removed_at")
