"""Structured Streaming forms of the flow.

S1 runs the batch flow on each micro-batch of a file source and writes the three
branches from one persisted parent; each batch writes to its own ``batch_id`` folder
with overwrite, so a retried batch replaces its output instead of duplicating it. S2 is
a watermarked tumbling-window count in two stages. S3 is in ``alerts``.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import message_id
from ..operators.validate import error_envelope, split_valid, with_validation
from ..plans.process import RESPONSE_COLUMNS, draft_replies, with_decision
from ..sources.inbound import parse_payload
from .runs import dropped_rows, run_to_end

#: A delivery: the channel's own id of it (null: none) and the body as it came.
DELIVERY_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def _process_batch(out_dir: str, drafter_factory=None, props: DataFrame | None = None):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        checked = with_validation(batch)
        ok = F.col("is_valid") & F.col("first_name").isNotNull()
        # counted as the rows are first made; the branches read them from the cache
        checked = checked.observe(seen, F.count(F.lit(1)).alias("deliveries"), F.count_if(ok).alias("responses"),
                                  F.count_if(~F.col("is_valid")).alias("rejects"),
                                  F.count_if(F.col("is_valid") & F.col("first_name").isNull()).alias("errors"),
                                  F.count_if(F.col("_body") != "JSON").alias("unusable_bodies"),
                                  F.max("sent_at").alias("last_sent_at")).persist()
        try:
            good, bad, failed = split_valid(checked)
            replies = draft_replies(with_decision(good), props, drafter_factory)
            replies.select(*RESPONSE_COLUMNS).write.mode("overwrite").parquet(
                f"{out_dir}/responses/batch_id={batch_id}")
            bad.select("message_id", "raw", error_envelope("errors").alias("envelope")).write.mode(
                "overwrite").parquet(f"{out_dir}/rejects/batch_id={batch_id}")
            failed.select("message_id", F.lit("blank_guest_name").alias("processing_error")).write.mode(
                "overwrite").parquet(f"{out_dir}/errors/batch_id={batch_id}")
            counts = {k: v if v is None or isinstance(v, int) else str(v) for k, v in seen.get.items()}
            spark.createDataFrame([(json.dumps(counts),)], "value string").coalesce(1).write.mode("overwrite").text(
                f"{out_dir}/counts/batch_id={batch_id}")
        finally:
            checked.unpersist()
    return run


def stream_process(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                   drafter_factory=None, props: DataFrame | None = None, batch_bytes: int = 64 << 30):
    """Delivery files (JSON lines of DELIVERY_SCHEMA) → message flow → responses /
    rejects / errors parquet under ``out_dir``; runs until the input present now is
    processed (``availableNow``) and returns the finished query. A micro-batch
    takes files of about ``batch_bytes``, however much is waiting.

    The message id is the channel's delivery key; without one it is the hash of the
    body and its file. The body is parsed once and nothing in it can set the id. ``out_dir/counts`` has per batch what was observed while its
    rows were made (``batch_counts`` reads them)."""
    raw = spark.readStream.schema(DELIVERY_SCHEMA).option("maxBytesPerTrigger", batch_bytes).json(in_dir)
    delivery_id = F.coalesce("key", message_id("value", F.col("_metadata.file_path")))
    parsed = parse_payload(raw.select(delivery_id.alias("message_id"), F.col("value").alias("raw")), check_types=True)
    q = (parsed.writeStream.foreachBatch(_process_batch(out_dir, drafter_factory, props))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def batch_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """(batch_id, deliveries, responses, rejects, errors, unusable_bodies, last_sent_at)."""
    schema = "deliveries bigint, responses bigint, rejects bigint, errors bigint, unusable_bodies bigint, last_sent_at timestamp_ntz"
    return spark.read.schema(schema).json(f"{out_dir}/counts")


def write_deliveries(df: DataFrame, path: str) -> None:
    """Write (key, value) rows as delivery files (a replayable source)."""
    df.select("key", "value").write.mode("append").json(path)


def rate_counts_stream(events: DataFrame, window: str = "1 minute", limit: int = 30,
                       watermark: str = "10 minutes", ts_col: str = "sent_at", salts: int = 8) -> DataFrame:
    """Messages per property, channel and tumbling window on a stream, flagged
    above ``limit``.

    Two stateful stages: counts per (window, property, channel, salt), then their sums
    per window, so the state of a property that gets a third of all messages lies in
    ``salts`` partitions and the second stage sees one row per salt. A window comes out
    once, when the watermark has passed it; later rows for it are dropped and counted
    by the first stage (``dropped_rows`` of the query: rows after its map-side count)."""
    salt = F.pmod(F.xxhash64(*[c for c in events.columns]), F.lit(salts))
    first = (events.withWatermark(ts_col, watermark).withColumn("_salt", salt)
             .groupBy("property_id", "channel", "_salt", F.window(ts_col, window).alias("w")).agg(F.count(F.lit(1)).alias("n")))
    return (first.groupBy("property_id", "channel", F.window(F.window_time("w"), window).alias("w"))
            .agg(F.sum("n").alias("n_messages"))
            .select("property_id", "channel", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n_messages",
                    (F.col("n_messages") > limit).alias("over_limit")))


RATE_SCHEMA = T.StructType([T.StructField("property_id", T.StringType()), T.StructField("channel", T.StringType()),
                            T.StructField("sent_at", T.TimestampType()), T.StructField("message_id", T.StringType())])


def run_rate_counts(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, state_partitions: int | None = None, **kw) -> int:
    """Count every message file the checkpoint has not seen and stop; open windows stay
    in state for the next run. Returns how many counts came too late."""
    events = spark.readStream.schema(RATE_SCHEMA).json(in_dir)
    return dropped_rows(run_to_end(rate_counts_stream(events, **kw), out_dir, checkpoint, state_partitions))


def replay_rate_counts(msgs: DataFrame, base: str, window: str, limit: int, **kw) -> int:
    """S2 over a message table (property_id, channel, sent_at, message_id) replayed as a
    stream: one run takes in all rows, a second one a row far ahead that closes every
    window (its own is left open). Windows land in ``{base}/out``."""
    spark = msgs.sparkSession
    msgs.select("property_id", "channel", F.col("sent_at").cast("timestamp").alias("sent_at"), "message_id").write.json(f"{base}/in")
    late = run_rate_counts(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", window=window, limit=limit, **kw)
    ahead = spark.range(1).select(F.lit(None).cast("string").alias("property_id"), F.lit("clock").alias("channel"),
                                  F.lit("2999-01-01 00:00:00").cast("timestamp").alias("sent_at"), F.lit(None).cast("string").alias("message_id"))
    ahead.write.mode("append").json(f"{base}/in")
    return late + run_rate_counts(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", window=window, limit=limit, **kw)
