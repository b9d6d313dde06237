"""Sinks (A5, A6)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import error_envelope
from ..session import scratch_folder

RESPONSE_COLUMNS = ["message_id", "query_type", "drafted_reply", "confidence_score", "action"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the application's own one, which goes when it ends."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_responses(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: the five response fields as parquet (a rerun replaces the output)."""
    df.select(*RESPONSE_COLUMNS).write.mode(mode).parquet(path)


def write_rejects(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rejected rows with their error envelope and raw body."""
    cols = ["message_id"] + (["raw"] if "raw" in df.columns else [])
    df.select(*cols, error_envelope("errors").alias("envelope")).write.mode(mode).parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """Store a table bucketed and sorted by ``key`` in the session catalog.

    Two tables saved with the same key and bucket count join on that key
    without a shuffle (each bucket pair is joined where it lies): the form to
    keep ``messages`` and ``ai_message_metadata`` in, keyed by message id, so
    the trend, pattern and ticket jobs stop re-shuffling both sides."""
    df.write.bucketBy(buckets, key).sortBy(key).mode(mode).saveAsTable(table)
