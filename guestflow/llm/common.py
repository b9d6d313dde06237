"""Helpers shared by the corpus operators: inputs, folds, text batches, stored tables."""
from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestflow.session import scratch_folder

#: Text handled at once inside a Python task, in characters. It bounds a
#: task's memory whatever the number of rows in an Arrow batch.
BATCH_CHARS = 3_000_000
#: Keys holding one row in HOT or more are joined apart (there are at most HOT).
HOT = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k: the split of learning and held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % k


def text_key(text: str | Column = "text") -> Column:
    """Sets apart the texts of rows that share a doc_id (or have none)."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text key) is in ``gone`` (doc_id, of): a
    verdict goes with its row, also where ids are null or repeated with other texts."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("of").alias("_of")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & text_key().eqNullSafe(F.col("_of")), "left_anti")


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``chars`` characters (one row at least)."""
    for b in batches:
        n, lo, size = b.num_rows, 0, 0
        lengths = pc.binary_length(b.column(text)).to_pylist() if n else []
        for i, k in enumerate(lengths):
            size += k or 0
            if size >= chars:
                yield b.slice(lo, i + 1 - lo)
                lo, size = i + 1, 0
        if lo < n:
            yield b.slice(lo, n - lo)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the application's folder under the shared checkpoint
    folder and read it back.

    Cuts the lineage with files every executor can reach; they go when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def met(rows: DataFrame, found: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of rows with ``found``, which has one row per key and ``n``, the key's
    number of rows. Keys with one row in HOT or more meet by broadcast, at most HOT of
    them; for the shuffled join of the others they get keys of their own (``spread``)."""
    total = found.agg(F.sum("n")).first()[0] or 0
    cols = [c for c in found.columns if c not in (key, "n")]
    hot = found.where(F.col("n") * HOT >= total).select(F.col(key).alias("_hot"), *[F.col(c).alias("_h_" + c) for c in cols])
    rest = found.where(F.col("n") * HOT < total).select(F.col(key).alias("_key"), *[F.col(c).alias("_r_" + c) for c in cols])
    out = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")
    own = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), spread.cast("string")).cast(rows.schema[key].dataType))
    out = out.withColumn("_own", own).join(rest, F.col("_own") == F.col("_key"), "left")
    return out.select(*rows.columns, *[F.coalesce("_h_" + c, "_r_" + c).alias(c) for c in cols],
                      (F.col("_hot").isNotNull() | F.col("_key").isNotNull()).alias("met"))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs whose frames are gone.

    The context cleaner acts when the driver's JVM collects garbage; without
    this, a job's files stay on the executors' disks until that happens by
    chance, and the stages of a long operator add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slots(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
