"""Labelled samples, token tables and whole-text features of the two classifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on at most; beyond it a hash of the
#: doc_id picks them.
MAX_ROWS = 20_000


def learnable(k: int, held: int) -> Column:
    """Rows whose labels may be learned from (a null doc_id never has a label)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k != held


def held_out(k: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == held, F.lit(False)).alias("held_out")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, k: int, held: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, y, part): learnable labelled documents, at most about max_rows.

    Null labels are none; of repeated label rows the largest counts; repeated
    documents count once. part (0-9) is an independent hash for splits. The
    sample's ids are broadcast: their number is bounded by max_rows."""
    ids = (labels.where(F.col(label).isNotNull() & learnable(k, held)).groupBy("doc_id")
           .agg(F.max(F.col(label).cast("int")).alias("y")))
    n = ids.count()
    mark = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    ids = ids.where(mark < int((1 << 20) * min(1.0, max_rows / max(n, 1))))
    out = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return out.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(10)).cast("int")).dropDuplicates(["doc_id"])
