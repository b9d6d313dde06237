"""The corpus pipeline: documents to packed training sequences.

Five stages, each one of the operators in ``guestflow.llm``. A stage takes
(spark, docs, sf_dir) and returns a frame; ``run`` writes each result as Parquet
in the shared checkpoint folder and reads it again for the next stage, so a lost
executor never sets the pipeline back further than one stage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestflow.llm.common import read, stored
from guestflow.llm.decontaminate import decontaminated
from guestflow.llm.langid import identified
from guestflow.llm.lines import line_dedup
from guestflow.llm.packing import pack
from guestflow.llm.simhash import near_duplicates_removed
from guestflow.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those rejected (``und`` too) go."""
    ship_package(spark)
    return identified(docs).select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines, n_chars counted anew. A document that
    loses all its lines goes; one that had none stays as it is."""
    ship_package(spark)
    out = line_dedup(docs, edits=2, min_chars=20)
    return (out.where((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
            .select(COLUMNS))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id."""
    ship_package(spark)
    return near_duplicates_removed(docs, shingle=3, radius=3).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark windows."""
    ship_package(spark)
    return decontaminated(docs, read(spark, sf_dir, "benchmark"), n=13, share=20).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, with its sequence and place."""
    ship_package(spark)
    return pack(docs, capacity=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, hashing by words and tokenizers have no SQL form; the tests
#: hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
