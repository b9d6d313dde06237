"""Inbound readers (A1, A3).

Payloads are read as text and parsed with a fixed six-string schema, keeping
the raw body for error reports and for the JSON type check (B6).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import message_id
from ..session import folder_has
from ..operators.validate import typed_fields

PAYLOAD_SCHEMA = T.StructType([
    T.StructField(name, T.StringType(), True)
    for name in ["source", "guest_name", "message", "timestamp", "booking_ref", "property_id"]
])

CASE_SCHEMA = T.StructType([T.StructField("test_cases", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("expected_query_type", T.StringType()),
    T.StructField("expected_action", T.StringType()),
    T.StructField("expected_status", T.IntegerType()),
    T.StructField("payload", T.VariantType()),  # read as what it is: a case may send any JSON
])))])


def parse_payload(df: DataFrame, raw_col: str = "raw", check_types: bool = False) -> DataFrame:
    """A1: parse the raw JSON body into the six payload columns.

    With ``check_types`` the body is parsed as a variant and every field is
    told apart as absent, null, string or another type (``typed_fields``): wrong
    types and malformed bodies are errors, as the service has it. Without, as
    for rows known to hold strings, ``json_tuple`` reads the fields' text; a
    malformed body gives null fields. Both are generators, so each body is
    parsed once and later filters never re-inline a JSON parse per field.
    """
    if check_types:
        return typed_fields(df, raw_col)
    names = [f.name for f in PAYLOAD_SCHEMA.fields]
    return df.select(*df.columns, F.json_tuple(F.col(raw_col), *names).alias(*names))


def pinned_ids(df: DataFrame, store: str, name: str = "message_id") -> DataFrame:
    """C4, random form: ``df`` with a random UUID per row, pinned by a stored table.

    A random value is made anew whenever a task runs again, so branches and retries
    would see different ids. Here the ids are drawn in one write: a failed or repeated
    task attempt leaves nothing behind (the write commits one attempt per task), and all
    readers take the stored rows. A complete store is used as it is, so a job started
    again after a failure goes on with the same ids; an unfinished one is replaced."""
    spark = df.sparkSession
    if not folder_has(spark, store, "_SUCCESS"):
        df.withColumn(name, F.uuid()).write.mode("overwrite").parquet(store)
    return spark.read.schema(df.withColumn(name, F.lit("")).schema).parquet(store)


def read_inbound(spark: SparkSession, path: str, check_types: bool = True,
                 drop_redeliveries: bool = False, id_store: str | None = None) -> DataFrame:
    """A1 over files: one JSON payload per line; ``message_id`` is the stable
    hash of the raw body and its file position is not used.

    A channel that delivers a payload twice gives the same id; by default both
    rows are kept (as the service does). ``drop_redeliveries`` keeps one per
    id; ``dropDuplicates`` combines map-side, so a body repeated very often
    collapses before the shuffle. ``id_store`` names a folder for random ids
    (``pinned_ids``) in place of the hash; every delivery then has its own."""
    raw = spark.read.text(path).withColumnRenamed("value", "raw")
    raw = pinned_ids(raw, id_store) if id_store else raw.withColumn("message_id", message_id("raw"))
    if drop_redeliveries:
        raw = raw.dropDuplicates(["message_id"])
    return parse_payload(raw, check_types=check_types)


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A3: nested test-case documents; one row per case, expected_status
    defaulting to 200.

    The payload is read as a variant, so what a case sends stays what it is:
    numbers, objects, explicit nulls and absent fields are told apart as in a
    live body (``typed_fields``), and cases that must be rejected are. ``raw`` is
    the payload's JSON text (keys in the variant's order).

    ``multi_line``: each file is one (pretty-printed) document; otherwise
    each line is a document."""
    doc = spark.read.option("multiLine", multi_line).schema(CASE_SCHEMA).json(path)
    cases = doc.select(F.explode("test_cases").alias("c")).select("c.*")
    cases = cases.select(
        F.col("id").alias("case_id"), "description", "expected_query_type", "expected_action",
        F.coalesce(F.col("expected_status"), F.lit(200)).alias("expected_status"),
        F.to_json(F.col("payload")).alias("raw"), "payload", F.concat(F.lit("case-"), F.col("id")).alias("message_id"))
    return typed_fields(cases, "raw", parsed="payload")
