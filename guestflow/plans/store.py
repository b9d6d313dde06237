"""Stored forms of the flow: computed once, read by many reports, removed after use.

``store_flow`` writes the flow's rows once, parted by branch (ok, failed, rejected),
with the columns that the reports at hand read; messages, audit rows, escalations and
conversations are projections of it. ``load_tables`` writes the eight typed domain
tables; the counts of the row constraints are observed by the writes themselves. Both
take a folder named by the caller, leave a manifest in it and are context managers
that remove it."""
from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fallback_reply
from ..operators import constraints as CON
from ..session import remove_folder
from ..sources import fixtures, typed
from . import domain as DOM
from . import process as P

MANIFEST = "_manifest"
BRANCHES = ("ok", "failed", "rejected")

#: Columns of the flow that each derived table is made from; the last two are all that
#: the complaint reports read of messages and audit rows.
NEEDS = {
    "messages": ["event_id", "guest_id", "message_id", "source", "property_id", "booking_ref", "message", "sent_at", "action", "drafted_reply"],
    "conversations": ["event_id", "guest_id", "message_id", "source", "property_id", "booking_ref", "message", "sent_at", "action", "drafted_reply"],
    "ai_message_metadata": ["event_id", "event_value", "message_id", "query_type", "drafted_reply", "confidence_score", "action", "sent_at"],
    "escalations": ["event_id", "event_value", "guest_id", "message_id", "source", "property_id", "query_type", "action", "message", "sent_at", "draft_error"],
    "inbound_messages": ["message_id", "guest_id", "property_id", "message", "sent_at"],
    "query_types": ["message_id", "query_type", "sent_at"],
}
TABLES = ("messages", "conversations", "ai_message_metadata", "escalations")


def _write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{MANIFEST}").first()[0])


class Stored:
    """A folder with a manifest; ``remove()`` or leaving the ``with`` block takes it away."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, read_manifest(spark, path)

    def schema(self, name: str) -> T.StructType:
        """Of a stored frame; a table without rows has no file that could tell."""
        return T.StructType.fromJson(self.manifest["schemas"][name])

    def remove(self) -> None:
        remove_folder(self.spark, self.path)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.remove()


class StoredFlow(Stored):
    """The flow's rows by branch, and the tables made from them."""

    def branch(self, *names: str) -> DataFrame:
        return self.spark.read.schema(self.schema("rows")).parquet(self.path + "/rows").where(F.col("branch").isin(*names))

    def messages(self) -> DataFrame:
        """Valid messages (also those whose processing failed) and outbound replies."""
        return P.messages_table(self.branch("ok", "failed"))

    def inbound_messages(self) -> DataFrame:
        """``messages`` without replies, the columns that reports on complaints and audits read."""
        return self.branch("ok", "failed").select(F.col("message_id").alias("id"), F.lit("inbound").alias("direction"), "guest_id", "property_id",
                                                  F.col("message").alias("raw_content"), "sent_at")

    def query_types(self) -> DataFrame:
        """``ai_message_metadata`` with its class only."""
        return self.branch("ok").select("message_id", "query_type", F.col("sent_at").alias("created_at"))

    def ai_metadata(self) -> DataFrame:
        return P.ai_metadata_table(self.branch("ok"))

    def escalations(self, as_of: str = DOM.AS_OF) -> DataFrame:
        return DOM.lifecycle_escalations(self.branch("ok"), as_of)

    def conversations(self) -> DataFrame:
        return DOM.conversations_of(self.messages())

    def tables(self, sf_dir: str) -> dict[str, DataFrame]:
        """The eight domain tables: four from the flow, four from their own sources."""
        return {**DOM.source_tables(self.spark, sf_dir), "conversations": self.conversations(), "messages": self.messages(),
                "ai_message_metadata": self.ai_metadata(), "escalations": self.escalations()}


def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inbound row with its branch and, where valid, its decision and reply."""
    checked = P.checked_inbound(spark, sf_dir)
    branch = F.when(~F.col("is_valid"), "rejected").when(F.col("first_name").isNull(), "failed").otherwise("ok")
    rows = P.with_decision(checked.withColumn("branch", branch))
    ok = F.col("branch") == "ok"
    return (rows.withColumn("action", F.when(ok, F.col("action"))).withColumn("drafted_reply", F.when(ok, fallback_reply("first_name")))
            .withColumn("draft_error", F.lit(None).cast("string")))


def store_flow(spark: SparkSession, sf_dir: str, path: str, tables: Iterable[str] = TABLES, rejected: bool = False) -> StoredFlow:
    """Run the flow once and keep what ``tables`` are made from under ``path``.

    ``rejected`` keeps the rejected rows with their errors too. The counts per branch
    are observed by the write and stand in the manifest."""
    columns = list(dict.fromkeys(c for t in tables for c in NEEDS[t]))
    rows = flow_rows(spark, sf_dir)
    if rejected:
        columns += ["raw", "errors"]
    else:
        rows = rows.where("branch <> 'rejected'")
    seen = Observation()
    rows = rows.select("branch", *columns).observe(seen, *[F.count_if(F.col("branch") == b).alias(b) for b in BRANCHES])
    with one_writer_per_branch(spark):
        rows.write.partitionBy("branch").parquet(path + "/rows")
    _write_manifest(spark, path, {"source": sf_dir, "rows": seen.get, "schemas": {"rows": rows.schema.jsonValue()}})
    return StoredFlow(spark, path)


class one_writer_per_branch:
    """Inside, a task keeps one open file per branch (or of rows set aside or not) instead of
    sorting its rows by it."""

    KEY = "spark.sql.maxConcurrentOutputFileWriters"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, str(len(BRANCHES) + 1))

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


class LoadedTables(Stored):
    """The eight typed tables and what their writes observed."""

    def table(self, name: str) -> DataFrame:
        return self.all_rows(name).where(~F.col(typed.QUARANTINED)).select(*typed.SCHEMAS[name].fieldNames())

    def quarantine(self, name: str) -> DataFrame:
        return self.all_rows(name).where(typed.QUARANTINED)

    def all_rows(self, name: str) -> DataFrame:
        """A table's rows, those set aside included."""
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.path}/{name}")

    def rows(self) -> dict[str, DataFrame]:
        return {name: self.all_rows(name) for name in typed.SCHEMAS}

    @property
    def counts(self) -> dict[str, dict[str, int]]:
        return self.manifest["counts"]


def load_table(df: DataFrame, name: str, path: str, as_of: str = DOM.AS_OF) -> tuple[dict[str, int], T.StructType]:
    """Defaults, types, one write; returns the counts of the table's row constraints and
    the stored schema. The counts are taken by the write itself (``observe`` sits right below it, in the stage that
    writes, so a row counts once)."""
    known = df.select(*[c for c in df.columns if c in typed.SCHEMAS[name].fieldNames()])
    rows = typed.enforce(known, name, CON.default_values(name, as_of))
    seen = Observation()
    rows = rows.observe(seen, F.count_if(typed.QUARANTINED).alias("quarantined"), *CON.row_counts(rows, name))
    rows.write.partitionBy(typed.QUARANTINED).parquet(f"{path}/{name}")
    return {k: int(v) for k, v in seen.get.items()}, rows.schema


def _load_each(tables: dict[str, DataFrame], path: str, as_of: str) -> dict[str, tuple[dict[str, int], T.StructType]]:
    """The writes do not wait for each other: a small table's few tasks run beside a large one's."""
    spark = next(iter(tables.values())).sparkSession
    with one_writer_per_branch(spark), ThreadPoolExecutor(len(tables)) as pool:
        done = {name: pool.submit(load_table, df, name, path, as_of) for name, df in tables.items()}
        return {name: d.result() for name, d in done.items()}


def _loaded(spark: SparkSession, path: str, as_of: str, done: dict[str, tuple[dict[str, int], T.StructType]]) -> LoadedTables:
    _write_manifest(spark, path, {"as_of": as_of, "counts": {n: c for n, (c, _) in done.items()}, "schemas": {n: s.jsonValue() for n, (_, s) in done.items()}})
    return LoadedTables(spark, path)


def load_tables(tables: dict[str, DataFrame], path: str, as_of: str = DOM.AS_OF) -> LoadedTables:
    """Write the eight domain tables, typed, under ``path``, with the observed counts in
    the manifest (``CON.counts_report`` turns them into the reports)."""
    spark = next(iter(tables.values())).sparkSession
    return _loaded(spark, path, as_of, _load_each(tables, path, as_of))


def load_domain(spark: SparkSession, sf_dir: str, path: str, as_of: str = DOM.AS_OF) -> LoadedTables:
    """The eight tables of a data set: the flow runs once, beside the loads of the four
    tables that do not come from it, and goes when its own are written."""
    with one_writer_per_branch(spark), ThreadPoolExecutor(1) as pool:
        sources = DOM.source_tables(spark, sf_dir)
        beside = pool.submit(_load_each, sources, path, as_of)
        with store_flow(spark, sf_dir, path + "/flow") as flow:
            made = _load_each({n: df for n, df in flow.tables(sf_dir).items() if n not in sources}, path, as_of)
        return _loaded(spark, path, as_of, {**beside.result(), **made})
