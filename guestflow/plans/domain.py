"""Domain tables fed by the message flow (FIXTURES.md §3), as DataFrames.

``messages`` holds every valid inbound message (also those whose processing
failed on a blank name) plus the outbound auto-sent replies;
``ai_message_metadata`` holds one audit row per processed message;
``escalations`` holds the rows routed to escalate, with a simulated lifecycle.
All are map-only derivations of one scan of ``events``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fallback_reply
from ..operators import escalation as ESC
from ..operators.validate import is_valid
from ..sources import fixtures
from . import process as P

AS_OF = "2024-04-01 00:00:00"
CHECKLIST_CLOCK = "2024-04-01 08:00:00"

# Simulated escalation lifecycle by event_id % 7 (FIXTURES.md §3).
LIFECYCLE_STATUS = ["open", "closed", "assigned", "resolved", "in_progress", "closed", "resolved"]
NO_RESPONSE_SLOTS = [0, 1, 2]


def valid_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid inbound rows with their decision; ``drafted_reply`` is null
    where processing failed (blank name)."""
    v = P.checked_inbound(spark, sf_dir).filter(is_valid())
    return P.with_decision(v).withColumn("drafted_reply", fallback_reply("first_name"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_decided(spark, sf_dir).withColumn(
        "action", F.when(F.col("first_name").isNotNull(), F.col("action")))
    return P.messages_table(rows)


def ai_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ai_metadata_table(P.processed(spark, sf_dir))


def with_lifecycle(esc: DataFrame) -> DataFrame:
    """Fixture: status and first response by event_id % 7 (the adapter's
    stand-in for what agents did); first response ``floor(value*60)`` s later."""
    e = F.col("event_id") % 7
    status = F.element_at(F.array(*[F.lit(s) for s in LIFECYCLE_STATUS]), (e + 1).cast("int"))
    resp = F.when(e.isin(*NO_RESPONSE_SLOTS), F.lit(None).cast("timestamp_ntz")).otherwise(
        F.expr("timestampadd(SECOND, CAST(floor(event_value * 60) AS INT), escalated_at)"))
    return esc.withColumn("status", status).withColumn("first_response_at", resp)


def lifecycle_escalations(proc: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return ESC.mark_sla_breached(with_lifecycle(ESC.create_escalations(proc)), as_of)


def escalations(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    return lifecycle_escalations(P.processed(spark, sf_dir), as_of)


# Status of a conversation by the furthest action of its messages.
CONVERSATION_STATUS = ["open", "waiting_guest", "waiting_team", "escalated"]
ACTION_RANK = {"auto_send": 1, "agent_review": 2, "escalate": 3}


def conversations_of(msgs: DataFrame) -> DataFrame:
    """``conversations``: one per (guest, channel, property), with its time span, the
    reservation its messages name and its status. Whole-number aggregates, so hash
    aggregation runs map-side. Guests 7, 57, 107, ... have a status outside the
    domain (planted)."""
    rank = F.lit(0)
    for action, k in ACTION_RANK.items():
        rank = F.when(F.col("action") == action, k).otherwise(rank)
    booking = F.expr("try_cast(substring(booking_ref, 4) AS BIGINT)")
    g = (msgs.groupBy("conversation_id", "guest_id", "property_id", "channel")
         .agg(F.min("sent_at").alias("opened_at"), F.max("sent_at").alias("last_message_at"), F.max(rank).alias("_rank"), F.min(booking).alias("_res")))
    status = F.element_at(F.array(*[F.lit(x) for x in CONVERSATION_STATUS]), F.col("_rank") + 1)
    return g.select(F.col("conversation_id").alias("id"), "guest_id", "property_id", "channel", "opened_at", "last_message_at",
                    F.concat(F.lit("res-"), F.col("_res").cast("string")).alias("reservation_id"),
                    F.when(F.col("guest_id") % 50 == 7, F.lit("parked")).otherwise(status).alias("status"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_of(messages(spark, sf_dir))


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four domain tables that do not come from the flow."""
    return {"properties": fixtures.properties(spark, sf_dir), "guests": fixtures.guests(spark, sf_dir),
            "guest_channel_identities": fixtures.channel_identities(spark, sf_dir), "reservations": fixtures.reservations(spark, sf_dir)}


def materialize(df: DataFrame, folder: str) -> DataFrame:
    """Cut lineage: write a parquet table into a shared folder and read it back.

    Unlike an eager ``checkpoint()`` (which computes the plan once to count and again
    to save unless cached), the plan runs once; later scans get column pruning and
    filter pushdown, and a lost executor costs a re-read."""
    import uuid
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
