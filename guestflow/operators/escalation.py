"""Escalation lifecycle.

NOW() of the schema's views is always an explicit ``as_of`` parameter, so a
report is reproducible and retry-safe.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CLOSED_STATUSES
from ..functions.text import conversation_key


def _ts(as_of) -> F.Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def create_escalations(responses: DataFrame, critical_minutes: int = 30, medium_hours: int = 24,
                       escalate_on_draft_error: bool = False) -> DataFrame:
    """One open escalation per message routed to escalate.

    complaint → critical, deadline +30 min; a drafting failure (opt-in) →
    ai_failure; otherwise low_confidence; both medium, +24 h by default.
    """
    qt = F.col("query_type")
    reason = F.when(qt == "complaint", F.lit("complaint"))
    if escalate_on_draft_error:
        reason = reason.when(F.col("draft_error").isNotNull(), F.lit("ai_failure"))
    reason = reason.otherwise(F.lit("low_confidence"))
    critical = qt == "complaint"
    deadline = F.when(critical, F.expr(f"timestampadd(MINUTE, {critical_minutes}, sent_at)")) \
        .otherwise(F.expr(f"timestampadd(HOUR, {medium_hours}, sent_at)"))
    return (responses.filter(F.col("action") == "escalate")
            .select(F.concat(F.lit("esc-"), F.col("event_id").cast("string")).alias("id"),
                    "message_id", conversation_key().alias("conversation_id"), "guest_id", "property_id",
                    reason.alias("reason"),
                    F.when(critical, F.lit("critical")).otherwise(F.lit("medium")).alias("severity"),
                    F.lit("open").alias("status"),
                    F.col("sent_at").alias("escalated_at"),
                    F.lit(None).cast("timestamp_ntz").alias("first_response_at"),
                    deadline.alias("sla_deadline"),
                    "event_id", "event_value", "query_type", "message"))


def mark_sla_breached(esc: DataFrame, as_of) -> DataFrame:
    """Breached if the first response came after the deadline, or none
    came and the deadline has passed at ``as_of``."""
    fr, dl = F.col("first_response_at"), F.col("sla_deadline")
    breached = (fr.isNotNull() & (fr > dl)) | (fr.isNull() & (dl < _ts(as_of)))
    return esc.withColumn("sla_breached", breached)


def overdue_escalations(esc: DataFrame, guests: DataFrame, props: DataFrame, as_of) -> DataFrame:
    """Open escalations past their deadline with no first response,
    with guest and property names; ``overdue_seconds`` = as_of − deadline."""
    now = _ts(as_of)
    e = esc.filter(~F.col("status").isin(*CLOSED_STATUSES) & (F.col("sla_deadline") < now)
                   & F.col("first_response_at").isNull())
    g = guests.select(F.col("id").alias("_gid"), F.col("full_name").alias("guest_name"))
    p = props.select(F.col("id").alias("_pid"), F.col("name").alias("property_name"))
    return (e.join(g, e["guest_id"] == g["_gid"], "inner")
            .join(p, e["property_id"] == p["_pid"], "inner")
            .select("id", "reason", "severity", "sla_deadline", "escalated_at", "guest_name", "property_name",
                    F.timestamp_diff("SECOND", F.col("sla_deadline"), now).alias("overdue_seconds")))


ALERTS = {1: "on_call_manager", 2: "senior_manager"}


def sla_alerts(esc: DataFrame, as_of) -> DataFrame:
    """Level 1 to the on-call manager when the escalation opens; level 2
    to the senior manager at the deadline when it passed with no response. Both
    levels come from one pass over the escalations."""
    due = F.col("first_response_at").isNull() & (F.col("sla_deadline") < _ts(as_of))
    alert = lambda level, at: F.struct(F.lit(level).alias("level"), F.lit(ALERTS[level]).alias("recipient"), F.col(at).alias("alert_at"))
    alerts = F.filter(F.array(alert(1, "escalated_at"), F.when(due, alert(2, "sla_deadline"))), lambda a: a.isNotNull())
    return esc.select(F.col("id").alias("escalation_id"), F.inline(alerts))
