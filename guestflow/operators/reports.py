"""Reports, windows, top-k and follow-up jobs (D3, D11, E1-E9, F1-F3, G1-G4,
H1, J4-J8, S2 batch twin).

Per-key sequence rules (running counts, every n-th item, previous turns)
never sort a whole key in one task: positions are computed inside
(key, time bucket) partitions and shifted by a prefix count over the small
per-bucket table, so a key holding a third of all rows still spreads over
many tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import COMPLAINT_TOPICS, OTHER_TOPIC

# Our own checklist wording.
BASE_CHECKLIST = ["clean and make up all rooms", "check linen and towels", "confirm caretaker on site"]
TOPIC_CHECK = {
    "no hot water": "test hot water system",
    "no water": "check water supply",
    "no ac": "test air conditioning",
    "no wifi": "test wifi connection",
    "not working": "test appliances",
    "broken": "inspect fittings for damage",
}


def _ts(v) -> F.Column:
    return F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else v


def complaint_topic(text) -> F.Column:
    """Same-type complaints: first listed topic found in the text, else 'other'."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    expr = None
    for t in COMPLAINT_TOPICS:
        expr = F.when(low.contains(t), F.lit(t)) if expr is None else expr.when(low.contains(t), F.lit(t))
    return expr.otherwise(F.lit(OTHER_TOPIC))


# ---------------------------------------------------------------------------
# Scale-safe sequence helpers

def ordinal(df: DataFrame, keys, order_cols, bucket: F.Column, name: str = "_ord") -> DataFrame:
    """1-based position of each row within ``keys`` ordered by ``order_cols``
    (which must order rows uniquely and agree with ``bucket``; keys must not
    be null).

    row_number inside (keys, bucket) + number of rows in earlier buckets of
    the key (a window over the per-bucket counts only). The join back is an
    equi-join on (keys, bucket), so it reuses the window's partitioning."""
    keys = list(keys)
    b = df.withColumn("_bucket", bucket)
    b = b.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order_cols)))
    per = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    prev = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_carry", F.coalesce(F.sum("_n").over(prev), F.lit(0))).drop("_n")
    return (b.join(per, [*keys, "_bucket"], "inner")
            .withColumn(name, F.col("_carry") + F.col("_in"))
            .drop("_carry", "_in", "_bucket"))


def rolling_count(df: DataFrame, keys, ts_col: str, days: int, name: str = "rolling_count") -> DataFrame:
    """Rows of the same key with ``ts`` in [t − days, t] (peers included), for
    every row — the SQL window ``RANGE BETWEEN INTERVAL days PRECEDING AND
    CURRENT ROW`` — as a sweep of +1 (at t) and −1 (just after t + days)
    events, summed inside (key, hour) partitions plus a per-hour carry.
    Keys must not be null."""
    keys = list(keys)
    row = F.struct(*[F.col(c) for c in df.columns])
    # both events of a row from one pass over the input (no union of two scans)
    pair = F.array(
        F.struct(F.col(ts_col).alias("_t"), F.lit(0).alias("_kind"), F.lit(1).alias("_w"), row.alias("_row")),
        F.struct(F.expr(f"timestampadd(DAY, {days}, `{ts_col}`)").alias("_t"), F.lit(1).alias("_kind"),
                 F.lit(-1).alias("_w"), F.when(F.lit(False), row).alias("_row")))
    ev = (df.select(*keys, F.explode(pair).alias("_e")).select(*keys, "_e.*")
          .withColumn("_bucket", F.date_trunc("hour", F.col("_t"))))
    # running sum within (key, hour): default RANGE frame over (_t, _kind) includes peers
    w_in = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_kind")
    ev = ev.withColumn("_run", F.sum("_w").over(w_in))
    per = ev.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_net"))
    prev = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_carry", F.coalesce(F.sum("_net").over(prev), F.lit(0))).drop("_net")
    msgs = ev.filter(F.col("_kind") == 0)
    j = msgs.join(per, [*keys, "_bucket"], "inner")
    return j.select("_row.*", (F.col("_carry") + F.col("_run")).cast("bigint").alias(name))


# ---------------------------------------------------------------------------
# Schema views and audits

def inbound_complaints(msgs: DataFrame, ai: DataFrame) -> DataFrame:
    m = msgs.filter(F.col("direction") == "inbound").select(
        F.col("id").alias("message_id"), "property_id", "sent_at", "raw_content")
    a = ai.filter(F.col("query_type") == "complaint").select("message_id", "query_type")
    return m.join(a, "message_id", "inner")


def complaint_trends(msgs: DataFrame, ai: DataFrame, props: DataFrame) -> DataFrame:
    """D3 + G1: monthly inbound complaint counts per property, month desc,
    count desc, property id as tie-break."""
    c = inbound_complaints(msgs, ai)
    p = props.select(F.col("id").alias("property_id"), F.col("name").alias("property_name"))
    return (c.join(p, "property_id", "inner")
            .groupBy("property_id", "property_name", "query_type",
                     F.date_trunc("month", F.col("sent_at")).cast("timestamp_ntz").alias("month"))
            .agg(F.count(F.lit(1)).alias("complaint_count"))
            .orderBy(F.col("month").desc(), F.col("complaint_count").desc(), F.col("property_id")))


def unaudited(msgs: DataFrame, ai: DataFrame) -> DataFrame:
    """Inbound messages with no AI audit row."""
    m = msgs.filter(F.col("direction") == "inbound")
    return m.join(ai.select(F.col("message_id").alias("id")), "id", "left_anti") \
        .select(F.col("id").alias("message_id"), "guest_id", "property_id", "sent_at")


# ---------------------------------------------------------------------------
# E: aggregations

def rolling_complaints(msgs: DataFrame, ai: DataFrame, days: int = 60) -> DataFrame:
    """per complaint, same-type complaints at its property in the
    preceding ``days`` days (itself included)."""
    c = inbound_complaints(msgs, ai).withColumn("topic", complaint_topic("raw_content"))
    return rolling_count(c.select("message_id", "property_id", "topic", "sent_at"),
                         ["property_id", "topic"], "sent_at", days)


def recurring_complaints(msgs: DataFrame, ai: DataFrame, n: int = 3, days: int = 60) -> DataFrame:
    """Per property, topic and week: complaints that were at least the
    n-th of their type within ``days`` days (the weekly pattern job)."""
    r = rolling_complaints(msgs, ai, days).filter(F.col("rolling_count") >= n)
    return (r.groupBy("property_id", "topic",
                      F.date_trunc("week", F.col("sent_at")).cast("timestamp_ntz").alias("week"))
            .agg(F.count(F.lit(1)).alias("n_flagged"), F.max("rolling_count").alias("max_in_window")))


def conversation_rollup(msgs: DataFrame) -> DataFrame:
    """Latest message time per conversation."""
    return msgs.groupBy("conversation_id").agg(F.max("sent_at").alias("last_message_at"),
                                               F.count(F.lit(1)).alias("n_messages"))


def mean_score() -> F.Column:
    """The mean of confidence_score, whose thousandths are summed as whole numbers and
    divided once: the same on every partitioning."""
    return F.sum((F.col("confidence_score") * 1000).cast("bigint")) / (F.count("confidence_score") * 1000)


def model_quality(ai: DataFrame) -> DataFrame:
    """Per model version: volume, mean score, share edited, share escalated."""
    n = F.count(F.lit(1))
    return ai.groupBy("model_version").agg(
        n.alias("n_decisions"),
        mean_score().alias("mean_score"),
        (F.count_if(F.col("agent_edited_reply").isNotNull()) / n).alias("share_edited"),
        (F.count_if(F.col("action_taken") == "escalate") / n).alias("share_escalated"))


def processing_latency(ai: DataFrame, shares=(("p50_ms", 50), ("p95_ms", 95))) -> DataFrame:
    """Per day and model: mean, exact percentiles and max pipeline time.

    Times are whole milliseconds, so each group is first counted per distinct
    time (map-side); the p-th percentile is the least time whose running count
    reaches p per cent of the group's rows. Windows see one row per distinct
    time, however many rows a group has."""
    ms = F.col("processing_time_ms")
    hist = (ai.groupBy(F.to_date("created_at").alias("day"), "model_version", ms.alias("ms")).agg(F.count(F.lit(1)).alias("c")))
    timed = F.col("ms").isNotNull()
    key = Window.partitionBy("day", "model_version")
    run = key.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(timed, F.col("c")).otherwise(0)
    hist = hist.withColumn("upto", F.sum(known).over(run)).withColumn("all", F.sum(known).over(key))
    return hist.groupBy("day", "model_version").agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("ms") * F.col("c")) / F.sum(known)).alias("mean_ms"),
        *[F.min(F.when(timed & (F.col("upto") * 100 >= p * F.col("all")), F.col("ms"))).alias(name) for name, p in shares],
        F.max("ms").alias("max_ms"))


def sla_report(esc: DataFrame) -> DataFrame:
    """E5: per property and severity: escalations, breached, breach rate, mean
    minutes to first response."""
    n = F.count(F.lit(1))
    secs = F.timestamp_diff("SECOND", F.col("escalated_at"), F.col("first_response_at"))
    return esc.groupBy("property_id", "severity").agg(
        n.alias("n_escalations"),
        F.count_if(F.col("sla_breached")).alias("n_breached"),
        (F.count_if(F.col("sla_breached")) / n).alias("breach_rate"),
        (F.sum(secs) / (F.count(secs) * 60)).alias("mean_minutes_to_first_response"))


def preferred_channel(msgs: DataFrame) -> DataFrame:
    """The channel a guest uses most; ties go to the channel name first
    in alphabetical order. Two aggregates, no window."""
    per = msgs.filter(F.col("direction") == "inbound").groupBy("guest_id", "channel") \
        .agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("guest_id").agg(
        F.min_by("channel", F.struct((-F.col("n")).alias("neg_n"), F.col("channel"))).alias("preferred_channel"),
        F.max("n").alias("n_messages"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Passed / failed over cases. A case passes if its status is the expected
    one. ``outcomes`` has expected_status and status, expected_query_type,
    expected_action (null: nothing expected) and query_type, action."""
    ok = F.col("status") == F.col("expected_status")
    answered = F.col("status") == 200
    met = lambda c: F.count_if(answered & (F.col(f"expected_{c}") == F.col(c)))
    return outcomes.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(ok).alias("n_passed"),
                        F.count_if(~ok).alias("n_failed"),
                        F.count_if(F.col("status") == 422).alias("n_rejected"),
                        F.count_if(F.col("status") == 500).alias("n_errors"),
                        F.count_if(F.col("expected_status") == 422).alias("n_rejects_expected"),
                        F.count_if(answered & F.col("expected_query_type").isNotNull()).alias("n_answers_expected"),
                        met("query_type").alias("n_types_met"), met("action").alias("n_actions_met"))


def expectation_diff(cases: DataFrame) -> DataFrame:
    """Expected vs actual type and action, per expectation group."""
    return (cases.groupBy("case_group", "expected_query_type", "query_type", "expected_action", "action")
            .agg(F.count(F.lit(1)).alias("n_messages"))
            .withColumn("matches", (F.col("expected_query_type") == F.col("query_type"))
                        & (F.col("expected_action") == F.col("action"))))


def routing_mix(ai: DataFrame) -> DataFrame:
    """Count and mean score by query type and action."""
    return ai.groupBy("query_type", "action_taken").agg(
        F.count(F.lit(1)).alias("n"),
        mean_score().alias("mean_score"))


# ---------------------------------------------------------------------------
# F, G, H: windows, top-k, transcript

def conversation_history(turns: DataFrame, k: int = 3, block: int = 64) -> DataFrame:
    """for every kept turn, the k previous turns of its conversation as
    'role: text' lines, oldest first.

    Turns lie in blocks of ``block`` turn numbers; inside a block a window collects the
    lines. The first k turns of a block also need the end of the blocks before it: the
    last k turns of each block are sent on to the blocks that need them (which ones
    follows from the numbers of turns per block) and joined to the block they belong
    to. So a text is shuffled once with its block, and k in ``block`` of them once more; no
    task holds more than a block of a conversation. (conv_id, turn) is unique."""
    rows = turns.select("conv_id", F.floor(F.col("turn") / block).alias("block"), "turn", "role",
                        F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    here = Window.partitionBy("conv_id", "block")
    placed = rows.withColumn("prev", F.collect_list("line").over(here.orderBy("turn").rowsBetween(-k, -1)))
    # a row_number filter, so that Spark picks the last k of each block before the shuffle (WindowGroupLimit): only ends move
    ends = rows.withColumn("from_end", F.row_number().over(here.orderBy(F.col("turn").desc()))).where(F.col("from_end") <= k)
    counts = turns.groupBy("conv_id", F.floor(F.col("turn") / block).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, k)
    after = counts.withColumn("after", F.collect_list(F.struct("block", "n")).over(later))
    # a block i blocks on needs this one's end while the blocks between hold fewer than k turns
    between = lambda i: F.aggregate(F.slice("after", 1, i), F.lit(0).cast("bigint"), lambda acc, b: acc + b["n"])
    needing = F.filter("after", lambda b, i: between(i) < k)
    after = after.select("conv_id", "block", F.transform(needing, lambda b: b["block"]).alias("to"))
    sent = ends.join(after, ["conv_id", "block"], "left").select("conv_id", F.explode("to").alias("block"), F.struct("turn", "role", "line").alias("t"))
    halo = sent.groupBy("conv_id", "block").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]).alias("halo"))  # at most k * k lines
    lines = F.concat(F.coalesce("halo", F.array().cast("array<string>")), F.col("prev"))
    last = F.slice(lines, F.greatest(F.size(lines) - k + 1, F.lit(1)), F.lit(k))
    return placed.join(halo, ["conv_id", "block"], "left").select(
        "conv_id", "turn", "role", F.concat_ws("\n", last).alias("history"), F.size(last).cast("int").alias("n_history"))


def inbox(msgs: DataFrame, n: int = 50) -> DataFrame:
    """the latest message of each conversation, newest conversation first.

    Latest times per conversation are hash-aggregated; only the n newest conversations
    meet the messages again (n rows broadcast), where ties of time go to the greater id."""
    newest = (msgs.groupBy("conversation_id").agg(F.max("sent_at").alias("last_message_at"))
              .orderBy(F.col("last_message_at").desc(), F.col("conversation_id")).limit(n)
              .select(F.col("conversation_id").alias("_c"), "last_message_at"))
    found = msgs.join(F.broadcast(newest), (F.col("conversation_id") == F.col("_c")) & (F.col("sent_at") == F.col("last_message_at")))
    last = found.groupBy("conversation_id", "last_message_at").agg(F.max(F.struct("id", "direction")).alias("m"))
    return (last.select("conversation_id", F.col("m.id").alias("message_id"), F.col("m.direction").alias("direction"), "last_message_at")
            .orderBy(F.col("last_message_at").desc(), F.col("conversation_id")))


def latest(df: DataFrame, ts_col: str, n: int, cols, id_col: str = "id") -> DataFrame:
    """Newest n rows (TakeOrdered: per-partition top n, then merge)."""
    return df.orderBy(F.col(ts_col).desc(), F.col(id_col)).limit(n).select(*cols)


def sla_queue(esc: DataFrame, n: int = 50) -> DataFrame:
    """Not-breached escalations by deadline, soonest first."""
    return (esc.filter(~F.col("sla_breached")).orderBy(F.col("sla_deadline"), F.col("id")).limit(n)
            .select("id", "severity", "status", "sla_deadline"))


def transcript(turns: DataFrame) -> DataFrame:
    """H1: both directions in one table, by conversation and turn; one scan. The
    sort is Spark's range partitioning, so a long conversation spreads."""
    return turns.filter(F.col("direction").isin("inbound", "outbound")).orderBy("conv_id", "turn")


# ---------------------------------------------------------------------------
# J: follow-up jobs

def final_reply(ai: DataFrame) -> DataFrame:
    """The delivered text — the edited reply if any, else the draft — only
    once sent (auto-sent or reviewed)."""
    sent = F.col("auto_sent_at").isNotNull() | F.col("reviewed_at").isNotNull()
    return ai.select("message_id", sent.alias("sent"),
                     F.when(sent, F.coalesce("agent_edited_reply", "ai_drafted_reply")).alias("final_reply"))


def edit_pairs(ai: DataFrame) -> DataFrame:
    """draft/edit pairs with their character edit distance."""
    return ai.filter(F.col("agent_edited_reply").isNotNull()).select(
        "message_id", "ai_drafted_reply", "agent_edited_reply",
        F.levenshtein("ai_drafted_reply", "agent_edited_reply").cast("bigint").alias("edit_distance"))


def maintenance_tickets(msgs: DataFrame, ai: DataFrame, every: int = 3) -> DataFrame:
    """A ticket on every ``every``-th same-type complaint at a property,
    carrying the message ids of that run in time order. Groups are bounded
    by ``every`` rows."""
    c = inbound_complaints(msgs, ai).withColumn("topic", complaint_topic("raw_content"))
    o = ordinal(c, ["property_id", "topic"], ["sent_at", "message_id"], F.date_trunc("hour", F.col("sent_at")))
    g = (o.withColumn("ticket_no", F.ceil(F.col("_ord") / every).cast("bigint"))
         .groupBy("property_id", "topic", "ticket_no")
         .agg(F.count(F.lit(1)).alias("_n"),
              F.sort_array(F.collect_list(F.struct("_ord", "message_id"))).alias("_ms"),
              F.max("sent_at").alias("opened_at")))
    return g.filter(F.col("_n") == every).select(
        "property_id", "topic", "ticket_no", F.concat_ws(",", F.col("_ms.message_id")).alias("message_ids"), "opened_at")


def checklists(res: DataFrame, tickets: DataFrame, clock, hours: int = 24,
               check_in_time: str = "14:00:00") -> DataFrame:
    """One checklist per confirmed check-in within ``hours`` of ``clock``;
    a property with a ticket on a known topic gets that check for good."""
    now = _ts(clock)
    at = F.to_timestamp_ntz(F.concat(F.col("check_in_date").cast("string"), F.lit(" " + check_in_time)))
    upcoming = (res.filter(F.col("status") == "confirmed").withColumn("check_in_at", at)
                .filter((F.col("check_in_at") >= now) & (F.col("check_in_at") < now + F.expr(f"INTERVAL {hours} HOURS"))))
    item = None
    for topic, check in TOPIC_CHECK.items():
        item = F.when(F.col("topic") == topic, F.lit(check)) if item is None else item.when(F.col("topic") == topic, F.lit(check))
    extra = (tickets.withColumn("item", item).filter(F.col("item").isNotNull())
             .groupBy(F.col("property_id").alias("_pid")).agg(F.sort_array(F.collect_set("item")).alias("_extra")))
    j = upcoming.join(extra, upcoming["property_id"] == extra["_pid"], "left")
    items = F.concat(F.array(*[F.lit(x) for x in BASE_CHECKLIST]), F.coalesce(F.col("_extra"), F.array().cast("array<string>")))
    return j.select(F.col("id").alias("reservation_id"), "property_id", "check_in_at", "checklist_confirmed",
                    F.concat_ws("; ", items).alias("items"))


def checklist_alerts(lists: DataFrame, confirmations: DataFrame, clock, hours_before: int = 6) -> DataFrame:
    """No confirmation ``hours_before`` hours before check-in → alert."""
    now = _ts(clock)
    pending = lists.join(confirmations.select(F.col("reservation_id")), "reservation_id", "left_anti")
    due = F.col("check_in_at") - F.expr(f"INTERVAL {hours_before} HOURS")
    return pending.filter(now >= due).select("reservation_id", "property_id", "check_in_at",
                                             due.alias("alert_at"), F.lit("property_manager").alias("recipient"))


def rate_counts(msgs: DataFrame, window: str = "1 day", limit: int = 3, ts_col: str = "sent_at") -> DataFrame:
    """S2 batch twin: messages per property, source and tumbling window,
    flagged above ``limit``."""
    return (msgs.groupBy("property_id", "channel", F.window(ts_col, window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_messages"))
            .select("property_id", "channel", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n_messages",
                    (F.col("n_messages") > limit).alias("over_limit")))
