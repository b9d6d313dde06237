"""Registered queries: one per operator of the inventory, each (spark, sf_dir) → DataFrame.

Each reads the given tables through the adapters, so its work grows with them.
Column names match the oracle SQL in ``plans.oracle.ORACLE``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.classify import classify, classify_by_lang
from ..functions.scoring import (ambiguous, base_score_cents, confidence_band, context_penalty_cents,
                                 multi_intent, route_action)
from ..functions.text import (booking_ref_label, fallback_reply, message_id, normalize_phone,
                              property_text, reply_preview, user_prompt)
from ..operators.validate import (MSG_BAD_SOURCE, MSG_MISSING, MSG_NOT_STRING, MSG_TOO_SHORT, error_envelope,
                                  is_valid, response_violations, split_valid, with_validation)
from ..sources import fixtures
from ..sources.inbound import parse_payload
from . import process as P

PAYLOAD = ["source", "guest_name", "message", "timestamp", "booking_ref", "property_id"]


def _checked(spark, sf):
    return P.checked_inbound(spark, sf)


def _ok(spark, sf):
    return split_valid(_checked(spark, sf))[0]


def _proc(spark, sf):
    return P.processed(spark, sf)


def _error_rows(spark, sf) -> DataFrame:
    bad = split_valid(_checked(spark, sf))[1]
    return (bad.select("message_id", F.posexplode("errors").alias("detail_index", "e"))
            .select("message_id", "detail_index", F.col("e.field").alias("field"),
                    F.col("e.issue").alias("issue"), F.col("e.received").alias("received")))


def _docs(spark, sf):
    return fixtures.table(spark, sf, "documents").select("doc_id", "text", "lang")


def _with_props(df: DataFrame, props: DataFrame) -> DataFrame:
    p = props.select(*[F.col(c).alias("p_" + c) for c in props.columns])
    return df.join(p, df["property_id"] == p["p_id"], "left")


# --- A: sources and sinks ---------------------------------------------------

def ingest_messages(spark, sf):
    return parse_payload(fixtures.inbound_raw(spark, sf)).select("message_id", "raw", *PAYLOAD)


def property_dim(spark, sf):
    return fixtures.properties(spark, sf)


def ai_audit_records(spark, sf):
    return P.audit_records(_proc(spark, sf)).select(
        "message_id", "query_type", "ai_drafted_reply", "confidence_score", "action_taken",
        "model_version", "processing_time_ms", "escalated_at", "auto_sent_at", "created_at")


# --- B: validation ----------------------------------------------------------

def check_required(spark, sf):
    return _error_rows(spark, sf).filter(F.col("issue") == MSG_MISSING)


def check_source_enum(spark, sf):
    return _error_rows(spark, sf).filter(F.col("issue") == MSG_BAD_SOURCE)


def check_min_length(spark, sf):
    return _error_rows(spark, sf).filter(F.col("issue") == MSG_TOO_SHORT)


def check_timestamp(spark, sf):
    return _checked(spark, sf).select("message_id", "timestamp", "sent_at",
                                      F.col("sent_at").isNotNull().alias("timestamp_valid"))


def default_booking_ref(spark, sf):
    return (_checked(spark, sf).filter(is_valid())
            .select("message_id", "booking_ref", F.col("booking_ref").isNotNull().alias("has_booking_ref")))


def error_details(spark, sf):
    env = error_envelope(F.array())
    return _error_rows(spark, sf).select(
        "message_id", env["error"].alias("error"), "detail_index", "field", "issue", "received",
        env["hint"].alias("hint"))


def split_valid_q(spark, sf):
    ch = _checked(spark, sf)
    outcome = (F.when(~is_valid(), F.lit("rejected"))
               .when(F.col("first_name").isNull(), F.lit("processing_error"))
               .otherwise(F.lit("response")))
    return ch.select("message_id", outcome.alias("outcome"), F.size("errors").cast("bigint").alias("n_errors"))


def blank_name_failure(spark, sf):
    return (split_valid(_checked(spark, sf))[2]
            .select("message_id", "guest_name", F.lit("blank_guest_name").alias("processing_error")))


def check_response(spark, sf):
    return (P.process_messages(spark, sf)
            .select("message_id", F.size(response_violations()).cast("bigint").alias("n_violations")))


# --- C: projections and scalar functions ------------------------------------

def classify_q(spark, sf):
    return _docs(spark, sf).select("doc_id", classify("text").alias("query_type"))


def classify_explain(spark, sf):
    from ..functions.classify import explain_from_hits, keyword_hits
    m = explain_from_hits("_hits")
    return _docs(spark, sf).withColumn("_hits", keyword_hits("text")).select(
        "doc_id", m["query_type"].alias("query_type"), m["matched_by"].alias("matched_by"),
        m["keyword"].alias("keyword"),
        F.concat_ws(",", m["matched_classes"]).alias("matched_classes"),
        F.concat_ws(",", m["matched_keywords"]).alias("matched_keywords"))


def normalize(spark, sf):
    d = P.with_decision(_ok(spark, sf))
    return d.select("message_id", "source", "guest_name", F.col("message").alias("message_text"),
                    F.col("sent_at").alias("timestamp"), "booking_ref", "property_id", "query_type")


def message_id_q(spark, sf):
    return fixtures.inbound_raw(spark, sf).select("message_id", message_id("raw").alias("stable_id"))


def first_name_q(spark, sf):
    return _checked(spark, sf).select("message_id", "guest_name", "first_name")


def booking_ref_label_q(spark, sf):
    return _ok(spark, sf).select("message_id", "booking_ref", booking_ref_label("booking_ref").alias("booking_ref_label"))


def property_text_q(spark, sf):
    j = _with_props(_ok(spark, sf), fixtures.properties(spark, sf))
    return j.select("message_id", "property_id", property_text("p_").alias("property_text"))


def user_prompt_q(spark, sf):
    j = P.with_prompts(P.with_decision(_ok(spark, sf)), fixtures.properties(spark, sf))
    return j.select("message_id", F.col("prompt"))


def prompt_requests(spark, sf):
    j = P.with_prompts(P.with_decision(_ok(spark, sf)), fixtures.properties(spark, sf))
    from ..functions.text import prompt_request
    r = prompt_request("prompt")
    return j.select("message_id", r["model"].alias("model"), r["max_tokens"].alias("max_tokens"),
                    r["system"].alias("system"), r["messages"][0]["role"].alias("role"),
                    r["messages"][0]["content"].alias("content"))


def base_score(spark, sf):
    d = P.with_decision(_ok(spark, sf))
    return d.select("message_id", "query_type",
                    (base_score_cents("query_type").cast("double") / F.lit(100.0)).alias("base_score"))


def multi_intent_penalty(spark, sf):
    low = F.lower(F.col("message"))
    return _ok(spark, sf).select(
        "message_id", F.when(multi_intent(low), F.lit(0.08)).otherwise(F.lit(0.0)).alias("multi_intent_penalty"))


def ambiguity_penalty(spark, sf):
    low = F.lower(F.col("message"))
    return _ok(spark, sf).select(
        "message_id", F.when(ambiguous(low), F.lit(0.10)).otherwise(F.lit(0.0)).alias("ambiguity_penalty"))


def confidence_q(spark, sf):
    return P.with_decision(_ok(spark, sf)).select("message_id", "query_type", "confidence_score")


def route_action_q(spark, sf):
    return P.with_decision(_ok(spark, sf)).select("message_id", "query_type", "confidence_score", "action")


def fallback_reply_q(spark, sf):
    return _ok(spark, sf).select("message_id", "first_name", fallback_reply("first_name").alias("fallback_reply"))


def draft_replies_q(spark, sf):
    d = P.with_decision(_ok(spark, sf))
    out = P.draft_replies(d, fixtures.properties(spark, sf), drafter_factory=P.OfflineDrafter)
    return out.select("message_id", "drafted_reply", "draft_error")


def process_messages(spark, sf):
    return P.process_messages(spark, sf)


def reply_preview_q(spark, sf):
    return P.process_messages(spark, sf).select("message_id", reply_preview("drafted_reply").alias("reply_preview"))


def confidence_band_q(spark, sf):
    d = P.with_decision(_ok(spark, sf))
    return d.select("message_id", "confidence_score", confidence_band("score_cents", "query_type").alias("confidence_band"))


def context_confidence(spark, sf):
    d = P.with_decision(_ok(spark, sf))
    j = _with_props(d, fixtures.properties(spark, sf))
    pen = context_penalty_cents("query_type", F.lower(F.col("message")), "p_wifi_password",
                                F.col("p_id").isNotNull())
    adj = F.when(F.col("query_type") == "complaint", F.col("score_cents")) \
        .otherwise(F.greatest(F.col("score_cents") - pen, F.lit(rules.SCORE_FLOOR_CENTS)))
    j = j.withColumn("_pen", pen).withColumn("_adj", adj)
    return j.select("message_id", (F.col("_pen").cast("double") / 100.0).alias("context_penalty"),
                    (F.col("_adj").cast("double") / 100.0).alias("adjusted_score"),
                    route_action("_adj", "query_type").alias("adjusted_action"))


def normalize_phone_q(spark, sf):
    g = fixtures.guests(spark, sf)
    return g.select("id", "phone", normalize_phone("phone").alias("phone_e164"))


def lang_rules(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang", classify_by_lang("text", "lang").alias("query_type"))


QUERIES = {
    "ingest_messages": ingest_messages,
    "property_dim": property_dim,
    "ai_audit_records": ai_audit_records,
    "check_required": check_required,
    "check_source_enum": check_source_enum,
    "check_min_length": check_min_length,
    "check_timestamp": check_timestamp,
    "default_booking_ref": default_booking_ref,
    "error_details": error_details,
    "split_valid": split_valid_q,
    "blank_name_failure": blank_name_failure,
    "check_response": check_response,
    "classify": classify_q,
    "classify_explain": classify_explain,
    "normalize": normalize,
    "message_id": message_id_q,
    "first_name": first_name_q,
    "booking_ref_label": booking_ref_label_q,
    "property_text": property_text_q,
    "user_prompt": user_prompt_q,
    "prompt_requests": prompt_requests,
    "base_score": base_score,
    "multi_intent_penalty": multi_intent_penalty,
    "ambiguity_penalty": ambiguity_penalty,
    "confidence": confidence_q,
    "route_action": route_action_q,
    "fallback_reply": fallback_reply_q,
    "draft_replies": draft_replies_q,
    "process_messages": process_messages,
    "reply_preview": reply_preview_q,
    "confidence_band": confidence_band_q,
    "context_confidence": context_confidence,
    "normalize_phone": normalize_phone_q,
    "lang_rules": lang_rules,
}


# ===========================================================================
# Joins, constraints, reports and follow-up jobs over the domain tables

from functools import reduce  # noqa: E402

from ..operators import cascade as CAS  # noqa: E402
from ..operators import constraints as CON  # noqa: E402
from ..operators import escalation as ESC  # noqa: E402
from ..operators import identity as ID  # noqa: E402
from ..operators import reports as R  # noqa: E402
from ..sources import typed  # noqa: E402
from . import domain as DOM  # noqa: E402

TOP_N = 20
DELETE_BEFORE = "2024-02-01 00:00:00"
RATE_LIMIT = 3


def _flow(spark, sf, *tables, **kw):
    """The flow, run once and stored with what ``tables`` are made from; the folder
    goes with the application."""
    from ..sources.sinks import scratch_path
    from .store import store_flow
    return store_flow(spark, sf, scratch_path(spark, "flow"), tables, **kw)


def _scratch(spark, name):
    from ..sources.sinks import scratch_path
    return scratch_path(spark, name)


_COMPLAINTS = ("inbound_messages", "query_types")


def _loaded(spark, sf):
    """The eight typed tables, stored, with the counts their writes observed."""
    from ..sources.sinks import scratch_path
    from .store import load_domain
    return load_domain(spark, sf, scratch_path(spark, "tables"))


def _tables(spark, sf) -> dict:
    return _flow(spark, sf, "messages", "ai_message_metadata", "escalations").tables(sf)


def _lazy_tables(spark, sf) -> dict:
    """The eight tables as plans, nothing stored."""
    return {**DOM.source_tables(spark, sf), "conversations": DOM.conversations(spark, sf), "messages": DOM.messages(spark, sf),
            "ai_message_metadata": DOM.ai_metadata(spark, sf), "escalations": DOM.escalations(spark, sf)}


def _exports(spark, sf) -> dict:
    """The eight tables as text exports with planted values that do not fit."""
    return {name: fixtures.text_export(df, name, typed.SCHEMAS[name].fieldNames()) for name, df in _lazy_tables(spark, sf).items()}


def _senders(spark, sf):
    """Inbound messages with their sender identity, for the identity jobs."""
    return _proc(spark, sf).select("message_id", F.col("source").alias("channel"), "guest_id", "booking_ref",
                                   "guest_name", "sent_at", "property_id")


def _unified(spark, sf):
    return ID.unify(_senders(spark, sf), fixtures.reservations(spark, sf), fixtures.channel_identities(spark, sf))


# --- A4-A6 -------------------------------------------------------------------

def domain_tables(spark, sf):
    """A4: the exports loaded into typed tables: rows and rows set aside per table,
    as the load observed them."""
    from ..sources.sinks import scratch_path
    from .store import load_tables
    counts = load_tables(_exports(spark, sf), scratch_path(spark, "tables")).counts
    return spark.createDataFrame([(t, c["rows"], c["rows"] - c["quarantined"], c["quarantined"]) for t, c in counts.items()],
                                 "table_name string, n_rows bigint, n_typed bigint, n_quarantined bigint")


def _typed_table(name):
    def run(spark, sf):
        return typed.accepted(typed.enforce(_exports(spark, sf)[name], name), name)
    run.__name__, run.__doc__ = f"table_{name}", f"A4: the rows of {name} that fit its schema, typed."
    return run


def quarantined_rows(spark, sf):
    """A4: every value set aside, with its table, row and text."""
    parts = [typed.faults(typed.enforce(df, name)).select(F.lit(name).alias("table_name"), "*") for name, df in _exports(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)


def write_responses(spark, sf):
    from ..sources.sinks import scratch_path, write_responses as w
    path = scratch_path(spark, "responses")
    w(P.process_messages(spark, sf), path)
    return spark.read.parquet(path)


def write_rejects(spark, sf):
    from ..sources.sinks import scratch_path, write_rejects as w
    path = scratch_path(spark, "rejects")
    w(split_valid(_checked(spark, sf))[1], path)
    back = spark.read.parquet(path)
    return back.select("message_id", "raw", F.col("envelope.error").alias("error"),
                       F.size("envelope.details").cast("bigint").alias("n_details"),
                       F.col("envelope.details")[0]["field"].alias("first_field"),
                       F.col("envelope.hint").alias("hint"))


# --- B11-B24 -------------------------------------------------------------------

def check_email(spark, sf):
    return CON.email_violations(fixtures.guests(spark, sf))


def check_stay_dates(spark, sf):
    return CON.stay_date_violations(fixtures.reservations(spark, sf))


def check_guest_count(spark, sf):
    return CON.guest_count_violations(fixtures.reservations(spark, sf))


def check_direction(spark, sf):
    t = fixtures.table(spark, sf, "conversations")
    d = (t.withColumn("direction", F.when(F.col("role") == "user", F.lit("inbound"))
                      .when(F.col("role") == "assistant", F.lit("outbound")).otherwise(F.col("role"))))
    return d.filter(F.col("direction").isNull() | ~F.col("direction").isin(*CON.DIRECTIONS)) \
        .select("conv_id", "turn", "direction")


def check_channel(spark, sf):
    return CON.domain_violations(fixtures.inbound_events(spark, sf), "message_id", "source", rules.CHANNELS)


def _with_reimport(df: DataFrame, again) -> DataFrame:
    """A table with some rows imported a second time under a new id (planted
    violations of its unique keys), from one scan."""
    copies = F.when(again, F.array(F.lit(""), F.lit("-again"))).otherwise(F.array(F.lit("")))
    return df.withColumn("_copy", F.explode(copies)).withColumn("id", F.concat("id", "_copy")).drop("_copy")


def check_unique_booking_ref(spark, sf):
    res = fixtures.reservations(spark, sf)
    return CON.duplicates(_with_reimport(res, F.substring("id", 5, 20).cast("bigint") % 500 == 0), "booking_ref")


def check_unique_identity(spark, sf):
    ident = fixtures.channel_identities(spark, sf)
    return CON.duplicates(_with_reimport(ident, F.col("guest_id") % 100 == 0), ["channel", "channel_guest_id"])


def check_primary_keys(spark, sf):
    t = _loaded(spark, sf)
    return CON.primary_key_report(t.rows(), t.counts)


def check_foreign_keys(spark, sf):
    return CON.foreign_key_report(_tables(spark, sf))


def check_not_null(spark, sf):
    return CON.null_report(spark, _loaded(spark, sf).counts)


def apply_defaults(spark, sf):
    """Every cell of the eight tables that a default fills."""
    parts = [CON.defaulted(fixtures.with_empty_cells(df, name), name, DOM.AS_OF) for name, df in _lazy_tables(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)


def check_domains(spark, sf):
    return CON.domain_report(spark, _loaded(spark, sf).counts)


def check_widths(spark, sf):
    return CON.width_report(spark, _loaded(spark, sf).counts)


def _references(spark, tables):
    """(edges of all references, a function that stores a frame), for the deletes."""
    from ..sources.sinks import scratch_path
    folder = scratch_path(spark, "deletes")
    store = lambda df: DOM.materialize(df, folder)
    return store(CAS.edges(tables)), store


def cascade_delete(spark, sf):
    """B24 for the guests without a confirmed reservation."""
    t = _tables(spark, sf)
    refs, store = _references(spark, t)
    unverified = ID.verify_guests(t["guests"], t["reservations"]).filter(~F.col("identity_verified"))
    return CAS.guest_deletes(unverified.select(F.col("id").alias("guest_id")), refs, store)


def cascade_delete_messages(spark, sf):
    """B24 for the messages sent before DELETE_BEFORE: what goes, with its audit rows,
    and what a reference holds back."""
    t = _tables(spark, sf)
    refs, store = _references(spark, t)
    old = t["messages"].filter(F.col("sent_at") < F.lit(DELETE_BEFORE).cast("timestamp_ntz"))
    return CAS.cascade(old.select(F.lit("messages").alias("table_name"), "id"), refs, store)


# --- D -------------------------------------------------------------------------

def overdue_escalations(spark, sf):
    return ESC.overdue_escalations(DOM.escalations(spark, sf), fixtures.guests(spark, sf),
                                   fixtures.properties(spark, sf), DOM.AS_OF)


def complaint_trends(spark, sf):
    f = _flow(spark, sf, *_COMPLAINTS)
    return R.complaint_trends(f.inbound_messages(), f.query_types(), fixtures.properties(spark, sf))


def resolve_booking(spark, sf):
    return ID.resolve_booking(_senders(spark, sf), fixtures.reservations(spark, sf)) \
        .select("message_id", "booking_ref", "reservation_id", "booking_guest_id")


def resolve_channel(spark, sf):
    return ID.resolve_channel(_senders(spark, sf), fixtures.channel_identities(spark, sf)) \
        .select("message_id", "channel_guest_id", "channel_guest")


def unify_guests(spark, sf):
    return _unified(spark, sf).select("message_id", "resolved_guest_id", "resolution")


def provisional_guests(spark, sf):
    return ID.provisional(_unified(spark, sf))


def merge_candidates(spark, sf):
    u = DOM.materialize(_unified(spark, sf).select("message_id", "channel", "channel_guest_id", "guest_name", "sent_at", "resolution",
                                                   "booking_guest_id"), _scratch(spark, "unified"))
    return ID.merge_candidates(ID.provisional(u), u)


def verified_guests(spark, sf):
    return ID.verify_guests(fixtures.guests(spark, sf), fixtures.reservations(spark, sf))


def thread_messages(spark, sf):
    return ID.thread(_senders(spark, sf), fixtures.reservations(spark, sf)).select(
        "thread_id", "guest_id", "channel", "property_id", "reservation_id", "n_messages",
        "opened_at", "last_message_at")


def unaudited_messages(spark, sf):
    f = _flow(spark, sf, *_COMPLAINTS)
    return R.unaudited(f.inbound_messages(), f.query_types())


# --- E -------------------------------------------------------------------------

def recurring_complaints(spark, sf):
    f = _flow(spark, sf, *_COMPLAINTS)
    return R.recurring_complaints(f.inbound_messages(), f.query_types(), n=3, days=60)


def last_message_at(spark, sf):
    return R.conversation_rollup(DOM.messages(spark, sf))


def model_quality(spark, sf):
    return R.model_quality(DOM.ai_metadata(spark, sf))


def processing_latency(spark, sf):
    return R.processing_latency(DOM.ai_metadata(spark, sf))


def sla_report(spark, sf):
    return R.sla_report(DOM.escalations(spark, sf))


def preferred_channel(spark, sf):
    return R.preferred_channel(DOM.messages(spark, sf))


def _cases(spark, sf) -> DataFrame:
    """The payloads as test-case documents, written one per line and read back."""
    from ..sources.inbound import read_cases
    from ..sources.sinks import scratch_path
    path = scratch_path(spark, "cases")
    fixtures.case_documents(spark, sf).write.text(path)
    return read_cases(spark, path, multi_line=False)


def run_summary(spark, sf):
    return R.run_summary(P.case_outcomes(_cases(spark, sf)))


def expectation_diff(spark, sf):
    exp_t = F.element_at(F.array(*[F.lit(t) for t, _ in fixtures.TEMPLATE_EXPECTED]),
                         (F.col("event_id") % 24 + 1).cast("int"))
    exp_a = F.element_at(F.array(*[F.lit(a) for _, a in fixtures.TEMPLATE_EXPECTED]),
                         (F.col("event_id") % 24 + 1).cast("int"))
    cases = _proc(spark, sf).select((F.col("event_id") % 24).alias("case_group"),
                                    exp_t.alias("expected_query_type"), "query_type",
                                    exp_a.alias("expected_action"), "action")
    return R.expectation_diff(cases)


def routing_mix(spark, sf):
    return R.routing_mix(DOM.ai_metadata(spark, sf))


# --- F, G, H -------------------------------------------------------------------

def conversation_history(spark, sf):
    return R.conversation_history(fixtures.conversation_turns(spark, sf), k=3)


def inbox(spark, sf):
    return R.inbox(DOM.messages(spark, sf), n=TOP_N)


def rolling_complaints(spark, sf):
    f = _flow(spark, sf, *_COMPLAINTS)
    return R.rolling_complaints(f.inbound_messages(), f.query_types(), days=60) \
        .select("message_id", "property_id", "topic", "sent_at", "rolling_count")


def trend_order(spark, sf):
    return complaint_trends(spark, sf).limit(TOP_N)


def latest_messages(spark, sf):
    return R.latest(DOM.messages(spark, sf), "sent_at", TOP_N, ["id", "direction", "channel", "sent_at"])


def latest_decisions(spark, sf):
    return R.latest(DOM.ai_metadata(spark, sf), "created_at", TOP_N,
                    ["id", "message_id", "query_type", "action_taken", "created_at"])


def open_sla_queue(spark, sf):
    return R.sla_queue(DOM.escalations(spark, sf), n=TOP_N)


def transcript(spark, sf):
    return R.transcript(fixtures.conversation_turns(spark, sf)).select("conv_id", "turn", "direction", "text")


# --- J, S2 ---------------------------------------------------------------------

def create_escalations(spark, sf):
    return ESC.create_escalations(_proc(spark, sf)).select(
        "id", "message_id", "conversation_id", "guest_id", "property_id", "reason", "severity", "status",
        "escalated_at", "sla_deadline")


def mark_sla_breached(spark, sf):
    return DOM.escalations(spark, sf).select("id", "status", "first_response_at", "sla_deadline", "sla_breached")


def sla_alerts(spark, sf):
    return ESC.sla_alerts(DOM.escalations(spark, sf), DOM.AS_OF)


def final_reply(spark, sf):
    return R.final_reply(DOM.ai_metadata(spark, sf))


def edit_pairs(spark, sf):
    return R.edit_pairs(DOM.ai_metadata(spark, sf))


def maintenance_tickets(spark, sf):
    f = _flow(spark, sf, *_COMPLAINTS)
    return R.maintenance_tickets(f.inbound_messages(), f.query_types())


def pre_arrival_checklist(spark, sf):
    return R.checklists(fixtures.reservations(spark, sf), maintenance_tickets(spark, sf), DOM.CHECKLIST_CLOCK) \
        .select("reservation_id", "property_id", "check_in_at", "items")


def checklist_alerts(spark, sf):
    res = fixtures.reservations(spark, sf)
    lists = R.checklists(res, maintenance_tickets(spark, sf), DOM.CHECKLIST_CLOCK)
    confirmations = res.filter(F.col("checklist_confirmed")).select(F.col("id").alias("reservation_id"))
    return R.checklist_alerts(lists, confirmations, DOM.CHECKLIST_CLOCK)


def stream_rate_limit(spark, sf):
    """The inbound messages replayed as a stream, to its end."""
    from ..streaming.stream import replay_rate_counts
    base = _scratch(spark, "rates")
    with fixtures.dealt_rows(spark):
        m = DOM.messages(spark, sf).filter(F.col("direction") == "inbound").withColumnRenamed("id", "message_id")
    replay_rate_counts(m, base, "1 day", RATE_LIMIT)
    return spark.read.parquet(f"{base}/out")


QUERIES.update({
    "domain_tables": domain_tables,
    "write_responses": write_responses,
    "write_rejects": write_rejects,
    "check_email": check_email,
    "check_stay_dates": check_stay_dates,
    "check_guest_count": check_guest_count,
    "check_direction": check_direction,
    "check_channel": check_channel,
    "check_unique_booking_ref": check_unique_booking_ref,
    "check_unique_identity": check_unique_identity,
    "check_primary_keys": check_primary_keys,
    "check_foreign_keys": check_foreign_keys,
    "check_not_null": check_not_null,
    "apply_defaults": apply_defaults,
    "check_domains": check_domains,
    "check_widths": check_widths,
    "cascade_delete": cascade_delete,
    "cascade_delete_messages": cascade_delete_messages,
    "quarantined_rows": quarantined_rows,
    **{f"table_{name}": _typed_table(name) for name in typed.SCHEMAS},
    "overdue_escalations": overdue_escalations,
    "complaint_trends": complaint_trends,
    "resolve_booking": resolve_booking,
    "resolve_channel": resolve_channel,
    "unify_guests": unify_guests,
    "provisional_guests": provisional_guests,
    "merge_candidates": merge_candidates,
    "verified_guests": verified_guests,
    "thread_messages": thread_messages,
    "unaudited_messages": unaudited_messages,
    "recurring_complaints": recurring_complaints,
    "last_message_at": last_message_at,
    "model_quality": model_quality,
    "processing_latency": processing_latency,
    "sla_report": sla_report,
    "preferred_channel": preferred_channel,
    "run_summary": run_summary,
    "expectation_diff": expectation_diff,
    "routing_mix": routing_mix,
    "conversation_history": conversation_history,
    "inbox": inbox,
    "rolling_complaints": rolling_complaints,
    "trend_order": trend_order,
    "latest_messages": latest_messages,
    "latest_decisions": latest_decisions,
    "open_sla_queue": open_sla_queue,
    "transcript": transcript,
    "create_escalations": create_escalations,
    "mark_sla_breached": mark_sla_breached,
    "sla_alerts": sla_alerts,
    "final_reply": final_reply,
    "edit_pairs": edit_pairs,
    "maintenance_tickets": maintenance_tickets,
    "pre_arrival_checklist": pre_arrival_checklist,
    "checklist_alerts": checklist_alerts,
    "stream_rate_limit": stream_rate_limit,
})


# --- A3, B6, C4, D1, E1, S1, S3 ---------------------------------------------------------

def enrich_property(spark, sf):
    j = _with_props(_ok(spark, sf), fixtures.properties(spark, sf))
    return j.select("message_id", "property_id", F.col("p_name").alias("property_name"),
                    F.col("p_id").isNotNull().alias("property_known"))


def _typed_raw(spark, sf):
    """Payloads where some channels send typed JSON: error events carry their
    ``props`` object in booking_ref (a planted type violation)."""
    inb = fixtures.inbound_events(spark, sf, keep=["event_type", "props"])
    ref = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.concat(F.lit('"'), F.col("booking_ref"), F.lit('"')))
    body = F.to_json(F.struct("source", "guest_name", "message", "timestamp", "property_id"))
    bare = inb.select("message_id", F.inline(F.array(F.struct(body.alias("_body_text"), ref.alias("_ref")))))  # rendered once
    raw = F.when(F.col("_ref").isNull(), F.col("_body_text")).otherwise(
        F.concat(F.expr("substring(_body_text, 1, length(_body_text) - 1)"), F.lit(',"booking_ref":'), F.col("_ref"), F.lit("}")))
    inb = bare
    return inb.select("message_id", raw.alias("raw"))


def check_string_types(spark, sf):
    bad = split_valid(with_validation(parse_payload(_typed_raw(spark, sf), check_types=True)))[1]
    return (bad.select("message_id", F.explode(F.filter("errors", lambda e: e["issue"] == MSG_NOT_STRING)).alias("e"))
            .select("message_id", F.col("e.field").alias("field"), F.col("e.issue").alias("issue"),
                    F.col("e.received").alias("received")))


def fixture_cases(spark, sf):
    """A3: every case of the case documents, its payload as it came."""
    return _cases(spark, sf).select("case_id", "expected_status", "expected_query_type", "expected_action", *PAYLOAD)


def case_outcomes(spark, sf):
    """The status each case gets, beside the expected one."""
    return P.case_outcomes(_cases(spark, sf)).select("case_id", "expected_status", "status", "n_errors", "query_type", "action")


def stream_process_q(spark, sf):
    """S1 over the payloads as keyed deliveries."""
    from ..streaming.stream import stream_process, write_deliveries
    base = _scratch(spark, "stream")
    inb = fixtures.inbound_events(spark, sf)
    write_deliveries(inb.select(F.col("message_id").alias("key"), F.to_json(F.struct(*PAYLOAD)).alias("value")), f"{base}/in")
    stream_process(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out/responses").select(*P.RESPONSE_COLUMNS)


def stream_sla_timer(spark, sf):
    """S3: the breaches (level 2 of the alerts) of the whole history, in one run."""
    from ..streaming.alerts import event_log, replay_alerts
    base = _scratch(spark, "sla")
    with fixtures.dealt_rows(spark):
        esc = DOM.escalations(spark, sf)
    replay_alerts(event_log(esc), base)
    out = spark.read.parquet(f"{base}/out").where("level = 2")
    return out.select("escalation_id", F.col("alert_at").cast("timestamp_ntz").alias("sla_deadline"))


def stream_sla_alerts(spark, sf):
    """Both alert levels, in two runs; every 13th opening reaches the log three
    days late, most of them after their deadline."""
    from ..streaming.alerts import event_log, replay_alerts
    base = _scratch(spark, "alerts")
    late = F.when(F.col("event_id") % 13 == 0, F.expr("timestampadd(DAY, 3, escalated_at)")).otherwise(F.col("escalated_at"))
    with fixtures.dealt_rows(spark):
        esc = DOM.escalations(spark, sf)
    replay_alerts(event_log(esc, late), base, cuts=["2024-03-15 00:00:00"])
    return spark.read.parquet(f"{base}/out").select("escalation_id", "level", "recipient", F.col("alert_at").cast("timestamp_ntz").alias("alert_at"))


def recurring_complaints_weekly(spark, sf):
    """E1 as two runs of the weekly job: the weeks before 2024-04-01, then the rest."""
    from .weekly import monday, patterns, run_weeks
    import datetime as dt
    f = _flow(spark, sf, *_COMPLAINTS)
    m, ai, folder = f.inbound_messages(), f.query_types(), _scratch(spark, "weekly")
    span = m.agg(F.min("sent_at"), F.max("sent_at")).first()
    if span[0] is not None:
        cuts = sorted({monday(span[0].date()), dt.date(2024, 4, 1), monday(span[1].date()) + dt.timedelta(days=7)})
        for first, end in zip(cuts, cuts[1:]):
            run_weeks(m, ai, folder, first, end)
    return patterns(spark, folder)


def random_ids(spark, sf):
    """C4, random form: how many deliveries and different ids, and how many have a UUID's shape."""
    from ..sources.inbound import pinned_ids
    ids = pinned_ids(fixtures.inbound_raw(spark, sf).select("raw"), _scratch(spark, "ids"))
    uuid4 = F.col("message_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    per_id = ids.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.sum("n").alias("n_messages"), F.count(F.lit(1)).alias("n_ids"), F.count_if(uuid4).alias("n_uuids"))


QUERIES.update({
    "enrich_property": enrich_property,
    "check_string_types": check_string_types,
    "fixture_cases": fixture_cases,
    "case_outcomes": case_outcomes,
    "stream_process": stream_process_q,
    "stream_sla_timer": stream_sla_timer,
    "stream_sla_alerts": stream_sla_alerts,
    "recurring_complaints_weekly": recurring_complaints_weekly,
    "random_ids": random_ids,
})
