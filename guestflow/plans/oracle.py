"""Independent DuckDB SQL for the correctness check.

The adapters of FIXTURES.md are written once here as named CTEs; each oracle
query names the CTEs it needs and ``sql()`` emits them in dependency order.
Rule-driven fragments (classification, scores) are generated from the same
fixed rule tables, so the rules are stated once.
"""
from __future__ import annotations

import re

from ..functions.rules import (AMBIGUITY_PHRASES, BASE_SCORE_CENTS, CHANNELS, CLASS_RULES,
                               COMPLAINT_TOPICS, CONFIDENCE_BANDS, DEFAULT_MODEL, DEFAULT_SCORE_CENTS,
                               FALLBACK_CLASS, FALLBACK_REPLY_HEAD, FALLBACK_REPLY_TAIL,
                               MAX_REPLY_TOKENS, MODEL_VERSIONS, MULTI_INTENT_PAIRS,
                               NO_BOOKING_TEXT, NO_PROPERTY_TEXT, SYSTEM_PROMPT, BAND_BELOW,
                               BAND_COMPLAINT, OTHER_TOPIC, MISSING_FACT, PROMPT_LINES,
                               PROPERTY_LINES)
from ..operators.validate import (ISO_SHAPE, MSG_BAD_DATETIME, MSG_BAD_SOURCE, MSG_MISSING,
                                  MSG_TOO_SHORT, field_path)
from ..sources.fixtures import MESSAGE_TEMPLATES

AS_OF_TEXT = "2024-04-01 00:00:00"
AS_OF = f"TIMESTAMP '{AS_OF_TEXT}'"
CHECKLIST_CLOCK = "TIMESTAMP '2024-04-01 08:00:00'"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def any_contains(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def classify_sql(low: str, rules=CLASS_RULES, fallback=FALLBACK_CLASS) -> str:
    whens = " ".join(f"WHEN {any_contains(low, words)} THEN {q(name)}" for name, words in rules)
    return f"(CASE {whens} ELSE {q(fallback)} END)"


def base_sql(qt: str) -> str:
    whens = " ".join(f"WHEN {qt} = {q(k)} THEN {v}" for k, v in BASE_SCORE_CENTS.items())
    return f"(CASE {whens} ELSE {DEFAULT_SCORE_CENTS} END)"


def multi_sql(low: str) -> str:
    return "(" + " OR ".join("(" + " AND ".join(f"contains({low}, {q(t)})" for t in pair) + ")"
                             for pair in MULTI_INTENT_PAIRS) + ")"


def ambig_sql(low: str) -> str:
    return any_contains(low, AMBIGUITY_PHRASES)


def cents_sql(qt: str, low: str) -> str:
    raw = (f"({base_sql(qt)} - CASE WHEN {multi_sql(low)} THEN 8 ELSE 0 END"
           f" - CASE WHEN {ambig_sql(low)} THEN 10 ELSE 0 END)")
    return f"(CASE WHEN {qt} = 'complaint' THEN 40 ELSE least(greatest({raw}, 10), 100) END)"


def action_sql(cents: str, qt: str) -> str:
    return (f"(CASE WHEN {qt} = 'complaint' THEN 'escalate' WHEN {cents} >= 85 THEN 'auto_send' "
            f"WHEN {cents} >= 60 THEN 'agent_review' ELSE 'escalate' END)")


def band_sql(cents: str, qt: str) -> str:
    whens = " ".join(f"WHEN {cents} >= {lo} THEN {q(name)}" for lo, name in CONFIDENCE_BANDS)
    return f"(CASE WHEN {qt} = 'complaint' THEN {q(BAND_COMPLAINT)} {whens} ELSE {q(BAND_BELOW)} END)"


def topic_sql(low: str) -> str:
    whens = " ".join(f"WHEN contains({low}, {q(t)}) THEN {q(t)}" for t in COMPLAINT_TOPICS)
    return f"(CASE {whens} ELSE {q(OTHER_TOPIC)} END)"


def _json_field(name: str) -> str:
    return f"CASE WHEN {name} IS NOT NULL THEN '\"{name}\":\"' || {name} || '\"' END"


_TEMPLATES = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(MESSAGE_TEMPLATES))
_PAYLOAD = ["source", "guest_name", "message", "timestamp", "booking_ref", "property_id"]
_FALLBACK = f"{q(FALLBACK_REPLY_HEAD)} || first_name || {q(FALLBACK_REPLY_TAIL)}"

# name -> (dependencies, body)
CTES: dict[str, tuple[list[str], str]] = {
    "templates": ([], f"SELECT * FROM (VALUES {_TEMPLATES}) AS t(i, msg)"),
    "inbound": (["templates"], f"""
        SELECT e.event_id, e.user_id AS guest_id, e.value AS event_value,
          'm-' || CAST(e.event_id AS VARCHAR) AS message_id,
          CASE WHEN e.event_id % 53 = 0 THEN 'telegram' ELSE {lst(CHANNELS)}[e.event_id % 5 + 1] END AS source,
          CASE WHEN e.event_id % 59 = 0 THEN '' WHEN e.event_id % 61 = 0 THEN '   '
               ELSE 'Guest' || CAST(e.user_id AS VARCHAR) || ' Family' END AS guest_name,
          CASE WHEN e.event_id % 47 = 0 THEN '' ELSE t.msg END AS message,
          CASE WHEN e.event_id % 43 = 0 THEN 'not-a-timestamp'
               ELSE strftime(e.ts + to_days(CAST(e.event_id % 180 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS timestamp,
          CASE WHEN e.event_id % 11 < 3 THEN NULL WHEN e.event_id % 37 = 0 THEN ''
               ELSE 'BK-' || CAST((e.event_id * 7) % 20000 AS VARCHAR) END AS booking_ref,
          CASE WHEN e.event_id % 67 = 0 THEN NULL WHEN e.event_id % 41 = 0 THEN 'villa-unknown'
               ELSE 'villa-' || CAST(e.user_id % 25 AS VARCHAR) END AS property_id
        FROM events e JOIN templates t ON t.i = e.event_id % 24"""),
    "parsed": (["inbound"], f"""
        SELECT *,
          '{{' || concat_ws(',', {', '.join(_json_field(n) for n in _PAYLOAD)}) || '}}' AS raw,
          CASE WHEN regexp_matches(timestamp, {q(ISO_SHAPE)}) THEN try_cast(timestamp AS TIMESTAMP) END AS sent_at,
          NULLIF(regexp_extract(guest_name, '^\\s*(\\S+)', 1), '') AS first_name
        FROM inbound"""),
    "errs": (["parsed"], f"""
        SELECT message_id, 1 AS rule_ord, {q(field_path('source'))} AS field, {q(MSG_MISSING)} AS issue, raw AS received FROM parsed WHERE source IS NULL
        UNION ALL SELECT message_id, 2, {q(field_path('source'))}, {q(MSG_BAD_SOURCE)}, source FROM parsed WHERE source IS NOT NULL AND source NOT IN ({', '.join(q(c) for c in CHANNELS)})
        UNION ALL SELECT message_id, 3, {q(field_path('guest_name'))}, {q(MSG_MISSING)}, raw FROM parsed WHERE guest_name IS NULL
        UNION ALL SELECT message_id, 4, {q(field_path('guest_name'))}, {q(MSG_TOO_SHORT)}, guest_name FROM parsed WHERE length(guest_name) < 1
        UNION ALL SELECT message_id, 5, {q(field_path('message'))}, {q(MSG_MISSING)}, raw FROM parsed WHERE message IS NULL
        UNION ALL SELECT message_id, 6, {q(field_path('message'))}, {q(MSG_TOO_SHORT)}, message FROM parsed WHERE length(message) < 1
        UNION ALL SELECT message_id, 7, {q(field_path('timestamp'))}, {q(MSG_MISSING)}, raw FROM parsed WHERE timestamp IS NULL
        UNION ALL SELECT message_id, 8, {q(field_path('timestamp'))}, {q(MSG_BAD_DATETIME)}, timestamp FROM parsed WHERE timestamp IS NOT NULL AND sent_at IS NULL
        UNION ALL SELECT message_id, 9, {q(field_path('property_id'))}, {q(MSG_MISSING)}, raw FROM parsed WHERE property_id IS NULL"""),
    "checked": (["parsed", "errs"], """
        SELECT p.*, COALESCE(n.n_errors, 0) AS n_errors
        FROM parsed p LEFT JOIN (SELECT message_id, count(*) AS n_errors FROM errs GROUP BY message_id) n
          ON p.message_id = n.message_id"""),
    "ok": (["checked"], "SELECT * FROM checked WHERE n_errors = 0 AND first_name IS NOT NULL"),
    "decided": (["ok"], f"SELECT *, {classify_sql('lower(message)')} AS query_type FROM ok"),
    "scored": (["decided"], f"SELECT *, {cents_sql('query_type', 'lower(message)')} AS score_cents FROM decided"),
    "proc": (["scored"], f"""
        SELECT *, CAST(score_cents AS DOUBLE) / 100.0 AS confidence_score,
          {action_sql('score_cents', 'query_type')} AS action,
          {_FALLBACK} AS drafted_reply
        FROM scored"""),
    "properties": ([], """
        SELECT 'villa-' || CAST(n.n_nationkey AS VARCHAR) AS id, n.n_name AS name, r.r_name AS location,
          CAST(1 + n.n_nationkey % 5 AS INTEGER) AS bedrooms, CAST(2 * (1 + n.n_nationkey % 5) AS INTEGER) AS max_guests,
          n.n_nationkey % 2 = 0 AS private_pool, '14:00:00' AS check_in_time, '11:00:00' AS check_out_time,
          CAST(8000 + 500 * n.n_nationkey AS DECIMAL(10,2)) AS base_rate_inr,
          CAST(1000 + 100 * n.n_nationkey AS DECIMAL(10,2)) AS extra_guest_rate_inr,
          CASE WHEN n.n_nationkey % 6 = 0 THEN NULL ELSE 'stay-' || CAST(n.n_nationkey AS VARCHAR) || '-wifi' END AS wifi_password,
          '8:00 AM to 10:00 PM' AS caretaker_hours, n.n_nationkey % 3 = 0 AS chef_available,
          CASE WHEN n.n_nationkey % 4 = 0 THEN 'Booked' ELSE 'Available' END AS availability_april_20_24,
          'Free cancellation up to 7 days before check-in' AS cancellation_policy, TRUE AS is_active
        FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "guests": ([], """
        SELECT c_custkey AS id, c_name AS full_name,
          CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 10 = 7 THEN c_name || '@example.org'
               ELSE replace(c_name, '#', '') || '@example.org' END AS email,
          CASE WHEN c_custkey % 2 = 0 THEN '+91 98' ELSE '098' END || lpad(CAST(c_custkey // 2 AS VARCHAR), 8, '0') AS phone,
          c_nationkey AS nationkey, CAST(NULL AS VARCHAR) AS preferred_channel
        FROM customer"""),
    "identities": ([], f"""
        SELECT 'gci-' || ch.channel || '-' || CAST(c.c_custkey AS VARCHAR) AS id, c.c_custkey AS guest_id, ch.channel,
          ch.channel || ':' || CAST(c.c_custkey AS VARCHAR) AS channel_guest_id, c.c_name AS channel_display_name
        FROM customer c CROSS JOIN (SELECT * FROM (VALUES {', '.join(f'({i}, {q(ch)})' for i, ch in enumerate(CHANNELS))}) AS x(ch_idx, channel)) ch
        WHERE (c.c_custkey + ch.ch_idx) % 3 <> 0"""),
    "reservations": ([], f"""
        SELECT 'res-' || CAST(o_orderkey AS VARCHAR) AS id, 'BK-' || CAST(o_orderkey AS VARCHAR) AS booking_ref,
          o_custkey AS guest_id, 'villa-' || CAST(o_custkey % 25 AS VARCHAR) AS property_id,
          {lst(CHANNELS)}[o_orderkey % 5 + 1] AS channel,
          CAST(DATE '2024-01-01' + CAST(o_orderkey % 180 AS INTEGER) AS DATE) AS check_in_date,
          CAST(DATE '2024-01-01' + CAST(o_orderkey % 180 + o_orderkey % 8 AS INTEGER) AS DATE) AS check_out_date,
          CAST(o_orderkey % 7 AS INTEGER) AS num_guests, CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount_inr,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'confirmed' WHEN 'P' THEN 'cancelled' ELSE 'no_show' END AS status,
          o_orderkey % 7 < 4 AS checklist_confirmed
        FROM orders"""),
    "valid": (["checked"], "SELECT * FROM checked WHERE n_errors = 0"),
    "vdec": (["valid"], f"""
        SELECT *, CAST({cents_sql('query_type', 'lower(message)')} AS INTEGER) AS score_cents,
          {action_sql(cents_sql('query_type', 'lower(message)'), 'query_type')} AS action,
          {_FALLBACK} AS drafted_reply
        FROM (SELECT *, {classify_sql('lower(message)')} AS query_type FROM valid)"""),
    "messages": (["vdec"], """
        SELECT message_id AS id, CAST(guest_id AS VARCHAR) || '|' || source || '|' || property_id AS conversation_id,
          guest_id, property_id, 'inbound' AS direction, source AS channel, message AS raw_content, sent_at,
          'received' AS delivery_status, event_id, booking_ref, CASE WHEN first_name IS NOT NULL THEN action END AS action
        FROM vdec
        UNION ALL
        SELECT message_id || '-r', CAST(guest_id AS VARCHAR) || '|' || source || '|' || property_id,
          guest_id, property_id, 'outbound', source, drafted_reply, sent_at + INTERVAL 3 SECOND, 'sent', event_id, booking_ref, action
        FROM vdec WHERE action = 'auto_send' AND first_name IS NOT NULL"""),
    "conversations": (["messages"], """
        SELECT conversation_id AS id, min(guest_id) AS guest_id, min(property_id) AS property_id, min(channel) AS channel,
          min(sent_at) AS opened_at, max(sent_at) AS last_message_at, CAST(NULL AS VARCHAR) AS subject,
          'res-' || CAST(min(try_cast(substr(booking_ref, 4) AS BIGINT)) AS VARCHAR) AS reservation_id,
          CASE WHEN min(guest_id) % 50 = 7 THEN 'parked' WHEN bool_or(action = 'escalate') THEN 'escalated' WHEN bool_or(action = 'agent_review') THEN 'waiting_team'
               WHEN bool_or(action = 'auto_send') THEN 'waiting_guest' ELSE 'open' END AS status
        FROM messages GROUP BY conversation_id"""),
    "ai": (["proc"], f"""
        SELECT 'ai-' || CAST(event_id AS VARCHAR) AS id, message_id, query_type, drafted_reply AS ai_drafted_reply,
          CAST(confidence_score AS DECIMAL(4,3)) AS confidence_score, action AS action_taken,
          CASE WHEN action = 'agent_review' AND event_id % 5 = 0 THEN drafted_reply || ' We look forward to hosting you.' END AS agent_edited_reply,
          CAST(NULL AS VARCHAR) AS final_reply_sent, 
          CASE WHEN action = 'agent_review' AND event_id % 3 <> 0 THEN CASE WHEN event_id % 30 = 1 THEN -1 ELSE event_id % 2000 + 1 END END AS reviewed_by_agent,
          CASE WHEN action = 'agent_review' AND event_id % 3 <> 0 THEN sent_at + INTERVAL 10 MINUTE END AS reviewed_at,
          CASE WHEN action = 'escalate' THEN sent_at END AS escalated_at,
          CASE WHEN action = 'auto_send' THEN sent_at + INTERVAL 3 SECOND END AS auto_sent_at,
          {lst(MODEL_VERSIONS)}[event_id % {len(MODEL_VERSIONS)} + 1] AS model_version,
          CAST(floor(event_value * 10) AS INTEGER) AS processing_time_ms, sent_at AS created_at, event_id
        FROM proc"""),
    "escalations": (["proc"], f"""
        SELECT 'esc-' || CAST(event_id AS VARCHAR) AS id, message_id,
          CAST(guest_id AS VARCHAR) || '|' || source || '|' || property_id AS conversation_id, guest_id, property_id,
          CASE WHEN query_type = 'complaint' THEN 'complaint' ELSE 'low_confidence' END AS reason,
          CASE WHEN query_type = 'complaint' THEN 'critical' ELSE 'medium' END AS severity,
          ['open', 'closed', 'assigned', 'resolved', 'in_progress', 'closed', 'resolved'][event_id % 7 + 1] AS status,
          sent_at AS escalated_at,
          CASE WHEN event_id % 7 IN (0, 1, 2) THEN NULL
               ELSE sent_at + to_seconds(CAST(floor(event_value * 60) AS BIGINT)) END AS first_response_at,
          CASE WHEN query_type = 'complaint' THEN sent_at + INTERVAL 30 MINUTE ELSE sent_at + INTERVAL 24 HOUR END AS sla_deadline,
          event_id, query_type, message, CAST(NULL AS VARCHAR) AS assigned_to
        FROM proc WHERE action = 'escalate'"""),
    "esc_marked": (["escalations"], f"""
        SELECT *, (first_response_at IS NOT NULL AND first_response_at > sla_deadline)
                  OR (first_response_at IS NULL AND sla_deadline < {AS_OF}) AS sla_breached
        FROM escalations"""),
    "turns": ([], """
        SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'inbound' ELSE 'outbound' END AS direction, text
        FROM conversations WHERE role IN ('user', 'assistant')"""),
}


def sql(needs: list[str], body: str) -> str:
    """``WITH`` the named CTEs (and their dependencies, in order) + ``body``."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


def _txt(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), {q(MISSING_FACT)})"


def _yn(c: str) -> str:
    return f"(CASE WHEN {c} THEN 'Yes' ELSE 'No' END)"


def render_sql(template: str, values: dict) -> str:
    """SQL for a fixed line template with ``{name}`` slots."""
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(q(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    if pos < len(template) or not parts:
        parts.append(q(template[pos:]))
    return " || ".join(parts)


def property_text_sql(p: str = "p") -> str:
    values = {n: (_yn(f"{p}.{n}") if n in ("private_pool", "chef_available") else _txt(f"{p}.{n}"))
              for line in PROPERTY_LINES for n in re.findall(r"\{(\w+)\}", line)}
    lines = [render_sql(line, values) for line in PROPERTY_LINES]
    return f"(CASE WHEN {p}.id IS NULL THEN {q(NO_PROPERTY_TEXT)} ELSE concat_ws(chr(10), {', '.join(lines)}) END)"


def prompt_sql(p: str = "p") -> str:
    values = {"first_name": "d.first_name", "source": "d.source", "query_type": "d.query_type",
              "booking_ref": f"coalesce(nullif(d.booking_ref, ''), {q(NO_BOOKING_TEXT)})",
              "property_text": property_text_sql(p), "message": "d.message"}
    return f"concat_ws(chr(10), {', '.join(render_sql(line, values) for line in PROMPT_LINES)})"


_EXPLAIN_HITS = ", ".join(f"CASE WHEN contains(lower(text), {q(w)}) THEN {q(name + ':' + w)} END"
                          for name, words in CLASS_RULES for w in words)
_EXPLAIN_CLASSES = ", ".join(f"CASE WHEN {any_contains('lower(text)', words)} THEN {q(name)} END"
                             for name, words in CLASS_RULES)
_FIRST_KW = "CASE " + " ".join(f"WHEN contains(lower(text), {q(w)}) THEN {q(w)}"
                               for _, words in CLASS_RULES for w in words) + " END"
_ALL_KW = any_contains("lower(text)", [w for _, words in CLASS_RULES for w in words])
_ERR_ROWS = ("SELECT message_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY rule_ord) - 1 AS INTEGER)"
             " AS detail_index, field, issue, received FROM errs")
_CTX_PEN = (f"(CASE WHEN (d.query_type = 'post_sales_checkin' AND {any_contains('lower(d.message)', ['wifi', 'wi-fi', 'password'])}"
            " AND p.wifi_password IS NULL) OR (p.id IS NULL AND d.query_type <> 'complaint') THEN 25 ELSE 0 END)")
_CTX_ADJ = f"(CASE WHEN d.query_type = 'complaint' THEN d.score_cents ELSE greatest(d.score_cents - {_CTX_PEN}, 10) END)"
_PHONE = ("CASE WHEN phone IS NULL OR length(regexp_replace(phone, '[^0-9]', '', 'g')) = 0 THEN NULL "
          "WHEN starts_with(trim(phone), '+') THEN '+' || regexp_replace(phone, '[^0-9]', '', 'g') "
          "WHEN starts_with(regexp_replace(phone, '[^0-9]', '', 'g'), '00') THEN '+' || substr(regexp_replace(phone, '[^0-9]', '', 'g'), 3) "
          "WHEN starts_with(regexp_replace(phone, '[^0-9]', '', 'g'), '0') THEN '+91' || substr(regexp_replace(phone, '[^0-9]', '', 'g'), 2) "
          "WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) = 10 THEN '+91' || regexp_replace(phone, '[^0-9]', '', 'g') "
          "ELSE '+' || regexp_replace(phone, '[^0-9]', '', 'g') END")

ORACLE: dict[str, str] = {
    "ingest_messages": sql(["parsed"], "SELECT message_id, raw, source, guest_name, message, timestamp, booking_ref, property_id FROM parsed"),
    "property_dim": sql(["properties"], "SELECT * FROM properties"),
    "ai_audit_records": sql(["proc"], f"""SELECT message_id, query_type, drafted_reply AS ai_drafted_reply, confidence_score,
        action AS action_taken, {q(DEFAULT_MODEL)} AS model_version, CAST(floor(event_value * 10) AS INTEGER) AS processing_time_ms,
        CASE WHEN action = 'escalate' THEN sent_at END AS escalated_at, CASE WHEN action = 'auto_send' THEN sent_at + INTERVAL 3 SECOND END AS auto_sent_at,
        sent_at AS created_at FROM proc"""),
    "check_required": sql(["errs"], f"SELECT * FROM ({_ERR_ROWS}) WHERE issue = {q(MSG_MISSING)}"),
    "check_source_enum": sql(["errs"], f"SELECT * FROM ({_ERR_ROWS}) WHERE issue = {q(MSG_BAD_SOURCE)}"),
    "check_min_length": sql(["errs"], f"SELECT * FROM ({_ERR_ROWS}) WHERE issue = {q(MSG_TOO_SHORT)}"),
    "check_timestamp": sql(["parsed"], "SELECT message_id, timestamp, sent_at, sent_at IS NOT NULL AS timestamp_valid FROM parsed"),
    "default_booking_ref": sql(["checked"], "SELECT message_id, booking_ref, booking_ref IS NOT NULL AS has_booking_ref FROM checked WHERE n_errors = 0"),
    "error_details": sql(["errs"], f"""SELECT message_id, 'Request validation failed' AS error, detail_index, field, issue, received,
        {q('Check field types, required fields, and enum values against the schema at /docs')} AS hint FROM ({_ERR_ROWS})"""),
    "split_valid": sql(["checked"], """SELECT message_id, CASE WHEN n_errors > 0 THEN 'rejected' WHEN first_name IS NULL
        THEN 'processing_error' ELSE 'response' END AS outcome, CAST(n_errors AS BIGINT) AS n_errors FROM checked"""),
    "blank_name_failure": sql(["checked"], "SELECT message_id, guest_name, 'blank_guest_name' AS processing_error FROM checked WHERE n_errors = 0 AND first_name IS NULL"),
    "check_response": sql(["proc"], """SELECT message_id, CAST((CASE WHEN confidence_score IS NULL OR confidence_score < 0 OR confidence_score > 1 THEN 1 ELSE 0 END)
        + (CASE WHEN action IN ('auto_send', 'agent_review', 'escalate') THEN 0 ELSE 1 END)
        + (CASE WHEN query_type IN ('complaint', 'pre_sales_availability', 'pre_sales_pricing', 'post_sales_checkin', 'special_request', 'general_enquiry') THEN 0 ELSE 1 END) AS BIGINT) AS n_violations FROM proc"""),
    "classify": f"SELECT doc_id, {classify_sql('lower(text)')} AS query_type FROM documents",
    "classify_explain": f"""SELECT doc_id, {classify_sql('lower(text)')} AS query_type,
        CASE WHEN {_ALL_KW} THEN 'keyword' ELSE 'fallback' END AS matched_by, {_FIRST_KW} AS keyword,
        concat_ws(',', {_EXPLAIN_CLASSES}) AS matched_classes, concat_ws(',', {_EXPLAIN_HITS}) AS matched_keywords
        FROM documents""",
    "normalize": sql(["decided"], "SELECT message_id, source, guest_name, message AS message_text, sent_at AS timestamp, booking_ref, property_id, query_type FROM decided"),
    "message_id": sql(["parsed"], """SELECT message_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS stable_id
        FROM (SELECT message_id, sha256(raw) AS h FROM parsed)"""),
    "first_name": sql(["parsed"], "SELECT message_id, guest_name, first_name FROM parsed"),
    "booking_ref_label": sql(["ok"], f"SELECT message_id, booking_ref, coalesce(nullif(booking_ref, ''), {q(NO_BOOKING_TEXT)}) AS booking_ref_label FROM ok"),
    "property_text": sql(["ok", "properties"], f"SELECT d.message_id, d.property_id, {property_text_sql('p')} AS property_text FROM ok d LEFT JOIN properties p ON d.property_id = p.id"),
    "user_prompt": sql(["decided", "properties"], f"SELECT d.message_id, {prompt_sql('p')} AS prompt FROM decided d LEFT JOIN properties p ON d.property_id = p.id"),
    "prompt_requests": sql(["decided", "properties"], f"""SELECT d.message_id, {q(DEFAULT_MODEL)} AS model, {MAX_REPLY_TOKENS} AS max_tokens,
        {q(SYSTEM_PROMPT)} AS system, 'user' AS role, {prompt_sql('p')} AS content FROM decided d LEFT JOIN properties p ON d.property_id = p.id"""),
    "base_score": sql(["decided"], f"SELECT message_id, query_type, CAST({base_sql('query_type')} AS DOUBLE) / 100.0 AS base_score FROM decided"),
    "multi_intent_penalty": sql(["ok"], f"SELECT message_id, CASE WHEN {multi_sql('lower(message)')} THEN 0.08 ELSE 0.0 END::DOUBLE AS multi_intent_penalty FROM ok"),
    "ambiguity_penalty": sql(["ok"], f"SELECT message_id, CASE WHEN {ambig_sql('lower(message)')} THEN 0.10 ELSE 0.0 END::DOUBLE AS ambiguity_penalty FROM ok"),
    "confidence": sql(["proc"], "SELECT message_id, query_type, confidence_score FROM proc"),
    "route_action": sql(["proc"], "SELECT message_id, query_type, confidence_score, action FROM proc"),
    "fallback_reply": sql(["ok"], f"SELECT message_id, first_name, {_FALLBACK} AS fallback_reply FROM ok"),
    "draft_replies": sql(["proc"], "SELECT message_id, drafted_reply, CAST(NULL AS VARCHAR) AS draft_error FROM proc"),
    "process_messages": sql(["proc"], "SELECT message_id, query_type, drafted_reply, confidence_score, action FROM proc"),
    "reply_preview": sql(["proc"], "SELECT message_id, substr(drafted_reply, 1, 80) || '...' AS reply_preview FROM proc"),
    "confidence_band": sql(["proc"], f"SELECT message_id, confidence_score, {band_sql('score_cents', 'query_type')} AS confidence_band FROM proc"),
    "context_confidence": sql(["scored", "properties"], f"""SELECT d.message_id, CAST({_CTX_PEN} AS DOUBLE) / 100.0 AS context_penalty,
        CAST({_CTX_ADJ} AS DOUBLE) / 100.0 AS adjusted_score, {action_sql(_CTX_ADJ, 'd.query_type')} AS adjusted_action
        FROM scored d LEFT JOIN properties p ON d.property_id = p.id"""),
    "normalize_phone": sql(["guests"], f"SELECT id, phone, {_PHONE} AS phone_e164 FROM guests"),
    "lang_rules": f"SELECT doc_id, lang, CASE WHEN lang = 'en' THEN {classify_sql('lower(text)')} ELSE 'general_enquiry' END AS query_type FROM documents",
}


# ---------------------------------------------------------------------------
# Batch 2: domain tables, constraints, reports, jobs

from ..operators.constraints import (DOMAINS, EMAIL_PATTERN, FOREIGN_KEYS, NOT_NULL, NUMERICS,  # noqa: E402
                                     WIDTHS, DEFAULTS)
from ..operators.reports import BASE_CHECKLIST, TOPIC_CHECK  # noqa: E402
from ..sources.fixtures import LEFT_EMPTY, TEMPLATE_EXPECTED, WRONG_VALUES  # noqa: E402
from ..sources.typed import SCHEMAS  # noqa: E402

CTES.update({
    # test cases: payload texts with the planted wrong types, and what each case expects
    "cases": (["inbound"], f"""
        SELECT event_id, message_id AS case_id, source, timestamp,
          CASE WHEN event_id % 71 = 0 THEN '5' ELSE message END AS message,
          CASE WHEN event_id % 73 = 0 THEN '{{"ref":"BK-1"}}' ELSE booking_ref END AS booking_ref,
          CASE WHEN event_id % 79 = 0 THEN NULL ELSE guest_name END AS guest_name,
          CASE WHEN event_id % 83 = 0 THEN 'true' ELSE property_id END AS property_id,
          CASE WHEN 0 IN (event_id % 43, event_id % 47, event_id % 53, event_id % 59, event_id % 67, event_id % 71, event_id % 73,
                          event_id % 79, event_id % 83, event_id % 89) THEN 422 ELSE 200 END AS expected_status,
          CASE WHEN event_id % 3 <> 0 THEN {lst(t for t, _ in TEMPLATE_EXPECTED)}[event_id % 24 + 1] END AS expected_query_type,
          CASE WHEN event_id % 3 <> 0 THEN {lst(a for _, a in TEMPLATE_EXPECTED)}[event_id % 24 + 1] END AS expected_action
        FROM inbound"""),
    "case_checked": (["cases"], f"""
        SELECT *, CASE WHEN n_errors > 0 THEN 422 WHEN NOT regexp_matches(guest_name, '\\S') THEN 500 ELSE 200 END AS status
        FROM (SELECT *, (CASE WHEN source NOT IN ({', '.join(q(c) for c in CHANNELS)}) THEN 1 ELSE 0 END)
          + (CASE WHEN event_id % 79 = 0 OR guest_name = '' THEN 1 ELSE 0 END)
          + (CASE WHEN event_id % 71 = 0 OR message = '' THEN 1 ELSE 0 END)
          + (CASE WHEN timestamp = 'not-a-timestamp' THEN 1 ELSE 0 END)
          + (CASE WHEN event_id % 73 = 0 THEN 1 ELSE 0 END)
          + (CASE WHEN event_id % 83 = 0 OR property_id IS NULL THEN 1 ELSE 0 END) AS n_errors FROM cases)"""),
    "case_answers": (["case_checked"], f"""
        SELECT * EXCLUDE (query_type), CASE WHEN status = 200 THEN query_type END AS query_type,
          CASE WHEN status = 200 THEN {action_sql(cents_sql('query_type', 'lower(message)'), 'query_type')} END AS action
        FROM (SELECT *, {classify_sql('lower(message)')} AS query_type FROM case_checked)"""),
    "tbl_properties": (["properties"], "SELECT * FROM properties"),
    "senders": (["proc"], """SELECT message_id, source AS channel, guest_id, booking_ref, guest_name, sent_at, property_id,
        source || ':' || CAST(guest_id AS VARCHAR) AS channel_guest_id FROM proc"""),
    "unified": (["senders", "reservations", "identities"], """
        SELECT s.*, r.id AS reservation_id, r.guest_id AS booking_guest_id, i.guest_id AS channel_guest,
          coalesce(r.guest_id, i.guest_id) AS resolved_guest_id,
          CASE WHEN r.guest_id IS NOT NULL THEN 'booking' WHEN i.guest_id IS NOT NULL THEN 'channel' ELSE 'unresolved' END AS resolution
        FROM senders s LEFT JOIN reservations r ON r.booking_ref = nullif(s.booking_ref, '')
        LEFT JOIN identities i ON i.channel = s.channel AND i.channel_guest_id = s.channel_guest_id"""),
    "provisional": (["unified"], """
        SELECT 'prov-' || channel_guest_id AS id, min(guest_name) AS full_name, channel, channel_guest_id,
          FALSE AS identity_verified, min(sent_at) AS first_seen_at
        FROM unified WHERE resolution = 'unresolved' GROUP BY channel, channel_guest_id"""),
    "complaints": (["messages", "ai"], f"""
        SELECT m.id AS message_id, m.property_id, m.sent_at, m.raw_content, ai.query_type, {topic_sql('lower(m.raw_content)')} AS topic
        FROM messages m JOIN ai ON ai.message_id = m.id
        WHERE m.direction = 'inbound' AND ai.query_type = 'complaint'"""),
    "rolling": (["complaints"], """
        SELECT message_id, property_id, topic, sent_at,
          count(*) OVER (PARTITION BY property_id, topic ORDER BY sent_at
                         RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND CURRENT ROW) AS rolling_count
        FROM complaints"""),
    "trends": (["messages", "ai", "properties"], """
        SELECT m.property_id, p.name AS property_name, ai.query_type, CAST(date_trunc('month', m.sent_at) AS TIMESTAMP) AS month,
          count(*) AS complaint_count
        FROM messages m JOIN ai ON ai.message_id = m.id JOIN properties p ON m.property_id = p.id
        WHERE m.direction = 'inbound' AND ai.query_type = 'complaint'
        GROUP BY m.property_id, p.name, ai.query_type, CAST(date_trunc('month', m.sent_at) AS TIMESTAMP)"""),
    "tickets": (["complaints"], """
        SELECT property_id, topic, ticket_no, string_agg(message_id, ',' ORDER BY rn) AS message_ids, max(sent_at) AS opened_at
        FROM (SELECT *, CAST(ceil(rn / 3.0) AS BIGINT) AS ticket_no FROM
              (SELECT *, row_number() OVER (PARTITION BY property_id, topic ORDER BY sent_at, message_id) AS rn FROM complaints))
        GROUP BY property_id, topic, ticket_no HAVING count(*) = 3"""),
    "checklists": (["reservations", "tickets"], f"""
        SELECT r.id AS reservation_id, r.property_id, r.check_in_at, r.checklist_confirmed,
          concat_ws('; ', {', '.join(q(x) for x in BASE_CHECKLIST)}, x.extra) AS items
        FROM (SELECT *, CAST(check_in_date AS TIMESTAMP) + INTERVAL 14 HOUR AS check_in_at FROM reservations
              WHERE status = 'confirmed') r
        LEFT JOIN (SELECT property_id, array_to_string(list_sort(list_distinct(list(item))), '; ') AS extra
                   FROM (SELECT property_id, CASE {' '.join(f'WHEN topic = {q(t)} THEN {q(c)}' for t, c in TOPIC_CHECK.items())} END AS item FROM tickets)
                   WHERE item IS NOT NULL GROUP BY property_id) x ON x.property_id = r.property_id
        WHERE r.check_in_at >= {CHECKLIST_CLOCK} AND r.check_in_at < {CHECKLIST_CLOCK} + INTERVAL 24 HOUR"""),
})

_TABLE_CTE = {"properties": "properties", "guests": "guests", "guest_channel_identities": "identities",
              "reservations": "reservations", "conversations": "conversations", "messages": "messages",
              "ai_message_metadata": "ai", "escalations": "esc_marked"}
_ALL_TABLES = list(_TABLE_CTE.values())


def _tbl(name: str) -> str:
    return _TABLE_CTE[name]


_PK = " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE id IS NULL) AS BIGINT) AS n_null_ids,
        CAST((SELECT count(*) FROM (SELECT id FROM {c} WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)) AS BIGINT) AS n_duplicate_ids FROM {c}"""
    for n, c in _TABLE_CTE.items())
_FK = " UNION ALL ".join(
    f"""SELECT '{ch}' AS child_table, '{col}' AS fk_column, '{par}' AS parent_table, CAST(count(*) AS BIGINT) AS n_orphans
        FROM {_tbl(ch)} c WHERE c.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_tbl(par)} p WHERE p.{pk} = c.{col})"""
    for ch, col, par, pk in FOREIGN_KEYS)
_NN = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_nulls FROM {_tbl(t)}"
    for t, cols in NOT_NULL.items() for c in cols)
_DOM = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows,
        CAST(count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({', '.join(q(v) for v in vals)})) AS BIGINT) AS n_outside FROM {_tbl(t)}"""
    for (t, c), vals in DOMAINS.items())
_WID = " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'varchar({n})' AS rule, CAST(count(*) FILTER (WHERE length({c}) > {n}) AS BIGINT) AS n_violations FROM {_tbl(t)}"
     for (t, c), n in WIDTHS.items()] +
    [f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'numeric({p},{sc})' AS rule, CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast({c} AS DECIMAL({p},{sc})) IS NULL) AS BIGINT) AS n_violations FROM {_tbl(t)}"
     for (t, c), (p, sc) in NUMERICS.items()])
_BLOCKERS = {"ai_message_metadata": "reviewed_by_agent", "conversations": "guest_id", "escalations": "guest_id", "messages": "guest_id", "reservations": "guest_id"}
_BLOCKING = "concat_ws(',', " + ", ".join(
    f"CASE WHEN EXISTS (SELECT 1 FROM {_tbl(b)} x WHERE x.{c} = g.id) THEN '{b}' END" for b, c in _BLOCKERS.items()) + ")"

# the columns that each CTE has of its table's schema, and the planted cells
_ABSENT = {"properties": ["created_at", "updated_at"], "guests": ["identity_verified", "notes", "created_at", "updated_at"],
           "guest_channel_identities": ["created_at"], "reservations": ["special_requests", "internal_notes", "created_at", "updated_at"],
           "conversations": ["subject", "resolved_at", "created_at", "updated_at"], "messages": ["created_at"], "ai_message_metadata": [],
           "escalations": ["assigned_to", "resolved_at", "resolution_notes", "created_at", "updated_at"]}
_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _unfit(t: str) -> str:
    return " OR ".join(f"({key}) % {mod} = 0" for _, key, mod, _ in WRONG_VALUES[t])


def _typed_sql(t: str) -> str:
    cols = ", ".join(f"CAST({'NULL' if f.name in _ABSENT[t] else f.name} AS {_SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())}) AS {f.name}"
                     for f in SCHEMAS[t].fields)
    return f"SELECT {cols} FROM {_tbl(t)} WHERE NOT ({_unfit(t)})"


_LOADED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) FILTER (WHERE NOT ({_unfit(t)})) AS n_typed, "
                             f"count(*) FILTER (WHERE {_unfit(t)}) AS n_quarantined FROM {_tbl(t)}" for t in SCHEMAS)
_SET_ASIDE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(id AS VARCHAR) AS id, '{c}' AS column_name, '{text}' AS value, 'type' AS fault "
                                f"FROM {_tbl(t)} WHERE ({key}) % {mod} = 0" for t, rules in WRONG_VALUES.items() for c, key, mod, text in rules)


def _default_sql(t: str, col: str, value) -> str:
    text = AS_OF_TEXT if value == "NOW" else str(value).lower() if isinstance(value, bool) else str(value)
    empty = " OR ".join([f"{col} IS NULL", *(f"({key}) % {mod} = 0" for c, key, mod in LEFT_EMPTY[t] if c == col)])
    return (f"SELECT '{t}' AS table_name, CAST(id AS VARCHAR) AS id, '{col}' AS column_name, '{text}' AS value FROM {_tbl(t)}"
            + ("" if col in _ABSENT[t] else f" WHERE {empty}"))


_DEFAULTED = " UNION ALL ".join(_default_sql(t, c, v) for t, cols in DEFAULTS.items() for c, v in cols.items())
_EXPECTED = ", ".join(f"({i}, {q(t)}, {q(a)})" for i, (t, a) in enumerate(TEMPLATE_EXPECTED))


def _pct(p: float) -> str:
    return f"list_sort(list(processing_time_ms))[greatest(CAST(ceil({p}::DOUBLE * count(*)) AS BIGINT), 1)]"


ORACLE.update({
    "domain_tables": sql(_ALL_TABLES, _LOADED),
    "quarantined_rows": sql(_ALL_TABLES, _SET_ASIDE),
    **{f"table_{t}": sql([c], _typed_sql(t)) for t, c in _TABLE_CTE.items()},
    "write_responses": sql(["proc"], "SELECT message_id, query_type, drafted_reply, confidence_score, action FROM proc"),
    "check_email": sql(["guests"], f"SELECT id, email FROM guests WHERE email IS NOT NULL AND NOT regexp_matches(email, {q(EMAIL_PATTERN)}, 'i')"),
    "check_stay_dates": sql(["reservations"], "SELECT id, check_in_date, check_out_date FROM reservations WHERE NOT (check_out_date > check_in_date)"),
    "check_guest_count": sql(["reservations"], "SELECT id, num_guests FROM reservations WHERE NOT (num_guests > 0)"),
    "check_direction": """SELECT conv_id, turn, direction FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'inbound'
        WHEN 'assistant' THEN 'outbound' ELSE role END AS direction FROM conversations)
        WHERE direction IS NULL OR direction NOT IN ('inbound', 'outbound')""",
    "check_channel": sql(["inbound"], f"SELECT message_id, source FROM inbound WHERE source IS NULL OR source NOT IN ({', '.join(q(c) for c in CHANNELS)})"),
    "check_unique_booking_ref": sql(["reservations"], """SELECT booking_ref, count(*) AS n_rows FROM (SELECT booking_ref FROM reservations UNION ALL
        SELECT booking_ref FROM reservations WHERE CAST(substr(id, 5) AS BIGINT) % 500 = 0) GROUP BY booking_ref HAVING count(*) > 1"""),
    "check_unique_identity": sql(["identities"], """SELECT channel, channel_guest_id, count(*) AS n_rows FROM (SELECT channel, channel_guest_id FROM identities UNION ALL
        SELECT channel, channel_guest_id FROM identities WHERE guest_id % 100 = 0) GROUP BY channel, channel_guest_id HAVING count(*) > 1"""),
    "check_primary_keys": sql(_ALL_TABLES, _PK),
    "check_foreign_keys": sql(_ALL_TABLES, _FK),
    "check_not_null": sql(_ALL_TABLES, _NN),
    "apply_defaults": sql(_ALL_TABLES, _DEFAULTED),
    "check_domains": sql(_ALL_TABLES, _DOM),
    "check_widths": sql(_ALL_TABLES, _WID),
    "cascade_delete": sql(_ALL_TABLES, f"""SELECT g.id AS guest_id, length({_BLOCKING}) > 0 AS blocked, {_BLOCKING} AS blocking_tables,
        CAST(CASE WHEN length({_BLOCKING}) > 0 THEN 0 ELSE (SELECT count(*) FROM identities i WHERE i.guest_id = g.id) END AS BIGINT) AS cascaded_identities
        FROM guests g WHERE NOT EXISTS (SELECT 1 FROM reservations r WHERE r.guest_id = g.id AND r.status = 'confirmed')"""),
    "cascade_delete_messages": sql(["messages", "ai", "escalations"], """
        SELECT 'messages' AS table_name, m.id, TRUE AS requested, CASE WHEN e.message_id IS NULL THEN 'deleted' ELSE 'blocked' END AS outcome,
          CASE WHEN e.message_id IS NULL THEN '' ELSE 'escalations.message_id' END AS blocking
        FROM messages m LEFT JOIN (SELECT DISTINCT message_id FROM escalations) e ON e.message_id = m.id WHERE m.sent_at < TIMESTAMP '2024-02-01'
        UNION ALL SELECT 'ai_message_metadata', a.id, FALSE, CASE WHEN e.message_id IS NULL THEN 'deleted' ELSE 'spared' END, ''
        FROM ai a JOIN messages m ON m.id = a.message_id LEFT JOIN (SELECT DISTINCT message_id FROM escalations) e ON e.message_id = m.id
        WHERE m.sent_at < TIMESTAMP '2024-02-01'"""),
    "overdue_escalations": sql(["esc_marked", "guests", "properties"], f"""
        SELECT e.id, e.reason, e.severity, e.sla_deadline, e.escalated_at, g.full_name AS guest_name, p.name AS property_name,
          date_diff('second', e.sla_deadline, {AS_OF}) AS overdue_seconds
        FROM esc_marked e JOIN guests g ON e.guest_id = g.id JOIN properties p ON e.property_id = p.id
        WHERE e.status NOT IN ('resolved', 'closed') AND e.sla_deadline < {AS_OF} AND e.first_response_at IS NULL"""),
    "complaint_trends": sql(["trends"], "SELECT * FROM trends"),
    "trend_order": sql(["trends"], "SELECT * FROM trends ORDER BY month DESC, complaint_count DESC, property_id LIMIT 20"),
    "resolve_booking": sql(["unified"], "SELECT message_id, booking_ref, reservation_id, booking_guest_id FROM unified"),
    "resolve_channel": sql(["unified"], "SELECT message_id, channel_guest_id, channel_guest FROM unified"),
    "unify_guests": sql(["unified"], "SELECT message_id, resolved_guest_id, resolution FROM unified"),
    "provisional_guests": sql(["provisional"], "SELECT * FROM provisional"),
    "merge_candidates": sql(["provisional", "unified"], """
        SELECT p.id AS provisional_id, u.booking_guest_id, min(u.sent_at) AS first_booking_message_at
        FROM provisional p JOIN unified u ON u.channel_guest_id = p.channel_guest_id AND u.resolution = 'booking' AND u.sent_at > p.first_seen_at
        GROUP BY p.id, u.booking_guest_id"""),
    "verified_guests": sql(["guests", "reservations"], """SELECT g.id, EXISTS (SELECT 1 FROM reservations r WHERE r.guest_id = g.id AND r.status = 'confirmed') AS identity_verified FROM guests g"""),
    "thread_messages": sql(["unified"], """
        SELECT sha256(concat_ws(chr(1), coalesce(CAST(guest_id AS VARCHAR), ''), coalesce(channel, ''), coalesce(property_id, ''), coalesce(reservation_id, ''))) AS thread_id,
          guest_id, channel, property_id, reservation_id, count(*) AS n_messages, min(sent_at) AS opened_at, max(sent_at) AS last_message_at
        FROM unified GROUP BY guest_id, channel, property_id, reservation_id"""),
    "unaudited_messages": sql(["messages", "ai"], """SELECT m.id AS message_id, m.guest_id, m.property_id, m.sent_at FROM messages m
        WHERE m.direction = 'inbound' AND NOT EXISTS (SELECT 1 FROM ai WHERE ai.message_id = m.id)"""),
    "recurring_complaints": sql(["rolling"], """SELECT property_id, topic, CAST(date_trunc('week', sent_at) AS TIMESTAMP) AS week,
        count(*) AS n_flagged, max(rolling_count) AS max_in_window FROM rolling WHERE rolling_count >= 3
        GROUP BY property_id, topic, CAST(date_trunc('week', sent_at) AS TIMESTAMP)"""),
    "rolling_complaints": sql(["rolling"], "SELECT * FROM rolling"),
    "last_message_at": sql(["messages"], "SELECT conversation_id, max(sent_at) AS last_message_at, count(*) AS n_messages FROM messages GROUP BY conversation_id"),
    "model_quality": sql(["ai"], """SELECT model_version, count(*) AS n_decisions, sum(CAST(confidence_score * 1000 AS BIGINT)) / (count(confidence_score) * 1000) AS mean_score,
        count(*) FILTER (WHERE agent_edited_reply IS NOT NULL) / count(*) AS share_edited,
        count(*) FILTER (WHERE action_taken = 'escalate') / count(*) AS share_escalated FROM ai GROUP BY model_version"""),
    "processing_latency": sql(["ai"], f"""SELECT CAST(created_at AS DATE) AS day, model_version, count(*) AS n,
        sum(processing_time_ms) / count(processing_time_ms) AS mean_ms, {_pct(0.5)} AS p50_ms, {_pct(0.95)} AS p95_ms,
        max(processing_time_ms) AS max_ms FROM ai GROUP BY CAST(created_at AS DATE), model_version"""),
    "sla_report": sql(["esc_marked"], """SELECT property_id, severity, count(*) AS n_escalations, count(*) FILTER (WHERE sla_breached) AS n_breached,
        count(*) FILTER (WHERE sla_breached) / count(*) AS breach_rate,
        sum(date_diff('second', escalated_at, first_response_at)) / (count(first_response_at) * 60) AS mean_minutes_to_first_response
        FROM esc_marked GROUP BY property_id, severity"""),
    "preferred_channel": sql(["messages"], """SELECT guest_id, channel AS preferred_channel, n AS n_messages FROM (
        SELECT guest_id, channel, count(*) AS n, row_number() OVER (PARTITION BY guest_id ORDER BY count(*) DESC, channel) AS rn
        FROM messages WHERE direction = 'inbound' GROUP BY guest_id, channel) WHERE rn = 1"""),
    "run_summary": sql(["case_answers"], """SELECT count(*) AS n_cases, count(*) FILTER (WHERE status = expected_status) AS n_passed,
        count(*) FILTER (WHERE status <> expected_status) AS n_failed, count(*) FILTER (WHERE status = 422) AS n_rejected,
        count(*) FILTER (WHERE status = 500) AS n_errors, count(*) FILTER (WHERE expected_status = 422) AS n_rejects_expected,
        count(*) FILTER (WHERE status = 200 AND expected_query_type IS NOT NULL) AS n_answers_expected,
        count(*) FILTER (WHERE status = 200 AND expected_query_type = query_type) AS n_types_met,
        count(*) FILTER (WHERE status = 200 AND expected_action = action) AS n_actions_met FROM case_answers"""),
    "expectation_diff": sql(["proc"], f"""SELECT x.i AS case_group, x.t AS expected_query_type, p.query_type, x.a AS expected_action, p.action,
        count(*) AS n_messages, (x.t = p.query_type AND x.a = p.action) AS matches
        FROM proc p JOIN (SELECT * FROM (VALUES {_EXPECTED}) AS v(i, t, a)) x ON x.i = p.event_id % 24
        GROUP BY x.i, x.t, p.query_type, x.a, p.action"""),
    "routing_mix": sql(["ai"], "SELECT query_type, action_taken, count(*) AS n, sum(CAST(confidence_score * 1000 AS BIGINT)) / (count(confidence_score) * 1000) AS mean_score FROM ai GROUP BY query_type, action_taken"),
    "conversation_history": sql(["turns"], """SELECT conv_id, turn, role, coalesce(array_to_string(h, chr(10)), '') AS history, CAST(coalesce(len(h), 0) AS INTEGER) AS n_history
        FROM (SELECT conv_id, turn, role, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS h FROM turns)"""),
    "inbox": sql(["messages"], """SELECT conversation_id, id AS message_id, direction, sent_at AS last_message_at FROM (
        SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at DESC, id DESC) AS rn FROM messages) WHERE rn = 1
        ORDER BY last_message_at DESC, conversation_id LIMIT 20"""),
    "latest_messages": sql(["messages"], "SELECT id, direction, channel, sent_at FROM messages ORDER BY sent_at DESC, id LIMIT 20"),
    "latest_decisions": sql(["ai"], "SELECT id, message_id, query_type, action_taken, created_at FROM ai ORDER BY created_at DESC, id LIMIT 20"),
    "open_sla_queue": sql(["esc_marked"], "SELECT id, severity, status, sla_deadline FROM esc_marked WHERE NOT sla_breached ORDER BY sla_deadline, id LIMIT 20"),
    "transcript": sql(["turns"], "SELECT conv_id, turn, direction, text FROM turns"),
    "create_escalations": sql(["escalations"], "SELECT id, message_id, conversation_id, guest_id, property_id, reason, severity, 'open' AS status, escalated_at, sla_deadline FROM escalations"),
    "mark_sla_breached": sql(["esc_marked"], "SELECT id, status, first_response_at, sla_deadline, sla_breached FROM esc_marked"),
    "sla_alerts": sql(["esc_marked"], f"""SELECT id AS escalation_id, 1 AS level, 'on_call_manager' AS recipient, escalated_at AS alert_at FROM esc_marked
        UNION ALL SELECT id, 2, 'senior_manager', sla_deadline FROM esc_marked WHERE first_response_at IS NULL AND sla_deadline < {AS_OF}"""),
    "final_reply": sql(["ai"], """SELECT message_id, (auto_sent_at IS NOT NULL OR reviewed_at IS NOT NULL) AS sent,
        CASE WHEN auto_sent_at IS NOT NULL OR reviewed_at IS NOT NULL THEN coalesce(agent_edited_reply, ai_drafted_reply) END AS final_reply FROM ai"""),
    "edit_pairs": sql(["ai"], "SELECT message_id, ai_drafted_reply, agent_edited_reply, levenshtein(ai_drafted_reply, agent_edited_reply) AS edit_distance FROM ai WHERE agent_edited_reply IS NOT NULL"),
    "maintenance_tickets": sql(["tickets"], "SELECT * FROM tickets"),
    "pre_arrival_checklist": sql(["checklists"], "SELECT reservation_id, property_id, check_in_at, items FROM checklists"),
    "checklist_alerts": sql(["checklists"], f"""SELECT reservation_id, property_id, check_in_at, check_in_at - INTERVAL 6 HOUR AS alert_at, 'property_manager' AS recipient
        FROM checklists WHERE NOT checklist_confirmed AND {CHECKLIST_CLOCK} >= check_in_at - INTERVAL 6 HOUR"""),
    "stream_rate_limit": sql(["messages"], """SELECT property_id, channel, CAST(date_trunc('day', sent_at) AS TIMESTAMP) AS window_start,
        CAST(date_trunc('day', sent_at) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, count(*) AS n_messages, count(*) > 3 AS over_limit
        FROM messages WHERE direction = 'inbound' GROUP BY property_id, channel, CAST(date_trunc('day', sent_at) AS TIMESTAMP)"""),
})

ORACLE.update({
    "enrich_property": sql(["ok", "properties"], """SELECT d.message_id, d.property_id, p.name AS property_name,
        p.id IS NOT NULL AS property_known FROM ok d LEFT JOIN properties p ON d.property_id = p.id"""),
})

ORACLE.update({
    "fixture_cases": sql(["cases"], """SELECT case_id, expected_status, expected_query_type, expected_action, source, guest_name, message,
        timestamp, booking_ref, property_id FROM cases"""),
    "case_outcomes": sql(["case_answers"], """SELECT case_id, expected_status, status, CAST(n_errors AS BIGINT) AS n_errors, query_type, action
        FROM case_answers"""),
    "check_string_types": sql(["inbound"], """SELECT i.message_id, 'body → booking_ref' AS field, 'Input should be a valid string' AS issue,
        CAST(json(e.props) AS VARCHAR) AS received
        FROM inbound i JOIN events e ON e.event_id = i.event_id WHERE e.event_type = 'error'"""),
})

ORACLE.update({
    "stream_process": ORACLE["process_messages"],
    "write_rejects": sql(["checked", "errs"], """SELECT c.message_id, c.raw, 'Request validation failed' AS error,
        CAST(c.n_errors AS BIGINT) AS n_details,
        (SELECT field FROM errs e WHERE e.message_id = c.message_id ORDER BY rule_ord LIMIT 1) AS first_field,
        'Check field types, required fields, and enum values against the schema at /docs' AS hint
        FROM checked c WHERE c.n_errors > 0"""),
    # the stream runs to one second past the last deadline, so every
    # escalation without a response by its deadline has breached
    "stream_sla_timer": sql(["escalations"], """SELECT id AS escalation_id, sla_deadline FROM escalations
        WHERE first_response_at IS NULL OR first_response_at > sla_deadline"""),
    # both levels: an opening alerts at once, a breach at its deadline
    "stream_sla_alerts": sql(["escalations"], """SELECT id AS escalation_id, 1 AS level, 'on_call_manager' AS recipient, escalated_at AS alert_at FROM escalations
        UNION ALL SELECT id, 2, 'senior_manager', sla_deadline FROM escalations WHERE first_response_at IS NULL OR first_response_at > sla_deadline"""),
    "recurring_complaints_weekly": ORACLE["recurring_complaints"],
    "random_ids": sql(["inbound"], "SELECT count(*) AS n_messages, count(*) AS n_ids, count(*) AS n_uuids FROM inbound"),
})
