"""Text-building column functions."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import _col
from .rules import (DEFAULT_MODEL, FALLBACK_REPLY_HEAD, FALLBACK_REPLY_TAIL, MAX_REPLY_TOKENS,
                    MISSING_FACT, NO_BOOKING_TEXT, NO_PROPERTY_TEXT, PROMPT_LINES, PROPERTY_LINES,
                    SYSTEM_PROMPT)


def message_id(*cols) -> Column:
    """C4: a stable UUID-shaped id: SHA-256 of the fields joined by U+0001.

    Unlike a random UUID it is the same on retry, on every branch of a plan and
    for a redelivered payload, so rejects, audit rows and escalations join.
    """
    h = F.sha2(F.concat_ws("\u0001", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def first_name(name) -> Column:
    """First whitespace-separated token; null when the name is blank.
    Unicode whitespace (e.g. no-break space) separates tokens too."""
    return F.nullif(F.regexp_extract(_col(name), r"(?U)^\s*(\S+)", 1), F.lit(""))


def booking_ref_label(ref) -> Column:
    """Null or empty reference → the 'not provided' text."""
    return F.coalesce(F.nullif(_col(ref), F.lit("")), F.lit(NO_BOOKING_TEXT))


def yes_no(flag) -> Column:
    return F.when(_col(flag), F.lit("Yes")).otherwise(F.lit("No"))


def _txt(c, missing=MISSING_FACT) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(missing))


REDACTED_WIFI = "Shared with guests who hold a booking"

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, values: dict) -> Column:
    """A fixed line template with ``{name}`` slots filled by columns."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    if pos < len(template) or not parts:
        parts.append(F.lit(template[pos:]))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def property_text(prefix: str = "p_", redact: Column | None = None) -> Column:
    """Thirteen property facts in the fixed ten-line layout.

    Expects the columns of the properties table prefixed with ``prefix``
    (after an enrichment join). Unknown property (no ``{prefix}id``) gives the
    'unavailable' sentence. Where ``redact`` is true the WiFi password is
    replaced by a notice. Booleans print as Yes/No, missing facts as
    'Not on file'.
    """
    values = {}
    for line in PROPERTY_LINES:
        for name in _FIELD.findall(line):
            col = F.col(prefix + name)
            values[name] = yes_no(col) if name in ("private_pool", "chef_available") else _txt(col)
    if redact is not None:
        values["wifi_password"] = F.when(redact, F.lit(REDACTED_WIFI)).otherwise(values["wifi_password"])
    lines = [render(line, values) for line in PROPERTY_LINES]
    return F.when(F.col(prefix + "id").isNull(), F.lit(NO_PROPERTY_TEXT)).otherwise(F.concat_ws("\n", *lines))


def user_prompt(first, source, query_type, booking_ref, prop_text, message) -> Column:
    """The user turn of the drafting request, in the fixed layout."""
    values = {"first_name": _col(first), "source": _col(source), "query_type": _col(query_type),
              "booking_ref": booking_ref_label(booking_ref), "property_text": _col(prop_text),
              "message": _col(message)}
    return F.concat_ws("\n", *[render(line, values) for line in PROMPT_LINES])


def prompt_request(prompt, model: str = DEFAULT_MODEL, max_tokens: int = MAX_REPLY_TOKENS) -> Column:
    """The request record sent to a drafting model."""
    return F.struct(
        F.lit(model).alias("model"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(SYSTEM_PROMPT).alias("system"),
        F.array(F.struct(F.lit("user").alias("role"), _col(prompt).alias("content"))).alias("messages"),
    )


def fallback_reply(first) -> Column:
    """The holding reply addressed to the first name."""
    return F.concat(F.lit(FALLBACK_REPLY_HEAD), _col(first), F.lit(FALLBACK_REPLY_TAIL))


def reply_preview(reply, n: int = 80) -> Column:
    """First ``n`` characters of the reply followed by dots."""
    return F.concat(F.substring(F.coalesce(_col(reply), F.lit("")), 1, n), F.lit("..."))


def normalize_phone(phone, country_code: str = "91") -> Column:
    """Spaced, dashed and trunk-zero numbers to E.164.

    '+91 98765 43210' and '098765 43210' both become '+919876543210'.
    A leading '00' is an international prefix; a bare 10-digit number gets the
    default country code.
    """
    p = _col(phone)
    digits = F.regexp_replace(p, r"[^0-9]", "")
    return (F.when(p.isNull() | (F.length(digits) == 0), F.lit(None).cast("string"))
            .when(F.trim(p).startswith("+"), F.concat(F.lit("+"), digits))
            .when(digits.startswith("00"), F.concat(F.lit("+"), F.regexp_replace(digits, "^00", "")))
            .when(digits.startswith("0"),
                  F.concat(F.lit("+" + country_code), F.regexp_replace(digits, "^0", "")))
            .when(F.length(digits) == 10, F.concat(F.lit("+" + country_code), digits))
            .otherwise(F.concat(F.lit("+"), digits)))


def conversation_key() -> Column:
    """One conversation per (guest, channel, property): 'guest|channel|property'."""
    return F.concat_ws("|", F.col("guest_id").cast("string"), F.col("source"), F.col("property_id"))
