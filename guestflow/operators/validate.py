"""Payload validation as columns.

Every failing rule on a row is reported, not just the first: the errors are
an array of {field, issue, received} built from one ``when`` per rule and
filtered for nulls. A bad row never fails the job; it lands in the reject
branch. All of it is per-row and map-only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import (CHANNELS, ERROR_HINT, ERROR_TITLE, FIELD_PATH_SEP,
                               QUERY_TYPES, ACTIONS)
from ..functions.classify import memo_per_context
from ..functions.text import first_name

# --- FIXED VALUES: validation messages, in the wording of the payload schema
# library the message service relies on.
MSG_MISSING = "Field required"
MSG_TOO_SHORT = "String should have at least 1 character"
MSG_BAD_DATETIME = "Input should be a valid datetime"
MSG_NOT_STRING = "Input should be a valid string"
MSG_NOT_JSON = "JSON decode error"
MSG_NOT_OBJECT = "Input should be a valid dictionary or object to extract fields from"
MSG_BAD_SOURCE = "Input should be " + ", ".join(f"'{c}'" for c in CHANNELS[:-1]) + f" or '{CHANNELS[-1]}'"

STRING_FIELDS = ["source", "guest_name", "message", "timestamp", "booking_ref", "property_id"]

# ISO 8601 date or date-time; guards the cast so '10:30' or '2026' never pass.
ISO_SHAPE = (r"^\d{4}-\d{2}-\d{2}"
             r"([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$")

def field_path(name: str) -> str:
    return FIELD_PATH_SEP.join(["body", name])


def parse_ts(col) -> Column:
    """ISO text → UTC wall-clock timestamp_ntz, null when it does not parse.

    Needs the session time zone to be UTC (``build_session`` sets it)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(ISO_SHAPE), F.try_to_timestamp(c)).cast("timestamp_ntz")


def _err(cond: Column, field: str, issue: str, received: Column, path: bool = True) -> Column:
    return F.when(cond, F.struct(F.lit(field_path(field) if path else field).alias("field"),
                                 F.lit(issue).alias("issue"),
                                 received.cast("string").alias("received")))


def kind_col(name: str) -> str:
    """Column that says what JSON a payload field came as: null (absent), VOID
    (an explicit null), STRING, or another type's name."""
    return f"_kind_{name}"


@memo_per_context
def _error_array_named(raw_name, typed):
    return error_array(F.col(raw_name) if raw_name else None, typed)


def _absent(name: str, typed: bool) -> Column:
    return F.col(kind_col(name) if typed else name).isNull()


def _not_string(name: str, typed: bool) -> Column:
    """Present, but not a JSON string (an explicit null included)."""
    return F.col(kind_col(name)) != "STRING" if typed else F.lit(False)


def error_array(raw: Column | None = None, typed: bool = False) -> Column:
    """The failed rules of a payload row in field order, one per field.

    ``raw`` is the received body, reported for missing fields (as the schema
    library does); without it the row's fields are rendered as JSON. With
    ``typed`` (rows of ``parse_payload(check_types=True)``) absent, null and
    wrongly typed fields are told apart, and a body that is no JSON object is
    one error of its own.
    """
    body = raw if raw is not None else F.to_json(F.struct(*[F.col(c) for c in STRING_FIELDS]))
    fields = []
    for name, wrong, rule in (
            ("source", MSG_BAD_SOURCE, (~F.col("source").isin(*CHANNELS), MSG_BAD_SOURCE)),
            ("guest_name", MSG_NOT_STRING, (F.length("guest_name") < 1, MSG_TOO_SHORT)),
            ("message", MSG_NOT_STRING, (F.length("message") < 1, MSG_TOO_SHORT)),
            ("timestamp", MSG_BAD_DATETIME, (parse_ts("timestamp").isNull(), MSG_BAD_DATETIME)),
            ("property_id", MSG_NOT_STRING, None)):
        c = _err(_absent(name, typed), name, MSG_MISSING, body)
        if typed:
            c = F.coalesce(c, _err(_not_string(name, typed), name, wrong, F.col(name)))
        if rule:
            c = F.coalesce(c, _err(rule[0], name, rule[1], F.col(name)))
        fields.append(c)
    if typed:
        ref = F.col(kind_col("booking_ref"))
        fields.insert(4, _err(~ref.isin("STRING", "VOID"), "booking_ref", MSG_NOT_STRING, F.col("booking_ref")))
    errors = F.filter(F.array(*fields), lambda x: x.isNotNull())
    if not typed:
        return errors
    whole = F.when(F.col("_body") == "JSON", F.lit(None)).otherwise(F.col("_body"))
    alone = _err(whole.isNotNull(), "body", "", F.when(whole == MSG_NOT_OBJECT, body), path=False)
    return F.when(F.col("_body") == "JSON", errors).otherwise(F.array(alone.withField("issue", F.col("_body"))))


@memo_per_context
def valid_condition(typed: bool = False) -> Column:
    """True when no rule of ``error_array`` fails; plain boolean checks, so a
    filter on it stays cheap after Catalyst pushes it down."""
    s, g, m, t, p = (F.col(c) for c in ["source", "guest_name", "message", "timestamp", "property_id"])
    ok = (s.isNotNull() & s.isin(*CHANNELS) & g.isNotNull() & (F.length(g) >= 1)
          & m.isNotNull() & (F.length(m) >= 1) & t.isNotNull() & parse_ts(t).isNotNull() & p.isNotNull())
    return ok & F.col("_strings") if typed else ok


def with_validation(df: DataFrame, raw_col: str | None = "raw") -> DataFrame:
    """Adds ``errors`` (array of every failed rule), ``is_valid``, ``sent_at``
    (parsed timestamp) and ``first_name`` (null for a blank name, B9).

    Splits filter on ``is_valid`` (cheap booleans); the error array is only
    computed where a branch selects it."""
    typed = "_body" in df.columns
    errs = _error_array_named(raw_col if raw_col and raw_col in df.columns else None, typed)
    return df.withColumns({"errors": errs, "is_valid": valid_condition(typed), "sent_at": parse_ts("timestamp"),
                           "first_name": first_name("guest_name")})


def is_valid() -> Column:
    return F.col("is_valid")


def split_valid(checked: DataFrame):
    """(ok, rejected, processing_error) from one validated parent.

    The three filters share one parent; persist the parent when all three are
    written from the same job (the streaming ``foreachBatch`` does).
    """
    ok = checked.filter(is_valid() & F.col("first_name").isNotNull())
    bad = checked.filter(~is_valid())
    failed = checked.filter(is_valid() & F.col("first_name").isNull())
    return ok, bad, failed


def error_envelope(errors) -> Column:
    """{error, details[], hint} as a struct."""
    e = F.col(errors) if isinstance(errors, str) else errors
    return F.struct(F.lit(ERROR_TITLE).alias("error"), e.alias("details"), F.lit(ERROR_HINT).alias("hint"))


def typed_fields(df: DataFrame, raw: str, parsed: str | None = None) -> DataFrame:
    """The payload fields of a raw JSON body, parsed once, with what they came as.

    Adds the six fields (text; other JSON as its JSON text), ``_kind_<field>``,
    ``_body`` (JSON, or why the body as a whole is unusable) and ``_strings``
    (all fields usable strings). The parse and what is read from it come out of
    one-row generators, so no later filter copies them. ``parsed`` names a
    variant column that holds the body already; it is taken out of the result."""
    keep = [c for c in df.columns if c != parsed]
    body = F.col(parsed) if parsed else F.try_parse_json(F.col(raw))
    parsed = df.select(*keep, F.inline(F.array(F.struct(body.alias("_v")))))
    part = lambda c: F.try_variant_get("_v", "$." + c, "variant")
    parsed = parsed.select(*keep, "_v", F.inline(F.array(F.struct(
        # what has a field is an object: only a body without the required ones is described as a whole
        F.when(F.col("_v").isNull(), MSG_NOT_JSON).when(part("source").isNotNull() | part("message").isNotNull(), "JSON")
        .when(F.schema_of_variant("_v").startswith("OBJECT"), "JSON").otherwise(MSG_NOT_OBJECT).alias("_body"),
        *[F.schema_of_variant(part(c)).alias(kind_col(c)) for c in STRING_FIELDS]))))
    kinds = {c: F.col(kind_col(c)) for c in STRING_FIELDS}
    usable = F.lit(True)
    for c in STRING_FIELDS:
        usable = usable & (F.coalesce(kinds[c], F.lit("VOID")).isin("STRING", "VOID") if c == "booking_ref" else F.coalesce(kinds[c] == "STRING", F.lit(False)))
    text = [F.when(kinds[c] == "STRING", F.try_variant_get("_v", "$." + c, "string"))
            .when(kinds[c] != "VOID", F.to_json(part(c))).alias(c) for c in STRING_FIELDS]
    return parsed.select(*keep, "_body", *[kind_col(c) for c in STRING_FIELDS],
                         F.inline(F.array(F.struct(*text, usable.alias("_strings")))))


def response_violations() -> Column:
    """Checks on a response row: score in [0, 1], action and type in
    their sets. Returns an array of violated rule names."""
    sc, ac, qt = F.col("confidence_score"), F.col("action"), F.col("query_type")
    rules = [
        F.when(sc.isNull() | (sc < 0) | (sc > 1), F.lit("confidence_score_range")),
        F.when(ac.isNull() | ~ac.isin(*ACTIONS), F.lit("action_domain")),
        F.when(qt.isNull() | ~qt.isin(*QUERY_TYPES), F.lit("query_type_domain")),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())
