"""A4: the eight domain tables with enforced types.

``SCHEMAS`` holds a StructType per table. ``enforce`` brings rows of any source
(string exports, JSON, parquet of another version) to it: a value that does not
fit its column's type is rescued as text under the column's name, and such a row
is set aside (quarantined) with everything it brought; no bad value fails a job
or turns into a silent null."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- FIXED VALUES: columns, types and NOT NULL of the schema's eight tables. Guest
# ids are whole numbers here, other ids text; TIME columns are HH:mm:ss text.
_S, _I, _L, _B, _TS, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType(), T.DateType()


def _table(*columns: tuple) -> T.StructType:
    """Columns as (name, type) or (name, type, True where NOT NULL)."""
    return T.StructType([T.StructField(c[0], c[1], len(c) < 3) for c in columns])


SCHEMAS: dict[str, T.StructType] = {
    "properties": _table(
        ("id", _S, True), ("name", _S, True), ("location", _S), ("bedrooms", _I, True), ("max_guests", _I, True),
        ("private_pool", _B), ("check_in_time", _S), ("check_out_time", _S), ("base_rate_inr", T.DecimalType(10, 2)),
        ("extra_guest_rate_inr", T.DecimalType(10, 2)), ("wifi_password", _S), ("caretaker_hours", _S), ("chef_available", _B),
        ("cancellation_policy", _S), ("is_active", _B), ("created_at", _TS), ("updated_at", _TS)),
    "guests": _table(
        ("id", _L, True), ("full_name", _S, True), ("email", _S), ("phone", _S), ("preferred_channel", _S),
        ("identity_verified", _B), ("notes", _S), ("created_at", _TS), ("updated_at", _TS)),
    "guest_channel_identities": _table(
        ("id", _S, True), ("guest_id", _L, True), ("channel", _S, True), ("channel_guest_id", _S, True),
        ("channel_display_name", _S), ("created_at", _TS)),
    "reservations": _table(
        ("id", _S, True), ("booking_ref", _S, True), ("guest_id", _L, True), ("property_id", _S, True), ("channel", _S, True),
        ("check_in_date", _D, True), ("check_out_date", _D, True), ("num_guests", _I, True), ("total_amount_inr", T.DecimalType(12, 2)),
        ("status", _S, True), ("special_requests", _S), ("internal_notes", _S), ("created_at", _TS), ("updated_at", _TS)),
    "conversations": _table(
        ("id", _S, True), ("guest_id", _L, True), ("reservation_id", _S), ("property_id", _S, True), ("channel", _S, True),
        ("status", _S, True), ("subject", _S), ("opened_at", _TS), ("resolved_at", _TS), ("last_message_at", _TS),
        ("created_at", _TS), ("updated_at", _TS)),
    "messages": _table(
        ("id", _S, True), ("conversation_id", _S, True), ("guest_id", _L, True), ("property_id", _S, True), ("direction", _S, True),
        ("channel", _S, True), ("raw_content", _S, True), ("sent_at", _TS, True), ("delivery_status", _S), ("created_at", _TS)),
    "ai_message_metadata": _table(
        ("id", _S, True), ("message_id", _S, True), ("query_type", _S, True), ("ai_drafted_reply", _S, True),
        ("confidence_score", T.DecimalType(4, 3), True), ("action_taken", _S, True), ("agent_edited_reply", _S), ("final_reply_sent", _S),
        ("reviewed_by_agent", _L), ("reviewed_at", _TS), ("escalated_at", _TS), ("auto_sent_at", _TS), ("model_version", _S),
        ("processing_time_ms", _I), ("created_at", _TS)),
    "escalations": _table(
        ("id", _S, True), ("message_id", _S, True), ("conversation_id", _S, True), ("guest_id", _L, True), ("property_id", _S, True),
        ("reason", _S, True), ("severity", _S, True), ("status", _S, True), ("assigned_to", _S), ("escalated_at", _TS),
        ("first_response_at", _TS), ("resolved_at", _TS), ("resolution_notes", _S), ("sla_deadline", _TS), ("sla_breached", _B),
        ("created_at", _TS), ("updated_at", _TS)),
}
TIME_COLUMNS = {("properties", "check_in_time"), ("properties", "check_out_time")}
TIME_SHAPE = r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"

RESCUED, QUARANTINED, MISSING = "_rescued", "_quarantined", "_missing"


def _typed(table: str, field: T.StructField, have: T.DataType) -> Column:
    c = F.col(field.name)
    if (table, field.name) in TIME_COLUMNS:
        return F.when(c.cast("string").rlike(TIME_SHAPE), c.cast("string"))
    return c if have == field.dataType else c.try_cast(field.dataType)


def enforce(df: DataFrame, table: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The columns of the table's schema in their types (absent ones null), and:

    ``_rescued``: map of column to text, of values that do not fit their type and of
    columns the schema does not have; ``_missing``: the NOT NULL columns that came
    without a value; ``_quarantined``: a value does not fit or one is missing.
    ``defaults`` fill columns that came without a value, never ones that do not fit.
    Map-only; a row is never dropped."""
    schema, defaults = SCHEMAS[table], defaults or {}
    have = {f.name: f.dataType for f in df.schema.fields}
    text = lambda c: F.to_json(c) if isinstance(have[c], (T.StructType, T.MapType, T.ArrayType)) else F.col(c).cast("string")
    entry = lambda c: F.struct(F.lit(c).alias("key"), text(c).alias("value"))
    columns, rescued, missing, unfit = [], [], [], F.lit(False)
    for f in schema.fields:
        fill = defaults[f.name].cast(f.dataType) if f.name in defaults else F.lit(None).cast(f.dataType)
        if f.name in have:
            value = _typed(table, f, have[f.name])
            wrong = F.col(f.name).isNotNull() & value.isNull()
            absent = F.col(f.name).isNull()
            rescued.append(F.when(wrong, entry(f.name)))
            unfit = unfit | wrong
            columns.append(F.when(absent, fill).otherwise(value).alias(f.name))
        else:
            absent = F.lit(True)
            columns.append(fill.alias(f.name))
        if not f.nullable and f.name not in defaults:
            missing.append(F.when(absent, F.lit(f.name)))
    rescued += [F.when(F.col(c).isNotNull(), entry(c)) for c in have if c not in schema.fieldNames()]
    def some(items, kind):
        """Those that are not null; rows without any, nearly all, build no array of them."""
        none = F.array().cast(kind)
        given = F.concat(*[F.when(x.isNotNull(), F.array(x)).otherwise(none) for x in items], none)
        return F.when(reduce(Column.__or__, [x.isNotNull() for x in items]), given).otherwise(none) if items else none

    lacking = some(missing, "array<string>")
    return df.select(*columns, F.map_from_entries(some(rescued, "array<struct<key:string,value:string>>")).alias(RESCUED),
                     lacking.alias(MISSING), (unfit | (F.size(lacking) > 0)).alias(QUARANTINED))


def accepted(enforced: DataFrame, table: str) -> DataFrame:
    """The rows that fit, with the schema's columns only."""
    return enforced.where(~F.col(QUARANTINED)).select(*SCHEMAS[table].fieldNames())


def faults(enforced: DataFrame) -> DataFrame:
    """(id, column_name, value, fault) of the rows set aside: ``type`` with the text
    that did not fit, or ``missing``. A row whose id itself does not fit has its text."""
    bad = enforced.where(QUARANTINED).withColumn("_id", F.coalesce(F.col("id").cast("string"), F.col(RESCUED)["id"]))
    types = F.transform(F.map_entries(RESCUED), lambda e: F.struct(e["key"].alias("column_name"), e["value"].alias("value"), F.lit("type").alias("fault")))
    known = [f for f in enforced.columns if f not in (RESCUED, MISSING, QUARANTINED)]
    types = F.filter(types, lambda e: e["column_name"].isin(known))
    gone = F.transform(MISSING, lambda c: F.struct(c.alias("column_name"), F.lit(None).cast("string").alias("value"), F.lit("missing").alias("fault")))
    return bad.select(F.col("_id").alias("id"), F.inline(F.concat(types, gone)))
