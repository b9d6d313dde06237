"""Data-quality checks for the schema's constraints.

Checks report; they never drop rows. Per-row rules are filters, uniqueness is
an aggregate with map-side combine, foreign keys are anti-joins against the
distinct parent keys (small parents are broadcast by AQE).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_MODEL

# --- FIXED VALUES: the guests.email CHECK pattern (case-insensitive).
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"

DIRECTIONS = ["inbound", "outbound"]

# --- FIXED VALUES, to the end of DEFAULTS: the schema's value domains, foreign
# keys, not-null columns, widths, numeric ranges and defaults.
# Comment-only value domains (reported as warnings).
DOMAINS = {
    ("reservations", "status"): ["confirmed", "cancelled", "completed", "no_show"],
    ("conversations", "status"): ["open", "resolved", "escalated", "waiting_guest", "waiting_team"],
    ("messages", "delivery_status"): ["received", "queued", "sent", "delivered", "failed"],
    ("ai_message_metadata", "action_taken"): ["auto_send", "agent_review", "escalate"],
    ("escalations", "reason"): ["complaint", "low_confidence", "ai_failure", "sla_breach"],
    ("escalations", "severity"): ["low", "medium", "high", "critical"],
    ("escalations", "status"): ["open", "assigned", "in_progress", "resolved", "closed"],
}

# Foreign keys: (child table, column, parent table, parent key).
FOREIGN_KEYS = [
    ("guest_channel_identities", "guest_id", "guests", "id"),
    ("reservations", "guest_id", "guests", "id"),
    ("reservations", "property_id", "properties", "id"),
    ("conversations", "guest_id", "guests", "id"),
    ("conversations", "reservation_id", "reservations", "id"),
    ("conversations", "property_id", "properties", "id"),
    ("messages", "conversation_id", "conversations", "id"),
    ("messages", "guest_id", "guests", "id"),
    ("messages", "property_id", "properties", "id"),
    ("ai_message_metadata", "message_id", "messages", "id"),
    ("ai_message_metadata", "reviewed_by_agent", "guests", "id"),
    ("escalations", "message_id", "messages", "id"),
    ("escalations", "conversation_id", "conversations", "id"),
    ("escalations", "guest_id", "guests", "id"),
    ("escalations", "property_id", "properties", "id"),
]

# The references of them that delete with their parent; the others block its delete.
CASCADES = {("guest_channel_identities", "guest_id"), ("ai_message_metadata", "message_id")}

# NOT NULL columns per table (as far as our tables carry them).
NOT_NULL = {
    "properties": ["id", "name", "bedrooms", "max_guests"],
    "guests": ["id", "full_name"],
    "guest_channel_identities": ["id", "guest_id", "channel", "channel_guest_id"],
    "reservations": ["id", "booking_ref", "guest_id", "property_id", "channel", "check_in_date",
                     "check_out_date", "num_guests", "status"],
    "conversations": ["id", "guest_id", "property_id", "channel", "status"],
    "messages": ["id", "conversation_id", "guest_id", "property_id", "direction", "channel",
                 "raw_content", "sent_at"],
    "ai_message_metadata": ["id", "message_id", "query_type", "ai_drafted_reply", "confidence_score",
                            "action_taken"],
    "escalations": ["id", "message_id", "conversation_id", "guest_id", "property_id", "reason",
                    "severity", "status"],
}

# VARCHAR widths per (table, column).
WIDTHS = {
    ("properties", "id"): 50, ("properties", "name"): 255, ("properties", "location"): 255,
    ("properties", "wifi_password"): 100, ("properties", "caretaker_hours"): 100,
    ("guests", "full_name"): 255, ("guests", "email"): 255, ("guests", "phone"): 50, ("guests", "preferred_channel"): 50,
    ("guest_channel_identities", "channel"): 50, ("guest_channel_identities", "channel_guest_id"): 255,
    ("guest_channel_identities", "channel_display_name"): 255,
    ("reservations", "booking_ref"): 100, ("reservations", "property_id"): 50,
    ("reservations", "channel"): 50, ("reservations", "status"): 50,
    ("conversations", "property_id"): 50, ("conversations", "channel"): 50, ("conversations", "status"): 50, ("conversations", "subject"): 255,
    ("messages", "property_id"): 50, ("messages", "direction"): 10, ("messages", "channel"): 50,
    ("messages", "delivery_status"): 50,
    ("ai_message_metadata", "query_type"): 50, ("ai_message_metadata", "action_taken"): 50,
    ("ai_message_metadata", "model_version"): 100,
    ("escalations", "property_id"): 50, ("escalations", "assigned_to"): 255, ("escalations", "reason"): 100, ("escalations", "severity"): 20, ("escalations", "status"): 50,
}

# NUMERIC(p, s) columns.
NUMERICS = {
    ("properties", "base_rate_inr"): (10, 2), ("properties", "extra_guest_rate_inr"): (10, 2),
    ("reservations", "total_amount_inr"): (12, 2), ("ai_message_metadata", "confidence_score"): (4, 3),
}

# Defaults applied to absent or null columns (NOW() = as_of).
DEFAULTS = {
    "properties": {"bedrooms": 1, "max_guests": 2, "private_pool": False, "check_in_time": "14:00:00",
                   "check_out_time": "11:00:00", "chef_available": False, "is_active": True,
                   "created_at": "NOW", "updated_at": "NOW"},
    "guests": {"identity_verified": False, "created_at": "NOW", "updated_at": "NOW"},
    "guest_channel_identities": {"created_at": "NOW"},
    "reservations": {"num_guests": 1, "status": "confirmed", "created_at": "NOW", "updated_at": "NOW"},
    "conversations": {"status": "open", "opened_at": "NOW", "last_message_at": "NOW",
                      "created_at": "NOW", "updated_at": "NOW"},
    "messages": {"delivery_status": "received", "created_at": "NOW"},
    "ai_message_metadata": {"model_version": DEFAULT_MODEL, "created_at": "NOW"},  # the model label is our own
    "escalations": {"severity": "medium", "status": "open", "escalated_at": "NOW",
                    "sla_breached": False, "created_at": "NOW", "updated_at": "NOW"},
}


def email_violations(guests: DataFrame) -> DataFrame:
    """Emails that are present and do not match the pattern (any case)."""
    return guests.filter(F.col("email").isNotNull() & ~F.col("email").rlike("(?i)" + EMAIL_PATTERN)) \
        .select("id", "email")


def stay_date_violations(res: DataFrame) -> DataFrame:
    """Check-out not after check-in."""
    return res.filter(~(F.col("check_out_date") > F.col("check_in_date"))) \
        .select("id", "check_in_date", "check_out_date")


def guest_count_violations(res: DataFrame) -> DataFrame:
    """num_guests must be positive."""
    return res.filter(~(F.col("num_guests") > 0)).select("id", "num_guests")


def domain_violations(df: DataFrame, key: str, col: str, allowed) -> DataFrame:
    """Values outside an enforced set (null fails too)."""
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(*allowed)).select(key, col)


def duplicates(df: DataFrame, keys) -> DataFrame:
    """Key values held by more than one row."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def duplicate_keys(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(table_name, n_duplicate_ids): keys held by more than one row, all tables in one
    pass over their key columns; counted map-side, so a repeated key is one row."""
    keys = reduce(DataFrame.unionByName, [df.where(F.col(key).isNotNull()).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("k"))
                                          for name, df in tables.items()])
    twice = keys.groupBy("table_name", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_duplicate_ids"))


def primary_key_report(tables: dict[str, DataFrame], counts: dict[str, dict[str, int]], key: str = "id") -> DataFrame:
    """Per table: rows and null ids (observed by the load, ``counts``), and ids held
    by more than one row."""
    spark = next(iter(tables.values())).sparkSession
    seen = spark.createDataFrame([(t, c["rows"], c[f"null {key}"]) for t, c in counts.items()], "table_name string, n_rows bigint, n_null_ids bigint")
    return (seen.join(F.broadcast(duplicate_keys(tables, key)), "table_name", "left")  # one row per table
            .select("table_name", "n_rows", "n_null_ids", F.coalesce("n_duplicate_ids", F.lit(0)).cast("bigint").alias("n_duplicate_ids")))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null reference has no parent row."""
    keys = parent.select(F.col(pk).alias("_pk")).distinct()
    c = child.filter(F.col(fk).isNotNull())
    return c.join(keys, c[fk] == keys["_pk"], "left_anti")


def foreign_key_report(tables: dict[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    """Orphan count per reference, all references in one job.

    Each child table is scanned once, emitting (reference, key) for every
    non-null foreign key it holds; the pairs are counted map-side (a hot key
    collapses to one row) and anti-joined once against the distinct parent
    keys of every reference."""
    by_child: dict = {}
    by_parent: dict = {}
    for i, (child, col, parent, pk) in enumerate(fks):
        by_child.setdefault(child, []).append((i, col))
        by_parent.setdefault((parent, pk), []).append(i)
    refs = reduce(DataFrame.unionByName, [
        tables[child].select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("fk"), F.col(col).cast("string").alias("k")) for i, col in cols])).alias("r"))
        .select("r.fk", "r.k")
        for child, cols in by_child.items()]).filter(F.col("k").isNotNull())
    counted = refs.groupBy("fk", "k").agg(F.count(F.lit(1)).alias("n"))
    parents = reduce(DataFrame.unionByName, [
        tables[parent].select(F.col(pk).cast("string").alias("k")).distinct()
        .select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("fk"), "k")
        for (parent, pk), ids in by_parent.items()])
    # ``n > 0`` always holds; it names the aggregate's output so Catalyst
    # keeps the anti-join above the count instead of pushing it into every
    # child scan (raw rows again, and the parent keys rebuilt per child)
    p = parents.select(F.col("fk").alias("_pfk"), F.col("k").alias("_pk"))
    orphan_counts = (counted.join(p, (counted["fk"] == p["_pfk"]) & (counted["k"] == p["_pk"]) & (counted["n"] > 0),
                                  "left_anti")
                     .groupBy("fk").agg(F.sum("n").alias("n")))
    listing = counted.sparkSession.createDataFrame(
        [(i, c, col, p) for i, (c, col, p, _) in enumerate(fks)],
        "fk int, child_table string, fk_column string, parent_table string")
    return (listing.join(orphan_counts, "fk", "left")
            .select("child_table", "fk_column", "parent_table",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_orphans")))


def default_values(table: str, as_of: str) -> dict[str, Column]:
    """The table's DEFAULT per column; NOW() = as_of."""
    return {c: F.lit(as_of).cast("timestamp_ntz") if v == "NOW" else F.lit(v) for c, v in DEFAULTS[table].items()}


def apply_defaults(df: DataFrame, table: str, as_of: str) -> DataFrame:
    """Fill DEFAULT values into absent or null columns; NOW() = as_of."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in default_values(table, as_of).items()})


def defaulted(df: DataFrame, table: str, as_of: str, key: str = "id") -> DataFrame:
    """(table_name, id, column_name, value) of every cell that its default fills."""
    cells = []
    for col, val in DEFAULTS[table].items():
        text = as_of if val == "NOW" else str(val).lower() if isinstance(val, bool) else str(val)
        absent = F.col(col).isNull() if col in df.columns else F.lit(True)
        cells.append(F.when(absent, F.struct(F.lit(col).alias("column_name"), F.lit(text).alias("value"))))
    return df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("id"),
                     F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


# ---------------------------------------------------------------------------
# Row constraints as counts that a write or a micro-batch observes

def row_counts(df: DataFrame, table: str) -> list[Column]:
    """Aggregates for ``observe``: rows, nulls per NOT NULL column, values outside each
    value domain, texts beyond their width, numbers beyond their precision. Checks of
    columns the rows do not have are left out."""
    have = set(df.columns)
    out = [F.count(F.lit(1)).alias("rows")]
    out += [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in NOT_NULL[table] if c in have]
    for (t, c), allowed in DOMAINS.items():
        if t == table and c in have:
            out.append(F.count_if(F.col(c).isNull() | ~F.col(c).isin(*allowed)).alias(f"outside {c}"))
    for (t, c), n in WIDTHS.items():
        if t == table and c in have:
            out.append(F.count_if(F.length(F.col(c)) > n).alias(f"wide {c}"))
    for (t, c), (p, s) in NUMERICS.items():
        if t == table and c in have:
            out.append(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(f"decimal({p},{s})").isNull()).alias(f"wide {c}"))
    return out


def null_report(spark: SparkSession, counts: dict[str, dict[str, int]]) -> DataFrame:
    """Null count of every NOT NULL column, as observed."""
    rows = [(t, c, counts[t][f"null {c}"]) for t, cols in NOT_NULL.items() for c in cols]
    return spark.createDataFrame(rows, "table_name string, column_name string, n_nulls bigint")


def domain_report(spark: SparkSession, counts: dict[str, dict[str, int]]) -> DataFrame:
    """Rows outside each comment-only domain (warnings), as observed."""
    rows = [(t, c, counts[t]["rows"], counts[t][f"outside {c}"]) for t, c in DOMAINS]
    return spark.createDataFrame(rows, "table_name string, column_name string, n_rows bigint, n_outside bigint")


def width_report(spark: SparkSession, counts: dict[str, dict[str, int]]) -> DataFrame:
    """Values longer than their VARCHAR width and numbers that do not fit their
    NUMERIC(p, s), as observed."""
    rules = {**{k: f"varchar({n})" for k, n in WIDTHS.items()}, **{k: f"numeric({p},{s})" for k, (p, s) in NUMERICS.items()}}
    rows = [(t, c, rule, counts[t][f"wide {c}"]) for (t, c), rule in rules.items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, rule string, n_violations bigint")
