"""Adapters from the driver's parquet tables to the messaging domain (A2, A4).

Every domain table is derived with column expressions from one given table
(plus a tiny nation⋈region lookup), so the adapters are map-only: they add no
shuffle and scale with their input. The rules are the ones in FIXTURES.md.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import CHANNELS

# --- FIXED VALUES (our own wording): the 24 message templates of FIXTURES.md §2,
# picked by event_id % 24.
MESSAGE_TEMPLATES = [
    "Is the house available 20-24 April, and at what rate for two adults?",
    "What is the wifi password, and when do we check in?",
    "No hot water since midnight, this is awful",
    "Please arrange a transfer from the airport on 20 April and a chef",
    "Not sure whether pets are okay, maybe one small dog",
    "Any vacancy in the villa next week?",
    "Just checking if it is available and at what price, maybe for two",
    "How much is it per night?",
    "How much per night, wondering with early pickup and transfer",
    "Could you send the password?",
    "Could you share the wifi password for check in?",
    "Please arrange a birthday surprise",
    "I was wondering about an early airport transfer",
    "An early airport transfer please",
    "Is there a swimming pool?",
    "Might there be a gym?",
    "Hello there",
    "THE AC IS BROKEN",
    "We arrived at 13am by mistake",
    "I feel good about this place",
    "क्या villa available है?",
    "क्या यहाँ ठहर सकते हैं?",
    "The shower is not working and there is no water",
    "Enjoying a slice of chocolate cake",
]

# Reservation status letters of the orders table.
ORDER_STATUS = {"F": "completed", "O": "confirmed", "P": "cancelled"}

PAYLOAD_FIELDS = ["source", "guest_name", "message", "timestamp", "booking_ref", "property_id"]


#: Session setting with which a caller deals the rows of fact tables to so many
#: partitions. Unset, as on any large input, the input's own splits are used.
INPUT_PARTITIONS = "guestflow.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str, dimension: bool = False) -> DataFrame:
    """A4: typed access to a given parquet table.

    Splits follow ``spark.sql.files.maxPartitionBytes``. Files of one row group
    cannot be split, so a caller with small test files may ask for
    INPUT_PARTITIONS; dimensions are never dealt anew."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n and not dimension else df


#: Parts that ``dealt_rows`` makes per task slot, so that a slow one is not waited for long.
PARTS_PER_SLOT = 3


@contextmanager
def dealt_rows(spark: SparkSession) -> Iterator[None]:
    """Fact tables built within are dealt evenly to all task slots, however few row
    groups their files have (a row group is never split): for a caller whose work per
    row far outweighs the deal. Where the session sets INPUT_PARTITIONS, that holds."""
    if spark.conf.get(INPUT_PARTITIONS, None):
        yield
        return
    spark.conf.set(INPUT_PARTITIONS, str(PARTS_PER_SLOT * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(INPUT_PARTITIONS)


def _pick(values, index: Column) -> Column:
    """values[index] for a small fixed list, as a column expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))


def inbound_events(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    """Inbound payload rows derived from ``events`` (one per event).

    Columns: event_id, guest_id, event_value, message_id + the six payload
    fields as strings (timestamp as ISO text), exactly as a channel would
    send them, including planted bad rows; plus any ``keep`` columns of
    ``events`` passed through from the same scan.
    """
    keep = list(keep)
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", *keep)
    e = F.col("event_id")
    shifted = F.expr("timestampadd(DAY, CAST(event_id % 180 AS INT), ts)")
    return ev.select(
        e.alias("event_id"),
        F.col("user_id").alias("guest_id"),
        F.col("value").alias("event_value"),
        F.concat(F.lit("m-"), e.cast("string")).alias("message_id"),
        F.when(e % 53 == 0, F.lit("telegram")).otherwise(_pick(CHANNELS, e % 5)).alias("source"),
        F.when(e % 59 == 0, F.lit("")).when(e % 61 == 0, F.lit("   "))
         .otherwise(F.concat(F.lit("Guest"), F.col("user_id").cast("string"), F.lit(" Family")))
         .alias("guest_name"),
        F.when(e % 47 == 0, F.lit("")).otherwise(_pick(MESSAGE_TEMPLATES, e % 24)).alias("message"),
        F.when(e % 43 == 0, F.lit("not-a-timestamp"))
         .otherwise(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.when(e % 11 < 3, F.lit(None).cast("string")).when(e % 37 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("BK-"), ((e * 7) % 20000).cast("string"))).alias("booking_ref"),
        F.when(e % 67 == 0, F.lit(None).cast("string")).when(e % 41 == 0, F.lit("villa-unknown"))
         .otherwise(F.concat(F.lit("villa-"), (F.col("user_id") % 25).cast("string"))).alias("property_id"),
        *keep,
    )


def inbound_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same payloads serialised as JSON text, the way they arrive on the wire.

    Absent (null) fields are left out of the JSON, as a channel that omits them.
    """
    inb = inbound_events(spark, sf_dir)
    return inb.select("event_id", "guest_id", "event_value", "message_id",
                      F.to_json(F.struct(*PAYLOAD_FIELDS)).alias("raw"))


def _json(value: Column) -> Column:
    """A string as a JSON value."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def case_documents(spark: SparkSession, sf_dir: str, size: int = 500) -> DataFrame:
    """Test-case documents (one JSON text per row, ``size`` cases at most) from the
    payloads of ``events``, with planted wrong types and expectations (FIXTURES.md §3)."""
    inb = inbound_events(spark, sf_dir)
    e = F.col("event_id")
    typed = {"message": F.when(e % 71 == 0, F.lit("5")), "booking_ref": F.when(e % 73 == 0, F.lit('{"ref":"BK-1"}')),
             "guest_name": F.when(e % 79 == 0, F.lit("null")), "property_id": F.when(e % 83 == 0, F.lit("true"))}
    value = {n: F.coalesce(typed.get(n, F.lit(None)), F.when(F.col(n).isNotNull(), _json(F.col(n)))) for n in PAYLOAD_FIELDS}
    fields = [F.concat(F.lit(f'"{n}":'), v) for n, v in value.items()]  # null: left out
    status = F.when((e % 43 == 0) | (e % 47 == 0) | (e % 53 == 0) | (e % 59 == 0) | (e % 67 == 0) | (e % 71 == 0) | (e % 73 == 0)
                    | (e % 79 == 0) | (e % 83 == 0) | (e % 89 == 0), F.lit(422)).when(e % 2 == 0, F.lit(200))
    expected = F.when(e % 3 != 0, F.concat(F.lit(',"expected_query_type":"'), _pick([t for t, _ in TEMPLATE_EXPECTED], e % 24),
                                           F.lit('","expected_action":"'), _pick([a for _, a in TEMPLATE_EXPECTED], e % 24), F.lit('"')))
    case = F.concat(F.lit('{"id":"'), F.col("message_id"), F.lit('","description":"event payload"'), F.coalesce(expected, F.lit("")),
                    F.coalesce(F.concat(F.lit(',"expected_status":'), status.cast("string")), F.lit("")),
                    F.lit(',"payload":{'), F.concat_ws(",", *fields), F.lit("}}"))
    return (inb.groupBy(F.floor(e / size).alias("part")).agg(F.concat_ws(",", F.collect_list(case)).alias("cases"))
            .select(F.concat(F.lit('{"test_cases":['), F.col("cases"), F.lit("]}")).alias("raw")))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: property facts keyed by id, from nation ⋈ region (25 rows)."""
    n = table(spark, sf_dir, "nation", dimension=True)
    r = table(spark, sf_dir, "region", dimension=True)
    k = F.col("n_nationkey")
    bedrooms = (F.lit(1) + k % 5).cast("int")
    return (n.join(r, n.n_regionkey == r.r_regionkey, "left")
            .select(
                F.concat(F.lit("villa-"), k.cast("string")).alias("id"),
                F.col("n_name").alias("name"),
                F.col("r_name").alias("location"),
                bedrooms.alias("bedrooms"),
                (bedrooms * 2).cast("int").alias("max_guests"),
                (k % 2 == 0).alias("private_pool"),
                F.lit("14:00:00").alias("check_in_time"),
                F.lit("11:00:00").alias("check_out_time"),
                (F.lit(8000) + k * 500).cast("decimal(10,2)").alias("base_rate_inr"),
                (F.lit(1000) + k * 100).cast("decimal(10,2)").alias("extra_guest_rate_inr"),
                F.when(k % 6 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("stay-"), k.cast("string"), F.lit("-wifi"))).alias("wifi_password"),
                F.lit("8:00 AM to 10:00 PM").alias("caretaker_hours"),
                (k % 3 == 0).alias("chef_available"),
                F.when(k % 4 == 0, F.lit("Booked")).otherwise(F.lit("Available"))
                 .alias("availability_april_20_24"),
                F.lit("Free cancellation up to 7 days before check-in").alias("cancellation_policy"),
                F.lit(True).alias("is_active"),
            ))


def guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guests from ``customer``; email and phone shapes plant violations and
    phone duplicates (FIXTURES.md §3)."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    clean = F.regexp_replace(F.col("c_name"), "#", "")
    half = F.lpad(F.floor(key / 2).cast("string"), 8, "0")
    return c.select(
        key.alias("id"),
        F.col("c_name").alias("full_name"),
        F.when(key % 3 == 0, F.lit(None).cast("string"))
         .when(key % 10 == 7, F.concat(F.col("c_name"), F.lit("@example.org")))
         .otherwise(F.concat(clean, F.lit("@example.org"))).alias("email"),
        F.when(key % 2 == 0, F.concat(F.lit("+91 98"), half))
         .otherwise(F.concat(F.lit("098"), half)).alias("phone"),
        F.col("c_nationkey").alias("nationkey"),
    )


def channel_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One identity per customer and channel where (key + channel index) % 3 <> 0."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    chans = F.posexplode(F.array(*[F.lit(ch) for ch in CHANNELS])).alias("ch_idx", "channel")
    return (c.select("c_custkey", "c_name", chans)
            .filter((F.col("c_custkey") + F.col("ch_idx")) % 3 != 0)
            .select(
                F.concat(F.lit("gci-"), F.col("channel"), F.lit("-"), F.col("c_custkey").cast("string")).alias("id"),
                F.col("c_custkey").alias("guest_id"),
                F.col("channel"),
                F.concat(F.col("channel"), F.lit(":"), F.col("c_custkey").cast("string")).alias("channel_guest_id"),
                F.col("c_name").alias("channel_display_name"),
            ))


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations from ``orders``; dates moved into 2024 (FIXTURES.md §3)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    check_in = F.date_add(F.lit("2024-01-01").cast("date"), (k % 180).cast("int"))
    status = F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("res-"), k.cast("string")).alias("id"),
        F.concat(F.lit("BK-"), k.cast("string")).alias("booking_ref"),
        F.col("o_custkey").alias("guest_id"),
        F.concat(F.lit("villa-"), (F.col("o_custkey") % 25).cast("string")).alias("property_id"),
        _pick(CHANNELS, k % 5).alias("channel"),
        check_in.alias("check_in_date"),
        F.date_add(check_in, (k % 8).cast("int")).alias("check_out_date"),
        (k % 7).cast("int").alias("num_guests"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount_inr"),
        F.when(status == "F", F.lit(ORDER_STATUS["F"])).when(status == "O", F.lit(ORDER_STATUS["O"]))
         .when(status == "P", F.lit(ORDER_STATUS["P"])).otherwise(F.lit("no_show")).alias("status"),
        (k % 7 < 4).alias("checklist_confirmed"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: user → inbound, assistant → outbound, system dropped."""
    c = table(spark, sf_dir, "conversations")
    return (c.filter(F.col("role").isin("user", "assistant"))
            .select("conv_id", "turn", "role",
                    F.when(F.col("role") == "user", F.lit("inbound")).otherwise(F.lit("outbound")).alias("direction"),
                    F.col("text")))



#: Values that do not fit, planted in the text exports of the domain tables: per
#: table (column, key expression, modulus of the keys hit, text). FIXTURES.md §3.
WRONG_VALUES = {
    "properties": [("bedrooms", "CAST(substr(id, 7) AS BIGINT) + 1", 11, "many")],
    "guests": [("identity_verified", "id", 89, "perhaps")],
    "guest_channel_identities": [("guest_id", "guest_id", 97, "unknown")],
    "reservations": [("num_guests", "CAST(substr(id, 5) AS BIGINT)", 101, "two"), ("check_in_date", "CAST(substr(id, 5) AS BIGINT)", 103, "soon"),
                     ("total_amount_inr", "CAST(substr(id, 5) AS BIGINT)", 107, "1e12")],
    "conversations": [("opened_at", "guest_id", 53, "yesterday")],
    "messages": [("sent_at", "event_id", 109, "later")],
    "ai_message_metadata": [("confidence_score", "event_id", 113, "high"), ("processing_time_ms", "event_id", 127, "fast")],
    "escalations": [("sla_breached", "event_id", 131, "soon")],
}
#: Columns left empty in the exports that defaults are filled into: per table
#: (column, key expression, modulus).
LEFT_EMPTY = {
    "properties": [("bedrooms", "CAST(substr(id, 7) AS BIGINT)", 4)], "guests": [], "guest_channel_identities": [],
    "reservations": [("status", "CAST(substr(id, 5) AS BIGINT)", 19), ("num_guests", "CAST(substr(id, 5) AS BIGINT)", 23)],
    "conversations": [("status", "guest_id", 3)], "messages": [("delivery_status", "event_id", 29)],
    "ai_message_metadata": [("model_version", "event_id", 31)], "escalations": [("severity", "event_id", 37), ("status", "event_id", 41)],
}


def text_export(df: DataFrame, table: str, columns) -> DataFrame:
    """A domain table as an export of texts (those of ``columns`` it has), with its
    WRONG_VALUES."""
    wrong = {}
    for col, key, mod, text in WRONG_VALUES[table]:
        wrong[col] = F.when(F.expr(f"({key}) % {mod} = 0"), F.lit(text))
    cells = {c: F.coalesce(wrong[c], F.col(c).cast("string") if c in df.columns else F.lit(None)) if c in wrong else F.col(c).cast("string")
             for c in columns if c in df.columns or c in wrong}
    return df.select(*[v.alias(c) for c, v in cells.items()])


def with_empty_cells(df: DataFrame, table: str) -> DataFrame:
    """A domain table with its LEFT_EMPTY cells null."""
    return df.withColumns({c: F.when(F.expr(f"({key}) % {mod} = 0"), F.lit(None)).otherwise(F.col(c)) for c, key, mod in LEFT_EMPTY[table]})


# --- FIXED VALUES (our own expectations, FIXTURES.md §2): query type and action
# each template should get, in template order.
TEMPLATE_EXPECTED = [
    ("pre_sales_availability", "agent_review"),
    ("post_sales_checkin", "auto_send"),
    ("complaint", "escalate"),
    ("pre_sales_availability", "auto_send"),
    ("pre_sales_availability", "agent_review"),
    ("pre_sales_availability", "auto_send"),
    ("pre_sales_availability", "agent_review"),
    ("pre_sales_pricing", "auto_send"),
    ("pre_sales_pricing", "agent_review"),
    ("post_sales_checkin", "auto_send"),
    ("post_sales_checkin", "agent_review"),
    ("special_request", "agent_review"),
    ("special_request", "escalate"),
    ("special_request", "agent_review"),
    ("general_enquiry", "agent_review"),
    ("general_enquiry", "agent_review"),
    ("general_enquiry", "agent_review"),
    ("complaint", "escalate"),
    ("complaint", "escalate"),
    ("pre_sales_pricing", "auto_send"),
    ("pre_sales_availability", "auto_send"),
    ("general_enquiry", "agent_review"),
    ("complaint", "escalate"),
    ("special_request", "agent_review"),
]
