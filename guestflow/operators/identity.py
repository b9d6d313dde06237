"""Guest identity across channels and conversation threads.

The booking reference is the identity anchor; a channel identity is the
second choice; the rest stay unresolved and become provisional guests, which
are listed for people to merge, never merged automatically.
All joins are equi-joins on keys; aggregates run map-side first.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sender_key() -> F.Column:
    """The channel-specific id a message arrives with: 'channel:sender'."""
    return F.concat(F.col("channel"), F.lit(":"), F.col("guest_id").cast("string"))


def inbound(msgs: DataFrame) -> DataFrame:
    return msgs.filter(F.col("direction") == "inbound")


def resolve_booking(msgs: DataFrame, res: DataFrame, booking_col: str = "booking_ref") -> DataFrame:
    """booking_ref → reservation → guest (left join; empty ref = none).

    Rows without a reference are often a third of all; as one null join key
    they would meet in one task, so such a row gets a key of its own that no
    reservation has."""
    r = res.select(F.col("booking_ref").alias("_ref"), F.col("id").alias("reservation_id"),
                   F.col("guest_id").alias("booking_guest_id"))
    none = F.coalesce(msgs[booking_col], F.lit("")) == ""
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*msgs.columns).cast("string"))
    return (msgs.withColumn("_key", F.when(none, spread).otherwise(msgs[booking_col]))
            .join(r, F.col("_key") == r["_ref"], "left").drop("_ref", "_key"))


def resolve_channel(msgs: DataFrame, ident: DataFrame) -> DataFrame:
    """(channel, channel_guest_id) → guest (two-key left join)."""
    i = ident.select(F.col("channel").alias("_ch"), F.col("channel_guest_id").alias("_cgid"),
                     F.col("guest_id").alias("channel_guest"))
    m = msgs.withColumn("channel_guest_id", sender_key())
    return m.join(i, (m["channel"] == i["_ch"]) & (m["channel_guest_id"] == i["_cgid"]), "left") \
        .drop("_ch", "_cgid")


def unify(msgs: DataFrame, res: DataFrame, ident: DataFrame) -> DataFrame:
    """Booking anchor first, then channel identity, else unresolved."""
    u = resolve_channel(resolve_booking(msgs, res), ident)
    how = (F.when(F.col("booking_guest_id").isNotNull(), F.lit("booking"))
           .when(F.col("channel_guest").isNotNull(), F.lit("channel"))
           .otherwise(F.lit("unresolved")))
    return (u.withColumn("resolved_guest_id", F.coalesce("booking_guest_id", "channel_guest"))
            .withColumn("resolution", how))


def provisional(unified: DataFrame) -> DataFrame:
    """One provisional, unverified guest per unresolved sender.

    Times are hash-aggregated per sender and name first; names are compared only
    among a sender's distinct ones."""
    named = (unified.filter(F.col("resolution") == "unresolved")
             .groupBy("channel", "channel_guest_id", "guest_name").agg(F.min("sent_at").alias("sent_at")))
    return (named.groupBy("channel", "channel_guest_id")
            .agg(F.min("sent_at").alias("first_seen_at"), F.min("guest_name").alias("full_name"))
            .select(F.concat(F.lit("prov-"), F.col("channel_guest_id")).alias("id"), "full_name", "channel",
                    "channel_guest_id", F.lit(False).alias("identity_verified"), "first_seen_at"))


def merge_candidates(prov: DataFrame, unified: DataFrame) -> DataFrame:
    """Provisional senders that later present a booking: (provisional id,
    booking guest) pairs for a person to review."""
    later = unified.filter(F.col("resolution") == "booking").select(
        F.col("channel_guest_id").alias("_cgid"), F.col("sent_at").alias("_at"), "booking_guest_id")
    j = prov.join(later, (prov["channel_guest_id"] == later["_cgid"]) & (later["_at"] > prov["first_seen_at"]),
                  "inner")
    return (j.groupBy(F.col("id").alias("provisional_id"), F.col("booking_guest_id"))
            .agg(F.min("_at").alias("first_booking_message_at")))


def verify_guests(guests: DataFrame, res: DataFrame) -> DataFrame:
    """verified = linked to at least one confirmed reservation."""
    confirmed = res.filter(F.col("status") == "confirmed").select(F.col("guest_id").alias("_g")).distinct()
    flagged = guests.join(confirmed, guests["id"] == confirmed["_g"], "left")
    return flagged.select("id", F.col("_g").isNotNull().alias("identity_verified"))


def thread_key_cols():
    return ["guest_id", "channel", "property_id", "reservation_id"]


def thread_id() -> F.Column:
    """Deterministic thread id from the null-safe thread key (no join needed)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in thread_key_cols()]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def thread(msgs: DataFrame, res: DataFrame) -> DataFrame:
    """Threads by guest, channel, property and reservation (nullable;
    messages without a reservation share a thread, null-safe).

    One aggregate per thread; partial aggregation keeps a hot thread cheap.
    """
    m = resolve_booking(msgs, res) if "reservation_id" not in msgs.columns else msgs
    return (m.groupBy(*thread_key_cols())
            .agg(F.count(F.lit(1)).alias("n_messages"), F.min("sent_at").alias("opened_at"),
                 F.max("sent_at").alias("last_message_at"))
            .withColumn("thread_id", thread_id()))
