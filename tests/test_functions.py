"""Column functions and small operators against hand-made rows, plus the
classification counts FIXTURES.md states for whole texts."""
from pyspark.sql import functions as F

from conftest import SF01
from guestflow.functions.classify import classify, explain_from_hits, keyword_hits
from guestflow.functions.text import first_name, message_id, normalize_phone, property_text
from guestflow.operators import constraints as CON
from guestflow.sources import fixtures


def test_user_turns_classes(spark):
    t = fixtures.conversation_turns(spark, SF01).filter(F.col("role") == "user")
    got = {r.qt: r["count"] for r in t.groupBy(classify("text").alias("qt")).count().collect()}
    assert got == {"general_enquiry": 274, "pre_sales_pricing": 4, "pre_sales_availability": 1}


def test_document_classes_whole_texts(spark):
    d = fixtures.table(spark, SF01, "documents").withColumn("_h", keyword_hits("text"))
    m = d.select(explain_from_hits("_h").alias("m"))
    got = {(r.qt, r.by): r["count"] for r in
           m.groupBy(F.col("m.query_type").alias("qt"), F.col("m.matched_by").alias("by")).count().collect()}
    assert got[("general_enquiry", "fallback")] == 734
    assert got[("general_enquiry", "keyword")] == 103
    assert got[("pre_sales_pricing", "keyword")] == 76
    assert got[("pre_sales_availability", "keyword")] == 57
    assert got[("complaint", "keyword")] == 30


def test_phone_and_first_name(spark):
    df = spark.createDataFrame([("+91 98765 43210", "  Ravi  Kumar"), ("098765 43210", "Ravi"),
                                ("9876543210", "   "), ("0044 20 7946 0000", None), (None, "\tAnn\tLee")],
                               "p string, n string")
    rows = df.select(normalize_phone("p").alias("e164"), first_name("n").alias("f")).collect()
    assert [r.e164 for r in rows] == ["+919876543210", "+919876543210", "+919876543210", "+442079460000", None]
    assert [r.f for r in rows] == ["Ravi", "Ravi", None, None, "Ann"]


def test_message_id_stable(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "raw string")
    ids = [r.i for r in df.select(message_id("raw").alias("i")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 36 and ids[0].count("-") == 4


def test_property_text_layout(spark):
    props = fixtures.properties(spark, SF01).filter(F.col("id").isin("villa-6", "villa-7"))
    p = props.select(*[F.col(c).alias("p_" + c) for c in props.columns])
    rows = {r.p_id: r.t for r in p.select("p_id", property_text("p_").alias("t")).collect()}
    assert rows["villa-6"].count("\n") == 9 and "WiFi Password: Not on file" in rows["villa-6"]
    assert "Private Pool: No" in rows["villa-7"] and rows["villa-7"].startswith("Property: ")
    miss = spark.createDataFrame([("villa-x",)], "property_id string").join(p, F.col("property_id") == F.col("p_id"), "left")
    unknown = miss.select(property_text("p_").alias("t")).first().t
    assert unknown == "Property details unavailable."


def test_defaults(spark):
    g = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id bigint, full_name string")
    d = CON.apply_defaults(g, "guests", "2024-04-01 00:00:00").orderBy("id").collect()
    assert all(r.identity_verified is False for r in d) and str(d[0].created_at) == "2024-04-01 00:00:00"


def test_first_name_unicode_space(spark):
    df = spark.createDataFrame([("\u00a0Ravi\u00a0Kumar",), ("\u00a0\u00a0",)], "n string")
    assert [r.f for r in df.select(first_name("n").alias("f")).collect()] == ["Ravi", None]


def test_redact_unverified_prompts(spark):
    from guestflow.plans.process import with_decision, with_prompts
    from guestflow.functions.text import REDACTED_WIFI
    rows = [("m1", "Ann Lee", "whatsapp", "wifi password?", "BK-1", "villa-1"),
            ("m2", "Bo Kim", "whatsapp", "wifi password?", None, "villa-1")]
    df = spark.createDataFrame(rows, "message_id string, first_name string, source string, message string, "
                                     "booking_ref string, property_id string")
    props = fixtures.properties(spark, SF01)
    plain = {r.message_id: r.prompt for r in with_prompts(with_decision(df), props).collect()}
    red = {r.message_id: r.prompt for r in with_prompts(with_decision(df), props, redact_unverified=True).collect()}
    assert "stay-1-wifi" in plain["m2"] and "stay-1-wifi" in red["m1"]
    assert "stay-1-wifi" not in red["m2"] and REDACTED_WIFI in red["m2"]


def test_drop_redeliveries(spark, tmp_path):
    from guestflow.sources.inbound import read_inbound
    body = '{"source":"direct","guest_name":"A B","message":"hi","timestamp":"2026-01-01T00:00:00Z","property_id":"villa-1"}'
    p = tmp_path / "in.jsonl"
    p.write_text("\n".join([body, body, body.replace("hi", "hello")]) + "\n")
    assert read_inbound(spark, str(p)).count() == 3
    assert read_inbound(spark, str(p), drop_redeliveries=True).count() == 2
