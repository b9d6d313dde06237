"""Streams: alerts with state and timers, rate counts in two stages, the flow on micro-batches."""
import datetime as dt
import json

from conftest import SF001
from guestflow.operators.reports import rate_counts
from guestflow.plans import domain as DOM
from guestflow.plans import registry as REG
from guestflow.sources import fixtures
from guestflow.sources.sinks import scratch_path
from guestflow.streaming import alerts as A
from guestflow.streaming import stream as S
from guestflow.streaming.stream import batch_counts, replay_rate_counts, run_rate_counts, stream_process, write_deliveries
from pyspark.sql import functions as F


def t(hour, minute=0, day=1):
    return dt.datetime(2024, 4, day, hour, minute)


def feed(spark, base, rows):
    """(id, kind, at, deadline, seen_at) as one file of the log, then a run."""
    spark.createDataFrame(rows, A.EVENT_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/in")
    return A.run_alerts(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", 2, keep_days=2)


def sent(spark, base):
    return sorted((r.escalation_id, r.level, r.recipient, r.alert_at) for r in spark.read.parquet(f"{base}/out").collect())


def test_alerts_whatever_the_order_of_arrival(spark):
    base = scratch_path(spark, "alerts-test")
    opened = lambda i, at, due, seen=None: (i, A.OPENED, at, due, seen or at)
    answer = lambda i, at, seen=None: (i, A.RESPONDED, at, None, seen or at)
    clock = lambda at: ("", A.CLOCK, None, None, at)
    feed(spark, base, [answer("early", t(10, 10)), opened("none", t(10), t(10, 30)), opened("late", t(10), t(11)), opened("far", t(10), t(10, day=25)), clock(t(10, 20))])
    assert [x[:2] for x in sent(spark, base)] == [("far", 1), ("late", 1), ("none", 1)]
    feed(spark, base, [opened("early", t(10), t(10, 30), t(10, 40)), answer("late", t(11, 5)), opened("twice", t(11), t(12)), opened("twice", t(11), t(12)),
                       answer("twice", t(11, 50)), answer("twice", t(11, 55)), clock(t(13))])
    # these two reach the log after their own deadlines: both levels at once, or only the first if answered in time
    feed(spark, base, [opened("past", t(9), t(9, 30), t(13, 30)), opened("past answered", t(9), t(9, 30), t(13, 30)), answer("past answered", t(9, 10), t(13, 30)),
                       opened("none", t(10), t(10, 30), t(13, 30)), clock(t(14))])
    assert feed(spark, base, [("stale", A.OPENED, t(12), t(13), t(12))]) == 1  # behind the log's clock: dropped, and counted
    feed(spark, base, [clock(t(11, day=25))])
    one = lambda i, at: (i, 1, "on_call_manager", at)
    two = lambda i, at: (i, 2, "senior_manager", at)
    assert sent(spark, base) == sorted([one("early", t(10)), one("none", t(10)), two("none", t(10, 30)), one("late", t(10)), two("late", t(11)),
                                        one("far", t(10)), two("far", t(10, day=25)), one("twice", t(11)), one("past", t(9)), two("past", t(9, 30)),
                                        one("past answered", t(9))])


def test_a_delay_lets_stale_rows_in(spark):
    base = scratch_path(spark, "alerts-test")
    for rows in ([("a", A.OPENED, t(10), t(11), t(10)), ("", A.CLOCK, None, None, t(12))], [("b", A.OPENED, t(9), t(10), t(9)), ("", A.CLOCK, None, None, t(20))]):
        spark.createDataFrame(rows, A.EVENT_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/in")
        assert A.run_alerts(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", 2, delay="4 hours") == 0
    assert [x[:2] for x in sent(spark, base)] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_alert_state_is_read_by_groups(spark):
    """Many escalations in few groups: alerts as one by one, over several batches, with a state row and a timer per group."""
    base = scratch_path(spark, "alerts-test")
    n = 300
    answered = lambda i: (None, 20, 40)[i % 3]  # minutes: never, in time, late
    due = lambda i: t(10, 30) + dt.timedelta(minutes=i % 200)
    parts = [[(f"e{i}", A.OPENED, t(10), due(i), t(10)) for i in range(n)] + [(f"e{i}", A.OPENED, t(10, 1), due(i), t(10)) for i in range(0, n, 7)],
             [(f"e{i}", A.RESPONDED, due(i) + dt.timedelta(minutes=answered(i) - 30), None, t(10, 20)) for i in range(n) if answered(i)] + [("", A.CLOCK, None, None, t(11, 30))],
             [("", A.CLOCK, None, None, t(20))], [("", A.CLOCK, None, None, t(20, day=9))]]
    states = []
    for rows in parts:
        spark.createDataFrame(rows, A.EVENT_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/in")
        q = A.run_to_end(A.deadline_alerts(spark.readStream.schema(A.EVENT_SCHEMA).json(f"{base}/in"), keep_days=2, buckets=3), f"{base}/out", f"{base}/ckpt", 2,
                         {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
        states.append([op["customMetrics"].get("numRegisteredTimers", 0) for p in q.recentProgress for op in p["stateOperators"]])
    want = [(f"e{i}", 1, "on_call_manager", t(10)) for i in range(n)]
    want += [(f"e{i}", 2, "senior_manager", due(i)) for i in range(n) if answered(i) != 20]
    assert sent(spark, base) == sorted(want)
    assert max(map(max, states)) <= 3 and sum(states[0]) > 0


def test_replayed_alerts_equal_the_batch(spark):
    esc = DOM.escalations(spark, SF001)
    base = scratch_path(spark, "alerts-test")
    assert A.replay_alerts(A.event_log(esc), base, cuts=["2024-02-01 00:00:00", "2024-04-10 00:00:00"], state_partitions=3) == 0
    rows = esc.collect()
    want = [(r.id, 1) for r in rows] + [(r.id, 2) for r in rows if r.first_response_at is None or r.first_response_at > r.sla_deadline]
    assert [x[:2] for x in sent(spark, base)] == sorted(want)


def test_replays_deal_the_rows_of_one_row_group(spark, tmp_path, monkeypatch):
    """The log is made in all task slots, however few row groups the file has, and the session's setting is left alone."""
    n = 3000
    (spark.range(0, n, 1, 1).selectExpr("id AS event_id", "timestampadd(MINUTE, CAST(id AS INT), timestamp_ntz'2024-01-01 00:00:00') AS ts", "id % 40 AS user_id",
                                        "'click' AS event_type", "CAST(id % 1500 AS DOUBLE) AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet"))
    spread = []

    def counted(replay):
        def run(log, *args, **kw):
            spread.append([r["count"] for r in log.groupBy(F.spark_partition_id()).count().collect()])
            return replay(log, *args, **kw)
        return run

    for module, name in ((A, "replay_alerts"), (S, "replay_rate_counts")):
        monkeypatch.setattr(module, name, counted(getattr(module, name)))
    breaches = REG.stream_sla_timer(spark, str(tmp_path)).collect()
    assert REG.stream_sla_alerts(spark, str(tmp_path)).count() > len(breaches)
    assert REG.stream_rate_limit(spark, str(tmp_path)).count() > 0
    esc = DOM.escalations(spark, str(tmp_path)).where("first_response_at IS NULL OR first_response_at > sla_deadline")
    assert sorted(map(tuple, breaches)) == sorted(map(tuple, esc.select("id", "sla_deadline").collect())) and breaches
    assert all(len(rows) >= spark.sparkContext.defaultParallelism and max(rows) < sum(rows) / 3 for rows in spread) and len(spread) == 3
    assert spark.conf.get(fixtures.INPUT_PARTITIONS, None) is None


def test_rate_counts_stream_equals_batch(spark):
    m = DOM.messages(spark, SF001).filter(F.col("direction") == "inbound").withColumnRenamed("id", "message_id")
    base = scratch_path(spark, "rate-test")
    assert replay_rate_counts(m, base, "1 day", 3, watermark="1 day", salts=4) == 0
    assert sorted(map(tuple, spark.read.parquet(f"{base}/out").collect())) == sorted(map(tuple, rate_counts(m, "1 day", 3).collect()))


def test_rate_counts_count_what_comes_too_late(spark):
    base = scratch_path(spark, "rate-test")
    late = []
    for rows in ([("v", "direct", t(10, i), f"a{i}") for i in range(5)] + [("v", "direct", t(15), "b")], [("v", "direct", t(10, 7), "late"), ("v", "direct", t(15, 1), "c")],
                 [(None, "clock", t(23), None)]):
        spark.createDataFrame(rows, "property_id string, channel string, sent_at timestamp, message_id string").coalesce(1).write.mode("append").json(f"{base}/in")
        late.append(run_rate_counts(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", 2, window="1 hour", limit=2, watermark="10 minutes"))
    got = sorted((r.window_start.hour, r.n_messages, r.over_limit) for r in spark.read.parquet(f"{base}/out").where("property_id = 'v'").collect())
    assert late == [0, 1, 0] and got == [(10, 5, True), (15, 2, False)]


PAYLOAD = ["source", "guest_name", "message", "timestamp", "booking_ref", "property_id"]


def test_stream_branches_restart_and_counts(spark):
    inb = fixtures.inbound_events(spark, SF001)
    base = scratch_path(spark, "s1-test")
    write_deliveries(inb.repartition(3).select(F.col("message_id").alias("key"), F.to_json(F.struct(*PAYLOAD)).alias("value")), f"{base}/in")
    for _ in range(2):  # a restart on the same checkpoint finds nothing new and writes nothing twice
        stream_process(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", batch_bytes=1)
    responses, rejects, errors = (spark.read.parquet(f"{base}/out/{b}") for b in ("responses", "rejects", "errors"))
    assert (responses.count(), rejects.count(), errors.count()) == (891, 93, 16)
    assert responses.select("message_id").distinct().count() == 891
    env = rejects.filter(F.col("message_id") == "m-0").select("envelope.error", F.size("envelope.details").alias("n")).first()
    assert env.error == "Request validation failed" and env.n >= 2
    # the counts of each micro-batch, observed while its rows were made
    counts = batch_counts(spark, f"{base}/out").collect()
    for branch, df in (("responses", responses), ("rejects", rejects), ("errors", errors)):
        assert {r.batch_id: r[branch] for r in counts} == {b: n for b, n in df.groupBy("batch_id").count().collect()} | {r.batch_id: 0 for r in counts if not r[branch]}
    assert sum(r.deliveries for r in counts) == 1000 and sum(r.unusable_bodies for r in counts) == 0 and len(counts) > 1


def test_the_payload_cannot_set_the_message_id(spark):
    good = {"source": "direct", "guest_name": "Ana", "message": "Hello", "timestamp": "2026-05-05T10:30:00Z", "property_id": "v", "message_id": "forged"}
    base = scratch_path(spark, "s1-test")
    df = spark.createDataFrame([("k1", json.dumps(good)), (None, json.dumps(good)), (None, "{oops")], "key string, value string")
    write_deliveries(df.coalesce(1), f"{base}/in")
    stream_process(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    ids = sorted(r.message_id for r in spark.read.parquet(f"{base}/out/responses").collect())
    assert len(ids) == 2 and "k1" in ids and "forged" not in ids and all(i == "k1" or len(i) == 36 for i in ids)
    assert batch_counts(spark, f"{base}/out").first().unusable_bodies == 1
