"""Flow invariants, constraint counts, scale helpers vs brute force,
drafting failures and streaming = batch."""
import datetime as dt
import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from guestflow.operators import constraints as CON
from guestflow.operators.reports import ordinal, rolling_count
from guestflow.plans import domain as DOM
from guestflow.plans import process as P
from guestflow.sources import fixtures


def test_every_row_lands_once(spark):
    ch = P.checked_inbound(spark, SF001)
    from guestflow.operators.validate import split_valid
    ok, bad, failed = split_valid(ch)
    assert (ch.count(), ok.count(), bad.count(), failed.count()) == (1000, 891, 93, 16)


def test_fixture_counts(spark):
    """Planted violations at sf0.001 (FIXTURES.md §3)."""
    assert CON.email_violations(fixtures.guests(spark, SF001)).count() == 10
    res = fixtures.reservations(spark, SF001)
    assert CON.stay_date_violations(res).count() == 188
    assert CON.guest_count_violations(res).count() == 215
    assert CON.duplicates(fixtures.channel_identities(spark, SF001), ["channel", "channel_guest_id"]).count() == 0


def test_planted_duplicates_and_orphans(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 3)], "id string, p int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert [r.id for r in CON.duplicates(df, "id").collect()] == ["a"]
    assert [r.p for r in CON.orphans(df, "p", parent, "id").collect()] == [3]
    rep = CON.primary_key_report({"t": df}, {"t": {"rows": 4, "null id": 1}}).collect()[0]
    assert (rep.n_rows, rep.n_null_ids, rep.n_duplicate_ids) == (4, 1, 1)


def test_ordinal_matches_row_number(spark):
    rows = [(k, t) for k in ["hot", "a", "b"] for t in range(0, 5000 if k == "hot" else 40, 7)]
    df = spark.createDataFrame(rows, "k string, t int")
    got = ordinal(df, ["k"], ["t"], F.floor(F.col("t") / 100)).toPandas()
    got = got.sort_values(["k", "t"])
    want = got.groupby("k").cumcount() + 1
    assert (got["_ord"].values == want.values).all()


def test_rolling_count_matches_brute_force(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        rows.append(("hot" if i % 3 else "cold", base + dt.timedelta(hours=(i * 37) % 2000)))
    rows += [("hot", base + dt.timedelta(days=60)), ("hot", base)]  # exact window edge and peers
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz").withColumn("id", F.monotonically_increasing_id())
    got = rolling_count(df, ["k"], "ts", 60).toPandas()
    pdf = df.toPandas()
    for r in got.itertuples():
        same = pdf[(pdf.k == r.k) & (pdf.ts <= r.ts) & (pdf.ts >= r.ts - pd.Timedelta(days=60))]
        assert r.rolling_count == len(same)


def test_drafter_failures_fall_back(spark):
    class Flaky:
        def __call__(self, req):
            if "Guest1 " in req["prompt"] or req["first_name"] == "Guest1":
                raise P.DraftRateLimitError()
            if req["first_name"] == "Guest2":
                raise ConnectionError()
            return "Dear " + req["first_name"]
    out = P.processed(spark, SF001, drafter_factory=Flaky, escalate_on_draft_error=True)
    rows = out.select("first_name", "drafted_reply", "draft_error", "action").collect()
    for r in rows:
        if r.first_name == "Guest1":
            assert r.draft_error == "rate_limit" and r.drafted_reply.startswith("Hi Guest1,") and r.action == "escalate"
        elif r.first_name == "Guest2":
            assert r.draft_error == "connection"
        else:
            assert r.draft_error is None and r.drafted_reply == "Dear " + r.first_name
    assert len(rows) == 891


def test_stream_process_equals_batch(spark):
    import __spark_entry__ as E
    s = E.queries()["stream_process"](spark, SF001)
    b = E.queries()["process_messages"](spark, SF001)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_bucketed_tables_join_without_shuffle(spark):
    from guestflow.operators.reports import inbound_complaints
    from guestflow.sources.sinks import save_bucketed
    save_bucketed(DOM.messages(spark, SF001).withColumnRenamed("id", "message_id"), "gf_messages", "message_id", 8)
    save_bucketed(DOM.ai_metadata(spark, SF001), "gf_ai", "message_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = spark.table("gf_messages").withColumnRenamed("message_id", "id")
        j = inbound_complaints(m, spark.table("gf_ai"))
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert j.count() == inbound_complaints(DOM.messages(spark, SF001), DOM.ai_metadata(spark, SF001)).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latency_percentiles_exact_in_a_large_group(spark):
    from guestflow.operators.reports import processing_latency
    ai = spark.range(200_000).select(F.lit("2024-04-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
                                     F.lit("m").alias("model_version"), F.col("id").cast("int").alias("processing_time_ms"))
    r = processing_latency(ai).first()
    assert (r.n, r.p50_ms, r.p95_ms, r.max_ms, r.mean_ms) == (200_000, 99_999, 189_999, 199_999, 99_999.5)


def brute_history(rows, k):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == conv)
        for i, (turn, _, _) in enumerate(mine):
            out[conv, turn] = "\n".join(f"{role}: {text}" for _, role, text in mine[max(0, i - k):i])
    return out


@pytest.mark.parametrize("k,block", [(3, 4), (1, 4), (5, 2), (3, 64)])
def test_conversation_history_equals_brute_force(spark, k, block):
    """Dense and sparse turns: blocks with fewer turns than k, gaps of whole blocks, one turn, a long conversation."""
    import random
    from guestflow.operators.reports import conversation_history
    rnd = random.Random(k)
    rows = [(c, t, rnd.choice(["user", "assistant"]), f"text {c}.{t}") for c, turns in
            enumerate([range(40), [0], [5, 6, 7, 8, 9, 100, 101, 400], rnd.sample(range(300), 60), [3, 7, 11, 15, 19, 23, 27], []]) for t in turns]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = conversation_history(df, k, block).collect()
    want = brute_history(rows, k)
    assert {(r.conv_id, r.turn): r.history for r in got} == want and len(got) == len(want)
    assert all(r.n_history == (r.history.count("\n") + 1 if r.history else 0) for r in got)


def test_conversation_history_sends_on_only_the_ends_of_blocks(spark):
    from guestflow.operators.reports import conversation_history
    path = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/turns"
    spark.range(20_000).selectExpr("id % 2 AS conv_id", "id AS turn", "'user' AS role", "repeat('x', 50) AS text").write.mode("overwrite").parquet(path)
    plan = conversation_history(spark.read.parquet(path), 3)._jdf.queryExecution().executedPlan().toString()
    # below the exchange of the ends, Spark has already picked the last turns of each block
    assert re.search(r"Exchange hashpartitioning\(conv_id(?:(?!Exchange).)*?WindowGroupLimit[^\n]*Partial", plan, re.S), plan


def test_inbox_equals_brute_force(spark):
    from guestflow.operators.reports import inbox
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(f"c{i % 7}", f"m{i:03d}", "inbound" if i % 2 else "outbound", at(i % 5)) for i in range(70)]
    df = spark.createDataFrame(rows, "conversation_id string, id string, direction string, sent_at timestamp_ntz")
    last = {}
    for c, i, d, t in rows:
        last[c] = max(last.get(c, (at(0), "", "")), (t, i, d))
    want = sorted(((c, i, d, t) for c, (t, i, d) in last.items()), key=lambda r: (-r[3].timestamp(), r[0]))
    assert [tuple(r) for r in inbox(df, 4).collect()] == want[:4] and [tuple(r) for r in inbox(df, 50).collect()] == want


def test_ordered_reports_come_in_order(spark):
    import __spark_entry__ as E
    q = E.queries()
    rows = q["complaint_trends"](spark, SF001).collect()
    assert rows == sorted(rows, key=lambda r: (-r.month.timestamp(), -r.complaint_count, r.property_id)) and len({r.month for r in rows}) > 2
    assert q["trend_order"](spark, SF001).collect() == rows[:20]
    turns = [(r.conv_id, r.turn) for r in q["transcript"](spark, SF001).collect()]
    assert turns == sorted(turns) and len(turns) > 20
    for name, key, down in (("latest_messages", "sent_at", True), ("latest_decisions", "created_at", True), ("open_sla_queue", "sla_deadline", False)):
        rows = [(r[key], r.id) for r in q[name](spark, SF001).collect()]
        assert rows == sorted(rows, key=lambda x: (-x[0].timestamp() if down else x[0].timestamp(), x[1])), name


# --- the weekly pattern job ------------------------------------------------------

def test_weekly_runs_equal_one_full_run(spark, tmp_path):
    from guestflow.operators.reports import recurring_complaints
    from guestflow.plans.weekly import monday, patterns, run_weeks
    m, ai = DOM.messages(spark, SF001).cache(), DOM.ai_metadata(spark, SF001).cache()
    low, high = m.agg(F.min("sent_at"), F.max("sent_at")).first()
    first, end = monday(low.date()), monday(high.date()) + dt.timedelta(days=7)
    want = sorted(map(tuple, recurring_complaints(m, ai).select("property_id", "topic", "week", "n_flagged", "max_in_window").collect()))
    weeks = [first + dt.timedelta(days=7 * i) for i in range((end - first).days // 7 + 1)]
    cut = weeks[len(weeks) // 2]
    folder = str(tmp_path / "weekly")
    for a, b in ((first, cut), (cut, cut + dt.timedelta(days=7)), (cut, cut + dt.timedelta(days=7)), (cut + dt.timedelta(days=7), end)):
        run_weeks(m, ai, folder, a, b)  # one week is run twice: it replaces itself
    assert sorted(map(tuple, patterns(spark, folder).collect())) == want and len(want) > 10
    with pytest.raises(ValueError):
        run_weeks(m, ai, folder, first + dt.timedelta(days=1), end)


def test_weekly_run_reads_only_the_months_it_needs(spark, tmp_path):
    from guestflow.plans.weekly import complaint_log, run_weeks
    base = dt.datetime(2023, 1, 2, 9)
    rows = [(f"m{i}", "inbound", "villa-1", base + dt.timedelta(days=3 * i), "no wifi here") for i in range(120)]
    m = spark.createDataFrame(rows, "id string, direction string, property_id string, sent_at timestamp_ntz, raw_content string")
    ai = m.select(F.col("id").alias("message_id"), F.lit("complaint").alias("query_type"), F.col("sent_at").alias("created_at"))
    folder = tmp_path / "weekly"
    run_weeks(m, ai, str(folder), dt.date(2023, 1, 2), dt.date(2023, 12, 18))
    for old in ("2023-02", "2023-07"):  # a run that touched these months would fail on them
        for f in (folder / "log" / f"month={old}").rglob("*.parquet"):
            f.write_bytes(b"not parquet")
    run_weeks(m, ai, str(folder), dt.date(2023, 12, 18), dt.date(2023, 12, 25))
    plan = complaint_log(spark, str(folder), dt.datetime(2023, 10, 19), dt.datetime(2023, 12, 25))._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "month" in filters and "2023-10" in filters and "2023-12" in filters, plan


# --- random ids --------------------------------------------------------------------

def test_random_ids_stay_the_same_for_all_readers(spark, tmp_path):
    from guestflow.sources.inbound import pinned_ids, read_inbound
    (tmp_path / "in.jsonl").write_text("\n".join(['{"a":1}'] * 50 + ["oops"]))
    read = lambda: read_inbound(spark, str(tmp_path / "in.jsonl"), id_store=str(tmp_path / "ids")).select("message_id", "raw")
    first = sorted(map(tuple, read().collect()))
    assert sorted(map(tuple, read().collect())) == first and len({i for i, _ in first}) == 51
    assert len({r.message_id for r in read_inbound(spark, str(tmp_path / "in.jsonl")).collect()}) == 2  # by hash: equal bodies, one id
    (tmp_path / "ids" / "_SUCCESS").unlink()  # an unfinished store is made anew
    assert sorted(map(tuple, read().collect())) != first
    assert pinned_ids(spark.createDataFrame([], "raw string"), str(tmp_path / "none")).count() == 0


def test_random_ids_survive_failed_tasks(tmp_path):
    """Tasks that fail after the ids are drawn run again and find the same ids (own process: task retries)."""
    import subprocess
    import sys
    script = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from guestflow.session import ship_package
from guestflow.sources.inbound import pinned_ids
spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
ship_package(spark)

def fail_once(rows):
    out = list(rows)
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
    return iter(out)

df = spark.createDataFrame(spark.range(40, numPartitions=4).rdd.mapPartitions(fail_once), "id bigint")
ids = pinned_ids(df, {str(tmp_path / "ids")!r})
once = sorted(ids.rdd.mapPartitions(fail_once).map(tuple).collect())
assert sorted(map(tuple, ids.collect())) == once and len(set(i for _, i in once)) == 40 and [i for i, _ in once] == list(range(40))
print("SAME")
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=180)
    assert "SAME" in done.stdout, done.stderr[-2000:]
