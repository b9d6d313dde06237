"""Typed tables, the stored flow, observed counts, and deletes against brute force."""
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from guestflow.operators import cascade as CAS
from guestflow.operators import constraints as CON
from guestflow.plans import domain as DOM
from guestflow.plans.store import load_domain, load_tables, read_manifest, store_flow
from guestflow.sources import fixtures, typed
from guestflow.sources.sinks import scratch_path


def exists(path):
    return os.path.exists(path.removeprefix("file:"))


# --- types -------------------------------------------------------------------

def test_values_that_do_not_fit_are_rescued_and_set_aside(spark):
    rows = [("res-1", "BK-1", "7", "villa-1", "direct", "2024-05-01", "2024-05-03", "2", "100.50", "confirmed", None),
            ("res-2", "BK-2", "x7", "villa-1", "direct", "2024-05-01", "2024-13-03", "2", "1e12", "confirmed", "yes"),
            ("res-3", None, "7", "villa-1", "direct", "2024-05-01", "2024-05-03", "2.5", None, "confirmed", None),
            (None, "BK-4", "7", "villa-1", "direct", "2024-05-01", "2024-05-03", "2", "1.005", None, None)]
    cols = ["id", "booking_ref", "guest_id", "property_id", "channel", "check_in_date", "check_out_date", "num_guests", "total_amount_inr", "status", "vip"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    out = typed.enforce(df, "reservations")
    assert [f.dataType for f in out.schema.fields][:14] == [f.dataType for f in typed.SCHEMAS["reservations"].fields]
    got = out.collect()
    assert [r._quarantined for r in got] == [False, True, True, True]
    assert got[1]._rescued == {"guest_id": "x7", "check_out_date": "2024-13-03", "total_amount_inr": "1e12", "vip": "yes"}
    assert got[2]._rescued == {"num_guests": "2.5"} and got[2]._missing == ["booking_ref"]
    assert got[3]._missing == ["id", "status"] and got[0]._rescued == {}
    assert [tuple(r)[:2] for r in typed.accepted(out, "reservations").collect()] == [("res-1", "BK-1")]
    faults = sorted(map(tuple, typed.faults(out).collect()), key=str)
    assert faults == sorted([("res-2", "guest_id", "x7", "type"), ("res-2", "check_out_date", "2024-13-03", "type"), ("res-2", "total_amount_inr", "1e12", "type"),
                             ("res-3", "num_guests", "2.5", "type"), ("res-3", "booking_ref", None, "missing"), (None, "id", None, "missing"),
                             (None, "status", None, "missing")], key=str)
    filled = typed.enforce(df, "reservations", CON.default_values("reservations", "2024-04-01 00:00:00")).collect()
    assert filled[3].status == "confirmed" and filled[3]._missing == ["id"] and filled[2].num_guests is None  # a default never hides a wrong value


def test_times_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("villa-1", "A", "1", "2", "25:00:00"), ("villa-2", "B", "1", "2", "23:59:59")],
                               "id string, name string, bedrooms string, max_guests string, check_in_time string")
    got = typed.enforce(df, "properties").collect()
    assert [(r.check_in_time, r._quarantined) for r in got] == [(None, True), ("23:59:59", False)]
    for name in typed.SCHEMAS:
        assert typed.enforce(spark.createDataFrame([], "id string, extra string"), name).collect() == []


# --- stored flow and load ------------------------------------------------------

def test_flow_is_stored_once_with_a_manifest_and_removed(spark):
    path = scratch_path(spark, "flow-test")
    with store_flow(spark, SF001, path, rejected=True) as flow:
        assert read_manifest(spark, path)["rows"] == {"ok": 891, "failed": 16, "rejected": 93}
        for name in ("messages", "ai_metadata", "escalations", "conversations"):
            want = getattr(DOM, name)(spark, SF001)
            assert sorted(map(str, getattr(flow, name)().select(want.columns).collect())) == sorted(map(str, want.collect())), name
        assert flow.branch("rejected").where("size(errors) > 0 AND raw IS NOT NULL").count() == 93
        assert exists(path)
    assert not exists(path)


def test_failed_use_still_removes_the_folder(spark):
    path = scratch_path(spark, "flow-test")
    with pytest.raises(RuntimeError), store_flow(spark, SF001, path, ["messages"]):
        raise RuntimeError
    assert not exists(path)


def direct_counts(df, name):
    row = df.agg(*CON.row_counts(df, name)).first()
    return row.asDict()


def test_counts_observed_by_the_load_are_the_tables_counts(spark):
    with load_domain(spark, SF001, scratch_path(spark, "load-test")) as load:
        assert not exists(load.path + "/flow")
        for name, df in load.rows().items():
            assert {k: v for k, v in load.counts[name].items() if k != "quarantined"} == direct_counts(df, name), name
            assert load.table(name).schema == typed.SCHEMAS[name] or [f.dataType for f in load.table(name).schema] == [f.dataType for f in typed.SCHEMAS[name]]
        assert {(r.table_name, r.n_rows, r.n_null_ids, r.n_duplicate_ids) for r in CON.primary_key_report(load.rows(), load.counts).collect()} \
            == {(n, df.count(), 0, 0) for n, df in load.rows().items()}
        assert sum(r.n_outside for r in CON.domain_report(spark, load.counts).collect()) > 0  # parked conversations


def test_load_counts_planted_faults(spark):
    tables = {name: spark.createDataFrame([], "id string") for name in typed.SCHEMAS}
    tables["guests"] = spark.createDataFrame([("1", "A" * 300, "x" * 60), ("1", None, None), ("one", "C", None)], "id string, full_name string, phone string")
    tables["conversations"] = spark.createDataFrame([("c", "1", "v" * 51, "direct", "gone")], "id string, guest_id string, property_id string, channel string, status string")
    with load_tables(tables, scratch_path(spark, "load-test")) as load:
        g, c = load.counts["guests"], load.counts["conversations"]
        assert (g["rows"], g["quarantined"], g["null id"], g["null full_name"], g["wide full_name"], g["wide phone"]) == (3, 2, 1, 1, 1, 1)
        assert (c["wide property_id"], c["outside status"], c["null channel"]) == (1, 1, 0)
        keys = {r.table_name: (r.n_null_ids, r.n_duplicate_ids) for r in CON.primary_key_report(load.rows(), load.counts).collect()}
        assert keys["guests"] == (1, 1) and keys["messages"] == (0, 0)
        assert load.quarantine("guests").count() == 2


def test_defaults_of_eight_tables(spark):
    for name in typed.SCHEMAS:
        df = spark.createDataFrame([("a",)], "id string")
        got = {r.column_name: r.value for r in CON.defaulted(df, name, DOM.AS_OF).collect()}
        assert set(got) == set(CON.DEFAULTS[name])
    assert got["severity"] == "medium" and got["sla_breached"] == "false" and got["escalated_at"] == DOM.AS_OF


# --- deletes -------------------------------------------------------------------

FKS = [("a", "up", "a2", "id"), ("b", "up", "a", "id"), ("c", "up", "b", "id"), ("c", "side", "a", "id"), ("d", "up", "c", "id"), ("d", "side", "a2", "id")]
CASCADING = {("b", "up"), ("c", "up"), ("a", "up"), ("c", "side")}


def brute(rows, asked):
    """rows: {(table, id): {column: parent id}}; the greatest set that leaves nothing behind."""
    refs = [((t, i), col, (parent, row[col])) for (t, i), row in rows.items() for ch, col, parent, _ in FKS if ch == t and row.get(col) is not None]
    reach = set(asked)
    while True:
        more = {c for c, col, p in refs if (c[0], col) in CASCADING and p in reach} - reach
        if not more:
            break
        reach |= more
    alive = set(reach)
    while True:
        gone = {p for c, col, p in refs if p in alive and c not in alive}
        gone |= {x for x in alive if x not in asked and not any(c == x and (c[0], col) in CASCADING and p in alive for c, col, p in refs)}
        if not gone:
            return reach, alive
        alive -= gone


def test_deletes_equal_brute_force(spark):
    folder = scratch_path(spark, "deletes-test")
    store = lambda df: DOM.materialize(df.coalesce(1), folder)
    rnd = random.Random(3)
    rows = {}
    for t, n in (("a2", 12), ("a", 25), ("b", 30), ("c", 40), ("d", 12)):
        for i in range(n):
            pick = lambda p: rnd.choice([None, *[x for (y, x) in rows if y == p]])
            rows[(t, str(i))] = {col: pick(p) for ch, col, p, _ in FKS if ch == t}
    tables = {t: spark.createDataFrame([(i, r.get("up"), r.get("side")) for (x, i), r in rows.items() if x == t], "id string, up string, side string")
              for t in ("a2", "a", "b", "c", "d")}
    asked = {k for k in rows if k[0] in ("a2", "a") and rnd.random() < 0.7} | {("d", "1"), ("d", "2"), ("a", "nobody")}
    refs = store(CAS.edges(tables, FKS, CASCADING))
    got = CAS.cascade(spark.createDataFrame([*asked, ("a", None)], "table_name string, id string"), refs, store).collect()
    reach, alive = brute(rows, asked)
    assert {(r.table_name, r.id) for r in got} == reach and len(got) == len(reach)
    assert {(r.table_name, r.id) for r in got if r.outcome == "deleted"} == alive
    assert {(r.table_name, r.id) for r in got if r.requested} == asked
    assert all((r.outcome == "blocked") == bool(r.blocking) for r in got) and all(not r.requested for r in got if r.outcome == "spared")
    assert {r.outcome for r in got} == {"deleted", "blocked", "spared"}


def test_reviewer_blocks_a_guest_and_an_escalation_a_message(spark):
    folder = scratch_path(spark, "deletes-test")
    store = lambda df: DOM.materialize(df, folder)
    ids = lambda rows, cols: spark.createDataFrame(rows, cols)
    tables = {"guests": ids([(1,), (2,), (3,)], "id bigint"),
              "guest_channel_identities": ids([("i1", 1), ("i2", 1), ("i3", 2)], "id string, guest_id bigint"),
              "messages": ids([("m1", None, None, None), ("m2", None, None, None)], "id string, conversation_id string, guest_id bigint, property_id string"),
              "ai_message_metadata": ids([("x1", "m1", 2), ("x2", "m2", None)], "id string, message_id string, reviewed_by_agent bigint"),
              "escalations": ids([("e2", "m2", None, None, None)], "id string, message_id string, conversation_id string, guest_id bigint, property_id string")}
    refs = store(CAS.edges(tables))
    got = {r.guest_id: tuple(r)[1:] for r in CAS.guest_deletes(tables["guests"].withColumnRenamed("id", "guest_id"), refs, store).collect()}
    assert got == {1: (False, "", 2), 2: (True, "ai_message_metadata", 0), 3: (False, "", 0)}
    asked = spark.createDataFrame([("messages", "m1"), ("messages", "m2"), ("guests", "2")], "table_name string, id string")
    out = {(r.table_name, r.id): (r.outcome, r.blocking) for r in CAS.cascade(asked, refs, store).collect()}
    # the reviewed audit row goes with its message, so the reviewer can go too
    assert out == {("messages", "m1"): ("deleted", ""), ("ai_message_metadata", "x1"): ("deleted", ""), ("guests", "2"): ("deleted", ""),
                   ("guest_channel_identities", "i3"): ("deleted", ""), ("messages", "m2"): ("blocked", "escalations.message_id"),
                   ("ai_message_metadata", "x2"): ("spared", "")}


def test_loads_do_not_wait_for_each_other(spark, monkeypatch):
    """Every write begins before any is done, those beside the flow included."""
    import threading
    from guestflow.plans import store
    from guestflow.sources.sinks import scratch_path
    whole, together, begun = store.load_table, threading.Barrier(4, timeout=60), []

    def load(df, name, *rest):
        begun.append(name)
        assert spark.conf.get(store.one_writer_per_branch.KEY) == "4"  # no sort by the rows' fate
        together.wait()
        return whole(df, name, *rest)

    monkeypatch.setattr(store, "load_table", load)
    before = spark.conf.get(store.one_writer_per_branch.KEY, None)
    loaded = store.load_domain(spark, SF001, scratch_path(spark, "side-by-side"))
    assert sorted(begun) == sorted(typed.SCHEMAS) and list(loaded.counts) == list(loaded.rows())
    assert spark.conf.get(store.one_writer_per_branch.KEY, None) == before
    assert {n: df.count() for n, df in loaded.rows().items()} == {n: c["rows"] for n, c in loaded.counts.items()}


def test_rows_that_fit_build_no_array_of_faults(spark):
    rows = [("r1", "BK-1", "7", "v", "direct", "2024-01-01", "2024-01-03", "2", None, "more"), ("r2", None, "x", "v", None, "soon", "2024-01-03", "2", "5", None)]
    df = spark.createDataFrame(rows, "id string, booking_ref string, guest_id string, property_id string, channel string, check_in_date string, "
                                     "check_out_date string, num_guests string, total_amount_inr string, extra string")
    enforced = typed.enforce(df, "reservations")
    assert "lambda" not in enforced._jdf.queryExecution().analyzed().toString()
    got = {r["id"]: r for r in enforced.collect()}
    assert got["r1"]["_rescued"] == {"extra": "more"} and got["r1"]["_missing"] == ["status"] and got["r1"]["_quarantined"]
    assert got["r2"]["_rescued"] == {"guest_id": "x", "check_in_date": "soon"} and got["r2"]["_missing"] == ["booking_ref", "channel", "status"]
    fits = typed.enforce(df.where("id = 'r1'").drop("extra").withColumn("status", F.lit("confirmed")), "reservations").first()
    assert fits["_rescued"] == {} and fits["_missing"] == [] and not fits["_quarantined"]


def test_bodies_are_told_apart_as_by_their_schema(spark):
    from guestflow.operators.validate import MSG_NOT_JSON, MSG_NOT_OBJECT, typed_fields
    bodies = {'{"source":"direct"}': "JSON", '{"message":null}': "JSON", "{}": "JSON", '{"other":{"source":1}}': "JSON", "[1]": MSG_NOT_OBJECT,
              '[{"source":"direct"}]': MSG_NOT_OBJECT, '"source"': MSG_NOT_OBJECT, "null": MSG_NOT_OBJECT, "{oops": MSG_NOT_JSON}
    df = spark.createDataFrame([(b,) for b in bodies], "raw string")
    assert {r["raw"]: r["_body"] for r in typed_fields(df, "raw").collect()} == bodies
