"""S3: response-deadline alerts on a stream, with state and event-time timers.

Openings and first responses arrive as one event log. Per escalation the state holds
the deadline, the earliest response and what was sent, escalations by hash in groups
that share a timer; when a deadline has passed, the timer sends the second alert if no
response came by then. What counts is when a thing happened, not
when or in which order it arrived: a response may arrive before its opening, and an
opening that arrives after its own deadline alerts at once."""
from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.escalation import ALERTS
from .runs import dropped_rows, run_to_end

#: One row per opening or response. ``seen_at`` is when the log took it; it alone moves
#: the watermark. Rows of kind CLOCK only do that.
EVENT_SCHEMA = T.StructType([T.StructField("escalation_id", T.StringType()), T.StructField("kind", T.StringType()),
                             T.StructField("at", T.TimestampType()), T.StructField("deadline", T.TimestampType()),
                             T.StructField("seen_at", T.TimestampType())])
OPENED, RESPONDED, CLOCK = "opened", "responded", "clock"
DAY_MS = 86_400_000
WAITING, OPEN, CLOSED = 0, 1, 2


def alert_processor(keep_ms: int) -> StatefulProcessor:
    """Level 1 when an escalation opens, level 2 at its deadline without a response.

    State per bucket of escalations: of each its deadline, earliest response (both in
    ms, null if unknown) and stage, as one JSON text, and the bucket's timer, which
    stands at the earliest time that anything in it falls due. So a batch reads and
    writes a bucket once, however many escalations it holds. An escalation goes
    ``keep_ms`` after its deadline; until then a repeated opening sends nothing. A
    response without an opening waits as long.

    A class of its own per call: Spark's helper process on the driver, which asks it
    for its state, gets it by value and need not import this package."""

    def late(deadline: int, answered: int | None) -> bool:
        return answered is None or answered > deadline

    def due(deadline: int | None, answered: int | None, stage: int) -> int:
        return answered + keep_ms if stage == WAITING else deadline if stage == OPEN else deadline + keep_ms

    class AlertProcessor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("escalations", "timer long, held string")

        def load(self) -> tuple[int | None, dict[str, list]]:
            timer, held = self.state.get() or (None, "{}")
            return timer, json.loads(held)

        def save(self, timer: int | None, held: dict[str, list], after: int = 0) -> None:
            """``timer``: the bucket's standing one; a new one lies beyond ``after``."""
            if not held:
                self.state.clear()
                return
            first = max(min(due(*x) for x in held.values()), after + 1)
            if timer is None or first < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
            self.state.update((timer, json.dumps(held)))

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            (timer, held), now = self.load(), timerValues.getCurrentWatermarkInMs()
            opened: dict[str, int] = {}
            changed = False
            for r in rows:
                i, at = r.escalation_id, r.at_ms
                deadline, answered, stage = held.get(i) or (None, None, WAITING)
                if r.kind == OPENED and at is not None and r.deadline_ms is not None and stage == WAITING:
                    if i not in opened or at < opened[i]:  # repeated openings in one batch: the earliest
                        opened[i], held[i], changed = at, [r.deadline_ms, answered, WAITING], True
                elif r.kind == RESPONDED and at is not None and (answered is None or at < answered):
                    held[i], changed = [deadline, at, stage], True
            for i, at in opened.items():
                deadline, answered, _ = held[i]
                yield Row(escalation_id=i, level=1, alert_ms=at)
                past = deadline < now  # arrived after its deadline: it need not fall due
                if past and late(deadline, answered):
                    yield Row(escalation_id=i, level=2, alert_ms=deadline)
                held[i] = [deadline, answered, CLOSED if past else OPEN]
            if changed:
                self.save(timer, held)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            (timer, held), at = self.load(), expiredTimerInfo.getExpiryTimeInMs()
            now = max(at, timerValues.getCurrentWatermarkInMs() - 1)
            for i, (deadline, answered, stage) in list(held.items()):
                if due(deadline, answered, stage) > now:
                    continue
                if stage == OPEN:
                    if late(deadline, answered):
                        yield Row(escalation_id=i, level=2, alert_ms=deadline)
                    held[i] = [deadline, answered, CLOSED]
                else:
                    del held[i]
            self.save(None if timer is not None and timer <= at else timer, held, at)

    return AlertProcessor()


#: Groups that the escalations' state is kept in. A group costs about a millisecond per
#: batch that touches it; its state grows with the open escalations divided by this.
BUCKETS = 1 << 14


def deadline_alerts(events: DataFrame, delay: str = "0 seconds", keep_days: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """S3/J3 on a stream of EVENT_SCHEMA: (escalation_id, level, recipient, alert_at).

    Each level is sent once per escalation. ``delay``: how far ``seen_at`` may run
    behind between writers of the log; rows behind that are dropped and counted
    (``numRowsDroppedByWatermark`` of the query's progress). Deadlines may be any time
    away; timers fire when the log's clock has passed them. State lies by hash of the
    escalation in ``buckets`` groups, a number that a checkpoint is bound to. Needs the
    RocksDB state store (``run_alerts`` sets it for its query)."""
    ms = lambda c: F.unix_millis(F.col(c))
    i = F.coalesce("escalation_id", F.lit(""))
    rows = (events.withWatermark("seen_at", delay)
            .select(F.pmod(F.xxhash64(i), F.lit(buckets)).alias("bucket"), i.alias("escalation_id"), "kind", ms("at").alias("at_ms"),
                    ms("deadline").alias("deadline_ms"), "seen_at"))
    sent = rows.groupBy("bucket").transformWithState(
        alert_processor(keep_days * DAY_MS), "escalation_id string, level int, alert_ms long", "Append", "EventTime")
    recipient = F.element_at(F.create_map(*[F.lit(x) for kv in ALERTS.items() for x in kv]), F.col("level"))
    return sent.select("escalation_id", "level", recipient.alias("recipient"), F.timestamp_millis("alert_ms").alias("alert_at"))


def run_alerts(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, state_partitions: int | None = None, **kw) -> int:
    """Take in every event file the checkpoint has not seen, send what is due and stop;
    state, timers and the clock carry over to the next run. Returns how many rows came
    too late for the watermark."""
    events = spark.readStream.schema(EVENT_SCHEMA).json(in_dir)
    q = run_to_end(deadline_alerts(events, **kw), out_dir, checkpoint, state_partitions,
                   {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    return dropped_rows(q)


def event_log(esc: DataFrame, opening_seen=None) -> DataFrame:
    """The openings and first responses of an escalations table as events, from one
    pass. ``opening_seen``: when the log took an opening (default: as it happened)."""
    ts = lambda c: F.col(c).cast("timestamp")
    opened = F.struct(F.lit(OPENED).alias("kind"), ts("escalated_at").alias("at"), ts("sla_deadline").alias("deadline"),
                      (ts("escalated_at") if opening_seen is None else opening_seen.cast("timestamp")).alias("seen_at"))
    responded = F.struct(F.lit(RESPONDED).alias("kind"), ts("first_response_at").alias("at"), F.lit(None).cast("timestamp").alias("deadline"),
                         ts("first_response_at").alias("seen_at"))
    both = F.filter(F.array(opened, F.when(F.col("first_response_at").isNotNull(), responded)), lambda e: e.isNotNull())
    return esc.select(F.col("id").alias("escalation_id"), F.inline(both))


def clock(spark: SparkSession, at: Column) -> DataFrame:
    """One event that moves the log's clock to ``at``."""
    return spark.range(1).select(F.lit("").alias("escalation_id"), F.lit(CLOCK).alias("kind"), F.lit(None).cast("timestamp").alias("at"),
                                 F.lit(None).cast("timestamp").alias("deadline"), at.alias("seen_at"))


def replay_alerts(log: DataFrame, base: str, cuts=(), end=None, state_partitions: int | None = None, **kw) -> int:
    """Run the alerts over an event log, taken in by ``seen_at`` in one run per part
    (``cuts``: where the parts end), each on the same checkpoint, and move the clock to
    ``end`` (default: a second past all deadlines and events). The number of runs is
    the caller's, whatever the length of the history. Alerts land in ``{base}/out``;
    returns how many rows came too late."""
    spark = log.sparkSession
    last = Observation()
    log = log.observe(last, F.max(F.greatest("seen_at", "deadline", "at")).alias("at"))
    if cuts:  # read once per part
        log.write.parquet(f"{base}/log")
        log = spark.read.schema(log.schema).parquet(f"{base}/log")
    late, low = 0, None
    for high in [*cuts, None]:
        part = log
        if low is not None:
            part = part.where(F.col("seen_at") >= F.lit(low).cast("timestamp"))
        if high is not None:
            part = part.where(F.col("seen_at") < F.lit(high).cast("timestamp"))
        part.write.mode("append").json(f"{base}/in")
        if high is None:  # in a file of its own: taken in with the last part, it moves the clock for the timers after it
            at = F.lit(end).cast("timestamp") if end is not None else F.coalesce(F.lit(last.get["at"]), F.lit(0).cast("timestamp")) + F.expr("INTERVAL 1 SECOND")
            clock(spark, at).coalesce(1).write.mode("append").json(f"{base}/in")
        late += run_alerts(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", state_partitions, **kw)
        low = high
    return late
