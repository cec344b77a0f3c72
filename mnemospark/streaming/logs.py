"""Logs of sessions as keyed state: what was shown, failures with their timers, saves that are reported once.

Each is one stateful operator per session over a stream of events, with event-time timers, so what it puts out depends on
the events and not on how they are cut into micro-batches; calls of one micro-batch are taken in order of time. State
lives in the state store of the query's checkpoint, so a restart goes on where it was. The operators are made in
functions: they reach executors whole, which need not have this package.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.operators.sessions import cooldown_minutes
from mnemospark.sources.scratch import folder, written

RING, DAY_US = 200, 24 * 3600 * 1_000_000
REPORTS, TTL_US = 4, 30 * 60 * 1_000_000
MINUTE_US = 60_000_000
LATENESS = "1 hour"
#: What stateful operators with timers and lists need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

SHOWN = "session long, n long, entries array<struct<us:bigint,event_id:bigint,ref:bigint,via:string>>"
RELEASED = "session long, kind string, due long"
DRAINED = "session long, event_id long, us long, batches long, ms long, count long, new long, error string, status string"


def shown_log(events: DataFrame, ring: int = RING, idle_us: int = DAY_US) -> DataFrame:
    """events(session, us, event_id, kind, ref, ts) with kind reset, push or search to the log of each session after each micro-batch that changed it.

    The log is the newest `ring` entries since the last reset and the last pause of more than idle_us, oldest first; n counts
    the changes, so the row of the greatest n is the state. A session that stays idle is forgotten by a timer.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Log(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.entries = handle.getListState("entries", "us long, event_id long, ref long, via string")
            self.mark = handle.getValueState("mark", "n long, reset_us long, reset_id long, timer long")

        def handleInputRows(self, key, rows, timerValues):
            # each question to the state is a round trip: what is not there is found by reading it
            mark = self.mark.get()
            n, reset_us, reset_id, timer = mark or (0, -(2**62), 0, 0)
            held = [tuple(e) for e in self.entries.get()] if mark else []
            found = bool(held)
            for r in sorted(rows, key=lambda r: (r.us, r.event_id or 0)):
                if r.kind == "reset":
                    reset_us, reset_id = max((reset_us, reset_id), (r.us, r.event_id))
                elif (r.us, r.event_id) > (reset_us, reset_id):
                    held.append((r.us, r.event_id, r.ref, "search" if r.kind == "search" else ""))
            held = sorted(e for e in held if e[:2] > (reset_us, reset_id))
            cut = max((i for i in range(1, len(held)) if held[i][0] - held[i - 1][0] > idle_us), default=0)
            held = held[cut:][-ring:]
            old, timer = timer, max((held[-1][0] + idle_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1) if held else 0
            if timer != old:
                if old:
                    self.handle.deleteTimer(old)
                if timer:
                    self.handle.registerTimer(timer)
            entries = [Row(us=u, event_id=i, ref=f, via=v) for u, i, f, v in held]
            if entries:
                self.entries.put(entries)
            elif found:
                self.entries.clear()
            self.mark.update((n + 1, reset_us, reset_id, timer))
            yield Row(session=key[0], n=n + 1, entries=entries)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            n, reset_us, reset_id, _ = self.mark.get()
            self.entries.clear()
            self.mark.update((n + 1, reset_us, reset_id, 0))
            return iter(())

    held = events.withWatermark("ts", LATENESS).where("session is not null and us is not null").groupBy("session")
    return held.transformWithState(Log(), T.StructType.fromDDL(SHOWN), "update", "eventTime")


def failures(events: DataFrame) -> DataFrame:
    """events(session, us, event_id, kind, ts) with kind failed or done to what timers release: (session, kind, due).

    The first failure after a success is retried once, a minute later; from the third in a row on a session pauses, for as
    long as `sessions.cooldown_minutes` says, and resumes unless another run, failed or not, came before.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    table = [r[0] for r in events.sparkSession.range(16).orderBy("id").select(cooldown_minutes(F.col("id"))).collect()]

    class Failures(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("state", "fails long, resume long, retries array<bigint>, timers array<bigint>")

        def released(self, key, retries, resume, now):
            """What is due before now, in order."""
            found = [(due, "retry") for due in retries if due < now] + [(resume, "resume")] * (0 < resume < now)
            return [Row(session=key[0], kind=kind, due=due) for due, kind in sorted(found)]

        def handleInputRows(self, key, rows, timerValues):
            fails, resume, retries, timers = self.state.get() or (0, 0, [], [])
            for r in sorted(rows, key=lambda r: (r.us, r.event_id or 0)):
                yield from self.released(key, retries, resume, r.us)
                retries, resume = [due for due in retries if due >= r.us], 0
                fails = fails + 1 if r.kind == "failed" else 0
                if fails == 1:
                    retries.append(r.us + MINUTE_US)
                minutes = table[min(fails, len(table) - 1)]
                if minutes:
                    resume = r.us + minutes * MINUTE_US
            first = timerValues.getCurrentWatermarkInMs() + 1
            wanted = {max(due // 1000 + 1, first) for due in {*retries, resume} - {0}}
            for old in {*timers} - wanted:
                self.handle.deleteTimer(old)
            for new in wanted - {*timers}:
                self.handle.registerTimer(new)
            self.state.update((fails, resume, [*retries], sorted(wanted)))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            fails, resume, retries, timers = self.state.get()
            at = expiredTimerInfo.getExpiryTimeInMs()
            now = at * 1000
            yield from self.released(key, retries, resume, now)
            self.state.update((fails, 0 if resume < now else resume, [due for due in retries if due >= now], [t for t in timers if t != at]))

    held = events.withWatermark("ts", LATENESS).where("session is not null and us is not null").groupBy("session")
    return held.transformWithState(Failures(), T.StructType.fromDDL(RELEASED), "append", "eventTime")


def save_log(events: DataFrame, ring: int = REPORTS, ttl_us: int = TTL_US) -> DataFrame:
    """events(session, us, event_id, kind, ms, error, skipped, n, n_new, ts) with kind report or drain to what each drain gives.

    A drain sums up the reports that no drain has given before, of the last `ring`, none older than ttl_us; one that finds
    none gives no row. A session that is idle for that long is forgotten, so state is bounded by what is in use. The
    reports can be looked at without draining: state variable `reports` of the checkpoint (`peeked`).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Saves(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.reports = handle.getListState("reports", "us long, ms long, error string, skipped string, n long, n_new long, reported boolean")
            self.timer = handle.getValueState("timer", "at long")

        def handleInputRows(self, key, rows, timerValues):
            held, last = [list(r) for r in self.reports.get()], 0
            for r in sorted(rows, key=lambda r: (r.us, r.event_id or 0)):
                last = r.us
                if r.kind == "report":
                    held = [*held, [r.us, r.ms, r.error or "", r.skipped or "", r.n, r.n_new, False]][-ring:]
                    continue
                given = [x for x in held if not x[6] and r.us - x[0] <= ttl_us]
                for x in given:
                    x[6] = True
                if not given:
                    continue
                count, skipped = sum(x[4] for x in given), [x[3] for x in given if x[3]]
                status = "" if count or not skipped else "deferred" if any(x.startswith("deferred") for x in skipped) else "skipped"
                errors = [x[2] for x in given if x[2]]
                yield Row(session=key[0], event_id=r.event_id, us=r.us, batches=len(given), ms=given[-1][1], count=count, new=sum(x[5] for x in given), error=errors[-1] if errors else None, status=status)
            old = self.timer.get()
            at = max((last + ttl_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
            if old is None or old[0] != at:
                if old is not None:
                    self.handle.deleteTimer(old[0])
                self.handle.registerTimer(at)
                self.timer.update((at,))
            if held:
                self.reports.put([Row(us=x[0], ms=x[1], error=x[2], skipped=x[3], n=x[4], n_new=x[5], reported=x[6]) for x in held])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.reports.clear()
            self.timer.clear()
            return iter(())

    held = events.withWatermark("ts", LATENESS).where("session is not null and us is not null").groupBy("session")
    return held.transformWithState(Saves(), T.StructType.fromDDL(DRAINED), "append", "eventTime")


class Run:
    """A stateful stream over a folder of event files (sessions have numbers from 0 on), run as often as wanted; each run takes what is new, a file a micro-batch, and ends."""

    def __init__(self, spark: SparkSession, schema: str | T.StructType, build, name: str):
        self.spark, self.build, self.schema = spark, build, schema
        self.root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.input, self.out, self.checkpoint = (f"{self.root}/{d}" for d in ("in", "out", "state"))

    def add(self, events: DataFrame, parts: int = 1) -> None:
        """Files of events, `parts` of them in order of time."""
        events = events.select(*[f.name for f in self._schema().fields])
        if parts == 1:
            # shuffled to one file, so that what they are made from is still read in parallel
            events.repartition(1).write.mode("append").parquet(self.input)
            return
        events = written(events, "events")  # each part, and where they are cut, would make them again
        lo, hi = events.agg(F.min("us"), F.max("us")).first()
        if lo is None:
            return self.add(events)
        part = F.least(F.floor((F.col("us") - lo) * parts / (hi - lo + 1)), F.lit(parts - 1))
        for i in range(parts):
            self.add(events.where(part == i))

    def _schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema

    def close(self, days: int = 60) -> None:
        """A last event of no session, so late that all timers are due; its row is left out of the results."""
        last = self.spark.read.schema(self._schema()).parquet(self.input).agg(F.max("us").alias("us")).where("us is not null")
        cells = {"session": F.lit(-1), "us": F.col("us") + days * DAY_US, "ts": F.timestamp_micros(F.col("us") + days * DAY_US)}
        self.add(last.select(*(cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema().fields)))

    def run(self) -> DataFrame:
        """All that was put out, by this run and those before."""
        key, value = STATE_STORE
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, value)
        try:
            events = self.spark.readStream.schema(self._schema()).option("maxFilesPerTrigger", 1).parquet(self.input)
            out = self.build(events)

            def write(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.out}/batch={number}")

            mode = "update" if [f.name for f in out.schema.fields][1] == "n" else "append"
            q = out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            q.awaitTermination()
            return self.spark.read.schema(out.schema).parquet(f"{self.out}/*").where("session >= 0")
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def peeked(self, variable: str) -> DataFrame:
        """The rows of a list in the state, by session, without touching it."""
        held = self.spark.read.format("statestore").option("stateVarName", variable).load(self.checkpoint)
        return held.select(F.col("key.session").alias("session"), "list_element.*")
