"""State over streams equals the same rules over whole tables, however the events are cut and whenever a run is restarted."""

import random

import pytest

from mnemospark.operators.sessions import cooldown_minutes
from mnemospark.streaming import logs as L
from pyspark.sql import functions as F

HOUR = 3_600_000_000
BASE = "session long, us long, event_id long, kind string, ts timestamp"


def events(spark, r, kinds, n, extra=()):
    at = 1_700_000_000_000_000
    rows = []
    for i in range(n):
        at += r.choice([1, 20_000_000, 10 * 60_000_000, HOUR, 5 * HOUR]) if r.random() < 0.97 else 30 * HOUR
        rows.append([r.randrange(3), at, i, r.choice(kinds), *(f(r) for _, f in extra)])
    schema = "session long, us long, event_id long, kind string" + "".join(f", {c}" for c, _ in extra)
    return rows, spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us"))


def test_shown_log(spark):
    r = random.Random(5)
    rows, df = events(spark, r, ["push", "push", "search", "push", "reset"][:4] + ["push"] * 6 + ["reset"], 160, [("ref long", lambda r: r.randrange(9))])
    want = {}
    for s, us, i, kind, ref in rows:
        log = want.setdefault(s, [])
        if kind == "reset":
            log.clear()
            continue
        if log and us - log[-1][0] > L.DAY_US:
            log.clear()
        log.append((us, i, ref, "search" if kind == "search" else ""))
        del log[:-7]
    run = L.Run(spark, BASE.replace(", ts", ", ref long, ts"), lambda e: L.shown_log(e, ring=7), "shown")
    run.add(df.where("event_id < 80"), 2)
    run.run()
    run.add(df.where("event_id >= 80"), 2)  # a new query over the same checkpoint
    out = run.run()
    last = {x.session: x for x in out.groupBy("session").agg(F.max_by("entries", "n").alias("entries")).collect()}
    assert {s: [tuple(e) for e in x.entries] for s, x in last.items()} == want
    held = {}
    for x in run.peeked("entries").collect():
        held.setdefault(x.session, []).append((x.us, x.event_id, x.ref, x.via))
    assert {s: sorted(v) for s, v in held.items()} == {s: v for s, v in want.items() if v and rows[-1][1] - v[-1][0] <= L.DAY_US or s in held}


def test_failures(spark):
    r = random.Random(9)
    rows, df = events(spark, r, ["failed", "failed", "failed", "failed", "done"], 90)
    table = [x[0] for x in spark.range(40).orderBy("id").select(cooldown_minutes(F.col("id"))).collect()]
    want = []
    for s in range(3):
        own, fails = [x for x in rows if x[0] == s], 0
        for k, (_, us, _, kind) in enumerate(own):
            fails = fails + 1 if kind == "failed" else 0
            nxt = own[k + 1][1] if k + 1 < len(own) else None
            if fails == 1:
                want.append((s, "retry", us + L.MINUTE_US))
            if table[fails] and (nxt is None or nxt > us + table[fails] * L.MINUTE_US):
                want.append((s, "resume", us + table[fails] * L.MINUTE_US))
    run = L.Run(spark, BASE, L.failures, "failures")
    run.add(df.where("event_id < 50"), 2)
    run.run()
    run.add(df.where("event_id >= 50"), 2)
    run.run()
    run.close()
    out = run.run()
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 10


def test_save_log(spark):
    r = random.Random(2)
    extra = [("ms long", lambda r: r.randrange(900)), ("error string", lambda r: r.choice(["", "", "broken"])), ("skipped string", lambda r: r.choice(["", "", "deferred: short", "no turns"])), ("n long", lambda r: r.randrange(3)), ("n_new long", lambda r: 1)]
    rows, df = events(spark, r, ["report", "report", "report", "drain"], 140, extra)
    want, held = [], {}
    for s, us, i, kind, ms, error, skipped, n, new in rows:
        log = held.setdefault(s, [])
        if kind == "report":
            log.append([us, ms, error, skipped, n, new, False])
            del log[:-4]
            continue
        given = [x for x in log if not x[6] and us - x[0] <= L.TTL_US]
        for x in given:
            x[6] = True
        if given:
            count = sum(x[4] for x in given)
            status = "" if count else "deferred" if any(x[3].startswith("deferred") for x in given) else "skipped" if any(x[3] for x in given) else ""
            want.append((s, i, us, len(given), given[-1][1], count, len(given), next((x[2] for x in reversed(given) if x[2]), None), status))
    run = L.Run(spark, BASE.replace(", ts", ", ms long, error string, skipped string, n long, n_new long, ts"), L.save_log, "saves")
    run.add(df.where("event_id < 70"), 2)
    first = run.run().count()
    peek = run.peeked("reports").count()
    assert peek == run.peeked("reports").count() and run.run().count() == first  # looking does not drain, nor does a run without events
    run.add(df.where("event_id >= 70"), 2)
    out = sorted(tuple(x) for x in run.run().collect())
    assert out == sorted(want) and 0 < first < len(out)


@pytest.mark.parametrize("build", [L.shown_log, L.failures, L.save_log])
def test_no_events(spark, build):
    schema = BASE.replace(", ts", ", ref long, ms long, error string, skipped string, n long, n_new long, ts")
    run = L.Run(spark, schema, build, "none")
    run.add(spark.createDataFrame([], schema))
    assert run.run().collect() == []
