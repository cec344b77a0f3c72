"""Lookups in what saves keep equal scans of the tables, after any saves, and the store loses and doubles nothing."""

import random

import pandas as pd
import pytest
import scan
from pyspark.sql import functions as F

from mnemospark import engine as E
from mnemospark.engine import Engine
from mnemospark.operators import index
from mnemospark.sources import snapshots
from mnemospark.sources.snapshots import Conflict, Draft

BATCH = "seq long, project_key string, title string, content string, kind string, aliases array<string>, entities array<struct<name:string,type:string>>, op string, target_id string"
WORDS = ["cache", "parquet", "loader", "shard", "merge", "token", "delta", "spill", "query", "index"]


def batch(spark, r, ids, n=12):
    rows = []
    for i in range(n):
        words = r.sample(WORDS, 3)
        names = [(" ".join(r.sample(WORDS, r.randrange(1, 3))), "t") for _ in range(r.randrange(0, 4))]
        op = r.choice(["add", "add", "update", "noop"]) if ids else "add"
        rows.append((i, r.choice("pq"), r.choice(["T", "U", f"own {r.random()}"]), " ".join(words) + f" {r.randrange(40)}x", "fact", r.sample(WORDS, r.randrange(0, 2)), names, op, r.choice(ids) if op != "add" else None))
    return spark.createDataFrame(rows, BATCH)


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


def same_as_scans(e, tokens):
    x, live = e.index(), e.live()
    assert rows(x.keyword_hits(tokens)) == rows(scan.keyword_hits(live, tokens))
    assert rows(x.entity_hits(tokens)) == rows(scan.entity_hits(e.entities, e.mentions, live, tokens))
    assert rows(x.related_hits(tokens, 1)) == rows(scan.related_hits(e.entities, e.mentions, e.related, live, tokens, 1))
    counts = {(r.kind, r.key): r.n for r in index.merged("counts")(e.table("counts"), True).collect()}
    want = {("live", r.project_key): r["count"] for r in live.groupBy("project_key").count().collect()}
    want |= {("token", r.t): r["count"] for r in live.select(F.explode("keywords").alias("t")).groupBy("t").count().collect()}
    want |= {("mentions", r.entity_key): r["count"] for r in e.mentions.groupBy("entity_key").count().collect()}
    assert counts == want and e.corpus().first().n == live.count()


def test_lookups_equal_scans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_PARTS", 2)
    r = random.Random(8)
    e, ids = Engine(spark, str(tmp_path / "s"), lambda: 1000), []
    for k in range(4):
        e.remember(batch(spark, r, ids))
        ids = sorted(x.id for x in e.memory.select("id").collect())
        if k == 2:
            e.archive(spark.createDataFrame([(i,) for i in r.sample(ids, 4)], "id string"))
            e.backfill_aliases(lambda b: pd.DataFrame({"id": b["id"], "aliases": [["spill over"] for _ in b["id"]]}))
    assert len(e.store.manifest(e.store.current())["words"]) <= 3  # segments were merged
    same_as_scans(e, ["cache", "parquet", "spill", "cache", "none"])
    first = e.backups()[-1]
    e.restore(first)
    same_as_scans(e, ["cache", "delta"])


def test_a_search_reads_what_it_names(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), lambda: 1000)
    e.remember(batch(spark, random.Random(2), []))
    found = e.search("parquet cache")
    read = {f.split(str(tmp_path / "s"))[1].split("/")[2] for f in found.inputFiles() if str(tmp_path) in f}
    assert read <= {"memory", "counts"}  # words, names and mentions were looked up before, by their keys
    assert "In(hash" in found._jdf.queryExecution().toString()
    hits = e.index().keyword_hits(["parquet", "cache"])
    assert "In(token" in hits._jdf.queryExecution().toString()
    assert [x.title for x in e.search("parquet cache").collect()]


def test_two_writers(spark, tmp_path):
    a, b = (Engine(spark, str(tmp_path / "s"), lambda: 1000) for _ in range(2))
    row = lambda p, t: spark.createDataFrame([(0, p, t, f"text {t}", "fact", [], [], "add", None)], BATCH)
    a.remember(row("p", "one"))
    late = Draft(a.store)
    b.remember(row("p", "two"))
    late.put("memory", a.memory, a._by()["memory"])
    with pytest.raises(Conflict):
        late.finish()
    # the other commits while this one plans: it plans again
    plan, turns = a._saved, []

    def slow(*args, **kw):
        out = plan(*args, **kw)
        if not turns:
            turns.append(b.remember(row("p", "three")))
        return out

    a._saved = slow
    a.remember(row("p", "four"))
    assert sorted(m.title for m in a.memory.collect()) == ["four", "one", "three", "two"] and len(turns) == 1
    assert {h.hash for h in a.index().keyword_hits(["text"]).collect()} == {m.hash for m in a.memory.collect()}
    assert a.store.clean(-10) == []


TURNS, JOBS = "session string, line int, role string, text string", "session string, project_key string, final boolean, agent boolean"


def test_a_chunk_counts_once(spark, tmp_path, monkeypatch):
    """Whatever step the run is lost in, the same tables are there after it ran again."""
    e = Engine(spark, str(tmp_path / "s"), lambda: 1000)
    e.remember(spark.createDataFrame([(0, "p", "A", "warm cache", "rule", [], [], "add", None)], BATCH))
    held = e.memory.first().id
    reply = '{"memories": [{"title": "A", "content": "warm cache", "type": "rule", "op": "noop", "target_id": "%s"}], "feedback": [{"id": "%s", "verdict": "used"}]}' % (held, held)
    turns = spark.createDataFrame([("s1", 0, "user", "x" * 300)], TURNS)
    jobs = spark.createDataFrame([("s1", "p", False, False)], JOBS)
    known = spark.createDataFrame([("s1", [held])], "session string, ids array<string>")
    call = lambda b: pd.DataFrame({"session": b["session"], "reply": [reply for _ in b["session"]]})
    for name, step in (("put", Draft.put), ("finish", Draft.finish)):
        def lost(self, *args, _name=name, **kw):
            if _name == "finish" or args[0] == "sessions":
                raise OSError("lost")
            return step(self, *args, **kw)

        monkeypatch.setattr(Draft, name, lost)
        with pytest.raises(OSError):
            e.extract(turns, jobs, call, known)
        monkeypatch.setattr(Draft, name, step)
        m = e.memory.first()
        assert (m.seen_count, m.used_count, e.cursor("s1")) == (1, 0, 0)
    e.extract(turns, jobs, call, known)
    m = e.memory.first()
    assert (m.seen_count, m.used_count, e.cursor("s1")) == (2, 1, 1)


def test_failures_shrink_and_pause(spark, tmp_path):
    clock = [1000]
    e = Engine(spark, str(tmp_path / "s"), lambda: clock[0])
    turns = spark.createDataFrame([("s1", i, "user", f"always keep {i} " + "x" * 300) for i in range(4)], TURNS)
    jobs = spark.createDataFrame([("s1", "p", False, False)], JOBS)
    bad = lambda b: pd.DataFrame({"session": b["session"], "reply": ["sorry" for _ in b["session"]]})
    state = lambda: tuple(e.sessions.select("fails", "room", "paused_until", "cursor").first())
    for want in ((1, 628, None, 0), (2, 314, None, 0), (3, 157, 1000 + 1800, 0)):
        e.extract(turns, jobs, bad)
        assert state() == want
    assert e.extract(turns, jobs).first().plan == "pause" and state()[0] == 3
    clock[0] += 1801
    done = e.extract(turns, jobs).first()
    assert (done.plan, done.error, done.next) == ("extract", None, 1) and state() == (None, None, None, 1)


def test_tables_of_the_index_are_known():
    assert set(index.TABLES) == set(index.ORDER) == set(index.KEYS) <= set(E.TABLES)
