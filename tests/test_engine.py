import pytest

from mnemospark.engine import Engine
from mnemospark.operators import sessions
from mnemospark.sources.snapshots import Store
from mnemospark.streaming import state

BATCH = "seq long, project_key string, title string, content string, kind string, aliases array<string>, entities array<struct<name:string,type:string>>"


def test_life_of_a_store(spark, tmp_path):
    clock = iter(range(1_000_000, 2_000_000, 10))
    e = Engine(spark, str(tmp_path / "store"), lambda: next(clock))
    assert e.memory.count() == 0
    batch = [(0, "p", "Cache rule", "Always warm the parquet cache", "rule", ["speedup"], [("parquet", "tech"), ("cache", "")]), (1, "p", "Loader", "The loader reads parquet in order", "fact", [], [("parquet", "tech"), ("loader", "tool")])]
    first = e.remember(spark.createDataFrame(batch, BATCH))
    assert e.memory.count() == 2 and e.entity_list().first()["name"] == "parquet"
    e.remember(spark.createDataFrame([(0, "p", "Cache rule", "always WARM the parquet cache ", "rule", [], []), (1, "p", "Loader", "The loader reads parquet by columns", "fact", [], [("loader", "tool")])], BATCH))
    seen = {r.title + str(r.superseded): r.seen_count for r in e.memory.collect()}
    assert seen == {"Cache ruleFalse": 2, "LoaderTrue": 1, "LoaderFalse": 1}
    assert [r.title for r in e.search("speedup").collect()] == ["Cache rule"]
    assert {r.title for r in e.retrieve("parquet loader", min_match=0.01).collect()} == {"Loader", "Cache rule"}
    rule = e.memory.where("kind = 'rule'").select("id")
    e.pin(rule)
    assert [r.pinned for r in e.rules("p").collect()] == [True]
    e.archive(rule)
    assert e.rules("p").collect() == [] and e.stats().first()["memories"] == 3
    assert len(e.backups()) == 4
    e.restore(first)
    assert e.memory.count() == 2
    assert len(e.store.prune(1)) == 2 and first in e.backups()
    with pytest.raises(ValueError):
        e.store.commit({"memory": e.memory.limit(0)})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("ev")
    rows = [(i, f"2024-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00", i % 3, ["view", "click", "error"][i * 7 % 5 % 3], '{"k": %d}' % (i % 4)) for i in range(0, 600, 7)]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, props string").selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "user_id", "event_type", "props").coalesce(1).write.parquet(f"{d}/events.parquet")
    return str(d)


def test_streams_equal_batch(spark, folder):
    batch = spark.read.parquet(f"{folder}/events.parquet").selectExpr("user_id as session", "event_id", "unix_micros(cast(ts as timestamp)) as us", "event_type", "cast(get_json_object(props, '$.k') as long) as ref")
    out = state.drained(state.gate(state.event_stream(spark, folder)), "update").collect()
    last = {}
    for r in out:
        key = r.session, r.ref, r["at"]
        last[key] = tuple(a or b for a, b in zip(last.get(key, (False, False)), (r.searched, r.fired), strict=True))
    assert last == {(r.session, r.ref, r["at"]): (r.searched, r.fired) for r in sessions.gate_turns(sessions.gate_calls(batch)).collect()}
    bursts = state.bursts(spark, folder, "20 minutes", "1 minute").collect()
    whole = {(r.session, r.n) for r in sessions.debounced(batch, 20 * 60_000_000).collect()}
    assert {(r.session, r.n) for r in bursts} == whole and len(bursts) == sessions.debounced(batch, 20 * 60_000_000).count()


def test_gate_keeps_a_state_a_session(spark, folder, tmp_path):
    """Prompts are many times the sessions, so Python is not entered for each of them."""
    e = state.event_stream(spark, folder)
    q = state.gate(e).writeStream.foreachBatch(lambda b, i: b.write.format("noop").mode("overwrite").save()).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = spark.read.format("statestore").load(str(tmp_path / "c")).selectExpr("key.*").collect()
    assert sorted(map(tuple, held)) == [(0,), (1,), (2,)]


def test_store_survives_a_lost_pointer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1,)], "x long")
    store.commit({"t": df})
    second = store.commit({"t": df.union(df)})
    (tmp_path / "s" / "CURRENT").unlink()
    assert Store(spark, str(tmp_path / "s")).current() == second and store.read("t").count() == 2
    (tmp_path / "s" / "00000000000000000007" / "t").mkdir(parents=True)  # an interrupted write
    (tmp_path / "s" / "x.tmp").write_text("")
    assert sorted(store.clean(older_than=-10)) == ["00000000000000000007", "x.tmp"] and len(store.versions()) == 2
    assert store.write_lines("RULES.md", ["- a"]) and not store.write_lines("RULES.md", ["- a"]) and store.write_lines("RULES.md", ["- b"])
    store.wipe()
    assert store.versions() == [] and store.current() is None
