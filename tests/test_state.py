import json

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import browse, cluster, evaluate, extraction, graph, save, sessions, write
from mnemospark.sources import transcripts

EVENTS = "session long, event_id long, us long, event_type string, ref long"


def ev(spark, rows):
    return spark.createDataFrame([(s, i, us, t, ref) for i, (s, us, t, ref) in enumerate(rows)], EVENTS)


def test_debounce(spark):
    rows = [(1, 0, "a", 0), (1, 40, "a", 0), (1, 100, "a", 0), (2, 5, "a", 0), (1, 151, "a", 0)]
    got = {(r.session, r.started, r.fires, r.n) for r in sessions.debounced(ev(spark, rows), 50).collect()}
    assert got == {(1, 0, 90, 2), (1, 100, 150, 1), (1, 151, 201, 1), (2, 5, 55, 1)}


def test_shown_log_resets_and_ignores_searches(spark):
    rows = [(1, 0, "view", 5), (1, 1, "signup", 0), (1, 2, "view", 6), (1, 3, "click", 7), (2, 0, "click", 9), (2, 1, "view", 9)]
    log = sessions.shown_log(ev(spark, rows))
    assert {(r.session, r.ref) for r in sessions.seen(log).collect()} == {(1, 6), (2, 9)}
    assert {(r.session, r.ref, r.place) for r in sessions.ring(log, 1).collect()} == {(1, 7, 1), (2, 9, 1)}
    used = spark.createDataFrame([(1, 7, "used"), (2, 9, "used"), (1, 6, "wrong")], "session long, ref long, verdict string")
    assert [(r.session, r.ref) for r in sessions.searched_only(log, used).collect()] == [(1, 7)]


def test_gate(spark):
    """Once per prompt, never after a search; stops are not counted, prompts are; an unknown prompt passes."""
    calls = [("s", "u1", 0, False), ("s", "u1", 1, False), ("s", "u2", 2, True), ("s", None, 3, False), ("s", "u1", 4, True), ("s", "u2", 5, True), ("t", "u1", 6, False), ("t", "u1", sessions.DAY_US + 6, True), ("t", "u1", sessions.DAY_US + 7, False)]
    df = spark.createDataFrame([(s, r, us, i, x) for i, (s, r, us, x) in enumerate(calls)], "session string, ref string, us long, event_id long, searched boolean")
    turns = sessions.gate_turns(df)
    got = {(r.session, r.ref, r["at"], r.searched, r.fired) for r in turns.collect()}
    assert got == {("s", "u1", 0, True, True), ("s", "u2", 2, True, False), ("t", "u1", 6, True, True), ("t", "u1", sessions.DAY_US + 7, False, True)}
    assert {(r.session, r.prompts, r.searched, r.fired) for r in sessions.gate_stats(turns, "session").collect()} == {("s", 2, 2, 1), ("t", 2, 1, 2)}
    assert [(r.prompts, r.fired) for r in sessions.gate_stats(turns, since=5).collect()] == [(2, 2)]


def test_learned_terms_come_only_from_searches_that_were_used(spark):
    rows = [("m1", "search", "callback bca rekening dana nasabah stuck", "BCA RDN creation", "Callback rejected when the signature is stale."), ("m2", "", "", "Hook found it", "x"), ("m3", "search", "something else entirely", "Searched but wrong", "y"),
        ("m4", "", "", "Both found it", "z"), ("m4", "search", "brand new words here", "Both found it", "z")]
    shown = spark.createDataFrame([("s", r[0], i, i, *r[1:]) for i, r in enumerate(rows)], "session string, ref string, us long, event_id long, via string, query string, title string, content string")
    used = spark.createDataFrame([("s", "m1", "used"), ("s", "m2", "used"), ("s", "m3", "wrong"), ("s", "m4", "used")], "session string, ref string, verdict string")
    assert [(r.ref, r.terms) for r in sessions.learned_terms(shown, used).collect()] == [("m1", ["rekening", "dana", "nasabah"])]


def test_shown_log_keeps_the_last_entries(spark):
    log = sessions.shown_log(ev(spark, [(1, i, "view" if i < 5 else "click", i) for i in range(8)]))
    assert {r.ref for r in sessions.seen(log, 4).collect()} == {4} and [r.ref for r in sessions.since(log, 6).collect()] == [6, 7]
    assert sessions.active(log, sessions.DAY_US + 8).count() == 0 and sessions.active(log, sessions.DAY_US + 7).count() == 8


def test_reports_drain_once(spark):
    rows = [("a", 100, 0, False, 5, "", "", 2, 1), ("a", 200, 1, True, 6, "", "", 9, 9), ("a", 300, 2, False, 7, "boom", "", 1, 0), ("b", 300, 0, False, 1, "", "deferred: short", 0, 0), ("b", 10, 1, False, 1, "", "no", 0, 0), ("c", 300, 0, False, 2, "", "no turns", 0, 0)]
    df = spark.createDataFrame(rows, "session string, at long, seq long, reported boolean, ms long, error string, skipped string, n long, n_new long")
    got = {r.session: (r.batches, r.ms, r["count"], r.new, r.error, r.status) for r in sessions.drained(df, 400, ttl=300).collect()}
    assert got == {"a": (2, 7, 3, 1, "boom", ""), "b": (1, 1, 0, 0, None, "deferred"), "c": (1, 2, 0, 0, None, "skipped")}


def test_cursor(spark):
    t = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(3)], "session string, line long")
    c = spark.createDataFrame([("a", 2), ("b", 9)], "session string, cursor long")
    assert sorted((r.session, r.line) for r in sessions.from_cursor(t, c).collect()) == [("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2)]


def test_chunks(spark):
    t = spark.createDataFrame([(1, 0, "user", "x" * 50), (1, 3, "assistant", "y" * 30), (1, 4, "user", "z" * 30), (2, 1, "user", "w" * 500)], "session long, line long, role string, text string")
    got = {r.session: (r.taken, r.bytes, r.next, r.total) for r in sessions.chunk_summary(t, 90).collect()}
    assert got == {1: (2, 80, 4, 5), 2: (1, 500, 2, 2)}
    assert {r.session: r.text for r in sessions.last_exchange(t, 33).collect()} == {1: "z" * 30 + "\nyy", 2: "w" * 33}


def test_cooldown_and_sweep(spark):
    got = [r.m for r in spark.range(11).orderBy("id").select(sessions.cooldown_minutes(F.col("id")).alias("m")).collect()]
    assert got == [0, 0, 0, 30, 60, 120, 240, 480, 960, 1440, 1440]
    s = spark.createDataFrame([(1, 900, 0, 5), (2, 990, 0, 5), (3, 500, 5, 5), (4, 0, 1, 5), (5, 700, 1, 2)], "session long, touched long, cursor long, lines long")
    assert {(r.session, r.final) for r in sessions.behind(s.withColumn("idle", 1000 - F.col("touched")), 100, 300, 900).collect()} == {(1, False), (5, True)}


MEM = "hash string, id string, title string, title_lc string, kind string, project_key string, keywords array<string>, aliases array<string>, seen_count long, last_seen_at long, superseded boolean, seq long"


def memory(spark, rows):
    return spark.createDataFrame([(h, h, t, t.lower(), "fact", "p", list(k), [], n, 1, sup, seq) for h, t, k, n, sup, seq in rows], MEM)


def saved(old, batch, now):
    """old after a batch whose hashes and words are given, through the steps that the engine saves by."""
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    also = {"content": F.col("title"), "alias_only": none, "created_at": zero, "used_count": zero, "disputed_count": zero, "injected_count": zero, "archived": F.lit(False), "pinned": F.lit(False), "source_session": F.lit(None).cast("string")}
    old = old.withColumns(also)
    b = batch.drop("superseded", "seen_count", "last_seen_at").withColumns({"content": F.col("title"), "alias_only": none, "alias_tokens": none, "at": F.col("seq") + 1, "session": F.lit(None).cast("string")})
    for c, v in (("op", F.lit("add")), ("target_id", F.lit(None).cast("string"))):
        b = b if c in b.columns else b.withColumn(c, v)
    return save.memories_after(old, save.effects(old, b), now)


def test_upsert(spark):
    old = memory(spark, [("a", "T", ["x"], 1, False, 0), ("b", "U", ["y"], 2, True, 0), ("c", "V", [], 1, False, 0)]).drop("seq")
    batch = memory(spark, [("a", "Other", ["z", "x"], 1, False, 1), ("b", "U", [], 1, False, 2), ("n1", "T", ["q"], 1, False, 3), ("n2", "T", [], 1, False, 4), ("a", "T", ["w"], 1, False, 5)])
    got = {r.id: r for r in saved(old, batch, 99).collect()}
    assert got["a"].seen_count == 3 and got["a"].title == "T" and got["a"].keywords == ["x", "z", "w"] and got["a"].last_seen_at == 99
    assert got["a"].superseded and got["n1"].superseded and not got["n2"].superseded  # each new one replaces what was live before
    assert got["b"].superseded and got["b"].seen_count == 3 and not got["c"].superseded and got["c"].last_seen_at == 1


def test_counters_and_flags(spark):
    v = spark.createDataFrame([(1, "used", 5), (1, "wrong", 6), (1, "used", 4), (2, "outdated", 1)], "ref long, verdict string, at long")
    assert {(r.ref, r.used, r.disputed, r.last_used) for r in write.feedback(v).collect()} == {(1, 2, 1, 5), (2, 0, 1, None)}
    m = memory(spark, [("a", "T", [], 1, False, 0), ("b", "U", [], 1, True, 0)]).withColumn("pinned", F.lit(False))
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r.id: r.pinned for r in write.set_flag(m, ids, "pinned", True, ("rule",)).collect()} == {"a": False, "b": False}
    noops = memory(spark, [(f"noop{i}", "", [], 1, False, i) for i in range(4)]).withColumns({"op": F.lit("noop"), "target_id": F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("seq") % 2 + 1).cast("int"))})
    assert {r.id: (r.seen_count, r.last_seen_at) for r in saved(m.drop("seq", "pinned"), noops, 9).collect()} == {"a": (3, 9), "b": (1, 1)}


def test_sessions_keep_the_agent_mark(spark):
    cols = "id string, project_key string, path string, cwd string, agent boolean, touched_at long, cursor long"
    s = spark.createDataFrame([("a", "p", "f", "c", True, 1, 7)], cols)
    t = spark.createDataFrame([("a", "p", "g", "c", False, 5), ("b", "q", "h", "d", False, 2)], "id string, project_key string, path string, cwd string, agent boolean, at long")
    assert {(r.id, r.path, r.agent, r.touched_at, r.cursor) for r in write.merge_sessions(s, t).collect()} == {("a", "g", True, 5, 7), ("b", "h", False, 2, 0)}


def test_clusters(spark):
    mem = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x", "y", "w"]), ("c", ["x", "q", "r"]), ("d", ["k"]), ("e", ["x", "y", "z", "w"])], "hash string, keywords array<string>")
    ment = spark.createDataFrame([(h, "t") for h in "abc"] + [("d", "u"), ("e", "v"), ("b", "v")], "hash string, entity_key string")
    got = {(r.label, r.hash, r.size) for r in cluster.clusters(mem, ment, 0.4).collect()}
    assert got == {("a", "a", 3), ("a", "b", 3), ("a", "e", 3)}
    members = spark.createDataFrame([("L", "a", "fact", "p", 0), ("L", "b", "rule", "q", 1), ("L", "c", "fact", "q", 2), ("L", "d", "fact", "p", 3)], "label string, id string, kind string, project_key string, seq long")
    assert cluster.majority_project(members).first()["project"] == "q"
    merges = spark.createDataFrame([("L", 0, ["a", "b"], "rule", "x"), ("L", 1, ["b", "c"], "fact", "x"), ("L", 2, ["c"], "fact", "x"), ("L", 3, ["d", "zz"], "fact", "x")], "label string, merge_no long, ids array<string>, kind string, content string")
    assert [(r.merge_no, r.ids) for r in cluster.valid_merges(merges, members).collect()] == [(0, ["a", "b"])]


def test_graph(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "c"), (4, "d"), (4, "x")], "item long, key string")
    e = graph.cooccurrence(items.where("item < 3"))
    assert {(r.k1, r.k2, r.weight) for r in e.collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    hops = lambda least: {(r.key, r.hops) for r in graph.two_hops(items, "a", least).collect()}
    assert hops(1) == {("b", 1), ("c", 1), ("d", 2)} and hops(2) == {("b", 1)} and graph.two_hops(items, "none", 1).collect() == []


def test_evaluation(spark):
    exp = spark.createDataFrame([(1, "x"), (1, "y"), (2, "Zed"), (3, "q")], "case_id long, item string")
    res = spark.createDataFrame([(1, "has X", 1), (1, "x again", 2), (2, "a", 1), (2, "the zeds", 4), (3, "n", 1)], "case_id long, title string, pos long")
    s = evaluate.scored_cases(exp, res)
    assert {(r.case_id, r.hit, r.rank, r.recall) for r in s.collect()} == {(1, True, 1, 0.5), (2, True, 4, 1.0), (3, False, 0, 0.0)}
    ms = s.withColumns({"mode": F.lit("hook"), "chars": F.col("case_id") * 10, "ms": F.col("case_id") * 10})
    r = evaluate.summary(ms).first()
    assert r.n == 3 and r.mrr == pytest.approx((1 + 0.25) / 3, abs=1e-6) and r.p50_ms == 20 and r.p95_ms == 20 and r.max_chars == 30
    block = spark.createDataFrame([("Memories\n- [fact] First one — text\n- [rule] Second (1d)\nnot this\nStanding rules\n- [rule] Third — x",)], "b string")
    assert block.select(evaluate.titles(F.col("b")).alias("t")).first().t == ["First one", "Second (1d)"]


def test_transcript(spark, tmp_path):
    line = lambda **k: json.dumps(k)
    say = lambda kind, content, **k: line(type=kind, sessionId="s", message={"role": kind, "content": content}, **k)
    blocks = [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "done"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/a/b"}}]
    (tmp_path / "t.jsonl").write_text("\n".join([line(type="queue"), say("user", "fix the bug", cwd="/w", entrypoint="sdk-py"), say("assistant", [{"type": "thinking", "text": "x"}]), say("assistant", blocks), say("user", "caveat", isMeta=True),
        say("user", "<command-name>/deploy</command-name> <command-args>now please</command-args>"), say("user", "side", isSidechain=True), line(type="attachment", sessionId="s", attachment={"type": "queued_command", "prompt": "also this"})]))
    lines = transcripts.read_lines(spark, str(tmp_path / "t.jsonl"))
    got = [(r.line, r.role, r.text, r.tools) for r in transcripts.turns(lines).orderBy("line").collect()]
    assert got == [(1, "user", "fix the bug", None), (3, "assistant", "done", ["Read /a/b"]), (5, "user", "deploy now please", None), (7, "user", "also this", None)]
    assert [(r.cwd, r.headless) for r in transcripts.metadata(lines).collect()] == [("/w", True)]


def test_reports_of_agents_tails_and_last_turns(spark, tmp_path):
    say = lambda kind, content, **k: json.dumps({"type": kind, "sessionId": "s", "message": {"role": kind, "content": content}} | k)
    call = [{"type": "tool_use", "name": "Task", "id": "t1", "input": {"description": "dig"}}]
    result = lambda i, c: [{"type": "tool_result", "tool_use_id": i, "content": c}]
    rows = [say("user", "go", uuid="p1"), say("assistant", call), say("user", result("t1", [{"type": "text", "text": "found it"}])), say("user", result("t9", "other")), say("user", "and now?", uuid="p2"),
        say("assistant", [{"type": "tool_use", "name": "find_memory", "id": "x", "input": {}}]), say("assistant", "All  done\nhere")]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n")
    lines = transcripts.read_lines(spark, str(tmp_path / "a.jsonl"))
    assert [r["at"] for r in lines.orderBy("line").collect()] == [sum(len(x.encode()) + 1 for x in rows[:i]) for i in range(len(rows))]
    texts = {r.line: (r.role, r.text) for r in transcripts.turns(lines).collect()}
    assert texts[2] == ("assistant", "Subagent report: found it") and 3 not in texts
    # the call is before the cursor: not recognised
    assert 2 not in {r.line for r in transcripts.turns(lines.where("line >= 2")).collect()}
    assert [(r.prompt, r.searched) for r in transcripts.last_turn_search(lines, "find_memory").collect()] == [("p2", True)]
    assert [(r.prompt, r.searched) for r in transcripts.last_turn_search(lines.where("line < 5"), "find_memory").collect()] == [("p2", False)]
    file = lines.first().file
    there = lambda reply: transcripts.final_reply(lines, spark.createDataFrame([(file, reply)], "file string, reply string")).first().there
    assert there("All done here") and there("  ") and not there("something else")
    assert [r.line for r in transcripts.tail(lines, len(rows[-1]) + 5).collect()] == [6] and transcripts.tail(lines, 10**6).count() == 7


def test_lines_of_files_read_in_parts(spark, tmp_path):
    rows = [f"line {i} " + "x" * (i * 37 % 200) if i % 5 else "" for i in range(400)]
    (tmp_path / "big.jsonl").write_text("\n".join(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.line: (r["at"], r.value) for r in transcripts.read_lines(spark, str(tmp_path / "big.jsonl")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: (sum(len(x) + 1 for x in rows[:i]), x) for i, x in enumerate(rows) if x}


def test_browsing(spark):
    cols = "id string, title string, kind string, project_key string, pinned boolean, seen_count long, aliases array<string>, superseded boolean, archived boolean, hash string, content string"
    rows = [("a1", "Cache warm-up", "rule", "p", True, 2, None, None, None, "h1", "c"), ("b2", "cache_size", "fact", "q", None, 1, [], False, False, "h2", "c"), ("c3", "Other a1", "preference", "q", True, 9, None, True, None, "h3", "c"), ("d4", "x", "rule", "test/1", False, 1, None, None, None, "h4", "c")]
    m = spark.createDataFrame(rows, cols)
    assert [r.id for r in browse.targets(m, "a1").collect()] == ["a1", "c3"] and [r.id for r in browse.targets(m, "CACHE", browse.STANDING).collect()] == ["a1"]
    assert [r.id for r in browse.pinned_first(m, "p").collect()] == ["a1", "c3"]
    assert {r.id for r in browse.pending_aliases(m, "test/").collect()} == {"a1"}
    got = {r.id: r.aliases for r in browse.backfill(m, prefix="test/").collect()}
    assert got == {"a1": ["warm up"]}
    plan = spark.createDataFrame([("p", "root/p"), ("q", None)], "key string, new_key string")
    assert {(r.id, r.repo_key) for r in browse.set_repo_key(m.withColumn("repo_key", F.lit("old")), plan).collect()} == {("a1", "root/p"), ("b2", "old"), ("c3", "old"), ("d4", "old")}
    stats = spark.createDataFrame([("w/a", 3), ("v/a", 5), ("w/b", 0), ("w/own", 9)], "project string, memories long")
    assert [(r.name, r.memories) for r in browse.busiest(stats, "x/own").collect()] == [("a", 5)]


def test_extraction_policy(spark):
    m = lambda **k: {"title": "t", "content": "c", "type": "rule", "entities": [{"name": " ", "type": ""}, {"name": "db", "type": "tech"}], "relations": [["a", "b"], ["a", "uses", "b"]], "aliases": ["X", "x"]} | k
    reply = "sure:\n```json\n" + json.dumps({"memories": [m(), m(op="update", target_id="k1"), m(op="update", target_id="zz", type="odd"), m(op="noop", target_id="zz"), m(op="noop", target_id="k1"), m(content="é" * 1000)],
        "feedback": [{"id": "s1", "verdict": "used"}, {"id": "s1", "verdict": "great"}, {"id": "no", "verdict": "wrong"}]}) + "\n```"
    df = spark.createDataFrame([(1, reply, False), (2, reply, True), (3, "no json", False)], "reply_id long, reply string, foreign boolean")
    known, shown = F.array(F.lit("k1")), F.array(F.lit("s1"))
    got = {}
    for r in extraction.memories(df, F.col("foreign"), known).orderBy("reply_id", "pos").collect():
        got.setdefault(r.reply_id, []).append(r)
    assert [(r.op, r.kind, r.target_id) for r in got[1]] == [("add", "rule", None), ("update", "rule", "k1"), ("add", "fact", None), ("noop", "rule", "k1"), ("add", "rule", None)]
    assert {(r.op, r.kind) for r in got[2]} == {("add", "fact")} and len(got[2]) == 4 and 3 not in got
    assert got[1][0].aliases == ["x"] and len(got[1][0].entities) == 1 and len(got[1][0].relations) == 1 and len(got[1][-1].content.encode()) == 1500
    assert [(r.reply_id, r.id, r.verdict) for r in extraction.verdicts(df, F.col("foreign"), shown).collect()] == [(1, "s1", "used")]
