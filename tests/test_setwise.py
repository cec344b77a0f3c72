"""Recall for many prompts equals single recalls; evaluation; closures of replacements; maps of keys."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.engine import Engine
from mnemospark.operators import graph, recall, setwise, write
from mnemospark.sources import transcripts

BATCH = "seq long, project_key string, title string, content string, kind string, aliases array<string>, entities array<struct<name:string,type:string>>"
WORDS = [f"w{i}x" for i in range(40)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    r = random.Random(3)
    e = Engine(spark, str(tmp_path_factory.mktemp("s")), lambda: 1_000_000)
    rows = []
    for i in range(300):
        words = ["common"] * (i % 3 > 0) + ["often"] * (i % 2) + r.sample(WORDS, 4) + [f"own{i}"]
        names = [(" ".join(r.sample(WORDS[:12], r.randrange(1, 3))), "t") for _ in range(r.randrange(0, 3))]
        rows.append((i, r.choice("pq"), f"title {i}", " ".join(words), r.choice(["fact", "rule"]), r.sample(WORDS, r.randrange(0, 2)), names))
    e.remember(spark.createDataFrame(rows, BATCH))
    e.feedback(e.memory.where("pmod(xxhash64(id), 9) = 0").select("id", F.lit("used").alias("verdict")))
    e.archive(e.memory.where("pmod(xxhash64(id), 11) = 0").select("id"))
    return e


@pytest.mark.parametrize("k, floor", [(3, 0.0), (5, 4.0)])
def test_equals_single_recalls(spark, store, monkeypatch, k, floor):
    r = random.Random(k)
    asked = [(i, ["common", "often", *r.sample(WORDS, r.randrange(0, 5)), *([r.choice(WORDS[:12])] * 2)], ["p", "", None, "q"][i % 4]) for i in range(5)]
    asked += [(5, [], "p"), (6, ["nothing"], "p"), (7, ["common"], "q"), (8, ["common", "own7", "own8", "own9", "own10"], "")]
    prompts = spark.createDataFrame(asked, "pid long, tokens array<string>, project string")
    seen = []
    needed = setwise.needed

    def noted(terms, *args):
        out = needed(terms, *args)
        seen.append((terms.count(), out.count()))
        return out

    monkeypatch.setattr(setwise, "needed", noted)
    x, mem, corpus = store.index(), store.memory, store.corpus()
    found = setwise.best(x, mem, prompts, corpus=corpus, now=1_000_000, k=k, min_match=floor, least=1)
    mine = {}
    for row in found.join(mem.select("hash", "id"), "hash").orderBy("pid", "rank").collect():
        mine.setdefault(row.pid, []).append((row.id, row.match, row.score))
    assert floor or seen[0][1] < seen[0][0]  # common words were not needed everywhere
    for pid, tokens, project in asked:
        parts = x.keyword_hits(tokens), x.entity_hits(tokens), x.related_hits(tokens, 1)
        one = recall.ranked(recall.merge_and_score(mem, *parts, corpus=corpus, now=1_000_000, project=project or "", min_match=floor), k).collect() if tokens else []
        assert mine.get(pid, []) == [(m.id, m.match, m.score) for m in one], pid


def test_prompts_too_many_for_each_task(spark, store, monkeypatch):
    prompts = spark.createDataFrame([(i, ["common", "often", WORDS[i], WORDS[(i * 7) % 40]], "pq"[i % 2]) for i in range(12)], "pid long, tokens array<string>, project string")
    run = lambda: sorted(map(tuple, setwise.best(store.index(), store.memory, prompts, corpus=store.corpus(), now=1_000_000, k=3, least=1).collect()))
    few = run()
    monkeypatch.setattr(setwise, "TERMS", 0)
    assert few and run() == few


def test_neighbours_are_counted_for_what_may_be_among_the_best(spark, store, monkeypatch):
    prompts = spark.createDataFrame([(i, ["common", "often", *WORDS[i : i + 3]], "") for i in range(9)], "pid long, tokens array<string>, project string")
    kept, put = {}, setwise.written
    monkeypatch.setattr(setwise, "written", lambda df, name, *order: kept.setdefault(name, put(df, name, *order)))
    setwise.best(store.index(), store.memory, prompts, corpus=store.corpus(), now=1_000_000, k=3, least=1)
    assert kept["contenders"].count() < kept["candidates"].count()
    # a row a memory, so what belongs to it does not move with each of its terms
    assert kept["prompt-postings"].count() == kept["prompt-postings"].select("hash").distinct().count()


def test_context_runs(spark, store):
    rows = [(0, "own7", "own8 own9", ""), (1, "words unknown here", "own10", ""), (2, "own11 own12 own13", "own14", ""), (3, "nobody knows this", None, ""), (4, "nobody knows this", "neither that", None)]
    got = {}
    for r in store.recall_all(spark.createDataFrame(rows, "pid long, text string, context string, project string"), 5).collect():
        got.setdefault(r.pid, set()).add((r.content.split()[-1], r.ctx))
    live = {c.content.split()[-1] for c in store.live().collect()}
    want = {0: ({"own7", "own8", "own9"}, 2), 1: ({"own10"}, 1), 2: ({"own11", "own12", "own13"}, 0)}
    assert got == {p: {(w, c) for w in ws & live} for p, (ws, c) in want.items() if ws & live}


def test_evaluation_of_a_case_file(spark, store, tmp_path):
    live = [m for m in store.live().orderBy("title").collect()]
    cases = [{"name": "a", "mode": "search", "prompt": live[0].content, "expect": [live[0].title.upper()]}, {"name": "b", "mode": "hook", "prompt": live[1].content, "expect": [live[1].title, "no such title"], "cwd": "p"}, {"name": "c", "mode": "search", "prompt": "nothing", "expect": ["x"]}]
    (tmp_path / "cases.jsonl").write_text("# cases\n\n" + "\n".join(map(json.dumps, cases)))
    held, summary = store.evaluate(transcripts.eval_cases(spark, str(tmp_path / "cases.jsonl")))
    got = {r.case_id: (r.hit, r.rank, r.recall) for r in held.collect()}
    assert got == {"a": (True, 1, 1.0), "b": (True, 1, 0.5), "c": (False, 0, 0.0)}
    assert {r["mode"]: (r.n, r.hit_rate, r.mrr) for r in summary.collect()} == {"search": (2, 0.5, 0.5), "hook": (1, 1.0, 1.0)} and held.where("chars > 0").count() == 2


def test_newest(spark):
    edges = [(f"n{i + 1}", f"n{i}") for i in range(20)] + [("n3", "m"), ("z", "y"), ("x", "x"), ("c1", "c0"), ("c2", "c1"), ("c0", "c2"), ("c0", "d"), ("n5", "two"), ("n1", "two"), (None, "q")]
    got = {r.id: (r["head"], r.steps) for r in graph.newest(spark.createDataFrame(edges, "newer string, older string")).collect()}
    want = {f"n{i}": ("n20", 20 - i) for i in range(20)} | {"m": ("n20", 18), "y": ("z", 1), "two": ("n20", 20)} | dict.fromkeys(("c0", "c1", "c2", "d"), (None, None))
    assert got == want
    assert graph.newest(spark.createDataFrame([], "newer string, older string")).collect() == []


def test_maps_of_keys(spark):
    keys = spark.createDataFrame([("/a/b/c",), ("/a/b",), ("/a/bc",), ("/a",), ("x",), ("",), (None,), ("/a/b/c",)], "key string")
    p = spark.createDataFrame([("/a", "/n"), ("/a/b/", "/m"), ("/a/b", "/z"), ("", "no")], "prefix string, target string")
    assert {r.key: r.new_key for r in write.prefix_mapped(keys, p).collect()} == {"/a/b/c": "/m/c", "/a/b": "/m", "/a/bc": "/n/bc", "/a": "/n"}


def test_rekey(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), lambda: 1000)
    e.remember(spark.createDataFrame([(i, p, "T", f"text {i}", "rule", [], [("a", "")]) for i, p in enumerate(["/w/one", "/w/two", "/v"])], BATCH))
    before = {m.id: m.hash for m in e.memory.collect()}
    maps = {"prefixes": spark.createDataFrame([("/w", "/home")], "prefix string, target string"), "manual": spark.createDataFrame([("/w/two", "/hand")], "key string, target string")}
    want = {"/w/one": "/home/one", "/w/two": "/hand", "/v": None}
    assert {r.key: r.new_key for r in e.rekey(**maps).collect()} == want and e.memory.where("repo_key is not null").count() == 0
    e.rekey(**maps, apply=True)
    assert {m.project_key: m.repo_key for m in e.memory.collect()} == want and {m.id: m.hash for m in e.memory.collect()} == before
    assert {m.project_key for m in e.search("text").collect()} == {"/home/one", "/hand", "/v"}
    assert [m.project_key for m in e.rules("/hand").collect()][0] == "/hand"
