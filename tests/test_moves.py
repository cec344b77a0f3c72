"""What is wide moves as often as it must: seen in plans without broadcasts."""

import os
import re
from contextlib import contextmanager

import pytest

from mnemospark.operators import cluster, graph, save
from mnemospark.plans import adapters, catalog

SF = "/root/testdata/sf0.001"


@contextmanager
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def nodes(df) -> list[tuple[str, str]]:
    """(operator, its input columns) of the plan."""
    said = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [(name, " ".join(re.findall(r"Input.*", body))) for name, body in re.findall(r"\n\(\d+\) ([^\n]+)\n(.*?)(?=\n\n)", said, re.S)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_texts_are_grouped_and_ordered_only(spark):
    with unbroadcast(spark):
        found = nodes(adapters.memories(spark, SF))
    assert any(name.startswith("Window") for name, _ in found)
    assert not [name for name, columns in found if re.match("Window|.*Join", name) and re.search(r"\b(text|content)#", columns)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_memories_are_ordered_where_they_were_grouped(spark):
    with unbroadcast(spark):
        assert "rangepartitioning" not in adapters.memories(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_what_a_query_does_not_look_up_is_not_stored(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(adapters.Model, "kept", lambda self, name: asked.append(name))
    index = adapters.Model(spark, SF).index
    index.mentioned, index.near  # noqa: B018
    assert asked == ["mentioned", "near"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_memories_without_contents_move_no_text(spark):
    whole, known = adapters.memories(spark, SF), adapters.memories(spark, SF, content=False)
    grouped = lambda df: [columns for name, columns in nodes(df) if re.match("Sort|Exchange", name) and re.search(r"\btext#", columns)]
    with unbroadcast(spark):
        assert grouped(whole) and not grouped(known)
    assert "content" not in known.columns
    rows = lambda df: sorted(map(repr, df.select(*sorted(known.columns)).collect()))
    assert rows(known) == rows(whole)


def _documents(spark, path):
    rows = [(3, "Alpha beta. x", "en", "s"), (1, " alpha BETA. x ", "en", "s"), (1, " alpha BETA. x ", "en", "s"), (1, "other text", "en", "s"), (2, "alpha beta. x", "de", "t"), (4, None, "en", "s"), (None, "no number", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_known_memories_of_odd_documents(spark, tmp_path):
    """Copies that differ in case and white space, repeated and missing numbers, no text."""
    _documents(spark, tmp_path)
    whole, known = adapters.memories(spark, str(tmp_path)), adapters.memories(spark, str(tmp_path), content=False)
    rows = lambda df: sorted(map(repr, df.select(*sorted(known.columns)).collect()))
    assert rows(known) == rows(whole)
    found = adapters.Model(spark, str(tmp_path)).with_content(known.where("seq is not null"))
    contents = lambda df: sorted(map(repr, df.select("hash", "seq", "content").collect()))
    assert contents(found) == contents(whole.where("seq is not null"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["recall_all_prompts", "context_sections", "retrieval_floor", "similar_memories_k12"])
def test_recall_stores_no_contents(spark, monkeypatch, name):
    monkeypatch.setattr(adapters, "_stored", {})
    monkeypatch.setattr(adapters, "_built", {})
    catalog.queries()[name](spark, SF)
    assert [k for *_, k in adapters._stored if k == "known"] and not [k for *_, k in adapters._stored if k == "memory"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lines_fetch_the_texts_of_their_rows_only(spark):
    m = adapters.Model(spark, SF)
    some = m.known.orderBy("id").limit(5).localCheckpoint()
    with unbroadcast(spark):
        assert any(name.startswith("BroadcastHashJoin") for name, _ in nodes(m.with_content(some)))
    assert m.with_content(some).where("content is null").isEmpty()


def _save(spark):
    lists = ", keywords array<string>, aliases array<string>, alias_only array<string>"
    mem = spark.createDataFrame([("h0", "p", "t", "t", "some content", "rule", 1, 0, "i0", False, [], [], [])], "hash string, project_key string, title string, title_lc string, content string, kind string, seen_count long, last_seen_at long, id string, superseded boolean" + lists)
    for c, kind in {"created_at": "long", "used_count": "long", "disputed_count": "long", "injected_count": "long", "source_session": "string", "archived": "boolean", "pinned": "boolean"}.items():
        mem = mem.selectExpr("*", f"cast(null as {kind}) as {c}")
    rows = spark.createDataFrame([(0, "p", "t", "new content", "rule", [], [])], "seq long, project_key string, title string, content string, kind string, aliases array<string>, entities array<struct<name:string,type:string>>")
    return mem, save.staged(rows)


def test_new_rows_are_found_once(spark):
    """Titles, updates, noops and outcomes each ask what is new and what is gone."""
    with unbroadcast(spark):
        outcomes = save.effects(*_save(spark)).outcomes
        assert "LeftAnti" not in outcomes._jdf.queryExecution().toString()


def test_memories_move_once_in_a_save(spark):
    with unbroadcast(spark):
        mem, b = _save(spark)
        after = save.memories_after(mem, save.effects(mem, b), 7)
        moved = [columns for name, columns in nodes(after) if name == "Exchange" and re.search(r"\blast_seen_at#", columns)]
    assert len(moved) == 1
    assert sorted((r.title, r.content, r.superseded) for r in after.collect()) == [("t", "new content", False), ("t", "some content", True)]


def test_keywords_do_not_move_with_pairs(spark):
    mem = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "z"]), ("c", ["x", "y"]), ("d", [])], "hash string, keywords array<string>")
    ment = spark.createDataFrame([(h, e) for h, e in ("a1", "b1", "c1", "a2", "c2", "d2", "a2", "b3")], "hash string, entity_key string")
    with unbroadcast(spark):
        found = cluster.pairs(mem, ment, 0.3)
        assert sum(name.endswith("Join") or "Join " in name for name, _ in nodes(found)) == 2
    assert sorted((r.a, r.b, round(r.jaccard, 4)) for r in found.collect()) == [("a", "b", 0.3333), ("a", "c", 1.0), ("b", "c", 0.3333)]
    assert cluster.pairs(mem, ment, 0.3, 2).collect() == []


def test_two_hops_by_one_item_hold_keys_only(spark):
    m = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 11), (2, 12), (3, 12), (3, 13), (4, 10)], "item long, key long")
    found = graph.two_hops(m, 10, 1)
    assert "Aggregate [_a#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(11, 1), (12, 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_basket_is_dealt_once(spark):
    with unbroadcast(spark):
        moved = [columns for name, columns in nodes(adapters.Model(spark, SF).basket) if name == "Exchange" and re.search(r"\bkey#", columns)]
    assert len(moved) == 1


def test_tasks_grow_in_number_with_the_graph(spark, monkeypatch):
    few = adapters.Model(spark, SF).dealt
    monkeypatch.setattr(adapters, "DEALT", 100)
    assert adapters.Model(spark, SF).dealt > 10 * few


def test_dealt_pairs_are_counted_alike(spark):
    m = spark.createDataFrame([(i % 40, i * i % 23) for i in range(400)], "item long, key long")
    assert sorted(map(tuple, graph.cooccurrence(m, 3).collect())) == sorted(map(tuple, graph.cooccurrence(m).collect()))


def test_hubs_count_keys_of_distinct_rows(spark):
    m = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, 12)], "item long, key long")
    found = graph.hubs(m, graph.cooccurrence(m), 9)
    assert "count(distinct" not in found._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in found.collect()] == [(10, 2, 2), (11, 1, 1), (12, 1, 1)]
