import math

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import recall as R

NOW = 10_000_000
MEM = "hash string, id string, title string, content string, kind string, project_key string, keywords array<string>, alias_only array<string>, last_seen_at long, last_used_at long, seen_count long, used_count long, disputed_count long, pinned boolean"


def mem(spark, rows):
    base = {"kind": "fact", "project_key": "p", "keywords": [], "alias_only": [], "last_seen_at": NOW, "last_used_at": None, "seen_count": 1, "used_count": 0, "disputed_count": 0, "pinned": False}
    full = [base | {"hash": r["id"], "title": r["id"], "content": "content " + r["id"]} | r for r in rows]
    return spark.createDataFrame([tuple(r[c.strip().split(" ")[0]] for c in MEM.split(",")) for r in full], MEM)


def looked_up(m, e, ment):
    """The index as one save of these would have left it, and the reference: scans of the tables."""
    from mnemospark.operators import index

    none = lambda df: df.limit(0)
    m = m.withColumns({"superseded": F.lit(False), "archived": F.lit(False)})
    related = e.sparkSession.createDataFrame([], "k1 string, k2 string, weight long")
    after = {"memory": m, "mentions": ment, "entities": e, "related": related}
    x = index.changes({n: none(df) for n, df in after.items()}, after, 7)
    return R.Index(x["words"], x["names"], x["mentioned"], x["near"])


def score(spark, rows, tokens, entities=(), n=2000, q3=(), **options):
    m = mem(spark, rows)
    e = spark.createDataFrame([(k, k, list(t)) for k, t, _ in entities], "entity_key string, name_lc string, tokens array<string>")
    ment = spark.createDataFrame([(h, k) for k, _, hs in entities for h in hs], "hash string, entity_key string")
    corpus = spark.createDataFrame([(n,)], "n long")
    near = spark.createDataFrame(list(q3), "hash string, hits long")
    x = looked_up(m, e, ment)
    out = R.merge_and_score(m, x.keyword_hits(tokens), x.entity_hits(tokens), near, corpus=corpus, now=NOW, **options)
    return {r.id: r for r in out.collect()}


def idf(n, df):
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


FRESH = 2 + 0.3 * math.log(2)


def test_rare_beats_common_and_alias_weighs_half(spark):
    rows = [{"id": "rare", "keywords": ["zeta"]}, {"id": "alias", "keywords": ["eta"], "alias_only": ["eta"]}] + [{"id": f"c{i}", "keywords": ["common"]} for i in range(30)]
    s = score(spark, rows, ["zeta", "common", "eta"])
    assert s["rare"].score == pytest.approx(idf(2000, 1) + FRESH, abs=1e-5) and s["c3"].score == pytest.approx(idf(2000, 30) + FRESH, abs=1e-5)
    assert s["alias"].score == pytest.approx(idf(2000, 1) / 2 + FRESH, abs=1e-5)


def test_repeated_terms_count_twice(spark):
    s = score(spark, [{"id": "a", "keywords": ["x1"]}], ["x1", "x1"])
    assert s["a"].match == pytest.approx(2 * idf(2000, 2), abs=1e-5)


def test_entities_exact_partial_and_compound(spark):
    rows = [{"id": "e"}, {"id": "p"}, {"id": "k", "keywords": ["memstore"]}, {"id": "m"}]
    ents = [("memstore", ["memstore"], ["e", "k"]), ("memstore cluster", ["memstore", "cluster"], ["p"]), ("a/b", ["a/b"], ["m"])]
    s = score(spark, rows, ["memstore", "a/b"], ents)
    df = 2  # exact names of two memories; one keyword, one partial
    assert s["e"].match == pytest.approx(idf(2000, df), abs=1e-5) and s["p"].match == pytest.approx(idf(2000, 1), abs=1e-5)
    assert s["k"].match == pytest.approx(idf(2000, 1), abs=1e-5)  # the keyword already counts it
    assert s["m"].match == pytest.approx(2 * idf(2000, 1), abs=1e-5)


def test_related_is_a_bonus_only_and_capped(spark):
    s = score(spark, [{"id": "a", "keywords": ["x1"]}, {"id": "b"}], ["x1"], q3=[("a", 9), ("b", 9)])
    assert set(s) == {"a"} and s["a"].match == pytest.approx(idf(2000, 1) + 1.0, abs=1e-5)


def test_floor_is_before_boosts(spark):
    rows = [{"id": f"c{i}", "keywords": ["x1"], "used_count": 50} for i in range(40)]
    assert score(spark, rows, ["x1"], n=50, min_match=2.0) == {} and len(score(spark, rows, ["x1"], n=50)) == 40


def test_feedback_age_and_project(spark):
    rows = [{"id": "used", "keywords": ["x1"], "used_count": 3}, {"id": "plain", "keywords": ["x1"]}, {"id": "bad", "keywords": ["x1"], "disputed_count": 9}, {"id": "old", "keywords": ["x1"], "last_seen_at": NOW - 14 * 86400}, {"id": "here", "keywords": ["x1"], "project_key": "q"}]
    s = score(spark, rows, ["x1"], project="q")
    assert s["used"].score > s["plain"].score > s["old"].score > s["bad"].score and s["here"].score == pytest.approx(s["plain"].score + 1, abs=1e-5)
    assert s["plain"].score - s["bad"].score == pytest.approx(3, abs=1e-5) and s["plain"].score - s["old"].score == pytest.approx(2 - 2 / math.e, abs=1e-5)


def test_order_page_exclude_budget(spark):
    df = spark.createDataFrame([("b", 2.0, "x" * 50), ("a", 2.0, "y" * 40), ("c", 3.0, "z" * 30), ("d", 1.0, "w")], "id string, score double, line string")
    assert [r.id for r in R.ranked(df).collect()] == ["c", "a", "b", "d"] and [r.id for r in R.ranked(df, 2, 1).collect()] == ["a", "b"]
    assert {r.id for r in R.excluding(df, spark.createDataFrame([("c",)], "id string")).collect()} == {"a", "b", "d"}
    kept = R.budgeted(df, [F.desc("score"), "id"], "line", 200, reserve=120).collect()
    assert {r.id for r in kept} == {"c", "a"}  # b does not fit, and d behind it is not tried


def test_rules(spark):
    rows = [{"id": "r1", "kind": "rule", "project_key": "q", "seen_count": 9}, {"id": "r2", "kind": "rule"}, {"id": "r3", "kind": "rule", "project_key": "q", "pinned": True}, {"id": "p1", "kind": "preference"}, {"id": "p2", "kind": "preference", "project_key": "p/sub"}, {"id": "f"}]
    m = mem(spark, rows)
    assert [r.id for r in R.sorted_rules(m, "p", 10).collect()] == ["r3", "r2", "r1"]
    assert [(r.id, r.group_no) for r in R.session_rules(m, "p").collect()] == [("r3", 0), ("r2", 1), ("p1", 2), ("r1", 3), ("p2", 4)]
    assert {r.id: r.kept for r in R.here_set(m, "p", "home").collect()} == {"r1": False, "r2": True, "r3": True, "p1": True, "p2": True}


def test_summary(spark):
    df = spark.createDataFrame([(f"i{k}", float(k), f"title number {k}") for k in range(9)], "id string, score double, title string")
    lines = [r.line for r in R.summary_lines(df, 3, 8).orderBy("pos").collect()]
    assert lines == ["title n…"] * 3 + ["… 6 more"]
