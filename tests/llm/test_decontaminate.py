import hashlib
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate as D

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UP))


def brute(text, items):
    w, hit, found = toks(text), set(), set()
    for item, t in items:
        b = toks(t)
        if item is None or not b:
            continue
        n = min(10, len(b))
        for i in range(len(b) - n + 1):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == b[i : i + n]:
                    hit.update(range(s, s + n))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit)


@pytest.fixture(scope="module")
def items(corpus):
    w = toks(corpus[5])
    return [(1, " ".join(w[3:25])), (2, "ONE, Two? THREE four"), (10, " ".join(toks(corpus[160])[-50:-10])), (9, " ".join(toks(corpus[160])[-50:-10])), (4, ""), (5, None), (None, corpus[7]), (6, "Éa öb ÉA"), (7, "loop " * 12), (8, "y éa"), (1, " ".join(w[3:25]))]


def test_matches_brute_force(spark, docs, corpus, items):
    rows = D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(corpus[r.doc_id], items), r.doc_id
    assert sum(r.contaminated for r in rows) > 40


def test_empty(spark, docs, none, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.decontaminate(none, bench).collect() == []
    assert not any(r.contaminated for r in D.decontaminate(docs, bench.limit(0)).collect())


def test_without_broadcast(spark, docs, corpus, items, monkeypatch):
    from mnemospark.llm import common

    monkeypatch.setattr(common.small, "__defaults__", (None, 0))
    rows = D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).where("doc_id is not null").collect()
    assert {r.doc_id: r.n_hit for r in rows} == {i: brute(t, items)[1] for i, t in corpus.items()}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zeta q q q eta"), (2, "eta " + "q " * 30 + "zeta"), (3, "eta zeta")], "doc_id long, text string")
    _, phrases, index = D.corpus_index(D.token_table(docs), spark.createDataFrame([(1, "zeta eta")], "item_id long, text string"))
    assert {(r.doc_id, r.gap) for r in D.proximity_matches(index, phrases, 5).collect()} == {(1, 4), (3, 1)}


def test_stage(spark, docs, corpus, tmp_path):
    spark.createDataFrame([(1, " ".join(toks(corpus[5])[3:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = D.decontaminate_stage(spark, docs, str(tmp_path))
    hit = {i for i, t in corpus.items() if brute(t, [(1, " ".join(toks(corpus[5])[3:25]))])[4]}
    assert hit and out.columns == docs.columns
    assert {r.doc_id for r in out.where(F.col("doc_id").isNotNull()).collect()} == set(corpus) - hit and out.count() == docs.count() - len(hit)
