import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as P
from mnemospark.llm import near_dedup as N
from mnemospark.llm.graph import connected_components


def brute_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(corpus):
    sets = {i: brute_set(t) for i, t in corpus.items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_matches_brute_force(docs, corpus):
    rows = N.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = brute(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None} == want
    assert sum(not k for _, _, k in want.values()) > 40
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None) == [(0, None, True), (5, None, True)] or all(r.component_id is None and r.kept for r in rows if r.doc_id is None)


def test_long_lists_lose_no_link(docs, corpus, monkeypatch):
    monkeypatch.setattr(N, "LONG", 2)
    rows = N.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == {i: c for i, (_, c, _) in brute(corpus).items()}


def test_empty(none):
    assert N.near_duplicates(none).collect() == []


def test_stage_keeps_one_of_each(spark, docs, corpus):
    out = N.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, _, k) in brute(corpus).items() if k)
    assert ids.count(None) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c", "dé", "É"]), max_size=30))
def test_shingle_sets(words):
    text = " ".join(words)
    assert len(N.shingle_set(text.encode(), N._WordHashes())) == len(brute_set(text))


@pytest.mark.parametrize("edges, want", [([], {}), ([(1, 1)], {}), ([(5, 4), (4, 3), (9, 8), (3, 2), (8, 9), (7, 9)], {2: 2, 3: 2, 4: 2, 5: 2, 7: 7, 8: 7, 9: 7}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)})])
def test_components(spark, edges, want):
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want


def test_sketch_estimates_jaccard():
    h = N._WordHashes()
    words = [f"w{i}" for i in range(3000)]
    a, b = N.shingle_set(" ".join(words).encode(), h), N.shingle_set(" ".join(words[150:]).encode(), h)
    u = np.union1d(a[: N.K], b[: N.K])[: N.K]
    assert abs(len(np.intersect1d(np.intersect1d(a[: N.K], b[: N.K]), u)) / N.K - 0.95) < 0.1


def test_pipeline_drops_pairs_between_the_thresholds(spark):
    text = [f"v{i}" for i in range(304)]  # 300 shingles; n changed words far apart take 5 n of them: 270 / 330, 265 / 335, 260 / 340
    rows = [(0, " ".join(text))] + [(n, " ".join(f"x{n}" if i % 30 == 15 and i // 30 < n else w for i, w in enumerate(text))) for n in (6, 7, 8)]
    for n in (6, 7, 8):
        df = spark.createDataFrame([rows[0], rows[n - 5]], "doc_id long, text string")
        assert N.near_duplicates(df).where("kept").count() == 2
        assert dict(P.STAGES)["near_dedup"](spark, df, "").count() == (1 if n == 6 else 2)


@pytest.mark.parametrize("percent", [80, 85])
def test_share_bounds_the_chance_of_a_miss(percent):
    r = np.random.default_rng(7)
    least = int(N.K * N.share(percent))
    assert N.share(85) == N.SHARE and (r.binomial(N.K, percent / 100, 1_000_000) >= least).all()
    assert sum(N.math.comb(N.K, i) * percent**i * (100 - percent) ** (N.K - i) for i in range(least)) < N.MISSED * 100**N.K


def test_repeated_ids_are_told_apart(spark):
    rows = [(1, "alpha text here"), (1, "beta words there"), (5, "alpha text here"), (6, "beta words there"), (2, "gamma"), (7, "gamma"), (7, "alpha text here"), (1, "alpha text here"), (None, "gamma"), (8, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component string, rep long")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 2, True), (5, 1, False), (6, 1, False), (7, 1, False), (7, 2, False), (8, 8, True)]
    out = N.dedup_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(1, "alpha text here"), (1, "beta words there"), (2, "gamma"), (None, "gamma"), (8, None)]))


def test_first_call_of_a_session_ships_the_package(spark):
    from mnemospark.llm import common

    common._shipped.clear()
    N.sketches(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert common._shipped
