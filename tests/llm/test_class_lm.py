import math
import random
import zlib

import numpy as np

from mnemospark.llm import class_lm as L


def test_base_and_counts(docs, corpus):
    rows = {r.doc_id: r for r in L.score(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    count = {}
    toks = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in corpus.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in corpus}
    for i, t in toks.items():
        for w in t if not held[i] else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in toks.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in count for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0


def test_edges(docs, none):
    assert L.score(none).collect() == []
    assert len(L.score(docs).collect()) == docs.count()


def _sentences(r, n):
    """Two kinds of words that alternate, in two languages."""
    out = []
    for _ in range(n):
        lang = r.choice("xy")
        out.append(" ".join(f"{'noun' if k % 2 else 'verb'}{lang}{r.randrange(60)}" for k in range(r.randrange(10, 40))))
    return out


def test_beats_the_base_on_held_out(spark):
    r = random.Random(9)
    df = spark.createDataFrame(list(enumerate(_sentences(r, 700))), "doc_id long, text string")
    rows = [x for x in L.score(df).collect() if x.held_out]
    assert len(rows) > 50
    gain = (sum(x.score for x in rows) - sum(x.base_score for x in rows)) / sum(x.n_tokens for x in rows)
    assert gain > 0.25  # the classes tell half the words and the language


def test_model_is_a_distribution():
    r = random.Random(1)
    unit = L.UnitOf({f"w{i}".encode(): 1 + i for i in range(5)})
    words = [f"w{i}".encode() for i in range(5)] + [f"tail{i}".encode() for i in range(40)]
    seq = [r.choice(words) for _ in range(3000)]
    bigrams = np.zeros((L.UNITS, L.UNITS))
    u = [0, *(unit[w] for w in seq), 0]
    np.add.at(bigrams, (u[:-1], u[1:]), 1)
    c = {w: seq.count(w) for w in words} | {L.END: 1}
    types, n = np.zeros(L.UNITS), np.zeros(L.UNITS)
    for w, k in c.items():
        types[unit[w]] += 1
        n[unit[w]] += k
    m = L.Model(unit.frequent, L.exchange(bigrams), bigrams, types, n)
    assert np.allclose((10**m.transition).sum(1), 1)
    seen = {m.of[unit[w]] for w in c}
    for k in seen:  # words of the class and its unknown word
        known = sum(max(x - m.discount, 0) / m.size[k] for w, x in c.items() if m.of[unit[w]] == k)
        assert math.isclose(known + 10 ** m.unknown[k], 1.0, rel_tol=1e-6) or k == 0


def test_exchange_finds_the_classes():
    r = np.random.default_rng(2)
    n = 24
    b = np.zeros((n, n))
    kind = np.array([0] + [1 + i % 2 for i in range(n - 1)])
    for _ in range(20_000):
        u = r.integers(1, n)
        v = r.choice(np.flatnonzero(kind == 3 - kind[u]))
        b[u, v] += 1
    of = L.exchange(b, classes=3)
    assert {of[i] for i in range(1, n) if kind[i] == 1} != {of[i] for i in range(1, n) if kind[i] == 2}
    assert len({(kind[i], of[i]) for i in range(1, n)}) == 2 and of[0] == 0


def test_words_beyond_the_frequent_are_clustered(spark):
    r = random.Random(4)
    word = lambda kind: f"{kind}{r.randrange(600)}same"  # noqa: E731  # one ending for all
    df = spark.createDataFrame([(i, " ".join(word("noun" if k % 2 else "verb") for k in range(120))) for i in range(900)], "doc_id long, text string")
    _, found, counts, _, _ = L.fit(L.chunked(df))
    listed = {bytes(x["word"]): found[bytes(x["word"])] for x in counts.where(f"c >= {L.LEAST}").distinct().collect()}
    moved = [(w, k) for w, (k, at) in listed.items() if at >= 0]
    assert len(moved) > 500 and len(found.keys) == len(moved)
    kinds = {}
    for w, k in moved:
        kinds.setdefault(k, []).append(w[:4])
    assert sum(max(v.count(b"noun"), v.count(b"verb")) for v in kinds.values()) > 0.95 * len(moved)


def test_best_class_is_that_of_brute_force():
    r = np.random.default_rng(3)
    kinds = np.array([0, *(1 + np.arange(11) % 4)])
    seq = np.array([0, *r.integers(1, 12, 400), 0])

    def table(of):
        t = np.zeros((5, 5))
        np.add.at(t, (of[seq[:-1]], of[seq[1:]]), 1)
        return t

    t = table(kinds)
    for w in range(1, 12):
        same = (seq[:-1] == w) & (seq[1:] == w)
        after = np.bincount(kinds[seq[1:]][(seq[:-1] == w) & ~same], minlength=5).astype(float)
        before = np.bincount(kinds[seq[:-1]][(seq[1:] == w) & ~same], minlength=5).astype(float)
        scores = [L.likelihood(table(np.where(np.arange(12) == w, c, kinds))) for c in range(1, 5)]
        assert L.best_class(t, L._xlogx(t), t.sum(1), t.sum(0), kinds[w], after, before, float(same.sum())) == 1 + int(np.argmax(scores))


def test_classes_grow_with_the_vocabulary():
    assert L.class_number(0) == L.CLASSES < L.class_number(10**5) < L.class_number(10**6)


def test_score_of_brute_force(spark):
    r = random.Random(5)
    texts = dict(enumerate(_sentences(r, 120))) | {500: None, 501: "", 502: "never seen words", 503: "nounx1 " * 30}
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in texts.items()], "doc_id long, text string, chunk long, word string")
    model, found, _, _, _ = L.fit(L.chunked(df))
    got = {x.doc_id: x for x in L.score(df).collect()}
    count = {}
    for i, t in texts.items():
        for w in L.tokens((t or "").encode()) if not L.held_out(i) else ():
            count[w] = count.get(w, 0) + 1
    k = lambda w: found[w][0]
    size, kinds = {}, {}
    for w, c in count.items():
        size[k(w)] = size.get(k(w), 0) + c
        kinds[k(w)] = kinds.get(k(w), 0) + 1
    pair = {}
    for i, t in texts.items():
        seq = [L.END, *L.tokens((t or "").encode())]
        for a, b in zip(seq, seq[1:], strict=False) if not L.held_out(i) else ():
            pair[k(a), k(b)] = pair.get((k(a), k(b)), 0) + 1
    classes = len(model.of)
    total = sum(pair.values())
    into = {c: sum(n for (_, b), n in pair.items() if b == c) for c in range(classes)}
    out = {c: sum(n for (a, _), n in pair.items() if a == c) for c in range(classes)}
    for i, t in texts.items():
        seq, want = [L.END, *L.tokens((t or "").encode())], 0.0
        for a, b in zip(seq, seq[1:], strict=False):
            share = (into[k(b)] + 1) / (total + classes)
            want += math.log10((pair.get((k(a), k(b)), 0) + share) / (out[k(a)] + 1))
            if b != L.END:
                c, n = count.get(b, 0), size.get(k(b), 0)
                want += math.log10((c - 0.5) / n if c else max(0.5 * kinds.get(k(b), 0), 1e-9) / n if n else 1.0)
        assert math.isclose(got[i].score, want, rel_tol=1e-9), i
        assert math.isclose(got[i].perplexity, 10 ** (-want / (len(seq) - 1)), rel_tol=1e-9)


def test_chunks_are_bounded(spark):
    many = [(i, f"text {i}") for i in range(2000)]
    size = lambda rows: [x["count"] for x in L.chunked(spark.createDataFrame(rows, "doc_id long, text string"), 100, 1 << 20).groupBy("chunk").count().collect()]
    for rows in (many, [*many, (10**15, "far")], [(7, t) for _, t in many], [(None, t) for _, t in many], [*many, (-(2**63), "a"), (2**63 - 1, "z")]):
        assert sum(size(rows)) == len(rows) and max(size(rows)) <= 250
    assert max(size([(i, "x" * 10_000) for i in range(200)])) <= 200
    assert sorted(size([(1, "x" * (1 << 20)), (2, "y" * (1 << 20)), (3, "z" * (1 << 20)), (4, "w" * (1 << 20))]))[-1] <= 3


def test_base_scores_train_no_model(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "" if i % 9 == 0 else f"the w{i % 13} Went to w{i % 7} and the end{i}") for i in range(120)] + [(None, "the"), (5, None)], "doc_id long, text string")
    order = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    rows = lambda df: sorted(map(repr, df.select(*order).collect()))
    want = rows(L.score(docs))
    monkeypatch.setattr(L, "exchange", None)
    assert rows(L.base_scores(docs)) == want
