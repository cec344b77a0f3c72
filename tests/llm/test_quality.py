import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mnemospark.llm import quality_classifier as C
from mnemospark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 8))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_statistics(docs, corpus):
    rows = Q.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(corpus[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def mcd(x, support=Q.SUPPORT):
    """Minimum covariance determinant of vectors, from the definition: centre and scatter (without floors)."""
    floors = np.diag(np.square(Q.FLOORS))
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floors), x - m)
    low = lambda v: np.sort(v)[-(-len(v) // 2) - 1]  # noqa: E731  least value that half do not exceed
    m = np.array([low(c) for c in x.T])
    spread = np.diag([(1.4826 * low(np.abs(c - k))) ** 2 for c, k in zip(x.T, m, strict=True)])
    best = None
    for m, c in ((m, spread), (x.mean(0), np.cov(x.T, bias=True))):
        for _ in range(40):
            bins = np.floor(np.log(np.maximum(d2(m, c), 1e-9)) * Q.BINS)
            last = next(b for b in np.sort(np.unique(bins)) if (bins <= b).sum() >= support * len(x))
            near = x[bins <= last]
            m, c = near.mean(0), np.cov(near.T, bias=True) * Q.consistency(support)
            found = np.log(np.linalg.det(c + floors)), m, c
            best = found if best is None or found[0] < best[0] - 1e-9 else best
    return best[1:]


def drawn(n, own, wider, prior=Q.PRIOR):
    a, b = n / (n + prior), prior / (n + prior)
    apart = own[0] - wider[0]
    return a * own[0] + b * wider[0], a * own[1] + b * wider[1] + a * b * np.outer(apart, apart)


def test_verdict_of_brute_force(spark):
    r = random.Random(11)
    rows = []
    for i in range(900):
        t = _clean(r).split()
        kind = r.random()
        if kind < 0.1:
            t = [w + "#$"[i % 2] * 2 for w in t]
        elif kind < 0.2:
            t = t[:30] * 2 + t
        elif kind < 0.25:
            t = ["verylongword" * 4 + w for w in t]
        rows.append((i, ("\n" if kind > 0.6 else " ").join(t) if i % 50 else "too short", ["en", "de", None][i % 3], ["a", "b", None][i // 300] if i % 7 else f"rare{i % 11}", "x", 1.0, "g"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, level string, x0 double, g string")
    got = {x.doc_id: x for x in Q.quality_rules(df).collect()}
    usable = {k: v for k, v in got.items() if not v.base_failed}
    vec = {k: np.round(np.array([math.log(max(v.word_chars, 1) / v.n_words)] + [math.log1p(100 * c / v.n_words) for c in (v.n_symbols, v.n_dup_lines, v.n_repeat_words)]) * Q.GRID) / Q.GRID for k, v in usable.items()}
    of = lambda ids: np.array([vec[i] for i in ids])
    everything = mcd(of(usable))
    for lang in ("en", "de", None):
        mine = [i for i in usable if rows[i][2] == lang]
        language = drawn(len(mine), mcd(of(mine)), everything)
        for source in {rows[i][3] for i in mine}:
            own = [i for i in mine if rows[i][3] == source]
            x = of(own)
            m, c = drawn(len(own), mcd(x) if len(own) > 1 else (x[0], np.zeros((4, 4))), language)
            inv = np.linalg.inv(c + np.diag(np.square(Q.FLOORS)))
            for i, v in zip(own, x, strict=True):
                want = (v - m) @ inv @ (v - m)
                assert math.isclose(usable[i].distance2, want, rel_tol=1e-6, abs_tol=1e-9), (i, lang, source)
                assert usable[i].kept == (want <= Q.CUTOFF)
    assert 20 < sum(not v.kept for v in usable.values()) < 300


def _clean(r):
    return " ".join(f"{'abcdefgh'[r.randrange(8)] * r.randrange(2, 9)}{r.randrange(900)}" for _ in range(r.randrange(60, 120)))


def test_outliers_go_and_clean_rows_stay(spark):
    r = random.Random(1)
    rows = [(i, _clean(r), "en", "s") for i in range(300)]
    odd = [(1000 + i, " ".join(w + "###" for w in _clean(r).split()), "en", "s") for i in range(60)]
    found = {x.doc_id: x.kept for x in Q.quality_rules(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i] for i in range(300)) and not any(found[1000 + i] for i in range(60))


def test_rules_empty_and_stage(spark, docs, none):
    assert Q.quality_rules(none).collect() == []
    out = Q.quality_stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = {r.doc_id for r in Q.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == kept


def test_consistency_factor():
    # for four dimensions and all rows the factor is one
    assert abs(Q.consistency(1 - 1e-12) - 1) < 1e-3 and Q.consistency(0.5) > Q.consistency(0.9) > 1


def _labelled(spark, n=800):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        toxic, low = r.random() < 0.15, r.random() < 0.15
        w = _clean(r).split()
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vile", "nasty", "awful"])
        if low:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 9}"))
        labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out(spark):
    docs, labels = _labelled(spark)
    found = C.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = [r.kept == (r.quality == 1 and r.toxic == 0) for r in found]
    assert len(right) == 400 and sum(right) >= 390


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, 0), (3, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    rows = C.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.kept is not None for r in rows)
    assert C.classify(none, labels).collect() == []
    assert all(r.kept for r in C.classify(docs, labels.limit(0)).collect())


def test_shrinkage(spark):
    model = {"targets": {t: {"rate": 0.2, "weights": {}} for t in C.TARGETS}}
    held = lambda groups: spark.createDataFrame([(f"h{h}", "p", 5.0 if i < bad else -5.0) for h, n, bad in groups for i in range(n)], "host string, path string, e_low double").withColumn("e_toxic", F.lit(0.0))
    rates = lambda groups: {x._host: x.r_low for x in C.posteriors(held(groups), model).collect()}
    apart = rates([(0, 400, 360), (1, 400, 10), (2, 2, 2), (3, 400, 40)])
    assert 0.2 < apart["h2"] < 0.95 and apart["h0"] > 0.8 and 0.2 > apart["h3"] > apart["h1"]
    alike = rates([(h, 100, 20 + h % 3) for h in range(12)] + [(99, 2, 2)])
    assert abs(alike["h99"] - 0.2) < 0.05  # where sites hardly differ, two rows say next to nothing


def test_rates_and_verdicts_of_brute_force(spark, monkeypatch):
    """Everything behind the evidence, row by row: sums, strengths, shrinkage, what the others leave, verdicts."""
    r = random.Random(3)
    rows = [(i, f"t{i}", f"h{i % 5 if i % 3 else 0}" if i % 17 else None, ["a", "b", None][i * 7 % 3], r.choice([-4.0, -1.0, 0.5, 3.0]) + i % 5, r.choice([-3.0, 2.0])) for i in range(300)]
    evidence = {x[1]: x[4:] for x in rows}
    model = {"targets": {"low": {"rate": 0.2, "weights": {}}, "toxic": {"rate": 0.1, "weights": {}}}}
    monkeypatch.setattr(C, "fit", lambda docs, labels: model)

    def fixed(model):
        def run(batches):
            for b in batches:
                e = [evidence[t] for t in b.column("text").to_pylist()]
                kept = b.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x[0] for x in e]), pa.array([x[1] for x in e])], [*kept.schema.names, "e_low", "e_toxic"])
        return run

    monkeypatch.setattr(C, "_evidence", fixed)
    df = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, source string, lang string")
    got = {x.doc_id: x for x in C.classify(df, None).collect()}
    logit = lambda p: math.log(p / (1 - p))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def strength(groups, rate):  # (n, mean, prior)
        total = sum(n for n, _, _ in groups)
        within = rate * (1 - rate)
        between = (sum(n * (m - c) ** 2 for n, m, c in groups) - (len(groups) - 1) * within) / (total - sum(n * n for n, _, _ in groups) / total)
        return min(max(within / between - 1, 1.0), 1e4) if between > 0 else 1e4

    for k, t in enumerate(C.TARGETS):
        rate = model["targets"][t]["rate"]
        soft = {x[0]: sigmoid(x[4 + k] + logit(rate)) for x in rows}
        hosts, paths = {}, {}
        for x in rows:
            hosts.setdefault(x[2], []).append(soft[x[0]])
            paths.setdefault((x[2], x[3]), []).append(soft[x[0]])
        j = strength([(len(v), sum(v) / len(v), rate) for v in hosts.values()], rate)
        prior = {h: (sum(v) + j * rate) / (len(v) + j) for h, v in hosts.items()}
        s = strength([(len(v), sum(v) / len(v), prior[h]) for (h, _), v in paths.items()], rate)
        for x in rows:
            own, h, p = soft[x[0]], hosts[x[2]], paths[x[2], x[3]]
            left = (sum(h) - own + j * rate) / (len(h) - 1 + j)
            left = (sum(p) - own + s * left) / (len(p) - 1 + s)
            assert math.isclose(got[x[0]][f"r_{t}"], left, rel_tol=1e-9), (t, x)
            assert math.isclose(got[x[0]][f"p_{t}"], sigmoid(x[4 + k] + logit(left)), rel_tol=1e-9)
    assert all(v.kept == (max(v.p_low, v.p_toxic) <= 0.5) for v in got.values()) and 20 < sum(v.kept for v in got.values()) < 280
