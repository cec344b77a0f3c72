import itertools
import math
import re

from mnemospark.llm import filter_audit as A


def brute(docs, labels):
    """docs of (doc_id, text, source): every order walked row by row."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and least[t] < i else set()
        rows.append((s or "", bad, any(x == i and q == 1 for x, q, _ in labels if x is not None), any(x == i and q == 1 for x, _, q in labels if x is not None)))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(kept), len(removed), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in rows if r[0] == part), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                total[part, f] = total.get((part, f), 0) + len(removed)
                left, gone = kept, gone + removed
    return sorted((p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items())


LABELS = [(i, i % 2, i % 3 == 0) for i in range(0, 200, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (9999, 1, 1), (1, None, None), (6, None, 1)]


def test_matches_brute_force(spark, docs):
    extra = [(300, "Word " * 250, "s0"), (301, "Word " * 250, "s1"), (302, "UPPER " + " ".join(f"w{i}" for i in range(300)), "s0"), (303, " ".join(f"w{i}" for i in range(300)) + " &", ""), (303, " ".join(f"w{i}" for i in range(300)) + " &", ""), (None, "Word " * 250, "s0")]
    df = docs.select("doc_id", "text", "source", "key").unionByName(spark.createDataFrame([(*e, "k") for e in extra], "doc_id long, text string, source string, key string"))
    labels = spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t), "part") for i, q, t in LABELS], "doc_id long, quality int, toxic int, part string")
    found = sorted(tuple(r) for r in A.audit(df, labels).collect())
    assert found == brute([(r.doc_id, r.text, r.source) for r in df.collect()], LABELS)
    assert len(found) == 600 * 3 and all(r[-1] <= math.factorial(5) * df.count() for r in found)


def test_empty(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(none, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    rows = A.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120 == sum(r.removed for r in rows if r.filter_order[r.step - 1] == "A")


def test_lattice(spark):
    rows = A.steps(spark).collect()
    assert len(rows) == 600 and len({r.filter_order for r in rows}) == 120 and len({(r.applied, r.filter) for r in rows}) == 80
