import math
import random

import numpy as np
import pytest

from mnemospark.llm import hard_negatives as H
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, row string, vec string, g long"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """From the definition; rows of (vec_id, label, whole vector) that take part, anchors those divisible by 50."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, (a, la, va) in enumerate(rows):
        if a % 50:
            continue
        scored = sorted((-dot(va, v), b, la == lb) for j, (b, lb, v) in enumerate(rows) if j != i)
        for s, p, same in [x for x in scored if x[2]][:positives]:
            held = [(n, x) for n, x, alike in scored if not alike and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, k, x, -s, -n) for k, (n, x) in enumerate(held, 1)]
    return sorted(out)


def parts(rows):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    f = lambda x: math.floor(256 * float(np.float32(x)))
    return [(r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], [f(x) for x in r[1]]) for r in ok]


def sample(seed, n, dims=6, labels=3, kinds=None):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        lab = 0 if r.random() < 0.4 else r.randrange(labels)
        rows.append((i, [c + r.gauss(0, 0.6) for c in centres[lab]], lab))
    if kinds:  # few distinct vectors: ties everywhere
        rows = [(i, rows[r.randrange(kinds)][1], lab) for i, _, lab in rows]
    return rows


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)
    v = H.whole(df).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(r) for r in H.mined(v, F.col("vec_id") % 50 == 0).collect())


@pytest.mark.parametrize("kinds", [None, 9])
def test_matches_brute_force(spark, monkeypatch, kinds):
    monkeypatch.setattr(H, "ROWS", 40)
    monkeypatch.setattr(H, "GROUP", 3)
    monkeypatch.setattr(H, "MET", 4)
    rows = sample(4, 700, kinds=kinds)
    rows += [(2000, None, 1), (2050, [1.0] * 6, None), (None, [1.0] * 6, 1), (2100, [1.0, None, 1.0], 1), (2150, [float("nan")] * 6, 1), (2200, [float("inf")] * 6, 1),
             (2250, [], 1), (2300, [0.5, 0.25], 0), (2350, [0.0] * 6, 1), (2400, [-9.0] * 6, 2)]
    found = mined(spark, rows)
    assert found == brute(parts(rows)) and len(found) > 60


def test_repeated_ids_and_rows(spark):
    rows = sample(6, 120)
    rows += [rows[0], rows[0], rows[50], (0, [1.0] * 6, 2), (50, rows[0][1], 0)]
    assert mined(spark, rows) == brute(parts(rows))


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, None, 1)]) == [] and mined(spark, [(50, [1.0], 1)]) == [] and mined(spark, [(51, [1.0], 1), (52, [1.0], 2)]) == []


def test_brackets_hold():
    r = np.random.default_rng(2)
    a, v = r.integers(-300, 300, (30, 8)), r.integers(-300, 300, (400, 8))
    r2 = int((v**2).sum(1).max())
    aug = np.column_stack([v, np.sqrt(r2 - (v**2).sum(1))])
    pivots = aug[:5]
    lower, upper = H.brackets(H._distances(a, pivots, None), H._distances(v, pivots, r2), (a.astype(float) ** 2).sum(1), r2)
    scores = a @ v.T
    assert (lower <= scores).all() and (scores <= upper).all() and np.allclose(upper[:, :5], scores[:, :5], rtol=1e-6, atol=1)


def test_cells_are_left_out(spark):
    """Far blocks meet no group: labels in two far corners, positives are looked for in one."""
    rows = [(i, [10.0 if i % 2 else -10.0, i / 1000], 0) for i in range(400)]
    v = H.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")).withColumn("row", F.col("vec_id"))
    r2 = v.agg(F.max(F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()[0]
    pivots = H.pivots_of(v, 2, r2)
    blocks, groups = H.blocked(v, pivots, 2, r2, 50, "t"), H.blocked(v.where("vec_id % 50 = 0"), pivots, 2, None, 4, "t")
    asked = groups.select(F.col("at").alias("g"), F.lit(1).alias("floor"), F.lit(H.MOST).alias("top"))
    made, most = H.cells(groups, blocks, asked, r2, True).count(), groups.count() * blocks.count()
    assert 0 < made <= 0.6 * most
