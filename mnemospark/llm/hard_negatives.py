"""Hard-negative mining over a pivot table: triangle inequalities bracket inner products, survivors are checked exactly.

With R the longest vector's length, a row v becomes v' = (v, sqrt(R^2 - |v|^2)) and an anchor q' = (q, 0). Then
|q' - v'|^2 = |q|^2 + R^2 - 2 qv: the largest inner product is the nearest row. Steps:

1. Pivots are picked farthest-first among SAMPLE rows; every row's and every anchor's distances to them are stored.
2. Rows are dealt to blocks of at most ROWS, anchors to groups of at most GROUP, in ranges of label, nearest pivot and
   distance to it, and each has its least and greatest distance to each pivot. |d(q, p) - d(v, p)| and
   d(q, p) + d(v, p) bracket d(q, v), so these bound what a block can score with a group: a (group, block) cell that
   cannot hold a result of any of its anchors is not made.
3. In a cell the stored distances bracket each (anchor, row); those that can still matter are multiplied out.
   A first pass over each group's most promising cells gives every anchor a score to beat; a second one over all cells
   that can reach it is exact.
4. The same search runs twice: for positives (same label, any score), then for negatives (another label, in the
   band of scores that each positive asks for). Results are ranked with a bounded heap a task before the exchange.

Groups meet blocks by (slot, part): a stated query set against all rows, in blocks.

Defined cases: rows with a null id, label or vector, or a null, NaN or infinite component take no part; a shorter vector
counts as filled up with zeros; each row with a repeated id is a row of its own, an anchor row's result is
returned for each, and equal scores of equal ids go by place; anchors without positives, and positives without
negatives, have no rows; a negative positive score has an empty band; columns beyond vec_id, embedding and label are not
looked at; an empty table gives an empty result. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ship, table

#: Rows that pivots are picked from, and how many.
SAMPLE, PIVOTS = 4096, 16
#: Most rows of a block, most anchors of a group, cells of a group in the first pass.
ROWS, GROUP, FIRST = 1024, 256, 2
#: Blocks and groups that meet in one task.
MET = 512
LEAST, MOST = -(2**63), 2**63 - 1
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95

_BLOCK = "label long, ids array<long>, rows array<long>, vecs binary, dists binary, low array<double>, high array<double>, q2_low double, q2_high double"


def _matrix(vectors: list[list[int]], wide: int) -> np.ndarray:
    out = np.zeros((len(vectors), wide), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def pivots_of(rows: DataFrame, wide: int, r2: int, sample: int = SAMPLE, n: int = PIVOTS) -> np.ndarray:
    """At most n distinct augmented vectors of the sample, picked as the farthest from those before."""
    held = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).select("vec").collect()
    v = _matrix([r["vec"] for r in held], wide).astype(float)
    v = np.column_stack([v, np.sqrt(np.maximum(r2 - (v * v).sum(1), 0))])
    far, chosen = np.linalg.norm(v - v.mean(0), axis=1), []
    while len(chosen) < n and far.max() > 0:
        chosen.append(v[far.argmax()])
        d = np.linalg.norm(v - chosen[-1], axis=1)
        far = d if len(chosen) == 1 else np.minimum(far, d)
    # in a chain of neighbours, so that a block that spans two of them stays narrow
    left, chain = chosen[1:], chosen[:1] or [v[0]]
    while left:
        chain.append(left.pop(int(np.argmin([np.linalg.norm(p - chain[-1]) for p in left]))))
    return np.array(chain)


def _distances(v: np.ndarray, pivots: np.ndarray, r2: int | None) -> np.ndarray:
    """To each pivot; rows are augmented, anchors (r2 is None) get a zero."""
    v = v.astype(float)
    own = np.zeros(len(v)) if r2 is None else np.sqrt(np.maximum(r2 - (v * v).sum(1), 0))
    v = np.column_stack([v, own])
    return np.column_stack([np.linalg.norm(v - p, axis=1) for p in pivots])


def _with_distances(pivots: np.ndarray, wide: int, r2: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column("vec").to_pylist(), wide), pivots, r2)
            near = d.argmin(1)
            dists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel()))
            columns = [batch.column(c) for c in ("row", "vec_id", "label", "vec")] + [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), dists]
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "label", "vec", "near", "d", "dists"])

    return run


def _blocks(size: int, wide: int):
    """Rows in order become blocks of one label."""

    def block(rows: list[dict]) -> dict:
        rows = sorted(rows, key=lambda r: (r["vec_id"], r["row"]))
        v, d = _matrix([r["vec"] for r in rows], wide), np.array([r["dists"] for r in rows])
        q2 = (v.astype(float) ** 2).sum(1)
        small = v.size == 0 or np.abs(v).max() < 2**31
        return {"label": rows[0]["label"], "ids": [r["vec_id"] for r in rows], "rows": [r["row"] for r in rows], "vecs": v.astype("<i4" if small else "<i8").tobytes(), "dists": d.tobytes(),
                "low": d.min(0).tolist(), "high": d.max(0).tolist(), "q2_low": float(q2.min()), "q2_high": float(q2.max())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            kind = pa.schema([("label", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("vecs", pa.binary()), ("dists", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("q2_low", pa.float64()), ("q2_high", pa.float64())])
            for row in batch.to_pylist():
                if held and (len(held) >= size or row["label"] != held[0]["label"]):
                    yield pa.RecordBatch.from_pylist([block(held)], kind)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([block(held)], kind)

    return run


def blocked(rows: DataFrame, pivots: np.ndarray, wide: int, r2: int | None, size: int, name: str) -> DataFrame:
    """The pivot table of rows(row, vec_id, label, vec) by block, numbered by `at`, written."""
    held = rows.mapInArrow(_with_distances(pivots, wide, r2), "row long, vec_id long, label long, vec array<long>, near int, d double, dists array<double>")
    order = ["label", "near", "d", "row"]
    held = materialize(held, f"{name}-pivots").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(size, wide), _BLOCK)
    return materialize(held.withColumn("at", F.monotonically_increasing_id()), f"{name}-blocks")


def cells(groups: DataFrame, blocks: DataFrame, asked: DataFrame, r2: int, same: bool) -> DataFrame:
    """(g, b, best): what meets, with the most that a row of the block can score. asked(g, floor, top) is what its anchors look for."""
    side = ["label", "low", "high"]
    g = groups.select(F.col("at").alias("g"), *(F.col(c).alias(f"g_{c}") for c in [*side, "q2_low", "q2_high"])).join(asked.select(F.col("g").alias("_g"), "floor", "top"), F.col("g") == F.col("_g"))
    b = blocks.select(F.col("at").alias("b"), *side)
    slots, parts = (1 + df.count() // MET for df in (g, b))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    g = g.withColumn("slot", F.pmod(F.xxhash64("g"), F.lit(slots)).cast("int")).withColumn("part", spread(parts))
    b = b.withColumn("_part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")).withColumn("_slot", spread(slots))
    met = g.join(b, (F.col("slot") == F.col("_slot")) & (F.col("part") == F.col("_part"))).where((F.col("label") == F.col("g_label")) if same else (F.col("label") != F.col("g_label")))
    apart = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("g_low", "g_high"), lambda x, y: F.greatest(F.lit(0.0), x["low"] - y["g_high"], y["g_low"] - x["high"]))
    about = F.zip_with("high", "g_high", lambda x, y: x + y)
    slack = (F.col("g_q2_high") + r2) * 1e-9
    best = (F.col("g_q2_high") + r2 - F.pow(F.array_max(apart), F.lit(2))) / 2 + slack
    worst = (F.col("g_q2_low") + r2 - F.pow(F.array_min(about), F.lit(2))) / 2 - slack
    met = met.select("g", "b", "floor", "top", best.alias("best"), worst.alias("worst"))
    return met.where((F.col("best") >= F.col("floor")) & (F.col("worst") <= F.col("top"))).select("g", "b", "best")


def brackets(da: np.ndarray, dv: np.ndarray, q2: np.ndarray, r2: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each (anchor, row), from their distances to the pivots."""
    gap, about = np.zeros((len(da), len(dv))), np.full((len(da), len(dv)), np.inf)
    for p in range(da.shape[1]):
        x, y = da[:, p, None], dv[None, :, p]
        np.maximum(gap, np.abs(x - y), out=gap)
        np.minimum(about, x + y, out=about)
    room = (q2 + r2)[:, None]
    return (room - about**2) / 2 - room * 1e-9, (room - gap**2) / 2 + room * 1e-9


def _products(a: np.ndarray, v: np.ndarray, r2: int) -> np.ndarray:
    if r2 < 2**53:  # no partial sum exceeds what doubles hold exactly
        return (a.astype(float) @ v.astype(float).T).astype(np.int64)
    return a @ v.T


def _searched(k: int, r2: int):
    def unpacked(row, side):
        n = len(row[f"{side}_ids"])
        raw = row[f"{side}_vecs"]
        kind = "<i8" if len(raw) == 8 * n * row["wide"] else "<i4"
        v, d = np.frombuffer(raw, kind).reshape(n, -1).astype(np.int64), np.frombuffer(row[f"{side}_dists"]).reshape(n, -1)
        return v, d, np.array(row[f"{side}_ids"]), np.array(row[f"{side}_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                a, da, _, own = unpacked(row, "g")
                v, dv, ids, rows = unpacked(row, "b")
                band, low, high = (np.array([x[c] for x in row["bands"]], np.int64) for c in ("band", "low", "high"))
                place = {r: i for i, r in enumerate(own.tolist())}
                of = np.array([place[x["row"]] for x in row["bands"]])
                need, top = np.full(len(a), MOST), np.full(len(a), LEAST)
                np.minimum.at(need, of, low)
                np.maximum.at(top, of, high)
                lower, upper = brackets(da, dv, (a.astype(float) ** 2).sum(1), r2)
                alive = (upper >= need[:, None]) & (lower <= top[:, None]) & (own[:, None] != rows[None, :])
                r, c = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                if not len(r):
                    continue
                scores = np.full(alive.shape, LEAST)
                scores[np.ix_(r, c)] = _products(a[r], v[c], r2)
                held = scores[of]
                held[~alive[of] | (held < low[:, None]) | (held > high[:, None])] = LEAST
                each, out = np.arange(len(of)), []
                for _ in range(min(k, held.shape[1])):
                    j = held.argmax(1)  # the first of equals: rows are in order of id
                    s = held[each, j]
                    out.append((each[s > LEAST], j[s > LEAST], s[s > LEAST]))
                    held[each, j] = LEAST
                i, j, s = (np.concatenate(x) for x in zip(*out, strict=True))
                columns = [own[of[i]], band[i], rows[j], ids[j], s]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["anchor", "band", "other", "other_id", "score"])

    return run


def best(groups: DataFrame, blocks: DataFrame, bands: DataFrame, k: int, wide: int, r2: int, same: bool, name: str) -> DataFrame:
    """(anchor, band, other, other_id, score, rank), written: the k best rows of each of bands(g, row, band, low, high), equal scores by id."""
    found = "anchor long, band long, other long, other_id long, score long"
    order = W.partitionBy("anchor", "band").orderBy(F.desc("score"), "other_id", "other")

    def searched(bands: DataFrame, first: int | None, step: str) -> DataFrame:
        own = materialize(bands.groupBy("g").agg(F.min("low").alias("floor"), F.max("high").alias("top"), F.collect_list(F.struct("row", "band", "low", "high")).alias("bands")), f"{name}-{step}-bands")
        met = cells(groups, blocks, own, r2, same)
        if first:
            met = met.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(F.desc("best"), "b"))).where(F.col("place") <= first)
        load = ("ids", "rows", "vecs", "dists")
        # groups are the smaller load: they travel to the blocks
        met = materialize(met.select("g", "b"), f"{name}-{step}-cells").join(groups.select(F.col("at").alias("g"), *(F.col(c).alias(f"g_{c}") for c in load)), "g").join(own.select("g", "bands"), "g")
        met = met.join(blocks.select(F.col("at").alias("b"), *(F.col(c).alias(f"b_{c}") for c in load)), "b").withColumn("wide", F.lit(wide))
        held = met.mapInArrow(_searched(k, r2), found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return materialize(held, f"{name}-{step}")

    seen = searched(bands, FIRST, "first").where(F.col("rank") == k).select(F.col("anchor").alias("_row"), F.col("band").alias("_band"), F.col("score").alias("floor"))
    raised = bands.join(seen, (F.col("row") == F.col("_row")) & (F.col("band") == F.col("_band")), "left")
    return searched(raised.select("g", "row", "band", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high"), None, "all")


def _down(x: Column) -> Column:
    """x / 100 in whole numbers, rounded down."""
    return F.floor((x - F.pmod(x, F.lit(100))).cast("decimal(38,0)") / 100).cast("long")


def mined(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vectors(vec_id, label, vec array<long>), anchors being those of the predicate.

    Negatives score from low to high hundredths of their positive.
    """
    ship(vectors.sparkSession)
    rows = vectors.where("vec_id is not null and label is not null and vec is not null").select("vec_id", F.col("label").cast("long").alias("label"), "vec")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mine-rows")
    length = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, wide, r2 = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(length)).first()
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return vectors.sparkSession.createDataFrame([], none)
    wide = max(wide, 1)
    pivots = pivots_of(rows, wide, r2)
    blocks = blocked(rows, pivots, wide, r2, ROWS, "mine-rows")
    groups = blocked(rows.where(anchors), pivots, wide, None, GROUP, "mine-anchors")
    who = materialize(groups.select(F.col("at").alias("g"), F.explode(F.arrays_zip("rows", "ids")).alias("x")).select("g", F.col("x.rows").alias("row"), F.col("x.ids").alias("anchor_id")), "mine-who")
    bands = who.select("g", "row", F.lit(0).cast("long").alias("band"), F.lit(LEAST + 1).alias("low"), F.lit(MOST).alias("high"))
    near = best(groups, blocks, bands, positives, wide, r2, True, "mine-near")
    score = F.col("score")
    asked = near.join(who, F.col("anchor") == F.col("row")).select("g", "row", F.col("rank").cast("long").alias("band"), (-_down(-low * score)).alias("low"), _down(high * score).alias("high"))
    hard = best(groups, blocks, asked.where("low <= high"), negatives, wide, r2, False, "mine-hard")
    pairs = near.select(F.col("anchor").alias("_a"), F.col("rank").alias("_p"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(pairs, (F.col("anchor") == F.col("_a")) & (F.col("band") == F.col("_p"))).join(who.select("row", "anchor_id"), F.col("anchor") == F.col("row"))
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vec of embeddings(vec_id, embedding, label): floor(256 x) of each component; rows with a null or non-finite one are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where("embedding is not null").where(finite).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vec"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


#: From the definition: every anchor is multiplied with every row.
OP12_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5),
n AS (SELECT p.a, p.anchor_id, p.b, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
