"""SimHash near-dedup by a binary trie of fingerprints that is joined with itself.

A text's 64-bit fingerprint has the bits that over half of its three-word shingles' hashes have (XXH64, seed 42;
repeats count). Fingerprints at most `budget` bits apart are linked. Steps:

1. Rows of one fingerprint form a class (pre-aggregated); classes are joined, not rows.
2. Two nodes of one depth whose prefixes differ in d bits are met together: their children, STEP bits on, are paired
   by every mask of at most budget - d bits, an equi-join with the trie's own nodes, so that no pair beyond the budget
   is ever made. A pair goes on until its two nodes hold at most LEAF fingerprints: then it is a unit of work. Nodes
   are counted only below pairs that go on, so a crowded prefix costs more levels, not a larger task.
3. Units get the sorted fingerprints of both nodes and finish the descent bit by bit, all node pairs of a depth at
   once; a pair of single fingerprints is decided by its remaining bits. Each unit returns a spanning forest of its
   links: fewer rows than fingerprints, however many links there are.
4. The forests' components, and the least doc_id of each.

Defined cases: null, empty and wordless texts have the fingerprint zero, linked like any other; one or two words are one
shingle; very long texts are hashed whole, a block at a time; component_id is the least id that is not null among the
rows that can be reached, so a row with a null id gets the one of its component, and null if that has none; a
repeated id gives a row for each input row; other columns are not looked at, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, materialize, rows_of, ship, table
from .graph import connected_components

WORDS, SEED, BITS = 3, 42, 64
#: Bits that linked fingerprints may differ by; bits from one level of nodes to the next; fingerprints in a unit of work.
BUDGET, STEP, LEAF = 2, 4, 2048
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _shingles(text: bytes) -> Iterator[list[bytes]]:
    """The shingles of a text, block after block."""
    held, at, made = [], 0, False
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        w = held + text[at:end].lower().split()
        at = end
        if len(w) >= WORDS:
            made = True
            yield [b" ".join(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)]
            w = w[1 - WORDS :]
        held = w
    if held and not made:
        yield [b" ".join(held)]


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    ones, n = np.zeros(BITS, np.int64), 0
    for block in _shingles(text or b""):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in block), "<u8", len(block))
        for part in np.array_split(h, 1 + len(h) // 65_536):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row; a fingerprint is a long of the same 64 bits."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fingerprint long")


def _prefix(depth: int):
    return F.shiftrightunsigned("fingerprint", BITS - depth) if depth else F.lit(0).cast("long")


def _children(pairs: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """Pairs of children of pairs(p, q, d) among nodes(node, n), STEP bits on, within the budget; p <= q if they are of one node."""
    masks = [[m for m in range(1 << STEP) if m.bit_count() <= budget - d] for d in range(budget + 1)]
    allowed = F.element_at(F.array(*(F.array(*map(F.lit, m)) for m in masks)), F.col("d") + 1)
    left = nodes.select(F.col("node").alias("pc"), F.col("n").alias("np"), F.shiftrightunsigned("node", STEP).alias("_p"))
    right = nodes.select(F.col("node").alias("_q"), F.col("n").alias("nq"))
    held = pairs.select("p", "q", "d").join(left, F.col("p") == F.col("_p")).withColumn("mask", F.explode(allowed))
    child = F.shiftleft("q", STEP).bitwiseOR((F.col("pc").bitwiseAND((1 << STEP) - 1)).bitwiseXOR(F.col("mask")))
    held = held.withColumn("qc", child).where("p <> q or pc <= qc").join(right, F.col("qc") == F.col("_q"))
    return held.select(F.col("pc").alias("p"), F.col("qc").alias("q"), (F.col("d") + F.bit_count("mask")).cast("int").alias("d"), "np", "nq")


def units(prints: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(depth, pairs of nodes (p, q, d)) that hold at most `leaf` of the distinct prints(fingerprint), from the root on."""
    spark, n, leaf = prints.sparkSession, prints.count(), leaf or LEAF
    pairs = rows_of(spark, "p long, q long, d int", [(0, 0, 0)])
    if n <= leaf:
        yield 0, pairs
        return
    held = prints
    for depth in range(STEP, BITS + 1, STEP):
        nodes = materialize(held.groupBy(_prefix(depth).alias("node")).agg(F.count("*").alias("n")), f"trie-nodes{depth}")
        met = materialize(_children(pairs, nodes, budget), f"trie-pairs{depth}")
        done = F.lit(True) if depth == BITS else F.col("np") + F.when(F.col("p") == F.col("q"), 0).otherwise(F.col("nq")) <= leaf
        yield depth, met.where(done).select("p", "q", "d")
        pairs = met.where(~done)
        if pairs.isEmpty():
            return
        # further nodes are needed below those of open pairs only
        still = pairs.select(F.col("p").alias("_node")).union(pairs.select("q")).distinct()
        held = held.join(still, _prefix(depth) == F.col("_node"), "left_semi")


def meet(a: np.ndarray, b: np.ndarray, depth: int, left: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of sorted unsigned a and b, each of one prefix of `depth` bits, that differ in at most `left` of the other bits.

    same: a is b; then each pair of different ones is met once.
    """
    one = np.zeros(1, np.int64)
    x0, x1, y0, y1, room = one, one + len(a), one, one + len(b), one + left
    found = []
    for bit in range(BITS - 1 - depth, -1, -1):
        single = (x1 - x0 == 1) & (y1 - y0 == 1)
        if single.any():
            i, j, r = x0[single], y0[single], room[single]
            rest = (a[i] ^ b[j]) & np.uint64((1 << (bit + 1)) - 1)
            near = np.bitwise_count(rest) <= r
            found.append((i[near], j[near]))
            x0, x1, y0, y1, room = (v[~single] for v in (x0, x1, y0, y1, room))
        if not len(x0):
            break
        up, half = np.uint64((1 << 64) - (1 << (bit + 1))), np.uint64(1 << bit)
        xm = np.clip(np.searchsorted(a, (a[x0] & up) | half), x0, x1)
        ym = np.clip(np.searchsorted(b, (b[y0] & up) | half), y0, y1)
        mirror = (x0 == y0) & (x1 == y1) if same else np.zeros(len(x0), bool)
        parts = [(x0, xm, y0, ym, room), (xm, x1, ym, y1, room), (x0, xm, ym, y1, room - 1), tuple(v[~mirror] for v in (xm, x1, y0, ym, room - 1))]
        x0, x1, y0, y1, room = (np.concatenate(v) for v in zip(*parts, strict=True))
        keep = (x0 < x1) & (y0 < y1) & (room >= 0)
        x0, x1, y0, y1, room = (v[keep] for v in (x0, x1, y0, y1, room))
    found.append((x0, y0))  # distinct fingerprints are single once all bits are spent
    i, j = (np.concatenate(v) for v in zip(*found, strict=True))
    return (i[i != j], j[i != j]) if same else (i, j)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that edges u-v reach."""
    root = np.arange(n)
    while True:
        least, before = np.minimum(root[u], root[v]), root.copy()
        for side in (u, v):
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        root = root[root]
        if (root == before).all():
            return root


def _met(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["p"] == row["q"]
                a, b = (np.sort(np.array(row[side], np.int64).view(np.uint64)) for side in ("fp", "fq"))
                i, j = meet(a, b, row["depth"], budget - row["d"], same)
                if not len(i):
                    continue
                held = (a if same else np.concatenate([a, b])).view(np.int64)
                root = forest(len(held), i, j if same else j + len(a))
                own = np.flatnonzero(root != np.arange(len(held)))
                yield pa.RecordBatch.from_arrays([pa.array(held[own]), pa.array(held[root[own]])], ["a", "b"])

    return run


def edges(prints: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """(a, b): edges that connect all distinct prints(fingerprint) at most `budget` bits apart, written."""
    found = []
    for depth, pairs in units(prints, budget, leaf):
        who = pairs.select(F.col("p").alias("_node")).union(pairs.select("q")).distinct()
        # a node of a unit has at most `leaf` of them
        blocks = prints.withColumn("node", _prefix(depth)).join(who, F.col("node") == F.col("_node"), "left_semi").groupBy("node").agg(F.collect_list("fingerprint").alias("f"))
        blocks = materialize(blocks, f"trie-blocks{depth}")
        work = pairs.join(blocks.select(F.col("node").alias("p"), F.col("f").alias("fp")), "p").join(blocks.select(F.col("node").alias("q"), F.col("f").alias("fq")), "q")
        found.append(materialize(work.withColumn("depth", F.lit(depth)).mapInArrow(_met(budget), "a long, b long").distinct(), f"trie-edges{depth}"))
    out = found[0]
    for e in found[1:]:
        out = out.union(e)
    return out


def linked(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs(doc_id, text)."""
    rows = materialize(fingerprints(docs), "simhash-rows")
    prints = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-classes")
    root = materialize(connected_components(edges(prints.select("fingerprint"), budget)), "simhash-components")
    held = prints.join(root, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    least = held.groupBy(F.col("component").alias("_c")).agg(F.min("first").alias("component_id"))
    of = materialize(held.join(least, F.col("component") == F.col("_c")).select(F.col("fingerprint").alias("_f"), "component_id"), "simhash-ids")
    out = hot_join(rows, of, {"fingerprint": "_f"})
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
