"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's words are lower-cased (A-Z) and cut into five-word shingles; one 64-bit hash per shingle gives
its set, of which the K least values are retained. Steps:

1. Rows with equal sets form classes (pre-aggregated); one representative stands for each.
2. Inverted lists hold the representatives by retained value. Two sets with the wanted similarity share
   at least `least_overlap` retained values (but for a chance below 10^-7 a pair, see `share`), so lists of only
   the rarest retained values suffice: a value that many documents share is used by those that hold little else.
3. Lists longer than LONG give way to lists over the full sets of their members: a set that shares too few
   shingles with any other of them is out, and only its rarest shared ones that could prove a link are
   listed. This bound is exact, where sketches must allow for chance.
4. In each list every member is paired with three leaders, a linear number of pairs: the one with the
   fewest shingles of its own, the least id, and one drawn by hash. The union of two sketches estimates
   the similarity and drops far pairs; the rest is confirmed on the full sets of the texts. Linked
   representatives merge into components.
5. Pairs of a list that are neither connected nor tested follow, each with a member outside the list's
   main component, and only in the sizes that the unshared shingles of both allow. After that no link
   between different texts is left out.

Defined cases: null or wordless text has an empty set and is linked with nothing; fewer than five words
are one shingle; null ids keep a row without a component; a repeated id gives a row for each input row,
judged by its own text, and different texts of one id are linked only if they are similar; columns beyond
doc_id and text are not looked at, whatever their names; very long texts take part whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, hot_join, materialize, row_key, ship, small, table, without
from .graph import connected_components

#: Words of a shingle, retained values, and the similarity in hundredths: that of op1's contract, that of the stage.
WORDS, K, PERCENT, STAGE_PERCENT = 5, 96, 85, 80
#: Share of the retained values that two linked sets have in common, at the most that is asked for; see `share`.
SHARE, MISSED = 0.6, 1e-7
#: Members from which a list is replaced by lists over full sets.
LONG = 32
_SEEN = 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _SEEN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@cache
def share(percent: int) -> float:
    """Share of K retained values, in hundredths and up to SHARE, that fewer of are common to two sets of that similarity with a chance below MISSED."""
    p = percent / 100
    below = lambda least: sum(math.comb(K, i) * p**i * (1 - p) ** (K - i) for i in range(least))
    return next(s / 100 for s in range(round(100 * SHARE), 0, -1) if below(math.floor(K * s / 100)) < MISSED)


def shingle_set(text: bytes | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text (UTF-8)."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    acc = np.full(n - width + 1, 0x9E3779B97F4A7C15 * width % 2**64, np.uint64)
    for i in range(width):
        acc ^= h[i : n - width + 1 + i]
        acc *= np.uint64(0xFF51AFD7ED558CCD)
        acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0xC4CEB9FE1A85EC53)
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sizes, keys, values = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            s = shingle_set(text, hashes)
            sizes.append(len(s))
            keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            values.append((s[:K] ^ np.uint64(1 << 63)).view(np.int64))  # signed order is then that of the hashes
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.empty(0, np.int64)])))
        columns = [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), sketch]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "set_key", "sketch"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, set_key (equal for equal sets, null if empty) and the sketch of each row."""
    ship(docs.sparkSession)
    return keyed(docs).mapInArrow(_sketches, "doc_id long, key long, n_shingles long, set_key binary, sketch array<long>")


def classes_of(rows: DataFrame) -> DataFrame:
    """(rep, doc_id, key, n_shingles, set_key, sketch): the first row of each set, written. rep is its number.

    That is its doc_id, unless another set has the same first id: then a number beyond all ids.
    """
    first = F.min(F.struct("doc_id", "key", "n_shingles", "sketch")).alias("m")
    held = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(first).select("set_key", "m.*")
    held = materialize(held, "dedup-sets-first")
    shared = held.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_key").alias("own")).where("n > 1")
    shared = materialize(shared.select(F.col("doc_id").alias("_d"), "own"), "dedup-shared-ids")
    if not shared.limit(1).count():
        return held.withColumn("rep", F.col("doc_id"))
    lo, hi = held.agg(F.min("doc_id"), F.max("doc_id")).first()
    place = F.monotonically_increasing_id()
    other = F.lit(hi + 1) + place if hi < 1 << 62 else F.lit(lo - 1) - place
    out = held.join(small(shared), held["doc_id"] == F.col("_d"), "left")
    return materialize(out.withColumn("rep", F.when(F.col("own").isNull() | (F.col("own") == F.col("set_key")), F.col("doc_id")).otherwise(other)).drop("_d", "own"), "dedup-classes")


def texts_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of wanted(rep)."""
    who = materialize(wanted.join(reps.select("rep", "doc_id", "key"), "rep").select("rep", F.col("doc_id").alias("_d"), F.col("key").alias("_k")), "dedup-wanted")
    return keyed(docs).join(small(who), (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k"))).select("rep", "text")


def least_overlap(size, percent: int = PERCENT):
    """Retained values that a set with `size` of them shares with any set it is linked with."""
    return F.greatest(F.floor(size * share(percent)), F.lit(1)).cast("int")


def inverted_lists(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(value, rep, n): for each representative, its rarest retained values that can prove a link."""
    held = reps.select("rep", F.col("n_shingles").alias("n"), F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    mine = held.join(shared, "value").groupBy("rep", "n", "s").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("values"))
    # those that no other has come first in the order and are left out of the count
    return mine.select("rep", "n", F.explode(F.slice("values", 1, F.greatest(F.size("values") - least_overlap(F.col("s"), percent) + 1, F.lit(0)))).alias("x")).select("x.value", "rep", "n")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sets = [shingle_set(t, hashes).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in sets])]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), values], ["rep", "values"])


def full_lists(docs: DataFrame, reps: DataFrame, chosen: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(value, rep, n, u) over the full sets of the chosen(rep): the rarest shared shingles that can prove a link.

    u: how many shingles of the set come before value in the common order, those that no other has among them.
    If value is the first that two sets have in common, none of these is; each link is found by that one.
    """
    sets = materialize(texts_of(docs, reps, chosen).mapInArrow(_sets, "rep long, values array<long>").where(F.size("values") > 0).dropDuplicates(["rep"]), "dedup-sets")
    held = sets.select("rep", F.size("values").cast("long").alias("n"), F.explode("values").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    mine = held.join(shared, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    mine = mine.withColumn("u", F.col("n") - F.size("values"))
    # a partner shares percent of the set at least, so the rarest others and one more hold a common shingle
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("u")
    out = mine.select("rep", "n", "u", F.posexplode(F.slice("values", 1, F.greatest(room, F.lit(0)).cast("int"))).alias("pos", "x"))
    return out.select(F.xxhash64("x.value").alias("value"), "rep", "n", (F.col("u") + F.col("pos")).alias("u"))


def candidate_lists(reps: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(value, rep, n, u): lists of retained values, and lists over full sets in place of the long ones."""
    lists = materialize(inverted_lists(reps, percent), "dedup-retained")
    sizes = materialize(lists.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"), "dedup-sizes")
    short = lists.join(sizes.where(F.col("size") <= LONG), "value", "left_semi")
    chosen = materialize(lists.join(sizes.where(F.col("size") > LONG), "value", "left_semi").select("rep").distinct(), "dedup-chosen")
    long = full_lists(docs, reps, chosen, percent)
    return short.select("value", "rep", "n", F.lit(0).cast("long").alias("u")).unionByName(long)


def _near(na, nb, percent):
    return (100 * na >= percent * nb) & (100 * nb >= percent * na)


def _possible(na, ua, nb, ub, percent):
    """Whether sets of these sizes, so many shingles of which are not in common, can be similar enough."""
    return (100 + percent) * F.least(na - ua, nb - ub) >= percent * (na + nb)


def estimated(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs(a, b) whose union sketch holds enough common values."""
    left = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    both = F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))
    found = pairs.join(left, "a").join(right, "b").withColumn("u", union)
    return found.where(F.size(both) >= F.floor(F.size("u") * share(percent))).select("a", "b")


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = _WordHashes(), {}

        def of(side: str, doc: int, text: bytes) -> np.ndarray:
            if last.get(side, (None,))[0] != (doc, text):
                last[side] = ((doc, text), shingle_set(text, hashes))
            return last[side][1]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for x, y, tx, ty in zip(a, b, batch.column("ta").cast(pa.binary()).to_pylist(), batch.column("tb").cast(pa.binary()).to_pylist(), strict=True):
                sx, sy = of("a", x, tx), of("b", y, ty)
                same = len(np.intersect1d(sx, sy, assume_unique=True))
                keep.append(100 * same >= percent * (len(sx) + len(sy) - same))
            chosen = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield chosen

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs(a, b) whose full shingle sets are similar enough."""
    pairs = materialize(pairs, "dedup-estimated")
    texts = texts_of(docs, reps, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_confirmed(percent), "a long, b long").distinct()


def star_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each member of a list with three leaders: the least unshared, the least id, and one drawn by hash."""
    me = [F.col("rep").alias("rep"), F.col("n").alias("n"), F.col("u").alias("u")]
    order = [[(F.col("u") * 1000 / F.col("n")).alias("o")], [F.lit(0).alias("o")], [F.xxhash64("value", "rep").alias("o")]]
    heads = lists.groupBy("value").agg(*(F.min(F.struct(*o, *me)).alias(f"l{i}") for i, o in enumerate(order)), F.count("*").alias("size")).where("size > 1")
    heads = heads.select("value", F.explode(F.array(*(F.struct(*(F.col(f"l{i}.{c}").alias(c) for c in ("rep", "n", "u"))) for i in range(3)))).alias("l")).distinct()
    held = lists.join(heads, "value").where((F.col("rep") != F.col("l.rep")) & _near(F.col("n"), F.col("l.n"), percent) & _possible(F.col("n"), F.col("u"), F.col("l.n"), F.col("l.u"), percent))
    return held.select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b")).distinct()


def _bin(n):
    """Sizes within about two hundredths share a bin."""
    return F.floor(F.log(n.cast("double")) * 50)


def open_pairs(lists: DataFrame, component: DataFrame, tested: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Untested pairs of a list between components. Each has a member outside the list's main component."""
    own = lists.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = own.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    own = materialize(own.join(mixed, "value", "left_semi").withColumn("bin", _bin(F.col("n"))), "dedup-open")
    main = own.groupBy("value", "component").agg(F.count("*").alias("c")).groupBy("value").agg(F.max(F.struct("c", "component")).alias("m")).select("value", F.col("m.component").alias("main"))
    few = own.join(main, "value").where("component <> main").select("value", *(F.col(c).alias(f"f_{c}") for c in ("rep", "n", "u", "component")), F.col("main"))
    # the sizes that a partner may have, given what is not in common
    most = F.least(F.col("f_n") * 100 / percent, (100 + percent) * (F.col("f_n") - F.col("f_u")) / percent - F.col("f_n"))
    least = F.col("f_n") * percent / 100
    few = few.where(most >= least - 1e-6).withColumn("bin", F.explode(F.sequence(_bin(F.greatest(least - 1e-6, F.lit(0.5))), _bin(most + 1e-6))))
    met = few.join(own, ["value", "bin"]).where((F.col("component") != F.col("f_component")) & _near(F.col("n"), F.col("f_n"), percent) & _possible(F.col("n"), F.col("u"), F.col("f_n"), F.col("f_u"), percent) &
        # two outsiders meet twice: once from each side
        ((F.col("component") == F.col("main")) | (F.col("f_rep") < F.col("rep"))))
    pairs = met.select(F.least("rep", "f_rep").alias("a"), F.greatest("rep", "f_rep").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, component, component_id for each row of docs(doc_id, text); sets of that similarity are linked.

    component numbers the group, and component_id is its smallest doc_id: two groups may share that if an id is repeated.
    """
    rows = materialize(sketches(docs), "dedup-sketches")
    reps = classes_of(rows)
    lists = materialize(candidate_lists(reps, docs, percent), "dedup-lists")
    stars = materialize(star_pairs(lists, percent), "dedup-stars")
    links = materialize(confirmed(estimated(stars, reps, percent), docs, reps, percent), "dedup-links")
    first = connected_components(links)
    rest = materialize(open_pairs(lists, first, stars, percent), "dedup-rest")
    more = materialize(confirmed(estimated(rest, reps, percent), docs, reps, percent), "dedup-more")
    root = connected_components(links.union(more)).withColumnRenamed("node", "rep").join(reps.select("rep", "doc_id"), "rep")
    least = root.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    root = materialize(root.join(least, "component").select("rep", "component", "component_id"), "dedup-components")
    of_class = reps.join(root, "rep", "left").select(F.col("set_key").alias("_set"), F.coalesce("component", "rep").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    held = rows.drop("sketch")
    # wordless rows have no set and would meet in one task; a set that many rows share is looked up apart
    out = hot_join(held.where("set_key is not null"), materialize(of_class, "dedup-of-class"), {"set_key": "_set"})
    out = out.unionByName(held.where("set_key is null"), allowMissingColumns=True)
    return out.select("doc_id", "key", "n_shingles", "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return linked(docs, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = PERCENT) -> DataFrame:
    """Pipeline stage: the first row of each group by id and text, once; rows without id or words stay. The pipeline asks for STAGE_PERCENT."""
    rows = materialize(linked(docs, percent).where("component_id is not null and n_shingles > 0"), "dedup-stage")
    me = F.struct("doc_id", "key")
    first = rows.groupBy("component").agg(F.min(me).alias("first"))
    first = materialize(first.withColumnRenamed("component", "_c"), "dedup-first")
    gone = hot_join(rows, first, {"component": "_c"}).where(me != F.col("first")).select("doc_id", "key")
    left = without(docs, gone)
    # repeats of the first row itself
    again = materialize(rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id__"), F.col("key").alias("__key__")), "dedup-again")
    if not again.limit(1).count():
        return left
    again = small(again)
    row = free_name(left, "__row__")
    left = left.withColumn(row, row_key("doc_id", "text"))
    same = (left["doc_id"] == again["__id__"]) & (left[row] == again["__key__"])
    return left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["doc_id", row])).drop(row)


#: The whole contract from its definition: shingles, all pairs that share one, components.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS s FROM w),
n AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM s),
x AS MATERIALIZED (SELECT r, unnest(s) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.r = a JOIN n v ON v.r = b WHERE 100 * c >= 85 * (u.n + v.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT t.a AS r, min(n.doc_id) AS m FROM t JOIN n ON n.r = t.b GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept FROM n LEFT JOIN c USING (r)
"""
