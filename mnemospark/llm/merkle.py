"""WARC fixity: Merkle trees over records and ordered ranges, compared from the root down.

A record's digest is SHA-256 over its length-framed fields. Leaves are record ids in order; a leaf with
several records adds their digests up (four 60-bit slices), so a repeated id needs no gathered group.
A node covers FANOUT neighbouring nodes below it and holds the digest of theirs with their record counts and
bytes, so that the digest of a range fixes the offsets in it. Two replicas are compared at the root; of each
level only the range between the first and the last child of a differing node is read (levels are stored in
order), and only children of differing nodes are compared. The byte offset of a faulty record is the sum of
its preceding siblings on the way down.

Defined cases: records without an id are a leaf of their own, before all others and apart from any id; null
fields differ from empty ones; a record on one side only is missing or extra; trees of different height are
compared from a common one; very long fields are digested whole; other columns are not looked at, whatever their
names; equal replicas and empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, table

FANOUT = 16


def record_digest(*fields: Column) -> Column:
    """SHA-256 over the fields, each with its byte length before it (-1 for null)."""
    framed = [F.concat(F.coalesce(F.octet_length(f), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(f, F.lit(""))) for f in fields]
    return F.sha2(F.concat(*framed), 256)


#: The key of a node: whether its records have an id, and its place.
KEY = ("known", "idx")


def _parent() -> Column:
    return F.floor(F.col("idx") / FANOUT).cast("long")


def leaves(records: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(known, idx, digest, n, bytes) of the leaf of each id."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(f), F.lit(0)) for f in fields]).cast("long")
    known = F.col(key).isNotNull().cast("int")
    held = records.select(known.alias("known"), F.coalesce(F.col(key), F.lit(0)).cast("long").alias("idx"), record_digest(*(F.col(f) for f in fields)).alias("d"), size.alias("size"))
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    sums = held.groupBy(*KEY).agg(*(part(i).alias(f"p{i}") for i in range(4)), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return sums.select(*KEY, F.sha2(F.concat_ws(":", "n", *(f"p{i}" for i in range(4))), 256).alias("digest"), "n", "bytes")


def _stored(level: DataFrame, k: int) -> DataFrame:
    """A level in order of its nodes, so that a range of it is read alone."""
    return materialize(level.repartitionByRange(*KEY).sortWithinPartitions(*KEY), f"merkle-{k}")


def tree(records: DataFrame, key: str, fields: tuple[str, ...], height: int | None = None) -> list[DataFrame]:
    """The levels of the tree, leaves first, written; all the way to one node, or up to a given height."""
    level = _stored(leaves(records, key, fields), 0)
    levels, span = [level], level.agg(F.max("idx"), F.min("idx")).first()
    reach = max(span[0] or 0, -(span[1] or 0), 0)
    while len(levels) <= height if height is not None else reach > 0 or len(levels) < 2:
        reach //= FANOUT
        children = F.sort_array(F.collect_list(F.struct("idx", "digest", "n", "bytes")))  # FANOUT of them at most
        up = level.groupBy("known", _parent().alias("parent")).agg(children.alias("c"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        text = F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x["idx"].cast("string"), x["digest"], x["n"].cast("string"), x["bytes"].cast("string"))))
        level = _stored(up.select("known", F.col("parent").alias("idx"), F.sha2(text, 256).alias("digest"), "n", "bytes"), len(levels))
        levels.append(level)
    return levels


def audit(a: DataFrame, b: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(idx, fault, offset, length): the leaves of a and b that differ, with their place among a's bytes; idx null for records without id.

    fault: changed, missing (from b) or extra (in b).
    """
    one, two = tree(a, key, fields), tree(b, key, fields)
    if len(one) != len(two):
        height = max(len(one), len(two)) - 1
        one, two = (x if len(x) == height + 1 else tree(y, key, fields, height) for x, y in ((one, a), (two, b)))
    top = len(one) - 1
    open_nodes = None  # all nodes of the top level: a root, one for ids below zero, one for records without id
    for level in range(top, -1, -1):
        x, y = one[level], two[level]
        if open_nodes is None:
            top_level = {"_k": F.lit(0), "_p": F.lit(0).cast("long"), "_o": F.lit(0).cast("long")}
            x, y = x.withColumns(top_level), y.withColumns(top_level)
        else:
            first, last, n = open_nodes.agg(F.min("idx"), F.max("idx"), F.count("*")).first()
            if not n:
                break
            held = small(open_nodes.select(F.col("known").alias("_k"), F.col("idx").alias("_p"), F.col("offset").alias("_o")))
            below = F.col("idx").between(first * FANOUT, last * FANOUT + FANOUT - 1)
            x, y = (z.where(below).join(held, (F.col("known") == F.col("_k")) & (_parent() == F.col("_p"))) for z in (x, y))
        x = x.select(*KEY, "_k", "_p", "_o", "digest", "bytes")
        y = y.select(*(F.col(c).alias(f"{c}2") for c in (*KEY, "_k", "_p", "_o", "digest")))
        both = [F.coalesce(c, f"{c}2").alias(c) for c in (*KEY, "_k", "_p", "_o")]
        met = x.join(y, (x["known"] == y["known2"]) & (x["idx"] == y["idx2"]), "full").select(*both, "digest", "digest2", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
        # bytes of the siblings before: FANOUT of them at most
        siblings = met.groupBy("_k", "_p").agg(F.collect_list(F.struct(*KEY, "bytes")).alias("s")).withColumnsRenamed({"_k": "_j", "_p": "_q"})
        met = met.where(~F.col("digest").eqNullSafe(F.col("digest2"))).join(siblings, (F.col("_k") == F.col("_j")) & (F.col("_p") == F.col("_q")))
        before = F.aggregate(F.filter("s", lambda v: F.struct(v["known"], v["idx"]) < F.struct(*KEY)), F.lit(0).cast("long"), lambda t, v: t + v["bytes"])
        open_nodes = materialize(met.select(*KEY, (F.col("_o") + before).alias("offset"), "bytes", "digest", "digest2"), f"merkle-open-{level}")
    fault = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return open_nodes.select(F.when(F.col("known") == 1, F.col("idx")).alias("idx"), fault.alias("fault"), "offset", F.col("bytes").alias("length"))


def damaged(pages: DataFrame) -> DataFrame:
    """The second replica of the query: pages with some records lost and some with a byte more."""
    i = F.col("page_id")
    return pages.where(i % 101 != 7).withColumn("html", F.when(i % 53 == 11, F.concat("html", F.lit("!"))).otherwise(F.col("html")))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages), "page_id", ("url", "html")).withColumnRenamed("idx", "page_id")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(url)) + octet_length(encode(html)) AS length FROM pages),
o AS (SELECT page_id, length, sum(length) OVER (ORDER BY page_id) - length AS "offset" FROM p)
SELECT page_id, CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS fault,
  CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length
FROM o WHERE page_id % 101 = 7 OR page_id % 53 = 11
"""
