"""Filter interaction audit: what each filter removes after every set of others, along every order.

A filter's effect depends only on which filters have been applied before it, not on their order. So the five
filters' 120 orders are paths in the lattice of their subsets, and its 80 edges (subset applied, next filter)
hold all there is to count. Steps:

1. A row's own failures (A to D) come from its text; E needs the least doc_id of each text, kept by its SHA-256.
2. Rows become classes of (part, failures, labels), at most 128 a part, before anything is expanded.
3. Each class contributes its count to the 80 edges.
4. The 600 (order, step) of all paths join the edges they cross. An edge lies on |S|! (4 - |S|)! paths, which
   gives a filter's Shapley sum without walking them.

Defined cases: a null text is an empty one, a null source the part ''; an empty text fails A only, or E too if a
smaller id has none (0 distinct of 0 words is not under half, 0 capitals of 0 characters not over 2 %). Rows of one
id and equal texts do not make each other fail E; a null id is smaller than none and has no smaller one, so it never
fails E, and has no labels. Of several label rows of one id any 1 counts; labels without a row, or null, count as 0.
Columns beyond doc_id, text and source are not looked at. An empty table has no parts and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table

FILTERS = "ABCDE"
MIN_WORDS = 200
SPACE = r"[\x20\x09-\x0D]+"


def tallies(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, fails, n): rows counted by id, text and source; bit i of fails is the i-th filter's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    held = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"), words.alias("w"))
    size = F.size("w")
    fails = [
        size < MIN_WORDS,
        100 * F.size(F.array_distinct("w")) < 50 * size,
        100 * F.regexp_count("t", F.lit("[A-Z]")) > 2 * F.length("t"),
        F.col("t").rlike(r"[#$%&*|]"),
    ]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    held = held.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("text_key"), mask.alias("fails"))
    return held.groupBy("doc_id", "part", "text_key", "fails").agg(F.count("*").alias("n"))


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): all five failures, rows counted by them and by their labels."""
    rows = materialize(tallies(docs), "audit-tallies")
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(one("quality"), one("toxic"))
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    # a null id has no labels, and all null ids would meet in one task
    marked = rows.where("doc_id is not null").join(known, F.col("doc_id") == F.col("_id"), "left").select(*rows.columns, of("quality").alias("good"), of("toxic").alias("toxic"))
    marked = marked.union(rows.where("doc_id is null").select(*rows.columns, F.lit(0), F.lit(0)))
    # all rows of one text meet, but as sums: a hot text has a row a part and label
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    by_text = marked.groupBy("text_key", "fails", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"), first)
    by_text = materialize(by_text, "audit-texts")
    least = by_text.groupBy(F.col("text_key").alias("_key")).agg(F.min("first.doc_id").alias("least"))
    held = by_text.join(least, F.col("text_key") == F.col("_key"))
    # those that are first of their text, or have no id, pass E
    pass_e = F.col("without") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("fails").alias("f"), pass_e.alias("n")), F.struct((F.col("fails") + 16).alias("f"), (F.col("n") - pass_e).alias("n")))
    held = held.select("part", "good", "toxic", F.explode(both).alias("x"))
    return held.groupBy("part", F.col("x.f").alias("fails"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def _bit(letter):
    return F.element_at(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.position(letter, F.lit(FILTERS)))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, filter): the steps of all orders, 600 of them, as edges of the lattice."""
    letters = F.array(*map(F.lit, FILTERS))
    paths = spark.range(1).select(F.lit("").alias("filter_order"))
    for _ in FILTERS:
        free = F.filter(letters, lambda x: ~F.contains(F.col("filter_order"), x))
        paths = paths.select(F.explode(free).alias("x"), "filter_order").select(F.concat("filter_order", "x").alias("filter_order"))
    walked = paths.select("filter_order", F.posexplode(F.split("filter_order", "")).alias("i", "x"))
    before = F.split(F.left("filter_order", F.col("i")), "")
    applied = F.aggregate(F.filter(before, lambda x: x != ""), F.lit(0), lambda a, x: a + _bit(x))
    return walked.select("filter_order", (F.col("i") + 1).alias("step"), applied.alias("applied"), _bit(F.col("x")).alias("filter"))


def edges(held: DataFrame) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of classes; 80 rows a part."""
    all_edges = [(s, 1 << f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]
    fan = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in all_edges))).alias("e")
    x = held.select("*", fan).select("part", "fails", "good", "toxic", "n", "e.*")
    gone, failing = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(F.col("filter")) != 0
    n = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    counted = x.groupBy("part", "applied", "filter").agg(
        n(~gone & ~failing)("kept"), n(~gone & failing)("removed"), n(gone & failing)("redundant"), n(F.col("fails") == F.col("filter"))("unique_fails"),
        n(~gone & failing & (F.col("good") == 1))("good_lost"), n(~gone & failing & (F.col("toxic") == 1))("toxic_lost"))
    size = F.bit_count("applied")
    paths = F.factorial(size) * F.factorial(len(FILTERS) - 1 - size)
    return counted.withColumn("shapley", F.sum(F.col("removed") * paths).over(W.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step keeps and removes, for all 120 orders; a row for each, zeros included."""
    e = edges(classes(docs, labels))
    walked = e.join(F.broadcast(steps(docs.sparkSession)), ["applied", "filter"])  # 600 rows, whatever the data
    return walked.select("part", "filter_order", F.col("step").cast("int").alias("step"), *(F.col(c).cast("long").alias(c) for c in e.columns[3:]))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: From the definition: every order is walked, step by step, over rows counted by their failures.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
  CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
y AS (SELECT part, o, step, o[step] AS x, n, good, toxic, fails, contains(fails, o[step]) AS failing, len(list_filter(string_split(o[:step - 1], ''), lambda p: p <> '' AND contains(fails, p))) > 0 AS gone FROM c CROSS JOIN s),
r AS (SELECT part, o AS filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (NOT gone AND failing AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic = 1), 0)::BIGINT AS toxic_lost FROM y GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""
