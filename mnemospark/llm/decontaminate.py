"""Benchmark decontamination by a positional inverted index of training tokens.

Windows of ten consecutive words are cut from every benchmark item. The corpus frequency of each test term
is counted, and each window is looked up from its rarest terms: the postings (term, row, position) of the two
rarest are taken from all whole documents and stored, and their lists, shifted by the terms' offsets, are
intersected on (row, start). What is left is intersected with the postings of all the window's other terms,
which are needed of the rows with candidates only; a start that all lists hold is an exact match. Proximity
matches relax the offsets of the two rarest terms to a distance.

Everything is DataFrame functions. A token travels as (term, row, position), never with its document. Test
terms are broadcast only while their number is below common.BROADCAST_ROWS; beyond it the same joins shuffle.

Defined cases: null text or item has no words; an item of fewer than ten words is one window; an item
without words is ignored; null ids are kept (null items are ignored); repeated documents and items are each
judged; windows shared by items hit all of them; of equally rare terms the first counts; very long texts take
part whole; other columns are not looked at, whatever their names; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, row_key, small, table, without

#: Words of a window, and words apart at which its two rarest terms still are a proximity match.
N, DISTANCE = 10, 10
#: Letters, digits and everything beyond ASCII, after lower-casing.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, phrase array, len) for each distinct window of items(item_id, text)."""
    held = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    return held.select("item_id", "w", at.alias("i")).select("item_id", F.slice("w", F.col("i"), n).alias("phrase")).distinct().withColumn("len", F.size("phrase"))


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, w, n_words), written: the training tokens in order, read by all that follows. Text is cut once."""
    held = docs.select("doc_id", row_key("doc_id", "text").alias("key"), words(F.col("text")).alias("w"))
    return materialize(held.withColumn("n_words", F.size("w").cast("long")), "decon-tokens")


def term_frequency(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq) over all tokens(w) for terms(term)."""
    held = tokens.select(F.explode("w").alias("term")).join(small(terms), "term")
    return held.groupBy("term").agg(F.count("*").alias("freq"))


def anchored(phrases: DataFrame, freq: DataFrame) -> DataFrame:
    """phrases(pid, phrase, len) with their two rarest terms t1, t2 and the offsets o1, o2 (the same for one word)."""
    ranked = phrases.select("pid", "phrase", "len", F.posexplode("phrase").alias("o", "term")).join(freq, "term", "left")
    by = F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "o", "term")))
    held = ranked.groupBy("pid", "phrase", "len").agg(by.alias("r"))
    last = F.least(F.size("r"), F.lit(2)) - 1
    return held.select("pid", "phrase", "len", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["o"].alias("o1"), F.col("r")[last]["term"].alias("t2"), F.col("r")[last]["o"].alias("o2"))


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, key, pos) of terms(term): the index of the training tokens; equal rows share theirs."""
    return tokens.select("doc_id", "key", F.posexplode("w").alias("pos", "term")).join(small(terms.select("term")), "term").select("term", "doc_id", "key", "pos")


def _at(index: DataFrame) -> DataFrame:
    return index.select(F.col("term").alias("_t"), F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("pos").alias("_p"))


_SAME_ROW = "key = _k and doc_id <=> _d"


def exact_matches(tokens: DataFrame, index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, key, start, len, pid) for every occurrence of phrases(pid, phrase, len, t1, o1, t2, o2)."""
    looked = phrases.select("pid", "len", "t1", "o1", "t2", "o2")
    first = index.join(small(looked), F.col("term") == F.col("t1")).withColumn("start", F.col("pos") - F.col("o1")).where("start >= 0")
    # the posting list of the second term, shifted, must hold the same start
    both = first.join(_at(index), (F.col("t2") == F.col("_t")) & F.expr(_SAME_ROW) & (F.col("start") + F.col("o2") == F.col("_p")), "left_semi")
    both = materialize(both.select("doc_id", "key", "start", "len", "pid").distinct(), "decon-candidates")
    # and those of all its terms, taken from the rows that are left
    rows = materialize(both.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct(), "decon-rows")
    lists = tokens.join(small(rows), F.expr(_SAME_ROW), "left_semi").select("doc_id", "key", F.posexplode("w").alias("pos", "term"))
    terms = phrases.select(F.col("pid").alias("_pid"), F.posexplode("phrase").alias("o", "want"))
    asked = both.join(small(terms), F.col("pid") == F.col("_pid")).drop("_pid")
    met = asked.join(_at(lists), (F.col("want") == F.col("_t")) & F.expr(_SAME_ROW) & (F.col("start") + F.col("o") == F.col("_p")), "left_semi")
    return met.groupBy("doc_id", "key", "start", "len", "pid").agg(F.count("*").alias("n")).where("n = len").drop("n")


def proximity_matches(index: DataFrame, phrases: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, key, pid, gap): the two rarest terms of a phrase at most `distance` words apart, least gap; in any order."""
    looked = phrases.select("pid", "t1", "t2", (F.col("o1") == F.col("o2")).alias("single"))
    one = index.join(small(looked), F.col("term") == F.col("t1")).select("doc_id", "key", "pid", "t2", "single", "pos", F.floor(F.col("pos") / distance).alias("bin"))
    # bins of the allowed distance and their neighbours: an equi-join, not a range scan
    one = one.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    two = _at(index).withColumn("_b", F.floor(F.col("_p") / distance))
    met = one.join(two, (F.col("t2") == F.col("_t")) & F.expr(_SAME_ROW) & (F.col("bin") == F.col("_b"))).withColumn("gap", F.abs(F.col("pos") - F.col("_p")))
    return met.where((F.col("gap") <= distance) & (F.col("single") | (F.col("gap") > 0))).groupBy("doc_id", "key", "pid").agg(F.min("gap").alias("gap"))


def corpus_index(tokens: DataFrame, items: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows (item_id, pid), the distinct phrases with their anchors, and the stored postings of a token table."""
    cut = materialize(windows(items, n), "decon-windows")
    phrases = materialize(cut.select("phrase", "len").distinct().withColumn("pid", F.monotonically_increasing_id()), "decon-phrases")
    terms = materialize(phrases.select(F.explode("phrase").alias("term")).distinct(), "decon-terms")
    freq = materialize(term_frequency(tokens, terms), "decon-frequency")
    of_item = materialize(cut.join(phrases.select("phrase", "pid"), "phrase").select("item_id", "pid"), "decon-items")
    phrases = materialize(anchored(phrases, freq), "decon-anchors")
    anchors = materialize(phrases.select(F.explode(F.array("t1", "t2")).alias("term")).distinct(), "decon-lookup")
    return of_item, phrases, materialize(postings(tokens, anchors), "decon-postings")


def _items(found: DataFrame, of_item: DataFrame) -> DataFrame:
    """(doc_id, key, item) of found(doc_id, key, pid)."""
    return found.select("doc_id", "key", "pid").distinct().join(small(of_item), "pid").select("doc_id", "key", F.col("item_id").cast("string").alias("item")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, and the row's key.

    n_near_items: items with a proximity match, exact ones included.
    """
    tokens = token_table(docs)
    of_item, phrases, index = corpus_index(tokens, items)
    hits = materialize(exact_matches(tokens, index, phrases), "decon-hits")
    # words covered by the union of the occurrences: each adds what lies beyond the farthest end before it
    spans = hits.groupBy("doc_id", "key", "start").agg(F.max("len").alias("len")).withColumn("end", F.col("start") + F.col("len"))
    before = Window.partitionBy("key", "doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    zero = F.lit(0).cast("long")
    covered = spans.groupBy("doc_id", "key").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    exact = _items(hits, of_item).groupBy("doc_id", "key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    near = _items(proximity_matches(index, phrases), of_item).groupBy("doc_id", "key").agg(F.count("*").alias("n_near_items"))
    parts = [covered, exact, near]
    names = ["n_hit", "n_items", "items_sha256", "n_near_items"]
    # a row per document with any match: tagged rows and one aggregation
    tagged = [p.select("doc_id", "key", *(c if c in p.columns else F.lit(None).cast("string" if c == "items_sha256" else "long").alias(c) for c in names)) for p in parts]
    found = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(*(F.max(c).alias(c) for c in names))
    found = materialize(found, "decon-found")
    out = tokens.select("doc_id", "key", "n_words").join(small(found), F.expr(_SAME_ROW), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("n_near_items", zero).alias("n_near_items"), "key")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark window."""
    tokens = token_table(docs)
    _, phrases, index = corpus_index(tokens, table(spark, sf_dir, "benchmark"))
    return without(docs, exact_matches(tokens, index, phrases).select("doc_id", "key"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The contract from its definition, and the proximity matches.
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
cut AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
phrase AS MATERIALIZED (SELECT DISTINCT phrase, n FROM cut),
size AS MATERIALIZED (SELECT DISTINCT n FROM phrase),
win AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase, unnest(range(1, len(w) - n + 2)) AS pos FROM d, size WHERE len(w) >= n),
hit AS MATERIALIZED (SELECT r, pos, n, phrase FROM win JOIN phrase USING (n, phrase)),
tok AS MATERIALIZED (SELECT r, term, pos FROM (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d) SEMI JOIN (SELECT DISTINCT unnest(string_split(phrase, ' ')) AS term FROM phrase) USING (term)),
words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS place FROM hit) GROUP BY 1),
exact AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit JOIN cut USING (phrase)) GROUP BY 1),
freq AS (SELECT term, count(*) AS f FROM tok GROUP BY 1),
ranked AS (SELECT phrase, term, o, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(f, 0), o) AS k, n FROM (SELECT phrase, n, unnest(string_split(phrase, ' ')) AS term, unnest(range(0, n)) AS o FROM phrase) LEFT JOIN freq USING (term)),
pair AS MATERIALIZED (SELECT phrase, max(term) FILTER (k = 1) AS t1, max(term) FILTER (k = least(2, n)) AS t2, max(o) FILTER (k = 1) = max(o) FILTER (k = least(2, n)) AS single FROM ranked GROUP BY phrase, n),
terms AS MATERIALIZED (SELECT DISTINCT t1, t2, single FROM pair),
x AS (SELECT r, pos, t1, t2, single, unnest([pos // 10 - 1, pos // 10, pos // 10 + 1]) AS bin FROM tok JOIN terms ON term = t1),
met AS (SELECT DISTINCT x.r, t1, t2, single FROM x JOIN tok y ON y.r = x.r AND y.term = t2 AND y.pos // 10 = bin WHERE abs(x.pos - y.pos) <= 10 AND (single OR x.pos <> y.pos)),
near AS (SELECT r, count(DISTINCT item_id) AS n_near_items FROM met JOIN pair USING (t1, t2, single) JOIN cut USING (phrase) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN words USING (r) LEFT JOIN exact USING (r) LEFT JOIN near USING (r)
"""
