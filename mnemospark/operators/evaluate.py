"""Retrieval evaluation: rank of the first expected title, hit rate, MRR, recall, latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a block that are shown whole, and of the start of a longer one.
INLINE_BYTES, PREVIEW_BYTES = 10_000, 2_048


def visible_text(block: Column) -> Column:
    from mnemospark.functions.text import clip_chars

    return F.when(F.octet_length(block) <= INLINE_BYTES, block).otherwise(clip_chars(block, PREVIEW_BYTES))


def titles(block: Column) -> Column:
    """Titles of a context block in order, up to the standing rules."""
    lines = F.split(F.regexp_replace(block, r"(?s)(^|\n)Standing rules.*", ""), "\n")
    held = F.filter(lines, lambda x: x.startswith("- ["))
    return F.transform(held, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^- \[[^\]]*\]", ""), "(?s) — .*$", "")))


def scored_cases(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, hit, rank, recall): a title of results(case_id, title, pos) that holds a text of expected(case_id, item), in any case.

    Titles of a case are few and its expectations fewer, so both meet within their case.
    """
    want = expected.distinct()
    met = results.join(want, "case_id").where(F.lower("title").contains(F.lower("item")))
    got = met.groupBy("case_id").agg(F.min("pos").alias("rank"), F.countDistinct("item").alias("found"))
    out = want.groupBy("case_id").agg(F.count("*").alias("wanted")).join(got, "case_id", "left")
    return out.select("case_id", F.col("rank").isNotNull().alias("hit"), F.coalesce("rank", F.lit(0)).cast("long").alias("rank"), F.round(F.coalesce("found", F.lit(0)) / F.col("wanted"), 6).alias("recall"))


def summary(results: DataFrame) -> DataFrame:
    """Per mode of results(mode, hit, rank, recall, chars, ms): n, hit rate, MRR, mean recall, longest block, and the
    latencies at the places int((n - 1) * share) in order."""
    w = W.partitionBy("mode")
    held = results.withColumns({"_place": F.row_number().over(w.orderBy("ms")) - 1, "_n": F.count("*").over(w)})
    at = lambda share: F.max(F.when(F.col("_place") == F.floor((F.col("_n") - 1) * share), F.col("ms")))
    return held.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"),
        F.round(F.avg("recall"), 6).alias("recall"), F.max("chars").alias("max_chars"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.max("ms").alias("max_ms"))
