"""The reads of a recall by scans of whole tables: the reference that lookups are held against."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.graph import both_ways
from mnemospark.operators.recall import _tokens


def keyword_hits(mem: DataFrame, tokens: list[str]) -> DataFrame:
    """(hash, matched, via_alias): query tokens among a memory's keywords, in order and with repeats."""
    found = mem.where(F.arrays_overlap("keywords", _tokens(tokens)))
    return found.select("hash", F.filter(_tokens(tokens), lambda t: F.array_contains("keywords", t)).alias("matched"), F.array_intersect(_tokens(tokens), "alias_only").alias("via_alias"))


def _matching(entities: DataFrame, tokens: list[str]) -> DataFrame:
    exact = F.col("name_lc").isin(tokens)
    parts = F.array_except(F.array_intersect("tokens", _tokens(tokens)), F.array("name_lc"))
    return entities.select("entity_key", "name_lc", exact.alias("is_exact"), parts.alias("parts")).where(F.col("is_exact") | (F.size("parts") > 0))


def entity_hits(entities: DataFrame, mentions: DataFrame, mem: DataFrame, tokens: list[str]) -> DataFrame:
    """(hash, hits, exact, partial): entities of the query that a memory mentions."""
    held = mentions.select("hash", "entity_key").join(_matching(entities, tokens), "entity_key").join(mem.select("hash"), "hash", "left_semi")
    return held.groupBy("hash").agg(F.countDistinct("entity_key").alias("hits"), F.sort_array(F.collect_set(F.when(F.col("is_exact"), F.col("name_lc")))).alias("exact"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("partial"))


def related_hits(entities: DataFrame, mentions: DataFrame, edges: DataFrame, mem: DataFrame, tokens: list[str], least: int = 2) -> DataFrame:
    """(hash, hits): distinct neighbours of the query's entities that a memory mentions, names in the query left out."""
    seeds = _matching(entities, tokens).select(F.col("entity_key").alias("a"))
    near = both_ways(edges).where(F.col("weight") >= max(least, 1)).join(seeds, "a", "left_semi").select(F.col("b").alias("entity_key")).distinct()
    near = near.join(entities.where(~F.col("name_lc").isin(tokens)).select("entity_key"), "entity_key", "left_semi")
    return mentions.select("hash", "entity_key").join(near, "entity_key", "left_semi").join(mem.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.countDistinct("entity_key").alias("hits"))
