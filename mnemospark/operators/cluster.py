"""Near-duplicate clusters of memories: blocks by entity, Jaccard, components; merges and canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions.text import clean_aliases, jaccard
from mnemospark.sources.scratch import written


def pairs(mem: DataFrame, mentions: DataFrame, least: float = 0.4, max_group: int = 30) -> DataFrame:
    """(a, b, jaccard), a < b: memories that share an entity of 2..max_group memories and enough keywords.

    The members of an entity are gathered with their keywords, max_group at most, and compared in place: what moves grows
    with the mentions, not with the pairs that meet.
    """
    size = mentions.groupBy("entity_key").agg(F.countDistinct("hash").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= max_group))
    held = mentions.select("entity_key", "hash").distinct().join(size.select("entity_key"), "entity_key", "left_semi")
    blocks = held.join(mem.select("hash", "keywords"), "hash").groupBy("entity_key").agg(F.sort_array(F.collect_list(F.struct("hash", "keywords"))).alias("m"))
    one = lambda x, y: F.struct(x["hash"].alias("a"), y["hash"].alias("b"), jaccard(x["keywords"], y["keywords"]).alias("jaccard"))
    # alike pairs only, so that no list of all pairs is held for long
    near = lambda x, i: F.filter(F.transform(F.slice("m", i + 2, F.size("m")), lambda y: one(x, y)), lambda p: p["jaccard"] >= least)
    met = blocks.select(F.explode(F.flatten(F.transform("m", near))).alias("p"))
    # a pair has the same value in each entity
    return met.select("p.*").where("a < b").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    return written(df, "step")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): the least node reachable, by repeated minimum over neighbours with pointer jumps."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    for _ in range(rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        now = label.join(near, label["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = now.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        now = checkpoint(now.join(jump, now["label"] == jump["_n"]).select("node", F.least("label", "_l").alias("label"), "old"))
        if not now.where("label <> old").limit(1).count():
            return now.select("node", "label")
        label = now.select("node", "label")
    raise RuntimeError("clusters did not settle")


def clusters(mem: DataFrame, mentions: DataFrame, least: float = 0.4, max_group: int = 30, max_size: int = 8) -> DataFrame:
    """(label, hash, size) for components of 2..max_size memories."""
    found = components(pairs(mem, mentions, least, max_group))
    sizes = found.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") <= max_size)
    return found.join(sizes, "label").select("label", F.col("node").alias("hash"), "size")


def majority_project(members: DataFrame) -> DataFrame:
    """(label, project): the project of most members; of equals, the one that reaches the count first in order of seq."""
    n = members.groupBy("label", "project_key").agg(F.count("*").alias("n"), F.max("seq").alias("at"))
    return n.groupBy("label").agg(F.min_by("project_key", F.struct(-F.col("n"), F.col("at"))).alias("project"))


def united(members: DataFrame, column: str, cap: int = 10) -> DataFrame:
    """(label, values): the members' lists joined in order of seq, without repeats, at most cap."""
    lists = F.transform(F.sort_array(F.collect_list(F.struct("seq", column))), lambda x: x[column])
    return members.groupBy("label").agg(F.slice(F.array_distinct(F.flatten(lists)), 1, cap).alias("values"))


def valid_merges(merges: DataFrame, members: DataFrame, max_bytes: int = 1500) -> DataFrame:
    """Merges(label, merge_no, ids, kind, content) whose ids are at least two distinct members, used once, kind among theirs."""
    one = merges.select("label", "merge_no", "kind", "content", F.explode(F.array_distinct("ids")).alias("id"))
    known = one.join(members.select("label", "id", F.col("kind").alias("member_kind")), ["label", "id"])
    first = known.withColumn("turn", F.row_number().over(W.partitionBy("label", "id").orderBy("merge_no"))).where("turn = 1")
    held = first.groupBy("label", "merge_no").agg(F.collect_set("id").alias("ids"), F.first("kind").alias("kind"), F.first("content").alias("content"), F.bool_or(F.col("kind") == F.col("member_kind")).alias("fits"))
    asked = merges.select("label", "merge_no", F.size(F.array_distinct("ids")).alias("n"))
    out = held.join(asked, ["label", "merge_no"]).where((F.size("ids") == F.col("n")) & (F.col("n") >= 2) & F.col("fits") & (F.octet_length("content") <= max_bytes))
    return out.select("label", "merge_no", F.sort_array("ids").alias("ids"), "kind", "content")


def canonical(merges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The memory that each merge makes, as a batch to save, and its members (label, merge_no, id).

    It has the merge's title, kind and content, most members' project, and their entities and aliases in the order of the
    merge's ids, ten at most. members(label, id, project_key, aliases, entities); a cluster, so a merge, has few members.
    """
    by = ["label", "merge_no"]
    one = merges.select(*by, F.posexplode("ids").alias("seq", "id")).groupBy(*by, "id").agg(F.min("seq").alias("seq"))
    held = one.join(members.select("label", "id", "project_key", "aliases", F.col("entities").alias("names")), ["label", "id"])
    held = held.withColumns({"label": F.struct(*by), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})
    aliases = united(held, "aliases", 1 << 20).select("label", clean_aliases(F.col("values")).alias("aliases"))
    names = united(held, "names").select("label", F.transform("values", lambda n: F.struct(n.alias("name"), F.lit("topic").alias("type"))).alias("entities"))
    made = majority_project(held).join(aliases, "label").join(names, "label").select("label.*", F.col("project").alias("project_key"), "aliases", "entities")
    rows = merges.select(*by, "title", "kind", "content").join(made, by)
    # merges are few: one for several memories of a cluster
    rows = rows.withColumn("seq", F.row_number().over(W.orderBy(*by)).cast("long"))
    return rows, held.select("label.*", "id")
