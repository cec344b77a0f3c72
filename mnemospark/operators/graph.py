"""Entity graph: co-occurrence, browsing, hubs, neighbourhoods, chains, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.sources.scratch import written


def cooccurrence(mentions: DataFrame, parts: int = 0) -> DataFrame:
    """(k1, k2, weight), k1 < k2: items that mention both keys of mentions(item, key).

    An item's keys are gathered (they are few by construction) and paired in place, so one shuffle by item
    and a pre-aggregated one by pair suffice. Where hardly a pair repeats, counts before the shuffle save nothing and hold
    a task's pairs once more: with `parts` the pairs are dealt to so many tasks and counted there.
    """
    held = mentions.groupBy("item").agg(F.sort_array(F.collect_set("key")).alias("ks")).where(F.size("ks") > 1)
    ones = held.select("ks", F.posexplode("ks").alias("i", "k1"))
    pairs = ones.select("k1", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("k2"))
    pairs = pairs.repartition(parts, "k1", "k2") if parts else pairs
    return pairs.groupBy("k1", "k2").agg(F.count("*").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as a directed table (a, b, weight): two equi-joins instead of one with an OR."""
    return edges.select(F.col("k1").alias("a"), F.col("k2").alias("b"), "weight").union(edges.select(F.col("k2").alias("a"), F.col("k1").alias("b"), "weight"))


def entity_list(entities: DataFrame, mentions: DataFrame, limit: int, project: str = "") -> DataFrame:
    """name, etype, project_key, mentions; most mentioned first. Superseded memories count."""
    n = mentions.groupBy("entity_key").agg(F.count("*").alias("mentions"))
    e = entities.where(F.col("project_key") == project) if project else entities
    out = e.join(n, "entity_key", "left").select("name", "etype", "project_key", F.coalesce("mentions", F.lit(0)).alias("mentions"))
    return out.orderBy(F.desc("mentions"), "name", "project_key").limit(limit)


def entity_nodes(entities: DataFrame, mentions: DataFrame, name: str, limit: int = 20, grams: DataFrame | None = None) -> DataFrame:
    """The entities of that name, or else those that contain it; with grams, the pieces of names that saves keep, those that may are looked up."""
    from .index import containing
    from .recall import pruned, settled

    name = name.lower()
    if grams is not None and name:
        entities = pruned(entities, "entity_key", settled(containing(grams, "name", name), "names"))
    held = settled(entities.where(F.col("name_lc").contains(name)), "nodes")
    exact = held.where(F.col("name_lc") == name)
    return entity_list(held if exact.isEmpty() else exact, mentions, limit)


def entity_relations(entities: DataFrame, edges: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Neighbours of the entities with that name, strongest first."""
    seed = entities.where(F.col("name_lc") == name.lower()).select(F.col("entity_key").alias("a"))
    other = entities.select(F.col("entity_key").alias("b"), F.col("name").alias("neighbour"), "project_key")
    return both_ways(edges).join(seed, "a", "left_semi").join(other, "b").groupBy("neighbour", "project_key").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "neighbour", "project_key").limit(limit)


def entity_memories(entities: DataFrame, mentions: DataFrame, mem: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Memories, not superseded, that mention the entity; latest first."""
    keys = entities.where(F.col("name_lc") == name.lower()).select("entity_key")
    ids = mentions.join(keys, "entity_key", "left_semi").select("hash").distinct()
    out = mem.where("not coalesce(superseded, false)").join(ids, "hash", "left_semi")
    return out.select("id", "title", "kind", "project_key", "last_seen_at").orderBy(F.desc("last_seen_at"), "id").limit(limit)


def recent_names(entities: DataFrame, limit: int, project: str = "") -> DataFrame:
    e = entities.where(F.col("project_key") == project) if project else entities
    return e.groupBy("name").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "name").limit(limit)


def project_stats(mem: DataFrame, entities: DataFrame, sessions: DataFrame) -> DataFrame:
    """project, memories (retired ones too), entities, sessions: tagged rows and one aggregation, no outer joins."""
    tag = lambda df, i: df.select("project_key", *(F.lit(int(k == i)).alias(c) for k, c in enumerate(("memories", "entities", "sessions"))))
    rows = reduce(DataFrame.union, [tag(df, i) for i, df in enumerate((mem, entities, sessions))])
    return rows.groupBy(F.col("project_key").alias("project")).agg(*(F.sum(c).alias(c) for c in ("memories", "entities", "sessions")))


def hubs(mentions: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(key, mentions, degree), by degree: each side aggregated before the join, so nothing fans out."""
    # distinct by item first, where mentions may lie so already: counting by key then holds keys only
    n = mentions.select("item", "key").distinct().groupBy("key").agg(F.count("item").alias("mentions"))
    d = both_ways(edges).groupBy(F.col("a").alias("key")).agg(F.count("*").alias("degree"))
    return n.join(d, "key").orderBy(F.desc("degree"), F.desc("mentions"), "key").limit(limit)


def cross_project(mentions: DataFrame, least: int = 2) -> DataFrame:
    return mentions.groupBy("key").agg(F.countDistinct("project").alias("projects")).where(F.col("projects") >= least)


def histogram(**tables: DataFrame) -> DataFrame:
    """(label, n) of each table."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n") for k, df in tables.items()])


def two_hops(mentions: DataFrame, seed, least: int = 2) -> DataFrame:
    """(key, hops) within two undirected steps of seed, a step being `least` common items of mentions(item, key).

    Each step starts from the items of the keys it has reached, so the pairs of other items are never made. Where one item
    is enough nothing is counted: a task holds the keys it reaches, not their pairs.
    """
    m = mentions.distinct() if least > 1 else mentions

    def near(keys: DataFrame) -> DataFrame:
        held = m.join(keys.select(F.col("key").alias("_a")), F.col("key") == F.col("_a")).select("_a", F.col("item").alias("_i"))
        met = held.join(m, F.col("_i") == F.col("item")).where("key <> _a")
        if least <= 1:
            return met.select("key").distinct()
        pairs = met.groupBy("_a", "key").agg(F.count("*").alias("weight"))
        return pairs.where(F.col("weight") >= least).select("key").distinct()

    one = written(near(m.where(F.col("key") == seed).select("key").distinct()), "one-hop")
    found = one.withColumn("hops", F.lit(1)).union(near(one).withColumn("hops", F.lit(2)))
    return found.where(F.col("key") != seed).groupBy("key").agg(F.min("hops").alias("hops"))


def newest(replacements: DataFrame) -> DataFrame:
    """(id, head, steps) for every older of replacements(newer, older): what stands for it now, so many replacements on.

    Pointers double: each round a row takes over where its head points, so the rounds are the logarithm of the longest
    chain. Of several replacements of one memory the least id counts; one that replaces itself does not. What runs into
    a circle never ends: once pointers reach further than there are edges, the head of what is left is null.
    """
    edges = replacements.where("newer <> older").groupBy(F.col("older").alias("id")).agg(F.min("newer").alias("head"))
    t, n, reach = written(edges.withColumn("steps", F.lit(1).cast("long")), "heads"), None, 1
    while True:
        on = t.select(F.col("id").alias("_id"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        moved = t.join(on, F.col("head") == F.col("_id"), "left")
        moved = written(moved.select("id", F.coalesce("_head", "head").alias("head"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_id").isNotNull().alias("open")), "heads")
        n = moved.count() if n is None else n
        if moved.where("open").isEmpty():
            return moved.drop("open")
        t, reach = moved.drop("open"), 2 * reach
        if reach > 2 * n:
            ends = t.join(edges.select(F.col("id").alias("_id")), F.col("head") == F.col("_id"), "left")
            return ends.select("id", F.when(F.col("_id").isNull(), F.col("head")).alias("head"), F.when(F.col("_id").isNull(), F.col("steps")).alias("steps"))


def chains(mem: DataFrame) -> DataFrame:
    """Supersession: each memory with the one that replaced it, its place and the length of its chain.

    Replacement runs along (project, title, kind) in order of seq, so windows give the closure of the chain.
    """
    from pyspark.sql import Window as W

    by = W.partitionBy("project_key", "title_lc", "kind")
    out = mem.withColumns({"newer": F.lead("id").over(by.orderBy("seq")), "depth": F.row_number().over(by.orderBy(F.desc("seq"))) - 1, "length": F.count("*").over(by)})
    return out.where("length > 1").select("id", "newer", F.col("depth").cast("long").alias("depth"), "length")
