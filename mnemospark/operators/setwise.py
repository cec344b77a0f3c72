"""Recall for a table of prompts at once: the k best memories of each, as single recalls would have found them.

A term's postings and frequencies do not depend on the prompt, so they are read once for all prompts that use it. Which
postings a prompt needs is settled by bounds: its rarest terms give k memories a least score; commonest terms that, all
together and with the most that recency, use and neighbours can add, stay below the k-th of these cannot bring in
another memory. Candidates are the memories of the other terms; they alone are scored in full, from the words each
holds. A memory's postings lie together, so candidates are found, scored and held against the bound where they are;
neighbours are counted for those alone that can still be among the k best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import text as X
from mnemospark.sources.scratch import written

from .index import latest
from .recall import SEPARATED, Index

#: Rows of postings, as a multiple of k, from which on a prompt's rarest terms may set its bound.
ENOUGH = 4
#: Rows and bytes of the prompts' terms up to which they go to all tasks; beyond, the same joins shuffle.
TERMS, TERM_BYTES = 100_000, 4 << 20
#: The most that neighbours add to a match, and a hair's breadth for sums in another order.
NEIGHBOURS, HAIR = 1.0, 1e-6
#: What a memory's score needs besides its match.
FACTS = ("id", "project_key", "last_seen_at", "last_used_at", "seen_count", "used_count", "disputed_count")


def terms_of(prompts: DataFrame) -> DataFrame:
    """(pid, term, r): the distinct words of prompts(pid, tokens) and how often each is there."""
    return prompts.select("pid", F.explode("tokens").alias("term")).groupBy("pid", "term").agg(F.count("*").alias("r"))


def _among(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_semi")


def named(index: Index, terms: DataFrame) -> DataFrame:
    """(term, entity_key, exact): entities whose name is a term, or has it among its words."""
    held = _among(index.names, "token", terms, "term").where("exact or token <> name_lc")
    return held.groupBy(F.col("token").alias("term"), "entity_key").agg(F.max("exact").alias("exact"))


def postings(index: Index, terms: DataFrame, names: DataFrame, mem: DataFrame) -> DataFrame:
    """(hash, facts of mem, own): live memories with the terms each has: (term, w, ent, part), as a word (by an alias: w is a half), as an entity's name, or in one.

    All that is known of a memory moves once, to where the memory is.
    """
    words = _among(index.words, "token", terms, "term")
    words = words.select("hash", F.col("token").alias("term"), F.lit(None).cast("string").alias("key"), "via_alias", F.lit(None).cast("boolean").alias("exact"), "gone", "at")
    said = index.mentioned.join(names, "entity_key")
    said = said.select("hash", "term", F.col("entity_key").alias("key"), F.lit(None).cast("boolean").alias("via_alias"), "exact", "gone", "at")
    held = latest(words.unionByName(said).repartition("hash"), "hash", "term", "key")
    word, entity = F.col("key").isNull(), F.col("key").isNotNull()
    held = held.groupBy("hash", "term").agg(F.max(F.when(word, F.when(F.col("via_alias"), 0.5).otherwise(1.0))).alias("w"),
        F.max((entity & F.col("exact")).cast("int")).alias("ent"), F.max((entity & ~F.col("exact")).cast("int")).alias("part"))
    per = F.struct("term", "w", F.coalesce("ent", F.lit(0)).alias("ent"), F.coalesce("part", F.lit(0)).alias("part"))
    own = held.groupBy("hash").agg(F.collect_list(per).alias("own"))  # a memory's words are few
    return own.join(mem.select("hash", *FACTS), "hash").select("hash", *FACTS, "own")


def weighed(terms: DataFrame, held: DataFrame, corpus: DataFrame) -> DataFrame:
    """terms with what a posting of each is worth, the most and least of it, and `rows`, their postings."""
    n = held.groupBy("term").agg(F.count("w").alias("kw"), F.sum("ent").alias("ent"), F.sum("part").alias("part"), F.count("*").alias("rows"))
    t = terms.join(n, "term").crossJoin(F.broadcast(corpus))  # one row
    total, kw = F.col("n").cast("double"), F.col("r") * F.col("kw")
    of = lambda *df: X.idf(total, F.greatest(*df).cast("double") if len(df) > 1 else df[0].cast("double"))
    t = t.select("pid", "term", "r", "rows", F.col("term").rlike(SEPARATED).alias("multi"), of(kw).alias("i_kw"), (2 * of(F.col("ent"))).alias("i_multi"), of(kw, F.col("part"), F.col("ent")).alias("i_ent"), of(kw, F.col("part")).alias("i_part"))
    some = F.greatest("i_ent", "i_part", F.lit(0.0))
    most = F.greatest(F.col("r") * F.greatest("i_kw", F.lit(0.0)), some) + F.when(F.col("multi"), F.greatest("i_multi", F.lit(0.0))).otherwise(0.0)
    return t.withColumns({"most": most, "least": F.least(F.col("r") * F.col("i_kw"), "i_multi", "i_ent", "i_part", F.lit(0.0))})


def _gain(x: Column, q: Column) -> Column:
    """What a posting x(w, ent, part) adds for a term q."""
    once = F.when((x["ent"] == 1) & ~q["multi"], q["i_ent"]).when(x["part"] == 1, q["i_part"]).otherwise(0.0)
    name = F.when((x["ent"] == 1) & q["multi"], q["i_multi"]).otherwise(0.0)
    return F.when(x["w"].isNull(), once).otherwise(q["r"] * x["w"] * q["i_kw"]) + name


def _extra(now: int, boost: float) -> Column:
    """What a memory's age, use and project add to its match; `project` is the prompt's."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.greatest("last_seen_at", F.coalesce("last_used_at", F.lit(0)))) / 86400.0)
    score = 2 * F.exp(-age / 14) + 0.3 * F.log(1.0 + F.col("seen_count")) + 0.4 * F.log(1.0 + F.col("used_count")) - 1.0 * F.least("disputed_count", F.lit(3))
    return score + F.when((F.col("project_key") == F.col("project")) & (F.col("project") != ""), boost).otherwise(0.0)


def _kth(df: DataFrame, k: int) -> DataFrame:
    """(pid, sure): the k-th greatest of df(pid, sure)."""
    return df.withColumn("place", F.row_number().over(W.partitionBy("pid").orderBy(F.desc("sure")))).where(F.col("place") == k).select("pid", "sure")


def needed(terms: DataFrame, held: DataFrame, mem: DataFrame, prompts: DataFrame, k: int, now: int, min_match: float, boost: float, few=lambda df: df) -> DataFrame:
    """(pid, term, sure): terms without those of each prompt whose postings cannot bring in one of its k best, and the least score of the k-th if it is known.

    held(hash, facts, term, w, ent, part) are postings dealt by hash; `few` marks what is bounded by the prompts.
    """
    rare = W.partitionBy("pid").orderBy("rows", "term")
    after = rare.rowsBetween(1, W.unboundedFollowing)
    t = terms.withColumns({"before": F.coalesce(F.sum("rows").over(rare.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "rest": F.coalesce(F.sum("most").over(after), F.lit(0.0)), "under": F.coalesce(F.sum("least").over(after), F.lit(0.0))})
    t = written(t, "bounds")
    first = t.where(F.col("before") < ENOUGH * k)
    part = held.join(few(first), "term").groupBy("pid", "hash", *FACTS).agg(F.sum(_gain(F.struct("w", "ent", "part"), F.struct("r", "multi", "i_kw", "i_multi", "i_ent", "i_part"))).alias("part"))
    # behind the last of them
    drop = first.groupBy("pid").agg(F.max_by("under", F.struct("rows", "term")).alias("under"))
    least = part.join(few(drop.join(prompts.select("pid", "project"), "pid")), "pid").withColumn("sure", F.col("part") + F.col("under")).where((F.col("sure") > 0) & (F.round("sure", 9) >= min_match))
    kth = _kth(least.select("pid", (F.col("sure") + _extra(now, boost)).alias("sure")), k)
    high = mem.agg((2 + 0.3 * F.log(1.0 + F.coalesce(F.max("seen_count"), F.lit(0))) + 0.4 * F.log(1.0 + F.coalesce(F.max("used_count"), F.lit(0))) + max(boost, 0.0) + NEIGHBOURS).alias("high"))
    out = t.join(kth, "pid", "left").crossJoin(F.broadcast(high)).where(F.col("sure").isNull() | (F.col("most") + F.col("rest") + F.col("high") + HAIR >= F.col("sure")))
    return out.select("pid", "term", "sure")


def best(index: Index, mem: DataFrame, prompts: DataFrame, *, corpus: DataFrame, now: int, k: int, min_match: float = 0.0, boost: float = 1.0, least: int = 2) -> DataFrame:
    """(pid, hash, match, score, rank): the k best memories for each of prompts(pid, tokens, project), equal scores by id.

    Defined cases: prompts without tokens, or whose tokens nothing has, have no rows; a null project is none; a repeated
    pid would be one prompt with the words of both, so pids are to be distinct.
    """
    prompts = written(prompts.select("pid", "tokens", F.coalesce("project", F.lit("")).alias("project")), "prompts")
    words = written(terms_of(prompts), "prompt-terms")
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    few = F.broadcast if size["n"] <= TERMS and size["bytes"] <= TERM_BYTES else lambda df: df
    names = written(named(index, words), "prompt-names")
    known = written(postings(index, words, names, mem), "prompt-postings")
    terms = written(weighed(words, known.select(F.explode("own").alias("x")).select("x.*"), corpus), "prompt-weights")
    # from here on each memory stays where it is
    known = known.repartition("hash")
    held = known.select("hash", *FACTS, F.explode("own").alias("x")).select("hash", *FACTS, "x.*")
    need = written(needed(terms, held, mem, prompts, k, now, min_match, boost, few), "needed")

    value = F.struct("r", "multi", "i_kw", "i_multi", "i_ent", "i_part")
    asked = terms.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("term", value))).alias("asked"))
    asked = asked.join(need.groupBy("pid").agg(F.max("sure").alias("sure")), "pid").join(prompts.select("pid", "project"), "pid")
    gain = F.aggregate("own", F.lit(0.0), lambda a, x: a + F.coalesce(_gain(x, F.col("asked")[x["term"]]), F.lit(0.0)))
    found = known.select("hash", F.explode("own.term").alias("term")).join(few(need.select("pid", "term")), "term").select("hash", "pid").distinct()
    direct = found.join(known, "hash").join(few(asked), "pid").select("pid", "hash", "id", gain.alias("direct"), _extra(now, boost).alias("extra"), "sure").where("direct <> 0")
    direct = written(_reaching(direct).drop("sure"), "candidates")
    sure = direct.where(F.round("direct", 9) >= min_match) if min_match > 0 else direct
    kth = _kth(sure.select("pid", (F.col("direct") + F.col("extra")).alias("sure")), k)
    direct = written(_reaching(direct.join(few(kth), "pid", "left")).drop("sure"), "contenders")

    near = latest(_among(index.near, "a", names, "entity_key"), "a", "b").where(F.col("weight") >= max(least, 1))
    near = near.join(words.join(names, "term").select("pid", F.col("entity_key").alias("a")).distinct(), "a")
    near = near.join(words.select("pid", F.col("term").alias("name_lc")), ["pid", "name_lc"], "left_anti").select("pid", F.col("b").alias("entity_key")).distinct()
    beside = latest(_among(index.mentioned, "hash", direct, "hash"), "entity_key", "hash").join(direct.select("pid", "hash"), "hash")
    beside = beside.join(near, ["pid", "entity_key"], "left_semi").groupBy("pid", "hash").agg(F.countDistinct("entity_key").alias("q3"))

    m = direct.join(beside, ["pid", "hash"], "left").withColumn("match", F.col("direct") + NEIGHBOURS / 4 * F.least(F.coalesce("q3", F.lit(0)), F.lit(4)))
    m = m.where(F.round("match", 9) >= min_match) if min_match > 0 else m
    m = m.select("pid", "hash", "id", F.round("match", 6).alias("match"), F.round(F.col("match") + F.col("extra"), 6).alias("score"))
    return m.withColumn("rank", F.row_number().over(W.partitionBy("pid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("pid", "hash", "match", "score", "rank")


def _reaching(found: DataFrame) -> DataFrame:
    """found(direct, extra, sure) that may yet come up to the least score of their prompt's k-th."""
    return found.where(F.col("sure").isNull() | (F.col("direct") + F.col("extra") + NEIGHBOURS + HAIR >= F.col("sure")))


#: Words below which a prompt is weak, and context words that are added to it.
WEAK, CONTEXT = 3, 16


def with_context(run, prompts: DataFrame, most: int = 32) -> DataFrame:
    """run(prompts(pid, tokens, project)) for prompts(pid, text, context, project): words of the context come with a weak prompt at once, with another only if it finds nothing.

    A second run that finds nothing either leaves the first one's result, so `ctx`, the number of context words, is 0 there.
    """
    p = prompts.select("pid", F.coalesce("project", F.lit("")).alias("project"), X.tokenize(F.coalesce("text", F.lit("")), most).alias("own"), X.tokenize(F.coalesce("context", F.lit("")), CONTEXT).alias("more"))
    p = written(p.withColumn("weak", F.size("own") < WEAK), "asked")
    tokens = F.when(F.col("weak"), F.concat("own", "more")).otherwise(F.col("own"))
    first = written(run(p.select("pid", tokens.alias("tokens"), "project")).join(p.select("pid", F.when(F.col("weak"), F.size("more")).otherwise(0).alias("ctx")), "pid"), "first-run")
    missed = p.where("not weak and size(more) > 0").join(first.select("pid").distinct(), "pid", "left_anti")
    second = run(missed.select("pid", F.concat("own", "more").alias("tokens"), "project")).join(missed.select("pid", F.size("more").alias("ctx")), "pid")
    return first.unionByName(second)
