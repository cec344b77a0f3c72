"""Ranked recall: candidates, idf scoring, floors, paging, rules, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions.text import ellipsis, idf, is_under, relative_age
from mnemospark.sources.scratch import written

from .index import latest

#: What stands between the words of a compound term.
SEPARATED = r"[ _./-]"


def _tokens(tokens: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in tokens)) if tokens else F.array().cast("array<string>")


#: Keys up to which a lookup is a filter that the scan can use; beyond, a join.
FEW = 1000


def settled(df: DataFrame, name: str) -> DataFrame:
    """df computed once: up to FEW rows come to the driver and are a local table, more are written."""
    rows = df.limit(FEW + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= FEW else written(df, name)


def pruned(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose column is among keys(one column), a written or local table."""
    found = [r[0] for r in keys.limit(FEW + 1).collect()]
    if len(found) <= FEW:
        return df.where(F.col(column).isin(found)) if found else df.where(F.lit(False))
    return df.join(keys.toDF(column).distinct(), column, "left_semi")


class Index:
    """What a query looks up, in the tables that saves keep (operators.index); only what it asks for is read and resolved."""

    def __init__(self, words: DataFrame, names: DataFrame, mentioned: DataFrame, near: DataFrame):
        self.words, self.names, self.mentioned, self.near = words, names, mentioned, near
        self._seeds: dict[tuple[str, ...], DataFrame] = {}

    def keyword_hits(self, tokens: list[str]) -> DataFrame:
        """(hash, matched, via_alias): query tokens among a live memory's keywords, in order and with repeats."""
        held = self.words.where(F.col("token").isin(list(dict.fromkeys(tokens)))).groupBy("hash")
        # a row a token and segment
        held = held.agg(F.collect_list(F.struct("at", "token", "gone", "via_alias")).alias("x"))
        last = lambda t: F.array_max(F.filter("x", lambda x: x["token"] == t))
        found = held.select("hash", F.filter(_tokens(tokens), lambda t: F.coalesce(~last(t)["gone"], F.lit(False))).alias("matched"), "x").where(F.size("matched") > 0)
        return found.select("hash", "matched", F.array_distinct(F.filter("matched", lambda t: last(t)["via_alias"])).alias("via_alias"))

    def matching(self, tokens: list[str]) -> DataFrame:
        """(entity_key, name_lc, is_exact, parts): entities whose name is a token, or holds some."""
        held = self.names.where(F.col("token").isin(list(dict.fromkeys(tokens)))).groupBy("entity_key", "name_lc")
        held = held.agg(F.max("exact").alias("is_exact"), F.collect_set(F.when(~F.col("exact") & (F.col("token") != F.col("name_lc")), F.col("token"))).alias("parts"))
        return held.where(F.col("is_exact") | (F.size("parts") > 0))

    def seeds(self, tokens: list[str]) -> DataFrame:
        """What matches, looked up once for all that follows from it."""
        key = tuple(tokens)
        if key not in self._seeds:
            self._seeds[key] = settled(self.matching(tokens), "seeds")
        return self._seeds[key]

    def mentions(self, keys: DataFrame) -> DataFrame:
        return latest(pruned(self.mentioned, "entity_key", keys), "entity_key", "hash")

    def entity_hits(self, tokens: list[str]) -> DataFrame:
        """(hash, hits, exact, partial): entities of the query that a live memory mentions."""
        seeds = self.seeds(tokens)
        held = self.mentions(seeds.select("entity_key")).join(seeds, "entity_key")
        return held.groupBy("hash").agg(F.countDistinct("entity_key").alias("hits"), F.sort_array(F.collect_set(F.when(F.col("is_exact"), F.col("name_lc")))).alias("exact"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("partial"))

    def related_hits(self, tokens: list[str], least: int = 2) -> DataFrame:
        """(hash, hits): distinct neighbours of the query's entities that a live memory mentions, names in the query left out."""
        near = latest(pruned(self.near, "a", self.seeds(tokens).select("entity_key")), "a", "b")
        near = near.where((F.col("weight") >= max(least, 1)) & ~F.col("name_lc").isin(tokens))
        return self.mentions(settled(near.select(F.col("b").alias("entity_key")).distinct(), "near")).groupBy("hash").agg(F.countDistinct("entity_key").alias("hits"))


def document_frequency(q1: DataFrame) -> DataFrame:
    return q1.select(F.explode("matched").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def merge_and_score(mem: DataFrame, q1: DataFrame, q2: DataFrame, q3: DataFrame, *, corpus: DataFrame, now: int, project: str = "", min_match: float = 0.0, boost: float = 1.0) -> DataFrame:
    """Scored memories: id, hash, match, score and parts of it. corpus(n) is a one-row table.

    Terms of the three reads become rows (hash, term, kind); document frequencies are counted on them before any
    floor, exclusion or cap. Frequencies belong to query terms, so that side stays tiny. Of mem, stored in order of hash,
    the rows that matched are read.
    """
    kw = q1.select("hash", F.explode("matched").alias("term"), "via_alias").select("hash", "term", F.when(F.array_contains("via_alias", F.col("term")), 0.5).otherwise(1.0).alias("w"))
    ent = q2.select("hash", F.explode("exact").alias("term"))
    part = q2.select("hash", F.explode("partial").alias("term"))
    tagged = [kw.select("term", F.lit("kw").alias("k")), ent.select("term", F.lit("ent").alias("k")), part.select("term", F.lit("part").alias("k"))]
    count = lambda k: F.sum((F.col("k") == k).cast("long")).alias(k)
    df = tagged[0].union(tagged[1]).union(tagged[2]).groupBy("term").agg(count("kw"), count("ent"), count("part"))
    n = F.col("n").cast("double")
    table = df.crossJoin(F.broadcast(corpus)).select("term", idf(n, F.col("kw").cast("double")).alias("i_kw"), (2 * idf(n, F.col("ent").cast("double"))).alias("i_multi"),
        idf(n, F.greatest("kw", "part", "ent").cast("double")).alias("i_ent"), idf(n, F.greatest("kw", "part").cast("double")).alias("i_part"))
    # one row per (memory, term): a term already counted as keyword or exact name adds nothing more
    rows = kw.select("hash", "term", F.lit(0).alias("rank"), "w").union(ent.select("hash", "term", F.lit(1).alias("rank"), F.lit(1.0).alias("w"))).union(part.select("hash", "term", F.lit(2).alias("rank"), F.lit(1.0).alias("w")))
    per = rows.groupBy("hash", "term").agg(F.sum(F.when(F.col("rank") == 0, F.col("w"))).alias("kw"), F.max((F.col("rank") == 1).cast("int")).alias("ent"), F.max((F.col("rank") == 2).cast("int")).alias("part"))
    multi = F.col("term").rlike(SEPARATED)
    once = F.when((F.col("ent") == 1) & ~multi, F.col("i_ent")).when(F.col("part") == 1, F.col("i_part")).otherwise(0.0)
    gain = F.coalesce("kw", F.lit(0.0)) * F.col("i_kw") + F.when((F.col("ent") == 1) & multi, F.col("i_multi")).otherwise(0.0) + F.when(F.col("kw").isNull(), once).otherwise(0.0)
    direct = per.join(F.broadcast(table), "term").groupBy("hash").agg(F.sum(gain).alias("direct"))
    held = direct.join(q3.withColumnRenamed("hits", "q3"), "hash", "left").where("direct <> 0")
    held = held.withColumn("match", F.col("direct") + 0.25 * F.least(F.coalesce("q3", F.lit(0)), F.lit(4)))
    if min_match > 0:
        held = held.where(F.round("match", 9) >= min_match)
    held = written(held, "matched")
    m = held.join(pruned(mem, "hash", held.select("hash")), "hash")
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.greatest("last_seen_at", F.coalesce("last_used_at", F.lit(0)))) / 86400.0)
    score = F.col("match") + 2 * F.exp(-age / 14) + 0.3 * F.log(1.0 + F.col("seen_count")) + 0.4 * F.log(1.0 + F.col("used_count")) - 1.0 * F.least("disputed_count", F.lit(3))
    score = score + F.when((F.col("project_key") == project) & F.lit(project != ""), boost).otherwise(0.0)
    return m.withColumns({"match": F.round("match", 6), "score": F.round(score, 6)})


def ranked(scored: DataFrame, k: int = 0, offset: int = 0) -> DataFrame:
    """Best first, ties by id; k rows after offset, 0 for all."""
    out = scored.orderBy(F.desc("score"), "id")
    return out.offset(offset).limit(k) if k > 0 else out


def excluding(scored: DataFrame, shown: DataFrame) -> DataFrame:
    return scored.join(shown, "id", "left_anti")


def rule_order(project: str) -> list:
    """Pinned, then the project's, then most and last seen."""
    return [F.desc("pinned"), F.col("project_key") != project, F.desc("seen_count"), F.desc("last_seen_at"), F.col("id")]


def sorted_rules(mem: DataFrame, project: str, k: int) -> DataFrame:
    """Standing rules in order."""
    return mem.where("kind = 'rule'").orderBy(*rule_order(project)).limit(k)


def session_rules(mem: DataFrame, project: str) -> DataFrame:
    """Five groups: pinned, local rules, local preferences, other rules, other preferences."""
    held = mem.where("kind in ('rule', 'preference')")
    local, rule = F.col("project_key") == project, F.col("kind") == "rule"
    group = F.when(F.col("pinned"), 0).when(local & rule, 1).when(local, 2).when(rule, 3).otherwise(4)
    return held.withColumn("group_no", group).orderBy("group_no", F.desc("seen_count"), F.desc("last_seen_at"), "id")


def here_set(mem: DataFrame, project: str, home: str) -> DataFrame:
    """Rules and preferences with whether they apply here: pinned, of the project or below it, or of the home."""
    local = is_under(F.col("project_key"), F.lit(project)) | (F.col("project_key") == home)
    return mem.where("kind in ('rule', 'preference')").withColumn("kept", F.col("pinned") | local)


def budgeted(lines: DataFrame, order: list, text: str, budget: int, reserve: int = 120, by: tuple[str, ...] = ()) -> DataFrame:
    """The prefix of lines, in order, whose bytes fit: it stops at the first misfit. `by` are independent blocks."""
    if not by:  # a line takes a byte at least, so no more lines than that can fit: a bounded top-k, not one big window
        lines = lines.orderBy(*order).limit(max(budget - reserve, 1))
    w = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    total = F.sum(F.octet_length(text) + 1).over(w.rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("used_bytes", total).where(F.col("used_bytes") <= budget - reserve)


#: What stands above the memories and above the rules of a block.
SECTIONS = ("Memories of earlier sessions (background; check before relying on them):", "Standing rules (follow them unless told otherwise):")


def sectioned(sections: list[tuple[str, DataFrame, list]], text: str, budget: int, reserve: int = 120) -> DataFrame:
    """(section, place, line, used_bytes) of a block of (header, lines, order): sections in turn, each the prefix that fits in what is left.

    A section stops at its first misfit, the next one goes on behind what was written. A header takes its room and is at place
    0; a section of which no line fits has none.
    """
    out, used = None, None
    for i, (header, lines, order) in enumerate(sections):
        size = len(header.encode()) + 1
        top = lines.orderBy(*order).limit(max(budget - reserve - size, 1))  # a line takes a byte at least
        w = W.orderBy(*order)
        held = top.select(F.row_number().over(w).cast("long").alias("place"), F.col(text).alias("line"), F.sum(F.octet_length(text) + 1).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_own"))
        held = held.withColumn("_before", F.lit(0).cast("long")) if used is None else held.crossJoin(F.broadcast(used))  # one row
        held = held.withColumn("used_bytes", F.col("_before") + size + F.col("_own")).where(F.col("used_bytes") <= budget - reserve)
        held = written(held.select(F.lit(i).cast("long").alias("section"), "place", "line", "used_bytes", "_before"), "section")
        head = held.where("place = 1").select("section", F.lit(0).cast("long").alias("place"), F.lit(header).alias("line"), (F.col("_before") + size).alias("used_bytes"))
        part = head.unionByName(held.drop("_before"))
        out = part if out is None else out.unionByName(part)
        used = out.agg(F.coalesce(F.max("used_bytes"), F.lit(0)).alias("_before"))
    return out


def standing_lines(mem: DataFrame) -> DataFrame:
    """(place, line) of pinned rules, then pinned preferences, for a file that is read at the start: by project, most seen first."""
    held = mem.where("kind in ('rule', 'preference') and coalesce(pinned, false)")
    origin = F.when(F.col("project_key") != "", F.concat(F.lit(" (from "), F.regexp_extract("project_key", "([^/]*)/*$", 1), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "title", F.lit(" — "), F.trim("content"), origin)
    order = [F.col("kind") != "rule", F.col("project_key"), F.desc("seen_count"), F.col("id")]
    # pinned by hand, so few
    return held.select(F.row_number().over(W.orderBy(*order)).cast("long").alias("place"), line.alias("line"))


def memory_line(now: int, clip: int = 400) -> Column:
    return F.format_string("- [%s] %s (%s): %s", F.col("kind"), F.col("title"), relative_age(F.lit(now), F.col("last_seen_at")), F.left(F.regexp_replace("content", r"\s+", " "), F.lit(clip)))


def summary_lines(scored: DataFrame, lines: int, width: int) -> DataFrame:
    """The first titles, shortened, and how many more there are."""
    total = scored.agg(F.count("*").alias("total"))
    top = scored.orderBy(F.desc("score"), "id").limit(lines)
    place = F.row_number().over(W.orderBy(F.desc("score"), "id")).cast("long")
    shown = top.select(place.alias("pos"), ellipsis(F.col("title"), width).alias("line"))
    more = total.where(F.col("total") > lines).select(F.lit(lines + 1).cast("long").alias("pos"), F.format_string("… %d more", F.col("total") - lines).alias("line"))
    return shown.union(more)
