"""Finding and listing memories: targets by id or title, pinned ones, pending work, entities of memories, vocabulary."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions.text import basename
from mnemospark.sources.scratch import written

from .index import containing
from .recall import pruned

#: Kinds that can be pinned.
STANDING = ("rule", "preference")


def targets(live: DataFrame, query: str, kinds: Iterable[str] = (), limit: int = 20, grams: DataFrame | None = None) -> DataFrame:
    """Memories of that id, or whose title holds the query in any case: the id first, then by title.

    With grams, the pieces of titles that saves keep, the memories that may have it are looked up and others are not read.
    An id is the start of its hash.
    """
    same = F.col("id") == query
    if grams is not None and query:
        keys = written(containing(grams, "title", query.lower()), "targets")
        live = pruned(live, "hash", keys).unionByName(live.where(F.col("hash").startswith(query) & same).join(keys, F.col("hash") == F.col("key"), "left_anti"))
    held = live.where((same | F.lower("title").contains(query.lower())) & (F.col("kind").isin(*kinds) if kinds else F.lit(True)))
    return held.orderBy(F.desc(same), "title", "id").limit(limit).select("id", "title", "kind", F.coalesce("pinned", F.lit(False)).alias("pinned"))


def pinned_first(live: DataFrame, project: str) -> DataFrame:
    """Pinned rules and preferences: those of the project, then most seen."""
    held = live.where(F.col("kind").isin(*STANDING) & F.coalesce("pinned", F.lit(False)))
    return held.orderBy(F.desc(F.col("project_key") == project), F.desc("seen_count"), "id")


def without_fixtures(mem: DataFrame, prefix: str) -> DataFrame:
    return mem.where(~F.coalesce(F.col("project_key").startswith(prefix), F.lit(False)))


def pending_aliases(mem: DataFrame, prefix: str = "") -> DataFrame:
    """Live memories that have never had aliases (null, not an empty list), fixtures left out."""
    held = mem.where("aliases is null and not coalesce(superseded, false) and not coalesce(archived, false)")
    return without_fixtures(held, prefix) if prefix else held


def with_entities(live: DataFrame, mentions: DataFrame) -> DataFrame:
    """Live memories with the names of their entities, in order; none is an empty list."""
    names = mentions.groupBy("hash").agg(F.sort_array(F.collect_set("name")).alias("entities"))
    return live.join(names, "hash", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def busiest(stats: DataFrame, project: str = "", limit: int = 25) -> DataFrame:
    """Names of the projects with most memories, each once: stats(project, memories)."""
    own = basename(F.col("project"))
    held = stats.where((F.col("memories") > 0) & (own != "") & (own != ".") & (own != basename(F.lit(project)))).select(own.alias("name"), "memories")
    return held.groupBy("name").agg(F.max("memories").alias("memories")).orderBy(F.desc("memories"), "name").limit(limit)


def skipped_footer(held: DataFrame) -> DataFrame:
    """One line on the rules and preferences(kind, kept) that do not apply here; no row if all do."""
    rule = (F.col("kind") == "rule") & ~F.col("kept")
    n = held.agg(F.coalesce(F.sum(rule.cast("long")), F.lit(0)).alias("rules"), F.coalesce(F.sum((~F.col("kept")).cast("long")), F.lit(0)).alias("n"))
    return n.where("n > 0").select(F.format_string("… %d rules + %d preferences from other projects not shown", "rules", F.col("n") - F.col("rules")).alias("line"))


def newest_touched(sessions: DataFrame, after: int, limit: int = 500) -> DataFrame:
    """Sessions with a known transcript touched since then, latest first."""
    return sessions.where((F.coalesce("path", F.lit("")) != "") & (F.col("touched_at") >= after)).orderBy(F.desc("touched_at"), "id").limit(limit)


def set_repo_key(mem: DataFrame, plan: DataFrame) -> DataFrame:
    """mem with the repo_key that plan(key, new_key) has for its project; others keep theirs."""
    p = plan.where("new_key is not null").select(F.col("key").alias("_key"), "new_key")
    held = mem.join(p, F.col("project_key") == F.col("_key"), "left")
    return held.withColumn("repo_key", F.coalesce("new_key", "repo_key")).drop("_key", "new_key")


def foreign_home(homes: DataFrame) -> DataFrame:
    """(key, home): the home most of a key's sessions ran in, the first by name of equally frequent ones."""
    n = homes.groupBy("key", "home").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "home"))
    return n.withColumn("_p", place).where("_p = 1").select("key", "home")


def through(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through a function of batches: the place of an external model. Every batch is sent once per attempt."""
    # the function's module goes with it, so executors need not have it
    home = sys.modules.get(getattr(call, "__module__", None) or "")
    if home is not None:
        cloudpickle.register_pickle_by_value(home)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield call(batch)

    return df.mapInPandas(run, schema)


def rule_based_aliases(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model that writes aliases: other spellings of a title's compound words."""
    spelt = lambda t: [w.replace("-", " ").replace("_", " ") for w in t.lower().split() if "-" in w or "_" in w][:10]
    return pd.DataFrame({"id": batch["id"], "aliases": [spelt(t) for t in batch["title"]]})


def backfill(mem: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame] = rule_based_aliases, prefix: str = "") -> DataFrame:
    """(id, aliases) for the memories that never had any; what is stored already is not asked again."""
    return through(pending_aliases(mem, prefix).select("id", "title", "content"), call, "id string, aliases array<string>")
