"""Set-wise upserts: each function returns the next version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def supersede_targets(mem: DataFrame, updates: DataFrame) -> DataFrame:
    """id, superseded of the memories that updates(target_id) replace."""
    return mem.join(updates.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi").select("id", F.lit(True).alias("superseded"))


def feedback(verdicts: DataFrame) -> DataFrame:
    """(ref, used, disputed, last_used) of verdicts(ref, verdict, at): anything but used is a dispute."""
    used = F.col("verdict") == "used"
    return verdicts.groupBy("ref").agg(F.sum(used.cast("long")).alias("used"), F.sum((~used).cast("long")).alias("disputed"), F.max(F.when(used, F.col("at"))).alias("last_used"))


def injected(shown: DataFrame) -> DataFrame:
    return shown.groupBy("ref").agg(F.count("*").alias("injected"), F.max("at").alias("last_injected"))


def archive_candidates(mem: DataFrame, least_injected: int, before: int) -> DataFrame:
    """Live memories shown often, never used and not seen lately; mem has injected and used counts."""
    return mem.where((F.col("injected") >= least_injected) & (F.col("used") == 0) & (F.col("last_seen_at") < before))


def reindex_plan(mem: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids whose stored token set differs from the recomputed one, with both sizes."""
    now = mem.select("id", F.array_sort("keywords").alias("fresh"))
    return stored.join(now, "id").where(F.array_sort("keywords") != F.col("fresh")).select("id", F.size("keywords").cast("long").alias("stored"), F.size("fresh").cast("long").alias("fresh"))


def set_aliases(mem: DataFrame, aliases: DataFrame, cap: int | None = None) -> DataFrame:
    """mem with aliases(id, aliases, tokens): replaced, or with a cap added to where fewer than cap are held."""
    a = aliases.select("id", F.col("aliases").alias("_a"), F.col("tokens").alias("_t"))
    m = mem.join(a, "id", "left")
    here = F.col("_a").isNotNull()
    if cap is not None:
        here = here & (F.size(F.coalesce("aliases", F.array().cast("array<string>"))) < cap)
    value = F.col("_a") if cap is None else F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.col("_a"))
    fresh = F.array_except("_t", "keywords")
    return m.withColumns({"aliases": F.when(here, value).otherwise(F.col("aliases")), "alias_only": F.when(here, F.array_union("alias_only", fresh)).otherwise(F.col("alias_only")),
        "keywords": F.when(here, F.array_union("keywords", fresh)).otherwise(F.col("keywords"))}).drop("_a", "_t")


def set_flag(mem: DataFrame, ids: DataFrame, column: str, value: bool, kinds: tuple[str, ...] = ()) -> DataFrame:
    """mem with a flag (pinned, archived, superseded) set on ids(id), for some kinds only if given."""
    m = mem.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("kind").isin(*kinds) if kinds else F.lit(True))
    return m.withColumn(column, F.when(hit, value).otherwise(F.col(column))).drop("_hit")


def merge_sessions(sessions: DataFrame, touched: DataFrame) -> DataFrame:
    """Sessions after touched(id, project_key, path, cwd, agent, at): the agent mark sticks, the rest is the latest."""
    t = touched.groupBy("id").agg(*(F.max_by(c, "at").alias(f"_{c}") for c in ("project_key", "path", "cwd")), F.bool_or("agent").alias("_agent"), F.max("at").alias("_at"))
    s = sessions.join(t, "id", "full")
    return s.select("id", *(F.coalesce(f"_{c}", c).alias(c) for c in ("project_key", "path", "cwd")), (F.coalesce("agent", F.lit(False)) | F.coalesce("_agent", F.lit(False))).alias("agent"), F.greatest("touched_at", "_at").alias("touched_at"), F.coalesce("cursor", F.lit(0)).alias("cursor"))


def plan_repo_keys(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, root): a root of its own, else that of its siblings if all agree, else that of its name if all agree.

    keys(key, folder, name); roots(key, root) as far as they resolve.
    """
    held = keys.join(roots, "key", "left")
    agreed = lambda by: held.where("root is not null").groupBy(by).agg(F.min("root").alias(f"root_{by}"), F.countDistinct("root").alias("n")).where("n = 1").drop("n")
    out = held.join(agreed("folder"), "folder", "left").join(agreed("name"), "name", "left")
    return out.select("key", F.coalesce("root", "root_folder", "root_name").alias("new_key"))


def prefix_mapped(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, new_key) of keys(key) that are, or lie below, a prefix of prefixes(prefix, target): the longest counts, and what is behind it stays.

    A key is looked up by each of its ancestors, so this is an equi-join and no prefix is tried on every key. Of several
    targets of one prefix the least counts; an ending slash of a prefix is left out.
    """
    p = prefixes.select(F.regexp_replace("prefix", "/+$", "").alias("prefix"), "target").where("prefix <> ''").groupBy("prefix").agg(F.min("target").alias("target"))
    parts = F.split("key", "/")
    held = keys.where("key is not null").select("key").distinct().select("key", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("parts"))
    held = held.select("key", "n", F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("prefix"), F.array_join(F.slice("parts", F.col("n") + 1, F.size("parts")), "/").alias("_rest"), (F.col("n") < F.size("parts")).alias("below"))
    new = F.concat("target", F.when(F.col("below"), F.concat(F.lit("/"), F.col("_rest"))).otherwise(""))
    return held.join(p, "prefix").groupBy("key").agg(F.max_by(new, "n").alias("new_key"))


def plan_keys(keys: DataFrame, roots: DataFrame, manual: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, new_key) of keys(key, folder, name); new_key is null where nothing tells it.

    A root that the key has of its own, as far as roots(key, root) resolve, goes before all else; then what manual(key,
    target) says, then the longest of prefixes(prefix, target), then the root of its folder if that has one only, then
    that of its name.
    """
    by = manual.groupBy(F.col("key").alias("_k")).agg(F.min("target").alias("manual"))
    mapped = prefix_mapped(keys, prefixes).select(F.col("key").alias("_m"), F.col("new_key").alias("mapped"))
    own = roots.groupBy(F.col("key").alias("_r")).agg(F.min("root").alias("own"))
    out = plan_repo_keys(keys, roots).join(own, F.col("key") == F.col("_r"), "left").join(by, F.col("key") == F.col("_k"), "left").join(mapped, F.col("key") == F.col("_m"), "left")
    return out.select("key", F.coalesce("own", "manual", "mapped", "new_key").alias("new_key"))
