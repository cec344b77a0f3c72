"""A batch of saves in one set-wise step, with the results of saving its rows one after the other.

A batch has (seq, project_key, title, content, kind, aliases, entities array<struct<name,type>>) and, if wanted,
op (add, update or noop), target_id, relations array<struct<a,verb,b>> and session. seq is unique and not negative.

Times within a batch are `at`: 0 before it, seq + 1 for its rows. Which memories a row creates depends on hashes only,
what is replaced and when depends on what is created, and which noops count depends on what is replaced: three steps
without a loop. Only the memories that a batch touches take part; the others pass through one join by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import text as X
from mnemospark.sources.scratch import written

_RELATIONS = "array<struct<a:string,verb:string,b:string>>"
#: Columns that a batch may leave out: type and value.
OPTIONAL = {"op": ("string", "add"), "target_id": ("string", None), "relations": (_RELATIONS, None), "session": ("string", None)}
_TITLE = ("project_key", "title_lc", "kind")


def _none() -> Column:
    return F.array().cast("array<string>")


def entity_key(project: Column, name: Column) -> Column:
    return F.concat(project, F.lit("\0"), F.lower(X.trimmed(name)))


def staged(batch: DataFrame) -> DataFrame:
    """The batch with hash, id, title_lc, keywords, alias tokens and the columns it left out."""
    for name, (kind, value) in OPTIONAL.items():
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(value).cast(kind))
    batch = batch.withColumn("project_key", F.coalesce("project_key", F.lit("")))
    b = batch.withColumns({
        "op": F.coalesce("op", F.lit("add")),
        "hash": X.content_hash(F.col("project_key"), F.col("content")),
        "title_lc": F.lower(X.trimmed(F.col("title"))),
        "aliases": X.clean_aliases(F.coalesce("aliases", _none())),
        "at": F.col("seq") + 1,
    })
    return b.withColumns({
        "id": F.substring("hash", 1, 16),
        "alias_tokens": X.tokenize(F.concat_ws(" ", "aliases"), 24),
        "keywords": X.memory_keywords(F.col("title"), F.col("content"), F.col("aliases")),
        "alias_only": X.alias_only(F.col("title"), F.col("content"), F.col("aliases")),
    })


@dataclass
class Saved:
    """What a batch did: made and replaced memories, what each row counted for, and its outcome."""

    created: DataFrame  # hash and the columns of a new memory
    replaced: DataFrame  # hash, gone_at, newer (hash)
    events: DataFrame  # hash, at, noop, and the lists it brings
    outcomes: DataFrame  # seq, id, title, kind, new, seen, updated


def effects(mem: DataFrame, b: DataFrame) -> Saved:
    """What the staged batch b, a stored table, does to the memories mem. What several steps read is written once."""
    saves = b.where("op <> 'noop'")
    first = lambda c: F.min_by(c, "at").alias(c)
    made = saves.groupBy("hash").agg(F.min("at").alias("made"), *(first(c) for c in ("id", "title", "title_lc", "content", "kind", "project_key", "session")))
    created = written(made.join(mem.select("hash"), "hash", "left_anti"), "created")

    old = mem.select("hash", "id", "title", *_TITLE, F.lit(0).cast("long").alias("made"), F.coalesce("superseded", F.lit(False)).alias("was_gone"))
    every = old.unionByName(created.select("hash", "id", "title", *_TITLE, "made", F.lit(False).alias("was_gone")))

    # a created row replaces what is live under its title; a row made before it is reached by the next creation
    alike = every.join(created.select(*_TITLE).distinct(), list(_TITLE), "left_semi")
    later = W.partitionBy(*_TITLE).orderBy("made").rangeBetween(1, W.unboundedFollowing)
    by_title = alike.withColumn("next", F.min(F.when(F.col("made") > 0, F.struct("made", "hash"))).over(later))
    by_title = by_title.where("next is not null and not was_gone").select("hash", F.col("next.made").alias("gone_at"), F.lit(False).alias("asked"), F.col("next.hash").alias("newer"))

    # an update replaces its target, if that exists by then
    asks = saves.where("op = 'update' and target_id <> ''").select(F.col("target_id").alias("id"), "at", F.col("hash").alias("newer"))
    by_id = every.where("not was_gone").join(asks, "id").where("made < at and hash <> newer")
    by_id = by_id.select("hash", F.col("at").alias("gone_at"), F.lit(True).alias("asked"), "newer")
    gone = by_title.unionByName(by_id).groupBy("hash").agg(F.min(F.struct("gone_at", "asked", "newer")).alias("g")).select("hash", "g.*")
    gone = written(gone, "gone")

    # a noop counts if its target is there and not yet replaced
    noops = b.where("op = 'noop'").select(F.col("target_id").alias("id"), "seq", "at", F.col("alias_tokens").alias("keywords"), "aliases")
    seen = every.select("hash", "id", "title", "kind", "made", "was_gone").join(noops, "id").join(gone.select("hash", "gone_at"), "hash", "left")
    seen = seen.where("not was_gone and made < at and coalesce(at < gone_at, true)")

    lists = ("keywords", "aliases", "alias_only")
    head = ("hash", "id", "seq", "at", "title", "kind")
    events = saves.select(*head, "op", *lists, F.lit(False).alias("noop"))
    events = events.unionByName(seen.select(*head, F.lit("noop").alias("op"), "keywords", "aliases", _none().alias("alias_only"), F.lit(True).alias("noop")))

    turn = F.row_number().over(W.partitionBy("hash").orderBy("at"))
    told = events.select(*head, "op", turn.alias("turn")).join(mem.select("hash", F.coalesce("seen_count", F.lit(0)).alias("before")), "hash", "left")
    hit = gone.where("asked").groupBy(F.col("gone_at").alias("at")).agg(F.lit(True).alias("hit"))
    told = told.join(hit, "at", "left").withColumn("seen", (F.coalesce("before", F.lit(0)) + F.col("turn")).cast("long"))
    outcomes = told.select("seq", "id", "title", "kind", ((F.col("seen") == 1) & (F.col("op") != "noop")).alias("new"), "seen", F.coalesce("hit", F.lit(False)).alias("updated"))
    return Saved(created, gone.select("hash", "gone_at", "newer"), events, outcomes)


def memories_after(mem: DataFrame, done: Saved, now: int) -> DataFrame:
    """mem after the batch: counted, lists united in order, new rows added, replaced ones marked; columns as in mem."""
    # what repeats within a batch adds to the counts only, so it is counted before it is gathered
    step = done.events.groupBy("hash", "noop", "keywords", "aliases", "alias_only").agg(F.min("at").alias("at"), F.count("*").alias("times"))
    row = F.struct("at", "noop", "keywords", "aliases", "alias_only")
    steps = step.groupBy("hash").agg(F.sum("times").alias("_times"), F.sort_array(F.collect_list(row)).alias("_steps"))
    new = done.created.select("hash", *(F.col(c).alias(f"_{c}") for c in ("id", "title", "title_lc", "content", "kind", "project_key")), F.col("session").alias("_source_session"), F.lit(now).cast("long").alias("_created_at"))
    # what the batch brings is put together first, so that the memories move once
    brings = steps.join(new, "hash", "left").join(done.replaced.select("hash", F.lit(True).alias("_gone")), "hash", "full")
    m = mem.join(brings, "hash", "full")

    lists = F.struct(*(F.coalesce(c, _none()).alias(c) for c in ("keywords", "aliases", "alias_only")))
    fresh = lambda a, s: F.when(s["noop"], F.array_except(s["keywords"], a["keywords"])).otherwise(s["alias_only"])
    fold = lambda a, s: F.struct(F.array_union(a["keywords"], s["keywords"]).alias("keywords"), F.array_union(a["aliases"], s["aliases"]).alias("aliases"), F.array_union(a["alias_only"], fresh(a, s)).alias("alias_only"))
    touched = F.col("_times").isNotNull()
    m = m.withColumn("_lists", F.when(touched, F.aggregate("_steps", lists, fold)))
    filled = {c: F.coalesce(c, f"_{c}") for c in ("id", "title", "title_lc", "content", "kind", "project_key", "source_session", "created_at")}
    united = {c: F.when(touched, F.col(f"_lists.{c}")).otherwise(F.col(c)) for c in ("keywords", "aliases", "alias_only")}
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("used_count", "disputed_count", "injected_count")}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("archived", "pinned")}
    m = m.withColumns(filled | united | counts | flags | {
        "seen_count": (F.coalesce("seen_count", F.lit(0)) + F.coalesce("_times", F.lit(0))).cast("long"),
        "last_seen_at": F.when(touched, F.lit(now)).otherwise(F.col("last_seen_at")).cast("long"),
        "superseded": F.coalesce("superseded", F.lit(False)) | F.coalesce("_gone", F.lit(False)),
    })
    return m.select(*mem.columns)


def replacements(done: Saved) -> DataFrame:
    """(newer, older) by id: the edges that the batch adds."""
    return done.replaced.select(F.substring("newer", 1, 16).alias("newer"), F.substring("hash", 1, 16).alias("older"))


def named(b: DataFrame) -> DataFrame:
    """(hash, entity_key, name, etype, project_key, at, pos) of the entities that the saves of b name."""
    held = b.where("op <> 'noop'").select("hash", "project_key", "at", F.posexplode("entities").alias("pos", "e")).where(X.trimmed(F.col("e.name")) != "")
    kind = X.trimmed(F.coalesce("e.type", F.lit("")))
    return held.select("hash", entity_key(F.col("project_key"), F.col("e.name")).alias("entity_key"), X.trimmed(F.col("e.name")).alias("name"), F.when(kind == "", "other").otherwise(kind).alias("etype"), "project_key", "at", "pos")


def entities_after(entities: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """Entities and the new ones, named as they were first."""
    first = found.groupBy("entity_key").agg(*(F.min_by(c, F.struct("at", "pos")).alias(c) for c in ("name", "etype", "project_key")))
    new = first.join(entities.select("entity_key"), "entity_key", "left_anti")
    new = new.withColumns({"name_lc": F.lower("name"), "tokens": X.tokenize(F.col("name"), 8), "created_at": F.lit(now).cast("long")})
    return entities.unionByName(new.select(*entities.columns))


def mentions_after(mentions: DataFrame, found: DataFrame) -> DataFrame:
    pairs = found.select("hash", "entity_key").distinct()
    return mentions.unionByName(pairs.join(mentions, ["hash", "entity_key"], "left_anti"))


def edges_of(b: DataFrame) -> DataFrame:
    """(k1, k2, weight, verb), k1 < k2: one for each save that names both, with the verb that the first such save has.

    A save's entities are paired in its row. Of several relations between two entities the last counts.
    """
    names = F.filter("entities", lambda e: X.trimmed(e["name"]) != "")
    keys = F.array_sort(F.array_distinct(F.transform(names, lambda e: entity_key(F.col("project_key"), e["name"]))))
    told = F.transform(F.coalesce("relations", F.array().cast(_RELATIONS)), lambda r: F.struct(entity_key(F.col("project_key"), r["a"]).alias("a"), r["verb"].alias("verb"), entity_key(F.col("project_key"), r["b"]).alias("b")))
    rows = b.where("op <> 'noop'").select("at", keys.alias("ks"), told.alias("told")).where(F.size("ks") > 1)
    ones = rows.select("at", "told", "ks", F.posexplode("ks").alias("i", "k1"))
    pairs = ones.select("at", "told", "k1", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("k2"))
    same = lambda r: F.least(r["a"], r["b"]).eqNullSafe(F.col("k1")) & F.greatest(r["a"], r["b"]).eqNullSafe(F.col("k2"))
    verb = X.trimmed(F.try_element_at(F.filter("told", same), F.lit(-1))["verb"])
    pairs = pairs.select("k1", "k2", "at", F.when(verb != "", verb).alias("verb"))
    return pairs.groupBy("k1", "k2").agg(F.count("*").alias("weight"), F.min_by("verb", "at").alias("verb"))


def related_after(related: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """related with the edges' weights added; a verb stays as the edge was made with it."""
    e = edges.select("k1", "k2", F.col("weight").alias("_w"), F.col("verb").alias("_v"))
    r = related.join(e, ["k1", "k2"], "full")
    return r.select("k1", "k2", (F.coalesce("weight", F.lit(0)) + F.coalesce("_w", F.lit(0))).cast("long").alias("weight"), F.when(F.col("weight").isNull(), F.col("_v")).otherwise(F.col("verb")).alias("verb"),
        F.when(F.col("_w").isNull(), F.col("last_seen_at")).otherwise(F.lit(now)).cast("long").alias("last_seen_at"))


def sessions_after(sessions: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """Sessions after used(id, project_key, seq[, line]): new ones begin now, and a line moves the cursor."""
    line = F.max_by("line", "seq") if "line" in used.columns else F.lit(None)
    u = used.where("id is not null").groupBy("id").agg(F.min_by("project_key", "seq").alias("_project"), line.cast("long").alias("_line"), F.lit(now).cast("long").alias("_now"))
    s = sessions.join(u, "id", "full")
    return s.withColumns({
        "project_key": F.coalesce("project_key", "_project"),
        "agent": F.coalesce("agent", F.lit(False)),
        "cursor": F.coalesce("_line", "cursor", F.lit(0)).cast("long"),
        "started_at": F.coalesce("started_at", "_now"),
        "updated_at": F.coalesce("_now", "updated_at"),
    }).select(*sessions.columns)


def projects_after(projects: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    new = keys.select("project_key").where("project_key is not null").distinct().join(projects.select("project_key"), "project_key", "left_anti")
    return projects.unionByName(new.select("project_key", X.basename(F.col("project_key")).alias("name"), F.lit(now).cast("long").alias("created_at")))


def superseded_by(mem: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mem with the memories of pairs(keeper, id) replaced by their keepers, and the (newer, older) edges that adds."""
    p = pairs.where("keeper <> id").groupBy("id").agg(F.min("keeper").alias("keeper"))
    p = p.join(mem.select(F.col("id").alias("keeper")).distinct(), "keeper", "left_semi")
    hit = mem.where("not coalesce(superseded, false)").select("id").join(p, "id")
    m = mem.join(hit.select("id", F.lit(True).alias("_hit")), "id", "left")
    m = m.withColumn("superseded", F.coalesce("superseded", F.lit(False)) | F.coalesce("_hit", F.lit(False)))
    return m.select(*mem.columns), hit.select(F.col("keeper").alias("newer"), F.col("id").alias("older"))
