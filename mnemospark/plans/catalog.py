"""The recall queries: (spark, sf_dir) -> DataFrame, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.engine import Engine
from mnemospark.functions import text as X
from mnemospark.operators import browse, cluster, evaluate, extraction, graph, recall, save, sessions, setwise, write
from mnemospark.sources import transcripts
from mnemospark.sources.scratch import folder, written
from mnemospark.streaming import logs, state

from .adapters import NOW, Model, live
from .settings import BATCH, CASES, ENTITY, MIN_MATCH, PROJECT, SAVES_TTL, TOKENS

MINUTE = 60_000_000


def joined(c: str):
    return F.array_join(c, " ").alias(c)


def short(c: str):
    return F.substring(c, 1, 16)


class Recall:
    """The parts of one recall, looked up in the stored index."""

    def __init__(self, m: Model, tokens: list[str] = TOKENS):
        # titles and counters only: contents stay where they are until a query prints some
        self.mem, self.live, self.corpus = m.known, live(m.known), m.corpus
        self.q1, self.q2, self.q3 = m.index.keyword_hits(tokens), m.index.entity_hits(tokens), m.index.related_hits(tokens)

    def scored(self, **options) -> DataFrame:
        return recall.merge_and_score(self.mem, self.q1, self.q2, self.q3, corpus=self.corpus, now=NOW, **options)


def top(scored: DataFrame, k: int, offset: int = 0) -> DataFrame:
    return recall.ranked(scored, k, offset).select("id", "title", "kind", "project_key", "match", "score")


def _verdicts(m: Model) -> DataFrame:
    return m.events.where("event_type in ('purchase', 'error')").select("session", "ref", F.when(F.col("event_type") == "purchase", "used").otherwise("wrong").alias("verdict"), F.floor(F.col("us") / 1_000_000).alias("at"))


def _shown_counts(m: Model) -> DataFrame:
    return write.injected(m.events.where("event_type in ('view', 'click')").select("ref", F.floor(F.col("us") / 1_000_000).alias("at")))


def _kept(m: Model) -> DataFrame:
    """The memories with the columns that a save fills in."""
    return m.memory.withColumns({"injected_count": F.lit(0).cast("long"), "source_session": F.lit(None).cast("string")})


def _batch(m: Model) -> DataFrame:
    """Old memories without every tenth, and a batch that brings those and repeats others."""
    old = _kept(m).where(f"seq % {BATCH} <> 1")
    batch = m.memory.where(f"seq % {BATCH} in (1, 2)").select("seq", "project_key", "title", "content", "kind", "aliases", F.array().cast("array<struct<name:string,type:string>>").alias("entities"))
    b = written(save.staged(batch).withColumn("title_lc", F.lower("title")), "staged")  # as the model has them
    return save.memories_after(old, save.effects(old, b), NOW).select("id", "seen_count", "last_seen_at", "superseded")


def _reobserved(m: Model) -> DataFrame:
    """Noops on every thirteenth memory, two on every other of these."""
    old = _kept(m)
    aims = old.where("seq % 13 = 0").select("seq", "id").union(old.where("seq % 26 = 0").select((F.col("seq") + 2**40).alias("seq"), "id"))
    none = F.array().cast("array<string>")
    rows = aims.select("seq", F.lit("").alias("project_key"), F.lit("").alias("title"), F.lit("").alias("content"), F.lit("").alias("kind"), none.alias("aliases"), F.array().cast("array<struct<name:string,type:string>>").alias("entities"), F.lit("noop").alias("op"), F.col("id").alias("target_id"))
    b = written(save.staged(rows), "staged")
    out = save.memories_after(old, save.effects(old, b), NOW)
    return out.where("not superseded").join(aims.select("id").distinct(), "id", "left_semi").select("id", "seen_count", "last_seen_at")


def _save(m: Model) -> tuple[DataFrame, DataFrame]:
    """Old memories, and a staged batch over them: new rows, updates of other memories, repeats and noops, with relations."""
    mem = m.memory
    old = _kept(m).where(f"seq % {BATCH} <> 1")
    mine = f"seq % {BATCH} in (1, 2)"
    named = m.mentions.where(mine).groupBy("hash").agg(F.sort_array(F.collect_set(F.struct("name", F.col("etype").alias("type")))).alias("entities"))
    aim = mem.select((F.col("seq") - 2).alias("seq"), F.col("id").alias("aim"))
    b = mem.where(mine).join(named, "hash").join(aim, "seq", "left")
    turn, verb = F.col("seq") % (2 * BATCH), F.col("seq") % 3
    op = F.when(turn == BATCH + 1, "update").when(turn == BATCH + 2, "noop").otherwise("add")
    ends = F.struct(F.element_at("entities", 1)["name"].alias("a"), F.when(verb > 0, F.concat(F.lit("v"), verb.cast("string"))).otherwise("").alias("verb"), F.element_at("entities", -1)["name"].alias("b"))
    columns = ("seq", "project_key", "title", "content", "kind", "aliases", "entities")
    staged = save.staged(b.select(*columns, op.alias("op"), F.when(op == "noop", F.col("id")).otherwise(F.col("aim")).alias("target_id"), F.array(ends).alias("relations")))
    # each step of a save reads the batch, so it is staged once, as the engine does
    return old, written(staged, "staged")


def _saved_memories(m: Model) -> DataFrame:
    old, b = _save(m)
    out = save.memories_after(old, save.effects(old, b), NOW)
    return out.select("id", "title", "kind", "seen_count", "last_seen_at", "superseded", joined("keywords"))


def _saved_edges(m: Model) -> DataFrame:
    old, b = _save(m)
    held = m.mentions.join(old.select("hash"), "hash", "left_semi")
    before = graph.cooccurrence(held.select(F.col("hash").alias("item"), F.col("entity_key").alias("key")))
    before = before.select("*", F.lit(None).cast("string").alias("verb"), F.lit(0).cast("long").alias("last_seen_at"))
    shown = lambda c: F.translate(c, "\0", "|").alias(c)
    return save.related_after(before, save.edges_of(b), NOW).select(shown("k1"), shown("k2"), "weight", "verb", "last_seen_at")


def _named_after(m: Model) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities and mentions of the old memories, and what a batch names."""
    old, b = _save(m)
    held = m.mentions.join(old.select("hash"), "hash", "left_semi")
    ents = m.entity.join(held.select("entity_key").distinct(), "entity_key", "left_semi")
    return ents, held.select("hash", "entity_key"), save.named(b), b


def _saved_entities(m: Model) -> DataFrame:
    ents, _, found, _ = _named_after(m)
    return save.entities_after(ents, found, NOW).select(F.translate("entity_key", "\0", "|").alias("entity_key"), "name", "project_key")


def _saved_mentions(m: Model) -> DataFrame:
    _, held, found, _ = _named_after(m)
    return save.mentions_after(held, found).select(short("hash").alias("id"), F.translate("entity_key", "\0", "|").alias("entity_key"))


def _aliases_added(m: Model) -> DataFrame:
    mem = m.memory
    a = mem.where("seq % 4 = 0").select("id", F.array(F.lit("alpha"), F.lit("beta-x"), F.col("lang")).alias("aliases"))
    a = a.withColumn("tokens", X.tokenize(F.concat_ws(" ", "aliases"), 24))
    return write.set_aliases(mem, a, 20).select("id", joined("aliases"), joined("alias_only"), joined("keywords"))


def _kept_by(m: Model) -> DataFrame:
    """Every sixth memory gives way to the one after it, as members of a cluster do to their keeper."""
    keeper = m.memory.select((F.col("seq") - 1).alias("_seq"), F.col("id").alias("keeper"))
    pairs = m.memory.where("seq % 6 = 0").join(keeper, F.col("seq") == F.col("_seq")).select("keeper", "id")
    return save.superseded_by(m.memory, pairs)[0].select("id", "superseded")


def _touched(m: Model) -> DataFrame:
    """Sessions known from signups, touched by views and clicks."""
    e = m.events.select(F.col("session").cast("string").alias("id"), F.concat(F.lit("src"), F.col("ref") % 20).alias("project_key"), F.concat(F.lit("t/"), F.col("event_id")).alias("path"), F.concat(F.lit("w/"), F.col("ref")).alias("cwd"),
        (F.col("ref") == 7).alias("agent"), (F.col("us") * 1000 + F.col("event_id") % 1000).alias("at"), "event_type")
    first = e.where("event_type = 'signup'").groupBy("id").agg(*(F.max_by(c, "at").alias(c) for c in ("project_key", "path", "cwd")), F.bool_or("agent").alias("agent"), F.max("at").alias("touched_at"), F.lit(3).cast("long").alias("cursor"))
    return write.merge_sessions(first, e.where("event_type in ('view', 'click')")).select("id", "project_key", "path", "cwd", "agent", "touched_at", "cursor")


def _archive(m: Model) -> DataFrame:
    n = _shown_counts(m).select("ref", "injected")
    held = m.live.withColumn("ref", F.col("seq") % 100).join(n, "ref").withColumnRenamed("used_count", "used")
    return write.archive_candidates(held, 20, NOW - 20 * 86400).select("id", "injected")


def _clusters(m: Model) -> tuple[DataFrame, DataFrame]:
    mem = m.memory
    return mem, cluster.components(cluster.pairs(mem, m.mentions, 0.25))


def _members(m: Model, most: int | None = None) -> DataFrame:
    mem, found = _clusters(m)
    if most:
        found = found.join(found.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") <= most), "label")
    return found.withColumnRenamed("node", "hash").join(mem, "hash")


def _majority(m: Model) -> DataFrame:
    members = _members(m).select("label", F.col("lang").alias("project_key"), "seq")
    return cluster.majority_project(members).select(short("label").alias("label"), "project")


def _repo_keys(m: Model) -> DataFrame:
    c = m.table("customer")
    keys = c.select(F.concat_ws("/", F.lit("ws"), "c_nationkey", "c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("folder"), F.col("c_mktsegment").alias("name"))
    root = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("root/"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("root/"), F.col("c_mktsegment")))
    roots = c.where("c_custkey % 4 = 0").select(F.concat_ws("/", F.lit("ws"), "c_nationkey", "c_custkey").alias("key"), root.alias("root"))
    return write.plan_repo_keys(keys, roots)


def _delta(m: Model) -> DataFrame:
    n = F.col("line") >= 2
    d = m.turns.groupBy("session").agg(F.sum(n.cast("long")).alias("n"), F.coalesce(F.sum(F.when(n, F.octet_length("text"))), F.lit(0)).cast("long").alias("bytes"))
    d = d.withColumns({"final": F.col("session") % 5 == 0, "agent": F.col("session") % 7 == 0})
    return d.select("session", "n", "bytes", sessions.delta_plan(d).alias("plan"))


def _weak(m: Model) -> DataFrame:
    u = m.table("conversations").where("role = 'user'")
    return u.select(F.col("conv_id").alias("session"), "turn", F.when(F.size(X.tokenize(F.col("text"))) < 3, "context_first").otherwise("retry_on_miss").alias("plan"))


def _miss_rate(m: Model) -> DataFrame:
    v = _verdicts(m)
    used = v.where("verdict = 'used'").select("session", "ref").distinct().agg(F.count("*").alias("used"))
    miss = sessions.searched_only(sessions.shown_log(m.events), v).agg(F.count("*").alias("search_only"))
    return used.crossJoin(miss).withColumn("miss_rate", F.round(F.try_divide("search_only", "used"), 6))


def _behind(m: Model) -> DataFrame:
    t = m.events.groupBy("session").agg(F.max("us").alias("touched"), F.count("*").alias("lines"), F.sum((F.col("event_type") == "signup").cast("long")).alias("cursor"))
    end = m.events.agg((F.max("us") + MINUTE).alias("_now"))
    t = t.crossJoin(F.broadcast(end)).withColumn("idle", F.col("_now") - F.col("touched"))  # one row
    return sessions.behind(t, 3 * MINUTE, 30 * MINUTE, 7 * 24 * 60 * MINUTE)


def _all_prompts(m: Model) -> DataFrame:
    """The best memories for every text of benchmark, each from a project that its number names."""
    prompts = m.table("benchmark").select(F.col("item_id").alias("pid"), X.tokenize(F.col("text"), 32).alias("tokens"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("project"))
    found = setwise.best(m.index, m.known, prompts, corpus=m.corpus, now=NOW, k=5, min_match=MIN_MATCH)
    return found.select("pid", short("hash").alias("id"), "match", "score", F.col("rank").cast("long").alias("rank"))


def _cooldowns(m: Model) -> DataFrame:
    """Sessions whose last runs failed, errors being failures and purchases successes: how many, and how long they pause."""
    runs = m.events.where("event_type in ('error', 'purchase')").withColumn("place", F.struct("us", "event_id"))
    good = runs.where("event_type = 'purchase'").groupBy("session").agg(F.max("place").alias("good"))
    bad = runs.where("event_type = 'error'").join(good, "session", "left").where("good is null or place > good")
    n = bad.groupBy("session").agg(F.count("*").alias("failures"))
    return n.select("session", "failures", sessions.cooldown_minutes(F.col("failures")).alias("minutes"))


def _replaced(m: Model) -> DataFrame:
    """Replacements along titles; the last of every third title is replaced by the memory of the fifth number after it."""
    by = W.partitionBy("project_key", "title_lc", "kind").orderBy("seq")
    held = m.memory.select("hash", "seq", F.lead("hash").over(by).alias("next"))
    other = m.memory.select((F.col("seq") - 5).alias("_seq"), F.col("hash").alias("other"))
    return held.join(other, (F.col("seq") == F.col("_seq")) & (F.col("seq") % 3 == 0), "left").select(F.coalesce("next", "other").alias("newer"), F.col("hash").alias("older")).where("newer is not null")


def _key_maps(m: Model) -> DataFrame:
    """Customers as projects below their nation; maps for some nations, for some of their tens, and by hand."""
    c = m.table("customer")
    key = F.concat_ws("/", F.lit("ws"), "c_nationkey", F.floor(F.col("c_custkey") / 10), "c_custkey")
    keys = c.select(key.alias("key"), F.concat_ws("/", F.lit("ws"), "c_nationkey", F.floor(F.col("c_custkey") / 10)).alias("folder"), F.col("c_mktsegment").alias("name"))
    roots = c.where("c_custkey % 7 = 0").select(key.alias("key"), F.concat(F.lit("root/"), F.col("c_custkey") % 3).alias("root"))
    manual = c.where("c_custkey % 11 = 0").select(key.alias("key"), F.concat(F.lit("hand/"), "c_custkey").alias("target"))
    nations = m.table("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("ws/"), "n_nationkey").alias("prefix"), F.concat(F.lit("new/"), "n_name").alias("target"))
    tens = c.where("c_custkey % 40 < 10").select(F.concat_ws("/", F.lit("ws"), "c_nationkey", F.floor(F.col("c_custkey") / 10)).alias("prefix"), F.concat(F.lit("ten/"), F.floor(F.col("c_custkey") / 10)).alias("target"))
    return write.plan_keys(keys, roots, manual, nations.union(tens))


def _evaluation(m: Model) -> DataFrame:
    """Cases expect the first letters, in capitals, of titles of memories with their first word."""
    results, expected = [], []
    for i, case in enumerate(CASES):
        r = Recall(m, case)
        best = recall.ranked(r.scored(), 10).select("id", "title", "score")
        results.append(best.select(F.lit(i).alias("case_id"), "title", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("pos")))
        held = r.live.where(F.array_contains("keywords", case[0]) & (F.col("seq") % 4 == 0))
        expected.append(held.select(F.lit(i).alias("case_id"), F.upper(F.left("title", F.lit(6))).alias("item")).distinct())
    union = lambda xs: xs[0].union(xs[1]).union(xs[2])
    s = evaluate.scored_cases(union(expected), union(results))
    s = s.withColumns({"mode": F.when(F.col("case_id") % 2 == 0, "hook").otherwise("search"), "chars": F.col("case_id") * 100, "ms": F.col("case_id") * 37 % 50})
    return evaluate.summary(s)


def _lines(m: Model, mem: DataFrame, order: list, budget: int) -> DataFrame:
    """The first of mem as lines, with their contents: a line takes a byte at least, so no more of them can fit."""
    slim = mem.drop("keywords", "own", "aliases", "alias_only")
    return m.with_content(recall.settled(slim.orderBy(*order).limit(budget), "top")).withColumn("line", recall.memory_line(NOW))


def _context(m: Model) -> DataFrame:
    order = [F.desc("score"), "id"]
    lines = _lines(m, Recall(m).scored(min_match=MIN_MATCH, project=PROJECT), order, 9500)
    return recall.budgeted(lines, order, "line", 9500).select("id", "line", "used_bytes")


def _sections(m: Model) -> DataFrame:
    """A block in which neither section has room for all."""
    mem, rule = recall.SECTIONS
    r = Recall(m)
    parts = [(mem, r.scored(min_match=MIN_MATCH, project=PROJECT), [F.desc("score"), "id"]), (rule, recall.sorted_rules(r.live, PROJECT, 50), recall.rule_order(PROJECT))]
    return recall.sectioned([(head, _lines(m, df, order, 4000), order) for head, df, order in parts], "line", 4000)


def _engine_search(m: Model) -> DataFrame:
    """A store that all memories were saved to in two batches, by number, some archived then: what it recalls."""
    e = Engine(m.spark, f"{folder(m.spark)}/engine-{uuid.uuid4().hex}", lambda: NOW)
    mem = m.memory  # whole, before anything is derived from it
    named = m.mentions.groupBy("hash").agg(F.sort_array(F.collect_set(F.struct("name", F.col("etype").alias("type")))).alias("entities"))
    rows = mem.join(named, "hash", "left").select("seq", "project_key", "title", "content", "kind", "aliases", "entities")
    half = (m.memory.agg(F.max("seq")).first()[0] or 0) // 2 + 1
    for i in range(2):
        part = rows.where(F.floor(F.col("seq") / half) == i)
        if not part.isEmpty():
            e.remember(part)
    e.archive(m.memory.where("archived").select("id"))
    *prompt, extra = TOKENS
    return top(e.scored(" ".join(prompt), PROJECT, (extra,), MIN_MATCH), 50)


def _reindex(m: Model) -> DataFrame:
    mem = m.memory
    stored = mem.select("id", F.when(F.col("seq") % 9 == 4, F.slice("keywords", 1, F.greatest(F.size("keywords") - 1, F.lit(0)))).otherwise(F.col("keywords")).alias("keywords"))
    return write.reindex_plan(mem, stored)


def _stats(m: Model) -> DataFrame:
    # sessions are customers, their projects the sources that the nations' numbers name
    held = m.table("customer").select(F.concat(F.lit("src"), F.col("c_nationkey") % 20).alias("project_key"))
    return graph.project_stats(m.known, m.entity, held)


def _entity(m: Model):
    return m.known, m.mentions, m.entity


def _basket_edges(m: Model) -> DataFrame:
    # an order has some four parts, so about two pairs a row
    return graph.cooccurrence(m.basket.select("item", "key"), 2 * m.dealt)


def _histogram(m: Model) -> DataFrame:
    mem, ment, ents = _entity(m)
    return graph.histogram(Memory=mem, Entity=ents, MENTIONS=ment, RELATED=m.related)


def _extraction(m: Model) -> DataFrame:
    """Replies of an extractor made from benchmark texts: every kind, operation and length."""
    b = m.table("benchmark")
    i = F.col("item_id")
    memory = F.struct(F.substring("text", 1, 30).alias("title"), F.repeat("text", (i % 40 + 1).cast("int")).alias("content"), F.element_at(F.array(*map(F.lit, ("fact", "rule", "odd"))), (i % 3 + 1).cast("int")).alias("type"),
        F.element_at(F.array(*map(F.lit, ("add", "update", "noop"))), (i % 3 + 1).cast("int")).alias("op"), F.concat(F.lit("k"), (i % 4).cast("string")).alias("target_id"), F.split("text", " ").alias("aliases"))
    replies = b.select(i.alias("reply_id"), F.concat(F.lit("Here:\n"), F.to_json(F.struct(F.array(memory, memory).alias("memories")))).alias("reply"))
    out = extraction.memories(replies, F.col("reply_id") % 5 == 0, F.array(F.lit("k0"), F.lit("k1")))
    return out.select("reply_id", "pos", "title", F.octet_length("content").alias("bytes"), "kind", "op", "target_id", F.array_join("aliases", ",").alias("aliases"))


def _stream_gate(m: Model) -> DataFrame:
    """What the gate has counted when the stream has run over all events."""
    turns = state.drained(state.gate(state.event_stream(m.spark, m.dir)), "update")
    # a turn's marks are only ever set, so the greatest state is the last
    last = turns.groupBy("session", "ref", "at").agg(F.max("searched").alias("searched"), F.max("fired").alias("fired"))
    return sessions.gate_stats(last, "session")


def _stream_debounce(m: Model) -> DataFrame:
    out = state.bursts(m.spark, m.dir)
    return out.select("session", F.unix_micros("started").alias("started"), F.unix_micros("fires").alias("fires"), "n")


def _streamed(m: Model, schema: str, build, name: str, kinds: dict[str, str], close: bool = False, **columns) -> DataFrame:
    """What a stateful stream has put out over all events: in several micro-batches, with a restart from its checkpoint in between."""
    kind = F.coalesce(*(F.when(F.col("event_type") == t, k) for t, k in kinds.items()))
    e = m.events.where(F.col("event_type").isin(*kinds)).select("session", "us", "event_id", kind.alias("kind"), *(c.alias(n) for n, c in columns.items()), F.timestamp_micros("us").alias("ts"))
    run = logs.Run(m.spark, schema, build, name)
    middle = e.agg(((F.min("us") + F.max("us")) / 2).alias("_m"))
    for part in (F.col("us") <= F.col("_m"), F.col("us") > F.col("_m")):
        run.add(e.join(F.broadcast(middle)).where(part), 2)  # one row
        out = run.run()
    if close:
        run.close()
        out = run.run()
    return out


_CALLS = "session long, us long, event_id long, kind string"


def _stream_shown(m: Model) -> DataFrame:
    kinds = {"view": "push", "click": "search", "signup": "reset"}
    out = _streamed(m, f"{_CALLS}, ref long, ts timestamp", logs.shown_log, "shown", kinds, ref=F.col("ref"))
    last = out.groupBy("session").agg(F.max_by("entries", "n").alias("e")).select("session", F.posexplode(F.reverse("e")).alias("i", "e"))
    return last.select("session", "e.ref", "e.us", "e.via", (F.col("i") + 1).cast("long").alias("place"))


def _stream_failures(m: Model) -> DataFrame:
    return _streamed(m, f"{_CALLS}, ts timestamp", logs.failures, "failures", {"error": "failed", "purchase": "done"}, close=True)


def _stream_saves(m: Model) -> DataFrame:
    of = lambda t, c, other: F.when(F.col("event_type") == t, c).otherwise(other)
    schema = f"{_CALLS}, ms long, error string, skipped string, n long, n_new long, ts timestamp"
    kinds = {"purchase": "report", "error": "report", "signup": "report", "view": "drain"}
    return _streamed(m, schema, lambda e: logs.save_log(e, ttl_us=SAVES_TTL), "saves", kinds, ms=F.col("event_id") % 900, error=of("error", F.concat(F.lit("e"), F.col("ref").cast("string")), ""),
        skipped=of("signup", F.when(F.col("ref") % 2 == 0, "deferred: short").otherwise("no turns"), ""), n=of("purchase", F.col("ref") % 4, 0), n_new=of("purchase", F.col("ref") % 2, 0))


def _learned(m: Model) -> DataFrame:
    """Searches ask for a benchmark text; session and reference say which memory was found."""
    n = m.memory.agg(F.max("seq").alias("_top")).crossJoin(F.broadcast(m.table("benchmark").agg(F.max("item_id").alias("_last"))))
    mapped = lambda df: df.crossJoin(F.broadcast(n)).withColumn("ref", (F.col("ref") * 31 + F.col("session")) % (F.col("_top") + 1))  # noqa: E731  one row
    mem = m.memory.select(F.col("seq").alias("_seq"), "title", "content")
    asked = m.table("benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("query"))
    shown = mapped(sessions.shown_log(m.events)).join(mem, F.col("ref") == F.col("_seq"))
    shown = shown.withColumn("_ask", F.col("ref") % (F.col("_last") + 1)).join(asked, F.col("_ask") == F.col("_item"))
    return sessions.learned_terms(shown, mapped(_verdicts(m))).select("session", "ref", joined("terms"))


def _drained(m: Model) -> DataFrame:
    e = m.events.where("event_type in ('purchase', 'error', 'signup')")
    at = F.floor(F.col("us") / 1_000_000)
    now = 1_704_067_200 + 10 * 86400
    reports = e.select("session", at.alias("at"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 == 0).alias("reported"), (F.col("event_id") % 900).alias("ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("ref").cast("string"))).otherwise("").alias("error"),
        F.when(F.col("event_type") == "signup", F.when(F.col("ref") % 2 == 0, "deferred: short").otherwise("no turns")).otherwise("").alias("skipped"),
        F.when(F.col("event_type") == "purchase", F.col("ref") % 4).otherwise(0).alias("n"), F.when(F.col("event_type") == "purchase", F.col("ref") % 2).otherwise(0).alias("n_new"))
    return sessions.drained(reports, now, ttl=10 * 86400)


def _jsonl(m: Model) -> DataFrame:
    """Conversations written as transcript lines, with wrappers, side chains and block contents, and read as turns."""
    c, i = m.table("conversations"), F.col("turn")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text"))))
    message = F.struct("role", F.when((F.col("conv_id") + i) % 3 == 0, blocks).otherwise(F.col("text")).alias("content"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), ((F.col("conv_id") + i) % 5 == 0).alias("isSidechain"), message.alias("message")))
    lines = c.select(F.col("conv_id").cast("string").alias("file"), i.cast("int").alias("line"), line.alias("value"))
    return transcripts.turns(lines).select(F.col("file").cast("long").alias("session"), "line", "role", F.octet_length("text").cast("long").alias("bytes"))


def _expanded(m: Model) -> DataFrame:
    """Terms as a model might send them: names in other spellings, filler, repeats, the prompt's own words."""
    b = m.table("benchmark")
    w = F.split("text", " ")
    terms = F.array(F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1))), F.concat(F.get(w, F.lit(2)), F.lit("-"), F.get(w, F.lit(3))), F.upper(F.get(w, F.lit(4))), F.lit("the of"), F.lit("a{b"), F.lit("x"), F.get(w, F.lit(4)), F.get(w, F.lit(5)))
    known = F.array(F.lower(F.concat_ws("_", F.get(w, F.lit(0)), F.get(w, F.lit(1)))), F.lower(F.concat_ws(" ", F.get(w, F.lit(2)), F.get(w, F.lit(3)))))
    prompt = F.array(F.lower(F.get(w, F.lit(5))))
    return b.select("item_id", F.array_join(X.expansion_terms(terms, prompt, known), "|").alias("terms"))


def _entities_of(m: Model) -> DataFrame:
    return browse.with_entities(m.live, m.mentions).select("id", F.array_join("entities", "|").alias("entities"))


def _foreign_home(m: Model) -> DataFrame:
    c = m.table("customer")
    return browse.foreign_home(c.select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("home")))


def _cursor(m: Model) -> DataFrame:
    t = m.turns
    cursors = t.groupBy("session").agg(F.when(F.col("session") % 3 == 0, 99).when(F.col("session") % 3 == 1, 2).alias("cursor"))
    return sessions.from_cursor(t, cursors).select("session", "line")


def _projects(m: Model) -> DataFrame:
    return browse.busiest(m.memory.groupBy(F.col("project_key").alias("project")).agg(F.count("*").alias("memories")), PROJECT, 10)


PLANS: dict[str, Callable[[Model], DataFrame]] = {
    "tokenize_documents": lambda m: m.table("documents").select("doc_id", F.array_join(X.tokenize(F.col("text"), 32), " ").alias("tokens")),
    "tokenize_pages": lambda m: m.table("pages").select("page_id", F.array_join(X.tokenize(F.col("html"), 32), " ").alias("tokens")),
    "memory_hash_dedup": lambda m: m.memory.select("hash", "id", "seen_count", "created_at", "last_seen_at"),
    "memory_keywords": lambda m: m.memory.select("id", joined("keywords")),
    "alias_only_tokens": lambda m: m.memory.select("id", joined("alias_only")),
    "live_memory": lambda m: m.live.select("id", "title", "kind", "project_key"),
    "corpus_count": lambda m: m.live.agg(F.count("*").alias("n")),
    "keyword_hits": lambda m: m.index.keyword_hits(TOKENS).select(short("hash").alias("id"), joined("matched")),
    "document_frequency": lambda m: recall.document_frequency(m.index.keyword_hits(TOKENS)),
    "idf_table": lambda m: recall.document_frequency(m.index.keyword_hits(TOKENS)).crossJoin(F.broadcast(m.corpus)).select("term", F.round(X.idf(F.col("n").cast("double"), F.col("df").cast("double")), 6).alias("idf")),
    "entity_hits_exact_partial": lambda m: m.index.entity_hits(TOKENS).select(short("hash").alias("id"), "hits", joined("exact"), joined("partial")),
    "related_hits": lambda m: m.index.related_hits(TOKENS).select(short("hash").alias("id"), "hits"),
    "keyword_search_topk": lambda m: top(Recall(m).scored(), 10),
    "full_retrieval_scored": lambda m: Recall(m).scored(project=PROJECT).select("id", "match", "score"),
    "retrieval_floor": lambda m: Recall(m).scored(min_match=MIN_MATCH, project=PROJECT).select("id", "match", "score"),
    "search_page_2": lambda m: top(Recall(m).scored(), 10, 10),
    "retrieve_exclude_shown": lambda m: recall.excluding(Recall(m).scored(min_match=MIN_MATCH), m.known.where("seq % 3 = 0").select("id")).select("id", "match", "score"),
    "similar_memories_k12": lambda m: recall.ranked(Recall(m, CASES[0]).scored(min_match=MIN_MATCH), 12).select("id", "match", "score"),
    "rules_sorted": lambda m: recall.sorted_rules(m.live, PROJECT, 50).select("id", "title", "pinned", "project_key", "seen_count"),
    "session_rules": lambda m: recall.session_rules(m.live, PROJECT).select("id", "group_no"),
    "here_set": lambda m: recall.here_set(m.live, PROJECT, "src7").select("id", "kept"),
    "context_block_budget": _context,
    "context_sections": _sections,
    "engine_search": _engine_search,
    "standing_lines": lambda m: recall.standing_lines(m.live),
    "summary_lines": lambda m: recall.summary_lines(Recall(m).scored(), 6, 20),
    "entity_list_mentions": lambda m: (lambda mem, ment, ents: graph.entity_list(ents, ment, 50))(*_entity(m)),
    "entity_detail_nodes": lambda m: (lambda mem, ment, ents: graph.entity_nodes(ents, ment, ENTITY, grams=m.kept("grams")))(*_entity(m)),
    "entity_relations": lambda m: (lambda mem, ment, ents: graph.entity_relations(ents, m.related, ENTITY))(*_entity(m)),
    "entity_memories": lambda m: (lambda mem, ment, ents: graph.entity_memories(ents, ment, mem, ENTITY))(*_entity(m)),
    "entity_names_recent": lambda m: graph.recent_names(m.entity, 20, PROJECT),
    "project_stats": _stats,
    "cooccurrence_edges": _basket_edges,
    "hub_entities": lambda m: graph.hubs(m.basket, _basket_edges(m), 25),
    "cross_project_entities": lambda m: graph.cross_project(m.basket),
    "graph_histogram": _histogram,
    "two_hop_neighbourhood": lambda m: graph.two_hops(m.basket.select("item", "key"), 10, 1),
    "supersession_chains": lambda m: graph.chains(m.memory),
    "replacement_heads": lambda m: graph.newest(_replaced(m)).select(short("id").alias("id"), short("head").alias("head"), "steps"),
    "key_map_plan": _key_maps,
    "supersede_same_title": _batch,
    "saved_outcomes": lambda m: save.effects(*_save(m)).outcomes,
    "saved_memories": _saved_memories,
    "saved_edges": _saved_edges,
    "saved_entities": _saved_entities,
    "saved_mentions": _saved_mentions,
    "aliases_added": _aliases_added,
    "superseded_by_keeper": _kept_by,
    "sessions_touched": _touched,
    "pinned_flags": lambda m: write.set_flag(m.memory, m.memory.where("seq % 5 = 0").select("id"), "pinned", True, browse.STANDING).select("id", "pinned"),
    "saved_replacements": lambda m: save.replacements(save.effects(*_save(m))),
    "supersede_by_target": lambda m: (lambda mem: write.supersede_targets(mem, mem.where("seq % 11 = 3").select(F.col("id").alias("target_id"))))(m.memory),
    "reobserve": _reobserved,
    "feedback_counters": lambda m: write.feedback(_verdicts(m)),
    "injected_counters": _shown_counts,
    "archive_candidates": _archive,
    "reindex_plan": _reindex,
    "near_duplicate_pairs": lambda m: (lambda mem: cluster.pairs(mem, m.mentions, 0.25).select(short("a").alias("a"), short("b").alias("b"), F.round("jaccard", 6).alias("jaccard")))(m.memory),
    "near_duplicate_clusters": lambda m: (lambda mem: cluster.clusters(mem, m.mentions, 0.25).select(short("label").alias("label"), short("hash").alias("id"), "size"))(m.memory),
    "majority_project": _majority,
    "canonical_union": lambda m: cluster.united(_members(m, 8), "aliases").select(short("label").alias("label"), F.array_join("values", " ").alias("aliases")),
    "repo_key_plan": _repo_keys,
    "transcript_turns": lambda m: m.turns.select("session", "line", "role", F.octet_length("text").alias("bytes")),
    "transcript_chunk_budget": lambda m: sessions.chunk_summary(m.turns, 3000),
    "last_exchange": lambda m: sessions.last_exchange(m.turns),
    "delta_chars_plan": _delta,
    "weak_prompt_context_plan": _weak,
    "debounced_jobs": lambda m: sessions.debounced(m.events, 45 * MINUTE),
    "shown_log_seen": lambda m: sessions.seen(sessions.shown_log(m.events)),
    "shown_ring_200": lambda m: sessions.ring(sessions.shown_log(m.events), 200).select("session", "ref", "us", "via", "place"),
    "gate_fire_once": lambda m: sessions.gate(m.events),
    "learned_aliases": lambda m: sessions.searched_only(sessions.shown_log(m.events), _verdicts(m)),
    "hook_miss_rate": _miss_rate,
    "save_log_last4": lambda m: sessions.last_reports(m.events.where("event_type = 'purchase'")).select("session", "ref", "us", "place"),
    "sweep_behind": _behind,
    "cooldown_table": _cooldowns,
    "eval_summary": _evaluation,
    "recall_all_prompts": _all_prompts,
    "extraction_validate": _extraction,
    "memory_targets": lambda m: browse.targets(m.live, "the", limit=20, grams=m.kept("grams")).select("id", "title", "kind", "pinned"),
    "pin_targets": lambda m: browse.targets(m.live, "an", browse.STANDING, grams=m.kept("grams")).select("id", "title", "kind", "pinned"),
    "pinned_listing": lambda m: browse.pinned_first(m.live, PROJECT).select("id", "title", "project_key", "seen_count"),
    "pending_aliases": lambda m: browse.pending_aliases(m.memory.withColumn("aliases", F.when(F.col("seq") % 3 > 0, F.col("aliases"))), "src1").select("id"),
    "memory_entities": _entities_of,
    "busiest_projects": _projects,
    "skipped_footer": lambda m: browse.skipped_footer(recall.here_set(m.live, PROJECT, "src7")),
    "expansion_terms": _expanded,
    "learned_terms": _learned,
    "drained_reports": _drained,
    "transcript_jsonl": _jsonl,
    "cursor_turns": _cursor,
    "foreign_home": _foreign_home,
    "message_clips": lambda m: m.table("documents").select("doc_id", F.md5(X.clip_message(F.col("text"))).alias("clip"), X.human_bytes(F.octet_length("text")).alias("size")),
    "gate_stats_day": lambda m: sessions.gate_stats(sessions.gate_turns(sessions.gate_calls(m.events)), since=1_704_067_200_000_000 + 5 * sessions.DAY_US),
    "stream_gate": _stream_gate,
    "stream_debounce": _stream_debounce,
    "stream_shown_log": _stream_shown,
    "stream_failures": _stream_failures,
    "stream_save_log": _stream_saves,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Model(spark, sf_dir))) for name, plan in PLANS.items()}
