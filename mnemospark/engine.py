"""Engine: the recall verbs over a snapshot store."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text as X
from mnemospark.operators import browse, cluster, evaluate, extraction, graph, index, recall, save, sessions, setwise, write
from mnemospark.sources import tails, transcripts
from mnemospark.sources.scratch import written
from mnemospark.sources.snapshots import Conflict, Draft, Store, bucket

MEMORY = """hash string, id string, title string, title_lc string, content string, kind string, project_key string, keywords array<string>, aliases array<string>, alias_only array<string>,
created_at long, last_seen_at long, seen_count long, used_count long, disputed_count long, last_used_at long, injected_count long, superseded boolean, archived boolean, pinned boolean, source_session string, repo_key string"""
_T = TypeVar("_T")
TABLES = {
    "memory": MEMORY,
    "mentions": "hash string, entity_key string",
    "entities": "entity_key string, name string, etype string, project_key string, name_lc string, tokens array<string>, created_at long",
    "related": "k1 string, k2 string, weight long, verb string, last_seen_at long",
    "replacements": "newer string, older string",
    "sessions": "id string, project_key string, path string, cwd string, agent boolean, touched_at long, cursor long, started_at long, updated_at long, fails long, room long, paused_until long",
    "projects": "project_key string, name string, created_at long",
} | index.TABLES

#: Most files that a sweep looks into, those changed last first; the next sweep has the others.
SWEPT = 500
#: Lines of a block that an evaluation looks at: more than its budget has room for.
MOST_LINES = 250
#: Tables whose rows are only ever added.
GROWN = ("replacements", *index.TABLES)
#: A session's failed extractions in a row, the characters its next chunk may have, and when it may be tried again.
FAILING = ("fails", "room", "paused_until")
#: What tables are sorted by where they are written.
ORDER = {"memory": ("hash",), "entities": ("entity_key",), "mentions": ("entity_key",), "related": ("k1",)} | index.ORDER


class Engine:
    """remember, consolidate, sessions, search, retrieve, feedback, pin, archive, entities, stats, backup and restore."""

    def __init__(self, spark: SparkSession, root: str, clock=lambda: int(time.time())):
        self.spark, self.store, self.clock = spark, Store(spark, root), clock
        self._draft: Draft | None = None

    def table(self, name: str, buckets: set[str] | None = None) -> DataFrame:
        """A table of the current version; within a change, of the one that it starts from."""
        version = self._draft.base if self._draft else self.store.current()
        held = version is not None and self.store.has(name, buckets, version)
        return self.store.read(name, version, buckets, TABLES[name]) if held else self.spark.createDataFrame([], TABLES[name])

    def _change(self, run: Callable[[Draft], _T], tries: int = 5) -> _T:
        """A change of the tables as one version: all of it is seen, or nothing. run(draft) reads the version it starts from and puts
        tables; if another writer was faster it runs again on what that one left, so nothing is lost and nothing counts twice."""
        for left in reversed(range(tries)):
            self._draft = draft = Draft(self.store)
            try:
                out = run(draft)
                if draft.fresh:
                    draft.finish()
                return out
            except Conflict:
                if not left:
                    raise
            except BaseException:
                draft.drop()
                raise
            finally:
                self._draft = None
        raise AssertionError("unreachable")

    def _put(self, draft: Draft, tables: dict[str, DataFrame], touched: set[str] | None = None) -> None:
        """Write tables into the version, those dealt by project for the touched buckets, and the index entries that follow."""
        by = self._by()
        if touched is not None and not touched:  # no project has a part in it
            tables = {n: df for n, df in tables.items() if n not in by}

        def put(item: tuple[str, DataFrame]) -> None:
            name, df = item
            draft.put(name, df, by.get(name), touched, name in GROWN, ORDER.get(name, ()), index.merged(name) if name in index.TABLES else None)

        with ThreadPoolExecutor(4) as pool:
            list(pool.map(put, tables.items()))
            if "memory" not in tables:
                return
            dealt = [n for n in by if n in tables]
            after = {n: self._as_written(draft, n, touched) for n in by}
            segments = index.changes({n: self.table(n, touched) for n in dealt}, after, int(draft.version))
            list(pool.map(put, segments.items()))

    def _as_written(self, draft: Draft, name: str, touched: set[str] | None) -> DataFrame:
        held = draft.read(name, touched, TABLES[name])
        return self.spark.createDataFrame([], TABLES[name]) if held is None else held

    def _by(self) -> dict[str, Column]:
        """Tables dealt to buckets by project: a save, verdict or flag writes those of the projects it touches only."""
        project = F.col("project_key")
        return {"memory": project, "entities": project, "mentions": F.substring_index("entity_key", "\0", 1), "related": F.substring_index("k1", "\0", 1)}

    def _buckets(self, *projects: DataFrame) -> set[str]:
        """The buckets of these project_keys: a bounded number."""
        rows = [df.select(bucket(F.col("project_key")).alias("b")) for df in projects]
        return {r["b"] for r in reduce(DataFrame.union, rows).distinct().collect()}

    def _of(self, ids: DataFrame) -> DataFrame:
        """The memories of ids(id). An id is the start of a hash, so tables in order of hash are in order of id, and few row groups are read."""
        return recall.pruned(self.memory, "id", recall.settled(ids.select("id").where("id is not null").distinct(), "ids"))

    def _update(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> str | None:
        """Apply a change to the memories, of which only the buckets that hold ids(id) are read and written; none held, no change."""

        def run(draft: Draft) -> str | None:
            touched = self._buckets(self._of(ids))
            if not touched:
                return draft.base
            self._put(draft, {"memory": change(self.table("memory", touched))}, touched)
            return draft.version

        return self._change(run)

    @property
    def memory(self) -> DataFrame:
        return self.table("memory")

    @property
    def mentions(self) -> DataFrame:
        return self.table("mentions")

    @property
    def entities(self) -> DataFrame:
        return self.table("entities")

    @property
    def related(self) -> DataFrame:
        return self.table("related")

    @property
    def sessions(self) -> DataFrame:
        return self.table("sessions")

    def shown(self) -> DataFrame:
        """The memories under the project they belong to now: that of their repository, if they were given one."""
        return self.memory.withColumn("project_key", F.coalesce("repo_key", "project_key"))

    def rekey(self, manual: DataFrame | None = None, prefixes: DataFrame | None = None, roots: DataFrame | None = None, apply: bool = False) -> DataFrame:
        """(key, new_key) of the projects that are to go by another key: manual(key, target), prefixes(prefix, target), roots(key, root).

        Applied, memories get that key beside their own: hashes, entities and edges stay, so it can be done again. Projects for
        which nothing tells a key have a null one.
        """
        of = lambda df, schema: self.spark.createDataFrame([], schema) if df is None else df
        keys = self.table("projects").select(F.col("project_key").alias("key")).where("key <> ''").distinct()
        keys = keys.withColumns({"folder": F.regexp_replace("key", "/[^/]*$", ""), "name": X.basename(F.col("key"))})
        plan = write.plan_keys(keys, of(roots, "key string, root string"), of(manual, "key string, target string"), of(prefixes, "prefix string, target string"))
        plan = written(plan.where("new_key is null or new_key <> key"), "rekey")
        if apply:
            ids = self.memory.join(plan.where("new_key is not null").select(F.col("key").alias("project_key")), "project_key", "left_semi").select("id")
            self._update(ids, lambda mem: browse.set_repo_key(mem, plan).select(*mem.columns))
        return plan

    def successors(self) -> DataFrame:
        """(id, head, steps): the memory that stands for each replaced one now."""
        return graph.newest(self.table("replacements"))

    def live(self) -> DataFrame:
        return self.memory.where("not coalesce(superseded, false) and not coalesce(archived, false)")

    def _saved(self, batch: DataFrame, now: int, also: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame, set[str]]:
        """The tables after a batch, what became of its rows, and the buckets this touches, with those of the projects of `also`."""
        # the batch is read by every table's plan, so it is staged once
        b = written(save.staged(batch), "staged")
        aims = b.where("target_id <> ''").select(F.col("target_id").alias("id")).distinct()
        touched = self._buckets(b, self._of(aims), *([also] if also is not None else []))
        mem = self.table("memory", touched)
        done = save.effects(mem, b)
        found = save.named(b)
        tables = {
            "memory": save.memories_after(mem, done, now),
            "entities": save.entities_after(self.table("entities", touched), found, now),
            "mentions": save.mentions_after(self.table("mentions", touched), found),
            "related": save.related_after(self.table("related", touched), save.edges_of(b), now),
            "replacements": save.replacements(done),
            "sessions": save.sessions_after(self.sessions, b.select(F.col("session").alias("id"), "project_key", "seq"), now),
            "projects": save.projects_after(self.table("projects"), b, now),
        }
        return tables, done.outcomes, touched

    def remember(self, batch: DataFrame) -> str:
        """Save a batch (operators.save says of what) as the next version; all of it is seen, or nothing."""
        return self.save(batch)[0]

    def save(self, batch: DataFrame) -> tuple[str, DataFrame]:
        """The next version, and (seq, id, title, kind, new, seen, updated) of each row that counted."""

        def run(draft: Draft) -> tuple[str, DataFrame]:
            tables, outcomes, touched = self._saved(batch, self.clock())
            # read from the version before this one, which could be pruned
            outcomes = written(outcomes, "outcomes")
            self._put(draft, tables, touched)
            return draft.version, outcomes

        return self._change(run)

    def touch(self, touched: DataFrame) -> str:
        """Note sessions as they run: touched(id, project_key, path, cwd, agent, at). The project stays, the agent mark sticks."""

        def run(draft: Draft) -> str:
            now, held = self.clock(), self.sessions
            own = held.select("id", F.col("project_key").alias("_project"), "started_at", "updated_at", *FAILING)
            s = write.merge_sessions(held.select("id", "project_key", "path", "cwd", "agent", "touched_at", "cursor"), touched).join(own, "id", "left")
            s = s.withColumns({"project_key": F.coalesce("_project", "project_key"), "started_at": F.coalesce("started_at", F.lit(now).cast("long"))})
            self._put(draft, {"sessions": s.select(*held.columns)})
            return draft.version

        return self._change(run)

    def set_cursor(self, cursors: DataFrame) -> str:
        """Move sessions on to the line they are extracted up to: cursors(id, project_key, line)."""

        def run(draft: Draft) -> str:
            now, c = self.clock(), cursors.withColumn("seq", F.lit(0))
            self._put(draft, {"sessions": save.sessions_after(self.sessions, c, now), "projects": save.projects_after(self.table("projects"), c, now)})
            return draft.version

        return self._change(run)

    def cursor(self, session: str) -> int:
        row = self.sessions.where(F.col("id") == session).select("cursor").first()
        return row["cursor"] if row else 0

    def extract(self, turns: DataFrame, jobs: DataFrame, call=extraction.rule_based_extractor, known: DataFrame | None = None, budget: int = 24_000) -> DataFrame:
        """One chunk of each of jobs(session, project_key, final, agent): from turns(session, line, role, text) to saved memories.

        call gets (session, project_key, prompt, known) in batches and returns (session, reply). known(session, ids) are the
        memories that a reply may name. Memories, verdicts and cursors are one version: a chunk counts once, whatever is
        lost in between, and a chunk whose cursor another run has moved meanwhile counts for that run only. A session whose
        reply cannot be read keeps its cursor; its next chunk is half as long, and from the third failure on it pauses
        (`sessions.cooldown_minutes`). Returns (session, plan, next, total, error, saved).
        """
        held = self.sessions.select(F.col("id").alias("session"), "cursor", *FAILING)
        held = written(jobs.join(held, "session", "left"), "jobs")
        waits = F.coalesce(F.col("paused_until") > self.clock(), F.lit(False))
        due = held.where(~waits)
        d = extraction.deltas(turns, due.select(*jobs.columns), due.where("cursor is not null").select("session", "cursor"), budget, due.select("session", "room"))
        none = F.array().cast("array<string>")
        d = d.withColumn("known", none) if known is None else d.join(known.withColumnRenamed("ids", "known"), "session", "left").withColumn("known", F.coalesce("known", none))
        d = written(d.join(due.select("session", F.coalesce("cursor", F.lit(0)).alias("from")), "session"), "deltas")
        replies = browse.through(d.where("plan = 'extract'").select("session", "project_key", "prompt", "known"), call, "session string, reply string")
        # an answer is asked for once
        replies = written(replies, "replies").join(d.select("session", "project_key", "agent", "known"), "session")
        read = replies.withColumn("reply_id", F.col("session")).withColumn("ok", extraction.parsed(F.col("reply"))["memories"].isNotNull())
        mems = extraction.memories(read.where("ok"), F.col("agent"), F.col("known")).withColumnRenamed("reply_id", "session")
        triple = F.transform("relations", lambda r: F.struct(r[0].alias("a"), r[1].alias("verb"), r[2].alias("b")))
        mems = mems.withColumn("relations", triple).join(d.select("session", "project_key"), "session")
        # numbered in order of session and place without gathering them: by range, and by row within it
        mems = mems.repartitionByRange("session", "pos").sortWithinPartitions("session", "pos").withColumn("seq", F.monotonically_increasing_id())
        mems = written(mems, "extracted")
        verdicts = written(extraction.verdicts(read.where("ok"), F.col("agent"), F.col("known")).withColumnRenamed("reply_id", "session"), "verdicts")
        done = d.join(read.select("session", "ok"), "session", "left").join(mems.groupBy("session").agg(F.count("*").alias("saved")), "session", "left")
        # a call that returns no row for a session has failed it
        failed = (F.col("plan") == "extract") & ~F.coalesce("ok", F.lit(False))
        done = done.select("session", "project_key", "plan", "next", "total", "from", "bytes", F.when(failed, "unreadable reply").alias("error"), F.coalesce("saved", F.lit(0)).alias("saved"))
        done = written(done, "extractions")

        def run(draft: Draft) -> DataFrame:
            now = self.clock()
            cursors = self.sessions.select(F.col("id").alias("session"), F.col("cursor").alias("_cursor"))
            mine = written(done.join(cursors, "session", "left").where(F.coalesce("_cursor", F.lit(0)) == F.col("from")).drop("_cursor"), "mine")
            own = mine.select("session")
            rows, judged = mems.join(own, "session", "left_semi"), verdicts.join(own, "session", "left_semi")
            tables, touched = {}, set()
            if not (rows.isEmpty() and judged.isEmpty()):
                about = self._of(judged)
                tables, _, touched = self._saved(rows, now, also=about)
                tables["memory"] = self._judged(tables["memory"], judged.select("id", "verdict"))
            moved = mine.where("plan <> 'defer' and error is null").select(F.col("session").alias("id"), "project_key", F.col("next").alias("line"), F.lit(0).alias("seq"))
            told = save.sessions_after(tables.get("sessions", self.sessions), moved, now)
            told = sessions.failing(told, mine.where("plan = 'extract'").select(F.col("session").alias("id"), "project_key", F.col("error").isNotNull().alias("failed"), "bytes"), now)
            if not mine.where("plan <> 'defer'").isEmpty():
                tables |= {"sessions": told, "projects": save.projects_after(tables.get("projects", self.table("projects")), moved, now)}
            if tables:
                self._put(draft, tables, touched)
            return mine

        out = self._change(run)
        paused = held.where(waits).select("session", F.lit("pause").alias("plan"), F.coalesce("cursor", F.lit(0)).alias("next"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("saved"))
        return out.select("session", "plan", "next", "total", "error", "saved").union(paused)

    def extract_all(self, turns: DataFrame, jobs: DataFrame, call=extraction.rule_based_extractor, budget: int = 24_000) -> int:
        """Chunk after chunk, as long as a session moved on and has more; the number of rounds."""
        rounds = 0
        while True:
            rounds += 1
            done = self.extract(turns, jobs, call, budget=budget)
            more = done.where("plan = 'extract' and error is null and next < total").select("session")
            if more.isEmpty():
                return rounds
            jobs = jobs.join(more, "session", "left_semi")

    def audit(self, lines: DataFrame, days: int = 7) -> DataFrame:
        """(id, unread) of the sessions touched lately whose transcripts, lines(path, lines), go on beyond the cursor."""
        recent = browse.newest_touched(self.sessions, self.clock() - days * 86_400)
        return recent.join(lines, "path").where(F.col("lines") > F.col("cursor")).select("id", (F.col("lines") - F.col("cursor")).alias("unread"))

    def reindex(self, apply: bool = False) -> DataFrame:
        """(id, stored, fresh): memories whose words or alias words differ from what the tokenizer gives now; put right if wanted."""
        none = F.array().cast("array<string>")
        args = F.col("title"), F.col("content"), F.coalesce("aliases", none)
        m = self.memory.select("id", F.coalesce("keywords", none).alias("kw"), F.coalesce("alias_only", none).alias("ao"), X.memory_keywords(*args).alias("keywords"), X.alias_only(*args).alias("alias_only"))
        plan = m.where((F.array_sort("kw") != F.array_sort("keywords")) | (F.array_sort("ao") != F.array_sort("alias_only")))
        plan = written(plan, "reindex")
        if apply:
            fresh = plan.select("id", F.col("keywords").alias("_kw"), F.col("alias_only").alias("_ao"))
            self._update(plan, lambda mem: mem.join(fresh, "id", "left").withColumns({"keywords": F.coalesce("_kw", "keywords"), "alias_only": F.coalesce("_ao", "alias_only")}).select(*mem.columns))
        return plan.select("id", F.size("kw").cast("long").alias("stored"), F.size("keywords").cast("long").alias("fresh"))

    def consolidate(self, merges: DataFrame) -> str | None:
        """Save each valid merge(label, merge_no, ids, title, kind, content) of a cluster as one memory that replaces its members.

        Returns the next version, or none if no merge is valid. Labels are those of consolidation_candidates.
        """

        def run(draft: Draft) -> str | None:
            now = self.clock()
            held = self.consolidation_candidates().select("label", "hash").join(self.live(), "hash")
            members = written(browse.with_entities(held, self.mentions.join(self.entities.select("entity_key", "name"), "entity_key")), "members")
            valid = cluster.valid_merges(merges, members.select("label", "id", "kind")).select("label", "merge_no")
            rows, pairs = cluster.canonical(merges.join(valid, ["label", "merge_no"]), members)
            rows = written(rows.withColumn("session", F.concat(F.lit("consolidate-"), F.date_format(F.timestamp_seconds(F.lit(now)), "yyyyMMdd"))), "canonical")
            if rows.isEmpty():
                return None
            tables, _, touched = self._saved(rows, now, also=members)
            keeper = save.staged(rows).select("label", "merge_no", F.col("id").alias("keeper"))
            m, edges = save.superseded_by(tables["memory"], pairs.join(keeper, ["label", "merge_no"]).select("keeper", "id"))
            self._put(draft, tables | {"memory": m, "replacements": tables["replacements"].unionByName(edges)}, touched)
            return draft.version

        return self._change(run)

    def backfill_aliases(self, call=browse.rule_based_aliases, prefix: str = "") -> str | None:
        """Ask call for aliases of the memories that never had any, and store them with their tokens."""
        a = browse.backfill(self.memory, call, prefix).withColumn("aliases", X.clean_aliases(F.col("aliases")))
        a = written(a.withColumn("tokens", X.tokenize(F.concat_ws(" ", "aliases"), 24)), "aliases")
        return self._update(a, lambda mem: write.set_aliases(mem, a))

    def dispute(self, ids: DataFrame, archive: bool = False) -> str | None:
        """Count a dispute against memories by hand and, if wanted, archive them."""
        verdicts = ids.select("id", F.lit("wrong").alias("verdict"))
        flagged = (lambda mem: write.set_flag(mem, ids, "archived", True)) if archive else (lambda mem: mem)
        return self._update(ids, lambda mem: flagged(self._judged(mem, verdicts)))

    def index(self) -> recall.Index:
        return recall.Index(*(self.table(n) for n in ("words", "names", "mentioned", "near")))

    def corpus(self) -> DataFrame:
        """The number of live memories, from the counts that saves keep."""
        return self.table("counts").where("kind = 'live'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def scored(self, prompt: str, project: str = "", extra: tuple[str, ...] = (), min_match: float = 0.0, most: int = 32) -> DataFrame:
        """Memories by score, of which the index names those that are read."""
        row = self.spark.range(1).select(X.tokenize(F.lit(prompt), most).alias("t")).first()
        tokens = [*row["t"], *extra]
        found = self.index()
        parts = found.keyword_hits(tokens), found.entity_hits(tokens), found.related_hits(tokens)
        return recall.merge_and_score(self.shown(), *parts, corpus=self.corpus(), now=self.clock(), project=project, min_match=min_match)

    def recall_all(self, prompts: DataFrame, k: int = 10, min_match: float = 0.0) -> DataFrame:
        """(pid, id, title, project_key, match, score, rank) for a table of prompts(pid, text, context, project); words of the context as `setwise.with_context` says."""
        found, corpus, now = self.index(), self.corpus(), self.clock()
        run = lambda p: setwise.best(found, self.shown(), p, corpus=corpus, now=now, k=k, min_match=min_match)
        out = written(setwise.with_context(run, prompts), "recalled")
        mem = recall.pruned(self.shown(), "hash", out.select("hash").distinct())
        return out.join(mem.select("hash", "id", "title", "content", "kind", "last_seen_at", "project_key"), "hash")

    def evaluate(self, cases: DataFrame, budget: int = 9500) -> tuple[DataFrame, DataFrame]:
        """(case_id, mode, hit, rank, recall, chars, ms) of cases(name, mode, prompt, context, cwd, expect), and the summary by mode.

        A hook case sees the block that fits the budget, over the floor; a search case the ten best. Cases run together, so ms is
        each one's share of the time.
        """
        began = time.time()
        p = cases.select(F.col("name").alias("pid"), F.col("mode"), F.col("prompt").alias("text"), "context", F.col("cwd").alias("project"), "expect")
        lines = lambda df: df.withColumn("line", recall.memory_line(self.clock()))
        order = [F.desc("score"), "id"]
        hook = recall.budgeted(lines(self.recall_all(p.where("mode = 'hook'"), MOST_LINES, 2.0)), order, "line", budget, by=("pid",))
        search = lines(self.recall_all(p.where("mode = 'search'"), 10)).withColumn("used_bytes", F.lit(0))
        seen = written(hook.select("pid", "rank", "title", "line").union(search.select("pid", "rank", "title", "line")), "evaluated")
        expected = p.select(F.col("pid").alias("case_id"), F.explode("expect").alias("item"))
        held = evaluate.scored_cases(expected, seen.select(F.col("pid").alias("case_id"), "title", F.col("rank").alias("pos")))
        size = seen.groupBy(F.col("pid").alias("case_id")).agg(F.sum(F.octet_length("line") + 1).alias("chars"))
        held = held.join(p.select(F.col("pid").alias("case_id"), "mode"), "case_id").join(size, "case_id", "left")
        ms = int(1000 * (time.time() - began) / max(p.count(), 1))
        held = written(held.select("case_id", "mode", "hit", "rank", "recall", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), F.lit(ms).cast("long").alias("ms")), "cases")
        return held, evaluate.summary(held)

    def search(self, query: str, project: str = "", limit: int = 10, offset: int = 0) -> DataFrame:
        """A page of results; no floor."""
        return recall.ranked(self.scored(query, project), limit if 1 <= limit <= 50 else 10, offset)

    def retrieve(self, prompt: str, project: str = "", shown: DataFrame | None = None, budget: int = 9500, min_match: float = 2.0) -> DataFrame:
        """Lines of the context block: over the floor, not shown before, the prefix that fits the budget."""
        s = self.scored(prompt, project, min_match=min_match)
        s = recall.excluding(s, shown) if shown is not None else s
        return recall.budgeted(s.withColumn("line", recall.memory_line(self.clock())), [F.desc("score"), "id"], "line", budget)

    def block(self, prompt: str, project: str = "", shown: DataFrame | None = None, budget: int = 9500, min_match: float = 2.0, rules: int = 50) -> DataFrame:
        """The lines of a block: what the prompt recalls, then the standing rules, each under its header, as far as they fit."""
        s = self.scored(prompt, project, min_match=min_match)
        s = recall.excluding(s, shown) if shown is not None else s
        lines = lambda df: df.withColumn("line", recall.memory_line(self.clock()))
        mem, rule = recall.SECTIONS
        return recall.sectioned([(mem, lines(s), [F.desc("score"), "id"]), (rule, lines(self.rules(project, rules)), recall.rule_order(project))], "line", budget)

    def write_rules(self, name: str = "RULES.md") -> bool:
        """A file of the store with the pinned rules and preferences, written only if it changes; whether it did."""
        lines = [r["line"] for r in recall.standing_lines(self.live()).orderBy("place").collect()]
        return self.store.write_lines(name, ["# Standing rules, written by the engine; changes here are lost.", *([""] if lines else []), *lines])

    def _judged(self, mem: DataFrame, verdicts: DataFrame) -> DataFrame:
        f = write.feedback(verdicts.select(F.col("id").alias("ref"), "verdict", F.lit(self.clock()).cast("long").alias("at")))
        m = mem.join(f.withColumnRenamed("ref", "id"), "id", "left")
        m = m.withColumns({
            "used_count": F.col("used_count") + F.coalesce("used", F.lit(0)),
            "disputed_count": F.col("disputed_count") + F.coalesce("disputed", F.lit(0)),
            "last_used_at": F.coalesce("last_used", "last_used_at"),
        })
        return m.select(*mem.columns)

    def feedback(self, verdicts: DataFrame) -> str | None:
        """Count verdicts(id, verdict) into the memories."""
        return self._update(verdicts, lambda mem: self._judged(mem, verdicts))

    def pin(self, ids: DataFrame, value: bool = True) -> str | None:
        return self._update(ids, lambda mem: write.set_flag(mem, ids, "pinned", value, browse.STANDING))

    def archive(self, ids: DataFrame) -> str | None:
        return self._update(ids, lambda mem: write.set_flag(mem, ids, "archived", True))

    def stale(self, least_injected: int = 20, days: int = 30, apply: bool = False) -> DataFrame:
        """Live memories that were shown often, never used and not seen for so many days; archived if wanted."""
        held = self.live().withColumns({"injected": F.col("injected_count"), "used": F.col("used_count")})
        out = written(write.archive_candidates(held, least_injected, self.clock() - days * 86_400).select("id", "title", "injected"), "stale")
        if apply:
            self.archive(out)
        return out

    def mark_injected(self, shown: DataFrame) -> str | None:
        """Count shown(id, at), a row per showing, into the memories."""
        n = write.injected(shown.select(F.col("id").alias("ref"), "at")).select(F.col("ref").alias("id"), "injected")
        counted = F.col("injected_count") + F.coalesce("injected", F.lit(0))
        return self._update(shown, lambda mem: mem.join(n, "id", "left").withColumn("injected_count", counted).select(*mem.columns))

    def learn(self, shown: DataFrame, verdicts: DataFrame, cap: int = 20) -> str | None:
        """Memories that only a search found, and that were used, take words of that search as aliases, while they have under `cap`.

        shown(session, ref, us, event_id, via, query, title, content) and verdicts(session, ref, verdict); ref is a memory's id.
        """
        t = sessions.learned_terms(shown, verdicts).groupBy(F.col("ref").alias("id")).agg(F.sort_array(F.collect_set(F.struct("session", "terms"))).alias("by_session"))
        t = t.select("id", F.array_distinct(F.flatten(F.transform("by_session", lambda x: x["terms"]))).alias("aliases"))
        t = written(t.withColumn("tokens", X.tokenize(F.concat_ws(" ", "aliases"), 24)), "learned")
        return self._update(t, lambda mem: write.set_aliases(mem, t, cap))

    def similar(self, turns: DataFrame, project: str = "", k: int = 12, min_match: float = 2.0, most: int = 300) -> DataFrame:
        """The memories that are closest to turns(line, text): the words of the newest turns come first."""
        texts = turns.orderBy(F.desc("line")).limit(most)  # a turn without words is rare: one a word is enough
        text = texts.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("line", "text")))), lambda x: x["text"]), "\n").alias("t")).first()["t"]
        return recall.ranked(self.scored(text or "", "", min_match=min_match, most=most), k)

    def session_start(self, project: str, home: str = "", budget: int = 8_000) -> tuple[DataFrame, DataFrame]:
        """Lines of the rules and preferences that apply here, as many as fit, and a line on those that do not."""
        held = recall.here_set(self.live().withColumn("project_key", F.coalesce("repo_key", "project_key")), project, home)
        lines = recall.session_rules(held.where("kept"), project).withColumn("line", recall.memory_line(self.clock()))
        order = ["group_no", F.desc("seen_count"), F.desc("last_seen_at"), "id"]
        return recall.budgeted(lines, order, "line", budget).orderBy(*order).select("id", "group_no", "line"), browse.skipped_footer(held)

    def entity(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The entities of a name, their neighbours, and the memories that mention them."""
        ents, ment = self.entities, self.mentions
        return graph.entity_nodes(ents, ment, name, grams=self.table("grams")), graph.entity_relations(ents, self.related, name), graph.entity_memories(ents, ment, self.memory, name)

    def targets(self, query: str, kinds: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
        """Live memories of that id, or whose title holds the query."""
        return browse.targets(self.live(), query, kinds, limit, self.table("grams"))

    def sweep(self, path: str, idle: int = 180, final: int = 1800, days: int = 7, adopt: bool = False) -> DataFrame:
        """(id, path, unread, final, known): sessions whose transcripts below a folder changed since they were read, and have been left alone since.

        Times and lengths of all files are joined with the sessions; only files that changed are read, to count their lines (an
        unterminated last one does not count). Files of no session are sessions that were missed: adopted, they are noted
        from their first line on.
        """
        now = self.clock()
        files = tails.file_times(self.spark, path).withColumn("idle", F.lit(now) - F.col("changed"))
        files = files.where((F.col("idle") >= idle) & (F.col("idle") <= days * 86_400)).withColumn("_at", F.regexp_replace("path", "^file:/*", "/"))
        held = self.sessions.where("coalesce(path, '') <> ''").select("id", F.regexp_replace("path", "^file:/*", "/").alias("_own"), "cursor", "updated_at", "agent")
        held = files.join(held, F.col("_at") == F.col("_own"), "left").where("id is null or updated_at is null or changed > updated_at")
        held = written(held.withColumns({"known": F.col("id").isNotNull(), "id": F.coalesce("id", F.regexp_replace(X.basename(F.col("path")), r"\.jsonl$", ""))}), "sweep")
        stale = [r["path"] for r in held.orderBy(F.desc("changed"), "path").select("path").limit(SWEPT).collect()]
        if stale:
            text = self.spark.read.text(stale, wholetext=True).select(F.col("_metadata.file_path").alias("_f"), transcripts.line_count(F.col("value")).alias("lines"))
        else:
            text = self.spark.createDataFrame([], "_f string, lines int")
        text = text.select(F.regexp_replace(F.url_decode(F.replace("_f", F.lit("+"), F.lit("%2B"))), "^file:/*", "/").alias("_f"), "lines")
        out = held.join(text, F.col("_at") == F.col("_f")).withColumn("unread", F.col("lines") - F.coalesce("cursor", F.lit(0))).where("unread > 0")
        out = written(out.select("id", F.col("_at").alias("path"), F.col("unread").cast("long").alias("unread"), (F.col("idle") >= final).alias("final"), "known", "changed"), "swept")
        if adopt and not out.where("not known").isEmpty():
            self.touch(out.where("not known").select("id", F.lit("").alias("project_key"), "path", F.lit("").alias("cwd"), F.lit(False).alias("agent"), F.col("changed").alias("at")))
        return out.drop("changed")

    def rules(self, project: str, k: int = 50) -> DataFrame:
        return recall.sorted_rules(self.live().withColumn("project_key", F.coalesce("repo_key", "project_key")), project, k)

    def entity_list(self, limit: int = 50, project: str = "") -> DataFrame:
        return graph.entity_list(self.entities, self.mentions, limit if 0 < limit <= 500 else 50, project)

    def stats(self) -> DataFrame:
        return graph.project_stats(self.memory, self.entities, self.sessions)

    def consolidation_candidates(self) -> DataFrame:
        return cluster.clusters(self.live(), self.mentions)

    def export(self, path: str) -> None:
        """All tables as gzipped JSON lines, a folder each; what searches look up is left out, as it follows from them."""
        for name in TABLES:
            if name not in index.TABLES:
                self.table(name).write.option("compression", "gzip").json(f"{path.rstrip('/')}/{name}")

    def load(self, path: str) -> str:
        """The tables of an export as the first version of this store, which has to be empty."""

        def run(draft: Draft) -> str:
            if draft.base:
                raise ValueError("the store is not empty")
            self._put(draft, {n: self.spark.read.schema(kind).json(f"{path.rstrip('/')}/{n}") for n, kind in TABLES.items() if n not in index.TABLES})
            return draft.version

        return self._change(run)

    def backups(self) -> list[str]:
        return self.store.versions()

    def restore(self, version: str) -> None:
        self.store.point(version)
