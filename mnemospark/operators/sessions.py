"""Transcripts and per-session state as batch queries: chunks, debounce, shown log, gate, learning, reports, sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions.text import clip_chars, tokenize, trimmed


def chunk_no(turns: DataFrame, budget: int | Column, by: str = "session") -> DataFrame:
    """The first chunk of each session from its cursor: turns while their bytes fit, and one at least."""
    w = W.partitionBy(by).orderBy("line")
    used = F.sum(F.octet_length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumns({"used": used, "rn": F.row_number().over(w)}).where((F.col("used") <= budget) | (F.col("rn") == 1)).drop("rn")


def chunk_summary(turns: DataFrame, budget: int) -> DataFrame:
    """(session, taken, bytes, next, total): next is the line of the first turn left out, else the line count."""
    total = turns.groupBy("session").agg((F.max("line") + 1).alias("total"))
    got = chunk_no(turns, budget).groupBy("session").agg(F.count("*").alias("taken"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.max("line").alias("last"))
    after = turns.join(got, "session").where(F.col("line") > F.col("last")).groupBy("session").agg(F.min("line").alias("next"))
    return total.join(got, "session").join(after, "session", "left").select("session", "taken", "bytes", F.coalesce("next", "total").alias("next"), "total")


def last_exchange(turns: DataFrame, clip: int = 4000) -> DataFrame:
    """(session, text): the last user turn and the last assistant turn, clipped together."""
    text = lambda role: F.max_by(F.when((F.col("role") == role) & (F.col("text") != ""), F.col("text")), F.when((F.col("role") == role) & (F.col("text") != ""), F.col("line"))).alias(role)
    both = turns.groupBy("session").agg(text("user"), text("assistant"))
    none = lambda c: F.coalesce(c, F.lit(""))
    return both.select("session", clip_chars(trimmed(F.concat(none("user"), F.lit("\n"), none("assistant"))), clip).alias("text"))


def from_cursor(turns: DataFrame, cursors: DataFrame) -> DataFrame:
    """Turns from each session's cursor on; a cursor beyond the end starts over. turns(session, line, ...), cursors(session, cursor)."""
    total = turns.groupBy("session").agg((F.max("line") + 1).alias("_total"))
    at = total.join(cursors, "session", "left").select("session", F.when(F.col("cursor") <= F.col("_total"), F.col("cursor")).otherwise(0).alias("_from"))
    return turns.join(at, "session").where(F.col("line") >= F.coalesce("_from", F.lit(0))).drop("_from")


def delta_plan(deltas: DataFrame, least: int = 200) -> Column:
    """advance without turns, defer a short delta unless it is final or an agent's, else extract. deltas: n, bytes, final, agent."""
    del deltas
    return F.when(F.col("n") == 0, "advance").when((F.col("bytes") < least) & ~F.col("final") & ~F.col("agent"), "defer").otherwise("extract")


def debounced(events: DataFrame, gap_us: int) -> DataFrame:
    """(session, started, fires, n): bursts of events, each firing a gap after its last one."""
    w = W.partitionBy("session").orderBy("us", "event_id")
    new = F.coalesce(F.col("us") - F.lag("us").over(w) > gap_us, F.lit(True)).cast("long")
    held = events.withColumn("new", new).withColumn("burst", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return held.groupBy("session", "burst").agg(F.min("us").alias("started"), (F.max("us") + gap_us).alias("fires"), F.count("*").alias("n")).drop("burst")


def since_reset(events: DataFrame, reset: Column) -> DataFrame:
    """events with the number of resets before or at each: equal numbers belong to one life of the session."""
    w = W.partitionBy("session").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("life", F.sum(reset.cast("long")).over(w))


def shown_log(events: DataFrame) -> DataFrame:
    """(session, ref, at, via): what the current life of each session was shown; view: pushed, click: by search."""
    lives = since_reset(events, F.col("event_type") == "signup")
    current = lives.withColumn("now", F.max("life").over(W.partitionBy("session")))
    return current.where("life = now and event_type in ('view', 'click')").select("session", "ref", "us", "event_id", F.when(F.col("event_type") == "click", "search").otherwise("").alias("via"))


def seen(shown: DataFrame, size: int = 200) -> DataFrame:
    """Distinct refs a session was pushed, of the last `size` entries of its log; search hits count as entries only."""
    return ring(shown, size).where("via = ''").select("session", "ref").distinct()


def since(shown: DataFrame, at: int) -> DataFrame:
    """Entries from a time on, search hits too, oldest first."""
    return shown.where(F.col("us") >= at).orderBy("session", "us", "event_id")


def active(shown: DataFrame, now: int, idle_us: int = 24 * 3600 * 1_000_000) -> DataFrame:
    """The log without sessions that were idle for too long."""
    last = shown.groupBy("session").agg(F.max("us").alias("_last")).where(F.lit(now) - F.col("_last") <= idle_us)
    return shown.join(last.select("session"), "session", "left_semi")


def ring(shown: DataFrame, size: int) -> DataFrame:
    """The last `size` entries of each session."""
    w = W.partitionBy("session").orderBy(F.desc("us"), F.desc("event_id"))
    return shown.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size).withColumn("place", F.col("place").cast("long"))


#: How long a turn of the gate is remembered.
DAY_US = 24 * 3600 * 1_000_000


def gate_turns(calls: DataFrame, window_us: int = DAY_US) -> DataFrame:
    """(session, ref, at, searched, fired) of calls(session, ref, us, event_id, searched): the gate of each prompt.

    It fires at the first call that finds it neither searched nor fired; a turn is forgotten `window_us` after its
    first call. A prompt without a name passes. The calls of one prompt in one session are few and are folded in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("us", "event_id", "searched")))
    held = calls.where("ref is not null and session is not null").groupBy("session", "ref").agg(ordered.alias("calls"))
    turn = lambda at, searched, fired: F.struct(at.alias("at"), searched.alias("searched"), fired.alias("fired"))
    none = F.array().cast("array<struct<at:bigint,searched:boolean,fired:boolean>>")

    def step(turns: Column, call: Column) -> Column:
        last = F.get(turns, F.size(turns) - 1)
        fresh = F.coalesce(call["us"] - last["at"] > window_us, F.lit(True))
        searched = call["searched"] | last["searched"]
        again = F.concat(F.slice(turns, 1, F.size(turns) - 1), F.array(turn(last["at"], searched, last["fired"] | ~searched)))
        return F.when(fresh, F.concat(turns, F.array(turn(call["us"], call["searched"], ~call["searched"])))).otherwise(again)

    return held.select("session", "ref", F.explode(F.aggregate("calls", none, step)).alias("t")).select("session", "ref", "t.*")


def gate_calls(events: DataFrame) -> DataFrame:
    """Views are stops of a turn, clicks its searches; the prompt is what they refer to."""
    return events.where("event_type in ('view', 'click')").select("session", "ref", "us", "event_id", (F.col("event_type") == "click").alias("searched"))


def gate_stats(turns: DataFrame, *by: str, since: int | None = None) -> DataFrame:
    held = turns if since is None else turns.where(F.col("at") >= since)
    return held.groupBy(*by).agg(F.count("*").alias("prompts"), F.sum(F.col("searched").cast("long")).alias("searched"), F.sum(F.col("fired").cast("long")).alias("fired"))


def gate(events: DataFrame) -> DataFrame:
    """(session, prompts, searched, fired) over the remembered turns of each session."""
    return gate_stats(gate_turns(gate_calls(events)), "session")


def searched_only(shown: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(session, ref) graded used that the session saw by search alone."""
    used = verdicts.where("verdict = 'used'").select("session", "ref").distinct()
    by = lambda via: shown.where(F.col("via") == via).select("session", "ref")
    return used.join(by("search"), ["session", "ref"], "left_semi").join(by(""), ["session", "ref"], "left_anti")


def novel_terms(query: Column, title: Column, content: Column, cap: int = 3) -> Column:
    """Words of a query that a memory's own text lacks, three letters or more."""
    fresh = F.filter(tokenize(query, 24), lambda t: F.length(t) >= 3)
    return F.slice(F.array_except(fresh, tokenize(F.concat_ws(" ", title, content), 200)), 1, cap)


def learned_terms(shown: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(session, ref, terms): what memories that only a search found, and that were used, learn from their last query.

    shown(session, ref, us, event_id, via, query, title, content).
    """
    only = searched_only(shown, verdicts)
    last = shown.where("via = 'search'").groupBy("session", "ref").agg(F.max_by(F.struct("query", "title", "content"), F.struct("us", "event_id")).alias("s"))
    return only.join(last, ["session", "ref"]).select("session", "ref", novel_terms(F.col("s.query"), F.col("s.title"), F.col("s.content")).alias("terms")).where(F.size("terms") > 0)


def learning_stats(runs: DataFrame, since: int) -> DataFrame:
    """Sums of runs(at, used, search_only, learned) from a time on."""
    return runs.where(F.col("at") >= since).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("used", "search_only", "learned")))


def drained(reports: DataFrame, now: int, ring_size: int = 4, ttl: int = 30 * 60) -> DataFrame:
    """(session, batches, ms, count, new, error, status) of what has not been reported: the last reports, none too old.

    reports(session, at, seq, reported, ms, error, skipped, n, n_new).
    """
    w = W.partitionBy("session").orderBy(F.desc("at"), F.desc("seq"))
    held = reports.withColumn("place", F.row_number().over(w)).where((F.col("place") <= ring_size) & ~F.col("reported") & (F.lit(now) - F.col("at") <= ttl))
    order = F.struct("at", "seq")
    last = lambda c, kept: F.max_by(F.when(kept, F.col(c)), F.when(kept, order))
    deferred = F.col("skipped").startswith("deferred")
    out = held.groupBy("session").agg(F.count("*").alias("batches"), F.max_by("ms", order).alias("ms"), F.sum("n").alias("count"), F.sum("n_new").alias("new"),
        last("error", F.col("error") != "").alias("error"), F.bool_or(deferred).alias("_deferred"), F.bool_or(F.col("skipped") != "").alias("_skipped"))
    status = F.when(F.col("count") > 0, "").when(F.col("_deferred"), "deferred").when(F.col("_skipped"), "skipped").otherwise("")
    return out.withColumn("status", status).drop("_deferred", "_skipped")


def last_reports(reports: DataFrame, n: int = 4) -> DataFrame:
    """The last n reports of each session with their place, newest first."""
    w = W.partitionBy("session").orderBy(F.desc("us"), F.desc("event_id"))
    return reports.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def behind(sessions: DataFrame, idle_us: int, final_us: int, horizon_us: int) -> DataFrame:
    """Sessions(session, idle, cursor, lines) idle for long enough with unread lines, and whether for good."""
    idle = F.col("idle")
    return sessions.where((idle >= idle_us) & (idle <= horizon_us) & (F.col("lines") > F.col("cursor"))).select("session", "cursor", "lines", (idle >= final_us).alias("final"))


def cooldown_minutes(failures: Column) -> Column:
    """No pause before the third failure, then 30 minutes doubled per failure, six times at most and a day at most."""
    return F.when(failures < 3, 0).otherwise(F.least(F.lit(1440), 30 * F.pow(F.lit(2), F.least(failures - 3, F.lit(6))))).cast("long")


def failing(sessions: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """Sessions after runs(id, project_key, failed, bytes): a failure halves the next chunk and may pause the session, a success clears that."""
    r = runs.select("id", F.col("project_key").alias("_p"), F.col("failed").alias("_failed"), F.col("bytes").alias("_bytes"))
    s = sessions.join(r, "id", "full")
    n = F.coalesce("fails", F.lit(0)) + 1
    pause = cooldown_minutes(n) * 60
    told = lambda failed, c: F.when(F.col("_failed"), failed).when(F.col("_failed").isNull(), F.col(c)).cast("long")
    return s.withColumns({
        "project_key": F.coalesce("project_key", "_p"),
        "agent": F.coalesce("agent", F.lit(False)),
        "cursor": F.coalesce("cursor", F.lit(0)).cast("long"),
        "started_at": F.coalesce("started_at", F.lit(now)).cast("long"),
        "paused_until": told(F.when(pause > 0, F.lit(now) + pause), "paused_until"),
        "room": told(F.greatest(F.floor(F.col("_bytes") / 2), F.lit(1)), "room"),
        "fails": told(n, "fails"),
    }).select(*sessions.columns)
