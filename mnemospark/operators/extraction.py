"""Extractor replies (JSON) to memories: validation, clipping, operation and trust policy."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import clean_aliases, clip_chars, slice_json
from mnemospark.operators import sessions

#: The kinds a memory may have, and the verdicts on a shown one.
KINDS, VERDICTS = ("fact", "decision", "preference", "rule", "reference"), ("used", "wrong", "outdated")
REPLY = "memories array<struct<title:string,content:string,type:string,entities:array<struct<name:string,type:string>>,relations:array<array<string>>,aliases:array<string>,op:string,target_id:string>>, feedback array<struct<id:string,verdict:string>>"


def parsed(reply: Column) -> Column:
    return F.from_json(slice_json(reply), REPLY)


def memories(replies: DataFrame, foreign: Column, known: Column) -> DataFrame:
    """replies(reply_id, reply) to memories(reply_id, pos, ...): eight at most, clipped, with a settled operation.

    An update of an unknown id is an addition, a no-op on one is dropped. Foreign sessions only add, and
    their rules and preferences are facts.
    """
    rows = replies.select("reply_id", foreign.alias("foreign"), known.alias("known"), F.posexplode(F.slice(parsed(F.col("reply"))["memories"], 1, 8)).alias("pos", "m"))
    kind = F.when(F.col("m.type").isin(*KINDS), F.col("m.type")).otherwise("fact")
    kind = F.when(F.col("foreign") & kind.isin("rule", "preference"), "fact").otherwise(kind)
    asked, target = F.lower(F.trim("m.op")), F.trim("m.target_id")
    op = F.when(asked.isin("update", "noop"), asked).otherwise("add")
    hit = F.coalesce(F.array_contains("known", target), F.lit(False))
    op = F.when(F.col("foreign") & (op != "add"), F.when(op == "noop", "drop").otherwise("add")).when(hit, op).otherwise(F.when(op == "noop", "drop").otherwise("add"))
    entities = F.slice(F.filter("m.entities", lambda e: F.trim(e["name"]) != ""), 1, 10)
    relations = F.slice(F.filter("m.relations", lambda r: F.size(r) == 3), 1, 12)
    out = rows.select("reply_id", "pos", F.trim("m.title").alias("title"), clip_chars(F.trim("m.content"), 1500).alias("content"), kind.alias("kind"), entities.alias("entities"), relations.alias("relations"),
        clean_aliases(F.coalesce("m.aliases", F.array().cast("array<string>"))).alias("aliases"), op.alias("op"), F.when(op.isin("update", "noop"), target).alias("target_id"))
    return out.where((F.col("op") != "drop") & (F.col("content") != "") & (F.col("title") != ""))


def verdicts(replies: DataFrame, foreign: Column, shown: Column) -> DataFrame:
    """(reply_id, id, verdict): known verdicts on shown memories, none from foreign sessions."""
    rows = replies.where(~foreign).select("reply_id", shown.alias("shown"), F.explode(parsed(F.col("reply"))["feedback"]).alias("f"))
    return rows.where(F.col("f.verdict").isin(*VERDICTS) & F.array_contains("shown", F.col("f.id"))).select("reply_id", "f.id", "f.verdict")


def deltas(turns: DataFrame, jobs: DataFrame, cursors: DataFrame, budget: int, rooms: DataFrame | None = None) -> DataFrame:
    """What is to be done for each of jobs(session, project_key, final, agent): the chunk from its cursor on and the plan.

    (session, project_key, agent, n, bytes, next, total, plan, prompt). The chunk is the part of the transcript that fits the budget,
    so a prompt is bounded by that and one turn. rooms(session, room) are smaller budgets of sessions that failed.
    """
    total = turns.groupBy("session").agg((F.max("line") + 1).cast("long").alias("total"))
    ahead = sessions.from_cursor(turns.join(jobs.select("session"), "session", "left_semi"), cursors)
    chunk = sessions.chunk_no(ahead if rooms is None else ahead.join(rooms, "session", "left"), F.lit(budget) if rooms is None else F.least(F.lit(budget), "room"))
    said = F.sort_array(F.collect_list(F.struct("line", F.concat("role", F.lit(": "), "text").alias("said"))))
    got = chunk.groupBy("session").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.max("line").alias("last"), said.alias("said"))
    after = ahead.join(got.select("session", "last"), "session").where(F.col("line") > F.col("last")).groupBy("session").agg(F.min("line").cast("long").alias("after"))
    d = jobs.join(total, "session", "left").join(got, "session", "left").join(after, "session", "left")
    d = d.withColumns({"n": F.coalesce("n", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    prompt = F.array_join(F.transform("said", lambda s: s["said"]), "\n")
    return d.select("session", "project_key", "agent", "n", "bytes", F.coalesce("after", "total").alias("next"), "total", sessions.delta_plan(d).alias("plan"), prompt.alias("prompt"))


def rule_based_extractor(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model that extracts memories: standing wishes and decisions that users state in a line."""
    signs = (("rule", r"\b(always|never|must)\b"), ("preference", r"\bprefer\b"), ("decision", r"\b(decided|we will)\b"))

    def found(prompt: str) -> str:
        out = []
        for line in (prompt or "").split("\n"):
            text = line.removeprefix("user: ").strip()
            kind = next((k for k, sign in signs if re.search(sign, text, re.IGNORECASE)), None)
            if kind and line.startswith("user: "):
                names = [{"name": n, "type": "term"} for n in re.findall(r"`([^`]+)`", text)]
                out.append({"title": " ".join(text.split()[:8]), "content": text, "type": kind, "op": "add", "entities": names, "relations": [], "aliases": []})
        return json.dumps({"memories": out, "feedback": []})

    return pd.DataFrame({"session": batch["session"], "reply": [found(p) for p in batch["prompt"]]})
