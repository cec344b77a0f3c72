"""Transcript logs (JSON lines) as turns: content is a string or a list of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions.text import clip_message, same_reply

_BLOCK = "array<struct<type:string,text:string,name:string,id:string,tool_use_id:string,content:string,input:map<string,string>>>"
_ENVELOPE = "type string, uuid string, isSidechain boolean, isMeta boolean, isApiErrorMessage boolean, cwd string, entrypoint string, sessionId string, message struct<role:string,content:string>, attachment struct<type:string,prompt:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, at, value): numbered lines, without blank ones, and the byte each starts at. Long files are read in parts.

    Lines keep their order within a part of a file; what precedes a part is counted per part.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    raw = raw.withColumn("size", F.octet_length("value") + 1)
    n = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    n = n.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    here = W.partitionBy("file", "block").orderBy("seq")
    held = raw.withColumns({"place": F.row_number().over(here) - 1, "start": F.sum("size").over(here.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
    out = held.join(n, ["file", "block"]).select("file", (F.col("n") + F.col("place")).cast("int").alias("line"), (F.col("b") + F.col("start")).alias("at"), "value")
    return out.where("value <> ''")


def tail(lines: DataFrame, most: int) -> DataFrame:
    """The whole lines within the last bytes of each file; a line cut by the limit is left out."""
    end = lines.groupBy("file").agg(F.max(F.col("at") + F.octet_length("value") + 1).alias("_end"))
    return lines.join(end, "file").where(F.col("at") >= F.col("_end") - most).drop("_end")


def line_count(value: Column) -> Column:
    """Line ends in a text; an unterminated last line does not count."""
    return F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))


def text_of(content: Column) -> Column:
    """Text of a message: the string itself, or its text blocks joined by line ends."""
    blocks = F.from_json(content, _BLOCK)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.trim(b["text"]) != "")), lambda b: b["text"]), "\n")
    return F.when(content.startswith("["), joined).otherwise(content)


def tool_lines(content: Column, cap: int = 8) -> Column:
    """Short notes on the tools a turn used: the path, else the description, else the name."""
    blocks = F.filter(F.from_json(content, _BLOCK), lambda b: b["type"] == "tool_use")
    note = lambda b: F.concat_ws(" ", b["name"], F.coalesce(b["input"]["file_path"], b["input"]["path"], F.left(b["input"]["description"], F.lit(100))))
    return F.when(content.startswith("["), F.slice(F.transform(blocks, note), 1, cap))


def _real(lines: DataFrame) -> DataFrame:
    """The envelopes of lines but for side chains, meta and errors."""
    j = lines.select("file", "line", F.from_json("value", _ENVELOPE).alias("j")).select("file", "line", "j.*")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return j.where(F.col("type").isin("user", "assistant") & no("isSidechain") & no("isMeta") & no("isApiErrorMessage"))


def subagent_reports(lines: DataFrame) -> DataFrame:
    """(file, line, session, text): results of agents that were called before in these lines."""
    real = _real(lines).select("file", "line", F.col("sessionId").alias("session"), "type", F.explode(F.from_json("message.content", _BLOCK)).alias("b"))
    calls = real.where("type = 'assistant' and b.type = 'tool_use' and b.name in ('Agent', 'Task') and b.id <> ''").groupBy(F.col("file").alias("_f"), F.col("b.id").alias("_id")).agg(F.min("line").alias("_at"))
    parts = real.where("type = 'user' and b.type = 'tool_result'").withColumn("text", F.trim(text_of(F.col("b.content")))).where("text <> '' and not startswith(text, 'Async agent launched')")
    met = parts.join(calls, (F.col("file") == F.col("_f")) & (F.col("b.tool_use_id") == F.col("_id")) & (F.col("_at") < F.col("line")))
    return met.groupBy("file", "line").agg(F.first("session").alias("session"), F.concat(F.lit("Subagent report: "), F.array_join(F.collect_list("text"), "\n\n")).alias("text"))


def last_turn_search(lines: DataFrame, tool: str) -> DataFrame:
    """(file, prompt, searched): the last real prompt of each file, and whether the tool was called after it."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    j = lines.select("file", "line", F.from_json("value", _ENVELOPE).alias("j")).select("file", "line", "j.*").where(no("isSidechain") & no("isMeta"))
    content = F.col("message.content")
    blocks = F.when(content.startswith("["), F.from_json(content, _BLOCK))
    has = lambda kind: F.coalesce(F.exists(blocks, kind), F.lit(False))
    text = F.trim(F.coalesce(text_of(content), F.lit("")))
    wrapped = text.startswith("<task-notification") | text.startswith("<local-command") | text.startswith("Caveat:")
    prompt = (F.col("type") == "user") & ~has(lambda b: b["type"] == "tool_result") & (text != "") & ~wrapped
    called = (F.col("type") == "assistant") & has(lambda b: (b["type"] == "tool_use") & (b["name"] == tool))
    held = j.select("file", "line", "uuid", prompt.alias("prompt"), called.alias("called"))
    last = held.groupBy("file").agg(F.max(F.when(F.col("prompt"), F.col("line"))).alias("at"), F.max_by("uuid", F.when(F.col("prompt"), F.col("line"))).alias("id"), F.max(F.when(F.col("called"), F.col("line"))).alias("call"))
    return last.select("file", F.coalesce("id", F.lit("")).alias("prompt"), F.coalesce(F.col("call") > F.coalesce("at", F.lit(-1)), F.lit(False)).alias("searched"))


def final_reply(lines: DataFrame, replies: DataFrame, most: int = 512 * 1024) -> DataFrame:
    """(file, there): whether the last assistant text in the tail of a file begins like replies(file, reply)."""
    spoken = turns(tail(lines, most)).where("role = 'assistant' and text <> ''").groupBy("file").agg(F.max_by("text", "line").alias("last"))
    return replies.join(spoken, "file", "left").select("file", same_reply(F.coalesce("last", F.lit("")), F.col("reply")).alias("there"))


def turns(lines: DataFrame) -> DataFrame:
    """(file, line, session, role, text, tools) of real turns: no side chains, meta, errors or wrappers; reports of agents are
    the assistant's. Long texts lose their middle."""
    j = lines.select("file", "line", F.from_json("value", _ENVELOPE).alias("j")).select("file", "line", "j.*")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    queued = (F.col("type") == "attachment") & (F.col("attachment.type") == "queued_command")
    kept = j.where((F.col("type").isin("user", "assistant") & no("isSidechain") & no("isMeta") & no("isApiErrorMessage")) | queued)
    content = F.when(queued, F.col("attachment.prompt")).otherwise(F.col("message.content"))
    text = text_of(content)
    command = F.regexp_extract(text, r"(?s)<command-name>/?([^<]*)</command-name>", 1)
    args = F.trim(F.regexp_extract(text, r"(?s)<command-args>([^<]*)</command-args>", 1))
    spoken = F.when((command != "") & (args != ""), F.concat_ws(" ", command, args)).when(text.rlike(r"(?s)^\s*<(command-|local-command|system-reminder)"), "").otherwise(text)
    out = kept.select("file", "line", F.col("sessionId").alias("session"), F.when(queued, "user").otherwise(F.col("type")).alias("role"), spoken.alias("text"), tool_lines(content).alias("tools"))
    out = out.where((F.trim("text") != "") | (F.size("tools") > 0))
    reports = subagent_reports(lines).select("file", "line", "session", F.lit("assistant").alias("role"), "text", F.lit(None).cast("array<string>").alias("tools"))
    own = out.join(reports.select("file", "line"), ["file", "line"], "left_anti").select(*reports.columns)
    return own.unionByName(reports).withColumn("text", clip_message(F.col("text")))


def metadata(lines: DataFrame) -> DataFrame:
    """(file, cwd, headless): the first of fifty lines that names a folder, and whether a program drove the session."""
    j = lines.where("line < 50").select("file", "line", F.from_json("value", _ENVELOPE).alias("j"))
    return j.groupBy("file").agg(F.min_by("j.cwd", F.when(F.col("j.cwd").isNotNull(), F.col("line"))).alias("cwd"), F.coalesce(F.bool_or(F.col("j.entrypoint").startswith("sdk")), F.lit(False)).alias("headless"))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries; blank and # lines are skipped, an unknown mode is an error."""
    raw = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    c = raw.select(F.from_json("value", "name string, mode string, prompt string, context string, cwd string, expect array<string>").alias("c")).select("c.*")
    return c.withColumn("mode", F.when(F.col("mode").isin("hook", "search"), F.col("mode")).otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), F.coalesce("mode", F.lit("null"))))))
