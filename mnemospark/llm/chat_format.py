"""Chat formatting by quotation linking.

Quote levels are the leading `>` marks of lines. Runs of lines of one level are passages; their normalised
text (lower case, letters and digits only, single spaces) is hashed. Quoted passages are joined to the
messages that hold them as own text: in the same conversation the earliest one, else the earliest of all,
if it precedes the quoting message. The message whose passages are quoted most at the lowest level is the
parent; where no whole passage of a level is found, its single lines count instead, so that a trimmed quote
links too. Threads follow by doubling of the parent pointers.

A conversation is made of the threads that start in it, in order of their first turns, each in order of its
messages: every reply stands behind what it answers, and turns that quote nothing keep their order. Its messages
are rows with their place, never gathered. Bodies keep the unquoted lines.

A passage that a third of all messages share costs a pre-aggregated minimum and one joined row per quote, dealt
over all tasks: no pairs are formed. A conversation that holds a third of all messages is ranked by ranges.
Everything is DataFrame functions.

Defined cases: null text is empty; a message without quotes that can be found starts its own thread;
passages without letters or digits link nothing; null roles stay; rows with null conv_id or turn are kept as
conversations of their own, at place 0; of equally quoted messages the latest is the parent; repeated rows are
each returned with the same parent and place; very long texts are parsed whole; other columns are not looked at,
whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_join, materialize, table

_MARKS = r"^((?:[ \t]*>)+)[ \t]?"
_BLANK = r"^[\s>]*$"


def _level(line: Column) -> Column:
    """Quote marks before a line; most lines hold none and need no pattern."""
    marks = F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", "")
    return F.when(line.contains(">"), F.length(marks)).otherwise(0)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def passages(text: Column) -> Column:
    """Array of (level, part, text) in a message, normalised: what it may be quoted by (level 0: runs, lines, all of its own
    lines) and what it quotes (runs, and as part 1 their single lines). Blank lines end a run."""
    # each line is cut and normalised once; what is joined of normalised lines is normalised
    cut = F.transform(_lines(text), lambda x: F.struct(_level(x).alias("level"), x.rlike(_BLANK).alias("blank"), normalised(F.when(x.contains(">"), F.regexp_replace(x, _MARKS, "")).otherwise(x)).alias("text")))
    kind = lambda x: F.when(x["blank"], -1).otherwise(x["level"])
    joined = lambda xs: F.array_join(F.filter(F.transform(xs, lambda x: x["text"]), lambda t: t != ""), " ")
    made = lambda level, part, text: F.struct(level.alias("level"), F.lit(part).alias("part"), text.alias("text"))

    def found(k: Column) -> Column:
        first = lambda i: (i == 0) | (kind(F.get(k, i)) != kind(F.get(k, i - 1)))
        starts = F.filter(F.sequence(F.lit(0), F.size(k) - 1), first)
        cuts = F.get(F.transform(F.array(starts), lambda s: F.transform(s, lambda a, n: made(kind(F.get(k, a)), 0, joined(F.slice(k, a + 1, F.coalesce(F.get(s, n + 1), F.size(k)) - a))))), F.lit(0))
        runs = F.filter(cuts, lambda r: r["level"] >= 0)
        own = F.filter(k, lambda x: x["level"] == 0)
        single = F.transform(own, lambda x: made(x["level"], 0, x["text"]))
        quoted = F.transform(F.filter(k, lambda x: x["level"] > 0), lambda x: made(x["level"], 1, x["text"]))
        return F.array_distinct(F.filter(F.concat(runs, single, quoted, F.array(made(F.lit(0), 0, joined(own)))), lambda r: r["text"] != ""))

    return F.get(F.transform(F.array(cut), found), F.lit(0))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quoted, max_level of messages(conv_id, turn, role, text)."""
    held = messages.select("conv_id", "turn", "role", F.transform(_lines(F.col("text")), lambda x: F.struct(_level(x).alias("level"), x.alias("text"))).alias("lines"))
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    return held.select("conv_id", "turn", "role", F.regexp_replace(body, r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("body"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"), F.array_max(F.transform("lines", lambda x: x["level"])).cast("long").alias("max_level"))


def parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): parent is the (conv, turn) quoted most at the lowest level that links; messages with text."""
    held = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("r"))
    held = materialize(held.select("conv_id", "turn", "r.level", "r.part", F.sha2("r.text", 256).alias("hash")), "chat-passages")
    quoted = held.where("level > 0")
    own = held.where("level = 0").groupBy("hash", "conv_id").agg(F.min("turn").alias("at"))
    # only what is quoted at all is looked up
    asked = materialize(quoted.select("hash").distinct(), "chat-asked")
    own = materialize(own.join(asked, "hash", "left_semi").select(F.col("hash").alias("_h"), F.col("conv_id").alias("_c"), "at"), "chat-own")
    anywhere = own.groupBy("_h").agg(F.min(F.struct(F.col("_c").alias("conv"), F.col("at").alias("turn"))).alias("first"))
    met = hot_join(quoted, own, {"hash": "_h", "conv_id": "_c"})
    met = met.withColumn("at", F.when(F.col("at") < F.col("turn"), F.col("at")))
    met = hot_join(materialize(met, "chat-here"), anywhere, {"hash": "_h"})
    me = F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"))
    target = F.when(F.col("at").isNotNull(), F.struct(F.col("conv_id").alias("conv"), F.col("at").alias("turn"))).when(F.col("first") < me, F.col("first"))
    votes = met.withColumn("parent", target).where("parent is not null").groupBy("conv_id", "turn", "level", "part", "parent").agg(F.count("*").alias("votes"))
    best = F.min(F.struct("level", "part", (-F.col("votes")).alias("v"), (-F.col("parent.conv")).alias("c"), (-F.col("parent.turn")).alias("t"), F.col("parent").alias("parent")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.parent").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) by pointer doubling; links lead to earlier messages, so there are no cycles."""
    now = materialize(links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for k in range(64):
        up = now.select(F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn")).alias("_at"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        held = hot_join(now, up, {"root": "_at"}) if now.limit(1).count() else now.withColumns({"_root": F.col("root"), "_depth": F.col("depth")})
        nxt = materialize(held.select("conv_id", "turn", "parent", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("moved")), f"threads-{k}")
        moved = nxt.where("moved").limit(1).count()
        now = nxt.drop("moved")
        if not moved:
            break
    return now


def reply_order(places: DataFrame) -> DataFrame:
    """places(conv_id, turn, root_conv, root_turn, ...) with their place in the conversation root_conv.

    Rows are dealt by ranges of their order, ranked within a range, and moved up by what precedes the range.
    """
    order = ["root_conv", "root_turn", "conv_id", "turn"]
    dealt = materialize(places.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "chat-order")
    n = dealt.groupBy("root_conv", "_part").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy("root_conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.select(F.col("root_conv").alias("_c"), F.col("_part").alias("_q"), ahead.alias("_ahead"))
    here = F.row_number().over(W.partitionBy("_part", "root_conv").orderBy(*order)) - 1
    out = dealt.withColumn("_here", here).join(n, (F.col("root_conv") == F.col("_c")) & (F.col("_part") == F.col("_q")))
    return out.withColumn("position", (F.col("_ahead") + F.col("_here")).cast("long")).drop("_part", "_here", "_c", "_q", "_ahead")


def link_quotes(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, body, n_quoted, max_level, parent_conv, parent_turn, root_conv, root_turn, depth, position.

    Ordered by (root_conv, position) the bodies are the conversations in reply order.
    """
    found = threads(parents(messages)).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "parent", "root", "depth")
    places = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    places = places.join(found, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    places = reply_order(places.select("conv_id", "turn", F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("root.conv", "conv_id").alias("root_conv"), F.coalesce("root.turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")))
    places = places.withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
    out = parsed(messages).join(places, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", "body", "n_quoted", "max_level", "parent_conv", "parent_turn", F.coalesce("root_conv", "conv_id").alias("root_conv"),
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"), F.coalesce("position", zero).alias("position"))


def conversations(linked: DataFrame) -> DataFrame:
    """(conversation, position, role, content) in reply order, without quotes."""
    return linked.select(F.col("root_conv").alias("conversation"), "position", "role", F.col("body").alias("content")).orderBy("conversation", "position")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def quoting(messages: DataFrame) -> DataFrame:
    """messages as mail clients would send them: turns quote the one before, whole, its first line, or with what that follows."""
    w = W.partitionBy("conv_id").orderBy("turn")
    marked = lambda text, marks: F.concat(F.lit(marks), F.replace(text, F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))
    held = messages.withColumns({"_last": F.lag("text").over(w), "_before": F.lag("text", 2).over(w)})
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    head = F.when(F.col("_last").isNull() | (kind == 3), "").when(kind == 1, marked(F.substring_index("_last", "\n", 1), "> "))
    head = head.when((kind == 2) & F.col("_before").isNotNull(), F.concat(marked(F.col("_before"), "> > "), marked(F.col("_last"), "> "))).otherwise(marked(F.col("_last"), "> "))
    return held.withColumn("text", F.concat(head, "text")).drop("_last", "_before")


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's operator where messages do quote each other."""
    return link_quotes(quoting(table(spark, sf_dir, "conversations")))


def _sql(messages: str) -> str:
    """The operator from its definition."""
    norm = r"trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g'))"
    return rf"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM ({messages})),
l0 AS (SELECT r, conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS x, unnest(range(1, len(string_split_regex(coalesce(text, ''), '\r?\n')) + 1)) AS i FROM m),
l1 AS (SELECT *, length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level, regexp_matches(x, '^[\s>]*$') AS blank, regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', '') AS t FROM l0),
l AS MATERIALIZED (SELECT *, {norm} AS n, CASE WHEN blank THEN -1 ELSE level END AS kind FROM l1),
g AS (SELECT *, sum(CASE WHEN kind = before THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY r ORDER BY i) AS before FROM l)),
passage AS MATERIALIZED (
  SELECT DISTINCT conv_id, turn, r, level, part, n FROM (
    SELECT conv_id, turn, r, kind AS level, 0 AS part, string_agg(n, ' ' ORDER BY i) FILTER (n <> '') AS n FROM g WHERE kind >= 0 GROUP BY conv_id, turn, r, kind, run
    UNION ALL SELECT conv_id, turn, r, level, CASE WHEN level > 0 THEN 1 ELSE 0 END, n FROM l
    UNION ALL SELECT conv_id, turn, r, 0, 0, string_agg(n, ' ' ORDER BY i) FILTER (n <> '') FROM l WHERE level = 0 GROUP BY 1, 2, 3)
  WHERE n <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
own AS (SELECT n, conv_id AS c, min(turn) AS t FROM passage WHERE level = 0 GROUP BY 1, 2),
origin AS (SELECT n, min(c) AS c, arg_min(t, c) AS t FROM own GROUP BY 1),
met AS (SELECT q.conv_id, q.turn, level, part, CASE WHEN h.t < q.turn THEN q.conv_id WHEN (a.c, a.t) < (q.conv_id, q.turn) THEN a.c END AS pc, CASE WHEN h.t < q.turn THEN h.t WHEN (a.c, a.t) < (q.conv_id, q.turn) THEN a.t END AS pt
  FROM passage q LEFT JOIN own h ON h.n = q.n AND h.c = q.conv_id LEFT JOIN origin a ON a.n = q.n WHERE level > 0),
votes AS (SELECT conv_id, turn, level, part, pc, pt, count(*) AS v FROM met WHERE pc IS NOT NULL GROUP BY ALL),
link AS MATERIALIZED (SELECT conv_id, turn, pc, pt FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, part, v DESC, pc DESC, pt DESC) = 1),
up(conv_id, turn, rc, rt, depth) AS (SELECT conv_id, turn, pc, pt, 1 FROM link UNION ALL SELECT up.conv_id, up.turn, link.pc, link.pt, depth + 1 FROM up JOIN link ON link.conv_id = rc AND link.turn = rt),
root AS (SELECT conv_id, turn, arg_max(rc, depth) AS rc, arg_max(rt, depth) AS rt, max(depth) AS depth FROM up GROUP BY 1, 2),
place AS (SELECT conv_id, turn, pc, pt, coalesce(rc, conv_id) AS rc, coalesce(rt, turn) AS rt, coalesce(depth, 0) AS depth, row_number() OVER (PARTITION BY coalesce(rc, conv_id) ORDER BY coalesce(rt, turn), conv_id, turn) - 1 AS position
  FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL) LEFT JOIN link USING (conv_id, turn) LEFT JOIN root USING (conv_id, turn)),
text AS (SELECT r, regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS body, count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level FROM l GROUP BY 1)
SELECT m.conv_id, m.turn, role, body, n_quoted, max_level, pc AS parent_conv, pt AS parent_turn, coalesce(rc, m.conv_id) AS root_conv, coalesce(rt, m.turn) AS root_turn, coalesce(depth, 0) AS depth, coalesce(position, 0) AS position
FROM m JOIN text USING (r) LEFT JOIN place ON place.conv_id = m.conv_id AND place.turn = m.turn
"""


OP2_SQL = _sql("SELECT conv_id, turn, role, text FROM conversations")
QUOTED_SQL = _sql("""SELECT conv_id, turn, role, CASE WHEN last IS NULL OR k = 3 THEN '' WHEN k = 1 THEN '> ' || string_split(last, chr(10))[1] || chr(10)
  WHEN k = 2 AND before IS NOT NULL THEN '> > ' || replace(before, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(last, chr(10), chr(10) || '> ') || chr(10) ELSE '> ' || replace(last, chr(10), chr(10) || '> ') || chr(10) END || text AS text
  FROM (SELECT *, (conv_id + turn) % 4 AS k, lag(text) OVER w AS last, lag(text, 2) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
