"""Shared tokenizer and text functions as Column expressions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default filler words, fixed values: English function words, then chat filler and generic words of development that
#: say nothing about a topic. Lists for other languages are a parameter: see `load_stopwords` and `tokenize`.
STOPWORDS = tuple("""
a an the and or but nor so yet if then else when while where which who whom whose what why how that this these
those there here i me my mine we us our ours you your yours he him his she her hers it its they them their theirs
am is are was were be been being do does did doing done have has had having will would shall should can could may
might must of in on at by for with about against between into through during before after above below to from up
down out off over under again further once as than too very not no only own same such both each few more most
other some any all also because until via per etc
please help want need make just like thing things stuff way let lets get got know think see look sure okay ok yes
yeah thanks thank now new one two still well good right really actually basically maybe something anything
everything work works working use using used fix add change update run running code file files error issue problem
question hey hi hello
""".split())


def load_stopwords(spark, path: str) -> tuple[str, ...]:
    """The default filler words and those of a file, one or more to a line, in any store that Spark reads."""
    found = spark.read.text(path).select(F.explode(F.split(F.lower("value"), r"\s+")).alias("w")).where("w <> ''").distinct()
    return STOPWORDS + tuple(sorted(r["w"] for r in found.collect() if r["w"] not in STOPWORDS))


#: Unicode white space as a class that Java and RE2 read alike.
SPACE = r"[\s\pZ\x0b\x85]"


def trimmed(s: Column) -> Column:
    """Without white space (any Unicode kind) at either end."""
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", "")


def tokenize(s: Column, cap: int = 0, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Distinct tokens in order: runs of [a-z0-9_./-] and the parts of compound ones, without filler.

    Shorter than two characters, pure integers and stopwords are dropped; cap 0 keeps all; null gives null.
    """
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(s, "İ", "i")), F.lit("[a-z0-9_./-]+"), F.lit(0))
    whole = lambda t: F.regexp_replace(t, "^[_./-]+|[_./-]+$", "")
    parts = F.flatten(F.transform(runs, lambda t: F.when(t.rlike("[_./-]"), F.concat(F.array(whole(t)), F.split(t, "[_./-]+"))).otherwise(F.array(t))))
    kept = F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))
    # array_except is a hash set and keeps first occurrences in order
    found = F.array_except(kept, F.array(*(F.lit(w) for w in stopwords)))
    return F.slice(found, 1, cap) if cap else found


def content_hash(project: Column, content: Column) -> Column:
    return F.sha2(F.concat(project, F.lit("\0"), F.lower(trimmed(content))), 256)


def memory_keywords(title: Column, content: Column, aliases: Column) -> Column:
    return F.array_union(tokenize(F.concat_ws(" ", title, content), 32), tokenize(F.concat_ws(" ", aliases), 24))


def alias_only(title: Column, content: Column, aliases: Column) -> Column:
    return F.array_except(tokenize(F.concat_ws(" ", aliases), 24), tokenize(F.concat_ws(" ", title, content), 32))


def basename(key: Column) -> Column:
    last = F.element_at(F.split(key, "/"), -1)
    return F.when(last == "", key).otherwise(last)


def clean_aliases(aliases: Column) -> Column:
    """White space collapsed, lower-cased, blanks, over 40 bytes and repeats dropped, ten at most."""
    tidy = F.transform(aliases, lambda a: F.lower(F.trim(F.regexp_replace(a, r"\s+", " "))))
    return F.slice(F.array_distinct(F.filter(tidy, lambda a: (a != "") & (F.octet_length(a) <= 40))), 1, 10)


def slice_json(s: Column) -> Column:
    """The outermost object within a reply, code fences and chatter cut off."""
    return F.regexp_extract(s, r"(?s)\{.*\}", 0)


def relative_age(now: Column, at: Column) -> Column:
    d = now - at
    unit = lambda n, u: F.concat(F.floor(d / n).cast("string"), F.lit(u))
    return F.when(d < 90, "just now").when(d < 5400, unit(60, "m")).when(d < 129600, unit(3600, "h")).otherwise(unit(86400, "d"))


def ellipsis(s: Column, n: int) -> Column:
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(n - 1))), F.lit("…")))


def clip_chars(s: Column, n: int) -> Column:
    """At most n bytes, cut at a character boundary."""
    raw = F.encode(s, "UTF-8")
    # a cut behind byte k is between characters unless the next byte continues one
    fits = F.filter(F.sequence(F.lit(n), F.lit(max(n - 3, 0)), F.lit(-1)), lambda k: ~F.hex(F.substring(raw, k + 1, F.lit(1))).between("80", "BF"))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.decode(F.substring(raw, F.lit(1), F.coalesce(F.get(fits, F.lit(0)), F.lit(0))), "UTF-8"))


#: Bytes that a turn's text keeps, and a report's.
MESSAGE_BYTES, REPORT_BYTES = 6000, 8000


def clip_middle(s: Column, n: int) -> Column:
    """Over n bytes, two thirds of them from the start and the rest from the end, at character boundaries."""
    raw = F.encode(s, "UTF-8")
    head = clip_chars(s, n * 2 // 3)
    start = F.octet_length(s) - (n - F.octet_length(head))
    # the first byte from there on that does not continue a character
    here = F.get(F.filter(F.sequence(start, start + 3), lambda k: ~F.coalesce(F.hex(F.substring(raw, k + 1, F.lit(1))).between("80", "BF"), F.lit(False))), F.lit(0))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(head, F.lit("\n…\n"), F.decode(F.substring(raw, here + 1, F.octet_length(s)), "UTF-8")))


def clip_message(s: Column) -> Column:
    report = s.startswith("<task-notification>") | s.startswith("Subagent report: ")
    return F.when(report, clip_middle(s, REPORT_BYTES)).otherwise(clip_middle(s, MESSAGE_BYTES))


def squashed(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, rf"{SPACE}+", " "))


def same_reply(a: Column, b: Column, n: int = 200) -> Column:
    """Whether two replies begin alike, whatever their white space; nothing to look for is always there."""
    return (squashed(b) == "") | (clip_chars(squashed(a), n) == clip_chars(squashed(b), n))


def escape_control(s: Column) -> Column:
    """Control characters as \\uXXXX, for text formats that cannot hold them."""
    one = lambda c: F.when(c.rlike(r"[\x00-\x1f\x7f]"), F.concat(F.lit("\\u"), F.lpad(F.upper(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)
    return F.when(s.rlike(r"[\x00-\x1f\x7f]"), F.array_join(F.transform(F.split(s, ""), one), "")).otherwise(s)


def human_bytes(n: Column) -> Column:
    """A size as printf has it: what lies in the middle goes to the even digit, where the JVM's formatter rounds up."""
    mb, kb = F.rint(n * 10 / (1 << 20)) / 10, F.rint(n / (1 << 10))
    return F.when(n >= 1 << 20, F.format_string("%.1fMB", mb)).when(n >= 1 << 10, F.format_string("%.0fKB", kb)).when(n.isNotNull(), F.format_string("%dB", n))


_IDENTIFIER = "[-_/.]+"


def normal_term(t: Column) -> Column:
    return F.lower(squashed(t))


def respellings(t: Column) -> Column:
    """A term in the other style: spaced for an identifier, with hyphens and underscores for a phrase."""
    spaced = F.array(trimmed(F.regexp_replace(t, _IDENTIFIER, " ")))
    return F.when(t.rlike("[-_/.]"), spaced).when(t.contains(" "), F.array(F.replace(t, F.lit(" "), F.lit("-")), F.replace(t, F.lit(" "), F.lit("_")))).otherwise(F.array().cast("array<string>"))


def usable_term(t: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Two bytes or more, no structural or control characters, and not of filler words alone."""
    words = F.filter(F.split(t, rf"{SPACE}+"), lambda w: w != "")
    return (F.octet_length(t) >= 2) & ~t.rlike(r"[\x00-\x1f\x7f-\x9f{}`\"'\\]") & (F.size(F.array_except(words, F.array(*(F.lit(w) for w in stopwords)))) > 0)


def expansion_terms(terms: Column, prompt: Column, known: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Usable terms that the prompt's tokens lack, in order, once each; other spellings only if they are known names.

    The prompt's tokens are compared as terms are written, white space and case levelled.
    """
    spelt = lambda t: F.concat(F.array(t), F.filter(respellings(t), lambda x: F.array_contains(known, x)))
    every = F.flatten(F.transform(F.transform(terms, normal_term), spelt))
    return F.array_except(F.array_distinct(F.filter(every, lambda t: usable_term(t, stopwords))), F.transform(prompt, normal_term))


def idf(n: Column, df: Column) -> Column:
    d = F.greatest(df, F.lit(1))
    return F.log(1 + (n - d + 0.5) / (d + 0.5))


def jaccard(a: Column, b: Column) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def is_under(path: Column, root: Column) -> Column:
    """path is root or below it."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def command_prompt(prompt: Column) -> Column:
    """`/skill args` without its slash; path-like prompts stay."""
    return F.when(prompt.rlike(r"^/[A-Za-z0-9_:-]+(\s|$)"), F.regexp_replace(prompt, "^/", "")).otherwise(prompt)
