"""What searches look up, kept by the saves: postings of words, names, mentions and relations, and counts.

Each save appends a segment a table, in order of what it is looked up by, that holds only what the save changed; a
posting that no longer holds is written again as gone. Of several rows of one posting the one of the greatest `at` (the
version that wrote it) counts. Counts are differences, and are summed up. Segments are merged by the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.sources.scratch import written

from .graph import both_ways

TABLES = {
    "words": "token string, hash string, via_alias boolean, gone boolean, at long",
    "names": "token string, entity_key string, name_lc string, exact boolean",
    "mentioned": "entity_key string, hash string, gone boolean, at long",
    "near": "a string, b string, name_lc string, weight long, at long",
    "counts": "kind string, key string, n long",
    "grams": "gram string, kind string, key string",
}
#: What a table is looked up by, and what makes a row of it the same posting.
ORDER = {"words": ("token",), "names": ("token",), "mentioned": ("entity_key",), "near": ("a",), "counts": ("kind", "key"), "grams": ("gram",)}
KEYS = {"words": ("token", "hash"), "names": ("token", "entity_key", "name_lc", "exact"), "mentioned": ("entity_key", "hash"), "near": ("a", "b"), "counts": ("kind", "key"), "grams": ("gram", "kind", "key")}
#: Length of the pieces that substrings are looked up by, and what fills the last of a text up.
GRAM, FILL = 3, "\x02"


def is_live() -> Column:
    return ~F.coalesce("superseded", F.lit(False)) & ~F.coalesce("archived", F.lit(False))


def _none() -> Column:
    return F.array().cast("array<string>")


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The row of the greatest `at` for each of the keys; those gone are left out."""
    rest = [c for c in df.columns if c not in (*keys, "at")]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("_r")).select(*keys, "_r.*")
    return out.where(~F.col("gone")).drop("gone") if "gone" in rest else out


def merged(name: str) -> Callable[[DataFrame, bool], DataFrame]:
    """How segments of a table become one. The flag: whether these are all, so that what is gone can go."""

    def run(df: DataFrame, whole: bool) -> DataFrame:
        keys = KEYS[name]
        if name == "counts":
            return df.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
        if name in ("names", "grams"):
            return df.distinct()
        rest = [c for c in df.columns if c not in keys]
        out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("_r")).select(*keys, "_r.*").select(*df.columns)
        return out.where(~F.col("gone")) if whole and "gone" in rest else out

    return run


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(hash, project_key, old, new, was, is) of the memories whose live words changed: words and alias words before and after."""

    def side(mem: DataFrame, name: str, flag: str) -> DataFrame:
        kept = F.struct(F.coalesce("keywords", _none()).alias("words"), F.coalesce("alias_only", _none()).alias("aliases"))
        return mem.select("hash", F.col("project_key").alias(f"p_{name}"), F.when(is_live(), kept).alias(name), is_live().alias(flag))

    both = side(before, "old", "was").join(side(after, "new", "is"), "hash", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    empty = F.struct(_none().alias("words"), _none().alias("aliases"))
    return both.select("hash", F.coalesce("p_new", "p_old").alias("project_key"), F.coalesce("old", empty).alias("old"), F.coalesce("new", empty).alias("new"), F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is", F.lit(False)).alias("is"))


def _words(changed: DataFrame) -> DataFrame:
    """(token, hash, via_alias, gone, added) of flips; added: what it does to the token's count."""
    has, via = F.array_contains, lambda side, t: F.array_contains(f"{side}.aliases", t)
    row = lambda t, gone, n: F.struct(t.alias("token"), via("new", t).alias("via_alias"), F.lit(gone).alias("gone"), n.cast("long").alias("added"))
    held = F.transform(F.array_distinct("new.words"), lambda t: row(t, False, F.when(has("old.words", t), 0).otherwise(1)))
    held = F.filter(held, lambda x: (x["added"] == 1) | (via("old", x["token"]) != x["via_alias"]))
    gone = F.transform(F.array_except("old.words", "new.words"), lambda t: row(t, True, F.lit(-1)))
    return changed.select("hash", F.explode(F.concat(held, gone)).alias("x")).select("x.token", "hash", "x.via_alias", "x.gone", "x.added")


def names_of(entities: DataFrame) -> DataFrame:
    """(token, entity_key, name_lc, exact): an entity's name and its tokens."""
    own = F.array_union(F.array(F.struct(F.col("name_lc").alias("token"), F.lit(True).alias("exact"))), F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit(False).alias("exact"))))
    return entities.select("entity_key", "name_lc", F.explode(own).alias("n")).select("n.token", "entity_key", "name_lc", "n.exact")


def grams_of(text: Column) -> Column:
    """The distinct pieces of a text that begin at each of its characters."""
    filled = F.concat(text, F.lit(FILL * (GRAM - 1)))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(filled, i, F.lit(GRAM))))).otherwise(_none())


def containing(grams: DataFrame, kind: str, needle: str) -> DataFrame:
    """key of what may hold a needle of one character or more, in lower case: all its pieces are there, or a piece that it begins."""
    held = grams.where(F.col("kind") == kind)
    if len(needle) < GRAM:
        return held.where(F.col("gram").startswith(needle)).select("key").distinct()
    pieces = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
    found = held.where(F.col("gram").isin(pieces)).groupBy("key").agg(F.countDistinct("gram").alias("n"))
    return found.where(F.col("n") == len(pieces)).select("key")


def changes(before: dict[str, DataFrame], after: dict[str, DataFrame], at: int) -> dict[str, DataFrame]:
    """Segments for the tables memory, mentions, entities and related before and after a save; those it left alone may be missing in both."""
    stamp = F.lit(at).cast("long").alias("at")
    changed = written(flips(before["memory"], after["memory"]), "flips")
    words = written(_words(changed), "posted")
    alive = changed.select("hash", "was", "is").where("was <> is")
    counts = [
        words.where("added <> 0").groupBy(F.lit("token").alias("kind"), F.col("token").alias("key")).agg(F.sum("added").alias("n")),
        changed.groupBy(F.lit("live").alias("kind"), F.col("project_key").alias("key")).agg(F.sum(F.col("is").cast("long") - F.col("was").cast("long")).alias("n")),
    ]
    out = {"words": words.select("token", "hash", "via_alias", "gone", stamp)}
    held = after["mentions"].select("entity_key", "hash")
    turned = held.join(alive, "hash").select("entity_key", "hash", (~F.col("is")).alias("gone"))
    if "mentions" in before:
        fresh = held.join(before["mentions"], ["entity_key", "hash"], "left_anti")
        counts.append(fresh.groupBy(F.lit("mentions").alias("kind"), F.col("entity_key").alias("key")).agg(F.count("*").alias("n")))
        mine = after["memory"].where(is_live()).select("hash")
        # a new mention of a memory that lived before; the others turn with theirs
        turned = turned.union(fresh.join(mine, "hash", "left_semi").join(alive.select("hash"), "hash", "left_anti").select("entity_key", "hash", F.lit(False)))
    out["mentioned"] = turned.select("entity_key", "hash", "gone", stamp)
    # titles and names stay as they were first; whether a memory lives is seen when it is read
    fresh = after["memory"].join(before["memory"].select("hash"), "hash", "left_anti")
    pieces = [fresh.select(F.explode(grams_of(F.lower("title"))).alias("gram"), F.lit("title").alias("kind"), F.col("hash").alias("key"))]
    if "entities" in before:
        new = after["entities"].join(before["entities"].select("entity_key"), "entity_key", "left_anti")
        pieces.append(new.select(F.explode(grams_of(F.col("name_lc"))).alias("gram"), F.lit("name").alias("kind"), F.col("entity_key").alias("key")))
    out["grams"] = pieces[0] if len(pieces) == 1 else pieces[0].union(pieces[1])
    if "entities" in before:
        out["names"] = names_of(after["entities"].join(before["entities"].select("entity_key"), "entity_key", "left_anti"))
    if "related" in before:
        old = before["related"].select("k1", "k2", F.col("weight").alias("_w"))
        edges = after["related"].join(old, ["k1", "k2"], "left").where("_w is null or _w <> weight")
        named = after["entities"].select(F.col("entity_key").alias("b"), "name_lc")
        out["near"] = both_ways(edges).join(named, "b").select("a", "b", "name_lc", "weight", stamp)
    total = counts[0]
    for c in counts[1:]:
        total = total.union(c)
    out["counts"] = total.where("n <> 0")
    return out
