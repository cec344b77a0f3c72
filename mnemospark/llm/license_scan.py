"""License scans: sparse TF-IDF cosine to licence templates, then inheritance along directories.

Candidates of a file are its lines, its blocks (lines up to a blank one: a comment mark keeps a header together)
and, of a licence file, the whole. A candidate's sparse vector (term counts times idf, the idf from the number of
files with a template term) is joined to the template vectors by term; the best cosine of at least LEAST gives
the file's licence. Directories with a licence file pass it on to all below them: each distinct directory is
joined to its ancestors and takes the nearest. Everything is DataFrame functions; the template vectors are a
constant of a few thousand rows.

No text is left out, but most of it is done with at once: a candidate with a cosine of LEAST shares terms with a
template whose weights alone have that norm (Cauchy and Schwarz). So the commonest terms of each template whose
weights fall short of it together do not make a match, and a match holds one of the others, the rarer ones.
Files, then candidates without such a term cannot match.

Defined cases: null text has no licence; null paths have no directory and inherit nothing; null or repeated ids do
not matter, rows are told apart by id, path and text; ties go to the alphabetically first licence; of several
licence files in a directory the best (then first by path) counts; repeated files are each returned; very long
texts are searched whole; other columns are not looked at, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, materialize, row_key, rows_of, small, table
from .licences import TEMPLATES

FILES = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
LEAST = 0.6


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _words(found: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in found)) if found else F.array().cast("array<string>")


def template_vectors(files: DataFrame, found=TEMPLATES, least: float = LEAST) -> tuple[DataFrame, DataFrame, float, list[str]]:
    """(no, licence, term, u) of unit length, (term, idf), the idf of terms in no template, and the terms one of which a match must have."""
    own = rows_of(files.sparkSession, "no int, licence string, notice string", [(i, *x) for i, x in enumerate(found)])
    own = own.select("no", "licence", F.explode(terms(F.col("notice"))).alias("term")).groupBy("no", "licence", "term").agg(F.count("*").alias("tf"))
    own = materialize(own, "licence-templates")
    known = sorted(r["term"] for r in own.select("term").distinct().collect())  # of the constant templates
    n = files.count()
    held = files.select(F.explode(F.array_intersect(terms(F.coalesce("text", F.lit(""))), _words(known))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = own.select("term").distinct().join(held, "term", "left").select("term", (F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    idf = materialize(idf, "licence-idf")
    weights = own.join(idf, "term").select("no", "licence", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = materialize(weights.join(norms, "no").select("no", "licence", "term", (F.col("w") / F.col("norm")).alias("u")), "licence-unit")
    needed: set[str] = set()
    per: dict[int, list[tuple[float, float, str]]] = {}
    for r in unit.join(idf, "term").collect():
        per.setdefault(r["no"], []).append((r["idf"], r["u"], r["term"]))
    for weighed in per.values():
        rest = 0.0
        for _, u, term in sorted(weighed):
            rest += u * u
            if rest >= least**2 - 1e-5:  # scores are rounded to six places
                needed.add(term)
    rare = float(idf.sparkSession.range(1).select(F.log(F.lit(float(n + 1))) + 1).first()[0])
    return unit, idf, rare, sorted(needed)


def candidates(files: DataFrame, needed: list[str]) -> DataFrame:
    """(row, id, lid, line) of the candidates of files(row, id, text, whole) with a needed term; lid is the digest of the line, which later steps carry instead."""
    some = files.where(F.arrays_overlap(terms(F.coalesce("text", F.lit(""))), _words(needed)))
    own = F.concat(F.split("text", "\r?\n"), F.split("text", r"\r?\n[ \t]*\r?\n"), F.when(F.col("whole"), F.array("text")).otherwise(F.array().cast("array<string>")))
    held = some.select("row", "id", F.explode(F.array_distinct(own)).alias("line")).where(F.arrays_overlap(terms(F.col("line")), _words(needed)))
    return held.select("row", "id", F.sha2("line", 256).alias("lid"), "line")


def scored(files: DataFrame, found=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(row, id, licence, score): the best template of files(row, id, text, whole)."""
    unit, idf, rare, needed = template_vectors(files, found, least)
    lines = materialize(candidates(files, needed), "licence-lines")
    # equal candidates are scored once, however many files hold them
    distinct = lines.select("lid", "line").dropDuplicates(["lid"])
    bag = distinct.select("lid", F.explode(terms(F.col("line"))).alias("term")).groupBy("lid", "term").agg(F.count("*").alias("tf"))
    held = materialize(bag.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare))), "licence-terms")
    size = held.groupBy("lid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = held.join(F.broadcast(unit), "term").groupBy("lid", "no", "licence").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    cosine = dots.join(size, "lid").select("lid", "licence", F.round(F.col("dot") / F.col("size"), 6).alias("score")).where(F.col("score") >= least)
    best = materialize(cosine.groupBy("lid").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")), "licence-best")
    won = lines.select("row", "id", "lid").join(small(best), "lid").groupBy("row", "id").agg(F.min("b").alias("b"))
    return won.select("row", "id", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """(depth, dir) of a folder and all above it; folders end with a slash, the top is empty."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))).alias("dir")))


def scan(files: DataFrame, found=TEMPLATES, least: float = LEAST) -> DataFrame:
    """id, path, own_licence, score, licence, inherited_from for each row of files(id, path, text)."""
    whole = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILES), F.lit(False))
    held = files.select(row_key("id", "path", "text").alias("row"), "id", "path", "text", whole.alias("whole"))
    own = materialize(scored(held, found, least), "licence-own").withColumnsRenamed({"row": "_row", "id": "_id"})
    places = held.select("row", "id", "path", directory(F.col("path")).alias("dir"), "whole").join(small(own), (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")), "left").drop("row", "_row", "_id")
    places = materialize(places, "licence-places")
    given = places.where("whole and licence is not null and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("g"))
    given = given.select(F.col("dir").alias("_dir"), F.col("g.licence").alias("given"), F.col("g.path").alias("from"))
    folders = places.where("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a"))
    near = folders.join(given, F.col("a.dir") == F.col("_dir")).groupBy("dir").agg(F.max(F.struct("a.depth", "given", "from")).alias("m"))
    near = materialize(near.select(F.col("dir").alias("_dir"), F.col("m.given").alias("given"), F.col("m.from").alias("from")), "licence-near")
    out = hot_join(places, near, {"dir": "_dir"})
    return out.select("id", "path", F.col("licence").alias("own_licence"), "score", F.coalesce("licence", "given").alias("licence"), F.when(F.col("licence").isNull(), F.col("from")).alias("inherited_from"))


def corpus_files(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/doc_id.txt; every 50th id is the licence file of a folder below that."""
    i = F.col("doc_id")
    name = F.when(i % 50 == 0, F.concat_ws("/", "source", "lang", F.pmod(F.floor(i / 50), F.lit(7)).cast("string"), F.lit("LICENSE")))
    return docs.select(i.alias("id"), F.coalesce(name, F.concat_ws("/", "source", "lang", F.pmod(i, F.lit(11)).cast("string"), F.concat(i.cast("string"), F.lit(".txt")))).alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(corpus_files(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


_TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')".format
_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
#: The scan from its definition: every line, block and licence file against every template.
OP6_SQL = rf"""
WITH f0 AS (SELECT row_number() OVER () AS r, doc_id, text, CASE WHEN doc_id % 50 = 0 THEN concat_ws('/', source, lang, CAST((doc_id // 50) % 7 AS VARCHAR), 'LICENSE') ELSE concat_ws('/', source, lang, CAST(doc_id % 11 AS VARCHAR), doc_id || '.txt') END AS path FROM documents),
f AS MATERIALIZED (SELECT *, doc_id % 50 = 0 AS whole, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir FROM f0),
template AS (SELECT * FROM (VALUES {_VALUES}) AS v(no, licence, notice)),
tt AS MATERIALIZED (SELECT no, licence, term, count(*) AS tf FROM (SELECT no, licence, unnest({_TERMS('notice')}) AS term FROM template) GROUP BY ALL),
size AS (SELECT count(*) AS n FROM f),
df AS (SELECT term, count(DISTINCT r) AS df FROM (SELECT r, unnest({_TERMS("coalesce(text, '')")}) AS term FROM f) WHERE term IN (SELECT term FROM tt) GROUP BY 1),
idf AS MATERIALIZED (SELECT DISTINCT tt.term, ln((n + 1e0) / (coalesce(df, 0) + 1)) + 1 AS idf FROM tt LEFT JOIN df USING (term), size),
w AS MATERIALIZED (SELECT no, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY no)) AS u FROM tt JOIN idf USING (term)),
line AS MATERIALIZED (SELECT DISTINCT r, line FROM (SELECT r, unnest(string_split_regex(text, '
?
')) AS line FROM f UNION ALL SELECT r, unnest(string_split_regex(text, '
?
[ 	]*
?
')) FROM f UNION ALL SELECT r, text FROM f WHERE whole) WHERE line IS NOT NULL),
lt AS MATERIALIZED (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest({_TERMS('line')}) AS term FROM (SELECT DISTINCT line FROM line)) GROUP BY ALL),
lw AS MATERIALIZED (SELECT line, term, tf * coalesce(idf, (SELECT ln(n + 1e0) + 1 FROM size)) AS w FROM lt LEFT JOIN idf USING (term)),
norm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY 1),
dot AS (SELECT line, no, licence, sum(w * u) AS dot FROM lw JOIN w USING (term) GROUP BY ALL),
cosine AS (SELECT line, licence, round(dot / norm, 6) AS score FROM dot JOIN norm USING (line) WHERE round(dot / norm, 6) >= {LEAST}),
won AS (SELECT r, licence, score FROM line JOIN cosine USING (line) QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, licence) = 1),
place AS MATERIALIZED (SELECT f.*, licence, score FROM f LEFT JOIN won USING (r)),
given AS (SELECT dir, licence AS given, path AS source_path FROM place WHERE whole AND licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
near AS (SELECT d.dir, given, source_path FROM (SELECT DISTINCT dir FROM place) d JOIN given g ON starts_with(d.dir, g.dir) QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(g.dir) DESC) = 1)
SELECT doc_id, path, licence AS own_licence, score, coalesce(licence, given) AS licence, CASE WHEN licence IS NULL THEN source_path END AS inherited_from FROM place LEFT JOIN near USING (dir)
"""
