"""Quality rules: text statistics and robust multivariate outliers per language and source.

Every document gets counts over its whole text, and four transformed statistics, rounded to 1/GRID. For each
(language, source), each language and all rows, the centre and scatter of these vectors are estimated by minimum
covariance determinant: concentration steps from two starts (medians with median absolute deviations; mean and
covariance) keep the nearest `support` share of rows, until no start's determinant falls any more; the smaller
determinant wins. A group's estimate is then drawn toward that of its language, and that toward all rows, as if
`prior` rows of the wider one were added: much where a group is small, hardly where it is large. Rows beyond
`cutoff` in squared Mahalanobis distance are rejected.

Equal vectors are counted before all else, so a step reads distinct vectors with their counts. It is one
aggregation: moments by bins of the distance, whose running sums give the nearest share and its moments at
once. Everything is DataFrame functions; a group never gathers more than its bins.

Defined cases: null text counts as empty; documents without words fail the base rule; null language or source
is a group of its own; a group without usable rows has none to judge; a share that ends within a bin of equally
far rows takes all of them; repeated rows are each returned; very long texts are counted whole; other columns
are kept by the stage and not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, hot_join, materialize, row_key, small, table, without

WINDOW = 8
FEATURES = ("x0", "x1", "x2", "x3")
#: Least standard deviation of each statistic: below it differences are not treated as odd.
FLOORS = (0.06, 0.45, 0.45, 0.6)
#: Steps of the statistics in a unit; bins of the distance in a factor of e.
GRID, BINS = 1024, 64
#: Share of rows that an estimate rests on, rows that a wider group's estimate counts for, steps at the most.
SUPPORT, PRIOR, STEPS = 0.75, 50, 50
#: Squared distance beyond which a vector is an outlier (four statistics; normal data pass it once in 10^9).
CUTOFF = 49.0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def repeat_words(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, given the hashes of all windows in order."""
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda j: (F.get(s, j)["g"] == F.get(s, j - 1)["g"]) | (F.get(s, j)["g"] == F.get(s, j + 1)["g"])
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j), F.lit(False)))
        return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

    def covered(at: Column) -> Column:
        return _total(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))).cast("long")))

    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  evaluates value once
    found = bind(ordered, lambda s: bind(starts(s), covered))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(found)


def statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to docs, over whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = docs.drop("_words", "_hashes", "_grams", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    df = clean.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i: [F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]
    grams = F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*at(i)))
    df = df.withColumn("_grams", F.when(F.size("_hashes") >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_grams")),
    })
    n = F.col("n_words")
    return df.drop("_words", "_hashes", "_grams").withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))


def transformed(df: DataFrame) -> DataFrame:
    """The vectors: log mean word length, and log shares of symbols, repeated lines and repeated words; and the group's name."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    on_grid = lambda x: F.round(x * GRID) / GRID
    return df.withColumns({
        "x0": on_grid(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)),
        "x1": on_grid(F.log1p(100 * F.col("n_symbols") / n)),
        "x2": on_grid(F.log1p(100 * F.col("n_dup_lines") / n)),
        "x3": on_grid(F.log1p(100 * F.col("n_repeat_words") / n)),
        "g": group(2, "lang", "source"),
    })


def group(level: int, *by: str) -> Column:
    """Name of a group: 2 of a language and source, 1 of a language, 0 of all; nulls have names, too."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *by))


def _distance(p: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. to the centre m0.. by the Cholesky factor l<i>_<j> of the scatter."""
    ys: list[Column] = []
    for i, x in enumerate(FEATURES):
        y = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}_{j}") * ys[j]
        ys.append(y / F.col(f"l{i}_{i}"))
    return reduce(lambda a, b: a + b, [y * y for y in ys])


def _factor(params: DataFrame) -> DataFrame:
    """Cholesky factor of covariance + floors, a column at a time; params has m<i> and s<i>_<j>, i >= j."""
    d = len(FEATURES)
    for j in range(d):
        for i in range(j, d):
            v = F.col(f"s{i}_{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            # the floors keep the matrix positive definite; the bound guards against rounding alone
            params = params.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 * 0.5))) if i == j else v / F.col(f"l{j}_{j}"))
    return params


def consistency(support: float, d: int = len(FEATURES)) -> float:
    """Factor that makes the scatter of the nearest `support` share consistent for normal data (even d)."""
    def cdf(x: float, k: int) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid, d) < support else (lo, mid)
    return support / cdf(lo, d + 2)


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def cells(stats: DataFrame) -> DataFrame:
    """(g, x<i>, w): distinct vectors of usable rows with their number, for each group, language and all."""
    own = stats.where(~F.col("base_failed")).groupBy("lang", "source", *FEATURES).agg(F.count("*").alias("w"))
    own = materialize(own, "mcd-vectors")
    views = [own.select(g.alias("g"), *FEATURES, "w") for g in (group(2, "lang", "source"), group(1, "lang"), group(0))]
    return materialize(reduce(DataFrame.union, views).groupBy("g", *FEATURES).agg(F.sum("w").alias("w")), "mcd-cells")


def _medians(rows: DataFrame, prefix: str, values: list[Column]) -> DataFrame:
    """(g, <prefix><i>): the least value that half of a group's rows(g, w) do not exceed."""
    long = rows.select("g", "w", F.posexplode(F.array(*values)).alias("i", "v")).groupBy("g", "i", "v").agg(F.sum("w").alias("w"))
    by = W.partitionBy("g", "i")
    held = long.withColumns({"upto": F.sum("w").over(by.orderBy("v").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("w").over(by)}).where("2 * upto >= all")
    return held.groupBy("g").agg(*(F.min(F.when(F.col("i") == i, F.col("v"))).alias(f"{prefix}{i}") for i in range(len(values))))


def _moments(w: Column, diffs: list[Column]) -> list[Column]:
    return [F.sum(w).alias("n"), *(F.sum(w * y).alias(f"e{i}") for i, y in enumerate(diffs)), *(F.sum(w * diffs[i] * diffs[j]).alias(f"p{i}_{j}") for i, j in _PAIRS)]


def _centred(sums: DataFrame) -> DataFrame:
    """m<i> moved and s<i>_<j> from the sums of moments around the old m<i>: no cancellation."""
    e = lambda i: F.col(f"e{i}") / F.col("n")
    return sums.withColumns({f"s{i}_{j}": F.col(f"p{i}_{j}") / F.col("n") - e(i) * e(j) for i, j in _PAIRS} | {f"m{i}": F.col(f"m{i}") + e(i) for i in range(len(FEATURES))})


def _params(df: DataFrame, scale: float) -> DataFrame:
    """g, start, m<i>, s<i>_<j> times scale, the factor l<i>_<j>, and the log of the determinant."""
    out = _factor(df.withColumns({f"s{i}_{j}": F.col(f"s{i}_{j}") * scale for i, j in _PAIRS}))
    det = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}_{i}") for i in range(len(FEATURES))])
    return out.withColumn("det", det).select("g", "start", *(f"m{i}" for i in range(len(FEATURES))), *(f"{c}{i}_{j}" for c in "sl" for i, j in _PAIRS), "det")


def starts(rows: DataFrame) -> DataFrame:
    """The two starts of each group of rows(g, x<i>, w)."""
    x = [F.col(f) for f in FEATURES]
    middle = materialize(_medians(rows, "m", x), "mcd-medians")
    there = rows.join(small(middle), "g")
    diffs = [c - F.col(f"m{i}") for i, c in enumerate(x)]
    spread = _medians(there, "a", [F.abs(y) for y in diffs]).join(middle, "g").withColumn("start", F.lit(0))
    spread = spread.withColumns({f"s{i}_{j}": F.pow(1.4826 * F.col(f"a{i}"), 2) if i == j else F.lit(0.0) for i, j in _PAIRS})
    sums = there.groupBy("g").agg(*_moments(F.col("w"), diffs)).join(middle, "g").withColumn("start", F.lit(1))
    return materialize(_params(spread, 1.0).unionByName(_params(_centred(sums), 1.0)), "mcd-starts")


def concentrated(rows: DataFrame, params: DataFrame, support: float) -> DataFrame:
    """params after a step: the moments of the nearest share of each group's rows."""
    old = params.select("g", "start", *(f"m{i}" for i in range(len(FEATURES))), *(f"l{i}_{j}" for i, j in _PAIRS))
    there = rows.join(small(old), "g").withColumn("bin", F.floor(F.log(F.greatest(_distance(), F.lit(1e-9))) * BINS))
    diffs = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    bins = there.groupBy("g", "start", "bin").agg(*_moments(F.col("w"), diffs))
    by = W.partitionBy("g", "start")
    near = bins.withColumns({"before": F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"), "all": F.sum("n").over(by)}).where(F.col("before") < F.col("all") * support)
    sums = near.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in ("n", *(f"e{i}" for i in range(len(FEATURES))), *(f"p{i}_{j}" for i, j in _PAIRS))))
    return _params(_centred(sums.join(old.select("g", "start", *(f"m{i}" for i in range(len(FEATURES)))), ["g", "start"])), consistency(support))


def estimates(rows: DataFrame, *, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """(g, m<i>, s<i>_<j>): of all steps from all starts the estimate with the least determinant, for each group of cells."""
    now, best = starts(rows), None
    for k in range(steps):
        now = materialize(concentrated(rows, now, support), f"mcd-step{k}")
        if best is None:
            best = now
            continue
        both = best.join(now.select("g", "start", F.col("det").alias("then")), ["g", "start"])
        fell = both.where(F.col("then") < F.col("det") - 1e-9).limit(1).count()
        if not fell:
            break
        held = best.unionByName(now).groupBy("g", "start").agg(F.min(F.struct("det", *(c for c in best.columns if c not in ("g", "start", "det")))).alias("b"))
        best = materialize(held.select("g", "start", "b.*").select(*best.columns), f"mcd-best{k}")
    won = best.groupBy("g").agg(F.min(F.struct("det", "start", *(f"m{i}" for i in range(len(FEATURES))), *(f"s{i}_{j}" for i, j in _PAIRS))).alias("b"))
    return won.select("g", *(f"b.m{i}" for i in range(len(FEATURES))), *(f"b.s{i}_{j}" for i, j in _PAIRS))


def _drawn(own: DataFrame, wider: DataFrame, on: str, prior: int) -> DataFrame:
    """own(g, n, m, s, ...) as if `prior` rows with the estimate of its wider group were added."""
    up = wider.select(F.col("g").alias("_up"), *(F.col(f"m{i}").alias(f"_m{i}") for i in range(len(FEATURES))), *(F.col(f"s{i}_{j}").alias(f"_s{i}_{j}") for i, j in _PAIRS))
    held = own.join(small(materialize(up, "mcd-wider")), F.col(on) == F.col("_up"))
    a, b = F.col("n") / (F.col("n") + prior), F.lit(prior) / (F.col("n") + prior)
    apart = lambda i: F.col(f"m{i}") - F.col(f"_m{i}")
    held = held.withColumns({f"s{i}_{j}": a * F.col(f"s{i}_{j}") + b * F.col(f"_s{i}_{j}") + a * b * apart(i) * apart(j) for i, j in _PAIRS} | {f"m{i}": a * F.col(f"m{i}") + b * F.col(f"_m{i}") for i in range(len(FEATURES))})
    return held.drop(*up.columns)


def group_params(stats: DataFrame, *, support: float = SUPPORT, prior: int = PRIOR) -> DataFrame:
    """(_g, m<i>, l<i>_<j>) of each language and source, drawn toward its language's, and that toward all."""
    rows = cells(stats)
    found = materialize(estimates(rows, support=support), "mcd-estimates")
    usable = stats.where(~F.col("base_failed"))
    named = lambda level, *by: usable.groupBy(*by).agg(F.count("*").alias("n")).select(group(level, *by).alias("_g"), group(1, "lang").alias("of_lang"), group(0).alias("of_all"), "n")
    own = lambda level, *by: named(level, *by).join(found, F.col("_g") == F.col("g")).drop("_g")
    lang = materialize(_drawn(own(1, "lang"), found, "of_all", prior), "mcd-languages")
    out = _factor(_drawn(own(2, "lang", "source"), lang, "of_lang", prior))
    return materialize(out.select(F.col("g").alias("_g"), *(f"m{i}" for i in range(len(FEATURES))), *(f"l{i}_{j}" for i, j in _PAIRS)), "mcd-groups")


def judged(stats: DataFrame, per: DataFrame, cutoff: float) -> DataFrame:
    """Add distance2 and kept to rows with base_failed, x<i> and g."""
    held = hot_join(stats, per, {"g": "_g"}).withColumn("distance2", _distance())
    held = held.drop(*(c for c in per.columns if c != "_g"))
    return held.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True)))


def quality_rules(docs: DataFrame, *, cutoff: float = CUTOFF, support: float = SUPPORT, prior: int = PRIOR) -> DataFrame:
    """doc_id, key, the statistics, base_failed, distance2 and kept for each row of docs(doc_id, text, lang, source)."""
    rows = docs.select("doc_id", "text", "lang", "source", row_key("doc_id", "text").alias("key"))
    stats = materialize(transformed(statistics(rows)).drop("text"), "quality-stats")
    return judged(stats, group_params(stats, support=support, prior=prior), cutoff)


_BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(*_BASE, "kept", F.round("distance2", 6).alias("distance2"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 returns besides its method's verdict, which SQL can express."""
    return statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*_BASE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, as they came."""
    return without(docs, quality_rules(docs).where(~F.col("kept")))


BASE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT r, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, count(DISTINCT at_) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS at_ FROM again) GROUP BY 1),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d),
dup AS (SELECT r, count(x) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)
"""
