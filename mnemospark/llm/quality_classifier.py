"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

A sparse model is fitted on labelled rows: for each target (low quality, toxic) only features that a good
share of its rows have, and clearly more often than others, carry evidence: their log ratio. What a text
lacks is no evidence, so short texts are not suspect. It scores whole texts. Evidence and global
rate give a document probability; their grouped sums per host and per path are shrunk, paths toward their
host and hosts toward the global rate, with strengths estimated by the method of moments around what they are
shrunk to, so that sparse sites say little. A document's verdict is its evidence under the rate that the other
documents of its path and host leave it: its own evidence counts once.

Parameters: LABELLED bounds the labelled rows that are fitted on (those with the least hash of their id);
FEATURES bounds the features of the model. Everything else covers all rows. Weaker features do not help: with all
features that differ by four standard errors, for and against, calibrated by a logistic fit, and with a logistic
regression on all features, held-out labels were found less often and more clean rows were rejected (README).

Defined cases: null text counts as empty; null hosts and paths are groups of their own; without labelled rows
nothing is rejected; rows with equal ids are each judged by their own text; labels with null id or null target are
ignored, repeated labels of an id count once (the worse); of equally telling features the first by name is taken;
very long texts are scored whole; other columns are kept by the stage and not looked at, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, materialize, row_key, ship, small, table, without

LABELLED, FEATURES = 20_000, 4_000
#: Of a feature: standard errors between the classes, share of the target's rows, ratio of the shares.
LEAST_Z, LEAST_SHARE, LEAST_RATIO = 5.0, 0.015, 150.0
TARGETS = ("low", "toxic")
_CACHE = 500_000
_CORE = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?-]+")


#: Lengths of the word beginnings that are features besides the word.
PREFIXES = (4, 5, 6, 7)


def word_features(word: bytes) -> tuple[tuple[str, ...], bool, bool]:
    """The lexical features of a word, whether it is in capitals, whether it carries symbols."""
    w = word.decode("utf-8", "replace")
    core, symbols = [c.lower() for c in _CORE.findall(w) if len(c) > 2], _SYMBOLS.findall(w)
    found = [f"w:{c}" for c in core] + [f"p:{c[:k]}" for c in core for k in PREFIXES if len(c) > k] + [f"s:{s[:3]}" for s in symbols]
    return tuple(found), len(w) > 1 and w.isupper(), bool(symbols)


def shape_features(words: list[bytes], upper: int, symbols: int, lines: list[bytes]) -> list[str]:
    """Binned shares over a whole text: words in capitals, with symbols, equal to the one before; repeated lines."""
    bins = lambda part: 0 if not part else 1 + int(4 * part / max(len(words), 1))
    lines = [x for x in lines if x.strip()]
    again = sum(map(eq, words, islice(words, 1, None)))
    return [f"#u:{bins(upper)}", f"#s:{bins(symbols)}", f"#r:{bins(again)}", f"#l:{(len(lines) - len(set(lines))) * 8 // max(len(lines), 1)}"]


class _Words(dict):
    def __missing__(self, word: bytes):
        if len(self) > _CACHE:
            self.clear()
        found = self[word] = word_features(word)
        return found


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each feature, by the four combinations of labels."""
    words, counts, rows = _Words(), [Counter() for _ in range(4)], np.zeros(4, np.int64)
    for batch in batches:
        for text, low, toxic in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("low").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seq = (text or b"").split()
            own, k = Counter(seq), 2 * low + toxic
            rows[k] += 1
            found: set[str] = set()
            upper = symbols = 0
            for w, m in own.items():
                f, u, s = words[w]
                found.update(f)
                upper += m * u
                symbols += m * s
            found.update(shape_features(seq, upper, symbols, (text or b"").split(b"\n")))
            counts[k].update(found)
    names = [*set().union(*counts), ""]
    columns = [np.array([c[x] for x in names[:-1]] + [r], np.int64) for c, r in zip(counts, rows, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, columns)], ["feature", "n0", "n1", "n2", "n3"])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from docs(doc_id, text) and labels(doc_id, quality, toxic): weights of significant features."""
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null")
    chosen = usable.select("doc_id", (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    chosen = materialize(chosen, "labels")
    seen = docs.select("doc_id", "text").join(small(chosen, limit=LABELLED), "doc_id")
    counts = seen.select("text", "low", "toxic").mapInArrow(_observed, "feature string, n0 long, n1 long, n2 long, n3 long")
    counts = materialize(counts.groupBy("feature").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4))), "features")
    total = counts.where("feature = ''").first()
    model = {"targets": {}}
    of = {"low": ([2, 3], [0, 1]), "toxic": ([1, 3], [0, 2])}
    for target, (yes, no) in of.items():
        many, few = (sum(total[f"n{k}"] for k in ks) if total else 0 for ks in (yes, no))
        rate = (many + 0.5) / (many + few + 1)
        weights: dict[str, float] = {}
        if many and few:
            p1, p0 = ((sum(F.col(f"n{k}") for k in ks) + 0.1) / (n + 0.2) for ks, n in ((yes, many), (no, few)))
            pooled = (p1 * many + p0 * few) / (many + few)
            z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / many + 1 / few))
            found = counts.where("feature <> ''").withColumns({"p1": p1, "p0": p0, "z": z}).where((F.col("z") >= LEAST_Z) & (p1 >= LEAST_SHARE) & (p1 >= LEAST_RATIO * p0))
            for r in found.orderBy(F.desc("z"), "feature").limit(FEATURES).collect():
                weights[r["feature"]] = math.log(r["p1"] / r["p0"])
        model["targets"][target] = {"rate": rate, "weights": weights}
    return model


class Scorer:
    """Evidence (log odds beyond the rate) of whole texts, for each target."""

    def __init__(self, model: dict):
        weights = [model["targets"][t]["weights"] for t in TARGETS]
        self.known = {f: i for i, f in enumerate(sorted(set().union(*weights)))}
        self.gains = np.array([[w.get(f, 0.0) for w in weights] for f in self.known]).reshape(-1, len(TARGETS))
        self.code: dict[bytes, int] = {}
        #: Words that look alike to the model share a kind: its features, capitals, symbols.
        self.kinds: dict[tuple, int] = {}
        self.table: list[tuple] = []

    def _kind(self, word: bytes) -> int:
        f, u, s = word_features(word)
        key = tuple(sorted({self.known[x] for x in f if x in self.known})), u, s
        if key not in self.kinds:
            self.kinds[key] = len(self.table)
            self.table.append(key)
        return self.kinds[key]

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        distinct = set(words)
        if len(self.code) > _CACHE:
            self.code.clear()
        for w in distinct.difference(self.code):
            self.code[w] = self._kind(w)
        n = np.bincount(np.fromiter(map(self.code.__getitem__, words), np.int64, len(words)), minlength=1)
        found: set[int] = set()
        upper = symbols = 0
        for k in np.flatnonzero(n).tolist():
            f, u, s = self.table[k]
            found.update(f)
            upper += int(n[k]) * u
            symbols += int(n[k]) * s
        found.update(self.known[x] for x in shape_features(words, upper, symbols, (text or b"").split(b"\n")) if x in self.known)
        return self.gains[list(found)].sum(0)


def _evidence(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = np.array([scorer(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, len(TARGETS))
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(found[:, i]) for i in range(len(TARGETS)))], [*kept.schema.names, *(f"e_{t}" for t in TARGETS)])

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, n: str, mean: str, around: Column, rate: float) -> float:
    """Prior strength of groups around their priors, by moments: the less they differ from them, the larger it is."""
    spread = F.sum(F.col(n) * F.pow(F.col(mean) - around, 2))
    s, total, square, count = groups.agg(spread, F.sum(n), F.sum(F.col(n) * F.col(n)), F.count("*")).first()
    if not total or count < 2:
        return 100.0
    within = rate * (1 - rate)
    between = (s - (count - 1) * within) / max(total - square / total, 1e-9)
    return min(max(within / between - 1, 1.0), 1e4) if between > 0 else 1e4


def _soft(model: dict, t: str) -> Column:
    """What a document adds to its site: its probability under the global rate."""
    return _sigmoid(F.col(f"e_{t}") + math.log(model["targets"][t]["rate"] / (1 - model["targets"][t]["rate"])))


def posteriors(scored: DataFrame, model: dict) -> DataFrame:
    """Per (host, path): sums s_, prior strengths j_, k_ and the posterior rate r_<target>, path shrunk to host and host to global."""
    paths = scored.withColumns({f"p_{t}": _soft(model, t) for t in TARGETS}).groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS))
    paths = materialize(paths, "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{t}").alias(f"hs_{t}") for t in TARGETS)), "hosts")
    for t in TARGETS:
        rate = model["targets"][t]["rate"]
        j = _strength(hosts.withColumn("m", F.col(f"hs_{t}") / F.col("hn")), "hn", "m", F.lit(rate), rate)
        hosts = hosts.withColumns({f"j_{t}": F.lit(j), f"h_{t}": (F.col(f"hs_{t}") + j * rate) / (F.col("hn") + j)})
    mine = hosts.withColumnRenamed("host", "_host")
    paths = materialize(paths.join(small(mine), paths["host"].eqNullSafe(mine["_host"])).drop("_host"), "paths-of-hosts")
    for t in TARGETS:
        k = _strength(paths.withColumn("m", F.col(f"s_{t}") / F.col("n")), "n", "m", F.col(f"h_{t}"), model["targets"][t]["rate"])
        paths = paths.withColumns({f"k_{t}": F.lit(k), f"r_{t}": (F.col(f"s_{t}") + k * F.col(f"h_{t}")) / (F.col("n") + k)})
    return paths.withColumnsRenamed({"host": "_host", "path": "_path"})


def site(host: Column, path: Column) -> Column:
    """One name for a host and path; nulls have names, too."""
    return F.to_json(F.struct(host.alias("host"), path.alias("path")))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, key, host, path, evidence e_<target>, rate r_<target> left by the others of the site, probability p_<target>, kept."""
    ship(docs.sparkSession)
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    model = fit(docs, labels)
    schema = "doc_id long, key long, host string, path string, " + ", ".join(f"e_{t} double" for t in TARGETS)
    scored = keyed.mapInArrow(_evidence(model), schema)
    scored = materialize(scored.withColumn("site", site(F.col("host"), F.col("path"))), "evidence")
    per = materialize(posteriors(scored, model).withColumn("_site", site(F.col("_host"), F.col("_path"))).drop("_host", "_path", *(f"r_{t}" for t in TARGETS)), "posteriors")
    out = hot_join(scored, per, {"site": "_site"})
    for t in TARGETS:
        own, rate = _soft(model, t), model["targets"][t]["rate"]
        of_host = (F.col(f"hs_{t}") - own + F.col(f"j_{t}") * rate) / (F.col("hn") - 1 + F.col(f"j_{t}"))
        of_path = (F.col(f"s_{t}") - own + F.col(f"k_{t}") * of_host) / (F.col("n") - 1 + F.col(f"k_{t}"))
        out = out.withColumn(f"r_{t}", F.greatest(F.least(of_path, F.lit(1 - 1e-9)), F.lit(1e-9)))
    out = out.select(*scored.columns, *(f"r_{t}" for t in TARGETS)).drop("site")
    out = out.withColumns({f"p_{t}": _sigmoid(F.col(f"e_{t}") + _logit(F.col(f"r_{t}"))) for t in TARGETS})
    return out.withColumn("kept", ~((F.col("p_low") > 0.5) | (F.col("p_toxic") > 0.5)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "host", "path", *(F.round(f"{k}_{t}", 6).alias(f"{k}_{t}") for k in ("e", "r", "p") for t in TARGETS), "kept")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier keeps, as they came."""
    verdict = classify(docs, table(spark, sf_dir, "labels"))
    return without(docs, verdict.where(~F.col("kept")))
