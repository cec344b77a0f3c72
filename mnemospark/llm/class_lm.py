"""LM scoring with Brown's class-based bigrams.

Each word that the training texts hold `LEAST` times or more is clustered itself; their number and that of the
classes grow with the corpus. The start: each of the `FREQUENT` most frequent words is a unit of its own, all
others share a unit by a hash of their last three characters, and exchange clustering moves units between
classes while the likelihood of the class bigrams rises. Then distributed exchange: for every other word of the
vocabulary its neighbours are counted by class over the whole corpus, and each moves to the class that gains
most of the SHORT that the first-order gain favours (a word of less than LIGHT of both classes to the first), in parallel; this is repeated while the likelihood rises,
ROUNDS times at most. Only rarer words stay with their ending. The training tokens are stored as numbers once, so
that these passes are array arithmetic. A token's probability is that of its
class after the class before it, times that of the word within its class (absolute discounting; what is
discounted is the unknown word's). A text's score includes its end token, which also precedes its first.

Tables: words are counted per chunk of neighbouring documents and summed over the corpus, so the counts are
exact and grow with it; the counts of a chunk's words then meet the chunk's texts by a cogroup. Chunks of too many
rows or bytes (dense, repeated, null or lonely ids) are split by a hash of id and text. A word's neighbours are
counted by class in each task, two numbers a class at most; the counts of words of more than HOT occurrences are
added up in SALTS parts before they meet. What goes
through the driver: the unit bigrams (at most UNITS^2 numbers), the class tables, and ten bytes for each word
of the vocabulary (its hash and class).

Defined cases: null or empty text is one end token; null ids train; rows with an equal id are each scored; of
equally frequent words the first in byte order counts as more frequent; very long texts are scored whole; other
columns are not looked at, whatever their names; without training rows every token is unknown; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, ship, small, table

FREQUENT, ENDINGS, CLASSES, SWEEPS = 511, 512, 64, 8
#: Training count from which a word is clustered itself, and how often all of these may move.
LEAST, ROUNDS, SHORT = 8, 2, 4
#: Share of a class below which a word hardly changes it.
LIGHT = 1e-3
#: Training count beyond which a word's neighbours are added up in parts, and the parts.
HOT, SALTS = 1 << 24, 64
#: Tokens in a row of the stored numbers.
CODED = 1 << 20
#: Unit 0 is the end token; then the frequent words; then the endings.
UNITS = 1 + FREQUENT + ENDINGS
#: Documents in a chunk, by density of ids, and bytes; chunks of more than twice that are split.
CHUNK, CHUNK_BYTES = 4096, 16 << 20
#: Neighbours that a task counts at once.
CONTEXTS = 16_000_000
FOLDS, HELD_OUT = 7, 2
#: The end token as a word: no word holds white space.
END = b"\n"
_CACHE = 1_000_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), END]


class UnitOf(dict):
    """Unit of a word; `frequent` maps the frequent words."""

    def __init__(self, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.frequent = frequent
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
            self.update(self.frequent)
            self[END] = 0
        u = self[word] = 1 + FREQUENT + zlib.crc32(word.rstrip(b".,;:!?)\"'")[-3:]) % ENDINGS
        return u


def class_number(words: int) -> int:
    """Classes for a vocabulary of that many words."""
    return max(CLASSES, round(2 * words ** (1 / 3)))


class ClassOf(dict):
    """(class, place in the vocabulary or -1) of a word: by its place in `keys`, the sorted hashes of the vocabulary, else by its unit."""

    def __init__(self, frequent: dict[bytes, int], of: np.ndarray, keys: np.ndarray, classes: np.ndarray):
        super().__init__()
        self.unit, self.of, self.keys, self.classes = UnitOf(frequent), of, keys, classes

    def __reduce__(self):
        return ClassOf, (self.unit.frequent, self.of, self.keys, self.classes)

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > _CACHE:
            self.clear()
        key = np.uint64(xxhash.xxh64_intdigest(word))
        at = int(np.searchsorted(self.keys, key))
        if at < len(self.keys) and self.keys[at] == key:
            found = int(self.classes[at]), at
        else:
            found = int(self.of[self.unit[word]]), -1
        self[word] = found
        return found

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place in the vocabulary, or -1, of each word."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        if not len(self.keys):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def codes(self, words: list[bytes]) -> np.ndarray:
        """A number for each word: its place, or its unit beyond the vocabulary's."""
        at = self.places(words)
        for i in np.flatnonzero(at < 0):
            at[i] = len(self.keys) + self.unit[words[i]]
        return at

    def class_of_code(self) -> np.ndarray:
        return np.concatenate([self.classes.astype(np.int64), self.of])


def _texts(batch: pa.RecordBatch):
    return zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)


def chunked(docs: DataFrame, rows: int = CHUNK, size: int = CHUNK_BYTES) -> DataFrame:
    """docs(doc_id, text) with the chunk that a row belongs to: neighbouring ids, of bounded rows and bytes."""
    lo, hi, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, round(rows * (hi - lo + 1) / max(n, 1))) if lo is not None else 1
    near = F.coalesce(F.floor((F.col("doc_id").cast("double") - float(lo or 0)) / width), F.lit(-1))
    rough = docs.select("doc_id", "text", near.cast("long").alias("near"))
    held = rough.groupBy("near").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    parts = F.ceil(F.greatest(F.col("n") / rows, F.coalesce("b", F.lit(0)) / size))
    heavy = materialize(held.select(F.col("near").alias("_near"), parts.alias("parts")).where("parts > 2"), "lm-heavy")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "text"), F.col("parts"))).otherwise(0)
    return rough.join(small(heavy), F.col("near") == F.col("_near"), "left").select("doc_id", "text", F.xxhash64("near", part).alias("chunk"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[Counter, set]] = {}
    size = 0

    def flush(chunk: int) -> pa.RecordBatch:
        train, other = held.pop(chunk)
        other.difference_update(train)
        words = [*train, *other]
        counts = np.concatenate([np.fromiter(train.values(), np.int64, len(train)), np.zeros(len(other), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), chunk)), pa.array(words, pa.binary()), pa.array(counts)], ["chunk", "word", "n"])

    for batch in batches:
        for (doc, text), chunk in zip(_texts(batch), batch.column("chunk").to_pylist(), strict=True):
            if chunk not in held:
                for done in [*held] if size > 300_000 else ():
                    yield flush(done)
                size = size if held else 0
                held[chunk] = Counter(), set()
            train, other = held[chunk]
            before = len(train) + len(other)
            if held_out(doc):
                other.update(tokens(text))
            else:
                train.update(tokens(text))
            size += len(train) + len(other) - before
    for done in [*held]:
        yield flush(done)


def _coded(found: ClassOf):
    """The training tokens of each batch as numbers, whole texts, CODED or more tokens a row, an end token first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words get numbers of their own as they come; the codes of new ones are looked up together
        own: defaultdict[bytes, int] = defaultdict(count().__next__)
        codes = np.empty(0, np.int32)
        held: list[bytes] = [END]

        def flush() -> pa.RecordBatch:
            nonlocal own, codes
            at = np.fromiter(map(own.__getitem__, held), np.int64, len(held))
            if len(own) > len(codes):
                new = [*islice(reversed(own), len(own) - len(codes))][::-1]
                codes = np.concatenate([codes, found.codes(new).astype(np.int32)])
            row = codes[at].tobytes()
            if len(own) > _CACHE:
                own, codes = defaultdict(count().__next__), codes[:0]
            del held[1:]
            return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["codes"])

        for batch in batches:
            for doc, text in _texts(batch):
                if not held_out(doc):
                    held += tokens(text)
                    if len(held) > CODED:
                        yield flush()
        if len(held) > 1:
            yield flush()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column("codes"):
            yield np.frombuffer(row.as_buffer(), np.int32)


def _pairs(of_code: np.ndarray, kinds: int):
    """Counts of neighbouring kinds, given the kind of each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds * kinds, np.int64)
        for codes in _rows(batches):
            k = of_code[codes]
            total += np.bincount(k[:-1] * kinds + k[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return run


def pairs(coded: DataFrame, of_code: np.ndarray, kinds: int) -> np.ndarray:
    found = coded.mapInArrow(_pairs(of_code, kinds), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(kinds * kinds)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(kinds, kinds)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, as a signed number, and unit of each word."""
    unit = UnitOf({})
    for batch in batches:
        words = batch.column("word").to_pylist()
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([unit[w] for w in words], pa.int32()), batch.column("c")], ["key", "unit", "c"])


def _classed(found: ClassOf):
    """Add the class of each word."""
    of_code = found.class_of_code()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = of_code[found.codes(batch.column("word").to_pylist())] if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(classes, pa.int32())], ["word", "c", "class"])

    return run


#: Counts of a word's neighbours: a code (a class after it, `classes` more before it, 2 * `classes` for itself) and a number each.
_COUNT = np.dtype([("code", "<u2"), ("n", "<u4")])


def _packed_counts(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct words, and the counts of each as bytes; words in order."""
    counts = np.empty(len(word), _COUNT)
    counts["code"], counts["n"] = code, n
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    offsets = np.append(starts, len(word)).astype(np.int32) * _COUNT.itemsize
    return word[starts], pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(counts.tobytes())])


def _contexts(of_code: np.ndarray, hot: np.ndarray, classes: int):
    """(word, salt, counts) per task; salt is -1 but for hot words."""
    width, words = 2 * classes + 1, len(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS

        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            word, counts = _packed_counts(at // width, at % width, n)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.where(hot[word], salt, -1), pa.int32()), counts], ["word", "salt", "counts"])

        held, size = [], 0
        for codes in _rows(batches):
            at, k = codes.astype(np.int64), of_code[codes]
            same = (at[:-1] == at[1:]) & (at[1:] < words)
            after, before = at[:-1] < words, (at[1:] < words) & ~same
            held += [at[:-1][after] * width + np.where(same, 2 * classes, k[1:])[after], at[1:][before] * width + k[:-1][before] + classes]
            size += len(held[-1]) + len(held[-2])
            if size > CONTEXTS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _dense(parts: list[bytes], classes: int) -> np.ndarray:
    held = np.frombuffer(b"".join(parts), _COUNT)
    return np.bincount(held["code"], held["n"], 2 * classes + 1)


def _added(classes: int):
    """Counts of a word that come in many parts, as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                n = _dense(parts, classes)
                limit = np.iinfo(np.uint32).max
                pieces = []
                while n.any():  # a number beyond 32 bits takes several
                    code = np.flatnonzero(n)
                    counts = np.empty(len(code), _COUNT)
                    counts["code"], counts["n"] = code, np.minimum(n[code], limit)
                    pieces.append(counts.tobytes())
                    n = np.maximum(n - limit, 0)
                out.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, pa.binary())], ["word", "counts"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(table: np.ndarray, logs: np.ndarray, rows: np.ndarray, cols: np.ndarray, a: int, r: np.ndarray, l: np.ndarray, s: float, among: np.ndarray | None = None) -> int:  # noqa: E741
    """Class, of those `among` (a is one), that a word of class a gains most in; table: class bigrams, logs its xlogx, rows and
    cols its sums; r, l: its followers and precursors by class without itself, s: how often it follows itself. As in
    `exchange`, others staying."""
    among = np.arange(len(table)) if among is None else among
    here = int(np.flatnonzero(among == a)[0])
    j, i = np.flatnonzero(r), np.flatnonzero(l)
    to, of = np.ix_(among, j), np.ix_(i, among)
    right, left, dr, dl = table[to], table[of].T.copy(), logs[to], logs[of].T.copy()
    # without the word: less in row a and in column a
    right[here] -= r[j]
    right[:, j == a] -= l[among][:, None]
    right[here, j == a] -= s
    left[here] -= l[i]
    left[:, i == a] -= r[among][:, None]
    left[here, i == a] -= s
    dr[here], dl[here] = _xlogx(right[here]), _xlogx(left[here])
    dr[:, j == a], dl[:, i == a] = _xlogx(right[:, j == a]), _xlogx(left[:, i == a])
    gain = (_xlogx(right + r[j]) - dr).sum(1) + (_xlogx(left + l[i]) - dl).sum(1)
    d = table[among, among].copy()
    d[here] -= r[a] + l[a] + s
    mr, ml = r[among], l[among]
    gain += _xlogx(d + mr + ml + s) - _xlogx(d + mr) - _xlogx(d + ml) + _xlogx(d)
    nr, nl = r.sum() + s, l.sum() + s
    rows, cols = rows[among], cols[among]
    rows[here] -= nr
    cols[here] -= nl
    gain -= _xlogx(rows + nr) - _xlogx(rows) + _xlogx(cols + nl) - _xlogx(cols)
    gain[among == 0] = -np.inf
    c = int(np.argmax(gain))
    return int(among[c]) if gain[c] > gain[here] + 1e-9 else a


def _moved(table: np.ndarray, now: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = len(table)
        logs, rows, cols = _xlogx(table), table.sum(1), table.sum(0)
        # what a small share of text gains in a class: log shares of its followers and precursors there
        follow = np.log(table + 0.5) - np.log(rows + 0.5 * classes)[:, None]
        precede = np.log(table.T + 0.5) - np.log(cols + 0.5 * classes)[:, None]
        follow[0] = precede[0] = -1e9
        rows, cols = np.maximum(rows, 1e-9), np.maximum(cols, 1e-9)
        for batch in batches:
            words, out = batch.column("word").to_numpy(), []
            for first in range(0, len(words), 1024):
                part = words[first : first + 1024]
                held = np.array([_dense(p, classes) for p in batch.column("parts").slice(first, 1024).to_pylist()])
                r, l, s = held[:, :classes], held[:, classes:-1], held[:, -1]  # noqa: E741
                gain = r @ follow.T + l @ precede.T
                weight = np.stack([r.sum(1) + s, l.sum(1) + s], 1)
                best, first_choice = np.argpartition(-gain, min(SHORT, classes - 1), axis=1)[:, :SHORT], gain.argmax(1)
                for k, w in enumerate(part):
                    a = int(now[w])
                    c = int(first_choice[k])
                    # a word whose own class is favoured stays; what is light beside both classes gains what the first order says
                    if c == a or max(weight[k, 0] / min(rows[a], rows[c]), weight[k, 1] / min(cols[a], cols[c])) < LIGHT:
                        out.append(c)
                        continue
                    out.append(best_class(table, logs, rows, cols, a, r[k], l[k], s[k], np.unique(np.append(best[k], a))))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(out, pa.int32())], ["word", "class"])

    return run


def likelihood(table: np.ndarray) -> float:
    """What the classes add to the log-likelihood of the training bigrams."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def distributed_exchange(coded: DataFrame, found: ClassOf, hot: np.ndarray, table: np.ndarray, rounds: int = ROUNDS) -> tuple[ClassOf, np.ndarray]:
    """The vocabulary of `found` moved between classes, and the class bigrams then; table: those before, hot: words to add up in parts."""
    classes = len(table)
    for k in range(rounds if len(found.keys) else 0):
        contexts = coded.mapInArrow(_contexts(found.class_of_code(), hot, classes), "word long, salt int, counts binary")
        if hot.any():
            contexts = materialize(contexts, f"lm-contexts{k}")
            parts = contexts.where("salt >= 0").groupBy("word", "salt").agg(F.collect_list("counts").alias("parts")).select("word", "parts")
            contexts = contexts.where("salt < 0").select("word", "counts").union(parts.mapInArrow(_added(classes), "word long, counts binary"))
        own = contexts.groupBy("word").agg(F.collect_list("counts").alias("parts"))
        moved = own.mapInArrow(_moved(table, found.classes), "word long, class int").toArrow()
        to = found.classes.copy()
        to[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
        if (to == found.classes).all():
            break
        other = ClassOf(found.unit.frequent, found.of, found.keys, to)
        then = pairs(coded, other.class_of_code(), classes)
        if likelihood(then) <= likelihood(table):
            break  # all moved at once: together they may lose
        found, table = other, then
    return found, table


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit (unit 0 alone in class 0) by exchange clustering of the unit bigram counts."""
    n = len(bigrams)
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    order = np.argsort(-bigrams.sum(0), kind="stable")
    of = np.zeros(n, np.int64)
    rest = order[order != 0]
    of[rest] = 1 + np.minimum(np.arange(len(rest)), classes - 2)  # the most frequent alone, the others together
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    b = bigrams.astype(float)
    right, left = b @ member, b.T @ member  # unit to classes, classes to unit
    table = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in rest:
            a, s = of[u], b[u, u]
            r, l = right[u].copy(), left[u].copy()
            if not r.sum() and not l.sum():
                continue
            r[a] -= s
            l[a] -= s  # its neighbours without itself
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= s
            # the sums of the other classes include their pairs with u wherever it goes
            rows, cols = table.sum(1) + l, table.sum(0) + r
            nr, nl = r.sum() + s, l.sum() + s
            gain = (xlogx(table + r) - xlogx(table)).sum(1) + (xlogx(table + l[:, None]) - xlogx(table)).sum(0)
            d = np.diag(table)
            gain += xlogx(d + r + l + s) - xlogx(d + r) - xlogx(d + l) + xlogx(d)
            gain -= xlogx(rows + nr) - xlogx(rows) + xlogx(cols + nl) - xlogx(cols)
            gain[0] = -np.inf
            c = int(np.argmax(gain))
            if gain[c] <= gain[a] + 1e-9:
                c = a
            table[c] += r
            table[:, c] += l
            table[c, c] += s
            if c != a:
                moved += 1
                of[u] = c
                right[:, a] -= b[:, u]
                right[:, c] += b[:, u]
                left[:, a] -= b[u]
                left[:, c] += b[u]
        if not moved:
            break
    return of


class Model:
    """Class transitions and emissions, of bounded size; word counts are looked up elsewhere."""

    def __init__(self, frequent: dict[bytes, int], of: np.ndarray, bigrams: np.ndarray, types: np.ndarray, n: np.ndarray, classes: int = CLASSES, discount: float = 0.5):
        member = np.zeros((len(of), classes))
        member[np.arange(len(of)), of] = 1
        joint = member.T @ bigrams @ member
        share = (joint.sum(0) + 1) / (joint.sum() + classes)
        mass = 1.0  # of the class shares in each row
        self.transition = np.log10((joint + mass * share) / (joint.sum(1, keepdims=True) + mass))
        self.size, kinds = member.T @ n, member.T @ types
        self.frequent, self.of, self.discount = frequent, of, discount
        # the end token's class has no unknown word; a class without words has nothing else
        unknown = np.where(self.size > 0, np.maximum(discount * kinds, 1e-9) / np.maximum(self.size, 1), 1.0)
        self.unknown = np.log10(unknown)
        self.emission = np.log10(np.maximum(self.size, 1))

    def tokens(self, unit: np.ndarray, c: np.ndarray, class0: np.ndarray) -> np.ndarray:
        """log10 probability of each token, given its unit and training count; an end token precedes the first."""
        k = class0[unit]
        before = np.concatenate([[class0[0]], k[:-1]])
        known = np.log10(np.maximum(c - self.discount, 1e-9)) - self.emission[k]
        known = np.where(k == class0[0], 0.0, known)  # the end class holds the end token alone
        return self.transition[before, k] + np.where(c > 0, known, np.where(k == class0[0], 0.0, self.unknown[k]))


def _scored(model: Model | None, found: ClassOf | None, n: int, v: int):
    """Scores of a chunk's texts; without a model the base only."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        words = counts.column("word").to_pylist()
        at = dict(zip(words, range(len(words)), strict=True))
        c = np.array(counts.column("c").to_numpy(), dtype=np.int64)
        base = np.log10((c + 1) / (n + v + 1))
        texts = [tokens(t) for t in docs.column("text").cast(pa.binary()).to_pylist()]
        i = np.fromiter(map(at.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  each text has a token
        ids = docs.column("doc_id").to_pylist()
        out = [ids, [held_out(d) for d in ids], ends - starts, add((c[i] > 0).astype(np.int64)), add(base[i])]
        if model is not None:
            u = np.array(counts.column("class").to_numpy(), dtype=np.int64)
            for k in np.flatnonzero(u < 0):  # words that no training text holds
                u[k] = found.of[found.unit[words[k]]]
            out.append(add(model.tokens(u[i], c[i], model.of)))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())[: len(out)]
        names = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")[: len(out)]
        return pa.table({k: pa.array(x, kind) for k, x, kind in zip(names, out, kinds, strict=True)})

    return run


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The words (chunk, word) of docs(doc_id, text, chunk), the training counts (word, c), N and V."""
    own = materialize(docs.mapInArrow(_counted, "chunk long, word binary, n long"), "lm-chunks", "zstd")
    counts = materialize(own.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return own.select("chunk", "word"), counts, n, v


def fit(docs: DataFrame) -> tuple[Model, ClassOf, DataFrame, int, int]:
    """The model of docs(doc_id, text, chunk), the classes of words, counts (chunk, word, c, class) for all words of a chunk, N and V."""
    own, counts, n, v = counted(docs)
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = {bytes(r["word"]): 1 + i for i, r in enumerate(top)}
    # the words that move on their own: all of the vocabulary but the frequent ones
    listed = counts.where((F.col("c") >= LEAST) & ~F.col("word").isin([F.lit(w) for w in [END, *frequent]]))
    words = listed.mapInArrow(_keys, "key long, unit int, c long").toArrow()
    keys = words.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    units, hot = words.column("unit").to_numpy()[order].astype(np.int64), words.column("c").to_numpy()[order] > HOT
    apart = ClassOf(frequent, np.arange(UNITS), keys[order], units)  # each word in the class of its unit
    coded = materialize(docs.select("doc_id", "text").mapInArrow(_coded(apart), "codes binary"), "lm-coded", "zstd")
    bigrams = pairs(coded, apart.class_of_code(), UNITS)
    classes = class_number(len(keys) + len(frequent))
    of = exchange(bigrams, classes)
    member = np.eye(classes)[of]
    found = ClassOf(frequent, of, keys[order], of[units].astype(np.int16))
    found, table = distributed_exchange(coded, found, hot, member.T @ bigrams @ member)
    discard(coded)  # what was learned from it is here
    classed = materialize(counts.mapInArrow(_classed(found), "word binary, c long, class int"), "lm-classes")
    per = classed.groupBy("class").agg(F.count("*").alias("types"), F.sum("c").alias("n")).toArrow()
    types, size = np.zeros(classes), np.zeros(classes)
    types[per.column("class").to_numpy()], size[per.column("class").to_numpy()] = per.column("types").to_numpy(), per.column("n").to_numpy()
    model = Model({}, np.arange(classes), table, types, size, classes)
    # a chunk read by two tasks has some words twice, with one count
    joined = own.join(classed, "word", "left").select("chunk", "word", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(-1)).alias("class"))
    return model, found, joined, n, v


BASE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    held = chunked(docs)
    model, found, counts, n, v = fit(held)
    schema = f"{BASE}, score double"
    out = held.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_scored(model, found, n, v), schema)
    out = out.withColumns({"train_tokens": F.lit(n).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def base_scores(docs: DataFrame) -> DataFrame:
    """What `score` returns besides the model's score: counts and scoring are the same, and no model is trained."""
    ship(docs.sparkSession)
    held = chunked(docs)
    own, counts, n, v = counted(held)
    counts = own.join(counts, "word", "left").select("chunk", "word", F.coalesce("c", F.lit(0)).alias("c"))
    out = held.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_scored(None, None, n, v), BASE)
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 returns besides its model's score, which SQL can express."""
    return base_scores(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def _crc32(text: str) -> str:
    """crc32 of a short ASCII string in SQL: a fold over its bytes and their bits."""
    bits = "list_reduce(list_prepend({0}, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    step = bits.format("xor(c, b)")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: {step}), 4294967295)"


BASE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), chr(10)) AS w FROM documents),
t AS MATERIALIZED (SELECT r, held_out, unnest(w) AS word FROM d),
c AS MATERIALIZED (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1e0) / (n + v + 1))) AS base_score FROM t LEFT JOIN c USING (word), n GROUP BY 1)
SELECT doc_id, held_out, len(w) AS n_tokens, n_known, CAST((SELECT n FROM n) AS BIGINT) AS train_tokens, round(base_score, 4) AS base_score FROM d JOIN s USING (r)
"""
