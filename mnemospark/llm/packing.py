"""Packing: order-preserving cuts into windows by dynamic programming with monotone queues.

The documents, in order of doc_id, are one stream of token ids (each document ends with `END`). Cut points
are the ends of documents and sentences. A window from cut i to cut j costs its padding, a fixed amount per
window, and a penalty where it truncates: little at a sentence end, nothing at a document end. The best start of
a window lies in a sliding range of f(i) + position(i), held in a monotone queue, so a cut costs amortised
constant time. Lengths that are powers of two need no padding; those starts are looked up exactly. A stretch
between two cuts may also be sliced at exact multiples of the window, however long it is, each slice paying a
larger penalty: what such a stretch costs depends on its start by f(i), position(i) and the remainder of that
alone, so the least over smaller and over larger remainders (two trees of minima) gives the best. The plan is the
least of all plans of these kinds; the last window may further be split into powers of two.

The corpus is dealt by ranges of doc_id and a hash of the text; each task streams its range through blocks of
bounded size and carries what follows the last settled window into the next block. Nothing but one batch and one
block is held in memory. A block's plan is the best up to its end, and TAIL windows before that are planned again
with what follows; a plan that keeps the cut before them costs at most one window more than the best.

Defined cases: null or empty text is its end token alone; null ids come first; rows with equal ids follow one
another; a sentence longer than the window is sliced; very long texts are packed whole; of equally cheap plans one
is taken; other columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

WINDOW, END = 1024, 0
#: Costs in tokens: of any window, of a cut at a sentence end, of a cut inside a sentence.
PER_WINDOW, SENTENCE, INSIDE = 1.0, 2.0, 12.0
#: Windows at the end of a block that are planned again with the next one.
TAIL = 8
#: Tokens of a block, and bytes of Parquet for a task.
BLOCK, TASK_BYTES = 1 << 20, 24 << 20
_UNITS = 600_000
#: A space inside a run of white space, where a cut could change the pieces.
_RUN = re.compile(r"\s (?:\s|\Z)")
_SENTENCE_ENDS = (".", "!", "?", "\n")


@lru_cache(4)
def specials(name: str) -> dict[str, int]:
    """Strings that the tokenizer file makes one token of wherever they stand, with their ids."""
    import public_tokenizers

    with open(public_tokenizers.path(name)) as f:
        held = json.load(f)["added_tokens"]
    if odd := [t for t in held if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"{name}: tokens that depend on what stands beside them: {odd}")
    return {t["content"]: t["id"] for t in held}


def check_same(name: str, pieces: dict[bytes, int]) -> None:
    """That ranked pieces are the whole vocabulary of the tokenizer file, each with its id."""
    import public_tokenizers

    with open(public_tokenizers.path(name)) as f:
        held = json.load(f)
    # byte-level vocabularies write bytes as characters: printable ones as they are, the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = {bytes(map(byte.__getitem__, t)): i for t, i in held["model"]["vocab"].items() if t not in specials(name)}
    if vocabulary != pieces:
        raise ValueError(f"the ranks are not the vocabulary of {name}")


@lru_cache(2)
def encoder(name: str, ranks: str | None):
    """texts -> their ids behind one another, and how many each has. ranks: the same vocabulary as ranked pieces, for a library several times as fast."""
    import public_tokenizers

    if ranks:
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as f:
            pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        check_same(name, pieces)
        # a mark between texts keeps them apart, so that many go into one call
        special = specials(name)
        mark, number = "<|between texts|>", max(*pieces.values(), *special.values()) + 1
        found = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens=special | {mark: number})

        def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if any(mark in t for t in texts):
                return _joined([found.encode(t, allowed_special=set(special), disallowed_special=()) for t in texts])
            parts = [np.array(found.encode(mark.join(texts[a : a + 4096]) + mark, allowed_special={mark, *special}), np.int64) for a in range(0, len(texts), 4096)]
            ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
            at = np.flatnonzero(ids == number)
            return np.delete(ids, at).astype(np.uint32), np.diff(at, prepend=-1) - 1

        return run
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda texts: _joined([e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)])


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size


class Units:
    """Token ids of texts through a table of space-led units.

    A byte-level tokenizer of this kind ends a piece before a space that is not within a longer run of white
    space, so a text is encoded unit by unit and each distinct unit once. Texts with such runs, or with the string of
    a special token, which is that token wherever it stands, are encoded whole.
    """

    def __init__(self, name: str, ranks: str | None = None):
        self.encoded = encoder(name, ranks)
        self.apart = re.compile("|".join([_RUN.pattern, *map(re.escape, specials(name))]))
        self.clear()

    def clear(self) -> None:
        # units to their numbers: text starts, what follows a space, and whole texts
        self.count = count()
        self.heads, self.tails, self.whole = self.tables = [defaultdict(self.count.__next__) for _ in range(3)]
        self.known = [0, 0, 0]
        self.flat, self.first = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.size, self.ends = np.empty(0, np.int64), np.empty(0, bool)

    def _learn(self) -> None:
        """Encode the units that are new in the tables, in order of their numbers."""
        new: list[tuple[int, str]] = []
        for i, (table, lead) in enumerate(zip(self.tables, ("", " ", ""), strict=True)):
            fresh = islice(reversed(table.items()), len(table) - self.known[i])
            new += [(number, lead + unit) for unit, number in fresh] if lead else [(number, unit) for unit, number in fresh]
            self.known[i] = len(table)
        if not new:
            return
        new.sort()
        texts = [unit for _, unit in new]
        flat, size = self.encoded(texts)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.ends = np.concatenate([self.ends, np.fromiter((u.endswith(_SENTENCE_ENDS) or "\n" in u for u in texts), bool, len(texts))])

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end token; where each ends; the offsets behind sentences and texts; which of these are texts' ends."""
        if sum(self.known) > _UNITS:
            self.clear()
        found, sizes, tail = [], [], self.whole[""]
        for t in texts:
            if t:
                if self.apart.search(t):
                    found.append(np.array([self.whole[t]]))
                else:
                    units = t.split(" ")
                    index = np.fromiter(map(self.tails.__getitem__, units), np.int64, len(units))
                    index[0] = self.heads[units[0]]
                    found.append(index)
                sizes.append(len(found[-1]) + 1)
            else:
                sizes.append(1)
            found.append(_NONE + tail)
        self._learn()
        i = np.concatenate(found) if found else np.empty(0, np.int64)
        last = np.cumsum(np.array(sizes, np.int64)) - 1
        lens = self.size[i]
        lens[last] = 1
        stop = np.cumsum(lens)
        total = int(stop[-1]) if len(stop) else 0
        at = np.repeat(self.first[i] - (stop - lens), lens) + np.arange(total)
        text_ends = stop[last]
        at[text_ends - 1] = 0
        ids = self.flat[at] if len(self.flat) else np.zeros(total, np.uint32)
        ids[text_ends - 1] = END
        ends = self.ends[i]
        # behind the last sentence follows the end token alone: no cut between them, nor before any token
        ends[last] = False
        ends[last[np.array(sizes) > 1] - 1] = False
        cuts = stop[ends & (lens > 0)]
        places = np.unique(np.concatenate([cuts, text_ends]))
        return ids, text_ends, places, np.isin(places, text_ends, assume_unique=True)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with the end token, and the offsets behind its sentences and its end."""
        ids, ends, places, _ = self.encode_all(texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return [(ids[a:b], places[(places > a) & (places <= b)] - a) for a, b in zip(starts, ends, strict=True)]


_NONE = np.zeros(1, np.int64)


def is_free(n: int) -> bool:
    return n & (n - 1) == 0


def plan(at: list[int], penalty: list[float], window: int = WINDOW, final: bool = True) -> list[int]:
    """Positions where the windows end, for cut points at positions at[0] = 0 < at[1] < ... with a penalty each.

    Unless final, the last windows are left off: what follows may be packed better.
    """
    n, none = len(at), float("inf")
    cost, back = [0.0] * n, [0] * n
    powers = [window >> k for k in range(1, window.bit_length())]
    place, seen = {0: 0}, bytearray(at[-1] + window + 1)  # cuts by position, and whether there is one
    seen[window] = 1
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost plus position, position, cut
    # starts of sliced stretches: trees of minima by low bits over the remainders of their positions, once from the
    # least remainder up and once from the greatest down; values only fall, so that a tree is right up to where one stays
    up, whose_up, down, whose_down = [none] * (window + 1), [0] * (window + 1), [none] * (window + 1), [0] * (window + 1)
    a_slice = INSIDE + PER_WINDOW
    a_row = a_slice + window
    key = row = rest = j = 0
    while True:
        # cut j as a start
        k = rest + 1
        value = key - row * a_row
        while k <= window and up[k] > value:
            up[k], whose_up[k] = value, j
            k += k & -k
        k = window - rest
        while k <= window and down[k] > value:
            down[k], whose_down[k] = value, j
            k += k & -k
        j += 1
        if j == n:
            break
        # and the next one as an end
        x = at[j]
        far = x - window
        while queue and queue[0][1] < far:
            queue.popleft()
        best, how = (queue[0][0] + window, queue[0][2]) if queue else (none, 0)
        row, rest = divmod(x, window)
        base = row * a_row - a_slice
        k, more = rest, base + a_row  # smaller remainders: a window more
        while k:
            if up[k] + more < best:
                best, how = up[k] + more, whose_up[k]
            k -= k & -k
        k = window - rest
        while k:
            if down[k] + base < best:
                best, how = down[k] + base, whose_down[k]
            k -= k & -k
        best -= x
        ahead = x + window
        for p in powers:
            if seen[ahead - p]:
                i = place[x - p]
                if cost[i] < best:
                    best, how = cost[i], i
        cost[j] = best = best + PER_WINDOW + penalty[j]
        back[j] = how
        key = best + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, x, j))
        place[x] = j
        seen[ahead] = 1
    ends: list[int] = []
    j = n - 1
    while j:
        i = back[j]
        stretch = list(range(at[i] + window, at[j], window)) + [at[j]]
        ends += reversed(stretch)
        j = i
    ends.reverse()
    if not final:
        settled = set(at)
        keep = [e for e in ends[: max(0, len(ends) - TAIL)]]
        while keep and keep[-1] not in settled:
            keep.pop()
        return keep
    # the last window: its padding against a split into powers of two
    if ends:
        start = ends[-2] if len(ends) > 1 else 0
        rest = ends[-1] - start
        parts = [p for p in (1 << k for k in reversed(range(window.bit_length()))) if rest & p]
        if not is_free(rest) and (len(parts) - 1) * (INSIDE + PER_WINDOW) < window - rest:
            ends[-1:] = (start + np.cumsum(parts)).tolist()
    return ends


class _Packer:
    def __init__(self, part: int):
        self.ids, self.cuts, self.kinds, self.docs = np.empty(0, np.uint32), [0], [0.0], []
        self.base = part << 40
        self.out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

    def add(self, held: list[np.ndarray], doc, ids: np.ndarray, cuts: np.ndarray, at: int) -> None:
        """Put a document of the block behind the others; at: where it begins in the block."""
        held.append(ids)
        self.docs.append((doc, at, 0, len(ids), len(ids)))
        self.cuts += (cuts + at).tolist()
        self.kinds += [SENTENCE] * (len(cuts) - 1) + [0.0]

    def add_all(self, held: list[np.ndarray], docs: list, ids: np.ndarray, ends: np.ndarray, places: np.ndarray, of_texts: np.ndarray, at: int) -> None:
        """Put documents behind the others; at: where the first begins in the block."""
        held.append(ids)
        start = 0
        for doc, end in zip(docs, ends.tolist(), strict=True):
            self.docs.append((doc, at + start, 0, end - start, end - start))
            start = end
        self.cuts += (places + at).tolist()
        self.kinds += np.where(of_texts, 0.0, SENTENCE).tolist()

    def pack(self, final: bool) -> None:
        """Emit the settled windows; what follows them stays as the start of the next block."""
        ends = plan(self.cuts, self.kinds, final=final)
        if not ends:
            return
        d, out, pos = 0, self.out, 0
        for e in ends:
            while d < len(self.docs) and self.docs[d][1] < e:
                doc, at, before, n, total = self.docs[d]
                a, b = max(pos, at), min(e, at + n)
                out["doc_id"].append(doc)
                out["start"].append(before + a - at)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(self.ids[a:b].astype("<u4").tobytes()))
                out["doc_tokens"].append(total)
                out["sequence_id"].append(self.base)
                out["offset"].append(a - pos)
                if at + n > e:
                    break
                d += 1
            self.base += 1
            pos = e
        k = self.cuts.index(pos)
        self.cuts, self.kinds = [c - pos for c in self.cuts[k:]], self.kinds[k:]
        self.kinds[0] = 0.0
        kept = []
        for doc, at, before, n, total in self.docs[d:]:
            gone = max(0, pos - at)
            if gone < n:
                kept.append((doc, max(0, at - pos), before + gone, n - gone, total))
        self.docs, self.ids = kept, self.ids[pos:]

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in self.out.values()], list(self.out))
        self.out = {k: [] for k in self.out}
        return batch


def _packed(name: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units, packer = Units(name, ranks), _Packer(TaskContext.get().partitionId())
        held, size = [], 0
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a in range(0, len(docs), 256):
                ids, ends, places, of_texts = units.encode_all(texts[a : a + 256])
                packer.add_all(held, docs[a : a + 256], ids, ends, places, of_texts, len(packer.ids) + size)
                size += len(ids)
                if size >= BLOCK:
                    packer.ids = np.concatenate([packer.ids, *held])
                    held, size = [], 0
                    packer.pack(False)
                    yield packer.take()
        packer.ids = np.concatenate([packer.ids, *held])
        if len(packer.ids):
            packer.pack(True)
        yield packer.take()

    return run


def task_count(df: DataFrame, task_bytes: int) -> int:
    """Tasks for df by the size that the optimizer knows; as many as a shuffle has where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(1, round(size / task_bytes)), 1 << 17)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", task_bytes: int = TASK_BYTES) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    held = docs.select("doc_id", "text")
    dealt = held.repartitionByRange(task_count(held, task_bytes), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.mapInArrow(_packed(tokenizer, ranks), schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the packed sequences."""
    return pack(docs)
