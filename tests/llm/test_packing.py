import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mnemospark.llm import packing as P

NAME, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
ODD = ["a \n \n b", "x  y   z  ", " lead", "don't    we\u3000 b", "\n\n a\t b", "<|endoftext|> a", "a\r\n\r\n  b \x85 c ", "é  b", "  ", "   a", " ", "a\u00a0 \u00a0b", "x \x1c y", "ß" * 50, "1234 5678. A", "\t", "a\n b", "a \nb",
       "<|endoftext|>", "a<|endoftext|>b", "a  <|endoftext|>  b", " <|endoftext|><|endoftext|> ", "a <|endoftext|>\n b <|endoftext", "<|endoftext|>a<|between texts|>b", "x <|between texts|>"]


def tokenizer():
    """The tokenizer as its library has it, a text at a time."""
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(NAME))
    return lambda texts: [found.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_units_equal_the_tokenizer(ranks):
    whole = tokenizer()
    r = random.Random(3)
    texts = ODD + ["".join(r.choice([" ", "  ", "\n", "a", "Bc", ".", "é", "1", "'s", "\t", "\u00a0"]) for _ in range(r.randrange(1, 25))) for _ in range(3000 if ranks else 300)]
    units = P.Units(NAME, ranks)
    for t, (ids, cuts) in zip(texts, units.encode(texts), strict=True):
        assert ids.tolist() == whole([t])[0] + [0], repr(t)
        assert cuts[-1] == len(ids) and (np.diff(cuts) > 0).all() and cuts[0] > 0
    assert [x.tolist() for x in units.encode([None, ""])[0]] == [[0], [1]]


def cost(at, pen, ends, window):
    inner, total, last = dict(zip(at, pen, strict=True)), 0.0, 0
    for e in ends:
        n = e - last
        assert 0 < n <= window
        total += P.PER_WINDOW + inner.get(e, P.INSIDE) + (0 if P.is_free(n) else window - n)
        last = e
    return total


def greedy(at, window):
    """Each window as full as the cut points allow."""
    ends, last = [], 0
    for here, nxt in zip(at[1:], [*at[2:], None], strict=True):
        if nxt is None or nxt - last > window:
            ends.append(here)
            last = here
    return ends


def test_plan_is_no_worse_than_filling_up():
    r = random.Random(4)
    for _ in range(200):
        at, pen = [0], [0.0]
        for _ in range(r.randrange(1, 30)):
            at.append(at[-1] + r.randrange(1, 40))
            pen.append(r.choice([0.0, P.SENTENCE]))
        ends = P.plan(at, pen, window=64)
        assert ends[-1] == at[-1] and ends == sorted(set(ends))
        assert cost(at, pen, ends, 64) <= cost(at, pen, greedy(at, 64), 64) + 1e-9


def least_cost(at, pen, window):
    """Every way from cut to cut: one window, or a stretch sliced at multiples of it."""
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            d = at[j] - at[i]
            k = -(-d // window)
            last = d - (k - 1) * window
            # a stretch of several windows is padded to whole ones
            pad = (0 if P.is_free(last) else window - last) if k == 1 else window - last
            best[j] = min(best[j], best[i] + (k - 1) * (P.INSIDE + P.PER_WINDOW) + pad + P.PER_WINDOW + pen[j])
    return best[-1]


@pytest.mark.parametrize("window, longest", [(64, 40), (64, 300), (16, 5), (8, 100)])
def test_plan_is_the_best_there_is(window, longest):
    r = random.Random(window + longest)
    for _ in range(300):
        at, pen = [0], [0.0]
        for _ in range(r.randrange(1, 40)):
            at.append(at[-1] + r.randrange(1, longest))
            pen.append(r.choice([0.0, P.SENTENCE]))
        pen[-1] = 0.0
        want = least_cost(at, pen, window)
        got = cost(at, pen, P.plan(at, pen, window=window), window)
        assert got <= want + 1e-9  # the last window may be split, too


def test_plan_in_blocks_costs_little_more():
    r = random.Random(9)
    at, pen = [0], [0.0]
    for _ in range(6000):
        at.append(at[-1] + r.randrange(1, 60))
        pen.append(r.choice([0.0, P.SENTENCE, P.SENTENCE, P.SENTENCE]))
    whole, ends, start = cost(at, pen, P.plan(at, pen, window=64), 64), [], 0
    for k in range(600, len(at), 600):
        part, kinds = at[start : k + 1], pen[start : k + 1]
        done = P.plan([x - part[0] for x in part], kinds, window=64, final=False)
        ends += [x + part[0] for x in done]
        start = at.index(ends[-1])
    ends += [x + at[start] for x in P.plan([x - at[start] for x in at[start:]], pen[start:], window=64)]
    assert cost(at, pen, ends, 64) <= 1.002 * whole


def test_hot_ids_are_dealt(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, f"some words {i}. And {i} more.", "x") for i in range(400)], "doc_id long, text string, start string")
    rows = P.pack(df.repartition(4), task_bytes=1 << 9).collect()
    assert len({r.sequence_id >> 40 for r in rows}) > 2 and sum(r.start == 0 for r in rows) == 400


def test_plan_slices_long_sentences():
    ends = P.plan([0, 5000, 5010], [0.0, P.SENTENCE, 0.0], window=1024)
    assert ends[-1] == 5010 and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= 1024


def check(rows, corpus):
    whole = tokenizer()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in corpus.items():
        ids = np.array((whole([t])[0] if t else []) + [0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    waste = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and n <= P.WINDOW
        waste += 0 if P.is_free(n) else P.WINDOW - n
    return waste / sum(r.length for r in rows)


def test_round_trip(docs, corpus):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    # these texts have no sentence ends, so only their own ends are free cuts
    assert check(P.pack(one).collect(), corpus) < 0.05


def test_small_blocks_and_many_tasks(docs, corpus):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert check(P.pack(one, task_bytes=4 << 10).collect(), corpus) < 0.06


def test_edges(docs, none):
    assert P.pack(none).collect() == []
    rows = P.pack(docs).collect()
    assert sum(r.doc_id is None and r.doc_tokens == 1 for r in rows) == 1


def test_blocks_carry_over():
    r = random.Random(6)
    packer, held, size = P._Packer(0), [], 0
    total = {}
    for doc in range(300):
        n = r.randrange(1, 400)
        ids = np.arange(n, dtype=np.uint32)
        cuts = np.array(sorted({*r.sample(range(1, n + 1), min(n, 6)), n}))
        packer.add(held, doc, ids, cuts, len(packer.ids) + size)
        total[doc] = n
        size += n
        if size > 5000:
            packer.ids = np.concatenate([packer.ids, *held])
            held, size = [], 0
            packer.pack(False)
    packer.ids = np.concatenate([packer.ids, *held])
    packer.pack(True)
    got = defaultdict(int)
    for d, s, n, c in zip(packer.out["doc_id"], packer.out["start"], packer.out["length"], packer.out["ids_crc32"], strict=True):
        assert s == got[d] and c == zlib.crc32(np.arange(s, s + n, dtype="<u4").tobytes())
        got[d] += n
    assert got == total
