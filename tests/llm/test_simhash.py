import random

import numpy as np
import pytest
import xxhash

from mnemospark.llm import simhash as S


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, budget=2):
    """prints: (id, fingerprint) -> component of each row."""
    kinds = sorted({f for _, f in prints})
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(kinds):
        for b in kinds[k + 1 :]:
            if (a ^ b).bit_count() <= budget:
                root[find(b)] = find(a)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in prints), key=repr)


def test_matches_brute_force(docs):
    want = brute_components([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    assert sorted((tuple(r) for r in S.linked(docs).collect()), key=repr) == want
    assert len({c for *_, c in want}) < len(want) - 15


def test_blocks_do_not_matter(monkeypatch):
    r = random.Random(3)
    text = " ".join(r.choice(["a", "Bc", "dé", "x" * 40, "\n", "\x0b"]) for _ in range(3000)).encode()
    whole = S.fingerprint(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(S, "BLOCK", size)
        assert S.fingerprint(text) == whole == brute_print(text.decode())
        for odd in (b"one", b"one  two", b" one two  three ", b"One two three four", b"", b" \n"):
            assert S.fingerprint(odd) == brute_print(odd.decode())


def crowd(r, n):
    """Fingerprints in dense balls, in a path of single bits, in one long prefix, and anywhere."""
    centres = [r.getrandbits(64) for _ in range(4)]
    out = {r.getrandbits(64) for _ in range(n)}
    for c in centres:
        out |= {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 6))) for _ in range(n // 4)}
    out |= {(0xABC << 52) | r.getrandbits(11) for _ in range(n // 4)}
    path = r.getrandbits(64)
    for _ in range(40):
        path ^= 1 << r.randrange(64)
        out.add(path)
    return sorted(out | {0, 2**64 - 1, 1 << 63, 3})


@pytest.mark.parametrize("depth", [0, 1, 4, 60])
def test_descent_finds_all_pairs(depth):
    r = random.Random(depth)
    for _ in range(3):
        a, b = (np.unique(np.array([(p << 64 - depth if depth else 0) | (f >> depth) for f in crowd(r, 60)], np.uint64)) for p in (0, 1 if depth else 0))
        for left in (0, 1, 2):
            low = np.uint64((1 << 64 - depth) - 1)
            near = np.bitwise_count((a[:, None] ^ b[None, :]) & low) <= left
            i, j = S.meet(a, b, depth, left, False)
            assert sorted(zip(i, j, strict=True)) == sorted(zip(*np.nonzero(near), strict=True))
            near = np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= left, 1)
            i, j = S.meet(a, a, depth, left, True)
            assert sorted((min(p), max(p)) for p in zip(i, j, strict=True)) == sorted(zip(*np.nonzero(near), strict=True))


@pytest.mark.parametrize("leaf", [2, 8, 100])
def test_trie_in_spark_connects_the_same(spark, leaf):
    from mnemospark.llm.graph import connected_components

    prints = crowd(random.Random(leaf), 80)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints], "fingerprint long")
    found = connected_components(S.edges(df, leaf=leaf)).collect()
    part = {r.node % 2**64: r.component % 2**64 for r in found}
    want = {}
    for i, (_, h, c) in enumerate(brute_components([(i, f) for i, f in enumerate(prints)])):
        want.setdefault(c, set()).add(int(h, 16))
    mine = {}
    for f in prints:
        mine.setdefault(part.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_empty_and_alike(spark, none):
    assert S.linked(none).collect() == []
    same = spark.createDataFrame([(5, None), (3, ""), (None, " "), (9, "a b c"), (7, "A b  c"), (7, "A b  c"), (None, "lone words here")], "doc_id long, text string")
    h = f"{brute_print('a b c'):016x}"
    lone = f"{brute_print('lone words here'):016x}"
    want = [(5, "0" * 16, 3), (3, "0" * 16, 3), (None, "0" * 16, 3), (9, h, 7), (7, h, 7), (7, h, 7), (None, lone, None)]
    assert sorted(map(tuple, S.linked(same).collect()), key=repr) == sorted(want, key=repr)
