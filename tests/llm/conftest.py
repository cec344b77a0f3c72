import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, n_words string, _id long, component_id string, text_ string"


def words(r, n, base="w"):
    return [f"{base}{r.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts by id: originals, exact and near copies, short, empty, null, very long, shared passages, odd characters."""
    r = random.Random(5)
    out: dict[int, str | None] = {}
    originals = [words(r, r.randrange(40, 300)) for _ in range(60)]
    passage = words(r, 60, "shared")
    for i, w in enumerate(originals):
        out[i] = " ".join(w)
    for i in range(60, 90):  # near copies with a few edits
        w = list(originals[i % 12])
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = f"edit{i}"
        out[i] = "\n".join(w) if i % 2 else " ".join(w)
    base = words(r, 150, "hot")
    for i in range(90, 150):  # a large group of near copies
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"hotedit{r.randrange(100000)}"
        out[i] = " ".join(w)
    for i in range(150, 190):  # a passage that many share
        out[i] = " ".join(words(r, r.randrange(30, 200)) + passage + words(r, 20))
    out |= {200: None, 201: "", 202: "  \n\t ", 203: "One", 204: "one", 205: "one two three four", 206: "ONE two\tthree four", 207: "Éa Öb éa \x0b x y ÉA"}
    out[208] = " ".join(words(r, 25_000))
    out[209] = "loop " * 500
    out[210] = "a.\nb.\na.\n\n \nb.\nc #*$ <b> & | %"
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", None, "s0"][i % 4], len(t or ""), "k", 7, "n", 9, "c", "t") for i, t in corpus.items()]
    rows += [rows[0], rows[0], (None, "null id " * 30, "en", "s0", 1, "k", 7, "n", 9, "c", "t"), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
