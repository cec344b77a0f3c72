"""Reading from where it stopped, sweeps over files, and titles looked up by their pieces."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.engine import Engine
from mnemospark.operators import browse, index
from mnemospark.sources import tails


def got(df):
    return sorted((os.path.basename(r.file), r.line, r["at"], r.value) for r in df.collect())


def test_batch_reads_what_was_appended(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "sub" / "b.jsonl"
    b.parent.mkdir()
    a.write_bytes("one\nzwei ü\n\nthree".encode())
    b.write_bytes(b"")
    (tmp_path / "other.txt").write_text("no\n")
    assert got(tails.read_new(spark, str(tmp_path))) == [("a.jsonl", 0, 0, "one"), ("a.jsonl", 1, 4, "zwei ü"), ("a.jsonl", 2, 12, ""), ("a.jsonl", 3, 13, "three")]
    assert len(got(tails.read_new(spark, str(a), unterminated=False))) == 3
    with a.open("ab") as f:
        f.write(b" more\nfour\n")
    b.write_bytes(b"x\n")
    # what lies before the offsets is not even readable text
    with a.open("r+b") as f:
        f.write(b"\xff\xff\xff")
    assert got(tails.read_new(spark, str(tmp_path), {str(a): (13, 3)})) == [("a.jsonl", 3, 13, "three more"), ("a.jsonl", 4, 24, "four"), ("b.jsonl", 0, 0, "x")]
    assert got(tails.read_new(spark, str(a), {str(a): (29, 5)})) == [] and len(got(tails.read_new(spark, str(a), {str(a): (999, 5)}))) == 5  # shorter than it was


def test_stream_takes_lines_when_they_end(spark, tmp_path):
    a = tmp_path / "in" / "a.jsonl"
    a.parent.mkdir()
    a.write_bytes(b"one\ntw")

    def run():
        q = tails.stream_new(spark, str(a.parent)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination()
        return sorted((r["at"], r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(0, "one")]
    for text, want in ((b"o", [(0, "one")]), (b"\nthree\nf", [(0, "one"), (4, "two"), (8, "three")]), (b"our\n", [(0, "one"), (4, "two"), (8, "three"), (14, "four")])):
        with a.open("ab") as f:
            f.write(text)
        assert run() == want


def test_sweep(spark, tmp_path):
    now = 2_000_000
    e = Engine(spark, str(tmp_path / "s"), lambda: now)
    files = tmp_path / "t"
    files.mkdir()

    def put(name, text, age):
        (files / name).write_text(text)
        os.utime(files / name, (now - age, now - age))
        return str(files / name)

    paths = {n: put(f"{n}.jsonl", text, age) for n, text, age in [("behind", "a\nb\nc", 600), ("read", "a\nb\n", 600), ("busy", "a\nb\nc\n", 10), ("old", "a\n", 30 * 86_400), ("missed one", "a\n", 4000), ("empty", "", 600)]}
    rows = [(n, "p", paths[n], "c", False, 5) for n in ("behind", "read", "busy", "old")]
    e.touch(spark.createDataFrame(rows, "id string, project_key string, path string, cwd string, agent boolean, at long"))
    e.clock = lambda: now - 5000  # read before the files changed
    e.set_cursor(spark.createDataFrame([("behind", "p", 1), ("read", "p", 2)], "id string, project_key string, line long"))
    e.clock = lambda: now
    want = [("behind", 1, False, True), ("missed one", 1, True, False)]
    assert sorted((r.id, r.unread, r.final, r.known) for r in e.sweep(str(files)).collect()) == want
    e.sweep(str(files), adopt=True)
    assert {r.id: r.path for r in e.sessions.collect()}["missed one"] == paths["missed one"]
    assert sorted((r.id, r.known) for r in e.sweep(str(files)).collect()) == [("behind", True), ("missed one", True)]


def test_substrings(spark):
    r = random.Random(1)
    titles = ["".join(r.choice("aAbB üÜ.") for _ in range(r.randrange(0, 9))) for _ in range(80)] + ["", "a", "ab", "A%b_", "aaa"]
    mem = spark.createDataFrame([(f"{i:016x}".ljust(64, "0"), f"{i:016x}", t, "rule", False) for i, t in enumerate(titles)], "hash string, id string, title string, kind string, pinned boolean").cache()
    g = mem.select(F.explode(index.grams_of(F.lower("title"))).alias("gram"), F.lit("title").alias("kind"), F.col("hash").alias("key")).cache()
    for needle in ("a", "ab", "AB ", "üa", "aab.", "b_", "%", "zz", "aaaa", f"{3:016x}"):
        assert sorted(map(tuple, browse.targets(mem, needle, limit=99, grams=g).collect())) == sorted(map(tuple, browse.targets(mem, needle, limit=99).collect())), needle


@pytest.mark.parametrize("needle", ["the", "an"])
def test_pieces_are_a_small_share(spark, needle):
    titles = [(f"{i:064x}", w) for i, w in enumerate(["the loader"] + [f"plain {i} words" for i in range(300)] + ["an index"])]
    g = spark.createDataFrame(titles, "hash string, title string").select(F.explode(index.grams_of(F.lower("title"))).alias("gram"), F.lit("title").alias("kind"), F.col("hash").alias("key"))
    assert index.containing(g, "title", needle).count() == 1
