import os

import pytest

import corpus_pipeline as P
from mnemospark.llm.common import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "packing"]
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= ids and len(left) > 0.6 * len(ids)
        ids = left
    rows = P.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids
    per = {}
    for r in rows:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    assert all(per[r.doc_id] == r.doc_tokens for r in rows)


def run_stages(docs):
    for name, stage in P.STAGES:
        docs = materialize(stage(docs.sparkSession, docs, SF), f"edge-{name}")
        yield name, docs


def test_odd_tables(spark, docs, none):
    """Null, empty, very long, repeated rows, null and repeated ids, columns of names that stages use themselves."""
    odd = docs.withColumn("__row__", docs["doc_id"]).withColumn("__ROW___", docs["text_"])
    before, packed = None, None
    for name, out in run_stages(odd):
        if name != "packing":
            assert out.columns == odd.columns
            rows = sorted(map(tuple, out.collect()), key=repr)
            assert before is None or not [r for r in rows if r not in before]
            before = rows
        else:
            packed = out.collect()
    ids = [r[0] for r in before]
    assert before and all(r[odd.columns.index("__row__")] == r[0] for r in before)
    assert sorted({r.doc_id for r in packed if r.doc_id is not None}) == sorted({i for i in ids if i is not None})
    for name, out in run_stages(none):
        assert out.collect() == [], name
