import os

import pytest

from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: A query of each family; `python tests/oracle_check.py SF_DIR` runs all of them.
SOME = ["tokenize_documents", "memory_keywords", "full_retrieval_scored", "context_block_budget", "entity_relations", "hub_entities", "supersede_same_title", "near_duplicate_clusters", "shown_ring_200", "transcript_chunk_budget", "repo_key_plan", "debounced_jobs"]


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "title", "kind", "project_key", "match", "score"] and df.count() == 10


def test_without_the_optional_part(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "mnemospark").mkdir()
    for f in os.listdir(f"{root}/mnemospark"):
        if f != "llm":
            os.symlink(f"{root}/mnemospark/{f}", tmp_path / "mnemospark" / f)
    code = "import __spark_entry__ as e; assert 'keyword_search_topk' in e.queries() and not any(k.startswith('op') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
