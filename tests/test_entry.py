"""The driver's contract."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
SMALL = ["semantic_topk", "tfidf_topk", "rrf_topk", "eval_metrics_per_query", "extract_contacts", "date_first_range", "name_validate", "upsert_force", "partial_update", "sections_forward_fill", "stream_dedup_ingest"]
PARSER = ["strip_dates", "date_ranges_all", "org_shapes", "skill_items", "fuzzy_indel", "scorer_prompts", "scorer_fallback", "embedding_batches", "ingest_messages", "date_ranges_sql", "skill_items_sql", "experience_blocks", "education_blocks", "page_lines", "vacancy_updates", "hash_backfill"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    shutil.copytree(f"{ROOT}/rankspark", tmp_path / "rankspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rrf_topk' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SMALL + PARSER)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    got = entry.queries()[name](spark, DATA)
    expected = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: [str(v) for v in r]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(expected.fetchall(), key=key)
