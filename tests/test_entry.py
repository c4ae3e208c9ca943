import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)


@pytest.mark.parametrize("name", ["article_filters", "postings_build", "doc_stats", "corpus_stats", "document_frequency", "dictionary_words", "store_stats"])
def test_equals_sql(spark, sf, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == cols
    key = lambda r: tuple(map(str, r))
    mine = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    theirs = sorted(db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({entry.oracle_sql()[name]})").fetchall(), key=key)
    assert mine == theirs


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_works_without_the_training_data_folder(tmp_path, pipeline_left):
    """The entry module imports, and names the engine's queries, where the llm folder is gone, whether
    or not the pipeline's file went with it."""
    import shutil

    shutil.copytree(ROOT / "lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline_left and (ROOT / "corpus_pipeline.py").exists())]:
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ranked_topk' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
