"""The driver's contract: every query runs and, where it has SQL, agrees with DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from merset.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = [n for n in QUERIES if "simple" not in n and "bfs_lex" not in n and n != "mis_size_by_kd"]


def alike(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert alike(df.select(*cols).collect()) == alike(want)


@pytest.mark.parametrize("name", CHEAP)
def test_query_agrees_with_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLES[name])


def test_entry(spark):
    assert e.entry(spark).count() == 12


def test_contract():
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_corpus_operators_can_be_removed(tmp_path):
    """Without their folders, and even with the pipeline's file left behind, the other queries are all there."""
    root = Path(e.__file__).resolve().parent
    shutil.copytree(root / "merset", tmp_path / "merset", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES) and sorted(e.oracle_sql()) == sorted(e.ORACLES))"
    for extra in (None, "corpus_pipeline.py"):
        if extra and (root / extra).exists():
            shutil.copy(root / extra, tmp_path)
        run = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert run.stdout.strip() == "True", run.stderr
