"""Every registered query gives what its SQL gives in DuckDB, and needs the library only."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from logloom.jobs import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    cursor = duck.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == order
    assert plain(map(tuple, df.collect()), df.columns, order) == plain(cursor.fetchall(), columns, order)


def test_registry(spark):
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["severity", "n"]


@pytest.mark.parametrize("gone", [("logloom/llm", "tests/llm"), ("logloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_other_subpackage(tmp_path, gone):
    """A copy of the tree without those folders still has all other queries."""
    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or str((Path(d) / n).relative_to(root)) in gone])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'audit_events' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=False).stderr == ""
