"""Registered queries against their SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import pytest

from citelode.plans import registry, sessions  # noqa: F401 (sessions registers its queries)

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def same_rows(spark_df, con, sql):
    columns = sorted(spark_df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in spark_df.collect()), key=repr)
    assert len(got) == len(want)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want] or got == want


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, str(SF)), duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0


def test_rest_works_without_training_data_operators(tmp_path):
    """Without the subpackage, with or without the pipeline's file, the entry still imports and its queries run."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_idf' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    for gone in (None, copy / "corpus_pipeline.py"):
        if gone:
            gone.unlink()
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, timeout=300)
        subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_registry.py", "-k", "test_entry or q_retry_delays"], cwd=copy, check=True, timeout=300)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "final_rank" in out.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
