"""Every registered query that has SQL gives DuckDB's rows, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in records:
        out.append(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order))
    return sorted(map(repr, out))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["xxh3_keys"])
def test_runs(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry_without_the_training_data(tmp_path):
    """With the subpackage and the pipeline gone, or a library they need, the other queries are registered."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "blockloom", tmp_path / "blockloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 40 and 'pipeline' not in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
