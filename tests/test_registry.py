"""Every registered query against its SQL, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from prosegauge.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def cells(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert got.collect() is not None
        return
    want = tables.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert cells(tuple(r[c] for c in columns) for r in got.collect()) == cells(want.fetchall())


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() == 200
    names = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_optional_parts_may_be_missing(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "prosegauge", tmp_path / "prosegauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit()]; print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) == len(registry.QUERIES)
