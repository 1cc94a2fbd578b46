import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from fabula import plans

ROOT = Path(__file__).resolve().parents[1]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    want = duck.sql(plans.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b and a


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_has_rows(spark, sf, name):
    assert not plans.queries()[name](spark, sf).isEmpty()


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['fabula.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'doc_keywords' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "fabula").rglob("*.py"):
        if "llm" not in f.parts:
            assert "fabula.llm" not in f.read_text(), f
