import ast
import glob
import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lacquer.plans import registry

ROOT = Path(__file__).resolve().parents[1]
SQL = registry.oracle_sql()


def canonical(df: pd.DataFrame):
    def v(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        if isinstance(x, bool):
            return str(int(x))
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.9g}"
        return str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(v, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert canonical(registry.queries()[name](spark, sf).toPandas()) == canonical(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    rows = df.collect()
    assert df.columns and all(len(r) == len(df.columns) for r in rows)


def test_core_does_not_import_llm():
    for f in (ROOT / "lacquer").rglob("*.py"):
        if "llm" in f.relative_to(ROOT / "lacquer").parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("lacquer.llm") for n in names), f


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(e.oracle_sql()) <= set(e.queries())
