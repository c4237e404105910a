"""Every query with SQL against DuckDB on the same tables, and what the driver's contract asks."""

import os
import subprocess
import sys

import duckdb
import pytest

from crivo.plans import catalog


def comparable(rows):
    def cell(v):
        if isinstance(v, float):
            return round(v, 6)
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_like_its_sql(spark, sf, tables, name):
    df = catalog.QUERIES[name](spark, sf)
    found = tables.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.select(*(f"`{c}`" for c in columns)).collect()) == comparable(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_training_data_operators(tmp_path):
    """Nothing else imports that subpackage, and the entry point does without it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys\nsys.modules['crivo.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries() if n[2:3].isdigit())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
