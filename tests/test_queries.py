"""Every registered query with SQL gives the SQL's rows; the entry point imports with and without the corpus operators."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from gossamer import catalog

catalog.load()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    if value is None or value != value:
        return None
    return value if isinstance(value, (bool, str)) else float(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(answer, duck, name):
    got, expected = rows_of(answer(name)), rows_of(duck.execute(catalog.SQL[name]).df())
    assert got[0] == expected[0] and len(got[1]) == len(expected[1])
    for a, b in zip(got[1], expected[1]):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and np.isclose(x, y, rtol=1e-9, atol=1e-6)) for x, y in zip(a, b)), (a, b)


def test_every_query_has_a_name_from_the_inventory():
    import re

    assert all(re.match(r"[A-Z]\d+[a-g]?_", n) for n in catalog.QUERIES)
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_corpus_operators(tmp_path):
    (tmp_path / "gossamer").mkdir()
    for p in (ROOT / "gossamer").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "gossamer" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'op1_token_blocks' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(catalog.QUERIES)), "False"], said.stderr
