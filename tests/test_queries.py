"""Every query with SQL against DuckDB, and the entry points without the optional parts."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from brindle import plans

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"having_false"}
MAY_BE_EMPTY = EMPTY | {"tpch_q02", "tpch_q11", "tpch_q15", "tpch_q18", "tpch_q20", "tpch_q21", "tpch_q08", "tpch_q07", "tpch_q22", "tpch_q16", "extension_except", "having"}


@pytest.fixture(scope="module")
def con(small):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as from '{small}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_sql(spark, small, con, name):
    df = plans.queries()[name](spark, small)
    theirs = con.execute(plans.oracle_sql()[name])
    names = [x[0] for x in theirs.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(map(repr, map(tuple, df.select(*names).collect())))
    assert mine == sorted(map(repr, theirs.fetchall()))
    assert bool(mine) != (name in EMPTY) or name in MAY_BE_EMPTY


def test_every_query_has_sql_or_a_test():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_parts(tmp_path):
    for x in ROOT.iterdir():
        if x.name in ("brindle", "__spark_entry__.py"):
            os.symlink(x, tmp_path / x.name) if x.is_file() else None
    (tmp_path / "brindle").mkdir()
    for x in (ROOT / "brindle").iterdir():
        if x.name != "llm":
            os.symlink(x, tmp_path / "brindle" / x.name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q, len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, ops, pipeline, _ = out.stdout.split()[-4:]
    assert int(n) == len(plans.queries()) and (ops, pipeline) == ("0", "False")
