"""Every registered query against its DuckDB oracle on the smallest testdata."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from riskflow.catalog import QUERIES as CATALOG

SF = "/root/testdata/sf0.001"
BASE = ("region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "approvalid" in df.columns


def test_every_query_has_an_oracle():
    assert set(CATALOG) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(CATALOG))
def test_query_matches_oracle(spark, duck, key):
    sdf = entry.queries()[key](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(entry.oracle_sql()[key])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert _digest(srows, sdf.columns) == _digest(drows, rel.columns)
