"""Every registered query against its DuckDB oracle on sf0.01: same column
names, same row count, same rows (order-insensitive)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from quire.plans import catalog

from conftest import SF001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return [cols[i] for i in order], out


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE) | {"write_report", "bytes_on_disk"}
    assert set(catalog.QUERIES) <= set(E.queries()) and set(catalog.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    got_cols, got = _canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[key])
    want_cols, want = _canon([d[0] for d in res.description], res.fetchall())
    assert got_cols == want_cols
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    # The whole written section, not only its head.
    assert df.count() == spark.read.parquet(f"{E.SMOKE_DIR}/lineitem.parquet").count() and df.columns[:4] == ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def test_output_column_names_are_unique(spark):
    # The driver sorts result columns by name before comparing.
    for key, fn in catalog.QUERIES.items():
        cols = fn(spark, "/root/testdata/sf0.001").columns
        assert len(cols) == len({c.lower() for c in cols}), key


def test_reports_equal_the_files(spark, monkeypatch):
    import glob
    import os

    made = []
    real = catalog.scratch_path
    monkeypatch.setattr(catalog, "scratch_path", lambda *a: made.append(real(*a)) or made[-1])
    got = E.queries()["write_report"](spark, SF001).collect()
    sizes = [os.path.getsize(p) for p in glob.glob("/" + made[0].removeprefix("file:").lstrip("/") + "/*.parquet")]
    assert [tuple(r) for r in got] == [(60000, len(sizes), sum(sizes), round(sum(sizes) / 1e9, 2))]
    bytes_, files_, gb = E.queries()["bytes_on_disk"](spark, SF001).collect()[0]
    size = os.path.getsize(f"{SF001}/orders.parquet")
    assert (bytes_, files_, gb) == (size, 1, round(size / 1e9, 2))
