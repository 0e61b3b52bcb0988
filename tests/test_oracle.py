"""Every query with SQL equals DuckDB's answer; the others run."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, datetime.date) else repr(x) if not isinstance(x, str) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.environ.get('ORACLE_SF', sf_dir)}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_equals_duckdb(spark, sf_dir, duck, name):
    ours = engine.QUERIES[name](spark, os.environ.get("ORACLE_SF", sf_dir))
    want = duck.execute(engine.ORACLE[name])
    columns = [x[0] for x in want.description]
    assert sorted(ours.columns) == sorted(columns)
    got = rows_of(ours.columns, [tuple(r) for r in ours.collect()])
    assert got == rows_of(columns, want.fetchall()) and got


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert engine.QUERIES[name](spark, sf_dir).count() > 0


#: A month of 120,000 unlike durations; months without a response or a closing; orders outside dim_date or without a date.
MONTHS = {
    "large": (120_000, 1, "TIMESTAMP '1997-03-01' + to_minutes(i % 44640)"),
    "sparse": (8, 3, "CASE i WHEN 5 THEN TIMESTAMP '1999-01-01' WHEN 6 THEN TIMESTAMP '1998-01-02' ELSE TIMESTAMP '1997-03-01' END"),
    "outside": (8, 4, "CASE i WHEN 1 THEN NULL WHEN 2 THEN TIMESTAMP '1992-05-05' WHEN 3 THEN TIMESTAMP '2030-01-01' ELSE TIMESTAMP '1997-03-01' END"),
}


@pytest.mark.parametrize("case", MONTHS)
def test_monthly_medians(spark, sf_dir, tmp_path, case):
    con = duckdb.connect()
    size, months, dates = MONTHS[case]
    tables = {
        "nation": "SELECT 1 AS n_nationkey, 'N' AS n_name",
        "customer": "SELECT 1::BIGINT AS c_custkey, 1 AS c_nationkey",
        "orders": f"SELECT i AS o_orderkey, 1::BIGINT AS o_custkey, CASE i % 2 WHEN 1 THEN 'F' ELSE 'O' END AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, {dates} AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(1, {size} + 1) r(i)",
        "lineitem": "SELECT o_orderkey AS l_orderkey, 2::BIGINT AS l_suppkey, 1 AS l_linenumber, 'A' AS l_returnflag, o_orderdate + to_minutes(o_orderkey * 7919 % 1000003) AS l_shipdate FROM orders WHERE o_orderkey <> 5",
        "events": f"SELECT * FROM '{sf_dir}/events.parquet'",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    ours = engine.QUERIES["approx_pct"](spark, str(tmp_path))
    want = con.execute(engine.ORACLE["approx_pct"])
    columns = [x[0] for x in want.description]
    expected = rows_of(columns, want.fetchall())
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == expected and len(expected) == months


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
