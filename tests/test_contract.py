"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from icspark.operators.program import alerts
from icspark.plans import checks
from icspark.plans.contract import ORACLE_SQL, QUERIES, TABLES

SF = "/root/testdata/sf0.001"
SOME = ["csv_scan", "split_versions", "program_file", "name_case", "guard_large_program", "several_statements", "noise_inject", "ci_chi2_distributed", "bdeu_score_distributed", "fd_lattice", "lasso_program", "bounded_search", "cfd_apply"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cells(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    made = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(made.columns) == sorted(columns)
    assert cells(made.collect(), made.columns) == cells(want.fetchall(), columns)


def changed(folder, table, sql):
    """The smallest tables with one of them replaced by a query of it: a folder, and DuckDB with its views."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if t != table:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    con.execute(f"COPY (SELECT {sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)".replace("SOURCE", f"read_parquet('{SF}/{table}.parquet')"))
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return str(folder), con


def agrees(spark, con, folder, name):
    """The rows of a query, which equal its SQL's."""
    made, want = QUERIES[name](spark, folder), con.execute(ORACLE_SQL[name])
    columns, rows = [d[0] for d in want.description], made.collect()
    assert sorted(made.columns) == sorted(columns)
    assert cells(rows, made.columns) == cells(want.fetchall(), columns)
    return rows


#: One row of twenty is flagged, so no nation is within the 1% of the geo queries.
MUCH_NOISE = "* FROM SOURCE WHERE (l_orderkey * 7 + l_linenumber) % 97 < 20"


def test_detection_without_a_branch(spark, tmp_path):
    folder, con = changed(tmp_path, "lineitem", MUCH_NOISE)
    (row,) = agrees(spark, con, folder, "detect_metrics")
    assert row.tp == row.fp == 0 and row.fn > 0 and row.precision != row.precision


def test_fit_without_a_branch(spark, tmp_path):
    folder, con = changed(tmp_path, "lineitem", MUCH_NOISE)
    assert agrees(spark, con, folder, "fit_branches") == []
    assert len(agrees(spark, con, folder, "force_fit")) > 0


def test_program_file_without_a_branch(spark, tmp_path):
    folder, con = changed(tmp_path, "orders", "* REPLACE (chr((65 + o_orderkey % 26)::INT) AS o_orderstatus, TIMESTAMP '2020-01-01' AS o_orderdate) FROM SOURCE")
    assert agrees(spark, con, folder, "program_file") == []


def test_guards_by_a_program_beyond_the_driver(spark, duck, monkeypatch):
    monkeypatch.setattr("icspark.operators.program.MOST_BRANCHES", 1000)
    for name in ("guard_large_program", "alerts_large_program"):
        assert len(agrees(spark, duck, SF, name)) > 2


def test_a_large_program_broadcasts_no_table_that_grows(spark, monkeypatch):
    """Orders and branches that Spark takes for small by their files are met by a shuffle."""
    monkeypatch.setattr("icspark.operators.program.MOST_BRANCHES", 1000)
    made = alerts(*checks._big(spark, SF))
    assert made.count() > 0
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
