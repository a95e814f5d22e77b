import os

import duckdb
import pytest

from opportunity import driver_queries

DATA = "/root/testdata/sf0.001"


def sql_rows(name):
    con = duckdb.connect()
    for table in ("customer", "events", "lineitem", "orders", "part", "supplier"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found = con.sql(driver_queries.ORACLE_SQL[name])
    return con, found.columns, found.fetchall()


def plain(rows):
    return sorted([tuple(str(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows])


def same_as_sql(spark, name):
    con, columns, want = sql_rows(name)
    found = driver_queries.QUERIES[name](spark, DATA).select(*columns).collect()
    assert plain(found) == plain(want)
    return con, found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_points_of_every_line(spark):
    con, found = same_as_sql(spark, "c10_points_all")
    assert len(found) == con.sql("select count(*) from lineitem").fetchall()[0][0]
    assert {r.game_id % 4 for r in found} == {0, 1, 2, 3}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_evidence_of_every_order(spark):
    con, found = same_as_sql(spark, "j18_evidence_dates_all")
    assert len(found) == con.sql("select count(*) from customer").fetchall()[0][0]
    assert max(r.primary_source for r in found) >= 100 and all(r.primary_source >= 0 for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_every_part_is_in_the_universe(spark):
    con, found = same_as_sql(spark, "t4_observed_universe_all")
    parts = {k for (k,) in con.sql("select p_partkey from part").fetchall()}
    assert parts <= {r.id for r in found}
