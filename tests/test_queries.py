"""Every query with SQL equals DuckDB on the small tables; the others run and keep their columns."""

import os

import duckdb
import pytest

from aerolith.plans import catalogue

NAMES = sorted(catalogue.SQL)


def _rows(names, rows):
    return sorted((tuple(repr(round(v, 6) if isinstance(v, float) else v) for _, v in sorted(zip(names, r))) for r in rows))


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, data, name):
    made = catalogue.QUERIES[name](spark, data)
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    cursor = con.execute(catalogue.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(made.columns) == sorted(names)
    assert _rows(made.columns, [tuple(r) for r in made.collect()]) == _rows(names, cursor.fetchall())


def test_flagship(spark, data):
    rows = catalogue.flagship(spark, data).collect()
    assert rows and rows[0].icao_code == "KORD"


def test_dispatch_first_is_part_of_all(spark, data):
    every = catalogue.QUERIES["dispatch_all"](spark, data)
    first = catalogue.QUERIES["dispatch_first"](spark, data)
    assert first.count() == every.select("delivery_id").distinct().count()
