"""The registered queries agree with their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, plain

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("b1_drop_cancelled", "c1_route_distance_join", "c6_enrich_and_clean", "d1_airport_dimension", "e4_class_balance",
          "h1_ordinal_encode", "i7_overall_similarity", "k6_average_precision", "l3_pareto_front", "n7_memorization_report")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    expected = sorted(([plain(r[i]) for i in order] for r in cursor.fetchall()), key=repr)
    rows = entry.queries()[name](spark, FOLDER)
    assert sorted(rows.columns) == names
    assert sorted(([plain(r[n]) for n in names] for r in rows.collect()), key=repr) == expected
