"""The record table: rare rows and the history's versions by narrow joins equal those of the full table."""

import datetime as dt

from pyspark.sql import functions as F

from catalog import fixtures as fx
from recordaudit.operators import enrich as en


def made(spark, folder):
    day = [dt.datetime(1995, 3, 1), dt.datetime(1997, 3, 1), None]
    rows = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(0, "INDIA", 0), (1, "FRANCE", 1), (2, "NOWHERE", None)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 0), (2, 1), (2, 1), (3, 2), (4, None)], "c_custkey long, c_nationkey int"),
        "supplier": ([(1, "a", 0), (2, "b", 1), (2, "c", 0), (None, "d", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(1, "x", 3), (2, "y", None), (2, "y", 4)], "p_partkey long, p_brand string, p_size int"),
        "orders": ([(i, 1 + i % 5, "PFO"[i % 3], day[i % 3 if i % 7 else 0]) for i in range(30)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"),
        "lineitem": ([(i % 33, 1 + i % 4, [1, 2, 3, None][i // 3 % 4], i % 5, float(i % 51), 100.0 * i, [0.08, 0.0, 0.04, None][i // 4 % 4],
                       ["A", "R", "N", None][i // 5 % 4], day[0]) for i in range(800)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, "
                     "l_returnflag string, l_shipdate timestamp_ntz")}
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def bag(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_rare_records_are_those_of_the_full_table_and_filter_the_lines(spark, tmp_path):
    folder = made(spark, tmp_path)
    full, rare = fx.records(spark, folder), fx.rare_records(spark, folder)
    assert bag(rare, full.columns) == bag(full.where("status in ('D', 'S')"), full.columns) != []
    assert set(r.status for r in rare.select("status").distinct().collect()) == {"D", "S"}
    plan = rare._jdf.queryExecution().optimizedPlan().toString()
    at = [line for line in plan.splitlines() if "l_tax" in line and "Filter" in line]
    assert any("l_returnflag" in line and "o_orderstatus" not in line for line in at)


def test_history_holds_every_version_of_the_full_table_once(spark, tmp_path):
    folder = made(spark, tmp_path)
    full, versions = fx.records(spark, folder), fx.history(spark, folder)
    own = [c for c in versions.columns if c != "flown"]
    wanted = full.select(*own, fx.is_route_history().alias("flown")).distinct()
    assert bag(versions.distinct(), versions.columns) == bag(wanted, versions.columns) != []
    routes, places = fx.dimensions(spark, folder)
    assert bag(routes, routes.columns) == bag(en.route_dimension(fx.route_history(full), fx.RELATIONS), routes.columns) != []
    assert bag(places, places.columns) == bag(en.airport_dimension(full, fx.RELATIONS), places.columns) != []
    assert bag(fx.known_routes(spark, folder), routes.columns) == bag(routes, routes.columns)
    # Lines carry keys alone to their order and part: texts come after the versions are told apart.
    plan = versions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("s_name") < plan.index("Aggregate") < plan.index("l_returnflag")


def test_lines_meet_their_orders_as_keys_and_flags(spark, tmp_path):
    folder = made(spark, tmp_path)
    plan = fx.history(spark, folder)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line and "l_orderkey" in line and "o_orderkey" in line]
    assert len(joins) == 1
    lines = plan[joins[0] + 1]
    assert "AS ground" in lines and "l_orderkey" in lines and "l_suppkey" in lines and "l_partkey" not in lines
    assert any("LeftSemi" in line and "l_partkey" in line for line in plan[joins[0]:])
