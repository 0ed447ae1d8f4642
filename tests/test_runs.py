"""The processed-day registry: order, repeats, broken runs, resumption."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidebar.plans.runs import DayStore
from tidebar.session import scratch_path


def test_days_are_done_once_in_order(spark):
    day = lambda i: dt.date(2024, 1, i)
    days = spark.createDataFrame([(day(i),) for i in range(1, 8)], "day date")
    whole = days.where(F.dayofmonth("day") != 4)
    data = spark.createDataFrame([(day(i), i) for i in range(1, 8) if i != 6 for _ in range(2)], "day date, x long")  # none on the 6th
    make = lambda due: data.join(due, "day")
    store = DayStore(spark, scratch_path(spark, "days-test"))
    at = lambda: sorted((r.day.day, r.run) for r in store.done().collect())
    seen = lambda: sorted((r.day.day, r.run, r.x) for r in store.rows("x long").collect())
    assert at() == [] == seen()
    store.write_rows("a", store.due(days, whole), make)  # breaks off before it registers
    assert at() == [] == seen()
    assert store.run("a", days, whole, make) and at() == [(i, "a") for i in (1, 2, 3)]
    assert not store.run("a", days, days, make) and store.run("b", days, whole, make) and at() == [(i, "a") for i in (1, 2, 3)]
    store.write_rows("broken", store.due(days, days), make)
    assert seen() == [(i, "a", i) for i in (1, 2, 3) for _ in range(2)]
    assert store.run("c", days, days, make) and at() == [*[(i, "a") for i in (1, 2, 3)], *[(i, "c") for i in (4, 5, 6, 7)]]
    assert seen() == [(i, "a" if i < 4 else "c", i) for i in range(1, 8) if i != 6 for _ in range(2)]
    assert store.run("d", days, days, make) and len(at()) == 7


def test_day_registry_equals_its_sql_with_and_without_a_gap(spark):
    import duckdb

    from tidebar.catalog import load
    from tidebar.session import scratch_path

    q = load()["t5_day_registry"]
    for gap in (None, 2):
        rows = [
            (d * 10 + i, 1, 1, 1, 2.0, 10.0 + i, 0.0, 0.0, f, s, f"2000-01-0{d}")
            for d in range(1, 5) for i, (f, s) in enumerate((f, s) for f in "ANR" for s in "FO") if not (d == gap and i == 3)
        ]
        names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
        root = scratch_path(spark, "registry-test")
        spark.createDataFrame(rows, names).selectExpr("* except(l_shipdate)", "cast(l_shipdate as timestamp_ntz) as l_shipdate").write.parquet(f"{root}/lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{root.removeprefix('file:')}/lineitem.parquet/*.parquet')")
        want = sorted(con.execute(q.oracle()).fetchall())
        assert sorted(tuple(r) for r in q.run(spark, root).collect()) == want and len(want) == 4
