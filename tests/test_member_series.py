"""Rules about members read no other symbol's rows, and the panel is shuffled to its series and its dates once each."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidebar.plans import portfolio, universe


def test_panel_shuffles_and_member_account(spark):
    rows = [(f"S{s}", datetime(2024, 1, 1) + timedelta(days=d), 10.0 + (s * 7 + d * 3) % 5, 100.0 * (9 - s) + d) for s in range(8) for d in range(12) if (s + d) % 9]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, quote_volume double")
    panel = universe.ranker_panel(bars, 1, 0.0, 3, 1, 2)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    # series and dates of the rows, and of the calendar; the rows went to their series and to their dates twice before
    assert plan.count("Exchange hashpartitioning(") <= 4
    some = universe.member_series(panel)
    assert 0 < some.select("symbol").distinct().count() < 8
    held = portfolio.equal_weight_members(panel)
    ordered = lambda df: [tuple(r) for r in df.orderBy("date").collect()]
    assert ordered(portfolio.holdings_account(held, some, calendar=panel)) == ordered(portfolio.holdings_account(held, panel))
