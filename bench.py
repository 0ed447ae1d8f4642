"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidebar.catalog import load
from tidebar.session import build_session

HEADLINE = [
    "flagship_donchian_performance", "j12_all_variant_returns", "x9_walk_forward_ledger", "x16_feature_table",
    "x17_ranker_panel", "x26_holdings_account", "j1_asof_by_key_hot", "j14_similar_pairs", "x12_running_book",
    "q1_bar_structure", "m9_average_precision", "w_long_series_rolling", "x14_risk_cascade", "f2_clean_text",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n = int(cpus) if cpus.isdigit() else 8
    spark = build_session("bench", f"local[{cpus}]", n, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    qs, secs = load(), {}
    spark.read.parquet(f"{path}/lineitem.parquet").count()
    for name in names:
        t0 = time.time()
        qs[name].run(spark, path).write.format("noop").mode("overwrite").save()
        secs[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(secs.values()), 3), "unit": "sec",
        "queries": secs, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
