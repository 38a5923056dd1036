"""Benchmark: run the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 2, the lower median counts) and BENCH_QUERIES (names, "all" for every query)
come from the environment.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from marketlens.plans import load  # noqa: E402
from marketlens.session import local_session  # noqa: E402

HEADLINE = """
daily_price_rollup hourly_price_rollup bazaar_period_rollup combine_points spike_filter backfill_missing
append_missing_prices centered_median gap_filled_price price_at_date strictly_newer order_book_delta color_consensus
recent_sales active_listings_lowest lowest_bin has_two_enchants enchant_worth_rank best_enchant relevant_enchants
dedup_bids hit_counts assign_ids flatten_attributes encode_attributes attribute_features player_search item_search
star_costs ingredient_counts component_value enchant_value value_columns stream_hour_close stream_hourly_fill
price_history_daily
""".split()


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    queries, _ = load()
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    names = list(queries) if chosen == ["all"] else chosen
    spark = local_session(cpus, "marketlens-bench", int(cpus) if cpus.isdigit() else 8)
    seconds(queries["daily_price_rollup"], spark, sf_dir)  # start the engine
    times = {}
    for name in names:
        times[name] = round(statistics.median_low([seconds(queries[name], spark, sf_dir) for _ in range(runs)]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
