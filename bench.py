"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from tapeline.plans import catalogue
from tapeline.session import get_spark

HEADLINE = ["run_screen", "ema", "rsi", "macd", "strategy_metrics", "backtest_strategy", "performance_metrics", "fifo_realized_gains",
            "average_cost_positions", "adjust_all_actions", "settle_forward_asof", "interval_quality", "calibrate_symbol", "instrument_features",
            "chain_reprice", "scenario_margin", "payoff_grid", "resample_bars", "redact_text", "headline_sentiment", "indicator_panel", "regime_label"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.run("traded_volume_flag", spark, sf).collect()  # session warm-up
    times = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        t0 = time.time()
        catalogue.run(name, spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf).replace("sf", "")}))


if __name__ == "__main__":
    main()
