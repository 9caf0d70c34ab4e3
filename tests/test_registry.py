"""The registry: every query resolves, and a few run against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from tapeline.plans import catalogue
from tapeline.sources.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_twins_exist():
    assert set(catalogue.names()) <= set(queries())
    assert not set(catalogue.names()) - set(oracle_sql())


def test_entry(spark):
    assert "symbol" in entry(spark).columns


# A spread of the registry; ALL_TWINS=1 compares every query, which takes some minutes.
SPREAD = ["ohlcv_scan", "sma", "macd", "price_contract", "interval_quality", "max_pain", "stream_bars", "fifo_realized_gains", "universe_reconcile", "adaptive_conformal",
          "redact_text", "regime_weights", "portfolio_valuation", "evaluate_tier", "walk_forward_origins", "settlement_stream", "har_rv"]


@pytest.mark.parametrize("name", catalogue.names() if os.environ.get("ALL_TWINS") else SPREAD)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    msg, _, _, ok = compare(spark, con, SF, name, queries()[name], oracle_sql()[name])
    assert ok, msg
