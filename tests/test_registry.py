"""Registered queries against their SQL; all of them with ``TILLVIEW_ALL_QUERIES=1``."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from registry.core import ORACLES, QUERIES  # noqa: E402

QUICK = (
    "agg_08_top_customers_by_revenue", "agg_14_items_per_customer_histogram", "agg_15_repurchase_rate",
    "agg_17_product_term_frequency", "agg_22_hourly_orders", "agg_39_tier_summary",
    "bin_03_global_rank", "seg_02_rfm_segment", "fil_18_insights_filter", "src_01_read_transactions",
    "pre_07_customer_recs", "cmp_08_customer_profile", "agg_44_spend_box_by_propensity",
)
NAMES = tuple(QUERIES) if os.environ.get("TILLVIEW_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, folder, name):
    assert check.differences(spark, con, name, queries()[name], oracle_sql().get(name), folder) is None


def test_entry(spark):
    assert entry(spark).count() == 10


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
