"""Registered queries against their SQL on the smallest tables.

A spread of families by default; RAINWEAVE_ALL=1 runs every query (tests/oracle.py does so too).
"""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SPREAD = ["agg1_decompose", "agg4_route_statistics", "jn4_paired_rows", "agg11_segment_skill", "agg22_average_precision",
          "top2_best_threshold", "top9_class_breaks", "win2_trailing_means", "win4_neighbour_features", "jn8_points_in_polygons",
          "win7_rate_to_amount", "jn5_exact_interval_pairs", "flt1_range_rules", "src4_content_digest", "set2_duplicate_or_conflict",
          "src8_bulletin_text", "agg19_ensemble_summary", "agg27_soft_reconciliation", "rul6_structured_bulletin", "ml6_ridge",
          "src6_daily_grid_decode", "snk2_activation_history"]
NAMES = list(entry.queries()) if os.environ.get("RAINWEAVE_ALL") else SPREAD
ORACLES = entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    _, _, verdict = compare(spark, connect(SF), SF, name, entry.queries()[name], ORACLES.get(name))
    assert verdict in ("ok", "rows only"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
