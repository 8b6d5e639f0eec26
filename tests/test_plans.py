"""Physical plans: no all-pairs joins, narrow scans, no row-at-a-time Python."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["agg1_decompose", "agg3_pair_statistics", "agg6_conserving_factor", "agg7_contingency", "agg23_threshold_sweep", "agg27_soft_reconciliation",
         "jn2_district_to_all", "jn4_paired_rows", "jn5_exact_interval_pairs", "jn8_points_in_polygons", "jn9_halo_membership", "jn10_nearest_station",
         "jn11_neighbours_outside_holdout", "ml9_inverse_distance_field", "win1_causal_lags", "win4_neighbour_features", "win8_window_features",
         "set2_duplicate_or_conflict", "src4_content_digest", "agg13_coverage", "agg20_ensemble_members", "rul6_structured_bulletin"]


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_all_pairs_and_no_row_python(spark, name):
    text = plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in text


@pytest.mark.parametrize("name,unread", [("agg7_contingency", "l_shipdate"), ("agg9_heavy_case_scores", "l_tax"), ("src4_content_digest", "l_discount"),
                                         ("jn4_paired_rows", "o_orderstatus"), ("win1_causal_lags", "l_extendedprice")])
def test_scans_read_only_what_is_used(spark, name, unread):
    assert unread not in plan(spark, name)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [In(o_orderpriority" in plan(spark, "jn4_paired_rows")


def test_ensembles_and_text_scans_do_not_shuffle(spark):
    for name in ("src11_allowed_links", "str4_entity_cleanup", "flt1_range_rules"):
        assert "Exchange hashpartitioning" not in plan(spark, name)


def test_villages_are_dealt_before_each_becomes_a_row_a_date(spark):
    from rainweave.plans import routes
    villages = spark.createDataFrame([(1, 1, 1, 2.0, 1.0, 100.0), (2, 1, 1, 1.0, 2.0, 200.0)],
                                     "village_id int, block_id int, district_id int, area_m2 double, climatology double, elevation_m double")
    values = "valid_date string, rainfall_mm double, temp_max_c double, temp_min_c double, humidity_pct double"
    sides = [spark.createDataFrame([(1, d, 6.0, 30.0, 20.0, 50.0) for d in ("2024-07-01", "2024-08-01")], f"{k} int, {values}") for k in ("block_id", "district_id")]
    rows = routes.paired_routes(villages, *sides).paired
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Repartition ") == 2 and rows.count() == 4


def test_dense_days_are_neither_joined_nor_windowed(spark):
    text = plan(spark, "win6_benchmark_lags")
    assert "Window" not in text and "FlatMapGroupsInArrow" in text
    assert not any("date" in line for line in text.splitlines() if "Join" in line)
