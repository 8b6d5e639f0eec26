"""Block route against district route: which villages differ, and by how much."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rainweave.operators import allocation, comparison
from rainweave.session import cut_lineage

VARIABLES = ["rainfall_mm", "temp_max_c", "temp_min_c", "humidity_pct"]


def village_adjustments(villages: DataFrame) -> DataFrame:
    """Block and district factors for every village; the two conserve different parents."""
    out = allocation.conserving_factor(villages, ["block_id"], "climatology", "area_m2", "elevation_m")
    return allocation.conserving_factor(out, ["district_id"], "climatology", "area_m2", "elevation_m", "district_")


def route(adjusted: DataFrame, forecast: DataFrame, level: str) -> DataFrame:
    key, prefix = ("block_id", "") if level == "block" else ("district_id", "district_")
    rows = allocation.expand_parent(adjusted, forecast, [key])
    rows = allocation.localise(rows, f"{prefix}rainfall_factor", f"{prefix}temperature_adjustment_c",
                               inherited=("humidity_pct",), level=level, status_map=False)
    return rows.select("village_id", "block_id", "valid_date", "area_m2", "elevation_m", "rainfall_mm",
                       F.col(f"{prefix}rainfall_factor").alias("rainfall_factor"),
                       *[f"local_{v}" for v in VARIABLES])


def paired_routes(villages: DataFrame, block_forecast: DataFrame, district_forecast: DataFrame) -> comparison.Paired:
    adjusted = village_adjustments(villages)
    # narrow rows are dealt out before each becomes one a date: a small table's scan is a task or two
    adjusted = adjusted.repartition(int(adjusted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return comparison.pair(route(adjusted, block_forecast, "block"), route(adjusted, district_forecast, "district"),
                           ["village_id", "valid_date"], agree=("block_id",), close=("area_m2",))


def compared(paired: DataFrame) -> DataFrame:
    return comparison.components(paired, "left_rainfall_mm", "right_rainfall_mm", "left_rainfall_factor",
                                 "right_rainfall_factor", "left_local_rainfall_mm", "right_local_rainfall_mm")


def route_report(villages: DataFrame, block_forecast: DataFrame, district_forecast: DataFrame) -> DataFrame:
    """Statistics overall, per date, and per block and date.

    The paired rows feed both the sums and the exact quantiles, so they are written once.
    """
    rows = compared(paired_routes(villages, block_forecast, district_forecast).paired)
    rows = rows.withColumnRenamed("left_block_id", "block_id").withColumnRenamed("left_area_m2", "area_m2")
    rows = cut_lineage(rows.select("valid_date", "block_id", "area_m2", "left_local_rainfall_mm", "right_local_rainfall_mm",
                                   "difference_mm", "source_component_mm", "reference_component_mm"))
    return comparison.pair_stats(rows, [[], ["valid_date"], ["valid_date", "block_id"]],
                                 "left_local_rainfall_mm", "right_local_rainfall_mm", "area_m2")
