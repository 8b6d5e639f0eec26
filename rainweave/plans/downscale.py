"""Footprint training and district downscaling, end to end."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rainweave.operators import allocation, covariates as K, ensemble as E, models as M, rules as R, spatial as X
from rainweave.session import cut_lineage

FEATURES = ["elevation_mean", "elevation_std", "slope_mean", "aspect_mean", "lulc_tree_pct", "lulc_crop_pct", "lulc_urban_pct",
            "lulc_water_pct", "dist_to_coast_km", "dist_to_water_km", "historical_rain_bias"]


def training_rows(observations: DataFrame, covariates: DataFrame, station: str = "station_id", district: str = "district",
                  date: str = "date", value: str = "rainfall_mm", x: list[str] = FEATURES) -> DataFrame:
    """Station deviations from their district mean with the covariates of the nearest village.

    The nearest village is looked up once per station, not once per observation. Checks, fits and
    scores all read the rows, so they are written once.
    """
    rows = allocation.decompose(observations, [district, date], value)
    places = observations.groupBy(station).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    near = X.nearest(places, covariates, station, "panchayat_id", ["lat", "lon"], ["centroid_lat", "centroid_lon"])
    near = near.select(station, "panchayat_id").join(covariates.select("panchayat_id", *x), "panchayat_id").drop("panchayat_id")
    return cut_lineage(rows.join(near, station))


def train(rows: DataFrame, x: list[str] = FEATURES, target: str = "deviation", trees: int = 60):
    """Boosted footprint model and leave-one-station-out linear predictions for its residuals."""
    from rainweave.operators.selection import target_guard
    target_guard(rows, target, strict=True)
    return M.fit_amount(rows, x, target, "squared", trees)


def logo_boosted(rows: DataFrame, station: str, x: list[str], target: str, folds: list, trees: int = 20, at_once: int = 4) -> DataFrame:
    """Out-of-sample mean prediction per fold value, one boosted fit per fold, `at_once` of them side by side.

    The rows are written once for all fits. Rows without a fold value are in no fold: every model learns from them, and
    none predicts them. A fold without rows has no prediction.
    """
    rows = cut_lineage(rows)

    def fold(value):
        own = F.col(station).eqNullSafe(F.lit(value))
        model = M.fit_amount(rows.where(~own), x, target, "squared", trees)
        return model.transform(M.assemble(rows.where(own), x)).groupBy(station).agg(F.avg("prediction").alias("prediction"))

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(fold, [f for f in folds if f is not None]))
    return reduce(DataFrame.unionByName, parts)


def downscale(villages: DataFrame, stations: DataFrame, group: str, factors: list[float], noises: list[float],
              method: str | None = None) -> DataFrame:
    """Parent + deviation + residual field -> ensemble -> local weather and dominant factor.

    `villages` carries covariates, block_rain, block_tmax, block_tmin, rain_deviation and
    temp_deviation; `stations` carries lat, lon and residual. The field and the final join read the villages four times,
    so they are written once.
    """
    villages = cut_lineage(villages)
    field = M.residual_field(villages, stations, group, "panchayat_id", "centroid_lon", "centroid_lat", "residual", "slon", "slat", method)
    rows = villages.join(field, "panchayat_id").withColumn("relief", K.topographic_variability())
    rows = E.ensemble_summary(E.ensemble(rows, "block_rain", "rain_deviation", "residual", "relief", factors, noises))
    rows = K.local_weather(rows.withColumnRenamed("ensemble_mean", "downscaled_rain_pred"), "downscaled_rain_pred", "block_tmax",
                           "block_tmin", "temp_deviation")
    return rows.withColumn("dominant_factor", R.dominant_factor()).drop("members", "relief")
