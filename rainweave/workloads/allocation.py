"""Conserving allocation over customers, nations and regions."""

from pyspark.sql import functions as F

from rainweave.operators import allocation as A
from rainweave.operators.distributed import group_stats
from rainweave.plans import routes
from rainweave.workloads import inputs as I
from rainweave.workloads.registry import query, spark_view, table


def villages(spark, sf):
    return spark_view(spark, sf, I.VILLAGES)


def block_forecast(spark, sf):
    return spark_view(spark, sf, I.BLOCK_FORECAST)


def district_forecast(spark, sf):
    return spark_view(spark, sf, I.DISTRICT_FORECAST)


@query("agg1_decompose", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v,
                  round_even(avg(l_extendedprice) OVER (PARTITION BY l_suppkey, l_returnflag), 2) AS group_mean
           FROM {lineitem})
SELECT l_orderkey, l_linenumber, group_mean, round_even(v - group_mean, 2) AS deviation FROM x""")
def agg1(spark, sf):
    df = table(spark, sf, "lineitem")
    return A.decompose(df, ["l_suppkey", "l_returnflag"], "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "group_mean", "deviation")


@query("agg2_reconstruct", """
SELECT l_orderkey, l_linenumber,
       greatest(0e0, round_even(l_quantity + l_discount * 10 - l_extendedprice / 2000, 2)) AS value
FROM {lineitem}""")
def agg2(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({
        "deviation": F.col("l_discount") * 10, "residual": -F.col("l_extendedprice") / 2000})
    return df.select("l_orderkey", "l_linenumber", A.reconstruct("l_quantity", "deviation", "residual").alias("value"))


@query("agg6_conserving_factor", f"""
SELECT village_id, round(rainfall_factor, 9) AS rainfall_factor, round(temperature_adjustment_c, 6) AS dt,
       round(district_rainfall_factor, 9) AS district_rainfall_factor,
       round(district_temperature_adjustment_c, 6) AS district_dt
FROM ({I.ADJUSTED})""")
def agg6(spark, sf):
    out = routes.village_adjustments(villages(spark, sf))
    return out.select("village_id", F.round("rainfall_factor", 9).alias("rainfall_factor"),
                      F.round("temperature_adjustment_c", 6).alias("dt"),
                      F.round("district_rainfall_factor", 9).alias("district_rainfall_factor"),
                      F.round("district_temperature_adjustment_c", 6).alias("district_dt"))


@query("agg6_conservation_check", f"""
SELECT block_id, valid_date, round(max(rainfall_mm), 6) AS parent_mm,
       round(sum(rainfall_mm * rainfall_factor * area_m2) / sum(area_m2), 6) AS area_mean_mm
FROM ({I.ROUTE_BLOCK}) GROUP BY block_id, valid_date""")
def agg6_check(spark, sf):
    rows = A.expand_parent(A.conserving_factor(villages(spark, sf), ["block_id"], "climatology", "area_m2"),
                           block_forecast(spark, sf), ["block_id"])
    local = F.col("rainfall_mm") * F.col("rainfall_factor")
    return group_stats(rows, ["block_id", "valid_date"], parent_mm=F.round(F.max("rainfall_mm"), 6),
                       area_mean_mm=F.round(F.sum(local * F.col("area_m2")) / F.sum("area_m2"), 6))


@query("jn1_parent_to_children", f"""
SELECT village_id, valid_date, round(rainfall_mm, 8) AS rainfall_mm
FROM ({I.VILLAGES}) v JOIN ({I.BLOCK_FORECAST}) f USING (block_id)""")
def jn1(spark, sf):
    return A.expand_parent(villages(spark, sf), block_forecast(spark, sf), ["block_id"]).select(
        "village_id", "valid_date", F.round("rainfall_mm", 8).alias("rainfall_mm"))


@query("jn2_district_to_all", f"""
SELECT village_id, valid_date, round(rainfall_mm, 8) AS rainfall_mm
FROM ({I.VILLAGES}) v JOIN ({I.DISTRICT_FORECAST}) f USING (district_id)""")
def jn2(spark, sf):
    return A.expand_parent(villages(spark, sf), district_forecast(spark, sf), ["district_id"]).select(
        "village_id", "valid_date", F.round("rainfall_mm", 8).alias("rainfall_mm"))


@query("jn3_adjustment_lookup", f"""
SELECT o_orderkey, round(o_totalprice * rainfall_factor, 4) AS adjusted
FROM {{orders}} JOIN ({I.ADJUSTED}) a ON o_custkey = village_id""")
def jn3(spark, sf):
    adjusted = routes.village_adjustments(villages(spark, sf)).select("village_id", "rainfall_factor")
    rows = A.lookup(table(spark, sf, "orders").withColumnRenamed("o_custkey", "village_id"), adjusted, ["village_id"])
    return rows.select("o_orderkey", F.round(F.col("o_totalprice") * F.col("rainfall_factor"), 4).alias("adjusted"))


@query("prj1_local_values", f"""
SELECT village_id, valid_date, local_rainfall_mm, local_temp_max_c, local_temp_min_c, local_humidity_pct,
       round_even(local_rainfall_mm - rainfall_mm, 4) AS adjustment_mm
FROM ({I.ROUTE_BLOCK})""")
def prj1(spark, sf):
    adjusted = A.conserving_factor(villages(spark, sf), ["block_id"], "climatology", "area_m2", "elevation_m")
    rows = A.localise(A.expand_parent(adjusted, block_forecast(spark, sf), ["block_id"]), "rainfall_factor",
                      "temperature_adjustment_c", inherited=("humidity_pct",), status_map=False)
    return rows.select("village_id", "valid_date", "local_rainfall_mm", "local_temp_max_c", "local_temp_min_c",
                       "local_humidity_pct", "adjustment_mm")


@query("map1_variable_status", f"""
SELECT block_id, valid_date, 'experimental proxy-climatology transfer; local skill unverified' AS rain_status,
       'experimental DEM lapse-rate adjustment' AS temp_status,
       CASE WHEN humidity_pct IS NULL THEN 'unavailable' ELSE 'inherited block forecast' END AS humidity_status
FROM ({I.BLOCK_FORECAST})""")
def map1(spark, sf):
    rows = block_forecast(spark, sf).withColumns({"f": F.lit(1.0), "dt": F.lit(0.0)})
    rows = A.localise(rows, "f", "dt", inherited=("humidity_pct",))
    status = F.col("variable_status")
    return rows.select("block_id", "valid_date", status["rainfall_mm"].alias("rain_status"),
                       status["temp_max_c"].alias("temp_status"), status["humidity_pct"].alias("humidity_status"))
