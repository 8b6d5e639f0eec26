"""Paired comparison of the block route and the district route."""

from pyspark.sql import functions as F

from rainweave.functions.numeric import isclose, percent_difference
from rainweave.operators import comparison as C
from rainweave.plans import routes
from rainweave.workloads import inputs as I
from rainweave.workloads.allocation import block_forecast, district_forecast, villages
from rainweave.workloads.registry import query, spark_view, table

STATS = """count(*) AS "count",
 round(sum(lv), 6) / count(lv) AS left_mean_mm, round(sum(rv), 6) / count(rv) AS right_mean_mm,
 round(sum(difference_mm), 6) / count(*) AS mean_difference_mm,
 round(sum(abs(difference_mm)), 6) / count(*) AS mean_absolute_difference_mm,
 round(sqrt(avg(difference_mm * difference_mm)), 6) AS root_mean_square_difference_mm,
 round(max(abs(difference_mm)), 6) AS max_absolute_difference_mm,
 round(sum(lv * area_m2) / sum(area_m2), 6) AS area_weighted_left_mm,
 round(sum(rv * area_m2) / sum(area_m2), 6) AS area_weighted_right_mm,
 round(sum(difference_mm * area_m2) / sum(area_m2), 6) AS area_weighted_difference_mm,
 round(sum(abs(difference_mm) * area_m2) / sum(area_m2), 6) AS area_weighted_absolute_difference_mm,
 round(avg(source_component_mm), 6) AS mean_source_component_mm,
 round(avg(reference_component_mm), 6) AS mean_reference_component_mm,
 round(avg(abs(source_component_mm)), 6) AS mean_absolute_source_component_mm,
 round(avg(abs(reference_component_mm)), 6) AS mean_absolute_reference_component_mm,
 count(*) FILTER (difference_mm > 1e-4) AS left_higher,
 count(*) FILTER (difference_mm < -1e-4) AS right_higher,
 count(*) FILTER (abs(difference_mm) <= 1e-4) AS equal_within_rounding,
 count(*) FILTER (abs(difference_mm) > 1) AS above_1mm,
 count(*) FILTER (abs(difference_mm) > 5) AS above_5mm,
 count(*) FILTER (abs(difference_mm) > 10) AS above_10mm,
 count(*) FILTER ((lv >= 20) <> (rv >= 20)) AS different_trigger,
 round(quantile_cont(abs(difference_mm), 0.5), 6) AS median_absolute_difference_mm,
 round(quantile_cont(abs(difference_mm), 0.9), 6) AS p90_absolute_difference_mm"""


def paired(spark, sf):
    return routes.paired_routes(villages(spark, sf), block_forecast(spark, sf), district_forecast(spark, sf))


def compared(spark, sf):
    rows = routes.compared(paired(spark, sf).paired)
    return rows.withColumnRenamed("left_block_id", "block_id").withColumnRenamed("left_area_m2", "area_m2")


@query("agg4_route_statistics", f"""
SELECT CASE WHEN grouping(valid_date) = 1 THEN 0 WHEN grouping(block_id) = 1 THEN 1 ELSE 2 END AS grouping_level,
 valid_date, block_id, {STATS}
FROM ({I.PAIRS}) GROUP BY GROUPING SETS ((), (valid_date), (valid_date, block_id))""")
def agg4(spark, sf):
    return routes.route_report(villages(spark, sf), block_forecast(spark, sf), district_forecast(spark, sf))


@query("agg3_pair_statistics", f"""
WITH p AS (SELECT l_suppkey, l_quantity / 1.0173e0 AS lv, l_extendedprice / 1999e0 AS rv, 1 + l_tax / 3e0 AS area_m2,
   l_quantity / 1.0173e0 - l_extendedprice / 1999e0 AS difference_mm, l_discount / 7e0 AS source_component_mm,
   l_tax / 7e0 - l_discount / 11e0 AS reference_component_mm FROM {{lineitem}})
SELECT 0 AS grouping_level, l_suppkey, {STATS} FROM p GROUP BY l_suppkey""")
def agg3(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_quantity") / 1.0173).alias("lv"), (F.col("l_extendedprice") / 1999).alias("rv"),
        (1 + F.col("l_tax") / 3).alias("area_m2"), (F.col("l_discount") / 7).alias("source_component_mm"),
        (F.col("l_tax") / 7 - F.col("l_discount") / 11).alias("reference_component_mm"))
    df = df.withColumn("difference_mm", F.col("lv") - F.col("rv"))
    return C.pair_stats(df, [["l_suppkey"]], "lv", "rv", "area_m2")


@query("agg5_weather_statistics", f"""
WITH p AS (SELECT l.local_rainfall_mm AS l1, r.local_rainfall_mm AS r1, l.local_temp_max_c AS l2,
  r.local_temp_max_c AS r2, l.local_temp_min_c AS l3, r.local_temp_min_c AS r3,
  l.local_humidity_pct AS l4, r.local_humidity_pct AS r4
  FROM ({I.ROUTE_BLOCK}) l JOIN ({I.ROUTE_DISTRICT}) r USING (village_id, valid_date)),
u AS (SELECT 'local_rainfall_mm' AS variable, l1 AS l, r1 AS r FROM p UNION ALL SELECT 'local_temp_max_c', l2, r2 FROM p
  UNION ALL SELECT 'local_temp_min_c', l3, r3 FROM p UNION ALL SELECT 'local_humidity_pct', l4, r4 FROM p)
SELECT variable, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS "count",
 round(avg(l) FILTER (r IS NOT NULL), 6) AS left_mean, round(avg(r) FILTER (l IS NOT NULL), 6) AS right_mean,
 round(avg(abs(l - r)), 6) AS mean_absolute_difference, round(max(abs(l - r)), 6) AS max_absolute_difference
FROM u GROUP BY variable""")
def agg5(spark, sf):
    return C.weather_stats(paired(spark, sf).paired, [f"local_{v}" for v in routes.VARIABLES])


@query("agg26_components", f"""
SELECT village_id, valid_date, round(difference_mm, 4) AS difference_mm,
 round(source_component_mm, 5) AS source_component_mm, round(reference_component_mm, 5) AS reference_component_mm,
 abs(difference_mm - source_component_mm - reference_component_mm) <= 1.01e-4 AS closes
FROM ({I.PAIRS})""")
def agg26(spark, sf):
    rows = compared(spark, sf)
    return rows.select("village_id", "valid_date", F.round("difference_mm", 4).alias("difference_mm"),
                       F.round("source_component_mm", 5).alias("source_component_mm"),
                       F.round("reference_component_mm", 5).alias("reference_component_mm"),
                       (F.abs("rounding_residual_mm") <= 1.01e-4).alias("closes"))


JN4_SIDES = """
WITH l AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM {orders}
           WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2),
r AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM {orders}
      WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') GROUP BY 1, 2)"""


@query("jn4_paired_rows", JN4_SIDES + """
SELECT k, d, 'paired' AS side, round(l.v - r.v, 2) AS difference FROM l JOIN r USING (k, d)
UNION ALL SELECT k, d, 'left_only', NULL FROM l ANTI JOIN r USING (k, d)
UNION ALL SELECT k, d, 'right_only', NULL FROM r ANTI JOIN l USING (k, d)""")
def jn4(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"),
                                               "o_totalprice", "o_orderpriority")

    def side(*priorities):
        return (orders.where(F.col("o_orderpriority").isin(*priorities)).groupBy("k", "d")
                .agg(F.sum("o_totalprice").alias("v")))

    p = C.pair(side("1-URGENT", "2-HIGH", "3-MEDIUM"), side("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), ["k", "d"])
    none = F.lit(None).cast("double").alias("difference")
    return (p.paired.select("k", "d", F.lit("paired").alias("side"),
                            F.round(F.col("left_v") - F.col("right_v"), 2).alias("difference"))
            .unionByName(p.left_only.select("k", "d", F.lit("left_only").alias("side"), none))
            .unionByName(p.right_only.select("k", "d", F.lit("right_only").alias("side"), none)))


@query("prj3_percent_difference", """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_discount <> 0 THEN 100 * (l_tax - l_discount) / l_discount END, 6) AS percent
FROM {lineitem}""")
def prj3(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(
        percent_difference(F.col("l_tax") - F.col("l_discount"), "l_discount"), 6).alias("percent"))


@query("set1_date_overlap", """
WITH l AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {orders}),
     r AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM {lineitem})
SELECT d, 'both' AS side FROM l SEMI JOIN r USING (d) UNION ALL SELECT d, 'left_only' FROM l ANTI JOIN r USING (d)
UNION ALL SELECT d, 'right_only' FROM r ANTI JOIN l USING (d)""")
def set1(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    right = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return C.date_overlap(left, right, "d")


@query("set3_comparable_variables", f"""
WITH u AS (SELECT rainfall_mm, temp_max_c, temp_min_c, humidity_pct FROM ({I.BLOCK_FORECAST})
 UNION ALL SELECT rainfall_mm, temp_max_c, temp_min_c, humidity_pct FROM ({I.DISTRICT_FORECAST}))
SELECT 'rainfall_mm' AS variable, bool_and(rainfall_mm IS NOT NULL) AS comparable FROM u
UNION ALL SELECT 'temp_max_c', bool_and(temp_max_c IS NOT NULL) FROM u
UNION ALL SELECT 'temp_min_c', bool_and(temp_min_c IS NOT NULL) FROM u
UNION ALL SELECT 'humidity_pct', bool_and(humidity_pct IS NOT NULL) FROM u""")
def set3(spark, sf):
    return C.comparable_variables(block_forecast(spark, sf), district_forecast(spark, sf), routes.VARIABLES)


@query("top1_top_disagreements", """
SELECT l_orderkey, l_linenumber, round(abs(l_quantity - l_extendedprice / 2000), 6) AS gap FROM {lineitem}
ORDER BY abs(l_quantity - l_extendedprice / 2000) DESC, l_orderkey, l_linenumber LIMIT 10""")
def top1(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("difference_mm", F.col("l_quantity") - F.col("l_extendedprice") / 2000)
    return C.top_disagreements(df, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", F.round(F.abs("difference_mm"), 6).alias("gap"))


@query("mth7_relative_closeness", """
SELECT o_orderkey, abs(o_totalprice - o_totalprice * (1 + 1e-11 * (o_orderkey % 20)))
  <= 1e-10 * greatest(abs(o_totalprice), abs(o_totalprice * (1 + 1e-11 * (o_orderkey % 20)))) AS close
FROM {orders}""")
def mth7(spark, sf):
    nudged = F.col("o_totalprice") * (1 + F.lit(1e-11) * (F.col("o_orderkey") % 20))
    return table(spark, sf, "orders").select("o_orderkey", isclose("o_totalprice", nudged).alias("close"))


@query("dt2_issue_gap_days", """
SELECT o_orderkey, l_linenumber, CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""")
def dt2(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "l_linenumber",
                       F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("days"))
