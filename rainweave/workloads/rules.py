"""Advisory rules and covariates: nations become blocks, orders forecasts."""

from pyspark.sql import functions as F

from rainweave.operators import covariates as K, rules as R
from rainweave.operators.advisory_texts import TEXTS
from rainweave.operators.series import dry_spells
from rainweave.workloads import inputs as I
from rainweave.workloads.allocation import villages
from rainweave.workloads.registry import query, spark_view, spread, table
from rainweave.workloads.spatial import distance_sql

BLOCKS = """CASE c_nationkey % 8 WHEN 0 THEN 'Niphad East' WHEN 1 THEN 'MALEGAON' WHEN 2 THEN 'Igatpuri' WHEN 3 THEN 'Bhor'
 WHEN 4 THEN 'Baramati' WHEN 5 THEN 'Pune city' WHEN 6 THEN 'Trimbak' ELSE 'Central' END"""
CROP = """CASE block WHEN 'Niphad East' THEN 'Grape' WHEN 'MALEGAON' THEN 'Onion' WHEN 'Igatpuri' THEN 'Bajra' WHEN 'Bhor' THEN 'Sugarcane'
 WHEN 'Baramati' THEN 'Onion' WHEN 'Pune city' THEN 'Grape' WHEN 'Trimbak' THEN 'Bajra' ELSE 'Grape' END"""
WEATHER = f"""
SELECT o_orderkey, {BLOCKS} AS block, CAST(o_orderdate AS DATE) AS d, o_totalprice / 6007e0 AS rain, 40e0 + o_totalprice / 9001e0 AS rh,
 15e0 + (o_orderkey % 211) / 10e0 AS temp, greatest(0e0, o_totalprice / 6007e0 + (o_orderkey % 23 - 11) / 1.7e0) AS parent
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
"""
CROPPED = f"SELECT *, {CROP} AS crop FROM ({WEATHER}) w"
STAGE_SQL = "CASE crop " + " ".join(
    f"WHEN '{c}' THEN CASE " + " ".join(f"WHEN month(d) IN ({', '.join(map(str, m))}) THEN '{s}'" for s, m in stages)
    + f" ELSE '{stages[-1][0]}' END" for c, stages in R.STAGES.items()) + " END"
ALERT_SQL = "CASE WHEN rain >= 64.5 THEN 'WARNING' WHEN rain >= 20 OR (crop = 'Grape' AND rh >= 85) THEN 'ADVISORY' ELSE 'NORMAL' END"
WET_SQL = """CASE WHEN (crop = 'Grape' AND (rain >= 20 OR rh >= 80)) OR (crop = 'Onion' AND rain >= 15) OR (crop = 'Sugarcane' AND rain >= 20)
 OR (crop = 'Bajra' AND rain >= 10) THEN 'wet' ELSE 'dry' END"""


def weather(spark, sf):
    return spark_view(spark, sf, WEATHER)


def cropped(spark, sf):
    return weather(spark, sf).withColumn("crop", R.dominant_crop("block"))


@query("rul1_dominant_crop", f"SELECT o_orderkey, crop FROM ({CROPPED})")
def rul1(spark, sf):
    return cropped(spark, sf).select("o_orderkey", "crop")


@query("rul2_growth_stage", f"SELECT o_orderkey, {STAGE_SQL} AS stage FROM ({CROPPED})")
def rul2(spark, sf):
    return cropped(spark, sf).select("o_orderkey", R.growth_stage("crop", F.month("d")).alias("stage"))


@query("rul3_alert_level", f"SELECT o_orderkey, {ALERT_SQL} AS alert FROM ({CROPPED})")
def rul3(spark, sf):
    return cropped(spark, sf).select("o_orderkey", R.alert_level("rain", "crop", "rh").alias("alert"))


def _texts_sql():
    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (c, b, t["pest_en"], t["spray_mr"], t["irrigation_en"])) + ")"
                     for (c, b), t in TEXTS.items())
    return f"t AS (SELECT * FROM (VALUES {rows}) v(crop, branch, pest_en, spray_mr, irrigation_en))"


@query("rul4_crop_branch_texts", f"""WITH {_texts_sql()}, w AS (SELECT *, {WET_SQL} AS branch FROM ({CROPPED}))
SELECT o_orderkey, branch, pest_en, spray_mr, irrigation_en FROM w JOIN t USING (crop, branch)""")
def rul4(spark, sf):
    rows = cropped(spark, sf).withColumn("branch", R.branch("crop", "rain", "rh"))
    rows = rows.withColumn("a", R.advice("crop", "branch"))
    return rows.select("o_orderkey", "branch", "a.pest_en", "a.spray_mr", "a.irrigation_en")


PHRASE_SQL = """CASE WHEN diff > 3 THEN printf('%.1f mm HIGHER than the block-level average (%.1f mm)', abs(diff), round_even(parent, 1))
 WHEN diff < -3 THEN printf('%.1f mm LOWER than the block-level average (%.1f mm)', abs(diff), round_even(parent, 1))
 ELSE printf('consistent with the block-level average (%.1f mm)', round_even(parent, 1)) END"""


@query("rul5_anomaly_phrase", f"SELECT o_orderkey, {PHRASE_SQL} AS phrase FROM (SELECT *, round_even(rain - parent, 1) AS diff FROM ({WEATHER}))")
def rul5(spark, sf):
    return weather(spark, sf).select("o_orderkey", R.anomaly_phrase("rain", "parent").alias("phrase"))


@query("rul6_structured_bulletin", f"""
SELECT o_orderkey, block AS block_name, CAST(d + 5 AS DATE) AS valid_until, crop AS dominant_crop, {STAGE_SQL} AS crop_stage,
 {ALERT_SQL} AS alert_level, 'DRAFT' AS status, printf('Expected 24-hr Rainfall: %.1f mm (Confidence Band 80%%: %.1f - %.1f mm). This estimate is ',
  round_even(rain, 1), round_even(greatest(0, rain - 4), 1), round_even(rain + 5, 1)) || {PHRASE_SQL} || ', driven primarily by Topographic relief. Max Temp: '
  || printf('%.1f°C, Min Temp: 21.0°C, Relative Humidity: %.0f%%.', round_even(temp, 1), round_even(rh, 0)) AS weather_summary_en
FROM (SELECT *, round_even(rain - parent, 1) AS diff FROM ({CROPPED}))""")
def rul6(spark, sf):
    rows = weather(spark, sf).select(
        F.col("o_orderkey").alias("panchayat_id"), F.col("block").alias("block_name"), "d", F.col("rain").alias("downscaled_rain_pred"),
        F.col("parent").alias("block_rain_mean"), F.col("temp").alias("downscaled_tmax_pred"), F.col("rh").alias("downscaled_rh_pred"))
    out = R.bulletins(rows, "d")
    return out.select(F.col("panchayat_id").alias("o_orderkey"), "block_name", "valid_until", "dominant_crop", "crop_stage",
                      "alert_level", "status", "weather_summary_en")


SERVED_SQL = f"""concat_ws(' ', CASE WHEN rain >= 20 THEN '{R.SERVED['heavy']}' WHEN rain > 0 THEN '{R.SERVED['some']}' ELSE '{R.SERVED['none']}' END,
 CASE WHEN rh >= 90 THEN '{R.SERVED['humid']}' END, CASE WHEN rh IS NULL THEN '{R.SERVED['unknown']}' END)"""


@query("rul7_served_advisory", f"""
WITH x AS (SELECT o_orderkey, rain, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE rh END AS rh, d < DATE '1998-01-01' AS historical FROM ({WEATHER})),
t AS (SELECT *, {SERVED_SQL} AS text FROM x)
SELECT o_orderkey, text, historical, substr(sha256('{{"historical":' || historical || ',"o_orderkey":' || o_orderkey || ',"rule_version":"weather-preview-v1","text":"' || text || '"}}'), 1, 24) AS advisory_id FROM t""")
def rul7(spark, sf):
    rows = weather(spark, sf).withColumns({"rh": F.when(F.col("o_orderkey") % 5 != 0, F.col("rh")),
                                           "fresh": F.when(F.col("d") < "1998-01-01", "archived").otherwise("current")})
    return R.served_advisories(rows, "rain", "rh", "fresh", ["o_orderkey"]).select("o_orderkey", "text", "historical", "advisory_id")


@query("rul10_single_explanation", f"""
SELECT o_orderkey, round(rain, 6) AS rain, {SERVED_SQL} AS text FROM ({WEATHER}) WHERE o_orderkey = (SELECT max(o_orderkey) FROM {{orders}})""")
def rul10(spark, sf):
    last = table(spark, sf, "orders").agg(F.max("o_orderkey").alias("k")).scalar()
    row = R.explanation(weather(spark, sf), "o_orderkey", last, strict=False)
    return row.select("o_orderkey", F.round("rain", 6).alias("rain"), R.served_text("rain", "rh").alias("text"))


@query("rul9_hazard_thresholds", f"""
SELECT o_orderkey, unnest(list_filter([CASE WHEN crop = 'Grape' AND rh >= 80 AND temp BETWEEN 20 AND 30 AND rain >= 5 THEN 'downy_mildew' END,
 CASE WHEN crop = 'Grape' AND rh BETWEEN 40 AND 75 AND temp BETWEEN 22 AND 32 THEN 'powdery_mildew' END,
 CASE WHEN crop = 'Grape' AND rain >= 25 THEN 'berry_cracking' END,
 CASE WHEN crop = 'Onion' AND rh >= 75 AND temp BETWEEN 20 AND 28 AND rain >= 10 THEN 'purple_blotch' END,
 CASE WHEN crop = 'Sugarcane' AND rain >= 15 AND temp BETWEEN 22 AND 32 THEN 'white_grub' END,
 CASE WHEN crop = 'Sugarcane' AND rain >= 35 THEN 'water_logging' END], lambda x: x IS NOT NULL)) AS hazard FROM ({CROPPED})""")
def rul9(spark, sf):
    found = R.hazards("crop", {"rh": "rh", "temp": "temp", "rain": "rain"})
    return cropped(spark, sf).select("o_orderkey", F.explode(found).alias("hazard"))


# A supplier's daily series: the quantity shipped is its rain, days without shipments are dry, days with an untaxed item not measured.
DAILY = """
d AS (SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q, min(l_tax) AS tax FROM {lineitem} GROUP BY 1, 2),
e AS (SELECT cell, min(day) AS a, max(day) AS b FROM d GROUP BY cell)"""


@query("rul9_dry_spell_hazards", f"""WITH {DAILY},
s AS (SELECT cell, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
w AS (SELECT s.cell, s.day, CASE WHEN d.cell IS NULL THEN 0e0 WHEN tax > 0 THEN q END AS rain FROM s LEFT JOIN d ON d.cell = s.cell AND d.day = s.day),
r AS (SELECT *, max(CASE WHEN coalesce(rain, 9) >= 1 THEN day END) OVER (PARTITION BY cell ORDER BY day) AS wet, min(day) OVER (PARTITION BY cell) - 1 AS before FROM w)
SELECT cell, day, CAST(datediff('day', coalesce(wet, before), day) AS BIGINT) AS dry_days FROM r
WHERE datediff('day', coalesce(wet, before), day) >= 5 AND 26 + month(day) % 7 >= 30""")
def rul9_dry_spells(spark, sf):
    """Onion thrips: dry for five days or more, and hot."""
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum("l_quantity").alias("q"), F.min("l_tax").alias("tax"), F.lit(True).alias("there"))
    ends = d.groupBy("cell").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select("cell", F.explode(F.sequence("a", "b")).alias("day")).join(d, ["cell", "day"], "left")
    days = days.withColumn("rain", F.when(F.col("there").isNull(), 0.0).when(F.col("tax") > 0, F.col("q")))
    days = dry_spells(days, ["cell"], "day", "rain").withColumns({"temp": 26 + F.month("day") % 7, "crop": F.lit("Onion")})
    found = R.hazards("crop", {"dry_days": "dry_days", "temp": "temp"})
    return days.where(F.array_contains(found, "thrips_infestation")).select("cell", "day", "dry_days")


@query("dt3_valid_until", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 5 AS DATE) AS valid_until, CAST(month(o_orderdate) AS INTEGER) AS "month" FROM {orders}""")
def dt3(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", R.valid_until(day).alias("valid_until"), F.month(day).alias("month"))


def _cover(region, name):
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower(block), '{k}')" for k in keys) + f" THEN {shares[name]}e0" for shares, keys in region.land_cover)
    return f"CASE {arms} ELSE {region.other_cover[name]}e0 END"


@query("str3_first_matching_group", f"""
SELECT c_custkey, {_cover(K.STATE, "crop")} AS crop_pct, {_cover(K.STATE, "tree")} AS tree_pct FROM (SELECT c_custkey, {BLOCKS} AS block FROM {{customer}})""")
def str3(spark, sf):
    rows = spark_view(spark, sf, f"SELECT c_custkey, {BLOCKS} AS block FROM {{customer}}")
    cover = K.land_cover("block")
    return rows.select("c_custkey", cover["lulc_crop_pct"].alias("crop_pct"), cover["lulc_tree_pct"].alias("tree_pct"))


TOPO_SQL = """CASE WHEN lon < 73.1 THEN 15e0 + greatest(0e0, (lon - 72.6e0) * 80) WHEN lon < 73.8 THEN 580e0 + greatest(0e0, (lat - 18) * 45) + (73.8e0 - lon) * 600
 WHEN lon < 75 THEN 560e0 - (lon - 73.8e0) * 120 ELSE 320e0 - (lon - 75) * 20 END"""
SLOPE_SQL = "CASE WHEN lon < 73.1 THEN 1.8e0 WHEN lon < 73.8 THEN 14.5e0 WHEN lon < 75 THEN 3.2e0 ELSE 1.5e0 END"
ANOMALY_SQL = """CASE WHEN lon < 73.65 THEN round_even(45 * exp(-power(lon - 73.5e0, 2) / 0.05e0), 1)
 ELSE round_even(-15 * least(1e0, (lon - 73.8e0) * 1.5e0), 1) END"""
# Coordinates off the rounding ties.
SITES = f"""SELECT village_id, block_id, lat + 0.000137e0 AS lat, lon + 0.000219e0 AS lon, {BLOCKS.replace('c_nationkey', 'block_id')} AS block FROM ({I.VILLAGES}) v"""


@query("mth4_terrain_proxies", f"""
SELECT village_id, round_even(h, 1) AS elevation_mean, std AS elevation_std, round_even(greatest(0, h - std * 1.2e0), 1) AS elevation_min,
 round_even(h + std * 1.2e0, 1) AS elevation_max, {SLOPE_SQL} AS slope_mean, round_even((lon * 42) % 360, 1) AS aspect_mean
FROM (SELECT *, {TOPO_SQL} AS h, round_even(({TOPO_SQL}) * 0.07e0, 1) AS std FROM ({SITES}))""")
def mth4(spark, sf):
    return spark_view(spark, sf, SITES).select("village_id", *[c.alias(n) for n, c in K.topography().items()])


@query("mth5_rain_anomaly_proxy", f"SELECT village_id, {ANOMALY_SQL} AS bias FROM ({SITES})")
def mth5(spark, sf):
    return spark_view(spark, sf, SITES).select("village_id", K.rain_anomaly().alias("bias"))


@query("mth6_topographic_variability", f"""
SELECT village_id, round(round_even(({TOPO_SQL}) * 0.07e0, 1) / 10 + {SLOPE_SQL} / 5, 6) AS v FROM ({SITES})""")
def mth6(spark, sf):
    t = K.topography()
    rows = spark_view(spark, sf, SITES).select("village_id", t["elevation_std"].alias("elevation_std"), t["slope_mean"].alias("slope_mean"))
    return rows.select("village_id", F.round(K.topographic_variability(), 6).alias("v"))


COV_SQL = f"""
c AS (SELECT village_id, block, 'MH_' || block_id || '_' || village_id AS panchayat_id, {distance_sql(K.COAST)} AS dist_to_coast_km, {distance_sql(K.RIVERS)} AS dist_to_water_km,
 {ANOMALY_SQL} AS historical_rain_bias, round_even({TOPO_SQL}, 1) AS elevation_mean, round_even(({TOPO_SQL}) * 0.07e0, 1) AS elevation_std, {SLOPE_SQL} AS slope_mean,
 {_cover(K.STATE, "crop")} AS lulc_crop_pct FROM ({SITES}))"""
COV_COLUMNS = ["village_id", "panchayat_id", "dist_to_coast_km", "dist_to_water_km", "historical_rain_bias", "elevation_mean",
               "elevation_std", "slope_mean", "lulc_crop_pct"]


def village_covariates(spark, sf):
    return K.covariates(spread(spark_view(spark, sf, SITES)), "block_id", "village_id", "block", keep=("village_id", "block_id", "lat", "lon"))


@query("cov1_village_covariates", f"WITH {COV_SQL} SELECT {', '.join(COV_COLUMNS)} FROM c")
def cov1(spark, sf):
    return village_covariates(spark, sf).select(*COV_COLUMNS)


@query("cov2_second_region_covariates", f"""
WITH h AS (SELECT *, CASE WHEN lon < 73.65 THEN 650e0 + (73.65e0 - lon) * 800 WHEN lon < 74 THEN 560e0 - (lon - 73.65e0) * 80 ELSE 530e0 - (lon - 74) * 60 END AS h FROM ({SITES}))
SELECT village_id, round_even(h, 1) AS elevation_mean, greatest(5e0, round_even(h * 0.07e0, 1)) AS elevation_std,
 CASE WHEN lon < 73.65 THEN 15e0 WHEN lon < 74 THEN 4e0 ELSE 2e0 END AS slope_mean, CASE WHEN lon < 73.7 THEN round_even(38 * (73.7e0 - lon) * 2.5e0, 1)
 ELSE round_even(-12 * least(1e0, (lon - 73.7e0) * 1.5e0), 1) END AS historical_rain_bias, {_cover(K.SECOND, "crop")} AS lulc_crop_pct FROM h""")
def cov2(spark, sf):
    out = K.covariates(spark_view(spark, sf, SITES), "block_id", "village_id", "block", K.SECOND, "MH_PUNE", keep=("village_id",))
    return out.select("village_id", "elevation_mean", "elevation_std", "slope_mean", "historical_rain_bias", "lulc_crop_pct")


@query("rul8_dominant_factor", f"""WITH {COV_SQL}
SELECT village_id, CASE WHEN elevation_mean > 600 OR slope_mean > 8 THEN 'Orographic Sahyadri Elevation Gradient' WHEN dist_to_coast_km < 60 THEN 'Coastal Maritime Proximity'
 WHEN lulc_crop_pct > 65 THEN 'Horticultural Orchard Microclimate' WHEN dist_to_water_km < 10 THEN 'Riparian Godavari River Valley'
 ELSE 'Rain-Shadow Plateau Topography' END AS factor FROM c""")
def rul8(spark, sf):
    return village_covariates(spark, sf).select("village_id", R.dominant_factor().alias("factor"))


@query("prj4_local_weather", f"""WITH {COV_SQL}
SELECT village_id, round_even(29.5e0 - (elevation_mean - 550) * 0.0065e0 + historical_rain_bias / 17e0 * 0.5e0, 1) AS tmax,
 round_even(21e0 - (elevation_mean - 550) * 0.0065e0 + historical_rain_bias / 17e0 * 0.5e0, 1) AS tmin,
 round_even(greatest(30e0, least(98e0, 60 + elevation_mean / 7.3e0 * 0.4e0)), 1) AS rh FROM c""")
def prj4(spark, sf):
    rows = village_covariates(spark, sf).withColumns({
        "r": F.col("elevation_mean") / 7.3, "hi": F.lit(29.5), "lo": F.lit(21.0), "dev": F.col("historical_rain_bias") / 17})
    out = K.local_weather(rows, "r", "hi", "lo", "dev")
    return out.select("village_id", F.col("downscaled_tmax_pred").alias("tmax"), F.col("downscaled_tmin_pred").alias("tmin"),
                      F.col("downscaled_rh_pred").alias("rh"))
