"""Forecast-window operators over hourly event buckets and order dates."""

from pyspark.sql import functions as F

from rainweave.operators import forecast as N, spatial as X
from rainweave.workloads.registry import query, spark_view, table

# Event hours fold into runs of leads 0..150 with three-hour steps after 120.
STEPS = """
SELECT run, lead_hour, cell, avg(value) / 36000e0 AS precip_rate, avg(value) / 9.7e0 AS pwat,
       least(100e0, 20e0 + avg(value) / 7.3e0) AS rh2m
FROM (SELECT CAST(floor(h / 151e0) AS BIGINT) AS run,
             CAST(CASE WHEN h % 151 <= 120 THEN h % 151 ELSE 120 + ceil((h % 151 - 120) / 3e0) * 3 END AS BIGINT) AS lead_hour,
             CAST(length(event_type) AS BIGINT) AS cell, value
      FROM (SELECT (dayofyear(ts) - 1) * 24 + hour(ts) AS h, event_type, value FROM {events}) e) x
GROUP BY run, lead_hour, cell
"""
WIDTH = "CASE WHEN lead_hour <= 120 THEN 1 ELSE 3 END"
FEATURES = f"""
d AS (SELECT *, CAST(ceil((lead_hour - 27) / 24e0) AS INTEGER) AS lead_day, {WIDTH} AS w FROM ({STEPS}) s WHERE lead_hour > 27 AND lead_hour <= 147),
g AS (SELECT run, cell, lead_day, sum(w) = 24 AS complete, sum(precip_rate * w * 3600) AS rain_mm,
 max(precip_rate) * 3600 AS max_step_rate_mmh, coalesce(sum(w) FILTER (precip_rate * 3600 >= 1), 0) / 24e0 AS rain_hours_fraction,
 sum(pwat * w) / sum(w) AS pwat_mean, sum(rh2m * w) / sum(w) AS rh_mean, max(rh2m) AS rh_max FROM d GROUP BY 1, 2, 3)"""


def steps(spark, sf):
    return spark_view(spark, sf, STEPS)


def features(spark, sf):
    return N.window_features(steps(spark, sf), ["run", "cell"], "lead_hour", "precip_rate", "pwat", "rh2m")


@query("flt18_lead_axis", f"""
WITH s AS (SELECT DISTINCT run, cell, lead_hour FROM ({STEPS})),
w AS (SELECT *, lead_hour - lag(lead_hour) OVER (PARTITION BY run, cell ORDER BY lead_hour) AS w FROM s)
SELECT run, cell, count(*) AS steps, count(*) >= 2 AND bool_and(w IS NULL OR w = CASE WHEN lead_hour <= 120 THEN 1 ELSE 3 END) AS native
FROM w GROUP BY run, cell""")
def flt18(spark, sf):
    return N.axis_check(steps(spark, sf), ["run", "cell"], "lead_hour")


@query("win7_rate_to_amount", f"""
SELECT run, cell, round(CASE WHEN sum({WIDTH}) FILTER (lead_hour > 27) = 24 AND bool_or(lead_hour = 27) AND bool_or(lead_hour = 51)
  THEN sum(precip_rate * {WIDTH} * 3600) FILTER (lead_hour > 27) END, 6) AS amount,
  CAST(coalesce(sum({WIDTH}) FILTER (lead_hour > 27), 0) AS BIGINT) AS covered
FROM ({STEPS}) WHERE lead_hour BETWEEN 27 AND 51 GROUP BY run, cell""")
def win7(spark, sf):
    out = N.integrate(steps(spark, sf), ["run", "cell"], "lead_hour", "precip_rate", 27, 51)
    return out.select("run", "cell", F.round("amount", 6).alias("amount"), "covered")


@query("win8_window_features", f"""WITH {FEATURES} SELECT run, cell, lead_day, complete,
 {', '.join(f'round(CASE WHEN complete THEN {n} END, 6) AS {n}' for n in
 ('rain_mm', 'max_step_rate_mmh', 'rain_hours_fraction', 'pwat_mean', 'rh_mean', 'rh_max'))} FROM g""")
def win8(spark, sf):
    out = features(spark, sf)
    return out.select("run", "cell", "lead_day", "complete", *[F.round(c, 6).alias(c) for c in out.columns[5:]])


CELL_XY = "18e0 + cell * 0.25e0 AS lat, 73e0 + cell * cell * 0.1e0 AS lon"


@query("win8_neighbour_rain", f"""WITH {FEATURES},
c AS (SELECT DISTINCT cell, {CELL_XY} FROM d),
adj AS (SELECT c.cell, n.cell AS neighbour FROM c JOIN c n ON c.cell <> n.cell QUALIFY row_number() OVER (PARTITION BY c.cell
  ORDER BY power(c.lat - n.lat, 2) + power((c.lon - n.lon) * cos(radians(c.lat)), 2), n.cell) <= 8),
v AS (SELECT run, cell, lead_day, CASE WHEN complete THEN rain_mm END AS rain_mm FROM g)
SELECT a.cell, run, lead_day, round(CASE WHEN count(rain_mm) = count(*) THEN avg(rain_mm) END, 6) AS neighbor_rain_mean,
 round(CASE WHEN count(rain_mm) = count(*) THEN max(rain_mm) END, 6) AS neighbor_rain_max
FROM adj a JOIN v ON v.cell = a.neighbour SEMI JOIN g ON g.run = v.run AND g.lead_day = v.lead_day AND g.cell = a.cell GROUP BY 1, 2, 3""")
def win8_neighbours(spark, sf):
    rows = features(spark, sf)
    cells = steps(spark, sf).select("cell").distinct().selectExpr("cell", *CELL_XY.split(", "))
    near = X.adjacency(cells, "cell", "lat", "lon")
    out = N.neighbour_rain(rows, near, "cell", ["run", "lead_day"])
    return out.select("cell", "run", "lead_day", F.round("neighbor_rain_mean", 6).alias("neighbor_rain_mean"),
                      F.round("neighbor_rain_max", 6).alias("neighbor_rain_max"))


@query("win9_window_times", """
WITH i AS (SELECT DISTINCT o_orderdate AS init FROM {orders}), l AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS lead)
SELECT init, lead, init + INTERVAL 12 HOUR AS decision, init + to_hours(27 + 24 * (lead - 1)) AS window_start,
 init + to_hours(51 + 24 * (lead - 1)) AS window_end, hour(init) = 0 AND minute(init) = 0 AND second(init) = 0 AS valid
FROM i CROSS JOIN l""")
def win9(spark, sf):
    inits = table(spark, sf, "orders").select(F.col("o_orderdate").alias("init")).distinct()
    return N.window_times(inits, "init")


@query("win10_initialization_dates", """
WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM {orders})
SELECT CAST(y AS INTEGER) AS y, CAST(unnest(generate_series(make_date(y, 5, 31), make_date(y, 10, 25), INTERVAL 5 DAY)) AS DATE) AS init_date FROM y""")
def win10(spark, sf):
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return N.initialization_dates(years, "y")


@query("dt5_observation_dates", """
SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + CAST(unnest(range(2, 7)) AS INTEGER) AS DATE) AS date FROM {orders}""")
def dt5(spark, sf):
    return N.observation_dates(table(spark, sf, "orders"), "o_orderdate")


@query("dt6_days_in_year", """
SELECT o_orderkey, CAST(dayofyear(make_date(year(o_orderdate), 12, 31)) AS INTEGER) AS days FROM {orders}""")
def dt6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.days_in_year(F.year("o_orderdate")).alias("days"))


@query("jn16_collocated_pairs", f"""WITH {FEATURES},
f AS (SELECT run, cell, CAST(run * 6 + lead_day + 1 AS BIGINT) AS day, round(rain_mm, 6) AS rain_mm FROM g WHERE complete),
o AS (SELECT CAST(dayofyear(ts) AS BIGINT) AS day, CAST(length(event_type) AS BIGINT) AS cell, round(avg(value) / 9.7e0, 6) AS observed FROM {{events}} GROUP BY 1, 2)
SELECT run, cell, day, rain_mm, observed FROM f JOIN o USING (day, cell)""")
def jn16(spark, sf):
    f = features(spark, sf).where("complete").select(
        "run", "cell", (F.col("run") * 6 + F.col("lead_day") + 1).alias("day"), F.round("rain_mm", 6).alias("rain_mm"))
    o = table(spark, sf, "events").groupBy(F.dayofyear("ts").cast("long").alias("day"),
                                           F.length("event_type").cast("long").alias("cell")).agg(
        F.round(F.avg("value") / 9.7, 6).alias("observed"))
    return N.collocate(f, o, "day", "cell").pairs.select("run", "cell", "day", "rain_mm", "observed")


@query("src13_forecast_subset", f"""
SELECT run, lead_hour, cell, round(precip_rate, 9) AS precip_rate FROM ({STEPS}) WHERE run = 2 AND lead_hour BETWEEN 0 AND 147 AND cell BETWEEN 5 AND 6""")
def src13(spark, sf):
    from rainweave.sources.archives import forecast_subset
    xy = steps(spark, sf).withColumns({"lat": F.col("cell").cast("double"), "lon": F.col("cell").cast("double")})
    cells = xy.select("cell", "lat", "lon").where("cell BETWEEN 5 AND 6").distinct()
    out = forecast_subset(xy.drop("cell"), cells, F.col("run") == 2, "lead_hour", 147, ["precip_rate"])
    return out.select("run", "lead_hour", "cell", F.round("precip_rate", 9).alias("precip_rate"))


@query("src14_unit_gate", """
SELECT event_type, CAST(CASE event_type WHEN 'view' THEN 'mm' WHEN 'click' THEN 'percent' ELSE 'unknown' END AS VARCHAR) AS found,
 CASE event_type WHEN 'view' THEN 'kg m-2 s-1' ELSE 'percent' END AS expected
FROM {events} WHERE event_type IN ('view', 'signup') GROUP BY 1""")
def src14(spark, sf):
    from rainweave.sources.archives import unit_violations
    kind = F.col("event_type")
    found = table(spark, sf, "events").select(kind.alias("variable"), F.when(kind == "view", "mm").when(
        kind == "click", "percent").otherwise("unknown").alias("units")).distinct()
    out = unit_violations(found, {"view": "kg m-2 s-1", "click": "percent", "signup": "percent"})
    return out.select(F.col("variable").alias("event_type"), F.col("units").alias("found"), "expected")
