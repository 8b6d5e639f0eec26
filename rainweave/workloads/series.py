"""Causal features on a daily grid: suppliers are cells, shipped quantity is rain."""

from pyspark.sql import functions as F

from rainweave.operators import series as W, spatial as X
from rainweave.operators.models import LAG_FEATURES
from rainweave.workloads.registry import query, table

LEAD, LAG = 3, 2
MONTHS = [6, 7, 8, 9, 10]

GRID_SQL = """
ends AS (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM {lineitem}),
spine AS (SELECT s_suppkey AS grid_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
          FROM {supplier} CROSS JOIN ends),
day AS (SELECT l_suppkey AS grid_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q FROM {lineitem} GROUP BY 1, 2),
rain AS (SELECT grid_id, date, CASE WHEN (grid_id * 7 + datediff('day', DATE '1970-01-01', date)) % 211 = 0 THEN NULL
          ELSE coalesce(q, 0) / 1.7e0 END AS rain_mm FROM spine LEFT JOIN day USING (grid_id, date))"""

FEATURES_SQL = GRID_SQL + f""",
f AS (SELECT grid_id, date, rain_mm, datediff('day', (SELECT a FROM ends), date) AS age,
 lag(rain_mm, {LEAD + LAG}) OVER w AS rain_last, lag(rain_mm, {LEAD + LAG + 1}) OVER w AS rain_previous,
 lag(rain_mm, {LEAD + LAG + 2}) OVER w AS rain_two_before, lag(rain_mm, {LEAD + LAG + 6}) OVER w AS rain_six_before,
 lag(rain_mm, {LEAD + LAG + 13}) OVER w AS rain_thirteen_before,
 CASE WHEN count(rain_mm) OVER w3 = 3 THEN avg(rain_mm) OVER w3 END AS mean3,
 CASE WHEN count(rain_mm) OVER w7 = 7 THEN avg(rain_mm) OVER w7 END AS mean7,
 CASE WHEN count(rain_mm) OVER w14 = 14 THEN avg(rain_mm) OVER w14 END AS mean14,
 CASE WHEN count(rain_mm) OVER w3 = 3 THEN max(rain_mm) OVER w3 END AS max3
 FROM rain WINDOW w AS (PARTITION BY grid_id ORDER BY date),
 w3 AS (PARTITION BY grid_id ORDER BY date ROWS BETWEEN {LEAD + LAG + 2} PRECEDING AND {LEAD + LAG} PRECEDING),
 w7 AS (PARTITION BY grid_id ORDER BY date ROWS BETWEEN {LEAD + LAG + 6} PRECEDING AND {LEAD + LAG} PRECEDING),
 w14 AS (PARTITION BY grid_id ORDER BY date ROWS BETWEEN {LEAD + LAG + 13} PRECEDING AND {LEAD + LAG} PRECEDING)),
usable AS (SELECT * FROM f WHERE age >= {LEAD + LAG + 14} AND month(date) IN (6, 7, 8, 9, 10))"""

CELLS_SQL = """cells AS (SELECT s_suppkey AS grid_id, 15.6e0 + (s_suppkey * 7919 % 6400) / 1000e0 AS lat,
 72.6e0 + (s_suppkey * 104729 % 8200) / 1000e0 AS lon, s_suppkey % 9 = 0 AS excluded FROM {supplier})"""


def cells(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("grid_id"), (15.6 + (k * 7919 % 6400) / 1000).alias("lat"),
        (72.6 + (k * 104729 % 8200) / 1000).alias("lon"), (k % 9 == 0).alias("excluded"))


CELLS_A_TASK = 1000


def grid_rain(spark, sf):
    """Dense daily series per supplier with a few missing days.

    Suppliers are dealt first and their quantities travel to them packed, by blocks of days, so that the dense rows are made
    where they are used and are never shuffled.
    """
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grid_id"),
                                                F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    ends = items.agg(F.struct(F.min("date").alias("a"), F.max("date").alias("b")).alias("e")).scalar()
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grid_id"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suppliers.count() // CELLS_A_TASK))

    def block(date):
        return F.floor(W.day_number(date) / W.NEIGHBOUR_DAYS).cast("int")

    day = items.where("grid_id is not null and date is not null").groupBy("grid_id", "date").agg(F.sum("l_quantity").alias("q"))
    packed = day.repartition(parts, "grid_id").groupBy("grid_id", block("date").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct("date", "q"))).alias("days"))
    packed = packed.groupBy("grid_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "days"))).alias("blocks"))
    spine = suppliers.repartition(parts, "grid_id").join(packed, "grid_id", "left").withColumn("e", ends)
    spine = spine.select("grid_id", "blocks", "e", F.explode(F.sequence(block("e.a"), block("e.b"))).alias("block"))
    start = F.date_add(F.lit("1970-01-01").cast("date"), F.col("block") * W.NEIGHBOUR_DAYS)
    dates = F.sequence(F.greatest("e.a", start), F.least("e.b", F.date_add(start, W.NEIGHBOUR_DAYS - 1)))
    spine = spine.select("grid_id", F.element_at("blocks", F.col("block")).alias("days"), dates.alias("dates"))
    gap = (F.col("grid_id") * 7 + W.day_number("date")) % 211 == 0
    return spine.select("grid_id", "days", F.explode("dates").alias("date")).select(
        "grid_id", "date", F.when(~gap, F.coalesce(F.element_at("days", F.col("date")), F.lit(0.0)) / 1.7).alias("rain_mm"))


def features(spark, sf):
    return W.lag_features(grid_rain(spark, sf), ["grid_id"], "date", "rain_mm", LEAD, LAG, MONTHS)


def shown(df, *names, digits=6):
    return df.select("grid_id", "date", *[F.round(n, digits).alias(n) for n in names])


def shown_sql(*names, digits=6):
    return "grid_id, date, " + ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


LAG_NAMES = tuple(W.LAGS)


@query("win1_causal_lags", f"WITH {FEATURES_SQL} SELECT {shown_sql(*LAG_NAMES)} FROM usable")
def win1(spark, sf):
    return shown(features(spark, sf), *LAG_NAMES)


@query("win2_trailing_means", f"WITH {FEATURES_SQL} SELECT {shown_sql('mean3', 'mean7', 'mean14')} FROM usable")
def win2(spark, sf):
    return shown(features(spark, sf), "mean3", "mean7", "mean14")


@query("win3_trends", f"""WITH {FEATURES_SQL} SELECT grid_id, date, round(max3, 6) AS max3,
 round(rain_last - rain_previous, 6) AS trend1, round(mean3 - mean7, 6) AS trend3_7 FROM usable""")
def win3(spark, sf):
    return shown(features(spark, sf), "max3", "trend1", "trend3_7")


ADJ_SQL = CELLS_SQL + """,
adj AS (SELECT c.grid_id, n.grid_id AS neighbour FROM cells c JOIN cells n ON c.grid_id <> n.grid_id AND NOT n.excluded
 QUALIFY row_number() OVER (PARTITION BY c.grid_id ORDER BY power(c.lat - n.lat, 2)
   + power((c.lon - n.lon) * cos(radians(c.lat)), 2), n.grid_id) <= 8)"""


@query("win4_neighbour_features", f"""WITH {FEATURES_SQL}, {ADJ_SQL},
j AS (SELECT a.grid_id, u.date, CASE WHEN count(rain_last) = count(*) THEN avg(rain_last) END AS neighbor_last,
 CASE WHEN count(mean3) = count(*) THEN avg(mean3) END AS neighbor_mean3,
 CASE WHEN count(mean7) = count(*) THEN avg(mean7) END AS neighbor_mean7,
 avg(CASE WHEN rain_last >= 20 THEN 1e0 ELSE 0e0 END) AS neighbor_event_fraction
 FROM adj a JOIN usable u ON u.grid_id = a.neighbour GROUP BY 1, 2)
SELECT {shown_sql('neighbor_last', 'neighbor_mean3', 'neighbor_mean7', 'neighbor_event_fraction')} FROM j""")
def win4(spark, sf):
    near = X.adjacency(cells(spark, sf), "grid_id", "lat", "lon", ~F.col("excluded"))
    out = W.neighbour_features(features(spark, sf), near, "grid_id", "date")
    return shown(out, "neighbor_last", "neighbor_mean3", "neighbor_mean7", "neighbor_event_fraction")


@query("win5_season_encoding", """
SELECT o_orderkey, round(sin(2 * pi() * dayofyear(o_orderdate) / 365.25e0), 9) AS season_sin,
 round(cos(2 * pi() * dayofyear(o_orderdate) / 365.25e0), 9) AS season_cos FROM {orders}""")
def win5(spark, sf):
    enc = W.season("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", *[F.round(c, 9).alias(n) for n, c in enc.items()])


@query("win6_benchmark_lags", f"""WITH {FEATURES_SQL}, {CELLS_SQL}
SELECT {shown_sql(*LAG_NAMES, 'mean3', 'mean7', 'mean14')}, round(lat, 4) AS latitude, round(lon, 4) AS longitude,
 round(sin(2 * pi() * dayofyear(date) / 365.25e0), 6) AS season_sin, round(cos(2 * pi() * dayofyear(date) / 365.25e0), 6) AS season_cos
FROM usable JOIN cells USING (grid_id)""")
def win6(spark, sf):
    """All twelve features of a feature vector."""
    rows = features(spark, sf).join(cells(spark, sf), "grid_id").withColumns({"latitude": F.col("lat"), "longitude": F.col("lon")})
    return rows.select("grid_id", "date", *[F.round(c, 4 if c in ("latitude", "longitude") else 6).alias(c) for c in LAG_FEATURES])


@query("win11_persistence_scores", f"""WITH {FEATURES_SQL}
SELECT grid_id, count(*) AS n, round(avg(abs(rain_last - rain_mm)), 6) AS mae FROM usable
WHERE rain_last IS NOT NULL AND rain_mm IS NOT NULL GROUP BY grid_id""")
def win11(spark, sf):
    rows = features(spark, sf)
    rows = rows.where(W.complete(rows, ["rain_last", "rain_mm"]))
    return rows.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.avg(F.abs(F.col("rain_last") - F.col("rain_mm"))), 6).alias("mae"))


@query("win12_leave_one_group_out_mean", """
WITH g AS (SELECT l_suppkey, sum(l_extendedprice) AS s, count(*) AS n FROM {lineitem} GROUP BY l_suppkey)
SELECT l_suppkey, n, round(((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n), 4) AS prediction FROM g""")
def win12(spark, sf):
    out = W.leave_one_group_out_mean(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")
    return out.withColumn("prediction", F.round("prediction", 4))


@query("win13_ordered_unique_history", "SELECT user_id, min(event_id) AS event_id FROM {events} GROUP BY user_id")
def win13(spark, sf):
    return W.ordered_unique(table(spark, sf, "events"), "user_id", "event_id")


@query("flt6_complete_rows", f"""WITH {FEATURES_SQL}
SELECT grid_id, count(*) FILTER (rain_last IS NOT NULL AND mean14 IS NOT NULL AND rain_mm IS NOT NULL) AS kept FROM usable GROUP BY grid_id""")
def flt6(spark, sf):
    rows = features(spark, sf)
    return rows.groupBy("grid_id").agg(F.count_if(W.complete(rows, ["rain_last", "mean14", "rain_mm"])).alias("kept"))


@query("agg28_dropped_rows", f"""WITH {FEATURES_SQL}
SELECT year(date) AS y, month(date) AS m, count(*) FILTER (rain_last IS NULL OR mean14 IS NULL OR rain_mm IS NULL) AS dropped
FROM usable GROUP BY 1, 2""")
def agg28(spark, sf):
    rows = features(spark, sf).withColumns({"y": F.year("date").cast("long"), "m": F.month("date").cast("long")})
    return W.dropped_rows(rows, ["rain_last", "mean14", "rain_mm"], ["y", "m"])


@query("flt11_season_filter", """
SELECT o_orderkey FROM {orders} WHERE month(o_orderdate) IN (6, 7, 8, 9, 10)""")
def flt11(spark, sf):
    return table(spark, sf, "orders").where(W.in_months("o_orderdate")).select("o_orderkey")


@query("flt15_daily_continuity", """
WITH d AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS d FROM {lineitem})
SELECT l_suppkey, count(*) AS n, count(*) AS days, datediff('day', min(d), max(d)) + 1 = count(*) AS continuous
FROM d GROUP BY l_suppkey""")
def flt15(spark, sf):
    days = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"))
    return W.continuity(W.distinct_days(days, ["l_suppkey"], "d"), ["l_suppkey"], "d")


@query("agg17_period_means", """
SELECT l_suppkey, round(avg(l_extendedprice) FILTER (CAST(l_shipdate AS DATE) BETWEEN '1996-06-01' AND '1997-07-31'), 4) AS train_mean,
 round(avg(l_extendedprice) FILTER (CAST(l_shipdate AS DATE) BETWEEN '1997-08-01' AND '1998-08-31'), 4) AS validation_mean,
 round(avg(l_extendedprice) FILTER (CAST(l_shipdate AS DATE) BETWEEN '1998-09-01' AND '1999-10-31'), 4) AS test_mean
FROM {lineitem} GROUP BY l_suppkey""")
def agg17(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("d", F.col("l_shipdate").cast("date"))
    out = W.period_means(rows, ["l_suppkey"], "d", "l_extendedprice", {
        "train_mean": ("1996-06-01", "1997-07-31"), "validation_mean": ("1997-08-01", "1998-08-31"),
        "test_mean": ("1998-09-01", "1999-10-31")})
    return out.select("l_suppkey", *[F.round(c, 4).alias(c) for c in out.columns[1:]])
