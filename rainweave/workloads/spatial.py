"""Spatial joins: customers are villages, suppliers stations, nations polygons."""

from pyspark.sql import functions as F

from rainweave.operators import spatial as X
from rainweave.operators.covariates import COAST, RIVERS
from rainweave.workloads import inputs as I
from rainweave.workloads.allocation import villages
from rainweave.workloads.registry import query, spark_view, table
from rainweave.workloads.series import CELLS_SQL, cells

STATIONS = """SELECT s_suppkey AS station_id, s_nationkey AS block_id, s_acctbal / 1009e0 AS residual,
 15.6e0 + (s_suppkey * 6007 % 6400) / 1000e0 AS slat, 72.6e0 + (s_suppkey * 50021 % 8200) / 1000e0 AS slon,
 100e0 + (s_suppkey * 37 % 1200) AS selev FROM {supplier}"""

# A hexagon-like ring per nation; the last corner repeats the first.
_CORNERS = ((0.0, 1.1), (0.9, 0.5), (0.9, -0.6), (0.1, -1.0), (-0.7, -0.4), (-0.8, 0.6))
_X = "(73.4e0 + (n_nationkey // 5) * 1.7e0)"
_Y = "(16.4e0 + (n_nationkey % 5) * 1.3e0)"


def _edges_sql():
    parts = []
    for (a, b), (c, d) in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]):
        parts.append(f"SELECT n_nationkey AS poly, {_X} + {a} AS x1, {_Y} + {b} AS y1, {_X} + {c} AS x2, {_Y} + {d} AS y2 FROM {{nation}}")
    return "edges AS (" + " UNION ALL ".join(parts).replace(" + -", " - ") + ")"


EDGES_SQL = _edges_sql()
INSIDE_SQL = f"""{EDGES_SQL}, v AS ({I.VILLAGES}),
hit AS (SELECT village_id, poly, max(elevation_m) AS elevation_m,
 count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1
 OR bool_or(abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) <= 1e-12 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
   AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS inside,
 min(power(lon - x1 - t * (x2 - x1), 2) + power(lat - y1 - t * (y2 - y1), 2)) AS d2
 FROM (SELECT *, greatest(0e0, least(1e0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1))
   / (power(x2 - x1, 2) + power(y2 - y1, 2)))) AS t FROM v CROSS JOIN edges) GROUP BY village_id, poly)"""


def stations(spark, sf):
    return spark_view(spark, sf, STATIONS)


def polygons(spark, sf):
    """Edge table built from one closed ring per nation."""
    cx = 73.4 + F.floor(F.col("n_nationkey") / 5) * 1.7
    cy = 16.4 + (F.col("n_nationkey") % 5) * 1.3
    ring = F.array(*[F.struct((cx + a).alias("lon"), (cy + b).alias("lat")) for a, b in _CORNERS + _CORNERS[:1]])
    return X.ring_edges(table(spark, sf, "nation").select(F.col("n_nationkey").alias("poly"), ring.alias("ring")),
                        "poly", "ring")


@query("jn10_nearest_station", f"""
SELECT village_id, station_id, round(power(lat - slat, 2) + power(lon - slon, 2), 9) AS d2
FROM ({I.VILLAGES}) CROSS JOIN ({STATIONS})
QUALIFY row_number() OVER (PARTITION BY village_id ORDER BY power(lat - slat, 2) + power(lon - slon, 2), station_id) = 1""")
def jn10(spark, sf):
    out = X.nearest(villages(spark, sf), stations(spark, sf), "village_id", "station_id", ["lat", "lon"], ["slat", "slon"])
    return out.withColumn("d2", F.round("d2", 9))


def _adjacency_sql(where):
    return f"""WITH {CELLS_SQL}
SELECT c.grid_id, n.grid_id AS neighbour, CAST(row_number() OVER w AS INTEGER) AS "rank" FROM cells c JOIN cells n ON c.grid_id <> n.grid_id {where}
WINDOW w AS (PARTITION BY c.grid_id ORDER BY power(c.lat - n.lat, 2) + power((c.lon - n.lon) * cos(radians(c.lat)), 2), n.grid_id)
QUALIFY row_number() OVER w <= 8"""


@query("jn11_neighbours_outside_holdout", _adjacency_sql("AND NOT n.excluded"))
def jn11(spark, sf):
    return X.adjacency(cells(spark, sf), "grid_id", "lat", "lon", ~F.col("excluded")).drop("d2")


@query("jn12_neighbours_same_run", _adjacency_sql(""))
def jn12(spark, sf):
    return X.adjacency(cells(spark, sf), "grid_id", "lat", "lon").drop("d2")


def distance_sql(points, lat="lat", lon="lon"):
    def one(p):
        a = (f"(power(sin(radians({p[1]}e0 - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({p[1]}e0))"
             f" * power(sin(radians({p[0]}e0 - {lon}) / 2), 2))")
        return f"6371e0 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))"
    return f"round_even(least({', '.join(one(p) for p in points)}), 2)"


@query("jn13_distance_to_points", f"""
SELECT village_id, {distance_sql(COAST)} AS coast_km, {distance_sql(RIVERS)} AS river_km FROM ({I.VILLAGES})""")
def jn13(spark, sf):
    return villages(spark, sf).select("village_id", X.min_distance_km("lat", "lon", COAST).alias("coast_km"),
                                      X.min_distance_km("lat", "lon", RIVERS).alias("river_km"))


@query("jn8_points_in_polygons", f"WITH {INSIDE_SQL} SELECT village_id, poly FROM hit WHERE inside")
def jn8(spark, sf):
    return X.points_in_polygons(villages(spark, sf), polygons(spark, sf), "village_id", "poly", "lon", "lat")


@query("jn9_halo_membership", f"WITH {INSIDE_SQL} SELECT village_id, poly FROM hit WHERE inside OR d2 <= 0.0625e0")
def jn9(spark, sf):
    return X.within_halo(villages(spark, sf), polygons(spark, sf), "village_id", "poly", "lon", "lat", 0.25)


@query("jn14_zonal_statistics", f"""WITH {INSIDE_SQL}
SELECT poly, round(avg(elevation_m), 6) AS mean, count(*) AS pixels FROM hit WHERE inside AND elevation_m > 120 AND elevation_m < 1250
GROUP BY poly""")
def jn14(spark, sf):
    out = X.zonal(villages(spark, sf), polygons(spark, sf), "village_id", "poly", "lon", "lat", "elevation_m", (120.0, 1250.0))
    return out.withColumn("mean", F.round("mean", 6))


def _tiles_sql(step):
    lo = lambda c: f"CAST(floor({c} / {step}) * {step} AS INTEGER)"
    hi = lambda c: f"CAST(ceil({c} / {step}) * {step} - {step} AS INTEGER)"
    return f"""WITH b AS (SELECT block_id, min(lon) - 0.15e0 AS x1, min(lat) - 0.15e0 AS y1, max(lon) + 0.15e0 AS x2,
 max(lat) + 0.15e0 AS y2 FROM ({I.VILLAGES}) GROUP BY block_id),
 r AS (SELECT block_id, unnest(generate_series({lo('y1')}, {hi('y2')}, {step})) AS tile_lat, x1, x2 FROM b),
 t AS (SELECT block_id, tile_lat, unnest(generate_series({lo('x1')}, {hi('x2')}, {step})) AS tile_lon FROM r)
 SELECT block_id, printf('N%02dE%03d', tile_lat, tile_lon) AS tile FROM t"""


@query("jn20_tile_cover_one_degree", _tiles_sql(1))
def jn20(spark, sf):
    return X.tiles(X.bounding_box(villages(spark, sf), "lon", "lat", ["block_id"])).select("block_id", "tile")


@query("jn20_tile_cover_three_degrees", _tiles_sql(3))
def jn20_three(spark, sf):
    return X.tiles(X.bounding_box(villages(spark, sf), "lon", "lat", ["block_id"]), 3).select("block_id", "tile")


@query("agg31_bounding_box", f"""
SELECT block_id, round(min(lon) - 0.15e0, 6) AS lon_min, round(min(lat) - 0.15e0, 6) AS lat_min,
 round(max(lon) + 0.15e0, 6) AS lon_max, round(max(lat) + 0.15e0, 6) AS lat_max FROM ({I.VILLAGES}) GROUP BY block_id""")
def agg31(spark, sf):
    out = X.bounding_box(villages(spark, sf), "lon", "lat", ["block_id"])
    return out.select("block_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("ml9_inverse_distance_field", f"""
SELECT village_id, round(greatest(-12e0, least(12e0, sum(residual / (power(lat - slat, 2) + power(lon - slon, 2) + 1e-4))
  / sum(1 / (power(lat - slat, 2) + power(lon - slon, 2) + 1e-4)))), 6) AS residual
FROM ({I.VILLAGES}) v JOIN ({STATIONS}) s USING (block_id) GROUP BY village_id""")
def ml9(spark, sf):
    out = X.idw(villages(spark, sf), stations(spark, sf), ["block_id"], "village_id", ["lat", "lon"], "residual", ["slat", "slon"])
    return out.select("village_id", F.round("residual", 6).alias("residual"))


@query("ml8_distance_weighted_neighbours", f"""
WITH n AS (SELECT village_id, residual, power(lat - slat, 2) + power(lon - slon, 2) + power(elevation_m / 1000e0 - selev / 1000e0, 2) AS d2
 FROM ({I.VILLAGES}) CROSS JOIN ({STATIONS}) QUALIFY row_number() OVER (PARTITION BY village_id ORDER BY
 power(lat - slat, 2) + power(lon - slon, 2) + power(elevation_m / 1000e0 - selev / 1000e0, 2), station_id) <= 5)
SELECT village_id, round(coalesce(avg(residual) FILTER (d2 = 0), sum(residual / sqrt(d2)) FILTER (d2 > 0)
 / sum(1 / sqrt(d2)) FILTER (d2 > 0)), 6) AS prediction FROM n GROUP BY village_id""")
def ml8(spark, sf):
    st = stations(spark, sf).withColumn("selev", F.col("selev") / 1000)
    vs = villages(spark, sf).withColumn("elev", F.col("elevation_m") / 1000)
    near = X.knn(vs, st, 5, "village_id", "station_id", ["lat", "lon", "elev"], ["slat", "slon", "selev"])
    out = X.knn_regression(near.join(st.select("station_id", "residual"), "station_id"), "village_id", "residual")
    return out.withColumn("prediction", F.round("prediction", 6))
