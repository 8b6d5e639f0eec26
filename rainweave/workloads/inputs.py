"""Role mapping of the given tables, as SQL both engines run unchanged.

Customers are villages, nations blocks, regions districts. Order totals give dated parent
values, events a daily series, keys give coordinates.
"""

VILLAGES = """
SELECT c_custkey AS village_id, c_nationkey AS block_id, n_regionkey AS district_id,
       c_acctbal + 1000e0 AS area_m2,
       15.6e0 + (c_custkey * 7919 % 6400) / 1000e0 AS lat,
       72.6e0 + (c_custkey * 104729 % 8200) / 1000e0 AS lon,
       100e0 + (c_custkey * 31 % 1200) AS elevation_m,
       (c_custkey * 17 % 97) / 10e0 AS climatology
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

BLOCK_FORECAST = """
SELECT c_nationkey AS block_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS valid_date,
       avg(o_totalprice) / 9973e0 AS rainfall_mm,
       20e0 + max(o_totalprice) / 49999e0 AS temp_max_c,
       10e0 + min(o_totalprice) / 49999e0 AS temp_min_c,
       CASE WHEN count(*) % 3 = 0 THEN NULL ELSE 40e0 + count(*) % 50 END AS humidity_pct
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
GROUP BY c_nationkey, date_trunc('month', o_orderdate)
"""

DISTRICT_FORECAST = """
SELECT n_regionkey AS district_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS valid_date,
       avg(o_totalprice) / 9973e0 AS rainfall_mm,
       20e0 + max(o_totalprice) / 49999e0 AS temp_max_c,
       10e0 + min(o_totalprice) / 49999e0 AS temp_min_c,
       CASE WHEN count(*) % 7 = 0 THEN NULL ELSE 40e0 + count(*) % 50 END AS humidity_pct
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY n_regionkey, date_trunc('month', o_orderdate)
"""

ADJUSTED = f"""
WITH v AS ({VILLAGES}),
b AS (SELECT block_id, sum(climatology * area_m2) / sum(area_m2) AS ref_v,
             sum(elevation_m * area_m2) / sum(area_m2) AS ref_e FROM v GROUP BY block_id),
d AS (SELECT district_id, sum(climatology * area_m2) / sum(area_m2) AS ref_v,
             sum(elevation_m * area_m2) / sum(area_m2) AS ref_e FROM v GROUP BY district_id)
SELECT v.*, b.ref_e AS reference_elevation_m,
       CASE WHEN b.ref_v > 0 THEN climatology / b.ref_v ELSE 1e0 END AS rainfall_factor,
       -0.0065e0 * (elevation_m - b.ref_e) AS temperature_adjustment_c,
       d.ref_e AS district_reference_elevation_m,
       CASE WHEN d.ref_v > 0 THEN climatology / d.ref_v ELSE 1e0 END AS district_rainfall_factor,
       -0.0065e0 * (elevation_m - d.ref_e) AS district_temperature_adjustment_c
FROM v JOIN b USING (block_id) JOIN d USING (district_id)
"""

# Village values of both routes, one row per village and month.
ROUTE_BLOCK = f"""
SELECT a.village_id, a.block_id, f.valid_date, a.area_m2, a.elevation_m, f.rainfall_mm, a.rainfall_factor,
       round_even(f.rainfall_mm * a.rainfall_factor, 4) AS local_rainfall_mm,
       round_even(f.temp_max_c + a.temperature_adjustment_c, 2) AS local_temp_max_c,
       round_even(f.temp_min_c + a.temperature_adjustment_c, 2) AS local_temp_min_c,
       f.humidity_pct AS local_humidity_pct
FROM ({ADJUSTED}) a JOIN ({BLOCK_FORECAST}) f ON a.block_id = f.block_id
"""

ROUTE_DISTRICT = f"""
SELECT a.village_id, a.block_id, f.valid_date, a.area_m2, a.elevation_m, f.rainfall_mm,
       a.district_rainfall_factor AS rainfall_factor,
       round_even(f.rainfall_mm * a.district_rainfall_factor, 4) AS local_rainfall_mm,
       round_even(f.temp_max_c + a.district_temperature_adjustment_c, 2) AS local_temp_max_c,
       round_even(f.temp_min_c + a.district_temperature_adjustment_c, 2) AS local_temp_min_c,
       f.humidity_pct AS local_humidity_pct
FROM ({ADJUSTED}) a JOIN ({DISTRICT_FORECAST}) f ON a.district_id = f.district_id
"""

PAIRS = f"""
SELECT village_id, valid_date, l.block_id, l.area_m2, l.local_rainfall_mm AS lv, r.local_rainfall_mm AS rv,
       l.local_rainfall_mm - r.local_rainfall_mm AS difference_mm,
       (l.rainfall_mm - r.rainfall_mm) * (l.rainfall_factor + r.rainfall_factor) / 2 AS source_component_mm,
       (l.rainfall_mm + r.rainfall_mm) * (l.rainfall_factor - r.rainfall_factor) / 2 AS reference_component_mm
FROM ({ROUTE_BLOCK}) l JOIN ({ROUTE_DISTRICT}) r USING (village_id, valid_date)
"""
