"""Run storage, activation, names, village links and map rows."""

import uuid

from pyspark.sql import functions as F

from rainweave.operators import geography as G, runs as R
from rainweave.plans import routes, served_run as SR
from rainweave.session import checkpoint_dir
from rainweave.sources import files
from rainweave.workloads import inputs as I
from rainweave.workloads.allocation import block_forecast, district_forecast, villages
from rainweave.workloads.registry import query, spark_view, table


@query("snk1_immutable_write", "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders}")
def snk1(spark, sf):
    path = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    R.write_run(rows, path, "r1")
    R.write_run(rows, path, "r1")  # identical content: no-op
    return R.read_run(spark, path, "r1")


ISSUED = f"""SELECT * FROM ({I.ROUTE_BLOCK}) WHERE local_humidity_pct IS NOT NULL AND village_id IN (SELECT o_custkey FROM {{orders}})"""


def _three_runs(spark, sf):
    """Two activated runs, the later issue with double rain and no rows without humidity, and one that nobody activated; villages with orders are linked."""
    path = f"{checkpoint_dir(spark)}/served-{uuid.uuid4().hex}"
    linked = table(spark, sf, "orders").select(F.col("o_custkey").alias("village_id"))
    adjusted = routes.village_adjustments(villages(spark, sf)).join(linked, "village_id", "left_semi")
    forecast = block_forecast(spark, sf)
    doubled = forecast.withColumn("rainfall_mm", F.col("rainfall_mm") * 2).where("humidity_pct is not null")
    for name, rows, issue in (("r2", doubled, "1998-08-02"), ("r1", forecast, "1998-08-01"), ("r3", forecast.where("humidity_pct is null"), None)):
        SR.publish(SR.build(rows, adjusted, name), path, name, issue)
    return path


@query("flt8_served_run", f"""
SELECT village_id, block_id, valid_date, 'r2' AS run, rainfall_mm * 2 AS source_rainfall_mm, round_even(rainfall_mm * 2 * rainfall_factor, 4) AS local_rainfall_mm,
 local_temp_max_c, local_humidity_pct, round_even(round_even(rainfall_mm * 2 * rainfall_factor, 4) - rainfall_mm * 2, 4) AS adjustment_mm
FROM ({ISSUED}) WHERE valid_date = DATE '1997-03-01'""")
def flt8_served(spark, sf):
    rows = SR.request(spark, _three_runs(spark, sf), "1997-03-01")
    return rows.select("village_id", "block_id", "valid_date", "run", "source_rainfall_mm", "local_rainfall_mm", "local_temp_max_c", "local_humidity_pct", "adjustment_mm")


@query("agg13_served_coverage", f"""
WITH f AS (SELECT valid_date, block_id, count(*) AS n FROM ({ISSUED}) GROUP BY 1, 2)
SELECT valid_date, count(*) AS available, (SELECT count(*) FROM {{nation}}) AS expected, (SELECT count(*) FROM {{nation}}) - count(*) AS missing, CAST(sum(n) AS BIGINT) AS linked_villages
FROM f GROUP BY valid_date""")
def agg13_served(spark, sf):
    rows = R.served(spark, _three_runs(spark, sf))
    return SR.coverage(rows, table(spark, sf, "nation").select(F.col("n_nationkey").alias("block_id")))


@query("snk2_activation_history", """
WITH a AS (SELECT o_custkey AS series, o_orderpriority AS run, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS issue FROM {orders}),
l AS (SELECT series, max(seq) AS last FROM a GROUP BY series),
d AS (SELECT a.series, arg_max(run, (issue, seq)) AS default_run, arg_max(run, (issue, seq)) FILTER (seq < last) AS previous_default FROM a JOIN l USING (series) GROUP BY a.series)
SELECT series, run, first_seq, issue, default_run, previous_default, run = default_run AS is_default
FROM (SELECT series, run, min(seq) AS first_seq, max(issue) AS issue FROM a GROUP BY series, run) JOIN d USING (series)""")
def snk2(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderpriority").alias("run"),
                                             F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").alias("issue"))
    return R.history(rows, "run", "seq", "issue", ["series"])


@query("snk3_geojson_rows", f"""
SELECT '{{"type":"Feature","properties":{{"village_id":' || village_id || ',"block_id":' || block_id || '}},"geometry":{{"type":"Point","coordinates":['
 || CAST(round(lon * 1000) AS BIGINT) || ',' || CAST(round(lat * 1000) AS BIGINT) || ']}}}}' AS value FROM ({I.VILLAGES})""")
def snk3(spark, sf):
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(F.col("lon") * 1000).cast("long"),
                                                           F.round(F.col("lat") * 1000).cast("long")).alias("coordinates"))
    return R.geojson_features(villages(spark, sf).withColumn("g", point), "g", ["village_id", "block_id"])


@query("snk3_csv_export", "SELECT split, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS y, min(comment) AS comment FROM ("
       + "SELECT l_returnflag AS split, l_quantity AS quantity, 'a, \"b\" ' || l_linestatus AS comment FROM {lineitem}) GROUP BY split")
def snk3_csv(spark, sf):
    """Rows through the CSV sink and back, quotes and commas in the text."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_quantity").alias("y"),
                                               F.concat(F.lit('a, "b" '), "l_linestatus").alias("comment"))
    R.write_csv(rows, path)
    back = files.read_csv(spark, path, rows.schema)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("double").alias("y"), F.min("comment").alias("comment"))


@query("prj2_map_rows", f"""
WITH b AS (SELECT * FROM ({I.BLOCK_FORECAST}) WHERE humidity_pct IS NOT NULL),
d AS (SELECT DISTINCT valid_date FROM ({I.BLOCK_FORECAST})),
v AS (SELECT village_id, block_id, village_id IN (SELECT o_custkey FROM {{orders}}) AS linked FROM ({I.VILLAGES}))
SELECT village_id, d.valid_date, linked AND b.block_id IS NOT NULL AS available,
 CASE WHEN NOT linked THEN 'Unlinked' WHEN b.block_id IS NULL THEN 'Parent block forecast missing' END AS unavailable_reason,
 CASE WHEN linked THEN round(rainfall_mm, 6) END AS source_rainfall_mm, CASE WHEN linked THEN round(rainfall_mm * 0.9e0, 6) END AS local_rainfall_mm
FROM v CROSS JOIN d LEFT JOIN b ON b.block_id = v.block_id AND b.valid_date = d.valid_date""")
def prj2(spark, sf):
    """Every village on every date; forecasts without humidity were not issued, villages without orders are not linked."""
    v, f = villages(spark, sf), block_forecast(spark, sf)
    linked = table(spark, sf, "orders").select(F.col("o_custkey").alias("village_id")).distinct().withColumn("linked", F.lit(True))
    places = v.select("village_id", "block_id").join(linked, "village_id", "left").select(
        "village_id", "block_id", F.coalesce("linked", F.lit(False)).alias("available"), F.when(F.col("linked").isNull(), "Unlinked").alias("unavailable_reason"))
    geometry = places.join(f.select("block_id").distinct().select("block_id", F.explode(_dates(f)).alias("valid_date")), "block_id")
    values = v.select("village_id", "block_id").join(f.where("humidity_pct is not null"), "block_id").select(
        "village_id", "valid_date", F.round("rainfall_mm", 6).alias("source_rainfall_mm"), F.round(F.col("rainfall_mm") * 0.9, 6).alias("local_rainfall_mm"))
    return R.map_features(geometry, values, ["village_id", "valid_date"], ["rainfall_mm"]).drop("block_id")


def _dates(forecast):
    """The forecast's dates, one a month, as an array from one aggregate row."""
    ends = forecast.agg(F.min("valid_date").alias("a"), F.max("valid_date").alias("b")).select(F.struct("a", "b")).scalar()
    return F.sequence(ends["a"], ends["b"], F.expr("interval 1 month"))


@query("agg25_bulletin_table", f"""
WITH d AS (SELECT c_nationkey AS block_id, CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice) / 9973e0, 6) AS r, round(max(o_totalprice) / 49999e0, 6) AS t
 FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY 1, 2),
f AS (SELECT block_id, min(d) AS start FROM d GROUP BY 1),
x AS (SELECT d.*, CAST(d - CAST(datediff('day', start, d) % 5 AS INTEGER) AS DATE) AS first_date, datediff('day', start, d) % 5 AS k FROM d JOIN f USING (block_id)),
u AS (SELECT block_id, first_date, k, 'rainfall_mm' AS variable, r AS source, r * 2 AS local FROM x UNION ALL SELECT block_id, first_date, k, 'temp_max_c', t, t * 2 FROM x)
SELECT block_id, first_date, variable, {', '.join(f"max(source) FILTER (k = {i}) AS d{i}_source, max(local) FILTER (k = {i}) AS d{i}_local" for i in range(5))},
 round(sum(source), 6) AS source_total, round(sum(local), 6) AS local_total FROM u GROUP BY 1, 2, 3""")
def agg25(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = rows.groupBy(F.col("c_nationkey").alias("block_id"), F.col("o_orderdate").cast("date").alias("d")).agg(
        F.round(F.avg("o_totalprice") / 9973, 6).alias("source_rainfall_mm"),
        F.round(F.max("o_totalprice") / 49999, 6).alias("source_temp_max_c"))
    g = g.withColumns({"local_rainfall_mm": F.col("source_rainfall_mm") * 2, "local_temp_max_c": F.col("source_temp_max_c") * 2})
    out = R.bulletin_table(g, ["block_id"], "d", ["rainfall_mm", "temp_max_c"])
    return out.withColumns({c: F.round(c, 6) for c in ("source_total", "local_total")})


@query("jn15_resolve_names", """
WITH u AS (SELECT n_nationkey, n_name FROM {nation})
SELECT c_custkey, n_nationkey, n_name FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower('NATION_' || c_nationkey) WHEN 1 THEN ' Nation_' || c_nationkey || ' '
  WHEN 2 THEN CAST(c_nationkey AS VARCHAR) ELSE 'old_' || c_nationkey END AS name, c_custkey % 4 AS kind, c_nationkey FROM {customer}) c
LEFT JOIN u ON n_nationkey = c_nationkey AND (kind < 3 OR c_nationkey < 10)""")
def jn15(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    aliases = nation.where("n_nationkey < 10").select(F.concat(F.lit("Old_"), F.col("n_nationkey")).alias("alias"),
                                                      F.col("n_name").alias("canonical"))
    key, kind = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 4
    name = (F.when(kind == 0, F.concat(F.lit("nation_"), key)).when(kind == 1, F.concat(F.lit(" Nation_"), key, F.lit(" ")))
            .when(kind == 2, key).otherwise(F.concat(F.lit("old_"), key)))
    rows = table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    return G.resolve(rows, "name", G.names_index(nation, "n_nationkey", "n_name", aliases)).drop("name")


@query("jn7_village_link", """
WITH g AS (SELECT c_custkey // 2 * 2 + CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey % 2 END AS id, c_custkey, CASE WHEN c_nationkey = 5 THEN NULL ELSE c_nationkey END AS block FROM {customer}),
c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE c_nationkey END AS block FROM {customer} WHERE c_custkey % 7 <> 0),
gn AS (SELECT id, count(*) AS n FROM g GROUP BY id)
SELECT g.id, c_custkey, block_ok, why = '' AS available, CASE WHEN why <> '' THEN why END AS unavailable_reason FROM (
 SELECT g.id, c_custkey, g.block AS block_ok, concat_ws('; ', CASE WHEN g.block IS NULL THEN 'Unresolved block' END, CASE WHEN c.id IS NULL THEN 'Missing covariate record' END,
  CASE WHEN c.id IS NULL OR n <> 1 THEN 'Duplicate/placeholder geographic ID' END,
  CASE WHEN c.id IS NOT NULL AND g.block IS NOT NULL AND c.block <> g.block THEN 'Boundary/covariate parent disagreement' END) AS why
 FROM g JOIN gn USING (id) LEFT JOIN c USING (id)) g""")
def jn7(spark, sf):
    k = F.col("c_custkey")
    cust = table(spark, sf, "customer")
    shared = F.floor(k / 2) * 2 + F.when(k % 11 == 0, 0).otherwise(k % 2)
    geometry = cust.select(shared.alias("id"), "c_custkey", F.when(F.col("c_nationkey") != 5, F.col("c_nationkey")).alias("block"))
    cov = cust.where(k % 7 != 0).select(k.alias("id"), F.when(k % 13 == 0, -1).otherwise(F.col("c_nationkey")).alias("block"))
    out = G.link_villages(geometry, cov, "id", "block")
    return out.select("id", "c_custkey", F.col("block").alias("block_ok"), "available", "unavailable_reason")
