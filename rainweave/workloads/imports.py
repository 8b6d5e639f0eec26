"""Import queries: block tables, binary grids, file readers and the incremental import."""

import uuid

from pyspark.sql import functions as F

from rainweave.operators import geography as G
from rainweave.plans import block_import
from rainweave.session import checkpoint_dir
from rainweave.sources import block_tables as B, files, grids
from rainweave.streaming.imports import import_stream
from rainweave.workloads import inputs as I
from rainweave.workloads.registry import query, spark_view, spread, table
from rainweave.workloads.runs import snk3

# Values of a customer's five-day table; kind decides which files are broken.
TABLES = """
SELECT c_custkey AS k, c_nationkey AS nation, DATE '2024-01-10' + CAST(c_custkey % 700 AS INTEGER) AS issue,
 CASE WHEN c_custkey % 12 IN (7, 8, 9, 10, 11) THEN c_custkey % 12 ELSE 0 END AS kind FROM {customer}
"""
VALUES = {"rainfall_mm": "(k * (i + 3) % 400) / 10e0", "temp_max_c": "30 + (k + i) % 10", "temp_min_c": "15 + (k * 3 + i) % 10",
          "cloud_cover_oktas": "(k + i) % 9", "relative_humidity_max_pct": "80 + (k + i) % 20",
          "relative_humidity_min_pct": "30 + (k * 7 + i) % 40", "wind_speed_kmph": "(k * 11 + i) % 30",
          "wind_direction_deg": "(k * 17 + i * 40) % 360"}
ISSUES = {7: "Negative rainfall or wind speed", 8: "No row of wind_direction_deg",
          9: "Days missing, repeated or out of order", 10: "File name and title give different blocks", 11: "File name of another form"}


def block_files(spark, sf):
    """CSV texts written from customers, some broken on purpose."""
    rows = spread(spark_view(spark, sf, TABLES))
    kind = F.col("kind")
    names = {v: s[0] for v, s in B.LABELS.items()}

    def cells(v, i):
        x = F.expr(VALUES[v].replace("i", str(i)))
        return F.when((kind == 7) & F.lit(v == "rainfall_mm" and i == 2), F.lit("-1")).otherwise(x.cast("string"))

    lines = [F.concat(F.lit("NATION_"), F.when(kind == 10, 99).otherwise(F.col("nation")), F.lit(" : Block Forecast issued on "),
                      F.date_format("issue", "dd-MM-yyyy"), F.lit(",,,,,,"))]
    days = [F.date_format(F.date_add("issue", i + 1), "dd-MM-yyyy") for i in range(5)]
    days[3] = F.when(kind == 9, days[0]).otherwise(days[3])
    lines.append(F.concat_ws(",", F.lit("Date"), *days, F.lit("Total / Average")))
    for v in B.LABELS:
        line = F.concat_ws(",", F.lit(names[v]), *[cells(v, i) for i in range(5)], F.lit("- - -"))
        lines.append(F.when(~((kind == 8) & F.lit(v == "wind_direction_deg")), line))
    name = F.concat(F.lit("Nashik_nation_"), F.col("nation"), F.when(kind == 11, "+").otherwise("_"), F.col("issue"), F.lit(".csv"))
    text = F.concat(F.lit("\uFEFF"), F.concat_ws("\r\n", *lines))
    return rows.select("k", name.alias("file"), text.alias("content"), F.sha2(text, 256).alias("sha256"))


def parsed_files(spark, sf):
    raw = block_files(spark, sf)
    rows = B.parse(raw.withColumn("key", F.col("k")))
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    nations = nations.unionByName(spark_view(spark, sf, "SELECT max(n_nationkey) + 75 AS n_nationkey, 'NATION_99' AS n_name FROM {nation}"))
    return B.resolve_blocks(rows, G.names_index(nations, "n_nationkey", "n_name"), "n_nationkey", "n_name")


@query("src1_block_table_records", f"""
WITH t AS ({TABLES}), x AS (SELECT *, CAST(unnest(range(0, 5)) AS INTEGER) AS i FROM t WHERE kind = 0)
SELECT k, nation AS n_nationkey, issue AS issue_date, CAST(issue + i + 1 AS DATE) AS valid_date,
 {', '.join(f'CAST({e} AS DOUBLE) AS {v}' for v, e in VALUES.items())} FROM x""")
def src1(spark, sf):
    return B.records(parsed_files(spark, sf), "k", "n_nationkey").select("k", "n_nationkey", "issue_date", "valid_date", *VALUES)


@query("src3_folder_import_report", f"""
WITH t AS ({TABLES}) SELECT k, CASE kind WHEN 0 THEN 'accepted' ELSE 'rejected' END AS severity, CASE kind WHEN 0 THEN ''
 {' '.join(f"WHEN {k} THEN '{m}'" for k, m in ISSUES.items())} END AS message FROM t""")
def src3(spark, sf):
    first = F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit(""))
    ok = F.size("reasons") == 0
    return parsed_files(spark, sf).select("k", F.when(ok, "accepted").otherwise("rejected").alias("severity"), first.alias("message"))


@query("flt2_structure_rules", f"""
WITH t AS ({TABLES}) SELECT k, CASE kind {' '.join(f"WHEN {k} THEN '{m}'" for k, m in ISSUES.items() if k in (8, 9, 11))} END AS message FROM t WHERE kind IN (8, 9, 11)""")
def flt2(spark, sf):
    rows = B.parse(block_files(spark, sf))
    structural = F.filter("reasons", lambda r: F.rlike(r, F.lit("^(No row|Repeated|Date row|Days|Not exactly|File name)")))
    return rows.select("k", F.try_element_at(structural, F.lit(1)).alias("message")).where("message IS NOT NULL")


@query("flt3_soft_warnings", f"""
WITH t AS ({TABLES}), w AS (SELECT unnest(['rainfall_mm', 'temp_max_c', 'temp_min_c', 'relative_humidity_max_pct', 'relative_humidity_min_pct', 'wind_speed_kmph']) AS v)
SELECT k, v || ': summary is no number' AS message FROM t CROSS JOIN w WHERE kind = 0""")
def flt3(spark, sf):
    rows = parsed_files(spark, sf).where(F.size("reasons") == 0)
    return rows.select("k", F.explode("warnings").alias("message"))


CELLS = 129 * 135


def daily_grids(spark, sf):
    """One binary plane per event day: summed values by cell, the southern rows measured, the rest missing."""
    cell = F.pmod(F.col("user_id") * 7919 + F.length("event_type") * 31, F.lit(100 * 135))
    # At most one row per cell of the fixed grid and day.
    cells = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("date"), cell.alias("cell")).agg(
        F.avg("value").alias("v"))

    def pack(pdf):
        import numpy as np
        import pandas as pd
        plane = np.full(129 * 135, -999.0, dtype="<f4")
        plane[:100 * 135] = 0
        plane[pdf["cell"].to_numpy().astype(int)] = pdf["v"].to_numpy()
        return pd.DataFrame({"file": [str(pdf["date"].iloc[0])], "content": [plane.tobytes()]})

    return cells.groupBy("date").applyInPandas(pack, "file string, content binary")


GRID_SQL = """
c AS (SELECT CAST(ts AS DATE) AS date, (user_id * 7919 + length(event_type) * 31) % 13500 AS cell, CAST(avg(value) AS FLOAT) AS v FROM {events} GROUP BY 1, 2)"""


@query("src6_daily_grid_decode", f"""WITH {GRID_SQL}
SELECT date, CAST(count(*) FILTER (v > 0) AS BIGINT) AS wet, 13500::BIGINT AS measured, 17415::BIGINT AS cells, round(sum(v::DOUBLE), 2) AS total FROM c GROUP BY date""")
def src6(spark, sf):
    rows = grids.decode(daily_grids(spark, sf))
    return rows.groupBy(F.col("file").cast("date").alias("date")).agg(
        F.count_if(F.col("rain_mm") > 0).alias("wet"), F.count("rain_mm").alias("measured"), F.count(F.lit(1)).alias("cells"),
        F.round(F.sum("rain_mm"), 2).alias("total"))


@query("src5_annual_grid_decode", f"""WITH {GRID_SQL}, d AS (SELECT DISTINCT date FROM c)
SELECT dayofyear(date) - 1 AS day, CAST(count(*) FILTER (v > 0) AS BIGINT) AS wet, round(sum(v::DOUBLE), 2) AS total FROM c GROUP BY date""")
def src5(spark, sf):
    # Big-endian files of one plane each stand for a year file whose length comes with the row.
    def swap(batches):
        import numpy as np
        for b in batches:
            yield b.assign(content=[np.frombuffer(x, "<f4").astype(">f4").tobytes() for x in b["content"]])

    daily = daily_grids(spark, sf)
    big = daily.mapInPandas(swap, daily.schema).withColumn("days", F.lit(1))
    rows = grids.decode(big, days=None)
    return rows.groupBy((F.dayofyear(F.col("file").cast("date")) - 1).cast("long").alias("day")).agg(
        F.count_if(F.col("rain_mm") > 0).alias("wet"), F.round(F.sum("rain_mm"), 2).alias("total"))


@query("src5_year_grid_planes", f"""WITH {GRID_SQL}
SELECT year(date) || '.grd' AS file, CAST(dayofyear(date) - 1 AS INTEGER) AS day, CAST(count(*) FILTER (v > 0) AS BIGINT) AS wet, 13500::BIGINT AS measured, round(sum(v::DOUBLE), 2) AS total
FROM c GROUP BY date""")
def src5_planes(spark, sf):
    """A year's planes in one big-endian file, written by the files sink and read plane by plane."""
    from rainweave.sources import grid_source

    def year(pdf):
        import numpy as np
        import pandas as pd
        dates = pd.to_datetime(pdf["file"])
        planes = np.full((365 + int(dates.iloc[0].is_leap_year), *grids.SHAPE), grids.MISSING, ">f4")
        for day, content in zip(dates.dt.dayofyear, pdf["content"]):
            planes[day - 1] = np.frombuffer(content, "<f4").reshape(grids.SHAPE)
        return pd.DataFrame({"file": [f"{dates.iloc[0].year}.grd"], "content": [planes.tobytes()]})

    path = f"{checkpoint_dir(spark)}/grids-{uuid.uuid4().hex}"
    grid_source.write_files(daily_grids(spark, sf).groupBy(F.substring("file", 1, 4)).applyInPandas(year, "file string, content binary"), path)
    rows = grid_source.scan(spark, path)
    return rows.groupBy("file", "day").agg(F.count_if(F.col("rain_mm") > 0).alias("wet"), F.count("rain_mm").alias("measured"),
                                           F.round(F.sum("rain_mm"), 2).alias("total")).where("measured > 0")


def _polygon(df, scale, lon, lat):
    c = F.col(df.columns[0])
    corners = [(0, 0), (scale, 0), (scale, scale), (0, scale), (0, 0)]
    ring = F.array(*[F.struct((lon + a).alias("lon"), (lat + b).alias("lat")) for a, b in corners])
    return df.select(c.alias("poly"), ring.alias("ring"))


@query("src7_grid_extraction", f"""WITH {GRID_SQL},
g AS (SELECT iy, ix, 6.5e0 + 0.25e0 * iy AS lat, 66.5e0 + 0.25e0 * ix AS lon FROM (SELECT unnest(range(0, 129)) AS iy) CROSS JOIN (SELECT unnest(range(0, 135)) AS ix)),
n AS (SELECT n_nationkey AS k, 70 + n_nationkey % 5 * 4 AS x, 10 + n_nationkey // 5 * 4 AS y FROM {{nation}}),
s AS (SELECT DISTINCT iy, ix, lat, lon FROM g JOIN n ON lon BETWEEN x AND x + 2 AND lat BETWEEN y AND y + 2),
h AS (SELECT s.*, lon BETWEEN 74 AND 76 AND lat BETWEEN 14 AND 16 AS holdout,
 power(greatest(74 - lon, lon - 76, 0), 2) + power(greatest(14 - lat, lat - 16, 0), 2) <= 0.0625 AS excluded FROM s)
SELECT d.date, h.holdout, h.excluded, count(*) AS cells, round(coalesce(sum(v::DOUBLE), 0), 2) AS total
FROM (SELECT DISTINCT date FROM c) d CROSS JOIN h LEFT JOIN c ON c.date = d.date AND c.cell = h.iy * 135 + h.ix GROUP BY 1, 2, 3""")
def src7(spark, sf):
    from rainweave.operators.spatial import ring_edges
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    state = ring_edges(_polygon(n, 2.0, 70.0 + k % 5 * 4, 10.0 + F.floor(k / 5) * 4), "poly", "ring")
    held = state.where("poly = 6")
    cells = grids.flag_cells(grids.cell_table(spark), state, held)
    rain = grids.extract(grids.decode(daily_grids(spark, sf)), cells, F.col("file").cast("date"))
    return rain.join(cells.select("grid_id", "holdout", F.col("excluded_from_training").alias("excluded")), "grid_id").groupBy(
        "date", "holdout", "excluded").agg(F.count(F.lit(1)).alias("cells"), F.round(F.coalesce(F.sum("rain_mm"), F.lit(0.0)), 2).alias("total"))


@query("src12_geojson_read", f"""
SELECT village_id, block_id, 'Point' AS geometry_type, CAST(round(lon * 1000) AS DOUBLE) AS x FROM ({I.VILLAGES})""")
def src12(spark, sf):
    path = f"{checkpoint_dir(spark)}/geojson-{uuid.uuid4().hex}"
    line = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("value"), F.lit("]}"))
    snk3(spark, sf).select(line.alias("value")).write.text(path)
    rows = files.read_geojson(spark, path, "village_id:bigint,block_id:int", "array<double>", multiline=False)
    return rows.select("village_id", "block_id", "geometry_type", F.col("coordinates")[0].alias("x"))


@query("stm1_incremental_import", f"""
WITH t AS ({TABLES}) SELECT k, CAST(issue + 1 AS DATE) AS first_day FROM t WHERE kind = 0""")
def stm1(spark, sf):
    """Stream the tables through the import twice; the second arrival repeats the first and adds nothing."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    key = F.lpad(F.col("k").cast("string"), 12, "0")
    # Every customer is a block of its own here, so that no table is another's copy or conflict.
    rows = block_files(spark, sf).select(F.regexp_replace("file", r"^Nashik_nation_\d+", F.concat(F.lit("Nashik_B"), key)).alias("file"),
                                         F.regexp_replace("content", "NATION_(?!99 )\\d+", F.concat(F.lit("B"), key)).alias("content"))
    rows = rows.withColumn("sha256", F.sha2("content", 256))
    blocks = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("B"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("name"))
    index = G.names_index(blocks, "c_custkey", "name")
    for _ in range(2):
        rows.write.mode("append").parquet(f"{base}/in")
        import_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint", index,
                      block_id="c_custkey", block_name="name").awaitTermination()
    return spark.read.parquet(f"{base}/out/records").groupBy(F.col("c_custkey").alias("k")).agg(F.min("valid_date").alias("first_day"))


DAYS_SQL = ", ".join("[" + ", ".join(f"CAST({e.replace('i', str(i))} AS DOUBLE)" for e in VALUES.values()) + "]" for i in range(5))
STATUS_SQL = f"""
t AS ({TABLES}), v AS (SELECT t.*, [{DAYS_SQL}] AS days FROM t),
f AS (SELECT *, first_value(k) OVER w AS first_k, first_value(days) OVER w AS first_days FROM v WHERE kind = 0 WINDOW w AS (PARTITION BY nation, issue ORDER BY k)),
s AS (SELECT k, nation, issue, CASE WHEN days <> first_days THEN 'conflict' WHEN k = first_k THEN 'accepted' ELSE 'duplicate' END AS status, first_k AS canonical FROM f
 UNION ALL SELECT k, nation, issue, 'rejected', NULL FROM v WHERE kind <> 0)"""


def classified_files(spark, sf):
    rows = parsed_files(spark, sf)
    # The customer's number makes file names distinct, in the order of the numbers.
    rows = rows.withColumn("file", F.lpad(F.col("k").cast("string"), 20, "0"))
    return block_import.classify(rows, ["n_nationkey", "issue_date"])


@query("src3_folder_import_status", f"WITH {STATUS_SQL} SELECT k, status, canonical FROM s")
def src3_status(spark, sf):
    return classified_files(spark, sf).select("k", "status", F.col("canonical_file").cast("long").alias("canonical"))


@query("src3_folder_import_coverage", f"""WITH {STATUS_SQL}, d AS (SELECT DISTINCT issue FROM s WHERE status = 'accepted')
SELECT issue AS issue_date, n_nationkey, EXISTS (SELECT 1 FROM s WHERE s.issue = d.issue AND s.nation = n_nationkey AND status = 'accepted') AS available
FROM d CROSS JOIN {{nation}}""")
def src3_coverage(spark, sf):
    return block_import.coverage(classified_files(spark, sf), table(spark, sf, "nation"), "n_nationkey")


@query("src3_folder_import_manifest", f"""WITH {STATUS_SQL}
SELECT CAST(count(*) FILTER (status = 'accepted') AS BIGINT) AS accepted, CAST(count(*) FILTER (status = 'duplicate') AS BIGINT) AS duplicate,
 CAST(count(*) FILTER (status = 'conflict') AS BIGINT) AS conflict, CAST(count(*) FILTER (status = 'rejected') AS BIGINT) AS rejected, FALSE AS valid FROM s""")
def src3_manifest(spark, sf):
    return block_import.manifest(classified_files(spark, sf)).drop("dataset_version")
