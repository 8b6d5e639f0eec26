"""Data rules, duplicates, coverage, freshness and digests over the given tables."""

from pyspark.sql import functions as F

from rainweave.operators import quality as Q
from rainweave.sources.archives import receipt_matches
from rainweave.workloads import inputs as I
from rainweave.workloads.registry import query, spark_view, table

WEATHER = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 0 AND l_tax < 0.02 THEN -1e0 ELSE l_quantity END AS rainfall_mm,
 20 + l_quantity / 3 AS temp_max_c, 18 + l_extendedprice / 20000 AS temp_min_c, CAST(l_suppkey % 10 AS DOUBLE) AS cloud_cover_oktas,
 60 + l_quantity AS relative_humidity_max_pct, 40 + l_extendedprice / 2000 AS relative_humidity_min_pct,
 CASE WHEN l_returnflag = 'R' AND l_discount < 0.01 THEN NULL ELSE l_discount * 100 END AS wind_speed_kmph,
 CAST(l_partkey % 400 AS DOUBLE) AS wind_direction_deg, CAST(l_shipdate AS DATE) AS valid_date,
 CAST(l_shipdate AS DATE) AS issue_date FROM {lineitem}
"""
REASONS = """concat_ws('; ', CASE WHEN wind_speed_kmph IS NULL THEN 'Values that are no numbers' END,
 CASE WHEN rainfall_mm < 0 OR coalesce(wind_speed_kmph, -1) < 0 THEN 'Negative rainfall or wind speed' END,
 CASE WHEN NOT (cloud_cover_oktas BETWEEN 0 AND 8 AND wind_direction_deg BETWEEN 0 AND 360) THEN 'Cloud cover or wind direction out of range' END,
 CASE WHEN NOT (relative_humidity_min_pct >= 0 AND relative_humidity_min_pct <= relative_humidity_max_pct AND relative_humidity_max_pct <= 100) THEN 'Humidity out of range or min above max' END,
 CASE WHEN temp_min_c > temp_max_c THEN 'Minimum temperature above maximum' END)"""


@query("flt1_range_rules", f"""
SELECT l_orderkey, l_linenumber, why = '' AS accepted, why FROM (SELECT *, {REASONS} AS why FROM ({WEATHER}))""")
def flt1(spark, sf):
    checked = Q.validate(spark_view(spark, sf, WEATHER), Q.weather_rules())
    keys = ["l_orderkey", "l_linenumber"]
    return checked.accepted.select(*keys, F.lit(True).alias("accepted"), F.lit("").alias("why")).unionByName(
        checked.rejected.select(*keys, F.lit(False).alias("accepted"), F.concat_ws("; ", "reasons").alias("why")))


@query("flt7_optional_ranges", f"""
SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN wind_speed_kmph NOT BETWEEN 0 AND 8 THEN 'Value out of range: wind_speed_kmph' END,
 CASE WHEN temp_min_c > temp_max_c THEN 'Lowest value over the highest: temp_min_c, temp_max_c' END) AS why FROM ({WEATHER})
WHERE wind_speed_kmph NOT BETWEEN 0 AND 8 OR temp_min_c > temp_max_c""")
def flt7(spark, sf):
    rules = Q.range_rules({"wind_speed_kmph": (0, 8)}, [("temp_min_c", "temp_max_c")])
    bad = Q.validate(spark_view(spark, sf, WEATHER), rules).rejected
    return bad.select("l_orderkey", "l_linenumber", F.concat_ws("; ", "reasons").alias("why"))


@query("flt4_series_validity", """
SELECT l_suppkey, l_partkey, count(*) AS n, count(*) = count(DISTINCT CAST(l_shipdate AS DATE)) AND bool_and(l_quantity >= 0) AS valid
FROM {lineitem} GROUP BY 1, 2""")
def flt4(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("d", F.col("l_shipdate").cast("date"))
    return Q.series_validity(rows, ["l_suppkey", "l_partkey"], "d", "l_quantity")


@query("flt5_fresh_by_age", """
SELECT event_id, coalesce(epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts) < 6 * 3600000000, false) AS fresh FROM {events}""")
def flt5(spark, sf):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", Q.is_fresh("ts", now).alias("fresh"))


@query("flt8_forecast_request", f"""
SELECT village_id, block_id, local_rainfall_mm FROM ({I.ROUTE_BLOCK}) WHERE valid_date = DATE '1997-03-01' AND block_id = 7""")
def flt8(spark, sf):
    from rainweave.plans import routes
    from rainweave.workloads.allocation import block_forecast, villages
    rows = routes.route(routes.village_adjustments(villages(spark, sf)), block_forecast(spark, sf), "block")
    rows = rows.withColumns({"mode": F.lit("block"), "run_id": F.lit("run-1")})
    return Q.forecast_rows(rows, "block", "run-1", "1997-03-01", 7).select("village_id", "block_id", "local_rainfall_mm")


@query("flt9_select_date", """
SELECT o_custkey, coalesce(max(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) = DATE '1998-06-15'), min(CAST(o_orderdate AS DATE))) AS selected
FROM {orders} GROUP BY o_custkey""")
def flt9(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    return Q.select_date(rows, ["o_custkey"], "d", F.lit("1998-06-15").cast("date"))


@query("flt10_freshness_class", """
SELECT o_custkey, CASE WHEN max(o_orderdate) < TIMESTAMP '2001-06-01' THEN 'archived' WHEN min(o_orderdate) > TIMESTAMP '2001-06-01' THEN 'upcoming'
 ELSE 'current' END AS freshness FROM {orders} GROUP BY o_custkey""")
def flt10(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    return Q.freshness(rows, ["o_custkey"], "d", F.lit("2001-06-01").cast("date"))


@query("flt13_name_column_pick", """
SELECT c_custkey, c_mktsegment FROM {customer} WHERE trim(lower(c_mktsegment)) IN ('machinery', 'building')""")
def flt13(spark, sf):
    return Q.filter_by_name(table(spark, sf, "customer"), ["state_name", "c_name", "c_mktsegment"],
                            ["Machinery", "BUILDING"]).select("c_custkey", "c_mktsegment")


@query("flt16_receipt_dates", """
SELECT o_orderkey, contains('attachment; filename=rain_ind0.25_' || strftime(o_orderdate + to_days(CAST(o_orderkey % 2 AS INTEGER)), '%y_%m_%d') || '.grd',
 'rain_ind0.25_' || strftime(o_orderdate, '%y_%m_%d') || '.grd') AS matches FROM {orders}""")
def flt16(spark, sf):
    day = F.col("o_orderdate").cast("date")
    sent = F.date_add(day, (F.col("o_orderkey") % 2).cast("int"))
    header = F.concat(F.lit("attachment; filename=rain_ind0.25_"), F.date_format(sent, "yy_MM_dd"), F.lit(".grd"))
    return table(spark, sf, "orders").select("o_orderkey", receipt_matches(header, day, day).alias("matches"))


@query("flt17_network_report", """
WITH z AS (SELECT coalesce(string_agg(z, ',' ORDER BY z), '') AS missing FROM (SELECT unnest(['BUILDING', 'COASTAL', 'MACHINERY']) AS z)
 WHERE z NOT IN (SELECT c_mktsegment FROM {customer})),
c AS (SELECT count(DISTINCT c_custkey) AS stations, count(DISTINCT c_custkey) FILTER (c_nationkey = 3) AS target_stations FROM {customer})
SELECT stations, target_stations, missing, missing = '' AND stations >= 20 AND target_stations >= 5 AS passed FROM c CROSS JOIN z""")
def flt17(spark, sf):
    out = Q.network_report(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", "c_nationkey", 3,
                           ["BUILDING", "COASTAL", "MACHINERY"])
    return out.select("stations", "target_stations", F.array_join("missing_zones", ",").alias("missing"), "passed")


@query("flt19_safe_identifiers", """
SELECT page_id, regexp_full_match(split_part(url, '/', 3), '[a-zA-Z0-9_-]+') AS host_safe,
 regexp_full_match('page-' || page_id, '[a-zA-Z0-9_-]+') AS id_safe FROM {pages}""")
def flt19(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", Q.is_safe_id(F.split_part("url", F.lit("/"), F.lit(3))).alias("host_safe"),
        Q.is_safe_id(F.concat(F.lit("page-"), F.col("page_id"))).alias("id_safe"))


@query("flt20_version_agreement", """
WITH m AS (SELECT o_custkey, max(o_orderpriority) AS v FROM {orders} GROUP BY 1)
SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.o_custkey = o.o_custkey AND m.v = o.o_orderpriority)""")
def flt20(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "v")
    manifests = orders.groupBy("o_custkey").agg(F.max("v").alias("v"))
    return Q.agrees_with_manifest(orders, manifests, "o_custkey", ["v"]).select("o_orderkey")


@query("flt21_source_whitelist", """
SELECT doc_id, source FROM {documents} WHERE source NOT IN ('src0', 'src1', 'src2') OR source IS NULL""")
def flt21(spark, sf):
    return Q.unlisted(table(spark, sf, "documents"), "source", ["src0", "src1", "src2"]).select("doc_id", "source")


DIGEST_ROW = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || l_returnflag"


def digest_sql(source, group, row):
    parts = ", ".join(f"sum(('0x' || substr(h, {1 + 13 * i}, 13))::BIGINT)" for i in range(5))
    return f"""SELECT {group}, count(*) AS "rows", sha256(concat_ws(':', count(*), {parts})) AS digest
FROM (SELECT {group}, sha256({row}) AS h FROM {source}) GROUP BY {group}"""


@query("src4_content_digest", digest_sql("{lineitem}", "l_returnflag", DIGEST_ROW))
def src4(spark, sf):
    row = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return Q.digest(table(spark, sf, "lineitem"), ["l_returnflag"], row)


@query("flt20_checksum_agreement", f"""
WITH d AS ({digest_sql('{lineitem}', 'l_suppkey', DIGEST_ROW)}) SELECT l_suppkey, digest FROM d WHERE l_suppkey % 3 = 0""")
def flt20_checksums(spark, sf):
    rows = table(spark, sf, "lineitem")
    row = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    manifests = Q.digest(rows, ["l_suppkey"], row).select(
        "l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, "stale").otherwise(F.col("digest")).alias("checksum"))
    return Q.checksum_mismatches(rows, manifests, "l_suppkey", row, "checksum").select("l_suppkey", "digest")


@query("jsn1_canonical_json", """
SELECT l_orderkey, l_linenumber, sha256(to_json({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_returnflag': l_returnflag})) AS h
FROM {lineitem}""")
def jsn1(spark, sf):
    text = Q.canonical_json(["l_returnflag", "l_partkey", "l_linenumber"])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(text, 256).alias("h"))


SERIES_SQL = """s AS (SELECT o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS d, count(*) % 2 AS v FROM {orders} GROUP BY 1, 2)"""


@query("agg18_duplicate_profiles", f"""WITH {SERIES_SQL},
p AS (SELECT o_custkey, string_agg(d || ':' || v, ',' ORDER BY d) AS profile FROM s GROUP BY o_custkey)
SELECT o_custkey, count(*) OVER (PARTITION BY profile) AS members FROM p""")
def agg18(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        (F.count(F.lit(1)) % 2).alias("v"))
    return Q.duplicate_profiles(rows, "o_custkey", F.concat_ws(":", "y", "v")).select("o_custkey", "members")


FILES_SQL = """
f AS (SELECT o_orderkey AS file, o_custkey AS k, CAST(date_trunc('year', o_orderdate) AS DATE) AS issue, o_orderstatus AS v FROM {orders}),
x AS (SELECT *, first_value(v) OVER w AS v0, first_value(file) OVER w AS canonical_file FROM f WINDOW w AS (PARTITION BY k, issue ORDER BY file)),
c AS (SELECT file, k, issue, canonical_file, CASE WHEN file = canonical_file THEN 'accepted' WHEN v = v0 THEN 'duplicate' ELSE 'conflict' END AS status FROM x)"""


def classified(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("k"),
        F.trunc(F.col("o_orderdate").cast("date"), "year").alias("issue"), F.col("o_orderstatus").alias("v"))
    return Q.classify_duplicates(rows, ["k", "issue"], ["v"], "file")


@query("set2_duplicate_or_conflict", f"WITH {FILES_SQL} SELECT * FROM c")
def set2(spark, sf):
    return classified(spark, sf).select("file", "k", "issue", "canonical_file", "status")


@query("arr1_source_provenance", f"""WITH {FILES_SQL}
SELECT k, issue, canonical_file, file AS source_file, status FROM c WHERE status <> 'conflict'""")
def arr1(spark, sf):
    return Q.provenance(classified(spark, sf), ["k", "issue"], "file")


@query("set5_distinct_members", "SELECT DISTINCT l_suppkey, l_returnflag FROM {lineitem}")
def set5(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query("set6_missing_members", """
SELECT c_custkey FROM {customer} ANTI JOIN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey""")
def set6(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return Q.missing_members(table(spark, sf, "customer"), urgent, ["c_custkey"])


@query("set4_union_of_inputs", """
SELECT o_orderkey AS id, 'orders' AS part FROM {orders} UNION ALL SELECT event_id, 'events' FROM {events}""")
def set4(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("part")).unionByName(
        table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("events").alias("part")))


@query("set7_deterministic_sample", """
SELECT c_custkey FROM {customer} WHERE c_nationkey = 3 UNION ALL
(SELECT c_custkey FROM {customer} WHERE c_nationkey <> 3 ORDER BY sha256(c_custkey || '|42'), c_custkey LIMIT 300)""")
def set7(spark, sf):
    return Q.deterministic_sample(table(spark, sf, "customer"), F.col("c_nationkey") == 3, 300, ["c_custkey"]).select("c_custkey")


@query("jn19_replace_slice", """
SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_nationkey <> 4
UNION ALL SELECT o_custkey, min(o_orderstatus) FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_nationkey = 4 GROUP BY o_custkey""")
def jn19(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("c_mktsegment"))
    new = new.join(old.where("c_nationkey = 4").select("c_custkey", "c_nationkey"), "c_custkey")
    return Q.replace_slice(old, new, F.col("c_nationkey") == 4, ["c_custkey"], ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("agg13_coverage", """
WITH h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS issue, c_nationkey AS nation, n_regionkey AS region
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey)
SELECT i.issue, region, n_nationkey AS nation, h.nation IS NOT NULL AS available
FROM (SELECT DISTINCT issue, region FROM h) i JOIN {nation} ON n_regionkey = region LEFT JOIN (SELECT issue, nation FROM h) h ON h.issue = i.issue AND h.nation = n_nationkey""")
def agg13(spark, sf):
    """On each order date of a region: which of its nations ordered."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("o_orderdate").cast("date").alias("issue"), F.col("c_nationkey").alias("nation")).join(nation, "nation")
    return Q.coverage(rows, nation, "issue", "region", "nation")


@query("agg29_zone_counts", 'SELECT c_mktsegment, count(*) AS "count" FROM {customer} GROUP BY c_mktsegment')
def agg29(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").count()
