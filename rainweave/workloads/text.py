"""Text and page scans over the given pages, documents and names."""

from pyspark.sql import functions as F

from rainweave.functions import numeric as M, text as T
from rainweave.sources import bulletins, pages as P, stations
from rainweave.workloads.registry import query, table


@query("str1_filename_groups", r"""
SELECT page_id, regexp_extract(url, '(?i)^(https?)://([^/]+)/([a-z]{2})/', 1) AS scheme, regexp_extract(url, '(?i)^(https?)://([^/]+)/([a-z]{2})/', 2) AS host,
 regexp_extract(url, '(?i)^(https?)://([^/]+)/([a-z]{2})/', 3) AS lang FROM {pages}""")
def str1(spark, sf):
    pattern = "(?i)^(https?)://([^/]+)/([a-z]{2})/"
    return table(spark, sf, "pages").select("page_id", *[F.coalesce(T.extract("url", pattern, i + 1), F.lit("")).alias(n)
                                                         for i, n in enumerate(("scheme", "host", "lang"))])


@query("str2_title_names", """
SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS name FROM {customer}""")
def str2(spark, sf):
    padded = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    return table(spark, sf, "customer").select("c_custkey", T.title_name(padded).alias("name"))


@query("src2_label_form", r"""
SELECT p_partkey, lower(regexp_replace(p_name || ' (°C)', '\s+', '', 'g')) AS label FROM {part}""")
def src2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.label(F.concat(F.upper("p_name"), F.lit(" (℃)"))).alias("label"))


@query("str4_entity_cleanup", """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS clean
FROM {pages}""")
def str4(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.unescape("html").alias("clean"))


@query("str5_urls_in_text", r"""
SELECT page_id, unnest(list_distinct(regexp_extract_all(url || ' ' || html, 'https?://[^\s"''<>\)]+'))) AS url FROM {pages}""")
def str5(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(T.urls(F.concat_ws(" ", "url", "html"))).alias("url"))


@query("str7_synthesized_ids", """
SELECT c_custkey, 'MH_' || CASE WHEN c_nationkey % 5 = 0 THEN '00' ELSE CAST(c_nationkey AS VARCHAR) END || '_' || c_custkey AS id FROM {customer}""")
def str7(spark, sf):
    code = F.when(F.col("c_nationkey") % 5 == 0, F.lit(" ")).otherwise(F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", T.synthesized_id(
        "MH", (F.concat(code, F.lit(" ")), "00"), ("c_custkey", "0")).alias("id"))


@query("dt1_date_formats", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM {orders}""")
def dt1(spark, sf):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd-MM-yyyy"))
            .when(k == 2, F.date_format(day, "d.M.yyyy")).otherwise(F.date_format(day, "yyyy/MM/dd")))
    return table(spark, sf, "orders").select("o_orderkey", T.date(text, "yyyy-MM-dd", "d-M-yyyy", "d.M.yyyy").alias("d"))


@query("dt4_day_list_rollover", """
SELECT o_orderkey, i, CAST(CAST(o_orderdate AS DATE) + i AS DATE) AS d FROM (SELECT *, CAST(unnest(range(0, 5)) AS INTEGER) AS i FROM {orders})""")
def dt4(spark, sf):
    day = F.col("o_orderdate").cast("date")
    labels = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.dayofmonth(F.date_add(day, i)))
    return table(spark, sf, "orders").select("o_orderkey", F.posexplode(T.rolled_dates(labels, day)).alias("i", "d"))


BULLETIN = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 AS kind,
 o_custkey % 90 AS r0, (o_custkey * 7) % 90 AS r1, (o_custkey * 13) % 90 AS r2, (o_custkey * 29) % 90 AS r3, (o_custkey * 31) % 90 AS r4,
 25 + o_custkey % 15 AS hi, 15 + o_orderkey % 12 AS lo FROM {orders}
"""


def bulletin_texts(spark, sf):
    """Text bulletins written from order values: five rain values after the label, older ones before it."""
    from rainweave.workloads.registry import spark_view, spread
    rows = spread(spark_view(spark, sf, BULLETIN))
    day = lambda i: F.date_format(F.date_add("d", i), "dd")
    rain = [F.col(f"r{i}").cast("string") for i in range(5)]
    rain[4] = F.when(F.col("kind") == 2, F.lit("n/a")).otherwise(rain[4])
    text = F.concat_ws(
        "\n", F.concat(F.lit("meeting dated "), F.date_format(F.date_sub("d", 1), "dd.MM.yyyy")),
        F.concat(F.lit("Weather Forecast ("), F.date_format("d", "dd.MM.yyyy"), F.lit(" to "), F.date_format(F.date_add("d", 4), "dd.MM.yyyy"), F.lit(")")),
        F.concat(F.lit("01 02 03 04 05 06 07 Date "), F.concat_ws(" ", *[day(i) for i in range(5)])),
        F.concat(F.lit("9.1 8.2 7.3 6.4 5.5 4.6 3.7 Rainfall (mm) "), F.concat_ws(" ", *rain)),
        F.concat(F.lit("9 8 7 6 5 4 3 Max. Temp. (0C) "), F.concat_ws(" ", *[F.col("hi").cast("string")] * 5)),
        F.concat(F.lit("9 8 7 6 5 4 3 Min. Temp. (0C) "), F.concat_ws(" ", *[F.col("lo").cast("string")] * 5)),
        F.lit("Cloudy Clear Cloud Cover Cloudy Clear Cloudy Clear Overcast\n"))
    return rows.select("o_orderkey", text.alias("text"))


@query("src8_bulletin_text", f"""
WITH b AS ({BULLETIN}), i AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS i)
SELECT o_orderkey, CAST(d - 1 AS DATE) AS issued_date, CAST(d + i AS DATE) AS valid_date, CAST([r0, r1, r2, r3, r4][i + 1] AS DOUBLE) AS rainfall_mm,
 CAST(hi AS DOUBLE) AS temp_max_c, CAST(lo AS DOUBLE) AS temp_min_c, ['Cloudy', 'Clear', 'Cloudy', 'Clear', 'Overcast'][i + 1] AS cloud_description
FROM b CROSS JOIN i WHERE kind <> 2 AND lo <= hi""")
def src8(spark, sf):
    parsed = bulletins.parse(bulletin_texts(spark, sf), ["o_orderkey"])
    return bulletins.records(parsed, ["o_orderkey"]).select(
        "o_orderkey", "issued_date", "valid_date", "rainfall_mm", "temp_max_c", "temp_min_c", "cloud_description")


FRAGMENTS = """SELECT c_nationkey, c_custkey, upper(c_name) AS name, 1995 + c_custkey % 9 AS y, c_custkey % 500 AS amount, c_custkey % 300 AS norm,
 c_custkey % 4 AS kind FROM {customer}"""


def rain_pages(spark, sf):
    """One page per customer with a district object written from its values."""
    from rainweave.workloads.registry import spark_view
    rows = spark_view(spark, sf, FRAGMENTS)
    num = lambda c: F.concat(F.floor(F.col(c) / 10), F.lit("."), F.col(c) % 10)
    normal = F.when(F.col("kind") == 1, F.lit("")).otherwise(F.concat(F.lit("<\\/br>Normal : "), num("norm"), F.lit(" mm")))
    actual = F.when(F.col("kind") == 2, F.lit("Actual : -")).otherwise(F.concat(F.lit("Actual : "), num("amount"), F.lit(" mm")))
    html = F.concat(F.lit('{"title": "'), F.col("name"), F.lit('", "id": "'), F.col("c_custkey"),
                    F.lit('", "color": "#00ff00", "info": "NA", "balloonText": "<h6>x<\\/h6> <p>Date : '), F.col("y"),
                    F.lit("-08-31<\\/br>Departure : -89%<\\/br>"), actual, normal, F.lit('<\\/p>"}'))
    return rows.select("c_custkey", F.concat(F.lit("<script>["), html, F.lit("]</script>")).alias("html"))


@query("src9_realised_rain", f"""
SELECT c_custkey, name AS district, amount / 10e0 AS rainfall_mm, make_date(y, 8, 31) AS observed_date,
 CASE WHEN kind <> 1 THEN norm / 10e0 END AS normal_mm, '-89%' AS departure FROM ({FRAGMENTS}) WHERE kind <> 2""")
def src9(spark, sf):
    return P.realized_rain(rain_pages(spark, sf), "c_custkey", "html")


@query("src10_all_district_rain", f"""
SELECT c_custkey, name AS district_name, CAST(c_custkey AS VARCHAR) AS district_id, '#00ff00' AS color, '-89%' AS departure, y || '-08-31' AS date,
 CASE WHEN kind = 2 THEN 0 ELSE amount / 10e0 END AS rainfall_mm, CASE WHEN kind = 1 THEN 0 ELSE norm / 10e0 END AS normal_rainfall_mm FROM ({FRAGMENTS})""")
def src10(spark, sf):
    return P.district_rain(rain_pages(spark, sf), "c_custkey", "html")


@query("src11_allowed_links", r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)(?:href|src)=["'']([^"'']+)["'']', 1)) AS link,
 generate_subscripts(regexp_extract_all(html, '(?i)(?:href|src)=["'']([^"'']+)["'']', 1), 1) - 1 AS pos FROM {pages}),
t AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, url, CASE WHEN link LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(link, '&amp;', '&') ELSE link END AS target FROM l)
SELECT page_id, pos, target FROM t WHERE target LIKE 'https://%' AND target <> url AND contains(lower(regexp_extract(target, '^https?://[^/]*([^?#]*)', 1)), 'th')""")
def src11(spark, sf):
    return P.links(table(spark, sf, "pages"), "page_id", "url", "html", path_contains=["th"])


@query("src15_station_payload", """
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) - 20 AS r, max(l_extendedprice) / 5000 AS hi, min(l_extendedprice) / 9000 AS lo, max(l_discount) * 1500 AS h
 FROM {lineitem} GROUP BY 1, 2)
SELECT l_orderkey, make_date(1995, 1, 10 + l_linenumber) AS date, round_even(greatest(0, r), 2) AS rainfall_mm, round_even(hi, 1) AS temp_max_c,
 round_even(lo, 1) AS temp_min_c, round_even((hi + lo) / 2, 1) AS temp_mean_c, round_even(greatest(10, least(100, h)), 1) AS rh_pct FROM l""")
def src15(spark, sf):
    item = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        (F.max("l_quantity") - 20).alias("r"), (F.max("l_extendedprice") / 5000).alias("hi"),
        (F.min("l_extendedprice") / 9000).alias("lo"), (F.max("l_discount") * 1500).alias("h"))
    day = F.concat(F.lit("199501"), F.col("l_linenumber") + 10)
    # An order has at most a handful of line numbers.
    g = item.groupBy("l_orderkey").agg(F.collect_list(F.struct(day.alias("k"), "r", "hi", "lo", "h")).alias("x"))
    series = lambda f: F.map_from_entries(F.transform("x", lambda e: F.struct(e["k"], e[f])))
    body = F.struct(F.struct(series("r").alias("PRECTOTCORR"), series("hi").alias("T2M_MAX"), series("lo").alias("T2M_MIN"),
                             series("h").alias("RH2M")).alias("parameter"))
    payload = F.to_json(F.struct(body.alias("properties")))
    return stations.reshape(g.select("l_orderkey", payload.alias("payload")), ["l_orderkey"], "payload")


@query("mth1_clamp", "SELECT o_orderkey, greatest(20000, least(150000, o_totalprice)) AS v FROM {orders}")
def mth1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", M.clamp("o_totalprice", 20000, 150000).alias("v"))


@query("mth2_logistic", """
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-greatest(-40e0, least(40e0, 3e0 * (l_quantity - 25) + 0.5e0)))), 9) AS p FROM {lineitem}""")
def mth2(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(
        M.sigmoid(F.col("l_quantity") - 25, 3.0, 0.5), 9).alias("p"))


@query("mth3_log_round_trip", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS y, round(exp(ln(1 + o_totalprice)) - 1, 3) AS back FROM {orders}""")
def mth3(spark, sf):
    y = F.log1p("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(y, 9).alias("y"), F.round(F.expm1(y), 3).alias("back"))
