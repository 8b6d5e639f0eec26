"""Exact interval pairing: orders forecast, shipped line items are observed."""

from pyspark.sql import functions as F

from rainweave.operators import intervals as P
from rainweave.workloads.registry import query, table

FC = """fc AS (SELECT o_orderkey, o_orderpriority AS source, o_custkey AS location_id, o_orderdate - INTERVAL 1 DAY AS issued_at,
 o_orderdate - INTERVAL 1 DAY + to_hours(o_orderkey % 26) AS available_at, o_orderdate AS valid_start,
 o_orderdate + INTERVAL 1 DAY AS valid_end, o_totalprice AS rain,
 o_orderdate - INTERVAL 1 DAY + to_hours(o_orderkey % 24) AS feature_at FROM {orders}),
ob AS (SELECT o_custkey AS location_id, l_shipdate AS valid_start, max(l_extendedprice) AS observed_mm
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2),
ck AS (SELECT *, count(*) OVER (PARTITION BY source, location_id, issued_at, valid_start) AS copies FROM fc),
st AS (SELECT ck.*, ob.observed_mm, available_at > ck.valid_start OR feature_at > available_at OR copies > 1 AS bad,
  concat_ws('; ', CASE WHEN available_at > ck.valid_start THEN 'not available before accumulation starts' END,
   CASE WHEN copies > 1 THEN 'duplicate forecast' END,
   CASE WHEN feature_at > available_at THEN 'future feature leakage' END) AS why
  FROM ck LEFT JOIN ob ON ob.location_id = ck.location_id AND ob.valid_start = ck.valid_start)"""


ROWS_A_TASK = 500_000


def parts(spark, sf):
    """Tasks that the rows are dealt over: the session's shuffle partitions, more for large tables."""
    rows = table(spark, sf, "lineitem").count() + table(spark, sf, "orders").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def forecasts(spark, sf):
    day, k = F.expr("INTERVAL 1 DAY"), F.col("o_orderkey")
    start = F.col("o_orderdate")

    def hours(h):
        return F.make_dt_interval(F.lit(0), h)

    o = table(spark, sf, "orders")
    return o.select(k, F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("location_id"),
                    F.lit("grid").alias("support_id"), F.sha2(k.cast("string"), 256).alias("source_sha256"),
                    (start - day).alias("issued_at"), (start - day + hours((k % 26).cast("int"))).alias("available_at"),
                    start.alias("valid_start"), (start + day).alias("valid_end"), F.col("o_totalprice").alias("rainfall_mm"),
                    F.array(F.struct(F.lit("f").alias("name"), (start - day + hours((k % 24).cast("int"))).alias(
                        "available_at"))).alias("features"))


def observations(spark, sf):
    n = parts(spark, sf)
    rows = table(spark, sf, "lineitem").repartition(n, "l_orderkey").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("location_id"), F.col("l_shipdate").alias("valid_start"), "l_extendedprice")
    g = rows.repartition(n, "location_id", "valid_start").groupBy("location_id", "valid_start").agg(F.max("l_extendedprice").alias("rainfall_mm"))
    return g.select("location_id", F.lit("grid").alias("support_id"), "valid_start",
                    (F.col("valid_start") + F.expr("INTERVAL 1 DAY")).alias("valid_end"), "rainfall_mm",
                    F.lit("independent_gauge").alias("target_kind"),
                    F.sha2(F.col("location_id").cast("string"), 256).alias("source_sha256"))


@query("jn5_exact_interval_pairs", f"""WITH {FC}
SELECT o_orderkey, CASE WHEN observed_mm IS NULL THEN 'unmatched' ELSE 'paired' END AS status, observed_mm,
 CASE WHEN observed_mm IS NOT NULL THEN 24e0 END AS lead_hours FROM st WHERE NOT bad""")
def jn5(spark, sf):
    a = P.align(forecasts(spark, sf), observations(spark, sf), "features", parts=parts(spark, sf))
    return a.pairs.select("o_orderkey", F.lit("paired").alias("status"), "observed_mm", "lead_hours").unionByName(
        a.unmatched.select("o_orderkey", F.lit("unmatched").alias("status"), F.lit(None).cast("double").alias("observed_mm"),
                           F.lit(None).cast("double").alias("lead_hours")))


@query("jn6_availability_rule", f"WITH {FC} SELECT o_orderkey, why FROM st WHERE bad")
def jn6(spark, sf):
    bad = P.align(forecasts(spark, sf), observations(spark, sf), "features", parts=parts(spark, sf)).bad_forecasts
    return bad.select("o_orderkey", F.concat_ws("; ", "reasons").alias("why"))


@query("agg33_evidence_readiness", f"""WITH {FC}
SELECT (SELECT count(DISTINCT CAST(issued_at AS DATE)) FROM fc) AS issue_dates, (SELECT count(*) FROM fc) AS forecasts,
 (SELECT count(*) FROM ob) AS observations, (SELECT count(DISTINCT year(valid_start)) FROM ob) AS observation_years,
 (SELECT count(*) FROM st WHERE NOT bad AND observed_mm IS NOT NULL) AS exact_pairs""")
def agg33(spark, sf):
    fc, ob = forecasts(spark, sf), observations(spark, sf)
    return P.readiness(fc, ob, P.align(fc, ob, "features", parts=parts(spark, sf)))
