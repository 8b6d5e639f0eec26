"""Ensemble, bootstrap and reconciliation queries."""

from pyspark.sql import functions as F

from rainweave.operators import ensemble as E
from rainweave.workloads import inputs as I
from rainweave.workloads.allocation import villages
from rainweave.workloads.registry import query, table

FACTORS = [round(1.0 + 0.05 * (m - 14.5) / 3.7, 6) for m in range(30)]
NOISES = [round(((m * 37) % 61 - 30) / 17.3, 6) for m in range(30)]

MEMBERS_SQL = f"""
m AS (SELECT unnest([{', '.join(f'{f}e0' for f in FACTORS)}]) AS f, unnest([{', '.join(f'{z}e0' for z in NOISES)}]) AS z),
e AS (SELECT village_id, greatest(0e0, area_m2 / 211e0 * f + (lat - 18) * 1.3e0 + (lon - 76) * 0.7e0 + 0.08e0 * elevation_m / 31e0 * z) AS v
 FROM ({I.VILLAGES}) CROSS JOIN m)"""


def members(spark, sf):
    rows = villages(spark, sf).select("village_id", (F.col("area_m2") / 211).alias("parent"), ((F.col("lat") - 18) * 1.3).alias("dev"),
                                      ((F.col("lon") - 76) * 0.7).alias("res"), (F.col("elevation_m") / 31).alias("relief"))
    return E.ensemble(rows, "parent", "dev", "res", "relief", FACTORS, NOISES)


@query("agg20_ensemble_members", f"WITH {MEMBERS_SQL} SELECT village_id, round(v, 6) AS v FROM e")
def agg20(spark, sf):
    return members(spark, sf).select("village_id", F.explode("members").alias("v")).select("village_id", F.round("v", 6).alias("v"))


@query("agg19_ensemble_summary", f"""WITH {MEMBERS_SQL}
SELECT village_id, round_even(avg(v), 2) AS ensemble_mean, round_even(stddev_pop(v), 2) AS uncertainty_std,
 round_even(quantile_cont(v, 0.1), 2) AS ci_lower_80, round_even(quantile_cont(v, 0.9), 2) AS ci_upper_80,
 round_even(quantile_cont(v, 0.025), 2) AS ci_lower_95, round_even(quantile_cont(v, 0.975), 2) AS ci_upper_95,
 CASE WHEN stddev_pop(v) < 3 THEN 'HIGH' WHEN stddev_pop(v) < 7 THEN 'MODERATE' ELSE 'LOW' END AS confidence_level
FROM e GROUP BY village_id""")
def agg19(spark, sf):
    out = E.ensemble_summary(members(spark, sf))
    return out.select("village_id", "ensemble_mean", "uncertainty_std", "ci_lower_80", "ci_upper_80", "ci_lower_95",
                      "ci_upper_95", "confidence_level")


UNITS_SQL = """
u AS (SELECT datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) // 9 AS unit,
 count(*) FILTER (l_quantity >= 20 AND l_extendedprice >= 40000) AS hits, count(*) FILTER (l_quantity >= 20 AND l_extendedprice < 40000) AS misses,
 count(*) FILTER (l_quantity < 20 AND l_extendedprice >= 40000) AS false_alarms FROM {lineitem} GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS idx, count(*) OVER () AS n FROM u),
d AS (SELECT idx AS draw, n, unnest(range(500)) AS rep FROM i WHERE idx < ceil(n / 2)),
s AS (SELECT *, ('0x' || substr(sha256(rep || '|' || draw || '|42'), 1, 13))::BIGINT % n AS start FROM d),
p AS (SELECT rep, (start + off) % n AS idx FROM (SELECT *, unnest([0, 1]) AS off FROM s) WHERE draw * 2 + off < n),
r AS (SELECT rep, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses, CAST(sum(false_alarms) AS BIGINT) AS false_alarms
 FROM p JOIN i USING (idx) GROUP BY rep)"""


def unit_counts(spark, sf):
    q, p = F.col("l_quantity") >= 20, F.col("l_extendedprice") >= 40000
    unit = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")) / 9)
    return table(spark, sf, "lineitem").groupBy(unit.alias("unit")).agg(
        F.count_if(q & p).alias("hits"), F.count_if(q & ~p).alias("misses"), F.count_if(~q & p).alias("false_alarms"))


@query("agg24_bootstrap_replicates", f"WITH {UNITS_SQL} SELECT CAST(rep AS INTEGER) AS rep, hits, misses, false_alarms FROM r")
def agg24_reps(spark, sf):
    return E.bootstrap_counts(unit_counts(spark, sf), "unit", ["hits", "misses", "false_alarms"])


@query("agg24_bootstrap_intervals", f"""WITH {UNITS_SQL},
x AS (SELECT 'recall' AS score, hits / nullif(hits + misses, 0) AS x FROM r UNION ALL SELECT 'precision', hits / nullif(hits + false_alarms, 0) FROM r
 UNION ALL SELECT 'csi', hits / nullif(hits + misses + false_alarms, 0) FROM r)
SELECT score, round(quantile_cont(x, 0.025), 8) AS low, round(quantile_cont(x, 0.975), 8) AS high, count(x) AS defined FROM x GROUP BY score""")
def agg24(spark, sf):
    out = E.bootstrap_intervals(unit_counts(spark, sf), "unit")
    return out.select("score", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"), "defined")


@query("agg27_soft_reconciliation", f"""
WITH v AS ({I.VILLAGES}), p AS (SELECT block_id, avg(climatology) * (0.2e0 + (block_id % 5) * 0.45e0) AS d, 1e0 + block_id % 3 AS wd FROM v GROUP BY block_id),
r AS (SELECT village_id, block_id, CASE WHEN village_id % 6 = 0 THEN 0 ELSE climatology END AS b, 1 + elevation_m / 700e0 AS w,
 area_m2 / sum(area_m2) OVER (PARTITION BY block_id) AS a FROM v),
t AS (SELECT *, -b * w / a AS t FROM r),
c AS (SELECT t.*, d, wd, sum(a * b) OVER o AS ab, sum(a * a / w) OVER o AS aa FROM t JOIN p USING (block_id) WINDOW o AS (PARTITION BY block_id ORDER BY t)),
l AS (SELECT block_id, arg_max(wd * (d - ab) / (1 + wd * aa), t) AS lam FROM c WHERE t < wd * (d - ab) / (1 + wd * aa) GROUP BY block_id),
x AS (SELECT village_id, block_id, a, greatest(0e0, b + coalesce(lam, 0) * a / w) AS x FROM r LEFT JOIN l USING (block_id))
SELECT village_id, round(x, 6) AS reconciled, round(sum(a * x) OVER (PARTITION BY block_id), 6) AS parent_value FROM x""")
def agg27(spark, sf):
    v = villages(spark, sf)
    parents = v.groupBy("block_id").agg((F.avg("climatology") * (0.2 + (F.col("block_id") % 5) * 0.45)).alias("d"),
                                        (1.0 + F.col("block_id") % 3).alias("wd"))
    kids = v.select("village_id", "block_id", "area_m2", F.when(F.col("village_id") % 6 == 0, 0.0).otherwise(F.col("climatology")).alias("b"),
                    (1 + F.col("elevation_m") / 700).alias("w"))
    out = E.reconcile(kids, parents, ["block_id"], "b", "area_m2", "w", "d", "wd")
    return out.select("village_id", F.round("reconciled", 6).alias("reconciled"), F.round("parent_value", 6).alias("parent_value"))
