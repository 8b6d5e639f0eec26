"""Verification and selection over line items: quantity observed, scaled price predicted."""

from pyspark.sql import functions as F

from rainweave.operators import selection as S, verification as V
from rainweave.workloads import inputs as I
from rainweave.workloads.allocation import villages
from rainweave.plans.event_experiment import THRESHOLDS
from rainweave.workloads.registry import query, table

LI = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS lead, l_quantity AS y,
  l_extendedprice / 1999e0 AS p, l_extendedprice / 105000e0 AS prob, l_quantity * (1 + l_tax) AS q,
  l_shipdate AS d FROM {lineitem}"""


def items(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_returnflag").alias("lead"),
        c("l_quantity").alias("y"), (c("l_extendedprice") / 1999).alias("p"),
        (c("l_extendedprice") / 105000).alias("prob"), (c("l_quantity") * (1 + c("l_tax"))).alias("q"),
        c("l_shipdate").alias("d"))


def event_sql(o, p):
    return f"""count(*) FILTER ({o} AND {p}) AS hits, count(*) FILTER ({o} AND NOT {p}) AS misses,
 count(*) FILTER (NOT {o} AND {p}) AS false_alarms, count(*) FILTER (NOT {o} AND NOT {p}) AS correct_negatives"""


RATIOS = """hits + misses AS observed_events, hits + false_alarms AS alerts,
 round(hits / nullif(hits + misses, 0), 9) AS recall, round(hits / nullif(hits + false_alarms, 0), 9) AS "precision",
 round(false_alarms / nullif(hits + false_alarms, 0), 9) AS false_alarm_ratio,
 round(false_alarms / nullif(false_alarms + correct_negatives, 0), 9) AS false_positive_rate,
 round(hits / nullif(hits + misses + false_alarms, 0), 9) AS csi"""
RATIO_NAMES = ("recall", "precision", "false_alarm_ratio", "false_positive_rate", "csi")


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("agg7_contingency", f"""
WITH g AS (SELECT l_suppkey, {event_sql('(y >= 20)', '(p >= 20)')} FROM ({LI}) GROUP BY l_suppkey)
SELECT *, {RATIOS} FROM g""")
def agg7(spark, sf):
    out = V.contingency(items(spark, sf), F.col("y") >= 20, F.col("p") >= 20, ["l_suppkey"])
    return rounded(out, 9, *RATIO_NAMES)


AMOUNT_SQL = """count(*) AS n, round(avg(abs(p - y)), 6) AS mae_mm, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse_mm,
 round(avg(p - y), 6) AS bias_mm, round(sum(y), 6) / count(*) AS observed_mean_mm, round(avg(p), 6) AS predicted_mean_mm"""


def amount_scores(spark, sf, groups):
    out = V.amounts(items(spark, sf), F.col("y"), F.col("p"), groups)
    return rounded(out, 6, "mae_mm", "rmse_mm", "bias_mm", "predicted_mean_mm", "heavy_mae_mm")


@query("agg8_amount_scores", f"""
WITH g AS (SELECT lead, {AMOUNT_SQL}, {event_sql('(y >= 20)', '(p >= 20)')} FROM ({LI}) GROUP BY lead)
SELECT *, {RATIOS} FROM g""")
def agg8(spark, sf):
    return rounded(amount_scores(spark, sf, ["lead"]).drop("heavy_mae_mm"), 9, *RATIO_NAMES)


@query("agg9_heavy_case_scores", f"""
SELECT l_suppkey, count(*) AS n, round(avg(abs(p - y)), 6) AS mae_mm,
 round(avg(abs(p - y)) FILTER (y >= 20), 6) AS heavy_mae_mm, count(*) FILTER (y >= 20) AS heavy_n
FROM ({LI}) GROUP BY l_suppkey""")
def agg9(spark, sf):
    return amount_scores(spark, sf, ["l_suppkey"]).select(
        "l_suppkey", "n", "mae_mm", "heavy_mae_mm", F.col("observed_events").alias("heavy_n"))


@query("agg10_floored_scores", f"""
WITH g AS (SELECT l_partkey, {event_sql('(y >= 45)', '(p >= 45)')} FROM ({LI}) GROUP BY l_partkey)
SELECT l_partkey, round_even(hits / greatest(1e-4, hits + misses), 3) AS pod,
 round_even(false_alarms / greatest(1e-4, hits + false_alarms), 3) AS far,
 round_even(hits / greatest(1e-4, hits + misses + false_alarms), 3) AS csi FROM g""")
def agg10(spark, sf):
    return V.floored_scores(items(spark, sf), F.col("y"), F.col("p"), 45.0, ["l_partkey"])


def _segment_sql():
    def floored(side, i, x):
        h = f"count(*) FILTER (y >= {x} AND {side} >= {x})"
        f = f"count(*) FILTER (y < {x} AND {side} >= {x})"
        m = f"count(*) FILTER (y >= {x} AND {side} < {x})"
        n = "model" if side == "p" else "naive"
        return f"""round_even({h} / greatest(1e-4, {h} + {m}), 3) AS pod_{n}_{i},
 round_even({f} / greatest(1e-4, {h} + {f}), 3) AS far_{n}_{i},
 round_even({h} / greatest(1e-4, {h} + {m} + {f}), 3) AS csi_{n}_{i}"""
    rm, rb = "sqrt(avg((p - y) * (p - y)))", "sqrt(avg((q - y) * (q - y)))"
    mm, mb = "avg(abs(p - y))", "avg(abs(q - y))"
    return f"""WITH x AS ({LI}),
 c AS (SELECT l_suppkey, count(DISTINCT l_partkey) >= 25 AS multi FROM x GROUP BY l_suppkey),
 s AS (SELECT 'all' AS segment, y, p, q FROM x UNION ALL
       SELECT 'multi', y, p, q FROM x JOIN c USING (l_suppkey) WHERE multi)
SELECT segment, count(*) AS sample_size, round_even({rm}, 2) AS model_rmse, round_even({rb}, 2) AS naive_rmse,
 round_even(({rb} - {rm}) / greatest(1e-4, {rb}) * 100, 2) AS rmse_improvement_pct,
 round_even({mm}, 2) AS model_mae, round_even({mb}, 2) AS naive_mae,
 round_even(({mb} - {mm}) / greatest(1e-4, {mb}) * 100, 2) AS mae_improvement_pct,
 round_even(corr(y, p), 3) AS pearson_model, round_even(corr(y, q), 3) AS pearson_naive,
 {floored('p', 0, 0.1)}, {floored('q', 0, 0.1)}, {floored('p', 1, 20)}, {floored('q', 1, 20)}
FROM s GROUP BY segment"""


@query("agg11_segment_skill", _segment_sql())
def agg11(spark, sf):
    from rainweave.operators.distributed import attach
    rows = items(spark, sf)
    rows = attach(rows, V.density(rows, "l_suppkey", "l_partkey", 25), ["l_suppkey"])
    labels = F.array_compact(F.array(F.lit("all"), F.when(F.col("is_multi"), F.lit("multi"))))
    return V.segment_skill(rows, "y", "p", "q", labels)


@query("agg12_density_cohort", """
SELECT l_suppkey, count(DISTINCT l_partkey) AS members, count(DISTINCT l_partkey) >= 300 AS is_multi
FROM {lineitem} GROUP BY l_suppkey""")
def agg12(spark, sf):
    return V.density(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", 300)


@query("agg14_gradient_plausible", f"""
SELECT block_id, round(corr(elevation_m, climatology), 8) AS r, corr(elevation_m, climatology) > 0.3 AS plausible
FROM ({I.VILLAGES}) GROUP BY block_id""")
def agg14(spark, sf):
    return rounded(V.plausible_gradient(villages(spark, sf), "elevation_m", "climatology", ["block_id"]), 8, "r")


@query("agg15_ratio_of_sums", f"SELECT l_suppkey, round(sum(y) / sum(p), 9) AS factor FROM ({LI}) GROUP BY l_suppkey")
def agg15(spark, sf):
    return rounded(V.ratio_of_sums(items(spark, sf), F.col("y"), F.col("p"), ["l_suppkey"]), 9, "factor")


@query("agg16_monthly_climatology", f"""
WITH x AS (SELECT *, month(d) AS m FROM ({LI})),
 c AS (SELECT m, avg(p) AS climatology FROM x WHERE year(d) <= 1998 GROUP BY m)
SELECT l_orderkey, l_linenumber, round(climatology, 6) AS climatology FROM x LEFT JOIN c USING (m)""")
def agg16(spark, sf):
    rows = items(spark, sf).withColumn("m", F.month("d"))
    out = V.climatology(rows, F.year("d") <= 1998, "p", ["m"])
    return out.select("l_orderkey", "l_linenumber", F.round("climatology", 6).alias("climatology"))


@query("agg21_spread_skill", f"""
SELECT lead, round_even(avg(prob) / greatest(1e-4, max(q)), 2) AS spread_skill_ratio FROM ({LI}) GROUP BY lead""")
def agg21(spark, sf):
    return V.spread_skill(items(spark, sf), F.col("prob"), F.col("q"), ["lead"])


@query("agg22_brier", f"""
SELECT lead, round(avg(power(prob - (y >= 20)::INT, 2)), 8) AS brier,
 round(avg((y >= 20)::INT), 8) AS event_frequency,
 round(avg((y >= 20)::INT) * (1 - avg((y >= 20)::INT)), 8) AS climatology_brier FROM ({LI}) GROUP BY lead""")
def agg22(spark, sf):
    out = V.brier(items(spark, sf), F.col("y") >= 20, F.col("prob"), ["lead"])
    return rounded(out, 8, "brier", "event_frequency", "climatology_brier")


@query("agg22_average_precision", f"""
WITH g AS (SELECT lead, prob, count(*) AS n, count(*) FILTER (y >= 20) AS pos FROM ({LI}) GROUP BY lead, prob),
 c AS (SELECT lead, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY lead) AS tp
       FROM g WINDOW w AS (PARTITION BY lead ORDER BY prob DESC))
SELECT lead, round(sum(pos / tp * cp / cn), 8) AS average_precision FROM c GROUP BY lead""")
def agg22_ap(spark, sf):
    out = V.average_precision(items(spark, sf), F.col("y") >= 20, F.col("prob"), ["lead"])
    return rounded(out, 8, "average_precision")


SWEEP_SQL = f"""
t AS (SELECT unnest([{', '.join(str(t) + 'e0' for t in THRESHOLDS)}]) AS threshold),
g AS (SELECT lead, threshold, {event_sql('(y >= 20)', '(prob >= threshold)')} FROM ({LI}) CROSS JOIN t GROUP BY lead, threshold),
s AS (SELECT *, {RATIOS} FROM g),
w AS (SELECT *, coalesce(recall, 0) >= 0.5 AND coalesce("precision", 0) >= 0.5
  AND coalesce(false_positive_rate <= 0.25, false) AS constraints_met FROM s)"""


@query("agg23_threshold_sweep", f"WITH {SWEEP_SQL} SELECT * FROM w")
def agg23(spark, sf):
    out = V.threshold_sweep(items(spark, sf), F.col("y") >= 20, F.col("prob"), THRESHOLDS, ["lead"])
    return rounded(out, 9, *RATIO_NAMES)


@query("top2_best_threshold", f"""
WITH {SWEEP_SQL} SELECT lead, threshold, csi, constraints_met FROM w QUALIFY row_number() OVER (PARTITION BY lead
 ORDER BY constraints_met DESC, coalesce(csi, 0) DESC, coalesce("precision", 0) DESC, threshold DESC) = 1""")
def top2(spark, sf):
    return S.best_threshold(agg23(spark, sf), ["lead"]).select("lead", "threshold", "csi", "constraints_met")


CANDIDATES_SQL = f"""
u AS (SELECT lead, 0 AS ord, 'raw' AS candidate, y, p FROM ({LI}) UNION ALL
 SELECT lead, 1, 'scaled', y, p * f FROM ({LI}) JOIN (SELECT lead, sum(y) / sum(p) AS f FROM ({LI}) GROUP BY lead) USING (lead)
 UNION ALL SELECT lead, 2, 'damped', y, 10 + p * 0.6 FROM ({LI})),
c AS (SELECT lead, ord, candidate, avg(abs(p - y)) AS mae_mm, sqrt(avg((p - y) * (p - y))) AS rmse_mm,
 avg(p - y) AS bias_mm, avg(y) AS observed_mean_mm, {event_sql('(y >= 20)', '(p >= 20)')} FROM u GROUP BY ALL),
b AS (SELECT lead, mae_mm AS base FROM c WHERE candidate = 'raw'),
e AS (SELECT c.*, abs(bias_mm) <= 0.2 * observed_mean_mm AND mae_mm <= base AS eligible FROM c JOIN b USING (lead))"""


def candidate_scores(spark, sf):
    from rainweave.operators.distributed import attach
    rows = items(spark, sf)
    rows = attach(rows, V.ratio_of_sums(rows, F.col("y"), F.col("p"), ["lead"]), ["lead"])
    p = F.col("p")
    forms = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("candidate"), c.alias("p")) for i, (n, c) in
                      enumerate({"raw": p, "scaled": p * F.col("factor"), "damped": 10 + p * 0.6}.items())])
    long = rows.select("lead", "y", F.inline(forms))
    return V.amounts(long, F.col("y"), F.col("p"), ["lead", "ord", "candidate"])


@query("top3_best_amount", f"""
WITH {CANDIDATES_SQL} SELECT lead, arg_min(candidate, (CASE WHEN eligible THEN 0 ELSE 1 END, rmse_mm, ord)) AS selected,
 bool_or(eligible) AS constraints_met FROM e GROUP BY lead""")
def top3(spark, sf):
    return S.best_amount(candidate_scores(spark, sf), ["lead"], "raw")


@query("top4_best_event", f"""
WITH {CANDIDATES_SQL}, s AS (SELECT lead, ord, candidate, {RATIOS} FROM e),
m AS (SELECT *, coalesce(recall, 0) >= 0.5 AND coalesce("precision", 0) >= 0.5 AND false_positive_rate <= 0.6 AS met FROM s)
SELECT lead, arg_max(candidate, (met, coalesce(csi, 0), coalesce("precision", 0), -ord)) AS selected,
 bool_or(met) AS joint_target_met FROM m GROUP BY lead""")
def top4(spark, sf):
    scores = rounded(candidate_scores(spark, sf), 9, *RATIO_NAMES).withColumn("constraints_met", V.meets(0.5, 0.5, 0.6))
    return S.best_event(scores, ["lead"])


@query("top5_lowest_error", f"""
WITH {CANDIDATES_SQL} SELECT lead, arg_min(candidate, (mae_mm, ord)) AS selected, round(min(mae_mm), 6) AS mae_mm
FROM e GROUP BY lead""")
def top5(spark, sf):
    return rounded(S.lowest(candidate_scores(spark, sf), ["lead"], "mae_mm"), 6, "mae_mm")


@query("top6_deploy_gate", f"""
WITH {CANDIDATES_SQL}, w AS (SELECT lead, arg_min(candidate, (rmse_mm, ord)) AS selected, min(rmse_mm) AS winner,
 max(rmse_mm) FILTER (candidate = 'raw') AS base FROM e GROUP BY lead)
SELECT lead, selected, selected <> 'raw' AND winner < base AS deploy FROM w""")
def top6(spark, sf):
    scores = candidate_scores(spark, sf)
    base = scores.groupBy("lead").agg(F.max(F.when(F.col("candidate") == "raw", F.col("rmse_mm"))).alias("base"))
    chosen = S.lowest(scores, ["lead"], "rmse_mm").join(base, "lead")
    return S.deploy_gate(chosen, ["lead"], "raw", "rmse_mm", "base").select("lead", "selected", "deploy")


@query("top7_extremes", """
SELECT l_suppkey, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS lowest_key, min(l_extendedprice) AS lowest,
 arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) AS highest_key, max(l_extendedprice) AS highest,
 round(max(l_extendedprice) - min(l_extendedprice), 2) AS spread FROM {lineitem} GROUP BY l_suppkey""")
def top7(spark, sf):
    return rounded(S.extremes(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey", ["l_suppkey"]), 2, "spread")


@query("top8_limited_rows", """
SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 2000""")
def top8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), "o_orderkey").limit(2000)


@query("top9_class_breaks", """
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i,
 count(*) OVER (PARTITION BY l_returnflag) AS n FROM {lineitem})
SELECT l_returnflag, max(v) FILTER (i = floor(0.2e0 * (n - 1)) + 1) AS b1, max(v) FILTER (i = floor(0.4e0 * (n - 1)) + 1) AS b2,
 max(v) FILTER (i = floor(0.6e0 * (n - 1)) + 1) AS b3, max(v) FILTER (i = floor(0.8e0 * (n - 1)) + 1) AS b4
FROM r GROUP BY l_returnflag""")
def top9(spark, sf):
    return S.class_breaks(table(spark, sf, "lineitem"), F.col("l_extendedprice"), groups=["l_returnflag"])


@query("agg30_run_audit", """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS runs, count(DISTINCT l_partkey) AS cells,
 CAST(min(l_shipdate) AS DATE) AS date_start, CAST(max(l_shipdate) AS DATE) AS date_end, count(*) AS n
FROM {lineitem} GROUP BY l_returnflag""")
def agg30(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("runs"), F.countDistinct("l_partkey").alias("cells"),
        F.min("l_shipdate").cast("date").alias("date_start"), F.max("l_shipdate").cast("date").alias("date_end"),
        F.count(F.lit(1)).alias("n"))


@query("agg32_uniform_value", """
SELECT l_partkey, l_suppkey, CASE WHEN min(l_discount) = max(l_discount) THEN min(l_discount) END AS uniform
FROM {lineitem} GROUP BY l_partkey, l_suppkey""")
def agg32(spark, sf):
    return S.uniform_value(table(spark, sf, "lineitem"), "l_discount", ["l_partkey", "l_suppkey"])


@query("agg34_joint_target_passes", f"""
WITH g AS (SELECT l_suppkey, {event_sql('(y >= 20)', '(p >= 20)')} FROM ({LI}) GROUP BY l_suppkey), r AS (SELECT {RATIOS} FROM g)
SELECT count(*) FILTER (recall >= 0.5 AND "precision" >= 0.5) AS passed, count(*) AS leads FROM r""")
def agg34(spark, sf):
    return agg7(spark, sf).agg(F.count_if((F.col("recall") >= 0.5) & (F.col("precision") >= 0.5)).alias("passed"),
                               F.count(F.lit(1)).alias("leads"))


@query("flt12_year_splits", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN year(o_orderdate) IN (1995, 1996, 1997) THEN 'train'
 WHEN year(o_orderdate) IN (1998) THEN 'calibration' WHEN year(o_orderdate) IN (1999) THEN 'selection' END END AS split
FROM {orders}""")
def flt12(spark, sf):
    spec = {"train": [1995, 1996, 1997], "calibration": [1998], "selection": [1999]}
    return S.splits(table(spark, sf, "orders"), F.year("o_orderdate"), spec,
                    F.col("o_orderstatus") == "P").select("o_orderkey", "split")


@query("flt14_target_guard", """
SELECT count(*) AS n, count(*) FILTER (l_quantity IS NULL) AS non_finite, round(var_pop(l_quantity), 6) AS variance,
 count(*) > 0 AND count(*) FILTER (l_quantity IS NULL) = 0 AND var_pop(l_quantity) >= 1e-12 AS trainable FROM {lineitem}""")
def flt14(spark, sf):
    return rounded(S.target_guard(table(spark, sf, "lineitem"), "l_quantity"), 6, "variance")
