"""Models over line items, stations and villages."""

from pyspark.sql import functions as F

from rainweave.operators import allocation as A, boosting as B, kriging as K, models as M, selection as S, spatial as X, verification as V
from rainweave.operators.distributed import attach
from rainweave.plans import downscale as D, event_experiment as EX
from rainweave.session import cut_lineage
from rainweave.workloads import inputs as I
from rainweave.workloads.ensembles import FACTORS, NOISES
from rainweave.workloads.allocation import villages
from rainweave.workloads.registry import query, spark_view, table
from rainweave.workloads.rules import COV_SQL, SITES, village_covariates
from rainweave.workloads.spatial import STATIONS, stations
from rainweave.functions.numeric import sigmoid

X3 = ["l_quantity", "l_discount", "l_tax"]
LOG_PRICE = "log1p(l_extendedprice)"

# Ridge with alpha 10 on three standardised features, solved by Cramer's rule.
RIDGE_SQL = """
m AS (SELECT count(*) AS n, avg(l_quantity) AS a1, avg(l_discount) AS a2, avg(l_tax) AS a3, avg(ln(1 + l_extendedprice)) AS ay,
 stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, stddev_pop(l_tax) AS s3 FROM {lineitem}),
z AS (SELECT (l_quantity - a1) / s1 AS z1, (l_discount - a2) / s2 AS z2, (l_tax - a3) / s3 AS z3, ln(1 + l_extendedprice) - ay AS y FROM {lineitem} CROSS JOIN m),
q AS (SELECT sum(z1 * z1) + 10 AS p11, sum(z1 * z2) AS p12, sum(z1 * z3) AS p13, sum(z2 * z2) + 10 AS p22, sum(z2 * z3) AS p23, sum(z3 * z3) + 10 AS p33,
 sum(z1 * y) AS r1, sum(z2 * y) AS r2, sum(z3 * y) AS r3 FROM z),
d AS (SELECT *, p11 * (p22 * p33 - p23 * p23) - p12 * (p12 * p33 - p23 * p13) + p13 * (p12 * p23 - p22 * p13) AS det FROM q),
b AS (SELECT (r1 * (p22 * p33 - p23 * p23) - p12 * (r2 * p33 - p23 * r3) + p13 * (r2 * p23 - p22 * r3)) / det AS b1,
 (p11 * (r2 * p33 - p23 * r3) - r1 * (p12 * p33 - p23 * p13) + p13 * (p12 * r3 - r2 * p13)) / det AS b2,
 (p11 * (p22 * r3 - r2 * p23) - p12 * (p12 * r3 - r2 * p13) + r1 * (p12 * p23 - p22 * p13)) / det AS b3 FROM d),
c AS (SELECT b1 / s1 AS c1, b2 / s2 AS c2, b3 / s3 AS c3, ay - b1 / s1 * a1 - b2 / s2 * a2 - b3 / s3 * a3 AS c0 FROM b CROSS JOIN m)"""


@query("ml6_ridge", f"""WITH {RIDGE_SQL}
SELECT l_orderkey, l_linenumber, round(c0 + c1 * l_quantity + c2 * l_discount + c3 * l_tax, 5) AS log_prediction,
 round(exp(c0 + c1 * l_quantity + c2 * l_discount + c3 * l_tax) - 1, 0) AS prediction FROM {{lineitem}} CROSS JOIN c""")
def ml6(spark, sf):
    rows = table(spark, sf, "lineitem")
    rows = attach(rows, M.ridge(rows, X3, F.expr(LOG_PRICE)), [])
    return rows.select("l_orderkey", "l_linenumber", F.round(M.linear(X3), 5).alias("log_prediction"),
                       F.round(F.expm1(M.linear(X3)), 0).alias("prediction"))


@query("win12_leave_one_group_out_ridge", """
WITH g AS (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice) AS sx, sum(l_quantity) AS sy, sum(l_extendedprice * l_extendedprice) AS sxx,
 sum(l_extendedprice * l_quantity) AS sxy FROM {lineitem} GROUP BY 1),
r AS (SELECT l_suppkey, (SELECT sum(n) FROM g) - n AS n, (SELECT sum(sx) FROM g) - sx AS sx, (SELECT sum(sy) FROM g) - sy AS sy,
 (SELECT sum(sxx) FROM g) - sxx AS sxx, (SELECT sum(sxy) FROM g) - sxy AS sxy FROM g),
b AS (SELECT l_suppkey, sx / n AS mx, sy / n AS my, n * (sxy / n - sx / n * sy / n) / sqrt(sxx / n - power(sx / n, 2)) / (n + 10) / sqrt(sxx / n - power(sx / n, 2)) AS b FROM r)
SELECT l_orderkey, l_linenumber, l_suppkey, round(my + b * (l_extendedprice - mx), 5) AS prediction FROM {lineitem} JOIN b USING (l_suppkey)""")
def win12_ridge(spark, sf):
    out = M.logo_ridge(table(spark, sf, "lineitem"), "l_suppkey", ["l_extendedprice"], F.col("l_quantity"))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", F.round("prediction", 5).alias("prediction"))


@query("win12_leave_one_group_out_boosted")
def win12_boosted(spark, sf):
    """Return flags are the groups: one boosted fit per held-out flag."""
    data = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1999).alias("rain"),
                                               "l_discount", "l_tax")
    return D.logo_boosted(data, "l_returnflag", XS, "y", ["A", "N", "R"], trees=8)


@query("arr2_feature_vectors", """
SELECT l_orderkey, l_linenumber, l_quantity AS v0, l_discount AS v1, l_tax AS v2 FROM {lineitem}""")
def arr2(spark, sf):
    from pyspark.ml.functions import vector_to_array
    rows = M.assemble(table(spark, sf, "lineitem"), X3).withColumn("v", vector_to_array("features"))
    return rows.select("l_orderkey", "l_linenumber", *[F.col("v")[i].alias(f"v{i}") for i in range(3)])


def split_items(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1999).alias("rain"),
        "l_discount", "l_tax", F.year("l_shipdate").alias("year"))
    return S.splits(rows, F.col("year"), {"train": [1995, 1996, 1997, 1998], "calibration": [1999], "selection": [2000, 2001]})


XS = ["rain", "l_discount", "l_tax"]


def _amount(kind):
    def run(spark, sf):
        rows = split_items(spark, sf)
        model = M.fit_amount(rows.where("split = 'train'"), XS, "y", kind, trees=15)
        out = M.score_amount(model, rows, XS)
        return V.amounts(out, F.col("y"), F.col("prediction"), ["split"]).select(
            "split", "n", *[F.round(c, 4).alias(c) for c in ("mae_mm", "rmse_mm", "bias_mm")])
    return run


query("ml1_boosted_squared")(_amount("squared"))
query("ml1_boosted_absolute")(_amount("absolute"))
query("ml2_tweedie_amount")(_amount("tweedie"))
query("ml7_random_forest")(_amount("forest"))

@query("ml2_boosted_tweedie", """
SELECT * FROM (VALUES ('deviance falls each round', TRUE), ('better than the linear model on the selection split', TRUE),
 ('every complete row has an amount over 0', TRUE), ('better than the mean on the selection split', TRUE)) AS t(fact, holds)""")
def ml2_boosted(spark, sf):
    """Boosted Tweedie amounts beside the generalised linear model: what has to hold, measured over all rows."""
    # quantities do not depend on the features, so the amounts are made: none under a discount of 5 %, else a product with the quantity as noise
    wet = F.when(F.col("l_discount") >= 0.05, F.col("rain") * F.col("l_tax") * 10 + F.col("y") / 10).otherwise(0.0)
    rows = cut_lineage(split_items(spark, sf).withColumn("y", wet).select("split", "y", *XS))
    train = rows.where("split = 'train'")
    boosted, linear = B.fit_tweedie(train, XS, "y", trees=12), M.fit_amount(train, XS, "y", "tweedie")
    both = B.score_tweedie(boosted, rows, XS, "boosted").join(train.agg(F.avg("y").alias("mean")))
    both = M.score_amount(linear, both.drop("prediction"), XS, "linear")
    chosen = F.col("split") == "selection"
    loss = {c: F.avg(F.when(chosen, B.tweedie_deviance("y", c))).alias(c) for c in ("boosted", "linear", "mean")}
    falls = all(b < a for a, b in zip(boosted.deviances, boosted.deviances[1:]))
    sums = both.agg(*loss.values(), F.bool_and(F.coalesce(F.col("boosted") > 0, F.lit(False)) | ~M.complete(XS)).alias("positive"))
    facts = F.array(*[F.struct(F.lit(t).alias("fact"), c.alias("holds")) for t, c in (
        ("deviance falls each round", F.lit(falls)), ("better than the linear model on the selection split", F.col("boosted") < F.col("linear")),
        ("every complete row has an amount over 0", F.col("positive")), ("better than the mean on the selection split", F.col("boosted") < F.col("mean")))])
    return sums.select(F.inline(facts))


def events(spark, sf):
    return split_items(spark, sf).withColumn("event", (F.col("y") >= 20).cast("double"))


@query("ml3_boosted_event")
def ml3(spark, sf):
    rows = events(spark, sf)
    model = M.fit_event(rows.where("split = 'train'"), XS, "event", trees=15)
    return M.raw_score(model, rows, XS).select("l_orderkey", "l_linenumber", "split", F.round("raw", 5).alias("raw"))


@query("ml4_rain_only_logistic")
def ml4(spark, sf):
    rows = events(spark, sf).withColumn("log_rain", F.log1p("rain"))
    model = M.fit_logistic(rows.where("split = 'train'"), ["log_rain"], "event")
    scored = M.raw_score(model, rows, ["log_rain"]).withColumn("p", sigmoid("raw"))
    return V.brier(scored, F.col("event") == 1, F.col("p"), ["split"])


@query("ml5_calibrated_probability")
def ml5(spark, sf):
    scored = EX.event_probabilities(events(spark, sf), XS, "event", trees=15)
    return scored.select("l_orderkey", "l_linenumber", F.round("probability", 6).alias("probability"))


@query("ml12_batch_scores")
def ml12(spark, sf):
    return EX.select_models(split_items(spark, sf), XS, "y", "rain", trees=10)


@query("top10_feature_importance")
def top10(spark, sf):
    rows = split_items(spark, sf)
    model = M.fit_amount(rows.where("split = 'train'"), XS, "y", "squared", trees=15)
    return M.importances(model, XS, rows).orderBy(F.col("importance").desc(), "feature").limit(3)


@query("ml11_out_of_fold_residual", """
WITH o AS (SELECT l_suppkey, avg(dev) AS observed FROM (SELECT l_suppkey, round_even(l_quantity - round_even(avg(l_quantity) OVER (PARTITION BY l_returnflag), 2), 2) AS dev
  FROM {lineitem}) GROUP BY 1),
g AS (SELECT l_suppkey, sum(l_discount) AS s, count(*) AS n FROM {lineitem} WHERE l_suppkey % 4 <> 0 GROUP BY 1),
p AS (SELECT l_suppkey, ((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n) AS prediction FROM g)
SELECT l_suppkey, round(observed - coalesce(prediction, 0), 8) AS residual FROM o LEFT JOIN p USING (l_suppkey)""")
def ml11(spark, sf):
    from rainweave.operators.series import leave_one_group_out_mean
    rows = table(spark, sf, "lineitem")
    dev = A.decompose(rows, ["l_returnflag"], "l_quantity")
    pred = leave_one_group_out_mean(rows.where("l_suppkey % 4 <> 0"), "l_suppkey", "l_discount")
    return M.station_residuals(dev, pred, station="l_suppkey").select("l_suppkey", F.round("residual", 8).alias("residual"))


@query("jn17_station_residual_join", """
WITH o AS (SELECT l_suppkey, avg(l_quantity) AS observed FROM {lineitem} GROUP BY 1), p AS (SELECT l_suppkey, avg(l_discount) * 100 AS prediction FROM {lineitem} WHERE l_suppkey % 3 <> 0 GROUP BY 1)
SELECT s_suppkey AS l_suppkey, s_nationkey, round(observed - coalesce(prediction, s_nationkey / 7e0, 0), 8) AS residual FROM {supplier} JOIN o ON l_suppkey = s_suppkey LEFT JOIN p USING (l_suppkey)""")
def jn17(spark, sf):
    rows = table(spark, sf, "lineitem")
    pred = rows.where("l_suppkey % 3 <> 0").groupBy("l_suppkey").agg((F.avg("l_discount") * 100).alias("prediction"))
    meta = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    found = rows.join(meta, "l_suppkey")
    res = M.station_residuals(found, pred.join(meta, "l_suppkey"), None, "l_suppkey", "l_quantity")
    out = meta.join(res.drop("residual"), "l_suppkey").withColumn(
        "residual", F.col("observed") - F.coalesce("prediction", F.col("s_nationkey") / 7.0, F.lit(0.0)))
    return out.select("l_suppkey", "s_nationkey", F.round("residual", 8).alias("residual"))


@query("ml10_density_rule", """
SELECT s_nationkey, count(*) AS stations, CASE WHEN count(*) >= 10 THEN 'universal' WHEN count(*) >= 5 THEN 'ordinary' ELSE 'idw' END AS method
FROM {supplier} GROUP BY s_nationkey""")
def ml10_rule(spark, sf):
    return M.density_rule(table(spark, sf, "supplier"), ["s_nationkey"])


STATION_GROUPS = f"""SELECT 'block ' || block_id AS area, station_id, slon, slat, residual FROM ({STATIONS})
 UNION ALL SELECT 'district ' || n_regionkey, station_id, slon, slat, residual FROM ({STATIONS}) JOIN {{nation}} ON block_id = n_nationkey"""

BINS_SQL = f"""
st AS ({STATION_GROUPS}),
spots AS (SELECT area, slon, slat, avg(residual) AS v FROM st GROUP BY 1, 2, 3),
pairs AS (SELECT a.area, sqrt(power(a.slon - b.slon, 2) + power(a.slat - b.slat, 2)) AS h, power(a.v - b.v, 2) / 2 AS g
 FROM spots a JOIN spots b ON a.area = b.area AND (a.slon <> b.slon OR a.slat <> b.slat)),
ends AS (SELECT area, min(h) AS low, max(h) AS high FROM pairs GROUP BY area),
bins AS (SELECT area, CASE WHEN high > low THEN least(floor((h - low) / ((high - low) / 6)), 5) ELSE 0 END AS bin, count(*) // 2 AS pairs, avg(h) AS lag, avg(g) AS g
 FROM pairs JOIN ends USING (area) GROUP BY 1, 2)"""


@query("ml10_experimental_variogram", f"""WITH {BINS_SQL}
SELECT area, CAST(bin AS INTEGER) AS bin, pairs, round(lag, 6) AS lag, round(g, 6) AS semivariance FROM bins""")
def ml10_bins(spark, sf):
    spots = K.station_spots(spark_view(spark, sf, STATION_GROUPS), "area", "slon", "slat", "residual", "area")
    rows = K.semivariogram(spots, "area")
    return rows.select("area", "bin", "pairs", F.round("lag", 6).alias("lag"), F.round("semivariance", 6).alias("semivariance"))


@query("ml10_fitted_variogram", f"""WITH RECURSIVE {BINS_SQL},
kind AS (SELECT area, CASE WHEN count(*) >= 10 THEN 'linear' ELSE 'spherical' END AS model FROM st GROUP BY area),
top AS (SELECT area, max(lag) AS far, max(g) AS top FROM bins GROUP BY area),
cand AS (SELECT area, model, top, k, CASE WHEN model = 'linear' THEN 0e0 ELSE far * k / 200e0 END AS reach
 FROM top JOIN kind USING (area), range(1, 201) r(k) WHERE model = 'spherical' OR k = 1),
x AS (SELECT cand.area, k, top, g, CASE WHEN model = 'linear' THEN lag ELSE 1.5e0 * least(lag / reach, 1e0) - 0.5e0 * power(least(lag / reach, 1e0), 3) END AS f
 FROM cand JOIN bins USING (area)),
step AS (SELECT 0 AS n, area, k, CAST(NULL AS DOUBLE) AS scale, CAST(NULL AS DOUBLE) AS nugget FROM cand
 UNION ALL
 SELECT n + 1, area, k, CASE WHEN nugget0 <> greatest(0e0, least(top, nugget0)) THEN greatest(0e0, (sfg - greatest(0e0, least(top, nugget0)) * sf) / CASE WHEN sff > 0 THEN sff ELSE 1e0 END)
   ELSE greatest(scale0, 0e0) END, greatest(0e0, least(top, nugget0))
 FROM (SELECT *, CASE WHEN flat OR scale0 < 0 THEN sg / sw ELSE (sg - scale0 * sf) / sw END AS nugget0 FROM (
  SELECT *, CASE WHEN flat THEN 0e0 ELSE (sw * sfg - sf * sg) / det END AS scale0 FROM (
   SELECT *, sw * sff - sf * sf AS det, sw * sff - sf * sf <= 1e-12 * sw * sff AS flat FROM (
    SELECT n, area, k, any_value(top) AS top, sum(w) AS sw, sum(w * f) AS sf, sum(w * g) AS sg, sum(w * f * f) AS sff, sum(w * f * g) AS sfg FROM (
     SELECT n, area, k, top, f, g, CASE WHEN scale IS NULL THEN 1e0 ELSE 1 / sqrt(1 + power(scale * f + nugget - g, 2)) END AS w
     FROM step JOIN x USING (area, k) WHERE n < 60) GROUP BY 1, 2, 3))))),
loss AS (SELECT area, k, scale, nugget, sum(2 * (sqrt(1 + power(scale * f + nugget - g, 2)) - 1)) AS loss FROM step JOIN x USING (area, k) WHERE n = 60 GROUP BY 1, 2, 3, 4),
best AS (SELECT loss.area, min(k) AS k FROM loss JOIN (SELECT area, min(loss) AS least FROM loss GROUP BY area) m USING (area) WHERE loss <= least * (1 + 1e-9) + 1e-12 GROUP BY 1)
SELECT area, model, round(scale, 4) AS scale, round(reach, 4) AS reach, round(nugget, 4) AS nugget, round(loss, 4) AS loss
FROM best JOIN loss USING (area, k) JOIN cand USING (area, k)""")
def ml10_fit(spark, sf):
    spots = K.station_spots(spark_view(spark, sf, STATION_GROUPS), "area", "slon", "slat", "residual", "area")
    rows = K.fitted_variograms(spots, "area")
    return rows.select("area", "model", *(F.round(c, 4).alias(n) for c, n in (("scale", "scale"), ("range", "reach"), ("nugget", "nugget"), ("loss", "loss"))))


@query("ml10_field_at_stations", f"""WITH st AS ({STATION_GROUPS}),
n AS (SELECT area, count(*) AS n FROM st GROUP BY area),
spots AS (SELECT area, slon, slat, avg(residual) AS v FROM st GROUP BY 1, 2, 3)
SELECT area || ' ' || station_id AS place, round(greatest(-15e0, least(15e0, v)), 4) AS residual
FROM st JOIN n USING (area) JOIN spots USING (area, slon, slat) WHERE n >= 5""")
def ml10_stations(spark, sf):
    """Kriging reproduces the stations it is made from."""
    rows = spark_view(spark, sf, STATION_GROUPS)
    rows = attach(rows, M.density_rule(rows, ["area"]), ["area"]).where("method <> 'idw'").withColumn("place", F.concat_ws(" ", "area", "station_id"))
    weights = K.kriging_weights(rows, "area", "slon", "slat", "residual")
    out = M.kriging_field(rows, weights, "area", "place", "slon", "slat")
    return out.select("place", F.round("residual", 4).alias("residual"))


@query("ml10_kriged_residual_field")
def ml10(spark, sf):
    st = stations(spark, sf)
    out = M.residual_field(villages(spark, sf), st, "block_id", "village_id", "lon", "lat", "residual", "slon", "slat")
    return out.withColumn("residual", F.round("residual", 4))


def _downscale_inputs(spark, sf):
    vill = village_covariates(spark, sf).withColumns({
        "block_rain": 18.0 + F.col("block_id") / 3.0, "block_tmax": F.lit(29.5), "block_tmin": F.lit(21.0),
        "rain_deviation": half(F.col("historical_rain_bias") / 11.0), "temp_deviation": half(F.col("elevation_mean") / 907.0)})
    return vill, stations(spark, sf)


def half(c):
    return F.bround(c, 2)


@query("ml13_downscaled_district", f"""WITH {COV_SQL},
v AS (SELECT c.*, s.block_id, s.lat, s.lon, 18 + s.block_id / 3e0 AS parent, round_even(historical_rain_bias / 11e0, 2) AS dev, round_even(elevation_mean / 907e0, 2) AS tdev FROM c JOIN ({SITES}) s USING (village_id)),
r AS (SELECT village_id, greatest(-12e0, least(12e0, sum(residual / (power(round(lat, 5) - slat, 2) + power(round(lon, 5) - slon, 2) + 1e-4))
  / sum(1 / (power(round(lat, 5) - slat, 2) + power(round(lon, 5) - slon, 2) + 1e-4)))) AS residual FROM v JOIN ({STATIONS}) t USING (block_id) GROUP BY village_id),
m AS (SELECT unnest([{', '.join(f'{f}e0' for f in FACTORS)}]) AS f, unnest([{', '.join(f'{z}e0' for z in NOISES)}]) AS z),
e AS (SELECT village_id, elevation_mean, tdev, greatest(0e0, parent * f + dev + coalesce(residual, 0) + 0.08e0 * (elevation_std / 10 + slope_mean / 5) * z) AS x
 FROM v LEFT JOIN r USING (village_id) CROSS JOIN m),
g AS (SELECT village_id, any_value(elevation_mean) AS h, any_value(tdev) AS tdev, round_even(avg(x), 2) AS rain, stddev_pop(x) AS sd FROM e GROUP BY village_id)
SELECT village_id, rain AS downscaled_rain_pred, round_even(sd, 2) AS uncertainty_std, CASE WHEN sd < 3 THEN 'HIGH' WHEN sd < 7 THEN 'MODERATE' ELSE 'LOW' END AS confidence_level,
 round_even(29.5e0 - (h - 550) * 0.0065e0 + tdev * 0.5e0, 1) AS downscaled_tmax_pred, round_even(greatest(30e0, least(98e0, 60 + rain * 0.4e0)), 1) AS downscaled_rh_pred FROM g""")
def ml13(spark, sf):
    vill, st = _downscale_inputs(spark, sf)
    out = D.downscale(vill, st, "block_id", FACTORS, NOISES, method="idw")
    return out.select("village_id", "downscaled_rain_pred", "uncertainty_std", "confidence_level", "downscaled_tmax_pred", "downscaled_rh_pred")


@query("ml14_footprint_training")
def ml14(spark, sf):
    """Supplier shipments as station observations; model fit and its skill on the training rows."""
    st = stations(spark, sf).select(F.col("station_id"), F.col("block_id").alias("district"), F.col("slat").alias("lat"), F.col("slon").alias("lon"))
    obs = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("station_id"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("date")).agg(
        F.avg("l_quantity").alias("rainfall_mm"))
    rows = D.training_rows(obs.join(st, "station_id"), village_covariates(spark, sf))
    model = D.train(rows, trees=10)
    scored = model.transform(M.assemble(rows, D.FEATURES))
    return scored.groupBy("station_id").agg(F.round(F.avg("prediction"), 5).alias("prediction"), F.round(F.avg("deviation"), 5).alias("observed"))
