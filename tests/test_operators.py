import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainweave.operators import allocation as A, comparison as C, ensemble as E, forecast as N, intervals as P, quality as Q, rules as R, runs, selection as S, verification as V


def test_allocation_conserves_parent_and_keeps_zero(spark):
    df = spark.createDataFrame([("b", 1, 4.0, 1.0, 500.0), ("b", 2, 1.0, 3.0, 700.0), ("z", 3, 0.0, 2.0, 100.0)],
                               "block string, id int, v double, a double, e double")
    out = A.conserving_factor(df, ["block"], "v", "a", "e")
    assert {r.id: r.rainfall_factor for r in out.collect()}[3] == 1.0
    rows = A.localise(out.withColumns({"rainfall_mm": F.lit(20.0), "temp_max_c": F.lit(30.0), "temp_min_c": F.lit(None).cast("double")}),
                      "rainfall_factor", "temperature_adjustment_c")
    b = [r for r in rows.collect() if r.block == "b"]
    assert sum(r.local_rainfall_mm * r.a for r in b) / 4 == pytest.approx(20, abs=1e-4)
    assert b[0].local_temp_min_c is None and b[0].variable_status["temp_min_c"] == "unavailable"
    zero = A.localise(out.withColumns({"rainfall_mm": F.lit(0.0)}), "rainfall_factor", "temperature_adjustment_c", temperatures=())
    assert {r.local_rainfall_mm for r in zero.collect()} == {0.0}


def side(spark, rows):
    return spark.createDataFrame(rows, "id string, d string, v double, a double")


def test_pairing_guards(spark):
    l, r = side(spark, [("p", "1", 2.0, 5.0)]), side(spark, [("p", "1", 0.0, 5.0)])
    row = C.components(C.pair(l, r, ["id"], ("d",), ("a",), strict=True).paired.withColumns({"f": F.lit(1.0)}),
                       "left_v", "right_v", "f", "f", "left_v", "right_v").first()
    assert row.difference_mm == 2 and row.percent_vs_right is None
    with pytest.raises(ValueError):
        C.pair(l.union(l), r, ["id"], strict=True)
    with pytest.raises(ValueError):
        C.pair(l, side(spark, [("p", "2", 0.0, 5.0)]), ["id"], ("d",), strict=True)
    assert C.pair(l, r.where("false"), ["id"]).left_only.count() == 1


def test_event_and_amount_scores(spark):
    df = spark.createDataFrame([(0.0, 0.0), (19.0, 21.0), (20.0, 20.0), (50.0, 10.0)], "y double, p double")
    r = V.amounts(df, F.col("y"), F.col("p")).first()
    assert (r.hits, r.misses, r.false_alarms, r.correct_negatives) == (1, 1, 1, 1)
    assert (r.recall, r.precision, r.bias_mm) == (0.5, 0.5, -9.5) and r.csi == pytest.approx(1 / 3)


def test_threshold_policy(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 0, 0, 0, 0], [0.8, 0.4, 0.6, 0.2, 0.1, 0.1, 0.1, 0.1])), "y int, p double")
    sweep = V.threshold_sweep(df, F.col("y") == 1, F.col("p"), [0.0, 0.3, 0.7])
    assert sweep.count() == 3 and S.best_threshold(sweep).first().threshold == 0.3


def test_average_precision_groups_ties(spark):
    df = spark.createDataFrame([(True, 0.5), (False, 0.5), (True, 0.9), (False, 0.1)], "e boolean, s double")
    assert V.average_precision(df, F.col("e"), F.col("s")).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


def steps(spark, drop=()):
    leads = [h for h in [*range(121), *range(123, 151, 3)] if h not in drop]
    return spark.createDataFrame([(0, h, 2 / 3600, 30.0, 80.0) for h in leads], "run int, h int, r double, p double, q double")


def test_rate_integration(spark):
    for a, b in ((99, 123), (123, 147)):
        assert N.integrate(steps(spark), ["run"], "h", "r", a, b).first().amount == pytest.approx(48)
    assert N.integrate(steps(spark), ["run"], "h", "r", 100, 124).first().amount is None
    assert N.integrate(steps(spark, (30,)), ["run"], "h", "r", 27, 51).first().amount is None
    assert N.axis_check(steps(spark), ["run"], "h").first().native
    for gone in (30, 120, 126):
        assert not N.axis_check(steps(spark, (gone,)), ["run"], "h").first().native


def test_window_features_and_times(spark):
    rows = N.window_features(steps(spark), ["run"], "h", "r", "p", "q").collect()
    assert {r.lead_day for r in rows} == {1, 2, 3, 4, 5} and all(r.complete and r.rain_mm == pytest.approx(48) for r in rows)
    assert rows[0].rain_hours_fraction == 1.0 and rows[0].rh_mean == pytest.approx(80)
    init = spark.createDataFrame([(dt.datetime(2024, 5, 31),)], "init timestamp")
    w = {r.lead: r for r in N.window_times(init, "init").collect()}
    assert w[1].window_start == dt.datetime(2024, 6, 1, 3) and w[1].window_end == dt.datetime(2024, 6, 2, 3)
    assert w[5].window_end == dt.datetime(2024, 6, 6, 3) and all(r.valid for r in w.values())


FC = ("source string, location_id string, support_id string, source_sha256 string, issued_at timestamp, available_at timestamp, "
      "valid_start timestamp, valid_end timestamp, rainfall_mm double, features array<struct<name:string,value:double,available_at:timestamp>>")
OB = "location_id string, support_id string, target_kind string, source_sha256 string, valid_start timestamp, valid_end timestamp, rainfall_mm double"


def test_interval_pairing(spark):
    t = lambda d, h=0: dt.datetime(2024, 6, d, h)
    fc = ("m", "L", "S", "0" * 64, t(1), t(1, 6), t(2), t(3), 5.0, [("x", 1.0, t(1, 5))])
    ob = ("L", "S", "independent_gauge", "1" * 64, t(2), t(3), 4.0)

    def go(f, o, strict=True):
        return P.align(spark.createDataFrame(f, FC), spark.createDataFrame(o, OB), "features", strict)

    assert go([fc], [ob]).pairs.first().lead_hours == 24
    assert go([fc], [("L", "other", *ob[2:])]).unmatched.count() == 1
    late = (*fc[:9], [("x", 1.0, t(1, 7))])
    for f, o in (([late], [ob]), ([fc, fc], [ob]), ([fc], [ob, ob]), ([fc], [("L", "S", "proxy", *ob[3:])])):
        with pytest.raises(ValueError):
            go(f, o)


def solve(b, a, w, d, wd):
    """Best active set by enumeration."""
    a = np.array(a) / np.sum(a)
    best = None
    for on in itertools.product([0, 1], repeat=len(b)):
        m = np.array(on, bool)
        lam = wd * (d - (a * b)[m].sum()) / (1 + wd * (a * a / w)[m].sum())
        x = np.where(m, np.maximum(0, b + lam * a / w), 0)
        cost = (w * (x - b) ** 2).sum() + wd * ((a * x).sum() - d) ** 2
        best = min(best, (cost, tuple(x))) if best else (cost, tuple(x))
    return best[1]


def test_reconciliation(spark):
    rng = np.random.default_rng(5)
    groups = [("f", np.array([10.0, 30.0]), [1.0, 3.0], np.ones(2), 50.0, 1.0), ("same", np.array([10.0, 30.0]), [1.0, 3.0], np.ones(2), 25.0, 1.0),
              ("zero", np.zeros(2), [1.0, 1.0], np.ones(2), 0.0, 1.0)]
    for i in range(12):
        n = rng.integers(1, 6)
        groups.append((f"r{i}", rng.gamma(1, 10, n) * rng.integers(0, 2, n), list(rng.random(n) + 0.1), rng.random(n) + 0.05, float(rng.gamma(1, 6) * rng.integers(0, 2)), float(rng.random() * 5 + 0.1)))
    kids = spark.createDataFrame([(g, i, float(x), float(y), float(z)) for g, b, a, w, _, _ in groups for i, (x, y, z) in enumerate(zip(b, a, w))],
                                 "g string, i int, b double, a double, w double")
    tops = spark.createDataFrame([(g, d, wd) for g, _, _, _, d, wd in groups], "g string, d double, wd double")
    got = {(r.g, r.i): r for r in E.reconcile(kids, tops, ["g"], "b", "a", "w", "d", "wd").collect()}
    for g, b, a, w, d, wd in groups:
        np.testing.assert_allclose([got[(g, i)].reconciled for i in range(len(b))], solve(b, a, w, d, wd), atol=1e-7)
    assert got[("f", 0)].reconciled == pytest.approx(13.84615385) and 25 < got[("f", 0)].parent_value < 50
    assert Q.validate(kids.withColumn("w", F.lit(0.0)), E.reconcile_rules("b", "a", "w")).accepted.count() == 0


def test_ensemble_and_bootstrap(spark):
    df = spark.createDataFrame([(1, 20.0, 1.0, 0.5, 2.0)], "id int, p double, d double, r double, t double")
    f, z = E.member_factors(), list(np.linspace(-2, 2, 30))
    x = np.maximum(0, 20 * np.array(f) + 1.5 + 0.08 * 2 * np.array(z))
    r = E.ensemble_summary(E.ensemble(df, "p", "d", "r", "t", f, z)).first()
    np.testing.assert_allclose([r.ensemble_mean, r.uncertainty_std, r.ci_lower_80, r.ci_upper_95],
                               [x.mean(), x.std(), np.percentile(x, 10), np.percentile(x, 97.5)], atol=0.0051)
    units = spark.createDataFrame([(i, 1, 1, 2) for i in range(7)], "u int, hits int, misses int, false_alarms int")
    reps = E.bootstrap_counts(units, "u", ["hits", "misses", "false_alarms"], reps=20).collect()
    assert len(reps) == 20 and all((r.hits, r.false_alarms) == (7, 14) for r in reps)
    i = {r.score: r for r in E.bootstrap_intervals(units, "u", reps=20).collect()}
    assert i["recall"].low == i["recall"].high == 0.5


def test_rules(spark):
    cases = [("Niphad", 9, "Forward_Pruning"), ("Niphad", 11, "Shooting_Bud_Burst"), ("Bhor", 7, "Grand_Growth"), ("Bhor", 11, "Ripening_Maturation"),
             ("Malegaon", 9, "Vegetative_Bulb_Formation"), ("Igatpuri", 8, "Vegetative_Tillering"), ("Niphad", 7, "Harvesting")]
    df = spark.createDataFrame(cases, "b string, m int, want string")
    assert df.where(R.growth_stage(R.dominant_crop("b"), "m") != F.col("want")).count() == 0
    one = spark.createDataFrame([("Bhor", 28.5, 18.0, 82.0, "2026-09-09")],
                                "block_name string, downscaled_rain_pred double, block_rain_mean double, downscaled_rh_pred double, d string")
    r = R.bulletins(one, "d").first()
    assert (r.dominant_crop, r.crop_stage, r.alert_level, r.valid_until) == ("Sugarcane", "Grand_Growth", "ADVISORY", dt.date(2026, 9, 14))
    assert "waterlogging" in r.pest_disease_warning_en and "10.5 mm HIGHER" in r.weather_summary_en


def test_dates_and_freshness(spark):
    df = spark.createDataFrame([("a", dt.date(2026, 9, d)) for d in (11, 12, 13)], "run string, d date")
    day = lambda x: F.lit(x).cast("date")
    pick = lambda today, req=None: Q.select_date(df, ["run"], "d", day(today), None if req is None else day(req)).first().selected
    assert pick("2026-09-12") == dt.date(2026, 9, 12) and pick("2026-10-01") == dt.date(2026, 9, 11)
    assert pick("2026-09-12", "2026-09-13") == dt.date(2026, 9, 13) and pick("2026-09-12", "2026-01-01") is None
    assert [Q.freshness(df, ["run"], "d", day(t)).first().freshness for t in ("2026-09-01", "2026-09-12", "2026-10-01")] == ["upcoming", "current", "archived"]


def test_immutable_run_and_splits(spark, tmp_path):
    df = spark.range(5).toDF("x")
    assert runs.write_run(df, str(tmp_path), "r") == "written" and runs.write_run(df, str(tmp_path), "r") == "unchanged"
    with pytest.raises(ValueError):
        runs.write_run(spark.range(6).toDF("x"), str(tmp_path), "r")
    with pytest.raises(ValueError):
        S.splits(df, F.col("x"), {"a": [1], "b": [1]})
    with pytest.raises(ValueError):
        S.target_guard(df.withColumn("y", F.lit(1.0)), "y", strict=True)


def test_digest_ignores_order_and_sees_copies(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    d = lambda df: Q.digest(df, [], F.col("x").cast("string")).first().digest
    assert d(a) == d(a.orderBy(F.col("x").desc()).repartition(3)) != d(a.distinct())


def test_ridge_matches_normal_equations(spark):
    from rainweave.operators import models as M
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, (40, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 40)
    df = spark.createDataFrame([(i % 4, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "g int, a double, b double, c double, y double")

    def fit(xx, yy):
        z = (xx - xx.mean(0)) / xx.std(0)
        beta = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (yy - yy.mean())) / xx.std(0)
        return yy.mean() - beta @ xx.mean(0), beta

    b0, b = fit(x, y)
    np.testing.assert_allclose(M.ridge(df, ["a", "b", "c"], F.col("y")).first().coef, [b0, *b], rtol=1e-8)
    out = M.logo_ridge(df, "g", ["a", "b", "c"], F.col("y")).collect()
    for r in out:
        keep = np.arange(40) % 4 != r.g
        b0, b = fit(x[keep], y[keep])
        assert r.prediction == pytest.approx(b0 + b @ [r.a, r.b, r.c])


def test_scoring_keeps_incomplete_rows(spark):
    from rainweave.operators import models as M
    train = spark.createDataFrame([(float(i), float(i % 7), float(2 * i), i % 2) for i in range(40)], "a double, b double, y double, e int")
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("nan"), 1.0)], "a double, b double")
    amounts = M.score_amount(M.fit_amount(train, ["a", "b"], "y", trees=3), rows, ["a", "b"])
    raws = M.raw_score(M.fit_logistic(train, ["a", "b"], "e"), rows, ["a", "b"])
    assert [r.prediction is None for r in amounts.collect()] == [False, True, True]
    assert [r.raw is None for r in raws.collect()] == [False, True, True]


def test_intervals_meet_in_as_many_tasks_as_asked_and_without_what_only_rules_read(spark):
    fc = spark.range(40).selectExpr("'s' AS source", "id AS location_id", "'g' AS support_id", "repeat('a', 64) || id AS source_sha256",
                                    "timestamp'2024-01-01' AS issued_at", "timestamp'2024-01-01' AS available_at", "timestamp'2024-01-02' AS valid_start",
                                    "timestamp'2024-01-03' AS valid_end", "1e0 AS rainfall_mm").withColumn("source_sha256", F.substring("source_sha256", 1, 64))
    ob = fc.withColumn("target_kind", F.lit("independent_gauge")).drop("issued_at", "available_at", "source")
    pairs = P.align(fc, ob, parts=7).pairs.select("location_id", "observed_mm", "lead_hours")
    text = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") >= 3 and pairs.count() == 40
    joins = [line for line in text.splitlines() if "Join LeftOuter" in line]
    below = [text.splitlines()[i + 1] for i, line in enumerate(text.splitlines()) if "Join LeftOuter" in line]
    assert len(joins) == 2 and not any("source_sha256#" in line.split("AS __bad")[0] for line in below)
