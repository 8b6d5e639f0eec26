"""Boosted Tweedie amounts: one round against its definition, the deviance, and incomplete rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from rainweave.operators import boosting as B


def amounts(spark, n=2000):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    y = np.where(a > 0.6, rng.gamma(2, 5 * (1 + 3 * (b > 0.5))), np.where(rng.uniform(size=n) < 0.7, 0, rng.gamma(1, 1, n)))
    return spark.createDataFrame([(float(p), float(q), float(r)) for p, q, r in zip(a, b, y)], "a double, b double, y double"), y


def test_one_round_by_its_definition(spark):
    df, y = amounts(spark)
    model = B.fit_tweedie(df, ["a", "b"], "y", trees=1, depth=1, rate=0.5, penalty=3.0, least=50)
    assert model.start == pytest.approx(math.log(y.mean()))
    tree, values = model.trees[0]
    rows = tree.transform(B.assemble(df, ["a", "b"])).select("y", "__leaf").toPandas()
    f = math.log(y.mean())
    for leaf, own in rows.groupby("__leaf"):
        g = (math.exp(0.5 * f) - own.y * math.exp(-0.5 * f)).sum()
        h = (0.5 * math.exp(0.5 * f) + 0.5 * own.y * math.exp(-0.5 * f)).sum()
        assert values[int(leaf)] == pytest.approx(-g / (h + 3.0))
    got = B.score_tweedie(model, df, ["a", "b"]).toPandas()
    assert sorted(got.prediction.unique()) == pytest.approx(sorted(math.exp(f + 0.5 * v) for v in values.values()))


def test_deviance_falls_and_is_the_unit_deviance(spark):
    df, y = amounts(spark)
    model = B.fit_tweedie(df, ["a", "b"], "y", trees=8, rate=0.3, least=20)
    assert all(b < a for a, b in zip(model.deviances, model.deviances[1:])) and len(model.deviances) == 9
    p = B.score_tweedie(model, df, ["a", "b"]).toPandas()
    unit = 2 * (p.y ** 0.5 / -0.25 + 2 * p.y * p.prediction ** -0.5 + 2 * p.prediction ** 0.5)
    assert unit.mean() == pytest.approx(model.deviances[-1]) and (unit > -1e-9).all()
    assert 0.9 < p.prediction.mean() / y.mean() < 1.1
    fewer = model.raw(B.assemble(df, ["a", "b"]), "f", 3).agg(F.avg(B.tweedie_deviance("y", F.exp("f")))).first()[0]
    assert fewer == pytest.approx(model.deviances[3])


def test_incomplete_rows(spark):
    df, _ = amounts(spark, 500)
    odd = spark.createDataFrame([(None, 0.5, 3.0), (float("nan"), 0.5, 3.0), (0.5, 0.5, None), (0.5, 0.5, -1.0)], df.schema)
    both = df.union(odd)
    model = B.fit_tweedie(both, ["a", "b"], "y", trees=2, least=20)
    same = B.fit_tweedie(df, ["a", "b"], "y", trees=2, least=20)
    assert model.start == pytest.approx(same.start)
    rows = B.score_tweedie(model, odd, ["a", "b"], "amount").collect()
    assert [r.amount is None for r in rows] == [True, True, False, False]
    with pytest.raises(ValueError):
        B.fit_tweedie(df.where("y = 0"), ["a", "b"], "y")
    with pytest.raises(ValueError):
        B.fit_tweedie(df.where("y < -5"), ["a", "b"], "y")


def test_folds_side_by_side_equal_folds_one_by_one(spark):
    from rainweave.operators import models as M
    from rainweave.plans.downscale import logo_boosted
    df, _ = amounts(spark, 600)
    df = df.withColumn("fold", F.when(F.col("a") > 0.9, None).otherwise(F.floor(F.col("b") * 3).cast("int")))
    got = {r.fold: r.prediction for r in logo_boosted(df, "fold", ["a", "b"], "y", [0, 1, 2, 7, None], trees=3).collect()}
    assert set(got) == {0, 1, 2}
    for k in got:
        model = M.fit_amount(df.where(f"fold is null or fold <> {k}"), ["a", "b"], "y", "squared", 3)
        want = model.transform(M.assemble(df.where(f"fold = {k}"), ["a", "b"])).agg(F.avg("prediction")).first()[0]
        assert got[k] == pytest.approx(want)
