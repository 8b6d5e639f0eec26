import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from rainweave.operators import models as M


def rows(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 9, n) / 10, rng.integers(0, 4, n)
    y = np.where(a > 0.3, 5 * b, c) + rng.normal(0, 0.3, n)
    data = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y))] + [(n, None, 0.1, 1.0, 2.0), (n + 1, float("nan"), 0.1, 1.0, 2.0)]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double").withColumn("event", (F.col("y") > 1.5).cast("double"))


def test_trees_fitted_on_cells_are_those_fitted_on_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAST_ROWS", 0)
    df, x = rows(spark, 3000), ["a", "b", "c"]
    whole = M.assemble(df, x)
    plain = GBTRegressor(labelCol="y", maxIter=4, maxDepth=4, stepSize=0.05, seed=42).fit(whole)
    fitted = M.fit_amount(df, x, "y", "squared", 4)
    want = {r.id: r.prediction for r in plain.transform(whole).collect()}
    got = {r.id: r.prediction for r in fitted.transform(whole).collect()}
    assert got.keys() == want.keys() and len(got) == 3000
    np.testing.assert_allclose([got[i] for i in want], list(want.values()), atol=1e-9)
    np.testing.assert_allclose(fitted.featureImportances.toArray(), plain.featureImportances.toArray(), atol=1e-9)

    plain = GBTClassifier(labelCol="event", maxIter=4, maxDepth=4, stepSize=0.05, seed=42).fit(whole)
    fitted = M.fit_event(df, x, "event", 4)
    want = {r.id: r.rawPrediction[1] for r in plain.transform(whole).collect()}
    got = {r.id: r.raw for r in M.raw_score(fitted, df, x).collect()}
    assert len(got) == 3002 and got[3000] is None and got[3001] is None
    np.testing.assert_allclose([got[i] for i in want], list(want.values()), atol=1e-9)


def test_learner_sees_cells_instead_of_rows(spark, monkeypatch):
    seen = []
    keep = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: seen.append(keep(df)) or seen[-1])
    monkeypatch.setattr(M, "LEAST_ROWS", 20_000)
    df = spark.range(20000).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                   (F.col("id") % 50 + F.col("id") % 7).cast("double").alias("y"))
    M.fit_amount(df.where("id > 0"), ["a", "b"], "y", "squared", 1)  # few rows are fitted as they are
    assert not seen
    M.fit_amount(df, ["a", "b"], "y", "squared", 2)
    cells = seen[0].agg(F.count(F.lit(1)).alias("n"), F.sum("__n").alias("rows"), F.sum(F.col("__n") * F.col("y")).alias("y")).first()
    assert cells.n <= 32 * 7 and cells.rows == 20000 and abs(cells.y - df.agg(F.sum("y")).first()[0]) < 1e-3


def test_bins_follow_thresholds(spark):
    assert M._edges(np.array([3.0, 1.0, 1.0, 2.0]), 31) == [1.5, 2.5]
    assert M._edges(np.arange(8.0), 3) == [1.5, 3.5, 5.5]
    edges = [0.5, 1.5, 2.5, 4.0]
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 0.6, 2.5, 4.0, 9.0, None)], "v double")
    assert [r[0] for r in df.select(M.in_bin("v", edges)).collect()] == [0, 0, 1, 2, 3, 4, None]
    assert [r[0] for r in df.select(M.in_bin("v", [])).collect()] == [0] * 6 + [None]
