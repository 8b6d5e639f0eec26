"""Boosted trees with a Tweedie loss: each round fits one tree to the loss's second-order target and sets its leaves by sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from rainweave.operators.models import assemble, complete
from rainweave.session import cut_lineage

POWER = 1.5


def tweedie_deviance(y, mu, power: float = POWER) -> Column:
    """Unit deviance of an amount of 0 or more and a prediction over 0."""
    y, mu = (F.col(c) if isinstance(c, str) else c for c in (y, mu))
    a, b = 1.0 - power, 2.0 - power
    return 2 * (F.pow(y, F.lit(b)) / (a * b) - y * F.pow(mu, F.lit(a)) / a + F.pow(mu, F.lit(b)) / b)


@dataclass
class BoostedTweedie:
    """A log-linear sum of trees: exp(start + rate * the leaves' values)."""
    start: float
    rate: float
    trees: list[tuple[DecisionTreeRegressionModel, dict[int, float]]]
    deviances: list[float]  # mean on the training rows, before the first round and after each

    def raw(self, data: DataFrame, out: str, trees: int | None = None) -> DataFrame:
        """data (with features) and the log of the amount after the first `trees` rounds, all by default."""
        data = data.withColumn(out, F.lit(self.start))
        for tree, values in self.trees[:trees]:
            data = _step(data, tree, values, self.rate, out)
        return data

    def transform(self, data: DataFrame) -> DataFrame:
        return self.raw(data, "prediction").withColumn("prediction", F.exp("prediction"))


def _step(data: DataFrame, tree: DecisionTreeRegressionModel, values: dict[int, float], rate: float, out: str) -> DataFrame:
    table = F.create_map(*[F.lit(float(v)) for pair in sorted(values.items()) for v in pair])
    placed = tree.copy({tree.leafCol: "__leaf", tree.predictionCol: "__p"}).transform(data)
    return placed.withColumn(out, F.col(out) + rate * F.coalesce(F.element_at(table, F.col("__leaf")), F.lit(0.0))).drop("__leaf", "__p")


def fit_tweedie(train: DataFrame, x: list[str], y: str, trees: int = 20, depth: int = 4, rate: float = 0.1, penalty: float = 10.0,
                least: int = 200, power: float = POWER, seed: int = 42) -> BoostedTweedie:
    """Boosting for amounts of 0 or more with mean exp(f) and variance in proportion to mean ** power.

    With gradient g and curvature h of the loss at f, a round's tree is grown on -g / h with weight h, so its splits gain
    most in second order; a leaf's value is -sum(g) / (sum(h) + penalty), one aggregate row a leaf. Leaves hold at least
    `least` rows. Rows without an amount or a feature take no part. Each round is written, so its cost does not grow.
    """
    rows = assemble(train.where(F.col(y) >= 0), x).select("features", F.col(y).cast("double").alias("y"))
    mean = rows.agg(F.avg("y")).first()[0]
    if not mean:
        raise ValueError("no amount over 0 to learn from")
    import math
    start = math.log(mean)
    state = cut_lineage(rows.withColumn("f", F.lit(start)))
    first = F.col("y") * F.exp((1.0 - power) * F.col("f"))
    second = F.exp((2.0 - power) * F.col("f"))
    g, h = second - first, (2.0 - power) * second - (1.0 - power) * first
    deviance = F.avg(tweedie_deviance("y", F.exp("f"), power))
    fitted, deviances = [], [state.agg(deviance).first()[0]]
    for k in range(trees):
        data = state.withColumns({"g": g, "h": h}).withColumn("target", -F.col("g") / F.col("h"))
        learner = DecisionTreeRegressor(featuresCol="features", labelCol="target", weightCol="h", maxDepth=depth, minInstancesPerNode=least, seed=seed + k,
                                        predictionCol="__p", leafCol="__leaf", maxMemoryInMB=512)
        tree = learner.fit(data)
        leaves = tree.transform(data).groupBy("__leaf").agg((-F.sum("g") / (F.sum("h") + penalty)).alias("value")).collect()  # at most 2 ** depth
        values = {int(r["__leaf"]): r["value"] for r in leaves}
        fitted.append((tree, values))
        state = cut_lineage(_step(state, tree, values, rate, "f"))
        deviances.append(state.agg(deviance).first()[0])
    return BoostedTweedie(start, rate, fitted, deviances)


def score_tweedie(model: BoostedTweedie, df: DataFrame, x: list[str], out: str = "prediction") -> DataFrame:
    """Every row with its amount, NULL where a feature is missing."""
    rows = model.transform(assemble(df, x, invalid="keep"))
    return rows.withColumn("prediction", F.when(complete(x), F.col("prediction"))).withColumnRenamed("prediction", out).drop("features")
