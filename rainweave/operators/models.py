"""Models as Spark jobs: exact ridge from sums, Spark ML learners, calibration and kriging."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from rainweave.functions.numeric import clamp
from rainweave.operators.distributed import attach
from rainweave.operators.kriging import kriging_weights
from rainweave.operators.spatial import blocks, idw, meet_blocks
from rainweave.session import cut_lineage

# Order of the twelve and nineteen features of a feature vector.
LAG_FEATURES = ["rain_last", "rain_previous", "rain_two_before", "rain_six_before", "rain_thirteen_before", "mean3", "mean7",
                "mean14", "latitude", "longitude", "season_sin", "season_cos"]
CONTEXT_FEATURES = LAG_FEATURES + ["neighbor_last", "neighbor_mean3", "neighbor_mean7", "neighbor_event_fraction", "trend1",
                                   "trend3_7", "max3"]


# --- exact ridge from sufficient statistics -------------------------------------------------

def moments(df: DataFrame, groups: list[str], x: list[str], y: Column) -> DataFrame:
    """Counts, sums and cross products per group: all a linear model needs, combined map-side.

    `stats` lists n, the sums of x and y, then the upper triangle of products of (x..., y).
    """
    cols = [F.col(c).cast("double") for c in x] + [y.cast("double")]
    aggs = [F.count(F.lit(1)).cast("double")] + [F.sum(c) for c in cols]
    aggs += [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*groups).agg(F.array(*aggs).alias("stats"))


def _solver(d: int, alpha: float):
    @pandas_udf("array<double>")
    def solve(stats):
        import numpy as np
        import pandas as pd
        out = []
        for s in stats:
            n, sums, prod = s[0], np.asarray(s[1:d + 2]), np.zeros((d + 1, d + 1))
            prod[np.triu_indices(d + 1)] = s[d + 2:]
            prod = prod + np.triu(prod, 1).T
            mean = sums / n
            cov = prod / n - np.outer(mean, mean)
            std = np.sqrt(np.maximum(np.diag(cov)[:d], 0))
            std[std < 1e-12] = 1.0
            z = n * cov[:d, :d] / np.outer(std, std) + alpha * np.eye(d)
            beta = np.linalg.solve(z, n * cov[:d, d] / std) / std
            out.append([float(mean[d] - beta @ mean[:d]), *map(float, beta)])
        return pd.Series(out)
    return solve


def ridge(df: DataFrame, x: list[str], y: Column, alpha: float = 10.0, groups: list[str] = ()) -> DataFrame:
    """`coef` = [intercept, slopes] of a ridge on features standardised by population deviation."""
    return moments(df, list(groups), x, y).withColumn("coef", _solver(len(x), alpha)("stats")).drop("stats")


def linear(x: list[str], coef: str = "coef") -> Column:
    return reduce(lambda a, b: a + b, [F.col(coef)[i + 1] * F.col(c) for i, c in enumerate(x)], F.col(coef)[0])


def logo_ridge(df: DataFrame, group: str, x: list[str], y: Column, alpha: float = 10.0) -> DataFrame:
    """Every row predicted by the ridge fitted on all other groups: totals less the group's own sums."""
    own = moments(df, [group], x, y)
    size = 1 + (len(x) + 1) + (len(x) + 1) * (len(x) + 2) // 2
    total = own.agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(size)]).alias("__total"))
    rest = attach(own, total, []).where(F.col("__total")[0] > F.col("stats")[0])
    rest = rest.withColumn("stats", F.zip_with("__total", "stats", lambda t, s: t - s))
    coefs = rest.withColumn("coef", _solver(len(x), alpha)("stats")).select(group, "coef")
    return attach(df, coefs, [group]).withColumn("prediction", linear(x)).drop("coef")


# --- Spark ML learners ----------------------------------------------------------------------

def assemble(df: DataFrame, x: list[str], out: str = "features", invalid: str = "skip") -> DataFrame:
    """Feature vector in the given order; incomplete rows are left out, or kept with invalid="keep"."""
    return VectorAssembler(inputCols=list(x), outputCol=out, handleInvalid=invalid).transform(df)


def complete(x: list[str]) -> Column:
    """Whether no feature of a row is missing."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in x])


BINS = 32  # Spark ML's number of bins of a feature
EDGE_ROWS = 10_000  # and of rows its thresholds are drawn from
MOST_CELLS = 65_536
LEAST_ROWS = 1_000_000  # fewer rows are fitted as they are


def bin_edges(rows: DataFrame, n: int, x: list[str], seed: int = 42) -> list[list[float]]:
    """Thresholds between the bins of every feature, by Spark ML's rule: midpoints of neighbouring values, at equal strides
    where there are more than BINS values, from all `n` rows or, of a large table, from about EDGE_ROWS of them.
    """
    import numpy as np
    if n > EDGE_ROWS:
        rows = rows.sample(EDGE_ROWS / n, seed)
    drawn = np.array(rows.select(*[F.col(c).cast("double") for c in x]).collect(), "f8").reshape(-1, len(x))  # about EDGE_ROWS at most
    return [_edges(column, min(BINS, n) - 1) for column in drawn.T]


def _edges(drawn, most: int) -> list[float]:
    import numpy as np
    values, counts = np.unique(drawn, return_counts=True)
    between = ((values[:-1] + values[1:]) / 2).tolist()
    if len(between) <= most:
        return between
    stride, out = len(drawn) / (most + 1), []
    target, upto = stride, np.cumsum(counts)
    for edge, before, after in zip(between, upto, upto[1:]):
        if abs(before - target) < abs(after - target):
            out.append(edge)
            target += stride
    return out


def in_bin(c: str, edges: list[float]) -> Column:
    """Number of the value's bin, found by halving; a value at a threshold belongs below it."""
    value = F.col(c).cast("double")

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > edges[middle], within(middle + 1, high)).otherwise(within(low, middle))

    return F.when(value.isNotNull(), within(0, len(edges)))


@dataclass
class Binned:
    """A tree model of bin numbers that takes the features themselves."""
    model: Model
    x: list[str]
    edges: list[list[float]]

    def transform(self, data: DataFrame) -> DataFrame:
        return self.model.transform(_bin_vector(data, self.x, self.edges)).drop("__bins")

    @property
    def featureImportances(self):
        return self.model.featureImportances


def _bin_vector(data: DataFrame, x: list[str], edges: list[list[float]]) -> DataFrame:
    names = [f"__b{i}" for i in range(len(x))]
    data = data.withColumns({b: in_bin(c, e) for b, c, e in zip(names, x, edges)})
    return assemble(data, names, "__bins", invalid="keep").drop(*names)


def _fit_cells(train: DataFrame, x: list[str], y: str, learner, by_label: bool, seed: int) -> Model | Binned:
    """The learner's fit on one weighted row per cell of bins instead of every row.

    Trees split between bins only, and rows of a cell share their prediction, so count and mean label (`by_label`: count of
    each label) are all that a squared or logistic loss needs. One pass reads the rows, and rounds read the cells. Where there
    are under LEAST_ROWS rows, or too many cells to gain from that, the learner reads the rows. Thresholds come from a random
    sample as large as Spark ML's, but not the same one.
    """
    rows = train.where(complete(x))
    n = rows.count()
    if n < LEAST_ROWS:
        return learner.fit(assemble(train, x))
    edges = bin_edges(rows, n, x, seed)
    if math.prod(len(e) + 1 for e in edges) * (2 if by_label else 1) > MOST_CELLS:
        return learner.fit(assemble(train, x))
    label, bins = F.col(y).cast("double"), [in_bin(c, e).alias(f"__b{i}") for i, (c, e) in enumerate(zip(x, edges))]
    rows = rows.select(*bins, label.alias(y))
    names = [f"__b{i}" for i in range(len(x))]
    if by_label:
        cells = rows.groupBy(*names, y).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    else:
        # a missing label is the learner's error, so it stays one
        cells = rows.groupBy(*names).agg(F.when(F.count(y) == F.count(F.lit(1)), F.avg(y)).alias(y), F.count(F.lit(1)).cast("double").alias("__n"))
    cells = assemble(cut_lineage(cells), names, "__bins")
    learner = learner.copy({learner.featuresCol: "__bins", learner.weightCol: "__n", learner.maxBins: math.isqrt(MOST_CELLS)})
    return Binned(learner.fit(cells), x, edges)


def fit_amount(train: DataFrame, x: list[str], y: str, kind: str = "squared", trees: int = 60, depth: int = 4,
               seed: int = 42) -> Model | Binned:
    """Rain amount model: boosted squared or absolute loss, Tweedie, or a random forest."""
    data = assemble(train, x)
    if kind in ("squared", "absolute"):
        est = GBTRegressor(lossType=kind, labelCol=y, maxIter=trees, maxDepth=depth, stepSize=0.05, seed=seed)
        if kind == "squared":
            return _fit_cells(train, x, y, est, False, seed)
    elif kind == "tweedie":
        est = GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol=y, regParam=1e-3)
    elif kind == "forest":
        est = RandomForestRegressor(labelCol=y, numTrees=200, maxDepth=4, minInstancesPerNode=3, seed=seed)
    else:
        raise ValueError(f"Unknown amount model: {kind}")
    return est.fit(data)


def score_amount(model: Model | Binned, df: DataFrame, x: list[str], out: str = "prediction") -> DataFrame:
    """Every row with its amount, NULL where a feature is missing."""
    rows = model.transform(assemble(df, x, invalid="keep")).drop("features")
    rows = rows.withColumn("prediction", F.when(complete(x), F.col("prediction")))
    return rows.withColumn(out, F.when(F.col("prediction").isNotNull(), F.greatest(F.lit(0.0), F.col("prediction"))))


def fit_event(train: DataFrame, x: list[str], event: str, trees: int = 60, depth: int = 4, seed: int = 42) -> Model | Binned:
    est = GBTClassifier(labelCol=event, maxIter=trees, maxDepth=depth, stepSize=0.05, seed=seed)
    return _fit_cells(train, x, event, est, True, seed)


def fit_logistic(train: DataFrame, x: list[str], event: str) -> Model:
    """Logistic regression with a unit L2 penalty on the summed loss, features left unscaled."""
    data = assemble(train, x)
    n = data.count()
    return LogisticRegression(labelCol=event, regParam=1.0 / max(n, 1), standardization=False, maxIter=100).fit(data)


def raw_score(model: Model | Binned, df: DataFrame, x: list[str], out: str = "raw") -> DataFrame:
    """The margin of the positive class, before any calibration; NULL where a feature is missing."""
    rows = model.transform(assemble(df, x, invalid="keep"))
    return rows.withColumn(out, F.when(complete(x), vector_to_array("rawPrediction")[1])).drop("features", "rawPrediction", "probability", "prediction")


def calibrate(scored: DataFrame, raw: str, event: str) -> tuple[float, float]:
    """Slope and intercept of the logistic calibration, fitted on a split of its own."""
    model = fit_logistic(scored, [raw], event)
    return float(model.coefficients[0]), float(model.intercept)


def importances(model: Model | Binned, x: list[str], df: DataFrame) -> DataFrame:
    """Normalised gain of every feature; `df` only lends its session."""
    gains = [float(g) for g in model.featureImportances.toArray()]
    total = max(1e-5, sum(gains))
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(round(g / total, 4)).alias("importance")) for n, g in zip(x, gains)])
    return df.sparkSession.range(1).select(F.inline(rows))


# --- residual interpolation -----------------------------------------------------------------

def density_rule(stations: DataFrame, groups: list[str]) -> DataFrame:
    """Method per group: universal kriging from 10 stations, ordinary from 5, else inverse distance."""
    n = stations.groupBy(*groups).agg(F.count(F.lit(1)).alias("stations"))
    return n.withColumn("method", F.when(F.col("stations") >= 10, "universal").when(F.col("stations") >= 5, "ordinary").otherwise("idw"))


def _kriging_sums():
    """Per target of a block the sum of weights times variogram over a block of spots."""
    @pandas_udf("array<double>")
    def sums(x, y, lon, lat, w, vario):
        import numpy as np
        import pandas as pd
        out = []
        for x, y, lon, lat, w, (slope, reach, nugget) in zip(x, y, lon, lat, w, vario):
            with np.errstate(all="ignore"):
                h = np.sqrt(np.subtract.outer(x, lon) ** 2 + np.subtract.outer(y, lat) ** 2)
                t = np.fmin(h / reach, 1.0) if reach != 0 else None
                g = nugget + slope * (h if t is None else 1.5 * t - 0.5 * t * t * t)
                g[h == 0] = 0.0
                out.append(g @ w)
        return pd.Series(out)
    return sums


def kriging_field(targets: DataFrame, weights: DataFrame, group: str, target_id: str, lon: str, lat: str,
                  limit: float = 15.0) -> DataFrame:
    """Kriged residual per target: a sum over the group's stations, block by block, clipped."""
    params = weights.groupBy(group).agg(F.first("drift").alias("__d"), F.first("vario").alias("__g"))
    packed = attach(blocks(weights.select(group, "lon", "lat", "w"), [group], ["lon", "lat", "w"]), params, [group])
    places = targets.select(group, F.col(target_id).alias("__id"), F.col(lon).cast("double").alias("__x"), F.col(lat).cast("double").alias("__y"))
    rows = meet_blocks(places, packed, [group], ["__id", "__x", "__y"])
    here, spot = F.col("__targets"), F.col("__items")
    rows = rows.select(group, "__targets", "__d", _kriging_sums()(here["__x"], here["__y"], spot["lon"], spot["lat"], spot["w"], F.col("__g")).alias("__s"))
    rows = rows.select(group, "__d", F.explode(F.arrays_zip("__targets", "__s")).alias("__o"))
    target, d = F.col("__o.__targets"), F.col("__d")
    rows = rows.select(group, target["__id"].alias(target_id), F.coalesce("__o.__s", F.lit(float("nan"))).alias("__s"),
                       (d[0] + d[1] * target["__x"] + d[2] * target["__y"]).alias("__m"))
    out = rows.groupBy(group, target_id).agg((F.sum("__s") + F.first("__m")).alias("residual"))
    return out.withColumn("residual", clamp(F.coalesce(F.nanvl("residual", F.lit(0.0)), F.lit(0.0)), -limit, limit))


def residual_field(targets: DataFrame, stations: DataFrame, group: str, target_id: str, lon: str, lat: str, value: str,
                   station_lon: str, station_lat: str, method: str | None = None) -> DataFrame:
    """Residual correction of every target by the density rule; groups without stations get 0."""
    rule = density_rule(stations, [group])
    if method:
        rule = rule.withColumn("method", F.lit(method))
    st = attach(stations, rule, [group])
    found = idw(targets, st.where("method = 'idw'"), [group], target_id, [lon, lat], value, [station_lon, station_lat]).select(target_id, "residual")
    if method != "idw":
        weights = kriging_weights(st.where("method <> 'idw'"), group, station_lon, station_lat, value)
        found = found.unionByName(kriging_field(targets, weights, group, target_id, lon, lat).select(target_id, "residual"))
    return targets.select(target_id).join(found, target_id, "left").fillna(0.0, ["residual"])


def station_residuals(observed: DataFrame, predicted: DataFrame, fallback: Column | None = None, station: str = "station_id",
                      deviation: str = "deviation", prediction: str = "prediction") -> DataFrame:
    """Mean observed deviation less its out-of-sample prediction (fallback, then 0, where absent)."""
    mean = observed.groupBy(station).agg(F.avg(deviation).alias("observed"))
    rows = mean.join(predicted.select(station, prediction), station, "left")
    pred = F.coalesce(F.col(prediction), *([fallback] if fallback is not None else []), F.lit(0.0))
    return rows.withColumn("residual", F.col("observed") - pred)
