"""Kriging: variograms fitted to the stations, and dual weights.

The experimental semivariogram counts pairs of stations in bins of distance, block by block, and combines them before the
shuffle. What is fitted are its few bins per group. Weights of small groups come from a direct solve, those of groups of
any size from conjugate gradients over blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from rainweave.operators.distributed import attach
from rainweave.operators.spatial import blocks, meet_blocks
from rainweave.session import cut_lineage

DIRECT_SPOTS = 2000
LINEAR_STATIONS = 10
LAGS = 6
RANGES = 200
FIT_STEPS = 60


def station_spots(stations: DataFrame, group: str, lon: str, lat: str, value: str, key: str) -> DataFrame:
    """key, lon, lat, v, stations: stations that share a spot count as one with their mean value.

    Stations without a position or value take no part.
    """
    rows = stations.select(F.col(group).alias(key), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), F.col(value).cast("double").alias("v"))
    for name in ("lon", "lat", "v"):
        rows = rows.where(F.abs(name) < float("inf"))  # neither NULL, NaN nor infinite
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("stations"))
    return attach(rows.groupBy(key, "lon", "lat").agg(F.avg("v").alias("v")), counts, [key])


def _pairs(spots: DataFrame, key: str) -> DataFrame:
    """The blocks of a group's spots in pairs: __targets and __items."""
    packed = blocks(spots.select(key, "lon", "lat", "v"), [key], ["lon", "lat", "v"])
    return meet_blocks(spots.select(key, "lon", "lat", "v"), packed, [key], ["lon", "lat", "v"])


def _distances(x, y, lon, lat):
    import numpy as np
    return np.sqrt(np.subtract.outer(x, lon) ** 2 + np.subtract.outer(y, lat) ** 2)


def _sides(*names: str) -> list:
    return [F.col(side)[n] for side in ("__targets", "__items") for n in names]


def _ends():
    """Least and largest distance over 0 within a pair of blocks."""
    @pandas_udf("low double, high double")
    def ends(x, y, lon, lat):
        import numpy as np
        import pandas as pd
        out = []
        for row in zip(x, y, lon, lat):
            h = _distances(*row)
            low = np.where(h > 0, h, np.inf).min()
            out.append((low, h.max()) if low < np.inf else (None, None))
        return pd.DataFrame(out, columns=["low", "high"], dtype=float)
    return ends


def _bin_sums(lags: int):
    """Pairs, distances and half squared differences of every bin, over a pair of blocks."""
    @pandas_udf("n array<long>, h array<double>, g array<double>")
    def sums(x, y, v, lon, lat, u, low, high):
        import numpy as np
        import pandas as pd
        out = []
        for x, y, v, lon, lat, u, low, high in zip(x, y, v, lon, lat, u, low, high):
            h = _distances(x, y, lon, lat)
            g = np.subtract.outer(v, u) ** 2 / 2
            some, width = h > 0, (high - low) / lags
            h, g = h[some], g[some]
            at = np.minimum(np.floor((h - low) / width), lags - 1).astype(int) if width > 0 else np.zeros(len(h), int)
            out.append((np.bincount(at, minlength=lags), np.bincount(at, h, lags), np.bincount(at, g, lags)))
        return pd.DataFrame(out, columns=["n", "h", "g"])
    return sums


def semivariogram(spots: DataFrame, key: str, lags: int = LAGS) -> DataFrame:
    """key, bin, pairs, lag, semivariance: mean distance and mean half squared difference in equal bins of distance.

    The bins span the group's smallest to largest distance between two spots. A group of one spot has none. Every pair of a
    group is met once each way: that is its definition; no more than a bin's sums leaves a pair of blocks.
    """
    pairs = _pairs(spots, key)
    ends = pairs.select(key, _ends()(*_sides("lon", "lat")).alias("e"))
    ends = cut_lineage(ends.groupBy(key).agg(F.min("e.low").alias("__low"), F.max("e.high").alias("__high")).where("__high > 0"))
    sums = pairs.join(ends, key).select(key, _bin_sums(lags)(*_sides("lon", "lat", "v"), "__low", "__high").alias("s"))
    rows = sums.select(key, F.posexplode(F.arrays_zip("s.n", "s.h", "s.g")).alias("bin", "b")).where("b.n > 0")
    return rows.groupBy(key, "bin").agg((F.sum("b.n") / 2).cast("long").alias("pairs"), (F.sum("b.h") / F.sum("b.n")).alias("lag"),
                                        (F.sum("b.g") / F.sum("b.n")).alias("semivariance"))


def fit_bins(lag, semivariance, model: str, ranges: int = RANGES, steps: int = FIT_STEPS) -> tuple[float, float, float, float]:
    """(scale, range, nugget, loss) of the model nearest to the bins in soft L1 loss, the sum of 2 (sqrt(1 + e^2) - 1).

    Linear: nugget + scale h, range 0. Spherical: nugget + scale (1.5 t - 0.5 t^3) with t = min(h / range, 1), where range
    is one of `ranges` equal steps up to the largest lag, the smallest of equally good ones. Scale is not negative, nugget
    neither, and at most the largest semivariance. For a given range both come from reweighted least squares.
    """
    import numpy as np
    h, g = np.asarray(lag, float), np.asarray(semivariance, float)
    if model == "linear":
        reach, f = np.zeros(1), h[None, :]
    else:
        reach = h.max() * np.arange(1, ranges + 1) / ranges
        t = np.minimum(h[None, :] / reach[:, None], 1.0)
        f = 1.5 * t - 0.5 * t ** 3
    top, w = g.max(), np.ones_like(f)
    for _ in range(steps):
        sw, sf, sg, sff, sfg = w.sum(1), (w * f).sum(1), (w * g).sum(1), (w * f * f).sum(1), (w * f * g).sum(1)
        det = sw * sff - sf * sf
        flat = det <= 1e-12 * sw * sff
        scale = np.where(flat, 0.0, (sw * sfg - sf * sg) / np.where(flat, 1.0, det))
        nugget = np.where(flat | (scale < 0), sg / sw, (sg - scale * sf) / sw)
        scale = np.where(scale < 0, 0.0, scale)
        capped = np.clip(nugget, 0.0, top)
        scale = np.where(capped != nugget, np.maximum(0.0, (sfg - capped * sf) / np.where(sff > 0, sff, 1.0)), scale)
        error = scale[:, None] * f + capped[:, None] - g
        w = 1 / np.sqrt(1 + error * error)
    loss = (2 * (np.sqrt(1 + error * error) - 1)).sum(1)
    best = int(np.flatnonzero(loss <= loss.min() * (1 + 1e-9) + 1e-12)[0])
    return float(scale[best]), float(reach[best]), float(capped[best]), float(loss[best])


def fitted_variograms(spots: DataFrame, key: str, lags: int = LAGS) -> DataFrame:
    """key, model, scale, range, nugget, loss for every group of two spots or more; linear from LINEAR_STATIONS stations on."""
    models = spots.groupBy(key).agg(F.when(F.first("stations") >= LINEAR_STATIONS, "linear").otherwise("spherical").alias("model"))
    rows = attach(semivariogram(spots, key, lags), models, [key])

    def fit(pdf):
        import pandas as pd
        pdf = pdf.sort_values("bin")
        model = pdf["model"].iloc[0]
        scale, reach, nugget, loss = fit_bins(pdf["lag"], pdf["semivariance"], model)
        return pd.DataFrame({key: pdf[key].iloc[:1], "model": [model], "scale": [scale], "range": [reach], "nugget": [nugget], "loss": [loss]})

    kind = spots.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(fit, f"{key} {kind}, model string, scale double, range double, nugget double, loss double")


def kriging_weights(stations: DataFrame, group: str, lon: str, lat: str, value: str, direct: int = DIRECT_SPOTS,
                    nugget: float | None = None, most_steps: int = 1000) -> DataFrame:
    """Dual weights of each group's kriging system: one row per spot, plus drift and variogram.

    The variogram is fitted to the group's spots, its nugget too unless one is given; a flat fit counts as a scale of 1e-9. A
    group of at most `direct` spots (10 or more) is solved in one task, a larger one over blocks of its spots, in as many
    jobs as the solution takes steps; a group not solved after most_steps is an error.
    """
    if direct < LINEAR_STATIONS:
        raise ValueError(f"direct has to be {LINEAR_STATIONS} or more")
    key = "__group"  # no name of a column used below
    spots = cut_lineage(station_spots(stations, group, lon, lat, value, key))
    sizes = spots.groupBy(key).agg(F.count(F.lit(1)).alias("spots"))
    shape = fitted_variograms(spots, key).select(key, "model", "scale", "range", "nugget")
    spots = attach(attach(spots, sizes, [key]), shape, [key]).withColumns({
        "scale": F.greatest(F.coalesce("scale", F.lit(0.0)), F.lit(1e-9)), "range": F.greatest(F.coalesce("range", F.lit(0.0)), F.lit(1e-9)),
        "nugget": F.coalesce("nugget", F.lit(0.0)) if nugget is None else F.lit(nugget)})
    spots = cut_lineage(spots)
    few, many = spots.where(F.col("spots") <= direct), spots.where(F.col("spots") > direct)
    weights = _direct(few, key)
    if not many.isEmpty():
        weights = weights.unionByName(_by_steps(many, key, most_steps))
    return cut_lineage(weights.withColumnRenamed(key, group))


def _direct(spots: DataFrame, group: str) -> DataFrame:
    schema = f"{group} {spots.schema[group].dataType.simpleString()}, lon double, lat double, w double, drift array<double>, vario array<double>"

    def solve(pdf):
        import numpy as np
        import pandas as pd
        n = len(pdf)
        scale, reach, nugget = (float(pdf[c].iloc[0]) for c in ("scale", "range", "nugget"))
        xy, z = pdf[["lon", "lat"]].to_numpy(float), pdf["v"].to_numpy(float)
        h = np.hypot(xy[:, :1] - xy[:, 0], xy[:, 1:] - xy[:, 1])
        if pdf["stations"].iloc[0] >= LINEAR_STATIONS:
            gamma, vario = nugget + scale * h, [scale, 0.0, nugget]
            drift = np.column_stack([np.ones(n), xy])
        else:  # spherical variogram
            t = np.minimum(h / reach, 1.0)
            gamma, vario = nugget + scale * (1.5 * t - 0.5 * t ** 3), [scale, reach, nugget]
            drift = np.ones((n, 1))
        np.fill_diagonal(gamma, 0.0)
        k = drift.shape[1]
        system = np.block([[gamma, drift], [drift.T, np.zeros((k, k))]])
        wanted = np.concatenate([z, np.zeros(k)])
        try:
            answer = np.linalg.solve(system, wanted)
        except np.linalg.LinAlgError:  # spots on one line
            answer = np.linalg.lstsq(system, wanted, rcond=None)[0]
        d = [float(a) for a in answer[n:]] + [0.0] * (3 - k)
        return pd.DataFrame({group: pdf[group], "lon": xy[:, 0], "lat": xy[:, 1], "w": answer[:n], "drift": [d] * n, "vario": [vario] * n})

    return spots.groupBy(group).applyInPandas(solve, schema)


def _distance_sums():
    """Per spot of a block the sum of distances times a vector over another block."""
    @pandas_udf("array<double>")
    def sums(x, y, lon, lat, vector):
        import pandas as pd
        return pd.Series([_distances(*row) @ p for *row, p in zip(x, y, lon, lat, vector)])
    return sums


def _times_variogram(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """rows with q: minus the linear variogram's matrix times a vector that sums to zero."""
    packed = blocks(rows.select(group, "lon", "lat", vector), [group], ["lon", "lat", vector])
    pairs = meet_blocks(rows.select(group, "lon", "lat"), packed, [group], ["lon", "lat"])
    sums = pairs.select(group, "__targets", _distance_sums()(*_sides("lon", "lat"), F.col("__items")[vector]).alias("q"))
    sums = sums.select(group, F.explode(F.arrays_zip("__targets", "q")).alias("o"))
    sums = sums.groupBy(group, F.col("o.__targets.lon").alias("lon"), F.col("o.__targets.lat").alias("lat")).agg(F.sum("o.q").alias("q"))
    return rows.join(sums, [group, "lon", "lat"]).withColumn("q", F.col("nugget") * F.col(vector) - F.col("slope") * F.col("q"))


def _on_drift(column) -> list:
    """Products of a column with the three orthonormal drift columns."""
    return [F.sum(F.col("e")[k] * column).alias(f"c{k}") for k in range(3)]


def _drift_part():
    return sum((F.col("e")[k] * F.col(f"c{k}") for k in range(1, 3)), F.col("e")[0] * F.col("c0"))


def _by_steps(spots: DataFrame, group: str, most_steps: int, tolerance: float = 1e-10) -> DataFrame:
    """The same weights for groups with the linear variogram, without a matrix.

    On vectors without drift, minus the variogram is positive definite, so conjugate gradients find the weights there; the
    drift is what remains. A step meets all spots of a group with all its blocks: work grows with the square of the
    group, as the system does, but no task holds more than a block. Each group ends when its residual falls below
    tolerance times the first.
    """
    key = [group]
    shape = spots.groupBy(group).agg(F.avg("lon").alias("mx"), F.avg("lat").alias("my"), F.count(F.lit(1)).alias("m"), F.var_pop("lon").alias("xx"),
                                     F.covar_pop("lon", "lat").alias("xy"), F.var_pop("lat").alias("yy"), F.first("scale").alias("slope"), F.first("nugget").alias("nugget"))
    shape = shape.withColumn("g", F.when(F.col("xx") > 0, F.col("xy") / F.col("xx")).otherwise(0.0))
    shape = shape.withColumn("left", F.col("yy") - F.col("g") * F.col("xy"))
    shape = cut_lineage(shape.select(
        group, "mx", "my", "g", (1 / F.sqrt("m")).alias("i0"),
        F.when(F.col("xx") > 0, 1 / F.sqrt(F.col("m") * F.col("xx"))).otherwise(0.0).alias("i1"),
        F.when(F.col("left") > 1e-18 * F.col("yy"), 1 / F.sqrt(F.col("m") * F.col("left"))).otherwise(0.0).alias("i2"),
        "slope", "nugget"))

    east = F.col("lon") - F.col("mx")
    north = F.col("lat") - F.col("my") - F.col("g") * east
    rows = attach(spots.select(group, "lon", "lat", "v"), shape, key)
    rows = rows.select(group, "lon", "lat", "v", "slope", "nugget", F.array("i0", F.col("i1") * east, F.col("i2") * north).alias("e"))
    rows = attach(rows, rows.groupBy(group).agg(*_on_drift(F.col("v"))), key).withColumn("r", _drift_part() - F.col("v"))
    rows = attach(rows, rows.groupBy(group).agg(F.sum(F.col("r") * F.col("r")).alias("first")), key)
    state = cut_lineage(rows.select(group, "lon", "lat", "v", "slope", "nugget", "e", "first", "r", F.col("r").alias("p"), F.lit(0.0).alias("w")))
    names = state.columns
    rq, qq = F.sum(F.col("r") * F.col("q")), F.sum(F.col("q") * F.col("q"))
    for step in range(most_steps + 1):
        state = cut_lineage(_times_variogram(state, group, "p"))
        sums = state.groupBy(group).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("q")).alias("pq"),
                                        F.first("first").alias("f"), *_on_drift(F.col("q")), rq.alias("rq"), qq.alias("qq"))
        going = (F.col("rr") > tolerance ** 2 * F.col("f")) & (F.col("pq") > 0)
        sums = cut_lineage(sums.withColumn("step", F.when(going, F.col("rr") / F.col("pq")).otherwise(0.0)))
        if sums.where("step > 0").isEmpty():
            break
        if step == most_steps:
            raise RuntimeError(f"kriging weights of a group are not found after {most_steps} steps")
        # the next residual's square sum follows from sums of this step, since residuals have no drift
        after = F.col("rr") - 2 * F.col("step") * F.col("rq") + F.col("step") * F.col("step") * (F.col("qq") - sum(F.col(f"c{k}") * F.col(f"c{k}") for k in range(3)))
        sums = sums.withColumn("ratio", F.when(F.col("rr") > 0, F.greatest(after, F.lit(0.0)) / F.col("rr")).otherwise(0.0))
        moved = attach(state, sums.select(group, "step", "ratio", "c0", "c1", "c2"), key)
        moved = moved.withColumns({"w": F.col("w") + F.col("step") * F.col("p"),
                                   "r": F.col("r") - F.col("step") * (F.col("q") - _drift_part())})
        state = moved.withColumn("p", F.col("r") + F.col("ratio") * F.col("p")).select(*names)

    rest = _times_variogram(state.drop("q"), group, "w")
    c = attach(rest.groupBy(group).agg(*_on_drift(F.col("v") + F.col("q"))), shape, key)
    c = c.withColumn("d2", F.col("c2") * F.col("i2")).withColumn("d1", F.col("c1") * F.col("i1") - F.col("d2") * F.col("g"))
    c = c.withColumn("d0", F.col("c0") * F.col("i0") - F.col("d1") * F.col("mx") - F.col("d2") * F.col("my"))
    c = c.select(group, F.array("d0", "d1", "d2").alias("drift"), F.array("slope", F.lit(0.0), "nugget").alias("vario"))
    return attach(state.select(group, "lon", "lat", "w"), c, key)
