import numpy as np
import pytest
from pyspark.sql import functions as F

from rainweave.operators import models as M, spatial as X


def cloud(n, seed):
    rng = np.random.default_rng(seed)
    far = rng.uniform([15, 72], [22, 80], (n // 3, 2))
    tight = rng.normal([19.0, 74.0], 1e-3, (n // 3, 2))
    same = np.repeat([[20.0, 75.0]], n - 2 * (n // 3), 0)
    return np.concatenate([far, tight, same])


def brute(t, r, k, c=None, own=False):
    out = {}
    for i, p in enumerate(t):
        d = (r[:, 0] - p[0]) ** 2 + ((r[:, 1] - p[1]) * (np.cos(np.radians(p[0])) if c else 1)) ** 2
        ids = [j for j in np.lexsort((np.arange(len(r)), d.round(15))) if not (own and j == i)]
        out[i] = [(j, d[j]) for j in ids[:k]]
    return out


@pytest.mark.parametrize("leaf,own", [(4, False), (64, True)])
def test_knn_is_exact_on_clusters_and_copies(spark, monkeypatch, leaf, own):
    monkeypatch.setattr(X, "LEAF", leaf)
    r = cloud(150, 1)
    t = r if own else cloud(60, 2)
    refs = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r)], "rid int, lat double, lon double")
    tgts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(t)], "tid int, lat double, lon double")
    scale = {"lon": F.cos(F.radians("lat"))}
    got = {}
    for x in X.knn(tgts, refs, 5, "tid", "rid", ["lat", "lon"], scale=scale, exclude_self=own).collect():
        got.setdefault(x.tid, {})[x["rank"]] = (x.rid, x.d2)
    want = brute(t, r, 5, True, own)
    for i, w in want.items():
        assert len(got[i]) == 5
        np.testing.assert_allclose([got[i][k + 1][1] for k in range(5)], [d for _, d in w], rtol=1e-9, atol=1e-18)


def test_knn_with_fewer_references_than_k(spark):
    refs = spark.createDataFrame([(1, 18.0, 73.0), (2, 19.0, -73.0)], "rid int, lat double, lon double")
    tgt = spark.createDataFrame([(0, 18.1, 73.1)], "tid int, lat double, lon double")
    assert [x.rid for x in X.knn(tgt, refs, 8, "tid", "rid", ["lat", "lon"]).orderBy("rank").collect()] == [1, 2]


def square(spark):
    ring = [(73.0, 18.0), (75.0, 18.0), (75.0, 20.0), (74.0, 19.0), (73.0, 20.0), (73.0, 18.0)]
    df = spark.createDataFrame([(1, [{"lon": a, "lat": b} for a, b in ring])], "poly int, ring array<struct<lon:double,lat:double>>")
    return X.ring_edges(df, "poly", "ring")


def test_polygon_covers_inside_edge_and_corner(spark):
    pts = [(0, 74.0, 18.5), (1, 74.0, 19.5), (2, 75.0, 19.0), (3, 73.0, 18.0), (4, 75.01, 19.0), (5, 73.5, 19.5), (6, 74.0, 19.0), (7, 72.9, 18.0)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    inside = {r.id for r in X.points_in_polygons(df, square(spark), "id", "poly", "x", "y").collect()}
    assert inside == {0, 2, 3, 5, 6}
    halo = {r.id for r in X.within_halo(df, square(spark), "id", "poly", "x", "y", 0.12).collect()}
    assert halo == inside | {4, 7}


def test_blocks_split_a_hot_group_and_keep_all_rows(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    packed = X.blocks(df, ["g"], ["v"], 500)
    assert packed.count() > 5
    assert packed.select(F.explode("__items").alias("i")).agg(F.sum("i.v"), F.count("*")).first()[:] == (5000 * 4999 / 2, 5000)


def test_idw_against_numpy(spark):
    rng = np.random.default_rng(3)
    st, tg = rng.uniform(18, 20, (9, 3)), rng.uniform(18, 20, (5, 2))
    s = spark.createDataFrame([("a", *map(float, p)) for p in st], "g string, lat double, lon double, r double")
    t = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(tg)], "g string, id int, lat double, lon double")
    got = {r.id: r.residual for r in X.idw(t, s, ["g"], "id", ["lat", "lon"], "r").collect()}
    for i, p in enumerate(tg):
        w = 1 / (((st[:, :2] - p) ** 2).sum(1) + 1e-4)
        assert got[i] == pytest.approx(min(12.0, (w * st[:, 2]).sum() / w.sum()))


@pytest.mark.parametrize("n,method", [(12, "universal"), (6, "ordinary"), (3, "idw")])
def test_residual_field_follows_density_and_honours_stations(spark, n, method):
    rng = np.random.default_rng(n)
    xy, z = rng.uniform(73, 75, (n, 2)), rng.normal(0, 3, n)
    st = spark.createDataFrame([("a", float(a), float(b), float(c)) for (a, b), c in zip(xy, z)], "g string, slon double, slat double, r double")
    tg = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [("b", 99, 73.0, 18.0)],
                               "g string, id int, lon double, lat double")
    assert M.density_rule(st, ["g"]).first().method == method
    got = {r.id: r.residual for r in M.residual_field(tg, st, "g", "id", "lon", "lat", "r", "slon", "slat").collect()}
    assert got[99] == 0.0
    assert np.std([got[i] for i in range(n)]) > 0.1
    if method != "idw":  # kriging reproduces its stations
        np.testing.assert_allclose([got[i] for i in range(n)], z, atol=1e-6)


def test_kriging_over_blocks_equals_the_direct_solve(spark):
    from rainweave.operators.kriging import kriging_weights
    rng = np.random.default_rng(8)
    xy, z = rng.uniform(73, 75, (14, 2)), rng.normal(0, 3, 14)
    rows = [("a", *map(float, p), float(v)) for p, v in zip(xy, z)] + [("a", *map(float, xy[0]), 5.0), ("a", None, 18.0, 1.0)]
    rows += [("line", 73.0 + k, 18.0, float(k * k)) for k in range(12)]  # every spot on one line
    st = spark.createDataFrame(rows, "g string, x double, y double, r double")
    places = [(g, i, float(a), float(b)) for g in ("a", "line") for i, (a, b) in enumerate(rng.uniform(73, 75, (6, 2)))]
    tg = spark.createDataFrame([(g, f"{g}{i}", a, b if g == "a" else 18.0) for g, i, a, b in places], "g string, id string, x double, y double")
    fields = []
    for direct in (2000, 10):
        w = kriging_weights(st, "g", "x", "y", "r", direct, 0.25)
        fields.append({r.id: r.residual for r in M.kriging_field(tg, w, "g", "id", "x", "y").collect()})
    assert len(fields[0]) == 12 and np.std(list(fields[0].values())) > 0.1
    assert fields[1] == pytest.approx(fields[0], abs=1e-6)


def _loss(scale, reach, nugget, h, g):
    t = np.minimum(h / reach, 1) if reach else h
    e = nugget + scale * (1.5 * t - 0.5 * t ** 3 if reach else t) - g
    return (2 * (np.sqrt(1 + e * e) - 1)).sum()


def test_fitted_variograms_against_brute_force(spark):
    from rainweave.operators import kriging as K
    rng = np.random.default_rng(5)
    rows = []
    for g in range(10):
        n = 12 + g if g % 2 else 5 + g % 5
        xy = rng.uniform(0, 2, (n, 2))
        z = np.sin(xy[:, 0] * 2) * 3 + rng.normal(0, 0.3 * g, n)
        rows += [(g, *map(float, p), float(v)) for p, v in zip(xy, z)]
    rows += [(0, rows[0][1], rows[0][2], 9.0), (0, None, 1.0, 1.0), (77, 1.0, 1.0, 1.0), (78, 1.0, 1.0, 4.0), (78, 1.0, 2.0, 4.0)]
    st = spark.createDataFrame(rows, "g int, x double, y double, r double")
    spots = K.station_spots(st, "g", "x", "y", "r", "g")
    bins = {(r.g, r.bin): (r.pairs, r.lag, r.semivariance) for r in K.semivariogram(spots, "g").collect()}
    fits = {r.g: r for r in K.fitted_variograms(spots, "g").collect()}
    assert set(fits) == {*range(10), 78} and fits[78].scale == fits[78].nugget == 0.0
    for g in range(10):
        own = {}
        for k, x, y, r in rows:
            if k == g and x is not None:
                own.setdefault((x, y), []).append(r)
        p, v = np.array(list(own)), np.array([np.mean(r) for r in own.values()])
        i, j = np.triu_indices(len(p), 1)
        h, semi = np.hypot(*(p[i] - p[j]).T), (v[i] - v[j]) ** 2 / 2
        at = np.minimum(np.floor((h - h.min()) / ((h.max() - h.min()) / 6)), 5).astype(int)
        lag, gamma = (np.array([a[at == b].mean() for b in np.unique(at)]) for a in (h, semi))
        assert {b: (int((at == b).sum()), pytest.approx(x), pytest.approx(s)) for b, x, s in zip(np.unique(at), lag, gamma)} == {
            b: t for (k, b), t in bins.items() if k == g}
        fit = fits[g]
        assert (fit.model == "linear") == (len([r for r in rows if r[0] == g and r[1] is not None]) >= 10) == (fit.range == 0)
        assert fit.loss == pytest.approx(_loss(fit.scale, fit.range, fit.nugget, lag, gamma))
        ranges = [0.0] if fit.model == "linear" else lag.max() * np.arange(1, 201) / 200
        best = min(_loss(a, r, b, lag, gamma) for r in ranges for a in np.linspace(0, 2 * gamma.max(), 41) for b in np.linspace(0, gamma.max(), 41))
        assert fit.loss <= best + 1e-6


def test_kriging_that_does_not_end_is_an_error(spark):
    from rainweave.operators.kriging import kriging_weights
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1, (30, 2))
    st = spark.createDataFrame([("a", float(x), float(y), float(3 * np.sin(6 * x) + y)) for x, y in xy], "g string, x double, y double, r double")
    with pytest.raises(RuntimeError):
        kriging_weights(st, "g", "x", "y", "r", direct=10, most_steps=2)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_idw_meets_blocks_of_targets_and_handles_missing_values(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    monkeypatch.setattr(X, "TARGETS", 8)
    rng = np.random.default_rng(5)
    t, s, v = rng.uniform(0, 3, (40, 2)), rng.uniform(0, 3, (60, 2)), rng.normal(size=60)
    tg = spark.createDataFrame([(i, 1, *map(float, p)) for i, p in enumerate(t)] + [(40, 1, None, 1.0), (41, 2, 1.0, 1.0), (42, 3, 1.0, 1.0)],
                               "id int, g int, lat double, lon double")
    st = spark.createDataFrame([(1, *map(float, p), float(r)) for p, r in zip(s, v)] + [(2, 1.0, 2.0, 4.0), (2, 1.0, 2.0, None)],
                               "g int, lat double, lon double, r double")
    out = X.idw(tg, st, ["g"], "id", ["lat", "lon"], "r", limit=None)
    assert "aggregate(" not in plan_of(out)  # sums over arrays, not item by item for every target row
    got = {r.id: r.residual for r in out.collect()}
    weight = 1 / (((t[:, None] - s[None]) ** 2).sum(2) + 1e-4)
    np.testing.assert_allclose([got[i] for i in range(40)], weight @ v / weight.sum(1), rtol=1e-10)
    assert got[40] is None and got[41] is None and 42 not in got


def test_blocks_meet_blocks_without_repeating_rows(spark):
    pts = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    pairs = X.meet_blocks(pts, X.blocks(pts, ["g"], ["x"]), ["g"], ["x"])
    assert pairs.count() == 3 * 10  # not 5,000 rows, each with 10 blocks


def test_variogram_pairs_and_products_stay_in_blocks(spark):
    from rainweave.operators import kriging as K
    rng = np.random.default_rng(8)
    st = spark.createDataFrame([(1, *map(float, p)) for p in rng.uniform(0, 3, (30, 3))], "g int, x double, y double, r double")
    spots = K.station_spots(st, "g", "x", "y", "r", "k")
    assert K._pairs(spots, "k").count() == 1  # one pair of blocks, not 900 pairs of spots
    product = K._times_variogram(spots.withColumns({"nugget": F.lit(0.5), "slope": F.lit(2.0), "p": F.col("v") - 0.5}), "k", "p")
    assert "aggregate(" not in plan_of(product)
    rows = product.collect()
    xy, p = np.array([[r.lon, r.lat] for r in rows]), np.array([r.p for r in rows])
    h = np.hypot(xy[:, :1] - xy[:, 0], xy[:, 1:] - xy[:, 1])
    np.testing.assert_allclose([r.q for r in rows], 0.5 * p - 2.0 * (h @ p), rtol=1e-10)


def test_field_joins_parameters_before_blocks_meet_targets(spark):
    w = spark.createDataFrame([(1, float(i % 7), float(i % 5), 0.1 if i % 2 else -0.1, [1.0, 0.0, 0.0], [2.0, 0.0, 0.5]) for i in range(20)],
                              "g int, lon double, lat double, w double, drift array<double>, vario array<double>")
    tg = spark.createDataFrame([(1, 1, 0.5, 0.5), (2, 1, None, 1.0), (3, 2, 1.0, 1.0)], "id int, g int, lon double, lat double")
    out = M.kriging_field(tg, w, "g", "id", "lon", "lat")
    assert "aggregate(" not in plan_of(out)
    got = {r.id: r.residual for r in out.collect()}
    want = 1.0 + sum((0.1 if i % 2 else -0.1) * (0.5 + 2.0 * np.hypot(0.5 - i % 7, 0.5 - i % 5)) for i in range(20))
    assert abs(got[1] - want) < 1e-9 and got[2] == 0.0 and 3 not in got


def test_inverse_distance_sums_hold_no_whole_matrix_and_blocks_travel_side_by_side(spark, monkeypatch):
    import pandas as pd
    import tracemalloc
    rng = np.random.default_rng(9)
    a, b, p, q, v = (rng.uniform(0, 3, n) for n in (1000, 1000, 4000, 4000, 4000))
    tracemalloc.start()
    got = X._idw_sums(2, 1e-4).func(*[pd.Series([c]) for c in (a, b, p, q, v)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    weight = 1 / (np.subtract.outer(a, p) ** 2 + np.subtract.outer(b, q) ** 2 + 1e-4)
    np.testing.assert_allclose(got.w[0], weight.sum(1), rtol=1e-12)
    np.testing.assert_allclose(got.wv[0], weight @ v, rtol=1e-12)
    assert peak < weight.nbytes / 4

    # a block with a missing position or value is left out, those beside it stay
    pack, seen = X.blocks, []
    monkeypatch.setattr(X, "blocks", lambda df, groups, fields, size=8: pack(df, groups, fields, size))
    meets = X.meet
    monkeypatch.setattr(X, "meet", lambda rows, packed, groups: seen.append(packed.count()) or meets(rows, packed, groups))
    st = spark.createDataFrame([(1, *map(float, r)) for r in zip(p[:60], q[:60], v[:60])] + [(1, 1.0, 2.0, None), (1, None, 2.0, 1.0)],
                               "g int, lat double, lon double, r double")
    at = pack(st, ["g"], ["lat", "lon", "r"], 8).collect()
    w = wv = 0
    for block in (b["__items"] for b in at):
        if all(i.lat is not None for i in block):
            one = 1 / ((0.5 - np.array([i.lat for i in block])) ** 2 + (0.5 - np.array([i.lon for i in block])) ** 2 + 1e-4)
            w += one.sum()
            wv += 0 if any(i.r is None for i in block) else one @ np.array([i.r for i in block])
    tg = spark.createDataFrame([(1, 1, 0.5, 0.5)], "id int, g int, lat double, lon double")
    assert X.idw(tg, st, ["g"], "id", ["lat", "lon"], "r", limit=None).first().residual == pytest.approx(wv / w, rel=1e-12)
    assert seen == [1] and len(at) > 4


def test_downscaled_villages_are_written_once(spark, monkeypatch):
    from rainweave.plans import downscale as D
    written = []
    monkeypatch.setattr(D, "cut_lineage", lambda df: written.append(df.columns) or df)
    columns = {"b": F.lit(1), "panchayat_id": F.col("id"), "centroid_lon": F.lit(74.0), "centroid_lat": F.lit(19.0), "block_rain": F.lit(20.0),
               **{c: F.lit(1.0) for c in ("block_tmax", "block_tmin", "rain_deviation", "temp_deviation", *D.FEATURES)}}
    villages = spark.range(3).select(*[c.alias(n) for n, c in columns.items()])
    st = spark.createDataFrame([(1, 74.1, 19.0, 2.0)], "b int, slon double, slat double, residual double")
    assert D.downscale(villages, st, "b", [1.0, 1.1], [0.0, 0.0], "idw").count() == 3
    assert [c[:2] for c in written] == [["b", "panchayat_id"]]


def shuffled_rows(df):
    """Records written by the exchanges of a plan that has run."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))
    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_few_leaves_reach_a_target_in_three_dimensions(spark):
    rng = np.random.default_rng(8)

    def points(name, n):
        return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 1, (n, 3)) * [6.4, 8.2, 1.1])], f"{name} int, a double, b double, c double")
    near = X.knn(points("tid", 500), points("rid", 5000), 5, "tid", "rid", ["a", "b", "c"])
    assert shuffled_rows(near) < 100 * 500 + 30 * 5000


def test_tables_of_a_knn_search_are_broadcast_for_few_points_only(spark):
    cells = spark.range(X.FEW + 1).selectExpr("id AS cell", "18 + id * 7919 % 6400 / 1000 AS lat", "73 + id * 104729 % 8200 / 1000 AS lon")
    text = X.adjacency(cells, "cell", "lat", "lon")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and text.count("SortMergeJoin") >= 6
    few = X.knn(cells, cells.where("cell < 50"), 8, "cell", "cell", ["lat", "lon"], exclude_self=True)._jdf.queryExecution().executedPlan().toString()
    searched = [line for line in few.splitlines() if "HashJoin" in line and "__own" in line]
    assert searched and all("BuildRight" in line for line in searched)  # what the few references hold, not the search of all targets


@pytest.mark.parametrize("few", [0, 100, 10_000])
@pytest.mark.parametrize("targets,references", [(300, 60), (60, 300), (0, 60), (60, 0)])
def test_knn_is_the_same_however_its_tables_meet(spark, monkeypatch, few, targets, references):
    monkeypatch.setattr(X, "FEW", few)
    t, r = cloud(targets, 4), cloud(references, 5)
    odd = [(-1, None, 74.0), (-2, float("nan"), 74.0), (-3, 19.0, float("inf"))]
    tgts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(t)] + odd, "tid int, lat double, lon double")
    refs = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r)] + odd, "rid int, lat double, lon double")
    got = {}
    for x in X.knn(tgts, refs, 3, "tid", "rid", ["lat", "lon"]).collect():
        got.setdefault(x.tid, {})[x["rank"]] = x.d2
    want = brute(t, r, 3) if references else {}
    assert {i: sorted(v) for i, v in got.items()} == {i: [1, 2, 3] for i in want}
    for i, w in want.items():
        np.testing.assert_allclose([got[i][k + 1] for k in range(3)], [d for _, d in w], rtol=1e-9, atol=1e-18)
