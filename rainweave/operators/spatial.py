"""Nearest neighbours, polygons, halos, zonal means and distance-weighted fields.

Points meet through grid cells, never through a cross join. Dense places are held in leaf cells
of at most LEAF points, and sums over many stations run over blocks of BLOCK stations, which meet
blocks of TARGETS targets: a pair of blocks is one row, its sums one array operation.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from rainweave.functions.numeric import clamp, haversine_km
from rainweave.operators.distributed import attach

LEAF = 64
BLOCK = 512
TARGETS = 2048
STEP = 2.0  # a cell's side over that of the next finer level
FEW = 8192  # points of a k-NN search up to which its tables may be broadcast: some 35 MB each
WIDE = 16  # blocks of stations that an inverse-distance sum takes at once
CACHED = 65536  # distances worked on at a time, so that they stay in a core's cache


def knn(targets: DataFrame, refs: DataFrame, k: int, target_id: str, ref_id: str, coords: list[str],
        ref_coords: list[str] | None = None, scale: dict[str, Column] | None = None, exclude_self: bool = False,
        finest: float = 4.0 ** -6) -> DataFrame:
    """Exact k nearest references per target: target_id, ref_id, rank, d2 (squared distance).

    Ties go to the smaller ref_id. `scale` multiplies the difference along a coordinate by a
    factor in (0, 1] of the target, e.g. cos(lat) for longitudes. Points without finite coordinates
    have no neighbours and are none. The extent of the grid and the numbers of points are read from both tables once,
    while the plan is built; tables that grow with more than FEW points are dealt, never broadcast.

    A pyramid of cell counts gives every target a cell with k references, hence a search radius;
    leaf cells (cut into parts where even the finest holds too many) reaching into it are pruned by their bounding boxes, and only the remaining leaves'
    points are compared. References that share a spot are first cut to the k smallest ids there,
    which cannot change the answer. Sides double from level to level, so that neither the radius nor the
    number of leaves in it grows much over what k references need, in three dimensions either.
    """
    ref_coords = ref_coords or coords
    scale = scale or {}
    dims = range(len(coords))
    need = k + 1 if exclude_self else k
    x = [f"__x{j}" for j in dims]
    s = [f"__s{j}" for j in dims]
    g = [f"__g{j}" for j in dims]

    def inside(df):
        return df.where(reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in x]))

    named = inside(targets.select(F.col(target_id).alias("__tid"), *[F.col(c).cast("double").alias(x[j]) for j, c in enumerate(coords)],
                                  *[scale.get(c, F.lit(1.0)).cast("double").alias(s[j]) for j, c in enumerate(coords)]))
    pts = inside(refs.select(F.col(ref_id).alias("__rid"), *[F.col(c).cast("double").alias(x[j]) for j, c in enumerate(ref_coords)]))
    (t_reach, targets_n), (r_reach, refs_n) = [df.agg(F.max(F.greatest(*[F.abs(c) for c in x], F.lit(1.0))), F.count(F.lit(1))).first() for df in (named, pts)]
    levels = max(12, math.ceil(math.log(2.1 * max(t_reach or 1.0, r_reach or 1.0) / finest, STEP)) + 1)
    half = finest * STEP ** (levels - 1) / 2

    def base(c):
        return F.floor((F.col(c) + half) / finest)

    def up(c, steps):
        return F.floor(c / F.pow(F.lit(STEP), steps)).cast("long")

    def sized(df, points, few=None):
        # the optimizer takes rows after an explode for as many as before it, and would broadcast the pyramid and the search of any table
        return df.hint("merge") if points > FEW else df.hint(few) if few else df

    spot = Window.partitionBy(*x).orderBy("__rid")
    pts = pts.withColumn("__rn", F.row_number().over(spot)).where(F.col("__rn") <= need).drop("__rn")
    tall = pts.select("__rid", *x, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("__l"))
    tall = tall.withColumns({g[j]: up(base(x[j]), F.col("__l")) for j in dims})
    pyramid = tall.groupBy("__l", *g).agg(F.count(F.lit(1)).alias("__n"))

    parents = pyramid.select((F.col("__l") - 1).alias("__l"), *[F.col(c).alias(f"__p{j}") for j, c in enumerate(g)],
                             F.col("__n").alias("__pn"))
    kids = pyramid.withColumns({f"__p{j}": up(F.col(g[j]), F.lit(1)) for j in dims})
    kids = kids.join(sized(parents, refs_n), ["__l", *[f"__p{j}" for j in dims]], "left")
    is_leaf = (F.col("__pn").isNull() | (F.col("__pn") > LEAF)) & ((F.col("__n") <= LEAF) | (F.col("__l") == 0))
    leaf_cells = kids.where(is_leaf).select("__l", *g, F.ceil(F.col("__n") / LEAF).alias("__parts"))
    leaves = tall.join(sized(leaf_cells, refs_n), ["__l", *g]).withColumn("__part", F.pmod(F.xxhash64(*x, "__rid"), F.col("__parts"))).groupBy(
        "__l", *g, "__part").agg(
        F.collect_list(F.struct(*x, "__rid")).alias("__pts"), F.count(F.lit(1)).alias("__n"),
        *[F.min(x[j]).alias(f"__lo{j}") for j in dims], *[F.max(x[j]).alias(f"__hi{j}") for j in dims])
    boxes = leaves.drop("__pts")
    leaf_key = [F.col("__l").alias("__ll"), "__part", *[F.col(g[j]).alias(f"__lg{j}") for j in dims]]
    registry = boxes.select(*leaf_key, "__n", *[f"__lo{j}" for j in dims], *[f"__hi{j}" for j in dims],
                            F.explode(F.sequence(F.col("__l").cast("int"), F.lit(levels - 1))).alias("__l"))
    registry = registry.withColumns({**{g[j]: up(F.col(f"__lg{j}"), F.col("__l") - F.col("__ll")) for j in dims},
                                     "__own": F.col("__l") == F.col("__ll")})

    spots = named.select(*x, *s).distinct()
    probe = spots.select(*x, *s, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("__l"))
    probe = probe.withColumns({g[j]: up(base(x[j]), F.col("__l")) for j in dims})
    start = probe.join(sized(pyramid, refs_n), ["__l", *g], "left").groupBy(*x, *s).agg(
        F.coalesce(F.min(F.when(F.col("__n") >= need, F.col("__l"))), F.lit(levels - 1)).alias("__start"))
    # A factor this small stretches the search to the whole extent: start from the cell that holds everything.
    narrow = reduce(lambda a, b: a | b, [F.col(c) < 1e-3 for c in s])
    start = start.withColumn("__start", F.when(narrow, levels - 1).otherwise(F.col("__start")))

    def size(level):
        return F.lit(finest) * F.pow(F.lit(STEP), F.col(level))

    # Cells within reach at the start level and all coarser ones: there a leaf may be the cell itself
    # (own), and below the start level a leaf is registered under its ancestor.
    wanted = start.withColumns({"__r": size("__start") * math.sqrt(len(coords)),
                                "__l": F.explode(F.sequence(F.col("__start").cast("int"), F.lit(levels - 1)))})
    for j in dims:
        reach = F.col("__r") / F.greatest(F.col(s[j]), F.lit(1e-3))
        last = F.pow(F.lit(STEP), F.lit(levels - 1) - F.col("__l")) - 1
        low, high = ((F.col(x[j]) + sign * reach + half) / size("__l") for sign in (-1, 1))
        wanted = wanted.withColumn(g[j], F.explode(F.sequence(
            F.greatest(F.floor(low), F.lit(0)).cast("long"), F.least(F.floor(high), last).cast("long"))))
    kinds = F.when(F.col("__l") == F.col("__start"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    wanted = wanted.withColumn("__own", F.explode(kinds)).drop("__start")
    pairs = wanted.join(sized(registry.withColumn("__l", F.col("__l").cast("int")), refs_n, "broadcast"), ["__l", *g, "__own"]).select(
        *x, *s, "__r", "__ll", "__part", *[f"__lg{j}" for j in dims], "__n", *[f"__lo{j}" for j in dims],
        *[f"__hi{j}" for j in dims])

    def box_distance(far: bool):
        total = F.lit(0.0)
        for j in dims:
            lo, hi, at = F.col(f"__lo{j}"), F.col(f"__hi{j}"), F.col(x[j])
            gap = (F.greatest(F.abs(at - lo), F.abs(at - hi)) if far
                   else F.greatest(lo - at, at - hi, F.lit(0.0)))
            total = total + F.pow(gap * F.col(s[j]), 2)
        return total

    pairs = pairs.withColumns({"__near": box_distance(False), "__far": F.when(F.col("__n") >= need, box_distance(True))})
    radius = F.when(~narrow, F.pow("__r", F.lit(2)))
    bound = F.least(radius, F.min("__far").over(Window.partitionBy(*x, *s)), F.lit(float("inf")))
    # A little slack keeps leaves that rounding puts just outside.
    pairs = pairs.withColumn("__bound", bound).where(F.col("__near") <= F.col("__bound") * (1 + 1e-9) + 1e-18)
    leaf = ["__ll", "__part", *[f"__lg{j}" for j in dims]]
    lists = pairs.select(*x, *s, "__bound", *leaf).join(sized(leaves.select(*leaf_key, "__pts"), refs_n), leaf)

    def squared(p):
        total = F.lit(0.0)
        for j in dims:
            total = total + F.pow((F.col(x[j]) - p[x[j]]) * F.col(s[j]), 2)
        return total

    marked = F.filter(F.transform("__pts", lambda p: F.struct(squared(p).alias("d2"), p["__rid"].alias("rid"))),
                      lambda p: p["d2"] <= F.col("__bound") * (1 + 1e-9) + 1e-18)
    best = F.slice(F.array_sort(marked), 1, need)
    merged = lists.select(*x, *s, best.alias("__best")).groupBy(*x, *s).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("__best"))), 1, need).alias("__best"))
    out = named.join(sized(merged, targets_n), [*x, *s])
    found = F.col("__best")
    if exclude_self:
        found = F.slice(F.filter(found, lambda p: p["rid"] != F.col("__tid")), 1, k)
    out = out.select("__tid", F.posexplode(found).alias("__pos", "__p"))
    return out.select(F.col("__tid").alias(target_id), F.col("__p.rid").alias(ref_id if ref_id != target_id else "neighbour"),
                      (F.col("__pos") + 1).alias("rank"), F.col("__p.d2").alias("d2"))


def nearest(targets: DataFrame, refs: DataFrame, target_id: str, ref_id: str, coords: list[str],
            ref_coords: list[str] | None = None) -> DataFrame:
    """The nearest reference by plain squared coordinate distance."""
    return knn(targets, refs, 1, target_id, ref_id, coords, ref_coords).drop("rank")


def adjacency(cells: DataFrame, cell: str, lat: str, lon: str, eligible: Column | None = None, k: int = 8) -> DataFrame:
    """k nearest eligible cells of every cell under the cos(lat) metric, itself excluded."""
    refs = cells.where(eligible) if eligible is not None else cells
    return knn(cells, refs, k, cell, cell, [lat, lon], scale={lon: F.cos(F.radians(F.col(lat)))}, exclude_self=True)


def min_distance_km(lat, lon, points: list[tuple[float, float]], digits: int = 2) -> Column:
    """Least haversine distance to a fixed list of (lon, lat) points."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    refs = F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in points])
    return F.bround(F.array_min(F.transform(refs, lambda p: haversine_km(lat, lon, p["lat"], p["lon"]))), digits)


def blocks(df: DataFrame, groups: list[str], fields: list[str], size: int = BLOCK) -> DataFrame:
    """Pack rows into arrays of about `size` per group; a hot group becomes many arrays."""
    counts = df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / size).alias("__parts"))
    rows = attach(df, counts, groups)
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(*fields), F.col("__parts")))
    return rows.groupBy(*groups, "__block").agg(F.collect_list(F.struct(*fields)).alias("__items"))


def meet(rows: DataFrame, packed: DataFrame, groups: list[str]) -> DataFrame:
    """Every row with every block of its group, dealt by group and block, so that a hot group is many tasks."""
    last = packed.groupBy(*groups).agg(F.max("__block").alias("__last"))
    rows = rows.join(last, groups).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last")))).drop("__last")
    return rows.join(packed, [*groups, "__block"]).drop("__block")


def meet_blocks(targets: DataFrame, packed: DataFrame, groups: list[str], fields: list[str]) -> DataFrame:
    """Targets packed as `__targets`, a block with every block of its group: neither side is repeated row by row."""
    mine = blocks(targets, groups, fields, TARGETS).withColumnRenamed("__items", "__targets").drop("__block")
    return meet(mine, packed, groups)


def _idw_sums(dims: int, eps: float):
    """Per target of a block the sums of weights and of weighted values over stations, a few targets at a time."""
    @pandas_udf("w array<double>, wv array<double>")
    def sums(*columns):
        import numpy as np
        import pandas as pd
        out = []
        for row in zip(*columns):
            at, places, value = row[:dims], row[dims:-1], row[-1]
            w, wv = np.empty(len(at[0])), np.empty(len(at[0]))
            step = max(1, CACHED // max(1, len(value)))
            for i in range(0, len(w), step):
                here = slice(i, i + step)
                with np.errstate(all="ignore"):
                    weight = np.subtract.outer(at[0][here], places[0])
                    weight *= weight
                    for a, p in zip(at[1:], places[1:]):
                        gap = np.subtract.outer(a[here], p)
                        gap *= gap
                        weight += gap
                    weight += eps
                    np.divide(1.0, weight, out=weight)
                    w[here], wv[here] = weight.sum(1), weight @ value
            out.append((w, wv))
        return pd.DataFrame(out, columns=["w", "wv"])
    return sums


def idw(targets: DataFrame, stations: DataFrame, groups: list[str], target_id: str, coords: list[str], value: str,
        station_coords: list[str] | None = None, eps: float = 1e-4, limit: float | None = 12.0) -> DataFrame:
    """Inverse-distance field: weights 1/(d^2 + eps) over all stations of the target's group."""
    station_coords = station_coords or coords
    places, at = [f"__p{j}" for j in range(len(coords))], [f"__t{j}" for j in range(len(coords))]
    st = stations.select(*groups, *[F.col(c).cast("double").alias(p) for p, c in zip(places, station_coords)],
                         F.col(value).cast("double").alias("__v"))
    # a missing position or value leaves its block without a sum, as in a sum over rows
    packed = blocks(st, groups, [*places, "__v"]).withColumns({
        "__placed": ~F.exists("__items", lambda p: reduce(lambda a, b: a | b, [p[c].isNull() for c in places])),
        "__valued": ~F.exists("__items", lambda p: p["__v"].isNull())})
    # blocks travel side by side, so that a target comes back once for many of them
    blank = F.transform("__items", lambda p: p.withField("__v", F.lit(0.0)))
    packed = packed.groupBy(*groups, F.floor(F.col("__block") / WIDE).alias("__block")).agg(
        F.flatten(F.collect_list(F.when(F.col("__placed"), F.when(F.col("__valued"), F.col("__items")).otherwise(blank)))).alias("__items"),
        F.bool_or("__placed").alias("__placed"), F.bool_or(F.col("__placed") & F.col("__valued")).alias("__valued"))
    mine = targets.select(*groups, F.col(target_id).alias("__id"), *[F.col(c).cast("double").alias(t) for t, c in zip(at, coords)])
    rows = meet_blocks(mine, packed, groups, ["__id", *at])
    sums = _idw_sums(len(coords), eps)(*[F.col("__targets")[t] for t in at], *[F.col("__items")[p] for p in [*places, "__v"]])
    rows = rows.select(*groups, "__targets", "__placed", "__valued", sums.alias("__s"))
    rows = rows.select(*groups, "__placed", "__valued", F.explode(F.arrays_zip("__targets", F.col("__s.w").alias("w"), F.col("__s.wv").alias("wv"))).alias("__o"))
    target, nan = F.col("__o.__targets"), F.lit(float("nan"))  # NaN comes back as NULL
    placed = reduce(lambda a, b: a & b, [target[t].isNotNull() for t in at], F.col("__placed"))
    rows = rows.select(*groups, target["__id"].alias(target_id), F.when(placed, F.coalesce("__o.w", nan)).alias("__w"),
                       F.when(placed & F.col("__valued"), F.coalesce("__o.wv", nan)).alias("__wv"))
    out = rows.groupBy(*groups, target_id).agg((F.sum("__wv") / F.sum("__w")).alias("residual"))
    return out.withColumn("residual", clamp("residual", -limit, limit)) if limit else out


def knn_regression(neighbours: DataFrame, target_id: str, y: str) -> DataFrame:
    """Distance-weighted mean of the neighbours; exact matches, where present, decide alone."""
    d = F.sqrt("d2")
    return neighbours.groupBy(target_id).agg(F.coalesce(
        F.avg(F.when(F.col("d2") == 0, F.col(y))),
        F.sum(F.when(F.col("d2") > 0, F.col(y) / d)) / F.sum(F.when(F.col("d2") > 0, 1.0 / d))).alias("prediction"))


def ring_edges(df: DataFrame, polygon: str, ring: str) -> DataFrame:
    """Edge table from closed rings given as array<struct<lon, lat>>; one row per edge."""
    n = F.size(ring)
    ends = F.arrays_zip(F.slice(F.col(ring), 1, n - 1).alias("a"), F.slice(F.col(ring), 2, n - 1).alias("b"))
    edge = df.select(polygon, F.explode(ends).alias("e"))
    return edge.select(polygon, F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"),
                       F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str, polygon: str, x: str, y: str,
                       cell: float = 0.25, tolerance: float = 1e-12, carry: str | None = None) -> DataFrame:
    """(point, polygon) pairs where the polygon covers the point; its boundary counts as inside.

    `carry` names one more column of the points to return, the same in all rows of a point.
    Bounding-box cells find candidate polygons, and each candidate tests only the edges of its
    own latitude strip, packed in blocks: crossings to the right add up over the blocks.
    """
    box = edges.groupBy(polygon).agg(
        F.least(F.min("x1"), F.min("x2")).alias("__lx"), F.greatest(F.max("x1"), F.max("x2")).alias("__hx"),
        F.least(F.min("y1"), F.min("y2")).alias("__ly"), F.greatest(F.max("y1"), F.max("y2")).alias("__hy"))
    covered = box.withColumn("__gx", _cells(F.col("__lx"), F.col("__hx"), cell))
    covered = covered.withColumn("__gy", _cells(F.col("__ly"), F.col("__hy"), cell))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    more = [carry] if carry else []
    pts = points.select(point_id, *more, px.alias("__x"), py.alias("__y"), F.floor(px / cell).alias("__gx"), F.floor(py / cell).alias("__gy"))
    hit = pts.join(covered, ["__gx", "__gy"]).where(
        F.col("__x").between(F.col("__lx"), F.col("__hx")) & F.col("__y").between(F.col("__ly"), F.col("__hy")))
    strips = edges.withColumn("__gy", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))
    packed = blocks(strips, [polygon, "__gy"], ["x1", "y1", "x2", "y2"])
    rows = hit.select(point_id, *more, polygon, "__x", "__y", "__gy").join(packed, [polygon, "__gy"])
    qx, qy = F.col("__x"), F.col("__y")

    def crosses(e):
        at = (e["x2"] - e["x1"]) * (qy - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return ((e["y1"] > qy) != (e["y2"] > qy)) & (qx < at)

    def on_edge(e):
        area = (e["x2"] - e["x1"]) * (qy - e["y1"]) - (e["y2"] - e["y1"]) * (qx - e["x1"])
        return ((F.abs(area) <= tolerance) & qx.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & qy.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    rows = rows.select(point_id, *more, polygon, F.size(F.filter("__items", crosses)).alias("__c"),
                       F.exists("__items", on_edge).alias("__on"))
    inside = rows.groupBy(point_id, polygon).agg(F.sum("__c").alias("__c"), F.bool_or("__on").alias("__on"), *[F.max(c).alias(c) for c in more])
    return inside.where((F.col("__c") % 2 == 1) | F.col("__on")).select(point_id, polygon, *more)


def within_halo(points: DataFrame, edges: DataFrame, point_id: str, polygon: str, x: str, y: str, radius: float,
                cell: float = 0.25) -> DataFrame:
    """(point, polygon) pairs inside the polygon or within `radius` of its boundary (exact disc)."""
    near = edges.withColumn("__gx", _cells(F.least("x1", "x2") - radius, F.greatest("x1", "x2") + radius, cell))
    near = near.withColumn("__gy", _cells(F.least("y1", "y2") - radius, F.greatest("y1", "y2") + radius, cell))
    packed = blocks(near, [polygon, "__gx", "__gy"], ["x1", "y1", "x2", "y2"])
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    pts = points.select(point_id, px.alias("__x"), py.alias("__y"), F.floor(px / cell).alias("__gx"),
                        F.floor(py / cell).alias("__gy"))
    qx, qy = F.col("__x"), F.col("__y")

    def close(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = ((qx - e["x1"]) * dx + (qy - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = clamp(F.coalesce(along, F.lit(0.0)), 0.0, 1.0)
        return F.pow(qx - e["x1"] - t * dx, 2) + F.pow(qy - e["y1"] - t * dy, 2) <= radius * radius

    rim = pts.join(packed, ["__gx", "__gy"]).where(F.exists("__items", close)).select(point_id, polygon)
    return rim.unionByName(points_in_polygons(points, edges, point_id, polygon, x, y, cell)).distinct()


def zonal(pixels: DataFrame, edges: DataFrame, pixel_id: str, polygon: str, x: str, y: str, value: str,
          valid: tuple[float, float] = (-500.0, 9000.0), cell: float = 0.25) -> DataFrame:
    """Mean and count of the valid pixel values each polygon covers."""
    v = F.col(value)
    good = pixels.where(v.isNotNull() & ~F.isnan(v.cast("double")) & (v > valid[0]) & (v < valid[1]))
    inside = points_in_polygons(good, edges, pixel_id, polygon, x, y, cell, carry=value)
    return inside.groupBy(polygon).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("pixels"))


def bounding_box(df: DataFrame, lon: str, lat: str, groups: list[str] = (), buffer: float = 0.15) -> DataFrame:
    return df.groupBy(*groups).agg((F.min(lon) - buffer).alias("lon_min"), (F.min(lat) - buffer).alias("lat_min"),
                                   (F.max(lon) + buffer).alias("lon_max"), (F.max(lat) + buffer).alias("lat_max"))


def tiles(boxes: DataFrame, step: int = 1) -> DataFrame:
    """South-west corners of the step-degree tiles covering each box, with compass names."""
    def span(low, high):
        lo = F.floor(F.col(low) / step) * step
        hi = F.ceil(F.col(high) / step) * step - step
        return F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int"), F.lit(step)))

    rows = boxes.withColumn("tile_lat", F.explode(span("lat_min", "lat_max")))
    rows = rows.withColumn("tile_lon", F.explode(span("lon_min", "lon_max")))
    name = F.concat(F.when(F.col("tile_lat") >= 0, "N").otherwise("S"), F.lpad(F.abs("tile_lat").cast("string"), 2, "0"),
                    F.when(F.col("tile_lon") >= 0, "E").otherwise("W"), F.lpad(F.abs("tile_lon").cast("string"), 3, "0"))
    return rows.withColumn("tile", name)
