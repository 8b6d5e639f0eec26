"""Building blocks that keep a hot group from landing in one task.

Group statistics are aggregated before the shuffle and joined back, sorted groups are cut
into order buckets, and quantiles come from ranked distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rainweave.functions.order import order_buckets, order_image
from rainweave.session import cut_lineage


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-key rows back onto the detail rows; NULL keys match each other.

    Without keys the right side is one aggregate row and becomes a scalar subquery.
    """
    values = [c for c in right.columns if c not in keys]
    if not keys:
        row = right.select(F.struct(*values).alias("r")).scalar()
        tagged = left.withColumn("__row", row)
        return tagged.select(*left.columns, *[F.col("__row")[c].alias(c) for c in values])
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *values)
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys])
    return left.join(renamed, match, how).drop(*[f"__k_{k}" for k in keys])


def group_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def with_group_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Like aggregates over a whole-group window, but with map-side combine."""
    return attach(df, group_stats(df, keys, **aggs), keys)


def running_sums(df: DataFrame, groups: list[str], order: Column, sums: dict[str, Column],
                 name: str = "value", totals: bool = False) -> DataFrame:
    """Inclusive running sums per distinct value in ascending order within each group.

    Returns groups, `name`, each sum for that value, `cum_<sum>`, and `total_<sum>` on request.
    Missing values, NaN and infinities have no place in the order and are left out. Numbers, dates,
    timestamps and text are ordered by themselves; only the buckets come from a number beside them.
    Totals run bottom-up over two bucket levels; every window sees one bucket's children, never
    the whole group. Both levels read the shuffled distinct values, not the input again.
    """
    # One struct key: NULL group values match, and the window's partitioning serves the join.
    key = F.struct(*groups) if groups else F.lit(0)
    at = ["__key", "__b0", "__b1"]
    rows = df.select(key.alias("__key"), order.alias(name), *[c.alias(s) for s, c in sums.items()])
    image = order_image(F.col(name), rows.schema[name].dataType.simpleString())
    counts = rows.where(F.abs(image) < float("inf")).groupBy("__key", name).agg(*[F.sum(s).alias(s) for s in sums])
    counts = counts.withColumns(dict(zip(at[1:], order_buckets(image))))
    fine = counts.groupBy(*at).agg(*[F.sum(s).alias(s) for s in sums])
    coarse = fine.groupBy(*at[:2]).agg(*[F.sum(s).alias(s) for s in sums])

    def before(s, parents, order_by):
        frame = Window.partitionBy(*parents).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(s).over(frame), F.lit(0))

    coarse = coarse.select(*at[:2], *[before(s, at[:1], "__b0").alias(f"__o_{s}") for s in sums],
                           *([F.sum(s).over(Window.partitionBy("__key")).alias(f"total_{s}") for s in sums] if totals else []))
    fine = fine.select(*at, *[before(s, at[:2], "__b1").alias(f"__p_{s}") for s in sums])
    offsets = fine.join(coarse, at[:2])
    inside = Window.partitionBy(*at).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = counts.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums}).join(offsets, at)
    return out.select(
        *[F.col("__key")[g].alias(g) for g in groups], name, *sums,
        *[(F.col(f"cum_{s}") + F.col(f"__p_{s}") + F.col(f"__o_{s}")).alias(f"cum_{s}") for s in sums],
        *([f"total_{s}" for s in sums] if totals else []))


def exact_quantiles(df: DataFrame, groups: list[str], value: Column, quantiles: dict[str, float],
                    method: str = "linear") -> DataFrame:
    """Exact quantiles per group by selection: rows are counted in order buckets, and only those of wanted buckets are ranked.

    `linear` interpolates between neighbouring ranks, `lower` takes sorted[floor(q*(n-1))]. Missing values, NaN and infinities
    are left out. df is read twice, and counts alone are shuffled: first those of buckets, which tell for each wanted rank
    its bucket, then those of the distinct values in these. The buckets found are written, so the optimizer sees how few they are.
    """
    key = F.struct(*groups) if groups else F.lit(0)
    rows = df.select(key.alias("__key"), value.alias("__v"))
    image = order_image(F.col("__v"), rows.schema["__v"].dataType.simpleString())
    rows = rows.where(F.abs(image) < float("inf")).withColumns(dict(zip(("__b0", "__b1"), order_buckets(image))))

    def ranked(counts, parents, order):
        """Rows before each row of its parent."""
        frame = Window.partitionBy(*parents).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("__before", F.sum("__n").over(frame) - F.col("__n"))

    coarse = ranked(rows.groupBy("__key", "__b0").agg(F.count(F.lit(1)).alias("__n")), ["__key"], "__b0")
    coarse = coarse.withColumn("__total", F.sum("__n").over(Window.partitionBy("__key")))
    last, asked = F.col("__total") - 1, []
    for k, q in enumerate(quantiles.values()):
        low = F.floor(F.lit(float(q)) * last)
        asked += [F.struct(F.lit(2 * k).alias("q"), low.alias("rank")), F.struct(F.lit(2 * k + 1).alias("q"), F.least(low + 1, last).alias("rank"))][:2 if method == "linear" else 1]
    held = (F.col("__a.rank") >= F.col("__before")) & (F.col("__a.rank") < F.col("__before") + F.col("__n"))
    wanted = coarse.select("__key", "__b0", "__n", "__before", "__total", F.explode(F.array(*asked)).alias("__a")).where(held)
    wanted = cut_lineage(wanted.select("__key", "__b0", "__total", F.col("__a.q").alias("__q"), (F.col("__a.rank") - F.col("__before")).alias("__rank")))

    near = (rows.join(wanted.select("__key", "__b0").distinct(), ["__key", "__b0"]).groupBy("__key", "__b0", "__b1", "__v").agg(F.count(F.lit(1)).alias("__n")))
    parts = ranked(near.groupBy("__key", "__b0", "__b1").agg(F.sum("__n").alias("__n")), ["__key", "__b0"], "__b1")
    inside = F.col("__rank") - F.col("__before")
    parts = parts.join(wanted, ["__key", "__b0"]).where((inside >= 0) & (inside < F.col("__n"))).select("__key", "__b0", "__b1", "__total", "__q", inside.alias("__rank"))
    found = ranked(near, ["__key", "__b0", "__b1"], "__v").join(parts, ["__key", "__b0", "__b1"]).where((inside >= 0) & (inside < F.col("__n")))
    marks = found.groupBy("__key").agg(F.max("__total").alias("__total"), *[F.max(F.when(F.col("__q") == k, F.col("__v"))).alias(f"__m{k}") for k in range(2 * len(quantiles))])
    out = []
    for k, (name, q) in enumerate(quantiles.items()):
        lo = F.col(f"__m{2 * k}")
        if method == "linear":
            pos = F.lit(float(q)) * last
            lo = lo + (F.col(f"__m{2 * k + 1}") - lo) * (pos - F.floor(pos))
        out.append(lo.alias(name))
    return marks.select(*[F.col("__key")[g].alias(g) for g in groups], *out)


def ordinal(df: DataFrame, order: Column, name: str = "idx") -> DataFrame:
    """Zero-based position of each distinct value in the whole table: columns `value`, `name`."""
    distinct = df.select(order.alias("value")).distinct()
    ranks = running_sums(distinct, [], F.col("value"), {"n": F.lit(1)})
    return ranks.select("value", (F.col("cum_n") - 1).cast("long").alias(name))


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row.

    They come out of a one-row generator, so filters above read the values; a plain projection
    would be copied into every filter and lambda that mentions it, level by level.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_empty(df: DataFrame, message: str) -> None:
    """Fail closed: one bounded probe, nothing is pulled to the driver but the first row."""
    found = df.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")
