"""Causal daily features: nothing after target day minus lead minus availability lag is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rainweave.operators.distributed import attach, require_empty

LAGS = {"rain_last": 0, "rain_previous": 1, "rain_two_before": 2, "rain_six_before": 6, "rain_thirteen_before": 13}
MEANS = (3, 7, 14)
EVENT_MM = 20.0
NEIGHBOUR_DAYS = 64
BIT_DAYS = 64  # bits of a long


def day_number(date) -> Column:
    return F.datediff(F.col(date) if isinstance(date, str) else date, F.lit("1970-01-01").cast("date"))


def _day_bits(df: DataFrame, key: list[str], date: str) -> DataFrame:
    """Per key and BIT_DAYS days of the calendar (`__chunk`): rows, the days as bits, the first and the last day."""
    day = day_number(date)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(BIT_DAYS)).cast("int"))
    return df.groupBy(*key, F.floor(day / BIT_DAYS).cast("int").alias("__chunk")).agg(
        F.count(F.lit(1)).alias("__n"), F.bit_or(bit).alias("__bits"), F.min(date).alias("__first"), F.max(date).alias("__last"))


def distinct_days(df: DataFrame, key: list[str], date: str) -> DataFrame:
    """The distinct rows of (key, date), a missing date included; days meet as bits, so no task holds a row per day."""
    days = F.filter(F.sequence(F.lit(0), F.lit(BIT_DAYS - 1)), lambda i: F.getbit("__bits", i) == 1)
    first = F.lit("1970-01-01").cast("date")
    dates = F.transform(days, lambda i: F.date_add(first, F.col("__chunk") * BIT_DAYS + i))
    return _day_bits(df, key, date).select(*key, F.explode_outer(dates).alias(date))


def continuity(df: DataFrame, key: list[str], date: str, strict: bool = False) -> DataFrame:
    """Per key: rows, distinct days, and whether the series steps by exactly one day."""
    if df.schema[date].dataType.simpleString() == "date":
        total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
        out = _day_bits(df, key, date).groupBy(*key).agg(total("__n").alias("n"), total(F.bit_count("__bits")).alias("days"),
                                                         (F.datediff(F.max("__last"), F.min("__first")) + 1).alias("span"))
    else:
        out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(date).alias("days"),
                                   (F.datediff(F.max(date), F.min(date)) + 1).alias("span"))
    out = out.withColumn("continuous", (F.col("n") == F.col("days")) & (F.col("days") == F.col("span")))
    if strict:
        require_empty(out.where(~F.col("continuous")), "Daily series must be continuous")
    return out.drop("span")


def in_months(date, months=(6, 7, 8, 9, 10)) -> Column:
    """Season filter. Apply after the lag features, which reach back before the season."""
    return F.month(date).isin(list(months))


def season(date) -> dict[str, Column]:
    angle = 2 * F.pi() * F.dayofyear(date) / 365.25
    return {"season_sin": F.sin(angle), "season_cos": F.cos(angle)}


def chunked(df: DataFrame, date: str, lookback: int, chunk_days: int = 1024) -> DataFrame:
    """Cut long series into day ranges; each range also gets the `lookback` days before it.

    Windows over (key, __chunk) then see the same past as windows over the whole key, while a
    task holds at most chunk_days + lookback days of it. Keep rows with __home afterwards.
    """
    day = day_number(date)
    home = F.floor(day / chunk_days)
    out = df.withColumn("__day", day)
    out = out.withColumn("__chunk", F.explode(F.sequence(home, F.floor((day + lookback) / chunk_days))))
    return out.withColumn("__home", F.floor(F.col("__day") / chunk_days) == F.col("__chunk"))


def _lag_arrays(kept: list[str], cutoff: int, lags: dict[str, int], means: tuple[int, ...]):
    """Per chunk of a series its rows marked `__keep`, with lags, means and the maximum of three days as array operations."""
    reach = cutoff + max(*lags.values(), *(n - 1 for n in means))

    def features(rows):
        import numpy as np
        import pyarrow as pa
        day = rows["__day"].to_numpy()
        order = np.argsort(day, kind="stable")
        # missing days are places without a value, so that a step back in places is a step back in days
        at = np.cumsum(np.concatenate([[0], np.maximum(np.diff(day[order]), 1)])) + reach
        v, here = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1, bool)
        v[at], here[at] = rows["__v"].fill_null(0.0).to_numpy()[order], rows["__v"].is_valid().to_numpy()[order]
        keep = rows["__keep"].to_numpy()[order]
        out, end = rows.select(kept).take(pa.array(order[keep])), at[keep] - cutoff

        def trailing(n, fn):
            total, whole = v[end - n + 1], here[end - n + 1]
            for i in range(n - 2, -1, -1):
                total, whole = fn(total, v[end - i]), whole & here[end - i]
            return total, whole

        found = {name: (v[end - k], here[end - k]) for name, k in lags.items()}
        with np.errstate(all="ignore"):
            for n in means:
                total, whole = trailing(n, np.add)
                found[f"mean{n}"] = total / n, whole
            found["max3"] = trailing(3, np.maximum)
        for name, (x, there) in found.items():
            out = out.append_column(name, pa.array(x, mask=~there))
        return out
    return features


def lag_features(df: DataFrame, key: list[str], date: str, value: str, lead: int, lag: int = 2,
                 months=None, chunk_days: int = 1024, warmup: int = 14) -> DataFrame:
    """Lags, trailing means, maximum and trends at the cutoff day of each target day, as doubles.

    A missing day gives NULL and never shifts another day into place; any missing value inside a trailing mean makes it
    NULL. A key has one row a day (see continuity). The first usable target lies lead + lag + `warmup` days after the
    first day of the table, of all keys. A chunk of a series is one call of array operations; where df is already dealt by
    its key, nothing is shuffled.
    """
    if lead < 1 or lag < 0:
        raise ValueError("Invalid lead or lag")
    cutoff = lead + lag
    first = df.agg(F.min(date).alias("d")).scalar()
    rows = chunked(df.select(*key, date, value), date, cutoff + max(*LAGS.values(), max(MEANS)), chunk_days)
    keep = F.col("__home") & (F.datediff(F.col(date), first) >= cutoff + warmup)
    if months:
        keep = keep & in_months(date, months)
    kept = [*key, date, value]
    rows = rows.select(*kept, "__day", "__chunk", F.coalesce(keep, F.lit(False)).alias("__keep"), F.col(value).cast("double").alias("__v"))
    schema = StructType([df.schema[c] for c in kept] + [StructField(c, DoubleType()) for c in (*LAGS, *(f"mean{n}" for n in MEANS), "max3")])
    rows = rows.groupBy(*key, "__chunk").applyInArrow(_lag_arrays(kept, cutoff, LAGS, MEANS), schema)
    return rows.withColumns({"trend1": F.col("rain_last") - F.col("rain_previous"),
                             "trend3_7": F.col("mean3") - F.col("mean7"), **season(F.col(date))})


def neighbour_features(features: DataFrame, adjacency: DataFrame, cell: str, date: str,
                       neighbour: str = "neighbour") -> DataFrame:
    """Neighbour means at the same cutoff and the share of neighbours at or above 20 mm.

    `adjacency` holds (cell, neighbour). One missing neighbour value makes that mean NULL; a missing
    value is not an event.
    """
    block = F.floor(day_number(date) / NEIGHBOUR_DAYS)
    near = features.groupBy(F.col(cell).alias(neighbour), block.alias("__block")).agg(
        F.collect_list(F.struct(F.col(date).alias("__date"), "rain_last", "mean3", "mean7")).alias("__items"))
    # days travel packed; dealt by cell and block, they are summed where they are unpacked. Where days were made by an explode the
    # optimizer counts few of them and would broadcast all
    joined = adjacency.select(cell, neighbour).join(near.hint("merge"), neighbour).select(cell, "__block", "__items").repartition(cell, "__block")
    joined = joined.select(cell, "__block", F.inline("__items"))

    def whole_mean(c):
        return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))

    means = joined.groupBy(cell, "__block", F.col("__date").alias(date)).agg(
        whole_mean("rain_last").alias("neighbor_last"), whole_mean("mean3").alias("neighbor_mean3"),
        whole_mean("mean7").alias("neighbor_mean7"),
        F.avg(F.when(F.col("rain_last") >= EVENT_MM, 1.0).otherwise(0.0)).alias("neighbor_event_fraction")).drop("__block")
    return features.join(means, [cell, date], "left")


def complete(df: DataFrame, columns: list[str]) -> Column:
    """True where every listed column is present and finite."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return ok


def dropped_rows(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(F.count_if(~F.coalesce(complete(df, columns), F.lit(False))).alias("dropped"))


def ordered_unique(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Each key once, at its first position."""
    return df.groupBy(key).agg(F.min(seq).alias(seq))


def period_means(df: DataFrame, groups: list[str], date: str, value: str,
                 periods: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean per named date window, all windows in one pass."""
    return df.groupBy(*groups).agg(*[
        F.avg(F.when(F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.col(value))).alias(name)
        for name, (a, b) in periods.items()])


def leave_one_group_out_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean over all other groups, from the table's totals less the group's own."""
    own = df.groupBy(group).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    out = attach(own, own.agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn")), [])
    left = F.col("__tn") - F.col("__n")
    return out.select(group, F.when(left > 0, (F.col("__ts") - F.col("__s")) / left).alias("prediction"),
                      F.col("__n").alias("n"))


SPELL_DAYS = 64


def dry_spells(df: DataFrame, keys: list[str], date: str, rain: str, below: float = 1.0, out: str = "dry_days", chunk: int = SPELL_DAYS) -> DataFrame:
    """df with the number of days in a row, up to and with the row's own, whose rain is under `below`.

    A wet day has 0, a missing value or date ends the spell. Keys with repeated dates are not allowed. No task holds a
    series: days lie in chunks of the calendar, a chunk tells its length, whether it is dry throughout, and the spell at its
    end, and what a spell brings along comes from these summaries.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    rows = df.withColumns({"__day": day, "__chunk": F.floor(day / chunk)})
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__day")
    before = F.coalesce(F.lag("__day").over(inside), F.col("__chunk") * chunk - 1)
    dry = F.coalesce(F.col(rain) < below, F.lit(False))
    # the last day before the spell: this one, if it is not dry, or a missing one just before
    ends = F.when(~dry, F.col("__day")).when(F.col("__day") - before > 1, F.col("__day") - 1)
    rows = rows.withColumn("__end", ends)
    rows = rows.withColumn("__from", F.max("__end").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    last = (F.col("__chunk") + 1) * chunk - 1
    sums = df.withColumns({"__day": day, "__chunk": F.floor(day / chunk)}).groupBy(*keys, "__chunk").agg(
        F.max("__day").alias("__to"), F.max(F.when(~dry, F.col("__day"))).alias("__wet"), F.collect_set("__day").alias("__days"))  # at most `chunk` numbers
    gap = F.array_max(F.filter(F.sequence((F.col("__chunk") * chunk).cast("int"), F.col("__to")), lambda d: ~F.array_contains("__days", d)))
    sums = sums.select(*keys, "__chunk", F.when(F.col("__to") < last, 0).otherwise(last - F.greatest("__wet", gap)).alias("__tail"))
    along = Window.partitionBy(*keys).orderBy("__chunk")
    alone = F.coalesce(F.lag("__chunk").over(along) != F.col("__chunk") - 1, F.lit(True))
    start = F.struct((F.col("__chunk") - 1).alias("c"), F.lit(0).cast("long").alias("v"))
    closed = F.when(F.col("__tail").isNotNull(), F.struct(F.col("__chunk").alias("c"), F.col("__tail").cast("long").alias("v")))
    sums = sums.withColumns({"__begun": F.when(alone, start), "__closed": closed})
    reset = F.greatest(F.max("__begun").over(along.rowsBetween(Window.unboundedPreceding, 0)),
                       F.max("__closed").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.withColumn("__reset", reset).select(*keys, "__chunk", ((F.col("__chunk") - 1 - F.col("__reset.c")) * chunk + F.col("__reset.v")).alias("__carry"))
    rows = attach(rows, sums, [*keys, "__chunk"])
    spell = F.when(F.col("__from").isNotNull(), F.col("__day") - F.col("__from")).otherwise(F.col("__day") - F.col("__chunk") * chunk + 1 + F.col("__carry"))
    return rows.withColumn(out, spell.cast("long")).drop("__day", "__chunk", "__end", "__from", "__carry")
