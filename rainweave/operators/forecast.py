"""Forecast runs: lead axis, accumulation windows, window features and observation pairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.operators.distributed import require_empty
from rainweave.operators.series import season


class Axis(NamedTuple):
    """Native steps: `fine` hours up to `change`, `coarse` hours after it."""

    change: int = 120
    fine: int = 1
    coarse: int = 3


class Timing(NamedTuple):
    init_hour: int = 0
    decision_delay: int = 12
    first_start: int = 27
    window: int = 24
    leads: tuple[int, ...] = (1, 2, 3, 4, 5)
    end_hour: int = 3


def step_width(lead: Column, axis: Axis = Axis()) -> Column:
    """Hours the rate at a step stands for: it covers (previous step, step]."""
    return F.when(lead <= axis.change, axis.fine).otherwise(axis.coarse)


def axis_check(df: DataFrame, run: list[str], lead: str, axis: Axis = Axis(), strict: bool = False) -> DataFrame:
    """Per run: does the lead axis follow the native steps without a gap?

    Counts decide: every part of the axis must hold as many distinct steps as its ends imply.
    """
    steps = df.select(*run, F.col(lead).cast("long").alias("h")).distinct()
    fine, h = F.col("h") <= axis.change, F.col("h")
    g = steps.groupBy(*run).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(fine).alias("nf"), F.min(F.when(fine, h)).alias("f0"),
        F.max(F.when(fine, h)).alias("f1"), F.count_if(~fine).alias("nc"), F.min(F.when(~fine, h)).alias("c0"),
        F.max(F.when(~fine, h)).alias("c1"), F.min(F.when(~fine, h % axis.coarse)).alias("r0"),
        F.max(F.when(~fine, h % axis.coarse)).alias("r1"))
    fine_ok = (F.col("nf") == 0) | (F.col("nf") == (F.col("f1") - F.col("f0")) / axis.fine + 1)
    coarse_ok = (F.col("nc") == 0) | ((F.col("r0") == F.col("r1"))
                                      & (F.col("nc") == (F.col("c1") - F.col("c0")) / axis.coarse + 1))
    joined = (F.col("nf") == 0) | (F.col("nc") == 0) | (F.col("c0") - F.col("f1") == axis.coarse)
    out = g.select(*run, "steps", ((F.col("steps") >= 2) & fine_ok & coarse_ok & joined).alias("native"))
    if strict:
        require_empty(out.where(~F.col("native")), "Missing native forecast step")
    return out


def window_times(inits: DataFrame, init: str, timing: Timing = Timing()) -> DataFrame:
    """Decision, start and end of every lead's accumulation window, and whether they are valid."""
    at = F.col(init)
    rows = inits.withColumn("lead", F.explode(F.array(*[F.lit(x) for x in timing.leads])))

    def hours(h):
        return F.make_dt_interval(F.lit(0), h)

    start = at + hours(timing.first_start + timing.window * (F.col("lead") - 1))
    rows = rows.withColumns({"decision": at + hours(F.lit(timing.decision_delay)), "window_start": start})
    rows = rows.withColumn("window_end", F.col("window_start") + hours(F.lit(timing.window)))
    on_cycle = (F.hour(at) == timing.init_hour) & (F.minute(at) == 0) & (F.second(at) == 0)
    return rows.withColumn("valid", on_cycle & (F.col("decision") <= F.col("window_start"))
                           & (F.hour("window_end") == timing.end_hour))


def lead_day(lead: Column, timing: Timing = Timing()) -> Column:
    """The lead whose window (start, end] holds a step; NULL outside all windows."""
    day = (F.ceil((lead - timing.first_start) / timing.window)).cast("int")
    return F.when((lead > timing.first_start) & day.isin(list(timing.leads)), day)


def integrate(df: DataFrame, keys: list[str], lead: str, rate: str, start: int, end: int,
              axis: Axis = Axis()) -> DataFrame:
    """Amount over (start, end] from rates per second; NULL unless the steps cover it exactly."""
    h = F.col(lead)
    inside = (h > start) & (h <= end)
    w = step_width(h, axis)
    out = df.where((h >= start) & (h <= end)).groupBy(*keys).agg(
        F.sum(F.when(inside, F.col(rate) * w * 3600)).alias("amount"),
        F.coalesce(F.sum(F.when(inside, w)), F.lit(0)).alias("covered"),
        F.count_if(inside & F.col(rate).isNull()).alias("missing"),
        (F.count_if(h == start) > 0).alias("has_start"), (F.count_if(h == end) > 0).alias("has_end"),
        F.count_if(F.col(rate) < 0).alias("negative"))
    whole = ((F.col("covered") == end - start) & F.col("has_start") & F.col("has_end")
             & (F.col("missing") == 0) & (F.col("negative") == 0))
    return out.select(*keys, F.when(whole, F.col("amount")).alias("amount"), "covered", "negative")


def window_features(df: DataFrame, keys: list[str], lead: str, rate: str, pwat: str, rh: str,
                    timing: Timing = Timing(), axis: Axis = Axis()) -> DataFrame:
    """All lead windows of all runs in one aggregation: rain, peak rate, wet share and moisture.

    A missing value inside a window makes its features NULL; so does a gap in its coverage.
    """
    h = F.col(lead)
    rows = df.withColumns({"lead_day": lead_day(h, timing), "__w": step_width(h, axis)})
    rows = rows.where(F.col("lead_day").isNotNull())
    w, r, p, q = F.col("__w"), F.col(rate), F.col(pwat), F.col(rh)
    g = rows.groupBy(*keys, "lead_day").agg(
        F.sum(w).alias("__cover"), F.count_if(r.isNull() | p.isNull() | q.isNull()).alias("__gaps"),
        F.count_if((r < 0) | (p < 0) | (q < 0) | (q > 100)).alias("unphysical"),
        F.sum(r * w * 3600).alias("rain_mm"), (F.max(r) * 3600).alias("max_step_rate_mmh"),
        (F.coalesce(F.sum(F.when(r * 3600 >= 1, w)), F.lit(0)) / timing.window).alias("rain_hours_fraction"),
        (F.sum(p * w) / F.sum(w)).alias("pwat_mean"), (F.sum(q * w) / F.sum(w)).alias("rh_mean"),
        F.max(q).alias("rh_max"))
    whole = (F.col("__cover") == timing.window) & (F.col("__gaps") == 0)
    names = ["rain_mm", "max_step_rate_mmh", "rain_hours_fraction", "pwat_mean", "rh_mean", "rh_max"]
    return g.select(*keys, "lead_day", "unphysical", whole.alias("complete"),
                    *[F.when(whole, F.col(n)).alias(n) for n in names])


def neighbour_rain(features: DataFrame, adjacency: DataFrame, cell: str, run: list[str],
                   neighbour: str = "neighbour") -> DataFrame:
    """Mean and maximum rain of the neighbouring cells in the same run and window."""
    near = features.select(F.col(cell).alias(neighbour), *run, "rain_mm")
    g = adjacency.select(cell, neighbour).join(near, neighbour).groupBy(cell, *run).agg(
        F.when(F.count("rain_mm") == F.count(F.lit(1)), F.avg("rain_mm")).alias("neighbor_rain_mean"),
        F.when(F.count("rain_mm") == F.count(F.lit(1)), F.max("rain_mm")).alias("neighbor_rain_max"))
    return features.join(g, [cell, *run], "left")


def end_season(df: DataFrame, window_end: str) -> DataFrame:
    return df.withColumns(season(F.col(window_end)))


class Collocated(NamedTuple):
    pairs: DataFrame
    missing_dates: DataFrame


def collocate(features: DataFrame, observations: DataFrame, date: str, cell: str, strict: bool = False) -> Collocated:
    """Forecast features and the analysis of the same date and cell; dates without analysis are listed."""
    lost = features.select(date).distinct().join(observations.select(date).distinct(), date, "left_anti")
    if strict:
        require_empty(lost, "Missing observation date")
    return Collocated(features.join(observations, [date, cell]), lost)


def initialization_dates(years: DataFrame, year: str, start: str = "05-31", end: str = "10-25", stride: int = 5) -> DataFrame:
    """Every `stride` days between two month-days of each year."""
    def on(md):
        m, d = (int(x) for x in md.split("-"))
        return F.make_date(F.col(year), F.lit(m), F.lit(d))
    return years.select(year, F.explode(F.sequence(on(start), on(end), F.make_dt_interval(F.lit(stride)))).alias("init_date"))


def observation_dates(inits: DataFrame, init: str, leads: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Dates whose analysis a set of runs needs."""
    day = F.explode(F.array(*[F.date_add(F.col(init).cast("date"), x + 1) for x in leads]))
    return inits.select(day.alias("date")).distinct()


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
