"""Spread parent values onto children while conserving the weighted parent mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rainweave.functions.numeric import LAPSE_RATE_C_PER_M, half_even
from rainweave.operators.distributed import attach, require_empty


def expand_parent(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Every parent row for every child of that parent.

    A plain equi-join: the optimizer broadcasts a side only when its measured size allows, and
    adaptive execution splits a parent that owns most of the children.
    """
    return children.join(parents, on, "inner")


def lookup(children: DataFrame, adjustments: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """Attach one adjustment row per child; with `strict`, a missing adjustment is an error."""
    if strict:
        require_empty(children.join(adjustments, on, "left_anti"), "Missing adjustment")
    return children.join(adjustments, on, "inner")


def conserving_factor(df: DataFrame, parent: list[str], value: str, weight: str, elevation: str | None = None,
                      prefix: str = "", lapse: float = LAPSE_RATE_C_PER_M) -> DataFrame:
    """Multiplicative factor whose weighted parent mean is one, and a lapse-rate offset.

    The factor is 1 where the parent's weighted mean is not positive.
    """
    w = F.col(weight)
    aggs = [(F.sum(F.col(value) * w) / F.sum(w)).alias("__ref")]
    if elevation:
        aggs.append((F.sum(F.col(elevation) * w) / F.sum(w)).alias(f"{prefix}reference_elevation_m"))
    refs = df.groupBy(*parent).agg(*aggs)
    out = attach(df, refs, parent)
    out = out.withColumn(f"{prefix}rainfall_factor",
                         F.when(F.col("__ref") > 0, F.col(value) / F.col("__ref")).otherwise(F.lit(1.0)))
    if elevation:
        out = out.withColumn(f"{prefix}temperature_adjustment_c",
                             lapse * (F.col(elevation) - F.col(f"{prefix}reference_elevation_m")))
    return out.drop("__ref")


def localise(df: DataFrame, factor: str, delta: str, rain: str = "rainfall_mm",
             temperatures: tuple[str, ...] = ("temp_max_c", "temp_min_c"),
             inherited: tuple[str, ...] = (), level: str = "block", status_map: bool = True) -> DataFrame:
    """Child values from parent values: scaled rain, shifted temperatures, the rest inherited.

    Missing parent values stay NULL and a zero parent stays zero.
    """
    local = {f"local_{rain}": half_even(F.col(rain) * F.col(factor), 4)}
    local.update({f"local_{t}": half_even(F.col(t) + F.col(delta), 2) for t in temperatures})
    local.update({f"local_{c}": F.col(c) for c in inherited})
    out = df.withColumns(local)
    out = out.withColumn("adjustment_mm", half_even(F.col(f"local_{rain}") - F.col(rain), 4))
    if status_map:
        def status(c, text):
            return F.when(F.col(c).isNotNull(), F.lit(text)).otherwise(F.lit("unavailable"))
        names = [rain, *temperatures, *inherited]
        texts = [F.lit("experimental proxy-climatology transfer; local skill unverified")]
        texts += [status(t, "experimental DEM lapse-rate adjustment") for t in temperatures]
        texts += [status(c, f"inherited {level} forecast") for c in inherited]
        out = out.withColumn("variable_status",
                             F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*texts)))
    return out


def decompose(df: DataFrame, groups: list[str], value: str, mean_digits: int = 2, deviation_digits: int = 2,
              prefix: str = "") -> DataFrame:
    """Value = rounded group mean + rounded deviation from that rounded mean."""
    mean, deviation = f"{prefix}group_mean", f"{prefix}deviation"
    means = df.groupBy(*groups).agg(half_even(F.avg(value), mean_digits).alias(mean))
    return attach(df, means, groups).withColumn(
        deviation, half_even(F.col(value) - F.col(mean), deviation_digits))


def reconstruct(parent, deviation, residual=0.0):
    parent, deviation = F.col(parent), F.col(deviation)
    residual = F.col(residual) if isinstance(residual, str) else F.lit(residual)
    return F.greatest(F.lit(0.0), half_even(parent + deviation + residual, 2))
