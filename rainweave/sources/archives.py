"""Archived forecast rows: subset, unit gate and response receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def forecast_subset(steps: DataFrame, cells: DataFrame, run: Column, lead: str, last_lead: int, variables: list[str],
                    lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One run's steps up to the last lead for exactly the given cells and variables.

    The run and lead conditions reach the scan; the box of the cells prunes row groups before the
    exact coordinate join.
    """
    box = cells.agg(F.min(lat).alias("a"), F.max(lat).alias("b"), F.min(lon).alias("c"), F.max(lon).alias("d"))
    low = box.select(F.struct("a", "b", "c", "d")).scalar()
    keys = [c for c in steps.columns if c not in (lat, lon) and c not in variables]
    picked = steps.where(run & F.col(lead).between(0, last_lead)).select(*keys, lat, lon, *variables)
    picked = picked.where(F.col(lat).between(low["a"], low["b"]) & F.col(lon).between(low["c"], low["d"]))
    return picked.join(cells, [lat, lon])


def unit_violations(metadata: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Variables whose units differ from the expected ones, and expected variables that are absent.

    The input must be empty of violations before any value is used.
    """
    wanted = F.lit(None).cast("string")
    for name, units in expected.items():
        wanted = F.when(F.col("variable") == name, units).otherwise(wanted)
    found = metadata.withColumn("expected", wanted).where(F.col("expected").isNotNull())
    wrong = found.where(~F.col("units").eqNullSafe(F.col("expected"))).select("variable", "units", "expected")
    present = found.agg(F.collect_set("variable").alias("present"))  # expected names only
    names = F.array(*[F.struct(F.lit(n).alias("variable"), F.lit(None).cast("string").alias("units"),
                               F.lit(u).alias("expected")) for n, u in expected.items()])
    absent = present.select(F.inline(F.filter(names, lambda x: ~F.array_contains("present", x["variable"]))))
    return wrong.unionByName(absent)


def receipt_matches(header, date, requested) -> Column:
    """Does the response's file name encode the requested day?"""
    name = F.concat(F.lit("rain_ind0.25_"), F.date_format(requested, "yy_MM_dd"), F.lit(".grd"))
    return F.coalesce(F.contains(header, name) & (date == requested), F.lit(False))
