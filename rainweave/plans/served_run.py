"""A served run in one go: local values of linked villages, their coverage, publication, activation and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainweave.operators import allocation, runs


def build(forecast: DataFrame, villages: DataFrame, run_id: str, inherited: tuple[str, ...] = ("humidity_pct",), parent: str = "block_id") -> DataFrame:
    """Local values of every village whose parent has a forecast, with the parent's values beside them.

    `villages` holds one row per linked village with its parent, rainfall_factor and temperature_adjustment_c.
    """
    source = [c for c in forecast.columns if c not in (parent, "valid_date")]
    rows = allocation.localise(allocation.expand_parent(villages, forecast, [parent]), "rainfall_factor", "temperature_adjustment_c", inherited=inherited, status_map=False)
    return rows.select("village_id", parent, "valid_date", F.lit(run_id).alias("run_id"), *[F.col(c).alias(f"source_{c}") for c in source],
                       *[c for c in rows.columns if c.startswith("local_")], "adjustment_mm")


def coverage(rows: DataFrame, blocks: DataFrame, parent: str = "block_id") -> DataFrame:
    """valid_date, available, expected, missing, linked_villages: parents with local values on each date, of the expected ones."""
    wanted = blocks.select(parent).distinct()
    have = rows.groupBy("valid_date", parent).agg(F.count(F.lit(1)).alias("linked"))
    seen = have.join(wanted, parent, "left_semi").groupBy("valid_date").agg(F.count(F.lit(1)).alias("available"), F.sum("linked").alias("linked_villages"))
    total = wanted.agg(F.count(F.lit(1)).alias("expected"))
    return seen.join(total).select("valid_date", "available", "expected", (F.col("expected") - F.col("available")).alias("missing"), "linked_villages")


def publish(rows: DataFrame, path: str, run_id: str, issue: str | None = None) -> str:
    """Writes a run by date and, with an issue date, activates it once its rows are complete; whether it was new."""
    state = runs.write_run(rows, path, run_id, ["valid_date"])
    if issue is not None:
        runs.activate(rows.sparkSession, path, run_id, issue)
    return state


def request(spark: SparkSession, path: str, valid_date: str, block_id=None, strict: bool = False) -> DataFrame:
    """Rows of the default run on one date and optionally in one block; with strict, none is an error."""
    out = runs.served(spark, path).where(F.col("valid_date") == F.lit(valid_date).cast("date"))
    if block_id is not None:
        out = out.where(F.col("block_id") == block_id)
    if strict and out.isEmpty():
        raise ValueError("No linked forecasts for the selected run and date")
    return out

