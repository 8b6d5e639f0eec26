"""Exact pairing of forecast and observation intervals; never by tolerance or date alone."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.functions.numeric import finite
from rainweave.operators.distributed import attach, duplicate_keys, require_empty

KEY = ["location_id", "support_id", "valid_start", "valid_end"]
TARGET_KINDS = ("independent_gauge", "gauge_based_gridded_analysis")


class Aligned(NamedTuple):
    pairs: DataFrame
    unmatched: DataFrame
    bad_forecasts: DataFrame
    bad_observations: DataFrame


def _copies(df: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """`__copies` on rows whose key repeats, NULL on all others, so that only repeated keys are joined back."""
    keys = df.select(*key).repartition(parts, *key) if parts else df
    return attach(df, duplicate_keys(keys, key).withColumnRenamed("copies", "__copies"), key)


def _with_reasons(df: DataFrame, key: list[str], rules: dict[str, Column | None], parts: int | None = None) -> DataFrame:
    """`reasons` in the order of `rules`; the rule without a condition holds for rows whose key repeats.

    The others are judged before repeated keys are joined back, so that the columns they read need not be sorted for it.
    """
    flags = {text: f"__bad{i}" for i, text in enumerate(rules)}
    rows = _copies(df.withColumns({flags[text]: F.coalesce(bad, F.lit(True)) for text, bad in rules.items() if bad is not None}), key, parts)
    return rows.withColumn("reasons", F.array_compact(F.array(*[
        F.when(F.col("__copies").isNotNull() if bad is None else F.col(flags[text]), F.lit(text)) for text, bad in rules.items()]))).drop(
        "__copies", *flags.values())


def check_observations(obs: DataFrame, target_kinds=TARGET_KINDS) -> DataFrame:
    return _with_reasons(obs, KEY, {
        "unverified target kind": ~F.col("target_kind").isin(list(target_kinds)),
        "invalid observation interval": F.col("valid_end") <= F.col("valid_start"),
        "duplicate observation interval": None,
        "source hash required": F.length("source_sha256") != 64,
        "invalid observed rain": ~finite("rainfall_mm") | (F.col("rainfall_mm") < 0)})


def check_forecasts(fc: DataFrame, features: str | None = None, parts: int | None = None) -> DataFrame:
    """No forecast may use what was not available before its window starts."""
    identity = ["source", "location_id", "support_id", "issued_at", "valid_start", "valid_end"]
    rules = {
        "not available before accumulation starts": (F.col("valid_end") <= F.col("valid_start"))
        | (F.col("issued_at") > F.col("valid_start")) | (F.col("available_at") > F.col("valid_start")),
        "availability predates issue": F.col("available_at") < F.col("issued_at"),
        "source hash required": F.length("source_sha256") != 64,
        "invalid forecast rain": ~finite("rainfall_mm") | (F.col("rainfall_mm") < 0),
        "duplicate forecast": None}
    if features:
        rules["future feature leakage"] = F.coalesce(
            F.exists(features, lambda f: f["available_at"] > F.col("available_at")), F.lit(False))
    return _with_reasons(fc, identity, rules, parts)


def align(forecasts: DataFrame, observations: DataFrame, features: str | None = None, strict: bool = False,
          parts: int | None = None) -> Aligned:
    """Pairs on location, support, start and end with lead hours, the unmatched, and the rejected.

    Both sides meet dealt by key over `parts` tasks, so that a task's memory need not grow with the tables; without it the
    session's shuffle partitions decide. Observations are expected to come dealt by location and start already.
    """
    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *KEY) if parts else df

    fc, obs = check_forecasts(forecasts, features, parts), check_observations(observations)
    bad_fc, bad_obs = fc.where(F.size("reasons") > 0), obs.where(F.size("reasons") > 0)
    if strict:
        require_empty(bad_obs, "Invalid observation")
        require_empty(bad_fc, "Invalid forecast")
    fc = dealt(fc.where(F.size("reasons") == 0).drop("reasons"))
    obs = dealt(obs.where(F.size("reasons") == 0).select(
        *KEY, "target_kind", F.col("source_sha256").alias("observed_sha256"), F.col("rainfall_mm").alias("observed_mm")))
    # In microseconds so a half-hour lead keeps its fraction.
    lead = F.timestamp_diff("MICROSECOND", F.col("issued_at"), F.col("valid_start")) / 3.6e9
    return Aligned(fc.join(obs, KEY).withColumn("lead_hours", lead), fc.join(obs.select(*KEY), KEY, "left_anti"),
                   bad_fc, bad_obs)


def readiness(forecasts: DataFrame, observations: DataFrame, aligned: Aligned) -> DataFrame:
    """One row: issue dates, record counts, observation years and the number of exact pairs."""
    fc = forecasts.agg(F.countDistinct(F.col("issued_at").cast("date")).alias("issue_dates"),
                       F.count(F.lit(1)).alias("forecasts"))
    obs = observations.agg(F.count(F.lit(1)).alias("observations"),
                           F.countDistinct(F.year("valid_start")).alias("observation_years"))
    pairs = aligned.pairs.agg(F.count(F.lit(1)).alias("exact_pairs"))
    return attach(attach(fc, obs, []), pairs, [])
