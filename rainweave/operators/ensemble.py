"""Ensemble spread, block bootstrap and soft reconciliation of children with their parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.functions.numeric import ratio
from rainweave.operators.distributed import attach, ordinal, running_sums
from rainweave.session import cut_lineage


def member_factors(members: int = 30, scale: float = 0.18) -> list[float]:
    """Forcing factors of the members, one fixed normal draw each (seed 42 + 7m)."""
    import numpy as np
    return [float(np.random.RandomState(42 + 7 * m).normal(1.0, scale)) for m in range(members)]


def ensemble(df: DataFrame, parent: str, deviation: str, residual: str, noise_scale: str, factors: list[float],
             noises: list[float], noise_share: float = 0.08) -> DataFrame:
    """`members`: max(0, parent * factor + deviation + residual + noise) for every member.

    The member list is short and fixed, so it stays inside the row and nothing is shuffled.
    """
    pairs = F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(float(z)).alias("z")) for f, z in zip(factors, noises)])
    value = F.transform(pairs, lambda m: F.greatest(F.lit(0.0), F.col(parent) * m["f"] + F.col(deviation)
                                                    + F.col(residual) + noise_share * F.col(noise_scale) * m["z"]))
    return df.withColumn("members", value)


def array_quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation between neighbouring ranks of a sorted array."""
    pos = F.lit(float(q)) * (F.size(sorted_values) - 1)
    low = F.floor(pos).cast("int")
    a = F.element_at(sorted_values, low + 1)
    b = F.element_at(sorted_values, F.least(low + 2, F.size(sorted_values)))
    return a + (b - a) * (pos - low)


def ensemble_summary(df: DataFrame, members: str = "members", digits: int = 2) -> DataFrame:
    """Mean, population deviation, 80 and 95 % limits and a confidence grade from the raw deviation."""
    m = F.col(members)
    n = F.size(m)
    df = df.withColumn("__sorted", F.array_sort(m))
    df = df.withColumn("__mean", F.aggregate(m, F.lit(0.0), lambda a, x: a + x) / n)
    df = df.withColumn("__std", F.sqrt(F.aggregate(m, F.lit(0.0), lambda a, x: a + F.pow(x - F.col("__mean"), F.lit(2))) / n))
    limits = {"ci_lower_80": 0.1, "ci_upper_80": 0.9, "ci_lower_95": 0.025, "ci_upper_95": 0.975}
    df = df.withColumns({"ensemble_mean": F.bround("__mean", digits), "uncertainty_std": F.bround("__std", digits),
                         **{k: F.bround(array_quantile(F.col("__sorted"), q), digits) for k, q in limits.items()},
                         "confidence_level": F.when(F.col("__std") < 3, "HIGH").when(F.col("__std") < 7, "MODERATE").otherwise("LOW")})
    return df.drop("__sorted", "__mean", "__std")


def hashed_start(rep: Column, draw: Column, seed: int, size: Column) -> Column:
    text = F.concat_ws("|", rep.cast("string"), draw.cast("string"), F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long"), size)


def bootstrap_counts(counts: DataFrame, unit: str, fields: list[str], reps: int = 500, block: int = 2,
                     seed: int = 42) -> DataFrame:
    """Summed counts of each replicate: circular blocks of adjacent units, drawn by hash.

    Units keep everything that happened in them together. A replicate has as many units as the
    table; the draws come from exploding the units themselves. The per-unit counts are written
    once, since numbering, drawing and summing all read them.
    """
    counts = cut_lineage(counts.select(unit, *fields))
    place = ordinal(counts, F.col(unit), "__idx")
    rows = counts.withColumn("value", F.col(unit)).join(place, "value").drop("value")
    rows = attach(rows, rows.agg(F.count(F.lit(1)).alias("__size")), [])
    draws = rows.where(F.col("__idx") < F.ceil(F.col("__size") / block)).select(
        F.col("__idx").alias("draw"), "__size", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.withColumn("start", hashed_start(F.col("rep"), F.col("draw"), seed, F.col("__size")))
    draws = draws.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    draws = draws.where(F.col("draw") * block + F.col("off") < F.col("__size"))
    picks = draws.groupBy("rep", F.pmod(F.col("start") + F.col("off"), F.col("__size")).alias("__idx")).agg(
        F.count(F.lit(1)).alias("__times"))
    return picks.join(rows.select("__idx", *fields), "__idx").groupBy("rep").agg(
        *[F.sum(F.col(f) * F.col("__times")).alias(f) for f in fields])


def bootstrap_intervals(counts: DataFrame, unit: str, reps: int = 500, block: int = 2, seed: int = 42) -> DataFrame:
    """95 % limits of recall, precision and CSI over the replicates; undefined ratios are ignored."""
    fields = ["hits", "misses", "false_alarms"]
    sums = bootstrap_counts(counts, unit, fields, reps, block, seed)
    h, m, f = (F.col(c) for c in fields)
    scores = F.array(*[F.struct(F.lit(n).alias("score"), c.alias("x")) for n, c in (
        ("recall", ratio(h, h + m)), ("precision", ratio(h, h + f)), ("csi", ratio(h, h + m + f)))])
    # One value per replicate and score.
    return sums.select(F.inline(scores)).groupBy("score").agg(
        F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"), F.count("x").alias("defined"))


def reconcile(children: DataFrame, parents: DataFrame, group: list[str], value: str, area: str, weight: str,
              target: str, target_weight: str) -> DataFrame:
    """Non-negative child values closest to their estimates and, softly, to the parent's estimate.

    Minimises sum w_i (x_i - b_i)^2 + w_d (sum a_i x_i - d)^2 with a normalised per group. The
    solution is max(0, b_i + lambda a_i / w_i): lambda follows from the running sums up to the last
    breakpoint below it, found from bucketed running sums instead of one sorted group.
    """
    total = children.groupBy(*group).agg(F.sum(area).alias("__area"))
    rows = attach(children, total, group).withColumn("__a", F.col(area) / F.col("__area"))
    b, w, a = F.col(value), F.col(weight), F.col("__a")
    sums = running_sums(rows, group, -b * w / a, {"ab": a * b, "aa": a * a / w}, "__t")
    sums = attach(sums, parents.select(*group, F.col(target).alias("__d"), F.col(target_weight).alias("__wd")), group, "inner")
    lam = F.col("__wd") * (F.col("__d") - F.col("cum_ab")) / (1 + F.col("__wd") * F.col("cum_aa"))
    best = sums.withColumn("__lam", lam).where(F.col("__t") < F.col("__lam")).groupBy(*group).agg(
        F.max_by("__lam", "__t").alias("__lam"))
    out = attach(rows, best, group)
    out = out.withColumn("reconciled", F.greatest(F.lit(0.0), b + F.coalesce("__lam", F.lit(0.0)) * a / w))
    district = out.groupBy(*group).agg(F.sum(a * F.col("reconciled")).alias("parent_value"))
    return attach(out, district, group).drop("__area", "__a", "__lam")


def reconcile_rules(value: str, area: str, weight: str) -> dict[str, Column]:
    """Rows that must not enter the reconciliation."""
    from rainweave.functions.numeric import finite
    return {"Invalid block values/areas": ~finite(value) | (F.col(value) < 0) | ~finite(area) | (F.col(area) <= 0),
            "Positive finite error weights required": ~finite(weight) | (F.col(weight) <= 0)}
