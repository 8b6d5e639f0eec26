"""Pick thresholds, candidates and splits from score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.operators.distributed import attach, exact_quantiles, require_empty


def best_threshold(sweep: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Rows that meet the constraints win over the rest, then CSI, precision, higher threshold."""
    order = F.struct("constraints_met", F.coalesce("csi", F.lit(0.0)).alias("c"),
                     F.coalesce("precision", F.lit(0.0)).alias("p"), "threshold")
    rest = [c for c in sweep.columns if c not in groups]
    return sweep.groupBy(*groups).agg(F.max_by(F.struct(*rest), order).alias("best")).select(*groups, "best.*")


def best_amount(scores: DataFrame, groups: list[str], baseline: str, fallback: str = "all",
                bias_share: float = 0.2) -> DataFrame:
    """Lowest RMSE among candidates no worse in MAE than the baseline and with a small bias.

    Where none is eligible: the lowest RMSE of all, or the baseline itself. `ord` breaks ties.
    """
    base = scores.where(F.col("candidate") == baseline).select(*groups, F.col("mae_mm").alias("base_mae"))
    rows = attach(scores, base, groups)
    ok = ((F.abs("bias_mm") <= bias_share * F.col("observed_mean_mm")) & (F.col("mae_mm") <= F.col("base_mae")))
    rows = rows.withColumn("eligible", F.coalesce(ok, F.lit(False)))
    preferred = F.col("eligible")
    if fallback == "baseline":
        last = F.when(F.col("eligible"), 0).when(F.col("candidate") == baseline, 1).otherwise(2)
    else:
        last = F.when(preferred, 0).otherwise(1)
    return rows.groupBy(*groups).agg(
        F.min_by("candidate", F.struct(last.alias("l"), F.col("rmse_mm"), F.col("ord"))).alias("selected"),
        F.bool_or("eligible").alias("constraints_met"))


def best_event(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Candidates meeting the joint target first, then CSI and precision; the earliest wins ties."""
    order = F.struct("constraints_met", F.coalesce("csi", F.lit(0.0)).alias("c"),
                     F.coalesce("precision", F.lit(0.0)).alias("p"), (-F.col("ord")).alias("o"))
    return scores.groupBy(*groups).agg(F.max_by("candidate", order).alias("selected"),
                                       F.bool_or("constraints_met").alias("joint_target_met"))


def lowest(scores: DataFrame, groups: list[str], metric: str) -> DataFrame:
    return scores.groupBy(*groups).agg(F.min_by("candidate", F.struct(metric, "ord")).alias("selected"),
                                       F.min(metric).alias(metric))


def deploy_gate(selected: DataFrame, groups: list[str], baseline: str, winner_rmse: str, baseline_rmse: str) -> DataFrame:
    """Use the winner only if it is not the baseline and beats it on the test window."""
    return selected.withColumn("deploy", (F.col("selected") != baseline) & (F.col(winner_rmse) < F.col(baseline_rmse)))


def splits(df: DataFrame, year: Column, spec: dict[str, list[int]], excluded: Column | None = None) -> DataFrame:
    """Attach the split a row's year belongs to; overlapping years are an error, excluded rows get NULL."""
    years = [y for ys in spec.values() for y in ys]
    if len(years) != len(set(years)):
        raise ValueError("Overlapping split years")
    label = F.lit(None).cast("string")
    for name, ys in spec.items():
        label = F.when(year.isin(list(ys)), F.lit(name)).otherwise(label)
    if excluded is not None:
        label = F.when(~excluded, label)
    return df.withColumn("split", label)


def class_breaks(df: DataFrame, value: Column, quantiles=(0.2, 0.4, 0.6, 0.8), default=(5.0, 20.0, 50.0, 100.0),
                 groups: list[str] = ()) -> DataFrame:
    """Class limits by the lower-index rule sorted[floor(q(n-1))]; fixed limits where no value exists."""
    names = {f"b{i + 1}": q for i, q in enumerate(quantiles)}
    found = exact_quantiles(df, list(groups), value, names, method="lower")
    if groups:
        found = df.select(*groups).distinct().join(found, list(groups), "left")
    return found.select(*groups, *[F.coalesce(F.col(n), F.lit(float(d))).alias(n) for n, d in zip(names, default)])


def uniform_value(df: DataFrame, value: str, groups: list[str] = ()) -> DataFrame:
    """The single value of a group whose present values are all equal, else NULL."""
    return df.groupBy(*groups).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias("uniform"))


def extremes(df: DataFrame, value: str, key: str, groups: list[str] = ()) -> DataFrame:
    """Rows with the lowest and highest value (smallest key on ties) and the spread."""
    return df.groupBy(*groups).agg(
        F.min_by(key, F.struct(value, key)).alias("lowest_key"), F.min(value).alias("lowest"),
        F.min_by(key, F.when(F.col(value).isNotNull(), F.struct(-F.col(value), F.col(key)))).alias("highest_key"), F.max(value).alias("highest"),
        (F.max(value) - F.min(value)).alias("spread"))


def target_guard(df: DataFrame, target: str, minimum_variance: float = 1e-12, strict: bool = False) -> DataFrame:
    """One row: size, non-finite count, population variance and whether training may start."""
    x = F.col(target).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("non_finite"),
                 F.var_pop(F.when(~bad, x)).alias("variance"))
    out = out.withColumn("trainable", (F.col("n") > 0) & (F.col("non_finite") == 0)
                         & F.coalesce(F.col("variance") >= minimum_variance, F.lit(False)))
    if strict:
        require_empty(out.where(~F.col("trainable")), f"Cannot train on target {target}")
    return out
