"""Event and amount verification, threshold sweeps and probability scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.functions.numeric import floored_ratio, ratio
from rainweave.operators.distributed import attach, running_sums

EVENT_MM = 20.0


def _ratios(h: Column, m: Column, f: Column, c: Column) -> dict[str, Column]:
    return {"observed_events": h + m, "alerts": h + f, "recall": ratio(h, h + m), "precision": ratio(h, h + f),
            "false_alarm_ratio": ratio(f, h + f), "false_positive_rate": ratio(f, f + c),
            "csi": ratio(h, h + m + f)}


def contingency(df: DataFrame, observed: Column, alert: Column, groups: list[str] = ()) -> DataFrame:
    """Hits, misses, false alarms, correct negatives and their ratios (NULL on 0/0)."""
    counts = df.groupBy(*groups).agg(
        F.count_if(observed & alert).alias("hits"), F.count_if(observed & ~alert).alias("misses"),
        F.count_if(~observed & alert).alias("false_alarms"), F.count_if(~observed & ~alert).alias("correct_negatives"))
    return counts.withColumns(_ratios(*[F.col(c) for c in ("hits", "misses", "false_alarms", "correct_negatives")]))


def amounts(df: DataFrame, observed: Column, predicted: Column, groups: list[str] = (),
            threshold: float = EVENT_MM) -> DataFrame:
    """Size, absolute and squared error, bias, both means and the event scores at the threshold."""
    rows = df.select(*groups, observed.cast("double").alias("y"), predicted.cast("double").alias("p"))
    y, p = F.col("y"), F.col("p")
    e, oy, op = p - y, y >= threshold, p >= threshold
    out = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae_mm"), F.sqrt(F.avg(e * e)).alias("rmse_mm"),
        F.avg(e).alias("bias_mm"), F.avg(y).alias("observed_mean_mm"), F.avg(p).alias("predicted_mean_mm"),
        F.avg(F.when(oy, F.abs(e))).alias("heavy_mae_mm"),
        F.count_if(oy & op).alias("hits"), F.count_if(oy & ~op).alias("misses"),
        F.count_if(~oy & op).alias("false_alarms"), F.count_if(~oy & ~op).alias("correct_negatives"))
    return out.withColumns(_ratios(*[F.col(c) for c in ("hits", "misses", "false_alarms", "correct_negatives")]))


def floored_scores(df: DataFrame, observed: Column, predicted: Column, threshold: float,
                   groups: list[str] = (), digits: int = 3) -> DataFrame:
    """POD, FAR and CSI with the floor 1e-4 under each denominator."""
    o, p = observed >= threshold, predicted >= threshold
    counts = df.groupBy(*groups).agg(F.count_if(o & p).alias("h"), F.count_if(~o & p).alias("f"),
                                     F.count_if(o & ~p).alias("m"))
    h, f, m = F.col("h"), F.col("f"), F.col("m")
    return counts.select(*groups, F.bround(floored_ratio(h, h + m), digits).alias("pod"),
                         F.bround(floored_ratio(f, h + f), digits).alias("far"),
                         F.bround(floored_ratio(h, h + m + f), digits).alias("csi"))


def segment_skill(df: DataFrame, truth: str, model: str, naive: str, segments: Column,
                  thresholds: tuple[float, ...] = (0.1, 20.0)) -> DataFrame:
    """Model against a naive baseline for every segment label a row belongs to."""
    rows = df.select(F.explode(segments).alias("segment"), *[F.col(c).cast("double").alias(a) for c, a in
                                                             ((truth, "t"), (model, "m"), (naive, "b"))])
    t = F.col("t")
    aggs = [F.count(F.lit(1)).alias("sample_size")]
    for side in ("m", "b"):
        e = F.col(side) - t
        aggs += [F.sqrt(F.avg(e * e)).alias(f"rmse_{side}"), F.avg(F.abs(e)).alias(f"mae_{side}"),
                 F.corr(t, F.col(side)).alias(f"r_{side}")]
        for i, x in enumerate(thresholds):
            o, p = t >= x, F.col(side) >= x
            aggs += [F.count_if(o & p).alias(f"h_{side}{i}"), F.count_if(~o & p).alias(f"f_{side}{i}"),
                     F.count_if(o & ~p).alias(f"s_{side}{i}")]
    g = rows.groupBy("segment").agg(*aggs)
    cols = ["segment", "sample_size"]
    for name in ("rmse", "mae"):
        m, b = F.col(f"{name}_m"), F.col(f"{name}_b")
        cols += [F.bround(m, 2).alias(f"model_{name}"), F.bround(b, 2).alias(f"naive_{name}"),
                 F.bround((b - m) / F.greatest(F.lit(1e-4), b) * 100, 2).alias(f"{name}_improvement_pct")]
    for side, label in (("m", "model"), ("b", "naive")):
        cols.append(F.bround(f"r_{side}", 3).alias(f"pearson_{label}"))
        for i in range(len(thresholds)):
            h, f, s = (F.col(f"{k}_{side}{i}") for k in "hfs")
            cols += [F.bround(floored_ratio(h, h + s), 3).alias(f"pod_{label}_{i}"),
                     F.bround(floored_ratio(f, h + f), 3).alias(f"far_{label}_{i}"),
                     F.bround(floored_ratio(h, h + s + f), 3).alias(f"csi_{label}_{i}")]
    return g.select(*cols)


def threshold_sweep(df: DataFrame, observed: Column, probability: Column, thresholds: list[float],
                    groups: list[str] = (), minimum_recall: float = 0.5, minimum_precision: float = 0.5,
                    maximum_false_positive_rate: float = 0.25) -> DataFrame:
    """Event scores at every threshold and whether the constraints hold.

    Each row is counted once, in the bucket between two neighbouring thresholds; the scores come
    from the few buckets, so rows are never multiplied by thresholds.
    """
    levels = sorted(thresholds)
    bucket = sum((F.when(probability >= t, 1).otherwise(0) for t in levels), F.lit(0))
    hist = (df.select(*groups, observed.alias("o"), bucket.alias("b")).groupBy(*groups, "b")
            .agg(F.count_if("o").alias("pos"), F.count_if(~F.col("o")).alias("neg")))
    # At most len(thresholds) + 1 buckets per group.
    packed = hist.groupBy(*groups).agg(F.collect_list(F.struct("b", "pos", "neg")).alias("buckets"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(float(t)).alias("threshold"))
                     for i, t in enumerate(levels)])
    rows = packed.select(*groups, "buckets", F.inline(grid))

    def total(field, above):
        def add(acc, x):
            inside = x["b"] >= F.col("rank")
            return acc + F.when(inside if above else ~inside, x[field]).otherwise(F.lit(0).cast("long"))
        return F.aggregate("buckets", F.lit(0).cast("long"), add)

    rows = rows.select(*groups, "threshold", total("pos", True).alias("hits"), total("pos", False).alias("misses"),
                       total("neg", True).alias("false_alarms"), total("neg", False).alias("correct_negatives"))
    rows = rows.withColumns(_ratios(*[F.col(c) for c in ("hits", "misses", "false_alarms", "correct_negatives")]))
    return rows.withColumn("constraints_met", meets(minimum_recall, minimum_precision, maximum_false_positive_rate))


def meets(minimum_recall: float, minimum_precision: float, maximum_false_positive_rate: float) -> Column:
    zero = F.lit(0.0)
    return ((F.coalesce(F.col("recall"), zero) >= minimum_recall)
            & (F.coalesce(F.col("precision"), zero) >= minimum_precision)
            & F.coalesce(F.col("false_positive_rate") <= maximum_false_positive_rate, F.lit(False)))


def brier(df: DataFrame, event: Column, probability: Column, groups: list[str] = ()) -> DataFrame:
    """Brier score, and that of a constant forecast at the observed frequency."""
    o = event.cast("double")
    return df.groupBy(*groups).agg(F.avg(F.pow(probability - o, 2)).alias("brier"),
                                   F.avg(o).alias("event_frequency")).withColumn(
        "climatology_brier", F.col("event_frequency") * (1 - F.col("event_frequency")))


def average_precision(df: DataFrame, event: Column, score: Column, groups: list[str] = ()) -> DataFrame:
    """Precision at each distinct score times the recall it adds; tied scores count once."""
    groups = list(groups)
    ranked = running_sums(df.withColumn("__e", event.cast("long")), groups, -score,
                          {"pos": F.col("__e"), "n": F.lit(1)}, totals=True)
    gain = F.col("pos") / F.col("total_pos") * F.col("cum_pos") / F.col("cum_n")
    return ranked.groupBy(*groups).agg(F.sum(gain).alias("average_precision"))


def ratio_of_sums(df: DataFrame, numerator: Column, denominator: Column, groups: list[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(ratio(F.sum(numerator), F.sum(denominator)).alias("factor"))


def climatology(df: DataFrame, train: Column, value: str, by: list[str]) -> DataFrame:
    """Training-only mean per calendar group, attached to every row as `climatology`."""
    return attach(df, df.where(train).groupBy(*by).agg(F.avg(value).alias("climatology")), by)


def spread_skill(df: DataFrame, spread: Column, rmse: Column, groups: list[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.bround(floored_ratio(F.avg(spread), F.max(rmse)), 2).alias("spread_skill_ratio"))


def density(df: DataFrame, group: str, member: str, at_least: int) -> DataFrame:
    out = df.groupBy(group).agg(F.countDistinct(member).alias("members"))
    return out.withColumn("is_multi", F.col("members") >= at_least)


def plausible_gradient(df: DataFrame, a: str, b: str, groups: list[str] = (), at_least: float = 0.3) -> DataFrame:
    return df.groupBy(*groups).agg(F.corr(a, b).alias("r")).withColumn("plausible", F.col("r") > at_least)
