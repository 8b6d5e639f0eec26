"""Pair two forecast routes child by child and summarise how they differ."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from rainweave.functions.numeric import isclose, percent_difference
from rainweave.operators.distributed import attach, duplicate_keys, exact_quantiles, require_empty

EQUAL_MM = 1e-4
TRIGGER_MM = 20.0


class Paired(NamedTuple):
    paired: DataFrame
    left_only: DataFrame
    right_only: DataFrame
    misaligned: DataFrame


def pair(left: DataFrame, right: DataFrame, key: list[str], agree: tuple[str, ...] = (),
         close: tuple[str, ...] = (), rel_tol: float = 1e-10, strict: bool = False) -> Paired:
    """Inner join by key with agreement checks, and the unmatched keys of both sides.

    Non-key columns come out as left_* and right_*. Rows whose `agree` columns differ, or whose
    `close` columns differ beyond the relative tolerance, are returned as misaligned.
    """
    if strict:
        require_empty(duplicate_keys(left, key), "Duplicate key on the left side")
        require_empty(duplicate_keys(right, key), "Duplicate key on the right side")
    lhs = left.select(*key, *[F.col(c).alias(f"left_{c}") for c in left.columns if c not in key])
    rhs = right.select(*key, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in key])
    both = lhs.join(rhs, key, "inner")
    checks = [F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in agree]
    checks += [F.coalesce(isclose(f"left_{c}", f"right_{c}", rel_tol), F.lit(False)) for c in close]
    ok = reduce(lambda a, b: a & b, checks, F.lit(True))
    result = Paired(both.where(ok), left.select(*key).join(right.select(*key), key, "left_anti"),
                    right.select(*key).join(left.select(*key), key, "left_anti"), both.where(~ok))
    if strict:
        require_empty(result.misaligned, "Paired rows disagree")
    return result


def components(df: DataFrame, left_source: str, right_source: str, left_factor: str, right_factor: str,
               left_local: str, right_local: str) -> DataFrame:
    """Split the local difference into a source part, a reference part and the rounding rest."""
    sl, sr, fl, fr = (F.col(c) for c in (left_source, right_source, left_factor, right_factor))
    out = df.withColumns({
        "difference_mm": F.col(left_local) - F.col(right_local),
        "source_component_mm": (sl - sr) * (fl + fr) / 2,
        "reference_component_mm": (sl + sr) * (fl - fr) / 2,
    })
    return out.withColumns({
        "percent_vs_right": percent_difference("difference_mm", right_local),
        "rounding_residual_mm": F.col("difference_mm") - F.col("source_component_mm")
        - F.col("reference_component_mm"),
    })


def pair_stats(df: DataFrame, grouping_sets: list[list[str]], left_local: str, right_local: str,
               weight: str, digits: int = 6) -> DataFrame:
    """Twenty-four paired-difference statistics for each grouping set.

    `grouping_level` numbers the sets; keys outside a set are NULL. Counts and sums combine
    before the shuffle. The median and 90th percentile are exact: values are ranked in buckets.
    """
    keys = list(dict.fromkeys(k for s in grouping_sets for k in s))
    d, a, w = F.col("difference_mm"), F.abs(F.col("difference_mm")), F.col(weight)
    lv, rv = F.col(left_local), F.col(right_local)

    def weighted(c):
        return F.sum(c * w) / F.sum(w)

    def mean(c):
        # Local values carry four decimals, so a sum rounded to six is exact whatever the order
        # of summation, and so is the quotient.
        return F.round(F.sum(c), 6) / F.count(c)

    means = {"left_mean_mm": mean(lv), "right_mean_mm": mean(rv), "mean_difference_mm": mean(d),
             "mean_absolute_difference_mm": mean(a)}
    aggs = {
        "root_mean_square_difference_mm": F.sqrt(F.avg(d * d)),
        "max_absolute_difference_mm": F.max(a),
        "area_weighted_left_mm": weighted(lv), "area_weighted_right_mm": weighted(rv),
        "area_weighted_difference_mm": weighted(d), "area_weighted_absolute_difference_mm": weighted(a),
        "mean_source_component_mm": F.avg("source_component_mm"),
        "mean_reference_component_mm": F.avg("reference_component_mm"),
        "mean_absolute_source_component_mm": F.avg(F.abs("source_component_mm")),
        "mean_absolute_reference_component_mm": F.avg(F.abs("reference_component_mm")),
    }
    counts = {
        "left_higher": F.count_if(d > EQUAL_MM), "right_higher": F.count_if(d < -EQUAL_MM),
        "equal_within_rounding": F.count_if(a <= EQUAL_MM),
        "above_1mm": F.count_if(a > 1), "above_5mm": F.count_if(a > 5), "above_10mm": F.count_if(a > 10),
        "different_trigger": F.count_if((lv >= TRIGGER_MM) != (rv >= TRIGGER_MM)),
    }
    level_of = {tuple(s): i for i, s in enumerate(grouping_sets)}
    if keys:
        gid = sum((F.grouping(k).cast("int") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
        mask = {sum(1 << i for i, k in enumerate(keys) if k not in s): n for s, n in level_of.items()}
        level = F.lit(None).cast("int")
        for bits, n in mask.items():
            level = F.when(gid == bits, F.lit(n)).otherwise(level)
        summary = df.groupingSets([[F.col(k) for k in s] for s in grouping_sets], *[F.col(k) for k in keys]).agg(
            level.alias("grouping_level"), F.count(F.lit(1)).alias("count"),
            *[c.alias(n) for n, c in means.items()], *[F.round(c, digits).alias(n) for n, c in aggs.items()],
            *[c.alias(n) for n, c in counts.items()])
    else:
        summary = df.agg(F.lit(0).alias("grouping_level"), F.count(F.lit(1)).alias("count"),
                         *[c.alias(n) for n, c in means.items()],
                         *[F.round(c, digits).alias(n) for n, c in aggs.items()],
                         *[c.alias(n) for n, c in counts.items()])
    tagged = df.select(*keys, a.alias("__abs"), F.explode(F.array(
        *[F.lit(n) for n in level_of.values()])).alias("grouping_level"))
    for k in keys:
        inside = [n for s, n in level_of.items() if k in s]
        tagged = tagged.withColumn(k, F.when(F.col("grouping_level").isin(inside), F.col(k)))
    marks = exact_quantiles(tagged, [*keys, "grouping_level"], F.col("__abs"), {
        "median_absolute_difference_mm": 0.5, "p90_absolute_difference_mm": 0.9})
    marks = marks.withColumns({c: F.round(c, digits) for c in marks.columns if c.endswith("_difference_mm")})
    return attach(summary, marks, [*keys, "grouping_level"])


def weather_stats(df: DataFrame, variables: list[str], digits: int = 6) -> DataFrame:
    """Per-variable statistics over the rows where both sides carry the variable."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"left_{v}").cast("double").alias("l"),
                               F.col(f"right_{v}").cast("double").alias("r")) for v in variables])
    long = df.select(F.inline(pairs))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    gap = F.abs(F.col("l") - F.col("r"))
    return long.groupBy("variable").agg(
        F.count_if(both).alias("count"),
        F.round(F.avg(F.when(both, F.col("l"))), digits).alias("left_mean"),
        F.round(F.avg(F.when(both, F.col("r"))), digits).alias("right_mean"),
        F.round(F.avg(gap), digits).alias("mean_absolute_difference"),
        F.round(F.max(gap), digits).alias("max_absolute_difference"))


def comparable_variables(left: DataFrame, right: DataFrame, variables: list[str]) -> DataFrame:
    """A variable is comparable when no row on either side lacks it."""
    def long(df):
        return df.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"),
                                                     F.col(v).isNotNull().alias("present")) for v in variables])))
    return long(left).unionByName(long(right)).groupBy("variable").agg(
        F.bool_and("present").alias("comparable"))


def top_disagreements(df: DataFrame, key: list[str], difference: str = "difference_mm", n: int = 10) -> DataFrame:
    return df.orderBy(F.abs(F.col(difference)).desc(), *key).limit(n)


def date_overlap(left: DataFrame, right: DataFrame, date: str) -> DataFrame:
    """Each distinct date with its side: both, left_only or right_only."""
    marked = (left.select(F.col(date), F.lit(1).alias("l"), F.lit(0).alias("r"))
              .unionByName(right.select(F.col(date), F.lit(0).alias("l"), F.lit(1).alias("r"))))
    return marked.groupBy(date).agg(F.max("l").alias("l"), F.max("r").alias("r")).select(
        date, F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left_only")
        .otherwise("right_only").alias("side"))
