"""Train, calibrate, select and score amount and event models on disjoint splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rainweave.functions.numeric import sigmoid
from rainweave.operators import models as M, selection as S, verification as V
from rainweave.operators.distributed import attach
from rainweave.session import cut_lineage

# Probabilities tried as alert thresholds.
THRESHOLDS = [0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.225, 0.25, 0.275, 0.3, 0.325, 0.35, 0.375, 0.4,
              0.45, 0.5, 0.6, 0.7, 0.8]


def amount_candidates(rows: DataFrame, x: list[str], y: str, raw: str, kinds=("tweedie", "squared"), trees: int = 20) -> DataFrame:
    """Long table of selection-split predictions: raw, scaled and every fitted kind."""
    train, select = rows.where("split = 'train'"), rows.where("split = 'selection'")
    scaled = attach(select, V.ratio_of_sums(train, F.col(y), F.col(raw)), [])
    parts = [select.select(F.lit(0).alias("ord"), F.lit("raw").alias("candidate"), y, F.col(raw).alias("p")),
             scaled.select(F.lit(1), F.lit("scaled"), y, F.col(raw) * F.col("factor"))]
    for i, kind in enumerate(kinds):
        model = M.fit_amount(train, x, y, kind, trees)
        parts.append(M.score_amount(model, select, x, "p").select(F.lit(2 + i), F.lit(kind), y, "p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def event_probabilities(rows: DataFrame, x: list[str], event: str, trees: int = 20) -> DataFrame:
    """Calibrated event probability on the selection split; calibration uses its own split."""
    model = M.fit_event(rows.where("split = 'train'"), x, event, trees)
    slope, intercept = M.calibrate(M.raw_score(model, rows.where("split = 'calibration'"), x), "raw", event)
    scored = M.raw_score(model, rows.where("split = 'selection'"), x)
    return scored.withColumn("probability", sigmoid("raw", slope, intercept))


def select_models(rows: DataFrame, x: list[str], y: str, raw: str, event_at: float = 20.0, trees: int = 20) -> DataFrame:
    """One row: the chosen amount model and the chosen alert threshold. Every fit reads the rows, so they are written once."""
    rows = cut_lineage(rows.withColumn("event", (F.col(y) >= event_at).cast("double")))
    scores = V.amounts(amount_candidates(rows, x, y, raw, trees=trees), F.col(y), F.col("p"), ["ord", "candidate"])
    amount = S.best_amount(scores, [], "raw", fallback="baseline")
    sweep = V.threshold_sweep(event_probabilities(rows, x, "event", trees), F.col("event") == 1, F.col("probability"), THRESHOLDS)
    best = S.best_threshold(sweep).select("threshold", "recall", "precision", "csi", F.col("constraints_met").alias("event_met"))
    return attach(amount, best, [])
