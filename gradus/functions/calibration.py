"""Calibration: binned errors, Brier score, class gaps, and temperature and Platt scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import ratio


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def reliability(df: DataFrame, groups: Sequence[str], bins: int = 15, prob: str = "prob", label: str = "label_45") -> DataFrame:
    """groups, bin, n, confidence, accuracy of the bins that aren't empty; [low, high), the last closed."""
    b = F.least(F.floor(F.col(prob) * bins).cast("int"), F.lit(bins - 1))
    return df.where(F.col(prob).isNotNull()).groupBy(*groups, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("confidence"), F.avg(label).alias("accuracy"))


def ece(df: DataFrame, groups: Sequence[str], bins: int = 15, prob: str = "prob", label: str = "label_45") -> DataFrame:
    r = reliability(df, groups, bins, prob, label)
    return r.groupBy(*groups).agg(F.sum("n").alias("n"), ratio(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n")).alias("ece"))


def brier(prob: str = "prob", label: str = "label_45") -> Column:
    return F.avg((F.col(prob) - F.col(label)) * (F.col(prob) - F.col(label)))


def class_gaps(df: DataFrame, groups: Sequence[str], prob: str = "prob", label: str = "label_45") -> DataFrame:
    """gap_neg: mean probability of negatives; gap_pos: what positives lack to 1; and their mean."""
    out = df.groupBy(*groups).agg(F.avg(F.when(F.col(label) == 0, F.col(prob))).alias("gap_neg"), (F.lit(1.0) - F.avg(F.when(F.col(label) == 1, F.col(prob)))).alias("gap_pos"))
    return out.withColumn("balanced", (F.col("gap_neg") + F.col("gap_pos")) / 2)


def threshold_metrics(df: DataFrame, groups: Sequence[str], threshold: float | Column, score: str = "prob", label: str = "label_45") -> DataFrame:
    """sensitivity, specificity, f1 (null if precision or sensitivity is 0) and balanced accuracy at score >= threshold."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    c = df.groupBy(*groups).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    sens, spec = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    f1 = F.when(F.col("tp") > 0, ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    parts = F.when(sens.isNull(), 0).otherwise(1) + F.when(spec.isNull(), 0).otherwise(1)
    return c.select(*groups, "tp", "fp", "fn", "tn", sens.alias("sensitivity"), spec.alias("specificity"), f1.alias("f1"), ratio(F.coalesce(sens, F.lit(0.0)) + F.coalesce(spec, F.lit(0.0)), parts).alias("balanced_accuracy"))


def fit_platt(df: DataFrame, logit: str = "logit", label: str = "label_45", passes: int = 25, tolerance: float = 1e-10) -> tuple[float, float]:
    """a, b of P = sigmoid(a * logit + b) by Newton's method: five sums a pass, whatever the rows."""
    a, b = 1.0, 0.0
    for _ in range(passes):
        z, y = F.col(logit), F.col(label)
        p = sigmoid(F.lit(a) * z + F.lit(b))
        w = p * (1 - p)
        r = df.agg(F.sum((y - p) * z).alias("ga"), F.sum(y - p).alias("gb"), F.sum(w * z * z).alias("haa"), F.sum(w * z).alias("hab"), F.sum(w).alias("hbb")).first()
        if r.ga is None:
            return a, b
        det = r.haa * r.hbb - r.hab * r.hab
        if det <= 0:
            break
        da, db = (r.hbb * r.ga - r.hab * r.gb) / det, (r.haa * r.gb - r.hab * r.ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tolerance:
            break
    return float(a), float(b)


def fit_temperature(df: DataFrame, logit: str = "logit", label: str = "label_45", low: float = 0.05, high: float = 20.0, passes: int = 40) -> float:
    """T of P = sigmoid(logit / T): the loss is convex in 1 / T, so Newton's method within the bounds."""
    x = 1.0
    for _ in range(passes):
        z, y = F.col(logit), F.col(label)
        p = sigmoid(F.lit(x) * z)
        r = df.agg(F.sum((y - p) * z).alias("g"), F.sum(p * (1 - p) * z * z).alias("h")).first()
        if r.g is None or not r.h:
            break
        new = min(max(x + r.g / r.h, 1 / high), 1 / low)
        done = abs(new - x) < 1e-12
        x = new
        if done:
            break
    return float(1 / x)


def calibrated(df: DataFrame, temperature: float, platt: tuple[float, float], logit: str = "logit") -> DataFrame:
    """df with prob_raw, prob_temp and prob_platt; all rise with the logit, so ranks stay."""
    z = F.col(logit)
    return df.withColumns({"prob_raw": sigmoid(z), "prob_temp": sigmoid(z / F.lit(temperature)), "prob_platt": sigmoid(F.lit(platt[0]) * z + F.lit(platt[1]))})


def logit_of(threshold: float) -> float:
    return math.log(threshold / (1 - threshold))
