"""What a training log tells: smoothed validation AUC, early stopping, best checkpoints, learning rates, sampling weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def smoothed(log: DataFrame, k: int = 5, run: str = "run") -> DataFrame:
    """log with the mean of the last k epochs' AUC that aren't null."""
    w = W.partitionBy(run).orderBy("epoch")
    seen = log.withColumn("val_auc", F.nanvl("val_auc", F.lit(None).cast("double"))).withColumn("nth", F.count("val_auc").over(w))
    known = seen.where("val_auc is not null").withColumn("val_auc_smoothed", F.avg("val_auc").over(w.rowsBetween(-(k - 1), 0))).select(run, F.col("nth").alias("k"), "val_auc_smoothed")
    return seen.join(known.withColumnRenamed(run, "r"), (F.col(run) == F.col("r")) & (F.col("nth") == F.col("k")), "left").drop("r", "k", "nth")


def early_stop(log: DataFrame, patience: int, run: str = "run") -> DataFrame:
    """run, stop_epoch: the first epoch that ends `patience` epochs in a row below the best so far; null if none does."""
    w = W.partitionBy(run).orderBy("epoch")
    before = F.max("val_auc_smoothed").over(w.rowsBetween(W.unboundedPreceding, -1))
    kept = F.col("val_auc_smoothed").isNotNull() & (F.col("val_auc_smoothed") >= F.coalesce(before, F.lit(0.0)))
    last = F.max(F.when(F.col("better"), F.col("epoch"))).over(w)
    misses = log.withColumn("better", kept).withColumn("misses", F.col("epoch") - F.coalesce(last, F.lit(0)))
    return misses.groupBy(run).agg(F.min(F.when(F.col("misses") >= patience, F.col("epoch"))).alias("stop_epoch"))


def best_checkpoints(log: DataFrame, k: int = 3, run: str = "run") -> DataFrame:
    """run, epoch, val_auc, place of the k best; of equal ones the earlier."""
    w = W.partitionBy(run).orderBy(F.desc("val_auc"), "epoch")
    return log.where("val_auc is not null and not isnan(val_auc)").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(run, "epoch", "val_auc", "place")


def learning_rate(epoch: Column, base: float, total: int, warmup: int, least: float = 1e-6) -> Column:
    """Linear warm-up, then half a cosine down to least; epochs count from 0."""
    done = (epoch - warmup) / F.lit(max(1, total - warmup))
    factor = least / base + (1 - least / base) * F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * done))
    return F.lit(base) * F.when(epoch < warmup, (epoch + 1) / F.lit(max(1, warmup))).otherwise(factor)


def sampling_weights(df: DataFrame, rate: float, label: str = "label_45") -> DataFrame:
    """label, n, weight of a row, and the loss weight of positives, for a target share of positives."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(F.col("n"))).alias("neg"))
    share = F.when(F.col(label) == 1, F.lit(rate) / F.greatest("pos", F.lit(1))).otherwise(F.lit(1 - rate) / F.greatest("neg", F.lit(1)))
    pos_weight = F.lit((1 - rate) / rate) if rate > 0 else F.try_divide("neg", "pos")
    return n.crossJoin(F.broadcast(total)).select(label, "n", share.alias("weight"), pos_weight.alias("pos_weight"))  # one row


def smoothed_label(label: Column, smoothing: float) -> Column:
    return label * (1 - smoothing) + F.lit(smoothing / 2)
