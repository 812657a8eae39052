"""Statistics of ranks, per group: ROC-AUC, average precision, curve points, Youden's threshold, Spearman.

Scores are first collapsed to distinct values (a combinable aggregation, so ties and hot values cost
nothing), then cumulated in two steps: within buckets of width `step`, in parallel, and over the few
bucket totals. No window ever spans a whole group of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cumulated(df: DataFrame, groups: Sequence[str], value: str, sums: dict[str, Column], descending: bool = False, step: float = 1 / 16) -> DataFrame:
    """groups, value, each sum over the rows of that value, and cum_<sum> over all values up to it."""
    bucket = F.floor(F.col(value) / F.lit(step))
    per = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("bucket", -bucket if descending else bucket).groupBy(*groups, "bucket", value).agg(*(F.sum(e).alias(n) for n, e in sums.items()))
    total = per.groupBy(*groups, "bucket").agg(*(F.sum(n).alias(f"t_{n}") for n in sums))
    before = W.partitionBy(*groups).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = total.select(*(F.col(g).alias(f"g_{g}") for g in groups), F.col("bucket").alias("g_bucket"), *(F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"o_{n}") for n in sums))
    order = F.desc(value) if descending else F.asc(value)
    within = W.partitionBy(*groups, "bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    same = F.col("bucket") == F.col("g_bucket")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    out = per.withColumns({f"cum_{n}": F.sum(n).over(within) for n in sums}).join(offsets, same)
    return out.select(*groups, value, *sums, *((F.col(f"cum_{n}") + F.col(f"o_{n}")).alias(f"cum_{n}") for n in sums))


def _sides(label: str, weight: str | None) -> dict[str, Column]:
    w = F.col(weight) if weight else F.lit(1)
    return {"pos": F.when(F.col(label) == 1, w).otherwise(0), "neg": F.when(F.col(label) == 1, 0).otherwise(w)}


def auc(df: DataFrame, groups: Sequence[str], score: str = "logit", label: str = "label_45", weight: str | None = None) -> DataFrame:
    """groups, n, n_pos, auc: the chance that a positive scores above a negative, ties half; null if there is one class."""
    c = cumulated(df, groups, score, _sides(label, weight))
    below = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * F.lit(0.5)))
    return c.groupBy(*groups).agg((F.sum("pos") + F.sum("neg")).alias("n"), F.sum("pos").alias("n_pos"), ratio(below, F.sum("pos") * F.sum("neg")).alias("auc"))


def auc_many(df: DataFrame, groups: Sequence[str], score: str = "logit", label: str = "label_45", step: float = 1 / 4, rows: int = 1 << 20) -> DataFrame:
    """auc() of many groups (one column at least) that have many distinct scores, which are doubles: each row is sorted in runs of `rows`.

    A run leaves its distinct scores packed by group and bucket of width `step`, so ties are combined before the one
    shuffle and few rows are shuffled. A bucket counts its own pairs; those across buckets follow from the buckets' sums.
    """
    value = F.col(score).cast("double")
    plain = df.where(value.isNotNull() & ~F.isnan(value)).select(*groups, value.alias("value"), F.coalesce(F.col(label) == 1, F.lit(False)).alias("is_pos"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.select(*groups).schema)
    packed = plain.mapInArrow(_packing(list(groups), step, rows), f"{fields}, bucket long, scores binary, pos binary, neg binary")
    sums = packed.groupBy(*groups, "bucket").applyInArrow(_bucket_pairs, f"{fields}, bucket long, pos long, neg long, twice long")
    before = W.partitionBy(*groups).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    below = F.sum(F.col("twice") * F.lit(0.5) + F.col("pos") * F.col("lower"))
    return sums.withColumn("lower", F.coalesce(F.sum("neg").over(before), F.lit(0))).groupBy(*groups).agg((F.sum("pos") + F.sum("neg")).alias("n"), F.sum("pos").alias("n_pos"), ratio(below, F.sum("pos") * F.sum("neg")).alias("auc"))


def _packing(groups: list[str], step: float, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of groups, value, is_pos: groups, bucket, and its distinct values with counts of both classes as bytes."""

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = np.zeros(table.num_rows, np.int64)
        for g in groups:
            coded = table[g].combine_chunks().dictionary_encode("encode")
            codes = np.unique(codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        value, is_pos = table["value"].to_numpy() + 0.0, table["is_pos"].to_numpy().astype(np.int64)  # + 0.0: -0.0 is 0.0
        order = np.lexsort((value, codes))
        codes, value = codes[order], value[order]
        at = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (value[1:] != value[:-1])])
        pos, n = np.add.reduceat(is_pos[order], at), np.diff(np.r_[at, len(order)])
        of, value = codes[at], value[at]
        bucket = np.clip(np.floor(value / step), -(2.0**62), 2.0**62).astype(np.int64)
        runs = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])])
        ends = np.r_[runs, len(at)]
        cells = lambda x, size: pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(x)])
        keys = table.select(groups).take(pa.array(order[at[runs]])).combine_chunks()
        columns = [*(keys[g].combine_chunks() for g in groups), pa.array(bucket[runs]), cells(value, 8), cells(pos.astype(np.int32), 4), cells((n - pos).astype(np.int32), 4)]
        yield from pa.table(columns, names=[*groups, "bucket", "scores", "pos", "neg"]).to_batches(max_chunksize=4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from packed(pa.Table.from_batches(held))

    return run


def _bucket_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """key (groups, bucket), pos, neg, and twice: two for each negative under a positive of the bucket, one for each tie."""
    joined = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
    value = joined("scores", np.float64)
    order = np.argsort(value, kind="stable")
    pos, neg = (joined(c, np.int32)[order].astype(np.int64) for c in ("pos", "neg"))
    value = value[order]
    at = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    pos, neg = np.add.reduceat(pos, at), np.add.reduceat(neg, at)
    twice = int((pos * (2 * np.cumsum(neg) - neg)).sum())
    names = table.column_names[: len(key)]
    return pa.table([*(pa.array([k.as_py()], k.type) for k in key), *(pa.array([int(x)], pa.int64()) for x in (pos.sum(), neg.sum(), twice))], names=[*names, "pos", "neg", "twice"])


def average_precision(df: DataFrame, groups: Sequence[str], score: str = "logit", label: str = "label_45", weight: str | None = None) -> DataFrame:
    """groups, ap: precision at each distinct score, weighted by the recall gained there; null without positives."""
    c = cumulated(df, groups, score, _sides(label, weight), descending=True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return c.groupBy(*groups).agg(ratio(F.sum(F.col("pos") * precision), F.sum("pos")).alias("ap"))


def auc_and_ap(df: DataFrame, groups: Sequence[str], score: str = "logit", label: str = "label_45", weight: str | None = None) -> DataFrame:
    """groups, n, n_pos, auc, ap from one cumulation of the scores."""
    c = cumulated(df, groups, score, _sides(label, weight), descending=True)
    above = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * F.lit(0.5)))  # negatives above each positive, ties half
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    p, q = F.sum("pos"), F.sum("neg")
    return c.groupBy(*groups).agg((p + q).alias("n"), p.alias("n_pos"), (F.lit(1.0) - ratio(above, p * q)).alias("auc"), ratio(F.sum(F.col("pos") * precision), p).alias("ap"))


def curve(df: DataFrame, groups: Sequence[str], score: str = "logit", label: str = "label_45") -> DataFrame:
    """groups, threshold, tp, fp, tpr, fpr, precision: a point per distinct score and the start at infinity."""
    c = cumulated(df, groups, score, _sides(label, None), descending=True).select(*groups, F.col(score).alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))
    totals = c.groupBy(*groups).agg(F.max("tp").alias("p"), F.max("fp").alias("q"))
    start = totals.select(*groups, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    points = c.unionByName(start)
    if groups:
        points = points.join(totals, list(groups))
    else:
        points = points.crossJoin(F.broadcast(totals))  # one row
    return points.select(*groups, "threshold", "tp", "fp", ratio(F.col("tp"), F.col("p")).alias("tpr"), ratio(F.col("fp"), F.col("q")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def youden(df: DataFrame, groups: Sequence[str], score: str = "logit", label: str = "label_45") -> DataFrame:
    """groups, threshold, j: the highest threshold of greatest sensitivity + specificity - 1; infinity if none is over 0."""
    best = F.max(F.struct(F.coalesce(F.col("tpr") - F.col("fpr"), F.lit(0.0)).alias("j"), F.col("threshold"))).alias("best")
    return curve(df, groups, score, label).groupBy(*groups).agg(best).select(*groups, F.col("best.threshold").alias("threshold"), F.col("best.j").alias("j"))


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, out: str, step: float = 1 / 1024) -> DataFrame:
    """df with the rank of value in its group; equal values share the mean of their ranks."""
    c = cumulated(df, groups, value, {"n": F.lit(1)}, step=step).select(*(F.col(g).alias(f"r_{g}") for g in groups), F.col(value).alias("r_value"), (F.col("cum_n") - (F.col("n") - 1) * F.lit(0.5)).alias(out))
    same = F.col(value) == F.col("r_value")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"r_{g}"))
    return df.join(c, same).drop("r_value", *(f"r_{g}" for g in groups))


def pearson(x: str, y: str) -> Column:
    """Null where either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, least: int = 10) -> DataFrame:
    """groups, n, rho over the pairs without nulls; null with fewer than `least` pairs or a constant side."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*groups, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = average_ranks(average_ranks(pairs, groups, "x", "rx"), groups, "y", "ry")
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, pearson("rx", "ry")).alias("rho"))


def _centred_ranks(counts: np.ndarray) -> np.ndarray:
    """Mean ranks less their own mean, of sorted distinct values that occur counts times."""
    return np.cumsum(counts) - (counts - 1) / 2 - (counts.sum() + 1) / 2


class _Ranks:
    """Ranks of the distinct values of one group's columns: of each column against any other, over the rows where neither is null."""

    def __init__(self, counted: pd.DataFrame):
        """counted: col, value, mask (a bit for each column that is null in those rows), n."""
        self.values, self.counts = {}, {}
        for col, part in counted.groupby("col"):
            self.values[col], at = np.unique(part["value"].to_numpy(), return_inverse=True)
            self.counts[col] = {m: np.bincount(at[rows], part["n"].to_numpy()[rows], len(self.values[col])) for m in part["mask"].unique() for rows in [np.flatnonzero(part["mask"].to_numpy() == m)]}
        self.ranks = {}

    def of(self, col: int, other: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Counts and centred ranks of col's values in the rows that have other, too; None if there are none."""
        masks = tuple(sorted(m for m in self.counts.get(col, {}) if not m >> other & 1))
        if masks and (col, masks) not in self.ranks:
            counts = reduce(np.add, (self.counts[col][m] for m in masks))
            self.ranks[col, masks] = counts, _centred_ranks(counts)
        return self.ranks.get((col, masks))


def spearman_many(df: DataFrame, groups: Sequence[str], xs: Sequence[str], ys: Sequence[str], least: int = 10, most: int = 6_000_000) -> DataFrame:
    """groups, x, y (names of columns), n, rho: spearman() of every x with every y, without a shuffle of the rows.

    Rows are read twice: to count the distinct values of each group's columns, and to multiply the ranks that these
    counts give. Groups are taken together up to `most` distinct values, which travel to the driver and the workers;
    the rows of a group with more of them are ranked by spearman(). df has to give the same rows each time.
    """
    spark, cols = df.sparkSession, [*xs, *ys]
    plain = df.select(*groups, *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols))
    mask = reduce(Column.bitwiseOR, (F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(cols)))
    stacked = plain.select(*groups, mask.alias("mask"), F.stack(F.lit(len(cols)), *(e for k, c in enumerate(cols) for e in (F.lit(k), F.col(c)))).alias("col", "value"))
    counted = stacked.where("value is not null").groupBy(*groups, "mask", "col", "value").agg(F.count("*").alias("n")).persist()
    sizes = counted.groupBy(*groups).agg(F.count("*").alias("size")).collect()  # a row per group
    found, batch, held = [], [], 0
    is_group = lambda g: reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(groups, g, strict=True)), F.lit(True))

    def finish() -> None:
        if batch:
            found.extend(_correlated(plain, counted, [(g, is_group(g)) for g in batch], cols, len(xs), least))

    for r in sorted(sizes, key=lambda r: repr(tuple(r))):
        g = tuple(r)[:-1]
        if r["size"] > most:
            for y in ys:
                long = plain.where(is_group(g)).unpivot([*groups, y], list(xs), "of", "value")
                found.extend((*g, t["of"], y, t["n"], t["rho"]) for t in spearman(long, [*groups, "of"], "value", y, least).collect())  # a row per x
            continue
        if held + r["size"] > most:
            finish()
            batch, held = [], 0
        batch.append(g)
        held += r["size"]
    finish()
    counted.unpersist()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in groups for f in [df.schema[c]])
    return spark.createDataFrame(found, (fields + ", " if groups else "") + "x string, y string, n bigint, rho double")


def _correlated(plain: DataFrame, counted: DataFrame, groups: list[tuple[tuple, Column]], cols: list[str], n_xs: int, least: int) -> list[tuple]:
    """The rows of spearman_many for these groups and their conditions."""
    context = plain.sparkSession.sparkContext
    gid = reduce(lambda rest, k: F.when(groups[k][1], k).otherwise(rest), range(len(groups)), F.lit(None).cast("int")).alias("gid")
    table = counted.select(gid, "mask", "col", "value", "n").where("gid is not null").toArrow().to_pandas()  # bounded by most
    ranks = {k: _Ranks(part) for k, part in table.groupby("gid")}
    pairs = [(x, y) for x in range(n_xs) for y in range(n_xs, len(cols))]
    for r in ranks.values():
        for x, y in pairs:
            r.of(x, y), r.of(y, x)
    sent = context.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], float] = {}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            numbers = [b.column(k + 1).to_numpy(zero_copy_only=False).astype(float, copy=False) for k in range(len(cols))]
            for g in np.unique(ids):
                own, rows = sent.value[g], np.flatnonzero(ids == g)
                here = [c[rows] for c in numbers]
                null = [np.isnan(c) for c in here]
                at = [np.minimum(np.searchsorted(own.values[k], c), len(own.values[k]) - 1) if k in own.values else None for k, c in enumerate(here)]  # nulls anywhere
                for x, y in pairs:
                    if (of_x := own.of(x, y)) and (of_y := own.of(y, x)):
                        products = of_x[1][at[x]] * of_y[1][at[y]]
                        sums[g, x, y] = sums.get((g, x, y), 0.0) + float(products[~(null[x] | null[y])].sum())
        keys = list(sums)
        yield pa.record_batch([pa.array([int(k[i]) for k in keys], pa.int32()) for i in range(3)] + [pa.array([sums[k] for k in keys], pa.float64())], names=["gid", "x", "y", "s"])

    condition = reduce(Column.__or__, (c for _, c in groups))
    rows = plain.where(condition).select(gid, *cols).mapInArrow(run, "gid int, x int, y int, s double")
    sums = {(r["gid"], r["x"], r["y"]): r["s"] for r in rows.groupBy("gid", "x", "y").agg(F.sum("s").alias("s")).collect()}  # a row per correlation
    sent.destroy()
    out = []
    for (g, x, y), s in sorted(sums.items()):
        (nx, rx), (ny, ry) = ranks[g].of(x, y), ranks[g].of(y, x)
        n, spread = int(nx.sum()), float(np.sqrt((nx * rx * rx).sum()) * np.sqrt((ny * ry * ry).sum()))
        out.append((*groups[g][0], cols[x], cols[y], n, s / spread if n >= least and spread > 0 else None))
    return out


def _tail(t: float, v: float) -> float:
    """The chance that Student's t with v degrees of freedom is farther from 0 than t: a continued fraction of the incomplete beta function."""
    a, b, x = v / 2, 0.5, v / (v + t * t)
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if flipped := x > (a + 1) / (a + b + 2):
        a, b, x = b, a, 1 - x
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + e * d or tiny)
            c = 1 + e / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    part = h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return 1 - part if flipped else part


def p_value(rho: str, n: str) -> Column:
    """The two-sided p-value of a rank correlation over n pairs, by Student's t with n - 2 degrees of freedom; null without a correlation."""

    @F.pandas_udf("double")
    def run(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x or m < 3 else 0.0 if abs(x) >= 1 else _tail(x * math.sqrt((m - 2) / (1 - x * x)), m - 2.0) for x, m in zip(r, k, strict=True)], dtype="float64")

    return run(rho, n)  # a row per correlation


def stars(p: Column) -> Column:
    return F.when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 5e-2, "*").otherwise("")
