"""Sampling and bootstrap intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def portable_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from an integer key and a seed that any SQL engine can repeat."""
    return ((key * 7919 + F.lit(seed * 104729)) % 1000003) / F.lit(1000003.0)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement: those of least hash."""
    return df.orderBy(portable_hash(F.col(key), seed), key).limit(n)


def one_per_group(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """A row of each group, by least hash: an aggregation, no window."""
    rest = [c for c in df.columns if c != group]
    return df.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(portable_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))).alias("row")).select(*(F.col(c) if c == group else F.col(f"row.{c}").alias(c) for c in df.columns))


def stratified(df: DataFrame, stratum: Column, wanted: dict, key: str, seed: int = 0) -> DataFrame:
    """Up to wanted[s] rows of each stratum s, or all if there are fewer."""
    out = None
    for value, n in wanted.items():
        part = sample(df.where(stratum == value), n, key, seed)
        out = part if out is None else out.unionByName(part)
    return out


def fixed_weights(b: Column, study: Column) -> Column:
    """How often draw b takes a study: close to Poisson(1), from a hash that SQL can repeat."""
    u = ((study * 7919 + b * 104729) % 10007) / F.lit(10007.0)
    edges = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)  # of the Poisson distribution with mean 1
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(u < edges[k], k).otherwise(out)
    return out


def interval(df: DataFrame, groups: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """groups, low, high, draws: percentiles of the draws that aren't null."""
    low = (1 - level) / 2
    return df.groupBy(*groups).agg(F.percentile(value, low).alias("low"), F.percentile(value, 1 - low).alias("high"), F.count(value).alias("draws"))


def weighted_auc(order: np.ndarray, starts: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """AUC of each row of weights (draws x rows); order sorts the scores, starts mark distinct ones. NaN for one class."""
    w = weights[:, order]
    pos, neg = (np.add.reduceat(w * side[order], starts, axis=1) for side in (y, 1 - y))
    below = np.cumsum(neg, axis=1) - neg / 2
    total = pos.sum(axis=1) * neg.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, (pos * below).sum(axis=1) / total, np.nan)


def weighted_ap(order: np.ndarray, starts: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Average precision of each row of weights, with the order and starts of weighted_auc. NaN without positives."""
    w = weights[:, order]
    pos, neg = (np.add.reduceat(w * side[order], starts, axis=1)[:, ::-1] for side in (y, 1 - y))
    found, all_ = np.cumsum(pos, axis=1), np.cumsum(pos + neg, axis=1)
    total = found[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, (pos * np.where(all_ > 0, found / all_, 0)).sum(axis=1) / total, np.nan)


def bootstrap_auc(df: DataFrame, groups: Sequence[str], draws: int, seed: int, cluster: str | None = None, score: str = "logit", label: str = "label_45", key: str = "image_id", ap: bool = True, rows: int = 20_000_000) -> DataFrame:
    """groups, draw, auc, and with ap ap: AUC and average precision of each draw, with rows (or clusters) drawn with replacement.

    Every group draws from the same generator over the sorted clusters, so draws pair across groups
    with the same clusters. A group is one condition of the study: they are few, and the driver lists them. A task
    takes one group after another, keeps some seven bytes a row and draws once for all of its groups, which are as many
    as have some `rows` rows, or one. For more images than a task holds use fixed_weights and rank.auc. df is read twice.
    """
    spark = df.sparkSession
    of = df.select(*groups).schema
    found = sorted(df.groupBy(*groups).count().collect(), key=lambda r: (-r["count"], repr(r)))  # a row of each condition
    members, largest = [tuple(r)[:-1] for r in found], sum(r["count"] for r in found)
    tasks = max(1, min(len(members), max(spark.sparkContext.defaultParallelism, -(-largest // rows))))
    own = df.select(*(F.col(g).alias(f"g{i}") for i, g in enumerate(groups)), F.col(cluster or key).alias("unit"), F.col(score).cast("double").alias("score"), F.coalesce(F.col(label) == 1, F.lit(False)).alias("is_pos"))
    if groups and members:
        numbers = spark.createDataFrame([(k, *m) for k, m in enumerate(members)], T.StructType([T.StructField("_k", T.IntegerType()), *(T.StructField(f"m{i}", f.dataType) for i, f in enumerate(of))]))
        own = own.join(F.broadcast(numbers), reduce(Column.__and__, (F.col(f"g{i}").eqNullSafe(F.col(f"m{i}")) for i in range(len(groups)))))
    else:
        own = own.withColumn("_k", F.lit(0))
    own = own.select("_k", "unit", "score", "is_pos")
    kind = own.schema["unit"].dataType.simpleString()
    size = max(16, (1 << 20) // max(1, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    cells = own.mapInArrow(_cells(size), f"_k int, unit array<{kind}>, score array<double>, is_pos array<boolean>")
    dealt = cells.repartitionById(max(1, len(members)), "_k").coalesce(tasks)  # a partition is one group, and a task reads one after another
    schema = T.StructType([*of.fields, T.StructField("draw", T.IntegerType()), T.StructField("auc", T.DoubleType()), *([T.StructField("ap", T.DoubleType())] if ap else [])])
    return dealt.mapInArrow(_drawn(members, to_arrow_schema(schema), draws, seed, ap), schema)


def _cells(size: int, rows: int = 1 << 18) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of _k and other columns: _k, and lists of up to `size` values of the others."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        k = table["_k"].to_numpy()
        k = k.astype(np.int16) if k.max(initial=0) < 1 << 15 else k  # sorted by digits
        order = np.argsort(k, kind="stable")
        k = k[order]
        edges = np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)]
        at = np.concatenate([np.arange(a, b, size) for a, b in zip(edges, edges[1:], strict=False)])
        offsets, taken = pa.array(np.r_[at, len(k)].astype(np.int32)), table.drop_columns(["_k"]).take(pa.array(order))
        lists = [pa.ListArray.from_arrays(offsets, taken[c].combine_chunks()) for c in taken.column_names]
        return pa.RecordBatch.from_arrays([pa.array(k[at].astype(np.int32)), *lists], names=["_k", *taken.column_names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    return run


def _times(rng: np.random.Generator, n: int) -> np.ndarray:
    """How often n draws from n clusters have each: the counts of rng.integers(0, n, n), in bytes where these hold them."""
    state, step = rng.bit_generator.state, 1 << 20
    out = np.zeros(n, np.uint8)
    for at in range(0, n, step):
        np.add.at(out, rng.integers(0, n, min(step, n - at)), np.uint8(1))
    if out.sum(dtype=np.int64) == n:
        return out
    rng.bit_generator.state = state
    return np.bincount(rng.integers(0, n, n), minlength=n)


def _drawn(members: list[tuple], schema: pa.Schema, draws: int, seed: int, ap: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From lists of _cells, group after group: rows of bootstrap_auc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike: dict[bytes, tuple[int, list[tuple[int, PackedRanks]]]] = {}  # by their clusters: how many, and each group's ranks
        held: dict[str, list[np.ndarray]] = {}
        now, seen = None, set()

        def close() -> None:
            if now is None:
                return
            by = np.concatenate(held.pop("unit"))
            own = np.unique(by)
            name = hashlib.sha256(repr(own.tolist()).encode() if own.dtype == object else own).digest()
            unit = np.empty(len(by), np.int32)
            for at in range(0, len(by), 1 << 18):
                unit[at : at + (1 << 18)] = np.searchsorted(own, by[at : at + (1 << 18)])
            n = len(own)
            del by, own
            y, s = (np.concatenate(held.pop(c)) for c in ("is_pos", "score"))
            alike.setdefault(name, (n, []))[1].append((now, PackedRanks(unit, s, y)))

        for batch in batches:
            ks = batch.column(0).to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]]), len(ks)] if len(ks) else []
            for a, b in zip(edges, edges[1:], strict=False):
                if ks[a] != now:
                    close()
                    now = int(ks[a])
                    if now in seen:
                        raise RuntimeError("the rows of a group came apart")
                    seen.add(now)
                for c in ("unit", "score", "is_pos"):
                    values = batch.slice(a, b - a).column(c).flatten().to_numpy(zero_copy_only=False)
                    small = values.dtype == np.int64 and len(values) and -(1 << 31) <= values.min() and values.max() < 1 << 31
                    held.setdefault(c, []).append(values.astype(np.int32 if small else values.dtype))
        close()
        for n, ranks in alike.values():
            rng = np.random.default_rng(seed)
            found = np.empty((len(ranks), draws, 2))
            for d in range(0, draws, 8):
                times = np.zeros((n + 1, 8), np.uint8)  # of no cluster too, which fills up blocks
                whole = []  # of draws that have a cluster more often than a byte holds
                for k in range(min(8, draws - d)):
                    drawn = _times(rng, n)
                    times[:n, k] = np.minimum(drawn, 255)
                    whole.append(drawn if drawn.dtype != np.uint8 else None)
                    del drawn
                high = max(255 if w is not None else 0 for w in whole) or int(times.max())
                for k, (_, r) in enumerate(ranks):
                    if high <= PackedRanks.MOST:
                        got = r.auc_and_ap_of_eight(times.view(np.uint64).ravel(), ap)
                        found[k, d : d + 8] = got[: draws - d]
                    else:
                        for j in range(min(8, draws - d)):
                            found[k, d + j] = r.plain().auc_and_ap(times[:n, j] if whole[j] is None else whole[j])
            for (k, _), f in zip(ranks, found, strict=True):
                columns = [pa.array([v] * draws, t) for v, t in zip(members[k], schema.types, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(draws, dtype=np.int32)), *(pa.array(f[:, j]) for j in range(1 + ap))], schema=schema)

    return run


class DrawnRanks:
    """weighted_auc and weighted_ap of draws of clusters: scores are sorted once, a draw is sums of whole numbers along them."""

    def __init__(self, unit: np.ndarray, s: np.ndarray, y: np.ndarray):
        """unit is the cluster of each row, s its score, y whether it is positive."""
        order = np.argsort(-s, kind="stable")
        s, y, unit = -s[order], y[order].astype(bool), unit[order]
        self.pos, self.neg = unit[y].astype(np.intp), unit[~y].astype(np.intp)
        self.before, self.until = (np.searchsorted(s[~y], s[y], side).astype(np.int32) for side in ("left", "right"))  # negatives above each positive, and not below it
        self.last = (np.searchsorted(s[y], s[y], "right") - 1).astype(np.int32)  # the last positive of each one's score

    def auc_and_ap(self, times: np.ndarray) -> tuple[float, float]:
        """times: how often the draw has each cluster."""
        times = times.astype(np.uint8 if times.max(initial=0) < 256 else np.int64)  # small, so that a processor's cache holds them
        hits = times.take(self.pos).astype(np.int64)
        others = np.zeros(len(self.neg) + 1, np.int64)
        np.cumsum(times.take(self.neg), out=others[1:])
        until, found = others[self.until], np.cumsum(hits)
        if not len(found) or not found[-1]:
            return np.nan, np.nan
        ap = (hits * (found[self.last] / np.maximum(found[self.last] + until, 1))).sum() / found[-1]
        return 1 - (hits * (others[self.before] + until)).sum() / 2 / (found[-1] * others[-1]) if others[-1] else np.nan, ap


class PackedRanks:
    """DrawnRanks of eight draws at once, whose counts are the bytes of one number.

    Negatives lie in blocks of SIZE, in columns, so that sums along a block are sums of rows; four draws
    share a number there, with 16 bits each. A positive's hits times the negatives of its block, above it and
    not below it, are at most 2 * SIZE * MOST * MOST, which 16 bits hold.
    """

    SIZE, MOST, WIDE, FEW = 128, 15, 1024, 4096  # of a block; times a cluster at most; blocks at a time; positives that are summed in 16 bits

    def __init__(self, unit: np.ndarray, s: np.ndarray, y: np.ndarray):
        """As DrawnRanks takes them; takes less memory."""
        s = -s
        order = np.argsort(s, kind="stable").astype(np.int32 if len(s) < 1 << 31 else np.int64)
        s, y, unit = s[order], y[order].astype(bool), unit[order].astype(np.int32)
        del order
        sp, sn = s[y], s[~y]
        del s
        self.pos, neg = unit[y], unit[~y]
        del unit, y
        self.n_neg = len(neg)
        ends = [np.searchsorted(sn, sp, side).astype(np.int32) for side in ("left", "right")]  # negatives above each positive, and not below it
        del sn
        self.last = (np.searchsorted(sp, sp, "right") - 1).astype(np.int32)
        per = self.SIZE * self.WIDE
        self.parts = []  # the negatives of some blocks; those past the end are of no cluster
        for at in range(0, len(neg) + 1, per):
            part = neg[at : at + per]
            wide = len(part) // self.SIZE + (len(part) < per)
            block = np.ascontiguousarray(np.r_[part, np.full(wide * self.SIZE - len(part), -1, np.int32)].reshape(wide, self.SIZE).T)
            self.parts.append((block, [self._places(x, at, wide) for x in ends]))

    def _places(self, x: np.ndarray, at: int, wide: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        """Which positives' ends lie in the part from `at` on, where in its sums, and runs of them: where each starts, and its block."""
        a, b = np.searchsorted(x, [at, at + self.SIZE * self.WIDE])
        own = x[a:b] - np.int32(at)
        block = own // self.SIZE
        starts = np.union1d(np.flatnonzero(np.diff(block)) + 1, np.arange(0, b - a, self.FEW))
        return int(a), int(b), own % self.SIZE * wide + block, starts, block[starts]

    def _products(self, hits: np.ndarray, local: np.ndarray) -> np.ndarray:
        """The sum over positives of each draw's products."""
        products = hits.view(np.uint16) * local.view(np.uint16)
        out = np.zeros(4, np.int64)
        for at in range(0, len(products), self.FEW * self.FEW):  # so many rows of FEW numbers stay within 32 bits; rows of four would be slow
            some = products[at : at + self.FEW * self.FEW]
            even = len(some) // self.FEW * self.FEW
            pairs = some[:even].view(np.uint32).reshape(-1, self.FEW // 2)
            sums = np.stack([(pairs & np.uint32(0xFFFF)).sum(axis=0, dtype=np.uint32), (pairs >> np.uint32(16)).sum(axis=0, dtype=np.uint32)], axis=1)
            out += sums.reshape(-1, 4).sum(axis=0, dtype=np.int64) + some[even:].reshape(-1, 4).sum(axis=0, dtype=np.int64)
        return out

    def plain(self) -> DrawnRanks:
        """The same, one draw at a time."""
        out = object.__new__(DrawnRanks)
        neg = np.concatenate([p.T.ravel() for p, _ in self.parts])[: self.n_neg]
        ends = ([place % p.shape[1] * self.SIZE + place // p.shape[1] + c * self.SIZE * self.WIDE for c, (p, places) in enumerate(self.parts) for place in [places[k][2]]] for k in range(2))
        out.pos, out.neg, out.last, (out.before, out.until) = self.pos.astype(np.intp), neg.astype(np.intp), self.last, map(np.concatenate, ends)
        return out

    def auc_and_ap_of_eight(self, times: np.ndarray, ap: bool = True) -> np.ndarray:
        """AUC and average precision (if not ap: NaN) of eight draws; times: a byte for each draw of how often it has a cluster, 0 in the last row."""
        lanes = lambda x: x.view(np.uint16).reshape(-1, 4)  # noqa: E731  draws 0, 2, 4, 6 of low numbers, 1, 3, 5, 7 of high ones
        mask, n_pos = np.uint64(0x00FF00FF00FF00FF), len(self.pos)
        sums, carry, hits_all = np.zeros((2, 4), np.int64), np.zeros((2, 4), np.int64), np.zeros((2, 4), np.int64)
        until = np.empty((2, n_pos, 4), np.int32) if ap else None
        hits = times.take(self.pos)
        hits = [hits & mask, (hits >> np.uint64(8)) & mask]
        for h in range(2):
            for at in range(0, n_pos, self.FEW):
                hits_all[h] += lanes(hits[h][at : at + self.FEW].sum(keepdims=True))[0]
        for part, places in self.parts:
            drawn = times.take(part)  # -1 is the last row
            wide = part.shape[1]
            for h in range(2):
                before = np.empty((self.SIZE + 1, wide), np.uint64)
                before[0] = 0
                np.bitwise_and(drawn if h == 0 else drawn >> np.uint64(8), mask, out=before[1:])
                for r in range(2, self.SIZE + 1):
                    before[r] += before[r - 1]
                whole = lanes(before[self.SIZE]).astype(np.int64)
                offsets = carry[h] + np.cumsum(whole, axis=0) - whole
                carry[h] += whole.sum(axis=0)
                local = [before.ravel().take(place) for _, _, place, _, _ in places]
                for side, (a, b, _, starts, block) in enumerate(places):
                    if a == b:
                        continue
                    sums[h] += (lanes(np.add.reduceat(hits[h][a:b], starts)).astype(np.int64) * offsets[block]).sum(axis=0)
                    if ap and side:
                        until[h, a:b] = lanes(local[1]) + offsets[np.repeat(block, np.diff(np.r_[starts, b - a]))]
                (a0, b0), (a1, b1) = places[0][:2], places[1][:2]  # a1 <= a0 and b1 <= b0: ties end later than they begin
                low, high = a0, max(a0, b1)  # with both ends here
                sums[h] += self._products(hits[h][low:high], local[0][: high - a0] + local[1][low - a1 : high - a1])
                sums[h] += self._products(hits[h][high:b0], local[0][high - a0 :]) + self._products(hits[h][a1 : min(b1, low)], local[1][: max(0, min(b1, low) - a1)])
        out = np.full((8, 2), np.nan)
        for h in range(2):
            for k in range(4):
                if not hits_all[h, k]:
                    continue
                if carry[h, k]:
                    out[2 * k + h, 0] = 1 - sums[h, k] / 2 / (hits_all[h, k] * carry[h, k])
                if ap:
                    one = lanes(hits[h])[:, k].astype(np.int64)
                    found = np.cumsum(one)[self.last]
                    out[2 * k + h, 1] = (one * (found / np.maximum(found + until[h, :, k], 1))).sum() / hits_all[h, k]
        return out


def bootstrap_mean(df: DataFrame, groups: Sequence[str], value: str, draws: int = 600, seed: int = 2026) -> DataFrame:
    """groups, mean, low, high of the mean, by drawing rows with replacement."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in groups)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[value].dropna().to_numpy(float))
        rng = np.random.default_rng(seed)
        means = [v[rng.integers(0, len(v), len(v))].mean() for _ in range(draws)] if len(v) else [np.nan]
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([[*(pdf[g].iloc[0] for g in groups), v.mean() if len(v) else np.nan, low, high]], columns=[*groups, "mean", "low", "high"])

    return df.select(*groups, value).groupBy(*groups).applyInPandas(run, f"{fields}, mean double, low double, high double")


def draw_index(weights: Sequence[float], u: Callable[[int], float], n: int) -> list[int]:
    """n places drawn with replacement by cumulative weight."""
    edges = np.cumsum(np.asarray(weights, float))
    return np.searchsorted(edges, [u(k) * edges[-1] for k in range(n)], "right").clip(0, len(edges) - 1).tolist()


__all__ = ["DrawnRanks", "PackedRanks", "bootstrap_auc", "bootstrap_mean", "draw_index", "fixed_weights", "interval", "one_per_group", "portable_hash", "sample", "stratified", "weighted_ap", "weighted_auc"]
