"""Packing token sequences: a configuration linear program over the histogram of lengths, solved by
multiplicative weights with knapsack dynamic programming as pricing, rounded down, and the rest
packed by best fit.

Only the histogram (at most one count per length) reaches the driver. What comes back is a table of
runs: which ranks of a length go to which sequences at which offset. Its size depends on the number
of lengths and iterations, not on the number of pieces. Pieces are ranked within (length, salt).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, rows_of
from .tokens import arrow_type, coder

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, most: int = 4096) -> DataFrame:
    """id, piece, start, length, ids_crc32: each text's ids and end_id, cut after every most ids.

    A null or empty text has end_id alone. Only the part of a text that makes one piece is held.
    """
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, end = arrow_type(got, "id"), int(end_id).to_bytes(4, "little")
    full = 4 * most

    def cut(text: bytes) -> Iterator[tuple[int, int]]:
        """Length and CRC-32 of each piece."""
        rest = bytearray()
        for part in coder(path, lengths=False).ids(text):
            rest += part
            while len(rest) > full:  # something follows, end_id at least
                yield most, zlib.crc32(memoryview(rest)[:full])
                del rest[:full]
        if len(rest) == full:
            yield most, zlib.crc32(rest)
            rest.clear()
        rest += end
        yield len(rest) // 4, zlib.crc32(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "id", "text"):
            rows = [(i, k, k * most, n, crc) for i, t in zip(ids, texts, strict=True) for k, (n, crc) in enumerate(cut(t or b""))]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["id", "piece", "start", "length", "ids_crc32"])

    return got.mapInArrow(run, f"id {got.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[list[int], float]:
    """How many of each size (ascending) are in a pattern of greatest total price, and that price.

    Rooms are solved in blocks as long as the least size, which look only at earlier blocks.
    """
    low = int(sizes[0])
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for at in range(low, capacity + 1, low):
        rooms = np.arange(at, min(at + low, capacity + 1))
        some = int(np.searchsorted(sizes, rooms[-1], "right"))
        left = rooms - sizes[:some, None]
        values = np.where(left >= 0, best[np.maximum(left, 0)] + prices[:some, None], -1.0)
        k = values.argmax(axis=0)
        value = values[k, rooms - at]
        best[rooms] = np.maximum.accumulate(np.maximum(value, best[at - 1]))
        took[rooms] = np.where(value >= best[rooms], k, -1)  # -1: a token left empty
    found, c = [0] * len(sizes), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            found[took[c]] += 1
            c -= int(sizes[took[c]])
    return found, float(best[capacity])


def best_pattern(prices: np.ndarray, capacity: int) -> Pattern:
    """The lengths (prices[n] for length n; 0 for none) of greatest total price that fit: an unbounded knapsack."""
    sizes = np.flatnonzero(prices > 0)
    if not len(sizes):
        return ()
    found, _ = _knapsack(sizes, prices[sizes], capacity)
    return tuple((int(n), k) for n, k in zip(sizes[::-1], found[::-1], strict=True) if k)


def classes_of(histogram: dict[int, int], capacity: int, most: int = 48) -> list[list[int]]:
    """Lengths in classes, ascending: a frequent length alone, runs of rare ones together.

    There are at most about 2 * most classes. Lengths under capacity / 128 are in none: they fill what is left.
    """
    own = sorted(n for n in histogram if n * 128 >= capacity)
    share = sum(n * histogram[n] for n in own) / most
    alone = {n for n in own if n * histogram[n] >= share / 2}
    out: list[list[int]] = [[n] for n in alone]
    run: list[int] = []
    for n in own:
        if n not in alone:
            if run and sum(m * histogram[m] for m in run) + n * histogram[n] > share:
                out.append(run)
                run = []
            run.append(n)
    return sorted([*out, *([run] if run else [])], key=lambda c: c[-1])


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.01, rate: float = 10.0, part: float = 0.05, most: int = 60) -> tuple[dict[tuple[int, ...], float], float]:
    """Weights of patterns (how many of each size) that cover demand, and a lower bound on their least sum.

    Each iteration prices sizes by how far they are from covered, takes the best pattern, and adds a
    part of what its scarcest size allows. Every iteration's prices, scaled so that no pattern is worth more
    than one sequence, bound the sum from below. It goes on until every size is covered and the sum
    is within gap of the bound, or for `most` iterations a size and as many more as the cover takes.
    """
    cover = np.zeros(len(sizes))
    out: Counter[tuple[int, ...]] = Counter()
    total, bound, n = 0.0, 0.0, 0
    while cover.min() < 1 or (total > (1 + gap) * bound * cover.min() and n < most * len(sizes)):
        n += 1
        prices = sizes / capacity * np.exp(-rate * (cover - cover.min()))
        pattern, value = _knapsack(sizes, prices, capacity)
        bound = max(bound, float(prices @ demand) / value)
        counts = np.array(pattern)
        held = counts > 0
        step = part * float((demand[held] / counts[held]).min())
        cover += counts * step / demand
        out[tuple(pattern)] += step
        total += step
    return {p: x / cover.min() for p, x in out.items()}, bound


def best_fit(rest: dict[int, int], capacity: int, begun: Counter[Pattern] | None = None) -> Counter[Pattern]:
    """Best fit of the longest first, for runs of equal lengths and of equally filled sequences at once.

    begun are sequences that hold something already.
    """
    open_: dict[int, Counter[Pattern]] = {}  # room left: patterns
    done: Counter[Pattern] = Counter()

    def put(pattern: Pattern, room: int, n: int) -> None:
        if room:
            open_.setdefault(room, Counter())[pattern] += n
        else:
            done[pattern] += n

    for pattern, n in (begun or {}).items():
        put(pattern, capacity - sum(length * k for length, k in pattern), n)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            room = min((r for r in open_ if r >= length), default=0)
            if room:
                pattern, n = next(iter(open_[room].items()))
                each = min(room // length, left)
                n = min(n, left // each)
                open_[room][pattern] -= n
                if not open_[room][pattern]:
                    del open_[room][pattern]
                if not open_[room]:
                    del open_[room]
            else:
                pattern, room, each = (), capacity, min(capacity // length, left)
                n = left // each
            put((*pattern, (length, each)), room - each * length, n)
            left -= n * each
    for patterns in open_.values():
        done.update(patterns)
    return done


def plan(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """How often each pattern is filled, all together holding exactly the histogram, in as few
    sequences as either the rounded program or best fit alone needs.
    """
    histogram = {n: c for n, c in histogram.items() if c > 0}
    return min(rounded(histogram, capacity), best_fit(histogram, capacity), key=lambda p: sum(p.values()))


def rounded(histogram: dict[int, int], capacity: int, rounds: int = 3) -> Counter[Pattern]:
    """The program's patterns in whole numbers, again for what they leave, and best fit for the rest.

    A place of a pattern is as long as the longest of its class, and lengths of the class take it in
    turn, longest first; the room this leaves is best fit's too.
    """
    rest, out = dict(histogram), Counter()
    for _ in range(rounds):
        classes = classes_of(rest, capacity)
        if not classes:
            break
        weights, bound = solve(np.array([c[-1] for c in classes]), np.array([float(sum(rest[n] for n in c)) for c in classes]), capacity)
        queues = [[[n, rest[n]] for n in c] for c in classes]
        left = [sum(rest[n] for n in c) for c in classes]
        taken = 0
        for pattern, x in sorted(weights.items(), key=lambda p: (-p[1], p[0])):
            times = int(min(x, *(left[j] // k for j, k in enumerate(pattern) if k)))
            taken += times
            for j, k in enumerate(pattern):
                left[j] -= k * times
            while times:
                n, places = times, []
                for j, k in reversed(list(enumerate(pattern))):
                    at = len(queues[j]) - 1
                    if k and queues[j][at][1] >= k:
                        n = min(n, queues[j][at][1] // k)
                        places.append((queues[j][at][0], k))
                    else:
                        while k:  # few are left of this length: one sequence takes them and some of the next
                            some = min(k, queues[j][at][1])
                            places.append((queues[j][at][0], some))
                            n, k, at = 1, k - some, at - 1
                for length, k in places:
                    rest[length] -= k * n
                for j in range(len(pattern)):
                    for pair in queues[j]:
                        pair[1] = rest[pair[0]]
                    while queues[j] and not queues[j][-1][1]:
                        queues[j].pop()
                out[tuple(places)] += n
                times -= n
        rest = {n: c for n, c in rest.items() if c}
        if taken * 20 < bound:
            break
    return best_fit(rest, capacity, out)


def runs_of(patterns: Counter[Pattern]) -> dict[int, np.ndarray]:
    """Length to rows (first rank, first sequence, how many in each sequence, offset of the first there)."""
    ranks: Counter[int] = Counter()
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for pattern, times in sorted(patterns.items()):
        at = 0
        for n, k in pattern:
            found.setdefault(n, []).append((ranks[n], first, k, at))
            ranks[n] += k * times
            at += n * k
        first += times
    return {n: np.array(rows, np.int64) for n, rows in found.items()}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, most: int = 4096, share: int = 100_000) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs gives at least one piece; null and empty texts one of length 1; repeated rows
    are packed each; an empty table gives no rows.
    """
    written = kept(pieces(docs, path, id_col, text_col, end_id, most), "pieces")
    salts = 64 + written.count() // share  # so that one length's pieces are ranked some `share` at a time, however many there are
    rows = written.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    counts = kept(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    table = rows.sparkSession.sparkContext.broadcast(runs_of(plan(histogram, most)))
    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32"))).join(before, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    fields = [f for f in ranked.schema.fields if f.name != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                runs = table.value[int(n)]
                run = runs[np.searchsorted(runs[:, 0], rank[own], "right") - 1]
                nth = rank[own] - run[:, 0]
                sequence[own] = run[:, 1] + nth // run[:, 2]
                offset[own] = run[:, 3] + nth % run[:, 2] * n
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [pa.array(sequence), pa.array(offset)], names=[*(f.name for f in fields), "sequence_id", "offset"])

    out = ranked.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
