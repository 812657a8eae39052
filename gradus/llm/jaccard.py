"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its word shingles. Shingles are hashed into groups; the counts of a
document's shingles in each group are a point, and the summed coordinate minima of two points bound
their overlap from above. Points are indexed in R-trees whose boxes carry the same bound, and pairs
that survive are verified on the whole sets.

Count vectors of unrelated texts of one length lie close together in every single coordinate, so no
tree over a whole corpus prunes by itself. Trees are therefore built within blocks that no linked
pair can miss: linked sets share at least one of the first floor((1 - s) * n) + 1 shingles of each, in
any one order of all shingles. The order is by how often the shingles of a hash cell occur, counted
over all documents, so that common passages come last and blocks stay small.

Equal sets are one node. Links within a block first go through one document of it (its pivot); only
blocks that then still hold several components are searched by tree, and only across components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mix, released, rows_of, small, window_hashes, word_hashes
from .graph import components
from .tokens import arrow_type

CELLS = 1 << 18
GROUPS = 256


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words, or of the whole if there are fewer; ASCII letters lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(size, len(words))))


def packed(counts: np.ndarray) -> bytes:
    """Counts by group in one, two or four bytes each, as the largest needs."""
    most = int(counts.max(initial=0))
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    """The counts of packed points, a row for each, in as few bytes as the largest needs."""
    width = max(map(len, points)) // GROUPS
    if all(len(x) == width * GROUPS for x in points):
        return np.frombuffer(b"".join(points), f"<u{width}").reshape(-1, GROUPS)
    return np.array([np.frombuffer(x, f"<u{len(x) // GROUPS}") for x in points], f"<u{width}")


def cell_counts(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """How many (document, shingle) fall into each hash cell, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for (texts,) in rows_of(batches, "text"):
            found = np.concatenate([shingles(t, size) for t in texts if t] or [np.empty(0, np.uint64)])
            total += np.bincount((found >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    out = np.zeros(CELLS, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def sketches(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """id, n (size of the set), sig (a hash of the whole set), prefix (the shingles to block by), point."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = arrow_type(got, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for ids, texts in rows_of(batches, "id", "text"):
            n, sigs, prefixes, points = [], [], [], []
            for t in texts:
                s = shingles(t or b"", size)
                n.append(len(s))
                k = (100 - percent) * len(s) // 100 + 1
                first = s
                if len(s) > k:
                    key = often[(s >> np.uint64(40)).astype(np.int64) % CELLS].astype(np.uint64) << np.uint64(20) | (s >> np.uint64(44))
                    first = s[np.lexsort((s, key))[:k]]
                prefixes.append(first.view(np.int64).tolist())
                sigs.append(int((mix(s) * np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64)) ^ len(s) if len(s) else None)
                points.append(packed(np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(n, pa.int64()), pa.array(sigs, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(points, pa.binary())], names=["id", "n", "sig", "prefix", "point"])

    return got.mapInArrow(run, f"id {got.schema['id'].dataType.simpleString()}, n long, sig long, prefix array<long>, point binary")


class Tree:
    """An R-tree over count vectors, packed in slabs of like size, and in a slab by component and the
    widest coordinate. A box has its upper corner, which bounds overlaps, its least and greatest set
    size, and the component of all its points if they have only one.

    Given the place of the block's shingle in each set's order, and the shingles before it, a pair is
    taken only where that shingle can be the first that the two sets share.
    """

    LEAF = 32
    FAN = 8
    MANY = np.iinfo(np.int64).min

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, places: np.ndarray | None = None, before: np.ndarray | None = None):
        by_size = np.lexsort((comps, sizes))
        slab = np.empty(len(sizes), np.int64)
        slab[by_size] = np.arange(len(sizes)) // max(self.LEAF, int((len(sizes) * self.LEAF) ** 0.5))
        widest = int((points.max(axis=0) - points.min(axis=0)).argmax())
        self.order = np.lexsort((points[:, widest], comps, slab))
        self.points, self.sizes, self.comps = points[self.order], sizes[self.order], comps[self.order]
        self.places = np.zeros(len(sizes), np.int64) if places is None else places[self.order]
        self.before = np.zeros((len(sizes), 0), np.int64) if before is None else before[self.order]
        level = (self.points, self.sizes, self.sizes, self.comps)
        self.levels = [level := self._boxes(*level, self.LEAF)]
        while len(level[1]) > 1:
            self.levels.append(level := self._boxes(*level, self.FAN))

    def _boxes(self, high, least, most, comp, fan: int) -> tuple[np.ndarray, ...]:
        """The boxes around every fan entries."""
        at = np.arange(0, len(least), fan)
        low, top = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
        return np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.where(low == top, low, self.MANY)

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (a, b) of points of different components whose bound allows a link."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            depth, i, j = stack.pop()
            if not depth:
                yield from self._leaf_pairs(i, j, percent)
                continue
            high, least, most, comp = self.levels[depth - 1]
            for x in range(i * self.FAN, min((i + 1) * self.FAN, len(least))):
                y = np.arange(max(x, j * self.FAN), min((j + 1) * self.FAN, len(least)))
                y = y[((comp[y] != comp[x]) | (comp[x] == self.MANY)) & (100 * most[x] >= percent * least[y]) & (100 * most[y] >= percent * least[x])]
                y = y[_may_link(np.minimum(high[x], high[y]).sum(axis=1, dtype=np.int64), least[x], least[y], percent)]
                stack += [(depth - 1, x, int(k)) for k in y]

    def _leaf_pairs(self, i: int, j: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = (slice(k * self.LEAF, (k + 1) * self.LEAF) for k in (i, j))
        na, nb = self.sizes[a][:, None], self.sizes[b][None]
        ok = self.comps[a][:, None] != self.comps[b][None]
        ok &= _may_link(np.minimum(na - self.places[a][:, None], nb - self.places[b][None]), na, nb, percent)  # if it is the first shared shingle, no more are shared
        for x in self.before[a].T:
            for y in self.before[b].T:
                ok &= (x[:, None] != y[None]) | (x[:, None] == 0)  # found in the block of that shingle
        if not ok.any():
            return
        ok &= _may_link(np.minimum(self.points[a][:, None], self.points[b][None]).sum(axis=2, dtype=np.int64), na, nb, percent)
        if i == j:
            ok = np.triu(ok, 1)
        x, y = np.nonzero(ok)
        if len(x):
            yield self.order[x + a.start], self.order[y + b.start]


def _may_link(overlap, a, b, percent: int):
    """Whether sets of sizes a and b with at most this overlap can have that share of their union."""
    return (100 + percent) * overlap >= percent * (a + b)


def _tree_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (block, half): a block's rows in one tree. Large blocks come as pairs of parts."""
        block, rows = None, []

        def search() -> Iterator[pa.RecordBatch]:
            if rows:
                t = pa.concat_tables(rows)
                if t.num_rows > 1:
                    points = unpacked(t["point"].to_pylist())
                    before = np.stack([t[c].to_numpy() for c in ("before", "before2")], axis=1)
                    sigs = t["sig"].to_numpy()
                    for a, b in Tree(points, t["n"].to_numpy(), t["comp"].to_numpy(), t["pos"].to_numpy().astype(np.int64), before).pairs(percent):
                        x, y = sigs[a], sigs[b]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                if keys[at] != block:
                    if rows:
                        yield from search()
                    block, rows = keys[at], []
                rows.append(pa.Table.from_batches([batch.slice(at, end - at)]))
        if rows:
            yield from search()

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b: sigs) whose whole sets link; a kept table. Sets are made anew from the texts, of the documents needed only."""
    needed = kept(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(nodes.select("sig", "doc"), "sig"), "jaccard-needed")
    ids = small(needed).select(F.col("doc").alias("__doc"), "sig")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    got = texts.join(ids, F.col("__id").eqNullSafe(F.col("__doc"))).select("sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sigs, texts in rows_of(batches, "sig", "text"):
            sets = [shingles(t or b"", size) for t in texts]
            own = [int((mix(s) * np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64)) ^ len(s) if len(s) else None for s in sets]
            ok = [i for i in range(len(sigs)) if own[i] == sigs[i]]  # ids may repeat with other texts
            yield pa.RecordBatch.from_arrays([pa.array([sigs[i] for i in ok], pa.int64()), pa.array([sets[i].view(np.int64).tolist() for i in ok], pa.list_(pa.int64()))], names=["sig", "items"])

    made = kept(got.mapInArrow(run, "sig long, items array<long>"), "jaccard-sets")
    sets = made.dropDuplicates(["sig"])
    both = pairs.join(sets.withColumnsRenamed({"sig": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"sig": "b", "items": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = kept(both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"), "jaccard-links")
    released(needed, made)
    return out


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (p, pn, pp, sig, n, point) whose points allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                overlap = np.minimum(unpacked(col("point").to_pylist()), unpacked(col("pp").to_pylist())).sum(axis=1, dtype=np.int64)
                ok = _may_link(overlap, col("n").to_numpy(), col("pn").to_numpy(), percent)
                x, y = col("sig").to_numpy()[ok], col("p").to_numpy()[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _members(chosen: DataFrame) -> DataFrame:
    """block, sig, n, pos, before, before2: a row per shingle of each prefix, with the two shingles before it.

    They are taken here, so that no row carries a whole prefix through the shuffle that follows.
    """
    earlier = lambda i, k: F.coalesce(F.get("prefix", i - k), F.lit(0))
    rows = F.transform("prefix", lambda x, i: F.struct(x.alias("block"), i.alias("pos"), earlier(i, 1).alias("before"), earlier(i, 2).alias("before2")))
    return chosen.select("sig", "n", F.explode(rows).alias("m")).select("m.block", "sig", "n", "m.pos", "m.before", "m.before2")


def links_and_nodes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, part: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """A row per document (id, n, sig), and components of linked sigs (node, comp)."""
    made = kept(sketches(docs, cell_counts(docs, text_col, size), id_col, text_col, size, percent).withColumn("row", F.monotonically_increasing_id()), "jaccard-sketches")
    rows = kept(made.select("id", "n", "sig"), "jaccard-rows")
    reps = kept(made.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "row")).alias("r")).select(F.col("r.row").alias("row")), "jaccard-reps")
    chosen = kept(made.join(small(reps), "row").select("sig", "n", F.col("id").alias("doc"), "prefix", "point"), "jaccard-chosen")
    released(made, reps)
    nodes = kept(chosen.select("sig", "n", "doc", "point"), "jaccard-nodes")
    shared = kept(chosen.select(F.explode("prefix").alias("block")).groupBy("block").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-blocks")
    multi = kept(_members(chosen).join(small(shared), "block"), "jaccard-members")
    released(chosen, shared)

    # One document of each block first: the one whose shingles most others share. That is the text that
    # the others of a large group were copied from, if it is there; any other would link to few of them.
    central = multi.groupBy("sig").agg(F.sum("size").alias("central"))
    pivots = multi.select("block", "sig", "n").join(central, "sig").groupBy("block").agg(F.max(F.struct("central", "n", "sig")).alias("pivot"))
    near = multi.join(pivots, "block").where((F.col("sig") != F.col("pivot.sig")) & (100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")))
    pairs = near.select(F.col("pivot.sig").alias("p"), "sig").distinct()
    points = nodes.select("sig", "n", "point")
    star = kept(_bounded(pairs.join(points.withColumnsRenamed({"sig": "p", "n": "pn", "point": "pp"}), "p").join(points, "sig"), percent).distinct(), "jaccard-star")
    links = _verified(star, nodes, docs, id_col, text_col, size, percent)
    comps = components(links)

    # Then the blocks that still hold several components, by tree.
    labelled = multi.join(comps.select(F.col("node").alias("sig"), "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    labelled = kept(labelled, "jaccard-labelled")
    released(multi)
    mixed = labelled.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("block")
    open_ = labelled.join(mixed, "block").join(nodes.select("sig", "point"), "sig")
    # A block over part rows is dealt into parts, and each pair of parts is searched on its own.
    n_parts = F.ceil(F.col("size") / F.lit(part)).cast("int")
    mine = F.pmod(F.xxhash64("sig"), n_parts.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), n_parts - 1))
    dealt = open_.withColumn("mine", mine).withColumn("other", other).withColumn("key", F.xxhash64("block", F.least("mine", "other"), F.greatest("mine", "other")))
    dealt = dealt.select("key", "sig", "n", "comp", "point", "pos", "before", "before2").repartition("key").sortWithinPartitions("key")
    found = kept(dealt.mapInArrow(_tree_pairs(percent), "a long, b long").distinct().join(star, ["a", "b"], "left_anti"), "jaccard-rest")
    released(labelled, star)
    if not found.isEmpty():
        more = _verified(found, nodes, docs, id_col, text_col, size, percent)
        both = kept(links.unionByName(more), "jaccard-links")
        released(links, more, comps)
        links, comps = both, components(both)
    released(found, nodes, links)
    return rows, comps


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the least id that links reach, itself included).

    Two documents link if 100 * intersection >= percent * union of their shingle sets. Null and empty
    texts and texts without words have no shingles and are groups of their own. Equal sets always
    link; rows with one id and different texts are treated as different documents that share the id.
    """
    rows, comps = links_and_nodes(docs, id_col, text_col, size, percent)
    least = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("doc")).join(small(comps).select(F.col("node").alias("sig"), "comp"), "sig", "left").select("sig", F.coalesce("comp", "sig").alias("comp"), "doc")
    least = kept(least, "jaccard-least")
    named = kept(least.select("sig", "comp").join(least.groupBy("comp").agg(F.min("doc").alias("component_id")), "comp").select("sig", "component_id"), "jaccard-named")
    out = kept(rows.join(named, "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "jaccard-components")
    released(rows, comps, least, named)
    return out
