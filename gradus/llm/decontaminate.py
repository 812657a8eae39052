"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Words are runs of ASCII digits, ASCII letters (lower-cased) and bytes over 127. A window is ten
consecutive words of an item, or the whole item if it has fewer. Each text is normalised to its
words with one space around each, scanned once, and hits are mapped back to offsets in the original.
"""

from __future__ import annotations

import hashlib
import uuid
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, rows_of
from .tokens import arrow_type

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(items: list[tuple[str | None, bytes]], size: int) -> dict[str, tuple[int, list[str | None]]]:
    """Padded window (as Latin-1 text, one character a byte) to its number of words and its items."""
    found: dict[str, tuple[int, list[str | None]]] = {}
    for item, text in items:
        words = normal_words(text)
        for at in range(max(len(words) - size + 1, 1) if words else 0):
            part = words[at : at + size]
            key = " " + b" ".join(part).decode("latin-1") + " "
            owners = found.setdefault(key, (len(part), []))[1]
            if item not in owners:
                owners.append(item)
    return found


class Scanner:
    def __init__(self, windows: dict[str, tuple[int, list[str | None]]]):
        self.auto = ahocorasick.Automaton()
        for key, value in windows.items():
            self.auto.add_word(key, value)
        if windows:
            self.auto.make_automaton()
        self.any = bool(windows)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, list[str | None]]]]:
        """The number of words, and for each hit its first word, one past its last, and its items."""
        words = normal_words(text)
        if not self.any or not words:
            return len(words), []
        line = " " + b" ".join(words).decode("latin-1") + " "
        ends = list(self.auto.iter(line))
        if not ends:
            return len(words), []
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        last = np.searchsorted(gaps, [e for e, _ in ends])
        return len(words), [(int(k) - n, int(k), items) for k, (_, (n, items)) in zip(last, ends, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as offsets in code points of the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    chars = lambda at: len(text[:at].decode("utf-8", "replace"))
    return [(chars(places[a][0]), chars(places[b - 1][1])) for a, b in spans]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, most_bytes: int = 1 << 19) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans holds [start, end) offsets in code points of the original, for each merged run of hit words.
    A null or empty text has no words and is clean; items without text or words have no windows; equal
    windows of several items count for each; repeated rows are scanned each. Items without an id count
    as one in n_items and are not in items_sha256, as in the SQL.

    Benchmark items are gathered on the driver only if all their text fits most_bytes, some 60,000
    windows or 220 MB of automaton. A larger
    benchmark is dealt by item into shards of at most that size, each scanned with its own automaton,
    and the hits of the shards are joined per document.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("t")).where(F.length("t") > 0).dropDuplicates()
    total, longest = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.coalesce(F.max(F.octet_length("t")), F.lit(0))).first()
    shards = max(1, -(-2 * total // most_bytes)) if total > most_bytes else 1
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if shards == 1:
        out = _scan(got, items, window)
    else:
        got = kept(got.select(F.struct("id", F.monotonically_increasing_id().alias("row")).alias("id"), "text"), "decontaminate")
        parts = [_scan(got, items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k), window) for k in range(shards)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = _joined(out).withColumn("id", F.col("id.id"))
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


_scanners: dict[str, Scanner] = {}
_SPANS = "array<struct<a:long,b:long>>"


def _scan(got: DataFrame, items: DataFrame, window: int) -> DataFrame:
    windows = windows_of([(r.item, r.t.encode()) for r in items.collect()], window)
    shared, name = got.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex
    id_type = arrow_type(got, "id")
    span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scanners:  # built once in each worker, not in each task
            _scanners.clear()
            _scanners[name] = Scanner(shared.value)
        scanner = _scanners[name]
        for ids, texts in rows_of(batches, "id", "text"):
            n, words, spans, found = [], [], [], []
            for t in texts:
                count, hits = scanner.scan(t or b"")
                runs = merged([(a, b) for a, b, _ in hits])
                n.append(count)
                words.append([{"a": a, "b": b} for a, b in runs])
                spans.append([{"a": a, "b": b} for a, b in original_offsets(t, runs)] if runs else [])
                found.append(sorted({i for _, _, owners in hits for i in owners}, key=lambda i: (i is None, i or "")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(n, pa.int64()), pa.array(words, span_type), pa.array(spans, span_type), pa.array(found, pa.list_(pa.string()))], names=["id", "n_words", "words", "spans", "items"])

    return got.mapInArrow(run, f"id {got.schema['id'].dataType.simpleString()}, n_words long, words {_SPANS}, spans {_SPANS}, items array<string>")


def _joined(parts: DataFrame) -> DataFrame:
    """The shards' rows of a row as one; ids carry the row's number here."""
    width = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            for k in ("words", "spans"):
                cols[k] = [[{"a": a, "b": b} for a, b in merged([(s["a"], s["b"]) for s in row])] for row in cols[k]]
            yield pa.RecordBatch.from_arrays([pa.array(cols["id"], batch.schema.field("id").type), pa.array(cols["n_words"], pa.int64()), pa.array(cols["words"], width), pa.array(cols["spans"], width), pa.array(cols["items"], pa.list_(pa.string()))], names=["id", "n_words", "words", "spans", "items"])

    flat = parts.groupBy("id").agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("words", "spans")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return flat.mapInArrow(run, f"id {flat.schema['id'].dataType.simpleString()}, n_words long, words {_SPANS}, spans {_SPANS}, items array<string>")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
