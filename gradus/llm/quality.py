"""Quality rules: adaptive thresholds from mergeable quantile sketches per language and source,
followed by joined filtering.

Features are counted per document. Each (language, source) has one KLL sketch for each feature, made
by partial aggregation; those of a language, and of the whole corpus, are merged from them. A
document is rejected if a feature lies far beyond the quartiles of its group, with groups of few
documents judged by their language, and languages of few by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, rows_of, small, window_hashes, word_hashes
from .tokens import arrow_type

SYMBOLS = "#*$%&|<>"

#: feature: (expression over the counts, least spread, whether low values are bad too). The least spread keeps groups of nearly equal documents from rejecting ordinary ones.
FEATURES = {
    "symbol_share": ("n_symbols / word_chars", 0.01, False),
    "dup_line_share": ("n_dup_lines / n_lines", 0.05, False),
    "repeat_share": ("n_repeat_words / n_words", 0.05, False),
    "mean_word": ("word_chars / n_words", 0.5, True),
}


def counts_of(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    s = text.decode("utf-8", "replace")
    words = text.split()
    symbols = sum(s.count(c) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) > 3:
        _, back, n = np.unique(window_hashes(word_hashes(words), 3), return_inverse=True, return_counts=True)
        marks = np.zeros(len(words), bool)
        often = n[back] > 1
        for k in range(3):
            marks[k : k + len(often)] |= often
        repeat = int(marks.sum())
    return len(words), len(s) - sum(s.count(c) for c in " \t\n\x0b\x0c\r"), symbols, len(lines) - len(set(lines)), repeat, len(lines)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the counts of each row's whole text; a null text has all counts 0."""
    got = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    id_type = arrow_type(got, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, langs, sources, texts in rows_of(batches, "id", "lang", "source", "text"):
            cols = zip(*(counts_of(t or b"") for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(langs, pa.binary()).cast(pa.string()), pa.array(sources, pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "lang", "source", *COUNTS])

    return got.mapInArrow(run, f"id {got.schema['id'].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_thresholds(rows: DataFrame, fence: float = 6.0, least_docs: int = 100, k: int = 400) -> DataFrame:
    """rows with accepted: whether each feature lies within the fences of the row's group.

    The fences stand fence spreads beyond the quartiles; the spread is the distance between the
    quartiles, or the feature's least spread. Only rows with a word and base_failed false shape the
    sketches. Null languages and sources are groups of their own.
    """
    rows = rows.withColumns({f: F.try_divide(*(F.col(x) for x in e.split(" / "))) for f, (e, _, _) in FEATURES.items()})
    judged = rows.where("not base_failed and n_words > 0")
    fine = judged.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(f, F.lit(k)).alias(f) for f in FEATURES))
    fine = kept(fine, "quality-sketches")
    by_lang = fine.groupBy("lang").agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(f, F.lit(k)).alias(f) for f in FEATURES))
    over_all = by_lang.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(f, F.lit(k)).alias(f) for f in FEATURES))

    def fences(sketches: DataFrame, prefix: str, *keys: str) -> DataFrame:
        out = sketches.select(*keys, F.col("n").alias(f"{prefix}n"), *(F.kll_sketch_get_quantile_double(f, F.lit(q)).alias(f"{f}_q{round(100 * q)}") for f in FEATURES for q in (0.25, 0.75)))
        cols = []
        for f, (_, least, both) in FEATURES.items():
            spread = F.greatest(F.col(f"{f}_q75") - F.col(f"{f}_q25"), F.lit(least)) * fence
            cols += [(F.col(f"{f}_q75") + spread).alias(f"{prefix}{f}_hi"), (F.col(f"{f}_q25") - spread if both else F.lit(float("-inf"))).alias(f"{prefix}{f}_lo")]
        return out.select(*keys, f"{prefix}n", *cols)

    table = fine.select("lang", "source").join(fences(fine, "s_", "lang", "source").withColumnsRenamed({"lang": "l1", "source": "s1"}), F.col("lang").eqNullSafe(F.col("l1")) & F.col("source").eqNullSafe(F.col("s1"))).drop("l1", "s1")
    table = table.join(fences(by_lang, "l_", "lang").withColumnRenamed("lang", "l1"), F.col("lang").eqNullSafe(F.col("l1"))).drop("l1").crossJoin(F.broadcast(fences(over_all, "a_")))  # one row
    pick = lambda c: F.when(F.col("s_n") >= least_docs, F.col(f"s_{c}")).when(F.col("l_n") >= least_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    table = table.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *(pick(f"{f}_{e}").alias(f"{f}_{e}") for f in FEATURES for e in ("lo", "hi")))
    table = small(kept(table, "quality-fences"))
    joined = rows.join(table, rows["lang"].eqNullSafe(table["t_lang"]) & rows["source"].eqNullSafe(table["t_source"]), "left").drop("t_lang", "t_source")
    ok = F.lit(True)
    for f in FEATURES:
        ok = ok & F.coalesce(F.col(f).between(F.col(f"{f}_lo"), F.col(f"{f}_hi")), F.lit(True))
    return joined.withColumn("accepted", ok)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """One row per row of docs: id_col, the counts, base_failed, kept, and each feature with its limits.

    A null or empty text has no words and fails the base; repeated rows each have their say; an
    empty table gives no rows.
    """
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = kept(features(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", base), "quality-features")
    out = with_thresholds(rows)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("accepted")).alias("kept"), *FEATURES, *(f"{f}_{e}" for f in FEATURES for e in ("lo", "hi")))
