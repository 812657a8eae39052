"""Language identification: known words by per-language log frequency, unseen words by backing off
to progressively shorter character n-grams.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .tokens import arrow_type

_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: bytes) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.decode("utf-8", "replace").lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its two ends marked."""
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Per-language log probabilities of words, and of n-grams of each length, one row each."""

    def __init__(self, counts: dict[str, dict[str, int]], longest: int = 4, alpha: float = 0.5, least: int = 2, cap: float = 4.0):
        """counts: language to word to how often it was seen. Words seen less than least times only
        count towards their n-grams. No word speaks against a language more than cap.
        """
        self.langs, self.longest = sorted(counts), longest
        by_lang = [counts[x] for x in self.langs]
        total = Counter()
        for c in by_lang:
            total.update(c)
        often = {w: k for k, w in enumerate(sorted(w for w, n in total.items() if n >= least))}
        self.words, self.word_rows = often, self._logs(often, by_lang, alpha, cap)
        self.grams, self.gram_rows = [{}], [np.zeros((0, len(by_lang)), np.float32)]
        for n in range(1, longest + 1):
            grams = []
            for c in by_lang:
                seen: dict[str, int] = defaultdict(int)
                for word, times in c.items():
                    for g in grams_of(word, n):
                        seen[g] += times
                grams.append(seen)
            index = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
            self.grams.append(index)
            self.gram_rows.append(self._logs(index, grams, alpha, cap))

    @staticmethod
    def _logs(index: dict[str, int], by_lang: list[dict[str, int]], alpha: float, cap: float) -> np.ndarray:
        m = np.full((len(index), len(by_lang)), alpha)
        for j, c in enumerate(by_lang):
            for key, times in c.items():
                if key in index:
                    m[index[key], j] += times
        m = np.log(m / m.sum(axis=0))
        return np.maximum(m - m.max(axis=1, keepdims=True, initial=-np.inf), -cap).astype(np.float32)  # only differences between languages count

    def unseen(self, word: str) -> np.ndarray | None:
        """From the longest n-grams of which any is known; None if not even a letter is."""
        for n in range(self.longest, 0, -1):
            index = self.grams[n]
            found = [index[g] for g in grams_of(word, n) if g in index]
            if found:
                return self.gram_rows[n][found].mean(axis=0)
        return None


class Predictor:
    """A model with a bounded memory of unseen words, as further rows."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.rows = np.concatenate([np.zeros((1, len(model.langs)), np.float32), model.word_rows, np.zeros((most, len(model.langs)), np.float32)])
        self.first = 1 + len(model.words)
        self.index: dict[str, int] = {}  # 0: nothing is known of it
        self.used = 0

    def _row(self, word: str) -> int:
        at = self.model.words.get(word, -1) + 1
        if not at:
            row = self.model.unseen(word)
            if row is not None:
                at = self.first + self.used
                self.rows[at] = row
                self.used += 1
        self.index[word] = at
        return at

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The language and its share of the likelihood, tempered by the root of the number of words."""
        words = Counter(words_of(text)) if text else None
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if self.used + len(words) > self.most or len(self.index) > 3 * self.most:
            self.index, self.used = {}, 0
            if len(words) > self.most:
                self.most = len(words)
                self.rows = np.concatenate([self.rows[: self.first], np.zeros((self.most, self.rows.shape[1]), np.float32)])
        get, row = self.index.get, self._row
        at = np.array([get(w, -1) for w in words])
        if (at < 0).any():
            at = np.array([row(w) if k < 0 else k for w, k in zip(words, at.tolist(), strict=True)])
        n = np.fromiter(words.values(), np.float64, len(words)) * (at > 0)
        if not n.any():
            return UNKNOWN, 0.0
        total = n @ self.rows[at]
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp((total - total[best]) / math.sqrt(n.sum())).sum())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = 300) -> Model:
    """From rows with a language and a text: about docs_per_lang of each language, chosen by a hash
    of the id. That sample bounds the model, however many rows there are; the number of languages is
    bounded by nature.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count("*")).alias("share"))
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, Counter] = defaultdict(Counter)
        for langs, texts in rows_of(batches, "lang", "text"):
            for lang, text in zip(langs, texts, strict=True):
                seen[lang].update(words_of(text))
        for lang, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = defaultdict(dict)
    found = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    for lang, word, n in zip(found["lang"], found["word"], found["n"], strict=True):
        counts[lang][word] = n
    return Model(counts)


_predictors: dict[str, Predictor] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of all but its own columns.

    A null text, one without letters, and any text under a model without languages gives `und` and
    score 0. Whole texts are read; ties go to the first language in alphabetical order; repeated
    rows are predicted each; an empty table gives no rows.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = arrow_type(got, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _predictors:
            _predictors.clear()
            _predictors[name] = Predictor(shared.value)
        p = _predictors[name]
        for ids, texts in rows_of(batches, "id", "text"):
            found = [p.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([x for x, _ in found]), pa.array([round(x, 6) for _, x in found])], names=["id", "lang_pred", "score"])

    return got.mapInArrow(run, f"id {got.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language with at least least_score."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _predictors:
            _predictors.clear()
            _predictors[name] = Predictor(shared.value)
        for batch in batches:
            found = [_predictors[name].predict(t) for (texts,) in rows_of([batch], text_col) for t in texts]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, modulus: int, remainder: int):
    """By the CRC-32 of the id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus)) == remainder
