"""Scoring texts with a log-bilinear language model.

Words are counted over all training documents. Every token belongs to a class: the end of a text,
one of the most frequent words (2,047 of them, each a class of its own), or one of 256 classes of the
other words by their last bytes. The model predicts the class of a token from the word before it:
the context is a linear map of that word's embedding, and a class scores the inner product with its
own vector plus a bias. It is trained in numpy by noise-contrastive estimation against noise classes
drawn anew for each step from the class frequencies, on the counts of all class pairs of all training
documents; the table of these counts follows the corpus until every pair has been seen. Batched
matrix products give the scores of every class after every context; they are normalised exactly, so a
text's score is a sum of looked-up log-probabilities. Within a class, words share its probability by
their smoothed counts, with one share for all unseen words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, rows_of, word_hashes
from .tokens import arrow_type

END = b" "  # no word has a space
ALPHA = 0.1


@dataclass
class Classes:
    """0 is the end; then the frequent words, then the rest by their last bytes."""

    top: dict[bytes, int]
    rest: int

    @property
    def n(self) -> int:
        return 1 + len(self.top) + self.rest

    def of(self, word: bytes) -> int:
        if word == END:
            return 0
        found = self.top.get(word)
        return 1 + len(self.top) + zlib.crc32(word[-3:]) % self.rest if found is None else found


class Vocabulary:
    """Counts by hash, of a vocabulary that one machine can hold."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def of(self, words: list[bytes]) -> np.ndarray:
        h = word_hashes(words).view(np.int64)
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)


def _coded(texts: list[bytes | None], classes: Classes, memory: dict[bytes, int], most: int = 500_000) -> Iterator[np.ndarray]:
    """The classes of each text's tokens."""
    for t in texts:
        words = (t or b"").lower().split()
        if len(memory) > most:
            memory.clear()
        for w in set(words).difference(memory):
            memory[w] = classes.of(w)
        yield np.fromiter(map(memory.__getitem__, words), np.int64, len(words))


def count_pairs(docs: DataFrame, text_col: str, classes: Classes, part: int = 1 << 20) -> np.ndarray:
    """How often each class follows each, (n, n), gathered from all of docs; a text begins after an end."""
    k = classes.n
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memory, waiting, n = np.zeros(k * k, np.int64), {}, [], 0
        for (texts,) in rows_of(batches, "text"):
            for c in _coded(texts, shared.value, memory):
                a = np.concatenate([[0], c, [0]])
                waiting.append(a[:-1] * k + a[1:])
                n += len(a)
            if n > part:
                total += np.bincount(np.concatenate(waiting), minlength=k * k)
                waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=k * k)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 17):
            own = some[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["cell", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most n ** 2 rows of 12 bytes
    out = np.zeros(k * k, np.float32)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(k, k)


def train(counts: np.ndarray, size: int = 32, steps: int = 80, rate: float = 0.04, noise: float = 20.0, drawn: int = 2048, prior: float = 5.0, seed: int = 7) -> np.ndarray:
    """log10 P(class | context), of the shape of counts, from how often each of k classes follows each context.

    There are k ** m contexts, numbered by their m classes. A step draws `drawn` noise classes for all
    contexts. Vectors have a normal prior of precision `prior`, which weighs less the more tokens there are.
    Contexts that never occur take no part in training but are scored.
    """
    k = counts.shape[1]
    order = next(m for m in range(1, 64) if k**m >= len(counts))
    rng = np.random.default_rng(seed)
    total = max(float(counts.sum(dtype=np.float64)), 1.0)
    share = (counts.sum(axis=0, dtype=np.float64) + 1) / (total + k)
    p = {"e": rng.normal(0, 0.1, (k, size)), "q": rng.normal(0, 0.1, (k, size)), "b": np.log(share)}
    p |= {f"c{j}": np.eye(size) * 0.5 for j in range(order)}
    p = {n: v.astype(np.float32) for n, v in p.items()}
    seen = np.flatnonzero(counts.sum(axis=1))
    places = [seen // k ** (order - 1 - j) % k for j in range(order)]
    target = (counts[seen] / total).astype(np.float32)
    weight = target.sum(axis=1, keepdims=True)
    shift = np.log(noise * share).astype(np.float32)
    m1, m2 = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if len(seen) else 1):
        parts = [p["e"][at] for at in places]
        r = sum(x @ p[f"c{j}"] for j, x in enumerate(parts))
        g = r @ p["q"].T
        g += p["b"] - shift
        np.clip(g, -60, 60, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)  # that a class came from the noise, not the data
        chosen, times = np.unique(rng.choice(k, drawn, p=share), return_counts=True)
        false = (1 - g[:, chosen]) * weight * (times * (noise / drawn)).astype(np.float32)
        g *= target
        g[:, chosen] -= false
        gr = g @ p["q"]
        grads = {"q": g.T @ r, "b": g.sum(axis=0), "e": np.zeros_like(p["e"])}
        for j, (x, at) in enumerate(zip(parts, places, strict=True)):
            grads[f"c{j}"] = x.T @ gr
            back = gr @ p[f"c{j}"].T
            if order == 1:
                grads["e"][at] += back  # each context has its own row
            else:
                np.add.at(grads["e"], at, back)
        for n in ("e", "q"):
            grads[n] -= (prior / total) * p[n]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))  # slower in the second half
        for n, d in grads.items():  # Adam, uphill
            m1[n] = 0.9 * m1[n] + 0.1 * d
            m2[n] = 0.99 * m2[n] + 0.01 * d * d
            p[n] += (pace * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-10)).astype(np.float32)
    out = np.empty(counts.shape, np.float32)
    for at in range(0, len(out), 1024):  # a batch of contexts at a time
        own = np.arange(at, min(at + 1024, len(out)))
        s = sum(p["e"][own // k ** (order - 1 - j) % k] @ p[f"c{j}"] for j in range(order)) @ p["q"].T + p["b"]
        s -= s.max(axis=1, keepdims=True)
        out[own] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)
    return out


@dataclass
class Model:
    classes: Classes
    table: np.ndarray  # log10 P(class | class before)
    class_tokens: np.ndarray  # training tokens and distinct words of each class
    class_words: np.ndarray
    n: int  # training tokens, and distinct ones
    v: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.n + ALPHA * (self.v + 1)))

    def within(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | its class); a class of one word gives it all."""
        alone = classes < self.classes.n - self.classes.rest
        return np.where(alone, 0.0, np.log10((counts + ALPHA) / (self.class_tokens[classes] + ALPHA * (self.class_words[classes] + 1))))


def fit(docs: DataFrame, text_col: str, top: int = 2047, rest: int = 256) -> tuple[Model, DataFrame]:
    """The model, and the written table of word counts (hash, n, class), from all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(word_hashes(words).view(np.int64)), pa.array(list(seen.values()), pa.int64()), pa.array([zlib.crc32(w[-3:]) % rest for w in words], pa.int32()), pa.array([w if len(w) <= 64 else None for w in words], pa.binary())], names=["hash", "n", "tail", "word"])
            seen.clear()
            return out

        for (texts,) in rows_of(batches, "text"):
            for t in texts:
                seen.update((t or b"").lower().split())
                seen[END] += 1
            if len(seen) > 400_000:
                yield flush()
        if seen:
            yield flush()

    raw = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "hash long, n long, tail int, word binary")
    words = kept(raw.groupBy("hash", "tail").agg(F.sum("n").alias("n"), F.min("word").alias("word")), "lm-words")
    common = [bytes(r.word) for r in words.where("word is not null").orderBy(F.desc("n"), "word").limit(top + 1).collect()]
    classes = Classes({w: 1 + k for k, w in enumerate([w for w in common if w != END][:top])}, rest)
    single = docs.sparkSession.createDataFrame(list(zip(word_hashes([END, *classes.top]).view(np.int64).tolist(), [0, *classes.top.values()], strict=True)), "hash long, own int")  # top + 1 rows
    of = F.coalesce("own", F.lit(1 + len(classes.top)) + F.col("tail"))
    words = words.join(F.broadcast(single), "hash", "left").select("hash", "n", of.alias("class"))
    tokens, distinct = np.zeros(classes.n), np.zeros(classes.n)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["class"]], distinct[r["class"]] = r.n, r.v
    table = train(count_pairs(docs, text_col, classes))
    return Model(classes, table, tokens, distinct, int(tokens.sum()), int(distinct.sum())), words


_STATE: dict[str, tuple] = {}


def scores(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = 8_000_000) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. Repeated rows are scored each; with no training tokens all
    counts are 0. A vocabulary of at most most_words (twelve bytes each) goes to every worker; a
    larger one stays a table, joined with the words of the documents.
    """
    if words.count() <= most_words:
        return _with_held_vocabulary(docs, model, words, id_col, text_col)
    return _with_joined_vocabulary(docs, model, words, id_col, text_col)


def _with_held_vocabulary(docs: DataFrame, model: Model, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    got = words.select("hash", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"), F.col("n").alias("full")).where("full < 2147483647").select("hash", "n").toArrow()
    large = {r.hash: r.n for r in words.where("n >= 2147483647").collect()}  # few: each is a thousandth of a huge corpus
    vocabulary = Vocabulary(got["hash"].to_numpy(), got["n"].to_numpy())
    del got
    shared = docs.sparkSession.sparkContext.broadcast((model, vocabulary, large))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = arrow_type(rows, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocab, many = shared.value
        memory, most = {}, 300_000
        facts = np.zeros((most, 4))  # class, base, within, known

        def learn(new: list[bytes]) -> None:
            counts = vocab.of(new)
            if many:
                counts = np.array([many.get(int(h), c) for h, c in zip(word_hashes(new).view(np.int64), counts, strict=True)])
            c = np.array([m.classes.of(w) for w in new])
            at = np.arange(len(memory), len(memory) + len(new))
            facts[at, 0], facts[at, 1], facts[at, 2], facts[at, 3] = c, m.base(counts), m.within(c, counts), counts > 0
            memory.update(zip(new, at.tolist(), strict=True))

        for ids, texts in rows_of(batches, "id", "text"):
            out = []
            for t in texts:
                tokens = (t or b"").lower().split()
                n, known, base, score, before = 0, 0, 0.0, 0.0, 0
                tokens.append(END)
                for at in range(0, len(tokens), most):
                    part = tokens[at : at + most]
                    new = [w for w in dict.fromkeys(part) if w not in memory]
                    if len(memory) + len(new) > most:
                        memory.clear()
                        new = list(dict.fromkeys(part))
                    if new:
                        learn(new)
                    f = facts[np.fromiter(map(memory.__getitem__, part), np.int64, len(part))]
                    c = np.concatenate([[before], f[:, 0]]).astype(np.int64)
                    n, known, base = n + len(part), known + int(f[:, 3].sum()), base + float(f[:, 1].sum())
                    score += float(m.table[c[:-1], c[1:]].sum(dtype=np.float64) + f[:, 2].sum())
                    before = c[-1]
                out.append((n, known, m.n, base, score))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, pa.int64() if j < 3 else pa.float64()) for j, c in enumerate(zip(*out, strict=True)))], names=["id", *_COLUMNS])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + _SCHEMA).withColumnRenamed("id", id_col)


_COLUMNS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_SCHEMA = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _with_joined_vocabulary(docs: DataFrame, model: Model, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words of documents, counted per document before the shuffle, meet their counts by hash.

    The end and the frequent words, which nearly every document has, are counted where they stand: the
    model knows their counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = kept(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "lm-texts")
    first = model.classes.n - model.classes.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document what needs no join (hash null), and its other words by hash, with their class and number."""
        m, memory = shared.value, {}
        alone = m.base(m.class_tokens)
        for numbers, texts in rows_of(batches, "row", "text", step=32):
            out = []
            for r, t in zip(numbers, texts, strict=True):
                c = next(_coded([t], m.classes, memory))
                a = np.concatenate([[0], c, [0]])
                own = a[1:][a[1:] < first]
                out.append((r, None, len(own), 0, float(m.table[a[:-1], a[1:]].sum(dtype=np.float64)), float(alone[own].sum()), int((m.class_tokens[own] > 0).sum())))
                seen = Counter(w for w in (t or b"").lower().split() if memory[w] >= first)
                out += zip([r] * len(seen), word_hashes(list(seen)).view(np.int64).tolist(), seen.values(), map(memory.__getitem__, seen), [0.0] * len(seen), [0.0] * len(seen), [0] * len(seen), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if j in (4, 5) else pa.int64()) for j, x in enumerate(zip(*out, strict=True))], names=["row", "hash", "times", "class", "score", "base", "known"])

    flat = rows.mapInArrow(run, "row long, hash long, times long, class long, score double, base double, known long")
    found = flat.join(words.select(F.col("hash").alias("h"), "n"), F.col("hash") == F.col("h"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rooms = F.broadcast(docs.sparkSession.createDataFrame([(c, float(model.class_tokens[c]) + ALPHA * (float(model.class_words[c]) + 1)) for c in range(first, model.classes.n)], "class long, room double"))
    found = found.join(rooms, "class", "left")
    word = F.col("hash").isNotNull()
    base = F.col("times") * F.log10((F.col("n") + ALPHA) / F.lit(model.n + ALPHA * (model.v + 1)))
    within = F.col("times") * F.log10((F.col("n") + ALPHA) / F.col("room"))
    known = F.when(F.col("n") > 0, F.col("times")).otherwise(0)
    summed = found.groupBy("row").agg(F.sum("times").alias("n_tokens"), F.sum(F.when(word, known).otherwise(F.col("known"))).alias("n_known"), F.sum(F.when(word, base).otherwise(F.col("base"))).alias("base_score"), F.sum(F.when(word, within).otherwise(F.col("score"))).alias("score"))
    return rows.select("row", "id").join(summed, "row").select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
