"""Token counts and token ids of whole texts with a public tokenizer.

Texts are cut at ASCII white space, where the tokenizer drops the white space and starts anew, so
the tokens of a text are those of its words in order. Each Python worker keeps a bounded memory of
words it has met; unknown words go to the library in batches balanced by bytes. Only lengths (or
ids) ever leave a batch.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: bytes, limit: int) -> Iterator[bytes]:
    """Pieces of text of about limit bytes, each cut at white space; a run without any stays whole."""
    start = 0
    while len(text) - start > limit:
        gap = _GAP.search(text, start + limit)
        if not gap:
            break
        yield text[start : gap.start()]
        start = gap.end()
    yield text[start:]


#: Words of Latin letters alone are one piece to the tokenizer: it lower-cases them and leaves them as they are.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Byte-level tokenizers write some bytes as other characters, in ascending order from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


class WordCoder:
    """Token ids of words, as bytes of little-endian unsigned 32-bit ids or as lengths only.

    A word of Latin letters, with stops or commas after it, is put together from the tokens of its
    lower-cased letters, which come straight from the library's model, and those of the stops. All
    others go through the whole library.
    """

    def __init__(self, path: str, lengths: bool, most_words: int = 500_000, batch_bytes: int = 1 << 18, long_word: int = 256):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.lengths, self.most, self.batch_bytes, self.long_word = lengths, most_words, batch_bytes, long_word
        self.known: dict[bytes, object] = {}
        self.cores: dict[str, object] = {}
        self.stops: dict[bytes, object] = {}
        self.passing: list[bytes] = []
        probe = "Wort,Äußerstes zz."
        self.direct = self.tok.encode(probe, add_special_tokens=False).ids == [i for part in ("wort", ",", "äußerstes", "zz", ".") for i in self._model_ids(part)]

    def _model_ids(self, piece: str) -> list[int]:
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return [t.id for t in self.tok.model.tokenize(written)]

    def _value(self, ids: list[int]) -> object:
        return len(ids) if self.lengths else struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, words: list[bytes]) -> Iterator[tuple[bytes, object]]:
        """In batches balanced by bytes."""
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= self.batch_bytes):
                size += len(words[end])
                end += 1
            part = words[at:end]
            for word, e in zip(part, self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                yield word, self._value(e.ids)
            at = end

    def _latin(self, word: bytes) -> object | None:
        """The value of a word of Latin letters and stops; None for others."""
        core = word.rstrip(b".,")
        letters = core.decode("utf-8", "replace")
        if not _LATIN.fullmatch(letters):
            return None
        letters = letters.lower()
        value = self.cores.get(letters)
        if value is None:
            if len(self.cores) >= self.most:
                self.cores.clear()
            value = self.cores[letters] = self._value(self._model_ids(letters))
        stops = word[len(core) :]
        if not stops:
            return value
        if stops not in self.stops:
            if len(self.stops) > 1000:
                self.stops.clear()
            self.stops.update(self._encode([stops]))
        return value + self.stops[stops]

    def look_up(self, words: list[bytes]) -> dict[bytes, object]:
        """What holds all of words until the next call, which forgets very long ones."""
        known = self.known
        for w in self.passing:
            known.pop(w, None)
        self.passing = []
        new = list(dict.fromkeys([w for w in words if w not in known]))
        if not new:
            return known
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(dict.fromkeys(words))
        other = []
        for w in new:
            value = self._latin(w) if self.direct and len(w) <= self.long_word else None
            if value is None:
                other.append(w)
            else:
                known[w] = value
        long = [w for w in other if len(w) > self.long_word]
        known.update(self._encode([w for w in other if len(w) <= self.long_word]))
        known.update(self._encode(long))
        self.passing = long
        return known

    def count(self, text: bytes) -> int:
        total = 0
        for part in segments(text, 1 << 20):
            words = part.split()
            total += sum(map(self.look_up(words).__getitem__, words))
        return total

    def ids(self, text: bytes) -> Iterator[bytes]:
        """The ids, part by part."""
        for part in segments(text, 1 << 20):
            words = part.split()
            yield b"".join(map(self.look_up(words).__getitem__, words))


_coders: dict[tuple[str, bool], WordCoder] = {}


def coder(path: str, lengths: bool) -> WordCoder:
    """This worker's coder; kept from task to task."""
    if (path, lengths) not in _coders:
        _coders[path, lengths] = WordCoder(path, lengths)
    return _coders[path, lengths]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; a null id stays
    null; an empty table gives no rows; other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, lengths=True)
        for ids, texts in rows_of(batches, "id", "text"):
            texts = [t or b"" for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = arrow_type(got, "id")
    out = got.mapInArrow(run, f"id {got.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)
