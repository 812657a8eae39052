"""WARC archives through a chunked record table.

A payload of any size is rows of (uid, record_id, chunk_no, data): chunks of bounded size, in order.
Digests are carried from chunk to chunk, so no whole record is ever held by Python. Archives are
gzip members, one a record, streamed to and from the shared folder; a manifest written as a table
names the files of the tasks that succeeded, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, shared_dir

CHUNKS = "uid long, record_id long, url string, chunk_no long, data binary, n_bytes long, digest string"
_CHUNK_TYPE = pa.schema([("uid", pa.int64()), ("record_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("n_bytes", pa.int64()), ("digest", pa.string())])
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, a fixed value of RFC 9562
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # a fixed value of WARC 1.1


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = 1 << 18) -> DataFrame:
    """The rows of pages as chunks; the last chunk of a record has n_bytes and digest (SHA-256) of it all.

    A null payload counts as empty and has one empty chunk. Each row is a record of its own, also if
    ids repeat or are null.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    parts = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk_bytes)), F.lit(1))
    cut = F.expr(f"substring(payload, cast(chunk_no * {chunk_bytes} + 1 as int), {chunk_bytes})")
    flat = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).select("uid", "record_id", "url", "chunk_no", cut.alias("data"), (F.octet_length("payload") <= (F.col("chunk_no") + 1) * chunk_bytes).alias("last"))
    return flat.mapInArrow(_digests, CHUNKS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carries the digest over the chunks of a record, which stand together and in order."""
    state, size = hashlib.sha256(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            lengths, digests = [], []
            data = part.column("data").to_pylist()
            for k, chunk, last in zip(part.column("chunk_no").to_pylist(), data, part.column("last").to_pylist(), strict=True):
                if k == 0:
                    state, size = hashlib.sha256(), 0
                state.update(chunk)
                size += len(chunk)
                lengths.append(size if last else None)
                digests.append(state.hexdigest() if last else None)
            yield pa.RecordBatch.from_arrays([part.column(n) for n in ("uid", "record_id", "url", "chunk_no")] + [pa.array(data, pa.binary()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], schema=_CHUNK_TYPE)


def decide(chunks: DataFrame, least_bytes: int = 100) -> DataFrame:
    """For each record: uid, record_id, url, n_bytes, digest, and first_id, first_uid of the record that it revisits, if any.

    Of records with equal payloads of at least least_bytes the one with the smallest id comes first;
    null ids come last, and equal ids in the order of uid.
    """
    records = chunks.where("digest is not null").select("uid", "record_id", "url", "n_bytes", "digest")
    order = F.struct(F.col("record_id").isNull().alias("none"), F.col("record_id").alias("id"), F.col("uid").alias("uid"))
    firsts = records.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = records.join(firsts, records["digest"] == firsts["d"], "left")
    later = F.col("first").isNotNull() & (F.col("first.uid") != F.col("uid"))
    return joined.select("uid", "record_id", "url", "n_bytes", "digest", F.when(later, F.col("first.id")).alias("first_id"), F.when(later, F.col("first.uid")).alias("first_uid"))


def _clean(value: str) -> str:
    """A header's value: control characters as percent signs and hex."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'record:{uid}')}>"


def _head(r: dict, date: str) -> bytes:
    revisit = r["first_uid"] is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(r['uid'])}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{r['digest']}", f"Payload-Length: {r['n_bytes']}"]
    if r["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(r['url'])}")
    if r["record_id"] is not None:
        lines.append(f"Source-ID: {r['record_id']}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(r['first_uid'])}"] + ([f"Refers-To-Source-ID: {r['first_id']}"] if r["first_id"] is not None else [])
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else r['n_bytes'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class _Writer:
    """Archives of one task: a new one when the last has reached file_bytes."""

    def __init__(self, folder: str, file_bytes: int, date: str):
        self.folder, self.file_bytes, self.date = folder, file_bytes, date
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out, self.done, self.packer = None, [], None

    def begin(self, record: dict) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.size, self.records = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, 0
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.data(_head(record, self.date))

    def data(self, chunk: bytes) -> None:
        if packed := self.packer.compress(chunk):
            self.out.write(packed)
            self.size += len(packed)

    def end(self) -> None:
        self.data(b"\r\n\r\n")
        packed = self.packer.flush()
        self.out.write(packed)
        self.size += len(packed)
        self.packer = None
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def write(chunks: DataFrame, decisions: DataFrame, folder: str, file_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the records as archives into folder; returns the manifest: file, n_records, n_bytes.

    A record's decision travels ahead of its chunks in one shuffle; chunks of revisits are dropped by
    then. The manifest is a written table: only files in it count.
    """
    columns = "uid", "record_id", "url", "chunk_no", "data", "n_bytes", "digest", "first_id", "first_uid"
    ahead = decisions.select("uid", "record_id", "url", F.lit(-1).cast("long").alias("chunk_no"), F.lit(None).cast("binary").alias("data"), "n_bytes", "digest", "first_id", "first_uid")
    none = F.lit(None)
    body = chunks.select("uid", none.cast("long").alias("record_id"), none.cast("string").alias("url"), "chunk_no", "data", none.cast("long").alias("n_bytes"), none.cast("string").alias("digest"), none.cast("long").alias("first_id"), none.cast("long").alias("first_uid"))
    stream = ahead.unionByName(body).select(*columns).repartition(F.col("uid")).sortWithinPartitions("uid", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, open_, skip = None, False, False
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if r["chunk_no"] < 0:
                        w = w or _Writer(folder, file_bytes, date)
                        if open_:
                            w.end()
                        w.begin(r)
                        open_, skip = True, r["first_uid"] is not None
                    elif not skip:
                        w.data(r["data"])
        if w:
            if open_:
                w.end()
            w.close()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in w.done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "n_records", "n_bytes"])

    return kept(stream.mapInArrow(run, "file string, n_records long, n_bytes long"), "warc-manifest")


READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, chunk_no long, data binary, last boolean"


def read(manifest: DataFrame, folder: str, chunk_bytes: int = 1 << 18) -> DataFrame:
    """The archives' records as chunks, in order; each archive is streamed by one task."""
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism * 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, root = pafs.FileSystem.from_uri(folder)
                with store.open_input_stream(f"{root}/{name}") as raw, gzip.GzipFile(fileobj=raw) as f:
                    rows, size = [], 0
                    for row in _records(f, chunk_bytes):
                        rows.append(row)
                        size += len(row["data"])
                        if size >= 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ_TYPE)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ_TYPE)

    return manifest.select("file").repartition(tasks).mapInArrow(run, READ)


_READ_TYPE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("last", pa.bool_())])


def _records(f: gzip.GzipFile, chunk_bytes: int) -> Iterator[dict]:
    """The rows of one archive."""
    number = lambda x: None if x is None else int(x)
    while first := f.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {first[:80]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            fields[key.lower()] = value.strip()
        left = int(fields["content-length"])
        while line := f.readline():  # the HTTP head
            left -= len(line)
            if line == b"\r\n":
                break
        row = {"page_id": number(fields.get("source-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number(fields.get("refers-to-source-id")), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "payload_bytes": int(fields["payload-length"])}
        k = 0
        while True:
            data = f.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError("an archive ends inside a record")
            left -= len(data)
            yield row | {"chunk_no": k, "data": data, "last": left == 0}
            k += 1
            if not left:
                break
        f.readline()
        f.readline()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record; digest and length of a response are those of its chunks, and must be those of its header."""
    state, size = hashlib.sha256(), 0
    names = "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 64):
            for r in batch.slice(at, 64).to_pylist():
                if r["chunk_no"] == 0:
                    state, size = hashlib.sha256(), 0
                state.update(r["data"])
                size += len(r["data"])
                if r["last"]:
                    if r["record_type"] == "response":
                        if (state.hexdigest(), size) != (r["payload_digest"], r["payload_bytes"]):
                            raise ValueError(f"the payload of page {r['page_id']} was damaged")
                        r |= {"payload_digest": state.hexdigest(), "payload_bytes": size}
                    rows.append({n: r[n] for n in names})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([_READ_TYPE.field(n) for n in names]))


def records(chunks: DataFrame) -> DataFrame:
    """Of read()'s chunks: a row for each record, its payload verified against its digest.

    A revisit has no payload in the archive: its length and digest are those that its header states.
    """
    return chunks.mapInArrow(_verified, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long")


def payloads(chunks: DataFrame) -> DataFrame:
    """Of read()'s chunks: those of responses with their place, for consumers that stream."""
    return chunks.where("record_type = 'response'").select("page_id", "url", "chunk_no", "data", "last")


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes all of pages as archives and reads them back: page_id, url, record_type, refers_to, payload_digest, payload_bytes."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    chunks = kept(chunk_table(pages, id_col, url_col, payload_col), "warc-chunks")
    manifest = write(chunks, decide(chunks), folder)
    return records(read(manifest, folder))


__all__ = ["chunk_table", "decide", "payloads", "read", "records", "round_trip", "write"]
