"""Shared pieces: reading tables, tables kept in the cluster's shared folder, hashing of words."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as bytes.split() knows it.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set (tests on one machine), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_dir()
    return found.rstrip("/")


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='gradus-')}"


#: Kept tables: application, path, and a weak reference to what every plan that reads the table holds.
_live: list[tuple[str, str, object]] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, and survives lost executors.

    The table stays until released(), or until a later kept() finds that no plan reads it any more.
    """
    spark = df.sparkSession
    _sweep(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    files = out._jdf.queryExecution().analyzed().relation().location()
    _live.append((spark.sparkContext.applicationId, path, spark._jvm.java.lang.ref.WeakReference(files)))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def _sweep(spark: SparkSession) -> None:
    """Deletes the tables whose plans the driver's collector has taken away."""
    gone = [x for x in _live if x[0] == spark.sparkContext.applicationId and x[2].get() is None]
    for x in gone:
        _delete(spark, x[1])
        _live.remove(x)


def released(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more, and lets Spark drop the shuffle files of the jobs before."""
    spark = tables[0].sparkSession
    for t in tables:
        _delete(spark, t._kept_at)
        _live[:] = [x for x in _live if x[1] != t._kept_at]
    gc.collect()
    spark._jvm.System.gc()  # the cleaner of shuffles and broadcasts follows the driver's collector


def bytes_of(table: DataFrame) -> int:
    """Bytes of a kept table's files."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._kept_at)
    return path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()


#: A table is broadcast up to so many bytes of compressed files: hashed in memory it takes some five times that.
BROADCAST_BYTES = 16 << 20


def small(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A kept table, marked for broadcast if its files have at most `most` bytes; larger ones are joined by a shuffle."""
    return F.broadcast(table) if bytes_of(table) <= most else table


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """names, lengthened until none is among taken."""
    lower = {t.lower() for t in taken}
    out = []
    for n in names:
        while n in lower:
            n += "_"
        out.append(n)
    return out


def without(docs: DataFrame, ids: DataFrame, id_col: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs whose id is not among ids. Ids of at most `most` bytes of files travel to every executor; more are joined by a shuffle."""
    ids = kept(ids.select(F.col(id_col)).distinct(), "gone")
    return docs.join(small(ids, most), id_col, "left_anti").select(docs.columns)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str, step: int = 256) -> Iterator[tuple[list, ...]]:
    """Small runs of rows of Arrow batches, as lists by column, so that few texts are copied at a time.

    Strings come as UTF-8 bytes.
    """
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        cols = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c.cast(pa.large_binary()) if pa.types.is_large_string(c.type) else c for c in cols]
        for at in range(0, batch.num_rows, step):
            yield tuple(c.slice(at, step).to_pylist() for c in cols)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, alike in every process."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n consecutive hashes, in order."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out
