"""Tar shards of <id>.npy images with <id>.json sidecars, as a Python data source.

Partitions are shards; a shard is streamed once from its start. `format("tarshards")` with the paths
joined by semicolons in `paths`. Option `index` reads names only and leaves pixels null. Any store
that pyarrow opens will do.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "image_id string, shard string, member string, h int, w int, data binary, sidecar string, error string"


class Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(";") if p]
        self.index = options.get("index", "false").lower() == "true"
        if not self.paths:
            raise ValueError("name the shards in option paths")

    def partitions(self) -> list[Shard]:
        return [Shard(p) for p in sorted(self.paths)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path if "://" in partition.path else f"file://{partition.path}")
        waiting: dict[str, tuple] = {}  # images whose sidecar hasn't come yet, and the other way round
        with store.open_input_stream(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
            for m in tar:
                stem, _, kind = m.name.rsplit("/", 1)[-1].rpartition(".")
                if not m.isfile() or kind not in ("npy", "json"):
                    continue
                if self.index:
                    if kind == "npy":
                        yield stem, partition.path, m.name, None, None, None, None, None
                    continue
                body = tar.extractfile(m).read()
                old = waiting.pop(stem, None)
                if old is None:
                    waiting[stem] = (kind, m.name, body)
                    continue
                npy, side = ((m.name, body), old[2]) if kind == "npy" else ((old[1], old[2]), body)
                yield self._row(stem, partition.path, *npy, side)
            for stem, (kind, name, body) in waiting.items():
                if kind == "npy":
                    yield self._row(stem, partition.path, name, body, None)

    @staticmethod
    def _row(stem: str, shard: str, member: str, body: bytes, side: bytes | None) -> tuple:
        """A damaged image is a row with its error."""
        try:
            x = np.load(io.BytesIO(body), allow_pickle=False).squeeze()
            if x.ndim != 2:
                raise ValueError(f"an image has two axes, not {x.ndim}")
            text = json.dumps(json.loads(side)) if side is not None else None
            return stem, shard, member, int(x.shape[0]), int(x.shape[1]), x.astype("<f4").tobytes(), text, None
        except (ValueError, OSError) as e:
            return stem, shard, member, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_shards(spark: SparkSession, paths: list[str], index: bool = False) -> DataFrame:
    spark.dataSource.register(TarShards)
    return spark.read.format("tarshards").option("paths", ";".join(paths)).option("index", str(index).lower()).load()
