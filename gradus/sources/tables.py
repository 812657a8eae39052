"""Text sources: CSV with aliased headers, image lists, per-model result files, file discovery."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labels import stable_index


def normal_name(name: str) -> str:
    return name.replace("﻿", "").strip().lower().replace(" ", "_")


def resolved(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """df with columns named by the first alias that its header has; fails if a required one is missing."""
    have = {normal_name(c): c for c in reversed(df.columns)}
    found = {name: have[a] for name, options in aliases.items() if (a := next((normal_name(o) for o in (name, *options) if normal_name(o) in have), None))}
    if missing := [c for c in required if c not in found]:
        raise ValueError(f"columns {missing} are missing; the header has {df.columns}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, sep: str = ",", trim: bool = True) -> DataFrame:
    """CSV with a header, a byte-order mark or not; with a schema, columns by name, cast, what can't be cast null."""
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=False, escape='"')
    raw = raw.toDF(*(c.replace("﻿", "").strip() for c in raw.columns))
    strip = (lambda c: F.trim(F.col(f"`{c}`"))) if trim else (lambda c: F.col(f"`{c}`"))
    if schema is None:
        return raw.select(*(strip(c).alias(c) for c in raw.columns))
    if missing := [f.name for f in schema if f.name not in raw.columns]:
        raise ValueError(f"columns {missing} are missing; the header has {raw.columns}")
    null = F.lit(None)
    return raw.select(*(F.nullif(strip(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) if f.name in raw.columns else null.cast(f.dataType).alias(f.name) for f in schema))


def read_models(spark: SparkSession, glob: str, schema: T.StructType, pattern: str = r"([a-z0-9_]+?)_s(\d+)_") -> DataFrame:
    """Result files of several models, with arch and seed from the file's name."""
    raw = spark.read.csv(glob, header=True, schema=schema, enforceSchema=False)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.select("*", F.regexp_extract(name, pattern, 1).alias("arch"), F.regexp_extract(name, pattern, 2).cast("int").alias("seed"))


def image_list(spark: SparkSession, path: str, aliases: Sequence[str] = ("image_path", "path", "file", "filename", "image")) -> DataFrame:
    """path of each image named in a .txt, .lst, .csv or .tsv file, without blanks and comments."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("txt", "lst"):
        rows = spark.read.text(path).select(F.trim("value").alias("path"))
    elif kind in ("csv", "tsv"):
        rows = resolved(read_csv(spark, path, sep="\t" if kind == "tsv" else ","), {"path": aliases}, ["path"])
    else:
        raise ValueError(f"can't read an image list from {path!r}")
    return rows.where("path <> '' and not path like '#%'")


def discover(spark: SparkSession, folder: str, pattern: str = r"(?i)\.(dcm|dicom)$") -> DataFrame:
    """path and idx (from 0, in the order of paths) of the files below folder; paths equal but for case count once. Files without a byte are passed over; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.col("path").rlike(pattern))
    once = files.groupBy(F.lower("path").alias("k")).agg(F.min("path").alias("path")).select("path")
    from ..operators.labels import stable_index

    return stable_index(once, "path")


def manifest(df: DataFrame, split: str) -> DataFrame:
    """The rows of a split; fails if it has none."""
    rows = df.where(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"the manifest has no rows of split {split!r}")
    return rows


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """key and its place (from 0) in the order of first appearance."""
    firsts = df.groupBy(key).agg(F.min(order).alias("at"))
    places = stable_index(firsts.select("at").distinct(), "at").withColumnRenamed("idx", "ordinal")
    return firsts.join(places, "at").select(key, "ordinal")
