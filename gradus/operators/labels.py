"""Labels, joins with checked cardinality, deduplication and the bookkeeping of restarts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def birads(text: Column) -> Column:
    """The number at the end of 'BI-RADS n'; null if there is none."""
    return F.expr("try_cast(1 as double)") * F.try_to_number(F.regexp_extract(text, r"(?:^|\s)(\d+)\s*$", 1), F.lit("999")).cast("double")


def label_at_least(grade: Column, least: int) -> Column:
    """1 or 0; an unknown grade is 0, not null."""
    return F.coalesce(grade >= least, F.lit(False)).cast("int")


def manufacturer(name: Column) -> Column:
    n = F.upper(F.trim(name))
    return F.when(n.startswith("AUTO"), "Auto").when(n.startswith("BUILD"), "Building").when(n.startswith("MACH"), "Machinery").otherwise("Other")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order: an aggregation with map-side combining, no window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*(F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns))


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that fails if a key of right repeats, checked by the join itself."""
    checked = right.groupBy(key).agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in right.columns if c != key))
    ok = F.when(F.col("copies") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats in the right table: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return left.join(checked.where(ok).drop("copies"), key, "left")


def first_filled(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def outer_keys(a: DataFrame, b: DataFrame, key: str, shared: Sequence[str]) -> DataFrame:
    """All keys of two tables with the first filled value of each shared column, a's before b's."""
    x, y = (t.select(key, *(F.col(c).alias(f"{p}_{c}") for c in shared)) for t, p in ((a, "a"), (b, "b")))
    return x.join(y, key, "full_outer").select(key, *(first_filled(f"a_{c}", f"b_{c}").alias(c) for c in shared))


def unfinished(work: DataFrame, done: DataFrame, key: str, rows_needed: int = 31) -> DataFrame:
    """The rows of work whose key hasn't all its rows in done yet."""
    complete = done.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= rows_needed).select(key)
    return work.join(complete, key, "left_anti")


def matched_ids(images: DataFrame, ids: DataFrame, exact: str, stem: str, key: str) -> DataFrame:
    """Images whose id or file stem equals one of ids, without regard to case: two equi joins instead of an OR."""
    wanted = ids.select(F.lower(F.trim(F.col(key))).alias("k")).distinct()
    by_id = images.join(wanted, F.lower(exact) == F.col("k"), "left_semi")
    by_stem = images.join(wanted, F.lower(stem) == F.col("k"), "left_semi")
    return by_id.unionByName(by_stem).distinct()


def shard(index: Column, n: int) -> Column:
    return F.pmod(index, F.lit(n))


def stable_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """The place of each row in the sorted order of key, from 0: sorted by range, counted per partition, then offset."""
    ranged = df.repartitionByRange(key).withColumn("part", F.spark_partition_id()).sortWithinPartitions(key)
    nth = ranged.withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy(key)))
    sizes = nth.groupBy("part").agg(F.max("nth").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per partition
    return nth.join(F.broadcast(before), "part").withColumn(out, F.col("base") + F.col("nth") - 1).drop("part", "nth", "base")
