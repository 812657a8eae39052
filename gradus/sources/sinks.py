"""Sinks: results and errors apart, run summaries, tables of differing columns, condition tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(measured: DataFrame, folder: str, mode: str = "append") -> None:
    """Results by degradation, errors aside; the commit protocol makes each write whole or absent."""
    ok = F.col("processing_status") != "ERROR"
    measured.where(ok).write.mode(mode).partitionBy("degradation_type").parquet(f"{folder}/results")
    measured.where(~ok).select("image_id", "processing_status", "error_message").write.mode(mode).parquet(f"{folder}/errors")


def write_csv(df: DataFrame, folder: str, digits: int = 6, mode: str = "overwrite") -> None:
    """CSV with a header, doubles rounded, nulls and NaN empty, fields quoted where they need it."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    df.withColumns({c: F.round(F.nanvl(c, F.lit(None).cast("double")), digits) for c in doubles}).write.mode(mode).csv(folder, header=True, escape='"', emptyValue="")


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows with all columns, sorted by name; with no columns at all, a row that says so."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not out.columns:
        return out.sparkSession.createDataFrame([("no_rows",)], "status string")
    return out.select(*sorted(out.columns))


def condition_table(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every number as text with a fixed number of digits and no separators, in the order of the plan: ready to print."""
    return df.orderBy("degradation_type", "severity").select(*(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def markdown(rows: list, columns: list[str]) -> str:
    """A table of the few rows of a condition table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
