"""The plan of degraded variants: one clean and five families at six severities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The severities of each family, and the names of their parameters.
SEVERITIES = {
    "noise": ("dose_factor", (0.95, 0.85, 0.75, 0.65, 0.50, 0.35)),
    "blur": ("length_px", (3.0, 5.0, 7.0, 11.0, 15.0, 21.0)),
    "contrast": ("alpha", (0.95, 0.90, 0.85, 0.80, 0.75, 0.70)),
    "jpeg2000": ("compression_ratio", (10.0, 25.0, 50.0, 100.0, 250.0, 500.0)),
    "resolution": ("scale_factor", (0.90, 0.80, 0.70, 0.60, 0.50, 0.40)),
}
CLEAN = "clean"
#: The names that the toolkit variant gives to two of the families.
TOOLKIT_NAMES = {"clean": "none", "blur": "motion_blur"}

SCHEMA = T.StructType([T.StructField("spec_idx", T.IntegerType()), T.StructField("degradation_type", T.StringType()), T.StructField("severity", T.IntegerType()), T.StructField("parameter_name", T.StringType()), T.StructField("parameter_value", T.DoubleType())])


def specs() -> list[tuple[int, str, int, str | None, float | None]]:
    rows = [(CLEAN, 0, None, None)] + [(name, k + 1, parameter, value) for name, (parameter, values) in SEVERITIES.items() for k, value in enumerate(values)]
    return [(i, *r) for i, r in enumerate(rows)]


def single(name: str, severity: int = 1) -> tuple[str, int, str | None, float | None]:
    """One validated spec; the severity of clean is always 0."""
    if name == CLEAN:
        return CLEAN, 0, None, None
    if name not in SEVERITIES:
        raise ValueError(f"unknown degradation {name!r}; known: {[CLEAN, *SEVERITIES]}")
    if not 1 <= severity <= 6:
        raise ValueError(f"severity {severity} is not in 1 to 6")
    parameter, values = SEVERITIES[name]
    return name, severity, parameter, values[severity - 1]


def plan(spark: SparkSession) -> DataFrame:
    """The 31 specs, in order."""
    return spark.createDataFrame(specs(), SCHEMA)


def expand(images: DataFrame, specs: DataFrame) -> DataFrame:
    """Every image with every spec. The plan has 31 rows whatever the data, so it is broadcast."""
    return images.crossJoin(F.broadcast(specs))


def seed_of(base: int, index, spec):
    """A seed from an image's place in the whole sorted corpus, not in what is left of it: a resumed run repeats its noise."""
    return F.lit(base) + index * 1000 + spec


def register_udtf(spark: SparkSession, name: str = "expand_plan") -> None:
    """The plan as a table function in SQL: select ... from images, lateral expand_plan()."""
    from pyspark.sql.functions import udtf

    rows = specs()

    @udtf(returnType="spec_idx int, degradation_type string, severity int, parameter_name string, parameter_value double")
    class Expand:
        def eval(self):
            yield from rows

    spark.udtf.register(name, Expand)


def effective_spacing(original_height, filled_rows, spacing_mm: float = 0.07):
    """Millimetres a pixel of the canvas stands for; null where no row is filled. Kernel lengths are in pixels and don't use it."""
    return F.try_divide(F.lit(spacing_mm) * original_height, filled_rows.cast("double"))
