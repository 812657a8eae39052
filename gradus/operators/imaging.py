"""Images as rows: setting up, degrading, scoring and measuring in one Arrow pass per image.

An image row is (image_id, h, w, data) with little-endian float32 pixels. Masks, patches and rings
are worked out once per image, and the 31 variants are expanded inside the pass, so no degraded
canvas is ever a row. An image that fails gives one row with its error; a variant that fails gives a
row with processing_status `variant_failed`.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import kernels as K
from ..plans import degradation

IMAGE = "image_id long, h int, w int, data binary, lesion array<int>, others array<array<int>>"
OUT = "image_id long, degradation_type string, severity int, parameter_name string, parameter_value double, logit double, prob double, noise_variance double, tenengrad double, ssim_full double, ssim_masked double, ssim_crop double, tau_nms double, tau_extrema double, contrast_iqr double, cnr double, delta_mu double, cnr_lesion_mean double, cnr_bg_mean double, cnr_bg_std double, cnr_bg_pixels long, breast_mask_valid int, tissue_patch_valid int, bg_ring_valid int, breast_area_pixels long, processing_status string, error_message string"

#: Scorers by name: each takes a float32 image and returns a logit. Models are registered by their users.
SCORERS: dict[str, Callable[[np.ndarray], float]] = {"linear": lambda x: float(4 * x.mean() - 1 + 6 * x.std())}


def flip_averaged(scorer: Callable[[np.ndarray], float]) -> Callable[[np.ndarray], float]:
    """The mean logit of an image and of its mirror image."""
    return lambda x: (scorer(x) + scorer(x[:, ::-1])) / 2


def to_image(data: bytes, h: int, w: int) -> np.ndarray:
    x = np.frombuffer(data, "<f4").reshape(h, w)
    return np.where(np.isfinite(x), x, 0).astype(np.float32)


def number(x: float | None) -> float | None:
    """None for what isn't a finite number: tables hold nulls, never NaN."""
    return None if x is None or not np.isfinite(x) else float(x)


def measure(x: np.ndarray, clean: np.ndarray, mask: np.ndarray, patch, lesion: np.ndarray | None, around: np.ndarray | None, variant: str = "evaluation") -> dict[str, float | None]:
    """All metrics of one variant; one that fails is null and leaves the others."""
    ssim = functools.cache(lambda: K.ssim_map(clean, x))  # for two of the metrics
    jobs: dict[str, Callable[[], float]] = {
        "noise_variance": lambda: K.noise_variance(x, patch),
        "tenengrad": lambda: K.tenengrad(x, mask),
        "ssim_full": lambda: K.mean_inside(ssim()),
        "ssim_masked": lambda: K.mean_over(ssim(), mask),
        "ssim_crop": lambda: K.ssim_crop(clean, x, mask),
        "tau_nms": lambda: K.tau_nms(x, mask),
        "tau_extrema": lambda: K.tau_extrema(x, mask),
        "contrast_iqr": lambda: K.contrast_iqr(x, mask),
    }
    out: dict[str, float | None] = {}
    for name, job in jobs.items():
        try:
            out[name] = number(job())
        except (ValueError, IndexError, ZeroDivisionError):
            out[name] = None
    if lesion is not None and around is not None:
        out["cnr"], out["delta_mu"] = (number(v) for v in K.cnr(x, lesion, around, variant))
        a, b, s, n = K.cnr_parts(x, lesion, around)
        out |= {"cnr_lesion_mean": number(a), "cnr_bg_mean": number(b), "cnr_bg_std": number(s), "cnr_bg_pixels": n}
    return out


def sizes_of(shape: tuple[int, int]) -> tuple[int, int, int]:
    """Closing width, least object and largest hole of the breast mask: 15, 4096 and 8192 on a canvas of 1024 x 384, others in proportion."""
    part = shape[0] * shape[1] / (1024 * 384)
    return max(1, round(15 * part**0.5)) | 1, round(4096 * part), round(8192 * part)


def variants(row: dict, specs: list[tuple], scorer: Callable[[np.ndarray], float], base_seed: int, patch_size: int, margin: int, variant: str, morphology: tuple[int, int, int] | None = None, stretch: bool = False) -> Iterator[dict]:
    """The rows of one image."""
    try:
        x = to_image(row["data"], row["h"], row["w"])
        x = K.unit_range(x) if stretch else K.clip01(x)
        closing, least_object, most_hole = morphology or sizes_of(x.shape)
        mask = K.breast_mask(x, closing=closing, least_object=least_object, most_hole=most_hole, diagonal=variant == "toolkit")
        boxes = [tuple(int(v) for v in b) for b in [row.get("lesion"), *(row["others"] if row.get("others") is not None else [])] if b is not None and len(b) == 4]
        avoid = K.lesions_dilated(x.shape, boxes) if variant == "toolkit" and boxes else None
        patch = K.tissue_patch(x, mask, patch_size, margin, avoid) if mask.any() else None
        inside = x[patch[1] : patch[3], patch[0] : patch[2]] if patch else x[mask] if mask.any() else x
        sigma0 = float(inside.std())
        lesion = around = None
        if row.get("lesion") is not None and len(row["lesion"]) == 4:
            b = tuple(int(v) for v in row["lesion"])
            lesion = K.box_mask(x.shape, b)
            around = K.ring(b, mask, [tuple(int(v) for v in o) for o in (row.get("others") if row.get("others") is not None else [])])
        flags = {"breast_mask_valid": int(mask.any()), "tissue_patch_valid": int(patch is not None), "bg_ring_valid": int(around is not None and bool(around.any())), "breast_area_pixels": int(mask.sum())}
    except Exception as e:  # noqa: BLE001  one bad image must not end the job
        yield {"image_id": row["image_id"], "processing_status": "ERROR", "error_message": f"{type(e).__name__}: {e}"[:500]}
        return
    for idx, name, severity, parameter, value in specs:
        out = {"image_id": row["image_id"], "degradation_type": name, "severity": severity, "parameter_name": parameter, "parameter_value": value, **flags}
        try:
            y = K.degrade(x, name, value, mask, sigma0, base_seed + int(row["image_id"]) * 1000 + idx, variant)
            try:
                logit = number(scorer(y))
            except Exception as e:  # noqa: BLE001  a scorer that fails gives a null logit and leaves the metrics
                logit, out["error_message"] = None, f"scorer: {type(e).__name__}: {e}"[:500]
            out |= {"logit": logit, "prob": None if logit is None else float(1 / (1 + np.exp(-logit)))}
            out |= measure(y, x, mask, patch, lesion, around, variant)
            out["processing_status"] = "OK"
        except Exception as e:  # noqa: BLE001
            out |= {"processing_status": "variant_failed", "error_message": f"{type(e).__name__}: {e}"[:500]}
        yield out


def evaluate(images: DataFrame, scorer: str = "linear", base_seed: int = 42, patch_size: int = 96, margin: int = 80, variant: str = "evaluation", surrogate: bool = False, rows_per_batch: int = 16, morphology: tuple[int, int, int] | None = None, stretch: bool = False) -> DataFrame:
    """31 rows per image (IMAGE columns): one per variant, or one for an image that fails.

    A canvas is 1.6 MB, so batches are cut to rows_per_batch images before Python holds them.
    surrogate puts wavelet_quant, under its own name, where no JPEG 2000 codec is registered. Pixels
    are taken as they are, cut to 0..1; stretch scales each image to its own range first. morphology
    (see sizes_of) fixes the mask's sizes. The pass is as parallel as images has partitions.
    """
    specs = [(i, "wavelet_quant" if n == "jpeg2000" and surrogate else n, *r) for i, n, *r in degradation.specs()]
    score = SCORERS[scorer]

    fields = [c.split(" ", 1)[0] for c in IMAGE.split(", ")]

    out = to_arrow_schema(T.StructType.fromDDL(OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                rows = [r for row in batch.slice(at, rows_per_batch).to_pylist() for r in variants(row, specs, score, base_seed, patch_size, margin, variant, morphology, stretch)]
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return images.select(*fields).mapInArrow(run, OUT)


def phantom(seed: int, h: int = 64, w: int = 48) -> tuple[bytes, list[int]]:
    """A half disk of noisy tissue with a brighter lesion, and the lesion's box."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    tissue = (x / (0.85 * w)) ** 2 + ((y - h / 2) / (0.45 * h)) ** 2 < 1
    img = tissue * (0.45 + 0.1 * np.sin(x / 9 + seed) * np.cos(y / 7))
    cx, cy, r = w // 3 + seed % 5, h // 2 - seed % 7, 4 + seed % 3
    img = img + tissue * (0.25 * ((x - cx) ** 2 + (y - cy) ** 2 < r * r)) + tissue * rng.normal(0, 0.02, (h, w))
    return np.clip(img, 0, 1).astype("<f4").tobytes(), [cx - r, cy - r, cx + r, cy + r]


def phantoms(ids: DataFrame, id_col: str, h: int = 64, w: int = 48) -> DataFrame:
    """A phantom per id. Ids are few bytes and images dear, so ids are dealt to four tasks a core first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [phantom(int(i), h, w) for i in pdf["image_id"]]
            yield pd.DataFrame({"image_id": pdf["image_id"], "h": h, "w": w, "data": [d for d, _ in made], "lesion": [b for _, b in made], "others": [[] for _ in made]})

    few = ids.select(F.col(id_col).cast("long").alias("image_id"))
    return few.repartition(4 * ids.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, IMAGE)


def summaries(measured: DataFrame) -> DataFrame:
    """image_id and a JSON document of its variants, in the order of the plan."""
    order = F.array_sort(F.collect_list(F.struct("degradation_type", "severity", "processing_status", "ssim_masked", "tau_extrema")))  # 31 rows an image
    return measured.groupBy("image_id").agg(F.to_json(F.struct(F.count("*").alias("n_variants"), order.alias("variants"))).alias("summary"))


def run_summary(measured: DataFrame) -> DataFrame:
    """One row: images, rows, failures and skips."""
    s = F.col("processing_status")
    return measured.agg(F.countDistinct("image_id").alias("n_images"), F.count("*").alias("n_rows"), F.count_if(s == "OK").alias("n_ok"), F.count_if(s == "ERROR").alias("n_errors"), F.count_if(s == "variant_failed").alias("n_variants_failed"))


def parse_boxes(text: str | None) -> list[list[int]]:
    return [] if not text else [[int(v) for v in b] for b in json.loads(text)]
