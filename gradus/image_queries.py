"""Queries on pixels: 8 x 8 images made of the embeddings, and phantoms through the whole image pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import kernels as K
from .operators import imaging
from .plans import fixtures
from .queries import query

#: Pixels in [0, 1] of each image, row by row, as a SQL table t(vec_id, a).
IMG8 = "with r as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings), t as (select vec_id, list_transform(e, lambda x: (x - list_min(e)) / (list_max(e) - list_min(e))) a from r) "


def img8(spark, sf_dir, kernel: Callable[[np.ndarray], float], name: str, digits: int = 5) -> DataFrame:
    """vec_id and a kernel's value on each image, stretched to [0, 1]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf["embedding"]:
                x = np.asarray(v, np.float64).reshape(8, 8)
                out.append(float(kernel((x - x.min()) / (x.max() - x.min()))))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], name: out})

    e = fixtures.tables(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", "embedding")
    return e.mapInPandas(run, f"vec_id {dict(e.dtypes)['vec_id']}, {name} double").withColumn(name, F.round(name, digits))


def _at(r: int, c: int, mirror: str = "symmetric") -> str:
    fold = (lambda k: min(max(k, 0), 7)) if mirror == "symmetric" else (lambda k: -k if k < 0 else 14 - k if k > 7 else k)
    return f"a[{fold(r) * 8 + fold(c) + 1}]"


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")"


PIXELS = [(r, c) for r in range(8) for c in range(8)]
_GX = {(r, c): _sum(f"{s} * ({_at(r + i, c + 1)} - {_at(r + i, c - 1)})" for i, s in ((-1, 1), (0, 2), (1, 1))) for r, c in PIXELS}
_GY = {(r, c): _sum(f"{s} * ({_at(r + 1, c + i)} - {_at(r - 1, c + i)})" for i, s in ((-1, 1), (0, 2), (1, 1))) for r, c in PIXELS}


@query(IMG8 + f"select vec_id, round({_sum(f'{_GX[p]} * {_GX[p]} + {_GY[p]} * {_GY[p]}' for p in PIXELS)} / 64, 5) tenengrad from t", needs_pred=False)
def tenengrad8(spark, sf_dir):
    return img8(spark, sf_dir, K.tenengrad, "tenengrad")


@query(IMG8 + "select vec_id, round(list_avg(p) * 0 + list_var_pop(p), 5) noise_var from (select vec_id, [" + ", ".join(_at(r, c) for r in range(2, 6) for c in range(2, 6)) + "] p from t) u", needs_pred=False)
def noise_var8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: K.noise_variance(x, (2, 2, 6, 6)), "noise_var")


@query(IMG8 + "select vec_id, round(list_avg(list_transform(a, lambda x: least(greatest(m + 7e-1 * (x - m), 0), 1))), 5) contrast from (select vec_id, a, list_median(a) m from t) u", needs_pred=False)
def contrast8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: K.reduce_contrast(x, 0.7, np.ones((8, 8), bool)).astype(float).mean(), "contrast")


@query(IMG8 + f"select vec_id, round(list_avg(list_transform([{', '.join(_sum(_at(r, c + k, 'reflect') for k in (-2, -1, 0, 1, 2)) + ' / 5' for r, c in PIXELS)}], lambda x: x * x)), 5) blur from t", needs_pred=False)
def blur8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: (K.motion_blur(x, 5).astype(float) ** 2).mean(), "blur")


_D = ", ".join("list_min([" + ", ".join(f"abs({_at(r, c)} - {_at(r + i, c + j)})" for i, j in K._AROUND) + "])" for r in range(1, 7) for c in range(1, 7))


@query(IMG8 + f"""select vec_id, round(coalesce(list_sum(list_transform(k, lambda x: x * (x + 1) / 2)) / 2000.0::double / nullif(list_sum(k), 0), 0), 4) tau from (select vec_id, list_transform([{_D}], lambda d: greatest(ceil(d * 2000.0::double) - 1, 0)) k from t) u""", needs_pred=False)
def tau8(spark, sf_dir):
    return img8(spark, sf_dir, K.tau_nms, "tau", 4)


@query(IMG8 + "select vec_id, round(list_aggregate(a, 'quantile_cont', 0.75) - list_aggregate(a, 'quantile_cont', 0.25), 5) iqr from t", needs_pred=False)
def iqr8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: K.contrast_iqr(x, np.ones((8, 8), bool)), "iqr")


def _ring8() -> tuple[np.ndarray, np.ndarray]:
    return K.box_mask((8, 8), (3, 3, 5, 5)), K.ring((3, 3, 5, 5), np.ones((8, 8), bool))


def _cells(mask: np.ndarray) -> str:
    return "[" + ", ".join(_at(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)) + "]"


@query(IMG8 + f"select vec_id, round(abs(list_avg(l) - list_avg(b)) / (sqrt(list_var_pop(b)) + 1e-8), 5) cnr from (select vec_id, {_cells(_ring8()[0])} l, {_cells(_ring8()[1])} b from t) u", needs_pred=False)
def cnr8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: K.cnr(x, *_ring8())[0], "cnr")


@query(IMG8 + f"select vec_id, round(list_var_pop([{', '.join(_sum(_at(r + i, c + j) for i in (0, 1) for j in (0, 1)) + ' / 4' for r in range(0, 8, 2) for c in range(0, 8, 2))}]), 5) blocks from t", needs_pred=False)
def block_resolution8(spark, sf_dir):
    w = K.area_weights(8, 4)
    return img8(spark, sf_dir, lambda x: (w @ x @ w.T).var(), "blocks")


@query(IMG8 + "select vec_id, round(-10 * log10(list_avg(list_transform(a, lambda x: pow(x - least(greatest(m + 7e-1 * (x - m), 0), 1), 2)))), 3) psnr from (select vec_id, a, list_median(a) m from t) u", needs_pred=False)
def psnr8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: K.psnr(x, K.reduce_contrast(x, 0.7, np.ones((8, 8), bool))), "psnr", 3)


@query(IMG8 + """, v as (select vec_id, x, min(x) over (partition by vec_id) lo, max(x) over (partition by vec_id) hi from (select vec_id, unnest(a) x from t) u where x > 0),
h as (select vec_id, least(floor((x - lo) / (hi - lo) * 256), 255) b, count(*) n, any_value(lo) lo, any_value(hi) hi from v group by 1, 2), c as (select *, lo + (b + 5e-1) * (hi - lo) / 256 centre from h),
k as (select vec_id, centre, sum(n) over w below, sum(n * centre) over w s, sum(n) over (partition by vec_id) total, sum(n * centre) over (partition by vec_id) st from c window w as (partition by vec_id order by b))
select vec_id, round(arg_min(centre, (-round(below * (total - below) * pow(s / below - (st - s) / (total - below), 2), 9), centre)), 5) otsu from k where below < total group by 1""", needs_pred=False)
def otsu8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: K.otsu(x[x > 0]), "otsu")


@query()
def iqm_pipeline_phantom(spark, sf_dir):
    """A phantom per supplier, through all 31 variants; without a codec, the jpeg2000 rows say so."""
    ids = fixtures.tables(spark, sf_dir, "supplier")["supplier"]
    out = imaging.evaluate(imaging.phantoms(ids, "s_suppkey"), patch_size=16, margin=8)
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: F.round(c, 6) for c in doubles})


@query("select count(*) n_images, 31 * count(*) n_rows, 31 * count(*) n_ok, cast(0 as bigint) n_errors, cast(0 as bigint) n_variants_failed from supplier", needs_pred=False)
def iqm_run_summary(spark, sf_dir):
    ids = fixtures.tables(spark, sf_dir, "supplier")["supplier"]
    return imaging.run_summary(imaging.evaluate(imaging.phantoms(ids, "s_suppkey"), patch_size=16, margin=8, surrogate=True))
