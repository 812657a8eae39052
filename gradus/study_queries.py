"""More of the study: several architectures, significance, comparisons of matrices, training metrics, parameter maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import kernels as K
from .functions import rank
from .image_queries import IMG8, _at, img8
from .operators import resample
from .plans import degradation, fixtures
from .queries import C, RQ1, SHIFT, _rho, followed, lesion_rows, long_metrics, query, r6, severity_metrics, test_rows

# The architectures and seeds of the grid, with the stand-in's scale and spread of each.
ARCHITECTURES = "(values ('convnext_tiny', 0, 1e0, 5e-1), ('resnet18', 1, 7e-1, 15e-1), ('efficientnet_b4', 2, 8e-1, 1e0)) a(arch, pos, scale, spread) cross join (values (42), (43), (44)) s(seed)"
_GRID = f"select t.image_id, t.label_45, t.degradation_type, t.severity, arch, seed, round(logit * scale + spread * (((t.image_id * 7919 + seed * 104729 + pos * 31) % 10009) / 10009e0 - 5e-1), 6) logit from {{test}} t cross join {ARCHITECTURES}"


def model_pred(spark, sf_dir) -> DataFrame:
    """Every test row under nine models: three architectures with three seeds."""
    return spark.sql(_GRID, test=test_rows(spark, sf_dir, by_image=True))


def over_seeds(scores: DataFrame, value: str, ddof: int = 1) -> DataFrame:
    """arch, degradation_type, severity, mean and sd of value over seeds, n, and the drop of the mean relative to clean.

    The clean row stands as severity 0 at the head of every degradation's series.
    """
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    m = scores.groupBy("arch", *C).agg(F.avg(value).alias("mean"), sd.alias("sd"), F.count(value).alias("n"))
    clean = m.where("degradation_type = 'clean'")
    heads = clean.withColumn("degradation_type", F.explode(F.array(*map(F.lit, degradation.SEVERITIES))))
    series = m.where("degradation_type <> 'clean'").unionByName(heads)
    return series.join(F.broadcast(clean.select("arch", F.col("mean").alias("mean0"))), "arch").withColumn("relative_drop", rank.ratio(F.col("mean0") - F.col("mean"), F.col("mean0"))).drop("mean0")  # a row per architecture


@query("+grid as (" + _GRID.format(test="test") + """), t as (select arch, seed, degradation_type, severity, logit, sum(label_45) p, sum(1 - label_45) q from grid group by 1, 2, 3, 4, 5),
a as (select arch, seed, degradation_type, severity, sum(p * (cq - q * 5e-1)) / nullif(sum(p) * sum(q), 0) auc from (select *, sum(q) over (partition by arch, seed, degradation_type, severity order by logit) cq from t) z group by 1, 2, 3, 4),
m as (select arch, degradation_type, severity, avg(auc) mean, stddev_samp(auc) sd, count(auc) n from a group by 1, 2, 3), c as (select * from m where severity = 0),
s as (select * from m where severity > 0 union all select arch, d, 0, mean, sd, n from c, (values ('noise'), ('blur'), ('contrast'), ('jpeg2000'), ('resolution')) k(d))
select s.arch, s.degradation_type, cast(s.severity as int) severity, round(s.mean, 6) mean, round(s.sd, 6) sd, s.n, round((c.mean - s.mean) / c.mean, 6) relative_drop from s join c on s.arch = c.arch""")
def multiarch_auc(spark, sf_dir):
    scores = rank.auc_many(model_pred(spark, sf_dir), ["arch", "seed", *C])
    return r6(over_seeds(scores, "auc").withColumn("severity", F.col("severity").cast("int")), "mean", "sd", "relative_drop")


@query("+grid as (" + _GRID.format(test="test") + """), t as (select arch, seed, logit, sum(label_45) p, sum(1 - label_45) q from grid where severity = 0 group by 1, 2, 3),
a as (select arch, seed, sum(p * (cq - q * 5e-1)) / nullif(sum(p) * sum(q), 0) auc from (select *, sum(q) over (partition by arch, seed order by logit) cq from t) z group by 1, 2)
select arch, round(avg(auc), 6) mean_auc, round(max(auc), 6) best_auc, cast(arg_max(seed, auc) as int) best_seed from a group by 1""")
def clean_auc_by_architecture(spark, sf_dir):
    a = rank.auc(model_pred(spark, sf_dir).where("severity = 0"), ["arch", "seed"])
    return r6(a.groupBy("arch").agg(F.avg("auc").alias("mean_auc"), F.max("auc").alias("best_auc"), F.max_by("seed", "auc").cast("int").alias("best_seed")), "mean_auc", "best_auc")


# --- significance

_P = """, t as (select *, rho * sqrt((n - 2) / nullif(1 - rho * rho, 0)) t from rho), k as (select degradation_type, metric, least(abs(t), 4e1) / 2000 h, n - 2e0 v from t),
c as (select *, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) c from k),
p as (select degradation_type, metric, 1 - 2 * sum((case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * c * pow(1 + i * h * i * h / v, -(v + 1) / 2)) * any_value(h) / 3 p from c, range(0, 2001) r(i) group by 1, 2)"""


@query(SHIFT + _rho("degradation_type, metric", "abs_shift") + _P + " select degradation_type, metric, n, round(rho, 6) rho, round(greatest(p, 0), 5) + 0e0 p, case when round(greatest(p, 0), 5) < 1e-3 then '***' when round(greatest(p, 0), 5) < 1e-2 then '**' when round(greatest(p, 0), 5) < 5e-2 then '*' else '' end stars from rho join p using (degradation_type, metric)")
def shift_significance(spark, sf_dir):
    found = followed(spark, sf_dir, ["degradation_type"], "abs_shift").drop("target").withColumn("p", F.round(rank.p_value("rho", "n"), 5))
    return r6(found.withColumn("stars", rank.stars(F.col("p"))), "rho")


# --- comparisons of matrices


def _second(sql: str) -> str:
    """The same steps under other names."""
    for a, b in ((", lm as (", ", lm2 as ("), ("from lm)", "from lm2)"), ("rk as (", "rk2 as ("), ("from rk ", "from rk2 "), ("\nrho as (", "\nrho2 as (")):
        sql = sql.replace(a, b)
    return sql


_BOTH = SHIFT + _rho("degradation_type, metric", "abs_shift") + _second(_rho("degradation_type, metric", "abs_error_shift")) + ", m as (select degradation_type, metric, round(a.rho, 4) x, round(b.rho, 4) y from rho a join rho2 b using (degradation_type, metric))"


def matrices(spark, sf_dir) -> DataFrame:
    """degradation_type, metric, x and y: rank correlation of each metric with the absolute logit shift and absolute error shift."""
    both = followed(spark, sf_dir, ["degradation_type"], "abs_shift", "abs_error_shift")
    one = lambda target, name: both.where(F.col("target") == target).select("degradation_type", "metric", F.round("rho", 4).alias(name))
    return one("abs_shift", "x").join(one("abs_error_shift", "y"), ["degradation_type", "metric"])


@query(_BOTH + " select degradation_type, metric, y rho from m")
def alt_abs_error_shift_matrix(spark, sf_dir):
    return matrices(spark, sf_dir).select("degradation_type", "metric", F.col("y").alias("rho"))


@query(_BOTH + ", k as (select *, row_number() over (partition by degradation_type order by abs(x) desc nulls last, metric) kx, row_number() over (partition by degradation_type order by abs(y) desc nulls last, metric) ky from m) select a.degradation_type, a.metric best_by_logit, b.metric best_by_error, a.metric = b.metric same from k a join k b on a.degradation_type = b.degradation_type where a.kx = 1 and b.ky = 1")
def matrix_argmax(spark, sf_dir):
    """The metric that follows the shift best, by either measure; of equals the first by name."""
    best = lambda c: F.min_by("metric", F.struct((-F.coalesce(F.abs(c), F.lit(-1.0))).alias("v"), "metric"))
    out = matrices(spark, sf_dir).groupBy("degradation_type").agg(best("x").alias("best_by_logit"), best("y").alias("best_by_error"))
    return out.withColumn("same", F.col("best_by_logit") == F.col("best_by_error"))


@query(_BOTH + ", r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 ry from m where x is not null and y is not null) select count(*) n, round(max(abs(x - y)), 4) max_diff, round(avg(abs(x - y)), 4) mean_diff, round(corr(rx, ry), 4) rank_rho from r")
def matrix_agreement(spark, sf_dir):
    m = matrices(spark, sf_dir).where("x is not null and y is not null")
    agreed = rank.spearman(m, [], "x", "y").select(F.col("rho").alias("rank_rho"))
    gaps = m.agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_diff"))
    return r6(gaps.crossJoin(F.broadcast(agreed)), "max_diff", "mean_diff", "rank_rho", digits=4)  # one row each


# --- lesions

_POSITIVE = "from (select * from test where severity > 0 and label_45 = 1 and cnr is not null{})"


def _lesion_sql(more: str, last: str) -> str:
    return SHIFT.replace("from (select * from test where severity > 0)", _POSITIVE.format(more)) + _rho("degradation_type, metric", "abs_shift") + last


_CELLS = " select degradation_type, metric, n, round(rho, 6) rho from rho where metric in ('cnr', 'noise_var')"


def _lesion_rho(rows: DataFrame) -> DataFrame:
    cells = long_metrics(rows, "degradation_type", "abs_shift").where("metric in ('cnr', 'noise_var')")
    return r6(rank.spearman(cells, ["degradation_type", "metric"], "value", "abs_shift"), "rho")


@query(_lesion_sql(" and severity = 6", _CELLS))
def lesion_rho_s6(spark, sf_dir):
    return _lesion_rho(lesion_rows(spark, sf_dir).where("severity = 6"))


_FLAGGED = "select t.image_id from test t join (select image_id, delta_mu d0 from test where severity = 0 and cnr is not null) c using (image_id) where degradation_type = 'contrast' group by 1 having max(abs(delta_mu / nullif(d0, 0) - (1 - severity * 5e-2))) > 5e-3"


@query(_lesion_sql(f" and image_id not in ({_FLAGGED})", _CELLS))
def lesion_rho_unflagged(spark, sf_dir):
    """Without the images whose lesion does not follow the contrast as pixels inside the mask do."""
    df = test_rows(spark, sf_dir)
    clean = df.where("severity = 0 and cnr is not null").select("image_id", F.col("delta_mu").alias("d0"))
    off = F.max(F.abs(rank.ratio(F.col("delta_mu"), F.col("d0")) - (F.lit(1.0) - F.col("severity") * F.lit(0.05))))
    flagged = df.where("degradation_type = 'contrast'").join(clean, "image_id").groupBy("image_id").agg(off.alias("worst")).where("worst > 5e-3")
    return _lesion_rho(lesion_rows(spark, sf_dir).join(flagged, "image_id", "left_anti"))


# --- training, parameters, expectations


@query("+k as (select degradation_type, severity, count(*) filter (prob >= 5e-1 and label_45 = 1) tp, count(*) filter (prob >= 5e-1 and label_45 = 0) fp, count(*) filter (prob < 5e-1 and label_45 = 1) fn, count(*) n from test group by 1, 2) select degradation_type, cast(severity as int) severity, round((n - fp - fn) / n, 6) accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as \"precision\", round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 from k")
def training_metrics(spark, sf_dir):
    """As training reports them: what has no denominator is 0."""
    yes, sick = F.col("prob") >= 0.5, F.col("label_45") == 1
    k = test_rows(spark, sf_dir).groupBy(*C).agg(F.count_if(yes & sick).alias("tp"), F.count_if(yes & ~sick).alias("fp"), F.count_if(~yes & sick).alias("fn"), F.count("*").alias("n"))
    part = lambda a, b: F.coalesce(rank.ratio(a, b), F.lit(0.0))
    tp, fp, fn, n = map(F.col, ("tp", "fp", "fn", "n"))
    return r6(k.select(*C, part(n - fp - fn, n).alias("accuracy"), part(tp, tp + fn).alias("recall"), part(tp, tp + fp).alias("precision"), part(2 * tp, 2 * tp + fp + fn).alias("f1")), "accuracy", "recall", "precision", "f1")


@query(f"select degradation_type, cast(count(*) as bigint) n, cast(max(case when severity = 3 then par end) as double) third, round(sum(par), 6) total from ({fixtures.PLAN}) p where severity > 0 group by 1", needs_pred=False)
def parameter_maps(spark, sf_dir):
    """Each degradation's parameters as one map from severity to value."""
    plan = degradation.plan(spark).where("severity > 0")
    maps = plan.groupBy("degradation_type").agg(F.map_from_entries(F.collect_list(F.struct("severity", "parameter_value"))).alias("by_severity"))  # six entries
    values = F.map_values("by_severity")
    return maps.select("degradation_type", F.size("by_severity").cast("long").alias("n"), F.element_at("by_severity", F.lit(3).cast(plan.schema["severity"].dataType)).cast("double").alias("third"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(RQ1 + " select e.name, want, round(auc, 6) as value, coalesce(abs(auc - want) <= tolerance, false) passed from (values ('clean_0', 864e-3, 5e-2), ('jpeg2000_6', 633e-3, 8e-2)) e(name, want, tolerance) left join aucs on concat(degradation_type, '_', cast(severity as varchar)) = e.name")
def golden_check(spark, sf_dir):
    """Each headline value against what it should be: a join with the table of expectations."""
    m = severity_metrics(test_rows(spark, sf_dir)).where("(severity = 0) or (degradation_type = 'jpeg2000' and severity = 6)")
    found = m.select(F.concat_ws("_", *C).alias("name"), F.col("auc").alias("value"))
    expected = spark.createDataFrame([("clean_0", 0.864, 0.05), ("jpeg2000_6", 0.633, 0.08)], "name string, want double, tolerance double")
    return expected.join(found, "name", "left").select("name", "want", F.round("value", 6).alias("value"), F.coalesce(F.abs(F.col("value") - F.col("want")) <= F.col("tolerance"), F.lit(False)).alias("passed"))


# --- intervals


@query()
def bootstrap_ci_study(spark, sf_dir):
    """AUC and AP of each condition, and what they lose against clean, with intervals of 2,000 shared draws of studies."""
    draws = resample.bootstrap_auc(test_rows(spark, sf_dir), C, 2000, 42, cluster="study_id").where("not isnan(auc)")
    clean = lambda m: F.max(F.when(F.col("severity") == 0, F.col(m))).over(Window.partitionBy("draw"))  # noqa: E731  a join would draw twice
    both = draws.withColumns({f"delta_{m}": F.col(m) - clean(m) for m in ("auc", "ap")}).where("delta_auc is not null")
    ends = [f(F.percentile(m, q)).alias(f"{m}_{n}") for m in ("auc", "ap", "delta_auc", "delta_ap") for n, q, f in (("low", 0.025, lambda c: F.round(c, 6)), ("high", 0.975, lambda c: F.round(c, 6)))]
    return both.groupBy(*C).agg(F.count("*").alias("draws"), *ends)


@query()
def bootstrap_ci_unpaired(spark, sf_dir):
    """The interval of each condition's AUC, moved by the AUC of clean: the older figure's bars."""
    df = test_rows(spark, sf_dir)
    ends = resample.interval(resample.bootstrap_auc(df, C, 1000, 2026, ap=False).where("not isnan(auc)"), C, "auc")
    clean = rank.auc(df.where("severity = 0"), []).select(F.col("auc").alias("auc0"))
    return r6(ends.crossJoin(F.broadcast(clean)).select(*C, (F.col("low") - F.col("auc0")).alias("low"), (F.col("high") - F.col("auc0")).alias("high"), "draws"), "low", "high")  # one row


# --- more kernels on 8 x 8 images


def _window(r: int, c: int) -> str:
    return "[" + ", ".join(_at(i, j) for i in range(r - 3, r + 4) for j in range(c - 3, c + 4)) + "]"


_SSIM = " + ".join(f"(select (2 * mx * my + 1e-4) * (2 * cv + 9e-4) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4)) from (select list_avg(x) mx, list_avg(y) my, list_var_samp(x) vx, list_var_samp(y) vy, (list_dot_product(x, y) - 49 * list_avg(x) * list_avg(y)) / 48 cv from (select x, list_transform(x, lambda v: least(greatest(m + 7e-1 * (v - m), 0), 1)) y from (select {_window(r, c)}::double[] x))))" for r in (3, 4) for c in (3, 4))


@query(IMG8 + f"select vec_id, round(({_SSIM}) / 4, 4) ssim from (select vec_id, a, list_median(a) m from t) u", needs_pred=False)
def ssim8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: K.ssim_full(x, K.reduce_contrast(x, 0.7, np.ones((8, 8), bool))), "ssim", 4)


@query(IMG8 + "select vec_id, round(list_avg(list_transform(a, lambda x: least(greatest((x - lo) / (hi - lo), 0), 1))), 4) win from (select vec_id, a, list_aggregate(a, 'quantile_cont', 0.005) lo, list_aggregate(a, 'quantile_cont', 0.995) hi from t) u", needs_pred=False)
def window8(spark, sf_dir):
    return img8(spark, sf_dir, lambda x: float(K.windowed(x, K.fixed_window(x)).astype(float).mean()), "win", 4)
