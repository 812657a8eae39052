"""Queries over the study's tables, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calibration, rank
from .plans import degradation, fixtures

C = ["degradation_type", "severity"]
IQMS = ["cnr", "noise_var", "tenengrad", "ssim", "tau"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, needs_pred: bool = True):
    """Registers a query under its function's name; sql may read pred (and test, its test rows)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"with pred as ({fixtures.PRED}), test as (select * from pred where split = 'test')" + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")) if needs_pred else sql
        return f

    return add


def test_rows(spark: SparkSession, sf_dir: str, by_image: bool = False) -> DataFrame:
    return fixtures.pred(spark, sf_dir, by_image).where("split = 'test'")


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- the plan


@query(f"select degradation_type, cast(severity as int) severity, case when severity > 0 then cast(par as double) end parameter_value from ({fixtures.PLAN}) p", needs_pred=False)
def plan_31(spark, sf_dir):
    return degradation.plan(spark).select(*C, "parameter_value")


@query("select split, degradation_type, cast(severity as int) severity, count(*) n, cast(sum(label_45) as bigint) n_pos, cast(sum(case when label_5 = 1 then 1 else 0 end) as bigint) n_five from pred group by all")
def pred_counts(spark, sf_dir):
    return fixtures.pred(spark, sf_dir).groupBy("split", *C).agg(F.count("*").alias("n"), F.sum("label_45").alias("n_pos"), F.sum("label_5").alias("n_five"))


@query("select (select count(*) from orders) n_images, (select count(*) from orders) * 31 n_rows, count(distinct (severity, degradation_type)) n_specs from pred")
def plan_expansion(spark, sf_dir):
    images = fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_orderkey")
    rows = degradation.expand(images, degradation.plan(spark))
    return rows.agg(F.countDistinct("o_orderkey").alias("n_images"), F.count("*").alias("n_rows"), F.countDistinct("spec_idx").alias("n_specs"))


# --- discrimination

RANK_AUC = """+ranked as (select *, rank() over (partition by degradation_type, severity order by logit) + (count(*) over (partition by degradation_type, severity, logit) - 1) * 0.5 rk from test),
aucs as (select degradation_type, severity, count(*) n, sum(label_45) n_pos, (sum(case when label_45 = 1 then rk else 0 end) - sum(label_45) * (sum(label_45) + 1) * 0.5) / nullif(sum(label_45) * (count(*) - sum(label_45)), 0) auc from ranked group by 1, 2),
ties as (select degradation_type, severity, logit, sum(label_45) p, count(*) c from test group by 1, 2, 3),
steps as (select *, sum(p) over w cp, sum(c) over w cc, sum(p) over (partition by degradation_type, severity) tp from ties window w as (partition by degradation_type, severity order by logit desc)),
aps as (select degradation_type, severity, sum(p * 1.0 / nullif(tp, 0) * cp / cc) ap from steps group by 1, 2)"""


@query(RANK_AUC + " select degradation_type, cast(severity as int) severity, n, cast(n_pos as bigint) n_pos, round(auc, 6) auc from aucs")
def auc_by_condition(spark, sf_dir):
    return r6(rank.auc(test_rows(spark, sf_dir), C), "auc")


@query(RANK_AUC + " select degradation_type, cast(severity as int) severity, round(ap, 6) ap from aps")
def ap_by_condition(spark, sf_dir):
    return r6(rank.average_precision(test_rows(spark, sf_dir), C), "ap")


ROC = """+pts as (select logit threshold, sum(sum(label_45)) over w tp, sum(sum(1 - label_45)) over w fp from test where degradation_type = 'clean' group by logit window w as (order by logit desc)
union all select cast('inf' as double), 0, 0)"""


@query(ROC + " select threshold, cast(tp as bigint) tp, cast(fp as bigint) fp, round(tp / nullif(max(tp) over (), 0), 6) tpr, round(fp / nullif(max(fp) over (), 0), 6) fpr from pts")
def roc_points(spark, sf_dir):
    return r6(rank.curve(test_rows(spark, sf_dir).where("degradation_type = 'clean'"), []), "tpr", "fpr").drop("precision")


@query(ROC + " select threshold, round(tp / nullif(max(tp) over (), 0), 6) recall, round(tp / nullif(tp + fp, 0), 6) as \"precision\" from pts where threshold < cast('inf' as double)")
def pr_points(spark, sf_dir):
    points = rank.curve(test_rows(spark, sf_dir).where("degradation_type = 'clean'"), []).where(F.col("threshold") < float("inf"))
    return r6(points.select("threshold", F.col("tpr").alias("recall"), "precision"), "recall", "precision")


def _youden(split: str) -> str:
    return f"""+pts as (select logit threshold, sum(sum(label_45)) over w tp, sum(sum(1 - label_45)) over w fp from pred where degradation_type = 'clean' and split = '{split}' group by logit window w as (order by logit desc)),
j as (select threshold, tp / (max(tp) over ()) - fp / (max(fp) over ()) j from pts) select threshold, round(j, 6) j from j order by round(j, 9) desc, threshold desc limit 1"""


@query(_youden("test"))
def youden_threshold_test(spark, sf_dir):
    return r6(rank.youden(test_rows(spark, sf_dir).where("degradation_type = 'clean'"), []), "j")


@query(_youden("val"))
def youden_threshold_val(spark, sf_dir):
    return r6(rank.youden(fixtures.pred(spark, sf_dir).where("degradation_type = 'clean' and split = 'val'"), []), "j")


def severity_metrics(df: DataFrame) -> DataFrame:
    """AUC and AP of each condition, what they lose against clean, and sensitivity at the clean rows' Youden threshold."""
    m = rank.auc_and_ap(df, C)
    clean = m.where("degradation_type = 'clean'").select(F.col("auc").alias("auc0"), F.col("ap").alias("ap0"))
    threshold = rank.youden(df.where("degradation_type = 'clean'"), []).select("threshold")
    sens = df.crossJoin(F.broadcast(threshold)).groupBy(*C).agg(rank.ratio(F.count_if((F.col("label_45") == 1) & (F.col("logit") >= F.col("threshold"))), F.count_if(F.col("label_45") == 1)).alias("sensitivity"))  # one row
    m = m.crossJoin(F.broadcast(clean)).join(sens, C)  # one row
    return m.select(*C, "n", "n_pos", "auc", "ap", (F.col("auc") - F.col("auc0")).alias("delta_auc"), (F.col("ap") - F.col("ap0")).alias("delta_ap"), rank.ratio(F.col("auc0") - F.col("auc"), F.col("auc0")).alias("relative_drop"), "sensitivity")


RQ1 = RANK_AUC + """, pts as (select logit threshold, sum(sum(label_45)) over w tp, sum(sum(1 - label_45)) over w fp from test where degradation_type = 'clean' group by logit window w as (order by logit desc)),
j as (select threshold, tp / (max(tp) over ()) - fp / (max(fp) over ()) j from pts), thr as (select threshold from j order by round(j, 9) desc, threshold desc limit 1),
sens as (select degradation_type, severity, avg(case when logit >= threshold then 1e0 else 0e0 end) sensitivity from test, thr where label_45 = 1 group by 1, 2),
base as (select auc auc0, ap ap0 from aucs join aps using (degradation_type, severity) where severity = 0)"""


@query(RQ1 + """ select degradation_type, cast(severity as int) severity, n, cast(n_pos as bigint) n_pos, round(auc, 6) auc, round(ap, 6) ap, round(auc - auc0, 6) delta_auc, round(ap - ap0, 6) delta_ap, round((auc0 - auc) / auc0, 6) relative_drop, round(sensitivity, 6) sensitivity
from aucs join aps using (degradation_type, severity) left join sens using (degradation_type, severity), base""")
def rq1_severity_metrics(spark, sf_dir):
    return r6(severity_metrics(test_rows(spark, sf_dir)), "auc", "ap", "delta_auc", "delta_ap", "relative_drop", "sensitivity")


@query(RQ1 + """ select degradation_type, cast(min(case when (auc0 - auc) / auc0 > 0.05 then severity end) as int) first_severity from aucs, base where severity > 0 group by degradation_type""")
def first_drop_severity(spark, sf_dir):
    m = severity_metrics(test_rows(spark, sf_dir)).where("severity > 0")
    return m.groupBy("degradation_type").agg(F.min(F.when(F.col("relative_drop") > 0.05, F.col("severity"))).alias("first_severity"))


# --- calibration


def _bins(n: int) -> str:
    edges = ",".join(f"({k},{k}/{n}e0,{k + 1}/{n}e0)" for k in range(n))
    return f"""+e(b, lo, hi) as (values {edges}), r as (select degradation_type, severity, b, count(*) n, avg(prob) conf, avg(label_45) acc from test join e on prob >= lo and (prob < hi or (b = {n - 1} and prob <= 1)) group by 1, 2, 3)"""


@query(_bins(15) + " select degradation_type, cast(severity as int) severity, cast(sum(n) as bigint) n, round(sum(n * abs(acc - conf)) / sum(n), 6) ece from r group by 1, 2")
def ece15(spark, sf_dir):
    return r6(calibration.ece(test_rows(spark, sf_dir), C, 15), "ece")


@query(_bins(10) + " select degradation_type, cast(severity as int) severity, cast(sum(n) as bigint) n, round(sum(n * abs(acc - conf)) / sum(n), 6) ece from r group by 1, 2")
def ece10(spark, sf_dir):
    return r6(calibration.ece(test_rows(spark, sf_dir), C, 10), "ece")


@query(_bins(15) + " select degradation_type, cast(severity as int) severity, cast(b as int) bin, n, round(conf, 5) confidence, round(acc, 5) accuracy from r")
def reliability_bins(spark, sf_dir):
    return r6(calibration.reliability(test_rows(spark, sf_dir), C, 15), "confidence", "accuracy", digits=5)


@query("select degradation_type, cast(severity as int) severity, round(avg(prob * prob - 2 * prob * label_45 + label_45), 6) brier from test group by 1, 2")
def brier(spark, sf_dir):
    return r6(test_rows(spark, sf_dir).groupBy(*C).agg(calibration.brier().alias("brier")), "brier")


@query("""+g as (select degradation_type, severity, sum(prob * (1 - label_45)) / nullif(sum(1 - label_45), 0) a, 1 - sum(prob * label_45) / nullif(sum(label_45), 0) b from test group by 1, 2)
select degradation_type, cast(severity as int) severity, round(a, 6) gap_neg, round(b, 6) gap_pos, round((a + b) / 2, 6) balanced from g""")
def classwise_gaps(spark, sf_dir):
    return r6(calibration.class_gaps(test_rows(spark, sf_dir), C), "gap_neg", "gap_pos", "balanced")


@query(_youden("val").replace("select threshold, round(j, 6) j from j order", ", thr as (select threshold from j order").replace("limit 1", "limit 1)") + """,
k as (select degradation_type, severity, sum(case when logit >= threshold and label_45 = 1 then 1 else 0 end) tp, sum(case when logit >= threshold and label_45 = 0 then 1 else 0 end) fp, sum(case when logit < threshold and label_45 = 1 then 1 else 0 end) fn, sum(case when logit < threshold and label_45 = 0 then 1 else 0 end) tn from test, thr group by 1, 2)
select degradation_type, cast(severity as int) severity, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, cast(tn as bigint) tn, round(tp / nullif(tp + fn, 0), 6) sensitivity, round(tn / nullif(tn + fp, 0), 6) specificity,
case when tp > 0 then round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) end f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) balanced_accuracy from k""")
def threshold_metrics(spark, sf_dir):
    threshold = rank.youden(fixtures.pred(spark, sf_dir).where("degradation_type = 'clean' and split = 'val'"), []).select("threshold")
    rows = test_rows(spark, sf_dir).crossJoin(F.broadcast(threshold))  # one row
    return r6(calibration.threshold_metrics(rows, C, F.col("threshold"), "logit"), "sensitivity", "specificity", "f1", "balanced_accuracy")


# --- paired shift and correlation


def paired(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Degraded rows with the logit, probability and quality of the same image's clean row, and the shifts."""
    clean = df.where("degradation_type = 'clean'").select(key, *(F.col(c).alias(f"clean_{c}") for c in ("logit", "prob", *IQMS)))
    out = df.where("degradation_type <> 'clean'").join(clean.hint("shuffle_hash"), key)  # a row per image; no sort of the others
    error, error0 = F.abs(F.col("label_45") - F.col("prob")), F.abs(F.col("label_45") - F.col("clean_prob"))
    return out.withColumns({"shift": F.col("logit") - F.col("clean_logit"), "abs_shift": F.abs(F.col("logit") - F.col("clean_logit")), "error_shift": error - error0, "abs_error_shift": F.abs(error - error0)})


SHIFT = """+sh as (select t.*, t.logit - c.logit shift, abs(t.logit - c.logit) abs_shift, abs(t.label_45 - t.prob) - abs(t.label_45 - c.prob) error_shift, abs(abs(t.label_45 - t.prob) - abs(t.label_45 - c.prob)) abs_error_shift,
c.cnr cnr0, c.delta_mu dm0 from (select * from test where severity > 0) t join (select * from test where severity = 0) c using (image_id))"""


@query(SHIFT + " select degradation_type, cast(severity as int) severity, count(*) n, round(avg(shift), 6) mean_shift, round(avg(abs_shift), 6) mean_abs_shift, round(quantile_cont(abs_shift, 0.5), 6) median_abs_shift, round(avg(error_shift), 6) mean_error_shift from sh group by 1, 2")
def prediction_shift(spark, sf_dir):
    return r6(paired(test_rows(spark, sf_dir)).groupBy(*C).agg(F.count("*").alias("n"), F.avg("shift").alias("mean_shift"), F.avg("abs_shift").alias("mean_abs_shift"), F.median("abs_shift").alias("median_abs_shift"), F.avg("error_shift").alias("mean_error_shift")), "mean_shift", "mean_abs_shift", "median_abs_shift", "mean_error_shift")


def followed(spark, sf_dir, groups: list[str], *targets: str) -> DataFrame:
    """groups, metric, target, n, rho: how each quality metric follows each shift of degraded rows."""
    return rank.spearman_many(paired(test_rows(spark, sf_dir, by_image=True)), groups, IQMS, targets).withColumnsRenamed({"x": "metric", "y": "target"})


def long_metrics(df: DataFrame, *keep: str) -> DataFrame:
    """A row per metric: one pass over ranks serves them all."""
    return df.unpivot(list(keep), IQMS, "metric", "value").where("value is not null")


def _rho(groups: str, y: str) -> str:
    un = " union all ".join(f"select image_id, degradation_type, severity, '{m}' metric, {m} value, {y} y from sh where {m} is not null and {y} is not null" for m in IQMS)
    return f""", lm as ({un}), rk as (select {groups}, rank() over (partition by {groups} order by value) + (count(*) over (partition by {groups}, value) - 1) / 2 rx, rank() over (partition by {groups} order by y) + (count(*) over (partition by {groups}, y) - 1) / 2 ry from lm),
rho as (select {groups}, count(*) n, case when count(*) >= 10 and var_pop(rx) > 0 and var_pop(ry) > 0 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) end rho from rk group by {groups})"""


@query(SHIFT + _rho("degradation_type, metric", "abs_shift") + " select degradation_type, metric, n, round(rho, 6) rho from rho")
def iqm_shift_spearman(spark, sf_dir):
    return r6(followed(spark, sf_dir, ["degradation_type"], "abs_shift").drop("target"), "rho")


@query(SHIFT + _rho("degradation_type, severity, metric", "abs_shift") + " select degradation_type, metric, cast(count(rho) as bigint) n_severities, round(avg(rho), 6) mean_rho from rho group by 1, 2")
def within_severity_rho(spark, sf_dir):
    return r6(followed(spark, sf_dir, C, "abs_shift").groupBy("degradation_type", "metric").agg(F.count("rho").alias("n_severities"), F.avg("rho").alias("mean_rho")), "mean_rho")


def _bridge(target: str) -> str:
    un = " union all ".join(f"select degradation_type, severity, '{m}' metric, avg({m}) value from test where severity > 0 group by 1, 2" for m in IQMS)
    return RANK_AUC + f""", m as ({un}), mm as (select metric, value, {target} y from m join aucs using (degradation_type, severity) join aps using (degradation_type, severity)),
k as (select metric, rank() over (partition by metric order by round(value, 12)) + (count(*) over (partition by metric, round(value, 12)) - 1) / 2 rx, rank() over (partition by metric order by round(y, 12)) + (count(*) over (partition by metric, round(y, 12)) - 1) / 2 ry from mm)
select metric, count(*) n, round(corr(rx, ry), 6) rho from k group by 1"""


@query(_bridge("auc"))
def bridge_rho_auc(spark, sf_dir):
    return r6(_bridged(spark, sf_dir, "auc"), "rho")


@query(_bridge("ap"))
def bridge_rho_ap(spark, sf_dir):
    return r6(_bridged(spark, sf_dir, "ap"), "rho")


def _bridged(spark, sf_dir, target):
    df = test_rows(spark, sf_dir)
    perf = rank.auc_and_ap(df, C)
    means = df.where("severity > 0").groupBy(*C).agg(*(F.round(F.avg(m), 12).alias(m) for m in IQMS)).join(perf, C).withColumn(target, F.round(target, 12))
    return rank.spearman(long_metrics(means, *C, target), ["metric"], "value", target)


@query(SHIFT + _rho("degradation_type, metric", "error_shift") + " select degradation_type, metric, n, round(rho, 4) rho from rho")
def alt_error_shift_matrix(spark, sf_dir):
    return r6(followed(spark, sf_dir, ["degradation_type"], "error_shift").drop("target"), "rho", digits=4)


@query(SHIFT + " select degradation_type, " + ", ".join(f"round(avg(case when severity = {s} then error_shift end), 6) s{s}" for s in range(1, 7)) + " from sh group by 1")
def err_shift_pivot(spark, sf_dir):
    p = paired(test_rows(spark, sf_dir)).groupBy("degradation_type").pivot("severity", list(range(1, 7))).agg(F.avg("error_shift"))
    return r6(p.withColumnsRenamed({str(s): f"s{s}" for s in range(1, 7)}), *(f"s{s}" for s in range(1, 7)))


@query(SHIFT + """, ed as (select degradation_type, list_distinct([""" + ", ".join(f"quantile_cont(ssim, {k}/12e0)" for k in range(13)) + """]) e from sh group by 1), b as (select degradation_type, abs_shift, ssim, greatest(len(list_filter(e, lambda v: round(v, 9) < ssim)), 1) bin from sh join ed using (degradation_type))
select degradation_type, cast(bin as int) bin, count(*) n, round(quantile_cont(ssim, 0.5), 6) median_ssim, round(quantile_cont(abs_shift, 0.5), 6) median_shift from b group by 1, 2""")
def qcut_trend(spark, sf_dir):
    rows = paired(test_rows(spark, sf_dir)).select("degradation_type", "ssim", "abs_shift")
    edges = rows.groupBy("degradation_type").agg(F.array_distinct(F.percentile("ssim", F.array(*(F.lit(k / 12) for k in range(13))))).alias("edges"))
    cut = rows.join(F.broadcast(edges), "degradation_type")  # a row per degradation
    bin_ = F.greatest(F.size(F.filter("edges", lambda v: F.round(v, 9) < F.col("ssim"))), F.lit(1))
    return r6(cut.groupBy("degradation_type", bin_.alias("bin")).agg(F.count("*").alias("n"), F.median("ssim").alias("median_ssim"), F.median("abs_shift").alias("median_shift")), "median_ssim", "median_shift")


# --- lesions


@query(SHIFT + """ select degradation_type, count(*) n, round(quantile_cont(cnr / nullif(cnr0, 0), 0.5), 6) cnr_ratio, round(quantile_cont(delta_mu / nullif(dm0, 0), 0.5), 6) delta_mu_ratio, round(quantile_cont((delta_mu / nullif(cnr, 0)) / nullif(dm0 / nullif(cnr0, 0), 0), 0.5), 6) sigma_ratio
from sh where severity = 6 and label_45 = 1 and cnr is not null group by 1""")
def lesion_ratios(spark, sf_dir):
    rows = lesion_rows(spark, sf_dir).where("severity = 6")
    return r6(rows.groupBy("degradation_type").agg(F.count("*").alias("n"), F.median("cnr_ratio").alias("cnr_ratio"), F.median("delta_mu_ratio").alias("delta_mu_ratio"), F.median("sigma_ratio").alias("sigma_ratio")), "cnr_ratio", "delta_mu_ratio", "sigma_ratio")


def lesion_rows(spark, sf_dir) -> DataFrame:
    """Degraded positives with a lesion, with their ratios to clean; sigma is delta_mu / cnr."""
    df = test_rows(spark, sf_dir)
    clean = df.where("severity = 0").select("image_id", F.col("delta_mu").alias("dm0"))
    rows = paired(df).join(clean, "image_id").where("label_45 = 1 and cnr is not null")
    sigma, sigma0 = rank.ratio(F.col("delta_mu"), F.col("cnr")), rank.ratio(F.col("dm0"), F.col("clean_cnr"))
    return rows.withColumns({"cnr_ratio": rank.ratio(F.col("cnr"), F.col("clean_cnr")), "delta_mu_ratio": rank.ratio(F.col("delta_mu"), F.col("dm0")), "sigma_ratio": rank.ratio(sigma, sigma0)})


@query(SHIFT.replace("from (select * from test where severity > 0)", "from (select * from test where severity > 0 and label_45 = 1 and cnr is not null)") + _rho("degradation_type, metric", "abs_shift") + " select degradation_type, metric, n, round(rho, 6) rho from rho where metric in ('cnr', 'noise_var')")
def lesion_rho(spark, sf_dir):
    rows = long_metrics(lesion_rows(spark, sf_dir), "degradation_type", "abs_shift").where("metric in ('cnr', 'noise_var')")
    return r6(rank.spearman(rows, ["degradation_type", "metric"], "value", "abs_shift"), "rho")


@query("""+c as (select image_id, delta_mu d0 from test where severity = 0 and cnr is not null), r as (select t.image_id, t.severity, delta_mu / nullif(d0, 0) ratio, 1 - severity * 5e-2 alpha from test t join c using (image_id) where degradation_type = 'contrast'),
f as (select image_id, max(abs(ratio - alpha)) worst, regr_slope(ratio, alpha) slope, regr_intercept(ratio, alpha) icpt from r group by 1),
z as (select image_id, max(abs(ratio - slope * alpha - icpt)) resid from r join f using (image_id) group by 1)
select image_id, round(worst, 4) worst, worst > 5e-3 flagged, round(slope, 3) slope, round(resid, 4) resid from f join z using (image_id)""")
def mask_affine_check(spark, sf_dir):
    df = test_rows(spark, sf_dir)
    clean = df.where("severity = 0 and cnr is not null").select("image_id", F.col("delta_mu").alias("d0"))
    r = df.where("degradation_type = 'contrast'").join(clean, "image_id").select("image_id", rank.ratio(F.col("delta_mu"), F.col("d0")).alias("ratio"), (F.lit(1.0) - F.col("severity") * F.lit(0.05)).alias("alpha"))
    fit = r.groupBy("image_id").agg(F.max(F.abs(F.col("ratio") - F.col("alpha"))).alias("worst"), F.regr_slope("ratio", "alpha").alias("slope"), F.regr_intercept("ratio", "alpha").alias("icpt"), F.collect_list(F.struct("ratio", "alpha")).alias("points"))  # six points an image
    resid = F.array_max(F.transform("points", lambda p: F.abs(p["ratio"] - F.col("slope") * p["alpha"] - F.col("icpt"))))
    out = fit.withColumns({"resid": resid, "flagged": F.col("worst") > 5e-3}).select("image_id", "worst", "flagged", "slope", "resid")
    return r6(r6(out, "worst", "resid", digits=4), "slope", digits=3)


@query("""select degradation_type, cast(label_45 as int) label_45, count(cnr) n_cnr, count(delta_mu) n_delta_mu, count(*) n from test group by degradation_type, label_45
union all select degradation_type, null, count(cnr), count(delta_mu), count(*) from test group by degradation_type union all select null, null, count(cnr), count(delta_mu), count(*) from test""")
def roi_coverage(spark, sf_dir):
    sets = [["degradation_type", "label_45"], ["degradation_type"], []]
    df = test_rows(spark, sf_dir)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], "degradation_type", "label_45").agg(F.count("cnr").alias("n_cnr"), F.count("delta_mu").alias("n_delta_mu"), F.count("*").alias("n")).select("degradation_type", F.col("label_45").cast("int").alias("label_45"), "n_cnr", "n_delta_mu", "n")


@query(SHIFT + " select cast(severity as int) severity, round(max(abs(cnr - cnr0)), 4) worst_cnr, round(quantile_cont(cnr / nullif(cnr0, 0), 0.5), 4) median_ratio from sh where degradation_type = 'contrast' and cnr is not null and image_id % 13 <> 0 group by 1")
def contrast_invariance(spark, sf_dir):
    rows = paired(test_rows(spark, sf_dir)).where("degradation_type = 'contrast' and cnr is not null and image_id % 13 <> 0")  # lesions inside the mask
    return rows.groupBy("severity").agg(F.round(F.max(F.abs(F.col("cnr") - F.col("clean_cnr"))), 4).alias("worst_cnr"), F.round(F.median(rank.ratio(F.col("cnr"), F.col("clean_cnr"))), 4).alias("median_ratio"))
