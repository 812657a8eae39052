"""Ranks, calibration and resampling against plain definitions and invariants."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  it registers the queries
from gradus.functions import calibration, rank
from gradus import study_queries
from gradus.operators import resample
from gradus.queries import QUERIES


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(y, 1.2), 1)  # with ties
    return spark.createDataFrame([(int(k), int(k) % 40, int(a), float(b)) for k, (a, b) in enumerate(zip(y, s))], "image_id long, study_id long, label_45 int, logit double"), y, s


def pairs_auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    p, q = s[y == 1][:, None], s[y == 0][None, :]
    ww = w[y == 1][:, None] * w[y == 0][None, :]
    return float((ww * ((p > q) + 0.5 * (p == q))).sum() / ww.sum())


def test_auc_counts_pairs(scored):
    df, y, s = scored
    assert rank.auc(df, []).first().auc == pytest.approx(pairs_auc(y, s))


def test_weighted_auc_is_the_auc_of_repeated_rows(scored):
    df, y, s = scored
    w = np.arange(len(y)) % 4
    got = rank.auc(df.withColumn("w", F.col("image_id") % 4), [], weight="w").first().auc
    assert got == pytest.approx(pairs_auc(np.repeat(y, w), np.repeat(s, w)))


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.2), ("b", 0, 1.0), ("b", 1, 2.0)], "g string, label_45 int, logit double")
    assert {r.g: r.auc for r in rank.auc(df, ["g"]).collect()} == {"a": None, "b": 1.0}


def test_auc_of_many_groups_is_auc(spark):
    rows = [(g, h, (k * 31 + len(g)) % 3 % 2 if g != "one" else 1, float(k * k % 41 - 20) / 8 * (-1) ** k if k % 7 else -0.0) for g in ("a", "bb", "one") for h in (1, None) for k in range(200)]
    rows += [("a", 1, 1, None), ("bb", 1, 0, float("nan")), ("a", None, None, 0.5), ("a", 1, 1, float("inf")), ("a", 1, 0, float("-inf"))]
    df = spark.createDataFrame(rows, "g string, h int, label_45 int, logit double").repartition(3)
    want = {(r.g, r.h): (r.n, r.n_pos, r.auc) for r in rank.auc(df.where("abs(logit) < 100"), ["g", "h"]).collect()}
    for size in (50, 1 << 20):
        assert {(r.g, r.h): (r.n, r.n_pos, r.auc) for r in rank.auc_many(df.where("abs(logit) < 100"), ["g", "h"], rows=size).collect()} == want
        both = {(r.g, r.h): r.n for r in rank.auc_many(df, ["g", "h"], rows=size).collect()}
        assert both == {k: n + 2 * (k == ("a", 1)) for k, (n, _, _) in want.items()}
    assert rank.auc_many(df.where("false"), ["g"]).count() == 0


def test_models_of_one_small_file_are_scored_in_many_tasks(spark, sf):
    assert study_queries.model_pred(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_empty_and_null_scores(spark):
    df = spark.createDataFrame([(1, None), (0, float("nan")), (1, 1.0), (0, 0.0)], "label_45 int, logit double")
    assert rank.auc(df, []).first().auc == 1.0
    assert rank.auc(df.where("false"), []).first().auc is None


def test_monotone_maps_leave_ranks(scored):
    df, _, _ = scored
    both = df.withColumn("p", calibration.sigmoid(F.col("logit")))
    for f in (rank.auc, rank.average_precision):
        a, b = f(both, []).first(), f(both, [], score="p").first()
        assert a[-1] == pytest.approx(b[-1], abs=1e-12)


def test_rows_in_another_order(scored):
    df, _, _ = scored
    assert rank.spearman(df, [], "logit", "study_id").first().rho == pytest.approx(rank.spearman(df.repartition(7).orderBy(F.rand(1)), [], "logit", "study_id").first().rho)


def test_spearman_of_a_constant_and_of_few_is_null(spark):
    df = spark.range(20).select(F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y"))
    assert rank.spearman(df, [], "x", "y").first().rho is None
    assert rank.spearman(df.withColumn("x", F.col("y")).limit(5), [], "x", "y").first().rho is None


def test_youden_takes_infinity_when_nothing_helps(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 1.0)], "label_45 int, logit double")
    assert rank.youden(df, []).first().threshold == float("inf")


def test_ece_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (0, 1 / 15)], "label_45 int, prob double")
    assert sorted(r.bin for r in calibration.reliability(df, []).collect()) == [0, 1, 14]
    assert 0 <= calibration.ece(df, []).first().ece <= 1


def test_f1_is_null_without_hits(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.9)], "label_45 int, prob double")
    r = calibration.threshold_metrics(df, [], 0.5).first()
    assert r.f1 is None and r.sensitivity == 0 and r.balanced_accuracy == 0


def test_fits_find_what_made_the_data(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 0.7)))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y)], "logit double, label_45 int")
    a, b = calibration.fit_platt(df)
    assert a == pytest.approx(0.5, abs=0.08) and b == pytest.approx(-0.7, abs=0.12)
    assert calibration.fit_temperature(df) > 1
    t = calibration.calibrated(df, 2.0, (a, b))
    assert rank.auc(t, [], score="prob_temp").first().auc == pytest.approx(rank.auc(df, []).first().auc, abs=1e-12)


def test_bootstrap_pairs_draws(scored):
    df, y, s = scored
    two = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")))
    draws = resample.bootstrap_auc(two, ["g"], 30, 42, cluster="study_id").toPandas().pivot(index="draw", columns="g", values="auc")
    assert (draws.a - draws.b).abs().max() == 0
    assert abs(draws.a.mean() - pairs_auc(y, s)) < 0.05


def test_samples(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 10)
    assert resample.sample(df, 7, "id").count() == 7
    assert resample.one_per_group(df, "g", "id").count() == 10
    assert resample.stratified(df, F.col("g") == 0, {True: 50, False: 5}, "id").groupBy((F.col("g") == 0).alias("s")).count().collect().__len__() == 2
    assert {r[0] for r in resample.sample(df, 7, "id").select("id").collect()} == {r[0] for r in resample.sample(df.repartition(9), 7, "id").select("id").collect()}


@pytest.mark.parametrize(("name", "draws"), [("bootstrap_ci_image", 1000), ("bootstrap_ci_study_paired", 2000), ("mean_iqm_ci", 600)])
def test_registered_bootstraps_take_the_references_draws(spark, sf, monkeypatch, name, draws):
    """pubcommon.N_BOOT, fig3_4_studylevel.B and fig2_global_iqm.boot_mean_ci."""
    taken = []
    for f in ("bootstrap_auc", "bootstrap_mean"):
        monkeypatch.setattr(resample, f, lambda *a, f=getattr(resample, f), **b: taken.append(a[2] if f.__name__ == "bootstrap_auc" else a[3]) or f(*a, **b))
    out = QUERIES[name](spark, sf)
    assert taken == [draws]
    if "draws" in out.columns:
        assert out.agg({"draws": "max"}).first()[0] == draws


def test_many_rank_correlations_without_shuffling_rows(spark):
    """Ties, nulls, NaN and a group too large for its distinct values to travel: as scipy-like ranks give, pair by pair."""
    rng = np.random.default_rng(3)
    g = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "x1": rng.integers(0, 9, 400).astype(float), "x2": rng.random(400), "y": rng.integers(0, 40, 400) / 8})
    rows = [tuple(None if c == "x1" and i % 7 == 0 else float("nan") if c == "x2" and i % 11 == 0 else v for c, v in zip(g.columns, r, strict=True)) for i, r in enumerate(g.itertuples(index=False))]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, y double")
    for most in (10_000, 100):
        found = {(r["g"], r["x"]): (r["n"], round(r["rho"], 9)) for r in rank.spearman_many(df, ["g"], ["x1", "x2"], ["y"], most=most).collect()}
        plain = pd.DataFrame(rows, columns=g.columns)
        for (name, x), got in found.items():
            part = plain[plain["g"] == name][[x, "y"]].dropna().astype(float)
            assert got == (len(part), round(part[x].rank().corr(part["y"].rank()), 9))
        assert len(found) == 4


def test_pairs_of_images_shuffle_no_expanded_rows(spark, sf):
    from gradus import queries

    text = queries.paired(queries.test_rows(spark, sf, by_image=True))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text
    assert all("REPARTITION_BY_NUM" in line or "Broadcast" in line for line in text.splitlines() if "Exchange" in line)


@pytest.mark.parametrize("n, clusters, share, digits", [(400, 40, 0.5, 1), (3000, 300, 0.2, 6), (50, 50, 0.0, 1), (50, 20, 1.0, 1), (300, 300, 0.02, 0)])
def test_draws_by_whole_numbers_are_the_weighted_statistics(n, clusters, share, digits):
    rng = np.random.default_rng(n)
    y, unit = (rng.random(n) < share).astype(float), rng.integers(0, clusters, n)
    s = np.round(rng.normal(y, 1.2), digits)
    times = np.stack([np.bincount(rng.integers(0, clusters, clusters), minlength=clusters) for _ in range(20)])
    order = np.argsort(s, kind="stable")
    starts, weights = np.flatnonzero(np.r_[True, np.diff(s[order]) > 0]), times[:, unit].astype(float)
    want = np.stack([resample.weighted_auc(order, starts, y, weights), resample.weighted_ap(order, starts, y, weights)], axis=1)
    drawn = resample.DrawnRanks(unit, s, y == 1)
    assert np.allclose([drawn.auc_and_ap(t) for t in times], want, equal_nan=True, atol=1e-12)


@pytest.mark.parametrize("n, clusters, share, digits", [(400, 40, 0.5, 1), (50, 50, 0.0, 1), (50, 20, 1.0, 1), (3000, 300, 0.2, 6), (300_000, 5000, 0.2, 2), (140_000, 300, 0.0005, 6), (20_000, 100, 0.9, 9)])
def test_eight_draws_at_once_are_those_one_by_one(n, clusters, share, digits):
    """Ties within and across blocks, one class only, and more positives in a block than 16 bits could add up."""
    rng = np.random.default_rng(n)
    y, unit = rng.random(n) < share, rng.integers(0, clusters, n)
    s = np.round(rng.normal(y * (9.0 if share == 0.9 else 1.0), 1.2), digits)
    times = np.zeros((clusters + 1, 8), np.uint8)
    times[:clusters] = np.minimum(rng.poisson(1.5, (clusters, 8)), 15)
    drawn, packed = resample.DrawnRanks(unit, s, y), resample.PackedRanks(unit, s, y)
    want = np.array([drawn.auc_and_ap(times[:-1, k]) for k in range(8)])
    assert np.array_equal(packed.auc_and_ap_of_eight(times.view(np.uint64).ravel()), want, equal_nan=True)
    assert np.array_equal([packed.plain().auc_and_ap(times[:-1, k]) for k in range(8)], want, equal_nan=True)


def test_bootstrap_tasks_hold_few_rows_of_a_group(spark):
    """One group after another, cells of few rows, and the draws of numpy's generator, whichever task has a group."""
    rng = np.random.default_rng(8)
    rows = [(g, int(i), int(i) % 90 + (1 << 33 if g == "d" else 0), float(np.round(rng.normal(), 2)), int(rng.random() < 0.3)) for g in ("a", "b", None, "d") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, image_id long, study_id long, logit double, label_45 int").repartition(3)
    found = resample.bootstrap_auc(df, ["g"], 11, 42, cluster="study_id", rows=500)
    got = {(r.g, r.draw): (r.auc, r.ap) for r in found.collect()}
    for g in ("a", "b", None, "d"):
        part = [r for r in rows if r[0] == g]
        unit = np.unique([r[2] for r in part], return_inverse=True)[1]
        ranks, draws = resample.DrawnRanks(unit, np.array([r[3] for r in part]), np.array([r[4] == 1 for r in part])), np.random.default_rng(42)
        want = [ranks.auc_and_ap(np.bincount(draws.integers(0, 90, 90), minlength=90)) for _ in range(11)]
        assert np.allclose([got[g, d] for d in range(11)], want, atol=1e-12)  # of equal scores rows come in any order
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan  # which would hold a group, or several, as one table
    cells = list(resample._cells(16)(iter([pa.RecordBatch.from_pydict({"_k": pa.array([0, 1] * 50, pa.int32()), "unit": list(range(100))})])))
    assert max(len(x) for b in cells for x in b.column(1).to_pylist()) == 16


def test_counts_of_draws_are_the_generators():
    for n in (1, 5, 2_500_000):
        a, b = np.random.default_rng(3), np.random.default_rng(3)
        assert all(np.array_equal(resample._times(a, n), np.bincount(b.integers(0, n, n), minlength=n)) for _ in range(2))


@pytest.mark.parametrize("name", ["bootstrap_ci_study_paired", "bootstrap_ci_study"])
def test_paired_bootstraps_draw_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the cells, and the draws
