"""Queries over annotations, lesions, logs and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import boxes, calibration, rank
from .operators import labels, resample, trainlog
from .plans import fixtures
from .queries import C, IQMS, ORACLES, QUERIES, paired, query, r6, test_rows

ANN = f"with ann as ({fixtures.ANNOTATIONS}) "
LES = f"with les as ({fixtures.LESIONS}), ok as (select *, cast(x2 - x1 as bigint) * (y2 - y1) area, row_number() over (partition by image_id, pos order by x1, y1, x2, y2, laterality, finding) rn from les where x2 > x1 and y2 > y1) "
LOG = f"with log as ({fixtures.TRAIN_LOG}) "


@query(ANN + r"""select image_id, cast(case when regexp_full_match(trim(breast_birads), '(.*\s)?[0-9]+') then regexp_extract(trim(breast_birads), '([0-9]+)$', 1) end as double) grade,
cast(case when regexp_full_match(trim(breast_birads), '(.*\s)?[0-9]+') and cast(regexp_extract(trim(breast_birads), '([0-9]+)$', 1) as int) >= 4 then 1 else 0 end as int) label_45,
cast(case when regexp_full_match(trim(breast_birads), '(.*\s)?[0-9]+') and cast(regexp_extract(trim(breast_birads), '([0-9]+)$', 1) as int) >= 5 then 1 else 0 end as int) label_5, case split when 'testing' then 'test' else 'train' end split from ann""", needs_pred=False)
def label_derivation(spark, sf_dir):
    a = fixtures.annotations(spark, sf_dir).withColumn("grade", labels.birads(F.col("breast_birads")))
    return a.select("image_id", "grade", labels.label_at_least(F.col("grade"), 4).alias("label_45"), labels.label_at_least(F.col("grade"), 5).alias("label_5"), F.when(F.col("split") == "testing", "test").otherwise("train").alias("split"))


@query(ANN + "select count(*) n, sum(case when breast_birads is null then 1 else 0 end)::bigint n_unmatched, count(distinct study_id) n_studies from (select l_orderkey from lineitem) l left join ann on l_orderkey * 2 = image_id", needs_pred=False)
def join_labels_validated(spark, sf_dir):
    left = fixtures.tables(spark, sf_dir, "lineitem")["lineitem"].select((F.col("l_orderkey") * 2).alias("image_id"))
    joined = labels.many_to_one(left, fixtures.annotations(spark, sf_dir), "image_id")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("breast_birads").isNull()).alias("n_unmatched"), F.countDistinct("study_id").alias("n_studies"))


@query("select l_orderkey image_id, cast(l_linenumber - 1 as int) severity, arg_min(l_partkey, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) part, min(l_partkey) least from lineitem group by 1, 2", needs_pred=False)
def dedupe_keep_first(spark, sf_dir):
    rows = fixtures.tables(spark, sf_dir, "lineitem")["lineitem"].select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") - 1).cast("int").alias("severity"), F.col("l_partkey").alias("part"), "l_suppkey", "l_quantity", "l_extendedprice")
    first = labels.keep_first(rows, ["image_id", "severity"], [F.col(c) for c in ("part", "l_suppkey", "l_quantity", "l_extendedprice")])
    return first.select("image_id", "severity", "part", F.col("part").alias("least"))


@query("+done as (select * from pred where not (image_id % 7 = 0 and severity > 3)) select split, count(*) n from pred where image_id not in (select image_id from done group by 1 having count(*) >= 31) group by 1")
def resume_anti_join(spark, sf_dir):
    p = fixtures.pred(spark, sf_dir)
    return labels.unfinished(p, p.where("not (image_id % 7 = 0 and severity > 3)"), "image_id").groupBy("split").agg(F.count("*").alias("n"))


@query(ANN + "select coalesce(a.image_id, b.image_id) image_id, coalesce(nullif(trim(a.split), ''), nullif(trim(b.split), '')) split from (select image_id, case when image_id % 3 = 0 then ' ' else split end split from ann where image_id % 4 <> 0) a full join (select image_id, split from ann where image_id % 5 <> 0) b on a.image_id = b.image_id", needs_pred=False)
def annotation_full_outer(spark, sf_dir):
    ann = fixtures.annotations(spark, sf_dir)
    a = ann.where("image_id % 4 <> 0").withColumn("split", F.when(F.col("image_id") % 3 == 0, " ").otherwise(F.col("split")))
    return labels.outer_keys(a, ann.where("image_id % 5 <> 0"), "image_id", ["split"])


def lesion_lists(spark, sf_dir):
    """image_id and its boxes, in order of pos; repeated rows of an image and pos count once."""
    rows = fixtures.lesions(spark, sf_dir).where(boxes.valid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    first = labels.keep_first(rows.select("image_id", "pos", "x1", "y1", "x2", "y2", "laterality", "finding"), ["image_id", "pos"], [F.col(c) for c in ("x1", "y1", "x2", "y2", "laterality", "finding")])
    return first.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("b"), "laterality"))), lambda s: s["b"]).alias("boxes"), F.min("laterality").alias("laterality"))


@query(LES + "select image_id, count(*) n_boxes, cast(arg_max(x1, (area, -pos)) as int) x1, cast(arg_max(y1, (area, -pos)) as int) y1, cast(arg_max(x2, (area, -pos)) as int) x2, cast(arg_max(y2, (area, -pos)) as int) y2, max(area) area from ok where rn = 1 group by 1", needs_pred=False)
def primary_lesion_argmax(spark, sf_dir):
    p = lesion_lists(spark, sf_dir).withColumn("p", boxes.primary(F.col("boxes")))
    return p.select("image_id", F.size("boxes").cast("long").alias("n_boxes"), "p.x1", "p.y1", "p.x2", "p.y2", boxes.area(F.col("p")).alias("area"))


def _scaled_sql(scale: float) -> str:
    def at(v: str, sign: str, most: int) -> str:
        size = f"greatest(1, round_even(({v}2 - {v}1) * {scale}::double, 0))"
        return f"cast(greatest(0, least({most}, round_even(({v}1 + {v}2) / 2.0::double {sign} {size} / 2.0::double, 0))) as int)"

    return LES + f"select image_id, pos, {at('x', '-', 1024)} x1, {at('y', '-', 384)} y1, {at('x', '+', 1024)} x2, {at('y', '+', 384)} y2 from ok where rn = 1"


@query(_scaled_sql(1.5), needs_pred=False)
def bbox_scale_clip(spark, sf_dir):
    rows = labels.keep_first(fixtures.lesions(spark, sf_dir).where("x2 > x1 and y2 > y1").select("image_id", "pos", "x1", "y1", "x2", "y2", "laterality", "finding"), ["image_id", "pos"], [F.col(c) for c in ("x1", "y1", "x2", "y2", "laterality", "finding")])
    out = rows.select("image_id", "pos", boxes.scaled(boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), 1.5, F.lit(384), F.lit(1024)).alias("s"))
    return out.select("image_id", "pos", "s.x1", "s.y1", "s.x2", "s.y2")


@query(LES + """select image_id, count(*) n_inside, cast(sum((least(x2, 600) - greatest(x1, 5)) * (least(y2, 250) - greatest(y1, 50))) as bigint) area_inside from ok where rn = 1 and least(x2, 600) > greatest(x1, 5) and least(y2, 250) > greatest(y1, 50) group by 1""", needs_pred=False)
def bbox_shift_crop(spark, sf_dir):
    crop = boxes.box(F.lit(5), F.lit(50), F.lit(600), F.lit(250))
    b = lesion_lists(spark, sf_dir).withColumn("inside", boxes.shifted(F.col("boxes"), crop)).where(F.size("inside") > 0)
    return b.select("image_id", F.size("inside").cast("long").alias("n_inside"), F.aggregate("inside", F.lit(0).cast("long"), lambda acc, x: acc + boxes.area(x)).alias("area_inside"))


@query(LES + """, f as (select *, case when laterality = 'R' then 1000 - x2 else x1 end u1, case when laterality = 'R' then 1000 - x1 else x2 end u2 from ok where rn = 1),
g as (select image_id, pos, greatest(0, least(cast(round_even((u1 - 20) * 35e-2, 0) as int), 384)) x1, greatest(0, least(cast(round_even((y1 - 10) * 35e-2, 0) as int), 1024)) y1, greatest(0, least(cast(round_even((u2 - 20) * 35e-2, 0) as int), 384)) x2, greatest(0, least(cast(round_even((y2 - 10) * 35e-2, 0) as int), 1024)) y2 from f)
select image_id, pos, cast(x1 as int) x1, cast(y1 as int) y1, cast(x2 as int) x2, cast(y2 as int) y2 from g where (x2 - x1) * (y2 - y1) > 0""", needs_pred=False)
def canvas_transform(spark, sf_dir):
    rows = labels.keep_first(fixtures.lesions(spark, sf_dir).where("x2 > x1 and y2 > y1").select("image_id", "pos", "x1", "y1", "x2", "y2", "laterality", "finding"), ["image_id", "pos"], [F.col(c) for c in ("x1", "y1", "x2", "y2", "laterality", "finding")])
    out = rows.select("image_id", "pos", boxes.to_canvas(boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), F.col("laterality"), F.lit(1000), F.lit(20), F.lit(10), F.lit(0.35)).alias("b")).where("b is not null")
    return out.select("image_id", "pos", "b.x1", "b.y1", "b.x2", "b.y2")


@query("""with s as (select p_partkey, 2000 + p_size * 37 h, 1500 + p_size * 29 w from part), g as (select *, least(1024.0::double / h, 384.0::double / w) sc from s)
select p_partkey, round(sc, 6) scale, cast(round_even(h * sc, 0) as int) resized_h, cast(round_even(w * sc, 0) as int) resized_w, 1024 - cast(round_even(h * sc, 0) as int) pad_bottom, 384 - cast(round_even(w * sc, 0) as int) pad_right, round(0.07::double * greatest(h / 1024.0::double, w / 384.0::double), 6) pitch from g""", needs_pred=False)
def canvas_geometry(spark, sf_dir):
    h, w = 2000 + F.col("p_size") * 37, 1500 + F.col("p_size") * 29
    g = boxes.canvas_geometry(h, w)
    pitch = F.lit(0.07) * F.greatest(h / F.lit(1024.0), w / F.lit(384.0))
    return r6(fixtures.tables(spark, sf_dir, "part")["part"].select("p_partkey", *(e.alias(n) for n, e in g.items()), pitch.alias("pitch")), "scale", "pitch")


@query("""with p as (select 0.07::double * greatest((2000 + p_size * 37) / 1024.0::double, (1500 + p_size * 29) / 384.0::double) pitch from part)
select s.v severity, round(quantile_cont(pitch, 0.25) * px, 6) blur_q1, round(quantile_cont(pitch, 0.5) * px, 6) blur_median, round(quantile_cont(pitch, 0.75) * px, 6) blur_q3, round(min(pitch) * px, 6) blur_min, round(max(pitch) * px, 6) blur_max, round(quantile_cont(pitch, 0.5) / f, 6) resolution_median
from p, (values (1, 3, 0.9::double), (2, 5, 0.8::double), (3, 7, 0.7::double), (4, 11, 0.6::double), (5, 15, 0.5::double), (6, 21, 0.4::double)) s(v, px, f) group by s.v, px, f""", needs_pred=False)
def physical_anchors(spark, sf_dir):
    h, w = 2000 + F.col("p_size") * 37, 1500 + F.col("p_size") * 29
    q = fixtures.tables(spark, sf_dir, "part")["part"].select((F.lit(0.07) * F.greatest(h / F.lit(1024.0), w / F.lit(384.0))).alias("pitch")).agg(F.percentile("pitch", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
    levels = spark.createDataFrame([(1, 3.0, 0.9), (2, 5.0, 0.8), (3, 7.0, 0.7), (4, 11.0, 0.6), (5, 15.0, 0.5), (6, 21.0, 0.4)], "severity int, px double, f double")
    px = F.col("px")
    out = q.crossJoin(levels).select("severity", (F.col("q")[0] * px).alias("blur_q1"), (F.col("q")[1] * px).alias("blur_median"), (F.col("q")[2] * px).alias("blur_q3"), (F.col("lo") * px).alias("blur_min"), (F.col("hi") * px).alias("blur_max"), (F.col("q")[1] / F.col("f")).alias("resolution_median"))  # one row and six
    return r6(out, *out.columns[1:])


@query("select case when c_mktsegment like 'AUTO%' then 'Auto' when c_mktsegment like 'BUILD%' then 'Building' when c_mktsegment like 'MACH%' then 'Machinery' else 'Other' end manufacturer, count(*) n from customer group by 1", needs_pred=False)
def manufacturer_norm(spark, sf_dir):
    return fixtures.tables(spark, sf_dir, "customer")["customer"].groupBy(labels.manufacturer(F.col("c_mktsegment")).alias("manufacturer")).agg(F.count("*").alias("n"))


@query("""+b as (select min(logit) lo, max(logit) hi from test where degradation_type = 'clean'), c as (select label_45, least(cast(floor((logit - lo) / (hi - lo) * 44) as int), 43) + 1 bin from test, b where degradation_type = 'clean')
select cast(c.label_45 as int) label_45, cast(c.bin as int) bin, count(*) n, round(count(*) / (sum(count(*)) over (partition by c.label_45)), 6) share from c group by c.label_45, c.bin""")
def hist_logit(spark, sf_dir):
    df = test_rows(spark, sf_dir).where("degradation_type = 'clean'")
    ends = df.agg(F.min("logit").alias("lo"), F.max("logit").alias("hi"))
    binned = df.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.width_bucket("logit", "lo", "hi", F.lit(44)), F.lit(44)).cast("int"))  # one row
    n = binned.groupBy("label_45", "bin").agg(F.count("*").alias("n"))
    total = n.groupBy(F.col("label_45").alias("l")).agg(F.sum("n").alias("total"))
    return n.join(total, F.col("label_45") == F.col("l")).select(F.col("label_45").cast("int").alias("label_45"), "bin", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""+k as (select a.manufacturer, count(*) pairs, sum(case when a.logit > b.logit then 1.0 when a.logit = b.logit then 0.5 else 0 end) won from (select * from test where severity = 0 and label_45 = 1) a join (select * from test where severity = 0 and label_45 = 0) b using (manufacturer) group by 1),
n as (select manufacturer, count(*) n, sum(label_45) n_pos from test where severity = 0 group by 1)
select manufacturer, n, cast(n_pos as bigint) n_pos, round(won / pairs, 6) auc, n_pos < 30 few from n left join k using (manufacturer)""")
def stratified_auc(spark, sf_dir):
    a = rank.auc(test_rows(spark, sf_dir).where("severity = 0 and manufacturer is not null"), ["manufacturer"])
    return r6(a.withColumn("few", F.col("n_pos") < 30), "auc")


@query("""+m as (select density, image_id % 3 seed, degradation_type, severity, count(*) filter (label_45 = 1 and logit >= 0) / nullif(sum(label_45), 0) s from test group by all)
select density arch, degradation_type, cast(severity as int) severity, round(avg(s), 6) mean, round(stddev_samp(s), 6) sd, count(s) n from m group by 1, 2, 3""")
def arch_mean_sd(spark, sf_dir):
    s = rank.ratio(F.count_if((F.col("label_45") == 1) & (F.col("logit") >= 0)), F.sum("label_45"))
    m = test_rows(spark, sf_dir).withColumn("seed", F.col("image_id") % 3).groupBy("density", "seed", *C).agg(s.alias("s"))
    return r6(m.groupBy(F.col("density").alias("arch"), *C).agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.count("s").alias("n")), "mean", "sd")


@query(LOG + "select run, epoch, round(avg(val_auc) over (partition by run order by epoch rows between 4 preceding and current row), 6) val_auc_smoothed from log", needs_pred=False)
def rolling_val_auc(spark, sf_dir):
    return r6(trainlog.smoothed(fixtures.train_log(spark, sf_dir)).select("run", "epoch", "val_auc_smoothed"), "val_auc_smoothed")


@query(LOG + """, s as (select run, epoch, avg(val_auc) over (partition by run order by epoch rows between 4 preceding and current row) v from log), m as (select *, max(round(v, 12)) over (partition by run order by epoch) best from s),
g as (select *, count(*) filter (round(v, 12) >= best) over (partition by run order by epoch) grp from m), k as (select run, epoch, count(*) filter (round(v, 12) < best) over (partition by run, grp order by epoch) misses from g)
select run, min(case when misses >= 10 then epoch end) stop_epoch from k group by 1""", needs_pred=False)
def early_stop(spark, sf_dir):
    return trainlog.early_stop(r6(trainlog.smoothed(fixtures.train_log(spark, sf_dir)), "val_auc_smoothed", digits=12), 10)


@query(LOG + "select run, epoch, val_auc, place from (select *, cast(row_number() over (partition by run order by val_auc desc, epoch) as int) place from log) t where place <= 3", needs_pred=False)
def topk_checkpoints(spark, sf_dir):
    return trainlog.best_checkpoints(fixtures.train_log(spark, sf_dir))


@query(LOG + "select distinct epoch, round(case when epoch - 1 < 5 then 1e-4 * epoch / 5 else 1e-6 + (1e-4 - 1e-6) * 0.5 * (1 + cos(pi() * (epoch - 6) / 45.0)) end, 12) lr from log where epoch <= 50", needs_pred=False)
def learning_rates(spark, sf_dir):
    log = fixtures.train_log(spark, sf_dir).where("epoch <= 50").select("epoch").distinct()
    return log.select("epoch", F.round(trainlog.learning_rate(F.col("epoch") - 1, 1e-4, 50, 5), 12).alias("lr"))


@query("+k as (select label_45, count(*) n from test where severity = 0 group by 1) select cast(label_45 as int) label_45, n, round(case when label_45 = 1 then 0.3 else 0.7 end / n, 9) weight, round(0.7 / 0.3, 6) pos_weight from k")
def oversample_weights(spark, sf_dir):
    w = trainlog.sampling_weights(test_rows(spark, sf_dir).where("severity = 0"), 0.3)
    return w.select(F.col("label_45").cast("int").alias("label_45"), "n", F.round("weight", 9).alias("weight"), F.round("pos_weight", 6).alias("pos_weight"))


@query("select degradation_type, cast(severity as int) severity, " + ", ".join(f"round(avg({m}), 6) mean_{m}, round(quantile_cont({m}, 0.5), 6) median_{m}, round(var_pop({m}), 9) var_{m}" for m in IQMS) + ", round(quantile_cont(ssim, 0.75) - quantile_cont(ssim, 0.25), 4) iqr_ssim from test group by 1, 2")
def condition_means_medians(spark, sf_dir):
    aggs = [e for m in IQMS for e in (F.round(F.avg(m), 6).alias(f"mean_{m}"), F.round(F.median(m), 6).alias(f"median_{m}"), F.round(F.var_pop(m), 9).alias(f"var_{m}"))]
    return test_rows(spark, sf_dir).groupBy(*C).agg(*aggs, F.round(F.percentile("ssim", 0.75) - F.percentile("ssim", 0.25), 4).alias("iqr_ssim"))


@query("+c as (select image_id, prob from test where severity = 0), d as (select image_id, prob from test where degradation_type = 'contrast' and severity = 1) select count(*) n, round(corr(c.prob, d.prob), 6) r, round(avg(abs(c.prob - d.prob)), 6) mad, round(max(abs(c.prob - d.prob)), 6) worst from c join d using (image_id)")
def sanity_agreement(spark, sf_dir):
    df = test_rows(spark, sf_dir)
    c, d = df.where("severity = 0").select("image_id", F.col("prob").alias("p")), df.where("degradation_type = 'contrast' and severity = 1").select("image_id", F.col("prob").alias("q"))
    gap = F.abs(F.col("p") - F.col("q"))
    return r6(c.join(d, "image_id").agg(F.count("*").alias("n"), rank.pearson("p", "q").alias("r"), F.avg(gap).alias("mad"), F.max(gap).alias("worst")), "r", "mad", "worst")


@query("select cast(a.severity as int) s1, cast(b.severity as int) s2, count(*) n, round(avg(abs(a.prob - b.prob)), 6) mean_gap, round(max(abs(a.prob - b.prob)), 6) worst_gap, max(abs(a.prob - b.prob)) = 0 identical from test a join test b using (image_id) where a.degradation_type = 'blur' and b.degradation_type = 'blur' and a.severity < b.severity group by 1, 2")
def severity_distinctness(spark, sf_dir):
    p = test_rows(spark, sf_dir).where("degradation_type = 'blur'").groupBy("image_id").pivot("severity", list(range(1, 7))).agg(F.first("prob"))  # one shuffle serves all pairs
    pairs = p.select(F.explode(F.array(*(F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"), F.abs(F.col(str(a)) - F.col(str(b))).alias("gap")) for a in range(1, 7) for b in range(a + 1, 7)))).alias("p")).select("p.*").where("gap is not null")
    return r6(pairs.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("worst_gap"), F.bool_and(F.col("gap") == 0).alias("identical")), "mean_gap", "worst_gap")


@query("with i as (select o_orderkey, row_number() over (order by o_orderkey) - 1 idx from orders) select idx % 4 shard, count(*) n, min(o_orderkey) least, cast(sum(42 + idx * 1000 + 7) as bigint) seeds from i group by 1", needs_pred=False)
def shard_assignment(spark, sf_dir):
    from .plans import degradation

    i = labels.stable_index(fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_orderkey"), "o_orderkey")
    return i.groupBy(labels.shard(F.col("idx"), 4).alias("shard")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.sum(degradation.seed_of(42, F.col("idx"), 7)).alias("seeds"))


@query("select c_custkey, lower(c_name) name from customer where lower(c_name) in (select lower(trim(c_name)) from customer where c_custkey % 3 = 0) or lower(cast(c_custkey as varchar)) in (select cast(c_custkey as varchar) from customer where c_custkey % 5 = 0)", needs_pred=False)
def id_or_stem_match(spark, sf_dir):
    c = fixtures.tables(spark, sf_dir, "customer")["customer"].select("c_custkey", F.lower("c_name").alias("name"), F.col("c_custkey").cast("string").alias("stem"))
    wanted = c.where("c_custkey % 3 = 0").select(F.concat(F.lit(" "), F.upper("name")).alias("key")).unionByName(c.where("c_custkey % 5 = 0").select(F.col("stem").alias("key")))
    return labels.matched_ids(c, wanted, "name", "stem", "key").select("c_custkey", "name")


@query(ANN + """, old as (select image_id, study_id, split from ann where image_id % 3 <> 0), extra as (select image_id, study_id, split from ann where image_id % 2 = 0 and image_id not in (select image_id from old))
select split, count(*) n, count(distinct study_id) n_studies from (select * from old union all select * from extra) t group by 1""", needs_pred=False)
def complete_splits(spark, sf_dir):
    ann = fixtures.annotations(spark, sf_dir).select("image_id", "study_id", "split")
    old = ann.where("image_id % 3 <> 0")
    extra = ann.where("image_id % 2 = 0").join(old, "image_id", "left_anti")
    return old.unionByName(extra.select(old.columns)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("study_id").alias("n_studies"))


@query("+m as (select degradation_type, quantile_cont(cnr, 0.5) med, quantile_cont(cnr, 0.25) lo, quantile_cont(cnr, 0.75) hi from test where severity = 3 and cnr is not null group by 1), k as (select degradation_type, image_id, cnr, row_number() over (partition by degradation_type order by round(abs(cnr - med), 9), image_id) rn from test join m using (degradation_type) where severity = 3 and cnr between lo and hi) select degradation_type, image_id, cnr from k where rn = 1")
def example_chooser(spark, sf_dir):
    df = test_rows(spark, sf_dir).where("severity = 3 and cnr is not null")
    q = df.groupBy("degradation_type").agg(F.percentile("cnr", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    near = df.join(F.broadcast(q), "degradation_type").where(F.col("cnr").between(F.col("q")[0], F.col("q")[2]))  # a row per degradation
    return near.groupBy("degradation_type").agg(F.min_by(F.struct("image_id", "cnr"), F.struct(F.round(F.abs(F.col("cnr") - F.col("q")[1]), 9).alias("d"), "image_id")).alias("p")).select("degradation_type", "p.image_id", "p.cnr")


@query("with h as (select o_orderkey, o_orderstatus, o_custkey, ((o_orderkey * 7919 + 3 * 104729) % 1000003) / 1000003e0 u from orders), r as (select *, row_number() over (partition by o_orderstatus = 'F' order by u, o_orderkey) rn from h) select o_orderkey, o_orderstatus from r where (o_orderstatus = 'F' and rn <= 40) or (o_orderstatus <> 'F' and rn <= 25)", needs_pred=False)
def stratified_sample(spark, sf_dir):
    o = fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_orderstatus")
    return resample.stratified(o, F.col("o_orderstatus") == "F", {True: 40, False: 25}, "o_orderkey", 3)


@query("with h as (select o_orderkey, o_custkey, ((o_orderkey * 7919) % 1000003) / 1000003e0 u from orders) select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by u, o_orderkey) rn from h) t where rn = 1", needs_pred=False)
def one_per_study(spark, sf_dir):
    return resample.one_per_group(fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def _fits(spark, sf_dir):
    val = fixtures.pred(spark, sf_dir).where("split = 'val' and degradation_type = 'clean'").select("logit", "label_45").cache()
    try:
        return calibration.fit_temperature(val), calibration.fit_platt(val)
    finally:
        val.unpersist()


@query()
def platt_fit(spark, sf_dir):
    t, (a, b) = _fits(spark, sf_dir)
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


@query()
def temperature_fit(spark, sf_dir):
    return spark.createDataFrame([(round(_fits(spark, sf_dir)[0], 6),)], "temperature double")


@query()
def calibrated_condition_table(spark, sf_dir):
    t, p = _fits(spark, sf_dir)
    df = calibration.calibrated(test_rows(spark, sf_dir), t, p)
    out = rank.auc(df, C)
    for kind in ("raw", "temp", "platt"):
        out = out.join(calibration.ece(df, C, 15, f"prob_{kind}").select(*C, F.col("ece").alias(f"ece_{kind}")), C).join(df.groupBy(*C).agg(calibration.brier(f"prob_{kind}").alias(f"brier_{kind}")), C)
    return r6(out, "auc", *(f"{m}_{k}" for m in ("ece", "brier") for k in ("raw", "temp", "platt")))


@query()
def bootstrap_ci_image(spark, sf_dir):
    draws = resample.bootstrap_auc(test_rows(spark, sf_dir), C, 1000, 2026, ap=False)
    return r6(resample.interval(draws.where("not isnan(auc)"), C, "auc"), "low", "high")


@query()
def bootstrap_ci_study_paired(spark, sf_dir):
    draws = resample.bootstrap_auc(test_rows(spark, sf_dir), C, 2000, 42, cluster="study_id", ap=False).where("not isnan(auc)")
    clean = F.max(F.when(F.col("severity") == 0, F.col("auc"))).over(Window.partitionBy("draw"))  # a join would draw twice
    deltas = draws.withColumn("delta", F.col("auc") - clean).where("delta is not null")
    return r6(resample.interval(deltas, C, "delta"), "low", "high")


_POISSON = "case when u < 0.367879 then 0 when u < 0.735759 then 1 when u < 0.919699 then 2 when u < 0.981012 then 3 when u < 0.996340 then 4 when u < 0.999406 then 5 else 6 end"


@query(f"""+dr as (select b, study_id, {_POISSON} k from (select b, study_id, ((study_id * 7919 + b * 104729) % 10007) / 10007e0 u from (select distinct study_id from test) s, range(1, 21) r(b)) t),
x as (select b, degradation_type, severity, logit, label_45, k from test join dr using (study_id) where severity in (0, 6) and k > 0), t as (select b, degradation_type, severity, logit, sum(k * label_45) p, sum(k * (1 - label_45)) q from x group by 1, 2, 3, 4),
a as (select b, degradation_type, severity, sum(p * (cq - q * 0.5)) / nullif(sum(p) * sum(q), 0) auc from (select *, sum(q) over (partition by b, degradation_type, severity order by logit) cq from t) z group by 1, 2, 3)
select degradation_type, cast(severity as int) severity, round(quantile_cont(auc, 0.025), 5) low, round(quantile_cont(auc, 0.975), 5) high, count(auc) draws from a group by 1, 2""")
def weighted_bootstrap_auc(spark, sf_dir):
    df = test_rows(spark, sf_dir).where("severity in (0, 6)")
    k = resample.fixed_weights(F.col("b"), F.col("study_id"))
    x = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("k", k).where("k > 0")
    return r6(resample.interval(rank.auc(x, ["b", *C], weight="k"), C, "auc"), "low", "high", digits=5)


@query()
def mean_iqm_ci(spark, sf_dir):
    return r6(resample.bootstrap_mean(test_rows(spark, sf_dir), C, "ssim", 600), "mean", "low", "high")


@query("+sh as (select t.degradation_type, t.severity, corr(t.ssim, abs(t.logit - c.logit)) r, count(*) n from test t join (select image_id, logit from test where severity = 0) c using (image_id) where t.severity = 6 group by 1, 2) select degradation_type, n, round(r, 6) r from sh")
def shift_pearson(spark, sf_dir):
    return r6(paired(test_rows(spark, sf_dir)).where("severity = 6").groupBy("degradation_type").agg(F.count("*").alias("n"), rank.pearson("ssim", "abs_shift").alias("r")), "r")


__all__ = ["ORACLES", "QUERIES"]
