"""Deterministic stand-ins for the study's tables, derived from the TPC-H-like tables.

Each text runs unchanged in Spark SQL and in DuckDB, so queries and their checks read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLAN = """
select 'clean' degradation_type, 0 severity, 0 ti, 0e0 w, 1e0 par
union all
select a.dt, b.sev, a.ti, a.w,
       case a.dt when 'noise' then b.noise when 'blur' then b.blur when 'contrast' then b.alpha when 'jpeg2000' then b.cr else b.res end
from (values ('noise',1,6e-1),('blur',2,5e-1),('contrast',3,2e-2),('jpeg2000',4,9e-1),('resolution',5,4e-1)) a(dt,ti,w)
cross join (values (1,95e-2,3e0,95e-2,10e0,9e-1),(2,85e-2,5e0,9e-1,25e0,8e-1),(3,75e-2,7e0,85e-2,50e0,7e-1),
                   (4,65e-2,11e0,8e-1,100e0,6e-1),(5,5e-1,15e0,75e-2,250e0,5e-1),(6,35e-2,21e0,7e-1,500e0,4e-1)) b(sev,noise,blur,alpha,cr,res)"""

IMG = """
  select o_orderkey image_id, o_custkey study_id, o_orderstatus density, c_mktsegment manufacturer,
         case when o_orderkey % 5 = 0 then 'val' else 'test' end split,
         case when o_orderpriority = '1-URGENT' then (case when o_orderkey % 2 = 0 then 5 else 4 end)
              when o_orderpriority = '2-HIGH' then 3 else 1 end breast_birads,
         ((o_orderkey * 7919) % 10007) / 10007e0 h1, ((o_orderkey * 104729) % 9973) / 9973e0 h3
  from orders join customer on o_custkey = c_custkey"""

PRED = f"""
with plan as ({PLAN}),
img as ({IMG}),
b as (
  select i.*, p.*, case when breast_birads >= 4 then 1 else 0 end label_45, case when breast_birads >= 5 then 1 else 0 end label_5,
         ((image_id * 31 + ti * 1009 + severity * 131) % 997) / 997e0 h2,
         case when degradation_type = 'contrast' then par else 1e0 end alpha,
         case when degradation_type = 'noise' then par else 1e0 end fd,
         (breast_birads >= 4 and image_id % 3 <> 0) or image_id % 29 = 0 annotated
  from img i cross join plan p),
c as (
  select *, round(14e-1 * label_45 * (1e0 - 12e-2 * w * severity) - 7e-1 + 3e0 * (h1 - 5e-1)
               + 25e-2 * w * severity + 4e-1 * w * severity * (h2 - 5e-1), 6) logit,
         case when annotated then (5e-2 + 1e-1 * h3) * alpha
              + (case when degradation_type = 'contrast' and image_id % 13 = 0 then 3e-3 * severity else 0e0 end) end delta_mu0
  from b)
select image_id, study_id, split, label_45, label_5, density, manufacturer, degradation_type, severity,
       logit, round(1e0 / (1e0 + exp(-logit)), 6) prob,
       round(delta_mu0 / ((4e-2 + 3e-2 * h1) * alpha / sqrt(fd)), 6) cnr, round(delta_mu0, 6) delta_mu,
       round((1e-4 + 4e-4 * h3) * alpha * alpha / fd, 9) noise_var,
       round((2e-2 + 3e-2 * h1) * alpha * alpha * (1e0 + (case degradation_type when 'noise' then 15e-2 when 'contrast' then 0e0 else -8e-2 end) * severity), 9) tenengrad,
       round(1e0 - 5e-2 * w * severity * (6e-1 + 8e-1 * h3), 6) ssim,
       round((2e-3 + 3e-3 * h3) * alpha / sqrt(fd), 6) tau,
       round((2e-1 + 2e-1 * h1) * alpha, 6) contrast_iqr
from c"""

LESIONS = """
select l_orderkey image_id, l_linenumber pos, l_suppkey % 900 x1, l_partkey % 300 y1,
       case when l_linenumber <> 7 then l_suppkey % 900 + cast(l_quantity as int) end x2,
       l_partkey % 300 + 7 * (l_linenumber - 1) y2, case when l_returnflag = 'R' then 'R' else 'L' end laterality, l_linestatus finding
from lineitem"""

TRAIN_LOG = """
select event_type run, cast(row_number() over (partition by event_type order by ts, event_id) as int) epoch,
       round(5e-1 + 5e-1 * (cast(floor(value * 1000) as bigint) % 997) / 997e0, 6) val_auc
from events"""

ANNOTATIONS = """
select o_orderkey image_id, o_custkey study_id,
       case when o_orderkey % 97 = 0 then 'unknown' when o_orderkey % 89 = 0 then '' else concat(' BI-RADS ', cast(o_orderkey % 6 as varchar(2))) end breast_birads,
       case when o_orderkey % 10 < 6 then 'training' else 'testing' end split, o_orderstatus density
from orders"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def from_sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """text over the named tables, bound as data frames: no view outlives the call."""
    import re

    bound = tables(spark, sf_dir, *names)
    for n in names:
        text = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **bound)


def pred(spark: SparkSession, sf_dir: str, by_image: bool = False) -> DataFrame:
    """The predictions. by_image shuffles the images before they are expanded, so that joins by image need not shuffle 31 rows of each.

    Such tasks are few and long: what they count of distinct values is combined before it is shuffled.
    """
    if not by_image:
        return from_sql(spark, sf_dir, PRED, "orders", "customer")
    images = from_sql(spark, sf_dir, IMG, "orders", "customer")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    return spark.sql(PRED.replace(IMG, "select * from {images}"), images=images.repartition(n, "image_id"))


def lesions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, LESIONS, "lineitem")


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, TRAIN_LOG, "events")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, ANNOTATIONS, "orders")
