"""Queries through sources, sinks and streams: what comes back must equal what a batch query gives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .plans import fixtures
from .queries import query, r6
from .sources import sinks, tables
from .streaming import ingest


def _folder(spark) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or a temporary one on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="gradus-")


@query("select degradation_type, count(*) n, count(cnr) n_cnr, round(avg(tau), 6) tau, cast(sum(severity) as bigint) severities from test group by 1")
def stream_restart_equals_batch(spark, sf_dir):
    """Files in two halves, the stream stopped in between and started anew: the rows are those of a batch."""
    root = _folder(spark)
    rows = fixtures.pred(spark, sf_dir).where("split = 'test'").select("image_id", "degradation_type", "severity", "cnr", "tau")
    for half in (0, 1):
        rows.where(F.col("image_id") % 2 == half).write.mode("append").parquet(f"{root}/in")
        ingest.ingest(spark, f"{root}/in", rows.schema, f"{root}/out", f"{root}/checkpoint")
    got = ingest.ingested(spark, f"{root}/out")
    return r6(got.groupBy("degradation_type").agg(F.count("*").alias("n"), F.count("cnr").alias("n_cnr"), F.avg("tau").alias("tau"), F.sum("severity").alias("severities")), "tau")


@query("+c as (select count(*) n from (select image_id from pred group by 1 having count(*) = 31) t) select n n_complete, (select count(distinct image_id) from pred) n_images from c")
def complete_images(spark, sf_dir):
    p = fixtures.pred(spark, sf_dir)
    return ingest.complete(p).agg(F.count("*").alias("n_complete")).crossJoin(p.agg(F.countDistinct("image_id").alias("n_images")))  # one row each


@query("select c_custkey image_id, trim(c_name) name, c_acctbal bal from customer", needs_pred=False)
def csv_round_trip(spark, sf_dir):
    """Through CSV and back, under other column names."""
    folder = _folder(spark) + "/csv"
    c = fixtures.tables(spark, sf_dir, "customer")["customer"]
    sinks.write_csv(c.select(F.col("c_custkey").alias("Image ID"), F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("NAME"), F.col("c_acctbal").alias("Balance")), folder)
    back = tables.resolved(tables.read_csv(spark, folder), {"image_id": ["image", "image_id"], "name": [], "bal": ["balance"]}, ["image_id"])
    return back.select(F.col("image_id").cast("long").alias("image_id"), "name", F.col("bal").cast("double").alias("bal"))


@query("select o_custkey, dense_rank() over (order by m) - 1 ordinal from (select o_custkey, min(o_orderkey) m from orders group by 1) t", needs_pred=False)
def first_seen_ordinal(spark, sf_dir):
    return tables.first_seen(fixtures.tables(spark, sf_dir, "orders")["orders"], "o_custkey", "o_orderkey")


@query("""select degradation_type, cast(severity as int) severity, printf('%.4f', 1e4 * avg(ssim)) ssim, count(*) n from test group by 1, 2""")
def condition_text(spark, sf_dir):
    """The condition table as it is printed: fixed digits, no separators of thousands."""
    m = fixtures.pred(spark, sf_dir).where("split = 'test'").groupBy("degradation_type", "severity").agg((F.lit(1e4) * F.avg("ssim")).alias("ssim"), F.count("*").alias("n"))
    return sinks.condition_table(m)


@query("select n_regionkey, n_nationkey, n_name, null::varchar r_name from nation union all select r_regionkey, null, null, r_name from region", needs_pred=False)
def union_schemas(spark, sf_dir):
    t = fixtures.tables(spark, sf_dir, "nation", "region")
    out = sinks.union_by_name([t["nation"].select("n_nationkey", "n_name", "n_regionkey"), t["region"].select(F.col("r_regionkey").alias("n_regionkey"), "r_name")])
    return out.select("n_regionkey", "n_nationkey", "n_name", "r_name")
