"""Connected groups of linked nodes, with DataFrame operations only; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, released, small


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node that links reach) of links a, b: of any number, order and repetition.

    Each round takes the least label among neighbours, then follows labels of labels, so that long
    chains halve. Sums over neighbours are combined before they are shuffled, so a node may have any
    number of them. Rounds end when no label changes. Every round is a written table.
    """
    links = links.where("a <> b").select("a", "b")
    both = kept(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("changed")), "labels")
    while not labels.where("changed").isEmpty():
        near = both.join(small(labels).select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        stepped = kept(labels.select("node", F.col("comp").alias("was")).join(near, "node").select("node", "was", F.least("was", "c").alias("comp")), "labels")
        far = small(stepped).select(F.col("node").alias("comp"), F.col("comp").alias("c2"))
        before, labels = labels, kept(stepped.join(far, "comp").select("node", F.least("comp", "c2").alias("comp"), (F.least("comp", "c2") < F.col("was")).alias("changed")), "labels")
        released(before, stepped)
    out = kept(labels.select("node", "comp"), "components")
    released(both, labels)
    return out
