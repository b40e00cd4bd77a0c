"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vapora.llm import common


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node that its links (a, b) reach.

    Every round takes the smallest label of the neighbours and then the label's own label; the rounds needed grow with the
    logarithm of a component's diameter. Each round is written, so lineage stays one round long, and deleted after the next.
    """
    edges = common.materialize(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = common.materialize(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before")), "labels")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        now = common.materialize(hooked.join(jump, "label", "left").select("node", F.least("label", "above").alias("label"), "before"), "labels")
        ended = now.where("label <> before").isEmpty()
        common.discard(labels)
        common.discard(hooked)
        if ended:
            common.discard(edges)
            return now.select("node", "label")
        labels = now
