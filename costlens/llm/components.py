"""Connected components of links by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from each id of the links (a, b).

    A round takes the smallest label around each id (summed up before the
    shuffle, so a hub is no hot task) and then the label's label. Each round is
    written, so lost executors repeat one round at most."""
    both = links.select(F.col("a").alias("s"), F.col("b").alias("d")).union(links.select("b", "a"))
    edges = materialize(both.distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("s").alias("id")).agg(F.min("d").alias("m"))
                         .select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("id", "d"), "d").groupBy("s").agg(F.min("comp").alias("m")))
        step = (labels.join(near, labels["id"] == near["s"], "left")
                .select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("c")))
        jump = labels.select(F.col("id").alias("c"), F.col("comp").alias("cc"))
        new = materialize(step.join(jump, "c", "left").select("id", "old", F.least("c", "cc").alias("comp")), "labels")
        changed = new.where("old != comp").limit(1).count()
        labels = new.select("id", "comp")
        if not changed:
            return labels
