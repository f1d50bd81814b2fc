"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id in ``links(a, b)``: the smallest id it is connected with.

    Labels move along links and then jump to the label of their label, so that long chains take
    a logarithmic number of rounds in practice. Each round is written, which cuts the lineage.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .filter("a != b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_m"))
                         .select("id", F.least("id", "_m").alias("root"), F.lit(True).alias("moved")), "labels")
    while labels.filter("moved").take(1):
        near = (both.join(labels.select(F.col("id").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("root").alias("_m")))
        step = labels.select("id", "root").join(near, "id").select(
            "id", "root", F.least("root", "_m").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("_up"))
        labels = materialize(step.join(jump, "next", "left").select(
            "id", F.least("next", "_up").alias("_r"), F.col("root").alias("_old")).select(
            "id", F.col("_r").alias("root"), (F.col("_r") != F.col("_old")).alias("moved")), "labels")
    return labels.select("id", "root")
