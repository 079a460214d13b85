"""Connected components of a graph of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id that occurs in `links` (a, b); component is the smallest id reachable.

    Each round gives an id the smallest label among its neighbours, then the label of its label, so that long chains
    shorten by half or more. Minima are summed up before they are shuffled, and the joins are plain equi-joins whose
    large keys Spark can split. Labels are written to the shared folder after each round; only the number of changed
    labels reaches the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label")), "labels")  # the first round's minima
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = written(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("before")), "labels")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = written(step.join(jump, "label").select("id", F.col("further").alias("label"), (F.col("further") != F.col("before")).alias("changed")), "labels")
        labels = after.select("id", "label")
        if after.where("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")
