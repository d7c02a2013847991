"""Connected components of an edge table, by contraction.

Each round maps every node to the least of itself and its neighbours and replaces edges by those between the images,
so edges vanish in a few rounds; the least node of a component always stays and names it. Rounds are written to the
shared folder, so lineage stays short and lost executors cost one round at most. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import discard, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another node; null ends and loops are ignored."""
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now, path = staged(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels, labels_path = None, None
    while not now.isEmpty():
        least, least_path = staged(now.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        if labels is None:
            done = []
            labels, labels_path = least.select(F.col("u").alias("node"), F.col("m").alias("component")), least_path
        else:
            moved = labels.join(least, labels.component == least.u, "left").select("node", F.coalesce("m", "component").alias("component"))
            done = [labels_path, least_path]
            labels, labels_path = staged(moved, "labels")
        to = least.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        moved = now.join(least, "u").join(to, "v").select(F.col("m").alias("u"), F.col("mv").alias("v")).where("u <> v").distinct()
        done.append(path)
        now, path = staged(moved, "edges")
        discard(spark, *done)
    if labels is None:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
