"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordex.llm._common import drop_path, fresh_path


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of edges (a, b).

    Each round takes the smallest label among neighbours, then jumps to that label's own label, so labels reach far
    nodes in a logarithmic number of rounds. Labels are a table in the shared folder after each round.
    """
    spark = edges.sparkSession

    def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        found = spark.read.schema("node long, label long" if name == "labels" else "a long, b long").parquet(path)
        found._arbordex_path = path
        return found, path

    both, edges_path = save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        stepped = lower.join(jump, "label").select("node", F.least("label", "far").alias("label"))
        new, new_path = save(stepped, "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        drop_path(spark, path)
        labels, path = new, new_path
        if not moved:
            drop_path(spark, edges_path)
            return labels
