"""Connected components by alternating large-star and small-star contraction.

Edges stay in tables: no link, component or label reaches the driver, and
each round is written to the shared folder, which cuts the lineage. Minima are
aggregated before the shuffle and joined back, so a node that a third of all
edges meet is summed in parts, and its edges are split by adaptive joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import release, workspace


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges (a, b).

    Loops, repeated edges and edges with a null end are passed over; nodes
    without an edge to another node have no row."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = workspace(spark, "edges")
        df.distinct().write.parquet(path)
        own = spark.read.parquet(path)
        return path, own, own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    a, b = edges.columns[:2]
    path, e, mark = kept(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path, mark
        path, e, mark = kept(small.unionByName(low.toDF("u", "v")))
        release(spark, old[0])
        if mark == old[1]:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
