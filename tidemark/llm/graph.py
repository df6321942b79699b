"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the smallest node reachable.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones; the number of
    rounds grows with the logarithm of the longest path. Rows with a null end and loops are ignored; repeated edges
    count once; no edges give no rows. Nothing is collected but a count and a checksum per round.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    e = written(e, "edges", folder)
    before, turn = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, f"large{turn}", folder)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = written(small.filter("u <> v").distinct(), f"small{turn}", folder)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, turn = now, turn + 1
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
