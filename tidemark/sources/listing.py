"""Listings that cut off long answers: windows of days split in two until every answer is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder, written


def bisected(windows: DataFrame, rows: DataFrame, key: str, day: str, limit: int) -> DataFrame:
    """(key, first, last, records, status) of every window asked for: complete, truncated (then its halves were asked as well), or overfull, a single day beyond the limit.

    A frontier of windows: all are asked at once, the truncated ones halved, and their halves asked in the next round, each round written. There are
    as many rounds as the logarithm of the longest window in days. Only complete windows say how many records there are.
    """
    folder, turn, done = shared_folder(rows.sparkSession), 0, None
    daily = written(rows.groupBy(key, F.col(day).alias(day)).agg(F.count("*").alias("n")), f"{folder}/daily")
    ask = windows.select(key, "first", "last")
    while True:
        days = ask.select("*", F.explode(F.sequence("first", "last")).alias(day)).join(daily, [key, day], "left")
        found = days.groupBy(key, "first", "last").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
        status = F.when(F.col("records") <= limit, "complete").when(F.col("first") < F.col("last"), "truncated").otherwise("overfull")
        found = written(found.withColumn("status", status), f"{folder}/round{turn}")
        done = found if done is None else done.unionByName(found)
        cut = found.filter("status = 'truncated'")
        if cut.isEmpty():
            return done
        middle = F.date_add("first", F.floor(F.datediff("last", "first") / 2).cast("int"))
        halves = F.array(F.struct(F.col("first").alias("first"), middle.alias("last")), F.struct(F.date_add(middle, 1).alias("first"), F.col("last").alias("last")))
        ask, turn = cut.select(key, F.explode(halves).alias("h")).select(key, "h.first", "h.last"), turn + 1


def expected_total(found: DataFrame, key: str) -> DataFrame:
    """(key, expected, overfull): what the complete windows of a key add up to, null if there are none, and how many of its days were overfull."""
    return found.groupBy(key).agg(F.sum(F.when(F.col("status") == "complete", F.col("records"))).alias("expected"), F.count_if(F.col("status") == "overfull").alias("overfull"))
