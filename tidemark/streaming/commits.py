"""Loads that count only once they have succeeded: batches written under their number, a commit per batch, and cursors read from commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch_id long, rows long, high string"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, rows, high): the batches that have succeeded; of one committed twice, one."""
    return spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{folder}/commits").dropDuplicates(["batch_id"])


def prepared(spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([], COMMIT).write.mode("append").parquet(f"{folder}/commits/none")


def load(stream: DataFrame, folder: str, high: str, work: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Runs a stream to its end into folder: each micro-batch is written under its number, replacing what a failed try left, and committed after that.

    `work` transforms a batch and may fail: then nothing is committed, the query stops with its error, and the next load() takes up with the very batch
    that failed, from the same offsets. The watermark (the largest `high` of the commits) so never passes data that isn't there.
    """
    spark = stream.sparkSession
    prepared(spark, folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/data/batch={batch_id}"
        out = work(batch, batch_id) if work else batch
        out.write.mode("overwrite").parquet(path)
        done = spark.read.schema(out.schema).parquet(path)
        done.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count("*").alias("rows"), F.max(high).cast("string").alias("high")).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch_id}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of committed batches, with their batch."""
    d = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").withColumn("batch", F.col("batch").cast("long"))
    return d.join(commits(spark, folder).select(F.col("batch_id").alias("batch")), "batch", "left_semi")


def watermark(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One row (batches, rows, high): how far committed loads reach, high as `kind`; a null high before the first."""
    return commits(spark, folder).agg(F.count("*").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max(F.col("high").cast(kind)).alias("high"))


def tick(table: DataFrame, key: str, cursor: int | None, limit: int = 50) -> tuple[DataFrame, int | None]:
    """(the next rows, the cursor after them): at most `limit` rows whose key is beyond the cursor, in its order. No rows leave the cursor where it is.

    The condition reaches the scan, and each task keeps `limit` rows before they meet; keys should not repeat.
    """
    ahead = table if cursor is None else table.filter(F.col(key) > cursor)
    rows = ahead.orderBy(key).limit(limit)
    last = rows.agg(F.max(key)).first()[0]
    return rows, cursor if last is None else last


def drain(table: DataFrame, key: str, folder: str, limit: int, handle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows handled in ticks of `limit`, each written and committed with its cursor before the next; taken up again after the last commit."""
    spark = table.sparkSession
    prepared(spark, folder)
    last = commits(spark, folder).agg(F.max("batch_id"), F.max(F.col("high").cast("long"))).first()
    number, cursor = (-1 if last[0] is None else last[0]), last[1]
    while True:
        rows, after = tick(table, key, cursor, limit)
        if after == cursor:
            return loaded(spark, folder)
        number += 1
        handle(rows).write.mode("overwrite").parquet(f"{folder}/data/batch={number}")
        spark.createDataFrame([(number, rows.count(), str(after))], COMMIT).write.mode("overwrite").parquet(f"{folder}/commits/batch={number}")
        cursor = after
