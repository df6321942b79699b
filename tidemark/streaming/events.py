"""Structured Streaming over the events table: windows with watermarks, sessions and deduplication.

Each query runs to the end of what is there (availableNow), into Parquet in the shared folder, and returns what was
written: a batch answer that a running stream would give as well. Only windows that the watermark has closed appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

DELAY = "2 hours"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The table as a stream of files, with its time as TIMESTAMP and a watermark on it."""
    batch = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    r = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 8)
    alone = any(f.endswith(f"/{name}") for f in batch.inputFiles()[:1])  # a stream reads folders: of one file, its folder by name
    s = r.option("pathGlobFilter", name).parquet(folder) if alone else r.parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def run_to_end(stream: DataFrame, provider: str | None = None) -> DataFrame:
    """What the stream has written once it has read all there is. A provider of the state store is set for this query alone."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    before = spark.conf.get(PROVIDER)
    if provider:
        spark.conf.set(PROVIDER, provider)
    try:
        return to_end(stream, spark, folder)
    finally:
        spark.conf.set(PROVIDER, before)


def to_end(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed(stream: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first of equal events within the watermark. State is dropped as the watermark passes."""
    return stream.dropDuplicatesWithinWatermark(keys)
