"""CSV seeds and JSON-lines manifests, by Spark's readers and writers: all strings, validated as a whole before use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.writes import problems
from .shared import shared_folder


def read_csv(spark, path: str, columns: list[str]) -> DataFrame:
    """A seed as strings. Columns are given, not inferred: a file with others fails instead of shifting."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(f"{c} string" for c in columns)).csv(path)


def csv_round_trip(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/seed"
    df.write.option("header", True).csv(path)
    return read_csv(df.sparkSession, path, df.columns)


def validated(seed: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(id, problems): every broken rule of every row; a caller that finds any refuses the whole file."""
    return seed.select(F.col("id").cast("int").alias("id"), F.concat_ws(",", problems(rules)).alias("problems"))


def json_round_trip(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/manifest"
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def verified(rows: DataFrame, manifest: DataFrame, key: str, body: str) -> DataFrame:
    """(key, sha256, intact): contents against the digests that a manifest states."""
    d = rows.select(key, F.sha2(body, 256).alias("sha256")).join(manifest, key)
    return d.select(key, "sha256", (F.col("sha256") == F.col("stated")).alias("intact"))
