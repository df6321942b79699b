"""A folder that driver and executors share, for checkpoints and stream output."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one on a local master (tests, a laptop), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table: cuts the lineage, and survives the loss of executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers where the session's own path doesn't: once per application, as a zip."""
    root = Path(__file__).resolve().parents[2]
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(root) in known or Path.cwd() == root or spark.conf.get("tidemark.shipped", None) == spark.sparkContext.applicationId:
        return
    name = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "tidemark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
    spark.conf.set("tidemark.shipped", spark.sparkContext.applicationId)
