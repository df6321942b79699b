"""What the training-data operators share: the shared folder, written tables, and files written from tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary folder is set for it on a local master (tests, a laptop); a cluster's executors wouldn't share it, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(url: str):
    """The pyarrow file system of a folder that executors share, and the path in it."""
    from pyarrow import fs

    parts = urlparse(url)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(url)


def task_file(folder: str, suffix: str) -> tuple[int, str]:
    """Partition number, and a name that no other attempt of the task writes. What counts is the name in the manifest."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId(), f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() does for ASCII strings, and is several times faster than translate()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3. Fold 1 is held out. Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def sample_share(doc_id: str, share: Column) -> Column:
    """True for about that share of the ids, the same ones on every run."""
    return F.pmod(F.xxhash64(F.lit(7), doc_id), F.lit(1 << 30)) < share * (1 << 30)


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts of at most `size` characters, cut at the last space of each where it has one."""
    while len(text) > size:
        at = max(text.rfind(" ", 0, size), text.rfind("\n", 0, size)) + 1
        yield text[: at or size]
        text = text[at or size :]
    yield text
