"""A content-addressed store: bytes under their digest, written once, counted by a manifest, read back and checked."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


def filesystem(url: str):
    """The pyarrow file system of a folder that executors share, and the path in it."""
    from pyarrow import fs

    parts = urlparse(url)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(url)


def put(blobs: DataFrame, root: str, name: str, data: str = "data") -> DataFrame:
    """(digest, size), a row per distinct blob of this put: its manifest, written as a table of that name beside the blobs. Null blobs are not stored.

    A task writes a blob under a name of its own attempt and then moves it to its digest's place, so readers see whole blobs only; a
    place that is taken holds the same bytes and is left alone. Equal blobs, repeated puts and repeated tasks so store one file; the bytes are never shuffled.
    """
    src = blobs.select(F.col(data).cast("binary").alias("data")).filter("data is not null").select(F.sha2("data", 256).alias("digest"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, path = filesystem(root)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            sizes = []
            for digest, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = blob.as_py()
                sizes.append(len(raw))
                folder = f"{path}/blobs/{digest[:2]}"
                if fs.get_file_info(f"{folder}/{digest}").type == pafs.FileType.NotFound:
                    fs.create_dir(folder, recursive=True)
                    with fs.open_output_stream(f"{folder}/_{digest}.{attempt}") as f:
                        f.write(raw)
                    fs.move(f"{folder}/_{digest}.{attempt}", f"{folder}/{digest}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["digest", "size"])

    return written(src.mapInArrow(run, "digest string, size long").distinct(), f"{root}/manifests/{name}")


#: The digest of no bytes, whose file a scan of files passes over.
EMPTY = hashlib.sha256(b"").hexdigest()


def get(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """(digest, data, intact) of the blobs that the manifests name, or of those of wanted(digest); a digest that isn't stored comes back with null data. intact says whether the bytes still have their digest."""
    if wanted is None:
        wanted = spark.read.schema("digest string, size long").option("recursiveFileLookup", True).parquet(f"{root}/manifests")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/blobs")
    d = files.select(F.element_at(F.split("path", "/"), -1).alias("digest"), F.col("content").alias("data")).filter(~F.col("digest").startswith("_"))
    d = wanted.select("digest").distinct().join(d, "digest", "left")
    data = F.when(F.col("digest") == EMPTY, F.lit(b"")).otherwise(F.col("data"))
    return d.select("digest", data.alias("data"), (F.sha2(data, 256) == F.col("digest")).alias("intact"))
