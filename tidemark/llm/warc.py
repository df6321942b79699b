"""WARC archives as zstandard frames: the dictionary in a leading skippable frame, then one frame per record."""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, sample_share, shared_folder, task_file

# The skippable frame that holds a dictionary, the frame magic, line ends and version of the format.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
END = b"\r\n"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
SMALLEST_REVISIT = 1000
CHUNK = 1 << 20
SAMPLE_PAYLOAD = 1 << 17
NAMES = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def record_bytes(page_id: int | None, url: str | None, kind: str, size: int, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    block = payload if kind == "response" else b""
    head = [VERSION, b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>".encode(), b"WARC-Date: " + DATE.encode(), b"WARC-Payload-Digest: sha1:" + digest.encode(), f"X-Payload-Length: {size}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " ").encode())
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    head.append(f"Content-Length: {len(block)}".encode())
    return END.join(head) + END + END + block + END + END


def parse_record(raw: bytes) -> dict:
    """The record, or ValueError where version, headers, lengths or the digest of a response are wrong."""
    head, sep, rest = raw.partition(END + END)
    lines = head.split(END)
    if not sep or lines[0] != VERSION:
        raise ValueError("no WARC/1.1 record")
    h = {}
    for x in lines[1:]:
        name, sep, value = x.partition(b": ")
        if not sep or name.lower() in h:
            raise ValueError(f"header {name[:40]!r} is malformed or repeated")
        h[name.lower()] = value.decode()
    missing = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length", b"warc-payload-digest", b"x-payload-length"} - set(h)
    if missing:
        raise ValueError(f"headers missing: {sorted(missing)}")
    n, size, kind = int(h[b"content-length"]), int(h[b"x-payload-length"]), h[b"warc-type"]
    if len(rest) != n + 4 or rest[n:] != END + END:
        raise ValueError("Content-Length differs from the block")
    if kind not in ("response", "revisit") or (kind == "revisit") != (b"warc-refers-to" in h):
        raise ValueError("WARC-Type and WARC-Refers-To don't agree")
    digest = h[b"warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (n != size or hashlib.sha1(rest[:n]).hexdigest() != digest):
        raise ValueError("payload differs from its length or digest")
    number = lambda x: None if x == "<urn:page:none>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    return {"page_id": number(h[b"warc-record-id"]), "url": h.get(b"warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number(h[b"warc-refers-to"]) if kind == "revisit" else None, "payload": rest[:n] if kind == "response" else None}


def train(payloads: DataFrame, size: int, sample_rows: int = 800, sample_bytes: int = 8_000_000) -> bytes:
    """A dictionary from a bounded sample of payloads (about sample_rows by a hash of the id, SAMPLE_PAYLOAD bytes of each at most, as training looks at no more of one); without enough of them a plain empty-like one."""
    n = payloads.count()
    got, total = [], 0
    for r in payloads.filter(sample_share("page_id", F.lit(min(1.0, sample_rows / max(n, 1))))).select(F.substring("payload", 1, SAMPLE_PAYLOAD).alias("payload")).toLocalIterator():
        if r["payload"]:
            got.append(bytes(r["payload"]))
            total += len(got[-1])
        if total > sample_bytes:
            break
    try:
        return zstandard.train_dictionary(size, got, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"


def frames(stream) -> Iterator[bytes]:
    """The content of each frame of an archive in turn; the leading skippable frame gives the dictionary (which may itself be a frame)."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    content = stream.read(size)
    if len(content) != size:
        raise ValueError("the dictionary frame is cut off")
    if content[:4] == FRAME_MAGIC:
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 27)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    left = b""
    while left or (left := stream.read(CHUNK)):
        one, out = tool.decompressobj(), io.BytesIO()
        if len(left) < 4:
            left += stream.read(CHUNK)
        if left[:4] != FRAME_MAGIC:
            raise ValueError("a record doesn't begin with a zstandard frame")
        while True:
            out.write(one.decompress(left))
            if one.eof:
                left = one.unused_data
                break
            if not (left := stream.read(CHUNK)):
                raise ValueError("the last frame is cut off")
        yield out.getvalue()


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every page.

    Groups are of equal digest and length, counted before anything is shuffled with payloads: a hot group's rows are
    pre-aggregated to one row, and the join back may be split by AQE. Pages with the largest id of their group are
    responses, so repeated rows of it are too. A null page_id can't be referred to and stays response.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    best = p.filter((F.col("payload_bytes") >= SMALLEST_REVISIT) & F.col("page_id").isNotNull()).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n")
    p = p.join(best, ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce((F.col("page_id") < F.col("best")), F.lit(False))
    return p.select("page_id", "url", F.when(again, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("best")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, dictionary_bytes: int = 32_768) -> DataFrame:
    """Writes an archive per task; returns the manifest (path, n_records), a table in folder. Only what it names counts.

    pages needs page_id, url and html; other columns are not read. Null html is an empty payload; no pages give no archives.
    One record at a time is held beside its batch.
    """
    content = train(pages.select("page_id", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")), dictionary_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, n = None, 0
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
        for b in batches:
            for r in range(b.num_rows):
                if out is None:
                    _, path = task_file(root, ".warc.zst")
                    out = fs.open_output_stream(path)
                    packed = zstandard.ZstdCompressor(level=19).compress(content)
                    out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
                page_id, url, payload, size, digest, kind, refers_to = (c[r].as_py() for c in b.columns)
                out.write(tool.compress(record_bytes(page_id, url, kind, size, digest, refers_to, payload or b"")))
                n += 1
        if out is not None:
            out.close()
            scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
            yield pa.RecordBatch.from_pydict({"path": [scheme + path], "n_records": pa.array([n], pa.int64())})

    plan_records(pages).mapInArrow(run, "path string, n_records long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("path string, n_records long").parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives that the manifest names: page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload].

    Frames are decoded one by one as the file streams in; a wrong header, length, digest, cut-off frame or number of records is an error.
    A page written without id comes back with a null one.
    """
    names = NAMES if payloads else NAMES[:-1]
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, p = filesystem(path)
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(p) as f:
                    for raw in frames(f):
                        rows.append(parse_record(raw))
                        seen, held = seen + 1, held + (len(raw) if payloads else 0)
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], types[k]) for k in names})
                            rows, held = [], 0
                if seen != n:
                    raise ValueError(f"{path}: {seen} records, not {n}")
                if rows:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], types[k]) for k in names})

    schema = ", ".join(f"{k} {'long' if types[k] == pa.int64() else 'binary' if k == 'payload' else 'string'}" for k in names)
    files = manifest.count()
    return manifest.repartition(max(1, files)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to archives in a new shared folder and returns what they hold, without the payloads."""
    folder = folder or shared_folder(pages.sparkSession) + "/warc"
    return read_archives(write_archives(pages, folder)).drop("url")
