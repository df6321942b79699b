"""Token-ID output: Arrow files of fixed-size-list batches, each list one sequence of equal length, with its mask."""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, shared_folder, task_file

SEQUENCE = 2048
BATCH = 64
CACHE_WORDS = 200_000
MANIFEST = "part int, path string, index_path string, n_docs long, n_tokens long"


def lowered(word: str) -> str:
    """Lower case as the tokenizer has it; empty where composing or a final sigma could make a difference."""
    low = word.lower()
    if word.isascii() or ("Σ" not in word and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low) and low.isalpha()):
        return low
    return ""


class Encoder(dict):
    """Ids of a text as little-endian uint16 bytes, by the tokenizers library.

    White space separates pre-tokens of this vocabulary and is dropped, so a text's ids are those of its space-separated
    pieces in turn; the library works on each new piece once and later ones are looked up. A piece of letters is
    one pre-token, which the library's model takes in lower case and byte by byte; a full stop or comma after letters is a
    pre-token of its own where the letters are such a piece; any other piece goes through the whole tokenizer. Texts that may hold one of the vocabulary's special
    strings, which the library finds before it splits, are encoded whole. Bounded: pieces not used for two rounds of
    CACHE_WORDS go.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.tokenizer = Tokenizer.from_file(vocabulary)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        self.special = sorted({x.content[:2] for x in self.tokenizer.get_added_tokens_decoder().values()})
        self.model, self.old = self.tokenizer.model, {}
        # the shortcuts hold for vocabularies that lower-case and put letters, digits and marks in pre-tokens of their own
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.short = all(whole(t) == [*(x.id for x in self.model.tokenize(t[:-1].lower())), *whole(t[-1])] for t in ("Word.", "thE,", "q."))
        self.short &= whole("ÉTÉ") == [x.id for x in self.model.tokenize(self.bytes("été")[0][0])]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if not piece:
                ids = b""
            elif self.short and piece.isalpha() and (low := lowered(piece)):
                ids = array("H", [x.id for x in self.model.tokenize(low if low.isascii() else self.bytes(low)[0][0])]).tobytes()
            elif self.short and piece[-1] in ".," and piece[:-1].isalpha() and lowered(piece[:-1]):
                ids = self[piece[:-1]] + self[piece[-1]]
            else:
                ids = self.whole(piece)
        self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self) > CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            out.append(self.whole(t) if any(s in t for s in self.special) else b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of this Python worker: Spark uses a worker for many tasks, and later ones find its pieces there."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def sequence_schema(length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Appends documents to one file of sequences and one of (doc_id, start in the file, n_tokens)."""

    def __init__(self, fs, path: str, index_path: str, length: int):
        self.length, self.left, self.size, self.n_docs, self.n_tokens, self.docs = length, [], 0, 0, 0, []
        self.files = [fs.open_output_stream(path), fs.open_output_stream(index_path)]
        self.schema = sequence_schema(length)
        self.writer, self.index = pa.ipc.new_file(self.files[0], self.schema), pa.ipc.new_file(self.files[1], INDEX)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_tokens, len(ids)))
        self.left.append(ids)
        self.size += len(ids)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if self.size >= BATCH * self.length:
            self.flush(False)
        if len(self.docs) >= 4096:
            self.flush_index()

    def flush(self, last: bool) -> None:
        ids = np.concatenate([*self.left, np.zeros(0, np.uint16)]).astype(np.uint16, copy=False)
        step = BATCH * self.length
        for at in range(0, len(ids) if last else len(ids) - step + 1, step):
            part = ids[at : at + step]
            rows = -(-len(part) // self.length)
            full = np.zeros(rows * self.length, np.uint16)
            full[: len(part)] = part
            mask = np.arange(rows * self.length) < len(part)
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.left = [] if last else [ids[len(ids) // step * step :]]
        self.size = sum(map(len, self.left))

    def flush_index(self) -> None:
        if self.docs:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=INDEX))
            self.docs = []

    def close(self) -> None:
        self.flush(True)
        self.flush_index()
        for x in (self.writer, self.index, *self.files):
            x.close()


def write_sequences(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, length: int = SEQUENCE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes docs in ascending id order to Arrow files in folder; returns the manifest, a table in the same folder.

    Files follow one another as their part numbers do; ids are ranged over them, so the order holds across files. Each
    file's last sequence is padded, with mask false. A null text is empty; every document ends with end_id. Null ids come
    first; repeated ids in order of text. No documents give no files. A retried task writes under another name and only
    what the manifest names counts. Memory: 256 texts and one batch of sequences per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        tool, out = encoder(vocabulary), None
        end = np.array([end_id], np.uint16)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                if out is None:
                    n, path = task_file(root, ".arrow")
                    out = SequenceWriter(fs, path, path + ".docs", length)
                for i, ids in zip(part.column(0).to_pylist(), tool.many([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    out.add(i, np.concatenate([np.frombuffer(ids, np.uint16), end]))
        if out is not None:
            out.close()
            scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
            yield pa.RecordBatch.from_pylist([{"part": n, "path": scheme + path, "index_path": scheme + path + ".docs", "n_docs": out.n_docs, "n_tokens": out.n_tokens}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).repartitionByRange("i").sortWithinPartitions("i", "t")
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def random_sequences(path: str, numbers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask) of the sequences of one file by number; ids are views of the mapped file where it is local."""
    fs, p = filesystem(path)
    source = pa.memory_map(p) if fs.type_name == "local" else fs.open_input_file(p)
    reader = pa.ipc.open_file(source)
    out = []
    for k in numbers:
        b = reader.get_batch(k // BATCH)
        row = b.slice(k % BATCH, 1)
        out.append((row.column(0).flatten().to_numpy(zero_copy_only=True), row.column(1).flatten().to_numpy(zero_copy_only=False)))
    return out


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, input_ids]) of every document, from the files that the manifest names.

    start counts the ids of all documents before it over all files. The manifest has a row per file, so its running sum
    is taken on the driver; batches are read one at a time, and a document may span any number of them.
    """
    files, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["path"], r["index_path"], before))
        before += r["n_tokens"]
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", input_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index_path, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, p = filesystem(path)
                with fs.open_input_file(p) as f, fs.open_input_file(filesystem(index_path)[1]) as g:
                    reader, index = pa.ipc.open_file(f), pa.ipc.open_file(g)
                    k, ids, at = 0, np.zeros(0, np.uint16), 0
                    for j in range(index.num_record_batches):
                        part = index.get_batch(j)
                        crcs, lists = [], []
                        for n in part.column(2).to_pylist():
                            crc, pieces = 0, []
                            while n:
                                if at == len(ids):
                                    x = reader.get_batch(k)
                                    ids, at, k = x.column(0).flatten().to_numpy()[x.column(1).flatten().to_numpy(zero_copy_only=False)], 0, k + 1
                                    if not len(ids):
                                        raise ValueError(f"{path}: fewer ids than its documents have")
                                piece = ids[at : at + n]
                                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                                at, n = at + len(piece), n - len(piece)
                                if with_ids:
                                    pieces.append(piece)
                            crcs.append(crc)
                            if with_ids:
                                lists.append(np.concatenate(pieces).astype(np.int32))
                        start = pa.compute.add(part.column(1), first)
                        yield pa.RecordBatch.from_arrays([part.column(0), start, part.column(2), pa.array(crcs, pa.int64()), *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", "input_ids"][: 4 + with_ids])

    import pyarrow.compute  # noqa: F401  (pa.compute in the tasks)

    table = spark.createDataFrame(files, "path string, index_path string, before long")
    return table.repartition(max(1, len(files))).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Writes the token files of docs(doc_id, text) to a new shared folder and returns what they hold per document."""
    folder = folder or shared_folder(docs.sparkSession) + "/tokens"
    return read_documents(write_sequences(docs, folder, vocabulary))
