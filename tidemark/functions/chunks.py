"""Splitting texts into overlapping pieces at sentence ends."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that end a sentence, and the sizes of pieces.
ENDERS = "。！？；\n"
SIZE, LEAST, OVERLAP = 400, 200, 48


def pieces(text: str, size: int = SIZE, least: int = LEAST, overlap: int = OVERLAP) -> list[str]:
    """A text in pieces of at most `size` characters, each but the first repeating the `overlap` characters before it; linear in the text.

    White space at either end goes; a blank text has no piece. A piece ends after the last sentence end from `least` characters on, else at
    `size`. A last piece shorter than `least` joins the one before it where both fit `size`.
    """
    text = text.strip()
    ends = [m.end() for m in re.finditer(f"[{ENDERS}]", text)]

    def stop(start: int) -> int:
        full = start + size
        if full >= len(text):
            return len(text)
        last = bisect_right(ends, full) - 1  # the last sentence end within reach, if it isn't too near
        return ends[last] if last >= 0 and ends[last] > start + least else full

    stops = [stop(0)]
    while stops[-1] < len(text):
        stops.append(stop(stops[-1] - overlap))
    starts = [0, *(s - overlap for s in stops[:-1])]
    if len(stops) > 1 and stops[-1] - starts[-1] < least and stops[-1] - starts[-2] <= size:
        del stops[-2], starts[-1]
    return [text[a:b] for a, b in zip(starts, stops, strict=True) if b]


def split_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, piece, content) of every text; null and blank ones have no pieces. One text's pieces at a time are held beside the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                p = pieces(t.as_py() or "")
                if p:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(p), b.column(0).type), pa.array(range(len(p)), pa.int32()), pa.array(p, pa.string())], names=[key, "piece", "content"])

    d = docs.select(F.col(key), F.col(text).cast("string"))
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, piece int, content string")
