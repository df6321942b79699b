"""More rules that depend on all before them, by key and in order; and deterministic embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], value: str, result: str, start: Callable[[], Callable]) -> DataFrame:
    """(keys, order, result) where a fresh start() per key is called with each value in turn.

    A key's rows are sorted on their way into a task and stream through it, so a key of any size costs the memory of its state alone.
    """
    names = [*keys, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for b in batches:
            found = []
            for now, x in zip(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True), b.column(len(names)).to_pylist(), strict=True):
                if step is None or now != key:
                    key, step = now, start()
                found.append(step(x))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found)], names=[*names, result.split()[0]])

    types = dict(rows.dtypes)
    d = rows.select(*names, value).repartition(*keys).sortWithinPartitions(*names)
    return d.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + f", {result}")


def audit_chain(log: DataFrame, key: str, order: list[str], body: str) -> DataFrame:
    """(key, order, hash): each entry's sha256 covers the one before it, so a change anywhere breaks all that follow."""

    def start() -> Callable:
        last = ""

        def step(x: str | None) -> str:
            nonlocal last
            last = hashlib.sha256(f"{last}|{x or ''}".encode()).hexdigest()
            return last

        return step

    return fold_sorted(log, [key], order, body, "hash string", start)


def greedy_packing(jobs: DataFrame, keys: list[str], order: list[str], cost: str, limit: float) -> DataFrame:
    """Jobs in order that still fit their key's budget; one that doesn't fit is skipped and later ones may."""

    def start() -> Callable:
        left = limit

        def step(x: float) -> bool:
            nonlocal left
            fits = x <= left
            left -= x if fits else 0
            return fits

        return step

    return fold_sorted(jobs, keys, order, cost, "taken boolean", start)


def directory_write(rows: DataFrame) -> DataFrame:
    """Outcome of each row(slot, known_at, page_id, degraded): a primary row supersedes degraded ones of its slot, a degraded row behind a primary is shadowed, a repeat is skipped."""
    w = Window.partitionBy("slot").orderBy("known_at", "page_id")
    before = F.coalesce(F.bool_or(~F.col("degraded")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    outcome = F.when(F.row_number().over(w) == 1, "inserted").when(~F.col("degraded") & ~before, "superseded_degraded").when(F.col("degraded") & before, "shadowed").otherwise("skipped")
    return rows.select("slot", "page_id", outcome.alias("outcome"))


def hashed_embedding(text, dim: int = 64):
    """Unit vectors from sha256 counter blocks: equal texts have equal vectors. A stand-in for a model in tests and fixtures."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            raw = b"".join(hashlib.sha256(f"{t}|{k}".encode()).digest() for k in range(-(-dim * 4 // 32)))
            v = np.nan_to_num(np.frombuffer(raw[: dim * 4], "<u4").astype(np.float64) / 2**31 - 1)
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32)

        return s.map(one)

    return embed(text)
