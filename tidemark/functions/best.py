"""The best rows of dense blocks of scores, as numpy arrays within a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def rounded(x: np.ndarray) -> np.ndarray:
    """To six decimals, halves away from zero; no negative zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, of equal ones the first; -inf is a place that counts for nothing."""
    n = scores.shape[1]
    bars = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    rows, columns = [], []
    for r, bar in enumerate(bars):
        above = np.flatnonzero(scores[r] > bar)
        level = np.flatnonzero(scores[r] == bar)[: k - len(above)] if bar > -np.inf else above[:0]
        columns += [above, level]
        rows.append(np.full(len(above) + len(level), r))
    nothing = [np.zeros(0, int)]
    return np.concatenate(rows or nothing), np.concatenate(columns or nothing)


def in_order(keys: pa.ChunkedArray) -> pa.Array:
    """The places of keys in Spark's ascending order, nulls first."""
    return pc.array_sort_indices(keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys, null_placement="at_start")
