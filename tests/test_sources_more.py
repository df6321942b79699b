"""Split windows, the blob store and word boxes against slow versions."""

import datetime as dt
import hashlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import word_boxes
from tidemark.sources import blobs, listing


def test_bisected_windows_against_recursion(spark):
    rng = np.random.default_rng(1)
    day0 = dt.date(2024, 1, 1)
    rows = [(k, day0 + dt.timedelta(days=int(d))) for k in ("a", "b") for d in rng.integers(0, 40, 300)] + [("b", day0 + dt.timedelta(days=7))] * 30 + [("c", None), (None, day0)]
    windows = [("a", day0, day0 + dt.timedelta(days=39)), ("b", day0, day0 + dt.timedelta(days=39)), ("c", day0, day0 + dt.timedelta(days=3))]
    got = listing.bisected(spark.createDataFrame(windows, "k string, first date, last date"), spark.createDataFrame(rows, "k string, day date"), "k", "day", 25)

    def ask(k, a, b):
        n = sum(x == k and d is not None and a <= d <= b for x, d in rows)
        if n <= 25:
            return [(k, a, b, n, "complete")]
        if a == b:
            return [(k, a, b, n, "overfull")]
        m = a + (b - a) // 2
        return [(k, a, b, n, "truncated"), *ask(k, a, m), *ask(k, m + dt.timedelta(days=1), b)]

    want = [r for w in windows for r in ask(*w)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and {r[4] for r in want} == {"complete", "truncated", "overfull"}
    total = {r.k: (r.expected, r.overfull) for r in listing.expected_total(got, "k").collect()}
    assert total["a"] == (300, 0) and total["b"][1] == 1 and total["c"] == (0, 0)


def test_blobs_are_stored_once_and_checked(spark, tmp_path):
    data = [b"", b"one", b"two" * 100_000, b"one", None, bytes(range(256))]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(data)], "k long, data binary").repartition(4)
    root = f"file://{tmp_path}"
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {sha(x): x for x in data if x is not None}
    for name in ("first", "again"):
        assert {r.digest: r["size"] for r in blobs.put(d, root, name).collect()} == {k: len(v) for k, v in want.items()}
        files = [p for p in Path(tmp_path, "blobs").rglob("*") if p.is_file() and not p.name.startswith(".")]
        assert sorted(p.name for p in files) == sorted(want)
    assert {r.digest: bytes(r.data) for r in blobs.get(spark, root).collect() if r.intact} == want
    Path(tmp_path, "blobs", sha(b"one")[:2], sha(b"one")).write_bytes(b"bad")
    asked = spark.createDataFrame([(sha(b"one"),), (sha(b"two" * 100_000),), ("none",)], "digest string")
    assert {r.digest[:4]: r.intact for r in blobs.get(spark, root, asked).collect()} == {sha(b"one")[:4]: False, sha(b"two" * 100_000)[:4]: True, "none": None}


def test_word_grids_against_a_slow_version(spark):
    rng = np.random.default_rng(6)
    words = []
    for page in range(60):
        for row in range(12):
            at = 0.0
            for _ in range(int(rng.integers(1, 5))):
                at += float(rng.choice([2, 6, 8, 30, 60]))
                size = float(rng.integers(3, 30))
                words.append((page, row, at, at + size, f"w{len(words)}"))
                at += size
    got = word_boxes.word_grids(spark.createDataFrame(words, "page int, row int, x0 double, x1 double, text string"), "page")
    want = set()
    for page in range(60):
        rows = [sorted((w for w in words if w[:2] == (page, r)), key=lambda w: w[2]) for r in range(12)]
        run: list = []
        for row in [*rows, []]:
            if row and 1 + sum(b[2] - a[3] >= 8 for a, b in zip(row, row[1:], strict=False)) >= 2:
                run.append(row)
                continue
            cols: list = []
            for x0, x1 in sorted((w[2], w[3]) for r in run for w in r):
                if cols and x0 - cols[-1][1] < 8:
                    cols[-1][1] = max(cols[-1][1], x1)
                else:
                    cols.append([x0, x1])
            if len(run) >= 3 and len(cols) >= 3:
                for r in run:
                    for k, (a, b) in enumerate(cols):
                        inside = [w for w in r if a <= w[2] and w[3] <= b]
                        if inside:
                            want.add((page, run[0][0][1], r[0][1], k, a, b, " ".join(w[4] for w in inside)))
            run = []
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100
    assert word_boxes.word_grids(got.limit(0).select("page", "row", F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"), "text"), "page").count() == 0
