"""Embedding near-duplicates by sorted projection passes: vectors in order of concatenated random hash bits, neighbours compared, pairs united over passes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written
from .graph import connected_components

MISS = 1e-4
BLOCK, HEAD = 4096, 256
STEP = 512
MIN_BITS, MAX_BITS = 3, 30
RUN_BITS = 10
LINKS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
COUNT, EDGE, ALONE = 0, 1, 2


def bits_for(most: int) -> int:
    """Hash bits of a pass for so many rows of a label: about 2 ** RUN_BITS rows of evenly spread vectors have equal bits."""
    return min(MAX_BITS, max(MIN_BITS, int(most).bit_length() - RUN_BITS))


def passes_for(bits: int, threshold: float) -> int:
    """Passes after which a pair at `threshold` has had equal bits in none with odds of MISS at most."""
    agree = (1 - np.arccos(threshold) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-agree)))) if agree < 1 else 1


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, good, v, h) of vectors(vec_id, label, embedding): v the components as bytes (four or eight each, as given), h 128 bits of them.

    good is false where the label is null or the vector is null, empty, zero, or holds null or non-finite components; v and h are null there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, lists = b.column(1), b.column(2)
            out = []
            for k in range(b.num_rows):
                v = None
                if labels[k].is_valid and lists[k].is_valid and not lists[k].values.null_count:
                    x = lists[k].values.to_numpy(zero_copy_only=False)
                    with np.errstate(over="ignore"):
                        norm = float(x.astype(np.float64) @ x.astype(np.float64)) if len(x) else 0.0
                    v = x.tobytes() if np.isfinite(norm) and norm > 0 else None
                out.append(v)
            h = [hashlib.blake2b(v, digest_size=16).digest() if v is not None else None for v in out]
            yield pa.RecordBatch.from_arrays([b.column(0), labels, pa.array([v is not None for v in out], pa.bool_()), pa.array(out, pa.binary()), pa.array(h, pa.binary())], names=["vec_id", "label", "good", "v", "h"])

    return vectors.mapInArrow(run, "vec_id long, label long, good boolean, v binary, h binary")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float32 if width == 4 else np.float64).reshape(len(vectors), -1).astype(np.float64)


def signatures(vectors: DataFrame, bits: int, passes: int, seed: int, width: int) -> DataFrame:
    """vectors(label, vec_id, m, v) with sigs: for each pass the signs of `bits` random projections as one number. width: bytes of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            v = b.column(3).to_pylist()
            size = np.array([len(x) for x in v])
            out = np.zeros((len(v), passes), np.int32)
            for s in np.unique(size):
                if s not in planes:
                    planes[s] = np.random.default_rng([seed, s // width]).normal(size=(s // width, passes * bits))
                at = np.flatnonzero(size == s)
                signs = (matrix([v[k] for k in at], width) @ planes[s] > 0).reshape(len(at), passes, bits)
                out[at] = signs @ (1 << np.arange(bits - 1, -1, -1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * passes + 1, passes), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["label", "vec_id", "m", "v", "sigs"])

    return vectors.mapInArrow(run, "label long, vec_id long, m long, v binary, sigs array<int>")


def tile_links(x: np.ndarray, ids: np.ndarray, label: np.ndarray, m: np.ndarray, side: np.ndarray, sigs: np.ndarray, p: int, far: bool, threshold: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Links of one tile, whose rows are in the order of the pass, side 0 first: (kind, a, b, n) in columns.

    A near tile compares the rows of side 0 with one another where their hash bits are equal or at most HEAD rows lie between, and with
    side 1, the first rows of the next block, where the bits differ. A far tile compares the two sides, parts of one run of equal bits.
    A pair with equal bits in this pass and in no earlier one is counted here, for both; a neighbour with equal bits in no pass at
    all is returned as a pair, as only sorting brought it here. So the counts of all tiles and passes add up. Cosines are taken
    in single precision first; what comes within `near` of the threshold is decided in double precision.
    """
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x32 = x.astype(np.float32)
    near = max(1e-4, 3e-7 * x.shape[1])
    n, n0 = len(x), int((side == 0).sum())
    new = np.concatenate([[True], (label[1:] != label[:-1]) | (sigs[1:, p] != sigs[:-1, p])])
    run = np.cumsum(new) - 1
    run_end = np.concatenate([np.flatnonzero(new)[1:], [n]])[run]
    count, ea, eb, out = np.zeros(n), [], [], []
    for s in range(0, n0, STEP):
        e = min(s + STEP, n0)
        c0, c1 = (n0, n) if far else (s, max(int(run_end[e - 1]), min(n, e + HEAD)))
        cos = x32[s:e] @ x32[c0:c1].T
        a, b = np.nonzero(cos >= threshold - near)
        value = cos[a, b]
        a, b = a + s, b + c0
        ok = (label[a] == label[b]) & (a < b)
        if not far:
            ok &= (b < n0) | (run[a] != run[b])
        a, b, value = a[ok], b[ok], value[ok]
        close = np.flatnonzero(value < threshold + near)
        sure = np.ones(len(a), bool)
        for at in range(0, len(close), 1 << 16):
            k = close[at : at + (1 << 16)]
            sure[k] = (x[a[k]] * x[b[k]]).sum(axis=1) >= threshold
        a, b = a[sure], b[sure]
        equal = sigs[a] == sigs[b]
        here = equal[:, p] & ~equal[:, :p].any(axis=1)
        alone = ~equal.any(axis=1)
        if here.any():
            ha, hb = a[here], b[here]
            count += np.bincount(ha, weights=m[hb], minlength=n) + np.bincount(hb, weights=m[ha], minlength=n)
            fa, fb = forest(ids, ha, hb)
            ea.append(fa)
            eb.append(fb)
        if alone.any():
            out.append((ALONE, np.minimum(ids[a[alone]], ids[b[alone]]), np.maximum(ids[a[alone]], ids[b[alone]]), np.zeros(int(alone.sum()), np.int64)))
    k = np.flatnonzero(count)
    if len(k):
        out.append((COUNT, ids[k], ids[k], count[k].astype(np.int64)))
        fa, fb = forest(ids, np.concatenate(ea), np.concatenate(eb))
        out.append((EDGE, ids[fa], ids[fb], np.zeros(len(fa), np.int64)))
    return out


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as places, from every linked row to the row of the smallest id that it reaches by the links a-b."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = rank.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            break
        root = new
    k = np.flatnonzero(root != rank)
    return k, order[root[k]]


def compare_tiles(rows: DataFrame, threshold: float, width: int) -> DataFrame:
    """(kind, a, b, n) of all tiles of rows(pass, low, high, side, label, vec_id, m, v, sigs); low = high marks a near tile. A tile is in one task, which holds no other at the time."""

    def links(held: list[tuple], p: int, far: bool) -> Iterator[pa.RecordBatch]:
        side, label, ids, m, v, sigs = (np.concatenate(c) if k != 4 else sum(c, []) for k, c in enumerate(zip(*held, strict=True)))
        size = np.array([len(x) for x in v])
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            if not far or len(np.unique(side[at])) == 2:
                for kind, a, b, n in tile_links(matrix([v[k] for k in at], width), ids[at], label[at], m[at], side[at], sigs[at], p, far, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                now = tuple(keys[i].tolist())
                if now != key and held:
                    yield from links(held, key[0], key[1] != key[2])
                    held = []
                key, part = now, b.slice(i, j - i)
                held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(6).to_numpy(), part.column(7).to_pylist(), part.column(8).flatten().to_numpy().reshape(j - i, -1)))
        if held:
            yield from links(held, key[0], key[1] != key[2])

    tile = ["pass", "low", "high"]
    ordered = rows.select(*tile, "side", "label", "vec_id", "m", "v", "sigs", "sig").repartition(*tile).sortWithinPartitions(*tile, "side", "label", "sig", "vec_id").drop("sig")
    return ordered.mapInArrow(run, "kind int, a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector with an id.

    Links are pairs of equal label, both not null, with cosine (double precision) of `threshold` or more. Vectors that are null, empty, zero,
    or hold null or non-finite components, or have no label, link with nothing; only vectors of equal length link. Rows without vec_id are left out,
    repeated rows of an id count once (of differing ones the least by label, then by a hash of the vector). Other columns are not read.

    Equal vectors of a label are one class with a multiplicity. In each pass all classes are put in the order of label and hash
    bits, and cut into blocks, a tile each: rows of equal bits are compared with one another, and each row with the HEAD rows after it, those of the next block
    included. A run of equal bits that goes on past its block has a tile for every two blocks it touches, so a dense
    group of any size loses no link and none of its pairs leaves its task: links are counted there, once over
    all passes, and each row gives one edge per tile. Bits grow with the logarithm of the rows per label, and passes
    (where not given) with the bits, so that a pair at `threshold` is missed with odds of at most MISS whatever the size
    (fewer, with the windows).
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    width = 4 if kind == "float" else 8
    e = F.col("embedding") if width == 4 else F.col("embedding").cast("array<double>")
    v = packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("embedding")).filter("vec_id is not null"))
    v = written(v.groupBy("vec_id").agg(F.min(F.struct("label", "h", "good", "v")).alias("x")).select("vec_id", "x.*"), "vectors", folder)
    keyed = v.filter("good").select("vec_id", "label", "h")
    classes = written(keyed.groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes", folder)
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits = bits_for(most)
    passes = passes_for(bits, threshold) if passes is None else passes
    reps = v.select("vec_id", "v").join(classes.select(F.col("rep").alias("vec_id"), "label", "m"), "vec_id").select("label", "vec_id", "m", "v")
    signed = written(signatures(reps, bits, passes, seed, width), "signed", folder)

    # the place of each row in each pass's order: counts of the parts that a range partition makes, then a number within the part
    keys = signed.select("vec_id", "label", F.posexplode("sigs").alias("pass", "sig"))
    ordered = keys.repartitionByRange("pass", "label", "sig", "vec_id").sortWithinPartitions("pass", "label", "sig", "vec_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(np.arange(at, at + b.num_rows), pa.int64())], names=["vec_id", "label", "pass", "sig", "part", "i"])
            at += b.num_rows

    numbered = written(ordered.mapInArrow(number, "vec_id long, label long, pass int, sig int, part int, i long"), "order", folder)
    parts, before = [], 0
    for r in numbered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per task
        parts.append((r["part"], before))
        before += r["n"]
    place = F.col("before") + F.col("i")
    placed = numbered.join(F.broadcast(spark.createDataFrame(parts, "part int, before long")), "part").select("vec_id", "label", "pass", "sig", F.floor(place / block).alias("block"), (place % block).alias("row"))

    runs = placed.groupBy("pass", "label", "sig").agg(F.min("block").alias("first"), F.max("block").alias("last")).filter("last > first")
    crossing = placed.join(runs, ["pass", "label", "sig"])
    left = crossing.filter("block < last").select("vec_id", "pass", "sig", F.col("block").alias("low"), F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("high"), F.lit(0).alias("side"))
    right = crossing.filter("block > first").select("vec_id", "pass", "sig", F.explode(F.sequence(F.col("first"), F.col("block") - 1)).alias("low"), F.col("block").alias("high"), F.lit(1).alias("side"))
    own = placed.select("vec_id", "pass", "sig", F.col("block").alias("low"), F.col("block").alias("high"), F.lit(0).alias("side"))
    head = placed.filter((F.col("row") < HEAD) & (F.col("block") > 0)).select("vec_id", "pass", "sig", (F.col("block") - 1).alias("low"), (F.col("block") - 1).alias("high"), F.lit(1).alias("side"))
    seats = own.unionByName(head).unionByName(left).unionByName(right)
    found = written(compare_tiles(seats.join(signed, "vec_id"), threshold, width), "links", folder)

    alone = found.filter(F.col("kind") == ALONE).select("a", "b").distinct()
    mult = signed.select("vec_id", "m")
    extra = alone.unionByName(alone.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(mult.withColumnRenamed("vec_id", "b"), "b").select("a", F.col("m").alias("n"))
    count = found.filter(F.col("kind") == COUNT).select("a", "n").unionByName(extra).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comp = connected_components(found.filter(F.col("kind") != COUNT).select("a", "b"))
    c = classes.join(count, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    c = c.select("label", "h", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.join(c, ["label", "h"]).select("vec_id", "n_links", "component_id")
    rest = v.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
