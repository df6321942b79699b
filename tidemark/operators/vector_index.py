"""A stored inverted file of vectors: cells around trained centroids, blocks of 8-bit codes with error bounds, multi-probe search that stays exact.

The index holds a byte per component; full vectors are read only for candidates, the rows whose bound reaches the k-th best of a question. Cells are
skipped where not even their nearest possible vector could reach it. On vectors without clusters no cell can be skipped, and the codes alone save
work: all of them are read, but few full vectors are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written
from .retrieval import dot, normalised, top

#: Bounds: centroids, the sample that they are trained on, vectors of a block, questions that meet a block at a time.
MOST_CELLS, SAMPLE_ROWS, BLOCK, CHUNK = 4_096, 65_536, 2_048, 256
#: Scores are rounded to six decimals, so what is this much below a bound can still tie with it.
SLACK = 2e-6


@dataclass
class VectorIndex:
    """blocks(block, keys, codes, scales, errors) as a table; the cells' centroids, radii and numbers of blocks are bounded by MOST_CELLS."""

    blocks: DataFrame
    vectors: DataFrame
    n: int
    centroids: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    key: str


def usable(v: Column) -> Column:
    """Vectors that have components, none of them null or not finite."""
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def train(units: DataFrame, n: int, seed: int = 5) -> np.ndarray:
    """Centroids by k-means on a sample of about SAMPLE_ROWS rows, chosen by a hash of the key; about the square root of n of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, SAMPLE_ROWS / max(1, n))
    sample = units.filter(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) < share * (1 << 30)).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, min(MOST_CELLS, round(n**0.5))), seed=seed, maxIter=10).fit(sample)
    return np.array(model.clusterCenters())


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors): components in 1/127 of the vector's largest, and how far the coded vector is from it."""
    scale = np.maximum(np.abs(x).max(1), 1e-30) / 127
    codes = np.floor(x / scale[:, None] + 0.5).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1)) + 1e-12


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def build(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> VectorIndex:
    """The index of every usable vector, written to the shared folder. Vectors of one table have one length.

    A cell of many vectors has as many blocks as its count asks for, dealt by a hash of the key, so no cell is in one task or row.
    """
    folder = shared_folder(vectors.sparkSession)
    raw = vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    units = written(raw.select("key", normalised(F.col("v")).alias("v")), f"{folder}/units")
    n = units.count()
    blank = np.zeros((0, 1))
    centroids = train(units, n) if n > 2 else np.array([r["v"] for r in units.limit(1).collect()]) if n else blank

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centroids**2).sum(1) / 2
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            cell = (x @ centroids.T - half).argmax(1)
            codes, scales, errors = coded(x)
            far = np.sqrt(((x - centroids[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scales), pa.array(errors)], names=["key", "cell", "far", "code", "scale", "error"])

    rows = written(units.mapInArrow(assign, "key long, cell int, far double, code binary, scale double, error double"), f"{folder}/rows")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    radii, parts = np.zeros(len(centroids)), np.zeros(len(centroids), int)
    for r in sizes.collect():  # MOST_CELLS rows at most
        radii[r["cell"]], parts[r["cell"]] = r["far"] + 1e-9, -(-r["n"] // BLOCK)
    dealt = rows.join(F.broadcast(sizes.select("cell", F.ceil(F.col("n") / BLOCK).alias("parts"))), "cell")
    dealt = dealt.withColumn("block", F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64(F.lit(3), "key"), F.col("parts")))
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("key", "code", "scale", "error")).alias("x"))
    blocks = blocks.select("block", F.col("x.key").alias("keys"), F.col("x.code").alias("codes"), F.col("x.scale").alias("scales"), F.col("x.error").alias("errors"))
    return VectorIndex(written(blocks, f"{folder}/blocks"), units, n, centroids, radii, parts, key)


def probes(index: VectorIndex, questions: DataFrame) -> DataFrame:
    """(qid, cell, parts, reach, rank) for each question's cells with vectors: the best cosine that the cell could hold, and the cell's place by distance."""
    c, radii, parts = index.centroids, index.radii, index.parts
    there = np.flatnonzero(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (c[there] ** 2).sum(1) / 2
        for b in batches:
            for k, q in enumerate(matrix(b.column(1))):
                s = c[there] @ q
                rank = np.empty(len(there), np.int32)
                rank[np.argsort(half - s, kind="stable")] = np.arange(1, len(there) + 1)
                # |q - v| is no less than |q - c| less the radius, and both q and v have unit length
                gap = np.maximum(0, np.sqrt(np.maximum(0, (q**2).sum() + 2 * half - 2 * s)) - radii[there])
                reach = ((q**2).sum() + 1 - gap**2) / 2
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(there), pa.int64()), pa.array(there.astype(np.int32)), pa.array(parts[there].astype(np.int32)), pa.array(reach), pa.array(rank)], names=["qid", "cell", "parts", "reach", "rank"])

    return questions.select("qid", "qv").mapInArrow(run, "qid long, cell int, parts int, reach double, rank int")


def scan(index: VectorIndex, ask: DataFrame, questions: DataFrame, n_questions: int) -> DataFrame:
    """(qid, key, low, high): bounds of the cosine of each asked question with the vectors of its cells, but for those that k others of the same block surely beat.

    Blocks meet questions by block, CHUNK questions a row at most on average, so neither a popular cell nor a popular block is one task.
    """
    chunks = max(1, -(-n_questions // CHUNK))
    asked = ask.select("qid", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("cell").cast("long") * (1 << 32) + p)).alias("block"), "k")
    asked = asked.join(questions.select("qid", "qv"), "qid").groupBy("block", F.pmod(F.xxhash64("qid"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("qid", "k", "qv")).alias("q"))
    met = asked.join(index.blocks, "block").select(F.col("q.qid").alias("qids"), F.col("q.k").alias("ks"), F.col("q.qv").alias("qvs"), "keys", "codes", "scales", "errors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qids, ks = b.column(0)[r].values.to_numpy(), b.column(1)[r].values.to_numpy()
                q = matrix(b.column(2)[r].values)
                keys, scales, errors = (b.column(k)[r].values.to_numpy() for k in (3, 5, 6))
                codes = np.frombuffer(b"".join(b.column(4)[r].as_py()), np.int8).reshape(len(keys), -1).astype(float)
                s = (codes @ q.T) * scales[:, None]
                room = errors[:, None] * np.sqrt((q**2).sum(1))
                low, high = s - room, s + room
                bar = np.full(len(qids), -np.inf)
                for k in np.unique(ks[ks <= len(keys)]):
                    bar[ks == k] = np.partition(low[:, ks == k], len(keys) - k, axis=0)[len(keys) - k]
                j, at = np.nonzero((high >= bar - SLACK).T)
                yield pa.RecordBatch.from_arrays([pa.array(qids[j]), pa.array(keys[at]), pa.array(low[at, j]), pa.array(high[at, j])], names=["qid", "key", "low", "high"])

    return met.mapInArrow(run, "qid long, key long, low double, high double")


def bars(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, bar): the k-th largest lower bound of each question, below which nothing can be among its k best; null with fewer rows."""
    w = Window.partitionBy("qid").orderBy(F.desc("low"))
    r = hits.withColumn("r", F.row_number().over(w)).join(asked.select("qid", "k"), "qid").filter("r = k")
    return r.select("qid", F.col("low").alias("bar"))


def search(index: VectorIndex, questions: DataFrame, k: int = 10, first_probes: int = 8) -> tuple[DataFrame, DataFrame]:
    """((qid, key, score, rank) of the k best by exact cosine, ties by key; (qid, n_candidates), the full vectors compared for each question).

    Two rounds: the nearest `first_probes` cells give a bar; of all other cells those are scanned that could reach it. Then only rows whose upper bound
    reaches the bar of all rows meet their full vectors. The questions are a stated set. Unusable questions get nothing; fewer than k vectors give them all.
    """
    q = questions.select(F.col("qid").cast("long").alias("qid"), normalised(F.col("embedding").cast("array<double>")).alias("qv")).filter(usable(F.col("qv")))
    return deepened(index, q.withColumn("k", F.lit(k)), first_probes)


def deepened(index: VectorIndex, q: DataFrame, first_probes: int) -> tuple[DataFrame, DataFrame]:
    spark, folder = index.blocks.sparkSession, shared_folder(index.blocks.sparkSession)
    q = written(q, f"{folder}/questions")
    n = q.count()
    if not n or not index.n:
        none = spark.createDataFrame([], f"qid long, {index.key} long, score double, rank int")
        return none, spark.createDataFrame([], "qid long, n_candidates long")
    p = written(probes(index, q).join(q.select("qid", "k"), "qid"), f"{folder}/probes")
    hits = written(scan(index, p.filter(F.col("rank") <= first_probes), q, n), f"{folder}/hits1")
    bar = written(bars(hits, q), f"{folder}/bar1")
    more = p.filter(F.col("rank") > first_probes).join(bar, "qid", "left").filter(F.col("bar").isNull() | (F.col("reach") >= F.col("bar") - SLACK)).drop("bar")
    hits = hits.unionByName(written(scan(index, more, q, n), f"{folder}/hits2"))
    bar = written(bars(hits, q), f"{folder}/bar2")
    candidates = written(hits.join(bar, "qid", "left").filter(F.col("bar").isNull() | (F.col("high") >= F.col("bar") - SLACK)).select("qid", "key"), f"{folder}/candidates")
    full = candidates.join(index.vectors, "key").join(q, "qid").select("qid", F.col("key").alias(index.key), "k", F.round(dot(F.col("v"), F.col("qv")), 6).alias("score"))
    best = top(full, index.key, 1 << 30).filter(F.col("rank") <= F.col("k")).drop("k")
    return best.select("qid", index.key, "score", "rank"), candidates.groupBy("qid").agg(F.count("*").alias("n_candidates"))


def filtered_search(index: VectorIndex, questions: DataFrame, allowed: DataFrame, k: int = 10, growth: int = 4, first_probes: int = 8) -> DataFrame:
    """(qid, key, score, rank) of the k best among the rows of allowed(key), which the index doesn't know.

    The index is asked for k, then for growth times as many for those questions alone of which fewer than k have survived the filter, until
    k survive or no vector is left. Each round is written.
    """
    folder = shared_folder(index.blocks.sparkSession)
    q = questions.select(F.col("qid").cast("long").alias("qid"), normalised(F.col("embedding").cast("array<double>")).alias("qv")).filter(usable(F.col("qv")))
    ok = allowed.select(F.col(index.key).cast("long").alias(index.key)).distinct()
    wanted, asked, turn, done = q, k, 0, None
    while True:
        found, _ = deepened(index, wanted.withColumn("k", F.lit(asked)), first_probes)
        kept = written(found.join(ok, index.key, "left_semi").select("qid", index.key, "score"), f"{folder}/kept{turn}")
        short = wanted.select("qid").join(kept.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").filter(F.coalesce("n", F.lit(0)) < k).select("qid")
        short = written(short if asked < index.n else short.limit(0), f"{folder}/short{turn}")
        complete = kept.join(short, "qid", "left_anti")
        done = complete if done is None else done.unionByName(complete)
        if short.isEmpty():
            return top(done, index.key, k).select("qid", index.key, "score", "rank")
        wanted, asked, turn = q.join(short, "qid", "left_semi"), asked * growth, turn + 1


def recall(index: VectorIndex, found: DataFrame, compared: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall, n, share): mean share of each question's exact hits that the index found, questions, and the mean share of all vectors that were compared in full."""
    e = exact.select("qid", index.key).distinct()
    hit = found.select("qid", index.key, F.lit(1).alias("hit")).distinct()
    per = e.join(hit, ["qid", index.key], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("r")).join(compared, "qid", "left")
    share = F.coalesce("n_candidates", F.lit(0)) / max(1, index.n)
    return per.agg(F.round(F.coalesce(F.avg("r"), F.lit(1.0)), 6).alias("recall"), F.count("*").alias("n"), F.round(F.coalesce(F.avg(share), F.lit(0.0)), 4).alias("share"))
