"""Toxicity by compression distance: windows of text compressed with a toxic and with an ordinary zstandard dictionary."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, sample_share, slices, written

WINDOW_WORDS = 4
LONGEST, OVERLAP = 96, 16
CODE_BYTES = 3
BASE_BYTES = 24_000
CLASS_BYTES = 6_000
HASH_LOG, MIN_MATCH = 17, 6
ROUNDS = 6
TOP = 3
BROADCAST_ROWS = 100_000
LONGEST_SAMPLE = 1_000_000
# Odd factors of the hash of three neighbouring characters.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)


def bounds(text: str) -> list[tuple[int, int]]:
    """First and last place (the latter left out) of the windows of a text of single-spaced words between two spaces: WINDOW_WORDS words and the spaces around them.

    A longer window than LONGEST characters gives several that overlap by OVERLAP, so that text without spaces has windows too.
    """
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    edges = [*spaces[:-1:WINDOW_WORDS].tolist(), int(spaces[-1])]
    if max(map(int.__sub__, edges[1:], edges), default=0) < LONGEST:
        return [(a, b + 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        while b + 1 - a > LONGEST:
            out.append((a, a + LONGEST))
            a += LONGEST - OVERLAP
        out.append((a, b + 1))
    return out


def coded(text: str) -> bytes:
    """CODE_BYTES for every three neighbouring characters.

    A dictionary match then needs a run of equal characters, costs the same whatever its length, and saves CODE_BYTES for
    each of them; what does not match cannot be packed. The compressed length so counts unmatched characters.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = cp[:-2] * np.uint64(FACTORS[0]) + cp[1:-1] * np.uint64(FACTORS[1]) + cp[2:] * np.uint64(FACTORS[2])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(FACTORS[3])
    return (h >> np.uint64(64 - 8 * CODE_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def windows(text: str | None) -> list[bytes]:
    """The coded windows of the whole text, in lower case and with white space as single spaces. A text without words has none."""
    out = []
    for part in slices(text or ""):
        if words := part.lower().split():
            plain = f" {' '.join(words)} "
            code = coded(plain)
            out += [code[CODE_BYTES * a : CODE_BYTES * (b - 2)] for a, b in bounds(plain)]
    return out


def train(samples: list[bytes], size: int) -> bytes:
    """Content that zstandard's dictionary training picks from the samples; the samples' own last bytes where they are too few to train on.

    Only the picked content is used: windows are so short that trained entropy tables would outweigh the matches.
    """
    try:
        return zstandard.train_dictionary(size, samples, k=8 * CODE_BYTES, d=8).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Distance:
    """Of each window its compressed length with the ordinary dictionary less that with the toxic one.

    Both compress with the same parameters: a hash table with room for every place of a dictionary, and matches of MIN_MATCH
    bytes at least, which are two codes, so four characters.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        p = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, hash_log=HASH_LOG, chain_log=HASH_LOG, search_log=1, target_length=0, min_match=MIN_MATCH, window_log=HASH_LOG, write_content_size=False, write_checksum=False, write_dict_id=False)

        def tool(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

        self.ordinary, self.toxic = tool(ordinary), tool(toxic)

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, map(self.ordinary, parts)), np.int32, len(parts)) - np.fromiter(map(len, map(self.toxic, parts)), np.int32, len(parts))


_distances: dict[str, Distance] = {}


def distance(model: dict) -> Distance:
    """The compressors of this Python worker for this model: Spark uses a worker for many tasks."""
    if model["key"] not in _distances:
        _distances.clear()
        _distances[model["key"]] = Distance(model["ordinary"], model["toxic"])
    return _distances[model["key"]]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """(ordinary, toxic): both trained by zstandard, from the windows of toxic and of ordinary texts.

    Both begin with content that tells them apart and end with one base trained on all ordinary windows, so that plain
    language costs the same in either. A toxic text is mostly ordinary words; which windows make it toxic is found in rounds: a dictionary trained on the
    windows chosen from one half of the texts picks, in each text of the other half, the TOP windows that it shortens most. The ordinary one is trained
    on the windows that it shortens most in ordinary texts, for the same number of bytes, so what both classes share cancels out. Of
    all rounds' pairs that one is kept which best tells the two classes' texts apart in the half that its toxic dictionary wasn't trained on.
    """
    halves = [toxic[::2], toxic[1::2]], [ordinary[::2], ordinary[1::2]]
    flat = lambda texts: sorted({w for t in texts for w in t})
    base = train(flat(ordinary), BASE_BYTES)
    chosen, plain = flat(halves[0][0]), b""
    kept, most = None, -1.0

    def best(texts: list[list[bytes]], d: Distance) -> tuple[list[bytes], np.ndarray]:
        out, top = set(), np.zeros(len(texts))
        for k, t in enumerate(texts):
            x = d.of(t)
            at = np.argsort(-x, kind="stable")[:TOP]
            out |= {t[j] for j in at if x[j] > 0}
            top[k] = x[at].clip(0).sum()
        return sorted(out), top

    for r in range(rounds):
        pair = plain + base, train(chosen, CLASS_BYTES) + base
        half = (r + 1) % 2 if len(toxic) > 1 else 0
        d = Distance(*pair)
        (picked, high), (hard, low) = best(halves[0][half], d), best(halves[1][half], d)
        apart = above(high, low)
        if apart > most:
            kept, most = pair, apart
        chosen, plain = picked or chosen, train(hard, CLASS_BYTES) if hard else plain
    return kept


def above(high: np.ndarray, low: np.ndarray) -> float:
    """The share of pairs in which the first is larger, ties half."""
    low = np.sort(low)
    return float((np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")).mean() / (2 * max(1, len(low))))


def features(d: np.ndarray) -> list[float]:
    """What calibration sees of a text: its largest TOP differences, their mean over all windows, and how many windows it has."""
    top = [*np.sort(d)[::-1][:TOP].tolist(), *[0] * TOP][:TOP]
    return [*(float(np.clip(x, -50, 80)) for x in top), float(d.mean()) if len(d) else 0.0, float(np.log1p(len(d)))]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(rows: list[tuple[str, int]], prior: float) -> dict:
    """The model from labelled texts in an arbitrary fixed order: two of three make the dictionaries, the third the calibration, whose texts they have not seen."""
    fit, rest = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    toxic, ordinary = ([windows(t) for t, y in fit if y == k] for k in (1, 0))
    model = {"key": uuid.uuid4().hex, "prior": prior}
    if not any(toxic) or not any(ordinary):
        return model
    model["ordinary"], model["toxic"] = dictionaries(toxic, ordinary)
    d = Distance(model["ordinary"], model["toxic"])
    x, y = np.array([features(d.of(windows(t))) for t, _ in rest]), np.array([v for _, v in rest], float)
    if 0 < y.sum() < len(y):
        model["weights"] = logistic(x, y).tolist()
    return model


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1600, ordinary_rows: int = 4800, max_chars: int = 40_000_000, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> dict:
    """Both dictionaries and the calibration, from labelled rows of folds 0 and 2.

    Class sizes cover all labelled rows. Texts are a bounded sample of about toxic_rows and ordinary_rows whole texts by a
    hash of the id (and max_chars in all), equal texts once; longer ones than LONGEST_SAMPLE characters aren't taken, so no single row fills the driver. Rows without id, text or label teach nothing. With one class only, or none, the score
    is the share of label 1 (0 without labels).
    """
    l = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(id_col) != 1)).groupBy(F.col(id_col).alias("i")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in l.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {"prior": 1.0 if sizes.get(1) else 0.0}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, toxic_rows / sizes[1]))).otherwise(F.lit(min(1.0, ordinary_rows / sizes[0])))
    chosen = written(l.filter(sample_share("i", share)), "sample")
    # about toxic_rows + ordinary_rows ids; the texts of all documents are only shuffled if somebody asks for a sample beyond BROADCAST_ROWS
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).filter(F.length("t") <= LONGEST_SAMPLE).join(chosen, "i").groupBy("t").agg(F.min("i").alias("i"), F.max("y").alias("y")).toLocalIterator(prefetchPartitions=True)
    found, chars = [], 0
    for r in rows:
        found.append((r["i"], r["t"], r["y"]))
        chars += len(r["t"])
        if chars > max_chars:
            break
    return fitted([(t, y) for _, t, y in sorted(found)], sizes[1] / (sizes[0] + sizes[1]))


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with toxicity double: 0 to 1, from the text alone, over all its windows.

    Null and empty texts have no windows and score as a text without distance. A column toxicity of docs is
    replaced; each row, repeated or not, comes back once, others pass through; no rows give none. One text's windows at a time are held beside the batch.
    """
    keep = [c for c in docs.columns if c != "toxicity"]
    src = docs.select(*keep)
    weights = model.get("weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = distance(model) if weights else None
        for b in batches:
            if weights:
                x = np.array([features(d.of(windows(t.as_py()))) for t in b.column(b.schema.get_field_index(text))]).reshape(b.num_rows, -1)
                z = np.hstack([x, np.ones((len(x), 1))]) @ np.array(weights)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                p = np.full(b.num_rows, model["prior"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*keep, "toxicity"])

    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", toxicity double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a score of exactly `threshold` is predicted 1."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
