"""MinHash near-duplicates by HyperMinHash registers: leading zeros plus mantissa bits per bucket, banded, estimated, verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written
from .graph import connected_components

INDEX_BITS = 9
BUCKETS = 1 << INDEX_BITS
MANTISSA = 10
BAND = 8
BANDS = BUCKETS // BAND
CACHE_WORDS = 400_000
SLACK = 6.0
TILE = 512
HUB_GROUP = 64
BROADCAST_BYTES = 64_000_000
TILE_SHINGLES = 4_000_000
# Odd 64-bit factors for mixing, and the constant of the expected collisions of registers.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
COLLISION = 0.169919487159739
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_order: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """64-bit hash of a word. Bounded: cleared when full."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def shingles(self, texts: list[str | None], width: int) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's runs of `width` words; a shorter text is one run, none gives an empty array."""
        if len(self) > CACHE_WORDS:
            self.clear()
        split = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() if t else [] for t in texts]
        n = np.array([len(w) for w in split])
        h = np.fromiter((x for w in split for x in map(self.__getitem__, w)), np.uint64, int(n.sum()))
        out, at = [], 0
        for k in n:
            w = h[at : at + k]
            at += k
            if k >= width:
                s = w[: k - width + 1] * np.uint64(FACTORS[0])
                for j in range(1, width):
                    s = (s ^ (s >> np.uint64(29))) * np.uint64(FACTORS[j % 4]) + w[j : k - width + 1 + j]
                out.append(np.unique(mixed(s)))
            elif k:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(split[len(out)]), seed=1)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch: for each bucket (first INDEX_BITS of the hash) the least remaining hash as leading zeros and mantissa; 0 where empty."""
    reg = np.zeros(BUCKETS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]])  # sorted: the first is the least
        rest = shingles[first] & np.uint64((1 << (64 - INDEX_BITS)) - 1)
        top = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bits in use
        shift = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
        mantissa = (rest >> shift) & np.uint64((1 << MANTISSA) - 1)
        reg[bucket[first]] = ((64 - INDEX_BITS - np.minimum(top, 64 - INDEX_BITS) + 1) << MANTISSA) | mantissa.astype(np.int64)
    return reg


def filled(reg: np.ndarray) -> np.ndarray:
    """For banding: an empty bucket takes the register of the first filled one in its own fixed random order."""
    if not _order:
        rng = np.random.default_rng(20240101)
        _order.append(np.argsort(rng.random((BUCKETS, BUCKETS)), axis=1).astype(np.int32))
    out, full = reg.copy(), reg > 0
    empty = np.flatnonzero(~full)
    width = 16
    for at in range(0, BUCKETS, width):
        if not len(empty):
            break
        options = _order[0][empty, at : at + width]
        ok = full[options]
        got = ok.any(axis=1)
        out[empty[got]] = reg[options[got, ok[got].argmax(axis=1)]]
        empty = empty[~got]
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers less the collisions expected of unrelated sets of these sizes, and the buckets they rest on."""
    union = ((a > 0) | (b > 0)).sum(axis=1)
    both = ((a > 0) & (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    ratio = na / np.maximum(nb, 1)
    accidental = COLLISION * 4 * ratio / (1 + ratio) ** 2 * both / (1 << MANTISSA)
    return np.maximum(equal - accidental, 0) / np.maximum(union, 1), union


def band_keys(full: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(full[BAND * k : BAND * (k + 1)].tobytes(), seed=k) & 0x7FFFFFFF for k in range(BANDS)]


def sketch(docs: DataFrame, width: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, raw, bands): set_a and set_b are 128 bits that equal sets share, raw the registers, bands a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = words.shingles(part.column(1).to_pylist(), width)
                raw = [registers(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(s.sum().view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                        pa.array([int(mixed(s ^ np.uint64(FACTORS[1])).sum().view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                        pa.array([r.tobytes() for r in raw], pa.binary()),
                        pa.array([band_keys(filled(r)) if len(s) else [] for r, s in zip(raw, sets, strict=True)], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "raw", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, raw binary, bands array<int>")


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose estimate isn't more than SLACK standard errors below the threshold."""
    t = percent / 100
    s = sketches.select(F.col("doc_id"), F.col("n_shingles").alias("n"), "raw")
    both = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("raw").alias("ra")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("raw").alias("rb")), "b")
    # sets whose sizes alone rule the threshold out
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                ra, rb = (np.frombuffer(b"".join(p.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (3, 5))
                j, n = estimate(ra, rb, p.column(2).to_numpy(), p.column(4).to_numpy())
                ok = j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(n, 1))
                yield p.select([0, 1]).filter(pa.array(ok))

    return both.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose full shingle sets have 100 * intersection >= percent * union.

    Many a may ask for one b: they are dealt to groups of about HUB_GROUP, and b's text goes once to each group, so a text that
    a third of all documents are compared with is neither in one task nor copied for every pair.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_GROUP).cast("int").alias("groups"))
    dealt = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), "groups").cast("int").alias("group"))
    one = dealt.select("b", "group", F.lit(1).alias("side"), F.col("a").alias("doc_id"))
    two = groups.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("side"), F.col("b").alias("doc_id"))
    rows = one.unionByName(two).join(texts.select("doc_id", "text"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hub = Words(), (None, None)
        for b in batches:
            left, right = [], []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = words.shingles(part.column(4).to_pylist(), width)
                for i, g, side, doc, x in zip(*(part.column(k).to_pylist() for k in range(4)), sets, strict=True):
                    if side == 0:
                        hub = ((i, g), x)
                        continue
                    y = hub[1] if hub[0] == (i, g) else np.zeros(0, np.uint64)
                    shared = np.intersect1d(x, y, assume_unique=True).size
                    if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                        left.append(doc)
                        right.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.select("b", "group", "side", "doc_id", "text").repartition("b", "group").sortWithinPartitions("b", "group", "side").mapInArrow(run, "a long, b long")


def rest_links(apart: DataFrame, texts: DataFrame, width: int, percent: int, folder: str) -> DataFrame:
    """Links (a, b) among apart(band, doc_id, component): all pairs of a band whose components differ, on full sets.

    A band's largest component is cut into blocks of TILE rows, and so are the rows of its others; every block of the others meets
    every block of the band in a tile of its own. Pairs never leave their tile, every one whose groups are apart there is
    compared on its full sets, and only those links are returned that join what the tile had apart.
    """
    sizes = apart.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("total"), F.max("n").alias("most"))
    m = apart.join(sizes, "band").withColumns({"blocks": F.ceil(F.col("total") / TILE).cast("int"), "sides": F.ceil((F.col("total") - F.col("most")) / TILE).cast("int"), "h": F.xxhash64("doc_id")})
    right = m.select("band", "doc_id", "component", F.lit(1).alias("side"), F.pmod("h", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("left_block"))
    left = m.filter("component <> major").select("band", "doc_id", "component", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.col("h"), F.col("sides")).cast("int").alias("left_block"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in words.shingles(part.column(1).to_pylist(), width)], pa.binary())], names=["doc_id", "shingles"])

    ids = apart.select("doc_id").distinct()
    known = written(texts.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles binary"), "sets", folder)
    rows = right.unionByName(left).join(known, "doc_id").select("band", "block", "left_block", "side", "doc_id", "component", "shingles")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for b in batches:
            c = [x.to_pylist() for x in b.columns]
            a_out, b_out = [], []
            for band, block, lb, side, doc, comp, sh in zip(*c, strict=True):
                if (band, block, lb) != key:
                    for x, y in tile_links(held, percent):
                        a_out.append(x)
                        b_out.append(y)
                    held, key = [], (band, block, lb)
                held.append((side, doc, comp, np.frombuffer(sh, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
        last = tile_links(held, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in last], pa.int64()), pa.array([y for _, y in last], pa.int64())], names=["a", "b"])

    return rows.repartition("band", "block", "left_block").sortWithinPartitions("band", "block", "left_block", "side", "doc_id").mapInArrow(tiles, "a long, b long")


def tile_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Verified links of one tile's rows (side, doc_id, component, shingles, ...), each between groups that were apart so far.

    Exact: no sketch decides. What a row shares with all rows of a part of the other side is counted at once, by its
    shingles' places in the part's sorted shingles; a part holds TILE_SHINGLES of them, or one row where that has more.
    """
    left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
    out: list[tuple[int, int]] = []
    if not left or not right:
        return out
    n = np.array([len(r[3]) for r in right])
    ids = np.array([r[1] for r in right])
    group = np.unique(np.array([r[2] for r in left + right]), return_inverse=True)[1]
    mine, theirs = group[: len(left)], group[len(left) :]
    part = (np.cumsum(n) - n) // TILE_SHINGLES
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        all_shingles, of = np.concatenate([right[i][3] for i in at]), np.repeat(np.arange(len(at)), n[at])
        order = np.argsort(all_shingles, kind="stable")
        all_shingles, of = all_shingles[order], of[order]
        for r, (_, doc, _, x, *_) in enumerate(left):
            ok = (theirs[at] != mine[r]) & (100 * np.minimum(n[at], len(x)) >= percent * np.maximum(n[at], len(x)))
            if not ok.any():
                continue
            low, high = np.searchsorted(all_shingles, x, "left"), np.searchsorted(all_shingles, x, "right")
            some = high > low
            low, size = low[some], (high - low)[some]
            hits = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            shared = np.bincount(of[hits], minlength=len(at))
            ok &= (shared > 0) & (100 * shared >= percent * (len(x) + n[at] - shared)) & (ids[at] != doc)
            for i in at[ok]:
                if theirs[i] != mine[r]:
                    out.append((int(max(doc, ids[i])), int(min(doc, ids[i]))))
                    old, new = mine[r], theirs[i]
                    mine[mine == old], theirs[theirs == old] = new, new
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id", rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document with an id.

    Documents with equal sets are one class, found by 128 bits of the whole set and represented by its smallest id. The
    classes' registers are cut into 64 bands of 8 (a pair at 0.8 shares one with all but 1 chance in 100,000); a pair that
    shares a band is a candidate. Only links decide components, so a band's members need not all meet: each is
    compared with the band's smallest member first, then, where members are still apart, with the one that has
    most links so far. What is apart after these `rounds` rounds is compared in tiles on full sets alone (rest_links), so no
    candidate is left out. In the rounds a pair passes the estimate before its full texts are compared; one that the
    estimate holds back is met again in the tiles.

    Null and empty texts have no shingles and link with nothing. Rows with a null id are left out. Of repeated rows of an
    id all come back; rows that share an id should share the text (keep_one gives keys to rows that don't). Texts are whole at
    any length; extra columns are not read; no documents give no rows.
    """
    folder = shared_folder(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    s = written(sketch(base, width, "text", "doc_id"), "sketches", folder)
    some = s.filter("n_shingles > 0")
    classes = written(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes", folder)
    reps = some.select("doc_id", "bands").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = reps.select("doc_id", F.posexplode("bands").alias("k", "key")).select("doc_id", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("key")).alias("band"))
    many = bands.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).filter("hub <> other").drop("other")
    bands = written(bands.join(many, "band").select("band", "doc_id", "hub"), "bands", folder)
    texts = written(base.join(bands.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts", folder)
    ask = written(bands.filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "ask0", folder)
    links, comp, m = None, None, None
    for turn in range(rounds):
        found = written(verified(likely(ask, some, percent), texts, width, percent), f"links{turn}", folder)
        links = found if links is None else links.unionByName(found)
        comp = written(connected_components(links), f"components{turn}", folder)
        degree = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("degree"))
        m = bands.select("band", "doc_id").distinct().join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(degree, "doc_id", "left")
        m = m.select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
        top = F.max(F.struct("degree", (-F.col("doc_id")).alias("i"), "component")).alias("top")
        split = m.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), top).filter("low <> high")
        m = written(m.join(split.select("band", (-F.col("top.i")).alias("hub"), F.col("top.component").alias("hub_component")), "band"), f"apart{turn}", folder)
        if turn < rounds - 1:
            pairs = m.filter("component <> hub_component").select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b"))
            ask = written(pairs.distinct().join(ask, ["a", "b"], "left_anti"), f"ask{turn + 1}", folder)
    rest = written(rest_links(m.select("band", "doc_id", "component"), texts, width, percent, folder), "rest", folder)
    if rest.take(1):
        comp = connected_components(links.unionByName(rest))
    ends = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = s.select("doc_id", "n_shingles", "set_a", "set_b").join(ends, ["set_a", "set_b", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay where of each group of near-duplicates only that with the smallest id does.

    Every row takes part: rows with a null id, and those of an id whose text isn't the first of that id's by a hash, have a key of their own
    beyond all ids, so they yield to rows with ids. Rows equal in id and text are one, of which the first by a hash of the other columns stays. Null and
    empty texts are no duplicates of one another. No documents give none; columns pass through as they are, whatever their names.
    """
    h = F.xxhash64("text")
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in (text, id_col) and "map<" not in kind]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("text"), F.xxhash64(*others or [F.lit(0)]).alias("order"))
    first = d.filter("i is not null").groupBy("i").agg(F.min(h).alias("h"), F.max(h).alias("last")).filter("h <> last").drop("last")
    first = written(first, "shared-ids")  # a row per id that has several texts; broadcast within a bound, so that texts stay where they are
    first = F.broadcast(first) if 16 * first.count() <= BROADCAST_BYTES else first
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.lit(11), "i", "text"), 2)
    keyed = d.join(first, "i", "left").withColumn("key", F.when(F.col("i").isNull() | (h != F.col("h")), own).otherwise(F.col("i")))
    kept = near_duplicates(keyed, width, percent, "text", "key").filter("kept").select(F.col("doc_id").alias("key"))
    one = Window.partitionBy("key").orderBy("order")
    return keyed.select("key", "row", "order").join(kept, "key", "left_semi").withColumn("r", F.row_number().over(one)).filter("r = 1").select("row.*")
