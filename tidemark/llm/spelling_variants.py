"""Spelling variants: words one edit apart, met in wildcard groups that keep their size and top two, never in pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, shared_folder, written

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: A word of more code points has groups known by hashes, as the strings of all its places would grow with its length's square.
LONG = 64
# Fixed value: what a word consists of.
LETTERS = r"A-Za-zÀ-ÿ"
# The modulus and the base of the places' polynomial hash.
PRIME, BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F


def word_counts(docs: DataFrame, noise: int | None = 31, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more.

    A word is a maximal run of letters with A-Z in lower case. Where `noise` divides the crc32 of id and word, one code point is taken out of
    it, as a typist would; None leaves the words as they are. Occurrences are summed before the shuffle, so a frequent word is no hot key.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}+"), F.lit(0))
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run"))
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower()))
    word = F.col("low")
    if noise:
        h = F.crc32(F.concat_ws(":", "i", "low"))
        at = (h % F.length("low")).cast("int")
        word = F.when(h % noise == 0, F.concat(F.substr("low", F.lit(1), at), F.substr("low", at + 2))).otherwise(word)
    words = d.select("i", lowered.alias("low")).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def short_keys(words: DataFrame) -> DataFrame:
    """(key, id, n, own): the groups of words of up to LONG code points; own is true in that of the word itself.

    A key is the word with one place left open ('*' is no letter, so place, prefix and suffix can be read from it), the
    word with one code point taken out (equal results once), or the word itself. A word that is another's deletion meets it there.
    """
    size = F.length("word")
    head, tail = (lambda p: F.substr("word", F.lit(1), p - 1)), (lambda p: F.substr("word", p + 1))
    places = F.sequence(F.lit(1), size)
    wild = F.transform(places, lambda p: F.concat(head(p), F.lit("*"), tail(p)))
    cut = F.when(size > LEAST_LENGTH, F.array_distinct(F.transform(places, lambda p: F.concat(head(p), tail(p))))).otherwise(F.array().cast("array<string>"))
    return words.select(F.explode(F.concat(wild, cut, F.array("word"))).alias("key"), F.col("word").alias("id"), "n").withColumn("own", F.col("key") == F.col("id"))


def place_hashes(word: str) -> Iterator[str]:
    """The keys of a long word: of itself first, then of its open places and deletions, in time and rows that grow with its length."""
    size, powers, ahead = len(word), [1], [0]
    for c in word:
        ahead.append((ahead[-1] * BASE + ord(c)) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    whole = ahead[-1]
    yield f"-{size}:{whole:x}"
    if size <= LONG:
        return
    last = None
    for p in range(size):
        behind = (whole - ahead[p + 1] * powers[size - p - 1]) % PRIME
        yield f"*{size}:{p}:{ahead[p]:x}:{behind:x}"
        if word[p] != last:  # equal neighbours leave equal words
            last = word[p]
            yield f"-{size - 1}:{(ahead[p] * powers[size - p - 1] + behind) % PRIME:x}"


def long_keys(words: DataFrame) -> DataFrame:
    """(key, id, n, own) like short_keys, of words (id, word, n) of LONG code points or more. Those of exactly LONG have but themselves: the deletions of longer ones meet them."""
    schema = pa.schema([("key", pa.string()), ("id", pa.string()), ("n", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, n in zip(*b.columns, strict=True):
                keys, own = place_hashes(w.as_py()), True
                while part := list(islice(keys, 10_000)):
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([i.as_py()] * k), pa.array([n.as_py()] * k), pa.array([own] + [False] * (k - 1))], schema=schema)
                    own = False

    return words.select("id", "word", "n").mapInArrow(run, "key string, id string, n long, own boolean")


def nearest(keys: DataFrame) -> DataFrame:
    """(id, n, n_near, best struct<m, id>): of every word how many others it meets, and the most frequent of them (m is its count, negated; null if none).

    A group keeps its size and its top two by count, then code points. In a group of an open place each word meets all others: size - 1
    of them, the best of which is the first of the top two that isn't itself. In a group of a deletion only the word that the key
    is meets others: it meets them all, and each of them meets it. Two words meet in one group only. No group exceeds the alphabet times
    the word's length, and each member gives one row, not one for each other member.
    """
    by_key = Window.partitionBy("key").orderBy(F.desc("n"), "id")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.when(F.col("own"), F.struct((-F.col("n")).alias("m"), "id"))
    top = lambda k: F.struct((-F.nth_value("n", k).over(whole)).alias("m"), F.nth_value("id", k).over(whole).alias("id"))
    g = keys.select("key", "id", "n", F.col("own"), F.count("*").over(whole).alias("size"), top(1).alias("first"), top(2).alias("second"), F.max(own).over(whole).alias("called"))
    other = F.when(F.col("first.id") != F.col("id"), F.col("first")).otherwise(F.when(F.col("size") > 1, F.col("second")))
    open_place = F.col("key").contains("*")
    met = F.when(open_place | F.col("own"), F.col("size") - 1).when(F.col("called").isNotNull(), 1).otherwise(0)
    best = F.when(open_place | F.col("own"), other).otherwise(F.col("called"))
    rows = g.select("id", "n", met.cast("long").alias("met"), best.alias("best")).filter((F.col("met") > 0) | F.col("own"))
    return rows.groupBy("id", "n").agg(F.sum("met").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(id, root): the last form that following forms leads to, by pointer doubling, each round written.

    Counts grow along a chain by RATIO at least, so there are no cycles, and as many rounds as the logarithm of the longest chain.
    """
    r, turn = written(forms.select("id", F.col("form").alias("root")), "roots0", folder), 0
    while True:
        ahead = r.select(F.col("id").alias("at"), F.col("root").alias("further"))
        turn += 1
        step = written(r.join(ahead, F.col("root") == F.col("at"), "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots{turn}", folder)
        r = step.select("id", "root")
        if step.filter("moved").isEmpty():
            return r


def spelling_variants(docs: DataFrame, noise: int | None = 31, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that word_counts gives.

    Words are near if one inserted, deleted or replaced code point makes one the other; n_near counts them. form is the near word of
    largest n (ties: the first by code points) where that is RATIO times the word's own n at least, else null; root is what following forms
    ends at, the word itself without one.

    Null and empty texts have no words; a null id counts as '' in the noise. Texts and words are read whole: words of more than LONG code
    points meet by 127-bit hashes of their places, and travel as their first LONG code points and their rank. Repeated rows count as often
    as they are there; extra columns are not read, whatever their names; no documents give no rows.
    """
    folder = shared_folder(docs.sparkSession)
    words = written(word_counts(docs, noise, text, id_col), "words", folder)
    short, n_long = words.filter(F.length("word") <= LONG), words.filter(F.length("word") > LONG).count()
    keys, names = short_keys(short), None
    if n_long:
        ranked = words.filter(F.length("word") > LONG).orderBy("word").withColumn("rank", F.monotonically_increasing_id())
        names = written(ranked.select(F.concat(F.left("word", F.lit(LONG)), F.lit("~"), F.lpad(F.col("rank").cast("string"), 20, "0")).alias("id"), "word", "n"), "long", folder)
        edge = short.filter(F.length("word") == LONG).select(F.col("word").alias("id"), "word", "n")
        keys = keys.unionByName(long_keys(names.unionByName(edge)))
    near = nearest(keys).select("id", "n", "n_near", F.when(-F.col("best.m") >= RATIO * F.col("n"), F.col("best.id")).alias("form"), (-F.col("best.m")).alias("m"))
    near = written(near, "near", folder)
    out = near.join(roots(near.filter("form is not null"), folder), "id", "left").select(F.col("id").alias("word"), "form", F.coalesce("root", "id").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("m")).alias("form_n"))
    if names is None:
        return out
    for c in ("word", "form", "root"):  # long words' stand-ins give way to the words
        name = names.select(F.col("id").alias("stand_in"), F.col("word").alias("full"))
        out = out.join(name, F.when(F.col(c).contains("~"), F.col(c)) == F.col("stand_in"), "left").withColumn(c, F.coalesce("full", c)).drop("stand_in", "full")
    return out
