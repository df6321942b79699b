"""Benchmark decontamination by a positional inverted index over the training documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, shared_folder, written

# Fixed value: what separates words, for texts whose A-Z are not lower-cased yet.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_BYTES = 64_000_000
#: Stands for a null id in joins, and for the end of a document among its postings (no word is empty).
NO_ID, END = -(1 << 63), ""
#: Farther than any two words of a context stand apart.
FAR = 1 << 30
DOC = ["i", "h"]


def word_list(text: Column) -> Column:
    """Words of a text with A-Z in lower case, null for null."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(text)
    w = F.filter(F.split(lower, SEPARATORS), lambda x: x != "")
    return F.when(F.octet_length(text) == F.length(text), w).otherwise(F.transform(w, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, UPPER.lower()))))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marked for broadcast where its counted rows of about row_bytes each are within BROADCAST_BYTES; beyond that it is shuffled."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id string, first, n, words) of every run of `window` words; an item of fewer, but some, is one."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), word_list(F.col("text")).alias("w")).filter("item_id is not null and size(w) > 0").distinct()
    n = F.least(F.size("w"), F.lit(window))
    return w.select("item_id", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("first", "words"))


def document_key(text: str = "text", id_col: str = "doc_id") -> list[Column]:
    """(i, h): the id (NO_ID for null) and a hash of the text, by which a document is known."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text).alias("h")]


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, folder: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Positional postings (i, h, term, pos) of the given terms in all documents, stored in the shared folder. terms has distinct rows.

    A document is known by its id (NO_ID for null) and a hash of its text, so that rows that share an id but not the text stay
    apart. Its end is posted as term END, whose place is the number of words: one for every row, so the index alone says
    what documents there are. Texts are split into words once, here. An index over every term is build_index with every
    term; a run for a benchmark stores those of the benchmark.
    """
    w = F.concat(F.coalesce(word_list(F.col(text)), F.array().cast("array<string>")), F.array(F.lit(END)))
    d = docs.select(*document_key(text, id_col), F.posexplode(w).alias("pos", "term"))
    wanted = terms.unionByName(terms.sparkSession.createDataFrame([(END,)], "term string"))
    return written(d.join(small(wanted, n_terms + 1, 64), "term").select(*DOC, "term", "pos"), "postings", folder)


def term_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): postings of each given term, 0 for those without."""
    return terms.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def anchored(windows: DataFrame, counts: DataFrame, by: tuple[str, ...] = ("item_id", "first")) -> DataFrame:
    """windows, known by `by`, with their two rarest places: (…, a, a_term, b, b_term); b is null in a window of one word. Windows with a term that no document has are left out."""
    t = windows.select(*by, F.posexplode("words").alias("at", "term")).join(counts, "term")
    r = F.row_number().over(Window.partitionBy(*by).orderBy("df", "at"))
    t = t.withColumns({"r": r, "least": F.min("df").over(Window.partitionBy(*by))}).filter("least > 0 and r <= 2")
    pick = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    two = t.groupBy(*by).agg(pick(1, "at").alias("a"), pick(1, "term").alias("a_term"), pick(2, "at").alias("b"), pick(2, "term").alias("b_term"))
    return windows.join(two, [*by])


def indexed(docs: DataFrame, items: DataFrame, window: int, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(windows, anchors, postings, folder): the benchmark's windows, those that may occur with their rarest terms, and the index over all their terms. With once, a window has each of its words once, and items may share an id."""
    folder = shared_folder(docs.sparkSession)
    windows = benchmark_windows(items, window)
    windows = written(windows.withColumn("words", F.array_distinct("words")) if once else windows, "windows", folder)
    terms = written(windows.select(F.explode("words").alias("term")).distinct(), "terms", folder)
    postings = build_index(docs, terms, terms.count(), folder)
    counts = term_counts(postings, terms)
    ask = written(anchored(windows, counts, ("item_id", "first", "words")) if once else anchored(windows, counts), "anchors", folder)
    return windows, ask, postings, folder


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(i, h, item_id, first, n, start): every exact occurrence of a window in a document (i, h); start counts its words from 0."""
    _, ask, postings, folder = indexed(docs, items, window)
    return intersect(ask, postings, folder)


def intersect(ask: DataFrame, postings: DataFrame, folder: str) -> DataFrame:
    """The occurrences of the windows of ask, by intersecting the posting lists of all their terms, each shifted by its place.

    Begins with the rarest term's list, then the second rarest's on (document, start); what both have is met with the lists of
    all other terms, read for the documents still in question only. Repeated rows of a document give their matches once.
    """
    n, width = ask.count(), 64 * (WINDOW + 4)
    lead = small(ask.select("item_id", "first", "n", "words", F.col("a_term").alias("term"), "a", "b", "b_term"), n, width)
    found = postings.join(lead, "term").withColumn("start", F.col("pos") - F.col("a")).filter("start >= 0").drop("pos", "term")
    found = found.withColumn("p", F.col("start") + F.col("b"))
    other = written(ask.filter("b_term is not null").select(F.col("b_term").alias("term")).distinct(), "second", folder)
    second = postings.join(small(other, other.count(), 64), "term", "left_semi").select(F.col("i").alias("i2"), F.col("h").alias("h2"), F.col("pos").alias("p2"), F.col("term").alias("t2"))
    met = found.filter("b is not null").join(second, (F.col("i") == F.col("i2")) & (F.col("h") == F.col("h2")) & (F.col("p") == F.col("p2")) & (F.col("b_term") == F.col("t2")), "left_semi")
    both = met.unionByName(found.filter("b is null")).select(*DOC, "item_id", "first", "n", "words", "start", "a", "b").distinct()
    both = written(both, "aligned", folder)
    ids = written(both.select(*DOC).distinct(), "ids", folder)
    lists = postings.filter(F.col("term") != END).join(small(ids, ids.count(), 32), DOC, "left_semi").select(*DOC, "pos", "term")
    by = [*DOC, "item_id", "first", "n", "start"]
    rest = both.select(*by, "a", "b", F.posexplode("words").alias("at", "term")).filter("at <> a and (b is null or at <> b)").withColumn("pos", F.col("start") + F.col("at"))
    full = rest.join(lists, [*DOC, "pos", "term"], "left_semi").groupBy(*by).agg(F.count("*").alias("k")).filter("k = n - 2").drop("k")
    return full.unionByName(both.filter("n <= 2").select(*by))


def places(ask: DataFrame, postings: DataFrame, slop: int, span: int, folder: str) -> DataFrame:
    """(i, h, cell, pair): the cells of `span` words in which a window's rarest word stands with the second rarest near enough. pair is a hash of the two.

    Only the postings of those words are shuffled, in narrow rows; the second ones are met in the cells that they may stand in, and add no rows.
    """
    cell = lambda x: F.floor(x / span).cast("int")
    pairs = written(ask.groupBy("pair", "a_term", "b_term").agg((F.max("n") + slop).alias("reach")), "pairs", folder)
    n = pairs.count()
    lead = postings.join(small(pairs.withColumnRenamed("a_term", "term"), n, 160), "term").select(*DOC, "pos", "pair", "b_term", "reach")
    lead = lead.withColumn("c", F.explode(F.sequence(cell(F.col("pos") - F.col("reach") + 1), cell(F.col("pos") + F.col("reach") - 1))))
    other = pairs.select(F.col("b_term").alias("term")).distinct()
    second = postings.join(small(other, n, 64), "term", "left_semi").select(F.col("i").alias("i2"), F.col("h").alias("h2"), F.col("term").alias("t2"), F.col("pos").alias("p2"), cell(F.col("pos")).alias("c2"))
    same = (F.col("i") == F.col("i2")) & (F.col("h") == F.col("h2")) & (F.col("b_term") == F.col("t2")) & (F.col("c") == F.col("c2"))
    near = lead.join(second, same & (F.abs(F.col("pos") - F.col("p2")) < F.col("reach")), "left_semi")
    return written(near.select(*DOC, cell(F.col("pos")).alias("cell"), "pair").distinct(), "places", folder)


def least_span(words: str, around: str, most: Column) -> Column:
    """Length of the shortest run in the array `around` that has all of the distinct words; null where none of at most `most` has."""
    hits = F.filter(F.transform(around, lambda y, k: F.struct(F.array_position(words, y).alias("word"), k.alias("at"))), lambda x: x["word"] > 0)
    start = F.struct(F.array_repeat(F.lit(-FAR), F.size(words)).alias("last"), F.lit(0).alias("at"), F.lit(FAR).alias("best"))
    best = lambda s: F.least(s["best"], s["at"] - F.array_min(s["last"]) + 1)
    seen = lambda s, x: F.transform(s["last"], lambda v, j: F.when(j + 1 == x["word"], x["at"]).otherwise(v))
    return F.aggregate(hits, start, lambda s, x: F.struct(seen(s, x).alias("last"), x["at"].alias("at"), best(s).alias("best")), lambda s: F.when(best(s) <= most, best(s)))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, first, distance): windows all of whose words stand within n + slop words of the document, in any order; distance is the least such span's length.

    A word counts once however often the window has it. The postings of each window's two rarest words say where it may be: in a cell as wide as
    a span can be, so that all its spans there lie in the cell and its neighbours. Those words are cut from the document's text, and windows are judged
    where they are cut, so that only matches leave a task; so docs is read twice. Null texts and texts without words match nothing; repeated rows give their matches once, rows of one id with different texts that of the nearest.
    """
    _, ask, postings, folder = indexed(docs, items, window, once=True)
    span = window + slop
    second = F.coalesce("b_term", "a_term")
    ask = ask.select("item_id", "first", "n", "words", "a_term", second.alias("b_term"), F.xxhash64("a_term", second).alias("pair"))
    near = places(ask, postings, slop, span, folder)
    by_doc = near.groupBy(*DOC).agg(F.collect_list(F.struct("cell", "pair")).alias("near"))
    texts = docs.select(*document_key(), "text").join(small(by_doc, near.count(), 64), DOC).select("i", "near", word_list(F.col("text")).alias("w"))
    around = lambda x: F.struct(x["pair"].alias("pair"), F.slice("w", F.greatest(F.lit(1), (x["cell"] - 1) * span + 1), F.lit(3 * span)).alias("around"))
    cut = texts.select("i", F.inline(F.transform("near", around)))
    found = cut.join(small(ask.drop("a_term", "b_term"), ask.count(), 64 * (window + 4)), "pair").filter(F.forall("words", lambda x: F.array_contains("around", x)))
    out = found.groupBy(F.nullif("i", F.lit(NO_ID)).alias("doc_id"), "item_id", "first").agg(F.min(least_span("words", "around", F.col("n") + slop)).alias("distance"))
    return out.filter("distance is not null")


def marked(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """(i, h, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs, known by its id and a hash of its text.

    Covered words are counted from the occurrences in order of their starts, so that overlapping ones count once, whatever their lengths.
    """
    _, ask, postings, folder = indexed(docs, items, window)
    m = written(intersect(ask, postings, folder), "matches", folder)
    by_doc = Window.partitionBy(*DOC).orderBy("start", "end")
    s = m.select(*DOC, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    s = s.withColumn("reached", F.coalesce(F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = s.groupBy(*DOC).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))).cast("long").alias("n_hit"))
    names = m.select(*DOC, "item_id").distinct().groupBy(*DOC).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("names"))
    out = postings.filter(F.col("term") == END).select(*DOC, F.col("pos").cast("long").alias("n_words")).join(hit.join(names, DOC), DOC, "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(*DOC, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    A word inside any occurrence of a window is hit, once; contaminated means n_hit > 0 and share * n_hit >= n_words. A null
    text has no words; texts are read whole at any length. Rows without id are judged like others; rows that share an id are judged each by its own
    text, and repeated rows come back as often. Items without id or words have no windows. No documents give no rows, no items no hits.
    """
    return marked(docs, items, window, share).select(F.nullif("i", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that aren't contaminated, as they are, whatever their columns' names."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bad = marked(d, items).filter("contaminated").select(*DOC).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(f"`{text}`").alias("h"))
    return rows.join(bad, DOC, "left_anti").select("row.*")
