"""Hybrid retrieval for many questions at once: BM25, cosine, weighted rank fusion, boosts, re-ranking, parent expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.best import best, in_order, rounded
from ..sources.shared import shared_folder, written

K1, B = 1.2, 0.75
CANDIDATES = 50
#: Documents, vectors and questions of a block, and how many scores are worked on at a time.
DOCS, VECTORS, ASKED, PAIRS = 4_096, 16_384, 2_048, 1 << 21
MOST_TASKS = 10_000
#: Bytes of text that are split at a time, and what stands between words.
SPLIT, WORD_ENDS = 8 << 20, r"[^a-z0-9à-ÿ]+"
#: Below every cosine.
NO_SCORE = -2.0


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; the same for index and question."""
    return F.filter(F.split(F.lower(text), WORD_ENDS), lambda t: t != "")


def word_counts(docs: DataFrame, key: str, text: Column, pattern: str, regex: bool = True) -> DataFrame:
    """(key, len, term, tf) of each row: how often each word of its text stands there, and a row with term '' that has one; len counts the words, a null text has none.

    Arrow splits SPLIT bytes of texts at a time. A row's counts are made where it is read: nothing is shuffled, and no table of words is held.
    """
    d = docs.select(key, F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, b.num_rows * SPLIT // max(1, b.nbytes))
            for i in range(0, b.num_rows, step):
                yield counted(b.slice(i, step), pattern, regex)

    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, len int, term string, tf long")


def counted(b: pa.RecordBatch, pattern: str, regex: bool) -> pa.RecordBatch:
    split = (pc.split_pattern_regex if regex else pc.split_pattern)(b.column(1), pattern=pattern)
    words, row = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    full = pc.not_equal(words, "")
    words, row = words.filter(full).dictionary_encode(), row[full.to_numpy(zero_copy_only=False)]
    size, known = np.bincount(row, minlength=b.num_rows), max(1, len(words.dictionary))
    pairs, tf = np.unique(row * known + words.indices.to_numpy(), return_counts=True)
    at = np.concatenate([pairs // known, np.arange(b.num_rows)])
    terms = pa.chunked_array([words.dictionary.take(pa.array(pairs % known)).cast(pa.string()), pa.array([""] * b.num_rows, pa.string())]).combine_chunks()
    tf = np.concatenate([tf, np.ones(b.num_rows, int)])
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(size[at].astype(np.int32)), terms, pa.array(tf)], names=[b.schema.names[0], "len", "term", "tf"])


def postings(docs: DataFrame, questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, len, term, tf) of the questions' terms in docs(key, text), and a row with term '' per document: an inverted index as a table, written once.

    Documents are split into words once, where they are read; only the questions' terms and each document's length leave the scan: the terms are written
    first, so that Spark knows their size and sends them to the documents. Rows are shuffled only where a key is repeated, to be counted as one document.
    """
    folder = shared_folder(docs.sparkSession)
    terms = questions.select(F.explode(tokens(F.col("question"))).alias("term")).distinct()
    terms = written(terms.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))), f"{folder}/asked")
    tf = word_counts(docs, key, F.lower("text"), WORD_ENDS).join(terms, "term", "left_semi")
    if docs.groupBy(key).count().filter("count > 1").head(1):
        tf = tf.groupBy(key, "len", "term").agg(F.sum("tf").alias("tf"))
    return written(tf.select(key, "len", "term", "tf"), f"{folder}/postings")


def bm25(docs: DataFrame, questions: DataFrame, key: str = "doc_id", k: int = CANDIDATES) -> DataFrame:
    """(qid, key, score, rank): Okapi BM25 of every question against docs(key, text), the k best of each, written; ties by key.

    Documents are dealt into blocks of about DOCS, questions into blocks of about ASKED, by hashes. Each pair of blocks is a task's group: it holds one
    block of scores and gives the k best of each of its questions. So what is shuffled grows with the postings, not with the pairs of documents and
    questions that share a word, and no frequent word is one task.
    """
    folder = shared_folder(docs.sparkSession)
    index = postings(docs, questions, key)
    stats = index.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    tf = index.filter("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = written(df.select("term", F.monotonically_increasing_id().alias("t"), idf.alias("idf"), "avg_len"), f"{folder}/terms")
    w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(terms, "term").select(key, "t", w.alias("w"))
    q = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")).join(terms, "term").select("qid", F.col("t").alias("asked"))
    blocks = [max(1, -(-n // size)) for n, size in ((stats.first()["n"] or 0, DOCS), (questions.count(), ASKED))]
    s = celled(scored, q, key, blocks, lambda d, a: summed(d, a, k))
    return written(top(s, key, k), f"{folder}/lexical")


def celled(rows: DataFrame, asked: DataFrame, key: str, blocks: list[int], f) -> DataFrame:
    """(qid, key, score) that f gives for each pair of a block of rows(key, ...) and a block of asked(qid, ...), dealt by hashes into so many blocks.

    Tasks grow in number with the pairs of blocks, so that what a task sorts and holds doesn't grow with the tables."""
    dealt = lambda c, n: F.pmod(F.xxhash64(F.lit(11), c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.select("*", dealt(key, blocks[0]).alias("_r")).select("*", each(blocks[1]).alias("_a"))
    b = asked.select("*", dealt("qid", blocks[1]).alias("_a")).select("*", each(blocks[0]).alias("_r"))
    types = [d.schema[c].dataType.simpleString() for d, c in ((asked, "qid"), (rows, key))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, keys, scores = f(left, right) if left.num_rows and right.num_rows else (right.column(0).slice(0, 0), left.column(0).slice(0, 0), pa.array([], pa.float64()))
        return pa.table([qids, keys, scores], names=["qid", key, "score"])

    tasks = min(blocks[0] * blocks[1], MOST_TASKS)
    a, b = (d.repartition(tasks, "_r", "_a") for d in (a, b))
    return a.groupBy("_r", "_a").cogroup(b.groupBy("_r", "_a")).applyInArrow(run, f"qid {types[0]}, `{key}` {types[1]}, score double")


def summed(rows: pa.Table, asked: pa.Table, k: int) -> tuple:
    """The k best keys of each question: weights of rows(key, t, w) summed over the terms of asked(qid, t)."""
    keys, qids = (t.column(0).combine_chunks().dictionary_encode("encode") for t in (rows, asked))
    place = in_order(keys.dictionary).to_numpy()
    where = np.empty(len(place), int)
    where[place] = np.arange(len(place))
    doc, t, w = where[keys.indices.to_numpy()], rows.column(1).to_numpy(), rows.column(2).to_numpy()
    own, at = np.unique(asked.column(1).to_numpy(), return_inverse=True)
    question = qids.indices.to_numpy()[np.argsort(at, kind="stable")]  # of each term in turn, the questions that have it
    many = np.bincount(at, minlength=len(own))
    first = np.cumsum(many) - many
    known = np.minimum(np.searchsorted(own, t), len(own) - 1)
    keep = np.flatnonzero(own[known] == t)
    keep = keep[np.argsort(doc[keep], kind="stable")]
    doc, t, w = doc[keep], known[keep], w[keep]
    scores, n = np.zeros((len(place), len(qids.dictionary))), len(qids.dictionary)
    pairs = np.cumsum(many[t])
    stops = [*np.searchsorted(pairs, np.arange(PAIRS, pairs[-1], PAIRS)), len(t)] if len(t) else []
    for a, b in zip([0, *stops], stops, strict=False):
        if a == b:
            continue
        times = many[t[a:b]]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[t[a:b]], times)
        low, high = doc[a], doc[b - 1] + 1
        flat = np.repeat(doc[a:b] - low, times) * n + question[inner]
        scores[low:high] += np.bincount(flat, np.repeat(w[a:b], times), (high - low) * n).reshape(-1, n)
    s = np.where(scores > 0, rounded(scores), -np.inf).T
    r, c = best(np.ascontiguousarray(s), k)
    return qids.dictionary.take(pa.array(r)), keys.dictionary.take(pa.array(place[c])), pa.array(s[r, c])


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", r).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays as it is. The length is found once a vector, not within a lambda, where each component would find it again."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n)).otherwise(v)


def unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat components of unit length, starts, lengths) of a column of arrays of doubles; -1 is the length of one that is null or holds a null. A zero vector stays as it is."""
    c = column.combine_chunks()
    flat = c.flatten()
    starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy())]).astype(int)
    x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(float)
    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    lengths = np.where(c.is_null().to_numpy(zero_copy_only=False) | (gaps[starts[1:]] > gaps[starts[:-1]]), -1, np.diff(starts))
    return x, starts[:-1], lengths


def rows_of(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    v = x[starts[:, None] + np.arange(length)]
    norm = np.sqrt((v * v).sum(1))
    return v / np.where(norm == 0, 1.0, norm)[:, None]


def nearest(vectors: pa.Table, asked: pa.Table, k: int) -> tuple:
    """The k best keys of each question by cosine: of vectors(key, v) and asked(qid, v); without a cosine, as between vectors of two lengths, the score is null and last."""
    vectors = vectors.take(in_order(vectors.column(0)))
    x, x_at, x_size = unit(vectors.column(1))
    y, y_at, y_size = unit(asked.column(1))
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    with np.errstate(invalid="ignore", over="ignore"):
        for size in np.unique(y_size):
            who, has = np.flatnonzero(y_size == size), np.flatnonzero(x_size == size) if size >= 0 else np.zeros(0, int)
            v, q = (rows_of(x, x_at[has], size), rows_of(y, y_at[who], size)) if size >= 0 else (np.zeros((0, 0)), np.zeros((len(who), 0)))
            step = max(1, PAIRS // max(1, len(x_at)))
            for a in range(0, len(who), step):
                s = np.full((len(who[a : a + step]), len(x_at)), NO_SCORE)
                c = rounded(q[a : a + step] @ v.T)
                s[:, has] = np.where(np.isnan(c), np.inf, c)  # Spark and SQL rank NaN first
                r, p = best(s, k)
                out.append((who[a : a + step][r], p, s[r, p]))
    r, p, s = (np.concatenate(z) for z in zip(*out, strict=True))
    scores = pa.array(np.where(np.isinf(s), np.nan, s), mask=s == NO_SCORE)
    return asked.column(0).take(pa.array(r)), vectors.column(0).take(pa.array(p)), scores


def vector_topk(vectors: DataFrame, questions: DataFrame, key: str = "vec_id", k: int = CANDIDATES) -> DataFrame:
    """(qid, key, score, rank) by exact cosine, the filter before the ranking, written. The questions are a stated set and meet all vectors, a block of about
    VECTORS against one of about ASKED at a time; of each pair of blocks only the k best of a question leave the task."""
    v = vectors.select(key, F.col("embedding").cast("array<double>").alias("v"))
    q = questions.select("qid", F.col("embedding").cast("array<double>").alias("v"))
    blocks = [max(1, -(-n // size)) for n, size in ((v.count(), VECTORS), (q.count(), ASKED))]
    s = celled(v, q, key, blocks, lambda a, b: nearest(a, b, k))
    return written(top(s, key, k), f"{shared_folder(vectors.sparkSession)}/nearest")


def rrf(lexical: DataFrame, vector: DataFrame, key: str, weights: tuple[float, float] = (0.6, 0.4), k: int = 60, limit: int = CANDIDATES) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists; a side without the row adds nothing; order by score, then key."""
    a = lexical.select("qid", key, F.col("rank").alias("lexical_rank"))
    b = vector.select("qid", key, F.col("rank").alias("vector_rank"))
    part = lambda w, r: F.coalesce(w / (k + F.col(r)), F.lit(0.0))
    j = a.join(b, ["qid", key], "full").withColumn("score", F.round(part(F.lit(weights[0]), "lexical_rank") + part(F.lit(weights[1]), "vector_rank"), 9))
    return top(j, key, limit)


def vector_guarantee(fused: DataFrame, lexical: DataFrame, vector: DataFrame, key: str, protect: int, limit: int, weights: tuple[float, float] = (0.6, 0.4), k: int = 60) -> DataFrame:
    """Fused rows, at most `limit` with the `protect` best by vector surely among them: (qid, key, score, lexical_rank, vector_rank, final_rank).

    Protected rows that fusion kept stay in place; those that it cut are appended in vector order with the score that fusion gives. The
    last unprotected rows make room for them.
    """
    v = vector.filter(F.col("rank") <= protect).select("qid", key, F.col("rank").alias("_v"))
    j = fused.select("qid", key, "score", "lexical_rank", "vector_rank", F.col("rank").alias("_f")).join(v, ["qid", key], "full")
    lost = F.col("_f").isNull()
    l = lexical.select("qid", key, F.col("rank").alias("_l"))
    j = j.join(l, ["qid", key], "left")
    score = F.round(F.coalesce(weights[0] / (k + F.col("_l")), F.lit(0.0)) + weights[1] / (k + F.col("_v")), 9)
    j = j.withColumns({"score": F.when(lost, score).otherwise(F.col("score")), "lexical_rank": F.when(lost, F.col("_l")).otherwise(F.col("lexical_rank")), "vector_rank": F.when(lost, F.col("_v")).otherwise(F.col("vector_rank"))})
    place = Window.partitionBy("qid").orderBy(lost, "_f", "_v")
    free = F.greatest(F.lit(limit) - F.count_if(F.col("_v").isNotNull()).over(Window.partitionBy("qid")), F.lit(0))
    before = F.count_if(F.col("_v").isNull()).over(place)
    j = j.withColumns({"_free": free, "_before": before}).filter(F.col("_v").isNotNull() | (F.col("_before") <= F.col("_free")))
    return j.withColumn("final_rank", F.row_number().over(place)).select("qid", key, "score", "lexical_rank", "vector_rank", "final_rank")


def merge_variants(hits: DataFrame, key: str, limit: int) -> DataFrame:
    """(qid, key, score, lexical_rank, vector_rank, rank) of hits(qid, variant, key, score, lexical_rank, vector_rank): scores of a question's variants added, ranks of the first variant that has the row."""
    g = hits.groupBy("qid", key).agg(F.round(F.sum("score"), 9).alias("score"), F.min_by("lexical_rank", "variant").alias("lexical_rank"), F.min_by("vector_rank", "variant").alias("vector_rank"))
    return top(g, key, limit)


def rerank_input(title: Column, section: Column, description: Column, content: Column, size: int = 2000) -> Column:
    """What a reranker or embedder reads: the parts that aren't empty, a line each, cut at `size` characters."""
    parts = F.filter(F.array(title, section, description, content), lambda x: x.isNotNull() & (x != ""))
    return F.substring(F.array_join(parts, "\n"), 1, size)


def degrade(fused: DataFrame, reranked: DataFrame, key: str, k: int) -> DataFrame:
    """(qid, key, final_rank, degraded, reason): the reranker's order where it answered for all of a question's rows, else the k best of the fused order.

    reranked(qid, key, rerank_rank, error): a null rank or any error degrades the question; the reason is its least error, or `incomplete`.
    """
    r = reranked.select("qid", key, "rerank_rank", "error")
    j = fused.select("qid", key, F.col("rank").alias("_f")).join(r, ["qid", key], "left")
    whole = Window.partitionBy("qid")
    error = F.min("error").over(whole)
    reason = F.coalesce(error, F.when(F.count_if(F.col("rerank_rank").isNull()).over(whole) > 0, "incomplete"))
    j = j.withColumn("reason", reason)
    order = F.when(F.col("reason").isNull(), F.col("rerank_rank")).otherwise(F.col("_f"))
    j = j.withColumn("final_rank", F.row_number().over(whole.orderBy(order, key))).filter(F.col("final_rank") <= k)
    return j.select("qid", key, "final_rank", F.col("reason").isNotNull().alias("degraded"), "reason")


def explicit_year(text: Column) -> Column:
    """The one year a text names, null where it names none or several."""
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])(20[0-9]{2})(?:[^0-9]|$)"), 1))
    return F.when(F.size(years) == 1, years[0])


def period_boost(scored: DataFrame, boost: float) -> DataFrame:
    """score times 1 + boost where question and title name the same one year, times 1 - boost where they name different ones."""
    a, b = explicit_year(F.col("question")), explicit_year(F.col("title"))
    factor = F.when(a.isNull() | b.isNull(), 1.0).when(a == b, 1.0 + boost).otherwise(1.0 - boost)
    return scored.withColumn("score", F.round(F.col("score") * factor, 9))


def char_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct characters that the text has."""
    q = F.array_distinct(F.split(question, ""))
    return F.size(F.array_intersect(q, F.array_distinct(F.split(text, "")))) / F.greatest(F.size(q), F.lit(1))


def rerank(candidates: DataFrame, key: str) -> DataFrame:
    s = F.round(char_overlap(F.col("question"), F.col("text")), 6)
    c = candidates.withColumn("rerank_score", s)
    return c.withColumn("rerank_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")))


def expand(hits: DataFrame, children: DataFrame) -> DataFrame:
    """Evidence: hits grouped by parent in order of the best hit, which is cited; the parent's text is its children in order, joined by blank lines."""
    g = hits.groupBy("qid", "parent_id").agg(F.min("rank").alias("position"), F.min_by("child_id", "rank").alias("cited"), F.count("*").alias("n_hits"))
    parents = children.join(g.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n\n").alias("content"))
    return g.join(parents, "parent_id")


def variants(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(qid, variant, position): each question first, then with each of its terms replaced by each alternative, without repeats."""
    own = questions.select("qid", F.col("question").alias("variant"), F.lit(0).alias("position"))
    alt = questions.join(F.broadcast(synonyms), F.col("question").contains(F.col("term")))
    alt = alt.select("qid", F.replace("question", "term", "alternative").alias("variant"), "position")
    return own.unionByName(alt).groupBy("qid", "variant").agg(F.min("position").alias("position"))


def term_count(text: Column, terms: list[str]) -> Column:
    """Non-overlapping occurrences of all terms."""
    total = F.lit(0)
    for t in terms:
        total = total + ((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("long")
    return total


def containing(docs: DataFrame, questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, key) of the documents that hold a question's whole text.

    A document with it holds all its words but the first and the last as whole words too: documents meet a question by the rarest of those, in
    equi-joins, and only these texts are searched. Questions of one or two words have none: as a stated query set they read all texts.
    """
    q = questions.filter("question <> ''").select("qid", "question", F.split("question", " ").alias("w"))
    inner = F.array_distinct(F.filter(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda x: x != ""))
    asked = q.select("qid", F.explode(inner).alias("term"))
    d = word_counts(docs.filter("text is not null"), key, F.col("text"), " ", regex=False).filter("term <> ''").join(asked.select("term").distinct(), "term", "left_semi")
    folder = shared_folder(docs.sparkSession)
    d = written(d.select(key, "term"), f"{folder}/words")
    rare = asked.join(d.groupBy("term").agg(F.count("*").alias("df")), "term", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("x"))
    rare = written(rare, f"{folder}/rare")  # a row a question: Spark knows its size
    met = d.join(rare.select("qid", "x.term"), "term").select("qid", key)
    short = q.join(rare.select("qid"), "qid", "left_anti").select("qid")
    met = met.unionByName(short.crossJoin(docs.select(key)))
    found = met.join(docs.select(key, "text"), key).join(q.select("qid", "question"), "qid")
    return found.filter(F.col("text").contains(F.col("question"))).select("qid", key)


def config_problems(vector_guarantee: Column, fusion_k: Column, timeout: Column, max_chars: Column, top_k: Column, candidate_k: Column, w_lexical: Column, w_vector: Column, rrf_k: Column, boost: Column, growth: Column) -> Column:
    """The names of the settings of a retrieval that can't work together, in a fixed order; empty for one that can. Null timeouts and lengths mean no limit."""
    broken = {
        "vector_guarantee": ~vector_guarantee.between(0, fusion_k), "rerank_timeout": timeout <= 0, "rerank_max_chars": max_chars <= 0, "top_k": top_k > fusion_k, "fusion_k": fusion_k > 2 * candidate_k,
        "weights": (w_lexical <= 0) & (w_vector <= 0), "rrf_k": rrf_k <= 0, "period_boost": ~((boost >= 0) & (boost < 1)), "oversample_growth": growth < 2,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]))
