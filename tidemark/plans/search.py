"""Registered queries of retrieval, evaluation, quality, reconciliation and diagnostics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitemporal as bt
from ..operators import quality as ql
from ..operators import retrieval as rt
from ..operators import textops as tx
from ..operators import vector_index as vi
from ..sources import projections as src
from ..sources.projections import ANNOUNCEMENT, BLOCK, DOCUMENT, PRICE, QUALITY, day_text, stamp

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOK = "list_filter(string_split_regex(lower({x}), '[^a-z0-9à-ÿ]+'), lambda t: t <> '')"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def questions(spark, sf):
    """The questions are all benchmark items."""
    return src.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def corpus(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", "text")


def vector_questions(spark, sf):
    return src.table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


BM25 = f"""q AS (SELECT item_id AS qid, text AS question FROM benchmark), qt AS (SELECT DISTINCT qid, unnest({TOK.format(x='question')}) AS term FROM q),
d AS (SELECT doc_id, {TOK.format(x='text')} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM d), tf AS (SELECT doc_id, any_value(len(ts)) AS len, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sc AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY qid, doc_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 50)"""
VEC = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), vs AS (SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id % 100 = 0),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM vs) WHERE rank <= 50)"""
FUSED = """rk AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.vec_id) AS doc_id, a.rank AS lexical_rank, b.rank AS vector_rank, round(coalesce(0.6 / (60 + a.rank), 0) + coalesce(0.4 / (60 + b.rank), 0), 9) AS score FROM lex a FULL JOIN vec b ON a.qid = b.qid AND a.doc_id = b.vec_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM rk) WHERE rank <= 50)"""


def lexical(spark, sf):
    return rt.bm25(corpus(spark, sf), questions(spark, sf))


def vector(spark, sf):
    return rt.vector_topk(src.table(spark, sf, "embeddings"), vector_questions(spark, sf)).withColumnRenamed("vec_id", "doc_id")


def fused(spark, sf):
    return rt.rrf(lexical(spark, sf), vector(spark, sf), "doc_id")


@query("bm25_topk", f"WITH {BM25} SELECT qid, doc_id, score, rank FROM lex")
def bm25_topk(spark, sf):
    return lexical(spark, sf)


@query("vector_topk", f"WITH {VEC} SELECT qid, vec_id AS doc_id, score, rank FROM vec")
def vector_topk(spark, sf):
    return vector(spark, sf)


@query("rrf_fuse", f"WITH {BM25}, {VEC}, {FUSED} SELECT qid, doc_id, score, rank, lexical_rank, vector_rank FROM fused")
def rrf_fuse(spark, sf):
    return fused(spark, sf)


TOP12 = "SELECT * FROM fused WHERE rank <= 12"


@query("vector_guarantee", f"""WITH {BM25}, {VEC}, {FUSED}, f AS ({TOP12}), p AS (SELECT qid, vec_id AS doc_id, rank AS v FROM vec WHERE rank <= 5),
j AS (SELECT coalesce(f.qid, p.qid) AS qid, coalesce(f.doc_id, p.doc_id) AS doc_id, f.rank AS f, v, f.score, f.lexical_rank AS fl, f.vector_rank AS fv FROM f FULL JOIN p ON f.qid = p.qid AND f.doc_id = p.doc_id),
k AS (SELECT j.*, lex.rank AS l, greatest(12 - count(v) OVER (PARTITION BY j.qid), 0) AS free, count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY j.qid ORDER BY f IS NULL, f, v) AS before FROM j LEFT JOIN lex ON lex.qid = j.qid AND lex.doc_id = j.doc_id)
SELECT qid, doc_id, CASE WHEN f IS NULL THEN round(coalesce(0.6 / (60 + l), 0) + 0.4 / (60 + v), 9) ELSE score END AS score, CASE WHEN f IS NULL THEN l ELSE fl END AS lexical_rank, CASE WHEN f IS NULL THEN v ELSE fv END AS vector_rank, row_number() OVER (PARTITION BY qid ORDER BY f IS NULL, f, v) AS final_rank FROM k WHERE v IS NOT NULL OR before <= free""")
def vector_guarantee(spark, sf):
    """The fused list is cut at 12 before the guarantee, as by a request's limit, so that rows it cut come back."""
    l, v = lexical(spark, sf), vector(spark, sf)
    return rt.vector_guarantee(rt.rrf(l, v, "doc_id", limit=12), l, v, "doc_id", 5, 12)


@query("merge_variants", f"""WITH {BM25}, {VEC}, {FUSED}, h AS (SELECT qid, 0 AS variant, doc_id, score, lexical_rank, vector_rank FROM fused UNION ALL SELECT qid, 1, doc_id, round(0.6 / (60 + rank), 9), rank, NULL FROM lex WHERE rank <= 20 UNION ALL SELECT qid, 2, vec_id, round(0.4 / (60 + rank), 9), NULL, rank FROM vec WHERE rank <= 20),
g AS (SELECT qid, doc_id, round(sum(score), 9) AS score, arg_min(struct_pack(l := lexical_rank, v := vector_rank), variant) AS x FROM h GROUP BY ALL)
SELECT qid, doc_id, score, x.l AS lexical_rank, x.v AS vector_rank, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 50""")
def merge_variants(spark, sf):
    l, v = lexical(spark, sf), vector(spark, sf)
    none, part = F.lit(None).cast("int"), lambda w: F.round(w / (60 + F.col("rank")), 9)
    one = rt.rrf(l, v, "doc_id").select("qid", F.lit(0).alias("variant"), "doc_id", "score", "lexical_rank", "vector_rank")
    two = l.filter("rank <= 20").select("qid", F.lit(1).alias("variant"), "doc_id", part(F.lit(0.6)).alias("score"), F.col("rank").alias("lexical_rank"), none.alias("vector_rank"))
    three = v.filter("rank <= 20").select("qid", F.lit(2).alias("variant"), "doc_id", part(F.lit(0.4)).alias("score"), none.alias("lexical_rank"), F.col("rank").alias("vector_rank"))
    return rt.merge_variants(one.unionByName(two).unionByName(three), "doc_id", 50)


@query("rerank_input", f"""WITH {DOCUMENT}, {BLOCK}, x AS (SELECT block_id, substr(list_aggregate(list_filter([doc_type, CASE WHEN ordinal % 3 = 0 THEN '' ELSE source || '/' || page END, CASE WHEN ordinal % 2 = 0 THEN 'lines of page ' || page END, content], lambda p: p IS NOT NULL AND p <> ''), 'string_agg', chr(10)), 1, 2000) AS t FROM doc_block) SELECT block_id, length(t) AS n, sha256(t) AS digest FROM x""")
def rerank_input(spark, sf):
    page = F.col("page").cast("string")
    t = rt.rerank_input(F.col("doc_type"), F.when(F.col("ordinal") % 3 == 0, "").otherwise(F.concat("source", F.lit("/"), page)), F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("lines of page "), page)), F.col("content"))
    return src.doc_block(spark, sf).select("block_id", t.alias("t")).select("block_id", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"))


@query("rerank_degrade", f"""WITH {BM25}, r AS (SELECT qid, doc_id, rank, CASE WHEN qid % 4 = 1 AND doc_id % 5 = 0 THEN NULL ELSE -rank END AS rr, CASE WHEN qid % 4 = 2 AND doc_id % 7 = 0 THEN 'timeout' END AS e FROM lex),
w AS (SELECT *, coalesce(min(e) OVER (PARTITION BY qid), CASE WHEN count(*) FILTER (WHERE rr IS NULL) OVER (PARTITION BY qid) > 0 THEN 'incomplete' END) AS reason FROM r)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN reason IS NULL THEN rr ELSE rank END, doc_id) AS final_rank, reason IS NOT NULL AS degraded, reason FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN reason IS NULL THEN rr ELSE rank END, doc_id) <= 8""")
def rerank_degrade(spark, sf):
    l = lexical(spark, sf)
    r = l.select("qid", "doc_id", F.when(~((F.col("qid") % 4 == 1) & (F.col("doc_id") % 5 == 0)), -F.col("rank")).alias("rerank_rank"), F.when((F.col("qid") % 4 == 2) & (F.col("doc_id") % 7 == 0), "timeout").alias("error"))
    return rt.degrade(l, r, "doc_id", 8)


@query("period_boost", f"""WITH {BM25}, t AS (SELECT qid, lex.doc_id, score, 'report ' || (2020 + qid % 3) || ' of item' AS question, source || ' ' || (2020 + lex.doc_id % 4) || CASE WHEN lex.doc_id % 5 = 0 THEN ' and 2023' ELSE '' END AS title FROM lex JOIN documents d ON lex.doc_id = d.doc_id),
y AS (SELECT *, 2020 + qid % 3 AS a, CASE WHEN doc_id % 5 = 0 AND doc_id % 4 <> 3 THEN NULL ELSE 2020 + doc_id % 4 END AS b FROM t) SELECT qid, doc_id, round(score * CASE WHEN b IS NULL THEN 1.0 WHEN a = b THEN 1.2 ELSE 0.8 END, 9) AS score FROM y""")
def period_boost(spark, sf):
    d = src.table(spark, sf, "documents").select("doc_id", "source")
    year = (2020 + F.col("doc_id") % 4).cast("string")
    s = lexical(spark, sf).join(d, "doc_id").withColumns({"question": F.concat(F.lit("report "), (2020 + F.col("qid") % 3).cast("string"), F.lit(" of item")), "title": F.concat(F.col("source"), F.lit(" "), year, F.when(F.col("doc_id") % 5 == 0, " and 2023").otherwise(""))})
    return rt.period_boost(s, 0.2).select("qid", "doc_id", "score")


@query("rerank_overlap", f"""WITH {BM25}, c AS (SELECT lex.*, question, text FROM lex JOIN q USING (qid) JOIN documents USING (doc_id)),
s AS (SELECT *, round(len(list_intersect(list_distinct(string_split(question, '')), list_distinct(string_split(text, '')))) / greatest(len(list_distinct(string_split(question, ''))), 1), 6) AS rerank_score FROM c)
SELECT qid, doc_id, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank) AS rerank_rank FROM s""")
def rerank_overlap(spark, sf):
    c = lexical(spark, sf).join(questions(spark, sf), "qid").join(corpus(spark, sf), "doc_id")
    return rt.rerank(c, "doc_id").select("qid", "doc_id", "rerank_score", "rerank_rank")


@query("expand_evidence", f"""WITH {BM25}, {DOCUMENT}, {BLOCK}, t AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id, ordinal) AS rank, block_id AS child_id, doc_id || '/' || page AS parent_id FROM lex JOIN doc_block USING (doc_id) WHERE rank <= 10), g AS (SELECT qid, parent_id, min(rank) AS position, arg_min(child_id, rank) AS cited, count(*) AS n_hits FROM t GROUP BY ALL),
p AS (SELECT doc_id || '/' || page AS parent_id, string_agg(content, chr(10) || chr(10) ORDER BY ordinal) AS content FROM doc_block GROUP BY ALL) SELECT qid, parent_id, position, cited, n_hits, sha256(content) AS digest FROM g JOIN p USING (parent_id)""")
def expand_evidence(spark, sf):
    """The hits are all blocks of a question's ten best documents, the parents their pages."""
    b = src.doc_block(spark, sf).withColumn("parent_id", F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("page").cast("string")))
    hits = lexical(spark, sf).filter("rank <= 10").join(b.select("doc_id", "ordinal", F.col("block_id").alias("child_id"), "parent_id"), "doc_id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc_id", "ordinal")))
    return rt.expand(hits, b.select("parent_id", F.col("block_id").alias("child_id"), "ordinal", "content")).select("qid", "parent_id", "position", "cited", "n_hits", F.sha2("content", 256).alias("digest"))


@query("retrieval_trace", f"""WITH {BM25}, {VEC}, {FUSED} SELECT qid, doc_id, l.rank AS lexical_rank, v.rank AS vector_rank, f.rank AS fused_rank, CASE WHEN f.rank <= 10 THEN f.rank END AS final_rank FROM (SELECT qid, doc_id, rank FROM lex) l FULL JOIN (SELECT qid, vec_id AS doc_id, rank FROM vec) v USING (qid, doc_id) FULL JOIN (SELECT qid, doc_id, rank FROM fused) f USING (qid, doc_id)""")
def retrieval_trace(spark, sf):
    l, v = lexical(spark, sf), vector(spark, sf)
    f = rt.rrf(l, v, "doc_id").select("qid", "doc_id", F.col("rank").alias("fused_rank"))
    t = l.select("qid", "doc_id", F.col("rank").alias("lexical_rank")).join(v.select("qid", "doc_id", F.col("rank").alias("vector_rank")), ["qid", "doc_id"], "full").join(f, ["qid", "doc_id"], "full")
    return t.withColumn("final_rank", F.when(F.col("fused_rank") <= 10, F.col("fused_rank")))


SYN = [("the", "a", 1), ("of", "from", 2), ("de", "du", 3), ("la", "le", 4)]


@query("synonym_variants", f"""WITH q AS (SELECT item_id AS qid, text AS question FROM benchmark), s(term, alternative, position) AS (VALUES {', '.join(map(str, SYN))})
SELECT qid, variant, min(position) AS position FROM (SELECT qid, question AS variant, 0 AS position FROM q UNION ALL SELECT qid, replace(question, term, alternative), position FROM q JOIN s ON contains(question, term)) GROUP BY ALL""")
def synonym_variants(spark, sf):
    q = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return rt.variants(q, spark.createDataFrame(SYN, "term string, alternative string, position int"))


@query("term_count_search", "SELECT doc_id, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 + (length(text) - length(replace(text, 'und', ''))) // 3 AS BIGINT) AS score FROM documents")
def term_count_search(spark, sf):
    return corpus(spark, sf).select("doc_id", rt.term_count(F.col("text"), ["tion", "und"]).alias("score"))


@query("index_topk", f"WITH {VEC} SELECT qid, vec_id, score, rank FROM vec WHERE rank <= 10")
def index_topk(spark, sf):
    return vi.search(vi.build(src.table(spark, sf, "embeddings")), vector_questions(spark, sf))[0]


@query("index_filtered_topk", f"WITH {VEC}, f AS (SELECT qid, vs.vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vs.vec_id) AS rank FROM vs JOIN embeddings USING (vec_id) WHERE label = 3 OR vec_id % 20 = 7) SELECT * FROM f WHERE rank <= 10")
def index_filtered_topk(spark, sf):
    """A filter that few vectors pass and the index doesn't know: it is asked deeper until ten of each question survive."""
    v = src.table(spark, sf, "embeddings")
    return vi.filtered_search(vi.build(v), vector_questions(spark, sf), v.filter("label = 3 or vec_id % 20 = 7"))


@query("index_recall", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
s AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 AS scale FROM u), c AS (SELECT *, list_transform(e, lambda x: floor(x / scale + 0.5)) AS code FROM s),
b AS (SELECT vec_id, e, scale, code, sqrt(list_sum(list_transform(list_zip(e, code), lambda z: (z[1] - z[2] * scale) ** 2))) AS err FROM c),
p AS (SELECT q.vec_id AS qid, b.vec_id, list_inner_product(b.code, q.e) * b.scale AS s, b.err FROM b, u q WHERE q.vec_id % 100 = 0),
t AS (SELECT qid, s - err AS bar FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s - err DESC) = 10), n AS (SELECT p.qid, count(*) AS n FROM p JOIN t ON p.qid = t.qid WHERE s + err >= bar - 0.000002 GROUP BY 1)
SELECT 1.0 AS recall, count(*) AS n, round(avg(n / (SELECT count(*) FROM v)), 4) AS share FROM n""")
def index_recall(spark, sf):
    """Of the ten best by exact scan all are found; the SQL counts the candidates by the same bounds, as no cell of these vectors can be skipped."""
    v, q = src.table(spark, sf, "embeddings"), vector_questions(spark, sf)
    index = vi.build(v)
    found, compared = vi.search(index, q)
    return vi.recall(index, found, compared, rt.vector_topk(v, q, k=10))


GOLD = "gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark, sf):
    return rt.containing(corpus(spark, sf), questions(spark, sf))


EVAL = f"{BM25}, {GOLD}, ev AS (SELECT g.qid, b.best IS NOT NULL AS hit, round(coalesce(1 / b.best, 0.0), 6) AS rr FROM (SELECT DISTINCT qid FROM gold) g LEFT JOIN (SELECT gold.qid, min(rank) AS best FROM gold JOIN lex ON gold.qid = lex.qid AND gold.doc_id = lex.doc_id AND rank <= 10 GROUP BY gold.qid) b ON g.qid = b.qid)"


@query("eval_recall_mrr", f"WITH {EVAL} SELECT qid, hit, rr FROM ev")
def eval_recall_mrr(spark, sf):
    return ql.recall_mrr(gold(spark, sf), lexical(spark, sf), "doc_id", 10)


GROUPS = "gr AS (SELECT qid % 3 AS bucket, count(*) AS n, round(avg(CAST(hit AS DOUBLE)), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) >= 10 AS gated FROM ev GROUP BY 1)"


@query("eval_grouped", f"WITH {EVAL}, {GROUPS} SELECT * FROM gr")
def eval_grouped(spark, sf):
    return ql.grouped(eval_recall_mrr(spark, sf).withColumn("bucket", F.col("qid") % 3), "bucket")


@query("eval_gate", f"WITH {EVAL}, {GROUPS} SELECT bucket, CASE WHEN bucket = 1 THEN 'incomparable' WHEN recall - (recall - CASE WHEN bucket = 2 THEN 0.9 ELSE 0 END) <= 1.0 / n + 1e-9 THEN 'pass' ELSE 'fail' END AS verdict FROM gr")
def eval_gate(spark, sf):
    a = eval_grouped(spark, sf)
    b = a.withColumns({"n": F.when(F.col("bucket") == 1, F.col("n") + 1).otherwise(F.col("n")), "recall": F.col("recall") - F.when(F.col("bucket") == 2, 0.9).otherwise(0.0)})
    return ql.regression_gate(a, b, "bucket")


@query("eval_nearest_rank", "SELECT event_type, list_sort(list(value))[greatest(CAST(ceil(0.95 * count(*)) AS BIGINT), 1)] AS value FROM events GROUP BY event_type")
def eval_nearest_rank(spark, sf):
    return ql.nearest_rank(src.table(spark, sf, "events"), ["event_type"], "value", 0.95)


@query("wilson_interval", """WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 50) AS h, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, h / n AS p FROM g)
SELECT event_type, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM p""")
def wilson_interval(spark, sf):
    g = src.table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("h"), F.count("*").alias("n"))
    low, high = ql.wilson(F.col("h"), F.col("n"))
    return g.select("event_type", low.alias("low"), high.alias("high"))


SAMPLE = "row_number() OVER (PARTITION BY source ORDER BY sha256('day1' || doc_id), doc_id) AS turn"


@query("stratified_sample", f"WITH r AS (SELECT doc_id, source, {SAMPLE} FROM documents) SELECT doc_id, source, turn FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN turn <= 2 THEN 0 ELSE turn END, turn, source) AS place FROM r) WHERE place <= 70")
def stratified_sample(spark, sf):
    return ql.stratified_sample(src.table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 70, 2, "day1")


@query("quota_sample", f"SELECT * FROM (SELECT doc_id, source, {SAMPLE} FROM documents) WHERE turn <= 5")
def quota_sample(spark, sf):
    return ql.quota_sample(src.table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 5, "day1")


@query("seeded_daily_sample", "SELECT doc_id FROM documents ORDER BY sha256('2024-01-05' || doc_id), doc_id LIMIT 200")
def seeded_daily_sample(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("2024-01-05"), F.col("doc_id").cast("string")), 256), "doc_id").limit(200)


# Quality -----------------------------------------------------------------------------------------------------------


@query("gate_parse_success", "SELECT 'parse_success' AS metric, v AS value, CAST(0.98 AS DOUBLE) AS threshold, v >= 0.98 AS passed FROM (SELECT round(coalesce(count(*) FILTER (WHERE event_type <> 'error') / nullif(count(*), 0), 1.0), 6) AS v FROM events)")
def gate_parse_success(spark, sf):
    return ql.gate(src.table(spark, sf, "events"), "parse_success", ql.rate(F.col("event_type") != "error"), 0.98)


@query("gate_closure", "SELECT 'closure' AS metric, v AS value, CAST(0.95 AS DOUBLE) AS threshold, v >= 0.95 AS passed FROM (SELECT round(coalesce(count(*) FILTER (WHERE n_chars = length(text)) / nullif(count(*), 0), 1.0), 6) AS v FROM documents)")
def gate_closure(spark, sf):
    return ql.gate(src.table(spark, sf, "documents"), "closure", ql.rate(F.col("n_chars") == F.length("text")), 0.95)


@query("gate_confidence_p50", "SELECT 'confidence_p50' AS metric, v AS value, CAST(0.8 AS DOUBLE) AS threshold, v >= 0.8 AS passed FROM (SELECT round(coalesce(quantile_cont(value / 100, 0.5), -1.0), 6) AS v FROM events)")
def gate_confidence_p50(spark, sf):
    e = src.table(spark, sf, "events").select((F.col("value") / 100).alias("value"))
    return ql.gate(ql.percentiles(e, [], "value", {"p": 0.5}), "confidence_p50", F.coalesce(F.max("p"), F.lit(-1.0)), 0.8)


@query("gate_orphans", "SELECT 'orphans' AS metric, v AS value, CAST(0 AS DOUBLE) AS threshold, v <= 0 AS passed FROM (SELECT CAST(count(*) AS DOUBLE) AS v FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))")
def gate_orphans(spark, sf):
    d = src.table(spark, sf, "documents").join(src.table(spark, sf, "labels"), "doc_id", "left_anti")
    return ql.gate(d, "orphans", F.count("*").cast("double"), 0.0, higher=False)


@query("gate_leaf_length", f"""WITH {DOCUMENT}, {BLOCK}, e AS (SELECT *, lead(block_id) OVER w IS NULL OR lead(page) OVER w <> page OR lead(source) OVER w <> source AS exempt FROM doc_block WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))
SELECT 'leaf_length' AS metric, v AS value, CAST(0.9 AS DOUBLE) AS threshold, v >= 0.9 AS passed FROM (SELECT round(coalesce(count(*) FILTER (WHERE exempt OR length(content) BETWEEN 100 AND 800) / nullif(count(*), 0), 1.0), 6) AS v FROM e)""")
def gate_leaf_length(spark, sf):
    b = tx.hard_boundary(src.doc_block(spark, sf))
    return ql.gate(b, "leaf_length", ql.rate(F.col("exempt") | F.length("content").between(100, 800)), 0.9)


@query("gate_vector_coverage", "SELECT 'vector_coverage' AS metric, v AS value, CAST(1 AS DOUBLE) AS threshold, v >= 1 AS passed FROM (SELECT round(coalesce(count(e.vec_id) / nullif(count(*), 0), 1.0), 6) AS v FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)")
def gate_vector_coverage(spark, sf):
    d = src.table(spark, sf, "documents").select("doc_id").join(src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("there")), "doc_id", "left")
    return ql.gate(d, "vector_coverage", ql.rate(F.col("there")), 1.0)


@query("gate_latency", "SELECT 'latency_p95' AS metric, v AS value, CAST(15 AS DOUBLE) AS threshold, v <= 15 AS passed FROM (SELECT round(coalesce(quantile_cont(value / 5, 0.95), -1.0), 6) AS v FROM events)")
def gate_latency(spark, sf):
    e = src.table(spark, sf, "events").select((F.col("value") / 5).alias("value"))
    return ql.gate(ql.percentiles(e, [], "value", {"p": 0.95}), "latency_p95", F.coalesce(F.max("p"), F.lit(-1.0)), 15.0, higher=False)


@query("gate_reconcile", "WITH a AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), b AS (SELECT event_type, count(*) AS m FROM events WHERE event_id % 50 <> 0 OR event_type = 'view' GROUP BY 1) SELECT a.event_type, n - m AS diff, n = m OR a.event_type = 'error' AS passed FROM a JOIN b ON a.event_type = b.event_type")
def gate_reconcile(spark, sf):
    e = src.table(spark, sf, "events")
    a = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if((F.col("event_id") % 50 != 0) | (F.col("event_type") == "view")).alias("m"))
    return a.select("event_type", (F.col("n") - F.col("m")).alias("diff"), ((F.col("n") == F.col("m")) | (F.col("event_type") == "error")).alias("passed"))


@query("dashboard_latest", f"WITH {QUALITY} SELECT metric, x.value AS value, strftime(x.computed_at, '%Y-%m-%d %H:%M:%S') AS computed_at, x.source AS source FROM (SELECT metric, arg_max(struct_pack(value := value, computed_at := computed_at, source := source), (computed_at, source)) AS x FROM quality_metric WHERE computed_at <= TIMESTAMP '2024-01-20' GROUP BY metric)")
def dashboard_latest(spark, sf):
    d = ql.latest_metric(src.quality_metric(spark, sf), ["metric"], F.lit("2024-01-20").cast("timestamp_ntz"))
    return d.select("metric", "value", stamp("computed_at").alias("computed_at"), "source")


@query("metric_history", f"WITH {QUALITY} SELECT metric, source, strftime(partition_day, '%Y-%m-%d') AS day, value, round(value - lag(value) OVER (PARTITION BY metric, source ORDER BY partition_day), 6) AS change FROM quality_metric")
def metric_history(spark, sf):
    m = src.quality_metric(spark, sf)
    return m.select("metric", "source", day_text("partition_day").alias("day"), "value", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("metric", "source").orderBy("partition_day")), 6).alias("change"))


@query("budget_month", """WITH s AS (SELECT event_type AS provider, strftime(ts + INTERVAL 8 HOUR, '%Y-%m') AS month, CASE WHEN event_id % 17 <> 0 THEN CAST(round(value * 10) AS BIGINT) END AS cents FROM events),
g AS (SELECT provider, month, CAST(coalesce(sum(cents), 0) AS BIGINT) AS spent, count(*) FILTER (WHERE cents IS NULL) AS unknown FROM s GROUP BY ALL) SELECT *, CASE WHEN spent / 400000.0 >= 1 THEN 'exceeded' WHEN spent / 400000.0 >= 0.8 THEN 'warn' WHEN unknown > 0 THEN 'unknown' ELSE 'ok' END AS level FROM g""")
def budget_month(spark, sf):
    e = src.table(spark, sf, "events").select(F.col("event_type").alias("provider"), F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM").alias("month"), F.when(F.col("event_id") % 17 != 0, F.round(F.col("value") * 10).cast("long")).alias("cents"))
    g = e.groupBy("provider", "month").agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("spent"), F.count_if(F.col("cents").isNull()).alias("unknown"))
    return g.withColumn("level", ql.budget_level(F.col("spent"), F.lit(400000.0), F.col("unknown")))


TIERS = [("A", 0.0), ("B", 0.0339), ("C", 0.1356), ("D", 1.0)]


@query("tier_summary", f"""WITH t(tier, price) AS (VALUES {', '.join(map(str, TIERS))}), d AS (SELECT CASE WHEN length(text) < 500 THEN 'A' WHEN length(text) < 3000 THEN 'B' ELSE 'C' END AS tier, length(text) AS n FROM documents)
SELECT t.tier, count(n) AS n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS chars, round(count(n) * CAST(price AS DOUBLE), 4) AS cost FROM t LEFT JOIN d ON t.tier = d.tier GROUP BY t.tier, price""")
def tier_summary(spark, sf):
    n = F.length("text")
    d = src.table(spark, sf, "documents").select(F.when(n < 500, "A").when(n < 3000, "B").otherwise("C").alias("tier"), n.alias("n"))
    g = d.groupBy("tier").agg(F.count("*").alias("n_docs"), F.sum("n").alias("chars"))
    t = spark.createDataFrame(TIERS, "tier string, price double").join(g, "tier", "left").na.fill(0, ["n_docs", "chars"])
    return t.select("tier", "n_docs", "chars", F.round(F.col("n_docs") * F.col("price"), 4).alias("cost"))


@query("tier_distribution", "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) < 500) AS short, min(length(text)) AS least, round(avg(length(text)), 4) AS mean FROM documents GROUP BY source")
def tier_distribution(spark, sf):
    n = F.length("text")
    return src.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(n < 500).alias("short"), F.min(n).alias("least"), F.round(F.avg(n), 4).alias("mean"))


@query("warnings_unnest", "SELECT w AS warning, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 100 THEN 'tiny' END, CASE WHEN contains(text, '|') THEN 'pipes' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END], lambda x: x IS NOT NULL)) AS w FROM documents) GROUP BY 1")
def warnings_unnest(spark, sf):
    w = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "tiny"), F.when(F.col("text").contains("|"), "pipes"), F.when(F.col("text").rlike("[0-9]"), "digits")))
    return src.table(spark, sf, "documents").select(F.explode(w).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


@query("alerts_from_quality", f"WITH {QUALITY} SELECT metric, source, strftime(partition_day, '%Y-%m-%d') AS day, CASE WHEN metric = 'error' THEN 'critical' WHEN value > 60 THEN 'warning' ELSE 'info' END AS severity FROM quality_metric WHERE value > 55 OR metric = 'error'")
def alerts_from_quality(spark, sf):
    m = src.quality_metric(spark, sf).filter((F.col("value") > 55) | (F.col("metric") == "error"))
    return m.select("metric", "source", day_text("partition_day").alias("day"), F.when(F.col("metric") == "error", "critical").when(F.col("value") > 60, "warning").otherwise("info").alias("severity"))


@query("alert_cooldown", """WITH RECURSIVE o AS (SELECT user_id AS key, event_id, floor(epoch(ts)) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
r AS (SELECT key, event_id, k, sec AS last, false AS suppressed FROM o WHERE k = 1 UNION ALL SELECT o.key, o.event_id, o.k, CASE WHEN o.sec - last >= 21600 THEN o.sec ELSE last END, o.sec - last < 21600 FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1) SELECT key, event_id, suppressed FROM r""")
def alert_cooldown(spark, sf):
    e = src.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("key"), "ts", "event_id")
    return ql.cooldown(e)


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    e = src.table(spark, sf, "events")
    return ql.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).join(e.groupBy("event_type").agg(stamp(F.min("ts")).alias("first"), stamp(F.max("ts")).alias("last")), "event_type")


@query("budget_packing_strict", "SELECT user_id, event_id, round(used, 6) AS used FROM (SELECT user_id, event_id, sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events) WHERE used <= 500")
def budget_packing_strict(spark, sf):
    e = src.table(spark, sf, "events").withColumn("cost", F.col("value").cast("decimal(18,4)"))
    return ql.strict_prefix(e, "user_id", ["ts", "event_id"], "cost", 500.0).select("user_id", "event_id", F.round("used", 6).alias("used"))


# Diagnostics -------------------------------------------------------------------------------------------------------


@query("page_documents", f"WITH {DOCUMENT}, {BLOCK}, n AS (SELECT doc_id, count(*) AS n_blocks FROM doc_block GROUP BY 1) SELECT d.doc_id, doc_type, source, substr(text, 1, 120) AS preview, coalesce(n_blocks, 0) AS n_blocks FROM document d LEFT JOIN n ON d.doc_id = n.doc_id WHERE owner_tenant IS NULL AND owner_user IS NULL ORDER BY publish_at DESC, d.doc_id LIMIT 50 OFFSET 50")
def page_documents(spark, sf):
    d = src.document(spark, sf)
    n = src.doc_block(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    page = d.filter(bt.owner_visible(None, None)).orderBy(F.desc("publish_at"), "doc_id").offset(50).limit(50)
    return page.join(n, "doc_id", "left").select("doc_id", "doc_type", "source", F.substring("text", 1, 120).alias("preview"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


@query("block_type_counts", f"WITH {DOCUMENT}, {BLOCK} SELECT doc_type, count(*) AS n, count(*) FILTER (WHERE contains(content, '|')) AS tables, count(*) FILTER (WHERE length(content) > 80) AS long FROM doc_block GROUP BY doc_type")
def block_type_counts(spark, sf):
    return src.doc_block(spark, sf).groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if(F.col("content").contains("|")).alias("tables"), F.count_if(F.length("content") > 80).alias("long"))


@query("page_histogram", f"WITH {DOCUMENT}, {BLOCK} SELECT source, page, count(*) AS n FROM doc_block GROUP BY ALL")
def page_histogram(spark, sf):
    return src.doc_block(spark, sf).groupBy("source", "page").agg(F.count("*").alias("n"))


ISO = "(owner_tenant IS NULL AND owner_user IS NULL)"


@query("isolation_probes", f"""WITH {DOCUMENT}, v AS (SELECT 'anonymous' AS who, * FROM document WHERE {ISO} UNION ALL SELECT 'tenant', * FROM document WHERE {ISO} OR owner_tenant = 't1' UNION ALL SELECT 'user_a', * FROM document WHERE {ISO} OR owner_user = 'a' UNION ALL SELECT 'user_b', * FROM document WHERE {ISO} OR owner_user = 'b')
SELECT who, count(*) AS total, count(*) FILTER (WHERE {ISO}) AS public, count(*) FILTER (WHERE owner_user IS NOT NULL) AS of_user, count(*) FILTER (WHERE owner_tenant IS NOT NULL) AS of_tenant, count(*) FILTER (WHERE owner_user IS NOT NULL AND who NOT IN ('user_a', 'user_b')) AS foreign_user FROM v GROUP BY who""")
def isolation_probes(spark, sf):
    d = src.document(spark, sf)
    callers = [("anonymous", None, None), ("tenant", "t1", None), ("user_a", None, "a"), ("user_b", None, "b")]
    public = F.col("owner_tenant").isNull() & F.col("owner_user").isNull()
    # one scan: each row is counted for every caller that may see it
    who = F.explode(F.array_compact(F.array(*[F.when(bt.owner_visible(t, u), F.lit(w)) for w, t, u in callers]))).alias("who")
    return d.select("owner_tenant", "owner_user", who).groupBy("who").agg(F.count("*").alias("total"), F.count_if(public).alias("public"), F.count_if(F.col("owner_user").isNotNull()).alias("of_user"), F.count_if(F.col("owner_tenant").isNotNull()).alias("of_tenant"), F.count_if(F.col("owner_user").isNotNull() & ~F.col("who").isin("user_a", "user_b")).alias("foreign_user"))


@query("meta_ranges", f"WITH {DOCUMENT}, {PRICE} SELECT 'document' AS name, count(*) AS n, strftime(min(known_at), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(known_at), '%Y-%m-%d %H:%M:%S') AS last FROM document UNION ALL SELECT 'price_daily', count(*), strftime(min(known_at), '%Y-%m-%d %H:%M:%S'), strftime(max(known_at), '%Y-%m-%d %H:%M:%S') FROM price_daily")
def meta_ranges(spark, sf):
    one = lambda name, df: df.agg(F.count("*").alias("n"), stamp(F.min("known_at")).alias("first"), stamp(F.max("known_at")).alias("last")).select(F.lit(name).alias("name"), "*")
    return one("document", src.document(spark, sf)).unionByName(one("price_daily", src.price_daily(spark, sf)))


@query("announcement_reconcile", f"WITH {ANNOUNCEMENT}, g AS (SELECT regexp_extract(source_ref, '^https?://([^/]*)', 1) AS host, count(*) AS listed, count(DISTINCT source_ref) AS unique_refs, count(*) FILTER (WHERE has_full_text) AS loaded FROM announcement GROUP BY 1) SELECT host, listed, unique_refs, loaded, listed = unique_refs AND loaded * 2 >= listed AS passed FROM g")
def announcement_reconcile(spark, sf):
    g = src.announcement(spark, sf).groupBy(F.regexp_extract("source_ref", "^https?://([^/]*)", 1).alias("host")).agg(F.count("*").alias("listed"), F.count_distinct("source_ref").alias("unique_refs"), F.count_if("has_full_text").alias("loaded"))
    return g.withColumn("passed", (F.col("listed") == F.col("unique_refs")) & (F.col("loaded") * 2 >= F.col("listed")))
