"""Queries whose work must not grow faster than their input, and inputs at the edges."""

import re
from contextlib import contextmanager
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import sequential as sq
from tidemark.operators import dual as du
from tidemark.operators import entities as en
from tidemark.operators import finance as fin
from tidemark.operators import retrieval as rt
from tidemark.operators import vector_index as vi


@contextmanager
def fixed_plan(spark):
    """Plans as they are first made, so that their nodes can be asked for the rows they gave."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def most_rows(spark, make) -> int:
    """The most rows that a node of make()'s plan gives while it is collected."""

    def walk(node) -> int:
        rows = node.metrics().get("numOutputRows")
        below = [walk(node.children().apply(i)) for i in range(node.children().size())]
        return max([rows.get().value() if rows.isDefined() else 0, *below])

    with fixed_plan(spark):
        df = make()
        df.collect()
        return walk(df._jdf.queryExecution().executedPlan())


def test_quarters_of_keys_that_end_before_march(spark):
    p = spark.createDataFrame([(1, date(2024, 1, 31)), (2, date(2024, 2, 29)), (3, date(2024, 2, 29)), (3, date(2024, 6, 30)), (4, date(2024, 3, 30)), (5, date(2024, 3, 31)), (6, None)], "k int, period_end date")
    got = sorted((r.k, r.period_end.isoformat()) for r in fin.full_years(p, "k").collect())
    assert got == [(3, "2024-03-31"), (3, "2024-06-30"), (5, "2024-03-31")]


def test_a_name_of_many_entities_is_not_met_with_all_of_them(spark):
    aliases = spark.range(400).select(F.lit("one").alias("alias"), F.col("id").alias("entity"))
    asked = spark.range(400).select("id", F.lit(None).cast("string").alias("code"), F.lit("one").alias("name"), F.array("id", F.col("id") + 400).alias("context"))
    codes = spark.createDataFrame([], "code string, entity long")
    assert most_rows(spark, lambda: en.resolve_names(asked, codes, aliases)) <= 1600
    got = {tuple(r) for r in en.resolve_names(asked, codes, aliases).collect()}
    assert got == {(i, i, "medium", "context", 400) for i in range(400)}


def test_cosine_of_odd_vectors_is_ranked_as_pair_by_pair(spark):
    odd = [[0.0, 0.0], [1.0, 0.0], [1.0, 0.0], None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [3.0, 4.0], [-1.0, 0.0], [1.0], [], [0.0078125, 0.9999694824218750]]
    v = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "vec_id long, embedding array<float>")
    q = v.withColumnRenamed("vec_id", "qid")
    d = "cast(embedding as array<double>)"
    a, b = v.select("vec_id", rt.normalised(F.expr(d)).alias("a")), q.select("qid", rt.normalised(F.expr(d)).alias("b"))
    want = rt.top(a.crossJoin(b).select("qid", "vec_id", F.round(rt.dot(F.col("a"), F.col("b")), 6).alias("score")), "vec_id", 4)
    rows = lambda f: sorted(map(str, f.select("qid", "vec_id", "score", "rank").collect()))
    assert rows(rt.vector_topk(v, q, k=4)) == rows(want)


def test_blocks_of_scores_give_what_one_block_gives(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "the"]
    docs = spark.createDataFrame([(i, " ".join(["the", words[i % 4], words[i * 7 % 4], *["x"] * (i % 9)])) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"the {words[i % 5]} {words[i % 3]}") for i in range(20)] + [(20, None), (21, "nowhere")], "qid long, question string")
    rows = lambda: sorted(map(tuple, rt.bm25(docs, asked, k=7).collect()))
    one = rows()
    for name, n in {"DOCS": 40, "ASKED": 3, "PAIRS": 50}.items():
        monkeypatch.setattr(rt, name, n)
    assert rows() == one
    assert len(one) == 20 * 7


def test_a_word_of_all_texts_and_questions_makes_no_pairs(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the word").alias("text"))
    asked = spark.range(400).select(F.col("id").alias("qid"), F.lit("the").alias("question"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    seen = []
    real = rt.top
    rt.top = lambda scored, key, k: seen.append(scored) or real(scored, key, k)
    try:
        assert rt.bm25(docs, asked, k=3).count() == 1200
        rt.top = real
        assert most_rows(spark, lambda: seen[0]) <= 4000
    finally:
        rt.top = real
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_pages_of_one_file_are_judged_by_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id", "concat('<b>', id, '</b>') AS a", "concat('', id) AS b").coalesce(1).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    got = du.dual_verdict(pages, "id", "a", "b")
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert got.filter("ok").count() == 40


def test_short_blocks_of_many_documents_are_walked_over_in_one_pass(spark):
    b = spark.range(60_000).selectExpr("id div 3 AS doc_id", "int(id % 3) AS ordinal", "1 AS page", "'ab' AS content").unionByName(spark.createDataFrame([(None, 0, 1, "x"), (None, 1, 2, "y")], "doc_id long, ordinal int, page int, content string"))
    merged = sq.merge_short(b)
    assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [tuple(r) for r in merged.filter("doc_id is null or doc_id in (0, 19999)").collect()]
        assert merged.count() == 20_002
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(rows, key=str) == [(0, 0, 0, 3, "ab\nab\nab"), (19999, 0, 0, 3, "ab\nab\nab"), (None, 0, 0, 1, "x"), (None, 1, 1, 1, "y")]


def test_words_are_counted_where_texts_are_read(spark, monkeypatch):
    odd = ["One two, one", None, "", " - ", "ÀÉ ß ÿÇ İI Σς naïve 9x", "a  b a\n\tb", "东西 x"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    monkeypatch.setattr(rt, "SPLIT", 40)
    got = rt.word_counts(docs, "doc_id", F.lower("text"), rt.WORD_ENDS)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    ts = F.coalesce(rt.tokens(F.col("text")), F.array().cast("array<string>"))
    want = docs.select("doc_id", F.size(ts).alias("len"), F.explode(F.concat(ts, F.array(F.lit("")))).alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(got) == rows(want)


def test_a_repeated_key_is_one_document(spark):
    asked = spark.createDataFrame([(1, "red one")], "qid long, question string")
    once = spark.createDataFrame([(1, "red one red one"), (2, "one blue")], "doc_id long, text string")
    twice = spark.createDataFrame([(1, "red one"), (1, "red one"), (2, "one blue")], "doc_id long, text string")
    counts = lambda d: sorted((r.doc_id, r.term, r.tf) for r in rt.postings(d, asked).filter("term <> ''").collect())
    assert counts(twice) == counts(once) == [(1, "one", 2), (1, "red", 2), (2, "one", 1)]


def test_tasks_of_block_pairs_grow_with_the_blocks(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('the ', id % 7) AS text")
    asked = spark.range(20).selectExpr("id AS qid", "concat('the ', id % 7) AS question")
    monkeypatch.setattr(rt, "DOCS", 10)
    monkeypatch.setattr(rt, "ASKED", 5)
    seen, real = [], rt.top
    monkeypatch.setattr(rt, "top", lambda scored, key, k: seen.append(scored) or real(scored, key, k))
    assert rt.bm25(docs, asked, k=3).count() == 60
    assert seen[0].rdd.getNumPartitions() == 120


def test_words_are_read_once_after_the_rarest_are_known(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('so the word ', id % 5, ' is here') AS text")
    asked = spark.createDataFrame([(1, "the word 3 is"), (2, "here"), (3, "word 9 is")], "qid long, question string")
    with fixed_plan(spark):
        found = rt.containing(docs, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*term#", plan)) == 1
    assert sorted(map(tuple, found.collect())) == sorted([(1, i) for i in range(50) if i % 5 == 3] + [(2, i) for i in range(50)])


def test_lengths_of_vectors_are_found_once(spark):
    v = F.array(*[F.col("id") + float(i) for i in range(3)])
    d = spark.range(3).select(v.alias("v"))
    text = d.select(rt.normalised(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    inside = text[text.index("THEN"):]
    assert "zip_with" in inside and "transform(" not in inside
    got = [r[0] for r in d.unionByName(spark.createDataFrame([(None,), ([None, 1.0],), ([0.0, 0.0],), ([],)], "v array<double>")).select(rt.normalised(F.col("v"))).collect()]
    norm = lambda x: [c / sum(y * y for y in x) ** 0.5 for c in x]
    assert got == [norm([i, i + 1.0, i + 2.0]) for i in range(3)] + [None, [None, 1.0], [0.0, 0.0], []]


def test_questions_of_one_block_may_want_different_numbers(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 40").withColumnRenamed("vec_id", "qid").select("qid", rt.normalised(F.col("embedding")).alias("qv"))
    index = vi.build(v)
    every = vi.probes(index, q).withColumn("k", F.lit(3) + (F.col("qid") % 2).cast("int") * 500)
    hits = vi.scan(index, every, q, 40)
    by = {r.qid: r.n for r in hits.groupBy("qid").agg(F.countDistinct("key").alias("n")).collect()}
    assert all(by[i] == 400 for i in range(1, 40, 2)) and all(3 <= by[i] <= 400 for i in range(0, 40, 2)) and min(by.values()) < 400
