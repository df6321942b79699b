"""The pipeline on small tables: run() as a whole, each stage's rows against brute force over what the stage before has written."""

from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_operators import closure, contaminated_by_hand, shingle_set, words
from tidemark.llm import language_id
from tidemark.llm.queries import queries, vocabulary

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, monkeypatch, docs, benchmark):
    """Rows of run() and the written stages, in order."""
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/in/benchmark.parquet")
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/in").collect()
    return rows, [spark.read.parquet(f"{tmp_path}/shared/{k}-{name}") for k, (name, _) in enumerate(corpus_pipeline.STAGES)]


def keys(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    base = spark.read.parquet(f"{SF}/documents.parquet")
    first = base.filter("text is not null").orderBy("doc_id").limit(3).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    more = [
        (None, first[0].text, "en", None, 1), (None, words(50, 1) + " the and of", "en", "src1", None), (first[1].doc_id, first[1].text, first[1].lang, first[1].source, first[1].n_chars),
        (first[2].doc_id, first[1].text + " and of the", "en", "src2", 3), (90_001, None, "en", "src0", 0), (90_002, "", None, "src0", 0), (90_003, " 12 !", "en", "src0", 4),
        (90_004, item, None, "src3", 0), (90_005, first[2].text * 40, first[2].lang, "src0", 0),
    ]
    docs = base.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("score", F.lit("mine"))
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    b = b.unionByName(spark.createDataFrame([(None, "x y"), (77_777, None)], b.select("item_id", "text").schema), allowMissingColumns=True)
    rows, stages = run(spark, tmp_path, monkeypatch, docs, b)
    out = [s.collect() for s in stages]
    assert all(s.columns == docs.columns for s in stages[:-1])
    # 0: exactly the rows whose prediction is a language with enough of the letters
    found = language_id.identify(docs.drop("score"), language_id.learn(docs)).collect()
    assert keys(out[0]) == keys(r for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SHARE)
    assert not {90_001, 90_002, 90_003} & {r.doc_id for r in out[0]} and {r.score for r in out[0]} == {"mine"}
    # 1: of each component of distinct rows the one with the smallest id, rows without a proper id last
    distinct = sorted(keys(out[0]), key=lambda k: (k[0] is None, k[0] or 0))
    sets = [shingle_set(t) for _, t in distinct]
    links = {i: {j for j in range(len(sets)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in range(len(sets))}
    comp = closure(links)
    assert len(out[1]) == len(set(comp.values()))
    group = {k: comp[i] for i, k in enumerate(distinct)}
    assert Counter(group[k] for k in keys(out[1])) == Counter(set(comp.values()))
    shared = {i for i, n in Counter(i for i, _ in distinct).items() if i is None or n > 1}
    members = {g: [k for k in distinct if group[k] == g] for g in set(comp.values())}
    assert all(k[0] == min(i for i, _ in members[group[k]]) for k in keys(out[1]) if not any(i in shared for i, _ in members[group[k]]))
    # 2: exactly the rows that the contamination rule doesn't mark
    items = [(r.item_id, r.text) for r in b.collect() if r.item_id is not None]
    bad = {t: contaminated_by_hand([(0, t)], items)[0][4] for _, t in keys(out[1])}
    assert keys(out[2]) == Counter({k: n for k, n in keys(out[1]).items() if not bad[k[1]]}) and any(bad.values())
    # 3: each row as often as one of two epochs and a bit allow, and about as many words as before
    assert set(keys(out[3])) <= set(keys(out[2])) and max(keys(out[3]).values()) <= 2
    size = lambda rows: sum(max(1, len((r.text or "").split())) for r in rows)
    largest: dict = {}
    for r in out[2]:
        largest[r.lang, r.source] = max(largest.get((r.lang, r.source), 0), size([r]))
    assert 0.9 * size(out[2]) < size(out[3]) <= size(out[2]) + sum(largest.values())  # each leaf's last document crosses its budget
    # 4: every row's ids, in order
    t = Tokenizer.from_file(vocabulary())
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in out[3])
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want == Counter((r.doc_id, r.n_tokens) for r in out[4])
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])


def test_run_on_no_documents(spark, tmp_path, monkeypatch):
    rows, stages = run(spark, tmp_path, monkeypatch, spark.read.parquet(f"{SF}/documents.parquet").limit(0), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert rows == [] and all(s.count() == 0 for s in stages)


CLASHES = ["_id", "_h", "_i", "_key", "_last", "key", "row", "order", "r", "i", "h", "c0", "c1", "lang_pred", "_lang_pred", "score", "_score", "lang_spans", "epoch", "_mix_n", "_mix_full", "others", "kept", "component_id", "n_words", "a.b"]


def test_stages_keep_columns_of_any_name(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    d = base.unionByName(base.limit(5)).withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, d, SF).collect()
        assert rows and rows[0].__fields__ == d.columns, name
        assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == 65


def test_of_equal_texts_the_same_row_stays(spark):
    rows = [(1, "one two three four five six", lang, source, None) for lang in ("en", "de") for source in ("b", "a", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = {tuple(corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(r, schema), SF).collect()[0]) for r in (rows, rows[::-1])}
    assert len(kept) == 1


def test_every_operator_has_one_query():
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
