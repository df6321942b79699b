"""Rules on small tables: point-in-time invariants, refusals, sequential folds."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import chunks as ch
from tidemark.functions import sequential as sq
from tidemark.operators import bitemporal as bt
from tidemark.operators import entities as en
from tidemark.operators import finance as fin
from tidemark.operators import quality as ql
from tidemark.operators import retrieval as rt
from tidemark.operators import textops as tx
from tidemark.operators import verification as vf
from tidemark.operators import writes
from tidemark.sources import payloads


def test_an_instant_is_mandatory_and_has_a_zone():
    with pytest.raises(bt.MissingAsOf):
        bt.require_as_of(None)
    with pytest.raises(bt.MissingAsOf):
        bt.Session(datetime(2024, 1, 1))
    assert bt.Session(datetime(2024, 1, 1, tzinfo=timezone.utc)).as_of.year == 2024


def facts(spark, rows):
    return spark.createDataFrame(rows, "entity string, metric string, period string, value decimal(18,4), unit string, known_at string, superseded_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("known_at", "superseded_at")})


def fact(period, value, unit="CNY", known="2024-01-01", gone=None, metric="M"):
    from decimal import Decimal

    return ("e", metric, period, None if value is None else Decimal(str(value)), unit, known, gone)


def test_visibility_is_left_closed_right_open(spark):
    f = facts(spark, [fact("2024Q1", 1, known="2024-02-01", gone="2024-03-01"), fact("2024Q1", 2, known="2024-03-01")])
    for t, want in [("2024-01-31", []), ("2024-02-01", [1]), ("2024-02-29 23:59:59", [1]), ("2024-03-01", [2])]:
        assert [int(r.value) for r in bt.asof(f, bt.at(t)).collect()] == want


def test_session_hides_foreign_rows(spark):
    d = spark.sql("select 1 id, timestamp'2024-01-01' known_at, cast(null as timestamp) superseded_at, cast(null as string) owner_tenant, cast(null as string) owner_user union all select 2, timestamp'2024-01-01', null, 't1', null union all select 3, timestamp'2024-01-01', null, null, 'a'")
    seen = lambda **k: sorted(r.id for r in bt.Session(datetime(2024, 6, 1, tzinfo=timezone.utc), **k).table(d).collect())
    assert (seen(), seen(tenant="t1"), seen(user="a"), seen(user="b")) == ([1], [1, 2], [1, 3], [1])


def test_growth_refuses_with_reasons_in_order(spark):
    f = facts(spark, [fact("2023Q1", 10), fact("2024Q1", 15), fact("2025Q1", 20, unit="USD"), fact("2023Q2", 0), fact("2024Q2", 1), fact("2023Q3", -1), fact("2024Q3", 1)])
    got = {r.period: (r.yoy, r.note) for r in fin.yoy(f).collect()}
    assert got["2024Q1"] == (0.5, None)
    assert got["2025Q1"] == (None, "unit_mismatch")
    assert got["2024Q2"] == (None, "zero_base") and got["2024Q3"] == (None, "negative_base")
    assert got["2023Q1"] == (None, "missing_base")


def test_ttm_and_single_quarter(spark):
    f = facts(spark, [fact("2023Q1", 1), fact("2023FY", 10), fact("2024Q1", 3), fact("2024Q3", 9)])
    ttm = {r.period: (r.ttm, r.note) for r in fin.ttm(f).collect()}
    assert ttm["2024Q1"] == (12.0, None) and ttm["2023FY"] == (10.0, None) and ttm["2024Q3"] == (None, "missing_base")
    one = {r.period: r.value for r in fin.single_quarter(f).collect()}
    assert float(one["2024Q1"]) == 3 and one["2024Q3"] is None  # a gap is never bridged


def test_rates_go_stale(spark):
    rates = spark.createDataFrame([("X", "2024-01-01", 2.0)], "base string, rate_date string, rate double").withColumns({"rate_date": F.col("rate_date").cast("date"), "rate": F.col("rate").cast("decimal(18,4)")})
    asked = spark.createDataFrame([("X", d) for d in ("2023-12-31", "2024-01-01", "2024-01-08", "2024-01-09")], "base string, on_day string").withColumn("on_day", F.col("on_day").cast("date"))
    got = [(r.on_day.day, r.note) for r in fin.rate_asof(asked, rates).orderBy("on_day").collect()]
    assert got == [(31, "no_rate"), (1, None), (8, None), (9, "stale_rate")]


def test_write_then_read_at_any_instant(spark):
    now = facts(spark, [fact("2024Q1", 1, known="2024-02-01")])
    new = facts(spark, [fact("2024Q1", 2, known="2024-03-01"), fact("2024Q2", 5, known="2024-03-01")]).drop("superseded_at")
    state = writes.fact_state(now, new)
    at = lambda t: sorted((r.period, int(r.value)) for r in bt.asof(state, bt.at(t)).collect())
    assert at("2024-02-15") == [("2024Q1", 1)] and at("2024-03-01") == [("2024Q1", 2), ("2024Q2", 5)]
    assert bt.duplicates(bt.live(state), ["entity", "metric", "period"]).count() == 0


def test_fusion_scores(spark):
    a = spark.createDataFrame([(1, 7, 1)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 9, 1), (1, 7, 2)], "qid int, id int, rank int")
    got = {r.id: (r.score, r.rank) for r in rt.rrf(a, b, "id").collect()}
    assert got[7] == (round(0.6 / 61 + 0.4 / 62, 9), 1) and got[9][1] == 2


def test_cooldown_is_a_fold(spark):
    rows = [("k", f"2024-01-01 {h:02d}:00:00", i) for i, h in enumerate([0, 2, 5, 6, 11, 12])]
    d = spark.createDataFrame(rows, "key string, ts string, event_id long")
    got = [r.suppressed for r in ql.cooldown(d).orderBy("event_id").collect()]
    assert got == [False, True, True, False, True, False]


def pieces_by_hand(text):
    """The rule said slowly: every place is looked at from the right."""
    text = text.strip()
    out, a = [], 0
    while text and a < len(text):
        b = min(a + 400, len(text))
        if b < len(text):
            b = next((k + 1 for k in range(b - 1, a + 199, -1) if text[k] in "。！？；\n"), b)
        out.append((a, b))
        if b == len(text):
            break
        a = b - 48
    if len(out) > 1 and out[-1][1] - out[-1][0] < 200 and out[-1][1] - out[-2][0] <= 400:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return [text[a:b] for a, b in out]


def test_pieces_against_the_rule_said_slowly(spark):
    rng = random.Random(4)
    texts = ["", " \n ", "x", "x" * 400, "x" * 401, "x" * 5000, "字。" * 900] + ["".join(rng.choice("abc 。；\n.") if rng.random() < 0.05 else rng.choice("abc ") for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    assert all(ch.pieces(t) == pieces_by_hand(t) for t in texts)
    assert all(len(p) <= 400 for t in texts for p in ch.pieces(t))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    got = {}
    for r in ch.split_texts(d, "doc_id", "text").orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {i: ch.pieces(t) for i, t in enumerate(texts) if t.strip()}


def test_chains_of_any_length(spark):
    rows = [(i, i - 1 if i else None) for i in range(101)] + [(200, 201), (201, 200), (300, 999), (None, 5)]
    d = spark.createDataFrame(rows, "id long, parent long")
    up = {(r.id, r.ancestor): r.depth for r in en.ancestors(d).filter("id <= 100").collect()}
    assert up == {(i, j): i - j for i in range(101) for j in range(i)}
    last = {r.id: (r.last, r.steps) for r in en.last_successor(d).collect()}
    assert all(last[i] == (100, 100 - i) for i in range(101)) and last[200][0] is None and last[300] == (300, 0)
    whole = en.tree_stats(d.filter("id <= 100")).first()
    assert (whole.nodes, whole.depth, whole.orphans) == (101, 101, 0)
    assert en.ancestors(d.limit(0)).count() == 0


def test_vector_guarantee_brings_back_what_fusion_cut(spark):
    lexical = spark.createDataFrame([(1, i, i) for i in range(1, 9)], "qid long, doc_id long, rank int")
    vector = spark.createDataFrame([(1, 100 + i, i) for i in range(1, 5)] + [(1, 2, 5)], "qid long, doc_id long, rank int")
    fused = rt.rrf(lexical, vector, "doc_id", limit=6)
    ids = lambda n: [r.doc_id for r in rt.vector_guarantee(fused, lexical, vector, "doc_id", n, 6).orderBy("final_rank").collect()]
    first = [r.doc_id for r in fused.orderBy("rank").collect()]
    assert ids(0) == first and 101 not in first
    assert ids(2) == [*first[:4], 101, 102]


def test_html_grid_refuses_what_it_cannot_read():
    good = "<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert [(c["r"], c["c"], c["t"]) for c in sq.parse_grid(good)] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c")]
    for bad in ("<table><tr><td><table></table></td></tr></table>", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "<table><tr><td colspan='0'>a</td></tr></table>", "<table><tfoot></tfoot></table>", "", None):
        assert sq.parse_grid(bad) is None


def test_csv_repair_and_parallel_arrays(spark):
    d = spark.createDataFrame([("1,a, b, c,9",), ("2,x,8",)], "line string")
    assert [r.fields for r in payloads.repaired_csv(d, "line", 3, 1).collect()] == [["1", "a, b, c", "9"], ["2", "x", "8"]]
    bad = spark.createDataFrame([('{"a": [1, 2], "b": [1]}',)], "body string")
    with pytest.raises(Exception, match="unequal"):
        payloads.parallel_rows(bad, "body", {"a": "int", "b": "int"}, []).collect()


def test_cell_values(spark):
    want = {"12,340": (12340, "amount", None), "58.2%": (58.2, "percent", None), "(1,234)": (-1234, "amount", None), "(1)": (None, None, None), "(3000)": (None, None, None), "1.5万元": (1.5, "amount", "万元"), "7<br>亿元": (7, "amount", "亿元"), "649,900,00<br>0": (None, None, None), "2024年": (None, None, None), "2024": (2024, "amount", None), "增加 16.70 个百分点": (None, None, None), "5%万元": (None, None, None), "1,23": (None, None, None), "": (None, None, None)}
    d = spark.createDataFrame([(k,) for k in want] + [(None,)], "c string")
    v, k, u = tx.cell_value(F.col("c"))
    got = {r.c: (None if r.v is None else float(r.v), r.k, r.u) for r in d.select("c", v.alias("v"), k.alias("k"), u.alias("u")).collect()}
    assert got == want | {None: (None, None, None)}


def test_no_filter_looks_at_load_time():
    """Visibility never depends on when a row was loaded."""
    from pathlib import Path

    for p in Path("tidemark").rglob("*.py"):
        assert "ingested_at" not in p.read_text(), p


def test_facade_reads_one_instant(spark):
    from tidemark.plans.api import DataApi

    sf = "/root/testdata/sf0.001"
    early = DataApi(spark, sf, datetime(1996, 6, 1, tzinfo=timezone.utc))
    late = DataApi(spark, sf, datetime(2005, 1, 1, tzinfo=timezone.utc), tenant="t1")
    assert 0 < early.facts().count() < late.facts().count()
    assert late.facts().groupBy("entity", "metric", "period").count().filter("count > 1").count() == 0
    assert early.derived("yoy").columns == ["entity", "metric", "period", "yoy", "note"]
    with pytest.raises(ValueError):
        early.derived("nope")
    public = DataApi(spark, sf, datetime(2024, 1, 20, tzinfo=timezone.utc)).documents().count()
    assert public < DataApi(spark, sf, datetime(2024, 1, 20, tzinfo=timezone.utc), tenant="t1").documents().count()


def test_folds(spark):
    from tidemark.functions import folds

    jobs = spark.createDataFrame([("d", 1, 6.0), ("d", 2, 5.0), ("d", 3, 4.0), ("d", 4, 0.5)], "k string, i int, cost double")
    assert [r.taken for r in folds.greedy_packing(jobs, ["k"], ["i"], "cost", 10.0).orderBy("i").collect()] == [True, False, True, False]
    rows = spark.createDataFrame([(1, i, i, d) for i, d in enumerate([True, True, False, True, False])], "slot long, known_at long, page_id long, degraded boolean")
    assert [r.outcome for r in folds.directory_write(rows).orderBy("page_id").collect()] == ["inserted", "skipped", "superseded_degraded", "shadowed", "skipped"]
    log = spark.createDataFrame([("s", i, x) for i, x in enumerate("abc")], "k string, i int, body string")
    a = [r.hash for r in folds.audit_chain(log, "k", ["i"], "body").orderBy("i").collect()]
    b = [r.hash for r in folds.audit_chain(log.withColumn("body", F.when(F.col("i") == 1, "x").otherwise(F.col("body"))), "k", ["i"], "body").orderBy("i").collect()]
    assert a[0] == b[0] and a[1] != b[1] and a[2] != b[2]


def test_percentiles_against_numpy(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(k, v) for k in ("a", "b") for v in [rng.choice([1.0, 2.0, 2.0, rng.gauss(0, 1e6), rng.gauss(0, 1e-6)]) for _ in range(700)]] + [("c", 5.0), ("d", None), ("c", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.lo, r.mid, r.hi) for r in ql.percentiles(d, ["k"], "v", {"lo": 0.0, "mid": 0.5, "hi": 0.95}).collect()}
    by = {k: np.array([v for j, v in rows if j == k and v is not None]) for k in "abc"}
    assert got == {k: tuple(pytest.approx(float(np.quantile(x, q)), abs=1e-6) for q in (0, 0.5, 0.95)) for k, x in by.items()}
    near = {r.k: r.v for r in ql.nearest_rank(d, ["k"], "v", 0.95).collect()}
    assert near == {k: sorted(x)[max(-(-95 * len(x) // 100), 1) - 1] for k, x in by.items()}
    assert ql.percentiles(d.filter("k = 'd'"), ["k"], "v", {"p": 0.5}).count() == 0
    assert [r.p for r in ql.percentiles(d.filter("k = 'd'"), [], "v", {"p": 0.5}).collect()] == [None]


def test_headings_and_their_numbers(spark):
    want = {"第一章 总则": ("chapter", 1), "第十二节 管理层讨论": ("section", 12), "二十一、重大事项": ("cn", 21), "（三）主要会计数据": ("cn_paren", 3), "1.2.3 研发投入": ("decimal3", 3), "3.5亿元": (None, None), "3.5 营业收入": ("decimal2", 5), "1.5倍": (None, None), "12、存货": ("arabic", 12), "2.3": (None, None), "（4）应收账款": ("arabic_paren", 4), "特别提示：": ("keyword", 0), "第百章": (None, None), "正文 1.2": (None, None), "": (None, None)}
    system, ordinal = vf.numbering(F.col("t"))
    got = {r.t: (r.s, r.n) for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", system.alias("s"), ordinal.alias("n")).collect()}
    assert got == want


def test_a_name_is_resolved_or_left_open(spark):
    codes = spark.createDataFrame([("c1", 7)], "code string, entity long")
    aliases = spark.createDataFrame([("one", 1), ("two", 2), ("two", 3), ("one", 1)], "alias string, entity long")
    asked = spark.createDataFrame([(1, "c1", "two", [2]), (2, None, "one", []), (3, "cx", "two", [3, 9]), (4, None, "two", [2, 3]), (5, None, "two", None), (6, None, "none", [1]), (7, None, None, None)], "id long, code string, name string, context array<long>")
    got = {r.id: (r.entity, r.confidence, r.layer) for r in en.resolve_names(asked, codes, aliases).collect()}
    assert got == {1: (7, "high", "code"), 2: (1, "high", "alias"), 3: (3, "medium", "context"), 4: (None, "low", "alias_ambiguous"), 5: (None, "low", "alias_ambiguous"), 6: (None, "low", "fuzzy"), 7: (None, "low", "fuzzy")}
