"""The ordered checks and the vector index against slow versions, with every class and verdict in the registered queries."""

import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dual as du
from tidemark.operators import ordered as od
from tidemark.operators import vector_index as vi
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
CRITICAL = set("亿万千百十元%‰增减升降涨跌负亏盈零〇一二三四五六七八九两不未无非否同环末初美港欧日≥≤<>▲▼△▽↑↓±")
BODY = r"(?:(?:\d{1,3}(?:,\d{3})+(?!\d)|\d+)(?:\.\d+)?|\.\d+)"


def stream_by_hand(text):
    """Character by character: numbers first, then what stands outside them."""
    text = (text or "").translate(str.maketrans("０１２３４５６７８９．，％（）－＋", "0123456789.,%()-+")).translate({ord(c): "-" for c in "–—−"})
    lines = ["" if "|" in x and x.replace("|", "").strip() and set(re.sub(r"\s", "", x.replace("|", ""))) <= set("-:") else x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    text, out = "\n".join(lines), []
    taken = {}
    for m in re.finditer(rf"\(\s*-?{BODY}\s*%?\s*\)%?|(?<![0-9.])-?{BODY}%?|{BODY}%?", text):
        token = re.sub(r"[\s,]", "", m[0])
        out.append((m.start(), token[:-2] + "%)" if token.endswith(")%") else token))
        taken.update(dict.fromkeys(range(*m.span()), m.start()))
    out += [(i, c) for i, c in enumerate(text) if c in CRITICAL and i not in taken]
    for m in re.finditer(r"[-/*…]+|\.{2,}", text):
        a, b = m.span()
        if a in taken:
            continue
        stop = next((i for i in range(a, b) if i in taken), None)
        first, last = text.rfind("\n", 0, a) + 1, (text + "\n").find("\n", b)
        if a and text[a - 1].isalnum() or stop is None and text[b : b + 1].isalnum():
            continue
        if stop is None and (b - a == 1 and not text[first:a].strip() and text[b : b + 1] in (" ", "\t") or text[first:last].strip() == m[0] and b - a >= 3):
            continue
        out.append((a, text[a : stop or b]))
    return [t for _, t in sorted(out)]


def test_stream_against_a_slow_version(spark):
    rng = np.random.default_rng(2)
    pieces = ["增", "亿", "1", "23.5", "1,234", "-", "--", "—", " ", " ", "\n", "|", "%", "(", ")", "a", "…", "/", "*", "..", "，", "１", "≥", "x ", "- ", "---\n", "| - | :-: |\n"]
    texts = ["".join(pieces[k] for k in rng.integers(0, len(pieces), int(rng.integers(1, 25)))) for _ in range(3000)] + [None, "", "-5 增 - 3%", "(3.5)% -0.5 EPS-0.5 5-3 --5", "- item\n-\t-\n---\n..."]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.s for r in d.select("k", od.stream(F.col("t")).alias("s")).collect()}
    wrong = [(t, got[k], stream_by_hand(t)) for k, t in enumerate(texts) if got[k] != stream_by_hand(t)]
    assert not wrong, (len(wrong), wrong[:3])


def test_stream_difference_sees_swapped_numbers(spark):
    rows = [(1, "增 1 元 2", "增 2 元 1"), (2, "增 1", "增 1"), (3, None, ""), (4, "1 - 2", "1 2"), (5, "1", "1 2"), (6, "增 １", "增 1")]
    got = {r.k: (r.place, r.structured_token, r.source_token) for r in od.stream_difference(spark.createDataFrame(rows, "k long, a string, b string"), "k", "a", "b").collect()}
    assert got == {1: (2, "1", "2"), 2: (None,) * 3, 3: (None,) * 3, 4: (2, "-", "2"), 5: (2, None, "2"), 6: (None,) * 3}


def test_value_keys(spark):
    tokens = {"(1,234.50)": "1234.5", "-0.50%": "0.5", "007": "7", "100": "100", "0.0": "0", "0": "0", "1.20": "1.2", "+3": "3", "2023": "2023", "10.00": "10"}
    d = spark.createDataFrame([(k,) for k in tokens], "t string")
    assert {r.t: r.v for r in d.select("t", od.value_key(F.col("t")).alias("v")).collect()} == tokens


@pytest.mark.parametrize(("name", "classes"), [("invented_numbers", od.INVENTED), ("lost_numbers", ["header_footer", "chart", "inside_table", "other"]), ("missing_numbers", ["hit", "figure", "unexplained", "decor", "tokenization", "absent"])])
def test_every_class_occurs_and_they_add_up(spark, name, classes):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert all(any(r[c] for r in rows) for c in classes)
    total = {"invented_numbers": "excess", "missing_numbers": "total"}.get(name)
    assert not total or all(sum(r[c] for c in classes) == r[total] for r in rows)


def test_accounting_of_nulls_and_repeats(spark):
    t = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "5 5 5 7", "5 7", "5", "7", None, "5")], "k long, stored string, unexpanded string, layer string, image string, adjacent string, title string")
    got = {r.k: r.asDict() for r in od.invented_numbers(t, "k").collect()}
    assert got[1]["excess"] == 0 and got[2] == {"k": 2, "excess": 3, **dict.fromkeys(od.INVENTED, 0), "merge_expansion": 2, "image_ocr": 1}
    m = spark.createDataFrame([(1, "12 12 345 9", "9", "712", "12", None), (2, None, None, None, None, None)], "k long, reference string, candidate string, layer string, stripped string, figure_text string")
    got = {r.k: tuple(r)[1:] for r in od.missing_numbers(m, "k").collect()}
    assert got == {1: (4, 1, 0, 0, 1, 1, 1), 2: (0,) * 7}


def alignment_by_hand(gold, found):
    norm = lambda hs: [(re.sub(r"[\W_]+", "", t), x) for _, t, x in sorted(hs) if re.sub(r"[\W_]+", "", t)]
    gold, found = norm(gold), norm(found)
    known = {t for t, _ in gold}
    f, k = [], 0
    while k < len(found):
        if k + 1 < len(found) and found[k][1] == found[k + 1][1] and found[k][0] not in known and found[k + 1][0] not in known and found[k][0] + found[k + 1][0] in known:
            f.append((found[k][0] + found[k + 1][0], found[k][1]))
            k += 2
        else:
            f.append(found[k])
            k += 1
    pairs, least = [], 0
    for i, (t, _) in enumerate(f):
        j = next((j for j in range(least, len(gold)) if gold[j][0] == t), None)
        if j is not None:
            pairs.append((i, j))
            least = j + 1
    sign = lambda x: (x > 0) - (x < 0)
    agree = [sign(f[b][1] - f[a][1]) == sign(gold[d][1] - gold[c][1]) for (a, c), (b, d) in pairwise(pairs)]
    return sum((Counter(t for t, _ in f) & Counter(t for t, _ in gold)).values()), len(f), len(gold), sum(agree), len(agree)


def test_heading_alignment_against_a_slow_version(spark):
    rng = np.random.default_rng(4)
    make = lambda n: [(k, "".join(rng.choice(list("abc. "), int(rng.integers(1, 4)))), int(rng.integers(1, 4))) for k in range(n)]
    docs = {d: (make(int(rng.integers(0, 9))), make(int(rng.integers(0, 9)))) for d in range(300)}
    frame = lambda side: spark.createDataFrame([(d, *h) for d, x in docs.items() for h in x[side]], "d long, ordinal int, title string, level int")
    got = {r.d: tuple(r)[1:] for r in od.heading_alignment(frame(0), frame(1), "d").collect()}
    want = {d: alignment_by_hand(*x) for d, x in docs.items()}
    assert got == {d: w for d, w in want.items() if w[1] or w[2]}
    assert sum(w[4] > w[3] for w in want.values()) > 20


# The vector index --------------------------------------------------------------------------------------------------


def exact(rows, asked, k, allowed=None):
    x = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    return {(q, i, r) for q in asked for r, (_, i) in enumerate(sorted((-round(float(x[q] @ v), 6), i) for i, v in x.items() if allowed is None or i in allowed)[:k], 1)}


def test_vector_index_is_exact_and_skips_cells(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(k, (centres[k % 40] + rng.normal(size=16) * 0.1).tolist()) for k in range(3000)]
    odd = [(9001, None), (9002, []), (9003, [float("nan")] * 16), (9004, [1.0] * 15 + [None])]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    index = vi.build(v)
    q = v.filter("vec_id % 100 = 0 or vec_id > 9000").select(F.col("vec_id").alias("qid"), "embedding")
    found, compared = vi.search(index, q, first_probes=2)
    asked = range(0, 3000, 100)
    assert {(r.qid, r.vec_id, r["rank"]) for r in found.collect()} == exact(rows, asked, 10)
    p = vi.probes(index, v.filter("vec_id = 0").select(F.col("vec_id").alias("qid"), vi.normalised(F.col("embedding")).alias("qv"))).collect()
    assert len(index.blocks.select("block").collect()) >= len(p) and sum(r.reach > 0.99 for r in p) < len(p) / 3  # most cells can't hold a near vector
    assert max(r.n_candidates for r in compared.collect()) <= 300
    allowed = set(range(7, 3000, 50))
    got = vi.filtered_search(index, q, v.filter("vec_id % 50 = 7"), k=5)
    assert {(r.qid, r.vec_id, r["rank"]) for r in got.collect()} == exact(rows, asked, 5, allowed)


def test_vector_index_of_few_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("qid"), "embedding")
    for n in (0, 1, 2):
        part = v.filter(F.col("vec_id") <= n)
        assert vi.search(vi.build(part), q)[0].count() == 2 * n
    assert vi.search(vi.build(v), q.limit(0))[0].count() == 0


def test_index_recall_within_a_tenth(spark):
    r = catalogue.QUERIES["index_recall"](spark, SF).first()
    assert r.recall >= 0.95 and r.share <= 0.1 and r.n > 0


# Every verdict occurs ----------------------------------------------------------------------------------------------

VERDICTS = {
    "statement_page": ("statement", {True, False}), "description_check": ("problem", {"empty", "forbidden", "judging", None}), "skip_rules": ("skip", {"blank_page", "signature_tail", None}), "question_hygiene": ("ok", {True, False}), "bisected_windows": ("status", {"complete", "truncated"}),
    "stream_corrections": ("outcome", {"inserted", "corrected", "out_of_order"}), "numbering_classifier": ("system", {None, "keyword", "chapter", "section", "cn", "cn_paren", "decimal3", "decimal2", "arabic", "arabic_paren"}),
}


@pytest.mark.parametrize("name", VERDICTS)
def test_every_verdict_occurs(spark, name):
    column, wanted = VERDICTS[name]
    assert wanted <= {r[0] for r in catalogue.QUERIES[name](spark, SF).select(column).distinct().collect()}


def test_savings_name_every_rule(spark):
    rows = {r.rule: r for r in catalogue.QUERIES["skip_savings"](spark, SF).collect()}
    assert set(rows) == {"blank_page", "signature_tail", "research_disclaimer_tail"} and all(r.matched > 0 for r in rows.values()) and rows["research_disclaimer_tail"].skipped == 0


def tags_by_hand(md):
    parents = {"table": {""}, "thead": {"table"}, "tbody": {"table"}, "tr": {"table", "thead", "tbody"}, "td": {"tr"}, "th": {"tr"}}
    found, stack, at = set(), [], 0
    for m in [*re.finditer(r"(?is)<(/?)(table|thead|tbody|tr|td|th)\b([^>]*)>", md), None]:
        text = re.sub(r"(?i)<br\b[^>]*>|\s+", "", md[at : m.start() if m else len(md)])
        if stack and stack[-1] in ("table", "thead", "tbody", "tr") and text:
            found.add("stray_text")
        if m is None:
            break
        at, name = m.end(), m[2].lower()
        if m[3].rstrip().endswith("/"):
            found.add("self_closing")
        elif m[1]:
            if stack and stack[-1] == name:
                stack.pop()
            else:
                found.add("unpaired")
        else:
            if (stack[-1] if stack else "") not in parents[name]:
                found.add("misplaced")
            stack.append(name)
    return sorted(found | ({"unclosed"} if stack else set()))


def test_tag_stack_against_a_slow_version(spark):
    rng = np.random.default_rng(3)
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<TH colspan=2>", "</th>", "<tbody>", "</tbody>", "<td/>", "<br/>", " ", "x", "\n", "<b>"]
    whole = "<table><tr><td>x</td></tr></table>"
    texts = ["".join(pieces[k] for k in rng.integers(0, len(pieces), int(rng.integers(0, 14)))) for _ in range(1500)] + [whole, whole * 3, "<table><tbody><tr><td>x</td> <br> <th>y</th></tr></tbody></table> after", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.v for r in d.select("k", du.tag_violations(F.col("t")).alias("v")).collect()}
    assert got == {k: tags_by_hand(t) for k, t in enumerate(texts)}
    assert got[1500] == got[1501] == got[1502] == [] and {x for v in got.values() for x in v} == {"stray_text", "self_closing", "unpaired", "misplaced", "unclosed"}


LOST, INVENTED = ["layer", "output", "header", "chart_text", "table_words"], ["stored", "unexpanded", "layer", "image", "adjacent", "title"]


def test_numbers_are_accounted_where_their_texts_are_read(spark):
    t = spark.createDataFrame([(1, "12 345"), (None, "7 7"), (2, None)], "k long, a string")
    for f, names in ((od.missing_numbers, ["reference", "candidate", "layer", "stripped", "figure_text"]), (od.lost_numbers, LOST), (od.invented_numbers, INVENTED)):
        got = f(t.select("k", *[(F.col("a") if i == 0 else F.lit("")).alias(n) for i, n in enumerate(names)]), "k")
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.k: r[1] for r in got.collect()} == ({1: 2, None: 2, 2: 0} if f is not od.lost_numbers else {1: 0, None: 0, 2: 0})


def test_digits_within_runs_are_those_that_a_search_finds():
    runs = {str(7**i)[: i % 23 + 1] for i in range(1, 200)} | {"9" * 200, ""}
    asked = {r[i : i + n] for r in list(runs)[:60] for i in (0, 3) for n in (1, 2, 5, 70) if r[i : i + n]} | {"0000001", "9" * 201, "12345"}
    assert od.within(asked, runs) == {x for x in asked if any(x in r for r in runs)}


def test_lines_of_an_order_are_shuffled_once(spark):
    plan = catalogue.QUERIES["missing_numbers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
