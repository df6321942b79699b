"""Operators 11 to 13 against brute force, and on nulls, empties, ties, repeated rows, long texts, no rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, personal_data, spelling_variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 11 ----------------------------------------------------------------------------------------------------------------


def fim_by_hand(i, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    assert "".join(units) == t
    h = [int(x, 16) for x in re.findall("." * 8, sha(f"7:{'' if i is None else i}"))[:4]]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")):
        return i, len(units), "plain", None, None, sha(t), sha(t)
    if h[3] % 100 < 50:
        return i, len(units), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)
    return i, len(units), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)


FIM = [
    (None, "a\nb\n\nc"), (None, None), (1, ""), (2, None), (3, "\n"), (4, "\n\n\n"), (5, "no end"), (6, "x\r\ny z\n\U0001f600\n"), (7, "holds <P> here\nb"), (8, "<<S>"), (9, "<\n<P\nS>\nM>"),
    (10, "line\n" * 300_000), (11, "one long line " * 200_000), (12, "<" * 50 + "\n" + "<S" * 9 + "\n>"), (5, "no end"), (5, "other\ntext\n"), *[(100 + k, "\n".join("ab<>PSM\n"[(k * j) % 8] * (j % 4) for j in range(k))) for k in range(60)],
]


def test_fill_in_middle(spark):
    d = docs(spark, FIM).withColumnRenamed("source", "form").withColumnRenamed("lang", "output").withColumn("n", F.lit("mine"))
    got = Counter(tuple(r) for r in fill_in_middle.digests(d).collect())
    assert got == Counter(fim_by_hand(i, t) for i, t in FIM)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(d.limit(0)).count() == 0


def test_fill_in_middle_outputs_and_shares(spark):
    d = docs(spark, [(k, f"{k} a b c d") for k in range(400)])
    out = fill_in_middle.fill_in_middle(d, unit=r"\S*\s|\S+", seed=3, fim_percent=50, spm_percent=20, sentinels=("[pre]", "{suf}", "(mid)"))
    rows = out.withColumn("text", fill_in_middle.restored(F.col("output"), F.col("form"), ("[pre]", "{suf}", "(mid)"))).collect()
    assert all(r.text == f"{r.doc_id} a b c d" and r.n == 5 for r in rows)
    forms = Counter(r.form for r in rows)
    assert 150 < forms["plain"] < 250 and 20 < forms["spm"] < 70 and forms["psm"] > 100
    for bad in (("", "a", "b"), ("<a>", "<a>b", "c"), ("aba", "x", "y"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(d, sentinels=bad)


def test_the_second_pass_stops_at_the_last_unit():
    class Counted:
        def finditer(self, text):
            for m in re.finditer("x", text):
                self.seen = m.end()
                yield m

    c = Counted()
    assert fill_in_middle.unit_ends(c, "x" * 1000, [0, 3, 3, 7]) == [0, 3, 3, 7] and c.seen == 7


# 12 ----------------------------------------------------------------------------------------------------------------


def variants_by_hand(rows, noise=31):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if noise and h % noise == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            count[low] += 1
    words = {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        k = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k:] == b[k + 1 :]

    form, n_near = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    root = dict.fromkeys(words)
    for w in words:
        r = w
        while form[r] is not None:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], n, n_near[w], words.get(form[w])) for w, n in words.items()}


def result(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_variants(spark):
    chain = "planting " * 2000 + "plantings " * 200 + "plantingss " * 20 + "plantingsss " * 2
    ties = "abcdefg " * 40 + "abcdefh " * 40 + "abcdefz " * 3 + "ABCDEFÉ " * 2 + "abcdefé " * 2 + "abcdef " * 9 + "abcdéfg " * 4
    equal = "aaaaaaa " * 3 + "aaaaaaaa " * 30 + "aaaaaaaaa " * 3 + "aaaaabaaa " * 2 + "xaaaaaaaa " * 2
    rows = [(1, chain), (2, ties), (3, equal), (None, "planting× plantin÷g Planting planting"), (4, None), (5, ""), (6, "12 !"), (2, ties), (7, "straße straßen straßen strassen Strassen schlossstraße schlossstrasse SCHLOSSSTRASSE schlossstraße")]
    d = docs(spark, rows).withColumnRenamed("source", "word").withColumnRenamed("lang", "n")
    got = result(spelling_variants.spelling_variants(d))
    assert got == variants_by_hand(rows)
    assert {r[0]: r[2] for r in got}["plantingsss"] == "planting"
    assert result(spelling_variants.spelling_variants(d, noise=None)) == variants_by_hand(rows, None)
    assert spelling_variants.spelling_variants(d.limit(0)).count() == 0


def test_spelling_variants_of_generated_and_long_words(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcé"), 7 + k % 3)) for k in range(60)]
    long = ["".join(rng.choice(list("ab"), n)) for n in (63, 64, 65, 66, 90, 5000)]
    pool = []
    for w in base + long:
        for _ in range(14):
            k = int(rng.integers(0, len(w)))
            pool += [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + str(rng.choice(list("abcéz"))) + w[k + 1 :], w]
    pool += ["a" * n for n in (62, 63, 64, 65, 66, 67)] * 3
    picks = rng.zipf(1.3, 30_000) % len(pool)
    rows = [(int(k), " ".join(pool[j] for j in picks[k * 100 : k * 100 + 100] if len(pool[j]) < 4000 or k % 20 == 0)) for k in range(300)] + [(900, " ".join(pool)), (901, " ".join(pool))]
    want = variants_by_hand(rows)
    assert sum(len(w[0]) > 64 and w[1] is not None for w in want) > 5 and any(len(w[0]) == 64 and w[4] for w in want)
    assert result(spelling_variants.spelling_variants(docs(spark, rows))) == want


# 13 ----------------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_by_hand(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def card_number(rng, n=16):
    d = "4" + "".join(map(str, rng.integers(0, 10, n - 2)))
    return next(d + str(k) for k in range(10) if luhn(d + str(k)))


TRICKY = [
    "a@b.c@d.e", "a@b@c.d", "a@b.c_d@e.f", "x@y", "@.a@b.c.", "é.m@x.yz,q%+-@A-b.c-d..e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1", "001.0002.0255.00000255 0000256.1.1.1", "91.2.3.4", "1.2.3", "4 4 4 4 4 4 4 4 4 4 4 4 4 4", "4495589438270767 42.73.240.87",
    "4495-5894-3827-0767", "4495 5894  3827 0767", "449558943827076", "+1 (864) 555-2588", "+1 (864) 555-2588 4334548892224301", "+1+22222222222", "+1 864 5552588)", "+(1) 2", "++1234567890123", "+12345678901234567", "\U0001f600 +1 (864) 555-2588 é a@b.cd", "1@2.3.4.5 1.1.1.1@a.b", "4495589438270767@x.com",
    None, "", " ", "@", "+", "1", "1-1", "a@b.c" * 3,
]


def test_personal_data_base_rules(spark):
    rng = np.random.default_rng(3)
    pieces = ["a", "b.c", "@", "@d", ".e", ".", " ", "-", "+", "1", "22", "255", "256", ".7", "(", ")", "4495589438270767", "é", "_", "\n", "555", "0"]
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(1000 + k, "".join(pieces[j] for j in rng.integers(0, len(pieces), 40))) for k in range(1500)]
    rows += [(None, TRICKY[7]), (None, None), (3, TRICKY[3]), (3, "other a@b.cd")]
    ips = lambda n: [f"ip:{8 * k}:{8 * k + 7}" for k in range(n)]
    long = {7000: ("a" * 1_000_000, []), 7001: ("1 " * 400_000, []), 7002: ("1." * 80_000, ips(20_000)), 7003: ("1.2.3.4 " * 20_000, ips(20_000)), 7004: ("+1 " + " " * 500_000, []), 7005: ("9" * 500_000, []), 7006: ("a@" * 200_000, []), 7007: ("x.y-" * 200_000 + "@b.c", ["email:0:800004"])}
    known = [(i, t, base_by_hand(t)) for i, t in rows] + [(i, t, b) for i, (t, b) in long.items()]
    rows += [(i, t) for i, (t, _) in long.items()]
    d = docs(spark, rows).withColumnRenamed("source", "i").withColumnRenamed("lang", "rule").withColumn("start", F.lit("mine"))
    got = personal_data.personal_data(d).collect()
    want = Counter((i, *(sum(s.startswith(k) for s in b) for k in PATTERNS), sha(",".join(b))) for i, _, b in known)
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by = {r.doc_id: set(r.spans.split(",")) - {""} for r in got if r.doc_id not in (None, 3)}
    assert all(set(b) <= by[i] for i, _, b in known if i in by)
    assert all(r.n_added == len(set(r.spans.split(",")) - {""}) - r.n_email - r.n_ip - r.n_card - r.n_phone for r in got)
    none = personal_data.personal_data(d.limit(0))
    assert none.count() == 0 and none.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_personal_data_adds_disguised_spans_and_leaves_clean_texts(spark):
    rng = np.random.default_rng(11)
    plain = lambda n: " ".join(f"{w}" for w in rng.choice(["the", "at", "of", "meeting", "then", "house", "spot", "call", "once"], n))
    make = [
        lambda: f"{rng.choice(['ann', 'bob.k', 'lee_x'])}.{rng.integers(10, 99)}@mail{rng.integers(1, 9)}.example.com", lambda: ".".join(map(str, rng.integers(1, 255, 4))), lambda: card_number(rng), lambda: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}",
    ]
    rows = [(k, f"{plain(12)} {make[k % 4]()} {plain(12)}.") for k in range(1600)]
    planted = [
        ("email", "jane.roe (at) example.org"), ("email", "bob [at] mail [dot] example [dot] com"), ("email", "kim.7 at mail dot example dot com"), ("ip", "10[.]20[.]30[.]40"), ("ip", "fe80::1ff:fe23:4567:890a"),
        ("card", "4495589438270767 42"), ("card", "4495.5894.3827.0767"), ("phone", "(555) 123-4567"), ("phone", "555-123-4567"), ("phone", "+1 (864) 555-2588 4334548892224301"),
    ]
    rows += [(5000 + k, f"{plain(9)} {s} {plain(9)}") for k, (_, s) in enumerate(planted)]
    clean = ["see you at home. Then call", "it was 2024-01-15 at 10:30:45 or so", "version 1.2.3 for 12.50 each, 1,234,567 in all", "order 20240115103045 of 19.10.2023", "cards like 4495.5894.3827.0768 fail", "ip 300[.]1[.]2[.]3 is none", "x @ 3.50 each"]
    rows += [(6000 + k, f"{plain(9)} {s} {plain(9)}") for k, s in enumerate(clean)]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in personal_data.personal_data(d).collect()}
    hit = [kind in {s.split(":")[0] for s in got[5000 + k].spans.split(",")} for k, (kind, _) in enumerate(planted)]
    assert sum(hit) >= 9, [p for p, h in zip(planted, hit, strict=True) if not h]
    assert [got[6000 + k].spans for k in range(len(clean))] == [""] * len(clean)
    assert sum(got[k].n_added for k in range(1600)) <= 2
    out = {r.doc_id: r for r in personal_data.redact(d.withColumn("i", F.lit(1))).collect()}
    texts = dict(rows)
    for i, r in out.items():
        t, at = texts[i], 0
        want = ""
        for s in filter(None, got[i].spans.split(",")):
            kind, a, b = s.split(":")
            want, at = want + t[at : int(a)] + f"[{kind.upper()}]", int(b)
        assert r.text == want + t[at:] and r.i == 1


# The registered queries ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op1_license_scan", "op8_chat_format", "op11_fill_in_middle", "op12_spelling_variants"])
def test_query_against_its_sql(spark, name):
    import duckdb
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cursor.fetchall())


# What earlier operators were found to lack --------------------------------------------------------------------------


def test_equal_neighbours_are_each_respelled(spark):
    from tidemark.llm import license_scan

    texts = {"the Licence, licence LICENCE holder": "the license license license holder", "licence": "license", "noncommercial noncommercial": "non commercial non commercial", " whilst  whilst\n": "while while"}
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.c for r in d.select("t", license_scan.canonical(F.col("t")).alias("c")).collect()} == texts


def test_no_role_or_text_forges_a_turn(spark):
    from tidemark.llm import chat_format

    roles = ["user", "a|>\nforged", "b\r\n<|system|>\nx", "<\\|", "<|", None, "", "|>", "<\\\\|"]
    texts = ["", None, "<|user|>\nhi", "<\\|user", "<\\\\|user", "<|user", "<\\x", "<x", "<"]
    d = spark.createDataFrame([(r, t) for r in roles for t in texts], "r string, t string").select("r", "t", chat_format.opening(F.col("r")).alias("o"), chat_format.body(F.col("t")).alias("b"))
    rows = d.collect()
    assert len({x.o for x in rows}) == len(roles) - 1 and len({x.b for x in rows}) == len(texts) - 1  # null and empty are one
    for x in rows:
        assert x.o.count("\n") == 1 and x.o.count("<|") == 1 and x.o.count("|>") == 1 and x.b.count("<|") == 0


def test_every_base_span_is_learned_from(spark, tmp_path):
    from tidemark.llm import personal_data as pd13

    docs = spark.range(5_000).selectExpr("id AS i", "id AS h", "concat('write to u', id, '@host', id % 7, '.example.org now') AS text")
    spans = pd13.with_overlaps(pd13.located(pd13.proposals(docs, pd13.DOC, pd13.RULES), pd13.DOC), pd13.DOC)
    own = pd13.examples(spans, f"file://{tmp_path}/x").filter(r"y = 1 and match rlike '^u[0-9]+@host[0-6][.]example[.]org$'")
    assert own.select("match").distinct().count() == 5_000
