"""The training-data operators on small tables against brute force, and on nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, embedding_dedup, graph, language_id, license_scan, minhash_dedup, mixing, token_output, toxicity, warc
from tidemark.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def words(n, seed, vocabulary=4000):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n))


# 1 -----------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    from tidemark.llm.license_texts import LICENSES

    mit = ("MIT License\n\nCopyright (c) 2020 Someone Else\n\n" + LICENSES["MIT"][0]).upper().replace("SUBLICENSE", "Sublicence")
    isc = "Copyright (c) 2004-2010 by Someone\n" + LICENSES["ISC"][0].replace("the above copyright notice", "the above\ncopyright notice").replace("OR CONSEQUENTIAL", "OR\nCONSEQUENTIAL")
    rows = [(1, mit), (2, mit + " and more"), (3, None), (4, ""), (5, "Licenced under the Apache Licence,\n version 2.0!"), (1, mit), (6, isc), (7, "The MIT License (MIT)\nCopyright © 1999 X\n" + LICENSES["MIT"][0]), (8, LICENSES["Unlicense"][0].split(" In jurisdictions")[0]), (9, "漢字 лицензия"), (10, "другая"), (11, "***"), (12, "word " * 200_000)]
    d = docs(spark, rows).withColumn("digest", F.lit("mine")).withColumn("license_id", F.lit("mine"))
    got = license_scan.scan_licenses(d, license_scan.known_digests(spark)).collect()
    assert sorted((r.doc_id, r.license_id) for r in got) == [(1, "MIT"), (1, "MIT"), (2, None), (3, None), (4, None), (5, "Apache-2.0-line"), (6, "ISC"), (7, "MIT"), (8, None), (9, None), (10, None), (11, None), (12, None)]
    by = {r.doc_id: r for r in got}
    assert by[3].digest is None and by[4].digest == by[11].digest and len({by[i].digest for i in (4, 9, 10)}) == 3 and by[12].n_canonical == 999_999
    assert license_scan.scan_licenses(d.limit(0), license_scan.known_digests(spark)).count() == 0
    twice = license_scan.known_digests(spark, [("b", "Same text."), ("a", "same TEXT")], {"c": ["00"], "d": ["00"]})
    assert sorted((r.license_id) for r in twice.collect()) == ["a", "c"]


def test_whole_licence_files_are_known(spark):
    from pathlib import Path

    files = {"MPL-2.0": "MPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "CC0-1.0": "CC0-1.0"}
    there = [(k, f) for k, f in enumerate(files) if Path("/usr/share/common-licenses", f).exists()]
    if not there:
        pytest.skip("no licence files on this machine")
    whole = [(k, Path("/usr/share/common-licenses", f).read_text()) for k, f in there]
    d = docs(spark, whole + [(100 + k, "  " + t.upper().replace("\n", " \r\n") + "\n\n") for k, t in whole if "GNU" not in t])
    got = {r.doc_id: r.license_id for r in license_scan.scan_licenses(d, license_scan.known_digests(spark)).collect()}
    assert got == {i: list(files.values())[i % 100] for i in got} and len(got) > len(there)


# 2 -----------------------------------------------------------------------------------------------------------------


def fill_by_hand(children, budget):
    """Water-filling by bisection of the level."""
    if sum(c for _, _, c in children) <= budget:
        return {n: c for n, _, c in children}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for _, w, c in children) < budget else (low, mid)
    return {n: min(c, w * low) for n, w, c in children}


def test_mix_budgets_match_water_filling(spark):
    leaves = [("a", "x", "s1", 10), ("a", "x", "s2", 500), ("a", "y", "s3", 40), ("b", "x", "s4", 5), ("b", "x", "s5", 7), ("c", "z", "s6", 1000)]
    weights = spark.createDataFrame([("domain", "a", 1.0), ("domain", "b", 5.0), ("domain", "c", 2.0), ("source", "s2", 3.0)], "level string, name string, weight double")
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, available long")
    got = {r.source: r.given for r in mixing.budgets(df, weights, 600.0, 2).collect()}
    top = fill_by_hand([("a", 1, 1100), ("b", 5, 24), ("c", 2, 2000)], 600)
    a = fill_by_hand([("x", 1, 1020), ("y", 1, 80)], top["a"])
    want = {**fill_by_hand([("s1", 1, 20), ("s2", 3, 1000)], a["x"]), "s3": a["y"], "s4": 10, "s5": 14, "s6": top["c"]}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(600)


def test_mix_takes_shortest_prefix_of_seeded_epochs(spark):
    rows = [(i, words(5 + i % 7, i)) for i in range(300)]
    d = docs(spark, rows).withColumn("_mix_h", F.lit(1))
    weights = spark.createDataFrame([("source", "src0", 4.0)], "level string, name string, weight double")
    out = mixing.mix(d, weights, F.lit("one"), budget=3000, max_epochs=3)
    assert out.columns == [*d.columns[:-1], "epoch"]
    got = out.collect()
    again = mixing.mix(d, weights, F.lit("one"), budget=3000, max_epochs=3).collect()
    assert sorted((r.doc_id, r.epoch) for r in got) == sorted((r.doc_id, r.epoch) for r in again)
    n = {i: len(t.split()) for i, t in rows}
    avail = {s: sum(n[i] for i in n if i % 3 == s) for s in range(3)}
    given = fill_by_hand([(0, 4, 3 * avail[0]), (1, 1, 3 * avail[1]), (2, 1, 3 * avail[2])], 3000)
    for s in range(3):
        mine = [r for r in got if r.doc_id % 3 == s]
        total = sum(n[r.doc_id] for r in mine)
        assert given[s] - 1 <= total < given[s] + 12  # the last document crosses the budget
        per = [sum(r.epoch == e for r in mine) for e in range(3)]
        assert per == sorted(per, reverse=True)
    few = docs(spark, [(1, None), (None, "a b"), (2, ""), (2, "")])
    assert mixing.mix(few, weights, F.lit(None).cast("string")).count() >= 3
    assert mixing.mix(few.limit(0), weights, F.lit("d")).count() == 0


def test_mix_prefixes_against_brute_force(spark):
    rows = [(i, words(3 + (i * 7) % 40, i) if i % 11 else None) for i in range(400)] + [(7, words(9, 1)), (7, words(9, 1)), (None, words(2000, 2)), (None, "a b")]
    d = docs(spark, rows)
    weights = spark.createDataFrame([("source", "src0", 5.0), ("source", "src1", 1.0), ("source", "src2", 0.2)], "level string, name string, weight double")
    size = lambda t: max(1, len((t or "").split()))
    leaf = lambda i: f"src{(i or 0) % 3}"
    avail = {s: sum(size(t) for i, t in rows if leaf(i) == s) for s in ("src0", "src1", "src2")}
    leaves = spark.createDataFrame([("one", "en", s, n) for s, n in avail.items()], "domain string, lang string, source string, available long")
    given = {r.source: r.given for r in mixing.budgets(leaves, weights, 9000.0, 3).collect()}
    keyed = [(k, i, t) for k, (i, t) in enumerate(rows)]
    h = {(r.k, r.e): r.h % 2**64 for r in spark.createDataFrame([(k, str(i) if i is not None else "", e) for k, i, _ in keyed for e in range(4)], "k int, key string, e int").select("k", "e", F.xxhash64(F.lit(17), "e", "key").alias("h")).collect()}
    want = []
    for s in avail:
        mine = [x for x in keyed if leaf(x[1]) == s]
        full = int(given[s] / avail[s] + 1e-9)
        rest = round(given[s] - full * avail[s])
        want += [(i, t, e) for e in range(full) for _, i, t in mine]
        taken, last = 0, None
        for k, i, t in sorted(mine, key=lambda x: (h[x[0], full], str(x[1]) if x[1] is not None else "")):
            key = (h[k, full], i)
            if taken >= rest and key != last:
                break
            if rest:
                want.append((i, t, full))
            taken, last = taken + size(t), key
    got = [(r.doc_id, r.text, r.epoch) for r in mixing.mix(d, weights, F.lit("one"), budget=9000, max_epochs=3).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(got, key=order) == sorted(want, key=order)


# 3 -----------------------------------------------------------------------------------------------------------------


def brute_links(rows):
    good = {i: (np.array(e, float), l) for i, e, l in rows if l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    links = {i: set() for i, _, _ in rows}
    for i, (a, la) in good.items():
        for j, (b, lb) in good.items():
            if i != j and la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i].add(j)
    return links


def closure(links):
    comp = {}
    for i in sorted(links):
        if i not in comp:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in comp:
                    comp[j] = i
                    stack += links[j]
    return comp


def test_embedding_dedup_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, [float(x) for x in centre + rng.normal(size=16) * 0.12 * (1 + c % 3)], c % 2) for k in range(40)]
    rows += [(600, rows[0][1], rows[0][2]), (601, rows[0][1], None), (602, None, 0), (603, [0.0] * 16, 0), (604, [1.0, None] + [1.0] * 14, 0), (605, [float("nan")] + [1.0] * 15, 1), (606, [float("inf")] + [1.0] * 15, 1), (607, [], 1), (608, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + [rows[5]], "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit(7))
    rows = [(r.vec_id, r.embedding, r.label) for r in df.dropDuplicates(["vec_id"]).collect()]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=32).collect()}
    links = brute_links(rows)
    found, wanted = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert set(got) == set(links) and wanted > 1000
    assert found >= 0.99 * wanted and all(r.n_links <= len(links[i]) for i, r in got.items())
    comp = closure(links)
    assert sum(r.component_id == comp[i] for i, r in got.items()) >= 0.99 * len(got)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(601, 609))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_on_a_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    x = np.stack(p.embedding.map(lambda v: np.asarray(v, np.float64)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.where((p.label.to_numpy()[:, None] == p.label.to_numpy()) & ~np.eye(len(p), dtype=bool), x @ x.T, -1.0)
    for threshold in (0.93, float(np.sort(cos, axis=None)[-4000])):  # and one that some two thousand pairs reach
        want = dict(zip(p.vec_id, (cos >= threshold).sum(axis=1), strict=True))
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, threshold=threshold).collect()}
        assert set(got) == set(want) and all(got[i] <= want[i] for i in want)
        assert sum(got.values()) >= 0.999 * sum(want.values())


def test_embedding_pairs_at_the_threshold(spark):
    exact = [[3.0, 4.0], [4.0, 3.0], [3.0, 4.0], [0.0, 2.0]]  # cosines 0.96, 0.8 and 0.6; 0.93 itself isn't representable, 0.96 is compared with itself below
    c = float(np.dot([3.0, 4.0], [4.0, 3.0]) / 25)
    df = spark.createDataFrame([(i, v, 7) for i, v in enumerate(exact)], "vec_id long, embedding array<double>, label int")
    for threshold, links in ((c, [2, 2, 2, 0]), (np.nextafter(np.nextafter(np.nextafter(c, 1), 1), 1), [1, 0, 1, 0])):
        got = embedding_dedup.near_duplicates(df, threshold=threshold).orderBy("vec_id").collect()
        assert [r.n_links for r in got] == links


def test_embedding_runs_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=12)
    rows = [(i, [float(z) for z in centre + rng.normal(size=12) * 0.02], 1) for i in range(300)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()
    links = brute_links(rows)
    assert {r.vec_id: r.n_links for r in got} == {i: len(x) for i, x in links.items()} and {r.component_id for r in got} == {0}


def test_embedding_recall_at_the_threshold(spark):
    for most in (10, 10**4, 10**6, 10**8):
        bits = embedding_dedup.bits_for(most)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** embedding_dedup.passes_for(bits, 0.93) <= 1e-4
    rng = np.random.default_rng(12)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    x = np.stack([a, 0.9305 * a + np.sqrt(1 - 0.9305**2) * o / np.linalg.norm(o, axis=1, keepdims=True)], axis=1).reshape(-1, 64)
    df = spark.createDataFrame([(1, i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)], "label long, vec_id long, m long, v binary")
    bits = embedding_dedup.bits_for(10**6)
    got = embedding_dedup.signatures(df, bits, embedding_dedup.passes_for(bits, 0.93), 5, 8).orderBy("vec_id").select("sigs").collect()
    sigs = np.array([r.sigs for r in got])
    assert (sigs[::2] == sigs[1::2]).any(axis=1).sum() >= 1998


# 4 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    bad = ["blargh", "zotting", "krumpet"]
    rows, labels = [], []
    for i in range(900):
        w = words(60, i, 500).split()
        y = int(i % 3 == 0 or i % 7 == 0)
        for _ in range(2 * y):
            w.insert(int(rng.integers(0, len(w))), bad[int(rng.integers(0, 3))])
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    d = docs(spark, rows + [(2000, None), (2001, ""), (None, "a")]).withColumn("toxicity", F.lit("x"))
    l = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, l).collect()}
    truth = dict(labels)
    held = [i for i in truth if got[i].held_out]
    assert held and all((zlib.crc32(str(i).encode()) % 3 == 1) == got[i].held_out for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2000].score == got[2001].score and got[2000].predicted == 0
    again = docs(spark, [(1, words(60, 1, 500)), (1, words(60, 1, 500)), (2, "blargh zotting " + words(40_000, 2, 500))])
    three = toxicity.score(again, toxicity.learn(d, l)).orderBy("doc_id").collect()
    assert len(three) == 3 and three[0].toxicity == three[1].toxicity == got[1].score
    assert toxicity.score_documents(d.limit(0), l).count() == 0
    exact = toxicity.score_documents(d, spark.createDataFrame([(0, 1)], "doc_id long, toxic int"), threshold=1.0)
    assert {(r.score, r.predicted) for r in exact.collect()} == {(1.0, 1)}
    assert {r.score for r in toxicity.score_documents(d, l.limit(0)).collect()} == {0.0}


def test_compression_windows_cover_the_text():
    t = "A " * 30 + "y" * 300 + "\n b"
    plain = " " + " ".join(t.lower().split()) + " "
    at = toxicity.bounds(plain)
    assert at[0][0] == 0 and at[-1][1] == len(plain) and all(b - a <= toxicity.LONGEST for a, b in at)
    assert all(c < b and d > b for (_, b), (c, d) in zip(at, at[1:], strict=False))  # each begins within the one before
    assert b"".join(toxicity.windows("one")) == toxicity.coded(" one ") and len(toxicity.coded("abc")) == 3
    assert toxicity.windows(None) == toxicity.windows("") == toxicity.windows(" \n") == []
    long = toxicity.windows("word " * 300_000)
    assert len(long) >= 300_000 // toxicity.WINDOW_WORDS


def test_distances_equal_compression_done_by_hand():
    import zstandard

    ordinary, toxic = toxicity.dictionaries([toxicity.windows(f"{words(100, i, 500)} blargh {words(9, 500 + i, 500)} zotting") for i in range(200)], [toxicity.windows(words(120, 900 + i, 500)) for i in range(400)])
    assert len(ordinary) > 0 and len(toxic) > 0
    p = zstandard.ZstdCompressionParameters(strategy=1, hash_log=17, chain_log=17, search_log=1, target_length=0, min_match=6, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
    texts = toxicity.windows("w1 w2 w3 w4 blargh w5 zotting w6 w7 blargh zotting")
    by_hand = [len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(ordinary, dict_type=1), compression_params=p).compress(w)) - len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(toxic, dict_type=1), compression_params=p).compress(w)) for w in texts]
    assert toxicity.Distance(ordinary, toxic).of(texts).tolist() == by_hand
    assert max(by_hand) > 5


# 5 -----------------------------------------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    texts = ["Hello  World", None, "", "naïve É́ café don't\tstop\r\n x 123 4.5!!", "a<|endoftext|>b <|startoftext|>", " \n ", "日本語 テスト", words(9000, 1), "Hello  World", "x y ́z ΑΣ ἙΛΛΑΣ İ", "<| |>"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(8, "Hello  World"), (None, "null id")]
    d = docs(spark, rows).withColumn("start", F.lit(5))
    got = token_output.encode_documents(d, vocabulary()).collect()
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    got.sort(key=lambda r: r.start)
    assert [r.n_tokens for r in got] == [len(w) for w in want]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]
    assert token_output.encode_documents(d.limit(0), vocabulary()).count() == 0


def test_sequences_have_equal_length_and_views(spark, tmp_path):
    d = docs(spark, [(i, words(40, i)) for i in range(30)])
    m = token_output.write_sequences(d, f"file://{tmp_path}/t", vocabulary(), length=16)
    r = m.collect()[0]
    ids, mask = token_output.random_sequences(r.path, [0, 1])[1]
    assert len(ids) == 16 and mask.all() and not ids.flags.owndata
    full = token_output.read_documents(m, with_ids=True).orderBy("doc_id").first().input_ids
    assert list(ids[:8]) == full[16:24] or len(full) < 24


# 6 -----------------------------------------------------------------------------------------------------------------


def contaminated_by_hand(texts, items):
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate({c: c + 32 for c in range(65, 91)})) if t else []
    out = {}
    for i, t in texts:
        w, hit, found = low(t), set(), set()
        for k, x in items:
            x = low(x)
            n = min(13, len(x))
            grams = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(str(k))
        names = ",".join(sorted(found))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontamination_against_brute_force(spark):
    items = [(k, words(10 + 3 * k, 100 + k, 300)) for k in range(8)] + [(20, "É one TWO"), (21, ""), (22, None), (23, "W7"), (10, words(15, 7, 300))]
    base = [(i, words(80, i, 300)) for i in range(40)]
    texts = [(i, t if i % 4 else t + " " + items[i % 8][1].upper() + ", " + (items[i % 8][1] if i % 8 else "")) for i, t in base]
    texts += [(100, None), (101, ""), (102, "--É  one;two"), (103, items[3][1] * 3), (104, "é one two"), (105, " ".join(items[5][1].split()[:12])), (106, items[6][1] + " " + words(600, 9))]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    d = docs(spark, texts + [texts[0]])
    rows = decontaminate.contamination(d, b).collect()
    want = contaminated_by_hand(texts, items)
    assert len(rows) == len(texts) + 1
    twins = docs(spark, [(0, None), (None, items[2][1]), (None, "none"), (7, items[2][1]), (7, "other words"), (8, items[2][1] + " zz" * 30_000)]).withColumn("term", F.lit("mine"))
    got = sorted((r.doc_id is None, r.n_hit, r.contaminated) for r in decontaminate.contamination(twins, b).collect())
    n = len(items[2][1].split())
    assert got == sorted([(False, 0, False), (True, n, True), (True, 0, False), (False, n, True), (False, 0, False), (False, n, False)])
    left = decontaminate.clean(twins, b)
    assert left.columns == twins.columns and sorted(str(r.text)[:11] for r in left.collect()) == sorted(["None", "none", "other words", items[2][1][:11]])
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0}


def test_proximity_finds_scattered_words(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    d = docs(spark, [(1, "x gamma y alpha z beta"), (2, "alpha x x x x x x beta gamma"), (3, "alpha beta"), (4, "beta gamma alpha")])
    got = {r.doc_id: r.distance for r in decontaminate.proximity_matches(d, b, slop=2).collect()}
    assert got == {1: 5, 4: 3}


def nearest_by_hand(texts, items, slop, window):
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) if t else []
    out = {}
    for i, t in texts:
        w = low(t)
        for k, x in items:
            x = low(x)
            n = min(window, len(x))
            for first in range(len(x) - n + 1 if n else 0):
                need = set(x[first : first + n])
                for a in range(len(w)):
                    for b in range(a, min(len(w), a + n + slop)):
                        if w[a] in need and need <= set(w[a : b + 1]):
                            key = (i, str(k), first)
                            out[key] = min(out.get(key, 99), b - a + 1)
                            break
    return out


def test_proximity_against_brute_force(spark):
    items = [(k, words(4 + k, 40 + k, 12)) for k in range(4)] + [(9, None), (10, "")]
    texts = [(i, words(60, i, 14)) for i in range(12)] + [(20, None), (21, ""), (22, "w1"), (0, words(60, 0, 14))]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts).withColumn("pos", F.lit("mine"))
    for slop, window in ((0, 3), (3, 4), (70, 6)):
        want = nearest_by_hand(texts, items, slop, window)
        got = {(r.doc_id, r.item_id, r.first): r.distance for r in decontaminate.proximity_matches(d, b, slop, window).collect()}
        assert got == want and len(want) > 10
    assert decontaminate.proximity_matches(d.limit(0), b, 2).count() == 0


def test_proximity_of_items_that_share_an_id(spark):
    items = [(1, "a b c"), (1, "x y z"), (1, "x y"), (1, "y x y"), (1, "x y z")]
    texts = [(1, "a b c"), (2, "x y z"), (3, "q q x z y"), (4, "x a y"), (5, "y y"), (6, "c q q b a")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), docs(spark, texts)
    want = nearest_by_hand(texts, items, 1, 13)
    rows = decontaminate.proximity_matches(d, b, 1).collect()
    assert {(r.doc_id, r.item_id, r.first): r.distance for r in rows} == want and len(rows) == len(want) == 4


def shuffled_rows(spark, run) -> int:
    """Rows that stages write to shuffles while run() runs, where no table is small enough to be broadcast unasked."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def so_far():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), so_far()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return sum(n for k, n in so_far().items() if k not in before)


def test_proximity_shuffles_only_the_rarest_words(spark, monkeypatch):
    """An item's common words are in all texts, its rare ones in few; the same without any broadcast, with null and shared ids."""
    common = lambda k, n: words(n, k, 20)
    items = [(k, f"{common(k, 4)} rare{k} {common(k + 50, 3)} odd{k} {common(k + 90, 3)}") for k in range(3)] + [(7, "odd1"), (8, "rare2 rare2 w1 rare2")]
    near = [f"{common(i, 15 + i)} {' '.join(sorted(items[i % 3][1].split()))} {common(i, 7)}" for i in range(20)]
    texts = [(i, common(200 + i, 60)) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(near)] + [(None, near[4]), (None, near[5]), (1000, near[7]), (1001, near[1]), (2000, "rare2 w1 w2 rare2"), (2001, "odd1"), (2002, "rare0 " + common(1, 30) + " odd0")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), docs(spark, texts)
    want, got = nearest_by_hand(texts, items, 3, 9), {}
    find = lambda: got.update({(r.doc_id, r.item_id, r.first): r.distance for r in decontaminate.proximity_matches(d, b, 3, 9).collect()})
    assert shuffled_rows(spark, find) < sum(len(t.split()) for _, t in texts) / 5
    assert got == want and len(want) > 50 and {None, 1000, 2000, 2001} <= {k[0] for k in want}
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    got.clear()
    find()
    assert got == want


# 7 -----------------------------------------------------------------------------------------------------------------


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 3 * language_id.CHUNK, 6)
        s = rng.normal(size=(lengths.sum(), 3)) * 3
        path, at = language_id.viterbi(s, lengths, 2.0), 0
        for n in lengths:
            v = s[at].copy()
            for t in range(1, n):
                v = np.maximum(v, v.max() - 2.0) + s[at + t]
            p = path[at : at + n]
            assert v.max() == pytest.approx(s[np.arange(at, at + n), p].sum() - 2.0 * (p[1:] != p[:-1]).sum())
            at += n


def test_language_id(spark):
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "ter", "ung"], "ru": ["при", "вет", "ска"]}
    make = lambda l, n, seed: " ".join("".join(np.random.default_rng([seed, k]).choice(syllables[l], 3)) for k in range(n))
    rows = [(i, make(l, 30, i), l) for i in range(300) for l in [list(syllables)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (903, make("aa", 40, 5) + " " + make("bb", 10, 6), None), (None, make("bb", 9, 1), "bb"), (904, "漢字", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language_id.predict_languages(d).collect()}
    assert np.mean([got[i].lang_pred == l for i, _, l in rows[:300]]) > 0.98
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and got[900].score == 0
    assert got[904].lang_pred in syllables and 0 <= got[904].score <= 0.5 and 0.6 < got[903].score < 1
    spans = language_id.identify(d.filter("doc_id = 903"), language_id.learn(d), spans=True).first().lang_spans
    assert [s.lang for s in spans] == ["aa", "bb"] and abs(spans[0].char_to - 280) <= 7 and spans[0].char_from == 0 and spans[1].char_to == len(rows[303][1])
    assert language_id.predict_languages(d.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predict_languages(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_one_label_is_taken_only_where_it_is_the_best_path():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 60, 400)
    s = rng.normal(size=(lengths.sum(), 3)) * 2 + np.repeat(rng.normal(size=(400, 3)) * 3, lengths, axis=0)
    label, settled = language_id.constant(s, lengths, 8.0)
    path = language_id.viterbi(s, lengths, 8.0)
    ends = np.cumsum(lengths)
    assert 20 < settled.sum() < 400
    for d in np.flatnonzero(settled):
        assert (path[ends[d] - lengths[d] : ends[d]] == label[d]).all()


def test_units_lose_no_gram_of_long_or_mixed_words():
    text = "x" + "abcdefgh" * 40 + "приветabc漢字 q  \u00a0 12"
    cp, kind, first = language_id.read([text, "", "z"])
    starts, spaced = language_id.units(kind)
    grams = sum(int((s < language_id.SLOTS).sum()) for s in language_id.gram_slots(cp, kind))
    assert grams == sum(len(w) + 2 - n + 1 for w in [*text.split(), "z"] for n in language_id.ORDERS if len(w) + 2 >= n)
    assert (np.diff(starts) > 0).all() and np.diff(starts).max() <= language_id.PIECE + 6
    at = starts + spaced
    assert {"п", "a", "漢", "x", "z"} <= {chr(cp[a]) for a in at} and list(first) == [0, len(text) + 1, len(text) + 2]


def test_long_text_without_spaces_is_read_throughout(spark):
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "ter", "ung"]}
    make = lambda l, n, seed, sep: sep.join("".join(np.random.default_rng([seed, k]).choice(syllables[l], 3)) for k in range(n))
    fit = [(i, make(l, 30, i, " "), l) for i in range(120) for l in [list(syllables)[i % 2]]]
    ends = make("aa", 6, 1, "")
    rows = [(900, ends + make("bb", 2500, 2, "") + ends, None), (901, make("aa", 2000, 3, "-") + make("bb", 900, 4, "/"), None), (901, make("aa", 2000, 3, "-") + make("bb", 900, 4, "/"), None)]
    model = language_id.learn(spark.createDataFrame(fit, "doc_id long, text string, lang string"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(d, model, spans=True).orderBy("doc_id").collect()
    whole = language_id.identify(d, model, spans=True, batch_chars=4096).orderBy("doc_id").collect()
    assert len(rows[0][1]) > 20_000 and [r.lang_pred for r in got] == ["bb", "aa", "aa"] == [r.lang_pred for r in whole]
    assert got[0].score > 0.98 and [s.lang for s in got[0].lang_spans] == ["aa", "bb", "aa"] and 0.4 < got[1].score < 0.7
    assert abs(got[0].lang_spans[0].char_to - len(ends)) <= language_id.PIECE and abs(whole[0].score - got[0].score) < 0.01


# 8 -----------------------------------------------------------------------------------------------------------------


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "bye"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", None), (3, 0, "user", None), (4, 0, "user", "x"), (6, 0, "a", "b"), (7, 0, "a", "b"), (7, 1, "assistant", "c<|user|>"), (7, 1, "assistant", "c<|user|>"), (None, 0, "u", "t"), (8, None, "u", "t")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(0))
    got = {r.pair_id: r for r in chat_format.format_preferences(c, chat_format.pairs_by_neighbour(c)).collect()}
    assert set(got) == {0, 1, 3}
    assert got[0].prompt == "<|user|>\nhi\n" and got[0].chosen == "<|assistant|>\nyes\n<|user|>\nbye\n" and got[0].rejected == "<|assistant|>\nno\n"
    assert (got[0].chosen_mask, got[0].rejected_mask) == ("14-18", "14-17") and got[0].chosen[14:18] == "yes\n"
    assert got[1].n_prefix == 1 and got[1].chosen == got[1].rejected == got[1].chosen_mask == ""
    assert got[3].n_prefix == 1 and got[3].chosen == "" and got[3].rejected == "<|assistant|>\nc<\\|user|>\n" and got[3].rejected_mask == "14-25"
    assert chat_format.format_preferences(c.limit(0), chat_format.pairs_by_neighbour(c.limit(0))).count() == 0


def test_answers_of_another_conversation(spark):
    long = "word " * 200_000
    rows = [(5, 0, "system", "s"), (5, 1, "user", long), (5, 2, "assistant", "good"), (5, 3, "user", "thanks"), (6, 0, "assistant", "bad"), (6, 1, "user", "x"), (8, 0, "assistant", "none after")]
    c = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string").withColumn("side", F.lit("x"))
    got = chat_format.format_preferences(c, chat_format.pairs_by_other_answer(c)).collect()
    assert len(got) == 1 and got[0].pair_id == 5 and got[0].n_prefix == 2 and long in got[0].prompt
    assert got[0].chosen == "<|assistant|>\ngood\n<|user|>\nthanks\n" and got[0].rejected == "<|assistant|>\nbad\n" and got[0].rejected_mask == "14-18"


# 9 -----------------------------------------------------------------------------------------------------------------


def shingle_set(t, width=4):
    w = re.findall("[^\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)})) if t else []
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_texts():
    rng = np.random.default_rng(2)
    rows = []
    for g in range(25):
        base = words(20 + 12 * g, g).split()
        for k in range(8):
            w = list(base)
            for _ in range(rng.integers(0, 2 + len(w) // 25)):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 999)}"
            rows.append((1000 - len(rows), " ".join(w) if k % 3 else "  " + " ".join(w).upper() + "\n"))
    return rows + [(0, None), (1, ""), (2, "one two"), (3, "ONE\ttwo"), (4, "   "), (5, "é a b c"), (6, "É a b c")]


def test_minhash_components_against_all_pairs(spark):
    rows = near_texts()
    d = docs(spark, rows + [rows[0], (None, "x y z w")]).withColumn("component_id", F.lit("mine"))
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(d, width=4).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    comp = closure(links)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == comp
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert minhash_dedup.near_duplicates(d.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    a, b, c = words(40, 1), words(40, 2), words(200_000, 3)
    rows = [(5, a), (5, a), (3, a + " x"), (None, a), (None, b), (None, b), (7, c), (7, "other text of seven"), (8, c + " y"), (9, None), (10, None), (11, ""), (None, None)]
    d = docs(spark, rows).withColumn("_x", F.lit("mine"))
    out = minhash_dedup.keep_one(d, width=4)
    assert out.columns == d.columns
    got = sorted(((r.doc_id if r.doc_id is not None else -1), (r.text or "")[:12]) for r in out.collect())
    seven = [g for g in got if g[0] in (7, 8)]
    assert [g for g in got if g[0] not in (7, 8)] == sorted([(3, (a + " x")[:12]), (-1, b[:12]), (9, ""), (10, ""), (11, ""), (-1, "")])
    assert len(seven) == 2 and (7, "other text o") in seven  # of the long pair one stays
    assert minhash_dedup.keep_one(d.limit(0)).count() == 0


def test_minhash_recall_on_a_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    sketch_of: dict = {}
    for i, s in sets.items():
        for x in s:
            sketch_of.setdefault(x, []).append(i)
    shared: dict = {}
    for ids in sketch_of.values():
        for i in ids:
            for j in ids:
                if i < j:
                    shared[i, j] = shared.get((i, j), 0) + 1
    links = {i: set() for i in sets}
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            links[i].add(j)
            links[j].add(i)
    comp = closure(links)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, width=4).collect()}
    assert sum(map(len, links.values())) > 100 and got == comp


def test_tiles_find_links_that_no_hub_saw():
    w = minhash_dedup.Words()
    texts = [words(300, 50)] + [" ".join(words(300, 50).split()[k:] + [f"z{k}"]) for k in range(1, 40)]
    sets = w.shingles(texts, 4)
    rows = [(side, i, i, s, 0) for side in (0, 1) for i, s in enumerate(sets) if side or i]
    out = minhash_dedup.tile_links(rows, 80)
    assert len(closure({i: {b for a, b in out if a == i} | {a for a, b in out if b == i} for i in range(40)})) == 40
    assert {closure({i: {b for a, b in out if a == i} | {a for a, b in out if b == i} for i in range(40)})[i] for i in range(40)} == {0}


def test_tiles_keep_pairs_whose_estimate_is_low():
    def pair(seed):  # 16,000 of 20,000 shared: exactly 0.8
        h = np.random.default_rng(seed).integers(0, 2**64, 20_000, dtype=np.uint64)
        return np.sort(h[:18_000]), np.sort(np.concatenate([h[:16_000], h[18_000:]]))

    low = [44, 185, 4628, 5122]  # of these seeds the estimate is 3 standard errors and more below
    rows = [(0, 2 * s, 2 * s, pair(s)[0], 0) for s in low] + [(1, 2 * s + 1, 2 * s + 1, pair(s)[1], 0) for s in [*low, *range(10_000, 10_080)]]
    assert set(minhash_dedup.tile_links(rows, 80)) == {(2 * s + 1, 2 * s) for s in low}
    assert minhash_dedup.tile_links(rows, 81) == []


def test_estimates_are_close():
    w = minhash_dedup.Words()
    base = words(2000, 1, 10**6).split()
    a, b = w.shingles([" ".join(base), " ".join(base[:1700] + words(300, 2, 10**6).split())], 4)
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    e, n = minhash_dedup.estimate(*(minhash_dedup.registers(x)[None] for x in (a, b)), np.array([len(a)]), np.array([len(b)]))
    assert abs(e[0] - j) < 0.08 and n[0] > 400


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.connected_components(e.limit(0)).count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é</p>" * 200
    rows = [(1, "http://a", long), (5, "http://b", long), (3, None, long), (4, "u", "short"), (6, "u", "short"), (7, "u\r\nX: y", None), (8, "u", ""), (9, "u", "z" * 999), (10, "u", "z" * 999), (11, "u", "q" * 3_000_000), (5, "http://b", long), (None, "n", long), (-1, "m", "minus one")]
    d = pages(spark, rows).withColumn("payload_digest", F.lit("mine"))
    got = warc.round_trip(d).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[3].refers_to, by[5].record_type, by[4].record_type, by[10].record_type) == ("revisit", 5, 5, "response", "response", "response")
    for i, _, h in rows:
        b = (h or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
    m = warc.write_archives(d, f"file://{tmp_path}/w")
    payload = {r.page_id: r.payload for r in warc.read_archives(m, payloads=True).collect() if r.record_type == "response"}
    assert bytes(payload[11]) == b"q" * 3_000_000 and bytes(payload[7]) == b""
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_refuses_bad_records():
    good = warc.record_bytes(1, "u", "response", 3, hashlib.sha1(b"abc").hexdigest(), None, b"abc")
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"Content-Length: 3", b"Content-Length: 2"), good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
