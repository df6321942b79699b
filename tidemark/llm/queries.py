"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, embedding_dedup, fill_in_middle, language_id, license_scan, minhash_dedup, mixing, personal_data, spelling_variants, token_output, toxicity, warc

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=4)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return chat_format.format_preferences(conversations, chat_format.pairs_by_other_answer(conversations))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"regexp_replace(lower(t), {quote('(?m)' + license_scan.COPYRIGHT_LINE)}, ' ', 'g')"
    c = f"' ' || trim(regexp_replace({c}, {quote(license_scan.SEPARATORS)}, '  ', 'g')) || ' '"
    for old, new in sorted(license_scan.SPELLINGS.items()):
        c = f"replace({c}, ' {old} ', ' {new} ')"
    c = f"replace(trim({c}), '  ', ' ')"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in license_scan.known_texts())
    long = ", ".join(f"({quote(k)}, {quote(d)})" for k, ds in license_scan.DIGESTS.items() for d in ds)
    return f"""WITH known AS (SELECT digest, min(id) AS license_id FROM (SELECT id, sha256(trim({c})) AS digest FROM (VALUES {known}) AS x(id, t) UNION ALL SELECT * FROM (VALUES {long}) AS y(id, digest)) GROUP BY 1),
docs AS (SELECT doc_id, trim({c}) AS c FROM (SELECT doc_id, text AS t FROM documents))
SELECT doc_id, CAST(length(c) AS BIGINT) AS n_canonical, sha256(c) AS digest, license_id FROM docs LEFT JOIN known ON sha256(docs.c) = known.digest"""


DECONTAMINATION_SQL = r"""WITH lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, CASE WHEN t IS NULL THEN [] ELSE regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') END AS w FROM lowered),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') AS phrase FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS k FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, lens WHERE len(w) >= n)),
m AS (SELECT DISTINCT g.doc_id, g.k, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.phrase = win.phrase),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""

CHAT_SQL = r"""WITH t AS (SELECT conv_id, turn, min(struct_pack(role := role, text := text)) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
last AS (SELECT conv_id, max(turn) AS pos FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
p AS (SELECT k.conv_id AS pair_id, k.pos, o.pos AS other_at FROM last k JOIN last o ON o.conv_id = k.conv_id + 1),
ab AS (SELECT pair_id, turn AS pos, x AS a, NULL AS b FROM p JOIN t ON t.conv_id = pair_id
UNION ALL SELECT pair_id, turn, NULL, x FROM p JOIN t ON t.conv_id = pair_id AND turn < p.pos
UNION ALL SELECT pair_id, p.pos, NULL, x FROM p JOIN t ON t.conv_id = pair_id + 1 AND turn = other_at),
r AS (SELECT pair_id, pos, min(a) AS a, min(b) AS b FROM ab GROUP BY ALL),
c AS (SELECT *, min(CAST(a IS NOT NULL AND b IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS INT)) OVER (PARTITION BY pair_id ORDER BY pos) = 1 AS shared,
length('<|' || replace(replace(replace(replace(replace(coalesce(a.role, ''), '<\', '<\\'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n'), chr(13), '\r') || '|>' || chr(10)) AS ha, length('<|' || replace(replace(replace(replace(replace(coalesce(b.role, ''), '<\', '<\\'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n'), chr(13), '\r') || '|>' || chr(10)) AS hb,
CASE WHEN a IS NOT NULL THEN '<|' || replace(replace(replace(replace(replace(coalesce(a.role, ''), '<\', '<\\'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n'), chr(13), '\r') || '|>' || chr(10) || replace(replace(coalesce(a.text, ''), '<\', '<\\'), '<|', '<\|') || chr(10) END AS fa,
CASE WHEN b IS NOT NULL THEN '<|' || replace(replace(replace(replace(replace(coalesce(b.role, ''), '<\', '<\\'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n'), chr(13), '\r') || '|>' || chr(10) || replace(replace(coalesce(b.text, ''), '<\', '<\\'), '<|', '<\|') || chr(10) END AS fb FROM r),
z AS (SELECT *, coalesce(sum(CASE WHEN NOT shared THEN length(fa) END) OVER w, 0) AS oa, coalesce(sum(CASE WHEN NOT shared THEN length(fb) END) OVER w, 0) AS ob FROM c WINDOW w AS (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, count(*) FILTER (WHERE shared) AS n_prefix, coalesce(string_agg(fa, '' ORDER BY pos) FILTER (WHERE shared), '') AS prompt,
coalesce(string_agg(fa, '' ORDER BY pos) FILTER (WHERE NOT shared AND fa IS NOT NULL), '') AS chosen,
coalesce(string_agg((oa + ha) || '-' || (oa + length(fa)), ',' ORDER BY pos) FILTER (WHERE NOT shared AND a.role = 'assistant'), '') AS chosen_mask,
coalesce(string_agg(fb, '' ORDER BY pos) FILTER (WHERE NOT shared AND fb IS NOT NULL), '') AS rejected,
coalesce(string_agg((ob + hb) || '-' || (ob + length(fb)), ',' ORDER BY pos) FILTER (WHERE NOT shared AND b.role = 'assistant'), '') AS rejected_mask
FROM z GROUP BY pair_id"""

WARC_SQL = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT payload_digest, payload_bytes, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type, p.payload_bytes, p.payload_digest, CASE WHEN page_id < best THEN best END AS refers_to
FROM p LEFT JOIN b ON p.payload_digest = b.payload_digest AND p.payload_bytes = b.payload_bytes"""

EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON vec_id = a LEFT JOIN c ON vec_id = node"""


FILL_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (len(u) + 1) AS b, ('0x' || substr(x, 25, 8))::BIGINT % 100 < 50 AS spm FROM d),
c AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
array_to_string(list_slice(u, 1, least(a, b)), '') AS p, array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS m, array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

VARIANT_SQL = r"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS k))),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
o AS (SELECT i, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY ALL),
b AS (SELECT i, w, n, hex(encode(i || ':' || w)) AS x FROM o),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM b, tab),
v AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
wild AS (SELECT word, n, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS k FROM p),
cut AS (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS k FROM p),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word UNION ALL SELECT c.word, v.word, v.n FROM cut c JOIN v ON c.k = v.word UNION ALL SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.k = v.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -m, b := other)) AS best FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 10 * v.n THEN best.b END AS form, CASE WHEN -best.a >= 10 * v.n THEN -best.a END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
g AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM f UNION ALL SELECT g.word, coalesce(f.form, g.root), f.form IS NULL FROM g JOIN f ON g.root = f.word WHERE NOT g.done)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN g ON f.word = g.word AND g.done"""


def queries() -> dict:
    named = [op1_license_scan, op2_mixture, op3_embedding_dedup, op4_toxicity, op5_token_output, op6_decontamination, op7_language_id, op8_chat_format, op9_minhash_dedup, op10_warc, op11_fill_in_middle, op12_spelling_variants, op13_personal_data, decontamination_proximity]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op3_embedding_dedup": EMBEDDING_SQL, "op6_decontamination": DECONTAMINATION_SQL, "op8_chat_format": CHAT_SQL, "op10_warc": WARC_SQL, "op11_fill_in_middle": FILL_SQL, "op12_spelling_variants": VARIANT_SQL}
