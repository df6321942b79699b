"""Registered queries of versioned definitions, document writes, fetching, and checks of parsed text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitemporal as bt
from ..operators import definitions as df
from ..operators import finance as fn
from ..operators import quality as ql
from ..operators import retrieval as rt
from ..operators import textops as tx
from ..operators import verification as vf
from ..sources import projections as src
from ..sources.projections import BLOCK, DOCUMENT, day_text, stamp
from . import search, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = "2024-02-05 00:00:00"
SEEN = f"known_at <= TIMESTAMP '{T}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{T}')"
BASE = "TIMESTAMP '2024-01-01'"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def days(start, n):
    return start + F.make_dt_interval(n.cast("int"))


# Definitions -------------------------------------------------------------------------------------------------------

VERSIONS = f"""versions AS (SELECT *, CASE WHEN version < 8 THEN known_at + to_days(10) WHEN id % 7 = 0 THEN known_at + to_days(5) END AS superseded_at FROM (SELECT p_partkey // 8 AS id, CAST(p_partkey % 8 + 1 AS INTEGER) AS version, p_brand AS unit, p_size AS scale, {BASE} + to_days(CAST(p_partkey % 8 * 10 AS INTEGER)) AS known_at FROM part))"""
MAPS = f"""maps AS (SELECT *, CASE WHEN priority <> 2 THEN NULL ELSE known_at + to_days(20) END AS superseded_at FROM (SELECT p_partkey // 8 AS metric, 'p' || p_partkey % 3 AS provider, 'f' || p_partkey % 5 AS field, p_size % 4 AS priority, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10000 END AS scale, {BASE} + to_days(CAST(p_partkey % 8 * 10 AS INTEGER)) AS known_at FROM part))"""


def versions(spark, sf):
    k = F.col("p_partkey")
    v = src.table(spark, sf, "part").select(F.floor(k / 8).alias("id"), (k % 8 + 1).cast("int").alias("version"), F.col("p_brand").alias("unit"), F.col("p_size").alias("scale"), days(bt.at("2024-01-01 00:00:00"), k % 8 * 10).alias("known_at"))
    return v.withColumn("superseded_at", F.when(F.col("version") < 8, days(F.col("known_at"), F.lit(10))).when(F.col("id") % 7 == 0, days(F.col("known_at"), F.lit(5))))


def maps(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    name = lambda a, n: F.concat(F.lit(a), (k % n).cast("string"))
    m = src.table(spark, sf, "part").select(F.floor(k / 8).alias("metric"), name("p", 3).alias("provider"), name("f", 5).alias("field"), (s % 4).alias("priority"), F.when(s % 3 == 0, 1).when(s % 3 == 1, 100).otherwise(10000).alias("scale"), days(bt.at("2024-01-01 00:00:00"), k % 8 * 10).alias("known_at"))
    return m.withColumn("superseded_at", F.when(F.col("priority") == 2, days(F.col("known_at"), F.lit(20))))


@query("definition_as_of", f"WITH {VERSIONS} SELECT id, max(version) AS version, arg_max(unit, version) AS unit, arg_max(scale, version) AS scale FROM versions WHERE {SEEN} GROUP BY id")
def definition_as_of(spark, sf):
    return df.definition_asof(versions(spark, sf), bt.at(T), "id").select("id", "version", "unit", "scale")


@query("source_maps_as_of", f"WITH {MAPS} SELECT metric, provider, field, priority, scale, row_number() OVER (PARTITION BY metric ORDER BY priority, provider, field) AS place FROM maps WHERE {SEEN}")
def source_maps_as_of(spark, sf):
    return df.maps_asof(maps(spark, sf), bt.at(T), "metric").select("metric", "provider", "field", "priority", "scale", "place")


RULES = f"rules AS (SELECT *, lead(known_at) OVER (PARTITION BY entity ORDER BY version) AS superseded_at FROM (SELECT s_nationkey AS entity, s_suppkey AS version, s_name AS rule, {BASE} + to_hours(CAST(s_suppkey * 5 AS INTEGER)) AS known_at FROM supplier))"


@query("rule_as_of", f"WITH {RULES} SELECT entity, version, rule FROM rules WHERE {SEEN}")
def rule_as_of(spark, sf):
    known = bt.at("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), (F.col("s_suppkey") * 5).cast("int"))
    r = src.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("entity"), F.col("s_suppkey").alias("version"), F.col("s_name").alias("rule"), known.alias("known_at"))
    r = r.withColumn("superseded_at", F.lead("known_at").over(Window.partitionBy("entity").orderBy("version")))
    return df.definition_asof(r, bt.at(T), "entity").select("entity", "version", "rule")


@query("source_map_scaling", f"""WITH {MAPS}, b AS (SELECT provider, field, arg_min(struct_pack(m := metric, s := scale), (priority, metric, scale)) AS x FROM maps WHERE superseded_at IS NULL GROUP BY ALL)
SELECT l_orderkey, l_linenumber, x.m AS metric, CAST(l_quantity AS DOUBLE) * x.s AS scaled, CASE WHEN x IS NULL THEN 'unknown_field' ELSE 'mapped' END AS outcome FROM lineitem LEFT JOIN b ON provider = 'p' || l_suppkey % 4 AND field = 'f' || l_linenumber""")
def source_map_scaling(spark, sf):
    f = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string")).alias("provider"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_quantity").cast("double").alias("value"))
    return df.scaled_facts(f, maps(spark, sf)).select("l_orderkey", "l_linenumber", "metric", "scaled", "outcome")


@query("retire_definition", f"""WITH {VERSIONS}, {MAPS}, a AS (SELECT DISTINCT id, CASE WHEN id % 2 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-06-01' END AS k FROM versions), v AS (SELECT id, max(known_at) AS live FROM versions WHERE superseded_at IS NULL GROUP BY id), m AS (SELECT DISTINCT metric FROM maps WHERE superseded_at IS NULL AND metric % 3 = 0)
SELECT a.id, CASE WHEN metric IS NOT NULL THEN 'refused' WHEN live IS NULL THEN 'not_live' WHEN k <= live THEN 'out_of_order' ELSE 'retired' END AS outcome FROM a LEFT JOIN v ON a.id = v.id LEFT JOIN m ON metric = a.id""")
def retire_definition(spark, sf):
    v = versions(spark, sf)
    asked = v.select("id", F.when(F.col("id") % 2 == 0, bt.at("2024-01-02 00:00:00")).otherwise(bt.at("2024-06-01 00:00:00")).alias("known_at")).distinct()
    return df.retire_outcomes(asked, v, maps(spark, sf).filter("metric % 3 = 0").withColumnRenamed("metric", "id"), "id").select("id", "outcome")


# Documents ---------------------------------------------------------------------------------------------------------


@query("document_write", """WITH c AS (SELECT source, sha256(text) AS hash, doc_id AS provider_id, doc_id - doc_id % 4 AS grp FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0), s AS (SELECT source, hash, min(grp) AS same FROM c GROUP BY ALL),
i AS (SELECT doc_id + 1000000 AS doc, source, sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE text || 'x' END) AS hash, CASE WHEN doc_id % 5 <> 0 THEN doc_id + 2 END AS corrects FROM documents), t AS (SELECT *, row_number() OVER w AS turn, first(doc) OVER w AS f FROM i WINDOW w AS (PARTITION BY source, hash ORDER BY doc))
SELECT doc, CASE WHEN same IS NOT NULL OR turn > 1 THEN 'skipped' WHEN c.grp IS NOT NULL THEN 'new_version' ELSE 'created' END AS outcome, coalesce(same, c.grp, f) AS "group" FROM t LEFT JOIN s ON t.source = s.source AND t.hash = s.hash LEFT JOIN c ON c.source = t.source AND c.provider_id = t.corrects""")
def document_write(spark, sf):
    d, i = src.table(spark, sf, "documents"), F.col("doc_id")
    current = d.filter(i % 2 == 0).select("source", F.sha2("text", 256).alias("hash"), i.alias("provider_id"), (i - i % 4).alias("group"), F.current_timestamp().alias("known_at"), F.when(i % 10 == 0, F.current_timestamp()).alias("superseded_at"))
    text = F.when(i % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    incoming = d.select((i + 1000000).alias("doc"), "source", F.sha2(text, 256).alias("hash"), F.when(i % 5 != 0, i + 2).alias("corrects"))
    return df.document_outcomes(current, incoming).select("doc", "outcome", "group")


@query("document_reparse", f"""WITH {DOCUMENT}, d AS (SELECT doc_id AS doc, sha256(text) AS hash, known_at, superseded_at FROM document), u AS (SELECT doc, hash, known_at, CASE WHEN doc % 6 = 0 AND superseded_at IS NULL THEN TIMESTAMP '{T}' ELSE superseded_at END AS superseded_at FROM d UNION ALL SELECT doc, sha256(hash), known_at, NULL FROM d WHERE doc % 6 = 0 AND superseded_at IS NULL)
SELECT doc, hash, strftime(known_at, '%Y-%m-%d %H:%M:%S') AS known_at, strftime(superseded_at, '%Y-%m-%d %H:%M:%S') AS superseded_at FROM u""")
def document_reparse(spark, sf):
    d = src.document(spark, sf).select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("hash"), "known_at", "superseded_at")
    parsed = d.filter("doc % 6 = 0").select("doc", F.sha2("hash", 256).alias("hash")).distinct()
    return df.reparse_state(d, parsed, bt.at(T)).select("doc", "hash", stamp("known_at").alias("known_at"), stamp("superseded_at").alias("superseded_at"))


@query("carry_over_blocks", f"""WITH {DOCUMENT}, {BLOCK}, b AS (SELECT doc_id, md5(content) AS digest, page, ordinal, block_id FROM doc_block), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest, page ORDER BY ordinal) AS n FROM b WHERE block_id % 3 <> 0),
w AS (SELECT doc_id, digest, pg AS page, ordinal, block_id, row_number() OVER (PARTITION BY doc_id, digest, pg ORDER BY ordinal) AS n FROM (SELECT *, page + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS pg FROM b WHERE block_id % 4 <> 0)),
j AS (SELECT coalesce(w.doc_id, o.doc_id) AS doc_id, coalesce(w.digest, o.digest) AS digest, w.block_id AS new_id, w.ordinal AS nw, o.block_id AS old_id, o.ordinal AS od FROM w FULL JOIN o ON w.doc_id = o.doc_id AND w.digest = o.digest AND w.page = o.page AND w.n = o.n),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest ORDER BY nw) AS k FROM j WHERE old_id IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest ORDER BY od) AS k FROM j WHERE new_id IS NULL)
SELECT doc_id, new_id, old_id, 'same_page' AS how FROM j WHERE new_id IS NOT NULL AND old_id IS NOT NULL UNION ALL SELECT a.doc_id, a.new_id, r.old_id, CASE WHEN r.old_id IS NULL THEN 'none' ELSE 'other_page' END FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.digest = r.digest AND a.k = r.k""")
def carry_over_blocks(spark, sf):
    b = src.doc_block(spark, sf).select("doc_id", F.md5("content").alias("digest"), "page", "ordinal", "block_id")
    old = b.filter("block_id % 3 <> 0").withColumnRenamed("block_id", "old_id")
    new = b.filter("block_id % 4 <> 0").withColumnRenamed("block_id", "new_id").withColumn("page", F.col("page") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return df.carry_over(old, new, ["doc_id", "digest"]).select("doc_id", "new_id", "old_id", "how")


# Fetching ----------------------------------------------------------------------------------------------------------


@query("fetch_from", "WITH g AS (SELECT user_id, max(CAST(ts AS DATE)) FILTER (WHERE event_type = 'click') AS c, min(CAST(ts AS DATE)) FILTER (WHERE event_type = 'view') AS f FROM events GROUP BY user_id) SELECT user_id, strftime(CASE WHEN c IS NULL THEN DATE '2024-01-10' WHEN f IS NULL OR f > DATE '2024-01-10' THEN least(c + 1, DATE '2024-01-10') ELSE c + 1 END, '%Y-%m-%d') AS since FROM g")
def fetch_from(spark, sf):
    day = F.to_date("ts")
    g = src.table(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", day)).alias("c"), F.min(F.when(F.col("event_type") == "view", day)).alias("f"))
    return g.select("user_id", day_text(df.fetch_from(F.col("c"), F.col("f"), F.lit("2024-01-10").cast("date"))).alias("since"))


@query("half_year_windows", "WITH s AS (SELECT o_custkey AS custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1), w AS (SELECT custkey, CAST(unnest(generate_series(a, b, INTERVAL 183 DAY)) AS DATE) AS f, b FROM s) SELECT custkey, strftime(f, '%Y-%m-%d') AS window_from, strftime(least(f + 182, b), '%Y-%m-%d') AS window_to FROM w")
def half_year_windows(spark, sf):
    s = src.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"))
    return df.half_years(s).select("custkey", day_text("window_from").alias("window_from"), day_text("window_to").alias("window_to"))


@query("backlog_order", f"WITH {DOCUMENT} SELECT doc_id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY CASE doc_id % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, publish_at DESC, doc_id) AS place FROM document")
def backlog_order(spark, sf):
    tier = F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string"))
    return df.backlog_order(src.document(spark, sf).withColumn("tier", tier), ["t1", "t0", "t2"], "doc_type").select("doc_id", "doc_type", "place")


@query("collection_names", "SELECT c_custkey, 'doc_block_u_' || substr(regexp_replace(c_name || ' ' || c_mktsegment || '/é', '[^a-zA-Z0-9._-]', '-', 'g'), 1, 484) || '_' || substr(sha256(c_name || ' ' || c_mktsegment || '/é'), 1, 16) AS name FROM customer")
def collection_names(spark, sf):
    owner = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("/é"))
    return src.table(spark, sf, "customer").select("c_custkey", df.collection_name(owner).alias("name"))


@query("snapshot_replay", """WITH u AS (SELECT user_id, ts, CAST(NULL AS BIGINT) AS call, event_id AS body FROM events WHERE event_type <> 'click' UNION ALL SELECT user_id, ts, event_id, NULL FROM events WHERE event_type = 'click'),
w AS (SELECT *, last_value(body IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, call NULLS FIRST, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM u) SELECT call, user_id, b AS body FROM w WHERE call IS NOT NULL""")
def snapshot_replay(spark, sf):
    e = src.table(spark, sf, "events")
    calls = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("asked_at"), F.col("event_id").cast("long").alias("call"))
    return vf.latest_snapshot(calls, e.filter("event_type <> 'click'").select("user_id", F.col("ts").alias("taken_at"), F.col("event_id").cast("long").alias("body")), ["user_id"])


# Checks ------------------------------------------------------------------------------------------------------------


@query("critical_characters", f"""WITH t AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '净利润同比增加１.2亿元，亏损减少' WHEN 1 THEN '不含税 3% ≥5 ↑▲' WHEN 2 THEN '增增减 ±<2>' ELSE p_name END AS a, CASE p_size % 3 WHEN 0 THEN '净利润同比增加1.2亿元 ≤5 ↓▼' WHEN 1 THEN '含税3％ 不 △▽' ELSE '减增 增增 <1>' END AS b FROM part),
x AS (SELECT id, 1 AS w, unnest(string_split(translate(a, '{tx.WIDE}', '{tx.NARROW}'), '')) AS ch FROM t UNION ALL SELECT id, -1, unnest(string_split(translate(b, '{tx.WIDE}', '{tx.NARROW}'), '')) FROM t), v AS (SELECT id, ch FROM x WHERE ch <> '' AND contains('亿万千百十元%‰增减升降涨跌负亏盈零〇一二三四五六七八九两不未无非否同环末初美港欧日≥≤<>▲▼△▽↑↓±', ch) GROUP BY id, ch HAVING sum(w) > 0)
SELECT t.id, coalesce(string_agg(ch, '' ORDER BY encode(ch)), '') AS violations FROM t LEFT JOIN v ON t.id = v.id GROUP BY t.id""")
def critical_characters(spark, sf):
    s = F.col("p_size")
    a = F.when(s % 4 == 0, "净利润同比增加１.2亿元，亏损减少").when(s % 4 == 1, "不含税 3% ≥5 ↑▲").when(s % 4 == 2, "增增减 ±<2>").otherwise(F.col("p_name"))
    b = F.when(s % 3 == 0, "净利润同比增加1.2亿元 ≤5 ↓▼").when(s % 3 == 1, "含税3％ 不 △▽").otherwise("减增 增增 <1>")
    t = src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))
    return vf.critical_violations(t, "id", "a", "b").select("id", F.array_join("violations", "").alias("violations"))


MARKDOWN = f"""{texts.GRID}, {texts.SLOTS}, e AS (SELECT table_id, max(row) AS mr, max(col) AS mc FROM slots GROUP BY 1), pl AS (SELECT table_id, row, mc, unnest(generate_series(0, mc)) AS col FROM (SELECT table_id, mc, unnest(generate_series(0, mr)) AS row FROM e)),
ln AS (SELECT pl.table_id, pl.row, max(mc) AS mc, '| ' || string_agg(coalesce(text, ''), ' | ' ORDER BY pl.col) || ' |' AS line FROM pl LEFT JOIN slots s ON s.table_id = pl.table_id AND s.row = pl.row AND s.col = pl.col GROUP BY ALL),
md AS (SELECT table_id, string_agg(line || CASE WHEN row = 0 THEN chr(10) || '|' || repeat('---|', CAST(mc + 1 AS INTEGER)) ELSE '' END, chr(10) ORDER BY row) AS markdown FROM ln GROUP BY table_id)"""


def markdown(spark, sf):
    return vf.markdown_tables(tx.grid_slots(texts.cells(spark, sf)))


@query("markdown_tables", f"WITH {MARKDOWN} SELECT table_id, markdown FROM md")
def markdown_tables(spark, sf):
    return markdown(spark, sf)


@query("tables_closed", f"WITH {MARKDOWN}, l AS (SELECT table_id, unnest(string_split(markdown, chr(10))) AS line FROM md), d AS (SELECT * FROM l WHERE NOT regexp_matches(line, '^[\\s|-]*$')) SELECT md.table_id, coalesce(bool_and(NOT regexp_matches(regexp_replace(line, '^\\|+|\\|+$', '', 'g'), '(^|\\|)\\s*(\\||$)')), false) AS closed FROM md LEFT JOIN d ON d.table_id = md.table_id GROUP BY 1")
def tables_closed(spark, sf):
    return markdown(spark, sf).select("table_id", vf.looks_closed(F.col("markdown")).alias("closed"))


@query("cell_stats", f"WITH {texts.GRID}, k AS (SELECT cells.*, CASE p_size % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'not_checked' END AS chk, p_size % 4 + 1 AS page FROM cells JOIN part ON p_partkey = cell) SELECT table_id, max(r + rs) AS rows, max(c + cs) AS cols, count(*) FILTER (WHERE chk = 'match') AS n_match, count(*) FILTER (WHERE chk = 'mismatch') AS n_mismatch, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM k GROUP BY 1")
def cell_stats(spark, sf):
    s = F.col("p_size")
    p = src.table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), F.when(s % 3 == 0, "match").when(s % 3 == 1, "mismatch").otherwise("not_checked").alias("check"), (s % 4 + 1).alias("page"))
    return vf.cell_stats(texts.cells(spark, sf).join(p, "cell")).withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


NUMS = texts.NUMS


@query("cell_verification", f"""WITH {texts.GRID}, k AS (SELECT table_id, cell, table_id AS page, CASE WHEN cell % 17 <> 0 THEN c END AS x0, r AS y0, CASE WHEN p_size % 13 = 0 THEN 'none' ELSE p_size || ' of ' || cell END AS text FROM cells JOIN part ON p_partkey = cell),
w AS (SELECT table_id AS page, c + 0.3 AS x, r + 0.5 AS y, CAST(p_size AS VARCHAR) AS text FROM cells JOIN part ON p_partkey = cell WHERE table_id % 11 <> 0 UNION ALL SELECT table_id, c + 0.6, r + 0.5, CASE WHEN p_size % 7 = 0 THEN '1,000' ELSE CAST(cell AS VARCHAR) END FROM cells JOIN part ON p_partkey = cell WHERE table_id % 11 <> 0),
h AS (SELECT table_id, cell, list_sort(list(n)) AS have FROM (SELECT k.table_id, cell, unnest({NUMS.format(x='w.text')}) AS n FROM k JOIN w ON k.page = w.page AND x BETWEEN x0 AND x0 + 0.9 AND y BETWEEN y0 AND y0 + 0.9) GROUP BY ALL)
SELECT k.table_id, k.cell, CASE WHEN len({NUMS.format(x='k.text')}) = 0 THEN 'no_numbers' WHEN x0 IS NULL OR k.table_id % 9 = 0 THEN 'not_checked' WHEN k.table_id % 11 = 0 THEN 'no_text_layer' WHEN coalesce(have, []) = list_sort({NUMS.format(x='k.text')}) THEN 'match' ELSE 'mismatch' END AS verdict FROM k LEFT JOIN h ON h.table_id = k.table_id AND h.cell = k.cell""")
def cell_verification(spark, sf):
    p = src.table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), "p_size")
    g = texts.cells(spark, sf).join(p, "cell")
    number = F.col("cell").cast("string")
    text = F.when(F.col("p_size") % 13 == 0, "none").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" of "), number))
    x0, y0 = F.when(F.col("cell") % 17 != 0, F.col("c").cast("double")), F.col("r").cast("double")
    cells = g.select("table_id", "cell", F.col("table_id").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.9).alias("x1"), (y0 + 0.9).alias("y1"), text.alias("text"))
    two = F.explode(F.array(F.struct((F.col("c") + 0.3).alias("x"), F.col("p_size").cast("string").alias("text")), F.struct((F.col("c") + 0.6).alias("x"), F.when(F.col("p_size") % 7 == 0, "1,000").otherwise(number).alias("text")))).alias("w")
    words = g.filter("table_id % 11 <> 0").select(F.col("table_id").alias("page"), (F.col("r") + 0.5).alias("y"), two).select("page", "w.x", "y", "w.text")
    pages = g.select(F.col("table_id").alias("page")).distinct().withColumn("rotation", F.when(F.col("page") % 9 == 0, 90).otherwise(0))
    return vf.verify_cells(cells, words, pages)


@query("table_context", """WITH s AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS distance, l_partkey % 3 = 0 AS declared, CASE WHEN l_partkey % 5 <> 0 THEN 'u' || l_partkey % 4 END AS unit FROM lineitem), o AS (SELECT table_id, distance, CASE WHEN count(DISTINCT unit) = 1 AND count(unit) = count(*) THEN max(unit) END AS unit FROM s WHERE declared GROUP BY ALL), f AS (SELECT table_id, arg_min(struct_pack(d := distance, u := unit), distance) AS x FROM o GROUP BY 1),
t AS (SELECT DISTINCT s.table_id, CASE WHEN s.table_id % 4 <> 0 OR x.d = 0 THEN x.u END AS unit, x.d AS d FROM s LEFT JOIN f ON f.table_id = s.table_id) SELECT table_id, unit, CASE WHEN unit IS NULL THEN 'none' WHEN d = 0 THEN 'in_table' ELSE 'preceding_block' END AS source FROM t""")
def table_context(spark, sf):
    k = F.col("l_partkey")
    s = src.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("distance"), (k % 3 == 0).alias("declared"), F.when(k % 5 != 0, F.concat(F.lit("u"), (k % 4).cast("string"))).alias("unit"))
    return vf.bind_context(s, s.filter("table_id % 4 = 0").select("table_id").distinct())


@query("heading_scores", f"""WITH {DOCUMENT}, {BLOCK}, g AS (SELECT doc_type, doc_id, content AS title, count(*) AS g FROM doc_block WHERE length(content) BETWEEN 1 AND 60 GROUP BY ALL), f AS (SELECT doc_type, doc_id, content AS title, count(*) AS f FROM doc_block WHERE length(content) BETWEEN 20 AND 80 AND ordinal % 5 <> 1 GROUP BY ALL),
j AS (SELECT coalesce(g.doc_type, f.doc_type) AS doc_type, coalesce(g, 0) AS g, coalesce(f, 0) AS f FROM g FULL JOIN f ON g.doc_id = f.doc_id AND g.title = f.title AND g.doc_type = f.doc_type) SELECT doc_type, round(CASE WHEN sum(g) > 0 THEN sum(least(g, f)) / sum(g) ELSE 0 END, 6) AS recall, round(CASE WHEN sum(f) > 0 THEN sum(least(g, f)) / sum(f) ELSE 0 END, 6) AS precision FROM j GROUP BY 1""")
def heading_scores(spark, sf):
    b = src.doc_block(spark, sf).select("doc_type", "doc_id", F.col("content").alias("title"), "ordinal").withColumn("n", F.length("title"))
    return vf.heading_scores(b.filter("n between 1 and 60"), b.filter("n between 20 and 80 and ordinal % 5 <> 1"), "doc_type")


@query("expensive_tier", "WITH p AS (SELECT 'src' || n_nationkey AS source, CASE WHEN n_nationkey % 3 <> 0 THEN 0.3 END AS cb, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 END AS lb, n_nationkey % 5 <> 0 AS enabled FROM nation WHERE n_nationkey <> 4) SELECT doc_id, coalesce(enabled, false) AND (coalesce(doc_id % 10 / 10 < cb, false) OR (doc_id % 2 = 0 AND coalesce(doc_id % 7 / 7 < lb, false))) AS routed FROM documents d LEFT JOIN p ON p.source = d.source")
def expensive_tier(spark, sf):
    n = F.col("n_nationkey")
    p = src.table(spark, sf, "nation").filter("n_nationkey <> 4").select(F.concat(F.lit("src"), n.cast("string")).alias("source"), F.when(n % 3 != 0, 0.3).alias("cb"), F.when(n % 2 == 0, 0.5).alias("lb"), (n % 5 != 0).alias("enabled"))
    i = F.col("doc_id")
    routed = vf.expensive_tier(F.col("cb"), F.col("lb"), F.col("enabled"), i % 10 / 10, i % 7 / 7, i % 2 == 0)
    return src.table(spark, sf, "documents").select("doc_id", "source").join(p, "source", "left").select("doc_id", routed.alias("routed"))


@query("stage_counts", f"WITH t AS ({search.SQL['retrieval_trace']}) SELECT qid, count(lexical_rank) AS n_lexical, count(vector_rank) AS n_vector, count(fused_rank) AS n_fused, count(final_rank) AS n_final FROM t GROUP BY qid")
def stage_counts(spark, sf):
    return vf.stage_counts(search.QUERIES["retrieval_trace"](spark, sf), ["lexical", "vector", "fused", "final"])


@query("grid_verdict", f"""WITH c AS (SELECT p_partkey // 8 AS table_id, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE p_size || '' END AS text, CASE WHEN p_partkey // 8 % 4 = 0 THEN 'not_checked' WHEN p_size % 13 = 0 AND p_partkey // 8 % 4 = 1 THEN 'mismatch' WHEN p_size % 7 = 0 AND p_partkey // 8 % 4 = 2 THEN 'no_text_layer' WHEN p_size % 3 = 0 AND p_partkey // 8 % 5 <> 2 THEN 'not_checked' ELSE 'match' END AS chk, CASE p_partkey // 8 % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' END AS tier FROM part),
n AS (SELECT *, len({NUMS.format(x='text')}) > 0 AS num FROM c), g AS (SELECT table_id, max(tier) AS tier, count(*) FILTER (WHERE num AND chk = 'match') AS ok, count(*) FILTER (WHERE num AND chk = 'mismatch') AS bad, count(*) FILTER (WHERE num AND chk = 'no_text_layer') AS bare, count(*) FILTER (WHERE num AND chk = 'not_checked') AS op, count(*) FILTER (WHERE num) AS total FROM n GROUP BY 1)
SELECT table_id, CASE WHEN bad > 0 THEN 'text_layer_cells_mismatch' WHEN tier = 'L2' AND op = total THEN 'dual_agree' WHEN bare > 0 THEN 'scan_single_unverified' WHEN total = 0 THEN 'not_checked' WHEN ok = total THEN 'text_layer_cells_ok' WHEN ok = 0 AND tier = 'L1' THEN 'text_layer_page_closed' WHEN ok = 0 THEN 'not_checked' ELSE 'text_layer_cells_partial' END AS verdict FROM g""")
def grid_verdict(spark, sf):
    s, t = F.col("p_size"), F.floor(F.col("p_partkey") / 8)
    check = F.when(t % 4 == 0, "not_checked").when((s % 13 == 0) & (t % 4 == 1), "mismatch").when((s % 7 == 0) & (t % 4 == 2), "no_text_layer").when((s % 3 == 0) & (t % 5 != 2), "not_checked").otherwise("match")
    c = src.table(spark, sf, "part").select(t.alias("table_id"), F.when(s % 5 == 0, "none").otherwise(s.cast("string")).alias("text"), check.alias("check"))
    return vf.grid_verdicts(c, F.when(F.col("table_id") % 3 == 0, "L1").when(F.col("table_id") % 3 == 1, "L2"))


CHUNKS = """ch AS (SELECT conv_id AS doc_id, turn + CASE WHEN conv_id % 11 = 0 AND turn > 1 THEN 1 ELSE 0 END AS ordinal, CASE WHEN turn > 0 THEN CASE WHEN conv_id % 7 = 0 THEN turn - 1 WHEN conv_id % 13 = 0 THEN 99 ELSE 0 END END AS parent, CASE WHEN role = 'system' THEN 'table' ELSE 'text' END AS kind, CASE WHEN conv_id % 17 = 0 THEN ' ' ELSE text END AS content, CASE WHEN conv_id % 2 = 0 THEN 'd' END AS description, turn + 1 AS page, turn > 0 OR conv_id % 5 = 0 AS is_leaf, conv_id % 3 = 0 AS has_figure FROM conversations)"""


@query("validate_chunks", f"""WITH {CHUNKS}, up AS (SELECT doc_id, ordinal, any_value(parent) AS grand FROM ch GROUP BY ALL), kids AS (SELECT DISTINCT doc_id, parent FROM ch WHERE parent IS NOT NULL),
d AS (SELECT ch.*, up.ordinal AS there, grand, kids.parent IS NOT NULL AS kept FROM ch LEFT JOIN up ON up.doc_id = ch.doc_id AND up.ordinal = ch.parent LEFT JOIN kids ON kids.doc_id = ch.doc_id AND kids.parent = ch.ordinal),
g AS (SELECT doc_id, [CASE WHEN count(*) <> count(DISTINCT ordinal) OR min(ordinal) <> 0 OR max(ordinal) <> count(*) - 1 THEN 'ordinals' END, CASE WHEN bool_or(trim(content) = '') THEN 'blank' END, CASE WHEN bool_or(kind = 'table' AND trim(coalesce(description, '')) = '') THEN 'no_description' END, CASE WHEN bool_or(parent IS NOT NULL AND there IS NULL) THEN 'no_parent' END, CASE WHEN bool_or(parent IS NOT NULL AND grand IS NOT NULL) THEN 'nested' END,
CASE WHEN bool_or(page < 1 OR page > 4) THEN 'page' END, CASE WHEN bool_or(is_leaf AND kept) THEN 'leaf_with_children' END, CASE WHEN bool_or(NOT is_leaf AND NOT kept AND NOT has_figure) THEN 'node_without_children' END] AS v FROM d GROUP BY doc_id)
SELECT doc_id, array_to_string(list_sort(list_filter(v, lambda x: x IS NOT NULL)), ',') AS violations FROM g""")
def validate_chunks(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    d = src.table(spark, sf, "conversations").select(
        c.alias("doc_id"), (t + F.when((c % 11 == 0) & (t > 1), 1).otherwise(0)).alias("ordinal"), F.when(t > 0, F.when(c % 7 == 0, t - 1).when(c % 13 == 0, 99).otherwise(0)).alias("parent"),
        F.when(F.col("role") == "system", "table").otherwise("text").alias("kind"), F.when(c % 17 == 0, " ").otherwise(F.col("text")).alias("content"), F.when(c % 2 == 0, "d").alias("description"), (t + 1).alias("page"), ((t > 0) | (c % 5 == 0)).alias("is_leaf"), (c % 3 == 0).alias("has_figure"),
    )
    return vf.chunk_violations(d, d.select("doc_id").distinct().withColumn("page_count", F.lit(4)))


HEADINGS = ["第一章 总则", "第十二节 管理层讨论", "二十一、重大事项", "（三）主要会计数据", "(九) 无", "1.2.3 研发投入", "3.5亿元", "3.5 营业收入", "1.5倍", "12、存货", "2.3", "（4）应收账款", "特别提示：", "附件三：名单", "第百章", "十、", "1. 概述", "10.25 其他", "正文 1.2", "  五．收入", "3.万元", "目录", "3.5年", "1.2 美元", "2.1 股东情况", "2.1 股", "4.2 点", "4.2 点评", "1.3 万股", "12 次要事项", "7、次", "2.4 bp"]
NO_AMOUNT = "NOT regexp_matches(s, '^[0-9]{1,2}([.][0-9]{1,2}){0,2}[、．.]?[ ]*([亿万千百元%％倍个家人台年月日]|美元|港元|港币|日元|欧元|万股|亿股|万吨|万手|bp|[股吨次项点手户]([^一-鿿]|$))')"
SYSTEM_SQL = "CASE WHEN regexp_matches(s, '{k}') THEN 'keyword' ".format(k=vf.KEYWORD) + " ".join(f"WHEN regexp_matches(s, '{p}') THEN CASE WHEN {NO_AMOUNT if n in ('decimal3', 'decimal2', 'arabic') else 'true'} AND n_{n} IS NOT NULL THEN '{n}' END" for n, p in vf.SYSTEMS.items()) + " END"
ORDINAL_SQL = "CASE WHEN regexp_matches(s, '{k}') THEN 0 ".format(k=vf.KEYWORD) + " ".join(f"WHEN regexp_matches(s, '{p}') THEN CASE WHEN {NO_AMOUNT if n in ('decimal3', 'decimal2', 'arabic') else 'true'} THEN n_{n} END" for n, p in vf.SYSTEMS.items()) + " END"
DIGIT = f"CASE WHEN {{x}} IN ('零', '〇') THEN 0 WHEN length({{x}}) = 1 AND instr('{vf.NUMERALS}', {{x}}) > 0 THEN instr('{vf.NUMERALS}', {{x}}) END"
NUMERAL_SQL = "CASE WHEN contains({x}, '十') THEN CASE WHEN split_part({x}, '十', 1) = '' THEN 1 ELSE " + DIGIT.replace("{x}", "split_part({x}, '十', 1)") + " END * 10 + CASE WHEN split_part({x}, '十', 2) = '' THEN 0 ELSE " + DIGIT.replace("{x}", "split_part({x}, '十', 2)") + " END ELSE " + DIGIT + " END"
PARTS_SQL = ", ".join((NUMERAL_SQL.replace("{x}", f"regexp_extract(s, '{p}', 1)") if n in ("chapter", "section", "cn", "cn_paren") else f"TRY_CAST(regexp_extract(s, '{p}', 1) AS INTEGER)") + f" AS n_{n}" for n, p in vf.SYSTEMS.items())


@query("numbering_classifier", f"WITH h AS (SELECT p_partkey AS id, regexp_replace(list_extract({HEADINGS!r}, CAST(p_partkey % {len(HEADINGS)} + 1 AS INTEGER)), '^\\s+|\\s+$', '', 'g') AS s FROM part), x AS (SELECT *, {PARTS_SQL} FROM h) SELECT id, {SYSTEM_SQL} AS system, CAST({ORDINAL_SQL} AS INTEGER) AS ordinal FROM x")
def numbering_classifier(spark, sf):
    """The synthetic lines carry no such numbers: a list of headings of every system is dealt to the parts."""
    k = F.col("p_partkey")
    h = src.table(spark, sf, "part").select(k.alias("id"), F.element_at(F.array(*[F.lit(x) for x in HEADINGS]), (k % len(HEADINGS) + 1).cast("int")).alias("s"))
    system, ordinal = vf.numbering(F.col("s"))
    return h.select("id", system.alias("system"), ordinal.cast("int").alias("ordinal"))


@query("question_hygiene", """WITH q AS (SELECT 'benchmark' AS kind, item_id AS id, trim(text || '?') AS q FROM benchmark UNION ALL SELECT 'part', p_partkey, trim(CASE p_partkey % 5 WHEN 0 THEN p_name || '？' WHEN 1 THEN p_name || ' ?' WHEN 2 THEN '该公司' || p_name || '?' WHEN 3 THEN p_name || ' 目标价?' ELSE p_name END) FROM part)
SELECT kind, id, regexp_matches(q, '[？?]$') AND length(q) BETWEEN 8 AND 120 AND NOT regexp_matches(q, '这份|该公司|该报告|本公司|本期报告|上述|该文') AND NOT regexp_matches(q, '买入|卖出|增持|减持|推荐|目标价|评级|建议配置|仓位') AS ok FROM q""")
def question_hygiene(spark, sf):
    """Whole benchmark texts as questions, and questions about whole part names that end, point or advise in each way."""
    k = F.col("p_partkey") % 5
    q = F.when(k == 0, F.concat("p_name", F.lit("？"))).when(k == 1, F.concat("p_name", F.lit(" ?"))).when(k == 2, F.concat(F.lit("该公司"), "p_name", F.lit("?"))).when(k == 3, F.concat("p_name", F.lit(" 目标价?"))).otherwise(F.col("p_name"))
    items = src.table(spark, sf, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), vf.good_question(F.concat("text", F.lit("?"))).alias("ok"))
    return items.unionByName(src.table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), vf.good_question(q).alias("ok")))


TITLES = ["2024年年度报告", "2024年年度报告摘要", "2024年第一季度报告", "2024年半年度报告的更正公告", "2024年半年度报告摘要（修订版）", "2024年度业绩预告", "年度报告（英文版）", "关于取消股东大会的公告", "2024年年度报告提示性公告", "董事会决议公告"]


@query("title_tier", f"WITH t AS (SELECT page_id, list_extract({TITLES!r}, CAST(page_id % 10 + 1 AS INTEGER)) AS title FROM pages), b AS (SELECT *, regexp_replace(regexp_replace(title, '{vf.CORRECTION}', ''), '[(（]+$', '') AS base FROM t) SELECT page_id, CASE WHEN regexp_matches(title, '{vf.NEVER_PARSED}') THEN 'none' WHEN regexp_matches(base, '{vf.SECOND_TIER}') THEN 'second' WHEN regexp_matches(base, '{vf.FIRST_TIER}') THEN 'first' ELSE 'none' END AS tier FROM b")
def title_tier(spark, sf):
    """Titles of every kind, dealt to the pages, whose own are invented words."""
    title = F.element_at(F.array(*[F.lit(x) for x in TITLES]), (F.col("page_id") % 10 + 1).cast("int"))
    return src.table(spark, sf, "pages").select("page_id", vf.title_tier(title).alias("tier"))


# Gates, periods and settings ---------------------------------------------------------------------------------------


@query("baseline_gate", "SELECT user_id, event_id, event_type AS metric, value, lag(value) OVER w AS baseline, coalesce(value >= lag(value) OVER w - 20, true) AS passed FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def baseline_gate(spark, sf):
    """Events as runs of their user's suite, each with one metric."""
    runs = src.table(spark, sf, "events").select("user_id", "ts", "event_id", F.create_map("event_type", "value").alias("metrics"))
    return ql.baseline_gate(runs, "user_id", ["ts", "event_id"], 20.0).drop("ts")


@query("full_years", """WITH g AS (SELECT o_custkey, min(last_day(o_orderdate)) AS lo, max(last_day(o_orderdate)) AS hi FROM orders GROUP BY 1), s AS (SELECT o_custkey, hi, unnest(generate_series(make_date(year(lo), 3, 1), hi, INTERVAL 3 MONTH)) AS m FROM g)
SELECT o_custkey, strftime(last_day(m), '%Y-%m-%d') AS period_end FROM s WHERE last_day(m) <= hi""")
def full_years(spark, sf):
    o = src.table(spark, sf, "orders").select("o_custkey", F.last_day("o_orderdate").alias("period_end"))
    return fn.full_years(o, "o_custkey").select("o_custkey", day_text("period_end").alias("period_end"))


SETTINGS = "p_size % 60 - 5 AS guarantee, 50 - p_size % 3 * 20 AS fusion, CASE p_size % 4 WHEN 0 THEN NULL ELSE p_size % 4 - 1 END AS timeout, CASE p_size % 5 WHEN 0 THEN NULL ELSE p_size % 5 - 1 END AS chars, p_size AS top, 10 + p_partkey % 40 AS candidates, p_size % 2 AS lexical, p_size % 3 - 1 AS vector, p_partkey % 9 AS rrf, p_partkey % 7 - 1 AS boost, p_partkey % 5 AS growth"


@query("config_problems", f"""WITH s AS (SELECT p_partkey, {SETTINGS} FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN guarantee < 0 OR guarantee > fusion THEN 'vector_guarantee' END, CASE WHEN timeout <= 0 THEN 'rerank_timeout' END, CASE WHEN chars <= 0 THEN 'rerank_max_chars' END, CASE WHEN top > fusion THEN 'top_k' END, CASE WHEN fusion > candidates * 2 THEN 'fusion_k' END,
CASE WHEN lexical <= 0 AND vector <= 0 THEN 'weights' END, CASE WHEN rrf <= 0 THEN 'rrf_k' END, CASE WHEN boost < 0 OR boost >= 1 THEN 'period_boost' END, CASE WHEN growth < 2 THEN 'oversample_growth' END) AS problems FROM s""")
def config_problems(spark, sf):
    s = src.table(spark, sf, "part").selectExpr("p_partkey", *[x.strip() for x in SETTINGS.split(", ")])
    c = F.col
    p = rt.config_problems(c("guarantee"), c("fusion"), c("timeout"), c("chars"), c("top"), c("candidates"), c("lexical"), c("vector"), c("rrf"), c("boost"), c("growth"))
    return s.select("p_partkey", F.array_join(p, ",").alias("problems"))
