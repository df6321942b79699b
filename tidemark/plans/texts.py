"""Registered queries of text, table-cell, join, entity and tree operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunks as ch
from ..functions import sequential as sq
from ..operators import entities as en
from ..operators import textops as tx
from ..sources import payloads
from ..sources import projections as src
from ..sources.projections import ANNOUNCEMENT, BLOCK, DOCUMENT, day_text, stamp

QUERIES: dict = {}
SQL: dict[str, str] = {}
BLOCKS = f"{DOCUMENT}, {BLOCK}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def docs(spark, sf):
    return src.table(spark, sf, "documents")


# RE2 and Java agree on this pattern; the alternatives' order matters: in parentheses, else signed or bare
NUM = r"\([0-9][0-9,]*(?:\.[0-9]+)?\)|[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?"
NUMS = "regexp_extract_all(translate({x}, '" + f"{tx.WIDE}', '{tx.NARROW}'), '{NUM}')".replace("{3}", "{{3}}")


@query("number_tokens", f"SELECT doc_id, item, count(*) AS n FROM (SELECT doc_id, unnest({NUMS.format(x='text')}) AS item FROM documents) GROUP BY ALL")
def number_tokens(spark, sf):
    return tx.multiset(docs(spark, sf), ["doc_id"], tx.numbers(F.col("text")))


HALF = "substr(text, 1, length(text) // 2)"


@query("number_closure", f"""WITH a AS (SELECT doc_id, item, count(*) AS n FROM (SELECT doc_id, unnest({NUMS.format(x="replace(text, '1', '7')")}) AS item FROM documents) GROUP BY ALL), b AS (SELECT doc_id, item, count(*) AS m FROM (SELECT doc_id, unnest({NUMS.format(x='text')}) AS item FROM documents) GROUP BY ALL)
SELECT doc_id, CAST(sum(least(coalesce(n, 0), coalesce(m, 0))) AS BIGINT) AS shared, CAST(sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0)) AS BIGINT) AS only_a, CAST(sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0)) AS BIGINT) AS only_b FROM a FULL JOIN b USING (doc_id, item) GROUP BY doc_id""")
def number_closure(spark, sf):
    d = docs(spark, sf)
    a = tx.multiset(d, ["doc_id"], tx.numbers(F.replace("text", F.lit("1"), F.lit("7"))))
    return tx.multiset_compare(a, tx.multiset(d, ["doc_id"], tx.numbers(F.col("text"))), ["doc_id"])


CHARS = "string_split(regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g'), '')"


@query("char_closure", f"""WITH s AS (SELECT * FROM documents), a AS (SELECT doc_id, item, count(*) AS n FROM (SELECT doc_id, unnest({CHARS.format(x="replace(text, 'e', 'ee')")}) AS item FROM s) WHERE item <> '' GROUP BY ALL), b AS (SELECT doc_id, item, count(*) AS m FROM (SELECT doc_id, unnest({CHARS.format(x='text')}) AS item FROM s) WHERE item <> '' GROUP BY ALL)
SELECT doc_id, CAST(sum(least(coalesce(n, 0), coalesce(m, 0))) AS BIGINT) AS shared, CAST(sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0)) AS BIGINT) AS only_a, CAST(sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0)) AS BIGINT) AS only_b FROM a FULL JOIN b USING (doc_id, item) GROUP BY doc_id""")
def char_closure(spark, sf):
    chars = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), ""), lambda x: x != "")
    d = docs(spark, sf)
    return tx.multiset_compare(tx.multiset(d, ["doc_id"], chars(F.replace("text", F.lit("e"), F.lit("ee")))), tx.multiset(d, ["doc_id"], chars(F.col("text"))), ["doc_id"])


WORDS = "list_filter(string_split_regex({x}, '[ \\n\\t\\r]+'), lambda w: w <> '')"


@query("text_coverage", f"""WITH a AS (SELECT doc_id, item, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format(x=HALF)}) AS item FROM documents) GROUP BY ALL), b AS (SELECT doc_id, item, count(*) AS m FROM (SELECT doc_id, unnest({WORDS.format(x='text')}) AS item FROM documents) GROUP BY ALL)
SELECT doc_id, round(coalesce(sum(least(coalesce(n, 0), coalesce(m, 0))) / nullif(sum(coalesce(m, 0)), 0), 1.0), 6) AS coverage, round(coalesce(sum(least(coalesce(n, 0), coalesce(m, 0))) / nullif(sum(coalesce(n, 0)), 0), 1.0), 6) AS precision FROM b FULL JOIN a USING (doc_id, item) GROUP BY doc_id""")
def text_coverage(spark, sf):
    words = lambda c: F.filter(F.split(c, "[ \n\t\r]+"), lambda x: x != "")
    d = docs(spark, sf)
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    c = tx.multiset_compare(tx.multiset(d, ["doc_id"], words(half)), tx.multiset(d, ["doc_id"], words(F.col("text"))), ["doc_id"])
    share = lambda rest: F.round(F.coalesce(F.col("shared") / F.nullif(F.col("shared") + F.col(rest), F.lit(0)), F.lit(1.0)), 6)
    return c.select("doc_id", share("only_b").alias("coverage"), share("only_a").alias("precision"))


BOILER = " OR ".join(["c = ''", *(f"regexp_matches(c, '{p}')" for p in tx.BOILERPLATE)])


@query("boilerplate", f"WITH {BLOCKS} SELECT block_id, {BOILER} AS boilerplate FROM (SELECT block_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS c FROM doc_block)")
def boilerplate(spark, sf):
    return src.doc_block(spark, sf).select("block_id", tx.is_boilerplate(F.col("content")).alias("boilerplate"))


# cells of every form, and two for each part: its price with a unit, and its size in parentheses
CELLS = ["12,340", "58.2%", "(1,234)", "(1)", "1.5万元", "2024年", "-7.25", "１２，３４０", "", " 42 ", "1,2a", "(12.5)", "(3.1%)", "5%万元", "649,900,00<br>0", "7<br/>亿元", "1,23", ".5", "12 34", "(1,234)万股", "＋3"]
CELL_SQL = f"""x AS (SELECT unnest({CELLS!r}) AS cell UNION ALL SELECT DISTINCT p_retailprice || '万元' FROM part UNION ALL SELECT DISTINCT '(' || p_size || ',000)' FROM part),
t AS (SELECT cell, trim(regexp_replace(translate(regexp_replace(cell, '{tx.BREAK}', ' ', 'g'), '{tx.WIDE}', '{tx.NARROW}'), '\\s+', ' ', 'g')) AS c FROM x),
n AS (SELECT cell, regexp_extract(c, '{tx.CELL}', 1) AS number, nullif(regexp_extract(c, '{tx.CELL}', 2), '') AS unit FROM t),
g AS (SELECT *, number <> '' AND NOT regexp_matches(cell, '{tx.BROKEN}') AND NOT (contains(number, '%') AND unit IS NOT NULL) AS good, TRY_CAST(regexp_replace(number, '[^0-9.]', '', 'g') AS DECIMAL(38,10)) AS v FROM n)"""


@query("cell_value", f"""WITH {CELL_SQL} SELECT cell, CASE WHEN good THEN CAST(CASE WHEN regexp_matches(number, '^[(-]') THEN -v ELSE v END AS DOUBLE) END AS value, CASE WHEN good THEN CASE WHEN contains(number, '%') THEN 'percent' ELSE 'amount' END END AS kind, CASE WHEN good THEN unit END AS unit FROM g""")
def cell_value(spark, sf):
    p = src.table(spark, sf, "part")
    d = spark.createDataFrame([(c,) for c in CELLS], "cell string")
    d = d.unionByName(p.select(F.concat(F.col("p_retailprice").cast("string"), F.lit("万元")).alias("cell")).distinct()).unionByName(p.select(F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(",000)")).alias("cell")).distinct())
    v, kind, unit = tx.cell_value(F.col("cell"))
    return d.select("cell", v.cast("double").alias("value"), kind.alias("kind"), unit.alias("unit"))


@query("confidence_score", "SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE * least(1.0::DOUBLE, n_chars / 1999.0::DOUBLE) + 0.3::DOUBLE * CASE WHEN n_chars = length(text) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.2::DOUBLE * (1 - (doc_id % 10) / 10.0::DOUBLE) + 0.2::DOUBLE * (1 - (doc_id % 4) / 4.0::DOUBLE))), 4) AS confidence FROM documents")
def confidence_score(spark, sf):
    c = tx.confidence(F.least(F.lit(1.0), F.col("n_chars") / 1999.0), F.when(F.col("n_chars") == F.length("text"), 1.0).otherwise(0.0), (F.col("doc_id") % 10) / 10.0, (F.col("doc_id") % 4) / 4.0)
    return docs(spark, sf).select("doc_id", c.alias("confidence"))


@query("line_repetition_decor", f"WITH {BLOCKS} SELECT source, trim(content) AS line, count(DISTINCT doc_id) AS n_docs FROM doc_block WHERE length(trim(content)) > 0 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3")
def line_repetition_decor(spark, sf):
    return tx.line_repetition(src.doc_block(spark, sf))


@query("continuation", f"WITH {BLOCKS} SELECT doc_id, ordinal, coalesce(lag(content) OVER w IS NOT NULL AND lag(ordinal) OVER w = ordinal - 1 AND NOT regexp_matches(lag(content) OVER w, '[.!?]\\s*$') AND regexp_matches(content, '^[a-z]'), false) AS continues FROM doc_block WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)")
def continuation(spark, sf):
    return tx.continuation(src.doc_block(spark, sf))


@query("gaps_islands_rows", """WITH n AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 3 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM n)
SELECT user_id, island, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM i GROUP BY ALL""")
def gaps_islands_rows(spark, sf):
    d = tx.islands(src.table(spark, sf, "events"), "user_id", 3 * 3600)
    return d.select("user_id", "island", "n", stamp("first").alias("first"), stamp("last").alias("last"))


GRID = "cells AS (SELECT p_partkey // 8 AS table_id, p_partkey AS cell, CAST((p_partkey % 8) // 3 AS INTEGER) AS r, CAST((p_partkey % 8) % 3 AS INTEGER) AS c, CASE WHEN p_size % 11 = 0 THEN 2 ELSE 1 END AS rs, CASE WHEN p_size % 7 = 0 THEN 2 ELSE 1 END AS cs, p_brand AS t FROM part)"
SLOTS = "slots AS (SELECT table_id, row, col, arg_max(t, cell) AS text, count(*) AS covered FROM (SELECT *, unnest(generate_series(c, c + cs - 1)) AS col FROM (SELECT *, unnest(generate_series(r, r + rs - 1)) AS row FROM cells)) GROUP BY ALL)"


def cells(spark, sf):
    k = F.col("p_partkey")
    return src.table(spark, sf, "part").select(F.floor(k / 8).alias("table_id"), k.alias("cell"), F.floor(k % 8 / 3).cast("int").alias("r"), (k % 8 % 3).cast("int").alias("c"), F.when(F.col("p_size") % 11 == 0, 2).otherwise(1).alias("rs"), F.when(F.col("p_size") % 7 == 0, 2).otherwise(1).alias("cs"), F.col("p_brand").alias("t"))


@query("grid_slots", f"WITH {GRID}, {SLOTS} SELECT * FROM slots")
def grid_slots(spark, sf):
    return tx.grid_slots(cells(spark, sf))


@query("grid_holes", f"WITH {GRID}, {SLOTS} SELECT table_id, CAST((max(row) + 1) * (max(col) + 1) - count(*) AS BIGINT) AS holes, count(*) FILTER (WHERE covered > 1) AS overlaps FROM slots GROUP BY table_id")
def grid_holes(spark, sf):
    return tx.grid_slots(cells(spark, sf)).groupBy("table_id").agg(((F.max("row") + 1) * (F.max("col") + 1) - F.count("*")).cast("long").alias("holes"), F.count_if(F.col("covered") > 1).alias("overlaps"))


UNITS = "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'm' END AS i, CASE WHEN p_size % 3 = 0 THEN 'k' END AS c, CASE p_size % 4 WHEN 0 THEN 'k' WHEN 1 THEN 'm' END AS r, CASE WHEN p_size % 2 = 0 THEN 'u' END AS t FROM part"


@query("unit_precedence", f"SELECT id, CASE WHEN i IS NOT NULL THEN i WHEN r IS NOT NULL AND c IS NOT NULL AND r <> c THEN NULL ELSE coalesce(c, r, t) END AS unit FROM ({UNITS})")
def unit_precedence(spark, sf):
    s = F.col("p_size")
    u = tx.unit_for_cell(F.when(s % 5 == 0, "m"), F.when(s % 3 == 0, "k"), F.when(s % 4 == 0, "k").when(s % 4 == 1, "m"), F.when(s % 2 == 0, "u"))
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), u.alias("unit"))


@query("fact_tolerance", "SELECT p_partkey AS id, least(greatest(6000.0, 0.5 * pow(10.0, -(p_size % 3)) * p_retailprice * 100), greatest(6000.0, 0.005 * p_retailprice * 100)) AS tolerance FROM part")
def fact_tolerance(spark, sf):
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.tolerance(F.col("p_size") % 3, F.col("p_retailprice") * 100).alias("tolerance"))


@query("cell_citation", "SELECT conv_id, turn, CAST(regexp_extract('see [' || conv_id || ' | 3 | r' || turn || 'c2]', '\\[\\s*([0-9]+)\\s*\\|\\s*([0-9]+)\\s*\\|\\s*r([0-9]+)c([0-9]+)\\s*\\]', 1) AS BIGINT) AS table_id, CAST(regexp_extract('see [' || conv_id || ' | 3 | r' || turn || 'c2]', 'r([0-9]+)c([0-9]+)', 1) AS BIGINT) AS cited_row FROM conversations")
def cell_citation(spark, sf):
    t = F.concat(F.lit("see ["), F.col("conv_id").cast("string"), F.lit(" | 3 | r"), F.col("turn").cast("string"), F.lit("c2]"))
    pattern = r"\[\s*([0-9]+)\s*\|\s*([0-9]+)\s*\|\s*r([0-9]+)c([0-9]+)\s*\]"
    return src.table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract(t, pattern, 1).cast("long").alias("table_id"), F.regexp_extract(t, pattern, 3).cast("long").alias("cited_row"))


@query("lexical_overlap", "WITH b AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), g AS (SELECT conv_id, turn, list_distinct([substr(text, i, 2) for i in generate_series(1, length(text) - 1)]) AS a, list_distinct([substr(nxt, i, 2) for i in generate_series(1, length(nxt) - 1)]) AS b FROM b WHERE length(text) >= 2 AND length(nxt) >= 2) SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(a), 6) AS overlap FROM g")
def lexical_overlap(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = src.table(spark, sf, "conversations").withColumn("nxt", F.lead("text").over(w)).filter("length(text) >= 2 and length(nxt) >= 2")
    a, b = tx.bigrams(F.col("text")), tx.bigrams(F.col("nxt"))
    return d.select("conv_id", "turn", F.round(F.size(F.array_intersect(a, b)) / F.size(a), 6).alias("overlap"))


CUT = "coalesce(CASE WHEN {a} + 400 >= length(s) THEN length(s) END, nullif(length(regexp_extract(substr(s, {a} + 201, 200), '(?s)^(.*[。！？；\\n])', 1)), 0) + {a} + 200, {a} + 400)"


@query("chunk_split", f"""WITH RECURSIVE t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM documents),
p AS (SELECT doc_id, s, 0 AS k, CAST(0 AS BIGINT) AS a, CAST({CUT.format(a='0')} AS BIGINT) AS b FROM t WHERE length(s) > 0 UNION ALL SELECT doc_id, s, k + 1, b - 48, CAST({CUT.format(a='(b - 48)')} AS BIGINT) FROM p WHERE b < length(s)),
w AS (SELECT *, lead(a) OVER d AS na, lead(b) OVER d AS nb, lead(k, 2) OVER d IS NULL AND lead(k) OVER d IS NOT NULL AS before_last, lag(a) OVER d AS pa, lead(k) OVER d IS NULL AND k > 0 AS last FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
m AS (SELECT doc_id, s, k, a, CASE WHEN before_last AND nb - na < 200 AND nb - a <= 400 THEN nb ELSE b END AS b FROM w WHERE NOT (last AND b - a < 200 AND b - pa <= 400))
SELECT doc_id, k AS piece, b - a AS n, sha256(substr(s, a + 1, b - a)) AS digest FROM m""")
def chunk_split(spark, sf):
    d = ch.split_texts(docs(spark, sf), "doc_id", "text")
    return d.select("doc_id", "piece", F.length("content").alias("n"), F.sha2("content", 256).alias("digest"))


@query("chunk_merge", f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT doc_id, page, ordinal, length(content) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k FROM doc_block),
r AS (SELECT doc_id, k, ordinal, n, 0 AS run, n AS len, CASE WHEN n < 120 THEN page END AS open_page FROM o WHERE k = 1 UNION ALL SELECT doc_id, k, ordinal, n, CASE WHEN fits THEN run ELSE run + 1 END, CASE WHEN fits THEN len + n + 1 ELSE n END, CASE WHEN fits THEN open_page WHEN n < 120 THEN page END FROM (SELECT o.*, run, len, open_page, coalesce(open_page = o.page, false) AND o.n < 120 AND len + o.n <= 400 AS fits FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1))
SELECT doc_id, run, min(ordinal) AS first_ordinal, count(*) AS n_blocks, CAST(sum(n) + count(*) - 1 AS BIGINT) AS n FROM r GROUP BY doc_id, run""")
def chunk_merge(spark, sf):
    return sq.merge_short(src.doc_block(spark, sf)).select("doc_id", "run", "first_ordinal", "n_blocks", F.length("content").alias("n"))


@query("heading_consistency", f"WITH {BLOCKS}, h AS (SELECT doc_id, ordinal, ordinal + 1 + CASE WHEN doc_id % 3 = 0 AND ordinal >= 4 THEN 1 ELSE 0 END AS no, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS want FROM doc_block WHERE length(content) > 0) SELECT doc_id, count(*) AS n_headings, CASE WHEN count(*) > 1 THEN bool_and(no = want) END AS consistent FROM h GROUP BY doc_id")
def heading_consistency(spark, sf):
    """The synthetic lines carry no numbers; each line with content gets one, a third of the documents with a gap."""
    no = F.col("ordinal") + 1 + F.when((F.col("doc_id") % 3 == 0) & (F.col("ordinal") >= 4), 1).otherwise(0)
    b = src.doc_block(spark, sf).filter("length(content) > 0")
    return sq.heading_consistency(b.select("doc_id", "ordinal", F.concat(no.cast("string"), F.lit(". "), F.col("content")).alias("content")))


LINK = '<li><a href="([^"]*)">([^<&]*)</a></li>'


@query("html_tables", f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS a, regexp_extract_all(html, '{LINK}', 2) AS b FROM pages), x AS (SELECT page_id, unnest(range(len(a))) AS r, a, b FROM l)
SELECT page_id, CAST(r AS INTEGER) AS r, c, 1 AS rs, 1 AS cs, trim(CASE c WHEN 0 THEN a[r + 1] ELSE b[r + 1] END) AS t FROM x, (VALUES (0), (1)) AS y(c)""")
def html_tables(spark, sf):
    """The synthetic pages have no tables: their navigation lists are turned into rows of target and text, and read as a table."""
    h = F.col("html")
    a, b = (F.regexp_extract_all(h, F.lit(LINK), k) for k in (1, 2))
    rows = F.array_join(F.zip_with(a, b, lambda x, y: F.concat(F.lit("<tr><td>"), x, F.lit("</td><td>"), y, F.lit("</td></tr>"))), "")
    return sq.html_grid(src.table(spark, sf, "pages").select("page_id", F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html")), "page_id", "html")


PATHS = "SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'amount|' || year(o_orderdate) || 'FY' WHEN 1 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) || '|prior|' || (year(o_orderdate) - 1) || 'FY' WHEN 2 THEN 'three months ended ' || (year(o_orderdate) + 10) || 'Q' || quarter(o_orderdate) || '|' || (year(o_orderdate) + 10) || 'Q' || quarter(o_orderdate) ELSE 'prior year ' || (year(o_orderdate) + 20) || '|' || (year(o_orderdate) + 20) || 'Q4' END AS path FROM orders"


@query("period_path", f"SELECT path, CASE WHEN len(p) = 1 THEN p[1] END AS period FROM (SELECT path, list_distinct(regexp_extract_all(path, '20[0-9][0-9](?:Q[1-4]|FY)')) AS p FROM ({PATHS}))")
def period_path(spark, sf):
    y, q, k = F.year("o_orderdate"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")), F.col("o_orderkey") % 4
    year = lambda n: (y + n).cast("string")
    one = F.concat(F.lit("amount|"), year(0), F.lit("FY"))
    two = F.concat(year(0), q, F.lit("|prior|"), year(-1), F.lit("FY"))
    three = F.concat(F.lit("three months ended "), year(10), q, F.lit("|"), year(10), q)
    four = F.concat(F.lit("prior year "), year(20), F.lit("|"), year(20), F.lit("Q4"))
    d = src.table(spark, sf, "orders").select(F.when(k == 0, one).when(k == 1, two).when(k == 2, three).otherwise(four).alias("path")).distinct()
    return d.select("path", sq.period_of_path(F.col("path")).alias("period"))


@query("build_tree", f"WITH {BLOCKS} SELECT doc_id, source || '/' || page AS parent, min(ordinal) AS first_ordinal, count(*) AS n_leaves, row_number() OVER (PARTITION BY doc_id ORDER BY min(ordinal)) AS parent_no FROM doc_block GROUP BY doc_id, source, page")
def build_tree(spark, sf):
    g = src.doc_block(spark, sf).groupBy("doc_id", "source", "page").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("n_leaves"))
    return g.select("doc_id", F.concat("source", F.lit("/"), F.col("page").cast("string")).alias("parent"), "first_ordinal", "n_leaves", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_ordinal")).alias("parent_no"))


@query("page_acceptance", f"""WITH {BLOCKS}, p AS (SELECT doc_id, page, CASE WHEN max(length(content)) > 2000 THEN 'rejected' WHEN bool_or(contains(content, '|')) THEN 'unverified' WHEN min(length(content)) = 0 THEN 'with_scan' ELSE 'accepted' END AS state FROM doc_block GROUP BY ALL)
SELECT doc_id, count(*) AS pages, CASE WHEN bool_or(state = 'rejected') THEN 'rejected' WHEN bool_or(state = 'unverified') THEN CASE WHEN bool_and(state = 'unverified') THEN 'unverified' ELSE 'partially' END WHEN bool_or(state = 'with_scan') THEN 'with_scan' ELSE 'accepted' END AS state FROM p GROUP BY doc_id""")
def page_acceptance(spark, sf):
    n = F.length("content")
    p = src.doc_block(spark, sf).groupBy("doc_id", "page").agg(F.when(F.max(n) > 2000, "rejected").when(F.bool_or(F.col("content").contains("|")), "unverified").when(F.min(n) == 0, "with_scan").otherwise("accepted").alias("s"))
    any_of = lambda x: F.bool_or(F.col("s") == x)
    state = F.when(any_of("rejected"), "rejected").when(any_of("unverified"), F.when(F.bool_and(F.col("s") == "unverified"), "unverified").otherwise("partially")).when(any_of("with_scan"), "with_scan").otherwise("accepted")
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), state.alias("state"))


@query("ledger_alerts", f"WITH {BLOCKS}, g AS (SELECT source, count(*) AS pages, round(count(*) FILTER (WHERE contains(content, '|')) / count(*), 6) AS share FROM doc_block GROUP BY source) SELECT *, CASE WHEN pages >= 50 AND share > 0.05 THEN 'alert' ELSE 'ok' END AS state FROM g")
def ledger_alerts(spark, sf):
    g = src.doc_block(spark, sf).groupBy("source").agg(F.count("*").alias("pages"), F.round(F.count_if(F.col("content").contains("|")) / F.count("*"), 6).alias("share"))
    return g.withColumn("state", F.when((F.col("pages") >= 50) & (F.col("share") > 0.05), "alert").otherwise("ok"))


@query("blended_cost", "SELECT source, CAST(round(sum(CASE WHEN length(text) < 500 THEN CAST(0.0339 AS DECIMAL(10,4)) WHEN length(text) < 3000 THEN CAST(0.1356 AS DECIMAL(10,4)) ELSE CAST(1.0 AS DECIMAL(10,4)) END) / count(*), 4) AS DOUBLE) AS cost FROM documents GROUP BY source")
def blended_cost(spark, sf):
    n = F.length("text")
    price = F.when(n < 500, F.lit("0.0339")).when(n < 3000, F.lit("0.1356")).otherwise(F.lit("1.0")).cast("decimal(10,4)")
    return docs(spark, sf).groupBy("source").agg(F.round(F.sum(price).cast("double") / F.count("*"), 4).alias("cost"))


# Joins and entities ------------------------------------------------------------------------------------------------


@query("join_anti_orphans", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def join_anti_orphans(spark, sf):
    return docs(spark, sf).select("doc_id").join(src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("join_left_missing", "SELECT source, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def join_left_missing(spark, sf):
    l = src.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("there"))
    return docs(spark, sf).select("doc_id", "source").join(l, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("join_array_membership", "WITH o AS (SELECT conv_id, list(turn * 7 + conv_id) AS evidence FROM conversations GROUP BY conv_id) SELECT conv_id, doc_id FROM (SELECT conv_id, unnest(evidence) AS e FROM o) JOIN documents ON doc_id = e")
def join_array_membership(spark, sf):
    o = src.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn") * 7 + F.col("conv_id")).alias("evidence"))
    return o.select("conv_id", F.explode("evidence").alias("doc_id")).join(docs(spark, sf).select("doc_id"), "doc_id").select("conv_id", "doc_id")


@query("join_lateral_top1", "SELECT c_custkey, x.o_orderkey, round(x.o_totalprice, 4) AS price FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) x ON o_custkey = c_custkey")
def join_lateral_top1(spark, sf):
    top = src.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_totalprice", "o_orderkey")).alias("x"))
    return src.table(spark, sf, "customer").select("c_custkey").join(top, "c_custkey", "left").select("c_custkey", "x.o_orderkey", F.round("x.o_totalprice", 4).alias("price"))


CHAIN = "n AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent FROM conversations)"


def chain(spark, sf):
    i = F.col("conv_id") * 100 + F.col("turn")
    return src.table(spark, sf, "conversations").select(i.alias("id"), F.when(F.col("turn") > 0, i - 1).alias("parent"))


@query("ancestors_recursive", f"WITH RECURSIVE {CHAIN}, a AS (SELECT id, parent AS ancestor, 1 AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT a.id, n.parent, depth + 1 FROM a JOIN n ON a.ancestor = n.id WHERE n.parent IS NOT NULL ) SELECT * FROM a")
def ancestors_recursive(spark, sf):
    return en.ancestors(chain(spark, sf))


@query("version_successor", f"WITH RECURSIVE {CHAIN}, a AS (SELECT id, id AS last, 0 AS steps FROM n UNION ALL SELECT a.id, n.id, steps + 1 FROM a JOIN n ON n.parent = a.last ) SELECT id, max(last) AS last, max(steps) AS steps FROM a GROUP BY id")
def version_successor(spark, sf):
    return en.last_successor(chain(spark, sf))


@query("tree_stats", f"WITH RECURSIVE {CHAIN}, a AS (SELECT id, parent, 1 AS depth FROM n UNION ALL SELECT a.id, n.parent, depth + 1 FROM a JOIN n ON a.parent = n.id) SELECT count(DISTINCT id) AS nodes, max(depth) AS depth, (SELECT count(*) FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)) AS orphans FROM a")
def tree_stats(spark, sf):
    return en.tree_stats(chain(spark, sf))


@query("relations_one_hop", "WITH e AS (SELECT DISTINCT l_suppkey AS s, o_custkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT s AS entity, t AS other, 'out' AS direction FROM e UNION ALL SELECT t, s, 'in' FROM e")
def relations_one_hop(spark, sf):
    e = src.table(spark, sf, "lineitem").join(src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(F.col("l_suppkey").alias("s"), F.col("o_custkey").alias("t")).distinct()
    return en.one_hop(e, "s", "t")


@query("resolve_entity", """WITH a AS (SELECT s_name AS alias, s_suppkey AS entity, 1.0 AS confidence FROM supplier UNION ALL SELECT s_name, s_suppkey, 0.5 FROM supplier UNION ALL SELECT upper(s_name), s_suppkey, 0.8 FROM supplier), b AS (SELECT alias, entity, max(confidence) AS confidence FROM a GROUP BY ALL)
SELECT alias, arg_max(entity, (confidence, -entity)) AS entity, CAST(max(confidence) AS DOUBLE) AS confidence, count(*) AS candidates FROM b GROUP BY alias""")
def resolve_entity(spark, sf):
    s = src.table(spark, sf, "supplier")
    one = lambda name, c: s.select(name.alias("alias"), F.col("s_suppkey").alias("entity"), F.lit(c).alias("confidence"))
    return en.resolve([one(F.col("s_name"), 1.0), one(F.col("s_name"), 0.5), one(F.upper("s_name"), 0.8)])


@query("resolve_code", "WITH c AS (SELECT s_suppkey AS id, 'A' || s_suppkey AS k1, 'B' || (s_suppkey + 1) AS k2 FROM supplier), asked AS (SELECT 'A' || p_partkey AS code FROM part UNION ALL SELECT 'B' || p_partkey FROM part) SELECT code, min(id) AS id FROM asked LEFT JOIN c ON code = k1 OR code = k2 GROUP BY code")
def resolve_code(spark, sf):
    c = src.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("k1"), F.concat(F.lit("B"), (F.col("s_suppkey") + 1).cast("string")).alias("k2"))
    p = src.table(spark, sf, "part").select(F.explode(F.array(F.concat(F.lit("A"), F.col("p_partkey").cast("string")), F.concat(F.lit("B"), F.col("p_partkey").cast("string")))).alias("code"))
    return en.resolve_codes(p, c, "id", ["k1", "k2"])


@query("resolve_names", """WITH al AS (SELECT 'N' || s_nationkey AS name, s_suppkey AS e FROM supplier UNION SELECT 'U' || s_suppkey, s_suppkey FROM supplier), cd AS (SELECT 'C' || s_suppkey AS code, s_suppkey AS entity FROM supplier),
q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'C' || c_custkey % 150 END AS code, CASE WHEN c_custkey % 3 = 0 THEN 'U' || c_custkey % 120 ELSE 'N' || c_nationkey END AS name, [c_custkey % 100 + 1, c_custkey % 37 + 1] AS context FROM customer),
g AS (SELECT id, any_value(cd.entity) AS by_code, count(e) AS candidates, min(e) AS one, count(*) FILTER (WHERE list_contains(context, e)) AS here, min(e) FILTER (WHERE list_contains(context, e)) AS near FROM q LEFT JOIN cd ON cd.code = q.code LEFT JOIN al ON al.name = q.name GROUP BY id)
SELECT id, CASE WHEN by_code IS NOT NULL THEN by_code WHEN candidates = 1 THEN one WHEN candidates > 1 AND here = 1 THEN near END AS entity, CASE WHEN by_code IS NOT NULL OR candidates = 1 THEN 'high' WHEN candidates > 1 AND here = 1 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN by_code IS NOT NULL THEN 'code' WHEN candidates = 1 THEN 'alias' WHEN candidates > 1 AND here = 1 THEN 'context' WHEN candidates > 1 THEN 'alias_ambiguous' ELSE 'fuzzy' END AS layer, candidates FROM g""")
def resolve_names(spark, sf):
    s, i = src.table(spark, sf, "supplier"), F.col("c_custkey")
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    key = F.col("s_suppkey")
    aliases = s.select(named("N", F.col("s_nationkey")).alias("alias"), key.alias("entity")).unionByName(s.select(named("U", key).alias("alias"), key.alias("entity")))
    asked = src.table(spark, sf, "customer").select(i.alias("id"), F.when(i % 7 == 0, named("C", i % 150)).alias("code"), F.when(i % 3 == 0, named("U", i % 120)).otherwise(named("N", F.col("c_nationkey"))).alias("name"), F.array(i % 100 + 1, i % 37 + 1).alias("context"))
    return en.resolve_names(asked, s.select(named("C", key).alias("code"), key.alias("entity")), aliases)


TRI = "list_distinct([substr('  ' || lower({x}) || ' ', i, 3) for i in generate_series(1, length({x}) + 1)])"


@query("fuzzy_alias", f"""WITH a AS (SELECT p_partkey AS id, p_type AS name FROM part WHERE p_partkey % 100 = 0), b AS (SELECT DISTINCT p_type AS alias FROM part), s AS (SELECT id, alias, {TRI.format(x='name')} AS x, {TRI.format(x='alias')} AS y FROM a, b),
r AS (SELECT id, alias, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS similarity FROM s) SELECT id, alias, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, alias) AS rank FROM r WHERE similarity > 0.4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, alias) <= 5""")
def fuzzy_alias(spark, sf):
    p = src.table(spark, sf, "part")
    return en.fuzzy(p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")), p.select(F.col("p_type").alias("alias")).distinct(), 0.4, 5)


# Sources -----------------------------------------------------------------------------------------------------------


@query("columnar_json_rows", "SELECT n_nationkey AS code, n_name AS name, n_nationkey * 2 AS amount FROM nation")
def columnar_json_rows(spark, sf):
    n = src.table(spark, sf, "nation").select((F.col("n_nationkey") % 3).alias("page"), F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), (F.col("n_nationkey") * 2).cast("string")).alias("row"))
    raw = n.groupBy("page").agg(F.to_json(F.struct(F.array(F.lit("code"), F.lit("name"), F.lit("amount")).alias("fields"), F.collect_list("row").alias("items"))).alias("body"))
    r = payloads.columnar_rows(raw, "body", ["code", "name", "amount"])
    return r.select(F.col("code").cast("int").alias("code"), "name", F.col("amount").cast("int").alias("amount"))


@query("parallel_array_rows", "SELECT n_regionkey AS region, n_name AS name, n_nationkey AS code FROM nation")
def parallel_array_rows(spark, sf):
    n = src.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    raw = n.select(F.col("n_regionkey").alias("region"), F.to_json(F.struct(F.transform("x", lambda v: v["n_name"]).alias("name"), F.transform("x", lambda v: v["n_nationkey"]).alias("code"))).alias("body"))
    return payloads.parallel_rows(raw, "body", {"name": "string", "code": "int"}, ["region"])


@query("multi_table_align", "WITH a AS (SELECT o_custkey % 100 AS code, year(o_orderdate) AS period, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_custkey % 100 AS code, year(o_orderdate) AS period, max(o_orderkey) AS m FROM orders WHERE o_custkey % 100 <> 7 GROUP BY ALL) SELECT code, period, n, m, CASE WHEN n IS NULL THEN 'left_missing' WHEN m IS NULL THEN 'right_missing' ELSE 'ok' END AS state FROM a FULL JOIN b USING (code, period)")
def multi_table_align(spark, sf):
    o = src.table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("code"), F.year("o_orderdate").alias("period"), "o_orderkey")
    a = o.groupBy("code", "period").agg(F.count("*").alias("n"))
    return payloads.align(a, o.filter("code <> 7").groupBy("code", "period").agg(F.max("o_orderkey").alias("m")), ["code", "period"], "n", "m")


@query("csv_repair", "SELECT s_suppkey AS id, s_name || ', Ltd, ' || s_nationkey AS name, 'end' AS last FROM supplier")
def csv_repair(spark, sf):
    line = src.table(spark, sf, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.concat("s_name", F.lit(", Ltd, "), F.col("s_nationkey").cast("string")), F.lit("end")).alias("line"))
    r = payloads.repaired_csv(line, "line", 3, 1)
    return r.select(r["fields"][0].cast("long").alias("id"), r["fields"][1].alias("name"), r["fields"][2].alias("last"))


@query("paged_listing", "WITH l AS (SELECT page_id % 20 AS listing, url FROM pages UNION ALL SELECT page_id % 20, url FROM pages WHERE page_id % 9 = 0) SELECT listing, count(DISTINCT url) AS listed, max(t) AS total, count(DISTINCT url) = max(t) AS complete FROM l JOIN (SELECT listing, count(*) + CASE WHEN listing = 3 THEN 1 ELSE 0 END AS t FROM (SELECT page_id % 20 AS listing FROM pages) GROUP BY listing) USING (listing) GROUP BY listing")
def paged_listing(spark, sf):
    p = src.table(spark, sf, "pages").select((F.col("page_id") % 20).alias("listing"), "page_id", F.col("url").alias("ref"))
    total = p.groupBy("listing").agg((F.count("*") + F.when(F.col("listing") == 3, 1).otherwise(0)).alias("total"))
    return payloads.listing_complete(p.unionByName(p.filter("page_id % 9 = 0")).drop("page_id"), total, "listing", "ref")


@query("snapshot_sink", "SELECT event_id, CASE WHEN octet_length(encode(props)) <= 30 THEN 'inline' ELSE 'blob' END AS kept, CASE WHEN octet_length(encode(props)) <= 30 THEN NULL ELSE sha256(props) END AS blob_ref FROM events WHERE props IS NOT NULL")
def snapshot_sink(spark, sf):
    return payloads.snapshot(src.table(spark, sf, "events").filter("props is not null"), "props", 30).select("event_id", "kept", "blob_ref")
