"""Registered queries of the ordered checks. Their texts are derived from the lines of each order, by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dual as du
from ..operators import ordered as od
from ..sources import projections as src
from .texts import NUMS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def order_texts(spark, sf, pieces: dict[str, str]):
    """(l_orderkey, a text per piece): the pieces of an order's lines in order, joined by bars. Lines are shuffled as they are, before the pieces are made of them."""
    d = src.table(spark, sf, "lineitem").repartition("l_orderkey").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {k}" for k, e in pieces.items()])
    g = d.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", *pieces))).alias("x"))
    return g.select("l_orderkey", *[F.array_join(F.col(f"x.{k}"), " ; ").alias(k) for k in pieces])


def order_texts_sql(pieces: dict[str, str]) -> str:
    inner = ", ".join(f"{e} AS {k}" for k, e in pieces.items())
    outer = ", ".join(f"string_agg({k}, ' ; ' ORDER BY l_linenumber, {', '.join(pieces)}) AS {k}" for k in pieces)
    return f"t AS (SELECT l_orderkey, {outer} FROM (SELECT l_orderkey, l_linenumber, {inner} FROM lineitem) GROUP BY l_orderkey)"


# Streams -----------------------------------------------------------------------------------------------------------

K = "l_orderkey % 6"
A, B = "concat(l_partkey, '.', l_suppkey)", "concat('-', l_quantity, '%')"
STREAMS = {
    "source": f"concat('净利润增 ', {A}, '元 ', {B}, ' / ', l_linenumber)",
    "structured": f"CASE WHEN l_linenumber > 1 OR {K} = 0 THEN concat('净利润增 ', {A}, '元 ', {B}, ' / ', l_linenumber) WHEN {K} = 1 THEN concat('净利润增 ', {B}, '元 ', {A}, ' / ', l_linenumber) WHEN {K} = 2 THEN concat('净利润增 ', {A}, '元 ', {B}, ' ', l_linenumber) WHEN {K} = 3 THEN concat('净利润减 ', {A}, '元 ', {B}, ' / ', l_linenumber) WHEN {K} = 4 THEN concat('增 ', {A}, ' 元 （', l_linenumber, '） ', {B}, ' / ', l_linenumber) ELSE concat({A}, ' / ', l_linenumber) END",
}
STREAM_SQL = "regexp_extract_all(replace(replace({x}, '（', '('), '）', ')'), '[(][0-9]+[)]|-?[0-9]+(?:[.][0-9]+)?%?|[增减元]|/')"


@query("stream_difference", f"""WITH {order_texts_sql(STREAMS)}, s AS (SELECT l_orderkey, {STREAM_SQL.format(x='structured')} AS a, {STREAM_SQL.format(x='source')} AS b FROM t),
p AS (SELECT l_orderkey, min(i) AS place FROM (SELECT l_orderkey, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM s) WHERE a[i] IS DISTINCT FROM b[i] GROUP BY 1)
SELECT s.l_orderkey, CAST(len(a) AS INTEGER) AS n_structured, CAST(len(b) AS INTEGER) AS n_source, CAST(place AS INTEGER) AS place, a[place] AS structured_token, b[place] AS source_token FROM s LEFT JOIN p ON p.l_orderkey = s.l_orderkey""")
def stream_difference(spark, sf):
    """Of each order's first line the structured text swaps two numbers, drops a placeholder, turns a sign, adds a number in brackets or leaves words out, or nothing."""
    return od.stream_difference(order_texts(spark, sf, STREAMS), "l_orderkey", "structured", "source")


# Accounting --------------------------------------------------------------------------------------------------------

C = "l_partkey % 9"
U = f"CASE {C} WHEN 1 THEN concat(l_partkey, ' . ', l_suppkey) WHEN 3 THEN concat(l_linenumber, '.2023') WHEN 6 THEN concat('(', {A}, ')') ELSE {A} END"
INVENTED = {
    "stored": f"CASE WHEN {C} = 0 THEN concat({A}, ' ; ', {A}) ELSE {U} END", "unexpanded": U, "layer": f"CASE WHEN {C} IN (0, 1, 8) THEN {A} WHEN {C} = 6 THEN concat('-', {A}) ELSE 'x' END",
    "image": f"CASE WHEN {C} = 4 THEN {A} ELSE '' END", "adjacent": f"CASE WHEN {C} = 5 THEN {A} ELSE '' END", "title": f"CASE WHEN {C} = 2 THEN {A} ELSE '' END",
}
HEAL = r"regexp_replace(regexp_replace({x}, '([0-9])[ \t]*([.,])[ \t]*([0-9])', '\1\2\3', 'g'), '([0-9])[ \t]*([.,])[ \t]*([0-9])', '\1\2\3', 'g')"


def counts_sql(sides: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT l_orderkey, '{k}' AS side, unnest({NUMS.format(x=e)}) AS token FROM t" for k, e in sides.items())
    return f"c AS (SELECT l_orderkey, token, {', '.join(f'count(*) FILTER (WHERE side = {chr(39)}{k}{chr(39)}) AS {k}' for k in sides)} FROM ({rows}) GROUP BY ALL)"


@query("invented_numbers", f"""WITH {order_texts_sql(INVENTED)}, {counts_sql({k: k for k in INVENTED} | {'healed': HEAL.format(x='unexpanded')})},
v AS (SELECT *, regexp_replace(regexp_replace(replace(token, ',', ''), '^[()%+-]+|[()%]+$', '', 'g'), '([.][0-9]*[1-9])0+$|[.]0+$', '\\1') AS v FROM c), k AS (SELECT *, max(layer > 0) OVER (PARTITION BY l_orderkey, v) AS known FROM v),
a AS (SELECT *, greatest(unexpanded - layer, 0) AS raw, least(greatest(unexpanded - layer, 0), greatest(healed - layer, 0)) AS base FROM k),
b AS (SELECT *, greatest(greatest(stored - layer, 0) - raw, 0) AS expansion, least(base, image) AS i, least(base - least(base, image), title) AS h FROM a), d AS (SELECT *, least(base - i - h, adjacent) AS j FROM b), e AS (SELECT *, base - i - h - j AS rest, regexp_matches(token, '^[0-9]{{1,2}}[.](19|20)[0-9]{{2}}$') AS joined FROM d)
SELECT l_orderkey, CAST(sum(expansion + raw) AS BIGINT) AS excess, CAST(sum(expansion) AS BIGINT) AS merge_expansion, CAST(sum(raw - base) AS BIGINT) AS spacing_artifact, CAST(sum(i) AS BIGINT) AS image_ocr, CAST(sum(h) AS BIGINT) AS chart_title_year, CAST(sum(j) AS BIGINT) AS adjacent_page,
CAST(sum(CASE WHEN joined THEN rest ELSE 0 END) AS BIGINT) AS list_number_merge, CAST(sum(CASE WHEN NOT joined AND known THEN rest ELSE 0 END) AS BIGINT) AS format_variant, CAST(sum(CASE WHEN NOT joined AND NOT known THEN rest ELSE 0 END) AS BIGINT) AS value_absent FROM e GROUP BY 1""")
def invented_numbers(spark, sf):
    """A line's number is unfolded twice, spaced, in a title, joined to a year, in an image, on the next page, in brackets, absent or in place, by its part."""
    return od.invented_numbers(order_texts(spark, sf, INVENTED), "l_orderkey")


LOST = {
    "layer": A, "output": f"CASE WHEN {C} IN (0, 1, 8) THEN {A} ELSE '' END", "header": f"CASE WHEN {C} IN (2, 3) THEN {A} ELSE '' END", "chart_text": f"CASE WHEN {C} IN (3, 4) THEN {A} ELSE '' END", "table_words": f"CASE WHEN {C} IN (5, 6) THEN {A} ELSE '' END",
}


@query("lost_numbers", f"""WITH {order_texts_sql(LOST)}, {counts_sql({k: k for k in LOST})}, a AS (SELECT *, greatest(layer - output, 0) AS n FROM c), b AS (SELECT *, least(n, header) AS h FROM a), d AS (SELECT *, least(n - h, chart_text) AS ch FROM b), e AS (SELECT *, least(n - h - ch, table_words) AS tw FROM d)
SELECT l_orderkey, CAST(sum(h) AS BIGINT) AS header_footer, CAST(sum(ch) AS BIGINT) AS chart, CAST(sum(tw) AS BIGINT) AS inside_table, CAST(sum(n - h - ch - tw) AS BIGINT) AS other FROM e GROUP BY 1""")
def lost_numbers(spark, sf):
    return od.lost_numbers(order_texts(spark, sf, LOST), "l_orderkey")


MISSING = {
    "reference": A, "candidate": f"CASE WHEN {C} IN (0, 1, 8) THEN {A} ELSE 'x' END", "figure_text": f"CASE WHEN {C} = 2 THEN {A} ELSE '' END", "stripped": f"CASE WHEN {C} = 4 THEN {A} ELSE '' END",
    "layer": f"CASE WHEN {C} IN (0, 1, 3) THEN {A} WHEN {C} = 5 THEN concat('9', l_partkey, l_suppkey, '1') ELSE 'x' END",
}
DIGITS = "list_transform(regexp_extract_all({x}, '[0-9]+(?:[.,][0-9]+)*'), lambda y: regexp_replace(y, '[^0-9]', '', 'g'))"


@query("missing_numbers", f"""WITH {order_texts_sql(MISSING)}, {counts_sql({k: k for k in MISSING})}, r AS (SELECT l_orderkey, list_concat(list_concat({DIGITS.format(x='layer')}, {DIGITS.format(x='stripped')}), {DIGITS.format(x='figure_text')}) AS runs FROM t),
a AS (SELECT c.*, greatest(reference - candidate, 0) AS n, greatest(layer - candidate, 0) AS spare, len(list_filter(runs, lambda x: contains(x, regexp_replace(token, '[^0-9]', '', 'g')))) > 0 AS held FROM c JOIN r ON r.l_orderkey = c.l_orderkey),
b AS (SELECT *, least(n, figure_text) AS f FROM a), d AS (SELECT *, least(n - f, spare) AS u FROM b), e AS (SELECT *, least(n - f - u, stripped) AS s FROM d)
SELECT l_orderkey, CAST(sum(reference) AS BIGINT) AS total, CAST(sum(least(reference, candidate)) AS BIGINT) AS hit, CAST(sum(f) AS BIGINT) AS figure, CAST(sum(u) AS BIGINT) AS unexplained, CAST(sum(s) AS BIGINT) AS decor, CAST(sum(CASE WHEN held THEN n - f - u - s ELSE 0 END) AS BIGINT) AS tokenization, CAST(sum(CASE WHEN held THEN 0 ELSE n - f - u - s END) AS BIGINT) AS absent FROM e GROUP BY 1""")
def missing_numbers(spark, sf):
    return od.missing_numbers(order_texts(spark, sf, MISSING), "l_orderkey")


# Headings ----------------------------------------------------------------------------------------------------------

GOLD = "SELECT p_partkey // 8 AS doc, p_partkey % 8 AS ordinal, p_name AS title, p_size % 3 + 1 AS level FROM part"
HEADINGS = f"""gold AS ({GOLD}), found AS (SELECT doc, ordinal * 10 + CASE WHEN k = 3 THEN 15 ELSE 0 END + n AS ordinal, CASE WHEN k <> 1 THEN title WHEN n = 0 THEN substr(title, 1, 5) ELSE substr(title, 6) END AS title, CASE WHEN k = 2 THEN 4 - level ELSE level END AS level FROM (SELECT p_partkey // 8 AS doc, p_partkey % 8 AS ordinal, p_partkey % 7 AS k, p_name AS title, p_size % 3 + 1 AS level FROM part), (SELECT unnest([0, 1]) AS n) WHERE k <> 0 AND (n = 0 OR k = 1))"""


@query("heading_alignment", rf"""WITH RECURSIVE {HEADINGS}, g AS MATERIALIZED (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ordinal, title, level) AS o, title, level FROM (SELECT doc, ordinal, regexp_replace(title, '[^\p{{L}}\p{{N}}]+', '', 'g') AS title, level FROM gold) WHERE title <> ''),
f0 AS (SELECT doc, ordinal, title, level, lead(title) OVER w AS t2, lead(level) OVER w AS l2, doc || ':' || title AS k1, doc || ':' || lead(title) OVER w AS k2, doc || ':' || title || lead(title) OVER w AS k12 FROM (SELECT doc, ordinal, regexp_replace(title, '[^\p{{L}}\p{{N}}]+', '', 'g') AS title, level FROM found) WHERE title <> '' WINDOW w AS (PARTITION BY doc ORDER BY ordinal, title, level)),
names AS (SELECT DISTINCT doc || ':' || title AS k FROM g), f1 AS (SELECT *, coalesce(level = l2 AND k1 NOT IN (SELECT k FROM names) AND k2 NOT IN (SELECT k FROM names) AND k12 IN (SELECT k FROM names), false) AS joined FROM f0),
f2 AS (SELECT *, coalesce(lag(joined) OVER (PARTITION BY doc ORDER BY ordinal, title, level), false) AS gone FROM f1), f AS MATERIALIZED (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ordinal, title, level) AS o, CASE WHEN joined THEN title || t2 ELSE title END AS title, level FROM f2 WHERE NOT gone),
st AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, false AS hit FROM f UNION ALL SELECT x.doc, x.i, coalesce(x.nj, x.j), x.nj IS NOT NULL FROM (SELECT st.doc, st.i + 1 AS i, st.j, (SELECT min(g.o) FROM g WHERE g.doc = st.doc AND g.title = f.title AND g.o > st.j) AS nj FROM st JOIN f ON f.doc = st.doc AND f.o = st.i + 1) x),
pr AS (SELECT st.doc, sign(f.level - lag(f.level) OVER w) AS a, sign(g.level - lag(g.level) OVER w) AS b FROM st JOIN f ON f.doc = st.doc AND f.o = st.i JOIN g ON g.doc = st.doc AND g.o = st.j WHERE hit WINDOW w AS (PARTITION BY st.doc ORDER BY st.i)),
lv AS (SELECT doc, count(*) FILTER (WHERE a = b) AS agree, count(a) AS total FROM pr GROUP BY doc),
m AS (SELECT doc, CAST(sum(least(n, c)) AS BIGINT) AS matched FROM (SELECT doc, title, count(*) AS n FROM f GROUP BY ALL) JOIN (SELECT doc, title, count(*) AS c FROM g GROUP BY ALL) USING (doc, title) GROUP BY doc),
d AS (SELECT doc FROM g UNION SELECT doc FROM f), nf AS (SELECT doc, count(*) AS n FROM f GROUP BY doc), ng AS (SELECT doc, count(*) AS n FROM g GROUP BY doc)
SELECT d.doc, coalesce(matched, 0) AS matched, coalesce(nf.n, 0) AS n_found, coalesce(ng.n, 0) AS n_gold, coalesce(agree, 0) AS level_agree, coalesce(total, 0) AS level_total FROM d LEFT JOIN m ON m.doc = d.doc LEFT JOIN nf ON nf.doc = d.doc LEFT JOIN ng ON ng.doc = d.doc LEFT JOIN lv ON lv.doc = d.doc""")
def heading_alignment(spark, sf):
    """Eight part names a document as its headings; those found lack some, split some in two, turn some levels and move some down."""
    p = src.table(spark, sf, "part")
    gold = p.select(F.floor(F.col("p_partkey") / 8).alias("doc"), (F.col("p_partkey") % 8).alias("ordinal"), F.col("p_name").alias("title"), (F.col("p_size") % 3 + 1).alias("level"), (F.col("p_partkey") % 7).alias("k"))
    k, level = F.col("k"), F.when(F.col("k") == 2, 4 - F.col("level")).otherwise(F.col("level"))
    found = gold.filter("k <> 0").withColumn("n", F.explode(F.when(k == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    title = F.when(k != 1, F.col("title")).when(F.col("n") == 0, F.substring("title", 1, 5)).otherwise(F.expr("substring(title, 6)"))
    found = found.select("doc", (F.col("ordinal") * 10 + F.when(k == 3, 15).otherwise(0) + F.col("n")).alias("ordinal"), title.alias("title"), level.alias("level"))
    return od.heading_alignment(gold, found, "doc")


# Two parses of a page ----------------------------------------------------------------------------------------------

P = "p_partkey % 11"
ONE = "concat('<table><tr><th>项目</th><th>金额</th></tr><tr><td>', p_name, '</td><td>增 ', p_partkey, '.5 亿元</td></tr></table> 合计 ', p_size)"
SECOND = f"""CASE {P} WHEN 1 THEN replace({ONE}, '</tr></table>', '</table>') WHEN 2 THEN ' <b></b> ' WHEN 3 THEN replace({ONE}, '.5 ', '.7 ') WHEN 4 THEN replace({ONE}, '增', '减') WHEN 5 THEN replace({ONE}, '<td>增', '<td colspan="2">增') WHEN 6 THEN concat('| 项目 | 金额 |', chr(10), '|---|---|', chr(10), '| ', p_name, ' | 增 ', p_partkey, '.5 亿元 |', chr(10), chr(10), '合计 ', p_size)
WHEN 7 THEN replace({ONE}, '合计', '总共') WHEN 8 THEN replace({ONE}, '</th></tr>', '</th> x </tr>') WHEN 9 THEN concat({ONE}, ' and further words that the first of the two parses has not seen at all, which are many more than it has') WHEN 10 THEN replace(replace({ONE}, p_name, ''), '项目', p_name) ELSE {ONE} END"""


@query("dual_verdict", f"""WITH r AS (SELECT p_partkey, CASE {P} WHEN 1 THEN 'markup' WHEN 2 THEN 'empty' WHEN 3 THEN 'numbers,tables,order,text' WHEN 4 THEN 'signs,tables,order,text' WHEN 5 THEN 'tables' WHEN 7 THEN 'text' WHEN 8 THEN 'markup' WHEN 9 THEN 'text,agreement' WHEN 10 THEN 'tables,text' ELSE '' END AS reasons FROM part) SELECT p_partkey, reasons = '' AS ok, reasons FROM r""")
def dual_verdict(spark, sf):
    """Second parses that differ from the first in known ways, or in nothing but that a table is drawn by bars; the SQL has the reasons by hand."""
    p = src.table(spark, sf, "part").selectExpr("p_partkey", f"{ONE} AS a", f"{SECOND} AS b")
    return du.dual_verdict(p, "p_partkey", "a", "b").select("p_partkey", "ok", F.array_join("reasons", ",").alias("reasons"))
