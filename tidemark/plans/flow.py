"""Registered queries of increments, streams, and the remaining checks, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import folds
from ..operators import increments as inc
from ..operators import page_rules as pr
from ..operators import tables as tb
from ..operators import word_boxes as wb
from ..sources import blobs, listing, seeds
from ..sources import projections as src
from ..sources.projections import ANNOUNCEMENT, BLOCK, DOCUMENT, PRICE, QUALITY, day_text, stamp
from ..sources.shared import shared_folder
from ..streaming import commits, late
from ..streaming import events as ev
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


CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


def stream(spark, sf):
    return ev.event_stream(spark, f"{sf}/events.parquet")


@query("stream_tumbling", f"SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS w FROM events) WHERE w + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL")
def stream_tumbling(spark, sf):
    return ev.run_to_end(ev.windowed(stream(spark, sf), "1 day")).select("event_type", stamp("w.start").alias("start"), "n", F.col("total").cast("double").alias("total"))


@query("stream_sliding", f"SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS w FROM events, generate_series(0, 3) AS g(k)) WHERE w + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL")
def stream_sliding(spark, sf):
    return ev.run_to_end(ev.windowed(stream(spark, sf), "1 day", "6 hours")).select("event_type", stamp("w.start").alias("start"), "n", F.col("total").cast("double").alias("total"))


@query("stream_session", f"""WITH n AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM n)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM i GROUP BY user_id, s HAVING max(ts) + INTERVAL 3 HOUR <= {CLOSED}""")
def stream_session(spark, sf):
    return ev.run_to_end(ev.sessions(stream(spark, sf), "3 hours")).select("user_id", stamp("w.start").alias("start"), "n")


@query("stream_dedup_watermark", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup_watermark(spark, sf):
    s = stream(spark, sf)
    return ev.run_to_end(ev.deduplicated(s.unionByName(s), ["event_id"]).select("event_id", "user_id", "event_type"))


@query("stream_watermark_gap", """WITH w AS (SELECT event_type AS source, CAST(ts AS DATE) AS part, max(event_id) AS cursor FROM events WHERE event_id % 3 <> 0 GROUP BY ALL) SELECT source, strftime(max(part), '%Y-%m-%d') AS last_part, arg_max(cursor, part) AS cursor, CASE WHEN max(part) < DATE '2024-01-21' THEN strftime(max(part) + 1, '%Y-%m-%d') END AS gap_from FROM w WHERE part <= DATE '2024-01-20' GROUP BY source""")
def stream_watermark_gap(spark, sf):
    e = src.table(spark, sf, "events").filter("event_id % 3 <> 0")
    w = e.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("part")).agg(F.max("event_id").alias("cursor"))
    d = inc.gap(inc.watermark(w, F.lit("2024-01-20").cast("date")), F.lit("2024-01-21").cast("date"))
    return d.select("source", day_text("last_part").alias("last_part"), "cursor", day_text("gap_from").alias("gap_from"))


@query("partition_window", "SELECT strftime(CAST(date_trunc('day', ts - INTERVAL 1 MICROSECOND) AS DATE) + 1, '%Y-%m-%d') AS day_end, count(*) AS n FROM events GROUP BY 1")
def partition_window(spark, sf):
    return src.table(spark, sf, "events").groupBy(day_text(inc.partition_end(F.col("ts"))).alias("day_end")).agg(F.count("*").alias("n"))


@query("source_routing", """WITH h AS (SELECT event_type AS source, user_id % 4 AS layer, max(ts) FILTER (WHERE value > 90) + INTERVAL 6 HOUR AS blocked_until FROM events GROUP BY ALL) SELECT source, min(layer) FILTER (WHERE blocked_until IS NULL OR blocked_until <= TIMESTAMP '2024-01-30') AS layer, count(*) FILTER (WHERE blocked_until > TIMESTAMP '2024-01-30') AS blocked FROM h GROUP BY source""")
def source_routing(spark, sf):
    e = src.table(spark, sf, "events")
    h = e.groupBy(F.col("event_type").alias("source"), (F.col("user_id") % 4).alias("layer")).agg((F.max(F.when(F.col("value") > 90, F.col("ts"))) + F.expr("INTERVAL 6 HOURS")).alias("blocked_until"))
    return inc.route(h, F.lit("2024-01-30").cast("timestamp_ntz"))


@query("backlog_resolve", "WITH b AS (SELECT user_id AS scope, min(CAST(ts AS DATE)) AS since, count(*) AS asked FROM events WHERE event_type = 'error' GROUP BY 1), c AS (SELECT user_id AS scope, min(CAST(ts AS DATE)) AS covered FROM events WHERE event_type = 'click' GROUP BY 1) SELECT b.scope, strftime(since, '%Y-%m-%d') AS since, asked, coalesce(since >= covered, false) AS resolved FROM b LEFT JOIN c ON b.scope = c.scope")
def backlog_resolve(spark, sf):
    e = src.table(spark, sf, "events").select(F.col("user_id").alias("scope"), F.to_date("ts").alias("day"), "event_type")
    d = inc.backlog(e.filter("event_type = 'error'"), e.filter("event_type = 'click'").groupBy("scope").agg(F.min("day").alias("covered")))
    return d.withColumn("since", day_text("since"))


@query("pending_work", "SELECT d.doc_id, sha256(text) AS digest FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN embeddings ON vec_id = doc_id)")
def pending_work(spark, sf):
    d = src.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return inc.pending(d, src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "digest")


@query("index_drift", "SELECT doc_id AS id, 'missing' AS state FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'orphan' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)")
def index_drift(spark, sf):
    d = src.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    e = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return d.join(e, "id", "left_anti").withColumn("state", F.lit("missing")).unionByName(e.join(d.filter("id % 10 <> 0"), "id", "left_anti").withColumn("state", F.lit("orphan")))


@query("missing_dates", "WITH f AS (SELECT DISTINCT event_type AS base, CAST(ts AS DATE) AS d FROM events WHERE event_id % 5 <> 0 OR day(ts) % 3 <> 0), a AS (SELECT DISTINCT base, x.d FROM (SELECT DISTINCT base FROM f), (SELECT DISTINCT d FROM f) x) SELECT base, strftime(d, '%Y-%m-%d') AS day FROM (SELECT * FROM a EXCEPT SELECT * FROM (SELECT * FROM f WHERE day(d) % 4 <> 0))")
def missing_dates(spark, sf):
    f = src.table(spark, sf, "events").filter("event_id % 5 <> 0 or day(ts) % 3 <> 0").select(F.col("event_type").alias("base"), F.to_date("ts").alias("d")).distinct()
    return inc.missing(f, f.filter("day(d) % 4 <> 0"), "base", "d").select("base", day_text("d").alias("day"))


@query("denorm_invariants", f"WITH {DOCUMENT}, {BLOCK}, b AS (SELECT doc_id, block_id, CASE WHEN block_id % 97 = 0 THEN NULL ELSE owner_user END AS owner_user, CASE WHEN block_id % 89 = 0 THEN 'xx' ELSE doc_type END AS doc_type FROM doc_block) SELECT 'owner_user' AS field, count(*) AS n FROM b JOIN document d ON b.doc_id = d.doc_id WHERE b.owner_user IS DISTINCT FROM d.owner_user UNION ALL SELECT 'doc_type', count(*) FROM b JOIN document d ON b.doc_id = d.doc_id WHERE b.doc_type IS DISTINCT FROM d.doc_type")
def denorm_invariants(spark, sf):
    b = src.doc_block(spark, sf).select("doc_id", "block_id", F.when(F.col("block_id") % 97 != 0, F.col("owner_user")).alias("owner_user"), F.when(F.col("block_id") % 89 == 0, "xx").otherwise(F.col("doc_type")).alias("doc_type"))
    return inc.differing(b, src.document(spark, sf), "doc_id", ["owner_user", "doc_type"])


@query("daily_move", f"WITH {PRICE} SELECT entity, count(*) FILTER (WHERE abs(close / p - 1) > 0.05) AS jumps, count(*) FILTER (WHERE trade_date - d > 12) AS gaps FROM (SELECT *, lag(close) OVER w AS p, lag(trade_date) OVER w AS d FROM price_daily WINDOW w AS (PARTITION BY entity ORDER BY trade_date)) GROUP BY entity")
def daily_move(spark, sf):
    w = Window.partitionBy("entity").orderBy("trade_date")
    d = src.price_daily(spark, sf).withColumns({"p": F.lag("close").over(w), "d": F.lag("trade_date").over(w)})
    return d.groupBy("entity").agg(F.count_if(F.abs(F.col("close") / F.col("p") - 1) > 0.05).alias("jumps"), F.count_if(F.datediff("trade_date", "d") > 12).alias("gaps"))


@query("forward_return", f"WITH {PRICE}, r AS (SELECT entity, trade_date, close, lead(close, 21) OVER w AS later FROM price_daily WHERE NOT is_suspended WINDOW w AS (PARTITION BY entity ORDER BY trade_date)), x AS (SELECT *, CAST(round(later / close - 1, 8) AS DECIMAL(20,8)) AS ret FROM r WHERE later IS NOT NULL), m AS (SELECT trade_date, CAST(sum(ret) AS DOUBLE) / count(*) AS bench, count(*) AS n FROM x GROUP BY 1) SELECT entity, strftime(x.trade_date, '%Y-%m-%d') AS day, round(CAST(ret AS DOUBLE) - bench, 6) AS alpha FROM x JOIN m ON x.trade_date = m.trade_date WHERE n >= 3")
def forward_return(spark, sf):
    return inc.forward_alpha(src.price_daily(spark, sf).filter("not is_suspended"), 21).select("entity", day_text("trade_date").alias("day"), "alpha")


@query("hit_rate", "WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 50) AS h FROM events GROUP BY 1) SELECT user_id, n, CASE WHEN n >= 30 THEN round(h / n, 6) END AS hit_rate FROM g")
def hit_rate(spark, sf):
    g = src.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("h"))
    return g.select("user_id", "n", F.when(F.col("n") >= 30, F.round(F.col("h") / F.col("n"), 6)).alias("hit_rate"))


@query("rule_match", "SELECT p_partkey AS rule_id, e.event_type FROM part JOIN (SELECT DISTINCT event_type, length(event_type) % 5 AS k FROM events) e ON p_size % 5 = e.k WHERE p_retailprice > 1000 AND p_brand LIKE 'Brand#1%'")
def rule_match(spark, sf):
    e = src.table(spark, sf, "events").select("event_type", (F.length("event_type") % 5).alias("k")).distinct()
    p = src.table(spark, sf, "part").filter((F.col("p_retailprice") > 1000) & F.col("p_brand").like("Brand#1%")).select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") % 5).alias("k"))
    return p.join(e, "k").select("rule_id", "event_type")


@query("citation_numbers", "SELECT l_orderkey, l_linenumber, abs(round(l_extendedprice / 1000, 1) * 1000 - l_extendedprice) <= 0.005 * l_extendedprice AS supported FROM lineitem")
def citation_numbers(spark, sf):
    l = src.table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", inc.supported(F.round(F.col("l_extendedprice") / 1000, 1) * 1000, F.col("l_extendedprice")).alias("supported"))


@query("markdown_plain", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace('<b>' || text || '</b><br/><!-- x -->', '<!--[^>]*-->', '', 'g'), '<br ?/?>', ' ', 'g'), '<[^>]+>', ' ', 'g')) AS digest FROM documents")
def markdown_plain(spark, sf):
    t = F.concat(F.lit("<b>"), F.col("text"), F.lit("</b><br/><!-- x -->"))
    return src.table(spark, sf, "documents").select("doc_id", F.sha2(inc.plain(t), 256).alias("digest"))


STATEMENTS = """CASE l_orderkey % 5 WHEN 0 THEN 'Consolidated  Balance Sheet' WHEN 1 THEN '本期金额 期末余额' WHEN 2 THEN '本期金额 本期金额' WHEN 3 THEN '合并现金 流量表' ELSE 'notes' END"""


@query("statement_page", f"""WITH p AS (SELECT l_orderkey, any_value({STATEMENTS}) || string_agg(concat(' ', l_partkey, ' ; ', l_suppkey, ' ; ', l_linenumber), '') AS text FROM lineitem GROUP BY l_orderkey), f AS (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS flat FROM p)
SELECT l_orderkey, (contains(flat, 'balancesheet') OR contains(flat, '现金流量表') OR CAST(contains(flat, '本期金额') AS INT) + CAST(contains(flat, '期末余额') AS INT) >= 2) AND len({NUMS.format(x='text')}) >= 20 AS statement FROM f""")
def statement_page(spark, sf):
    """A page for each order, titled or marked by its key, with three numbers a line."""
    d = src.table(spark, sf, "lineitem").selectExpr("l_orderkey", f"{STATEMENTS} AS head", "concat(' ', l_partkey, ' ; ', l_suppkey, ' ; ', l_linenumber) AS x")
    p = d.groupBy("l_orderkey").agg(F.concat(F.max("head"), F.array_join(F.collect_list("x"), "")).alias("text"))
    return p.select("l_orderkey", pr.statement_page(F.col("text")).alias("statement"))


PAGES = {
    "doc": "CAST(floor(o_orderkey / 64) AS BIGINT)", "page": "o_orderkey % 64", "kind": "CASE WHEN floor(o_orderkey / 64) % 3 = 0 THEN 'research_report' ELSE 'announcement' END", "images": "CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END", "curves": "CASE WHEN o_custkey % 11 = 0 THEN 2 ELSE 0 END",
    "text": "CASE WHEN floor(o_orderkey / 64) % 10 = 7 THEN ' ' ELSE CASE o_custkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN '特此公告 某公司董事会 2024年1月5日' WHEN 2 THEN '免责声明：本报告仅供参考' WHEN 3 THEN concat('董事会 ', o_orderkey) WHEN 4 THEN '监事会 二〇二四年，以上公告所载内容真实、准确、完整，没有虚假记载、误导性陈述或者重大遗漏，特此公告' ELSE concat('法律声明 ', o_orderkey, ' ', o_custkey) END END",
}
ALL_PAGES = ", ".join(f"{e} AS {k}" for k, e in PAGES.items())
SKIPS = f"""p AS (SELECT {ALL_PAGES} FROM orders), q AS (SELECT *, length(regexp_replace(text, '\\s+', '', 'g')) AS chars, len({NUMS.format(x="regexp_replace(text, '(19|20)[0-9][0-9]年[0-9]+月[0-9]+日', ' ')")}) = 0 AS bare, count(*) OVER (PARTITION BY doc) AS n, row_number() OVER (PARTITION BY doc ORDER BY page DESC) AS r FROM p),
m AS (SELECT *, list_filter([CASE WHEN bare AND chars < 40 AND images = 0 AND curves = 0 THEN 'blank_page' END, CASE WHEN bare AND kind = 'announcement' AND n >= 2 AND r = 1 AND chars < 200 AND regexp_matches(text, '董事会|监事会|特此公告') THEN 'signature_tail' END, CASE WHEN bare AND kind = 'research_report' AND r <= 3 AND regexp_matches(text, '免责声明|分析师声明|法律声明|重要声明|特别声明') THEN 'research_disclaimer_tail' END], lambda x: x IS NOT NULL) AS matched FROM q),
k AS (SELECT *, list_filter(matched, lambda x: x IN ('blank_page', 'signature_tail'))[1] AS s FROM m), z AS (SELECT doc, page, matched, CASE WHEN count(s) OVER (PARTITION BY doc) < n THEN s END AS skip FROM k)"""


def skips(spark, sf):
    """Eight orders or so are a document's pages, blank, signed, disclaiming or with numbers; every tenth document is blank throughout."""
    pages = src.table(spark, sf, "orders").selectExpr(*[f"{e} AS {k}" for k, e in PAGES.items()])
    return pr.skip_decisions(pages, "doc", ["blank_page", "signature_tail"])


@query("skip_rules", f"WITH {SKIPS} SELECT doc, page, array_to_string(matched, ',') AS matched, skip FROM z")
def skip_rules(spark, sf):
    return skips(spark, sf).select("doc", "page", F.array_join("matched", ",").alias("matched"), "skip")


@query("skip_savings", f"WITH {SKIPS}, r AS (SELECT unnest(['blank_page', 'signature_tail', 'research_disclaimer_tail']) AS rule) SELECT rule, (SELECT count(*) FROM z WHERE list_contains(matched, rule)) AS matched, (SELECT count(*) FROM z WHERE skip = rule) AS skipped, round((SELECT count(*) FROM z WHERE skip = rule) * 0.1356, 4) AS saved FROM r")
def skip_savings(spark, sf):
    return pr.skip_savings(skips(spark, sf), 0.1356)


DESCRIBED = """CASE p_partkey % 10 WHEN 0 THEN ' ' WHEN 1 THEN concat(p_name, '建议买入') WHEN 2 THEN concat('列为项目、说明，共', p_size, '行。') WHEN 3 THEN concat('数据说明', p_name) WHEN 4 THEN concat('预计负债、', p_name) WHEN 5 THEN concat('预计', p_size, '年将继续增长') WHEN 6 THEN concat(p_name, '大幅增长') WHEN 7 THEN concat('收入承压 ', p_name) WHEN 8 THEN concat('同比增速 ', p_name) ELSE p_name END"""


@query("description_check", f"""SELECT p_partkey, CASE WHEN trim(x) = '' THEN 'empty' WHEN regexp_matches(x, '买入|卖出|增持|减持|推荐|目标价|评级|建议配置|仓位') THEN 'forbidden' WHEN regexp_matches(x, '(显示|说明|表明|反映|意味着|体现出)[^，。！？；、 ]') OR regexp_matches(x, '改善|恶化|强劲|疲软|亮眼|承压|超预期|不及预期')
OR regexp_matches(x, '(预计|预期)[^，。！？；、 ]*(将|会|有望|增长|下滑|下降|上升|提升|回升|改善|恶化|扩大|收窄|盈利|亏损|上涨|下跌)|有望|将会|料将') OR regexp_matches(x, '(大幅|显著|明显)(增长|下滑|提升|下降)') THEN 'judging' END AS problem FROM (SELECT p_partkey, {DESCRIBED} AS x FROM part)""")
def description_check(spark, sf):
    return src.table(spark, sf, "part").selectExpr("p_partkey", f"{DESCRIBED} AS x").select("p_partkey", pr.description_problem(F.col("x")).alias("problem"))


@query("gold_remap", f"WITH {DOCUMENT}, {BLOCK}, o AS (SELECT block_id AS old_id, doc_id, page, CASE WHEN block_id % 3 = 0 THEN substr(content, 1, 30) ELSE content END AS content FROM doc_block WHERE block_id % 7 = 0 AND length(content) > 30), n AS (SELECT block_id AS new_id, doc_id, page, content FROM doc_block WHERE block_id % 11 <> 0), j AS (SELECT old_id, new_id, CASE WHEN o.content = n.content THEN 0 ELSE 1 END AS r FROM o JOIN n ON o.doc_id = n.doc_id AND o.page = n.page AND contains(n.content, o.content)), b AS (SELECT old_id, arg_min(new_id, (r, new_id)) AS new_id, min(r) AS r FROM j GROUP BY 1) SELECT o.old_id, new_id, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'overlap' ELSE 'lost' END AS state FROM o LEFT JOIN b ON o.old_id = b.old_id")
def gold_remap(spark, sf):
    b = src.doc_block(spark, sf)
    o = b.filter("block_id % 7 = 0 and length(content) > 30").select(F.col("block_id").alias("old_id"), "doc_id", "page", F.when(F.col("block_id") % 3 == 0, F.substring("content", 1, 30)).otherwise(F.col("content")).alias("old"))
    return inc.remap(o, b.filter("block_id % 11 <> 0").select(F.col("block_id").alias("new_id"), "doc_id", "page", "content"))


@query("result_digest", f"WITH {QUALITY} SELECT metric, sha256(string_agg(source || ':' || strftime(partition_day, '%Y-%m-%d'), '|' ORDER BY source, partition_day)) AS digest FROM quality_metric GROUP BY metric")
def result_digest(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("source", "partition_day")))
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["source"].cast("string"), F.lit(":"), F.date_format(x["partition_day"], "yyyy-MM-dd"))), "|")
    return src.quality_metric(spark, sf).groupBy("metric").agg(F.sha2(text, 256).alias("digest"))


@query("json_containment", "SELECT event_id FROM events WHERE list_contains(['click', 'view'], event_type) AND json_valid(props)")
def json_containment(spark, sf):
    tags = F.from_json(F.to_json(F.array(F.lit("click"), F.lit("view"))), "array<string>")
    return src.table(spark, sf, "events").filter(F.array_contains(tags, F.col("event_type")) & F.try_parse_json("props").isNotNull()).select("event_id")


@query("raw_text_permission", f"WITH {DOCUMENT} SELECT doc_id, CASE WHEN source NOT IN ('src3', 'src7') THEN substr(text, 1, 80) END AS snippet, CASE WHEN doc_type = 'en' THEN NULL ELSE doc_type END AS unit FROM document")
def raw_text_permission(spark, sf):
    return src.document(spark, sf).select("doc_id", F.when(~F.col("source").isin("src3", "src7"), F.substring("text", 1, 80)).alias("snippet"), F.when(F.col("doc_type") != "en", F.col("doc_type")).alias("unit"))


@query("title_normalised", f"WITH {ANNOUNCEMENT} SELECT page_id, trim(lower(translate('Ｘ： ' || title, 'Ｘ：', 'X:'))) AS title_norm FROM announcement")
def title_normalised(spark, sf):
    return src.announcement(spark, sf).select("page_id", F.trim(F.lower(F.translate(F.concat(F.lit("Ｘ： "), F.col("title")), "Ｘ：", "X:"))).alias("title_norm"))


@query("nearest_number", "WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem), t AS (SELECT o_orderkey, o_totalprice FROM orders) SELECT o_orderkey, arg_min(l_linenumber, (abs(v - o_totalprice), l_linenumber)) AS linenumber FROM a JOIN t ON l_orderkey = o_orderkey GROUP BY 1")
def nearest_number(spark, sf):
    l = src.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice")
    d = l.join(src.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return d.groupBy("o_orderkey").agg(F.min_by("l_linenumber", F.struct(F.abs(F.col("l_extendedprice") - F.col("o_totalprice")), "l_linenumber")).alias("linenumber"))


@query("statement_kind", "SELECT p_partkey AS id, CASE WHEN len(list_intersect(string_split(p_type, ' '), ['STANDARD', 'BRASS', 'PLATED'])) >= 2 THEN 'balance' WHEN len(list_intersect(string_split(p_type, ' '), ['SMALL', 'TIN', 'POLISHED', 'COPPER'])) >= 2 THEN 'income' END AS kind FROM part")
def statement_kind(spark, sf):
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), inc.kind_of(F.split("p_type", " "), {"balance": ["STANDARD", "BRASS", "PLATED"], "income": ["SMALL", "TIN", "POLISHED", "COPPER"]}).alias("kind"))


# Folds -------------------------------------------------------------------------------------------------------------


@query("audit_hash_chain", """WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, sha256('|' || t) AS hash FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.turn, o.k, sha256(r.hash || '|' || o.t) FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1) SELECT conv_id, turn, hash FROM r""")
def audit_hash_chain(spark, sf):
    return folds.audit_chain(src.table(spark, sf, "conversations"), "conv_id", ["turn"], "text")


@query("budget_packing_greedy", """WITH RECURSIVE o AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, event_id, value, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, month, event_id, k, value <= 300 AS taken, CASE WHEN value <= 300 THEN 300 - value ELSE 300 END AS room FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.month, o.event_id, o.k, o.value <= room, CASE WHEN o.value <= room THEN room - o.value ELSE room END FROM r JOIN o ON o.user_id = r.user_id AND o.month = r.month AND o.k = r.k + 1)
SELECT user_id, month, event_id, taken FROM r""")
def budget_packing_greedy(spark, sf):
    e = src.table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), "event_id", "value")
    return folds.greedy_packing(e, ["user_id", "month"], ["event_id"], "value", 300.0)


@query("directory_write", f"""WITH {ANNOUNCEMENT}, a AS (SELECT page_id // 4 AS slot, known_at, page_id, NOT has_full_text AS degraded FROM announcement), b AS (SELECT *, row_number() OVER w AS k, coalesce(bool_or(NOT degraded) OVER (PARTITION BY slot ORDER BY known_at, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM a WINDOW w AS (PARTITION BY slot ORDER BY known_at, page_id))
SELECT slot, page_id, CASE WHEN k = 1 THEN 'inserted' WHEN NOT degraded AND NOT before THEN 'superseded_degraded' WHEN degraded AND before THEN 'shadowed' ELSE 'skipped' END AS outcome FROM b""")
def directory_write(spark, sf):
    a = src.announcement(spark, sf).select(F.floor(F.col("page_id") / 4).alias("slot"), "known_at", "page_id", (~F.col("has_full_text")).alias("degraded"))
    return folds.directory_write(a)


@query("hashed_embeddings", """WITH h AS (SELECT item_id, sha256(text || '|0') AS h FROM benchmark), v AS (SELECT item_id, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, 8 * k + 7, 2) || substr(h, 8 * k + 5, 2) || substr(h, 8 * k + 3, 2) || substr(h, 8 * k + 1, 2) AS UBIGINT) / 2147483648.0 - 1) AS v FROM h),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT item_id, round(v[1] / n, 4) AS first, round(v[8] / n, 4) AS last, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 4) AS norm FROM n""")
def hashed_embeddings(spark, sf):
    v = src.table(spark, sf, "benchmark").select("item_id", folds.hashed_embedding(F.col("text"), 8).alias("v"))
    place = lambda k: F.round(F.element_at("v", k).cast("double"), 4)
    return v.select("item_id", place(1).alias("first"), place(8).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))


# Tables ------------------------------------------------------------------------------------------------------------

CELLS = """cells AS (SELECT p_partkey // 12 AS table_id, CAST((p_partkey % 12) // 4 AS INTEGER) AS row, CAST(p_partkey % 4 AS INTEGER) AS col, CASE WHEN (p_partkey % 12) // 4 = 0 THEN 'h' || p_size WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_size % 9 = 0 THEN p_size || '%' ELSE CAST(p_size AS VARCHAR) END AS text FROM part)"""


def table_cells(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    row, col = F.floor(k % 12 / 4).cast("int"), (k % 4).cast("int")
    text = F.when(row == 0, F.concat(F.lit("h"), s)).when(col == 0, F.col("p_brand")).when(F.col("p_size") % 9 == 0, F.concat(s, F.lit("%"))).otherwise(s)
    return src.table(spark, sf, "part").select(F.floor(k / 12).alias("table_id"), row.alias("row"), col.alias("col"), text.alias("text"))


NUMBER = "regexp_matches(trim(text), '^[-+(]?[0-9][0-9,]*(\\.[0-9]+)?[)%]?$')"
HEADS = f"hd AS (SELECT table_id, min(row) FILTER (WHERE {NUMBER}) AS header_rows, min(col) FILTER (WHERE {NUMBER}) AS label_cols FROM cells GROUP BY 1)"


@query("header_inference", f"WITH {CELLS}, {HEADS} SELECT * FROM hd")
def header_inference(spark, sf):
    return tb.headers(table_cells(spark, sf))


@query("cell_paths", f"WITH {CELLS}, {HEADS}, c AS (SELECT * FROM cells JOIN hd USING (table_id)), p AS (SELECT table_id, col, string_agg(text, ' / ' ORDER BY row) AS col_path FROM c WHERE row < header_rows AND col >= label_cols GROUP BY ALL), l AS (SELECT table_id, row, arg_max(text, col) AS row_label FROM c WHERE col < label_cols AND row >= header_rows AND length(trim(text)) > 0 GROUP BY ALL) SELECT table_id, row, col, text, col_path, row_label FROM c LEFT JOIN p USING (table_id, col) LEFT JOIN l USING (table_id, row) WHERE row >= header_rows AND col >= label_cols AND {NUMBER}")
def cell_paths(spark, sf):
    return tb.paths(table_cells(spark, sf))


@query("unit_markers", "WITH x AS (SELECT l_orderkey % 500 AS table_id, CASE l_linenumber % 5 WHEN 0 THEN 'in Million' WHEN 1 THEN 'thousand pieces' ELSE 'none' END AS text FROM lineitem), f AS (SELECT table_id, u FROM (SELECT DISTINCT table_id FROM x) LEFT JOIN (SELECT DISTINCT table_id, unnest(regexp_extract_all(lower(text), 'thousand|million|billion')) AS u FROM x) USING (table_id)) SELECT table_id, CASE WHEN count(u) = 1 THEN max(u) END AS unit, count(u) > 1 AS conflict FROM f GROUP BY 1")
def unit_markers(spark, sf):
    k = F.col("l_linenumber") % 5
    x = src.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("table_id"), F.when(k == 0, "in Million").when(k == 1, "thousand pieces").otherwise("none").alias("text"))
    return tb.unit_markers(x, "table_id", "text")


@query("ratio_only_tables", f"WITH {CELLS} SELECT table_id, bool_and(trim(text) LIKE '%\\%' ESCAPE '\\') AS ratio_only FROM cells WHERE {NUMBER} GROUP BY 1")
def ratio_only_tables(spark, sf):
    return tb.ratio_only(table_cells(spark, sf))


FACT_CELLS = f"WITH {src.FIN}, f AS (SELECT * FROM fin_fact WHERE superseded_at IS NULL), c AS (SELECT entity, metric, period, CAST(value * CASE WHEN q = 2 THEN 1.02 ELSE 1.00 END AS DECIMAL(18,4)) AS amount, y % 2 = 0 AS own_document FROM f WHERE q <> 3 UNION ALL SELECT entity, metric, period, CAST(value * 1.5 AS DECIMAL(18,4)), y % 2 = 0 FROM f WHERE q = 1 AND y % 3 = 0)"


@query("fact_cell_match", FACT_CELLS + """, b AS (SELECT *, max(own_document) OVER (PARTITION BY entity, metric, period) AS best FROM c), g AS (SELECT f.entity, f.metric, f.period, count(amount) AS n_cells, count(DISTINCT amount) AS vals, coalesce(bool_or(abs(CAST(amount AS DOUBLE) - CAST(value AS DOUBLE)) <= greatest(6000.0::DOUBLE, 0.005::DOUBLE * abs(CAST(value AS DOUBLE)))), false) AS fits, coalesce(bool_or(own_document), false) AS own, any_value(unit) AS unit FROM f LEFT JOIN (SELECT * FROM b WHERE own_document = best) b ON f.entity = b.entity AND f.metric = b.metric AND f.period = b.period GROUP BY ALL)
SELECT entity, metric, period, CASE WHEN unit <> 'CNY' THEN 'foreign_unit' WHEN n_cells = 0 THEN 'no_cell' WHEN NOT fits THEN 'mismatch' WHEN vals > 1 THEN 'ambiguous' WHEN NOT own THEN 'restated' ELSE 'match' END AS verdict, n_cells FROM g""")
def fact_cell_match(spark, sf):
    f = src.fin_fact(spark, sf).filter("superseded_at is null")
    own = (F.col("y") % 2 == 0).alias("own_document")
    scaled = lambda x: (F.col("value") * x.cast("decimal(3,2)")).cast("decimal(18,4)").alias("amount")
    a = f.filter("q <> 3").select("entity", "metric", "period", scaled(F.when(F.col("q") == 2, F.lit("1.02")).otherwise(F.lit("1.00"))), own)
    b = f.filter("q = 1 and y % 3 = 0").select("entity", "metric", "period", scaled(F.lit("1.50")), own)
    return tb.match_facts(f, a.unionByName(b))


@query("table_row_recall", f"WITH {CELLS}, b AS (SELECT table_id, row, col, CASE WHEN (table_id + row) % 4 = 0 AND col = 2 THEN 'x' ELSE text END AS text FROM cells), s AS (SELECT table_id, row, text, count(*) AS n FROM cells GROUP BY ALL), t AS (SELECT table_id, row AS other, text, count(*) AS m FROM b GROUP BY ALL), z AS (SELECT table_id, row, CAST(sum(n) AS BIGINT) AS size FROM s GROUP BY ALL), k AS (SELECT table_id, row, other, sum(least(n, m)) AS shared FROM s JOIN t USING (table_id, text) GROUP BY ALL), h AS (SELECT table_id, row, max(shared) AS shared FROM k GROUP BY ALL) SELECT table_id, round(avg(CAST(coalesce(shared, 0) >= size AS DOUBLE)), 6) AS recall FROM z LEFT JOIN h USING (table_id, row) GROUP BY 1")
def table_row_recall(spark, sf):
    a = table_cells(spark, sf)
    b = a.withColumn("text", F.when(((F.col("table_id") + F.col("row")) % 4 == 0) & (F.col("col") == 2), "x").otherwise(F.col("text")))
    return tb.row_recall(a, b)


@query("table_backfill", f"WITH {DOCUMENT}, {BLOCK}, b AS (SELECT doc_id, ordinal, content AS text FROM doc_block), g AS (SELECT doc_id, ordinal * 10 AS grid_no, CASE WHEN doc_id % 5 = 0 AND ordinal = 1 THEN 'changed' ELSE content END AS text FROM doc_block WHERE NOT (doc_id % 7 = 0 AND ordinal = 2)), j AS (SELECT doc_id, grid_no, ordinal, coalesce(g.text = b.text, false) AS same FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grid_no) AS n FROM g) g FULL JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM b) b USING (doc_id, n)) SELECT doc_id, grid_no, ordinal FROM (SELECT *, bool_and(same) OVER (PARTITION BY doc_id) AS ok FROM j) WHERE ok")
def table_backfill(spark, sf):
    b = src.doc_block(spark, sf).select("doc_id", "ordinal", F.col("content").alias("text"))
    g = b.filter("not (doc_id % 7 = 0 and ordinal = 2)").select("doc_id", (F.col("ordinal") * 10).alias("grid_no"), F.when((F.col("doc_id") % 5 == 0) & (F.col("ordinal") == 1), "changed").otherwise(F.col("text")).alias("text"))
    return tb.backfill(g, b, "doc_id")


@query("stream_corrections", f"""WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 5 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END AS known, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE ts < {CLOSED}),
r AS (SELECT user_id, event_type, event_id, k, 'inserted' AS outcome, known AS ht, value AS hv FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_type, o.event_id, o.k, CASE WHEN abs(hv - o.value) < 1e-9 THEN 'skipped' WHEN o.known > ht THEN 'corrected' ELSE 'out_of_order' END, CASE WHEN abs(hv - o.value) >= 1e-9 AND o.known > ht THEN o.known ELSE ht END, CASE WHEN abs(hv - o.value) >= 1e-9 AND o.known > ht THEN o.value ELSE hv END FROM r JOIN o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.k = r.k + 1)
SELECT user_id, event_id, outcome FROM r""")
def stream_corrections(spark, sf):
    """Every fifth value was known three days before it came."""
    s = stream(spark, sf).withColumn("known", F.when(F.col("event_id") % 5 == 0, F.col("ts") - F.expr("INTERVAL 3 DAYS")).otherwise(F.col("ts")))
    return ev.run_to_end(late.corrections(s), late.ROCKS)


@query("committed_watermark", "SELECT count(*) AS rows, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS high FROM events")
def committed_watermark(spark, sf):
    """The events as a stream, loaded batch by batch, each committed after it is written."""
    folder = shared_folder(spark)
    commits.load(ev.event_stream(spark, f"{sf}/events.parquet"), folder, "ts")
    return commits.watermark(spark, folder, "timestamp").select("rows", stamp("high").alias("high"))


@query("cursor_ticks", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // greatest(50, (SELECT count(*) FROM customer) // 5) AS BIGINT) AS batch FROM customer")
def cursor_ticks(spark, sf):
    """Customers beyond a cursor, so many a tick, until none is left; fifty at the least, and a fifth of a larger table."""
    c = src.table(spark, sf, "customer").select("c_custkey")
    return commits.drain(c, "c_custkey", shared_folder(spark), max(50, c.count() // 5), lambda rows: rows).select("c_custkey", "batch")


BISECTED = """RECURSIVE e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), lim AS (SELECT greatest(20, count(*) // 60) AS lim FROM events), b AS (SELECT min(day) AS lo, max(day) AS hi FROM e),
w AS (SELECT event_type, lo AS f, hi AS l, (SELECT sum(n) FROM e x WHERE x.event_type = k.event_type) AS records FROM (SELECT DISTINCT event_type FROM e) k, b
UNION ALL SELECT event_type, f, l, coalesce((SELECT sum(n) FROM e x WHERE x.event_type = h.event_type AND x.day BETWEEN h.f AND h.l), 0) FROM (SELECT event_type, CASE s WHEN 0 THEN f ELSE f + CAST((l - f) // 2 AS INTEGER) + 1 END AS f, CASE s WHEN 0 THEN f + CAST((l - f) // 2 AS INTEGER) ELSE l END AS l FROM w, lim, (SELECT unnest([0, 1]) AS s) WHERE records > lim AND f < l) h)"""


def bisected(spark, sf):
    """The events by type and day as a listing that answers with so many rows at most: 20, or a sixtieth of a larger table."""
    e = src.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    ends = e.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).first()
    windows = e.select("event_type").distinct().select("event_type", F.lit(ends["first"]).alias("first"), F.lit(ends["last"]).alias("last"))
    return listing.bisected(windows, e, "event_type", "day", max(20, ends["n"] // 60))


@query("bisected_windows", f"WITH {BISECTED} SELECT event_type, strftime(f, '%Y-%m-%d') AS first, strftime(l, '%Y-%m-%d') AS last, CAST(records AS BIGINT) AS records, CASE WHEN records <= lim THEN 'complete' WHEN f < l THEN 'truncated' ELSE 'overfull' END AS status FROM w, lim")
def bisected_windows(spark, sf):
    return bisected(spark, sf).select("event_type", day_text("first").alias("first"), day_text("last").alias("last"), "records", "status")


@query("bisected_total", f"WITH {BISECTED} SELECT event_type, CAST(sum(records) FILTER (WHERE records <= lim) AS BIGINT) AS expected, count(*) FILTER (WHERE records > lim AND f = l) AS overfull FROM w, lim GROUP BY 1")
def bisected_total(spark, sf):
    return listing.expected_total(bisected(spark, sf), "event_type")


@query("blob_round_trip", "SELECT page_id, sha256(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS size, true AS intact FROM pages WHERE html IS NOT NULL")
def blob_round_trip(spark, sf):
    """The pages' bytes, put into the store and read back."""
    p, root = src.table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("data")), shared_folder(spark)
    manifest = blobs.put(p, root, "pages")
    back = blobs.get(spark, root, manifest).select("digest", F.octet_length("data").cast("long").alias("size"), "intact")
    return p.filter("data is not null").select("page_id", F.sha2("data", 256).alias("digest")).join(back, "digest").select("page_id", "digest", "size", "intact")


BOXES = "SELECT l_orderkey // 256 AS page, l_orderkey % 256 AS row, l_linenumber * 50 + l_partkey % 9 AS x0, l_linenumber * 50 + l_partkey % 9 + 6 + l_suppkey % 30 AS x1, CAST(l_partkey AS VARCHAR) AS text FROM lineitem"


@query("word_grids", f"""WITH raw AS ({BOXES}), b AS (SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY row) AS row, x0, x1, text FROM raw),
s AS (SELECT page, row, count(*) FILTER (WHERE nx - x1 >= 8) + 1 AS n FROM (SELECT *, lead(x0) OVER (PARTITION BY page, row ORDER BY x0, x1, text) AS nx FROM b) GROUP BY ALL),
i AS (SELECT page, row, row - row_number() OVER (PARTITION BY page ORDER BY row) AS island FROM s WHERE n >= 2), g AS (SELECT page, row, min(row) OVER w AS region, count(*) OVER w AS rows FROM i WINDOW w AS (PARTITION BY page, island)),
d AS (SELECT b.*, region, max(x1) OVER (PARTITION BY page, region ORDER BY x0, x1, b.row, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM b JOIN g USING (page, row) WHERE rows >= 3),
c AS (SELECT *, sum(CASE WHEN reached IS NULL OR x0 - reached >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY page, region ORDER BY x0, x1, row, text ROWS UNBOUNDED PRECEDING) - 1 AS col FROM d),
e AS (SELECT *, min(x0) OVER (PARTITION BY page, region, col) AS l, max(x1) OVER (PARTITION BY page, region, col) AS r, max(col) OVER (PARTITION BY page, region) AS cols FROM c)
SELECT page, CAST(region AS INTEGER) AS region, CAST(row AS INTEGER) AS row, CAST(col AS BIGINT) AS col, l AS "left", r AS "right", string_agg(text, ' ' ORDER BY x0, x1, text) AS text FROM e WHERE cols >= 2 GROUP BY ALL""")
def word_grids(spark, sf):
    """Each order line is a word on its order's row, 256 orders a page; orders of one line end a table."""
    k, x0 = F.col("l_orderkey"), F.col("l_linenumber") * 50 + F.col("l_partkey") % 9
    w = src.table(spark, sf, "lineitem").select(F.floor(k / 256).alias("page"), F.dense_rank().over(Window.partitionBy(F.floor(k / 256)).orderBy(k % 256)).alias("row"), x0.alias("x0"), (x0 + 6 + F.col("l_suppkey") % 30).alias("x1"), F.col("l_partkey").cast("string").alias("text"))
    return wb.word_grids(w, "page")


@query("seed_validation", "SELECT n_nationkey AS id, concat_ws(',', CASE WHEN length(n_name) < 5 THEN 'short_name' END, CASE WHEN n_regionkey > 3 THEN 'unknown_region' END) AS problems FROM nation")
def seed_validation(spark, sf):
    return seeds.validated(seeds.csv_round_trip(src.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey")), {"short_name": F.length("n_name") < 5, "unknown_region": F.col("n_regionkey").cast("int") > 3})


@query("manifest_check", "SELECT page_id, sha256(html) AS sha256, page_id % 10 <> 0 AS intact FROM pages")
def manifest_check(spark, sf):
    p = src.table(spark, sf, "pages").select("page_id", "html")
    m = p.select("page_id", F.sha2(F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("stated"))
    return seeds.verified(p, seeds.json_round_trip(m), "page_id", "html")
