"""Registered queries over point-in-time tables, financial derivations and writes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitemporal as bt
from ..operators import finance as fin
from ..operators import writes
from ..sources import projections as src
from ..sources.projections import ANNOUNCEMENT, BLOCK, DOCUMENT, FIN, FX, PRICE, day_text, stamp

T1, T2 = "1998-08-01 00:00:00", "1998-08-25 00:00:00"
NOW = "1998-09-01 00:00:00"
SEEN = "known_at <= TIMESTAMP '{t}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{t}')"
FACT_COLS = "entity, metric, period, CAST(value AS DOUBLE) AS value, unit, strftime(known_at, '%Y-%m-%d %H:%M:%S') AS known_at"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def fact_rows(df):
    return df.select("entity", "metric", "period", F.col("value").cast("double").alias("value"), "unit", stamp("known_at").alias("known_at"))


def known(spark, sf, t=NOW):
    return bt.asof(src.fin_fact(spark, sf), bt.at(t))


@query("asof_fact_at_t", f"WITH {FIN} SELECT {FACT_COLS} FROM fin_fact WHERE {SEEN.format(t=T1)}")
def asof_fact_at_t(spark, sf):
    return fact_rows(bt.asof(src.fin_fact(spark, sf), bt.at(T1)))


@query("asof_fact_after_correction", f"WITH {FIN} SELECT {FACT_COLS} FROM fin_fact WHERE {SEEN.format(t=T2)}")
def asof_fact_after_correction(spark, sf):
    return fact_rows(bt.asof(src.fin_fact(spark, sf), bt.at(T2)))


@query("asof_live_rows", f"WITH {FIN} SELECT {FACT_COLS} FROM fin_fact WHERE superseded_at IS NULL")
def asof_live_rows(spark, sf):
    return fact_rows(bt.live(src.fin_fact(spark, sf)))


def visibility(name, tenant, user, where):
    sql = f"WITH {DOCUMENT} SELECT doc_id, doc_type, strftime(publish_at, '%Y-%m-%d %H:%M:%S') AS publish_at FROM document WHERE {SEEN.format(t='2024-01-20 00:00:00')} AND ({where})"

    @query(name, sql)
    def run(spark, sf):
        d = bt.asof(src.document(spark, sf), bt.at("2024-01-20 00:00:00")).filter(bt.owner_visible(tenant, user))
        return d.select("doc_id", "doc_type", stamp("publish_at").alias("publish_at"))


PUBLIC = "owner_tenant IS NULL AND owner_user IS NULL"
visibility("asof_visibility_public", None, None, PUBLIC)
visibility("asof_visibility_tenant", "t1", None, f"({PUBLIC}) OR (owner_tenant = 't1' AND owner_user IS NULL)")
visibility("asof_visibility_user", None, "a", f"({PUBLIC}) OR owner_user = 'a'")


@query("asof_visibility_exact", f"WITH {DOCUMENT} SELECT doc_id FROM document WHERE {SEEN.format(t='2024-01-20 00:00:00')} AND owner_tenant IS NOT DISTINCT FROM 't1' AND owner_user IS NOT DISTINCT FROM NULL AND doc_type = 'en'")
def asof_visibility_exact(spark, sf):
    d = bt.asof(src.document(spark, sf), bt.at("2024-01-20 00:00:00"))
    return d.filter(bt.owner_exact("t1", None) & bt.optional("doc_type", "en") & bt.optional("source", None)).select("doc_id")


@query("asof_latest_derivation", f"WITH {DOCUMENT}, {BLOCK} SELECT doc_type, source, page, max(block_id) AS block_id FROM doc_block GROUP BY ALL")
def asof_latest_derivation(spark, sf):
    return bt.latest(src.doc_block(spark, sf), ["doc_type", "source", "page"], F.desc("block_id")).select("doc_type", "source", "page", "block_id")


POLICY = """policy AS (SELECT p_partkey AS policy_id, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS brand, p_type AS tier, TIMESTAMP '2024-01-01' + to_days(p_size) AS known_at FROM part)"""


def policies(spark, sf):
    p = src.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("policy_id"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("brand"), F.col("p_type").alias("tier"), F.timestamp_seconds(F.lit(1704067200) + F.col("p_size") * 86400).alias("known_at"))


@query("asof_policy_fallback", f"""WITH {POLICY}, asked AS (SELECT DISTINCT p_brand AS brand FROM part UNION ALL SELECT 'no such brand'),
own AS (SELECT brand, arg_max(policy_id, (known_at, policy_id)) AS policy_id FROM policy WHERE brand IS NOT NULL GROUP BY brand), wild AS (SELECT arg_max(policy_id, (known_at, policy_id)) AS w FROM policy WHERE brand IS NULL),
best AS (SELECT asked.brand, coalesce(own.policy_id, w) AS policy_id FROM asked LEFT JOIN own ON asked.brand = own.brand CROSS JOIN wild) SELECT best.brand, best.policy_id, tier FROM best LEFT JOIN policy ON best.policy_id = policy.policy_id""")
def asof_policy_fallback(spark, sf):
    asked = src.table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct().unionByName(spark.createDataFrame([("no such brand",)], "brand string"))
    return bt.fallback(asked, policies(spark, sf), "brand").select("brand", "policy_id", "tier")


@query("asof_active_flag", f"WITH {FIN} SELECT entity, metric, period, version, {SEEN.format(t=T1)} AS active FROM fin_fact")
def asof_active_flag(spark, sf):
    return src.fin_fact(spark, sf).select("entity", "metric", "period", "version", bt.visible(bt.at(T1)).alias("active"))


@query("asof_first_disclosure", f"""WITH {ANNOUNCEMENT}, p AS (SELECT DISTINCT k AS slot, DATE '2023-12-31' + CAST(k * 30 AS INTEGER) AS period_end FROM (SELECT page_id % 10 AS k FROM announcement)),
d AS (SELECT page_id % 10 AS slot, * FROM announcement WHERE regexp_matches(title, '[a-z]{{4}}') AND NOT regexp_matches(title, '^[AEÉ]'))
SELECT p.slot, strftime(p.period_end, '%Y-%m-%d') AS period_end, arg_min(page_id, (known_at, page_id)) AS page_id, strftime(min(known_at), '%Y-%m-%d %H:%M:%S') AS known_at
FROM p LEFT JOIN d ON p.slot = d.slot AND publish_date > period_end AND publish_date <= period_end + INTERVAL 15 MONTH GROUP BY p.slot, p.period_end""")
def asof_first_disclosure(spark, sf):
    a = src.announcement(spark, sf).withColumn("slot", F.col("page_id") % 10)
    p = a.select("slot").distinct().withColumn("period_end", F.date_add(F.lit("2023-12-31").cast("date"), (F.col("slot") * 30).cast("int")))
    d = bt.first_disclosure(p, a, "[a-z]{4}", "^[AEÉ]")
    return d.select("slot", day_text("period_end").alias("period_end"), "page_id", stamp("known_at").alias("known_at"))


@query("asof_trading_calendar", f"WITH {PRICE} SELECT entity, strftime(max(trade_date), '%Y-%m-%d') AS trade_date FROM price_daily WHERE known_at <= TIMESTAMP '{T1}' AND NOT is_suspended GROUP BY entity")
def asof_trading_calendar(spark, sf):
    return bt.trading_day(src.price_daily(spark, sf), bt.at(T1)).select("entity", day_text("trade_date").alias("trade_date"))


@query("asof_leak_checks", f"""WITH {FIN} SELECT 'known_before_period_end' AS "check", count(*) AS n FROM fin_fact WHERE CAST(known_at AS DATE) < period_end
UNION ALL SELECT 'superseded_before_known', count(*) FROM fin_fact WHERE superseded_at <= known_at
UNION ALL SELECT 'several_at_probe', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM fin_fact WHERE {SEEN.format(t=T2)} GROUP BY entity, metric, period HAVING count(*) > 1)""")
def asof_leak_checks(spark, sf):
    return bt.leak_checks(src.fin_fact(spark, sf), bt.at(T2))


@query("asof_replay_hash", f"""WITH {DOCUMENT}, {BLOCK}, b AS (SELECT * FROM doc_block), p AS (SELECT block_id, known_at - INTERVAL 1 SECOND AS probe FROM b UNION ALL SELECT block_id, known_at FROM b UNION ALL SELECT block_id, superseded_at FROM b WHERE superseded_at IS NOT NULL)
SELECT b.block_id, strftime(probe, '%Y-%m-%d %H:%M:%S') AS probe, CASE WHEN known_at <= probe AND (superseded_at IS NULL OR superseded_at > probe) THEN sha256(concat_ws('|', CAST(b.block_id AS VARCHAR), content, strftime(known_at, '%Y-%m-%d %H:%M:%S'))) ELSE 'ABSENT' END AS hash FROM b JOIN p ON b.block_id = p.block_id""")
def asof_replay_hash(spark, sf):
    b = src.doc_block(spark, sf)
    probes = b.select("block_id", F.explode(F.array(F.col("known_at") - F.expr("INTERVAL 1 SECOND"), "known_at", "superseded_at")).alias("probe")).filter("probe is not null")
    return bt.replay_hash(b, probes).withColumn("probe", stamp("probe"))


@query("asof_freeze_diff", f"""WITH {DOCUMENT}, a AS (SELECT doc_id FROM document WHERE {SEEN.format(t='2024-01-15 00:00:00')}), b AS (SELECT doc_id FROM document WHERE {SEEN.format(t='2024-02-05 00:00:00')})
SELECT doc_id, 'added' AS change FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT doc_id, 'removed' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)""")
def asof_freeze_diff(spark, sf):
    return bt.freeze_diff(src.document(spark, sf), "doc_id", bt.at("2024-01-15 00:00:00"), bt.at("2024-02-05 00:00:00"))


@query("known_at_rules", """SELECT kind, strftime(d, '%Y-%m-%d') AS day, strftime(CASE kind WHEN 'announcement' THEN CAST(d AS TIMESTAMP) + INTERVAL '15:59:59.999999' WHEN 'fundamentals' THEN CAST(d AS TIMESTAMP) + INTERVAL '15:59:59' WHEN 'price' THEN CAST(d AS TIMESTAMP) + INTERVAL '07:30:00' WHEN 'fixing' THEN CAST(d AS TIMESTAMP) + INTERVAL '01:15:00' ELSE CAST(d AS TIMESTAMP) - INTERVAL 8 HOUR END, '%Y-%m-%d %H:%M:%S.%f') AS known_at
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), (VALUES ('announcement'), ('fundamentals'), ('price'), ('fixing'), ('manual')) AS k(kind)""")
def known_at_rules(spark, sf):
    days = src.table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    kinds = ["announcement", "fundamentals", "price", "fixing", "manual"]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), bt.known_at(k, F.col("d")).alias("known_at")) for k in kinds]))
    return days.select(day_text("d").alias("day"), rows.alias("x")).select("x.kind", "day", F.date_format("x.known_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("known_at"))


KNOWN = f"WITH {FIN}, f AS (SELECT entity, metric, period, y, q, value, unit FROM fin_fact WHERE {SEEN.format(t=NOW)})"
NOTE = "CASE WHEN {b} IS NULL OR {v} IS NULL THEN 'missing_base' WHEN {u} IS DISTINCT FROM {bu} THEN 'unit_mismatch' WHEN {b} = 0 THEN 'zero_base' WHEN {b} < 0 THEN 'negative_base' END"


def growth_sql(name, a, b):
    note = NOTE.format(v=f"{a}.value", u=f"{a}.unit", b=f"{b}.value", bu=f"{b}.unit")
    return f"{a}.entity, {a}.metric, {a}.period, CASE WHEN ({note}) IS NULL THEN round(CAST({a}.value AS DOUBLE) / CAST({b}.value AS DOUBLE) - 1, 6) END AS {name}, {note} AS note"


@query("fin_yoy", f"{KNOWN} SELECT {growth_sql('yoy', 'f', 'g')} FROM f LEFT JOIN f g ON g.entity = f.entity AND g.metric = f.metric AND g.y = f.y - 1 AND g.q = f.q")
def fin_yoy(spark, sf):
    return fin.yoy(known(spark, sf))


PREVIOUS = "p.entity = f.entity AND p.metric = f.metric AND p.y * 4 + p.q = f.y * 4 + f.q - 1"
SINGLE = f"s AS (SELECT f.entity, f.metric, f.period, f.y, f.q, CASE WHEN f.q = 1 THEN f.value WHEN f.unit IS NOT DISTINCT FROM p.unit THEN f.value - p.value END AS value, f.unit FROM f LEFT JOIN f p ON {PREVIOUS})"


@query("fin_single_quarter", f"{KNOWN}, {SINGLE} SELECT entity, metric, period, CAST(value AS DOUBLE) AS value, unit FROM s")
def fin_single_quarter(spark, sf):
    return fin.single_quarter(known(spark, sf)).withColumn("value", F.col("value").cast("double"))


@query("fin_qoq", f"{KNOWN}, {SINGLE}, x AS (SELECT * FROM s WHERE metric <> 'MACHINERY' UNION ALL SELECT entity, metric, period, y, q, value, unit FROM f WHERE metric = 'MACHINERY') SELECT {growth_sql('qoq', 'x', 'z')} FROM x LEFT JOIN x z ON z.entity = x.entity AND z.metric = x.metric AND z.y * 4 + z.q = x.y * 4 + x.q - 1")
def fin_qoq(spark, sf):
    return fin.qoq(known(spark, sf))


@query("fin_ttm", f"""{KNOWN}, j AS (SELECT f.*, g.value AS sv, g.unit AS su, h.value AS hv, h.unit AS hu FROM f LEFT JOIN f g ON g.entity = f.entity AND g.metric = f.metric AND g.y = f.y - 1 AND g.q = f.q LEFT JOIN f h ON h.entity = f.entity AND h.metric = f.metric AND h.y = f.y - 1 AND h.q = 4),
n AS (SELECT *, CASE WHEN metric = 'MACHINERY' THEN 'stock_metric' WHEN q <> 4 AND (hv IS NULL OR sv IS NULL) THEN 'missing_base' WHEN q <> 4 AND (unit IS DISTINCT FROM hu OR unit IS DISTINCT FROM su) THEN 'unit_mismatch' END AS note FROM j)
SELECT entity, metric, period, CASE WHEN note IS NULL THEN CAST(CASE WHEN q = 4 THEN value ELSE value + hv - sv END AS DOUBLE) END AS ttm, note FROM n""")
def fin_ttm(spark, sf):
    return fin.ttm(known(spark, sf))


@query("fx_asof_join", f"""WITH {FX}, a AS (SELECT DISTINCT event_type AS base, CAST(ts AS DATE) AS on_day FROM events), j AS (SELECT a.base, a.on_day, r.rate_date, r.rate FROM a ASOF LEFT JOIN fx_rate r ON a.base = r.base AND a.on_day >= r.rate_date),
n AS (SELECT *, CASE WHEN rate_date IS NULL THEN 'no_rate' WHEN on_day - rate_date > 7 THEN 'stale_rate' END AS note FROM j) SELECT base, strftime(on_day, '%Y-%m-%d') AS on_day, strftime(rate_date, '%Y-%m-%d') AS rate_date, CASE WHEN note IS NULL THEN CAST(rate AS DOUBLE) END AS rate, note FROM n""")
def fx_asof_join(spark, sf):
    asked = src.table(spark, sf, "events").select(F.col("event_type").alias("base"), F.to_date("ts").alias("on_day")).distinct()
    d = fin.rate_asof(asked, src.fx_rate(spark, sf))
    return d.select("base", day_text("on_day").alias("on_day"), day_text("rate_date").alias("rate_date"), F.col("rate").cast("double").alias("rate"), "note")


@query("fx_cross_convert", f"""WITH {FX}, a AS (SELECT DISTINCT x.event_type AS base, y.event_type AS quote, CAST(x.ts AS DATE) AS on_day FROM events x JOIN (SELECT DISTINCT event_type FROM events) y ON true),
b AS (SELECT a.*, r.rate_date AS d1, r.rate AS r1 FROM a ASOF LEFT JOIN fx_rate r ON a.base = r.base AND a.on_day >= r.rate_date), c AS (SELECT b.*, r.rate_date AS d2, r.rate AS r2 FROM b ASOF LEFT JOIN fx_rate r ON b.quote = r.base AND b.on_day >= r.rate_date),
n AS (SELECT *, CASE WHEN base <> quote THEN coalesce(CASE WHEN d1 IS NULL THEN 'no_rate' WHEN on_day - d1 > 7 THEN 'stale_rate' END, CASE WHEN d2 IS NULL THEN 'no_rate' WHEN on_day - d2 > 7 THEN 'stale_rate' END) END AS note FROM c)
SELECT base, quote, strftime(on_day, '%Y-%m-%d') AS on_day, round(CASE WHEN base = quote THEN 1.0 WHEN note IS NULL THEN CAST(r1 AS DOUBLE) / CAST(r2 AS DOUBLE) END, 9) AS rate, note FROM n""")
def fx_cross_convert(spark, sf):
    e = src.table(spark, sf, "events").select(F.col("event_type").alias("base"), F.to_date("ts").alias("on_day")).distinct()
    types = e.agg(F.collect_set("base").alias("quotes"))  # currencies: a fixed few
    asked = e.crossJoin(F.broadcast(types)).select("base", F.explode("quotes").alias("quote"), "on_day")
    return fin.cross_rate(asked, src.fx_rate(spark, sf)).select("base", "quote", day_text("on_day").alias("on_day"), F.round("rate", 9).alias("rate"), "note")


@query("fx_quote_normalise", f"""WITH {FX}, p AS (SELECT CASE WHEN base = 'click' THEN '100JPY/CNY' WHEN base = 'view' THEN 'CNY/KRW' ELSE 'USD/CNY' END AS pair, rate_date, CAST(rate AS DOUBLE) AS rate FROM fx_rate)
SELECT CASE WHEN pair LIKE '100%' THEN pair[4:] WHEN pair LIKE 'CNY/%' THEN pair[5:] || '/CNY' ELSE pair END AS pair, strftime(rate_date, '%Y-%m-%d') AS rate_date, round(round_even(CASE WHEN pair LIKE '100%' THEN rate / 100 WHEN pair LIKE 'CNY/%' THEN 1 / rate ELSE rate END, 12), 9) AS rate FROM p""")
def fx_quote_normalise(spark, sf):
    pair = F.when(F.col("base") == "click", "100JPY/CNY").when(F.col("base") == "view", "CNY/KRW").otherwise("USD/CNY")
    d = src.fx_rate(spark, sf).select(pair.alias("p"), "rate_date", F.col("rate").cast("double").alias("r"))
    name, value = fin.normalise_quote(F.col("p"), F.col("r"))
    return d.select(name.alias("pair"), day_text("rate_date").alias("rate_date"), F.round(value, 9).alias("rate"))


@query("cum_single_assignment", f"""WITH {FIN}, x AS (SELECT a.entity, a.metric, a.y, a.q, a.value AS cum, a.value - coalesce(p.value, 0) AS one, a.nk FROM fin_fact a LEFT JOIN fin_fact p ON p.entity = a.entity AND p.metric = a.metric AND p.y = a.y AND p.q = a.q - 1 AND p.version = 1 WHERE a.version = 1),
c AS (SELECT entity, metric, y, q, CASE WHEN nk % 2 = 0 THEN cum ELSE one END AS l, CASE WHEN nk % 2 = 0 THEN one ELSE cum END AS r FROM x),
h AS (SELECT *, lag(q) OVER w = q - 1 AS adj, CASE WHEN q = 1 THEN l = r WHEN lag(q) OVER w = q - 1 THEN l - lag(l) OVER w = r END AS h1, CASE WHEN q = 1 THEN l = r WHEN lag(q) OVER w = q - 1 THEN r - lag(r) OVER w = l END AS h2 FROM c WINDOW w AS (PARTITION BY entity, metric, y ORDER BY q)),
g AS (SELECT entity, metric, coalesce(bool_and(h1), false) AS a, coalesce(bool_and(h2), false) AS b, coalesce(bool_or(q > 1 AND adj), false) AS t FROM h GROUP BY ALL) SELECT entity, metric, CASE WHEN t AND a AND NOT b THEN 'left' WHEN t AND b AND NOT a THEN 'right' END AS cumulative FROM g""")
def cum_single_assignment(spark, sf):
    f = src.fin_fact(spark, sf).filter("version = 1")
    p = f.select("entity", "metric", "y", (F.col("q") + 1).alias("q"), F.col("value").alias("before"))
    x = f.join(p, ["entity", "metric", "y", "q"], "left").withColumn("one", F.col("value") - F.coalesce("before", F.lit(0).cast("decimal(18,4)")))
    even = F.col("nk") % 2 == 0
    return fin.cumulative_or_single(x.select("entity", "metric", "y", "q", F.when(even, F.col("value")).otherwise(F.col("one")).alias("left"), F.when(even, F.col("one")).otherwise(F.col("value")).alias("right")))


HOLD = "hold AS (SELECT l_partkey % 50 AS entity, l_suppkey AS holder, CAST(sum(l_quantity) AS BIGINT) AS shares FROM lineitem GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN entity % 5 = 0 THEN holder ELSE -shares END, holder) AS rank, round(100.0 * shares / sum(shares) OVER (PARTITION BY entity), 4) AS pct FROM hold)"


def holdings(spark, sf):
    h = src.table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("entity"), F.col("l_suppkey").alias("holder")).agg(F.sum("l_quantity").cast("long").alias("shares"))
    order = F.when(F.col("entity") % 5 == 0, F.col("holder")).otherwise(-F.col("shares"))
    return h.withColumns({"rank": F.row_number().over(Window.partitionBy("entity").orderBy(order, "holder")), "pct": F.round(100.0 * F.col("shares") / F.sum("shares").over(Window.partitionBy("entity")), 4)})


@query("holders_consistency", f"WITH {HOLD}, t AS (SELECT *, lag(shares) OVER (PARTITION BY entity ORDER BY rank, holder) AS before, row_number() OVER (PARTITION BY entity ORDER BY rank, holder) AS rn FROM top WHERE rank <= 10) SELECT entity, count(*) AS n, bool_and(rank = rn) AS ranks_ok, bool_and(before IS NULL OR shares <= before) AS monotone, round(sum(pct), 6) <= 100.1 AS sum_ok FROM t GROUP BY entity")
def holders_consistency(spark, sf):
    return fin.holders_consistency(holdings(spark, sf).filter("rank <= 10"))


@query("segment_reconcile", """WITH p AS (SELECT n_name AS entity, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS parts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
t AS (SELECT entity, y, CASE WHEN y % 2 = 0 THEN parts * 1.02 ELSE parts END AS total FROM p WHERE y <> 1997) SELECT p.entity, p.y, CASE WHEN total IS NULL OR total = 0 THEN 'no_total' WHEN abs(parts - total) / abs(total) <= 0.005 THEN 'ok' ELSE 'differs' END AS verdict FROM p LEFT JOIN t ON p.entity = t.entity AND p.y = t.y""")
def segment_reconcile(spark, sf):
    o = src.table(spark, sf, "orders").join(src.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    g = o.groupBy("c_nationkey", "c_mktsegment", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    g = g.join(src.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity")), "c_nationkey")
    totals = g.groupBy("entity", "y").agg(F.sum("amount").cast("double").alias("t")).filter("y <> 1997").select("entity", "y", F.when(F.col("y") % 2 == 0, F.col("t") * 1.02).otherwise(F.col("t")).alias("total"))
    return fin.segment_reconcile(g, totals)


@query("event_dedup_24h", """WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END + event_id % 3 AS rank, time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM events)
SELECT user_id, event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, arg_min(event_id, (-rank, event_id)) AS master_id, count(*) - 1 AS n_evidence FROM e GROUP BY ALL""")
def event_dedup_24h(spark, sf):
    e = src.table(spark, sf, "events").withColumn("rank", F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1) + F.col("event_id") % 3)
    return fin.event_dedup(e.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", stamp("start"))


@query("last_quarter_ends", """SELECT d AS day, string_agg(strftime(last_day(CAST(date_trunc('quarter', CAST(d AS DATE)) AS DATE) - to_months(3 * k) + INTERVAL 2 MONTH), '%Y-%m-%d'), ',' ORDER BY k DESC) AS ends FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), generate_series(1, 4) AS g(k) GROUP BY d""")
def last_quarter_ends(spark, sf):
    d = src.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(day_text("d").alias("day"), F.array_join(F.transform(fin.quarter_ends(F.col("d"), 4), lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("ends"))


# Writes ------------------------------------------------------------------------------------------------------------

INCOMING = "incoming AS (SELECT entity, metric, period, value + CASE WHEN (y + q) % 3 = 0 THEN 10 ELSE 0 END AS value, unit, known_at + CASE WHEN q = 2 THEN INTERVAL '-40' DAY ELSE INTERVAL 40 DAY END AS known_at FROM fin_fact WHERE superseded_at IS NULL AND y <= 1997 UNION ALL SELECT entity, metric, (y + 20) || 'Q1', value, unit, known_at FROM fin_fact WHERE version = 1 AND q = 1)"


def incoming(spark, sf):
    f = src.fin_fact(spark, sf)
    a = f.filter("superseded_at is null and y <= 1997").select("entity", "metric", "period", (F.col("value") + F.when((F.col("y") + F.col("q")) % 3 == 0, 10).otherwise(0)).cast("decimal(18,4)").alias("value"), "unit", (F.col("known_at") + F.when(F.col("q") == 2, F.expr("INTERVAL -40 DAYS")).otherwise(F.expr("INTERVAL 40 DAYS"))).alias("known_at"))
    b = f.filter("version = 1 and q = 1").select("entity", "metric", F.concat((F.col("y") + 20).cast("string"), F.lit("Q1")).alias("period"), "value", "unit", "known_at")
    return a.unionByName(b)


@query("delta_write_fact", f"""WITH {FIN}, {INCOMING}, l AS (SELECT * FROM fin_fact WHERE superseded_at IS NULL)
SELECT i.entity, i.metric, i.period, CASE WHEN l.value IS NULL THEN 'inserted' WHEN abs(CAST(l.value AS DOUBLE) - CAST(i.value AS DOUBLE)) < 1e-9 THEN 'skipped' WHEN i.known_at > l.known_at THEN 'corrected' ELSE 'out_of_order' END AS outcome FROM incoming i LEFT JOIN l ON i.entity = l.entity AND i.metric = l.metric AND i.period = l.period""")
def delta_write_fact(spark, sf):
    return writes.fact_outcomes(src.fin_fact(spark, sf), incoming(spark, sf)).select("entity", "metric", "period", "outcome")


@query("delta_fact_state", f"""WITH {FIN}, {INCOMING}, l AS (SELECT * FROM fin_fact WHERE superseded_at IS NULL),
o AS (SELECT i.*, CASE WHEN l.value IS NULL THEN 'inserted' WHEN abs(CAST(l.value AS DOUBLE) - CAST(i.value AS DOUBLE)) < 1e-9 THEN 'skipped' WHEN i.known_at > l.known_at THEN 'corrected' ELSE 'out_of_order' END AS outcome FROM incoming i LEFT JOIN l ON i.entity = l.entity AND i.metric = l.metric AND i.period = l.period),
closed AS (SELECT f.entity, f.metric, f.period, f.value, f.known_at, CASE WHEN f.superseded_at IS NULL THEN o.known_at ELSE f.superseded_at END AS superseded_at FROM fin_fact f LEFT JOIN o ON f.entity = o.entity AND f.metric = o.metric AND f.period = o.period AND o.outcome = 'corrected')
SELECT entity, metric, period, CAST(value AS DOUBLE) AS value, strftime(known_at, '%Y-%m-%d %H:%M:%S') AS known_at, strftime(superseded_at, '%Y-%m-%d %H:%M:%S') AS superseded_at FROM (SELECT * FROM closed UNION ALL SELECT entity, metric, period, value, known_at, NULL FROM o WHERE outcome IN ('inserted', 'corrected'))""")
def delta_fact_state(spark, sf):
    d = writes.fact_state(src.fin_fact(spark, sf), incoming(spark, sf))
    return d.select("entity", "metric", "period", F.col("value").cast("double").alias("value"), stamp("known_at").alias("known_at"), stamp("superseded_at").alias("superseded_at"))


@query("delta_write_price", f"""WITH {PRICE}, i AS (SELECT entity, trade_date, close + CASE WHEN day(trade_date) % 5 = 0 THEN 1 ELSE 0 END AS close, known_at + CASE WHEN day(trade_date) % 7 = 0 THEN INTERVAL '-1' HOUR ELSE INTERVAL 1 HOUR END AS known_at FROM price_daily)
SELECT i.entity, strftime(i.trade_date, '%Y-%m-%d') AS trade_date, CASE WHEN p.known_at IS NULL THEN 'inserted' WHEN i.known_at < p.known_at THEN 'older_known_at' WHEN i.close = p.close THEN 'skipped' ELSE 'corrected' END AS outcome FROM i LEFT JOIN price_daily p ON i.entity = p.entity AND i.trade_date = p.trade_date""")
def delta_write_price(spark, sf):
    p = src.price_daily(spark, sf)
    day = F.dayofmonth("trade_date")
    i = p.select("entity", "trade_date", (F.col("close") + F.when(day % 5 == 0, 1).otherwise(0)).alias("close"), (F.col("known_at") + F.when(day % 7 == 0, F.expr("INTERVAL -1 HOURS")).otherwise(F.expr("INTERVAL 1 HOURS"))).alias("known_at"))
    return writes.price_outcomes(p, i).select("entity", day_text("trade_date").alias("trade_date"), "outcome")


@query("delta_batch_replace", """WITH s AS (SELECT l_suppkey % 20 AS entity, year(l_shipdate) AS period, l_returnflag AS item, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT entity, period, item, CASE WHEN entity % 3 = 0 AND item = 'A' THEN n + 1 ELSE n END AS n FROM s WHERE NOT (entity % 5 = 0 AND item = 'R')),
d AS (SELECT entity, period FROM ((SELECT * FROM s EXCEPT SELECT * FROM w) UNION ALL (SELECT * FROM w EXCEPT SELECT * FROM s)) GROUP BY ALL) SELECT k.entity, k.period, CASE WHEN d.entity IS NULL THEN 'unchanged' ELSE 'replaced' END AS outcome FROM (SELECT DISTINCT entity, period FROM s UNION SELECT DISTINCT entity, period FROM w) k LEFT JOIN d ON k.entity = d.entity AND k.period = d.period""")
def delta_batch_replace(spark, sf):
    s = src.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("entity"), F.year("l_shipdate").alias("period"), F.col("l_returnflag").alias("item")).agg(F.count("*").alias("n"))
    w = s.filter("not (entity % 5 = 0 and item = 'R')").withColumn("n", F.when((F.col("entity") % 3 == 0) & (F.col("item") == "A"), F.col("n") + 1).otherwise(F.col("n")))
    return writes.batch_outcomes(s, w, ["entity", "period"])


@query("delta_publish_version", """WITH l AS (SELECT p_partkey AS id, p_brand AS unit, p_size AS scale FROM part), i AS (SELECT p_partkey + CASE WHEN p_size = 1 THEN 1000000 ELSE 0 END AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS unit, p_size + CAST(p_size % 10 = 3 AS INTEGER) AS scale FROM part)
SELECT i.id, CASE WHEN l.id IS NULL THEN 'created' WHEN i.unit IS NOT DISTINCT FROM l.unit AND i.scale IS NOT DISTINCT FROM l.scale THEN 'unchanged' ELSE 'new_version' END AS outcome FROM i LEFT JOIN l ON i.id = l.id""")
def delta_publish_version(spark, sf):
    p = src.table(spark, sf, "part")
    l = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("unit"), F.col("p_size").alias("scale"))
    i = p.select((F.col("p_partkey") + F.when(F.col("p_size") == 1, 1000000).otherwise(0)).alias("id"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("unit"), (F.col("p_size") + (F.col("p_size") % 10 == 3).cast("int")).alias("scale"))
    return writes.publish_outcomes(l, i, "id", ["unit", "scale"])


@query("delta_sync_sets", """WITH l AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_linenumber <= 2), w AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_linenumber >= 2)
SELECT a, b, 'close' AS action FROM (SELECT * FROM l EXCEPT SELECT * FROM w) UNION ALL SELECT a, b, 'open' FROM (SELECT * FROM w EXCEPT SELECT * FROM l)""")
def delta_sync_sets(spark, sf):
    l = src.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), "l_linenumber")
    return writes.sync(l.filter("l_linenumber <= 2").select("a", "b").distinct(), l.filter("l_linenumber >= 2").select("a", "b").distinct(), ["a", "b"])


@query("import_diff", """WITH a AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) || '!' ELSE s_name END AS name, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier)
SELECT a.id, f AS field, CASE f WHEN 'name' THEN a.name ELSE a.nation END AS old_value, CASE f WHEN 'name' THEN b.name ELSE b.nation END AS new_value FROM a JOIN b ON a.id = b.id, (VALUES ('name'), ('nation')) AS x(f) WHERE CASE f WHEN 'name' THEN a.name ELSE a.nation END IS DISTINCT FROM CASE f WHEN 'name' THEN b.name ELSE b.nation END""")
def import_diff(spark, sf):
    a = src.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    b = a.select("id", F.when(F.col("id") % 4 == 0, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 6 != 0, F.col("nation")).alias("nation"))
    return writes.field_diff(a, b, "id", ["name", "nation"])


@query("manual_validation", """SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_retailprice > 1500 THEN 'value_too_large' END, CASE WHEN p_size > 40 THEN 'size_out_of_range' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-3]') THEN 'unknown_brand' END, CASE WHEN length(p_name) < 10 THEN 'name_too_short' END) AS problems FROM part""")
def manual_validation(spark, sf):
    rules = {"value_too_large": F.col("p_retailprice") > 1500, "size_out_of_range": F.col("p_size") > 40, "unknown_brand": ~F.col("p_brand").rlike("^Brand#[1-3]"), "name_too_short": F.length("p_name") < 10}
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(",", writes.problems(rules)).alias("problems"))


@query("upsert_latest", """SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) IS NOT NULL AS present, count(*) AS attempts, strftime(min(ts) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS deadline FROM events GROUP BY ALL""")
def upsert_latest(spark, sf):
    e = src.table(spark, sf, "events")
    return writes.retry_queue(e, ["user_id", "event_type"], "ts", "event_id", "value")


@query("write_cascade", f"""WITH {FIN} SELECT entity, metric, period, version, strftime(CASE WHEN superseded_at > known_at THEN superseded_at ELSE TIMESTAMP '{NOW}' END, '%Y-%m-%d %H:%M:%S') AS closed_at FROM fin_fact""")
def write_cascade(spark, sf):
    f = src.fin_fact(spark, sf)
    return f.select("entity", "metric", "period", "version", stamp(writes.cascade(F.col("superseded_at"), F.col("known_at"), bt.at(NOW))).alias("closed_at"))
