"""Domain tables projected from the driver's synthetic tables, and the same projections as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded_mean(column: str, places: int):
    """A mean that engines round alike: summed as decimals, and halves up by floor, as round() differs on doubles."""
    return F.floor(F.sum(F.col(column).cast("decimal(18,4)")).cast("double") / F.count("*") * 10**places + 0.5) / 10**places


def fin_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative quarterly amounts of nation and segment, corrected by 1 % after 20 days for every seventh nation."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # summed by nation key before the name is joined: the join then sees a row per group, not per order
    g = o.join(c, "o_custkey").groupBy("c_nationkey", "c_mktsegment", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.sum("amount").alias("v")).join(n, "c_nationkey")
    ytd = F.sum("v").over(Window.partitionBy("n_name", "c_mktsegment", "y").orderBy("q"))
    f = g.select(
        F.col("n_name").alias("entity"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("metric"), "y", "q",
        F.when(F.col("q") == 4, F.concat(F.col("y").cast("string"), F.lit("FY"))).otherwise(F.concat(F.col("y").cast("string"), F.lit("Q"), F.col("q").cast("string"))).alias("period"),
        F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1))).alias("period_end"),
        ytd.cast("decimal(18,4)").alias("value"),
        F.when((F.col("c_nationkey") == 3) & (F.col("y") < 1998), "USD").otherwise("CNY").alias("unit"),
    )
    known = (F.col("period_end").cast("timestamp") + F.expr("INTERVAL 25 DAYS 23 HOURS 59 MINUTES 59 SECONDS")).alias("known_at")
    f = f.select("*", known)
    later, again = F.col("known_at") + F.expr("INTERVAL 20 DAYS"), F.col("nk") % 7 == 0
    first = f.withColumns({"superseded_at": F.when(again, later), "version": F.lit(1)})
    second = f.filter(again).withColumns({"value": (F.col("value") * F.lit("1.01").cast("decimal(3,2)")).cast("decimal(18,4)"), "known_at": later, "superseded_at": F.lit(None).cast("timestamp"), "version": F.lit(2)})
    return first.unionByName(second)


FIN = """fin_src AS (SELECT n_name AS entity, n_nationkey AS nk, c_mktsegment AS metric, year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
fin_one AS (SELECT entity, nk, metric, y, q, CASE WHEN q = 4 THEN y || 'FY' ELSE y || 'Q' || q END AS period, last_day(make_date(y, q * 3, 1)) AS period_end,
 CAST(sum(v) OVER (PARTITION BY entity, metric, y ORDER BY q) AS DECIMAL(18,4)) AS value, CASE WHEN nk = 3 AND y < 1998 THEN 'USD' ELSE 'CNY' END AS unit FROM fin_src),
fin_known AS (SELECT *, CAST(period_end AS TIMESTAMP) + INTERVAL 25 DAY + INTERVAL '23:59:59' AS known_at FROM fin_one),
fin_fact AS (SELECT *, CASE WHEN nk % 7 = 0 THEN known_at + INTERVAL 20 DAY END AS superseded_at, 1 AS version FROM fin_known
 UNION ALL SELECT entity, nk, metric, y, q, period, period_end, CAST(value * 1.01 AS DECIMAL(18,4)), unit, known_at + INTERVAL 20 DAY, NULL, 2 FROM fin_known WHERE nk % 7 = 0)"""


def price_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.to_date("l_shipdate").alias("trade_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    g = l.join(p, "p_partkey").groupBy("entity", "trade_date").agg(F.max("price").alias("close"))
    return g.select("*", (F.col("trade_date").cast("timestamp") + F.expr("INTERVAL 15 HOURS 30 MINUTES")).alias("known_at"), (F.dayofmonth("trade_date") == 13).alias("is_suspended"))


PRICE = """price_daily AS (SELECT p_brand AS entity, CAST(l_shipdate AS DATE) AS trade_date, max(l_extendedprice / l_quantity) AS close,
 CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL '15:30:00' AS known_at, day(CAST(l_shipdate AS DATE)) = 13 AS is_suspended FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def fx_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("base"), day.alias("rate_date")).agg((rounded_mean("value", 4) + 1).cast("decimal(18,4)").alias("rate"))
    d = F.dayofmonth("rate_date")
    return g.filter((d % 4 != 0) & ~((F.col("base") == "error") & d.between(8, 18)))


FX = """fx_rate AS (SELECT base, rate_date, rate FROM (SELECT event_type AS base, CAST(ts AS DATE) AS rate_date, CAST(floor(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 10000 + 0.5) / 10000 + 1 AS DECIMAL(18,4)) AS rate FROM events GROUP BY ALL)
 WHERE day(rate_date) % 4 <> 0 AND NOT (base = 'error' AND day(rate_date) BETWEEN 8 AND 18))"""


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    published = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return d.select(
        "doc_id", F.col("lang").alias("doc_type"), "source", "text", published.alias("publish_at"), (published + F.expr("INTERVAL 1 HOUR")).alias("known_at"),
        F.when(F.col("doc_id") % 10 == 0, published + F.expr("INTERVAL 30 DAYS")).alias("superseded_at"),
        F.when(n.isin(16, 17), "t1").alias("owner_tenant"), F.when(n == 18, "a").when(n == 19, "b").alias("owner_user"),
    )


DOCUMENT = """document AS (SELECT doc_id, lang AS doc_type, source, text, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS publish_at, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER) + 1) AS known_at,
 CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) + INTERVAL 30 DAY END AS superseded_at, CASE WHEN source IN ('src16', 'src17') THEN 't1' END AS owner_tenant,
 CASE source WHEN 'src18' THEN 'a' WHEN 'src19' THEN 'b' END AS owner_user FROM documents)"""


def doc_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document(spark, sf_dir).withColumnRenamed("text", "body")
    b = d.select("*", F.posexplode(F.split("body", "\n")).alias("ordinal", "content")).drop("body")
    return b.withColumns({"page": F.floor(F.col("ordinal") / 40).cast("int") + 1, "block_id": F.col("doc_id") * 100000 + F.col("ordinal")})


BLOCK = """doc_block AS (SELECT * EXCLUDE (text, lines), CAST(ordinal // 40 + 1 AS INTEGER) AS page, doc_id * 100000 + ordinal AS block_id
 FROM (SELECT *, string_split(text, chr(10)) AS lines, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM document))"""


def announcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("page_id").cast("int"))
    return p.select("page_id", F.col("url").alias("source_ref"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), day.alias("publish_date"), (day.cast("timestamp") + F.expr("INTERVAL 23 HOURS 59 MINUTES 59 SECONDS")).alias("known_at"), (F.col("page_id") % 3 != 0).alias("has_full_text"))


ANNOUNCEMENT = """announcement AS (SELECT page_id, url AS source_ref, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, DATE '2024-01-01' + CAST(page_id AS INTEGER) AS publish_date,
 CAST(DATE '2024-01-01' + CAST(page_id AS INTEGER) AS TIMESTAMP) + INTERVAL '23:59:59' AS known_at, page_id % 3 <> 0 AS has_full_text FROM pages)"""


def quality_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("source"), F.to_date("ts").alias("partition_day")).agg(rounded_mean("value", 6).alias("value"), F.max("ts").alias("computed_at"))


QUALITY = """quality_metric AS (SELECT event_type AS metric, user_id % 5 AS source, CAST(ts AS DATE) AS partition_day, floor(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 1000000 + 0.5) / 1000000 AS value, max(ts) AS computed_at FROM events GROUP BY ALL)"""


def stamp(c, fmt: str = "yyyy-MM-dd HH:mm:ss"):
    """A timestamp or date as text, so that both engines print it alike."""
    return F.date_format(c, fmt)


def day_text(c):
    return F.date_format(c, "yyyy-MM-dd")
