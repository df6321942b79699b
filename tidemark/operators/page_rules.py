"""Rules by page: financial statements, pages that need no parsing and what they save, and descriptions that state without judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import NARROW, WIDE, numbers

# Titles of financial statements, marks of their rows and columns, and how many numbers such a page has at least.
STATEMENT_TITLES = [
    "资产负债表", "利润表", "损益表", "综合收益表", "现金流量表", "所有者权益变动表", "股东权益变动表", "分部信息", "报告分部", "資產負債表", "利潤表", "損益表", "綜合收益表", "現金流量表", "所有者權益變動表", "股東權益變動表",
    "Consolidated Balance Sheet", "Balance Sheet", "Statement of Financial Position", "Statement of Cash Flow", "Statements of Cash Flow", "Statement of Comprehensive Income", "Statements of Comprehensive Income", "Income Statement",
]
STATEMENT_MARKS = ["流动资产合计", "负债和所有者权益总计", "经营活动产生的现金流量净额", "本期金额", "上期金额", "期末余额", "期初余额"]
LEAST_NUMBERS, LEAST_MARKS = 20, 2
# Sizes of pages without content, pages at the end that may disclaim, and what such pages say.
BLANK_CHARS, SIGNATURE_CHARS, TAIL_PAGES = 40, 200, 3
SIGNATURE, DISCLAIMER, DATE = "董事会|监事会|特此公告", "免责声明|分析师声明|法律声明|重要声明|特别声明", r"(?:19|20)[0-9]{2}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日"
SKIP_RULES = ["blank_page", "signature_tail", "research_disclaimer_tail"]
# Words that advise, and how descriptions judge or foresee instead of stating.
FORBIDDEN = "买入|卖出|增持|减持|推荐|目标价|评级|建议配置|仓位"
JUDGING = [
    r"(?:显示|说明|表明|反映|意味着|体现出)[^，。！？；、\s]", "改善|恶化|强劲|疲软|亮眼|承压|超预期|不及预期",
    r"(?:预计|预期)[^，。！？；、\s]*(?:将|会|有望|增长|下滑|下降|上升|提升|回升|改善|恶化|扩大|收窄|盈利|亏损|上涨|下跌)|有望|将会|料将", "(?:大幅|显著|明显)(?:增长|下滑|提升|下降)",
]


def statement_page(text: Column) -> Column:
    """Whether a page's text is that of a financial statement: a title, or LEAST_MARKS different marks where a table goes on, and LEAST_NUMBERS numbers."""
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    titled = flat.rlike("|".join(t.replace(" ", "").lower() for t in STATEMENT_TITLES))
    marks = sum((F.when(flat.contains(m), 1).otherwise(0) for m in STATEMENT_MARKS), F.lit(0))
    return (titled | (marks >= LEAST_MARKS)) & (F.size(numbers(F.coalesce(text, F.lit("")))) >= LEAST_NUMBERS)


def skip_decisions(pages: DataFrame, doc: str, enforced: list[str]) -> DataFrame:
    """pages(doc, page, kind, text, images, curves) with matched, the skip rules that a page meets in their order, and skip, the first enforced one.

    blank_page: few characters, no picture; signature_tail: the last of several pages of an announcement, short, signed; research_disclaimer_tail: one of
    the last pages of a research report, disclaiming. None has a number besides dates. A document all of whose pages would go keeps them all.
    """
    text = F.coalesce("text", F.lit(""))
    chars = F.length(F.regexp_replace(text, r"\s+", ""))
    bare = F.size(numbers(F.regexp_replace(F.translate(text, WIDE, NARROW), DATE, " "))) == 0
    whole = Window.partitionBy(doc)
    left = F.row_number().over(whole.orderBy(F.desc("page")))
    rules = {
        "blank_page": (chars < BLANK_CHARS) & (F.col("images") == 0) & (F.col("curves") == 0), "signature_tail": (F.col("kind") == "announcement") & (F.col("_n") >= 2) & (F.col("_left") == 1) & (chars < SIGNATURE_CHARS) & text.rlike(SIGNATURE),
        "research_disclaimer_tail": (F.col("kind") == "research_report") & (F.col("_left") <= TAIL_PAGES) & text.rlike(DISCLAIMER),
    }
    d = pages.withColumns({"_n": F.count("*").over(whole), "_left": left})
    d = d.withColumn("matched", F.array_compact(F.array(*[F.when(F.coalesce(rules[k] & bare, F.lit(False)), F.lit(k)) for k in SKIP_RULES])))
    first = F.get(F.filter("matched", lambda x: x.isin(enforced)), F.lit(0))
    d = d.withColumn("skip", first)
    return d.withColumn("skip", F.when(F.count("skip").over(whole) < F.col("_n"), F.col("skip"))).drop("_n", "_left")


def skip_savings(decisions: DataFrame, cost_per_page: float) -> DataFrame:
    """(rule, matched, skipped, saved) per rule: pages that meet it, pages that it makes go, and what those would have cost. Rules that nobody met are there as well."""
    met = decisions.select(F.explode("matched").alias("rule")).groupBy("rule").agg(F.count("*").alias("matched"))
    gone = decisions.filter("skip is not null").groupBy(F.col("skip").alias("rule")).agg(F.count("*").alias("skipped"))
    all_rules = decisions.sparkSession.createDataFrame([(k,) for k in SKIP_RULES], "rule string")
    d = all_rules.join(met, "rule", "left").join(gone, "rule", "left")
    n = F.coalesce("skipped", F.lit(0))
    return d.select("rule", F.coalesce("matched", F.lit(0)).alias("matched"), n.alias("skipped"), F.round(n * cost_per_page, 4).alias("saved"))


def description_problem(text: Column) -> Column:
    """Why a description is refused: empty, forbidden (it advises) or judging (it interprets or foresees); null for one that only states."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    judged = F.lit(False)
    for p in JUDGING:
        judged = judged | t.rlike(p)
    return F.when(t == "", "empty").when(t.rlike(FORBIDDEN), "forbidden").when(judged, "judging")
