"""Two parses of one page held against each other: markup by a stack of open tags, tables cell by cell, numbers, signs and text in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import folded, stream
from .verification import CRITICAL

# Where each tag of a table may stand ('' is outside of all), and the least share of characters that two parses have in common.
PARENTS = {"table": [""], "thead": ["table"], "tbody": ["table"], "tr": ["table", "thead", "tbody"], "td": ["tr"], "th": ["tr"]}
LEAST_AGREEMENT = 0.9
TAG = r"<(/?)(table|thead|tbody|tr|td|th)\b([^>]*)>"
STATE = "struct<open:array<string>,found:array<string>>"


def tag_violations(md: Column) -> Column:
    """What is wrong with a text's table tags, each kind once: self_closing, unpaired, misplaced, stray_text (between cells), unclosed.

    One walk over the tags in order, with the tags still open as its state: a tag must stand in one of its parents, an end must close the last one opened.
    """
    piece = lambda n: F.regexp_extract_all(md, F.lit(rf"(?is)(.*?)(?:{TAG}|\z)"), n)
    halves = [F.zip_with(piece(k), piece(k + 1), lambda x, y: F.struct(x.alias("x"), y.alias("y"))) for k in (1, 3)]  # each group is found once, not once per tag
    steps = F.zip_with(*halves, lambda u, v: F.struct(F.regexp_replace(u["x"], r"(?i)<br\b[^>]*>|\s+", "").alias("text"), (u["y"] == "/").alias("ends"), F.lower(v["x"]).alias("name"), v["y"].rlike(r"/\s*$").alias("alone")))
    parents = F.create_map(*[x for k, v in PARENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def walk(acc: Column, x: Column) -> Column:
        top = F.when(F.size(acc["open"]) > 0, F.element_at(acc["open"], -1)).otherwise("")
        tag = x["name"] != ""
        stray = top.isin("table", "thead", "tbody", "tr") & (x["text"] != "")
        closes = tag & ~x["alone"] & x["ends"]
        opens = tag & ~x["alone"] & ~x["ends"]
        wrong = F.array_compact(F.array(
            F.when(stray, F.lit("stray_text")), F.when(tag & x["alone"], F.lit("self_closing")), F.when(closes & (top != x["name"]), F.lit("unpaired")), F.when(opens & ~F.array_contains(F.element_at(parents, x["name"]), top), F.lit("misplaced")),
        ))
        stack = F.when(opens, F.concat(acc["open"], F.array(x["name"]))).when(closes & (top == x["name"]), F.slice(acc["open"], 1, F.size(acc["open"]) - 1)).otherwise(acc["open"])
        return F.struct(stack.alias("open"), F.array_union(acc["found"], wrong).alias("found")).cast(STATE)

    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("found")).cast(STATE)
    return F.aggregate(steps, start, walk, lambda s: F.sort_array(F.array_union(s["found"], F.when(F.size(s["open"]) > 0, F.array(F.lit("unclosed"))).otherwise(F.array().cast("array<string>")))))


def plain_text(md: Column) -> Column:
    """Tags are spaces, the lines that divide tables' heads are empty, bars are spaces."""
    t = F.regexp_replace(F.regexp_replace(md, r"\r\n?", "\n"), r"(?m)^(?=[^\n]*\|)[ \t|:-]*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\|", " ")


def content(text: Column) -> Column:
    """Letters and digits in order."""
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", "")


def table_rows(md: Column) -> Column:
    """A string per row of the text's tables, in order: each cell's text without spaces, and its spans where they aren't 1. Rows of tags, and lines that begin with a bar."""
    rows = F.regexp_extract_all(md, F.lit(r"(?is)(<tr\b[^>]*>.*?(?=<tr\b|</table>|\z)|^[ \t]*\|[^\n]*$)".replace("(?is)", "(?ism)")), 1)
    divider = lambda r: r.rlike(r"^\s*\|[\s|:-]*$") & r.contains("-")
    span = lambda c, name: F.coalesce(F.nullif(F.regexp_extract(c, rf"(?i){name}\s*=\s*[\"']?([0-9]+)", 1), F.lit("")), F.lit("1"))
    bare = lambda c: F.regexp_replace(folded(F.regexp_replace(c, r"<[^>]*>", "")), r"\s+", "")
    tagged = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)(<t[dh]\b[^>]*>.*?(?=<t[dh]\b|\z))"), 1), lambda c: F.concat_ws("/", bare(c), span(F.regexp_extract(c, r"^<[^>]*>", 0), "rowspan"), span(F.regexp_extract(c, r"^<[^>]*>", 0), "colspan")))
    barred = lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda c: F.concat(bare(c), F.lit("/1/1")))
    return F.transform(F.filter(rows, lambda r: ~divider(r)), lambda r: F.array_join(F.when(r.rlike(r"(?i)^<tr"), tagged(r)).otherwise(barred(r)), "¦"))


def shared_characters(a: Column, b: Column) -> Column:
    """How many characters two texts have in common, each as often as both have it."""
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))


def dual_verdict(pages: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, ok, reasons, agreement) of two parses of each page. reasons are all that apply, in this order: markup (either's tags are wrong; nothing else is looked at),
    empty, numbers, signs, tables, order, text, agreement.

    numbers and signs compare as multisets, tables row by row, order the stream of numbers and signs, text the letters and digits in sequence; agreement is the lower
    share of either's characters that the other has. Row by row, dealt over all cores first: a small file of many pages is one task's work otherwise; a null parse is an empty one.
    """
    spark = pages.sparkSession
    pages = pages.select(key, first, second).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (first, second))
    d = pages.select(key, F.array(*map(tag_violations, (a, b))).alias("tags"), table_rows(a).alias("ra"), table_rows(b).alias("rb"), plain_text(a).alias("a"), plain_text(b).alias("b"))
    d = d.select("*", stream(F.col("a")).alias("sa"), stream(F.col("b")).alias("sb"), content(F.col("a")).alias("ca"), content(F.col("b")).alias("cb"))
    number = lambda s: F.array_sort(F.filter(s, lambda x: x.rlike("[0-9]")))
    sign = lambda s: F.array_sort(F.filter(s, lambda x: F.lit(CRITICAL).contains(x)))
    longest = F.greatest(F.length("ca"), F.length("cb"))
    agreement = F.when(longest == 0, 1.0).otherwise(shared_characters(F.col("ca"), F.col("cb")) / longest)
    d = d.withColumn("agreement", F.round(agreement, 6))
    bad, none = F.exists("tags", lambda t: F.size(t) > 0), (F.col("ca") == "") | (F.col("cb") == "")
    differs = {"numbers": number(F.col("sa")) != number(F.col("sb")), "signs": sign(F.col("sa")) != sign(F.col("sb")), "tables": F.col("ra") != F.col("rb"), "order": F.col("sa") != F.col("sb"), "text": F.col("ca") != F.col("cb"), "agreement": F.col("agreement") < LEAST_AGREEMENT}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in differs.items()]))
    reasons = F.when(bad, F.array(F.lit("markup"))).when(none, F.array(F.lit("empty"))).otherwise(found)
    return d.select(key, reasons.alias("reasons"), "agreement").select(key, (F.size("reasons") == 0).alias("ok"), "reasons", "agreement")
