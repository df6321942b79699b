"""Text and table-cell expressions: numbers, closure, coverage, headings, tiers, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Full-width digits and signs, and what they are written as.
WIDE, NARROW = "０１２３４５６７８９．，％（）－＋", "0123456789.,%()-+"
NUMBER = r"\([0-9][0-9,]*(?:\.[0-9]+)?\)|[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?"
# Lines without content of their own (page marks, contents, definitions, the disclaimer, "no such case").
BOILERPLATE = [r"^第\s*[0-9]+\s*页\s*共\s*[0-9]+\s*页$", r"^-?\s*[0-9]+\s*-?$", r"^目\s*录$", r"^释\s*义$", r"保证信息披露内容的真实、准确和完整", r"^本报告期内公司不存在.{0,20}情形$"]
# Units that may stand behind a number in its cell.
UNITS = "百万元 千万元 万亿元 亿元 万元 千元 港元 欧元 日元 英镑 元 亿美元 万美元 千美元 美元 亿股 万股 股 万吨 吨 万人 人 万台 台 万件 件".split()
GROUPED = r"[0-9]{1,3}(?:,[0-9]{3})+"
PLAIN_CELL = rf"-?(?:(?:{GROUPED}|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)%?"
NEGATIVE_CELL = rf"\((?:{GROUPED}(?:\.[0-9]+)?|[0-9]*\.[0-9]+)%?\)%?"
CELL = rf"^({PLAIN_CELL}|{NEGATIVE_CELL})\s*({'|'.join(UNITS)})?$"
BREAK, BROKEN = r"(?i)<br\s*/?>", r"(?i)[0-9.,]\s*<br\s*/?>\s*[0-9.,]"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, WIDE, NARROW), F.lit(f"({NUMBER})"), 1)


def multiset(df: DataFrame, keys: list[str], items: Column) -> DataFrame:
    return df.select(*keys, F.explode(items).alias("item")).groupBy(*keys, "item").agg(F.count("*").alias("n"))


def multiset_compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: items in common counted with min(a, b), and what either side has beyond."""
    j = a.join(b.withColumnRenamed("n", "m"), [*keys, "item"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return j.groupBy(*keys).agg(F.sum(F.least(n, m)).alias("shared"), F.sum(F.greatest(n - m, F.lit(0))).alias("only_a"), F.sum(F.greatest(m - n, F.lit(0))).alias("only_b"))


def is_boilerplate(line: Column) -> Column:
    """True for blank lines and those that are, or hold, one of BOILERPLATE. Null stays null."""
    c = F.regexp_replace(line, r"^\s+|\s+$", "")
    out = c == ""
    for p in BOILERPLATE:
        out = out | c.rlike(p)
    return out


def cell_value(cell: Column) -> tuple[Column, Column, Column]:
    """(value, kind, unit) of a cell that states one number, with at most one of UNITS behind it; else nulls.

    A number in parentheses is negative if it has decimals or groups, else a note's number. A break between digits, a percentage with a unit,
    several numbers, dates and words leave the cell without value. A bare year counts as an amount.
    """
    c = F.trim(F.regexp_replace(F.translate(F.regexp_replace(cell, BREAK, " "), WIDE, NARROW), r"\s+", " "))
    number, unit = F.regexp_extract(c, CELL, 1), F.nullif(F.regexp_extract(c, CELL, 2), F.lit(""))
    percent = number.contains("%")
    good = (number != "") & ~cell.rlike(BROKEN) & ~(percent & unit.isNotNull())
    plain = F.regexp_replace(number, "[^0-9.]", "").try_cast("decimal(38,10)")
    value = F.when(good, F.when(number.rlike("^[(-]"), -plain).otherwise(plain))
    return value, F.when(value.isNotNull(), F.when(percent, "percent").otherwise("amount")), F.when(value.isNotNull(), unit)


def garbled_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.round((n - F.length(F.regexp_replace(text, r"[^\x20-\x7e\n -ɏ]", ""))) / n, 6)).otherwise(0.0)


def confidence(coverage: Column, closure: Column, garbled: Column, missing: Column) -> Column:
    """Weighted score of four shares, clamped to 0..1."""
    s = 0.3 * coverage + 0.3 * closure + 0.2 * (1 - garbled) + 0.2 * (1 - missing)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 4)


def line_repetition(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Lines that a source's documents repeat: candidates for headers and footers."""
    g = blocks.filter("length(trim(content)) > 0").select("source", "doc_id", F.trim("content").alias("line")).groupBy("source", "line").agg(F.count_distinct("doc_id").alias("n_docs"))
    return g.filter(F.col("n_docs") >= least)


def continuation(blocks: DataFrame) -> DataFrame:
    """Blocks that go on from the one before: same document and section, next ordinal, no sentence end before, no capital after."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    before = F.lag("content").over(w)
    linked = before.isNotNull() & (F.lag("ordinal").over(w) == F.col("ordinal") - 1) & ~before.rlike(r"[.!?]\s*$") & F.col("content").rlike("^[a-z]")
    return blocks.select("doc_id", "ordinal", F.coalesce(linked, F.lit(False)).alias("continues"))


def hard_boundary(blocks: DataFrame) -> DataFrame:
    """Leaves exempt from the length rule: last of their document, or before a change of page or section."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    edge = F.lead("block_id").over(w).isNull() | (F.lead("page").over(w) != F.col("page")) | (F.lead("source").over(w) != F.col("source"))
    return blocks.withColumn("exempt", edge)


def islands(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Gaps and islands: rows of a key closer than the gap belong together."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))) > gap_seconds * 1_000_000, F.lit(True))
    d = events.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w))
    return d.groupBy(key, "island").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def grid_slots(cells: DataFrame) -> DataFrame:
    """Cells with row and column spans to one row per slot; of several cells on a slot the later wins."""
    rows = F.explode(F.sequence("r", F.col("r") + F.col("rs") - 1)).alias("row")
    d = cells.select("*", rows).select("*", F.explode(F.sequence("c", F.col("c") + F.col("cs") - 1)).alias("col"))
    return d.groupBy("table_id", "row", "col").agg(F.max_by("t", "cell").alias("text"), F.count("*").alias("covered"))


def unit_for_cell(inline: Column, column: Column, row: Column, table: Column) -> Column:
    """Inline unit before the column's before the table's; a row unit that disagrees with the column's is a conflict, hence none."""
    return F.when(inline.isNotNull(), inline).when(row.isNotNull() & column.isNotNull() & (row != column), None).otherwise(F.coalesce(column, row, table))


def tolerance(decimals: Column, scale: Column) -> Column:
    """Allowed difference of a fact and a cell: half a unit of the last printed place, at least 6000, at most 0.5 % of scale or 6000."""
    return F.least(F.greatest(F.lit(6000.0), 0.5 * F.pow(F.lit(10.0), -decimals) * scale), F.greatest(F.lit(6000.0), 0.005 * scale))


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2))))


def trigrams(text: Column) -> Column:
    """Trigrams of a lower-cased name padded by two spaces before and one after."""
    t = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, 3)))


def similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)
