"""Checks of parsed text and tables against their source: critical characters, closed tables, cells against page words, context, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import NARROW, WIDE, numbers

# Characters that change what a number means (scales and signs, denials, periods, currencies, comparisons and directions).
CRITICAL = "亿万千百十元%‰增减升降涨跌负亏盈零〇一二三四五六七八九两不未无非否同环末初美港欧日≥≤<>▲▼△▽↑↓±"


def critical_violations(texts: DataFrame, key: str, structured: str, source: str) -> DataFrame:
    """(key, violations): the critical characters that a text has more often than its source, sorted; an empty array where none."""
    chars = lambda c, n: F.struct(F.lit(n).alias("w"), F.filter(F.split(F.translate(F.coalesce(F.col(c), F.lit("")), WIDE, NARROW), ""), lambda x: F.lit(CRITICAL).contains(x) & (x != "")).alias("xs"))
    d = texts.select(key, F.explode(F.array(chars(structured, 1), chars(source, -1))).alias("s")).select(key, "s.w", F.explode("s.xs").alias("ch"))
    over = d.groupBy(key, "ch").agg(F.sum("w").alias("n")).filter("n > 0").groupBy(key).agg(F.sort_array(F.collect_list("ch")).alias("violations"))
    return texts.select(key).join(over, key, "left").select(key, F.coalesce("violations", F.array().cast("array<string>")).alias("violations"))


def markdown_tables(slots: DataFrame) -> DataFrame:
    """(table_id, markdown) of slots(table_id, row, col, text): a line per row, a dashed line after the first; a place that no cell covers is empty, line breaks and bars in cells are made harmless."""
    size = slots.groupBy("table_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    places = size.select("table_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    text = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), "[\r\n]+", " ")
    full = places.join(slots.select("table_id", "row", "col", "text"), ["table_id", "row", "col"], "left").withColumn("text", text)
    ordered = lambda c, v: F.transform(F.sort_array(F.collect_list(F.struct(c, v))), lambda x: x[v])
    line = F.concat(F.lit("| "), F.array_join(ordered("col", "text"), " | "), F.lit(" |"))
    rows = full.groupBy("table_id", "row").agg(line.alias("line"), F.max("cols").cast("int").alias("cols"))
    rows = rows.withColumn("line", F.when(F.col("row") == 0, F.concat("line", F.lit("\n|"), F.repeat(F.lit("---|"), F.col("cols")))).otherwise(F.col("line")))
    return rows.groupBy("table_id").agg(F.array_join(ordered("row", "line"), "\n").alias("markdown"))


def looks_closed(markdown: Column) -> Column:
    """True for a table with lines of data none of whose cells is empty."""
    data = F.filter(F.split(markdown, "\n"), lambda x: ~x.rlike(r"^[\s|-]*$"))
    return (F.size(data) > 0) & ~F.exists(data, lambda x: F.regexp_replace(x, r"^\|+|\|+$", "").rlike(r"(^|\|)\s*(\||$)"))


def cell_stats(cells: DataFrame) -> DataFrame:
    """(table_id, rows, cols, n_match, n_mismatch, pages): how far the cells reach, how their checks ended, and the pages they stand on, sorted."""
    n = lambda v: F.count_if(F.col("check") == v)
    g = cells.groupBy("table_id").agg(F.max(F.col("r") + F.col("rs")).alias("rows"), F.max(F.col("c") + F.col("cs")).alias("cols"), n("match").alias("n_match"), n("mismatch").alias("n_mismatch"), F.sort_array(F.collect_set("page")).alias("pages"))
    return g


def verify_cells(cells: DataFrame, words: DataFrame, pages: DataFrame, pad: float = 0.0) -> DataFrame:
    """(table_id, cell, verdict) of cells(table_id, cell, page, x0, y0, x1, y1, text) against words(page, x, y, text), whose centres stand on pages(page, rotation).

    A cell without numbers is no_numbers; without place, or on a turned page, not_checked; on a page without words no_text_layer; else match where the
    words inside hold the same numbers as often as the cell does, and mismatch. Words meet cells by page, and only those inside go on.
    """
    need = F.sort_array(numbers(F.col("text")))
    c = cells.withColumn("need", need)
    inside = c.select("table_id", "cell", "page", "x0", "y0", "x1", "y1").join(words.select("page", "x", "y", F.col("text").alias("word")), "page").filter(F.col("x").between(F.col("x0") - pad, F.col("x1") + pad) & F.col("y").between(F.col("y0") - pad, F.col("y1") + pad))
    have = inside.select("table_id", "cell", F.explode(numbers(F.col("word"))).alias("n")).groupBy("table_id", "cell").agg(F.sort_array(F.collect_list("n")).alias("have"))
    layer = words.select("page").distinct().withColumn("_layer", F.lit(True))
    d = c.join(have, ["table_id", "cell"], "left").join(layer, "page", "left").join(pages.select("page", "rotation"), "page", "left")
    same = F.coalesce("have", F.array().cast("array<string>")) == F.col("need")
    verdict = F.when(F.size("need") == 0, "no_numbers").when(F.col("page").isNull() | F.col("x0").isNull() | (F.coalesce("rotation", F.lit(0)) != 0), "not_checked").when(F.col("_layer").isNull(), "no_text_layer").when(same, "match").otherwise("mismatch")
    return d.select("table_id", "cell", verdict.alias("verdict"))


def bind_context(scopes: DataFrame, ratio_only: DataFrame) -> DataFrame:
    """(table_id, unit, source) from scopes(table_id, distance, declared, unit): distance 0 is the table itself, others the blocks before it, nearest first.

    The nearest scope that declares a unit decides, even if its unit is unknown (null) or it declares several, as a farther one must not stand in. A
    table of ratios alone takes no unit from the blocks before it.
    """
    one = F.when((F.count_distinct("unit") == 1) & (F.count("unit") == F.count("*")), F.max("unit"))
    first = scopes.filter("declared").groupBy("table_id", "distance").agg(one.alias("unit")).groupBy("table_id").agg(F.min_by(F.struct("distance", "unit"), "distance").alias("x"))
    d = scopes.select("table_id").distinct().join(first, "table_id", "left").join(ratio_only.select("table_id", F.lit(True).alias("_r")), "table_id", "left")
    unit = F.when(F.col("_r").isNull() | (F.col("x.distance") == 0), F.col("x.unit"))
    source = F.when(unit.isNull(), "none").when(F.col("x.distance") == 0, "in_table").otherwise("preceding_block")
    return d.select("table_id", unit.alias("unit"), source.alias("source"))


def heading_scores(gold: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(by, recall, precision) of found(by, doc_id, title) against gold: headings of a document counted as a multiset, summed over all documents before the ratios are taken."""
    n = lambda d, name: d.groupBy(by, "doc_id", "title").agg(F.count("*").alias(name))
    j = n(gold, "g").join(n(found, "f"), [by, "doc_id", "title"], "full")
    g, f = F.coalesce("g", F.lit(0)), F.coalesce("f", F.lit(0))
    s = j.groupBy(by).agg(F.sum(F.least(g, f)).alias("hit"), F.sum(g).alias("g"), F.sum(f).alias("f"))
    share = lambda c: F.round(F.when(F.col(c) > 0, F.col("hit") / F.col(c)).otherwise(0.0), 6)
    return s.select(by, share("g").alias("recall"), share("f").alias("precision"))


def expensive_tier(confidence_below: Column, closure_below: Column, enabled: Column, confidence: Column, closure: Column, has_table: Column) -> Column:
    """Whether a page goes to the dearest parser: an enabled policy whose bound its confidence, or its tables' closure, stays below. Without policy never."""
    low = F.coalesce(confidence < confidence_below, F.lit(False))
    return F.coalesce(enabled, F.lit(False)) & (low | (F.coalesce(has_table, F.lit(False)) & F.coalesce(closure < closure_below, F.lit(False))))


def stage_counts(trace: DataFrame, stages: list[str]) -> DataFrame:
    """(qid, a count per stage): how many rows of a trace have a rank in each stage."""
    return trace.groupBy("qid").agg(*[F.count(f"{s}_rank").alias(f"n_{s}") for s in stages])


def latest_snapshot(calls: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """calls with the body of the latest snapshot of equal parameters, taken no later than the call; null where there is none, as nothing is fetched."""
    s = snapshots.select(*keys, F.col("taken_at").alias("_at"), "body", F.lit(None).cast("long").alias("call"))
    c = calls.select(*keys, F.col("asked_at").alias("_at"), F.lit(None).cast(snapshots.schema["body"].dataType).alias("body"), "call")
    w = Window.partitionBy(*keys).orderBy("_at", F.col("call").asc_nulls_first(), "body").rowsBetween(Window.unboundedPreceding, 0)
    u = s.unionByName(c).withColumn("body", F.last("body", ignorenulls=True).over(w))
    return u.filter("call is not null").select("call", *keys, "body")


def grid_verdicts(cells: DataFrame, tier: Column) -> DataFrame:
    """(table_id, verdict) of cells(table_id, text, check), where `tier` says how the table was parsed (L1, L2 or none).

    Only cells with numbers count. In this order: any mismatch; L2 without any cell checked against a text layer is dual_agree; a page without text
    layer; no numbers at all; all match; none matches (closed by its page in L1, else not checked); the rest is partial.
    """
    n = lambda *v: F.count_if((F.size(numbers(F.col("text"))) > 0) & F.col("check").isin(*v))
    g = cells.withColumn("_tier", tier).groupBy("table_id").agg(F.max("_tier").alias("tier"), n("match").alias("ok"), n("mismatch").alias("bad"), n("no_text_layer").alias("bare"), n("not_checked", "no_numbers").alias("open"))
    total = F.col("ok") + F.col("bad") + F.col("bare") + F.col("open")
    verdict = (
        F.when(F.col("bad") > 0, "text_layer_cells_mismatch").when((F.col("tier") == "L2") & (F.col("open") == total), "dual_agree").when(F.col("bare") > 0, "scan_single_unverified")
        .when(total == 0, "not_checked").when(F.col("ok") == total, "text_layer_cells_ok").when((F.col("ok") == 0) & (F.col("tier") == "L1"), "text_layer_page_closed").when(F.col("ok") == 0, "not_checked").otherwise("text_layer_cells_partial")
    )
    return g.select("table_id", verdict.alias("verdict"))


def chunk_violations(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, violations) of chunks(doc_id, ordinal, parent, kind, content, description, page, is_leaf, has_figure) against pages(doc_id, page_count): all broken rules of a document, sorted; none where empty.

    Ordinals run from 0 without gap or repeat; no content is blank; a table has a description; a parent exists and has no parent itself; a page lies
    within the document; a leaf has no children, and what is no leaf has some, or is a figure.
    """
    up = chunks.select("doc_id", F.col("ordinal").alias("parent"), F.col("parent").alias("_grand"), F.lit(True).alias("_there")).dropDuplicates(["doc_id", "parent"])
    kids = chunks.filter("parent is not null").select("doc_id", F.col("parent").alias("ordinal")).distinct().withColumn("_kids", F.lit(True))
    d = chunks.join(up, ["doc_id", "parent"], "left").join(kids, ["doc_id", "ordinal"], "left").join(pages, "doc_id", "left")
    has, kept = F.col("parent").isNotNull(), F.col("_kids").isNotNull()
    broken = {
        "blank": F.trim("content") == "", "no_description": (F.col("kind") == "table") & (F.trim(F.coalesce("description", F.lit(""))) == ""), "no_parent": has & F.col("_there").isNull(), "nested": has & F.col("_grand").isNotNull(),
        "page": (F.col("page") < 1) | ((F.col("page_count") > 0) & (F.col("page") > F.col("page_count"))), "leaf_with_children": F.col("is_leaf") & kept, "node_without_children": ~F.col("is_leaf") & ~kept & ~F.col("has_figure"),
    }
    order = F.when((F.count("*") != F.count_distinct("ordinal")) | (F.min("ordinal") != 0) | (F.max("ordinal") != F.count("*") - 1), "ordinals")
    g = d.groupBy("doc_id").agg(order.alias("_order"), *[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"_{k}") for k, c in broken.items()])
    return g.select("doc_id", F.concat_ws(",", F.array_sort(F.array_compact(F.array("_order", *[F.when(F.col(f"_{k}"), F.lit(k)) for k in broken])))).alias("violations"))


# Numerals, and how headings of each system begin.
NUMERALS = "一二三四五六七八九"
CN = "一二三四五六七八九十零〇"
SYSTEMS = {
    "chapter": f"^第([{CN}]+)章", "section": f"^第([{CN}]+)节", "cn": f"^([{CN}]{{1,3}})[、．.][^\\s]", "cn_paren": f"^[（(]([{CN}]{{1,3}})[）)][^\\s]",
    "decimal3": r"^[0-9]{1,2}\.[0-9]{1,2}\.([0-9]{1,2})(?:\s+[^\s]|[^0-9.\s])", "decimal2": r"^[0-9]{1,2}\.([0-9]{1,2})(?:\s+[^\s]|[^0-9.\s])",
    "arabic": r"^([0-9]{1,2})[、．.](?:\s+[^\s]|[^0-9\s])", "arabic_paren": r"^[（(]([0-9]{1,2})[）)]\s*[^\s]",
}
#: Systems whose numbers may as well begin an amount.
AMOUNTS = ("decimal3", "decimal2", "arabic")
KEYWORD = f"^(?:(?:特别提示|重要提示|重要内容提示|释义|目录|备查文件目录|备查文件|风险提示)[：:]?|附件[一二三四五六七八九十0-9]{{0,3}}(?:[：:].{{0,30}})?)$"
# Units that make a number an amount: of one character, of several, and of one that also begins words, so no letter of a word may follow.
UNIT, UNIT_WORDS, UNIT_OR_WORD = "亿万千百元%％倍个家人台年月日", "美元|港元|港币|日元|欧元|万股|亿股|万吨|万手|bp", "股吨次项点手户"
NUMBER_WITH_UNIT = rf"^[0-9]{{1,2}}(?:\.[0-9]{{1,2}}){{0,2}}[、．.]?\s*(?:[{UNIT}]|{UNIT_WORDS}|[{UNIT_OR_WORD}](?:[^一-鿿]|$))"


def numeral(c: Column) -> Column:
    """Decimal digits of one place or two, or one to ninety-nine in Chinese numerals; null for anything else."""
    plain = F.translate(c, NUMERALS + "零〇", "12345678900")
    by_place = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "^十", "1十"), "十$", "0"), "十", "")
    written = c.rlike("^[0-9]{1,2}$") | c.rlike(f"^(?:[{NUMERALS}零〇]|[{NUMERALS}零〇]?十[{NUMERALS}零〇]?)$")
    return F.when(written, by_place.cast("int"))


def numbering(text: Column) -> tuple[Column, Column]:
    """(system, ordinal) of a heading's number; nulls where there is none, or where the number is an amount with its unit. A keyword heading has ordinal 0.

    The first rule whose pattern fits decides: each is a struct of its name, whether the text fits, its number, and whether an amount would fit it too.
    """
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    amount = s.rlike(NUMBER_WITH_UNIT)
    rule = lambda name, fits, n, barred: F.struct(F.lit(name).alias("system"), fits.alias("fits"), n.alias("ordinal"), barred.alias("barred"))
    rules = [rule("keyword", s.rlike(KEYWORD), F.lit(0), F.lit(False))] + [rule(k, s.rlike(p), numeral(F.regexp_extract(s, p, 1)), amount if k in AMOUNTS else F.lit(False)) for k, p in SYSTEMS.items()]
    first = F.get(F.filter(F.array(*rules), lambda r: r["fits"]), F.lit(0))
    known = ~first["barred"] & first["ordinal"].isNotNull()
    return F.when(known, first["system"]), F.when(known, first["ordinal"])


# What a question must not say (it must stand alone, and ask for no advice), and what titles say.
DEICTIC = "这份|该公司|该报告|本公司|本期报告|上述|该文"
ADVICE = "买入|卖出|增持|减持|推荐|目标价|评级|建议配置|仓位"
NEVER_PARSED, CORRECTION = "英文版|English|取消.*(?:公告|事项)|提示性公告", "(?:的)?(?:更正|修订)(?:公告|版|说明)?[)）]?$"
FIRST_TIER, SECOND_TIER = "第[一三]季度报告$|(?:半)?年度报告摘要$|业绩预告|业绩快报", "(?:半)?年度报告$"


def good_question(text: Column) -> Column:
    """Whether a question ends as one, has 8 to 120 characters, names what it asks about, and asks for no advice."""
    q = F.regexp_replace(text, r"^\s+|\s+$", "")
    return q.rlike("[？?]$") & F.length(q).between(8, 120) & ~q.rlike(DEICTIC) & ~q.rlike(ADVICE)


def title_tier(title: Column) -> Column:
    """first, second or none: when a document of this title is parsed. A correction counts as what it corrects."""
    base = F.regexp_replace(F.regexp_replace(title, CORRECTION, ""), "[(（]+$", "")
    return F.when(title.rlike(NEVER_PARSED), "none").when(base.rlike(SECOND_TIER), "second").when(base.rlike(FIRST_TIER), "first").otherwise("none")
