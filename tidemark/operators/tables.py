"""Table understanding over cells(table_id, row, col, text): headers, labels, units, and facts against cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = r"^[-+(]?[0-9][0-9,]*(\.[0-9]+)?[)%]?$"
# Unit words and their scales.
UNIT_SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}


def is_number(text: Column) -> Column:
    return F.trim(text).rlike(NUMERIC)


def headers(cells: DataFrame) -> DataFrame:
    """(table_id, header_rows, label_cols): rows before the first that holds a number, and columns that never hold one before the first that does."""
    n = cells.withColumn("number", is_number(F.col("text")))
    body = n.filter("number").groupBy("table_id").agg(F.min("row").alias("header_rows"), F.min("col").alias("label_cols"))
    return cells.select("table_id").distinct().join(body, "table_id", "left")


def paths(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, text, col_path, row_label) of every number: header texts above it from top to bottom, and the last label at its left."""
    c = cells.join(headers(cells), "table_id")
    head = c.filter("row < header_rows and col >= label_cols").groupBy("table_id", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " / ").alias("col_path"))
    label = c.filter("col < label_cols and row >= header_rows and length(trim(text)) > 0").groupBy("table_id", "row").agg(F.max_by("text", "col").alias("row_label"))
    body = c.filter("row >= header_rows and col >= label_cols").filter(is_number(F.col("text")))
    return body.join(head, ["table_id", "col"], "left").join(label, ["table_id", "row"], "left").select("table_id", "row", "col", "text", "col_path", "row_label")


def unit_markers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit): the one unit that the texts of a key name; two different ones are a conflict, hence none, and never a default."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({'|'.join(UNIT_SCALES)})"), 1)
    g = texts.select(key, F.explode_outer(F.array_distinct(found)).alias("unit")).groupBy(key).agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    return g.select(key, F.when(F.col("low") == F.col("high"), F.col("low")).alias("unit"), F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("conflict"))


def ratio_only(cells: DataFrame) -> DataFrame:
    """Tables whose numbers are all ratios don't inherit a unit of amount."""
    n = cells.filter(is_number(F.col("text")))
    return n.groupBy("table_id").agg(F.bool_and(F.trim("text").endswith("%")).alias("ratio_only"))


def match_facts(facts: DataFrame, cells: DataFrame, share: float = 0.005) -> DataFrame:
    """(entity, metric, period, verdict, n_cells) of every fact against cells(entity, metric, period, amount, own_document).

    Cells of the fact's own document go before all others. One matching value is match, or restated where it
    stands in another document only; several different values of which one fits are ambiguous; none that fits is mismatch.
    """
    keys = ["entity", "metric", "period"]
    c = cells.withColumn("own_document", F.coalesce("own_document", F.lit(False)))
    best = F.max("own_document").over(Window.partitionBy(*keys))
    c = c.withColumn("_best", best).filter(F.col("own_document") == F.col("_best")).drop("_best")
    j = facts.select(*keys, "value", "unit").join(c, keys, "left")
    gap = F.abs(F.col("amount").cast("double") - F.col("value").cast("double"))
    ok = gap <= F.greatest(F.lit(6000.0), share * F.abs(F.col("value").cast("double")))
    g = j.groupBy(*keys).agg(F.count("amount").alias("n_cells"), F.count_distinct("amount").alias("values"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("fits"), F.coalesce(F.bool_or("own_document"), F.lit(False)).alias("own"), F.first("unit", ignorenulls=True).alias("unit"))
    verdict = F.when(F.col("unit") != "CNY", "foreign_unit").when(F.col("n_cells") == 0, "no_cell").when(~F.col("fits"), "mismatch").when(F.col("values") > 1, "ambiguous").when(~F.col("own"), "restated").otherwise("match")
    return g.select(*keys, verdict.alias("verdict"), "n_cells")


def row_recall(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per table: share of reference rows whose cells some candidate row covers as a multiset. Rows meet on their rarest shared cell text."""
    a = reference.groupBy("table_id", "row", "text").agg(F.count("*").alias("n"))
    b = candidate.groupBy("table_id", F.col("row").alias("other"), "text").agg(F.count("*").alias("m"))
    size = a.groupBy("table_id", "row").agg(F.sum("n").alias("size"))
    met = a.join(b, ["table_id", "text"]).groupBy("table_id", "row", "other").agg(F.sum(F.least("n", "m")).alias("shared"))
    best = met.groupBy("table_id", "row").agg(F.max("shared").alias("shared"))
    r = size.join(best, ["table_id", "row"], "left")
    return r.groupBy("table_id").agg(F.round(F.avg((F.coalesce("shared", F.lit(0)) >= F.col("size")).cast("double")), 6).alias("recall"))


def backfill(grids: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """Positional zip of parsed tables and live table blocks per document; a document whose counts or texts differ at any place is refused as a whole."""
    order = lambda df, k: df.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(k)))
    j = order(grids, "grid_no").select(doc, "_n", "grid_no", F.col("text").alias("grid_text")).join(order(blocks, "ordinal").select(doc, "_n", "ordinal", "text"), [doc, "_n"], "full")
    same = F.coalesce(F.col("grid_text") == F.col("text"), F.lit(False))
    return j.withColumn("ok", F.bool_and(same).over(Window.partitionBy(doc))).filter("ok").select(doc, "grid_no", "ordinal")
