"""Tables from the boxes of words: rows of several segments, and columns by an interval sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(words: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """(keys, row, n): how many segments a row of words has, cut where the next word begins `gap` or more after the end of the one before."""
    w = Window.partitionBy(*keys, "row").orderBy("x0", "x1", "text")
    cut = F.coalesce(F.lead("x0").over(w) - F.col("x1") >= gap, F.lit(False))
    return words.withColumn("_cut", cut).groupBy(*keys, "row").agg((F.count_if("_cut") + 1).alias("n"))


def table_regions(words: DataFrame, keys: list[str], gap: float = 8.0, min_rows: int = 3) -> DataFrame:
    """words in a region, with region: neighbouring rows of two segments or more, `min_rows` of them at least. Rows are numbered without gaps."""
    rows = segments(words, keys, gap).filter("n >= 2")
    w = Window.partitionBy(*keys).orderBy("row")
    rows = rows.withColumn("_island", F.col("row") - F.row_number().over(w))
    island = Window.partitionBy(*keys, "_island")
    rows = rows.withColumns({"region": F.min("row").over(island), "_rows": F.count("*").over(island)}).filter(F.col("_rows") >= min_rows)
    return words.join(rows.select(*keys, "row", "region"), [*keys, "row"])


def column_edges(words: DataFrame, keys: list[str], gap: float = 8.0) -> DataFrame:
    """words with col and its left and right edge, by a sweep: a word that begins `gap` or more after all before it have ended begins a column."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1", "row", "text")
    reached = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = words.withColumn("_new", F.coalesce(F.col("x0") - reached >= gap, F.lit(True)).cast("int")).withColumn("col", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
    column = Window.partitionBy(*keys, "col")
    return d.withColumns({"left": F.min("x0").over(column), "right": F.max("x1").over(column)})


def word_grids(words: DataFrame, key: str, gap: float = 8.0, min_rows: int = 3, min_cols: int = 3) -> DataFrame:
    """(key, region, row, col, left, right, text): the cells of the tables that words(key, row, x0, x1, text) form on their pages; a cell's words in order of x0.

    Columns are found within a region only, as a line of prose would bridge them. Regions of fewer than `min_cols` columns are no tables.
    """
    d = column_edges(table_regions(words, [key], gap, min_rows), [key, "region"], gap)
    d = d.withColumn("_cols", F.max("col").over(Window.partitionBy(key, "region"))).filter(F.col("_cols") + 1 >= min_cols)
    cell = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ")
    return d.groupBy(key, "region", "row", "col", "left", "right").agg(cell.alias("text"))
