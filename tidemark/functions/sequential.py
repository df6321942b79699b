"""Rules that depend on all before them: per document in sorted order, and small parsers as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^([0-9]+)\.\s"
SHORT, FULL = 120, 400


def merge_short(blocks: DataFrame, short: int = SHORT, full: int = FULL) -> DataFrame:
    """(doc_id, run, first_ordinal, n_blocks, content): runs of short blocks of a page are joined until `full` characters.

    Documents are dealt by their id and sorted with their blocks, and a task walks over its rows once: the state is the open run, whatever the
    number of documents or of a document's blocks.
    """
    names = ["doc_id", "run", "first_ordinal", "n_blocks", "content"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run, at, open_page = None, None, None  # [doc_id, run, first_ordinal, n_blocks, contents], its length

        def closed(runs: list[list]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*runs, strict=True)] or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns[:4], ["\n".join(x) for x in columns[4]]], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()], strict=True)], names=names)

        for b in batches:
            done = []
            for doc, ordinal, page, content in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n = len(content)
                new = open_run is None or open_run[0] != doc
                if not new and open_page is not None and open_page == page and n < short and at + n <= full:
                    open_run[3] += 1
                    open_run[4].append(content)
                    at += n + 1
                    continue
                if open_run is not None:
                    done.append(open_run)
                open_run, at, open_page = [doc, 0 if new else open_run[1] + 1, ordinal, 1, [content]], n, page if n < short else None
            yield closed(done)
        if open_run is not None:
            yield closed([open_run])

    dealt = blocks.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("int"), F.col("page").cast("int"), "content").repartition("doc_id").sortWithinPartitions("doc_id", "ordinal", "page", "content")
    return dealt.mapInArrow(merge, "doc_id long, run int, first_ordinal int, n_blocks int, content string")


def heading_consistency(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_headings, consistent): numbered headings begin at 1 and rise by 1; fewer than two say nothing (null)."""
    h = blocks.withColumn("no", F.regexp_extract("content", HEADING, 1).try_cast("int")).filter("no is not null")
    h = h.withColumn("want", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")))
    return h.groupBy("doc_id").agg(F.count("*").alias("n_headings"), F.when(F.count("*") > 1, F.bool_and(F.col("no") == F.col("want"))).alias("consistent"))


class Grid(HTMLParser):
    """Cells of one table; anything not understood refuses the whole table."""

    KNOWN = {"table", "thead", "tbody", "tr", "td", "th", "br", "b", "i", "sup", "sub", "span", "p"}

    def __init__(self):
        super().__init__()
        self.rows, self.open, self.tables, self.bad = [], None, 0, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.bad |= tag not in self.KNOWN
        if tag == "table":
            self.tables += 1
            self.bad |= self.tables > 1
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            spans = [a.get(k, "1") for k in ("rowspan", "colspan")]
            if not self.rows or not all(s.isdigit() and 0 < int(s) <= 200 for s in spans):
                self.bad = True
            else:
                self.open = [int(spans[0]), int(spans[1]), ""]
                self.rows[-1].append(self.open)

    def handle_data(self, data):
        if self.open is not None:
            self.open[2] += data

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = None


def parse_grid(html: str | None) -> list[dict] | None:
    g = Grid()
    g.feed(html or "")
    if g.bad or not g.rows:
        return None
    taken, out = set(), []
    for r, row in enumerate(g.rows):
        c = 0
        for rs, cs, text in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + j) for i in range(rs) for j in range(cs)}
            out.append({"r": r, "c": c, "rs": rs, "cs": cs, "t": text.strip()})
            c += cs
    width, height = 1 + max(c for _, c in taken), 1 + max(r for r, _ in taken)
    return out if len(taken) == width * height else None


def html_grid(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row per cell (key, r, c, rs, cs, t); tables that are nested, have holes or odd spans give no rows."""

    @F.pandas_udf("array<struct<r: int, c: int, rs: int, cs: int, t: string>>")
    def cells(s: pd.Series) -> pd.Series:
        return s.map(parse_grid)

    return pages.select(key, F.inline(cells(F.col(html))))


def period_of_path(path):
    """The one explicit period of a header path, null where it names none or several, or only a relative one."""
    found = F.array_distinct(F.regexp_extract_all(path, F.lit(r"(20[0-9]{2}(?:Q[1-4]|FY))"), 1))
    return F.when(F.size(found) == 1, found[0])
