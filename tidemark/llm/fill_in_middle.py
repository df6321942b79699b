"""Fill-in-middle: texts cut at two units drawn from the id, by two passes of a lazy matcher that never holds the units."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
#: Rows leave a task once their texts have about so many characters.
BATCH_CHARS = 4_000_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the seed and the id alone. A null id counts as ''."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def count_units(unit: re.Pattern, text: str) -> int:
    """First pass: how many units there are."""
    return sum(1 for _ in unit.finditer(text))


def unit_ends(unit: re.Pattern, text: str, ranks: list[int]) -> list[int]:
    """Second pass: where the units of the given ascending ranks end (rank 0: 0), by one iterator that stops at the last."""
    matches, seen, at, out = unit.finditer(text), 0, 0, []
    for rank in ranks:
        if rank > seen:
            at = next(islice(matches, rank - seen - 1, None)).end()
            seen = rank
        out.append(at)
    return out


def transformed(text: str, doc_id: int | None, unit: re.Pattern, seed: int, fim_percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = count_units(unit, text)
    h = draws(seed, doc_id)
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    first, second = unit_ends(unit, text, sorted([h[0] % (n + 1), h[1] % (n + 1)]))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = sentinels
    if h[3] % 100 < spm_percent:
        return n, "spm", first, second - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", first, second - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs, without a shuffle.

    A text has n units (matches of `unit`, from left to right). The prefix ends after the smaller of two ranks drawn from the id, the middle
    after the larger, the suffix is the rest; output is prefix, suffix, middle (psm) or suffix, prefix, middle (spm) behind their
    sentinels. It is the text itself (plain) where that is empty, holds a sentinel, or the draw leaves it out of fim_percent. No sentinel may
    begin as another one ends, or restored() would be ambiguous.

    A null text counts as empty and is plain; a null id draws as ''. Texts are read whole at any length: beside a text and its output a task
    holds the places of two units only. Rows that tie or repeat are treated alike and all come back; extra columns are not read, whatever
    their names; no documents give no rows.
    """
    for a in sentinels:
        if not a or any(a in b or b.startswith(a[-k:]) for b in sentinels if b != a for k in range(1, len(a))) or any(a.startswith(a[-k:]) for k in range(1, len(a))):
            raise ValueError("sentinels must not be empty, hold or overlap one another")
    compiled = re.compile(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                i, t = i.as_py(), t.as_py() or ""
                rows.append((i, *transformed(t, i, compiled, seed, fim_percent, spm_percent, sentinels)))
                chars += len(t)
                if chars >= BATCH_CHARS:
                    yield packed(rows)
                    rows, chars = [], 0
        if rows:
            yield packed(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DDL)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from. Its parts hold no sentinel, so the first of each kind is the one that was set."""
    p, s, m = sentinels

    def parts(opening: str, between: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(opening) + 1))
        first = F.substring_index(body, between, 1)
        rest = F.substr(body, F.length(first) + len(between) + 1)
        second = F.substring_index(rest, m, 1)
        return first, second, F.substr(rest, F.length(second) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): the outputs by their digests, and those of the texts rebuilt from them."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
