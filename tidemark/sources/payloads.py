"""Provider payloads to rows: columnar JSON, parallel arrays, aligned tables, broken CSV, listings and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columnar_rows(raw: DataFrame, body: str, names: list[str]) -> DataFrame:
    """{fields: [...], items: [[...]]} to a row per item, columns found by the payload's own field order."""
    j = raw.select(F.from_json(body, "struct<fields: array<string>, items: array<array<string>>>").alias("j"))
    x = j.select(F.col("j.fields").alias("f"), F.explode("j.items").alias("item"))
    return x.select(*[F.element_at("item", F.array_position("f", n).cast("int")).alias(n) for n in names])


def parallel_rows(raw: DataFrame, body: str, types: dict[str, str], keep: list[str]) -> DataFrame:
    """{a: [...], b: [...]} to rows by position; arrays of unequal length are an error, not a shift."""
    schema = "struct<" + ", ".join(f"{n}: array<{t}>" for n, t in types.items()) + ">"
    j = raw.select(*keep, F.from_json(body, schema).alias("j"))
    sizes = [F.size(F.col(f"j.{n}")) for n in types]
    same = sizes[0] == sizes[-1]
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.arrays_zip(*[F.col(f"j.{n}") for n in types])
    return j.select(*keep, F.inline(F.when(same, zipped).otherwise(F.raise_error(F.lit("arrays of unequal length")).cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in types.items()) + ">>"))))


def align(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Two tables by key with what either lacks; a caller refuses the batch unless every state is ok."""
    j = a.join(b, keys, "full")
    return j.withColumn("state", F.when(F.col(left).isNull(), "left_missing").when(F.col(right).isNull(), "right_missing").otherwise("ok"))


def repaired_csv(lines: DataFrame, line: str, columns: int, at: int) -> DataFrame:
    """Lines whose field `at` holds unquoted commas: surplus fields are merged back into it."""
    p = F.split(line, ",")
    surplus = F.size(p) - columns
    merged = F.array(F.array_join(F.slice(p, F.lit(at + 1), surplus + 1), ","))
    head = F.slice(p, 1, at) if at else F.array().cast("array<string>")
    return lines.filter(F.size(p) >= columns).select(F.concat(head, merged, F.slice(p, F.lit(at + 2) + surplus, F.lit(columns - at - 1))).alias("fields"))


def listing_complete(rows: DataFrame, totals: DataFrame, key: str, ref: str) -> DataFrame:
    """Distinct references of a paged listing against the total that it reports itself."""
    g = rows.groupBy(key).agg(F.count_distinct(ref).alias("listed"))
    return g.join(totals, key).withColumn("complete", F.col("listed") == F.col("total"))


def snapshot(responses: DataFrame, body: str, limit: int) -> DataFrame:
    """Small bodies stay in the row, larger ones are kept by content hash."""
    small: Column = F.octet_length(body) <= limit
    return responses.withColumns({"kept": F.when(small, "inline").otherwise("blob"), "blob_ref": F.when(~small, F.sha2(body, 256))})
