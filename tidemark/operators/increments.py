"""Increments and the remaining rule checks: watermarks, gaps, routing, backlogs, drift, forward returns, remapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partition_end(ts: Column) -> Column:
    """The day whose window (end - 1 day, end] holds an instant: midnight belongs to the day that it ends."""
    return F.date_add(F.to_date(ts - F.expr("INTERVAL 1 MICROSECOND")), 1)


def watermark(cursors: DataFrame, partition: Column) -> DataFrame:
    """The last cursor of each source that isn't after the partition."""
    return cursors.filter(F.col("part") <= partition).groupBy("source").agg(F.max("part").alias("last_part"), F.max_by("cursor", "part").alias("cursor"))


def gap(marks: DataFrame, partition: Column) -> DataFrame:
    return marks.withColumn("gap_from", F.when(F.col("last_part") < partition, F.date_add("last_part", 1)))


def route(health: DataFrame, now: Column) -> DataFrame:
    """The first layer of each source that no cooldown blocks."""
    blocked = F.coalesce(F.col("blocked_until") > now, F.lit(False))
    return health.groupBy("source").agg(F.min(F.when(~blocked, F.col("layer"))).alias("layer"), F.count_if(blocked).alias("blocked"))


def backlog(gaps: DataFrame, covered: DataFrame) -> DataFrame:
    """Open gaps by scope since their earliest day; resolved where what is covered reaches back that far."""
    g = gaps.groupBy("scope").agg(F.min("day").alias("since"), F.count("*").alias("asked"))
    return g.join(covered, "scope", "left").select("scope", "since", "asked", F.coalesce(F.col("since") >= F.col("covered"), F.lit(False)).alias("resolved"))


def pending(rows: DataFrame, done: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows without a result, but for those whose content a done row shares (the cache serves them)."""
    cached = rows.join(done, key, "left_semi").select(digest).distinct()
    return rows.join(done, key, "left_anti").join(cached, digest, "left_anti").select(key, digest)


def missing(expected: DataFrame, have: DataFrame, key: str, day: str) -> DataFrame:
    """Days that any key has and this one lacks. Keys are currencies, a fixed few: their days are one array."""
    days = expected.select(day).distinct()
    keys = expected.agg(F.collect_set(key).alias("_keys"))
    every = days.crossJoin(F.broadcast(keys)).select(day, F.explode("_keys").alias(key))
    return every.join(have, [key, day], "left_anti")


def differing(child: DataFrame, parent: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n): copies on the child that differ from the parent's, null equal to null. One join for all fields."""
    p = parent.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    counts = child.join(p, key).agg(*[F.count_if(~F.col(f).eqNullSafe(F.col(f"_{f}"))).alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x")).select("x.*")


def forward_alpha(prices: DataFrame, days: int, least: int = 3) -> DataFrame:
    """Return over the next trading days less the equal-weight mean of all entities on that day, of `least` at least."""
    later = F.lead("close", days).over(Window.partitionBy("entity").orderBy("trade_date"))
    r = prices.withColumn("ret", F.round(later / F.col("close") - 1, 8).cast("decimal(20,8)")).filter("ret is not null")
    bench = r.groupBy("trade_date").agg((F.sum("ret").cast("double") / F.count("*")).alias("bench"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return r.join(bench, "trade_date").select("entity", "trade_date", F.round(F.col("ret").cast("double") - F.col("bench"), 6).alias("alpha"))


def supported(stated: Column, cited: Column, share: float = 0.005) -> Column:
    return F.abs(stated - cited) <= share * cited


def plain(markdown: Column) -> Column:
    """Comments out, breaks and tags to spaces."""
    steps = [("<!--[^>]*-->", ""), ("<br ?/?>", " "), ("<[^>]+>", " ")]
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, markdown)


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each old block's successor on its page: the same text, else one that holds it, else lost."""
    j = old.join(new, ["doc_id", "page"]).filter(F.col("content").contains(F.col("old")))
    r = F.when(F.col("content") == F.col("old"), 0).otherwise(1)
    best = j.groupBy("old_id").agg(F.min(F.struct(r.alias("r"), "new_id")).alias("x"))
    d = old.select("old_id").join(best, "old_id", "left")
    return d.select("old_id", F.col("x.new_id").alias("new_id"), F.when(F.col("x.r") == 0, "exact").when(F.col("x.r") == 1, "overlap").otherwise("lost").alias("state"))


def kind_of(labels: Column, kinds: dict[str, list[str]], least: int = 2) -> Column:
    """The first kind, in the order given, of which at least two labels are there."""
    out = F.lit(None).cast("string")
    for name, words in reversed(kinds.items()):
        out = F.when(F.size(F.array_intersect(labels, F.array(*map(F.lit, words)))) >= least, name).otherwise(out)
    return out
