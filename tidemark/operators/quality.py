"""Gates, dashboards, budgets, reconciliation and evaluation metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import fold_sorted
from ..sources.shared import shared_folder, written


def rate(good: Column) -> Column:
    """Share of rows for which a condition holds; 1 for no rows."""
    return F.round(F.coalesce(F.count_if(good) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)), 6)


def gate(df: DataFrame, name: str, value: Column, threshold: float, higher: bool = True) -> DataFrame:
    d = df.agg(value.alias("value"))
    ok = F.col("value") >= threshold if higher else F.col("value") <= threshold
    return d.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), ok.alias("passed"))


CELLS = 1024


def ranked(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, r, value) for each row of ranks(keys, r): the r-th value of its key in order, exactly, without sorting anything but CELLS counts.

    Each round counts a key's values in CELLS cells between the bounds known so far (summed before the shuffle) and goes on with the
    bounds of the cell that holds the rank, until they are one value. Nulls are no values.
    """
    folder = shared_folder(rows.sparkSession)
    by = ["_k", *keys]
    v = rows.select(F.lit(0).alias("_k"), *keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    bounds = v.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state, turn = ranks.withColumn("_k", F.lit(0)).join(bounds, by).select(*by, "r", "lo", "hi", F.lit(0).cast("long").alias("below")), 0
    state = written(state, f"{folder}/bounds0")
    while state.filter("lo < hi").take(1):
        cell = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1)).alias("cell")
        j = v.join(state.filter("lo < hi"), by).filter("_v >= lo and _v <= hi")
        c = j.groupBy(*by, "r", "below", cell).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        c = c.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy(*by, "r").orderBy("cell"))).filter("upto >= r and upto - n < r")
        turn += 1
        state = written(state.filter("lo = hi").unionByName(c.select(*by, "r", "lo", "hi", (F.col("upto") - F.col("n")).alias("below"))), f"{folder}/bounds{turn}")
    return state.select(*keys, "r", F.col("lo").alias(value))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each named share): values at shares of the order, by linear interpolation; keys without values give no row, no keys at all one row."""
    n = rows.groupBy(*keys).agg(F.count(value).alias("n")).filter("n > 0").select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("h")) for k, q in shares.items()])).alias("x")).select(*keys, "x.*")
    asked = n.select(*keys, "name", "h", (F.floor("h") + 1).alias("r1"), (F.ceil("h") + 1).alias("r2"))
    got = ranked(rows, keys, value, asked.select(*keys, F.explode(F.array("r1", "r2")).alias("r")).distinct())
    side = lambda r, v: got.select(*keys, F.col("r").alias(r), F.col(value).alias(v))
    d = asked.join(side("r1", "a"), [*keys, "r1"]).join(side("r2", "b"), [*keys, "r2"])
    p = F.round(F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h")), 6)
    return d.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, p)).alias(k) for k in shares])


def nearest_rank(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The ceil(share * n)-th value in order, without interpolation."""
    r = F.greatest(F.ceil(F.lit(share) * F.count(value)), F.lit(1)).cast("long")
    return ranked(rows, keys, value, rows.groupBy(*keys).agg(r.alias("r"))).drop("r")


def budget_level(spent: Column, limit: Column, unknown: Column) -> Column:
    return F.when(spent / limit >= 1, "exceeded").when(spent / limit >= 0.8, "warn").when(unknown > 0, "unknown").otherwise("ok")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a share; without observations 0 to 1."""
    p = hits / n
    mid, spread, low = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n == 0, 0.0).otherwise(F.round((mid - spread) / low, 6)), F.when(n == 0, 1.0).otherwise(F.round((mid + spread) / low, 6))


def latest_metric(metrics: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """Latest observation per key up to an instant, so that a dashboard of the past doesn't know later ones."""
    d = metrics.filter(F.col("computed_at") <= by)
    g = d.groupBy(*keys).agg(F.max_by(F.struct("value", "computed_at", "source"), F.struct("computed_at", "source")).alias("x"))
    return g.select(*keys, "x.*")


def cooldown(alerts: DataFrame, hours: int = 6) -> DataFrame:
    """Alerts with suppressed: an unsuppressed one of the same key silences those within the hours that follow it.

    Which alerts silence depends on those before, so it is a fold over each key's alerts in order. Keys are cut at gaps of
    the cooldown or more first, where the fold starts anew whatever came before; a burst streams through its task with one instant as its state.
    """
    span = hours * 3600
    w = Window.partitionBy("key").orderBy("at", "event_id")
    d = alerts.withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("moment", F.col("at"))
    d = d.withColumn("burst", F.sum(F.coalesce((F.col("at") - F.lag("at").over(w) >= span).cast("int"), F.lit(1))).over(w))

    def start() -> Callable:
        last = None

        def step(at: int) -> bool:
            nonlocal last
            silent = last is not None and at - last < span
            last = last if silent else at
            return silent

        return step

    return fold_sorted(d, ["key", "burst"], ["at", "event_id"], "moment", "suppressed boolean", start).select("key", "event_id", "suppressed")


def stratified_sample(df: DataFrame, strata: str, key: str, n: int, least: int, seed: str) -> DataFrame:
    """n rows: `least` of every stratum, then one more of each in turn, rows in the order of a seeded hash.

    A stratum gives n rows at most, cut before the shuffle; the n first of all in order are a top-k, merged from those of the tasks.
    """
    r = F.row_number().over(Window.partitionBy(strata).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key))
    d = df.withColumn("turn", r).filter(F.col("turn") <= n)
    return d.orderBy(F.when(F.col("turn") <= least, 0).otherwise(F.col("turn")), "turn", strata).limit(n)


def quota_sample(df: DataFrame, strata: str, key: str, quota: int, seed: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(strata).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key))
    return df.withColumn("turn", r).filter(F.col("turn") <= quota)


def recall_mrr(gold: DataFrame, retrieved: DataFrame, key: str, k: int) -> DataFrame:
    """Per question: whether a gold row is among the k best, and the reciprocal of the best rank."""
    hit = retrieved.filter(F.col("rank") <= k).join(gold, ["qid", key], "left_semi").groupBy("qid").agg(F.min("rank").alias("best"))
    return gold.select("qid").distinct().join(hit, "qid", "left").select("qid", F.col("best").isNotNull().alias("hit"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("rr"))


def grouped(scores: DataFrame, group: str, least: int = 10) -> DataFrame:
    return scores.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr")).withColumn("gated", F.col("n") >= least)


def regression_gate(before: DataFrame, after: DataFrame, group: str, cases: float = 1.0) -> DataFrame:
    """A group may lose `cases` cases; groups of different size aren't comparable."""
    b = before.select(group, F.col("n").alias("n0"), F.col("recall").alias("r0"))
    j = after.join(b, group)
    verdict = F.when(F.col("n") != F.col("n0"), "incomparable").when(F.col("r0") - F.col("recall") <= cases / F.col("n") + 1e-9, "pass").otherwise("fail")
    return j.select(group, verdict.alias("verdict"))


def strict_prefix(df: DataFrame, key: str, order: list[str], cost: str, limit: float) -> DataFrame:
    """Rows of each key in order while their running cost stays within the limit."""
    return df.withColumn("used", F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= limit)


def baseline_gate(runs: DataFrame, suite: str, at: list[str], tolerance: float) -> DataFrame:
    """(suite, at, metric, value, baseline, passed) of runs(suite, at, metrics map): each metric against the latest earlier run of the suite that has it, less the tolerance; the first passes.

    A run never meets itself: the baseline ends before its row.
    """
    d = runs.select(suite, *at, F.explode("metrics").alias("metric", "value"))
    before = F.lag("value").over(Window.partitionBy(suite, "metric").orderBy(*at))
    d = d.withColumn("baseline", before)
    return d.withColumn("passed", F.col("baseline").isNull() | (F.col("value") >= F.col("baseline") - tolerance))
