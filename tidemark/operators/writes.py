"""Write-side planning: current table and incoming rows to outcomes, or to the table's whole next state. Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT_KEYS = ["entity", "metric", "period"]
EPSILON = 1e-9


def fact_outcomes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with outcome: inserted, skipped (same number), corrected, or out_of_order (changed, but known no later)."""
    live = current.filter("superseded_at is null").select(*FACT_KEYS, F.col("value").alias("_old"), F.col("known_at").alias("_known"))
    d = incoming.join(live, FACT_KEYS, "left")
    same = F.abs(F.col("_old").cast("double") - F.col("value").cast("double")) < EPSILON
    outcome = F.when(F.col("_old").isNull(), "inserted").when(same, "skipped").when(F.col("known_at") > F.col("_known"), "corrected").otherwise("out_of_order")
    return d.withColumn("outcome", outcome).drop("_old", "_known")


def fact_state(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after the write: a corrected row closes at its correction's known_at, so any instant sees one version."""
    o = fact_outcomes(current, incoming)
    closing = o.filter("outcome = 'corrected'").select(*FACT_KEYS, F.col("known_at").alias("_closed"))
    kept = current.join(closing, FACT_KEYS, "left").withColumn("superseded_at", F.coalesce("superseded_at", "_closed")).select(*FACT_KEYS, "value", "known_at", "superseded_at")
    new = o.filter("outcome in ('inserted', 'corrected')").select(*FACT_KEYS, "value", "known_at", F.lit(None).cast("timestamp").alias("superseded_at"))
    return kept.unionByName(new)


def price_outcomes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Prices compare closes only, and refuse an older known_at before they look for equality."""
    keys = ["entity", "trade_date"]
    live = current.select(*keys, F.col("close").alias("_old"), F.col("known_at").alias("_known"))
    d = incoming.join(live, keys, "left")
    outcome = F.when(F.col("_known").isNull(), "inserted").when(F.col("known_at") < F.col("_known"), "older_known_at").when(F.col("close") == F.col("_old"), "skipped").otherwise("corrected")
    return d.withColumn("outcome", outcome).drop("_old", "_known")


def batch_outcomes(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Batches compare as whole sets of rows per key: one differing row replaces all of them."""
    side = current.withColumn("_a", F.lit(1)).unionByName(incoming.withColumn("_a", F.lit(-1)))
    rows = side.groupBy(*current.columns).agg(F.sum("_a").alias("_a"))
    return rows.groupBy(*keys).agg(F.max(F.abs("_a")).alias("_d")).select(*keys, F.when(F.col("_d") == 0, "unchanged").otherwise("replaced").alias("outcome"))


def publish_outcomes(live: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """created, unchanged or new_version, null equal to null in every column."""
    old = live.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    d = incoming.join(old, key, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return d.select(key, F.when(F.col("_there").isNull(), "created").when(same, "unchanged").otherwise("new_version").alias("outcome"))


def sync(live: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to close (live, not wanted) and to open (wanted, not live)."""
    return live.join(wanted, keys, "left_anti").withColumn("action", F.lit("close")).unionByName(wanted.join(live, keys, "left_anti").withColumn("action", F.lit("open")))


def field_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of every field that changed."""
    b = after.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("old_value"), F.col(f"_{c}").alias("new_value")) for c in columns]))
    return before.join(b, key).select(key, x.alias("x")).select(key, "x.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def problems(rules: dict[str, Column]) -> Column:
    """Names of all broken rules, in their order. A rule that is null isn't broken."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def retry_queue(attempts: DataFrame, keys: list[str], ts: str, order: str, value: str) -> DataFrame:
    """One row per key after all upserts: the last value, the number of attempts, and a deadline that the first attempt fixed."""
    return attempts.groupBy(*keys).agg(
        F.max_by(value, F.struct(ts, order)).alias(value),
        F.max(ts).isNotNull().alias("present"),
        F.count("*").alias("attempts"),
        F.date_format(F.min(ts).cast("timestamp") + F.expr("INTERVAL 24 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("deadline"),
    )


def cascade(parent_superseded: Column, known: Column, now: Column) -> Column:
    """When a dependent row closes: with its parent if that closed after it was known, else now."""
    return F.when(parent_superseded > known, parent_superseded).otherwise(now)
