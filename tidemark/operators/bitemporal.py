"""Point-in-time reads and checks over append-only tables with known_at and superseded_at."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingAsOf(ValueError):
    """A read without an instant, or with one that names no time zone."""


def require_as_of(as_of: datetime | None) -> datetime:
    if as_of is None:
        raise MissingAsOf("every read names the instant it is asked from")
    if as_of.tzinfo is None:
        raise MissingAsOf("the instant needs a time zone")
    return as_of.astimezone(timezone.utc)


@dataclass(frozen=True)
class Session:
    """What a read is bound to. Tables are only reached through it, so no read forgets its instant."""

    as_of: datetime
    tenant: str | None = None
    user: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "as_of", require_as_of(self.as_of))

    @property
    def instant(self) -> Column:
        return F.lit(self.as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")

    def table(self, df: DataFrame) -> DataFrame:
        df = df.filter(visible(self.instant))
        return df.filter(owner_visible(self.tenant, self.user)) if "owner_tenant" in df.columns else df


def visible(t: Column) -> Column:
    """Left-closed, right-open: known by t and not yet superseded. Never looks at when a row was loaded."""
    return (F.col("known_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t))


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def asof(df: DataFrame, t: Column) -> DataFrame:
    return df.filter(visible(t))


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("superseded_at").isNull())


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many are too many."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def owner_visible(tenant: str | None, user: str | None) -> Column:
    """Inclusive: public rows, those of my tenant without a user, and mine."""
    public = F.col("owner_tenant").isNull() & F.col("owner_user").isNull()
    mine = F.col("owner_user") == F.lit(user) if user is not None else F.lit(False)
    ours = (F.col("owner_tenant") == F.lit(tenant)) & F.col("owner_user").isNull() if tenant is not None else F.lit(False)
    return public | F.coalesce(ours, F.lit(False)) | F.coalesce(mine, F.lit(False))


def owner_exact(tenant: str | None, user: str | None) -> Column:
    """Exact: both owners equal to the caller's, null equal to null."""
    return F.col("owner_tenant").eqNullSafe(F.lit(tenant)) & F.col("owner_user").eqNullSafe(F.lit(user))


def optional(column: str, value) -> Column:
    """No filter where the parameter is null."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def fallback(requests: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """The policy of each request: of its own key, else the wildcard's (null key); of several the newest, then the highest id.

    Two equi-joins of one best row per key, in place of one join on `key = x or key is null`, which no hash join can do.
    """
    best = latest(policies, [key], F.desc("known_at"), F.desc("policy_id"))
    own = best.filter(F.col(key).isNotNull()).select(key, F.col("policy_id").alias("own_id"), F.col("tier").alias("own_tier"))
    wild = best.filter(F.col(key).isNull()).select(F.col("policy_id").alias("wild_id"), F.col("tier").alias("wild_tier"), F.lit(1).alias("_one"))
    r = requests.join(own, key, "left").withColumn("_one", F.lit(1)).join(wild, "_one", "left").drop("_one")
    return r.withColumns({"policy_id": F.coalesce("own_id", "wild_id"), "tier": F.coalesce("own_tier", "wild_tier")}).drop("own_id", "wild_id", "own_tier", "wild_tier")


def first_disclosure(periods: DataFrame, directory: DataFrame, include: str, exclude: str, months: int = 15) -> DataFrame:
    """Earliest known_at of a directory row whose title names a report, published in (period_end, period_end + months]; superseded rows count.

    Rows meet periods by slot and month, of which a period has months + 1, so neither a slot nor a range is one task.
    """
    month = lambda c: F.trunc(c, "month")
    rows = directory.filter(F.col("title").rlike(include) & ~F.col("title").rlike(exclude)).select("slot", "publish_date", "known_at", "page_id", month("publish_date").alias("_m"))
    asked = periods.select("slot", "period_end", F.explode(F.sequence(month("period_end"), month(F.add_months("period_end", months)), F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    met = asked.join(rows, ["slot", "_m"]).filter((F.col("publish_date") > F.col("period_end")) & (F.col("publish_date") <= F.add_months("period_end", months)))
    first = met.groupBy("slot", "period_end").agg(F.min(F.struct("known_at", "page_id")).alias("x"))
    return periods.select("slot", "period_end").distinct().join(first, ["slot", "period_end"], "left").select("slot", "period_end", F.col("x.page_id").alias("page_id"), F.col("x.known_at").alias("known_at"))


def trading_day(prices: DataFrame, t: Column) -> DataFrame:
    """Latest trading day known at t on which the entity wasn't suspended."""
    return prices.filter((F.col("known_at") <= t) & ~F.col("is_suspended")).groupBy("entity").agg(F.max("trade_date").alias("trade_date"))


def leak_checks(facts: DataFrame, probe: Column) -> DataFrame:
    """(check, n): facts known before their period ended, superseded before known, and keys with several versions at one instant."""
    checks = [
        facts.filter(F.col("known_at").cast("date") < F.col("period_end")).agg(F.count("*").alias("n")).withColumn("check", F.lit("known_before_period_end")),
        facts.filter(F.col("superseded_at") <= F.col("known_at")).agg(F.count("*").alias("n")).withColumn("check", F.lit("superseded_before_known")),
        duplicates(asof(facts, probe), ["entity", "metric", "period"]).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n")).withColumn("check", F.lit("several_at_probe")),
    ]
    return reduce(DataFrame.unionByName, checks).select("check", "n")


def replay_hash(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """sha256 of id, content and known_at of each block at each of its probe instants, ABSENT where it isn't visible. superseded_at is no part of it."""
    b = blocks.join(probes, "block_id")
    seen = (F.col("known_at") <= F.col("probe")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("probe")))
    digest = F.sha2(F.concat_ws("|", F.col("block_id").cast("string"), "content", F.date_format("known_at", "yyyy-MM-dd HH:mm:ss")), 256)
    return b.select("block_id", "probe", F.when(seen, digest).otherwise("ABSENT").alias("hash"))


def freeze_diff(df: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """(key, change): visible at the second instant only (added) or at the first only (removed)."""
    a, b = asof(df, before).select(key).distinct(), asof(df, after).select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def known_at(kind: str, day: Column) -> Column:
    """When a row of a day-precise source could be known, in UTC; local days are at +08:00."""
    rules = {"announcement": "23 HOURS 59 MINUTES 59.999999 SECONDS", "fundamentals": "23 HOURS 59 MINUTES 59 SECONDS", "price": "15 HOURS 30 MINUTES", "fixing": "9 HOURS 15 MINUTES", "manual": "0 HOURS"}
    return day.cast("timestamp_ntz").cast("timestamp") + F.expr(f"INTERVAL {rules[kind]}") - F.expr("INTERVAL 8 HOURS")
