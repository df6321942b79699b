"""Derivations over period-labelled facts: by label, never by offset, and null with a reason where the rule refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["entity", "metric"]
STOCK_METRICS = ("MACHINERY",)


def year_of(period: Column) -> Column:
    return F.regexp_extract(period, r"^([0-9]{4})(Q[1-4]|FY)$", 1).try_cast("int")


def quarter_of(period: Column) -> Column:
    label = F.regexp_extract(period, r"^[0-9]{4}(Q[1-4]|FY)$", 1)
    return F.when(label == "FY", 4).otherwise(F.substring(label, 2, 1).try_cast("int"))


def label(y: Column, q: Column) -> Column:
    return F.when(q == 4, F.concat(y.cast("string"), F.lit("FY"))).otherwise(F.concat(y.cast("string"), F.lit("Q"), q.cast("string")))


def same_period_last_year(period: Column) -> Column:
    return label(year_of(period) - 1, quarter_of(period))


def previous_quarter(period: Column) -> Column:
    y, q = year_of(period), quarter_of(period)
    return F.when(q == 1, label(y - 1, F.lit(4))).otherwise(label(y, q - 1))


def growth(value: Column, base: Column, unit: Column, base_unit: Column) -> tuple[Column, Column]:
    """(growth, note); the refusals are checked in this order."""
    note = F.when(base.isNull() | value.isNull(), "missing_base").when(~unit.eqNullSafe(base_unit), "unit_mismatch").when(base == 0, "zero_base").when(base < 0, "negative_base")
    return F.when(note.isNull(), F.round(value.cast("double") / base.cast("double") - 1, 6)), note


def with_base(facts: DataFrame, base: DataFrame, base_period: Column) -> DataFrame:
    b = base.select(*KEYS, F.col("period").alias("_base"), F.col("value").alias("base_value"), F.col("unit").alias("base_unit"))
    return facts.withColumn("_base", base_period).join(b, [*KEYS, "_base"], "left").drop("_base")


def yoy(facts: DataFrame) -> DataFrame:
    d = with_base(facts, facts, same_period_last_year(F.col("period")))
    g, note = growth(F.col("value"), F.col("base_value"), F.col("unit"), F.col("base_unit"))
    return d.select(*KEYS, "period", g.alias("yoy"), note.alias("note"))


def single_quarter(facts: DataFrame) -> DataFrame:
    """Cumulative amounts to those of the quarter alone: Q1 as it is, else less the previous quarter's, in the same unit."""
    d = with_base(facts, facts, previous_quarter(F.col("period")))
    q = quarter_of(F.col("period"))
    value = F.when(q == 1, F.col("value")).when(F.col("unit").eqNullSafe(F.col("base_unit")), F.col("value") - F.col("base_value"))
    return d.select(*KEYS, "period", value.alias("value"), "unit")


def qoq(facts: DataFrame) -> DataFrame:
    """Flow metrics compare single quarters, stock metrics the amounts at period end; a base of 0 or less is refused."""
    flow = single_quarter(facts.filter(~F.col("metric").isin(*STOCK_METRICS)))
    d = flow.unionByName(facts.filter(F.col("metric").isin(*STOCK_METRICS)).select(*KEYS, "period", "value", "unit"))
    d = with_base(d, d, previous_quarter(F.col("period")))
    g, note = growth(F.col("value"), F.col("base_value"), F.col("unit"), F.col("base_unit"))
    return d.select(*KEYS, "period", g.alias("qoq"), note.alias("note"))


def ttm(facts: DataFrame) -> DataFrame:
    """A full year is itself; else last full year + this year so far - last year so far; stock metrics are refused."""
    y, q = year_of(F.col("period")), quarter_of(F.col("period"))
    d = with_base(facts, facts, same_period_last_year(F.col("period"))).withColumnsRenamed({"base_value": "same_value", "base_unit": "same_unit"})
    d = with_base(d, facts, label(y - 1, F.lit(4)))
    whole = q == 4
    note = F.when(F.col("metric").isin(*STOCK_METRICS), "stock_metric").when(~whole & (F.col("base_value").isNull() | F.col("same_value").isNull()), "missing_base")
    note = note.when(~whole & (~F.col("unit").eqNullSafe(F.col("base_unit")) | ~F.col("unit").eqNullSafe(F.col("same_unit"))), "unit_mismatch")
    value = F.when(whole, F.col("value")).otherwise(F.col("value") + F.col("base_value") - F.col("same_value"))
    return d.select(*KEYS, "period", F.when(note.isNull(), value.cast("double")).alias("ttm"), note.alias("note"))


def rate_asof(requests: DataFrame, rates: DataFrame, days: int = 7) -> DataFrame:
    """Backward as-of join: the last rate on or before each request's day, null with a note where it is older than `days`.

    Rates and requests are merged per base and day, and the last rate carried forward: one shuffle, no range join. Bases are
    currencies, so a window is a currency's calendar; requests are reduced to distinct days before it.
    """
    days_asked = requests.select("base", F.col("on_day").alias("day")).distinct().withColumns({"rate": F.lit(None).cast("decimal(18,4)"), "asked": F.lit(1)})
    merged = rates.select("base", F.col("rate_date").alias("day"), "rate", F.lit(0).alias("asked")).unionByName(days_asked)
    w = Window.partitionBy("base").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = merged.withColumns({"r": F.last("rate", ignorenulls=True).over(w), "d": F.last(F.when(F.col("asked") == 0, F.col("day")), ignorenulls=True).over(w)}).filter("asked = 1")
    note = F.when(F.col("d").isNull(), "no_rate").when(F.datediff("day", "d") > days, "stale_rate")
    m = m.select("base", F.col("day").alias("on_day"), F.col("d").alias("rate_date"), F.when(note.isNull(), F.col("r")).alias("rate"), note.alias("note"))
    return requests.join(m, ["base", "on_day"])


def cross_rate(requests: DataFrame, rates: DataFrame, days: int = 7) -> DataFrame:
    """Two hops through the pivot currency; the same currency is 1."""
    a = rate_asof(requests.select("base", "quote", "on_day"), rates, days).select("base", "quote", "on_day", F.col("rate").alias("base_rate"), F.col("note").alias("base_note"))
    q = rate_asof(a.select(F.col("quote").alias("base"), "on_day").distinct(), rates, days).select(F.col("base").alias("quote"), "on_day", F.col("rate").alias("quote_rate"), F.col("note").alias("quote_note"))
    same = F.col("base") == F.col("quote")
    d = a.join(q, ["quote", "on_day"], "left")
    note = F.when(~same, F.coalesce("base_note", "quote_note"))
    return d.select("base", "quote", "on_day", F.when(same, F.lit(1.0)).when(note.isNull(), F.col("base_rate").cast("double") / F.col("quote_rate").cast("double")).alias("rate"), note.alias("note"))


def normalise_quote(pair: Column, rate: Column) -> tuple[Column, Column]:
    """`100JPY/CNY` is per hundred; `CNY/KRW` becomes KRW/CNY; 12 places, half to even."""
    hundred, inverse = pair.startswith("100"), pair.startswith("CNY/")
    name = F.when(hundred, F.substring(pair, 4, 100)).when(inverse, F.concat(F.substring(pair, 5, 100), F.lit("/CNY"))).otherwise(pair)
    value = F.when(hundred, rate / 100).when(inverse, 1 / rate).otherwise(rate)
    return name, F.bround(value, 12)


def cumulative_or_single(columns: DataFrame) -> DataFrame:
    """Which of two columns is cumulative: columns(entity, metric, y, q, left, right). A hypothesis is accepted if it alone holds for all periods and was tested at least once."""
    w = Window.partitionBy(*KEYS, "y").orderBy("q")
    adjacent = F.lag("q").over(w) == F.col("q") - 1
    ok = lambda cum, one: F.when(F.col("q") == 1, F.col(cum) == F.col(one)).when(adjacent, F.col(cum) - F.lag(cum).over(w) == F.col(one))
    d = columns.withColumns({"h1": ok("left", "right"), "h2": ok("right", "left"), "tested": (F.col("q") > 1) & adjacent})
    g = d.groupBy(*KEYS).agg(F.coalesce(F.bool_and("h1"), F.lit(False)).alias("a"), F.coalesce(F.bool_and("h2"), F.lit(False)).alias("b"), F.coalesce(F.bool_or("tested"), F.lit(False)).alias("t"))
    return g.select(*KEYS, F.when(F.col("t") & F.col("a") & ~F.col("b"), "left").when(F.col("t") & F.col("b") & ~F.col("a"), "right").alias("cumulative"))


def holders_consistency(holdings: DataFrame) -> DataFrame:
    """Per entity: ranks are 1..n, shares don't rise with rank, percentages sum to 100.1 at most."""
    w = Window.partitionBy("entity").orderBy("rank", "holder")
    d = holdings.withColumns({"rn": F.row_number().over(w), "before": F.lag("shares").over(w)})
    return d.groupBy("entity").agg(F.count("*").alias("n"), F.bool_and(F.col("rank") == F.col("rn")).alias("ranks_ok"), F.bool_and(F.col("before").isNull() | (F.col("shares") <= F.col("before"))).alias("monotone"), (F.round(F.sum("pct"), 6) <= 100.1).alias("sum_ok"))


def segment_reconcile(parts: DataFrame, totals: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Sum of an entity's segments against its total, relative; a missing total is a warning."""
    g = parts.groupBy("entity", "y").agg(F.sum("amount").alias("parts"))
    d = g.join(totals, ["entity", "y"], "left")
    gap = F.abs(F.col("parts").cast("double") - F.col("total").cast("double")) / F.abs(F.col("total").cast("double"))
    return d.select("entity", "y", F.when(F.col("total").isNull() | (F.col("total") == 0), "no_total").when(gap <= tolerance, "ok").otherwise("differs").alias("verdict"))


def event_dedup(events: DataFrame, hours: int = 24) -> DataFrame:
    """One master per entity, type and window of hours: the highest source rank, then the lowest id; the rest are counted as evidence."""
    w = F.window("ts", f"{hours} hours")
    g = events.withColumn("w", w).groupBy("user_id", "event_type", F.col("w.start").alias("start")).agg(F.min(F.struct(-F.col("rank"), F.col("event_id"))).alias("m"), F.count("*").alias("n"))
    return g.select("user_id", "event_type", "start", F.col("m.event_id").alias("master_id"), (F.col("n") - 1).alias("n_evidence"))


def quarter_ends(last: Column, n: int) -> Column:
    """The last n quarter ends up to a day."""
    first = F.trunc(last, "quarter")
    return F.transform(F.sequence(F.add_months(first, -3 * n), F.add_months(first, -3), F.expr("INTERVAL 3 MONTHS")), lambda d: F.last_day(F.add_months(d, 2)))


def full_years(periods: DataFrame, key: str) -> DataFrame:
    """(key, period_end): every quarter's end from the first quarter of the year of a key's first period to its last period, so that each single quarter has the one before to be checked against."""
    g = periods.filter("period_end is not null").groupBy(key).agg(F.min("period_end").alias("first"), F.max("period_end").alias("last"))
    march = F.make_date(F.year("first"), F.lit(3), F.lit(1))
    months = F.sequence(march, F.greatest(march, F.col("last")), F.expr("INTERVAL 3 MONTH"))  # a key whose periods all end before March has no quarter's end
    return g.select(key, "last", F.explode(months).alias("m")).select(key, F.last_day("m").alias("period_end"), "last").filter("period_end <= last").drop("last")
