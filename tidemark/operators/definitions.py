"""Versioned definitions, field maps and documents: reads as of an instant, and writes as outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitemporal import asof, live


def definition_asof(versions: DataFrame, t: Column, key: str) -> DataFrame:
    """The version of each definition that held at t; of several the highest. Keys without one give no row."""
    v = asof(versions, t)
    return v.groupBy(key).agg(F.max_by(F.struct(*[c for c in v.columns if c != key]), "version").alias("x")).select(key, "x.*")


def maps_asof(maps: DataFrame, t: Column, key: str) -> DataFrame:
    """The field maps of each definition that held at t, with their place by priority, provider and field."""
    w = Window.partitionBy(key).orderBy("priority", "provider", "field")
    return asof(maps, t).withColumn("place", F.row_number().over(w))


def scaled_facts(facts: DataFrame, maps: DataFrame) -> DataFrame:
    """facts(provider, field, value, ...) in the system's units: value times the scale of the live map of least priority; facts without one are `unknown_field`."""
    best = live(maps).groupBy("provider", "field").agg(F.min_by(F.struct("metric", "scale"), F.struct("priority", "metric", "scale")).alias("m")).select("provider", "field", "m.*")
    d = facts.join(best, ["provider", "field"], "left")
    return d.withColumns({"scaled": F.col("value") * F.col("scale"), "outcome": F.when(F.col("metric").isNull(), "unknown_field").otherwise("mapped")}).drop("scale")


def retire_outcomes(asked: DataFrame, versions: DataFrame, maps: DataFrame, key: str) -> DataFrame:
    """asked(key, known_at) with outcome: refused where a live map points at the definition, not_live, out_of_order (known no later than the live version), or retired."""
    v = live(versions).groupBy(key).agg(F.max("known_at").alias("_live"))
    m = live(maps).select(key).distinct().withColumn("_mapped", F.lit(True))
    d = asked.join(v, key, "left").join(m, key, "left")
    outcome = F.when(F.col("_mapped"), "refused").when(F.col("_live").isNull(), "not_live").when(F.col("known_at") <= F.col("_live"), "out_of_order").otherwise("retired")
    return d.withColumn("outcome", outcome).drop("_live", "_mapped")


def document_outcomes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(doc, source, hash, provider_id, corrects) with outcome and group.

    A text that is live in its source is skipped, with the live document's group; so are its repeats within the batch, but for the first. A correction whose
    predecessor is live by provider id is a new_version of its group; any other document is created, its own group.
    """
    alive = live(current)
    same = alive.groupBy("source", "hash").agg(F.min("group").alias("_same"))
    before = alive.groupBy("source", F.col("provider_id").alias("corrects")).agg(F.max_by("group", "known_at").alias("_group"))
    turn = F.row_number().over(Window.partitionBy("source", "hash").orderBy("doc"))
    first = F.first("doc").over(Window.partitionBy("source", "hash").orderBy("doc"))
    d = incoming.withColumns({"_turn": turn, "_first": first}).join(same, ["source", "hash"], "left").join(before, ["source", "corrects"], "left")
    outcome = F.when(F.col("_same").isNotNull() | (F.col("_turn") > 1), "skipped").when(F.col("_group").isNotNull(), "new_version").otherwise("created")
    return d.withColumns({"outcome": outcome, "group": F.coalesce("_same", "_group", "_first")}).select(*[c for c in incoming.columns if c != "group"], "outcome", "group")


def reparse_state(current: DataFrame, parsed: DataFrame, now: Column) -> DataFrame:
    """The documents after parsed(doc, hash) were parsed anew: the old row closes at now, the new one keeps its known_at, group and owner."""
    p = parsed.select("doc", F.col("hash").alias("_hash"))
    d = current.join(p, "doc", "left")
    again = F.col("_hash").isNotNull() & F.col("superseded_at").isNull()
    kept = d.withColumn("superseded_at", F.when(again, now).otherwise(F.col("superseded_at"))).drop("_hash")
    new = d.filter(again).withColumns({"hash": F.col("_hash"), "superseded_at": F.lit(None).cast("timestamp")}).drop("_hash")
    return kept.unionByName(new)


def carry_over(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, new_id, old_id, how) of new(keys, page, ordinal, new_id) against old(keys, page, ordinal, old_id): what each new block takes over from one old block, which no other takes.

    Blocks of equal keys (document and text) meet in order of their ordinals, on the same page first, then what is left wherever it is.
    """
    o = old.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "page").orderBy("ordinal")))
    n = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "page").orderBy("ordinal")))
    j = n.select(*keys, "page", "_n", "new_id", F.col("ordinal").alias("_new")).join(o.select(*keys, "page", "_n", "old_id", F.col("ordinal").alias("_old")), [*keys, "page", "_n"], "full")
    left = F.col("old_id").isNull() | F.col("new_id").isNull()
    place = lambda i, at: F.when(left & F.col(i).isNotNull(), F.row_number().over(Window.partitionBy(*keys, left, F.col(i).isNotNull()).orderBy(at)))
    j = j.withColumns({"_a": place("new_id", "_new"), "_b": place("old_id", "_old")})
    rest = j.filter(F.col("_b").isNotNull()).select(*keys, F.col("_b").alias("_a"), F.col("old_id").alias("_other"))
    d = j.filter("new_id is not null").join(rest, [*keys, "_a"], "left")
    return d.select(*keys, "new_id", F.coalesce("old_id", "_other").alias("old_id"), F.when(F.col("old_id").isNotNull(), "same_page").when(F.col("_other").isNotNull(), "other_page").otherwise("none").alias("how"))


def fetch_from(cursor: Column, floor: Column, backfill: Column) -> Column:
    """First day to fetch: the day after the cursor, the start of the backfill where there is none or where what was ever fetched begins after it."""
    return F.when(cursor.isNull(), backfill).when(floor.isNull() | (floor > backfill), F.least(F.date_add(cursor, 1), backfill)).otherwise(F.date_add(cursor, 1))


def half_years(spans: DataFrame, days: int = 183) -> DataFrame:
    """spans(first, last) cut into windows of at most `days` days: a row per window."""
    starts = F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {days} DAYS"))).alias("window_from")
    return spans.select("*", starts).withColumn("window_to", F.least(F.date_add("window_from", days - 1), "last"))


def backlog_order(docs: DataFrame, tiers: list[str], partition: str) -> DataFrame:
    """docs(tier, publish_at, doc_id) with their place in a partition's backlog: by the tiers' order, newest first, then by id. A tier that isn't listed is an error.

    Rows are counted by tier and day; a place is what stands on the days before, and the row's number on its own day, so no partition is sorted in one task.
    """
    rank = F.map_from_arrays(F.array(*[F.lit(t) for t in tiers]), F.array(*[F.lit(i) for i in range(len(tiers))]))
    known = F.coalesce(rank[F.col("tier")], F.raise_error(F.concat(F.lit("no priority for tier "), "tier")).cast("int"))
    cell = [partition, "_tier", "_day"]
    d = docs.withColumns({"_tier": known, "_day": F.coalesce(F.to_date("publish_at"), F.lit("0001-01-01").cast("date"))})
    days = d.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(partition).orderBy("_tier", F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*cell, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("publish_at"), "doc_id"))
    return d.withColumn("_own", own).join(days, cell).withColumn("place", (F.col("_before") + F.col("_own")).cast("int")).select(*docs.columns, "place")


def collection_name(owner: Column, prefix: str = "doc_block_u_", size: int = 512) -> Column:
    """A name of letters, digits, dots, lines and dashes for each owner, told apart by 16 digits of a hash; `size` characters at most."""
    middle = F.substring(F.regexp_replace(owner, "[^a-zA-Z0-9._-]", "-"), 1, size - len(prefix) - 17)
    return F.concat(F.lit(prefix), middle, F.lit("_"), F.substring(F.sha2(owner, 256), 1, 16))
