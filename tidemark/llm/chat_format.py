"""Preference formatting: the longest common turn prefix of two conversations is the prompt, the rests are masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = "pair_id long, side int, conv_id long, low long, high long, shift long"


def escaped(text: Column) -> Column:
    """`<|` with a backslash inside, and one more where `<` and backslashes stand already, so that every text can be told from every other; null is empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def opening(role: Column) -> Column:
    """A turn's first line. A role can't end it early or begin another: `|>` gets a backslash as well, line ends are written as \\n and \\r."""
    r = F.replace(escaped(role), F.lit("|>"), F.lit("|\\>"))
    return F.concat(F.lit("<|"), F.replace(F.replace(r, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("|>\n"))


def body(text: Column) -> Column:
    """A turn's text and its end. No text can pass for the opening of a turn."""
    return F.concat(escaped(text), F.lit("\n"))


def pairs_by_neighbour(conversations: DataFrame) -> DataFrame:
    """Sides of conversation 2k against 2k + 1, where both are there."""
    ids = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n"))
    both = ids.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).filter("a <> b")
    whole = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("conv_id"))
    s = both.select("pair_id", F.explode(F.array(whole(0, "a"), whole(1, "b"))).alias("s")).select("pair_id", "s.*")
    return s.select("*", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit(0).cast("long").alias("shift"))


def pairs_by_other_answer(conversations: DataFrame) -> DataFrame:
    """Sides of each conversation k as it is against itself up to its last assistant turn, which is answered by conversation k + 1's last one.

    A pair for each k where both have an assistant turn. What follows the last assistant turn belongs to the chosen side only.
    """
    last = conversations.filter("conv_id is not null and turn is not null and role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("at"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("conv_id").alias("other"), F.col("at").alias("other_at"))
    p = last.join(other, "conv_id")
    side = lambda n, c, low, high, shift: F.struct(F.lit(n).alias("side"), c.alias("conv_id"), low.cast("long").alias("low"), high.cast("long").alias("high"), shift.cast("long").alias("shift"))
    none, own, at, there = F.lit(None), F.col("conv_id"), F.col("at"), F.col("other_at")
    s = F.array(side(0, own, none, none, F.lit(0)), side(1, own, none, at - 1, F.lit(0)), side(1, F.col("other"), there, there, at - there))
    return p.select(own.alias("pair_id"), F.explode(s).alias("s")).select("pair_id", "s.*")


def format_preferences(conversations: DataFrame, sides: DataFrame) -> DataFrame:
    """A row per pair: pair_id, n_prefix turns shared, prompt, chosen, chosen_mask, rejected, rejected_mask.

    sides(pair_id, side, conv_id, low, high, shift) says what a pair compares: side 0, the chosen one, and side 1 are made of turns low to
    high (null: from the first, to the last) of one or several conversations, with their numbers moved by shift. Turns
    are equal when number, role and text are (nulls are equal to nulls); the prefix ends before the first turn that
    differs or that one side lacks. A mask names the characters of its completion to be trained on: from-to (the latter left out) of each
    assistant turn's text and end, comma-joined, and empty where there are none. A pair of equal sides has empty
    completions. Rows without conv_id or turn are left out; of several rows with one number the least by role and text counts;
    other columns are not read; no conversations or no pairs give no rows.

    Texts are shuffled by conversation and by pair (a turn that both sides have goes once), and only a pair's own
    turns ever meet, as the result holds them in one row.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").filter("conv_id is not null and turn is not null")
    s = sides.groupBy("conv_id", "pair_id").agg(F.collect_list(F.struct("side", "low", "high", "shift")).alias("s"))
    inside = F.filter("s", lambda x: (F.col("turn") >= F.coalesce(x["low"], F.col("turn"))) & (F.col("turn") <= F.coalesce(x["high"], F.col("turn"))))
    rows = c.join(s, "conv_id").withColumn("s", inside)
    rows = rows.select("pair_id", "role", "text", "s", "turn", F.explode(F.array_distinct(F.transform("s", lambda x: F.col("turn") + x["shift"]))).alias("at"))
    has = lambda side: F.exists("s", lambda x: (x["side"] == side) & (F.col("turn") + x["shift"] == F.col("at")))
    rows = rows.select("pair_id", "at", "role", "text", has(0).alias("in_a"), has(1).alias("in_b")).repartition("pair_id")
    both = rows.groupBy("pair_id", "at").agg(F.min(F.when(F.col("in_a"), F.struct("role", "text"))).alias("a"), F.min(F.when(F.col("in_b"), F.struct("role", "text"))).alias("b"))
    upto = Window.partitionBy("pair_id").orderBy("at")
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))
    both = both.withColumn("shared", F.min(same).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    for x in ("a", "b"):
        head, rest = opening(F.col(x)["role"]), body(F.col(x)["text"])
        both = both.withColumns({f"head_{x}": F.when(F.col(x).isNotNull(), F.length(head)), f"full_{x}": F.when(F.col(x).isNotNull(), F.concat(head, rest))})
        before = F.coalesce(F.sum(F.when(~F.col("shared"), F.length(f"full_{x}"))).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        trained = F.when(~F.col("shared") & F.col(x)["role"].eqNullSafe("assistant"), F.concat((before + F.col(f"head_{x}")).cast("string"), F.lit("-"), (before + F.length(f"full_{x}")).cast("string")))
        both = both.withColumn(f"mask_{x}", trained)

    def joined(value: Column, sep: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("at"), value.alias("v")))))
        return F.array_join(F.transform(parts, lambda x: x["v"]), sep)

    text = lambda x: F.when(~F.col("shared"), F.col(f"full_{x}"))
    return both.groupBy("pair_id").agg(
        F.count_if("shared").cast("long").alias("n_prefix"), joined(F.when(F.col("shared"), F.col("full_a")), "").alias("prompt"),
        joined(text("a"), "").alias("chosen"), joined(F.col("mask_a"), ",").alias("chosen_mask"), joined(text("b"), "").alias("rejected"), joined(F.col("mask_b"), ",").alias("rejected_mask"),
    )
