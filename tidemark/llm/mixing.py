"""Mixing sources to target weights: budgets run down a domain-language-source tree, leaves give token prefixes of seeded epochs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = ("domain", "lang", "source")
BUCKETS = 256


def words(text: Column) -> Column:
    """Tokens of a text as budgets count them: runs without white space; 1 at least, so that every row costs something."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\s]+")), F.lit(1)).cast("long")


def fill(children: DataFrame, parents: list[str], node: str) -> DataFrame:
    """Splits each parent's budget over its children by weight, none above its capacity: (parents, node, weight, capacity, budget) to the same with `given`.

    What a full child can't take goes to its siblings by their weights. In order of capacity per weight, a child is full
    as long as its share of what is left exceeds its capacity; the rest share by weight. Budget beyond all
    capacities stays unplaced, so a caller that caps the parent's budget by the sum of capacities has siblings
    serve before its own siblings do.
    """
    w = Window.partitionBy(*parents, "_one").orderBy(F.col("capacity") / F.col("weight"), node)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    d = children.withColumn("_one", F.lit(1)).withColumn("_level", level)
    d = d.withColumn("_cut", F.max(F.when(F.col("capacity") / F.col("weight") > F.col("_level"), F.col("_level"))).over(Window.partitionBy(*parents, "_one")))
    d = d.withColumn("given", F.when(F.col("_cut").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.col("weight") * F.col("_cut"))))
    return d.drop("_one", "_level", "_cut")


def budgets(leaves: DataFrame, weights: DataFrame, budget: float | None, max_epochs: int) -> DataFrame:
    """(domain, lang, source, available, given): leaves(…, available tokens), weights(level, name, weight) and the whole budget.

    A node's weight is looked up by level and name, 1.0 where it has none; a weight of 0 or less gives nothing. Capacity is
    max_epochs times the tokens, summed upwards; budgets then run downwards, each capped by its node's capacity. The
    tree has a row per leaf, of which there are as many as sources, however many rows they have.
    """
    t = leaves
    for level in LEVELS:
        named = weights.filter(F.col("level") == level).groupBy("name").agg(F.max("weight").alias(f"w_{level}"))
        t = t.join(named.withColumnRenamed("name", level), level, "left").withColumn(f"w_{level}", F.coalesce(F.col(f"w_{level}").cast("double"), F.lit(1.0)))
    dead = reduce(lambda a, b: a | b, [F.col(f"w_{x}") <= 0 for x in LEVELS])
    t = t.filter(~dead).withColumn("capacity", F.col("available").cast("double") * max_epochs)
    nodes, down = {}, None
    for k in range(len(LEVELS), 0, -1):
        nodes[k] = t.groupBy(*LEVELS[:k]).agg(F.sum("capacity").alias("capacity"), F.max(f"w_{LEVELS[k - 1]}").alias("weight"))
    total = t.agg(F.coalesce(F.sum("capacity"), F.lit(0.0)).alias("cap"), F.coalesce(F.sum("available"), F.lit(0)).cast("double").alias("all"))
    root = total.select(F.least("cap", F.lit(float(budget)) if budget is not None else F.col("all")).alias("budget"), F.lit(1).alias("_root"))
    down = nodes[1].withColumn("_root", F.lit(1)).join(root, "_root").drop("_root")
    down = fill(down, [], LEVELS[0])
    for k in (2, 3):
        above = down.select(*LEVELS[: k - 1], F.col("given").alias("budget"))
        down = fill(nodes[k].join(above, list(LEVELS[: k - 1])), list(LEVELS[: k - 1]), LEVELS[k - 1])
    return down.select(*LEVELS, "given").join(leaves, list(LEVELS))


def mix(docs: DataFrame, weights: DataFrame, domain: Column, budget: float | None = None, max_epochs: int = 2, seed: int = 17, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with epoch int, one row for each time a document is taken: every leaf's given tokens as a prefix of its epochs.

    Epoch e orders a leaf's documents by a hash of seed, e and id. Whole epochs are taken while they fit, then the
    shortest prefix of the next whose tokens reach what is left (less than half a token counts as none). Documents of
    equal hash and id (repeated rows) stay or go together. Null lang, source or id count as the value ''. No documents
    give none. Columns called epoch or beginning with _mix_ are replaced.

    No leaf is ever in one task: the prefix's end is found by two rounds of 256 sums per leaf over slices of the hash
    range, then by ordering the rows of one slice in 65,536 (a third of 10 billion rows leaves 50,000 there).
    """
    keep = [c for c in docs.columns if c != "epoch" and not c.startswith("_mix_")]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    d = docs.select(*keep).withColumns({"_mix_domain": F.coalesce(domain, F.lit("")), "_mix_lang": F.coalesce(F.col("lang"), F.lit("")), "_mix_source": F.coalesce(F.col("source"), F.lit(""))})
    leaf = [f"_mix_{x}" for x in LEVELS]
    small = written(d.select(*leaf, words(F.col(text)).alias("_mix_n"), key.alias("_mix_key")), "rows")  # the texts are counted once
    leaves = small.groupBy(*leaf).agg(F.sum("_mix_n").alias("available"))
    plan = budgets(leaves.select(*[F.col(a).alias(b) for a, b in zip(leaf, LEVELS, strict=True)], "available"), weights, budget, max_epochs)
    plan = plan.select(*[F.col(b).alias(a) for a, b in zip(leaf, LEVELS, strict=True)], F.floor(F.col("given") / F.col("available") + 1e-9).cast("int").alias("_mix_full"), F.col("given"), F.col("available"))
    plan = plan.withColumn("_mix_rest", F.round(F.col("given") - F.col("_mix_full") * F.col("available")).cast("long")).drop("given", "available")
    plan = written(plan, "budgets")
    hashed = lambda e: F.xxhash64(F.lit(seed), e, F.col("_mix_key"))
    slot = lambda h, k: F.shiftrightunsigned(h, 64 - 8 * k).bitwiseAND(BUCKETS - 1)
    rows = small.join(plan.filter("_mix_rest > 0"), leaf).withColumn("_mix_h", hashed(F.col("_mix_full")))
    rows = rows.select(*leaf, "_mix_rest", "_mix_n", "_mix_key", "_mix_h", slot(F.col("_mix_h"), 1).alias("_mix_1"), slot(F.col("_mix_h"), 2).alias("_mix_2"))

    def boundary(r: DataFrame, by: str) -> DataFrame:
        """The slice in which the prefix ends, and what is still wanted in it."""
        s = r.groupBy(*leaf, "_mix_rest", by).agg(F.sum("_mix_n").alias("n"))
        s = s.withColumn("upto", F.sum("n").over(Window.partitionBy(*leaf).orderBy(by)))
        return s.filter("upto >= _mix_rest and upto - n < _mix_rest").select(*leaf, F.col(by).alias("at"), (F.col("_mix_rest") - F.col("upto") + F.col("n")).alias("want"))

    one = boundary(rows, "_mix_1")
    rows2 = rows.join(one, leaf).filter("_mix_1 = at").drop("at", "_mix_rest").withColumnRenamed("want", "_mix_rest")
    two = boundary(rows2, "_mix_2")
    rows3 = rows2.join(two, leaf).filter("_mix_2 = at").groupBy(*leaf, "want", "_mix_h", "_mix_key").agg(F.sum("_mix_n").alias("n"))
    ends = rows3.withColumn("upto", F.sum("n").over(Window.partitionBy(*leaf).orderBy(unsigned(F.col("_mix_h")), "_mix_key")))
    ends = ends.filter("upto >= want and upto - n < want").select(*leaf, F.col("_mix_h").alias("_mix_end"), F.col("_mix_key").alias("_mix_last"))
    table = written(plan.join(ends, leaf, "left"), "ends")
    d = d.withColumn("_mix_key", key).join(table, leaf)
    h = unsigned(hashed(F.col("_mix_full")))
    partial = F.col("_mix_end").isNotNull() & ((h < unsigned(F.col("_mix_end"))) | ((h == unsigned(F.col("_mix_end"))) & (F.col("_mix_key") <= F.col("_mix_last"))))
    times = F.col("_mix_full") + F.when(partial, 1).otherwise(0)
    return d.withColumn("_mix_times", times).filter("_mix_times > 0").select(*keep, F.explode(F.sequence(F.lit(0), F.col("_mix_times") - 1)).alias("epoch"))


def unsigned(h: Column) -> Column:
    """Orders a 64-bit hash as its highest bits do."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def corpus_weights(spark) -> DataFrame:
    """The target weights of the registered query. Sources without one weigh 1."""
    return spark.createDataFrame([("domain", "web", 3.0), ("domain", "reference", 2.0), ("domain", "forum", 1.0), ("lang", "en", 2.0), ("lang", "de", 1.0), ("lang", "fr", 1.0), ("lang", "es", 1.0), ("source", "src0", 1.0), ("source", "src1", 2.0)], "level string, name string, weight double")


def corpus_domain() -> Column:
    """The registered query's tree: sources by number into three domains."""
    n = F.coalesce(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]+)$", 1).try_cast("int"), F.lit(0)) % 3
    return F.when(n == 0, "web").when(n == 1, "reference").otherwise("forum")


def mix_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, epoch) of the mixture of docs to corpus_weights(), as many tokens as docs has."""
    out = mix(docs, corpus_weights(docs.sparkSession), corpus_domain())
    return out.select("doc_id", "lang", "source", "epoch")
