"""Resolution of names and codes to entities, relations one hop away, and walks along parent links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written
from .textops import similarity, trigrams


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth) along nodes(id, parent), to any depth: each round doubles the length of the steps, so there are as many as the logarithm of the longest path.

    Every round is written to the shared folder. In a cycle a node is an ancestor of itself; rounds end when steps are longer than there are nodes.
    """
    folder = shared_folder(nodes.sparkSession)
    jump = found = written(nodes.filter("id is not null and parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), f"{folder}/step0")
    n, length = nodes.count(), 1
    while length <= n and jump.take(1):
        by = jump.select(F.col("id").alias("_via"), F.col("ancestor").alias("_up"), F.col("depth").alias("_more"))
        on = lambda d: d.join(by, F.col("ancestor") == F.col("_via")).select("id", F.col("_up").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))  # noqa: E731, B023
        length *= 2
        found = written(found.unionByName(on(found)).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), f"{folder}/found{length}")
        jump = written(on(jump).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), f"{folder}/step{length}")
    return found


def ends(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, last, steps): where each node's way along links(id, next) ends, by pointer doubling: one row per node in every round, whatever the length.

    A node has one next one, the largest of several. A way that runs into a cycle has no end: last is null.
    """
    folder = shared_folder(nodes.sparkSession)
    one = links.filter("next is not null").groupBy("id").agg(F.max("next").alias("next"))
    at = nodes.filter("id is not null").select("id").distinct().join(one, "id", "left")
    at = written(at.select("id", F.coalesce("next", "id").alias("last"), F.col("next").isNotNull().cast("long").alias("steps")), f"{folder}/way0")
    n, length, before = at.count(), 1, None
    while length <= n:
        by = at.select(F.col("id").alias("_via"), F.col("last").alias("_last"), F.col("steps").alias("_more"))
        length *= 2
        at = written(at.join(by, F.col("last") == F.col("_via"), "left").select("id", F.coalesce("_last", "last").alias("last"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")), f"{folder}/way{length}")
        now = at.agg(F.sum("steps")).first()[0]
        if now == before:
            break
        before = now
    return at.join(one.select(F.col("id").alias("last"), F.lit(True).alias("_on")), "last", "left").select("id", F.when(F.col("_on").isNull(), F.col("last")).alias("last"), "steps")


def last_successor(nodes: DataFrame) -> DataFrame:
    """(id, last, steps): the end of each node's chain of versions, where a version's parent is the one before it."""
    return ends(nodes, nodes.filter("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("next")))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """(nodes, depth, orphans): one row."""
    known = nodes.select(F.col("id").alias("next")).distinct()
    up = nodes.filter("parent is not null").select("id", F.col("parent").alias("next")).join(known, "next", "left_semi")
    depth = ends(nodes, up).agg(F.coalesce(F.max("steps") + 1, F.lit(1)).alias("depth"))
    n = nodes.agg(F.count_distinct("id").alias("nodes"))
    orphans = nodes.filter("parent is not null").join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").agg(F.count("*").alias("orphans"))
    return n.crossJoin(depth).crossJoin(orphans)  # one row each


def one_hop(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Relations from either end: two equi-joinable halves in place of `from = e or to = e`."""
    out = edges.select(F.col(a).alias("entity"), F.col(b).alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col(b).alias("entity"), F.col(a).alias("other"), F.lit("in").alias("direction")))


def resolve(branches: list[DataFrame]) -> DataFrame:
    """(alias, entity, confidence, candidates) over branches(alias, entity, confidence): the most confident entity, of equals the smallest."""
    b = reduce(DataFrame.unionByName, branches).groupBy("alias", "entity").agg(F.max("confidence").alias("confidence"))
    g = b.groupBy("alias").agg(F.max(F.struct("confidence", -F.col("entity"))).alias("x"), F.count("*").alias("candidates"))
    return g.select("alias", (-F.col("x.col2")).alias("entity"), F.col("x.confidence").alias("confidence"), "candidates")


def resolve_names(asked: DataFrame, codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, entity, confidence, layer, candidates) of asked(id, code, name, context): who is meant, and by what.

    A known code decides; else an alias that only one entity has; of an alias that several have, the one among the context's entities, if
    it is the only one. What is ambiguous or unknown has no entity: suggestions (fuzzy) are for people to confirm, never taken.
    """
    c = codes.groupBy("code").agg(F.min("entity").alias("_code"))
    a = aliases.select(F.col("alias").alias("name"), F.col("entity").alias("_e")).filter("_e is not null").distinct()
    named = a.groupBy("name").agg(F.count("*").alias("_n"), F.min("_e").alias("_one"))
    # an alias meets its entities once, when they are counted; a question then meets that one row, and only the entities of its own context
    d = asked.join(c, "code", "left").join(named, "name", "left").groupBy("id").agg(F.first("_code", True).alias("by_code"), F.coalesce(F.sum("_n"), F.lit(0)).alias("candidates"), F.min("_one").alias("one"))
    around = asked.filter("name is not null").select("id", "name", F.explode(F.array_distinct("context")).alias("_e")).join(a, ["name", "_e"])
    g = d.join(around.groupBy("id").agg(F.count("*").alias("here"), F.min("_e").alias("near")), "id", "left")
    code, alone, near = F.col("by_code").isNotNull(), F.col("candidates") == 1, (F.col("candidates") > 1) & (F.col("here") == 1)
    entity = F.when(code, F.col("by_code")).when(alone, F.col("one")).when(near, F.col("near"))
    layer = F.when(code, "code").when(alone, "alias").when(near, "context").when(F.col("candidates") > 1, "alias_ambiguous").otherwise("fuzzy")
    return g.select("id", entity.alias("entity"), F.when(code | alone, "high").when(near, "medium").otherwise("low").alias("confidence"), layer.alias("layer"), "candidates")


def resolve_codes(asked: DataFrame, entities: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Any of several code columns, unpivoted so that one hash join does it."""
    codes = entities.select(key, F.explode(F.array(*columns)).alias("code"))
    return asked.join(codes, "code", "left").groupBy("code").agg(F.min(key).alias(key))


def fuzzy(names: DataFrame, aliases: DataFrame, least: float, k: int) -> DataFrame:
    """Suggestions by trigram similarity. Only names that share a trigram meet; the shared ones are counted in the join."""
    n = names.select("id", trigrams(F.col("name")).alias("x"))
    a = aliases.select("alias", trigrams(F.col("alias")).alias("y"))
    met = n.select("id", F.explode("x").alias("g")).join(a.select("alias", F.explode("y").alias("g")), "g").select("id", "alias").distinct()
    s = met.join(n, "id").join(a, "alias").select("id", "alias", F.round(similarity(F.col("x"), F.col("y")), 6).alias("similarity")).filter(F.col("similarity") > least)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "alias"))).filter(F.col("rank") <= k)
