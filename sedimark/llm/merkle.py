"""Merkle manifest of a dataset by checkpoint-and-recompute: one tree per key, and a tree over their roots.

Only every few levels of a tree are stored. A proof regenerates the missing interior nodes of each aligned subtree from the stored
nodes below it, takes its siblings and discards the rest. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sedimark.llm.common import checkpointed


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as `-` if null, else as its count of UTF-8 bytes, `:` and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with place (from 0 within their `tree`, by `order`, nulls first) and of (nodes of the tree), checkpointed.

    No tree is held in one task: rows are dealt by range over (tree, order), equal rows among them, each range counts its rows of every
    tree, and the counts of earlier ranges are added (a row per range and tree, and a tree lies in consecutive ranges).
    """
    keys = ["tree", *order, "__m"]
    rows = nodes.withColumn("__m", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__m").withColumn("__at", F.monotonically_increasing_id())
    rows = checkpointed(rows.select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__row")).drop("__at"))
    w = W.partitionBy("tree").orderBy("__part")
    runs = rows.groupBy("tree", "__part").agg(F.min("__row").alias("low"), F.count("*").alias("n"))
    shift = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("low")
    runs = runs.select(F.col("tree").alias("__tree"), F.col("__part").alias("__p"), shift.alias("__shift"), F.sum("n").over(W.partitionBy("tree")).alias("of"))
    out = rows.join(runs, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("__part") == F.col("__p")))
    return checkpointed(out.select(*nodes.columns, (F.col("__row") + F.col("__shift")).alias("place"), "of"))


def _climb(of: Column, fan: int, every: int) -> Column:
    """Levels from nodes of which the tree has `of` to the next stored level: `every`, or fewer where the root comes before."""
    return sum(((of > fan**i).cast("int") for i in range(1, every)), (of > 1).cast("int"))


def _levels(digests: Column, climb: Column, fan: int, every: int) -> Column:
    """array<array<string>>: an aligned subtree's levels, regenerated from its lowest one."""

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(level) / fan).cast("int") - 1)
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * fan + 1, fan), ""), 256))

    steps = F.slice(F.array(*map(F.lit, range(every))), F.lit(1), climb)
    return F.aggregate(steps, F.array(digests), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _subtrees(nodes: DataFrame, fan: int, every: int) -> DataFrame:
    """tree, place (of the subtree's top), of, members (by place), levels: aligned groups of at most fan ** every nodes."""
    held = F.struct("place", "digest", *[c for c in nodes.columns if c not in ("tree", "of", "place", "digest")])
    groups = nodes.groupBy("tree", F.expr(f"place div {fan**every}").alias("top")).agg(F.array_sort(F.collect_list(held)).alias("members"), F.first("of").alias("of"))
    groups = groups.withColumn("climb", _climb(F.col("of"), fan, every))
    return groups.withColumn("levels", _levels(F.transform("members", lambda m: m["digest"]), F.col("climb"), fan, every))


def stored_levels(leaves: DataFrame, fan: int = 3, every: int = 4) -> list[DataFrame]:
    """The levels that are kept of numbered leaves, lowest first: each has every fan ** every-th part of the one below, the last has one
    row per tree, its root. Every one is checkpointed."""
    kept = [leaves]
    most = leaves.agg(F.max("of")).first()[0] or 0
    while most > 1:
        up = _subtrees(kept[-1], fan, every)
        kept.append(checkpointed(up.select("tree", F.col("top").alias("place"), F.ceil(F.col("of") / fan ** F.col("climb")).cast("long").alias("of"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))))
        most = -(-most // fan**every)
    return kept


def _siblings(levels: Column, place: Column, climb: Column, fan: int, every: int) -> Column:
    """array<struct<left,right>>: level by level, the digests of a node's run before it and after it, joined."""

    def at(level: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(fan), level)).cast("int")
        nodes, first = F.get(levels, level), own - own % fan
        left, right = F.slice(nodes, first + 1, own - first), F.slice(nodes, own + 2, fan - 1 - (own - first))
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(F.slice(F.array(*map(F.lit, range(every))), F.lit(1), climb), at)


def proofs(kept: list[DataFrame], above: DataFrame, fan: int = 3, every: int = 4) -> DataFrame:
    """Of every leaf: its columns, those of `above`, and proof, its siblings level by level up to the root over all trees.

    above: a row per tree with its proof from there on (and further columns). Goes down the stored levels: a subtree's nodes come
    from its stored members, what stands above it from the level before, so a proof's length travels once per subtree, not per leaf.
    """
    carried = [c for c in above.columns if c not in ("tree", "place", "proof")]
    above = above.withColumn("place", F.lit(0).cast("long"))
    for k in range(len(kept) - 1, -1, -1):
        nodes = kept[k]
        if k == len(kept) - 1:
            groups = nodes.select("*", F.struct(*[c for c in nodes.columns if c not in ("tree", "of")]).alias("m"))
            groups = groups.select("tree", "place", F.col("m"), F.array().cast("array<struct<left:string,right:string>>").alias("own"))
        else:
            groups = _subtrees(nodes, fan, every).withColumnRenamed("top", "place")
        up = above.select(F.col("tree").alias("__tree"), F.col("place").alias("__place"), F.col("proof").alias("__proof"), *carried)
        out = groups.join(up, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("place") == F.col("__place")))
        if k < len(kept) - 1:
            own = _siblings(F.col("levels"), (F.col("m.place") % fan**every).cast("int"), F.col("climb"), fan, every)
            out = out.withColumn("m", F.explode("members")).withColumn("own", own)
        above = out.select("tree", "m.*", F.concat("own", "__proof").alias("proof"), *carried)
        if k:
            above = above.drop("digest")
    return above


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(proof, digest, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def manifest(leaves: DataFrame, order: list[str], fan: int = 3, every: int = 4) -> DataFrame:
    """All columns of leaves (tree, digest and further ones) with subroot (root of the leaf's tree), root (over the subroots by tree, null
    first, bytewise) and proof (siblings from leaf to root: array<struct<left,right>>, empty strings where a node is alone in its run).

    Leaves of a tree are placed by `order`, nulls first, ties by digest; equal rows take a place each, and which of them takes which
    changes no digest. A tree of one leaf is that leaf; a null tree is a tree. An empty table gives no rows. Every `every`-th level is
    stored (checkpointed); groups are aligned subtrees of at most fan ** every nodes, however large a tree is.
    """
    kept = stored_levels(numbered(leaves, [*order, "digest"]), fan, every)
    subroots = kept[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = stored_levels(numbered(subroots, ["name"]), fan, every)
    root = tops[-1].select("tree", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    of_trees = proofs(tops, root, fan, every).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    return proofs(kept, checkpointed(of_trees), fan, every).drop("place", "of")
