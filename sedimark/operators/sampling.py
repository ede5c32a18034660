"""Sampling (R operators): every draw is a function of a key and a salt, never of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.functions.scalars import keyed_hash, keyed_uniform


def subset(df: DataFrame, keys: Sequence[str], item: Column, k: int, salt: str) -> DataFrame:
    """Uniform k rows of each group: the k smallest keyed hashes."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(keyed_hash(item, salt)))).where(F.col("__r") <= k).drop("__r")


def weighted_subset(df: DataFrame, keys: Sequence[str], item: Column, weight: str, k: int, salt: str) -> DataFrame:
    """k rows of each group without replacement, in proportion to weight (exponential race); weights of 0 never win."""
    race = -F.log(F.greatest(keyed_uniform(item, salt), F.lit(1e-300))) / F.col(weight)
    rows = df.where(F.col(weight) > 0)
    return rows.withColumn("__race", race).withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("__race", keyed_hash(item, salt)))).where(F.col("__r") <= k).drop("__r", "__race")


def splice(a: DataFrame, b: DataFrame, item: Sequence[str], k: int, salt: str, pool: DataFrame | None = None) -> DataFrame:
    """k distinct items: half from each set, then what either has left, then the pool, each in keyed order."""
    order = keyed_hash(F.concat_ws("|", *[F.col(c).cast("string") for c in item]), salt)
    half = k // 2
    parts = []
    for rank, (df, cut) in enumerate(((a, k - half), (b, half), *(((pool, 0),) if pool is not None else ()))):
        one = df.select(*item).distinct().withColumn("__h", order).withColumn("__r", F.row_number().over(W.orderBy("__h"))) if cut == 0 else df.select(*item).distinct().withColumn("__h", order).orderBy("__h").limit(k).withColumn("__r", F.row_number().over(W.orderBy("__h")))
        parts.append(one.withColumn("__class", F.when(F.col("__r") <= cut, rank).otherwise(2 + rank)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy(*item).agg(F.min(F.struct("__class", "__h")).alias("__o"))
    return best.orderBy("__o").limit(k).select(*item)


def matched_null(pairs: DataFrame, universe: DataFrame, profile: str, item: Sequence[str], salt: str) -> DataFrame:
    """As many universe rows per profile value as pairs has, in keyed order, none of them among the pairs."""
    want = pairs.groupBy(profile).agg(F.count("*").alias("__n"))
    free = universe.join(pairs.select(*item), list(item), "left_anti")
    h = keyed_hash(F.concat_ws("|", *[F.col(c).cast("string") for c in item]), salt)
    ranked = free.withColumn("__r", F.row_number().over(W.partitionBy(profile).orderBy(h)))
    return ranked.join(want, profile).where("__r <= __n").drop("__r", "__n")


def draw_files(df: DataFrame, file: str, n: int, salt: str) -> DataFrame:
    """n of the files named in a column, by keyed order."""
    return df.select(file).distinct().orderBy(keyed_hash(F.col(file), salt), file).limit(n)


def mixture(sources: dict[str, tuple[DataFrame, float]], key: str, salt: str) -> DataFrame:
    """Union with each source's share of rows, by keyed uniform below its fraction."""
    out = None
    for name, (df, fraction) in sources.items():
        part = df.where(keyed_uniform(F.col(key), salt, name) < fraction).withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def poisson_weight(key: Column, replicate: Column, salt: str, most: int = 8) -> Column:
    """Poisson(1) count of a row in a bootstrap replicate, by the inverse CDF of a keyed uniform."""
    import math

    u, edges, total = keyed_uniform(key, salt, replicate), [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        edges.append(total)
    return sum((u >= edge).cast("int") for edge in edges)  # no branches, so that the uniform is computed once


def global_shuffle(df: DataFrame, key: str, salt: str) -> DataFrame:
    """Order of keyed hashes; a range exchange, no single task."""
    return df.orderBy(keyed_hash(F.col(key), salt), key)


def clean_mix(dirty: DataFrame, clean: DataFrame, key: str, n_clean: int, salt: str) -> DataFrame:
    """dirty rows and n_clean rows of keys that dirty doesn't have, `half` naming the side; in keyed order."""
    free = clean.join(dirty.select(key).distinct(), key, "left_anti").orderBy(keyed_hash(F.col(key), salt), key).limit(n_clean)
    return global_shuffle(dirty.withColumn("half", F.lit("dirty")).unionByName(free.withColumn("half", F.lit("clean"))), key, salt + "-order")


def first_n_surviving(df: DataFrame, dropped: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    return df.join(dropped.select(key).distinct(), key, "left_anti").dropDuplicates([key]).orderBy(keyed_hash(F.col(key), salt), key).limit(n)
