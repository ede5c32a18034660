"""Set operations and deduplication (U operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def labelled_union(frames: dict[str, DataFrame], column: str = "origin") -> DataFrame:
    """UNION ALL with the source's name; missing columns are null."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def aligned_union(frames: Sequence[DataFrame], first: Sequence[str]) -> DataFrame:
    """UNION ALL with the canonical columns first (null where a frame lacks one), then the others in order of appearance."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    for c in first:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*first, *[c for c in out.columns if c not in first])


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows whose key is not among the new ones, and the new rows: doing it twice changes nothing."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def prefer(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the first frame that has their key."""
    out = labelled_union({f"{i:04d}": f for i, f in enumerate(frames)}, "__origin")
    least = F.min("__origin").over(W.partitionBy(*keys))
    return out.withColumn("__least", least).where("__origin = __least").drop("__origin", "__least")


def is_subset(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    return a.join(b, list(keys), "left_anti").limit(1).isEmpty()


def exact_duplicates(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, text_sha1, n_copies, first_key for every row, by an aggregate on the hash (combined before the shuffle)."""
    d = df.select(F.col(key), F.sha1(F.col(text).cast("binary")).alias("text_sha1"))
    groups = d.groupBy("text_sha1").agg(F.count("*").alias("n_copies"), F.min(key).alias("first_key"))
    return d.join(groups.withColumnRenamed("text_sha1", "__h"), F.col("text_sha1").eqNullSafe(F.col("__h"))).drop("__h")


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int = 1) -> DataFrame:
    """The best k representatives of each group."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def layered(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all frames, the last frame that has a key giving its rows; columns are those of the first, missing ones null."""
    first = frames[0].columns
    rows = [f.select(*[F.col(c) if c in f.columns else F.lit(None).alias(c) for c in first]) for f in frames]
    return prefer(rows[::-1], keys)
