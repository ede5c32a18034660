"""Aggregations (A operators) and grouping shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.abs(x.cast("double")) < float("inf"), x)


def group_means(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, n_valid (finite), mean and sem (n - 1 in the variance) of a value."""
    v = finite(F.col(value))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(v).alias("n_valid"), F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))


def mean_of_means(df: DataFrame, levels: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Averages of averages: levels from the finest keys to the coarsest."""
    out = df.select(*{c: None for keys in levels for c in keys}, finite(F.col(value)).alias(value))
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg(value).alias(value))
    return out


def best_evidence(hits: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The payload of each key's best score; equal scores are settled by the smallest of `ties`. One map-side combined aggregate."""
    order = F.struct(F.col(score).isNotNull().alias("known"), F.col(score).alias("score"))
    least = F.struct(*ties, *payload)
    best = hits.groupBy(*keys, F.col(score)).agg(F.min(least).alias("__p"))
    return best.groupBy(*keys).agg(F.max_by(F.struct(F.col(score), F.col("__p")), order).alias("__b")).select(*keys, F.col(f"__b.{score}").alias(score), *[F.col(f"__b.__p.{c}").alias(c) for c in dict.fromkeys([*ties, *payload])])


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, min and max (exact median)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one column each (q0 to q100)."""
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(f"q{q * 100:g}".replace(".", "_")) for q in at])


def bincount(df: DataFrame, array: str, size: int) -> DataFrame:
    """Counts of 0 to size - 1 among the elements of an array column, zeros included."""
    counts = df.select(F.explode(array).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(size).withColumnRenamed("id", "bin").join(counts, "bin", "left").fillna(0, ["n"])


def reasons_funnel(df: DataFrame, array: str) -> DataFrame:
    return df.select(F.explode(array).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def wide(df: DataFrame, keys: Sequence[str], column: str, value: str, values: Sequence, how=F.first) -> DataFrame:
    """Long to wide; the listed values give fixed columns, so no pass is spent on finding them."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(how(value))


def long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts with a fixed column order, zeros filled, and a row total (which counts other values too)."""
    out = df.groupBy(row).pivot(column, list(values)).count().fillna(0)
    return out.join(df.groupBy(F.col(row).alias("__row")).agg(F.count("*").alias("total")), F.col(row).eqNullSafe(F.col("__row"))).drop("__row")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """GROUPING SETS: the union of the groupings in one pass; columns that a set leaves out are null, `level` lists its columns."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*aggregates, *[F.grouping(c).alias(f"__g_{c}") for c in names])
    level = F.concat_ws(",", *[F.when(F.col(f"__g_{c}") == 0, F.lit(c)) for c in names])
    return out.withColumn("level", level).drop(*[f"__g_{c}" for c in names])


def overlapping(df: DataFrame, subsets: Sequence[tuple[str, Column]], column: str = "subset") -> DataFrame:
    """One row per named subset that holds the row."""
    return df.withColumn(column, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subsets]), lambda x: x.isNotNull())))


def votes(ballots: DataFrame, item: Sequence[str], voter: str, weight: str | None = None) -> DataFrame:
    """Votes and weight per item; a voter counts once per item, with its largest weight."""
    w = F.max(weight) if weight else F.lit(1.0)
    once = ballots.groupBy(*item, voter).agg(w.alias("__w"))
    return once.groupBy(*item).agg(F.count("*").alias("votes"), F.sum("__w").alias("weight"))


def softmax_weights(df: DataFrame, keys: Sequence[str], loss: str, temperature: float) -> DataFrame:
    """Adds weight = softmax over the group of -loss / temperature: two aggregates joined back, so a large group isn't one task."""
    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    gone = [f"__k{i}" for i in range(len(keys))]
    d = df.join(df.groupBy(*k).agg(F.min(loss).alias("__m")), on).drop(*gone).withColumn("__e", F.exp(-(F.col(loss) - F.col("__m")) / temperature))
    return d.join(d.groupBy(*k).agg(F.sum("__e").alias("__s")), on).withColumn("weight", F.col("__e") / F.col("__s")).drop("__e", "__m", "__s", *gone)


def set_scores(predicted: Column, truth: Column) -> Column:
    """struct<precision,recall,f1> of two arrays as sets; no prediction gives 0, no truth NaN for all."""
    p, t = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(truth))
    hit = F.size(F.array_intersect(predicted, truth))
    score = lambda n, d: F.when(t == 0, float("nan")).when(d == 0, 0.0).otherwise(F.try_divide(n, d))
    return F.struct(score(hit, p).alias("precision"), score(hit, t).alias("recall"), score(2 * hit, p + t).alias("f1"))


def best_prefix_f1(scored: DataFrame, keys: Sequence[str], score: str, tie: str, truth: str) -> DataFrame:
    """The best F1 over all prefixes of each group's ranking (score descending, then tie), and its length."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), tie)
    hits = F.sum(F.col(truth).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(F.col(truth).cast("int")).over(W.partitionBy(*keys))
    f = scored.withColumn("__k", F.row_number().over(order)).withColumn("__f", 2.0 * hits / (F.col("__k") + total))
    return f.groupBy(*keys).agg(F.max("__f").alias("best_f1"), F.min_by("__k", F.struct(-F.col("__f"), F.col("__k"))).alias("best_k"))


def frequencies(df: DataFrame, value: str, background: DataFrame | None = None) -> DataFrame:
    """n, share and, against a background of the same column, log2 enrichment."""
    count = lambda d: d.groupBy(value).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # noqa: E731  a row per value
    out = count(df)
    if background is None:
        return out
    back = count(background).select(value, F.col("share").alias("background"))
    return out.join(back, value, "left").withColumn("log2_enrichment", F.log2(F.col("share") / F.col("background")))


def effective_count(neighbours: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Sum over items of 1 / (number of neighbours, itself included): (keys, neff) from rows (keys, item, other)."""
    n = neighbours.groupBy(*keys, item).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.sum(1 / F.col("n")).alias("neff"))


def two_ended_coverage(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.agg(F.count_distinct(left).alias("left_covered"), F.count_distinct(right).alias("right_covered"))


def axis_decomposition(df: DataFrame, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """How many rows fall by axis a only, b only, both, or are kept."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(*keys).agg(n(a & ~b).alias("only_a"), n(~a & b).alias("only_b"), n(a & b).alias("both"), n(~a & ~b).alias("kept"))
