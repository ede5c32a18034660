"""Window and ranking operators (W and O operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.operators.checkpoints import checkpointed


def rounds(df: DataFrame, cluster: str, score: str, tie: str) -> DataFrame:
    """Adds round (rank in the cluster from 0, best score first) and cluster_size."""
    w = W.partitionBy(cluster)
    return df.withColumn("round", F.row_number().over(w.orderBy(F.desc(score), tie)) - 1).withColumn("cluster_size", F.count("*").over(w))


def select_rounds(df: DataFrame, cluster: str, score: str, tie: str, least_size: int, n_rounds: int) -> DataFrame:
    """The best n_rounds rows of each cluster of at least least_size rows. The size is an aggregate joined back and the rank
    limit is pushed below the shuffle, so a hot cluster doesn't pass through one sort."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("cluster_size")).where(F.col("cluster_size") >= least_size)
    top = df.withColumn("round", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc(score), tie)) - 1).where(F.col("round") < n_rounds)
    return top.join(sizes, cluster)


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, a small aggregate, computed now; broadcast if it has at most `most` rows. The planner can't tell the size of an aggregate before it
    runs, and would deal the large side of a join by a few keys at the same time."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut_edges(df: DataFrame, keys: Sequence[str], value: str, parts: int) -> DataFrame:
    """(__k0, __k1 ..., __e): up to parts - 1 approximate quantiles of each key's values."""
    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    return df.groupBy(*k).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("__e"))


def with_cut(df: DataFrame, keys: Sequence[str], value: str, edges: DataFrame, parts: int) -> DataFrame:
    """df with __c, how many of the key's edges lie below the row's value (-1: null): equal values share a cut, and cuts follow each other in
    order."""
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)] or [F.lit(True)]
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(parts.bit_length()))])  # the edges are in order: a search by halves
    below = F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(F.get("__e", n + s - 1) < F.col(value), s).otherwise(0))
    cut = F.when(F.col(value).isNull() | F.col("__e").isNull(), -1).otherwise(below)
    return df.join(edges, on).withColumn("__c", cut).drop("__e", *[f"__k{i}" for i in range(len(keys))])


def _cut(df: DataFrame, keys: Sequence[str], value: str, parts: int) -> DataFrame:
    """df with __c by edges of its own: a key that holds most of the rows is many cuts."""
    return with_cut(df, keys, value, bounded(cut_edges(df, keys, value, parts)), parts)


def _with_before(d: DataFrame, keys: Sequence[str], total: Column, whole: str | None = None) -> DataFrame:
    """d, cut by __c, with __b: the sum of an aggregate over the key's earlier cuts (0 before the first), and its sum over all of them as
    `whole` if named."""
    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    sizes = d.groupBy(*k, F.col("__c").alias("__d")).agg(total.alias("__t"))
    w = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__d").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("__b", F.coalesce(F.sum("__t").over(w), F.lit(0)))  # a row per cut
    if whole:
        before = before.withColumn(whole, F.sum("__t").over(W.partitionBy(*[f"__k{i}" for i in range(len(keys))])))
    before = before.drop("__t")
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)] + [F.col("__c") == F.col("__d")]
    return d.join(before, on).drop("__d", *[f"__k{i}" for i in range(len(keys))])


def value_counts(df: DataFrame, keys: Sequence[str], values: Sequence[str], *more: Column) -> DataFrame:
    """keys, values, __n rows (and further aggregates): equal rows are counted map-side. The condition, always true, keeps __n in every use of
    the result, so that uses share one exchange."""
    return df.groupBy(*keys, *values).agg(F.count("*").alias("__n"), *more).where("__n > 0")


def count_ranks(counts: DataFrame, keys: Sequence[str], value: str, column: str, total: str | None = None, parts: int = 256) -> DataFrame:
    """counts (keys, value, __n, one row for each of a key's values) with the mean rank of the value's rows, nulls first, and the key's rows as
    `total` if named. Distinct values are summed up inside cuts of their key, then shifted by the cuts before."""
    d = _with_before(_cut(counts, keys, value, parts), keys, F.sum("__n"), total)
    inside = F.sum("__n").over(W.partitionBy(*keys, "__c").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn(column, F.col("__b") + inside - (F.col("__n") - 1) / 2.0)
    return d.select(*counts.columns, column, *([total] if total else []))


def average_ranks(df: DataFrame, keys: Sequence[str], columns: dict[str, str], parts: int = 256) -> DataFrame:
    """df with ranks from 1 in each key, the mean rank for ties, nulls first as in an ascending order: columns maps a value to its rank's name.

    Each value's distinct values are counted (ties vanish before the shuffle), ranked, and joined back: the input is read once for each
    value and once more, and a value that most rows share is one row of the counts."""
    out = df
    for i, (value, column) in enumerate(columns.items()):
        r = count_ranks(value_counts(df.select(*dict.fromkeys([*keys, value])), keys, [value]), keys, value, column, parts=parts)
        names = {c: f"__{i}_{k}" for k, c in enumerate([*keys, value])}
        r = r.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(column))
        out = out.join(r, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())
    return out


def average_rank(df: DataFrame, keys: Sequence[str], value: str, column: str = "rank", parts: int = 256) -> DataFrame:
    """df with the mean rank of one value (see average_ranks)."""
    return average_ranks(df, keys, {value: column}, parts)


def place(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence, column: str = "place", parts: int = 256) -> DataFrame:
    """Row numbers from 1 by (value, ties) in each key, in cuts as for average_rank."""
    d = _with_before(_cut(df, keys, value, parts), keys, F.count("*"))
    return d.withColumn(column, F.col("__b") + F.row_number().over(W.partitionBy(*keys, "__c").orderBy(value, *ties))).drop("__b", "__c")


def place_in_order(df: DataFrame, lead: str, value: str, ties: Sequence, column: str = "place", parts: int = 256) -> DataFrame:
    """Row numbers from 1 over the whole table by (lead, nulls last; value; ties): places inside each value of lead, a column of few values,
    shifted by the rows of the values before it."""
    sizes = df.groupBy(F.col(lead).alias("__l")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy(F.asc_nulls_last("__l")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = place(df, [lead], value, ties, "__p", parts).join(sizes.select("__l", before.alias("__before")), F.col(lead).eqNullSafe(F.col("__l")))
    return d.withColumn(column, F.col("__p") + F.col("__before")).drop("__p", "__l", "__before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, column: str, parts: int = 256) -> DataFrame:
    """Sum of a value over the key's rows up to and with each one, in the order of columns of which the first is a number or a time; in
    cuts as for average_rank."""
    d = _with_before(_cut(df, keys, order[0], parts), keys, F.sum(value))
    w = W.partitionBy(*keys, "__c").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn(column, F.col("__b") + F.sum(value).over(w)).drop("__b", "__c")


def quartile(df: DataFrame, keys: Sequence[str], value: str, tie: str, parts: int = 4, column: str = "quartile") -> DataFrame:
    """Equal-width cuts of the first-occurrence rank (1..parts), which differ from ntile where n isn't a multiple."""
    w = W.partitionBy(*keys)
    rn, n = F.row_number().over(w.orderBy(value, tie)), F.count("*").over(w)
    return df.withColumn("__n", n).withColumn("__r", rn).withColumn(column, F.when(F.col("__n") == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(parts * (F.col("__r") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))))).cast("int")).drop("__n", "__r")


def normalised_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str = "rank01") -> DataFrame:
    return df.withColumn(column, F.percent_rank().over(W.partitionBy(*keys).orderBy(*order)))


def z_score(df: DataFrame, keys: Sequence[str], value: str, column: str = "z") -> DataFrame:
    """(x - mean) / std in the group, null without a spread: an aggregate joined back, so a large group isn't one task."""
    g = df.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    return df.join(g, on).withColumn(column, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s", *[f"__k{i}" for i in range(len(keys))])


def rolling_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int, least: int, column: str = "rolling") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn(column, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def sections(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, column: str = "section") -> DataFrame:
    """Running count of opening rows: 0 before the first."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.sum(F.when(opens, 1).otherwise(0)).over(w))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def head_and_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first and last k rows of each group, with `end` head or tail; a row may be both."""
    head = df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k)
    tail = df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where(F.col("__r") <= k)
    return head.withColumn("end", F.lit("head")).unionByName(tail.withColumn("end", F.lit("tail"))).withColumnRenamed("__r", "place")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """Top k per key; the planner keeps only k rows per key and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def top_precision(scored: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], truth: str, size: str) -> DataFrame:
    """Precision among the best L, L/2, L/5 and R (number of true rows); L is in column `size`. NaN where the target is not
    positive; n_candidates counts all rows of the group."""
    w = W.partitionBy(*keys)
    ranked = scored.withColumn("__r", F.row_number().over(w.orderBy(F.desc(score), *ties))).withColumn("__n", F.sum(F.col(truth).cast("int")).over(w))
    cuts = {"L": F.col(size), "L_2": F.floor(F.col(size) / 2), "L_5": F.floor(F.col(size) / 5), "R": F.col("__n")}

    def precision(cut: Column) -> Column:
        inside = F.col("__r") <= cut
        return F.coalesce(F.sum(F.when(inside, F.col(truth).cast("int"))) / F.sum(F.when(inside, 1)), F.lit(float("nan")))

    return ranked.groupBy(*keys).agg(*[precision(c).alias(f"p_{n}") for n, c in cuts.items()], F.count("*").alias("n_candidates"), F.max("__n").alias("n_true"))


def leave_one_out(df: DataFrame, keys: Sequence[str], value: str, column: str = "mean_without") -> DataFrame:
    """Mean of the group's other rows."""
    w = W.partitionBy(*keys)
    return df.withColumn(column, F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1))


def standardised_advantage(df: DataFrame, keys: Sequence[str], value: str, column: str = "advantage") -> DataFrame:
    """(x - mean) / (std + 1e-6) in the group; a group of one passes its value through."""
    w = W.partitionBy(*keys)
    return df.withColumn(column, F.when(F.count("*").over(w) == 1, F.col(value)).otherwise((F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + 1e-6)))


def first_seen(df: DataFrame, keys: Sequence[str], item: Sequence[str], order: str) -> DataFrame:
    """n_new: items that no earlier ordinal of the group had, per (keys, ordinal)."""
    born = df.groupBy(*keys, *item).agg(F.min(order).alias(order))
    return born.groupBy(*keys, order).agg(F.count("*").alias("n_new"))


def linear_schedule(step: Column, start: float, end: float, total: int) -> Column:
    return F.lit(start) + (F.lit(end) - F.lit(start)) * F.least(F.greatest(step / float(total), F.lit(0.0)), F.lit(1.0))


def rank_order(resolution: str, length: str, key: str) -> list[Column]:
    """Best resolution first and missing last, then the longest, then the key."""
    return [F.asc_nulls_last(resolution), F.desc(length), F.asc(key)]


def by_magnitude(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(F.abs(value)), tie).limit(k)


def least_rows(df: DataFrame, keys: Sequence[str], value: str, tie: str, percent: int = 1) -> tuple[DataFrame, DataFrame]:
    """The smallest max(1, n * percent // 100) rows of each group by (value, tie), as two tables: those whose value lies below the group's last
    one taken, and of those that have it the first ones by tie.

    The last value comes from counts of the values, so only rows that have it are put in order, in cuts of the tie (of its first field, if it is
    a struct) if that is a number or a time."""
    from pyspark.sql.types import DateType, NumericType, StructType, TimestampNTZType, TimestampType

    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    take = F.greatest(F.lit(1), F.floor(F.col("__all") * percent / 100))
    ranks = count_ranks(value_counts(df.select(*dict.fromkeys([*keys, value])), keys, [value]), keys, value, "__r", "__all")
    half = (F.col("__n") - 1) / 2.0  # ranks are means: a value's first one is half its rows before
    last = ranks.where((F.col("__r") - half <= take) & (F.col("__r") + half >= take))
    last = bounded(last.select(*k, F.col(value).alias("__v"), (take - (F.col("__r") - half) + 1).alias("__left")))
    d = df.join(last, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)] or [F.lit(True)]).drop(*[f"__k{i}" for i in range(len(keys))])
    below = d.where((F.col(value) < F.col("__v")) | (F.col(value).isNull() & F.col("__v").isNotNull()))
    at = d.where(F.col(value).eqNullSafe(F.col("__v")))
    kind, first = df.schema[tie].dataType, F.col(tie)
    if isinstance(kind, StructType):
        first, kind = first.getField(kind.fields[0].name), kind.fields[0].dataType
    orders = isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType))
    at = place(at.withColumn("__t", first if orders else F.lit(0)), keys, "__t", [tie], "__place").where(F.col("__place") <= F.col("__left"))
    return below.select(*df.columns), at.select(*df.columns)


def smallest_share(df: DataFrame, keys: Sequence[str], value: str, tie: str, percent: int = 1) -> DataFrame:
    """The smallest max(1, n * percent // 100) rows of each group."""
    below, at = least_rows(df, keys, value, tie, percent)
    return below.unionByName(at)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Adds run: the number of the maximal run of equal labels (from 0) in each group's order."""
    w = W.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__c")


def run_table(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, unique: bool = False) -> DataFrame:
    """One row per run: label, run, length. unique: raises if a label comes back after another run."""
    out = runs(df, keys, order, label).groupBy(*keys, "run", label).agg(F.count("*").alias("length"))
    if unique and not out.groupBy(*keys, label).count().where("count > 1").limit(1).isEmpty():
        raise ValueError(f"a {label} comes back after another one")
    return out
