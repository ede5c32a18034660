"""Statistics (T operators) by group; relational where possible, one vectorised call per group elsewhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.operators.aggregates import finite
from sedimark.operators.sampling import poisson_weight
from sedimark.operators.windows import average_ranks, bounded, count_ranks, cut_edges, value_counts, with_cut


def paired_difference(df: DataFrame, entity: str, model: str, value: str) -> DataFrame:
    """All unordered pairs of models over the entities both have: n, means, delta (a - b), sem, normal 95 % interval, win and
    tie rate."""
    a = df.select(F.col(entity), F.col(model).alias("model_a"), finite(F.col(value)).alias("__a"))
    b = df.select(F.col(entity), F.col(model).alias("model_b"), finite(F.col(value)).alias("__b"))
    p = a.join(b, entity).where("model_a < model_b and __a is not null and __b is not null").withColumn("__d", F.col("__a") - F.col("__b"))
    sem = F.stddev_samp("__d") / F.sqrt(F.count("*"))
    out = p.groupBy("model_a", "model_b").agg(
        F.count("*").alias("n"), F.avg("__a").alias("mean_a"), F.avg("__b").alias("mean_b"), F.avg("__d").alias("delta"), sem.alias("sem"),
        F.avg((F.col("__d") > 0).cast("double")).alias("win_rate"), F.avg((F.col("__d") == 0).cast("double")).alias("tie_rate"),
    )
    return out.withColumns({"low": F.col("delta") - 1.96 * F.col("sem"), "high": F.col("delta") + 1.96 * F.col("sem")})


def bootstrap_means(df: DataFrame, keys: Sequence[str], entity: str, value: str, replicates: int, salt: str, level: float = 0.95) -> DataFrame:
    """Mean with percentile interval by Poisson bootstrap: each entity's count in each replicate is a function of its key. Rows
    x replicates stream through one map-side combined aggregate. Fewer than three finite values: no interval."""
    v = df.where(finite(F.col(value)).isNotNull())
    n = v.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    means = _replicated(v, keys, entity, value, replicates, salt)
    tail = (1 - level) / 2
    ci = means.groupBy(*keys).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    out = n.join(ci, list(keys), "left") if keys else n.join(ci, F.lit(True), "left")
    few = F.col("n") < 3
    return out.withColumns({"low": F.when(few, None).otherwise(F.col("low")), "high": F.when(few, None).otherwise(F.col("high"))}).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a side is constant (the built-in raises there in ANSI mode)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _rank_products(df: DataFrame, keys: Sequence[str], values: Sequence[str], parts: int = 256) -> DataFrame:
    """keys, n and __m: the sums, row by row of their matrix, of products of the values' mean ranks, each less the key's mean rank.

    The ranks of all values but the last are looked up by the rows, which are then summed up by the last value; that is ranked inside
    cuts and the cuts' sums are shifted by the rows before, so no rank of it is joined to anything. Best with the value of most
    distinct numbers last. Ranks of few values are broadcast (`bounded`)."""
    last, first = values[-1], list(values[:-1])
    edges = bounded(cut_edges(df, keys, last, parts))
    d = df
    for i, v in enumerate(first):
        r = count_ranks(value_counts(df.select(*keys, v), keys, [v]), keys, v, "__r", "__all")
        names = {x: f"__{i}_{k}" for k, x in enumerate([*keys, v])}
        r = bounded(r.select(*[F.col(x).alias(n) for x, n in names.items()], (F.col("__r") - (F.col("__all") + 1) / 2.0).alias(f"__a{i}")))
        d = d.join(r, [F.col(x).eqNullSafe(F.col(n)) for x, n in names.items()]).drop(*names.values())
    pairs = [(i, j) for i in range(len(first)) for j in range(i, len(first))]
    single, product = [f"__s{i}" for i in range(len(first))], [f"__p{i}_{j}" for i, j in pairs]
    d = d.groupBy(*keys, last).agg(F.count("*").alias("__n"), *[F.sum(f"__a{i}").alias(s) for i, s in enumerate(single)], *[F.sum(F.col(f"__a{i}") * F.col(f"__a{j}")).alias(p) for (i, j), p in zip(pairs, product)])
    d = with_cut(d, keys, last, edges, parts)
    inside = F.sum("__n").over(W.partitionBy(*keys, "__c").orderBy(last).rowsBetween(W.unboundedPreceding, 0)) - (F.col("__n") - 1) / 2.0
    d = d.withColumn("__i", inside)
    n, at = F.col("__n").cast("double"), F.col("__i")
    cuts = d.groupBy(*keys, "__c").agg(F.sum("__n").alias("__rows"), F.sum(n * at).alias("__t1"), F.sum(n * at * at).alias("__t2"), *[F.sum(s).alias(s) for s in single], *[F.sum(F.col(s) * at).alias(f"{s}i") for s in single], *[F.sum(p).alias(p) for p in product])
    before = F.coalesce(F.sum("__rows").over(W.partitionBy(*keys).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per cut
    cuts = cuts.withColumn("__b", before - (F.sum("__rows").over(W.partitionBy(*keys)) + 1) / 2.0)
    k, by = len(values), F.col("__b")
    cell = {(i, j): F.sum(p) for (i, j), p in zip(pairs, product)} | {(i, k - 1): F.sum(F.col(f"{s}i") + by * F.col(s)) for i, s in enumerate(single)} | {(k - 1, k - 1): F.sum(F.col("__t2") + 2 * by * F.col("__t1") + by * by * F.col("__rows"))}
    return cuts.groupBy(*keys).agg(F.sum("__rows").alias("n"), F.array(*[cell[min(i, j), max(i, j)] for i in range(k) for j in range(k)]).alias("__m"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; rows with a missing side go first; fewer than three rows or a constant side: NaN (see
    _rank_products; y is the side of more distinct numbers at best)."""
    d = df.select(*keys, finite(F.col(x)).alias("__x"), finite(F.col(y)).alias("__y")).where("__x is not null and __y is not null")
    xx, xy, yy = (F.get("__m", F.lit(i)) for i in (0, 1, 3))
    ok = (F.col("n") >= 3) & (xx > 0) & (yy > 0)
    return _rank_products(d, keys, ["__x", "__y"]).select(*keys, "n", F.when(ok, F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))).otherwise(float("nan")).alias("rho"))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank sum with average ranks; NaN where a class is absent. The input is read once: counts of the
    scores, true ones beside all, are ranked."""
    true = F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)).alias("__p")
    c = value_counts(df.select(*keys, F.col(score).alias("__s"), F.col(label)).where(F.col(label).isNotNull()), keys, ["__s"], true)
    d = count_ranks(c, keys, "__s", "__r")
    p, n = F.sum("__p"), F.sum(F.col("__n") - F.col("__p"))
    area = F.try_divide(F.sum(F.col("__r") * F.col("__p")) - p * (p + 1) / 2, p * n)
    return d.groupBy(*keys).agg(p.alias("n_pos"), n.alias("n_neg"), F.when((p > 0) & (n > 0), area).otherwise(float("nan")).alias("auc"))


def adjusted_p(df: DataFrame, p: str, ties: Sequence[str]) -> DataFrame:
    """Adds q = min(1, p n / rank) over all tests, without a monotone step. A row per test: few rows, one sort."""
    w = W.orderBy(p, *ties)
    return df.withColumn("q", F.least(F.col(p) * F.count("*").over(W.partitionBy()) / F.row_number().over(w), F.lit(1.0)))


def _log_factorial(n: Column) -> Column:
    """Logarithm of n!: the exact product's below 16, then Stirling's series (its first term left out is under 1e-13 there)."""
    x = F.greatest(n.cast("double"), F.lit(16.0))
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x
    known = F.array(*[F.lit(math.log(math.factorial(k))) for k in range(16)])
    return F.when(n < 16, F.get(known, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p: the sum of all tables with the same margins that are no likelier than the one seen. The work is a fixed number of steps
    for each such table."""
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    whole = lambda x: _log_factorial(x) + _log_factorial(col - x) + _log_factorial(row - x) + _log_factorial(n - col - row + x)
    low, high = F.greatest(F.lit(0).cast("long"), row - (n - col)), F.least(row, col)
    margins = _log_factorial(col) + _log_factorial(n - col) + _log_factorial(row) + _log_factorial(n - row) - _log_factorial(n)
    # what all tables share is an argument of a lambda, so that it is computed once
    fixed = F.array(F.struct(margins.alias("m"), (F.exp(margins - whole(a)) * (1 + 1e-7)).alias("seen")))
    term = lambda f, x: F.aggregate(F.array(F.exp(f["m"] - whole(x))), F.lit(0.0), lambda none, p: none + F.when(p <= f["seen"], p).otherwise(0.0))
    total = F.transform(fixed, lambda f: F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, x: acc + term(f, x)))
    return F.least(F.get(total, F.lit(0)), F.lit(1.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


#: Coefficients, highest power first, of the exponent's polynomial in a published fit of the complementary error function.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p of a statistic, to about 1e-7 relative."""
    u = F.abs(z) / math.sqrt(2)
    k = 1 / (1 + 0.5 * u)
    poly = F.lit(ERFC[0])
    for c in ERFC[1:]:
        poly = poly * k + c
    return F.least(k * F.exp(-u * u - 1.26551223 + poly * k), F.lit(1.0))


def association_screen(df: DataFrame, keys: Sequence[str], x: str, features: Sequence[str]) -> DataFrame:
    """(keys, feature, n, rho, p, q): rank correlation of x with each feature, its two-sided p by the normal approximation (to twelve digits, so
    that equal ones are), and q adjusted over all tests."""
    long = df.unpivot([*keys, x], list(features), "feature", "__f")
    rho = spearman(long, [*keys, "feature"], x, "__f").where(~F.isnan("rho"))
    return adjusted_p(rho.withColumn("p", F.round(two_sided_p(F.col("rho") * F.sqrt(F.col("n") - 1)), 12)), "p", [*keys, "feature"])


def wilcoxon(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Paired signed-rank test: n non-zero differences, w (smaller rank sum), two-sided p by the normal approximation with
    tie correction."""
    d = df.select(*keys, (finite(F.col(x)) - finite(F.col(y))).alias("__d")).where("__d is not null and __d <> 0")
    c = value_counts(d.withColumn("__m", F.abs("__d")), keys, ["__m"], F.sum(F.when(F.col("__d") > 0, 1).otherwise(0)).alias("__p"))
    t = F.col("__n").cast("double")
    g = count_ranks(c, keys, "__m", "__r").groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum(F.col("__r") * F.col("__p")).alias("plus"), F.sum(F.col("__r") * t).alias("all"), F.sum((t * t - 1) * t).alias("ties"))
    n = F.col("n").cast("double")
    w = F.least(F.col("plus"), F.col("all") - F.col("plus"))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (w - n * (n + 1) / 4) / F.sqrt(var)
    return g.select(*keys, "n", w.alias("w"), two_sided_p(z).alias("p"))


def parity(found: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Rows whose value is missing or further than tolerance from the expected one; empty if all is well."""
    e = expected.select(*keys, F.col(value).alias("expected"))
    return e.join(found.select(*keys, F.col(value).alias("found")), list(keys), "left").where(F.col("found").isNull() | (F.abs(F.col("found") - F.col("expected")) > tolerance))


def rank_ensemble(df: DataFrame, group: Sequence[str], a: str, b: str, weight: float, column: str = "ensemble") -> DataFrame:
    """weight times the average rank of a plus (1 - weight) times that of b, within each group."""
    df = average_ranks(df, group, {c: f"__{c}" for c in (a, b)})
    return df.withColumn(column, weight * F.col(f"__{a}") + (1 - weight) * F.col(f"__{b}")).drop(f"__{a}", f"__{b}")


def substitution_scores(conditionals: DataFrame, wild: DataFrame) -> DataFrame:
    """(entity, pos, aa, log_ratio): log-probability of aa less that of the wild residue at the place. conditionals: entity, pos, aa,
    logp; wild: entity, pos, wild."""
    base = conditionals.join(wild, ["entity", "pos"]).where("aa = wild").select("entity", "pos", F.col("logp").alias("base"))
    return conditionals.join(base, ["entity", "pos"]).select("entity", "pos", "aa", (F.col("logp") - F.col("base")).alias("log_ratio"))


def conditional_mean(df: DataFrame, keys: Sequence[str], value: str, context: str, least: float) -> DataFrame:
    """Mean over rows with enough context; null where none has."""
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(context) >= least, F.col(value))).alias("mean"))


def precision_weighted(df: DataFrame, keys: Sequence[str], value: str, precision: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(precision)) / F.sum(precision)).alias("estimate"), F.sum(precision).alias("precision"))


def partial_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, controls: Sequence[str]) -> DataFrame:
    """keys, n, rho: correlation of what is left of the ranks of x and y when those of the controls are fitted, by group; rows with a missing
    value are left out; NaN for no more rows than controls and two, or where nothing is left of a side.

    Products of centred ranks come from _rank_products, y last; a task gets a matrix per group."""
    names = [x, *controls, y]
    d = df.select(*keys, *[finite(F.col(c)).alias(f"__v{i}") for i, c in enumerate(names)]).where(" and ".join(f"__v{i} is not null" for i in range(len(names))))
    g = _rank_products(d, keys, [f"__v{i}" for i in range(len(names))])

    @F.pandas_udf("double")
    def left(n, m):
        import numpy as np
        import pandas as pd

        def one(n, m):
            c = np.roll(np.array(m, float).reshape(len(names), -1), (1, 1), (0, 1))  # y, x, controls
            a, b, z = c[:2, :2], c[:2, 2:], c[2:, 2:]
            rest = a - b @ np.linalg.pinv(z) @ b.T
            if n <= len(controls) + 2 or min(rest[0, 0], rest[1, 1]) <= 1e-9 * max(1.0, a.max()):
                return float("nan")
            return float(rest[0, 1] / np.sqrt(rest[0, 0] * rest[1, 1]))

        return pd.Series([one(*v) for v in zip(n, m)])

    return g.select(*keys, "n", F.coalesce(left("n", "__m"), F.lit(float("nan"))).alias("rho"))


def superposition_scores(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rmsd after optimal rotation (NaN for fewer than three points) and lddt (see structures.lddt) of paired points: rows (keys, i, x, y, z, px, py, pz)."""
    fields = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)

    def one(pdf):
        import pandas as pd

        from sedimark.operators.structures import lddt_of, rmsd

        a, b = pdf[["x", "y", "z"]].to_numpy(float), pdf[["px", "py", "pz"]].to_numpy(float)
        return pd.DataFrame([[*pdf[list(keys)].iloc[0], rmsd(b, a), lddt_of(a, b)]], columns=[*keys, "rmsd", "lddt"])

    return df.groupBy(*keys).applyInPandas(one, f"{fields}, rmsd double, lddt double")


def paired_wins(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, wins, losses, ties, delta) of left against right over the keys both have; missing values are left out."""
    p = left.select(*keys, *by, finite(F.col(value)).alias("__a")).join(right.select(*keys, finite(F.col(value)).alias("__b")), list(keys)).where("__a is not null and __b is not null")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col("__a"), F.col("__b")
    return p.groupBy(*by).agg(F.count("*").alias("n"), n(a > b).alias("wins"), n(a < b).alias("losses"), n(a == b).alias("ties"), F.avg(a - b).alias("delta"))


def _replicated(df: DataFrame, keys: Sequence[str], entity: str, value: str, replicates: int, salt: str) -> DataFrame:
    """(keys, rep, m): the mean of each Poisson bootstrap replicate of finite values (null where none is drawn), one map-side combined aggregate.
    Rows that are not drawn count nothing; a filter would compute every weight once more."""
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__w", poisson_weight(F.col(entity), F.col("rep"), salt))
    return reps.groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("__w") * F.col(value)), F.sum("__w")).alias("m"))


def two_sample_gap(df: DataFrame, keys: Sequence[str], side: Column, entity: str, value: str, replicates: int, salt: str, level: float = 0.95, least: int = 1) -> DataFrame:
    """(keys, n_a, n_b, mean_a, mean_b, gap, low, high, significant): mean of the rows where `side` holds less that of the others, with a
    percentile interval; either side is resampled by itself, as their entities differ. Non-finite values are left out, and keys with fewer
    than `least` rows on a side."""
    d = df.select(*keys, entity, finite(F.col(value)).alias("__v"), side.alias("__a")).where("__v is not null and __a is not null")
    flag = F.col("__a")
    g = d.groupBy(*keys).agg(F.count(F.when(flag, 1)).alias("n_a"), F.count(F.when(~flag, 1)).alias("n_b"), F.avg(F.when(flag, F.col("__v"))).alias("mean_a"), F.avg(F.when(~flag, F.col("__v"))).alias("mean_b")).where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    m = _replicated(d, [*keys, "__a"], entity, "__v", replicates, salt).groupBy(*keys, "rep").agg((F.max(F.when(flag, F.col("m"))) - F.max(F.when(~flag, F.col("m")))).alias("d"))
    tail = (1 - level) / 2
    ci = m.groupBy(*keys).agg(F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high"))
    out = g.join(ci, list(keys)) if keys else g.join(ci, F.lit(True))
    return out.withColumns({"gap": F.col("mean_a") - F.col("mean_b"), "significant": (F.col("low") > 0) | (F.col("high") < 0)})


def interaction(df: DataFrame, keys: Sequence[str], entity: str, model: str, baseline: str, group: Column, replicates: int, salt: str) -> DataFrame:
    """Difference of differences: the paired difference of two value columns, compared between the entities of a group and the others
    (n_a, n_b, mean_a, mean_b, gap, low, high, significant); three rows a side at least."""
    return two_sample_gap(df.withColumn("__d", F.col(model) - F.col(baseline)), keys, group, entity, "__d", replicates, salt, least=3)


def slopes(df: DataFrame, splits: Sequence[tuple[str, Column]], keys: Sequence[str], x: str, values: Sequence[str], least: int = 10) -> DataFrame:
    """(split, keys, value, n, rho): rank correlation of x with each value column in overlapping splits; fewer than `least` rows: left out."""
    from sedimark.operators.aggregates import overlapping

    long = overlapping(df.where(F.col(x).isNotNull()), splits, "split").unpivot(["split", *keys, x], list(values), "value", "__y")
    return spearman(long, ["split", *keys, "value"], x, "__y").where(F.col("n") >= least)


def fold_of(key: Column, folds: int, salt: str = "fold") -> Column:
    from sedimark.functions.scalars import keyed_uniform

    return F.floor(keyed_uniform(key, salt) * folds).cast("int")


def _moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> list:
    """Sums of products of all pairs of columns (and 1) by key: the normal equations, one map-side combined aggregate."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    aggs = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.groupBy(*keys).agg(*aggs).collect()  # a row per fold


def cross_validated_ridge(df: DataFrame, key: str, features: Sequence[str], target: str, folds: int = 5, ridge: float = 1.0) -> tuple[DataFrame, dict[str, float]]:
    """(df with fold and prediction from the model of the other folds, importances): ridge regression on standardised features. The normal
    equations of a fold are those of all rows less its own, so the data are read once to fit all folds; predictions are column expressions.
    The importance of a feature is the loss of R squared when its values are those of the row before in keyed order."""
    import numpy as np

    d = df.where(" and ".join(f"{c} is not null" for c in [*features, target])).withColumn("fold", fold_of(F.col(key), folds))
    names, p = [*features, target], len(features)
    sums = {}
    for r in _moments(d, ["fold"], names):
        m = np.zeros((p + 2, p + 2))
        for i in range(p + 2):
            for j in range(i, p + 2):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        sums[r["fold"]] = m
    whole = sum(sums.values())
    weights = {}
    for f, own in sums.items():
        m = whole - own
        n = m[0, 0]
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov)[:p], 1e-12))
        a = cov[:p, :p] / np.outer(scale, scale) * n
        beta = np.linalg.solve(a + ridge * np.eye(p), cov[:p, p] / scale * n) / scale
        weights[f] = (float(mean[p] - beta @ mean[:p]), beta.tolist())

    def predict(columns):
        out = F.lit(None).cast("double")
        for f, (base, beta) in weights.items():
            out = F.when(F.col("fold") == f, sum((F.lit(b) * c for b, c in zip(beta, columns)), F.lit(base))).otherwise(out)
        return out

    from sedimark.functions.scalars import keyed_hash

    scored = d.withColumn("prediction", predict([F.col(c) for c in features]))
    part = F.pmod(F.xxhash64(key), F.lit(64))  # neighbours are taken inside 64 keyed parts of a fold, not in one sort of it
    w = W.partitionBy("fold", part).orderBy(keyed_hash(F.col(key), "shuffle"), key)
    moved = d.withColumns({f"__{c}": F.coalesce(F.lag(c).over(w), F.col(c)) for c in features})
    loss = lambda x: F.sum((F.col(target) - x) ** 2)
    row = moved.agg(loss(predict([F.col(c) for c in features])).alias("base"), F.var_pop(target).alias("var"), F.count("*").alias("n"), *[loss(predict([F.col(f"__{c}" if c == k else c) for c in features])).alias(f"without {k}") for k in features]).first()
    total = (row["var"] or 0) * row["n"]
    return scored, {"r2": 1 - row["base"] / total if total else float("nan"), **{k: (row[f"without {k}"] - row["base"]) / total if total else float("nan") for k in features}}


def all_identity(rows: DataFrame, group: str, item: str, aligned: str, threshold: float = 0.8, size: int = 512, gap: str = "-") -> DataFrame:
    """(group, item, n_neighbours): how many rows of the group's alignment, itself included, agree at `threshold` or more of the places where
    both have a letter (no such place: identity 0). Equal rows of a group are one class before anything is compared."""
    classes = _class_neighbours(rows, group, aligned, threshold, size, gap)
    c = classes.select(F.col(group).alias("__g"), F.col(aligned).alias("__s"), "n_neighbours")
    return rows.join(c, (F.col(group) == F.col("__g")) & (F.col(aligned) == F.col("__s"))).select(group, item, "n_neighbours")


def _class_neighbours(rows: DataFrame, group: str, aligned: str, threshold: float, size: int = 512, gap: str = "-") -> DataFrame:
    """(group, aligned, __w, n_neighbours): the classes of equal rows of each group, how many rows they have, and how many rows of the group are
    near them. Classes are dealt to blocks, and blocks of a group meet two by two in tiles: what leaves a tile is a count per class, never
    a pair. The work grows with the square of a group's distinct rows."""
    fields = dict(rows.select(group, aligned).dtypes)
    classes = rows.groupBy(group, aligned).agg(F.count("*").alias("__w"))
    counts = classes.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("__k"))
    d = classes.join(counts, group).withColumn("__b", F.pmod(F.xxhash64(aligned), F.col("__k")).cast("int"))
    left = d.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    right = d.select(F.col(group).alias("__g"), F.col(aligned).alias("__s"), F.col("__w").alias("__m"), F.col("__b").alias("__r"), F.explode(F.sequence(F.lit(0), F.col("__k") - 1)).alias("__l"))

    def tile(a, b):
        import numpy as np
        import pyarrow as pa

        head = {c: a.column(c) for c in (group, aligned, "__w")}
        if not a.num_rows or not b.num_rows:
            return pa.table({**head, "n": pa.array(np.zeros(a.num_rows, "i8"))})
        matrix = lambda t, c: np.frombuffer("".join(t.column(c).to_pylist()).encode("ascii", "replace"), "u1").reshape(t.num_rows, -1)
        x, y = matrix(a, aligned), matrix(b, "__s")
        nx, ny = (x != ord(gap)).astype("f4"), (y != ord(gap)).astype("f4")
        both = nx @ ny.T
        same = np.zeros(both.shape, "f4")
        for c in np.unique(x):
            if c != ord(gap):
                same += (x == c).astype("f4") @ (y == c).astype("f4").T
        near = np.where(both > 0, same / np.maximum(both, 1), 0) >= threshold
        return pa.table({**head, "n": pa.array(np.where(near, b.column("__m").to_numpy(), 0).sum(axis=1))})

    out = left.groupBy(group, "__b", "__o").cogroup(right.groupBy("__g", "__l", "__r")).applyInArrow(tile, f"{group} {fields[group]}, {aligned} {fields[aligned]}, __w long, n long")
    return out.groupBy(group, aligned).agg(F.first("__w").alias("__w"), F.sum("n").alias("n_neighbours"))


def effective_depth(rows: DataFrame, group: str, item: str, aligned: str, threshold: float = 0.8) -> DataFrame:
    """(group, neff): sum over the rows of an alignment of 1 / (number of neighbours), from its classes of equal rows."""
    return _class_neighbours(rows, group, aligned, threshold).groupBy(group).agg(F.sum(F.col("__w") / F.col("n_neighbours")).alias("neff"))
