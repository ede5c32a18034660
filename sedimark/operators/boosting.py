"""Histogram gradient boosting with cross-validation and permutation importance.

Features are binned once. A level of all folds' trees costs one pass: tasks add gradients up by (model, node, feature, bin), the sums, a
bounded table, come back and the splits are broadcast. Gradients are whole multiples of a small unit, so sums, and with them splits, do not
depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.functions.scalars import keyed_hash
from sedimark.operators.checkpoints import checkpointed
from sedimark.operators.stats import fold_of


@dataclass
class Tree:
    """A full binary tree by levels: node k's children are 2k + 1 (bin <= cut) and 2k + 2; cut -1 is a leaf."""

    feature: list[int]
    cut: list[int]
    value: list[float]

    def leaves(self, codes):
        """The node that each row of bins ends in."""
        import numpy as np

        node, feature, cut = np.zeros(len(codes), "i8"), np.array(self.feature), np.array(self.cut)
        for _ in range((len(self.cut) + 1).bit_length() - 2):
            inner = cut[node] >= 0
            node = np.where(inner, 2 * node + 1 + (codes[np.arange(len(codes)), feature[node]] > cut[node]), node)
        return node

    def predict(self, codes):
        import numpy as np

        return np.array(self.value)[self.leaves(codes)]


def best_split(count, total, least: int) -> tuple[float, int, int]:
    """(gain, feature, cut) of a node's histograms (features, bins); gain 0 if no cut leaves `least` rows on either side. Of equal gains the
    first feature, then the lowest cut."""
    import numpy as np

    n, g = count.sum(1, keepdims=True), total.sum(1, keepdims=True)
    nl, gl = count.cumsum(1), total.cumsum(1)
    nr, gr = n - nl, g - gl
    ok = (nl >= least) & (nr >= least)
    gain = np.where(ok, gl.astype(float) ** 2 / np.maximum(nl, 1) + gr.astype(float) ** 2 / np.maximum(nr, 1) - g.astype(float) ** 2 / np.maximum(n, 1), 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Each feature's distinct approximate quantiles: one aggregate."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at).alias(f"f{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(features))]


def binned(df: DataFrame, key: str, features: Sequence[str], target: str, edges: list[list[float]], folds: int) -> DataFrame:
    """key, fold, y, codes (a byte per feature: 0 for a missing value, else one more than the edges below it)."""

    def code(c, e):
        x, steps = F.col(c).cast("double"), F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(e)).bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(F.get(F.array(*map(F.lit, e or [0.0])), n + s - 1) < x, s).otherwise(0)) if e else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), 0).otherwise(below + 1).cast("int")

    codes = F.concat(*[F.unhex(F.lpad(F.hex(code(c, e)), 2, "0")) for c, e in zip(features, edges)])
    return df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select(key, F.coalesce(fold_of(F.col(key), folds), F.lit(0)).alias("fold"), F.col(target).cast("double").alias("y"), codes.alias("codes"))


def _matrix(column, width: int):
    import numpy as np

    offsets, data = column.buffers()[1:]  # values of one width, without nulls: they lie one after the other
    start = int(np.frombuffer(offsets, "i4", 1, column.offset * 4)[0])
    return np.frombuffer(data, "u1", len(column) * width, start).reshape(-1, width).astype("i8")


def packed(rows: DataFrame, key: str, width: int, folds: int, parts: int, most: int = 1 << 16, longest: int = 1024) -> DataFrame:
    """(fold, codes, ys, sums): runs of up to `longest` targets of rows of a fold that have the same bins, and what each fold's model predicts
    for them (0 yet). Trees are applied once to a run. Rows are dealt by range, a hot set of bins by its keys, and packed `most` at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def made(held):
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            codes, fold = _matrix(b.column("codes"), width), b.column("fold").to_numpy()
            first = np.ones(len(fold), bool)
            first[1:] = (fold[1:] != fold[:-1]) | (codes[1:] != codes[:-1]).any(axis=1)
            at = np.arange(len(fold))
            first |= (at - np.maximum.accumulate(np.where(first, at, 0))) % longest == 0
            at = np.flatnonzero(first)
            ys = pa.ListArray.from_arrays(pa.array(np.append(at, len(fold)), pa.int32()), b.column("y"))
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * folds, pa.int32()), pa.array(np.zeros(len(at) * folds)))
            return pa.RecordBatch.from_arrays([b.column("fold").take(pa.array(at)), b.column("codes").take(pa.array(at)), ys, sums], ["fold", "codes", "ys", "sums"])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n >= most:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    dealt = rows.repartitionByRange(parts, "fold", "codes", F.xxhash64(key)).sortWithinPartitions("fold", "codes")
    return dealt.select("fold", "codes", "y").mapInArrow(run, f"fold {dict(rows.dtypes)['fold']}, codes binary, ys array<double>, sums array<double>")


@dataclass
class Boosted:
    """A model per fold: it has not seen that fold."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[list[Tree]]

    def predict(self, fold: int, codes):
        return self.base + sum((t.predict(codes) for t in self.trees[fold]), 0.0)


def fit(df: DataFrame, key: str, features: Sequence[str], target: str, folds: int = 5, rounds: int = 50, depth: int = 3, rate: float = 0.06, bins: int = 64, least: int = 20, every: int = 16) -> tuple[Boosted, DataFrame]:
    """(model, binned rows). Squared loss; rows without a target are left out, a missing feature has a bin of its own below all others.

    Rows of a fold are not used by its model. What the driver holds is bounded: folds * 2^depth * features * bins sums at a time, and the
    trees. Passes read the rows packed by their bins. Every `every` rounds these are checkpointed with what the trees so far predict, so that a pass applies the newest trees only."""
    import numpy as np

    names, width = list(features), len(features)
    edges = bin_edges(df, names, bins)
    first = df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    # both rounded, so that the order of a sum doesn't show in them: ten digits, a power of two
    base, unit = float(f"{first['m'] or 0.0:.10g}"), 2.0 ** round(math.log2(first["s"] or 1.0) - 20)
    rows = checkpointed(binned(df, key, names, target, edges, folds))
    runs = checkpointed(packed(rows, key, width, folds, max(df.sparkSession.sparkContext.defaultParallelism, rows.count() >> 20)))
    model, fresh, n_bins = Boosted(names, edges, base, [[] for _ in range(folds)]), [[] for _ in range(folds)], bins + 1
    spark = df.sparkSession

    def summed(b, newest):
        """The bins of a batch's runs, and what each fold's model predicts for them: (folds, runs)."""
        codes = _matrix(b.column("codes"), width)
        made = b.column("sums").flatten().to_numpy().reshape(-1, folds).T.copy()
        for f, trees in enumerate(newest):
            for t in trees:
                made[f] += t.predict(codes)
        return codes, made

    def level(nodes: list[list[int]], partial: list[Tree]) -> list[dict]:
        """Histograms of every fold's open nodes in one pass."""
        shared = spark.sparkContext.broadcast((fresh, nodes, partial))  # bounded: trees

        def run(batches):
            import pyarrow as pa

            newest, wanted, trees = shared.value
            count = [np.zeros((len(t.cut), width, n_bins), "i8") for t in trees]
            total = [np.zeros((len(t.cut), width, n_bins), "i8") for t in trees]
            for b in batches:
                if not b.num_rows:
                    continue
                codes, made = summed(b, newest)
                y, fold = b.column("ys").flatten().to_numpy() - base, b.column("fold").to_numpy()
                size = b.column("ys").value_lengths().to_numpy()
                start = np.cumsum(size) - size
                for f, t in enumerate(trees):
                    use = fold != f
                    if not use.any():
                        continue
                    g = np.add.reduceat(np.rint((y - np.repeat(made[f], size)) / unit), start)[use]  # whole numbers: exact
                    n, at = size[use], t.leaves(codes[use])
                    for k in range(width):
                        flat = (at * n_bins) + codes[use][:, k]
                        count[f][:, k] += np.bincount(flat, n, minlength=len(t.cut) * n_bins).reshape(-1, n_bins).astype("i8")
                        total[f][:, k] += np.bincount(flat, g, minlength=len(t.cut) * n_bins).reshape(-1, n_bins).astype("i8")
            parts = [(f, v, k, c, int(count[f][v, k, c]), int(total[f][v, k, c])) for f in range(folds) for v in wanted[f] for k in range(width) for c in np.flatnonzero(count[f][v, k])]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], pa.int64()) for i in range(6)], ["f", "v", "k", "c", "n", "g"])

        sums = runs.mapInArrow(run, "f long, v long, k long, c long, n long, g long").groupBy("f", "v", "k", "c").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()
        out: list[dict] = [{} for _ in range(folds)]
        for r in sums:
            c, g = out[r.f].setdefault(r.v, (np.zeros((width, n_bins), "i8"), np.zeros((width, n_bins), "i8")))
            c[r.k, r.c], g[r.k, r.c] = r.n, r.g
        return out

    for turn in range(rounds):
        makers = [Growing(depth, least, rate, unit) for _ in range(folds)]
        while any(m.open for m in makers):
            for m, found in zip(makers, level([m.open for m in makers], [m.tree for m in makers])):
                m.take(found)
        for f, m in enumerate(makers):
            model.trees[f].append(m.tree)
            fresh[f].append(m.tree)
        if (turn + 1) % every == 0 and turn + 1 < rounds:
            done, schema = spark.sparkContext.broadcast([list(x) for x in fresh]), runs.schema

            def applied(batches):
                import pyarrow as pa

                for b in batches:
                    if b.num_rows:
                        at = b.schema.names.index("sums")
                        yield b.set_column(at, b.schema.field(at), pa.array(summed(b, done.value)[1].T.tolist(), b.schema.field(at).type))

            runs = checkpointed(runs.mapInArrow(applied, schema))
            fresh = [[] for _ in range(folds)]
    return model, rows


class Growing:
    """A tree that grows level by level as histograms of its open nodes come in: {node: (count, total)}, each (features, bins). Children's
    values follow from their parent's histogram, so the last level needs none."""

    def __init__(self, depth: int, least: int, rate: float, unit: float):
        size = 2 ** (depth + 1) - 1
        self.tree, self.open, self.level = Tree([0] * size, [-1] * size, [0.0] * size), [0], 0
        self.depth, self.least, self.scale = depth, least, rate * unit

    def take(self, found: dict) -> None:
        following = []
        for node in self.open:
            if node not in found:
                continue
            count, total = found[node]
            n, g = int(count[0].sum()), int(total[0].sum())
            if node == 0:
                self.tree.value[0] = self.scale * g / n
            gain, feature, cut = best_split(count, total, self.least)
            if gain > 0:
                nl, gl = int(count[feature, : cut + 1].sum()), int(total[feature, : cut + 1].sum())
                self.tree.feature[node], self.tree.cut[node] = feature, cut
                self.tree.value[2 * node + 1], self.tree.value[2 * node + 2] = self.scale * gl / nl, self.scale * (g - gl) / (n - nl)
                following += [2 * node + 1, 2 * node + 2]
        self.level += 1
        self.open = following if self.level < self.depth else []


def cross_validated(df: DataFrame, key: str, features: Sequence[str], target: str, **how) -> tuple[DataFrame, DataFrame]:
    """(key, fold, y, prediction by the model that has not seen the row; fold, feature, n, r2, importance).

    The importance of a feature in a fold is the loss of R squared on the fold's rows when the feature's bins are those of the row before in
    keyed order (inside 64 keyed parts of the fold); r2 is the fold's, feature null its own row."""
    import numpy as np

    model, rows = fit(df, key, features, target, **how)
    shared, names, width, kind = df.sparkSession.sparkContext.broadcast(model), list(features), len(features), dict(df.dtypes)[key]

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                codes, fold, out = _matrix(b.column("codes"), width), b.column("fold").to_numpy(), np.zeros(b.num_rows)
                for f in np.unique(fold):
                    out[fold == f] = shared.value.predict(int(f), codes[fold == f])
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("fold"), b.column("y"), pa.array(out)], [key, "fold", "y", "prediction"])

    w = W.partitionBy("fold", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(keyed_hash(F.col(key), "shuffle"), key)
    moved = rows.withColumn("before", F.coalesce(F.lag("codes").over(w), F.col("codes")))

    def losses(batches):
        import pyarrow as pa

        acc: dict = {}
        for b in batches:
            if b.num_rows:
                codes, before, fold, y = _matrix(b.column("codes"), width), _matrix(b.column("before"), width), b.column("fold").to_numpy(), b.column("y").to_numpy()
                for f in np.unique(fold):
                    use = fold == f
                    for k in range(-1, width):
                        x = codes[use].copy()
                        if k >= 0:
                            x[:, k] = before[use][:, k]
                        lost = float(((y[use] - shared.value.predict(int(f), x)) ** 2).sum())
                        a = acc.setdefault((int(f), k), 0.0)
                        acc[int(f), k] = a + lost
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in acc], pa.int64()), pa.array([k for _, k in acc], pa.int64()), pa.array(list(acc.values()), pa.float64())], ["fold", "k", "loss"])

    loss = moved.select("fold", "y", "codes", "before").mapInArrow(losses, "fold long, k long, loss double").groupBy("fold", "k").agg(F.sum("loss").alias("loss"))
    spread = rows.groupBy("fold").agg(F.count("*").alias("n"), (F.var_pop("y") * F.count("*")).alias("total"))
    own = loss.where("k = -1").select("fold", F.col("loss").alias("own"))
    called = F.get(F.array(*[F.lit(c) for c in names]), F.col("k").cast("int"))
    report = loss.join(own, "fold").join(spread, "fold").select(
        "fold", F.when(F.col("k") >= 0, called).alias("feature"), "n", (1 - F.try_divide("own", "total")).alias("r2"),
        F.when(F.col("k") >= 0, F.try_divide(F.col("loss") - F.col("own"), F.col("total"))).alias("importance"),
    )
    return rows.mapInArrow(scored, f"{key} {kind}, fold {dict(rows.dtypes)['fold']}, y double, prediction double"), report
