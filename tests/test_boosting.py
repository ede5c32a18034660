"""Boosted trees: every split equals that of a plain fit in memory on the same bins; missing values, partitions, importances."""

import numpy as np
import pandas as pd
import pytest

from sedimark.operators import boosting as B


def plain(codes, y, fold, base, folds, rounds, depth, least, rate, unit):
    """Boosting by recursion over row sets, without histograms: lists of (node, feature, cut, value) by fold and round."""
    out = []
    for f in range(folds):
        use = fold != f
        x, target, made, trees = codes[use], y[use], np.zeros(use.sum()), []
        for _ in range(rounds):
            g = np.rint((target - base - made) / unit).astype(int)
            nodes, add = {}, np.zeros(len(x))

            def grow(node, rows, level):
                value = rate * unit * int(g[rows].sum()) / len(rows)
                best = (0.0, 0, 0)
                if level < depth:
                    for k in range(x.shape[1]):
                        for cut in range(int(x[:, k].max()) + 1):
                            left = rows[x[rows, k] <= cut]
                            nl, nr = len(left), len(rows) - len(left)
                            if nl >= least and nr >= least:
                                gl, gr = float(g[left].sum()), float(g[rows].sum() - g[left].sum())
                                gain = gl**2 / nl + gr**2 / nr - (gl + gr) ** 2 / len(rows)
                                if gain > best[0]:
                                    best = (gain, k, cut)
                nodes[node] = (best[1], best[2], value) if best[0] > 0 else (None, None, value)
                if best[0] > 0:
                    below = x[rows, best[1]] <= best[2]
                    grow(2 * node + 1, rows[below], level + 1)
                    grow(2 * node + 2, rows[~below], level + 1)
                else:
                    add[rows] = value

            grow(0, np.arange(len(x)), 0)
            made = made + add
            trees.append(nodes)
        out.append(trees)
    return out


def table(n=240, seed=1):
    r = np.random.default_rng(seed)
    a, b, c = r.normal(size=n), r.integers(0, 5, n).astype(float), r.random(n)
    y = np.where(a > 0.3, 2.0, -1.0) + b * 0.5 + r.normal(size=n) * 0.1
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "y": y})
    return [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in t) for t in [*pdf.itertuples(index=False, name=None), (n, None, 1.0, 0.5, 1.0), (n + 1, float("nan"), None, None, 0.0), (n + 2, 1.0, 1.0, 1.0, None)]]


def test_splits_equal_a_plain_fit(spark):
    rows = table()
    df = spark.createDataFrame([tuple(None if v is None else int(v) if i == 0 else float(v) for i, v in enumerate(t)) for t in rows], "id long, a double, b double, c double, y double")
    how = dict(folds=3, rounds=5, depth=3, rate=0.3, bins=16, least=10, every=2)
    model, held = B.fit(df.repartition(3), "id", ["a", "b", "c"], "y", **how)
    again, _ = B.fit(df.repartition(1), "id", ["a", "b", "c"], "y", **how)
    assert [[t.__dict__ for t in f] for f in model.trees] == [[t.__dict__ for t in f] for f in again.trees]
    pdf = held.select("id", "fold", "y", "codes").toPandas().sort_values("id")
    assert len(pdf) == 242 and pdf.codes.iloc[240][0] == 0 and list(pdf.codes.iloc[241]) == [0, 0, 0]
    codes, y, fold = np.array([list(c) for c in pdf.codes]), pdf.y.to_numpy(), pdf.fold.to_numpy()
    want = plain(codes, y, fold, model.base, 3, 5, 3, 10, 0.3, 2.0 ** round(np.log2(np.std(y)) - 20))
    splits = 0
    for f in range(3):
        for tree, nodes in zip(model.trees[f], want[f]):
            for k, (feature, cut, value) in nodes.items():
                assert (tree.feature[k], tree.cut[k]) == ((feature, cut) if feature is not None else (0, -1))
                assert tree.value[k] == pytest.approx(value)
                splits += feature is not None
    assert splits > 40


def test_cross_validated(spark):
    rows = [t for t in table(1500, 2) if None not in t]
    df = spark.createDataFrame([(int(t[0]), *map(float, t[1:])) for t in rows if t[1] == t[1]], "id long, a double, b double, c double, y double")
    scored, report = B.cross_validated(df, "id", ["a", "b", "c"], "y", folds=3, rounds=12, rate=0.3, bins=32, every=5)
    s, r = scored.toPandas(), report.toPandas()
    assert len(s) == df.count() and s.id.is_unique
    for f, d in s.groupby("fold"):
        r2 = 1 - ((d.y - d.prediction) ** 2).sum() / ((d.y - d.y.mean()) ** 2).sum()
        mine = r[r.fold == f].set_index("feature", drop=False)
        assert r2 > 0.9 and mine.r2.iloc[0] == pytest.approx(r2) and mine.n.iloc[0] == len(d)
        lost = {k: v for k, v in zip(mine["feature"], mine["importance"]) if k}
        assert set(lost) == {"a", "b", "c"} and lost["a"] > 0.5 and lost["b"] > 0.1 and abs(lost["c"]) < 0.02


def test_of_nothing(spark):
    df = spark.createDataFrame([], "id long, a double, y double")
    scored, report = B.cross_validated(df, "id", ["a"], "y", folds=2, rounds=2)
    assert scored.count() == 0 and report.count() == 0
    one = spark.createDataFrame([(1, 1.0, 5.0)], "id long, a double, y double")
    assert [r.prediction for r in B.cross_validated(one, "id", ["a"], "y", folds=2, rounds=2)[0].collect()] == [5.0]


def test_rows_are_packed_by_their_bins(spark):
    """Five thousand rows of one set of bins and a few others: runs of bounded length hold every target once, next to its own bins."""
    rows = [(i, i % 2, float(i), bytes([7, 7]) if i < 5000 else bytes([i % 3, 1])) for i in range(5060)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, codes binary").repartition(5)
    got = B.packed(df, "id", 2, 2, parts=3, most=700, longest=100).collect()
    assert sorted((y, r.fold, bytes(r.codes)) for r in got for y in r.ys) == sorted((y, f, c) for _, f, y, c in rows)
    assert len(got) < 120 and max(len(r.ys) for r in got) <= 100 and all(r.sums == [0.0, 0.0] for r in got)
