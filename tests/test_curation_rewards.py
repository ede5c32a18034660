"""Edit diagnosis, rewards, curation and resampling on literal rows."""

import math

from pyspark.sql import functions as F

from sedimark.operators import curation as C
from sedimark.operators import evaluation as V
from sedimark.operators import stats as T
from sedimark.sources import readers


def stream(spark, docs, truth):
    rows = [(k, n, {"C": "contact", "R": "retract"}[s[0]], s[1], s[2]) for k, steps in docs.items() for n, s in enumerate(steps)]
    events = spark.createDataFrame(rows, "key long, n int, kind string, a int, b int")
    true = spark.createDataFrame([(k, *p) for k, ps in truth.items() for p in ps], "key long, i int, j int")
    return events, true


def diagnose(spark, steps, truth):
    events, true = stream(spark, {1: steps}, {1: truth})
    return V.diagnose_edits(events, true, "key", ["n"]).first(), V.recoveries(events, true, "key", ["n"]).first().n_recoveries


def test_edit_diagnosis_rules(spark):
    c, r = (lambda a, b: ("C", a, b)), (lambda a, b: ("R", a, b))
    d, _ = diagnose(spark, [c(50, 5), r(5, 50)], [(1, 10)])
    assert (d.retracted_fp, d.kept_fp) == (1, 0)
    d, _ = diagnose(spark, [c(1, 10), c(2, 20), r(1, 10), c(1, 10)], [(1, 10)])
    assert (d.retracted_tp, d.kept_tp) == (1, 0)
    d, _ = diagnose(spark, [r(7, 70), c(1, 10)], [(10, 1)])
    assert (d.absent_retracts, d.kept_tp, d.distance) == (1, 1, None)
    assert diagnose(spark, [c(5, 50), c(1, 11), r(5, 50), c(5, 40)], [(5, 40)])[1] == 1
    assert diagnose(spark, [c(5, 50), r(5, 50), c(5, 41)], [(9, 90)])[1] == 0
    d, n = diagnose(spark, [c(1, 2), r(1, 2), c(1, 2), c(3, 4), r(3, 4), r(3, 4)], [(1, 2)])
    assert (d.kept_tp, d.retracted_tp, d.absent_retracts, d.distance, n) == (0, 1, 1, 1.0, 1)


def test_recoveries_equal_a_plain_loop(spark):
    import random

    rnd, docs, truth = random.Random(5), {}, {}
    for k in range(40):
        docs[k] = [(rnd.choice("CCR"), *rnd.sample(range(6), 2)) for _ in range(40)]
        truth[k] = [tuple(rnd.sample(range(6), 2)) for _ in range(4)]
    events, true = stream(spark, docs, truth)
    got = {r.key: r.n_recoveries for r in V.recoveries(events, true, "key", ["n"]).collect()}
    for k, steps in docs.items():
        gt, live, waiting, n = {tuple(sorted(p)) for p in truth[k]}, set(), [], 0
        for kind, a, b in steps:
            pair = (min(a, b), max(a, b))
            if kind == "C":
                live.add(pair)
                first = next((w for w in waiting if set(w) & set(pair)), None) if pair in gt else None
                if first is not None:
                    waiting.remove(first)
                    n += 1
            elif pair in live:
                live.remove(pair)
                waiting.append(pair)
        assert got[k] == n


def test_retraction_summary_values(spark):
    events, true = stream(spark, {1: [("C", 1, 10), ("C", 5, 50), ("R", 5, 50)], 2: [("C", 1, 10), ("C", 6, 60), ("R", 6, 60)], 3: [("C", 1, 2)]}, {1: [(1, 10)], 2: [(1, 10)], 3: [(1, 2)]})
    s = V.retraction_summary(V.diagnose_edits(events, true, "key", ["n"]), V.edit_distances(events, "key", ["n"]), V.recoveries(events, true, "key", ["n"])).first()
    assert (s.n_documents, s.n_emitted, s.precision, s.base_rate, s.enrichment, s.mean_distance, s.median_distance, s.immediate_share, s.recovery_rate) == (3, 5, 1.0, 0.4, 2.5, 1.0, 1, 1.0, 0.0)
    s = V.retraction_summary(V.diagnose_edits(events.where("key = 3"), true, "key", ["n"]), V.edit_distances(events.where("key = 3"), "key", ["n"])).first()
    assert math.isnan(s.precision) and math.isnan(s.enrichment) and s.median_distance is None


def test_effective_depth_of_blocks(spark):
    rows = [(1, i, s) for i, s in enumerate(["AAAA", "AAAC", "CCCC", "----", "A---"])]
    df = spark.createDataFrame(rows, "g int, id int, s string")
    got = {r.id: r.n_neighbours for r in T.all_identity(df, "g", "id", "s", 0.7, size=2).collect()}
    want = {}
    for _, i, a in rows:
        near = 0
        for _, _, b in rows:
            both = [(x, y) for x, y in zip(a, b) if x != "-" and y != "-"]
            near += bool(both) and sum(x == y for x, y in both) / len(both) >= 0.7
        want[i] = near
    assert got == want


def test_cross_validated_ridge_equals_a_plain_fit(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2)) * [1, 50] + [3, -7]
    y = x @ [2.0, -0.1] + 5 + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    scored, importance = T.cross_validated_ridge(df, "id", ["a", "b"], "y", folds=4)
    for r in scored.where("id % 40 = 0").collect():
        use = np.array([row.fold != r.fold for row in scored.orderBy("id").select("fold").collect()])
        z = (x[use] - x[use].mean(0)) / x[use].std(0)
        beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y[use] - y[use].mean()))
        assert abs(r.prediction - (y[use].mean() + (x[r.id] - x[use].mean(0)) / x[use].std(0) @ beta)) < 1e-6
    assert importance["r2"] > 0.99 and importance["b"] > importance["a"] > 0.1


def test_resolve_reference_and_scales(spark):
    chains = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (3, "A"), (3, "B")], "e int, chain string")
    wanted = spark.createDataFrame([(1, "Z"), (2, "B"), (3, "Z"), (4, "A")], "e int, wanted string")
    assert {(r.e, r.chain, r.mode) for r in C.resolve_reference(chains, wanted, "e").collect()} == {(1, "A", "single"), (2, "B", "by_name"), (3, None, "missing"), (4, None, "missing")}
    rows = C.rescaled(spark.createDataFrame([(1.0, None), (2.0, "new"), (None, "new")], "v double, s string"), "v", "s", {"new": 0.5}, "old").collect()
    assert [tuple(r) for r in rows] == [(1.0, "old", 1.0), (1.0, "new", 2.0), (None, "", None)]


def test_clusters_are_numbered_by_file_and_line(spark, tmp_path):
    for name, n in (("a.txt", 3), ("b.txt", 500)):
        (tmp_path / name).write_text("".join(f"{name}{i} x{i}\n" + ("\n" if i % 2 else "") for i in range(n)))
    got = {r.key: r.cluster for r in readers.read_clusters(spark, str(tmp_path)).where(F.col("key").contains("txt")).collect()}
    assert all(got[f"a.txt{i}"] == i for i in range(3)) and all(got[f"b.txt{i}"] == 3 + i for i in range(500))


def test_sampling_follows_the_back_end(spark):
    import numpy as np

    from sedimark.operators import backends

    counts = np.zeros((4, 4))
    counts[0, 1] = counts[1, 2] = counts[2, 1] = 1e9
    counts[1, 3] = 1e9
    df = spark.createDataFrame([(i, [1]) for i in range(300)], "id long, ids array<int>")
    rows = backends.sampled(df, "id", "ids", lambda: backends.Bigrams(counts, 0), 6, 3).collect()
    assert all(r.sampled[-1] == 3 or len(r.sampled) == 6 for r in rows) and all(a != b for r in rows for a, b in zip([1, *r.sampled], r.sampled))
    first = [r.sampled[0] for r in rows]
    assert 0.35 < sum(x == 3 for x in first) / 300 < 0.65
    again = {r.id: r.sampled for r in backends.sampled(df.repartition(7), "id", "ids", lambda: backends.Bigrams(counts, 0), 6, 3).collect()}
    assert all(again[r.id] == r.sampled for r in rows)
    assert backends.teacher_forced(df.limit(1), "id", "ids", lambda: backends.Bigrams(counts, 0)).first().logprobs[0] > -1e-6


def test_effective_depth_compares_classes_of_equal_rows(spark):
    """Ten thousand rows of three kinds are three rows to compare; each row still counts."""
    kinds = ["AAAA", "AAAC", "CCCC"]
    df = spark.range(10_000).select(F.lit(1).alias("g"), "id", F.get(F.array(*[F.lit(k) for k in kinds]), F.pmod("id", F.lit(3)).cast("int")).alias("s"))
    assert {r.s: (r["__w"], r.n_neighbours) for r in T._class_neighbours(df, "g", "s", 0.7, size=2).collect()} == {"AAAA": (3334, 6667), "AAAC": (3333, 6667), "CCCC": (3333, 3333)}
    assert abs(T.effective_depth(df, "g", "id", "s", 0.7).first().neff - 2.0) < 1e-9
