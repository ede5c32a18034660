"""Faults found in review, each with the case that showed it: half precision, null keys, name clashes, hot values, scans of rank plans."""

import math
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedimark.functions import scalars
from sedimark.operators import alignment, codecs, curation, evaluation, filters, joins, stats, windows
from sedimark.plans.selection import exact_passages
from sedimark.sources import sinks


def test_half_precision_is_numpy_float16(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 1e-7, 3e-5, 70000.0, -70000.0, 65519.9, 65520.0, 6e-8, 2.9e-8, 2.0**-14, 2.0**-24, 2.0**-25, 1.5 * 2.0**-24, 2047.5, 2049.0, 1.0009765625, float("inf"), -float("inf")]
    values += [r.uniform(-1, 1) * 10.0 ** r.randint(-9, 5) for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalars.half_precision(F.col("x")).alias("h")).collect()
    with np.errstate(over="ignore"):
        assert all(float(np.float16(x.x)) == x.h for x in got)
    nan = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(scalars.half_precision(F.col("x")).alias("h")).collect()
    assert np.isnan(nan[0].h) and nan[1].h is None


@pytest.mark.parametrize("width", ["1 month", "12 month", "1 day"])
def test_as_of_null_keys_match_nothing(spark, width):
    left = spark.createDataFrame([(None, "2024-01-20"), (None, "2024-03-20"), (1, "2024-03-20"), (1, "2023-12-01"), (2, None)], "k int, at string").withColumn("at", F.col("at").cast("date"))
    right = spark.createDataFrame([(None, "2024-01-10", 10.0), (1, "2024-01-10", 7.0), (1, "2024-03-01", None), (1, None, 9.0), (2, None, 3.0)], "k int, at string, v double").withColumn("at", F.col("at").cast("date"))
    got = [(r.k, str(r["at"]), r.asof_v) for r in joins.as_of(left, right, ["k"], "at", ["v"], width).collect()]
    assert sorted(got, key=str) == sorted([(None, "2024-01-20", None), (None, "2024-03-20", None), (1, "2024-03-20", 7.0), (1, "2023-12-01", None), (2, "None", None)], key=str)


def test_rewrite_keeps_a_column_named_file_and_folders_apart(spark, tmp_path):
    for folder, ids in (("a b", [3, 1, 2]), ("c", [9, 8])):
        pdf = pd.DataFrame({"id": ids, "file": [f"f{i}" for i in ids], "__row": ids})
        os.makedirs(tmp_path / folder)
        pdf.to_parquet(tmp_path / folder / "part.parquet", index=False)
    files = [str(tmp_path / "a b" / "part.parquet"), str(tmp_path / "c" / "part.parquet")]
    out = sinks.rewrite_without(spark, files, spark.createDataFrame([(1,), (9,)], "id long"), "id", str(tmp_path / "out")).collect()
    assert [(r.total, r.dropped, r.kept) for r in out] == [(3, 1, 2), (2, 1, 1)]
    assert [pd.read_parquet(tmp_path / "out" / f"0000{i}-of-00002.parquet").values.tolist() for i in range(2)] == [[[3, "f3", 3], [2, "f2", 2]], [[8, "f8", 8]]]


def test_a_rename_that_fails_is_an_error(spark, tmp_path):
    fs, _ = sinks._files(spark, str(tmp_path))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    with pytest.raises(Exception):
        sinks._renamed(fs, path(f"{tmp_path}/none"), path(f"{tmp_path}/there"))


def test_relabel_default(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(150)] + [("a",), (None,)], "c string")
    got = filters.relabel(df, "c", {"a": "b"}, "other").groupBy("c").count().collect()
    assert {r.c: r["count"] for r in got} == {"other": 151, "b": 1}


def test_exact_passages_of_every_length(spark):
    r = random.Random(3)
    words = ["aa", "bb", "Cc", "dd", "e"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 3, 4])] + [(50, "zz bb"), (51, "a bb C")]
    got = exact_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, i) for d, t in docs for i, x in items if x in t)


def hot(seed=4, n=4000):
    """Half of the rows share one value; nulls, NaN, and a key with one row."""
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.choice([7.0, r.choice([r.uniform(0, 100), float(r.randint(0, 9))])]), r.choice([7.0, r.uniform(0, 50)])) for _ in range(n)]
    return rows + [("c", 1.0, 2.0), ("a", None, 1.0), ("b", 3.0, None), ("a", float("nan"), 1.0)]


def test_ranks_by_counts(spark):
    rows = [x for x in hot() if x[1] is not None and x[1] == x[1] and x[2] is not None]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, k string, x double, y double").repartition(5)
    want = pd.DataFrame(rows, columns=["k", "x", "y"])
    got = windows.average_ranks(df, ["k"], {"x": "rx", "y": "ry"}, parts=8).toPandas().sort_values("i")
    assert np.allclose(got.rx, want.groupby("k").x.rank()) and np.allclose(got.ry, want.groupby("k").y.rank())
    assert list(got.columns) == ["i", "k", "x", "y", "rx", "ry"]
    rho = {r.k: (r.n, r.rho) for r in stats.spearman(spark.createDataFrame(hot(), "k string, x double, y double"), ["k"], "x", "y").collect()}
    for k in "ab":
        d = want[want.k == k]
        assert rho[k] == (len(d), pytest.approx(d.x.rank().corr(d.y.rank())))
    assert rho["c"][0] == 1 and np.isnan(rho["c"][1])
    whole = windows.average_rank(df, [], "x").toPandas().sort_values("i")
    assert np.allclose(whole["rank"], want.x.rank())


def test_partial_correlation_of_ranks(spark):
    r = np.random.default_rng(5)
    z = r.integers(0, 6, 500).astype(float)
    pdf = pd.DataFrame({"k": ["a"] * 400 + ["b"] * 100, "x": np.round(z + r.normal(size=500), 1), "y": np.round(z - r.normal(size=500), 1), "z": z, "w": np.round(r.normal(size=500), 1)})
    got = {x.k: x for x in stats.partial_spearman(spark.createDataFrame(pdf), ["k"], "x", "y", ["z", "w"]).collect()}
    for k, d in pdf.groupby("k"):
        m = d[["x", "y", "z", "w"]].rank()
        a = np.column_stack([np.ones(len(m)), m.z, m.w])
        left = [m[c] - a @ np.linalg.lstsq(a, m[c], rcond=None)[0] for c in "xy"]
        assert got[k].n == len(d) and got[k].rho == pytest.approx(np.corrcoef(*left)[0, 1])
    flat = spark.createDataFrame([("a", float(i), float(i), 1.0) for i in range(5)] + [("b", 1.0, 2.0, 3.0)], "k string, x double, y double, z double")
    rho = {x.k: x.rho for x in stats.partial_spearman(flat, ["k"], "x", "y", ["z"]).collect()}
    assert rho["a"] == pytest.approx(1) and np.isnan(rho["b"])


def test_scans_of_rank_plans(spark, tmp_path):
    spark.createDataFrame(hot(), "k string, x double, y double").selectExpr("*", "y > 20 as l").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")

    def scans(out):
        out.collect()
        return out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")

    assert scans(stats.spearman(df, ["k"], "x", "y")) <= 2
    assert scans(stats.auc(df, ["k"], "x", "l")) <= 2
    assert scans(stats.wilcoxon(df, ["k"], "x", "y")) <= 2
    assert scans(windows.average_rank(df, ["k"], "x")) <= 2
    assert scans(stats.rank_ensemble(df, ["k"], "x", "y", 0.5)) <= 3


def test_places_over_the_whole_table(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, 1, 2, 3]), r.choice([1.0, 2.0, 3.0])) for i in range(500)]
    got = windows.place_in_order(spark.createDataFrame(rows, "i long, a int, v double").repartition(4), "a", "v", ["i"], parts=4).collect()
    want = sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2], x[0]))
    assert [x.i for x in sorted(got, key=lambda x: x.place)] == [x[0] for x in want] and sorted(x.place for x in got) == list(range(1, 501))


def test_bisection_opens_few_files(spark, tmp_path):
    from sedimark.operators.curation import first_file_where

    for k in range(40):
        spark.range(3).selectExpr("id", f"{40 - k} as round").coalesce(1).write.parquet(f"{tmp_path}/{k:05d}")
    files = [f"{tmp_path}/{k:05d}" for k in range(40)]
    for round_ in (40, 39, 17, 2, 1):
        opened = []

        def probe(f):
            opened.append(f)
            return spark.read.parquet(f)

        assert first_file_where(spark, files, F.col("round") <= round_, probe) == files[40 - round_]
        assert len(opened) <= 6
    assert first_file_where(spark, files, F.col("round") <= 0) is None and first_file_where(spark, [], F.col("round") <= 0) is None


def test_a_file_of_parts_is_one_file(spark, tmp_path):
    parts = tmp_path / "table.parquet"
    os.makedirs(parts)
    for k, ids in enumerate(([5, 4], [0, 9, 7], [1])):
        pd.DataFrame({"id": ids}).to_parquet(parts / f"part-{k}.parquet", index=False)
    df = spark.read.parquet(str(parts))
    assert [tuple(r) for r in curation.first_file_with(df, "id", 6).collect()] == [("table.parquet", 0, 9)]
    assert sorted(r.id for r in curation.take_per_file(df, 3).collect()) == [0, 4, 5]
    assert sorted((r.row_index, r.id, r.file) for r in filters.row_addresses(df).collect()) == [(i, x, "table.parquet") for i, x in enumerate([5, 4, 0, 9, 7, 1])]


def test_lookup_expressions_see_missing_rows(spark):
    keys, found = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 0.01)], "k int, e double")
    got = curation.lookup_features(keys, "k", [(found, [("log_e", curation.log_evalue(F.col("e"))), ("e", F.col("e"))])]).collect()
    assert sorted((r.k, round(r.log_e, 9), r.e) for r in got) == [(1, 2.0, 0.01), (2, 300.0, None)]


def test_fisher_exact_is_linear_in_the_counts(spark):
    def plain(a, b, c, d):
        f = lambda k: math.lgamma(k + 1)
        row, col, n = a + b, a + c, a + b + c + d
        p = lambda x: math.exp(f(col) + f(n - col) + f(row) + f(n - row) - f(n) - f(x) - f(col - x) - f(row - x) - f(n - col - row + x))
        return min(1.0, sum(q for x in range(max(0, row + col - n), min(row, col) + 1) if (q := p(x)) <= p(a) * (1 + 1e-7)))

    cases = [(8, 2, 1, 5), (0, 3, 4, 0), (0, 0, 0, 0), (15, 16, 17, 14), (900, 1000, 1010, 990), (100_000, 100_400, 100_300, 100_000)]
    start = time.time()
    d = spark.createDataFrame(cases, "a long, b long, c long, d long")
    got = d.select("*", stats.fisher_exact(*[F.col(c) for c in "abcd"]).alias("p")).collect()
    assert time.time() - start < 60
    for r in got:
        assert r.p == pytest.approx(plain(r.a, r.b, r.c, r.d), rel=1e-6)


def test_search_deals_targets_to_tasks(spark):
    one = spark.range(400).select(F.col("id").alias("target"), F.lit("ACDEFGHIKL").alias("sequence")).coalesce(1)
    found = alignment.search(one.limit(1).withColumnRenamed("target", "query"), one, 1000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 400 and "Repartition" in plan and plan.index("MapInArrow") < plan.index("Repartition")


def test_bootstrap_weights_are_computed_once(spark):
    d = spark.createDataFrame([(i % 2, i, float(i)) for i in range(40)], "g int, id int, v double")
    for out in (stats.two_sample_gap(d, ["g"], F.col("id") % 3 == 0, "id", "v", 10, "s"), stats.bootstrap_means(d, ["g"], "id", "v", 10, "s")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and "sha1" in line]
        assert all(r.low <= r.high for r in out.collect())


def test_documents_compute_their_offset_once(spark):
    names = ["ALA", "GLY", None, "TRP"]
    entries = spark.createDataFrame([("e", names)], "entry_id string, sequence array<string>")
    contacts = spark.createDataFrame([("e", 0, 3, 2.0), ("e", 1, 3, 1.0), ("e", 0, 2, 0.5)], "entry_id string, i int, j int, degree double")
    docs = codecs.build_documents(entries, contacts, 17, least_degree=0.6)
    row = docs.first()
    assert (row.n_contacts, row.n_excluded, row.truncated) == (2, 0, False) and row.document.count("<p") == 8
    start = int(row.document.split("<p")[1].split(">")[0])
    parsed = docs.select(codecs.parse_document(F.col("document"), F.lit(4), F.lit(start)).alias("d"))
    assert parsed.first().d.asDict(True) == {"sequence": "AGXW", "pairs": [{"i": 0, "j": 3}, {"i": 1, "j": 3}]}
    plan = parsed._jdf.queryExecution().analyzed().toString()
    assert plan.index("map_from_entries") < plan.index("sequence(0")  # outside the lambda over the letters
    tight = codecs.build_documents(entries, contacts, 14).first()
    assert (tight.n_contacts, tight.n_excluded, tight.truncated) == (1, 2, True)


def test_soft_lddt_bins_are_dealt_to_tasks(spark):
    from sedimark.plans.registry import QUERIES

    plan = QUERIES["soft_lddt_of_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2


def test_half_precision_ranks_on_odd_values(spark, tmp_path):
    import duckdb

    from sedimark.plans.registry import QUERIES, SQL

    r = random.Random(3)
    values = [None, 0.0, -0.0, 1e9, -1e9] + [r.choice((-1, 1)) * 2.0 ** r.randint(-30, 20) / 137 * (1 + r.choice((0, 1e-16, -1e-16, 2e-16, 2.0**-11))) for _ in range(3000)] + [r.expovariate(0.02) for _ in range(3000)]
    pd.DataFrame({"event_id": range(len(values)), "user_id": [i % 7 for i in range(len(values))], "value": values}).to_parquet(tmp_path / "events.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(f"SELECT event_id, half, place FROM ({SQL['half_precision_ranks']})").fetchall(), key=lambda x: x[0])
    got = sorted(((x.event_id, x.half, x.place) for x in QUERIES["half_precision_ranks"](spark, str(tmp_path)).collect()), key=lambda x: x[0])
    assert [(a, b) for a, b in zip(got, want) if a != b] == []


def test_distance_join_in_tiles_of_a_crowded_cell(spark):
    """All rows in one grid cell, read as one partition: every pair is found, and more than one task finds them."""
    points = [(i, (i * 37 % 100) / 100, (i * 53 % 100) / 100) for i in range(120)]
    df = spark.createDataFrame(points, "id long, x double, y double").coalesce(1)
    out = joins.within_distance(df, df, 0.5, ("x", "y"), size=16).withColumn("task", F.spark_partition_id())
    got = out.collect()
    want = {(a, b) for a, x, y in points for b, u, v in points if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= 0.5}
    assert len(got) == len(want) and {(r.a_id, r.b_id) for r in got} == want
    assert len({r.task for r in got}) > 1


def test_rank_correlation_joins_no_ranks_to_its_last_value(spark):
    """Rows look up ranks of the first value and cuts of the last one; the last one's own ranks are summed where they are."""
    df = spark.createDataFrame(hot(), "k string, x double, y double")
    for out in (stats.spearman(df, ["k"], "x", "y"), stats.partial_spearman(df, ["k"], "y", "x", ["y"])):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" not in plan and plan.count("HashJoin") <= 3


def test_smallest_share_orders_only_ties_of_the_last_value(spark):
    """Two values, one hot: a few rows of the hot value are taken by tie, and no task is handed all rows of the value to sort."""
    rows = [("a", 1.0, (i * 7919) % 6000, float(i)) for i in range(6000)] + [("a", 0.0, i, -1.0) for i in range(10)] + [("b", None, 5, 2.0), ("b", 3.0, 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double, id long, q double").select("k", "v", "q", F.struct("id", "q").alias("t")).repartition(4)
    got = {(x.k, x.v, x.t.id) for x in windows.smallest_share(df, ["k"], "v", "t").collect()}
    assert got == {("a", 0.0, i) for i in range(10)} | {("a", 1.0, i) for i in range(50)} | {("b", None, 5)}
    below, at = windows.least_rows(df, ["k"], "v", "t")
    assert below.count() == 10 and at.count() == 51
    cuts = windows._cut(df.where("v = 1.0").withColumn("i", F.col("t.id")), ["k"], "i", 256).groupBy("__c").count()
    assert cuts.agg(F.max("count")).first()[0] < 100
    out = {x.a: (x.selected, x.best_1pct) for x in evaluation.likelihood_selection(df.withColumnRenamed("k", "a"), "a", "v", "q", "t").collect()}
    assert out["a"] == (-1.0, max(q for _, v, i, q in rows[:6000] if i < 50)) and out["b"] == (2.0, 2.0)


def test_tiles_of_a_distance_join_repeat_few_rows(spark):
    """rows in one cell are shuffled a few times, not once per thousand rows of the other side."""
    import inspect

    size = inspect.signature(joins.within_distance).parameters["size"].default
    a, b = (spark.range(n).selectExpr("id", "double(id % 100) / 100 AS x", "double(id % 7) / 10 AS y") for n in (12000, 30000))
    left, right, key = joins.tiled(a, b, 1.0, ("x", "y"), ("id", "id"), size)
    assert left.count() <= 12000 * 5 and right.count() <= 30000 * 3 and set(key) <= set(left.columns) & set(right.columns)
