"""Operators on literal rows: edges, nulls, ties, contracts."""

import math
import zipfile

import pytest
from pyspark.sql import functions as F

from sedimark.functions import scalars as S
from sedimark.operators import aggregates as A
from sedimark.operators import codecs as D
from sedimark.operators import evaluation as V
from sedimark.operators import filters as P
from sedimark.operators import joins as J
from sedimark.operators import sampling as R
from sedimark.operators import setops as U
from sedimark.operators import similarity as N
from sedimark.operators import stats as T
from sedimark.operators import windows as W
from sedimark.sources import readers, sinks
from sedimark.streaming import events as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_round_selection_by_cluster(spark):
    rows = [("A", f"a{i}", 95 - 5 * i) for i in range(1, 7)] + [("B", "b1", 50), ("B", "b2", 60), ("B", "b3", 55), ("C", "c1", 88), ("C", "c2", 77), ("F", "f3", 80), ("F", "f1", 80), ("F", "f2", 80)]
    df = spark.createDataFrame(rows, "cluster string, id string, score int")
    got = {r.id: r["round"] for r in W.select_rounds(df, "cluster", "score", "id", 3, 5).collect()}
    assert got == {"a1": 0, "a2": 1, "a3": 2, "a4": 3, "a5": 4, "b2": 0, "b3": 1, "b1": 2, "f1": 0, "f2": 1, "f3": 2}


def test_coverage_modes_and_contaminants(spark):
    rows = [("FRAGMENT", .95, .12, .012), ("LONG", .35, .80, .090), ("SHORT", .35, .10, .850)]
    df = spark.createDataFrame(rows, "t string, id double, q double, c double")
    drop = lambda m: {r.t for r in df.where(P.is_contaminant(F.col("id"), P.coverage(m, F.col("q"), F.col("c")), None)).collect()}
    assert [drop(m) for m in ("shorter", "reference", "training", "both")] == [{"LONG", "SHORT"}, {"LONG"}, {"SHORT"}, set()]
    assert one(spark, P.is_contaminant(F.lit(.1), F.lit(.8), F.lit(1e-9))) and not one(spark, P.is_contaminant(F.lit(.1), F.lit(.8), F.lit(1e-9), most_evalue=None))
    assert one(spark, P.survives(F.lit(None).cast("double"), 0.3))


def test_group_key_namespaces(spark):
    key = lambda ids, h="h": one(spark, S.group_key(F.array(*map(F.lit, ids)), F.lit(h)))
    assert key([12, 7]) == key([7, 12]) and len({key([7]), key([7, 7]), key([7, 7, 7, 7]), key([7, 12])}) == 4
    assert key([-1]) != key([-1, -1]) and key([-1]).startswith("seq:")


def test_addresses(spark):
    a = "esm_atlas|00123_45_0000052aa00ab_2f6c"
    r = one(spark, S.parse_address(F.lit(a), ["esm_atlas"]))
    assert tuple(r) == ("esm_atlas", 123, 45, "0000052aa00ab_2f6c")
    assert one(spark, S.address(F.lit("esm_atlas"), F.lit(123), F.lit(45), F.lit("0000052aa00ab_2f6c"))) == a
    with pytest.raises(Exception, match="not a row address"):
        one(spark, S.parse_address(F.lit("other|1_2_x"), ["esm_atlas"]))


def test_document_parsing(spark):
    text = "<begin_sequence> <p1> <LYS> <p0> <VAL> <p1998> <MET> <p2> <GLY> <p1999> <LYS> <begin_statements> <contact> <p1998> <p2>"
    r = one(spark, D.parse_document(F.lit(text), F.lit(5), F.lit(1998)))
    assert r.sequence == "MKVKG" and [tuple(p) for p in r.pairs] == [(0, 4)]
    text = "<begin_sequence> <p0> <ALA> <p1> <XYZ> <p2> <GLY> <p7> <LEU> <begin_statements> <contact> <p0> <p7>"
    r = one(spark, D.parse_document(F.lit(text), F.lit(3), F.lit(0)))
    assert r.sequence == "AXG" and r.pairs == []


def test_statement_stream(spark):
    docs = [(1, "<contact> <p10> <p20> <retract> <p10> <p20> <contact> <p5> <p30>"), (2, "<contact> <p20> <p10> <retract> <p10> <p20>"), (3, "<contact> <p10> <p20> <retract> <p10> <p20> <contact> <p10> <p20>")]
    df = spark.createDataFrame([(k, "<begin_sequence> <contact> <p1> <p2> <begin_statements> " + t) for k, t in docs], "k long, text string")
    rows = D.fold_statements(D.statements(df, "k", "text"), "k", ["pos"]).collect()
    live = {(r.k, r.i, r.j): r.re_emits for r in rows if r.live}
    assert live == {(1, 5, 30): 0, (3, 10, 20): 1}


def test_alignment_map(spark):
    df = spark.createDataFrame([("AB-CD", "ABC-D", 5, 10)], "qaln string, taln string, qstart int, tstart int")
    assert J.alignment_map(df).first().target_to_query == {9: 4, 10: 5, 12: 7}


def test_joins_keep_their_contracts(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    with pytest.raises(ValueError, match="repeats"):
        J.validated_join(a, b, ["k"])
    with pytest.raises(ValueError, match="no match"):
        J.validated_join(a, b.where("b = 5"), ["k"], require_match=True)
    assert J.disjoint(a, b.where("k > 1"), ["k"]) and not J.disjoint(a, b, ["k"])
    names = spark.createDataFrame([("A",), ("AB",), ("B",)], "p string")
    got = {r.v: r.matched for r in J.longest_prefix(spark.createDataFrame([("AB12",), ("A",), ("ABx",), ("C1",)], "v string"), names, "v", "p").collect()}
    assert got == {"AB12": "AB", "A": "A", "ABx": None, "C1": None}
    assert one(spark, J.is_subsequence(F.lit("ace"), F.lit("abcde"))) and not one(spark, J.is_subsequence(F.lit("aec"), F.lit("abcde")))
    m = J.array_members(spark.createDataFrame([(1, [1, 2]), (2, [3])], "id int, ids array<int>"), "ids", spark.createDataFrame([(1,), (2,)], "c int"), "c").collect()
    assert [(r.id, r.n_members) for r in m] == [(1, 2)]


def test_labels_and_relabelling(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert sorted(r.c or "" for r in P.relabel(df, "c", {"a": "x"}).collect()) == ["", "x"]
    with pytest.raises(Exception, match="unknown label"):
        P.relabel(spark.createDataFrame([("z",)], "c string"), "c", {"a": "x"}).collect()
    assert one(spark, S.bucket_label(F.lit(None).cast("int"), [1], ["a", "b"], "none")) == "none"
    assert [one(spark, S.novelty_stratum(F.lit(n), F.lit(i))) for n, i in ((0, .9), (2, .1), (2, .3), (2, .7))] == ["no_homolog", "remote", "id_30_50", "id_ge_70"]


def test_scalar_functions(spark):
    assert one(spark, S.operator_count(F.lit("(1-5)(6,7)"))) == 10 and one(spark, S.operator_count(F.lit("1"))) == 1
    assert one(spark, S.shard_ranges(F.lit("0-2,20"))) == [0, 1, 2, 20]
    assert [tuple(m) for m in one(spark, S.parse_mutations(F.lit("A24G:D30N")))] == [("A", 23, "G"), ("D", 29, "N")] and one(spark, S.parse_mutations(F.lit(None))) == []
    assert [tuple(p) for p in one(spark, S.canonical_pairs(F.array(*map(F.lit, [9, 1, 1, 9, 3, 4]))))] == [(1, 9)] and one(spark, S.canonical_pairs(F.array().cast("array<int>"))) == []
    assert S.quota(10, 3, 2) == [3, 4, 3] and one(spark, S.residues(F.lit(" ag x"))) == ["ALA", "GLY", "UNK"]
    assert one(spark, S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)


def test_statistics(spark):
    assert one(spark, T.fisher_exact(F.lit(8), F.lit(2), F.lit(1), F.lit(5))) == pytest.approx(0.034965, abs=1e-5)
    df = spark.createDataFrame([("g", float(i), float(i * i), i % 3) for i in range(12)] + [("g", float("nan"), 1.0, 0), ("c", 1.0, 1.0, 0), ("c", 1.0, 2.0, 0), ("c", 1.0, 3.0, 0)], "k string, x double, y double, z int")
    rho = {r.k: r.rho for r in T.spearman(df, ["k"], "x", "y").collect()}
    assert rho["g"] == pytest.approx(1.0) and math.isnan(rho["c"])
    assert math.isnan(T.auc(df.where("k = 'c'").withColumn("l", F.lit(True)), ["k"], "y", "l").first().auc)
    pairs = spark.createDataFrame([("g", float(v), 0.0) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, -10)], "k string, x double, y double")
    w = T.wilcoxon(pairs, ["k"], "x", "y").first()
    assert (w.n, w.w) == (10, 10.0) and w.p == pytest.approx(0.0745, abs=2e-3)
    ci = T.bootstrap_means(spark.createDataFrame([("g", i, 5.0 + i % 3) for i in range(60)], "k string, e int, v double"), ["k"], "e", "v", 100, "s").first()
    assert ci.low < ci["mean"] < ci.high and ci.significant
    assert T.bootstrap_means(spark.createDataFrame([("g", 1, 5.0)], "k string, e int, v double"), ["k"], "e", "v", 10, "s").first().low is None
    part = T.partial_spearman(df.where("k = 'g'"), ["k"], "x", "y", ["z"]).first()
    assert part.n == 12 and part.rho == pytest.approx(1.0, abs=0.05)
    pts = spark.createDataFrame([("e", float(i), float(i % 3), float(i % 5), float(-(i % 3)), float(i), float(i % 5)) for i in range(10)], "k string, x double, y double, z double, px double, py double, pz double")
    s = T.superposition_scores(pts, ["k"]).first()
    assert s.rmsd == pytest.approx(0, abs=1e-6) and s.lddt == 1.0
    assert T.parity(ci_df := spark.createDataFrame([("a", 1.0)], "k string, v double"), ci_df, ["k"], "v", 0.1).count() == 0


def test_sampling_depends_on_keys_only(spark):
    df = spark.range(500).selectExpr("id % 7 as g", "id")
    pick = lambda d: sorted(r.id for r in R.subset(d, ["g"], F.col("id"), 3, "s").collect())
    assert pick(df) == pick(df.repartition(13, "id").orderBy(F.desc("id"))) and len(pick(df)) == 21
    a, b = spark.range(10).select("id"), spark.range(100, 110).select("id")
    got = {r.id for r in R.splice(a, b, ["id"], 6, "s").collect()}
    assert len(got) == 6 and len([x for x in got if x < 100]) == 3
    assert R.clean_mix(a, spark.range(20).select("id"), "id", 5, "s").where("half = 'clean'").where("id < 10").count() == 0


def test_aggregates_and_windows(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", float("nan")), ("g", 3.0), ("h", None)], "k string, v double")
    got = {r.k: (r.n, r.n_valid, r["mean"]) for r in A.group_means(df, ["k"], "v").collect()}
    assert got == {"g": (3, 2, 2.0), "h": (1, 0, None)}
    assert [(r.bin, r.n) for r in A.bincount(spark.createDataFrame([([0, 2, 2],)], "a array<int>"), "a", 4).orderBy("bin").collect()] == [(0, 1), (1, 0), (2, 2), (3, 0)]
    p, e = F.array(F.lit(1), F.lit(2)), F.array().cast("array<int>")
    assert math.isnan(one(spark, A.set_scores(p, e))["f1"]) and one(spark, A.set_scores(e, p))["f1"] == 0
    runs = spark.createDataFrame([("c", i, x) for i, x in enumerate("aabba")], "k string, n int, x string")
    with pytest.raises(ValueError, match="comes back"):
        W.run_table(runs, ["k"], ["n"], "x", unique=True)
    v = W.standardised_advantage(spark.createDataFrame([("s", 7.0)], "k string, v double"), ["k"], "v").first()
    assert v.advantage == 7.0
    scored = spark.createDataFrame([("e", i, 1.0 - i / 10, i in (0, 2)) for i in range(6)], "k string, i int, s double, t boolean")
    b = A.best_prefix_f1(scored, ["k"], "s", "i", "t").first()
    assert (b.best_f1, b.best_k) == (pytest.approx(0.8), 3)


def test_sets_and_drop_lists(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = U.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, U.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert U.is_subset(old.where("k = 1"), old, ["k"]) and not U.is_subset(new, old, ["k"])
    assert N.reconcile(once, old, ["k"]) == {"total": 3, "dropped": 2, "kept": 1} and N.tiers_up_to("B") == ("A", "B")
    a = U.aligned_union([old, new.withColumn("w", F.lit(1))], ["id", "k"])
    assert a.columns == ["id", "k", "v", "w"] and a.count() == 4


def test_evaluation_guards(spark):
    df = spark.createDataFrame([("e", 1), ("e", 2)], "e string, part int")
    with pytest.raises(ValueError, match="more than one"):
        V.refuse_split_entities(df, "e", "part")
    with pytest.raises(ValueError, match="not as it should be"):
        V.output_audit(df, "e", "part", 2, 2, spark.createDataFrame([], "e string"))
    assert V.upper_median(spark.createDataFrame([("g", x) for x in (4, 1, 3, 2)], "k string, v int"), ["k"], "v").first().median == 3


def test_token_codecs(spark):
    ids = F.array(*map(F.lit, [5, 1, 6, 1, 7]))
    assert one(spark, D.span_weights(ids, 0.1, 0.5, 1.0, 1)) == [0.1, 0.5, 0.5, 1.0, 1.0]
    assert one(spark, D.token_faults(F.array().cast("array<int>"), 5, 0, 1, 1, 9)) == ["empty", "too_short"]
    c = F.array(F.struct(F.lit(1).alias("seq_i"), F.lit(9).alias("seq_j"), F.lit(0.5).alias("degree")))
    assert one(spark, D.from_parallel(D.to_parallel(c))) == one(spark, c)
    items = F.array(*map(F.lit, range(8)))
    assert sorted(one(spark, D.shuffled(items, F.lit("k"), "s"))) == list(range(8)) and one(spark, D.shuffled(items, F.lit("k"), "s")) == one(spark, D.shuffled(items, F.lit("k"), "s"))
    assert one(spark, D.draft_size(F.lit(5), 1.5, F.lit(0.0))) == 1 and one(spark, D.draft_size(F.lit(5), 1.0, F.lit(0.999999))) == 5
    assert one(spark, D.sequence_document(F.array(F.lit("ALA")))) == "<begin_sequence> <p0> <ALA> <begin_statements> <end>"
    assert one(spark, D.pause_overhead(F.lit("k"), 1.0, 0.5, 4)) >= 4 and one(spark, D.pause_overhead(F.lit("k"), 0.0, 0.5, 4)) == 0


def test_readers(spark, tmp_path):
    import numpy as np

    (tmp_path / "x.fasta").write_text(">a one two\nAC\nGT\n>b\nTT\n")
    assert [tuple(r) for r in readers.read_fasta(spark, f"{tmp_path}/x.fasta").collect()] == [("a", "one two", "ACGT"), ("b", "", "TT")]
    (tmp_path / "h.m8").write_text("q\tt\t0.5\t10\t0.1\t0.2\t1e-5\t40\n")
    assert readers.read_hits(spark, f"{tmp_path}/h.m8").first().evalue == 1e-5
    (tmp_path / "c.txt").write_text("a b\nc\n")
    assert {(r.key, r.cluster) for r in readers.read_clusters(spark, f"{tmp_path}/c.txt").collect()} == {("a", 0), ("b", 0), ("c", 1)}
    (tmp_path / "m.a3m").write_text(">a\nACd-\n>b\nA-T\n")
    assert {r.aligned for r in readers.read_a3m(spark, f"{tmp_path}/m.a3m").collect()} == {"AC-", "A-T"}
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "set__one.npz", score=np.arange(4.0).reshape(2, 2))
    np.savez(tmp_path / "npz" / "set__bad.npz", score=np.zeros(3))
    assert [tuple(r) for r in readers.read_score_matrices(spark, f"{tmp_path}/npz").orderBy("i", "j").collect()][-1] == ("set", "one", 1, 1, 3.0)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "m,s\nA1B,0.5\n")
    assert readers.read_zipped_csv(spark, f"{tmp_path}/z.zip", ["m", "s"]).first().s == "0.5"
    (tmp_path / "cif").mkdir()
    (tmp_path / "cif" / "1abc.cif").write_text("data_1ABC\n_exptl.method 'X-RAY DIFFRACTION'\n_refine.ls_d_res_high 1.8\n")
    r = readers.scan_headers(spark, f"{tmp_path}/cif", {"method": "_exptl.method", "resolution": "_refine.ls_d_res_high", "date": "_no.thing"}).first()
    assert (r.method, r.resolution, r.date) == ("X-RAY DIFFRACTION", "1.8", None)
    assert readers.structures(spark, f"{tmp_path}/cif", "text").first().entry_id == "1abc"
    spark.createDataFrame([(" ", "t1"), ("id", "t2")], "i string, text string").coalesce(1).write.parquet(f"{tmp_path}/p")
    ids = sorted(r.entry_id for r in readers.with_row_id(spark.read.parquet(f"{tmp_path}/p"), "i").collect())
    assert ids[0] == "id" and ids[1].endswith(":row0")
    with pytest.raises(ValueError, match="not in"):
        readers.resolve_columns(spark.range(1), ["nope"])
    rows = readers.map_rows(spark.range(4), lambda r: {"y": 10 // r["id"]} if r["id"] != 2 else None, "y int", lenient=True)
    assert sorted(r.y for r in rows.collect()) == [3, 10]
    assert [r.group for r in readers.size_groups(spark.createDataFrame([(c, 10) for c in "abcd"], "path string, size long"), 2).orderBy("path").collect()] == [0, 0, 1, 1]
    assert readers.as_glob("a/b") == "a/b/*.parquet" and readers.as_glob("a/*.parquet") == "a/*.parquet"


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("half"))
    assert sinks.write_documents(df, f"{tmp_path}/d", "v1") == 10 and spark.read.parquet(f"{tmp_path}/d").columns[-1] == "structure"
    with pytest.raises(ValueError, match="no documents"):
        sinks.write_documents(df.limit(0), f"{tmp_path}/e", "v1")
    sinks.write_evaluation(spark, f"{tmp_path}/ev", "v1", {"p": 0.5}, {"n": 3, "deep": {"a": 1}}, df)
    assert spark.read.parquet(f"{tmp_path}/ev/summary.parquet").first().extras_json == '{"deep": {"a": 1}}'
    df.where("half = 1").write.parquet(f"{tmp_path}/r")
    assert {r.id for r in sinks.pending(df, spark, f"{tmp_path}/r", "id").collect()} == {0, 2, 4, 6, 8}
    assert sinks.pending(df, spark, f"{tmp_path}/nothing", "id").count() == 10
    sel = spark.range(23).selectExpr("'train' as split", "cast(id % 3 as int) as round", "id")
    shards = sinks.write_rounds(sel, f"{tmp_path}/w", "split", 4, "id").orderBy("shard").collect()
    assert [r["round"] for r in shards] == sorted((r["round"] for r in shards), reverse=True) and max(r.n for r in shards) <= 4 and sum(r.n for r in shards) == 23


def test_filtered_rewrite_keeps_files_and_order_and_resumes(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    files = [f"{tmp_path}/in-{i}.parquet" for i in range(4)]
    ids = [[5, 3, 9, 1], [2, 4], [], [8, 7, 6, 11, 10]]
    for f, x in zip(files, ids):
        pq.write_table(pa.table({"id": pa.array(x, pa.int64()), "text": [f"t{i}" for i in x]}), f)
    dropped = spark.createDataFrame([(9,), (2,), (4,), (8,), (99,)], "id long")
    out = sinks.rewrite_without(spark, files, dropped, "id", f"{tmp_path}/out").collect()
    assert [(r.total, r.dropped, r.kept) for r in out] == [(4, 1, 3), (2, 2, 0), (0, 0, 0), (5, 1, 4)]
    names = [f"{i:05d}-of-00004.parquet" for i in range(4)]
    assert sorted(n for n in os.listdir(f"{tmp_path}/out") if not n.startswith(".")) == names
    read = lambda n: pq.read_table(f"{tmp_path}/out/{n}")
    assert [read(n).column("id").to_pylist() for n in names] == [[5, 3, 1], [], [], [7, 6, 11, 10]] and read(names[1]).schema.names == ["id", "text"]
    stamp = os.stat(f"{tmp_path}/out/{names[0]}").st_mtime_ns
    os.remove(f"{tmp_path}/out/{names[3]}")
    sinks.rewrite_without(spark, files, dropped, "id", f"{tmp_path}/out")
    assert os.stat(f"{tmp_path}/out/{names[0]}").st_mtime_ns == stamp and read(names[3]).column("id").to_pylist() == [7, 6, 11, 10]
    os.remove(f"{tmp_path}/out/.{names[0]}.crc")
    pq.write_table(pa.table({"id": pa.array([1], pa.int64()), "text": ["x"]}), f"{tmp_path}/out/{names[0]}")
    with pytest.raises(ValueError, match="kept rows"):
        sinks.rewrite_without(spark, files, dropped, "id", f"{tmp_path}/out")
    assert sinks.write_shards(spark.range(9).selectExpr("id", "id % 2 * 2 as s"), f"{tmp_path}/k", "s", 4, ["id"]) == [1, 3]
    assert spark.read.parquet(f"{tmp_path}/k").count() == 9


def test_row_functions_and_early_stop(spark, tmp_path):
    df = spark.range(20, numPartitions=4)

    def make():
        made = []

        def one(row):
            made.append(row["id"])
            return None if row["id"] % 3 == 0 else [{"id": row["id"], "n": len(made)} for _ in range(row["id"] % 3)]

        return one

    for threads in (1, 4):
        rows = readers.flat_map_rows(df, make, "id long, n long", threads).collect()
        assert [r.id for r in rows] == [i for i in range(20) for _ in range(i % 3)] and max(r.n for r in rows) <= 5

    def bad():
        return lambda row: 1 // 0

    with pytest.raises(Exception, match="division"):
        readers.flat_map_rows(df, bad, "id long", 2).count()
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    stream = readers.batches_of(spark.range(1000, numPartitions=10).mapInArrow(watch, "id long"), 30)
    assert [r.id for r in next(stream)] == list(range(30)) and seen.value <= 200
    stream.close()
    df.write.parquet(f"{tmp_path}/t")
    assert readers.query_files(spark, "select sum(id) as s from {t} where id > 17", {"t": f"{tmp_path}/t"}).first().s == 37


def test_streams(spark, tmp_path):
    rows = [("k", 1, "contact", 1, 2), ("k", 2, "contact", 3, 4), ("k", 3, "retract", 2, 1), ("j", 1, "retract", 5, 6)]
    spark.createDataFrame(rows, "key string, n long, kind string, a int, b int").selectExpr("hash(key) as h", "*").selectExpr("cast(case key when 'k' then 1 else 2 end as long) as key", "n", "kind", "a", "b").write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema("key long, n long, kind string, a int, b int").parquet(f"{tmp_path}/s")
    got = {r.key: (r.n_live, r.emits, r.retracts) for r in X.drain(X.live_pairs(stream, None), "live_pairs", "update", f"{tmp_path}/c").collect()}
    assert got == {1: (1, 2, 1), 2: (0, 0, 1)}
    mean = X.drain(X.running_average(stream.selectExpr("key", "n", "cast(a as double) as value"), 0.5), "means", "update", f"{tmp_path}/c2")
    assert {r.key: r["mean"] for r in mean.collect()} == {1: 2.0, 2: 5.0}


def test_builders(spark):
    from sedimark.operators import builders as B

    chains = spark.createDataFrame([(f"e{k}", c, 20 + 3 * c) for k in range(20) for c in range(k % 4 + 1)] + [("big", 0, 90), ("big", 1, 90)], "entry_id string, chain int, length int")
    rows = B.layout_chains(chains, 150, 5).collect()
    assert {r.entry_id for r in rows} == {f"e{k}" for k in range(20)}
    for k in range(20):
        mine = sorted((r for r in rows if r.entry_id == f"e{k}"), key=lambda r: r.slot)
        used = [(r.start + x) % 150 for r in mine for x in range(r.length)]
        assert len(set(used)) == len(used)
        if len(mine) > 1:
            gaps = [(b.start - a.start - a.length) % 150 for a, b in zip(mine, [*mine[1:], mine[0]])]
            assert min(gaps) >= 5 and sum(gaps) + sum(r.length for r in mine) == 150
    draws = spark.createDataFrame([("g", i, float(w), 0.5) for i, w in enumerate((1, 0, 3, 4))], "k string, i int, w double, u double")
    assert B.weighted_draw(draws, ["k"], ["i"], "w", "u").first().i == 3
    res = spark.createDataFrame([("e", i, "GLY", 2.0 * math.cos(i), 2.0 * math.sin(i), 0.1 * i, 80.0) for i in range(40)] + [("one", 0, "GLY", 0.0, 0.0, 0.0, 80.0)], "entry_id string, i int, name string, x double, y double, z double, quality double")
    r = B.distance_documents(res, 200).collect()
    assert len(r) == 1 and r[0].document.count("<contact>") == r[0].n_contacts > 0 and r[0].document.count("<distance>") == r[0].n_distances > 0
    assert len(r[0].document.split()) <= 200 and r[0].document.split()[-2] == "<q2>"


def test_command_line(spark, tmp_path, capsys):
    from sedimark.__main__ import main

    main(["list"])
    assert "round_selection" in capsys.readouterr().out
    main(["run", "round_selection", "--tables", "/root/testdata/sf0.001", "--out", f"{tmp_path}/o"])
    assert spark.read.parquet(f"{tmp_path}/o").count() > 0
    main(["explain", "round_selection", "--tables", "/root/testdata/sf0.001"])
    assert "PushedFilters" in capsys.readouterr().out
    main(["sql", "round_selection"])
    assert "row_number" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "nothing", "--tables", "x"])


def test_short_passages_are_found_like_long_ones(spark):
    from sedimark.plans.selection import exact_passages

    words = "the quick brown fox jumps over the lazy dog again".split()
    texts = [" ".join(words), "xx" + " ".join(words) + "yy", "lazy  dog", "", "un" + " ".join(words[3:7])]
    items = [" ".join(words[a : a + n]) for n in range(1, 9) for a in (0, 2)] + ["nothing", " fox ", "og ag", "azy dog a", "ick brown fox ju"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, item string")
    got = sorted((r.doc_id, r.item_id) for r in exact_passages(docs, frame).collect())
    assert got == sorted((d, i) for d, x in enumerate(texts) for i, y in enumerate(items) if y in x)
