"""Coordinate and crop documents: parse back to the last digit, boxes by a plain loop, budgets, frames, odd rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimark.operators import spatial_documents as D


def made(spark, n_entries=6, n=40, spread=12.0):
    rng = np.random.default_rng(1)
    residues, atoms, contacts = [], [], []
    for e in range(n_entries):
        x = np.cumsum(rng.normal(size=(n, 3)) * spread / 4, axis=0)
        for i in range(n):
            residues.append((f"e{e}", i, ["ALA", "GLY"][i % 2]))
            atoms += [(f"e{e}", i, a, *(x[i] + rng.normal(size=3)).tolist()) for a in ("CA", "CB", "O1'")[: 1 + i % 3]]
        contacts += [(f"e{e}", int(i), int(j), float(rng.random())) for i in range(0, n - 8, 3) for j in (i + 3, i + 8)]
    return (
        spark.createDataFrame(residues, "entry_id string, i int, name string"),
        spark.createDataFrame([*atoms, ("e0", 1, "N", None, 0.0, 0.0), ("e0", 1, "N", float("nan"), 0.0, 0.0)], "entry_id string, i int, atom string, x double, y double, z double"),
        spark.createDataFrame(contacts, "entry_id string, i int, j int, degree double"),
    )


@pytest.fixture(scope="module")
def rows(spark):
    return D.entries(*made(spark)).cache()


def framed(row, doc):
    """The entry's atoms in the document's frame, by (residue, atom)."""
    x = np.array([[a.x, a.y, a.z] for a in row.atoms])
    x = (x - x.mean(0)) @ D.rotation(doc.quaternion).T + np.array(doc["shift"])
    return {(a.i, a.atom): v for a, v in zip(row.atoms, x)}


def start_of(doc):
    return int(doc.document.split("<n-term> <p")[1].split(">")[0])


def test_rotation_is_proper():
    q = np.array([0.5, -0.1, 0.7, 0.2])
    r = D.rotation(q / np.linalg.norm(q))
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
    assert D.digits(np.array([123.5, -4.0, 5000.0]), 3).T.tolist() == [[1, 2, 4], [0, 0, 0], [9, 9, 9]] and D.digits(np.array([180.2]), 4).T.tolist() == [[1, 8, 0, 2]]


@pytest.mark.parametrize("depth", [3, 4])
def test_coordinates_parse_back(spark, rows, depth):
    at = D.Layout(context=1200, noise=False, depth=depth)
    docs = {d.entry_id: d for d in D.coordinate_documents(rows, at).collect()}
    again = {d.entry_id: d.document for d in D.coordinate_documents(rows.repartition(7), at).collect()}
    assert {k: d.document for k, d in docs.items()} == again and len(docs) == 6
    by = {r.entry_id: r for r in rows.collect()}
    assert len(by["e0"].atoms) == len(by["e1"].atoms)
    seen = Counter()
    for m in D.coordinate_mentions(D.coordinate_documents(rows, at)).collect():
        d = docs[m.entry_id]
        want = framed(by[m.entry_id], d)[(m.p - start_of(d)) % 2000, m.atom]
        full = np.rint(want * 10 ** (depth - 3)) * 10 ** (4 - depth)  # tenths
        step = 10 ** (4 - m.depth)
        assert [m.x, m.y, m.z] == (full // step * step).astype(int).tolist()
        if m.depth == depth:  # back through the frame: the original place to half a step
            x = (np.array([m.x, m.y, m.z]) / 10 - np.array(d["shift"])) @ D.rotation(d.quaternion)
            first = np.array([[a.x, a.y, a.z] for a in by[m.entry_id].atoms])
            own = next(v for a, v in zip(by[m.entry_id].atoms, first - first.mean(0)) if (a.i, a.atom) == ((m.p - start_of(d)) % 2000, m.atom))
            assert np.abs(x - own).max() <= 10 ** (3 - depth)
        seen[m.entry_id] += 1
        assert m.n or m.depth == depth
    for k, d in docs.items():
        assert d.n_tokens == len(d.document.split(" ")) <= 1200 and d.n_mentions == seen[k] > 100 and d.truncated == (d.n_tokens < 1200 or d.truncated)
        assert d.document.count("<contact>") == d.n_contacts <= 50 and d.document.split(" ")[-1] == "<end>"
    depths = [m.depth for m in D.coordinate_mentions(D.coordinate_documents(rows, at)).where("entry_id = 'e1'").orderBy("n").collect()]
    assert np.mean(depths[1:40]) < np.mean(depths[-40:]) - 0.8


def test_noise_and_sequence(spark, rows):
    docs = D.coordinate_documents(rows, D.Layout(context=3000)).collect()
    by = {r.entry_id: r for r in rows.collect()}
    off = []
    got = {d.entry_id: d for d in docs}
    for m in D.coordinate_mentions(D.coordinate_documents(rows, D.Layout(context=3000))).where("depth = 3").collect():
        d = got[m.entry_id]
        off.append(np.array([m.x, m.y, m.z]) / 10 - framed(by[m.entry_id], d)[(m.p - start_of(d)) % 2000, m.atom])
    assert 0.3 < np.std(off) < 0.5  # a quarter of a unit, and the rounding
    for d in docs:
        head = d.document.split("<begin_statements>")[0].split("<begin_sequence>")[1].split()
        told = {head[k]: head[k + 1] for k in range(0, len(head), 2)}
        s = start_of(d)
        assert [told[f"<p{(s + i) % 2000}>"] for i in range(40)] == [f"<{r}>" for r in by[d.entry_id].residues] and told["<c-term>"] == f"<p{(s + 39) % 2000}>"


def test_crops_are_boxes(spark, rows):
    """Without noise a crop tells exactly its box's atoms, as a plain loop over all atoms finds them; only the last one may be cut."""
    at = D.Layout(context=1500, noise=False, keep=1.0, reserve=900)
    docs = {d.entry_id: d for d in D.crop_documents(rows, at).collect()}
    by = {r.entry_id: r for r in rows.collect()}
    found: dict = {}
    for m in D.crop_mentions(D.crop_documents(rows, at)).collect():
        d = docs[m.entry_id]
        who = ((m.p - start_of(d)) % 2000, m.atom)
        tenths = np.rint(framed(by[m.entry_id], d)[who] * 10).astype(int)
        assert (m.box_x, m.box_y, m.box_z) == tuple(tenths // 100)
        if m.crop:
            assert (m.x, m.y, m.z) == tuple(tenths % 100)
            found.setdefault((m.entry_id, m.crop, (m.box_x, m.box_y, m.box_z)), []).append(who)
        else:
            assert m.x is None
    assert len(found) > 60
    for (e, crop, box), who in found.items():
        d = docs[e]
        whole = sorted(k for k, v in framed(by[e], d).items() if tuple(np.rint(v * 10).astype(int) // 100) == box)
        assert sorted(who) == whole or (d.truncated and crop == d.n_crops and set(who) < set(whole))
    for d in docs.values():
        assert d.n_tokens == len(d.document.split(" ")) <= 1500 and d.document.count("<crop>") == d.n_crops and d.n_mentions >= 100


def test_crops_with_noise_stay_in_their_box(spark, rows):
    out = D.crop_documents(rows)
    again = {d.entry_id: d.document for d in D.crop_documents(rows.repartition(5)).collect()}
    assert {d.entry_id: d.document for d in out.collect()} == again
    near = D.crop_mentions(out).where("crop > 0")
    assert near.where("x < 0 or x > 99 or y < 0 or y > 99 or z < 0 or z > 99").count() == 0 and near.count() > 2000


def test_odd_entries(spark):
    schema = "entry_id string, residues array<string>, atoms array<struct<i:int,atom:string,x:double,y:double,z:double>>, contacts array<struct<i:int,j:int,degree:double>>"
    far = [(0, "CA", 0.0, 0.0, 0.0), (1, "CA", 2000.0, 0.0, 0.0)]
    df = spark.createDataFrame([("one", ["ALA"], [], []), ("none", ["ALA", "GLY"], None, None), (None, ["ALA", "GLY"], [], []), ("far", ["ALA", "GLY"], far, []), ("many", ["ALA"] * 2001, [], []), ("out", ["ALA", "GLY"], [(7, "CA", 1.0, 1.0, 1.0), (1, "CA", 0.0, 0.0, 0.0)], [(0, 9, 1.0)])], schema)
    for f in (D.coordinate_documents, D.crop_documents):
        got = {d.entry_id: d for d in f(df, D.Layout(context=200, reserve=100)).collect()}
        assert set(got) == {"none", "out"} and got["none"].n_mentions == 0 and got["out"].n_contacts == 0
        assert f(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        D.coordinate_documents(df, D.Layout(depth=5))


def test_documents_are_dealt_to_tasks(spark):
    from sedimark.plans import spatial

    rows = spatial.rows(lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet"))
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_each_atom_is_told_before_the_draws(spark):
    n = 40
    atoms = spark.createDataFrame([("e", i, "CA", 3.0 * i, 1.0, 2.0) for i in range(n)], "entry_id string, i int, atom string, x double, y double, z double")
    residues = atoms.select("entry_id", "i", F.lit("ALA").alias("name"))
    none = spark.createDataFrame([], "entry_id string, i int, j int, degree double")
    told = lambda each: D.coordinate_mentions(D.coordinate_documents(D.entries(residues, atoms, none), D.Layout(context=8 + 2 * n + 6 * n + 30, depth=4, noise=False, each=each))).where("depth = 4").select("p").distinct().count()
    assert told(True) == n and told(False) < n


def test_each_box_is_told_before_the_draws(spark):
    """chains of which draws alone leave atoms out of the crops."""
    n = 21
    rng = np.random.default_rng(3)
    places = [(e, i, "CA", *(rng.normal(size=3) * 7.5).tolist()) for e in range(60) for i in range(n)]
    atoms = spark.createDataFrame(places, "entry_id int, i int, atom string, x double, y double, z double")
    rows = D.entries(atoms.select("entry_id", "i", F.lit("ALA").alias("name")), atoms, spark.createDataFrame([], "entry_id int, i int, j int, degree double"))
    at = lambda each: D.Layout(context=8 + 2 * n + 7 * n, noise=False, keep=1.0, reserve=7 * n, each=each)
    told = lambda each: {r.entry_id: r.n for r in D.crop_mentions(D.crop_documents(rows, at(each))).where("crop > 0").groupBy("entry_id").agg(F.count_distinct("p").alias("n")).collect()}
    assert set(told(True).values()) == {n} and min(told(False).values()) < n


def test_entries_are_made_in_their_row(spark):
    """an entry of a vector needs no rows per component, hence no groups and joins."""
    from sedimark.plans import spatial

    plan = spatial.rows(lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan
