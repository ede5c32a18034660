"""Merkle manifest: a plain tree by lists, stored levels, proofs, odd rows."""

import hashlib
import zlib

import pytest

from sedimark.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fan=3):
    """Levels of a tree, and of each leaf the siblings on its way up: (before, after)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[a : a + fan]) for a in range(0, len(low), fan)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for low in levels[:-1]:
            a = i - i % fan
            way.append(("".join(low[a:i]), "".join(low[i + 1 : a + fan])))
            i //= fan
        ways.append(way)
    return levels[-1][0], ways


def folded(node, way):
    for a, b in way:
        node = h(a, node, b)
    return node


def key(x):
    return (x is not None, x if x is not None else 0)


@pytest.mark.parametrize("fan,every", [(3, 4), (3, 1), (2, 3), (4, 2)])
def test_manifest(spark, fan, every):
    sizes = {None: 5, "": 1, "a": 90, "b": 3, "é": 28, "Z": 2, "zz": 260}
    rows = [(t, i % 70, h(f"{t} {i}")) for t, n in sizes.items() for i in range(n)]
    rows += [("b", 1, h("same"))] * 3 + [("b", None, h("none"))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "tree string, doc_id long, digest string, place string").repartition(5)
    got = merkle.manifest(df.drop("place"), ["doc_id"], fan, every).collect()
    groups = {t: sorted((key(d), x) for u, d, x in rows if u == t) for t in {r[0] for r in rows}}
    order = sorted(groups, key=lambda t: (t is not None, (t or "").encode()))
    plain = {t: tree([x for _, x in groups[t]], fan) for t in order}
    root, tops = tree([plain[t][0] for t in order], fan)
    want = sorted((t or "", t is None, d, x, plain[t][0], root, way + tops[k]) for k, t in enumerate(order) for (d, x), way in zip(groups[t], plain[t][1]))
    assert sorted((r.tree or "", r.tree is None, key(r.doc_id), r.digest, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got) == want
    assert all(folded(r.digest, r.proof) == r.root for r in got)


def test_levels_that_are_stored(spark):
    df = spark.range(1000).selectExpr("'t' AS tree", "id AS doc_id", "sha2(string(id), 256) AS digest")
    kept = merkle.stored_levels(merkle.numbered(df, ["doc_id", "digest"]), 3, 4)
    assert [k.count() for k in kept] == [1000, 13, 1]


def test_of_nothing_and_one(spark):
    df = spark.createDataFrame([("t", 1, h("x"))], "tree string, doc_id long, digest string")
    assert merkle.manifest(df.limit(0), ["doc_id"]).count() == 0
    (r,) = merkle.manifest(df, ["doc_id"]).collect()
    assert (r.subroot, r.root, r.proof) == (h("x"), h("x"), [])


def test_query(spark, tmp_path):
    """The registered query on odd rows: nulls in every column, repeated rows, tampered texts, one long text."""
    rows = [(i, f"line {i}\nnext\n" * (i % 4), ["en", None][i % 2], [None, "a", "", "é"][i % 7 % 4], i) for i in range(60)]
    rows += [rows[7], rows[7], (None, "x\ny", "en", "a", 1), (60, None, None, "lonely", None), (61, "", "de", "a", 0), (62, "long\n" * 200_000, "de", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    leaves = [(s, d, leaf(d, s, l, n, t), leaf(d, s, l, n, t.replace("\n", "") if t is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t)) for d, t, l, s, n in rows]
    groups = {s: sorted((key(d), x, y) for u, d, x, y in leaves if u == s) for s in {x[0] for x in leaves}}
    order = sorted(groups, key=lambda t: (t is not None, (t or "").encode()))
    plain = {s: tree([x for _, x, _ in groups[s]]) for s in order}
    root, tops = tree([plain[s][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for (d, x, y), way in zip(groups[s], plain[s][1]):
            way = way + tops[k]
            want.append((d, x, plain[s][0], root, h(*(a + b for a, b in way)), folded(y, way), folded(y, way) == root))
    assert sorted((key(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert {r.verified for r in got} == {True, False}
