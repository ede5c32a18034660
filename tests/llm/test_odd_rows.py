"""Repeated ids with other vectors, chains through rows without an id, languages of long texts only."""

import numpy as np

from sedimark.llm import langid, simhash, vecdedup


def test_repeated_ids_of_unequal_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = base[i % 12] + rng.normal(size=16) * 0.04
        rows.append((int(rng.integers(0, 60)), v.tolist(), int(i % 3)))
    rows += [(5, rows[0][1], rows[0][2]), (5, rows[0][1], rows[0][2]), (rows[3][0], rows[7][1], rows[7][2]), (9, rows[1][1], None), (None, rows[1][1], 0), (9, None, 0)]
    got = vecdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    ok = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if None not in (i, lab) and v is not None]
    near = [[j for j in range(len(ok)) if j != k and ok[j][2] == ok[k][2] and ok[j][1] @ ok[k][1] >= 0.98] for k in range(len(ok))]
    root = [i for i, _, _ in ok]
    for _ in range(len(ok)):
        new = [min([root[k], *(root[j] for j in near[k])]) for k in range(len(ok))]
        if new == root:
            break
        root = new
    want = sorted([(i, len(near[k]), root[k], i == root[k]) for k, (i, _, _) in enumerate(ok)] + [(9, 0, 9, True), (9, 0, 9, True)])
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == want
    assert len(got) == len(rows) and all(r.audit_recall is None or r.audit_recall <= 1 for r in got)


def test_chain_through_a_row_without_id(spark):
    prints = [(1, 0), (None, 0b1111), (2, 0b11111111), (None, 1 << 63 | 0xFFFFFFF), (3, 0x0FFFFFFF00000000)]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame([*rows, (7, 0)], "doc_id long, fp long")).collect() if r.doc_id}
    assert got == {1: 1, 2: 1, 3: 3, 7: 1}


def test_a_language_of_long_texts_is_learned(spark):
    short = [(i, "the quick brown fox jumps over the lazy dog and runs " * 2, "en") for i in range(60)]
    long_ = [(100 + i, "żółć gęślą jaźń wśród łąk świeżych źdźbeł " * 700, "xx") for i in range(60)]
    df = spark.createDataFrame(short + long_, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["en", "xx"]
    got = langid.classify(df, model).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.5 for r in got)
