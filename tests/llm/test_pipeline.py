"""The learned operators and the pipeline's stages."""

import zlib

import corpus_pipeline
import pytest

from sedimark.llm import langid, quality, queries, vecdedup

ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! 123 ###", "en", "a", 3), (4, "a", None, None, None), (4, "a", None, None, None), (None, "short text without an id", "en", "b", 5)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    return spark.createDataFrame([(*r, 7, True) for r in ODD], DOCS + ", score int, keep boolean")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: queries.load(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels", "embeddings")}


def test_language_held_out(spark):
    rows = queries.op1_string_kernel(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in queries.load(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_odd_rows(spark, tables):
    model = langid.fit(tables["documents"])
    out = langid.classify(odd(spark), model).collect()
    assert len(out) == 6 and [r.lang_pred for r in out if r.doc_id in (1, 2, 3)] == ["und"] * 3 and all(r.lang_pred != "und" for r in out if r.doc_id == 4)
    assert langid.classify(odd(spark).limit(0), model).count() == 0
    assert langid.fit(odd(spark).limit(0)) is None
    assert {r.lang_pred for r in langid.classify(odd(spark), None).collect()} == {"und"}


def test_language_of_large_scripts(spark):
    """Six scripts of 400 letters each beside Latin and Cyrillic; texts of several thousand letters too."""
    import random

    rnd, rows = random.Random(3), []
    for k, first in enumerate((0x61, 0x430, 0x4E00, 0x5200, 0xAC00, 0xB000, 0x20000, 0x20400)):
        letters = [chr(first + i) for i in range(26 if k < 2 else 400)]
        for i in range(60):
            n = 5000 if i == 0 else 120
            rows.append((len(rows), " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 6))) for _ in range(n)), f"l{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 60 < 30"))
    out = langid.classify(docs.where("doc_id % 60 >= 30 or doc_id % 60 = 0"), model).collect()
    assert all(r.lang_pred == r.lang for r in out)


def test_language_kernel_by_brute_force():
    """Presence, kernel and scores of the blocks against sets of n-grams."""
    import numpy as np

    rows = [("a", "Straße und Haus"), ("a", "das Haus, 12 Häuser"), ("b", "the house and street"), ("b", "houses!! of a street"), ("a", "Haus"), ("b", "street")]
    model = langid.train(rows)

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = " " + " ".join(s.split()) + " "
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    maker = langid.Presence(model.columns)
    chosen = [rows[i][1] for i in (0, 2, 1, 3, 4, 5)]  # a text of each language in turn
    for t in ["Haus an der Straße", "house 7", "x"]:
        p, n = maker.block([t])
        got = ((p @ model.landmarks) / np.sqrt(n[:, None] * model.sizes))[0]
        want = [len(grams(t) & grams(c)) / (len(grams(t)) * len(grams(c))) ** 0.5 for c in chosen]
        assert np.allclose(got, want)


def test_quality_on_labels_kept_out(spark):
    """Trained on the labels of half the documents, measured on the other half's."""
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.load(spark, sf, "documents"), queries.load(spark, sf, "labels")
    half = "crc32(cast(cast(doc_id as string) as binary)) % 2 = 0"
    model = quality.fit(docs, labels.where(half))
    out = quality.score(docs, model).join(labels.where(f"not ({half})"), "doc_id").select("keep", "quality", "toxic", "quality_page", "quality_words").collect()
    good, junk, toxic = [r.keep for r in out if r.quality and not r.toxic], [r.keep for r in out if not r.quality], [r.keep for r in out if r.toxic]
    print(len(out), sum(good) / len(good), sum(junk) / len(junk), sum(toxic) / len(toxic))
    assert sum(good) >= 0.98 * len(good) and sum(toxic) <= 0.12 * len(toxic) and sum(junk) <= 0.08 * len(junk)
    # calibrated: in each tenth of the scores the share of good rows is near the mean score
    for k in range(10):
        part = [r for r in out if k / 10 <= r.quality_words < (k + 1) / 10]
        assert len(part) < 60 or abs(sum(r.quality for r in part) / len(part) - sum(r.quality_words for r in part) / len(part)) < 0.15


def test_quality_views_see_different_things():
    rows = [(b"some words here", "a", "en", 15), (b"Other TEXT 123 !!!", "a", "en", 15)]
    model = quality.Model({b"some": 0}, [[0.5]] * 9, [10], {"source a": 0}, {}, {})
    pages, words = model.pages(rows), model.words([r[0] for r in rows])
    assert (pages[0] == pages[1]).all() and (words[0] != words[1]).any()
    assert (model.pages([(b"x", None, None, None)])[0] == [0, 0, 1, 0]).all()


def test_quality_exchange_hands_each_row_over_once(spark, tables):
    import numpy as np

    docs = tables["documents"].where("text is not null")
    pool = docs.selectExpr("xxhash64(text) as key", "cast(text as binary) as text", "source", "lang", "n_chars")
    labels = {r.doc_id: r for r in tables["labels"].collect()}
    rows = [(r.text.encode(), r.source, r.lang, r.n_chars, labels[r.doc_id]) for r in docs.collect() if r.doc_id in labels]
    targets = {t: np.array([int(r[4][t] > 0) for r in rows]) for t in quality.TASKS}
    model = quality.train([r[:4] for r in rows], targets, rounds=0)
    pick = quality._confident(pool, 0.9, 20)
    first, second = ([(t, v, y, r) for t, v, y, r in pick(model)] for _ in range(2))
    assert first and not {(t, v, y, r[0]) for t, v, y, r in first} & {(t, v, y, r[0]) for t, v, y, r in second}
    probs = model.certainty([r for *_, r in first])
    assert all((p if y else 1 - p) >= 0.9 for (t, v, y, _), p in zip(first, [probs[t][v][i] for i, (t, v, _, _) in enumerate(first)]))


def test_quality_odd_rows(spark, tables):
    assert quality.fit(tables["documents"], tables["labels"].limit(0)) is None
    model = quality.fit(tables["documents"], tables["labels"])
    out = quality.score(odd(spark), model)
    assert out.count() == 6 and out.where("keep is null or quality_score is null").count() == 0
    assert quality.score(odd(spark), None).where("keep").count() == 6
    assert quality.score(odd(spark).limit(0), model).count() == 0


def linked(rows, least=0.98):
    import numpy as np

    ok = {i: (lab, np.array(v, "f8")) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for i, (lab, v) in ok.items():
        out[i] = [j for j, (other, w) in ok.items() if j != i and lab == other and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least]
    root = {i: i for i in out}
    while True:
        new = {i: min([root[i], *(root[j] for j in out[i])]) for i in out}
        if new == root:
            return {i: (len(out[i]), root[i]) for i in out}
        root = new


def test_vector_groups_equal_brute_force(spark):
    import numpy as np

    rng, rows = np.random.default_rng(4), []
    for c in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12]) * np.linalg.norm(base) / 4).tolist(), int(c % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [(9000 + k, v, 1) for k, v in enumerate([None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]])]
    rows += [(9100, rows[0][1], None), (9101, rows[0][1], 5)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    want = linked(rows)
    for size in (40, 2048):
        got = {r.vec_id: r for r in vecdedup.near_duplicates(frame, size=size).collect()}
        assert len(got) == len(rows)
        for i, _, _ in rows:
            assert (got[i].n_links, got[i].component_id) == want.get(i, (0, i)) and got[i].kept == (got[i].component_id == i)
        assert got[0].audit_recall == 1.0
    assert vecdedup.near_duplicates(frame.limit(0)).count() == 0


def test_pipeline_stages_chain(spark, tables):
    sf, docs = "/root/testdata/sf0.01", tables["documents"].unionByName(spark.createDataFrame(ODD, DOCS))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count() <= before, name
            before, docs = out.count(), out
    assert out.agg({"length": "max"}).first()[0] <= 2048 and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_stages_take_empty_tables(spark, tables):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, tables["documents"].limit(0), "/root/testdata/sf0.01").count() == 0


def test_removed_passages_leave_whole_characters(spark):
    text = "é" * 80
    docs = spark.createDataFrame([(1, "x" + text, "fr", "a", 81), (2, "ab" + text + "ü", "fr", "a", 83)], DOCS)
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert out[1] == "xé" and out[2].encode().decode() == out[2] and out[2].startswith("ab") and len(out[2]) < 10


def test_near_duplicates_decide_per_id_and_text(spark):
    text = lambda tag, n=200: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, text("a")), (2, text("a", 199)), (2, text("b")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (None, text("e", 199)), (None, text("d", 199))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = [(r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(map(str, out)) == sorted(map(str, [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "e")]))


def test_vector_groups_larger_than_a_list_are_linked(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    u, w = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    group = lambda base: base + rng.normal(size=(200, 64)) * 1e-3
    x = np.concatenate([group(u), group(0.985 * u + np.sqrt(1 - 0.985**2) * w), rng.normal(size=(200, 64))])
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = v @ v.T >= 0.98
    assert near[:200, 200:400].all()
    frame = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdedup.near_duplicates(frame).collect()}
    assert all(got[i] == (near[i].sum() - 1, 0 if i < 400 else i) for i in range(600))


def test_a_dense_group_larger_than_its_shards_loses_no_link(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    base = rng.normal(size=48)
    x = np.concatenate([base + rng.normal(size=(5400, 48)) * 0.142 * np.linalg.norm(base) / 48**0.5, rng.normal(size=(600, 48))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    share = near[:5400, :5400].mean()
    assert 0.2 < share < 0.999
    frame = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vecdedup.near_duplicates(frame).collect()}
    assert all(got[i].n_links == near[i].sum() - 1 for i in range(6000)) and got[0].audit_recall == 1.0
    linked = np.flatnonzero(near.sum(axis=1) > 1)
    assert {got[i].component_id for i in linked.tolist()} == {int(linked[0])} and all(got[i].component_id == i for i in set(range(6000)) - set(linked.tolist()))


def test_audit_makes_a_label_exact(spark):
    """Shards too small for their groups and without overlap lose pairs; the audit sees it and the label is compared in full."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = np.repeat(rng.normal(size=(40, 32)), 8, axis=0)
    x = base + rng.normal(size=base.shape) * 0.09
    rows = [(i, r.tolist(), i % 2) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = linked(rows)
    got = {r.vec_id: r for r in vecdedup.near_duplicates(frame, size=4, overlap=1).collect()}
    assert all((got[i].n_links, got[i].component_id) == want[i] for i in want) and got[0].audit_recall == 1.0
    loose = vecdedup.near_duplicates(frame, size=4, overlap=1, audit=0).agg({"n_links": "sum"}).first()[0]
    assert loose < sum(n for n, _ in want.values())


def test_language_stage_without_languages_and_with_a_foreign_text(spark, tables):
    bare = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "123", None, "s", 3), (3, None, None, "s", 0)], DOCS)
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, bare, "").collect()] == [1]
    foreign = spark.createDataFrame([(-1, "".join(chr(0x1000 + i % 37) for i in range(400)), None, "s", 400)], DOCS)
    out = corpus_pipeline.language_id(spark, tables["documents"].unionByName(foreign), "").select("doc_id").collect()
    assert -1 not in {r.doc_id for r in out} and len(out) >= 0.999 * tables["documents"].where("text rlike '[a-z]'").count()


def test_pipeline_leaves_one_folder(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    (folder,) = [d for d in os.listdir(tmp_path) if d.startswith("pipeline-")]
    assert os.listdir(tmp_path / folder) == ["repeated_passages"]
