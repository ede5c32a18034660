"""The registered queries, through their registry, on small tables: the columns they promise against brute force."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sedimark.llm import queries

TEXT = "The quick brown fox jumps over the lazy dog, says the old man by the river bank in the morning light. "
LONG = " ".join(f"w{k % 997}" for k in range(9000))
DOCS = [
    *[(i, TEXT * (1 + i % 3) + f"number {i} " * (i % 5), "en", "a", 1) for i in range(20)], (20, None, "en", "a", 0), (21, "", None, "b", 0), (22, " \t\n", "en", "b", 3), (23, LONG, "en", "b", len(LONG)),
    (24, "Müller läßt grüßen — ßß 123 " * 9, "de", "a", 9), (25, "A a A a", "en", None, 7), (26, "a a a a", "en", None, 7), (27, "one two", "en", "c", 7), (28, TEXT * 2 + "x", "en", "c", 7), (29, " nbsp wide words here\x1cand\x85more", "fr", "c", 7),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 8)), 4, axis=0) + rng.normal(size=(120, 8)) * 0.05
    rows = [(i, r.astype("f4").tolist(), i % 3) for i, r in enumerate(x)] + [(120, None, 1), (140, [0.0] * 8, 1), (160, [float("nan")] * 8, 0), (180, x[0].astype("f4").tolist(), None), (200, x[0].astype("f4").tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), rows


def run(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf[0]).collect()]


def vectors(rows):
    return {i: (lab, np.array(v, "f8")) for i, v, lab in rows if v is not None and np.isfinite(np.array(v, "f8")).all() and any(v)}


def test_op3(spark, sf):
    ok, got = vectors(sf[1]), {r["vec_id"]: r for r in run(spark, sf, "op3_flat_graph")}
    near = {i: [j for j in ok if j != i and None not in (ok[i][0], ok[j][0]) and ok[i][0] == ok[j][0] and ok[i][1] @ ok[j][1] / np.linalg.norm(ok[i][1]) / np.linalg.norm(ok[j][1]) >= 0.98] for i in ok}
    root = {i: i for i, _, _ in sf[1]}
    for _ in range(10):
        root = {i: min([root[i], *(root[j] for j in near.get(i, []))]) for i in root}
    assert len(got) == len(sf[1])
    for i in root:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, [])), root[i], root[i] == i)


def test_op4(spark, sf):
    got, texts = run(spark, sf, "op4_histogram_sort"), {i: t or "" for i, t, *_ in DOCS}
    slots = defaultdict(list)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(DOCS) and all(sorted(v) == list(range(len(v))) and 0 <= k < 40 for k, v in slots.items())


def test_op5(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: r for r in run(spark, sf, "op5_trie_bpe")}
    for i, t, *_ in DOCS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_op6(spark, sf):
    seen, got = set(), {r["doc_id"]: r for r in run(spark, sf, "op6_interval_tree")}
    for i, t, *_ in DOCS:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                gone[a : a + 100] = True
            seen.add(data[a : a + 100])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op7(spark, sf):
    prints = {}
    for i, t, *_ in DOCS:
        data = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())
        words = re.findall(rb"[^\x20\x09-\x0D]+", data)
        shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in prints}
    for _ in range(len(prints)):
        root = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
    got = {r["doc_id"]: r for r in run(spark, sf, "op7_bk_simhash")}
    assert all((got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[i]:016x}", root[i]) for i in prints)


def test_op9(spark, sf):
    ok, got = vectors(sf[1]), defaultdict(list)
    for r in run(spark, sf, "op9_block_matrix_search"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ok if i % 20 == 0]
    assert set(got) == set(asked)
    for q in asked:
        want = sorted(((-(ok[q][1] @ ok[j][1]), j) for j in ok if j != q))[:20]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and [r[1] for r in rows] == [j for _, j in want]
        assert np.allclose([r[2] for r in rows], [-s for s, _ in want], rtol=0, atol=1e-12)


def test_op10(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rows, pieces, filled = run(spark, sf, "op10_best_fit_packing"), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in DOCS:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r["length"]
        assert at == len(ids)
    for spans in filled.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 2048


def test_op1_and_op2_columns(spark):
    small = "/root/testdata/sf0.001"
    n = queries.load(spark, small, "documents").count()
    one, two = queries.QUERIES["op1_string_kernel"](spark, small).collect(), queries.QUERIES["op2_co_training"](spark, small).collect()
    assert len(one) == len(two) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in one)
    assert Counter(r.doc_id for r in one) == Counter(r.doc_id for r in two)
