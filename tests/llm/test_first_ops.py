"""Operators 4, 5, 7, 8, 9 and 10 against brute force, and their odd cases."""

import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sedimark.llm import ann, bpe, chat, packing, queries, sharding, simhash

ODD = [None, "", " \t\n", "a", "a b", "x " * 30000, "same text here for all", "same text here for all", "Ünï <|endoftext|> don't ٣ x²", "</s>[INST] \\0 \\a <<SYS>>"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp string"


def odd_docs(spark):
    rows = [(i, t, None, "s", 1, "clash", "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], (None, "no id", "en", None, None, None, None)], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def small_docs(spark):
    return queries.load(spark, "/root/testdata/sf0.01", "documents")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_sharding_is_gapless_and_near_equal(spark):
    docs = small_docs(spark)
    rows = sharding.shard(docs, 8).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(load) == set(range(8))
    most = max(r.size for r in rows)
    assert max(load.values()) - min(load.values()) <= 2 * most


def test_sharding_splits_a_group_of_equal_texts(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('same ', 20) else concat('text ', id, repeat('x', 90)) end as text")
    load = Counter()
    for r in sharding.shard(docs, 40).select("shard", "size").collect():
        load[r.shard] += r.size
    assert len(load) == 40 and max(load.values()) < 1.1 * min(load.values())


def test_sharding_deals_rows_that_are_equal_in_everything(spark):
    docs = spark.range(12_000).selectExpr("case when id < 10000 then cast(null as long) else id end as doc_id", "case when id < 10000 then null else concat('text ', id) end as text", "id as __e")
    rows = sharding.shard(docs.repartition(3), 40).select("shard", "size", "slot").collect()
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == 12_000 and len(load) == 40 and max(load.values()) < 1.1 * min(load.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_follows_a_plain_sort(spark):
    docs = small_docs(spark)
    rows = sharding.shard(docs, 5).select("doc_id", "shard", "slot", "size", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    plain = sorted(rows, key=lambda r: (r.h, r.doc_id))
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == [r.doc_id for r in plain]
    total, below = sum(r.size for r in rows), 0
    for r in plain:  # each row lies where its bytes lie, to within the tolerance and one row
        ideal = 5 * below / total
        assert abs(r.shard + 0.5 - ideal) <= 0.5 + 5 * (0.005 / 5 + max(x.size for x in rows) / total)
        below += r.size


def test_sharding_odd_rows(spark):
    out = sharding.shard(odd_docs(spark), 3)
    assert out.count() == 12 and dict(out.dtypes)["shard"] == "int"
    assert {r.size for r in out.where("text is null").collect()} == {16}
    assert sharding.shard(empty_docs(spark), 3).count() == 0


def test_bpe_equals_the_library(spark, library):
    docs = small_docs(spark).unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    texts = Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    want = Counter()
    for (i, t), n in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[(i, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False))] += n
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_documents(docs, queries.tokenizer_path()).collect())
    assert got == want
    assert bpe.encode_documents(empty_docs(spark), queries.tokenizer_path()).count() == 0


def test_bpe_on_random_characters(library):
    coder, rnd = bpe.Bpe(queries.tokenizer_path(), most=200), random.Random(7)
    pool = "aàéB'stdmrevell 12²½一ΣİǅſßǺ̀éñ\t\n\x1c\x1d\x85\xa0 ​　!?—😀\U00020000ⅣẞΑ\0\x01ﬁ"
    for k in range(1500):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) + ("<|endoftext|>" if k % 7 == 0 else "")
        assert coder.encode(s) == library.encode(s, add_special_tokens=False).ids, repr(s)


def reference_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, radius=4):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = small_docs(spark)
    want = {r.doc_id: reference_fp(r.text) for r in docs.collect()}
    comp = classes(want)
    for r in simhash.near_duplicates(simhash.fingerprints(docs)).collect():
        assert r.fp % (1 << 64) == want[r.doc_id] and r.component_id == comp[r.doc_id]


def test_simhash_dense_clusters_and_chains(spark):
    rnd, fps = random.Random(3), {}
    for c in range(6):
        x = rnd.getrandbits(64)
        for _ in range(60):
            fps[len(fps)] = x
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, most=500).collect()}
    assert got == classes(fps)


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(simhash.fingerprints(odd_docs(spark))).collect()
    assert len(rows) == 12 and {r.fp for r in rows if r.doc_id in (0, 1, 2)} == {0} and {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(simhash.fingerprints(empty_docs(spark))).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "b\\a</s>"), (1, 1, "user", "[INST] \n x"), (2, 1, "assistant", "first"), (2, 1, "assistant", "first"), (3, None, None, None), (3, 0, "tool<<END>>", "out\\"), (None, 1, "user", "")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "[INST] \n x"), ("assistant", "b\\a</s>")] and out[1].valid
    assert [tuple(t) for t in out[2].turns] == [("assistant", "first")] * 2 and not out[2].valid
    assert [tuple(t) for t in out[3].turns] == [("tool<<END>>", "out\\"), ("", "")]
    assert [tuple(t) for t in out[None].turns] == [("user", "")]
    assert [s.loss for s in out[1].segments] == [False, False, False, False, True, False]
    assert chat.format_chats(frame.limit(0)).count() == 0


def brute_nearest(rows, k):
    ok = {i: np.array(v, "f8") for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for q in sorted(ok):
        if q % 20 == 0:
            near = sorted(((-float(np.einsum("i,i->", ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k]
            yield q, [i for _, i in near], [-s for s, _ in near]


@pytest.mark.parametrize("block", [64, 8192])
def test_search_equals_brute_force(spark, block):
    vectors = queries.load(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    got = defaultdict(dict)
    for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), query_block=10, block=block).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    want = list(brute_nearest(rows, 20))
    assert len(want) == len(got)
    for q, ids, scores in want:
        assert [got[q][i][0] for i in range(1, 21)] == ids and np.allclose([got[q][i][1] for i in range(1, 21)], scores, rtol=1e-12)


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(60, None), (80, []), (100, [0.0, 0.0]), (120, [nan, 1.0]), (140, [inf, 1.0]), (160, [None, 1.0]), (180, [1.0, 2.0, 3.0]), (200, [-1.0, 5.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    out = defaultdict(list)
    for r in ann.search(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.vec_id)
    assert set(out) == {0, 20, 40, 200} and out[0] == [200, *range(1, 20)] and out[200] == list(range(20))
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_best_fit_decreasing_equals_plain_search():
    rnd = random.Random(5)
    for _ in range(50):
        lengths = [rnd.randint(1, 64) for _ in range(rnd.randint(0, 200))]
        free, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [f for f in free if f >= lengths[i]]
            want.append((min(fit) if fit else 64) - lengths[i])
            free.remove(min(fit)) if fit else None
            free.append(want[-1])
        places = packing.best_fit_decreasing(lengths, 64)
        ends = defaultdict(int)
        for n, (w, o) in sorted(zip(lengths, places), key=lambda x: (x[1])):
            assert ends[w] == o
            ends[w] += n
        assert sorted(64 - e for e in ends.values()) == sorted(free)


def test_packing_holds_every_id_once(spark, library):
    docs = small_docs(spark).select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text").where("doc_id < 10 and doc_id <> 6").selectExpr("doc_id + 10000 as doc_id", "text"))
    rows = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    by, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d in docs.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by[d.doc_id], key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == struct.pack(f"<{len(ids)}I", *ids) and {r.doc_tokens for r in pieces} == {len(ids)}
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(fill) <= 1.01 * sum(r.length for r in rows) / 2048 + 2
    assert packing.pack_documents(empty_docs(spark), queries.tokenizer_path()).count() == 0


def test_similar_documents_finds_near_copies(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, near, far = [], [], []
    for g in range(60):
        base = [word() for _ in range(rnd.randint(100, 400))]
        rows.append((len(rows), " ".join(base)))
        for edits, into in ((len(base) // 60, near), (len(base) // 8, far)):
            t = list(base)
            for i in rnd.sample(range(len(t)), max(1, edits)):
                t[i] = word()
            a, b = shingles(rows[3 * g][1]), shingles(" ".join(t))
            s = len(a & b) / len(a | b)
            if into is near and s >= 0.82 or into is far and s < 0.6:
                into.append((3 * g, len(rows)))
            rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert len(got) == len(rows) + 2 and got[1001] == 1000
    assert len(near) > 40 and len(far) > 40
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near) and sum(got[a] == got[b] for a, b in far) == 0


def test_similar_documents_are_decided_by_their_shingles(spark):
    import numpy as np

    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, near, far = [], [], []
    for g in range(400):
        base = [word() for _ in range(300)]
        t = list(base)
        for k in range(6 if g % 2 else 9):  # one edit changes five of 296 shingles
            t[10 + 30 * k] = word()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(t))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        (near if len(a & b) / len(a | b) >= 0.8 else far).append(2 * g)
    rows.append((9000, " ".join(rows[0][1].split()[:40] * 9)))  # a repeated passage counts once
    rows.append((9001, " ".join(rows[0][1].split()[:40] * 2)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) == 200 and len(far) == 200 and got[9001] == 9000
    assert np.mean([got[i] == got[i + 1] for i in near]) >= 0.98 and not any(got[i] == got[i + 1] for i in far)


def test_simhash_splits_hot_keys(spark):
    """Fingerprints around a few centres with `most` far below the size of their keys: links as by brute force."""
    rnd, rows = random.Random(12), []
    for c in range(3):
        base = rnd.getrandbits(64)
        for _ in range(150):
            x = base
            for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 5, 9])):
                x ^= 1 << b
            rows.append((len(rows), x - (1 << 64) if x >> 63 else x))
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    word = np.array([r[1] for r in rows]).view("u8")
    root, near = np.arange(len(rows)), np.bitwise_count(word[:, None] ^ word) <= 4
    while True:
        low = np.where(near, root, len(rows)).min(axis=1)
        if (low == root).all():
            break
        root = low
    for most in (20, 400_000):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, most=most).collect()}
        assert [got[i] for i in range(len(rows))] == root.tolist()


def test_key_runs_hold_a_large_key_once():
    import pyarrow as pa

    from sedimark.llm.common import key_runs

    keys = np.sort(np.concatenate([np.full(5000, 7), np.arange(100), np.full(900, 50)]))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 64]), pa.array(np.arange(i, min(i + 64, len(keys))))], ["k", "v"]) for i in range(0, len(keys), 64)]
    runs = list(key_runs(iter(batches), ["k", "v"], 200))
    assert np.array_equal(np.concatenate([r[0] for r in runs]), keys) and np.array_equal(np.concatenate([r[1] for r in runs]), np.arange(len(keys)))
    assert len(runs) > 2 and all(a[0][-1] < b[0][0] for a, b in zip(runs, runs[1:]))


def test_similar_documents_in_a_family_of_unequal_copies(spark):
    """A base and copies with few to many changes, some of them copies of copies: components as by all pairs."""
    rnd, base = random.Random(21), [f"w{k}" for k in range(160)]

    def changed(words, n):
        out = list(words)
        for i in rnd.sample(range(len(out)), n):
            out[i] = f"x{rnd.randrange(10**9)}"
        return out

    docs = [base]
    for k in range(260):
        docs.append(changed(rnd.choice(docs) if k % 4 == 0 else base, rnd.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])))
    docs += [[f"y{k}x{i}" for i in range(50)] for k in range(20)]
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    root = list(range(len(docs)))
    near = [[j for j in range(len(docs)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(docs))]
    while True:
        low = [min(root[j] for j in n) for n in near]
        if low == root:
            break
        root = low
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    for limits in ({}, {"block_texts": 20}, {"block_bytes": 5000}):  # one block, and a family cut into many
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame, **limits).collect()}
        assert [got[i] for i in range(len(docs))] == root


def test_cells_decide_every_pair():
    """Parts joined in a cell against sets of shingles; empty texts are alike."""
    import pyarrow as pa

    rnd = random.Random(5)
    words = [f"w{k}" for k in range(90)]
    texts = ["", " ", "one two"] + [" ".join(rnd.choice(words[:3]) if rnd.random() < 0.01 * (k % 9) else w for w in words[k % 4 :]) for k in range(80)]
    part = [k // 2 if k > 20 else k for k in range(len(texts))]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    sets = [grams(t) for t in texts]
    root = {p: p for p in part}
    pairs = [(part[i], part[j]) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    out = simhash.cell_links(0.8, 5)(pa.table({"text": texts, "part": pa.array(part, pa.int64())}))
    got = {p: p for p in part} | dict(zip(out.column("a").to_pylist(), out.column("b").to_pylist()))
    assert got == root and 3 < len(set(root.values())) < len(root)
