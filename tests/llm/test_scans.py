"""Decontamination and lexical search by automata: brute force over words, rounds and blocks, odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from sedimark.llm import decontam, lexical, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def made(seed, n_docs=60, n_items=14):
    r = random.Random(seed)
    vocab = ["the", "The", "a", "é", "É", "x1", "öl", "ßa", "k", "日本", "b"]
    say = lambda n: "".join(r.choice(vocab) + r.choice([" ", "  ", ", ", "\n", " ", "-", " _ "]) for _ in range(n))
    items = [(k, say(r.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(n_items)]
    items += [(100, None), (101, ""), (102, " .,;"), (None, "k k k k b b"), (3, items[3][1]), (3, "öl öl öl"), (20, items[5][1])]
    docs = [(k, say(r.choice([0, 2, 12, 80])) + (r.choice(items)[1] or "") + say(r.choice([0, 5]))) for k in range(n_docs)]
    docs += [(900, None), (901, ""), (902, "!?"), (5, docs[5][1]), (None, docs[6][1]), (903, "the " * 30_000 + items[6][1]), (904, docs[7][1]), (7, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("chars", [1 << 21, 300])
def test_contaminations(spark, chars):
    docs, items = made(1)
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[a : a + 10]), set()).add(i)
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, n_hit int, Items string").repartition(3)
    out = decontam.contaminations(d, spark.createDataFrame(items, "item_id long, text string"), most_chars=chars)
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans", "contaminated"]
    got = Counter((r.doc_id, r.text, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans)), r.contaminated) for r in out.collect())
    want = Counter()
    for i, t in docs:
        w, places = words(t), [m.span() for m in WORD.finditer((t or "").translate(LOWER))]
        hit, own = set(), set()
        for size in {len(x) for x in wins}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in wins:
                    hit |= set(range(a, a + size))
                    own |= wins[tuple(w[a : a + size])]
        runs = [(a, next(b for b in range(a, len(w)) if b + 1 not in hit)) for a in sorted(hit) if a - 1 not in hit]
        want[i, t, len(w), len(hit), tuple(sorted(own - {None})), tuple((a, b, places[a][0], places[b][1]) for a, b in runs), bool(hit)] += 1
    assert got == want and sum(1 for k in want if k[-1]) > 10


def test_contaminations_of_nothing(spark):
    docs, items = made(2, 8, 8)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contaminations(d.limit(0), b).count() == 0
    none = decontam.contaminations(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_hit or r["items"] for r in none)


def search(docs, items, most=10):
    texts = {}
    for i, t in {x for x in items if x[1] is not None}:
        texts.setdefault(i, []).append(t)
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    want = set()
    for item, ts in texts.items():
        rows = []
        for doc, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in held) + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for s in sorted(ts) for t in words(s) if c[t])
            rows.append((-score, doc is None, doc or 0))
        want |= {(item, k + 1, None if n else d, -s) for k, (s, n, d) in enumerate(sorted(rows)[:most]) if s < 0}
    return want


@pytest.mark.parametrize("chars", [1 << 21, 200])
def test_ranked(spark, chars):
    docs, items = made(3)
    d = spark.createDataFrame([(i, t, "r") for i, t in docs], "doc_id long, text string, rank string").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    out = [tuple(r) for r in lexical.ranked(d, b, block_chars=chars).collect()]
    assert len(out) == len(set(out)) and set(out) == search(docs, items)


def test_ranked_of_nothing(spark):
    docs, items = made(4, 8, 8)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked(d.limit(0), b).count() == lexical.ranked(d, b.limit(0)).count() == 0
    assert lexical.ranked(d.where("doc_id > 899"), b.where("item_id > 99")).count() == 0


def test_ranked_with_many_items(spark):
    """Items enough that a task settles its rows in several steps, and documents with one word over and over."""
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(50)]
    items = [(k, " ".join(r.choices(vocab, k=6))) for k in range(300)]
    docs = [(k, " ".join(r.choices(vocab, weights=[1 / (j + 1) for j in range(50)], k=r.choice([3, 40])))) for k in range(700)]
    out = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string"), most=4)
    assert {tuple(x) for x in out.collect()} == search(docs, items, 4)


def test_queries(spark, tmp_path):
    """The registered queries against the plain versions: ids as strings in order, digests, flags."""
    docs, items = made(6, 80, 120)
    docs = [x for x in docs if x[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in queries.QUERIES["op13_lexical_scan"](spark, str(tmp_path)).collect()} == search(docs, items)
    plain = {(r.doc_id, r.text): r for r in decontam.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    texts = dict(docs)
    got = queries.QUERIES["op11_window_automaton"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and max(r.n_items for r in got) > 2
    for r in got:
        p = plain[r.doc_id, texts[r.doc_id]]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (p.n_words, p.n_hit, len(p["items"]), p.contaminated)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, p["items"]))).encode()).hexdigest()
