"""Operator 6 against brute force."""

import random

from sedimark.llm import queries, suffix


def brute(texts, least):
    """texts: [(order key, bytes)] -> removed places of each."""
    seen, out = set(), {}
    for key, data in sorted(texts):
        gone = set()
        for i in range(len(data) - least + 1):
            w = data[i : i + least]
            if w in seen:
                gone.update(range(i, i + least))
            seen.add(w)
        out[key] = gone
    return out


def check(spark, texts, least=100, most=200_000):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, kept string").repartition(5)
    want = brute([(i, (t or "").encode()) for i, t in texts.items()], least)
    rows = suffix.remove_repeats(docs, least, most).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(data) and r.text == (texts[r.doc_id] or "")
        assert {x for s in r.spans for x in range(s.start, s.start + s.size)} == want[r.doc_id], r.doc_id
        assert bytes(r.kept) == bytes(b for i, b in enumerate(data) if i not in want[r.doc_id])
        assert all(a.start + a.size < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_real_documents(spark):
    docs = queries.load(spark, "/root/testdata/sf0.001", "documents")
    check(spark, {r.doc_id: r.text for r in docs.collect()})


def test_shared_passages_edits_and_periods(spark):
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdefgé ") for _ in range(n))
    passages, texts = [noise(n) for n in (99, 100, 101, 150, 400, 1500)], {}
    for i in range(120):
        parts = [noise(rnd.randint(0, 120)) if rnd.random() < 0.6 else "" for _ in range(4)]
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p))
            parts.insert(rnd.randint(0, len(parts)), p if rnd.random() < 0.5 else p[a:] + p[: a // 2])
        t = "".join(parts)
        if i % 9 == 0:
            t += "For " * rnd.randint(10, 90)
        if i % 10 == 0 and i:
            t = texts[i - 10]
            if i % 20 and t:
                a = rnd.randrange(len(t))
                t = t[:a] + "X" + t[a + 1 :]
        texts[rnd.randint(0, 10**6) * 1000 + i] = t
        texts[i] = t
    texts |= {-5: None, -6: "", -7: "a" * 99, -8: "a" * 100, -9: "a" * 350, -10: "a" * 1200}
    check(spark, texts)
    check(spark, texts, least=40, most=50)


def test_very_long_text(spark):
    rnd = random.Random(2)
    part = "".join(rnd.choice("abcdefgh") for _ in range(5000))
    long = "".join(rnd.choice("stuvwxyz") for _ in range(1_100_000))
    check(spark, {3: long + part, 7: part + long[5000:300_000] + part[100:220] + long[1_040_000:1_060_000]})


def test_repeated_rows_and_ids(spark):
    a, b = "one text " * 3 + "x" * 80 + "end", "other " * 30
    docs = spark.createDataFrame([(1, a), (1, a), (2, a), (2, b), (None, b)], "doc_id long, text string")
    rows = suffix.remove_repeats(docs).collect()
    assert len(rows) == 5
    got = sorted((r.doc_id or 0, r.text, len(r.kept)) for r in rows)
    assert [g for g in got if g[0] == 1] == [(1, a, len(a))] * 2
    assert [g[2] for g in got if g[0] == 2 and g[1] == a] == [0] and [g[2] for g in got if g[0] == 2 and g[1] == b] == [0]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
