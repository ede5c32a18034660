"""Sequence search against a plain Smith-Waterman: identity, coverages, E-values, recall; frequent words; bands; odd rows."""

import math
import random

import numpy as np
import pytest

from sedimark.operators import alignment as A

S = A.Scoring()


def plain(a, b, s):
    """Textbook local alignment with affine gaps by loops: (score, path), ties as the operator's docstring says."""
    table, far = s.table(), -(10**9)
    n, m = len(a), len(b)
    H = [[0] * (m + 1) for _ in range(n + 1)]
    E, Fm = [[far] * (m + 1) for _ in range(n + 1)], [[far] * (m + 1) for _ in range(n + 1)]
    best, end = 0, None
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            E[i][j] = max(H[i][j - 1] - s.opening, E[i][j - 1] - s.extension)
            Fm[i][j] = max(H[i - 1][j] - s.opening, Fm[i - 1][j] - s.extension)
            H[i][j] = max(0, H[i - 1][j - 1] + table[a[i - 1], b[j - 1]], E[i][j], Fm[i][j])
            if H[i][j] > best:
                best, end = H[i][j], (i, j)
    path = []
    if end:
        i, j = end
        while H[i][j] > 0:
            if H[i][j] == H[i - 1][j - 1] + table[a[i - 1], b[j - 1]]:
                path.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif H[i][j] == Fm[i][j]:
                while Fm[i][j] == Fm[i - 1][j] - s.extension and Fm[i][j] > H[i - 1][j] - s.opening:
                    i -= 1
                i -= 1
            else:
                while E[i][j] != H[i][j - 1] - s.opening:
                    j -= 1
                j -= 1
    return best, path[::-1]


def mutated(r, s, rate, gaps=0.02):
    out = []
    for c in s:
        x = r.random()
        if x < gaps:
            continue
        if x < 2 * gaps:
            out.append(r.choice(A.RESIDUES))
        out.append(r.choice(A.RESIDUES) if r.random() < rate else c)
    return "".join(out)


def family(seed, n, low=20, high=90):
    r = random.Random(seed)
    roots = ["".join(r.choices(A.RESIDUES, k=r.randint(low, high))) for _ in range(max(1, n // 6))]
    return [mutated(r, r.choice(roots), r.choice([0.05, 0.2, 0.4])) for _ in range(n)]


def test_align_is_smith_waterman():
    r = random.Random(1)
    seqs = [S.codes(x) for x in family(1, 60)] + [S.codes("".join(r.choices("ACX", k=40))) for _ in range(6)]
    pairs = [(r.choice(seqs), r.choice(seqs)) for _ in range(200)]
    assert [(s, list(map(tuple, p.tolist()))) for s, p in A.align(pairs, S)] == [plain(a, b, S) for a, b in pairs]
    assert A.best_scores(pairs, S) == [s for s, _ in A.align(pairs, S)]
    narrow = A.align(pairs, S, [(1 - len(a), len(b) - 1) for a, b in pairs])
    assert [(s, p.tolist()) for s, p in narrow] == [(s, p.tolist()) for s, p in A.align(pairs, S)]


def test_bands_widen():
    r = random.Random(2)
    a = "".join(r.choices(A.RESIDUES, k=900))
    b = a[:400] + "".join(r.choices(A.RESIDUES, k=60)) + a[400:]
    job = (S.codes(a), S.codes(b), [0, 60], 1)
    (_, score, path), = A.aligned([job], S, full_cells=10, pad=8)
    want, full = A.align([job[:2]], S)[0]
    assert score == want and path.tolist() == full.tolist()


def test_search_equals_all_pairs(spark):
    """300 x 300 sequences: what is found equals the plain alignment in all fields, and at least 0.9 of the pairs with E <= 1e-3 are found."""
    seqs = family(3, 300, 40, 70)
    q = spark.createDataFrame(list(enumerate(seqs)), "query long, sequence string")
    got = {(x.query, x.target): x for x in A.search(q, q.withColumnRenamed("query", "target"), most=300, evalue=10.0).collect()}
    rate, factor = A.calibrated(S)
    letters, codes = sum(map(len, seqs)), [S.codes(x) for x in seqs]
    pairs = [(i, j) for i in range(300) for j in range(300)]
    tops = {p: s for at in range(0, len(pairs), 900) for p, s in zip(pairs[at : at + 900], A.best_scores([(codes[i], codes[j]) for i, j in pairs[at : at + 900]], S))}
    e = {(i, j): factor * len(codes[i]) * letters * math.exp(-rate * s) for (i, j), s in tops.items()}
    true = {p for p in e if e[p] <= 1e-3}
    assert len(true & set(got)) / len(true) >= 0.9 and len(true) > 1500
    assert all((i, i) in got for i in range(300))
    hits = sorted(got)
    scores = {p: x for at in range(0, len(hits), 500) for p, x in zip(hits[at : at + 500], A.align([(codes[i], codes[j]) for i, j in hits[at : at + 500]], S))}
    for p, x in got.items():
        score, path = scores[p]
        (q0, t0), (q1, t1) = path[0], path[-1]
        n = (q1 - q0) + (t1 - t0) + 2 - len(path)
        assert (x.score, x.alnlen, x.qstart, x.qend, x.tstart, x.tend) == (score, n, q0 + 1, q1 + 1, t0 + 1, t1 + 1)
        assert x.evalue == pytest.approx(e[p]) and x.evalue <= 10 and x.bits == pytest.approx((rate * score - math.log(factor)) / math.log(2))
        assert x.fident == pytest.approx(sum(codes[p[0]][a] == codes[p[1]][b] for a, b in path) / n)
        assert (x.qcov, x.tcov) == pytest.approx(((q1 - q0 + 1) / len(codes[p[0]]), (t1 - t0 + 1) / len(codes[p[1]])))
    some = random.Random(4).sample(sorted(got), 60)
    assert all(plain(codes[i], codes[j], S)[0] == got[i, j].score for i, j in some)


def test_blocks_and_frequent_words(spark):
    """Small blocks, halves of the queries and single queries over the limit of pairs find what one block finds."""
    r = random.Random(5)
    seqs = family(5, 60) + ["A" * 80, "AC" * 50, "A" * 30 + "".join(r.choices(A.RESIDUES, k=40))]
    q = spark.createDataFrame(list(enumerate(seqs)), "query long, sequence string")
    t = q.withColumnRenamed("query", "target").repartition(3)
    whole = sorted(map(tuple, A.search(q, t, evalue=1e-2).collect()))
    assert sorted(map(tuple, A.search(q, t, evalue=1e-2, block=700).collect())) == whole
    assert set(whole) <= set(map(tuple, A.search(q, t, evalue=1e-2, most_pairs=50).collect()))
    counts = {}
    for x in A.search(q, t, most=3).collect():
        counts.setdefault(x.query, []).append(x)
    assert max(map(len, counts.values())) == 3 and all(any(x.target == k for x in v) for k, v in counts.items() if k < 60)


def test_odd_rows(spark):
    q = spark.createDataFrame([(1, None), (2, ""), (3, "ACD"), (None, "ACDEFGHIKLMNPQRSTVWYACDEFG"), (4, "ACDEFGHIKLMNPQRSTVWYACDEFG"), (4, "ACDEFGHIKLMNPQRSTVWYACDEFG"), (5, "ÄÖ" * 20)], "query long, sequence string")
    t = q.withColumnRenamed("query", "target")
    got = sorted((x.query or 0, x.target or 0) for x in A.search(q, t).collect())
    assert got == [(0, 0), (0, 4), (0, 4), (4, 0), (4, 4), (4, 4)]
    assert A.search(q.limit(0), t).count() == A.search(q, t.limit(0)).count() == 0


def test_matrix_text():
    text = "# a comment\n   A C\nA  4 -1\nC -1  9\n"
    s = A.Scoring("AC", ("A", "C"), matrix=A.read_matrix(text, "AC"))
    assert s.table().tolist() == [[4, -1, -2], [-1, 9, -2], [-2, -2, -2]]
    assert A.align([(s.codes("xxACCA"), s.codes("ACCAyy"))], s)[0][0] == 26


def test_law_fits_unrelated_pairs():
    """Of 1,000 unrelated pairs about one in twenty has a chance value below 0.05."""
    rate, factor = A.calibrated(S)
    rng = np.random.default_rng(11)
    made = rng.integers(0, 20, (2, 1000, 128)).astype("u1")
    scores = np.array(A.best_scores(list(zip(*made)), S))
    share = (1 - np.exp(-factor * 128**2 * np.exp(-rate * scores)) < 0.05).mean()
    assert 0.02 < share < 0.09


def test_scores_come_first():
    """F2 to F5: the pairs that reach their query's score, many at once, are those of the plain kernels; so are the seeds of given pairs."""
    r = random.Random(8)
    seqs = [S.codes(x) for x in family(8, 80, 5, 120)] + [S.codes("".join(r.choices("ACX", k=k))) for k in (1, 3, 40, 200)]
    for scoring in (S, A.Scoring(opening=3, extension=2), A.Scoring(same=40, like=9, unlike=-25)):
        queries, targets = seqs[::3], seqs[::2] * 3
        scores = np.array(A.best_scores([(a, b) for a in queries for b in targets], scoring)).reshape(len(queries), -1)
        for goal in (1, 20, 60, 300):
            least = [goal + k % 3 for k in range(len(queries))]
            for cells in (1 << 19, 2000):
                got = np.zeros(scores.shape, int)
                for x, y in A.reaching(queries, least, targets, scoring, cells):
                    got[x, y] += 1
                assert (got == (scores >= np.array(least)[:, None])).all()
    for drift, most in ((24, 1 << 21), (0, 1 << 21), (24, 30)):
        seeds = A.Seeds(queries, S, 4, 80, most, drift)
        want = {(k, j) for j, b in enumerate(targets) for k, _ in seeds.candidates(b)}
        pairs = [(k, j) for k in range(len(queries)) for j in range(len(targets))]
        assert {p for p, ok in zip(pairs, A.seeded([(queries[k], targets[j]) for k, j in pairs], seeds)) if ok} == want and want


def test_tasks_without_targets():
    """A task that runs although no target has a letter gives no rows."""
    class Shared:
        value = [(1, "ACDEFGHIKLMNPQRSTVWY")]

    run = A.Search(S, (0.3, 0.1))._task(Shared, 0, lambda v: S.codes(v[0]), lambda hits: [], A.HIT)
    assert sum(b.num_rows for b in run(iter([]))) == 0
