"""Back ends are asked in batches; hidden places equal a plain enumeration."""

import math

import numpy as np

from sedimark.operators import backends


def test_masked_marginals(spark):
    class Counted(backends.Bigrams):
        """Writes down how many rows each call brings."""

        def masked(self, rows, places):
            assert len(rows) == len(places) <= 5
            return super().masked(rows, places)

        def forced(self, rows):
            assert len(rows) <= 3
            return super().forced(rows)

    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (4, 4)).astype(float)
    rows = [(i, [int(x) for x in rng.integers(0, 4, n)]) for i, n in enumerate([0, 1, 2, 7, 3])] + [(9, None)]
    df = spark.createDataFrame(rows, "id long, ids array<int>").coalesce(1)
    p = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    got = {(r.id, r.pos, r.token): (r.wild, r.logp) for r in backends.masked_marginals(df, "id", "ids", lambda: Counted(counts, 0), 5).collect()}
    assert len(got) == 4 * sum(len(r or []) for _, r in rows)
    for i, row in rows:
        for k, own in enumerate(row or []):
            def joint(x):
                text = [0, *row[:k], x, *row[k + 1 :]]
                return math.prod(p[a, b] for a, b in zip(text, text[1:]))

            total = sum(joint(x) for x in range(4))
            for x in range(4):
                assert got[i, k, x][0] == own and math.isclose(got[i, k, x][1], math.log(joint(x) / total))
    forced = {r.id: r.logprobs for r in backends.teacher_forced(df, "id", "ids", lambda: Counted(counts, 0), 3).collect()}
    assert all(np.allclose(forced[i], [math.log(p[a, b]) for a, b in zip([0, *(row or [])], row or [])]) for i, row in rows)
