"""Near copies: minwise bits and the second search."""

from sedimark.llm import simhash


def test_minwise_bits_tell_similarity_and_keep_every_near_pair():
    import numpy as np

    rng = np.random.default_rng(9)
    for s, low, high in ((1.0, 0, 0), (0.8, 60, 140), (0.6, 150, 270), (0.0, 440, 590)):
        for _ in range(20):
            n, both = 450, round(2 * 450 * s / (1 + s))
            x = rng.integers(0, 1 << 63, 2 * n, dtype="u8")
            a, b = (simhash.minwise_bits(np.unique(v), 16)[None] for v in (x[:n], x[n - both : 2 * n - both]))
            assert low <= simhash.apart(a, b)[0] <= high
    assert not simhash.minwise_bits(np.zeros(0, "u8"), 16).any()


def test_open_cells_skip_pairs_that_the_bits_tell_apart():
    """A family of similarity 0.6 to 0.7 whose texts agree in a band names no cells; a pair above 0.8 does."""
    import numpy as np

    rng = np.random.default_rng(2)
    base, own = rng.integers(0, 1 << 63, 400, dtype="u8"), rng.integers(0, 1 << 63, (60, 110), dtype="u8")
    sets = [np.unique(np.concatenate([base, x])) for x in own]
    sets.append(np.unique(np.concatenate([sets[0][:-5], own[1][:5]])))
    n = np.arange(len(sets))
    fps = np.array([simhash.minwise_bits(x, 16) for x in sets])
    out = list(simhash.open_cells(140)(n * 0, fps, n, n, n * 0))
    assert {int(i) for _, _, nodes in out for i in nodes} == {0, 60}
