"""Model back ends behind two operators: teacher-forced scores and sampling (F operators)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    """What a model has to offer, a batch at a time: rows of probabilities over its vocabulary."""

    def forced(self, rows: Sequence[Sequence[int]]) -> list:
        """For each row a matrix: the probabilities at every place after the tokens before it."""

    def next_probs(self, prefixes: Sequence[Sequence[int]]):
        """A row for each prefix: the probabilities of its next token."""

    def masked(self, rows: Sequence[Sequence[int]], places: Sequence[int]):
        """A row for each (row, place): the probabilities of the token there when it alone is hidden."""


class Bigrams:
    """Add-one smoothed bigram model: counts[a, b] of token b after a; the first token follows `begin`."""

    def __init__(self, counts, begin: int) -> None:
        self.probs, self.begin = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True), begin

    def forced(self, rows):
        return [self.probs[[self.begin, *row[:-1]][: len(row)]] for row in rows]

    def next_probs(self, prefixes):
        return self.probs[[p[-1] if len(p) else self.begin for p in prefixes]]

    def masked(self, rows, places):
        import numpy as np

        before = self.probs[[r[k - 1] if k else self.begin for r, k in zip(rows, places)]]
        after = np.array([self.probs[:, r[k + 1]] if k + 1 < len(r) else np.ones(len(self.probs)) for r, k in zip(rows, places)]).reshape(len(before), -1)
        joint = before * after
        return joint / joint.sum(axis=1, keepdims=True)


def bigram_counts(df: DataFrame, ids: str, vocabulary: int, begin: int):
    """Matrix of how often token b follows a, over an array column: one aggregate; vocabulary**2 counts reach the driver."""
    import numpy as np

    if vocabulary > 4096:
        raise ValueError("the table of counts is for small vocabularies")
    seq = F.concat(F.array(F.lit(begin)), F.col(ids).cast("array<int>"))
    pairs = df.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: F.struct(F.get(seq, i).alias("a"), F.get(seq, i + 1).alias("b")))).alias("p")) if vocabulary else df.limit(0)
    out = np.zeros((vocabulary, vocabulary))
    for r in pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).collect():
        out[r.a, r.b] = r.n
    return out


def _batches(batches, size: int):
    """Arrow batches in slices of `size` rows: a model's batch."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def teacher_forced(df: DataFrame, key: str, ids: str, make: Callable[[], Backend], batch: int = 64) -> DataFrame:
    """(key, logprobs array<double>): the log-probability of each token after those before it. make() gives the task its back end once, which
    is called once per `batch` rows. A null row is an empty one."""
    kind = dict(df.select(key).dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = make()
        for b in _batches(batches, batch):
            rows = [r or [] for r in b.column(ids).to_pylist()]
            out = [np.log(np.asarray(m)[np.arange(len(r)), r]).tolist() if r else [] for r, m in zip(rows, model.forced(rows))]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.list_(pa.float64()))], [key, "logprobs"])

    return df.select(key, ids).mapInArrow(run, f"{key} {kind}, logprobs array<double>")


def masked_marginals(df: DataFrame, key: str, ids: str, make: Callable[[], Backend], batch: int = 256) -> DataFrame:
    """(key, pos, wild, token, logp): the log-probability of every token of the vocabulary at each place when the place is hidden, its own
    token being `wild`. Hidden places of all rows of a task are put together to calls of `batch`. Null and empty rows have none."""
    kind = dict(df.select(key).dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = make()
        for b in batches:
            rows = list(zip(b.column(key).to_pylist(), (r or [] for r in b.column(ids).to_pylist())))
            todo = [(k, r, i) for k, r in rows for i in range(len(r))]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                logp = np.log(np.asarray(model.masked([r for _, r, _ in part], [i for _, _, i in part])))
                v = logp.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _, _ in part for _ in range(v)], b.schema.field(key).type), pa.array(np.repeat([i for _, _, i in part], v), pa.int32()),
                    pa.array(np.repeat([r[i] for _, r, i in part], v), pa.int32()), pa.array(np.tile(np.arange(v), len(part)), pa.int32()), pa.array(logp.ravel()),
                ], [key, "pos", "wild", "token", "logp"])

    return df.select(key, ids).mapInArrow(run, f"{key} {kind}, pos int, wild int, token int, logp double")


def sampled(df: DataFrame, key: str, ids: str, make: Callable[[], Backend], most: int, end: int, salt: str = "sample", batch: int = 64) -> DataFrame:
    """(key, sampled array<int>): tokens drawn after each row's own until `end` or `most`; the draws are a function of the key, so a repeated
    task gives the same. Rows of a batch go on side by side, one call of the back end a step."""
    from sedimark.functions.scalars import keyed_uniform

    kind = dict(df.select(key).dtypes)[key]
    draws = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: keyed_uniform(F.col(key), salt, i))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = make()
        for b in _batches(batches, batch):
            texts = [list(r or []) for r in b.column(ids).to_pylist()]
            us, new = b.column("__u").to_pylist(), [[] for _ in texts]
            live = list(range(len(texts)))
            for step in range(most):
                if not live:
                    break
                for k, probs in zip(live, np.asarray(model.next_probs([texts[k] for k in live]))):
                    edges = probs.cumsum()
                    new[k].append(min(int(np.searchsorted(edges, us[k][step] * edges[-1], "right")), len(edges) - 1))
                    texts[k].append(new[k][-1])
                live = [k for k in live if new[k][-1] != end]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(new, pa.list_(pa.int32()))], [key, "sampled"])

    return df.select(key, ids, draws.alias("__u")).mapInArrow(run, f"{key} {kind}, sampled array<int>")
