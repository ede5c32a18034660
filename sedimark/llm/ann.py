"""Nearest neighbours by inner product: a block matrix join on int8 tiles with error bounds.

A stated query set meets all candidates in tiles of bounded size. In a tile one integer matrix product gives approximate
products; with x = s_x q_x + e_x the error of s_x s_y <q_x, q_y> is at most |s_x q_x| |e_y| + |e_x| |y|, so a candidate
whose upper bound is below the k-th lower bound of its query can't be among that tile's best k. The others are
recomputed in double precision from the original vectors, and the tiles' lists are merged by heaps.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import checkpointed


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>, dim of the vectors that take part: not null, not zero, all components finite."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(ok).withColumn("dim", F.size("v"))


def quantised(x):
    """(int8 values, scales, norms of the quantised vectors, norms of the errors, norms of the originals), by row."""
    import numpy as np

    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).clip(-127, 127).astype("i1")
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1), np.linalg.norm(x, axis=1)


def int_product(a, b):
    """a @ b.T of int8 rows; single-precision products of up to 1024 columns are exact integers."""
    out = 0
    for i in range(0, a.shape[1], 1024):
        out = out + (a[:, i : i + 1024].astype("f4") @ b[:, i : i + 1024].astype("f4").T).astype("f8")
    return out


def best_in_tile(qid, qv, cid, cv, k: int, rows: int = 512):
    """Per query (ids, scores) of its k best candidates in the tile: largest product first, ties to the smaller id."""
    import numpy as np

    # of identical vectors only the k + 1 smallest ids can be among any query's best k (one of them may be its own)
    order = np.lexsort((cid, *cv.T[::-1]))
    same = np.zeros(len(cid), bool)
    same[1:] = (cv[order[1:]] == cv[order[:-1]]).all(axis=1)
    nth = np.arange(len(cid)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(cid))))
    keep = np.sort(order[nth <= k])
    cid, cv = cid[keep], cv[keep]
    cq, cs, cn, ce, cl = quantised(cv)
    for a in range(0, len(qid), rows):
        ids, x = qid[a : a + rows], qv[a : a + rows]
        q, s, n, e, _ = quantised(x)
        near = int_product(q, cq) * (s[:, None] * cs)
        err = (n[:, None] * ce + e[:, None] * cl) * (1 + 1e-9) + 1e-12 * (n[:, None] * cl)
        near[ids[:, None] == cid] = -np.inf
        low = near - err
        worst = np.partition(low, -k, axis=1)[:, -k] if len(cid) > k else np.full(len(ids), -np.inf)
        at, c = np.nonzero((near + err >= worst[:, None]) & (near > -np.inf))
        exact = np.concatenate([np.einsum("ij,ij->i", x[at[i : i + 65536]], cv[c[i : i + 65536]]) for i in range(0, len(at), 65536)] or [np.zeros(0)])
        order = np.lexsort((cid[c], -exact, at))
        at, c, exact = at[order], c[order], exact[order]
        first = np.searchsorted(at, np.arange(len(ids)))
        last = np.minimum(np.searchsorted(at, np.arange(len(ids)), "right"), first + k)
        for i, (f, t) in enumerate(zip(first, last)):
            yield int(ids[i]), cid[c[f:t]], exact[f:t]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = 4096, block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest of `vectors` to each of `queries` (both: vec_id, embedding), a
    row of the same vec_id excepted; score is the inner product in double precision, ties go to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; vectors of
    different lengths don't meet. Equal vectors are candidates each. Fewer candidates than k: all of them. Empty tables
    give no rows; further columns are ignored. Repeated vec_ids among queries are one query (the first by vector).

    Each candidate is sent once per query block and each query once per candidate block; a tile holds query_block x
    block vectors whatever the table's size. Only lists of k are merged.
    """
    both = checkpointed(usable(vectors))
    asked = usable(queries).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("x")).select("vec_id", "x.v", "x.dim")
    n, m = both.count(), asked.count()
    across, down = max(1, -(-n // block)), max(1, -(-m // query_block))
    cands = both.select(F.pmod(F.xxhash64("vec_id"), F.lit(across)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("qb"), "dim", "vec_id", "v")
    asks = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(down)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("cb"), "dim", "vec_id", "v")
    key = ["dim", F.col("qb").cast("int").alias("qb"), F.col("cb").cast("int").alias("cb"), "vec_id", "v"]

    def tile(left, right):
        import numpy as np
        import pyarrow as pa

        ids, lists, scores = [], [], []
        if left.num_rows and right.num_rows:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            number = lambda t: t.column("vec_id").to_numpy()
            for q, c, s in best_in_tile(number(left), matrix(left), number(right), matrix(right), k):
                ids.append(q)
                lists.append(np.asarray(c))
                scores.append(s)
        return pa.table({"query_id": pa.array(ids, pa.int64()), "ids": pa.array(lists, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    tiles = asks.select(*key).groupBy("dim", "qb", "cb").cogroup(cands.select(*key).groupBy("dim", "qb", "cb")).applyInArrow(tile, "query_id long, ids array<long>, scores array<double>")

    def merge(batches):
        import pyarrow as pa

        best: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, ids, scores in zip(b.column("query_id").to_pylist(), b.column("ids").to_pylist(), b.column("scores").to_pylist()):
                heap = best.setdefault(q, [])
                for item in zip(scores, (-i for i in ids)):
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                    else:
                        break  # a tile's list is in order
        rows = [(q, r, -i, s) for q, heap in best.items() for r, (s, i) in enumerate(sorted(heap, reverse=True), 1)]
        for a in range(0, len(rows), 1 << 15):
            part = rows[a : a + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    return tiles.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
