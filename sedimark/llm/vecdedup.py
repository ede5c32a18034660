"""Near-duplicate vectors over a robust-pruned flat graph.

Distinct vectors of a label are dealt to overlapping shards, each to those of its nearest centres. Every shard builds a graph:
nearest candidates, pruned so that a neighbour is left out when a nearer one leads to it (alpha), and the reverse edges.
The adjacency lists of a vector from all its shards are united. Then every shard searches for each of its vectors: greedily
from the shard's medoid and from the vector itself, and on from everything within a widened range until nothing new
comes up. Pairs found are verified in double precision. Where a vector has more others in range than a list of the graph holds, its
pairs come from tiles of matrix products with all that a bound on angles leaves. A sample is audited against brute force.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.llm.common import checkpointed, components, map_arrow


def unit(x):
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def candidates(x, k: int, least: float, rows: int = 1024):
    """(the k nearest others of each row of unit vectors, nearest first; how many others may be within `least` cosine), by blocks
    of a matrix product."""
    import numpy as np

    near, crowd = [], []
    for a in range(0, len(x), rows):
        s = x[a : a + rows] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        crowd.append((s >= least - 1e-4).sum(axis=1))
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(near), np.concatenate(crowd)


def robust_prune(x, near, alpha: float, degree: int, rows: int = 2048):
    """Boolean mask of the neighbours kept: nearest first, each drops those that lie alpha times nearer to it than to the row."""
    import numpy as np

    masks = []
    for a in range(0, len(x), rows):
        n = near[a : a + rows]
        c = x[n]  # rows, k, dim
        own = np.maximum(0, 2 - 2 * np.einsum("rkd,rd->rk", c, x[a : a + rows]))
        between = np.maximum(0, 2 - 2 * np.einsum("rkd,rld->rkl", c, c))
        alive, keep = np.ones(n.shape, bool), np.zeros(n.shape, bool)
        for j in range(n.shape[1]):
            take = alive[:, j] & (keep.sum(axis=1) < degree)
            keep[:, j] = take
            alive &= ~(take[:, None] & (alpha * alpha * between[:, j] <= own))
        masks.append(keep)
    return np.concatenate(masks)


def build(x, least: float, alpha: float = 1.2, degree: int = 24, k: int = 48):
    """Edges (from, to) of the pruned graph with reverse edges, each once, and which rows are dense: those with `degree` or more
    others in range, for which the bounded lists are too short."""
    import numpy as np

    n = len(x)
    if n < 2:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(n, bool)
    near, crowd = candidates(x, min(k, n - 1), least)
    keep = robust_prune(x, near, alpha, degree)
    a, b = np.repeat(np.arange(n), keep.sum(axis=1)), near[keep]
    pair = np.unique(np.concatenate([a * n + b, b * n + a]))
    return pair // n, pair % n, crowd >= degree


def expand(x, first, to, least: float, wide: float, beam: int = 8, steps: int = 12, rows: int = 512):
    """Blocks of (row, other) that may be within `least` cosine, from a greedy walk and range expansion over the graph
    (first[i]:first[i+1] are the edges of i in `to`)."""
    import numpy as np

    n = len(x)
    degree = np.diff(first)
    medoid = int((x @ x.mean(axis=0)).argmax())

    def neighbours(q, node):
        d = degree[node]
        at = np.repeat(first[node] - np.cumsum(d) + d, d) + np.arange(int(d.sum()))
        return np.repeat(q, d), to[at]

    for a in range(0, n, rows):
        who = np.arange(a, min(a + rows, n))
        m = len(who)
        seen = np.zeros((m, n), bool)
        q, node = np.arange(m), np.full(m, medoid)
        seen[q, node] = True
        pool_q, pool_n = q, node
        pool_s = x[who] @ x[medoid]
        open_ = np.ones(m, bool)
        for _ in range(steps):  # greedy: of each query's beam, the best node that is not expanded yet
            at = np.flatnonzero(open_)
            if not len(at):
                break
            order = at[np.lexsort((-pool_s[at], pool_q[at]))]
            head = np.concatenate(([True], pool_q[order[1:]] != pool_q[order[:-1]]))
            best = order[head]
            open_[best] = False
            q, node = neighbours(pool_q[best], pool_n[best])
            fresh = ~seen[q, node]
            q, node = q[fresh], node[fresh]
            pair = np.unique(q * n + node)
            q, node = pair // n, pair % n
            seen[q, node] = True
            pool_q, pool_n = np.concatenate((pool_q, q)), np.concatenate((pool_n, node))
            pool_s = np.concatenate((pool_s, np.einsum("ij,ij->i", x[who[q]], x[node])))
            open_ = np.concatenate((open_, np.ones(len(q), bool)))
            order = np.lexsort((-pool_s, pool_q))
            start = np.searchsorted(pool_q[order], np.arange(m))
            keep = order[np.arange(len(order)) - start[pool_q[order]] < beam]
            pool_q, pool_n, pool_s, open_ = pool_q[keep], pool_n[keep], pool_s[keep], open_[keep]
        seen[:] = False
        near = pool_s >= wide
        q, node = np.concatenate((np.arange(m), pool_q[near])), np.concatenate((who, pool_n[near]))
        pair = np.unique(q * n + node)
        q, node = pair // n, pair % n
        seen[q, node] = True
        other = node != who[q]
        yield who[q[other]], node[other]
        while len(q):  # everything in range leads on
            q, node = neighbours(q, node)
            fresh = ~seen[q, node]
            pair = np.unique(q[fresh] * n + node[fresh])
            q, node = pair // n, pair % n
            if not len(q):
                break
            seen[q, node] = True
            s = np.concatenate([np.einsum("ij,ij->i", x[who[q[i : i + 65536]]], x[node[i : i + 65536]]) for i in range(0, len(q), 65536)])
            yield who[q[s >= least - 1e-4]], node[s >= least - 1e-4]
            q, node = q[s >= wide], node[s >= wide]


def tile(x, asked, others, n, same, least: float, rows: int = 512):
    """(links of each asked row, links of each other row, root of each asked and of each other row) between unit vectors: `asked`
    and `others` number rows of x, n weighs them, `same` tells which others are asked somewhere. Pairs live only as a block of
    a matrix product in double precision; the components of a block come from minima passed to and fro over it."""
    import numpy as np

    links, back = np.zeros(len(asked), "i8"), np.zeros(len(others), "i8")
    root = np.arange(len(x))
    for a in range(0, len(asked), rows):
        q = asked[a : a + rows]
        s = x[q] @ x[others].T
        hit = s >= least
        close = np.argwhere(np.abs(s - least) < 1e-9)  # sums in another order: settled by the plain formula
        hit[close[:, 0], close[:, 1]] = cosines(x, q[close[:, 0]], others[close[:, 1]]) >= least
        hit &= q[:, None] != others
        links[a : a + rows] = hit @ n[others]
        back += np.where(same, 0, n[q] @ hit)
        while True:
            low = np.minimum(root[q], np.where(hit, root[others], len(x)).min(axis=1))
            up = np.minimum(root[others], np.where(hit, low[:, None], len(x)).min(axis=0))
            if (low == root[q]).all() and (up == root[others]).all():
                break
            root[q] = low
            root[others] = np.minimum(root[others], up)  # a row may be on both sides
            root = root[root]
    return links, back, root


def cosines(v, a, b):
    import numpy as np

    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / scale
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return np.concatenate([np.einsum("ij,ij->i", v[a[i : i + 65536]], v[b[i : i + 65536]]) / (norm[a[i : i + 65536]] * norm[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])


def _matrix(table):
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _centres(reps: DataFrame, size: int, overlap: int, most_centres: int) -> dict:
    """(label, dim) -> centres, for groups of more than twice `size` rows: rows of smallest hash, one per size/overlap rows and at
    most most_centres in all, which bounds their broadcast (beyond it shards grow)."""
    counts = [r for r in reps.groupBy("label", "dim").count().where(F.col("count") > 2 * size).collect()]
    total = sum(r["count"] for r in counts)
    each = max(1, size // overlap, -(-total // most_centres))
    wanted = {(r.label, r.dim): -(-r["count"] // each) for r in counts}
    centres: dict = {}
    if wanted:
        hash_ = F.xxhash64("v", F.lit("centre"))
        share = F.create_map(*[F.lit(x) for (lab, dim), c in wanted.items() for x in (f"{lab} {dim}", c)])
        some = reps.withColumn("__c", share[F.concat_ws(" ", "label", "dim")]).where("__c is not null")
        rank = F.row_number().over(W.partitionBy("label", "dim").orderBy(hash_, "rep"))
        low = F.create_map(*[F.lit(x) for (r, c) in ((r, wanted[(r.label, r.dim)]) for r in counts) for x in (f"{r.label} {r.dim}", int(min(1.0, 2 * c / r["count"] + 50 / r["count"]) * (1 << 62)))])
        some = some.where(F.shiftrightunsigned(hash_, 2) <= low[F.concat_ws(" ", "label", "dim")])
        for r in some.withColumn("__r", rank).where("__r <= __c").select("label", "dim", "v").collect():
            centres.setdefault((r.label, r.dim), []).append(r.v)
    return centres


def _with_cells(rows: DataFrame, shared, name: str, choose) -> DataFrame:
    """rows and `name` array<int>: what choose(cosines to the centres of their (label, dim), known) lists for each row; rows of
    groups without centres get [0]. known: what else the broadcast holds for the group."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType(list(rows.schema.fields)).add(name, ArrayType(IntegerType()))

    def make():
        import numpy as np

        known = {k: (unit(np.array(v)), more) for k, (v, more) in shared.value.items()}

        def run(batches):
            for b in batches:
                labels, dims, out = b.column("label").to_pylist(), b.column("dim").to_pylist(), [[0]] * b.num_rows
                groups: dict = {}
                for i, k in enumerate(zip(labels, dims)):
                    groups.setdefault(k, []).append(i)
                for k, at in groups.items():
                    if k in known:
                        x = unit(b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                        centres, more = known[k]
                        for i, cells in zip(at, choose(x @ centres.T, more)):
                            out[i] = cells
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, name])

        return run

    return map_arrow(rows, make, schema)


def _nearest(overlap: int):
    def choose(near, _):
        import numpy as np

        top = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
        return [t.tolist() for t in top]  # nearest first

    return choose


def _in_reach(least: float):
    """Cells whose dense rows may be within `least` of a row: by the triangle inequality of angles, those whose centre is no further
    than the cell's radius and the range together."""

    def choose(near, radius):
        import numpy as np

        reach = np.array([radius.get(c, -1.0) for c in range(near.shape[1])])
        angle = np.arccos(np.clip(near, -1, 1))
        inside = (reach >= 0) & (angle <= reach + np.arccos(least) + 1e-6)
        return [np.flatnonzero(x).tolist() for x in inside]

    return choose


def _dense_links(placed: DataFrame, flags: DataFrame, shared_centres: dict, least: float, size: int) -> DataFrame:
    """(rep, links, root) of all pairs that have a dense row.

    flags: rep of the dense rows. They are dealt to cells by nearest centre; every row of the label goes to the cells that can
    hold a partner of it, found by a bound on angles, so no link is lost. A cell's asked rows and the others meet in tiles of
    about size x 4 size rows: an index of each side's part is all that is repeated, so a hot cell is many tasks."""
    import pyarrow as pa

    asked = placed.join(flags.select(F.col("rep").alias("__f")), F.col("rep") == F.col("__f"), "left").withColumn("asked", F.col("__f").isNotNull()).drop("__f")
    asked = checkpointed(asked.withColumn("cell", F.col("shards")[0]).select("label", "dim", "rep", "n", "v", "cell", "asked", "cosine"))
    cells = checkpointed(asked.where("asked").groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"), F.min("cosine").alias("low")))
    radius: dict = {}
    for r in cells.where("low > -1").collect():  # bounded by the number of centres
        radius.setdefault((r.label, r.dim), {})[r.cell] = math.acos(min(1.0, r.low))
    shared = placed.sparkSession.sparkContext.broadcast({k: (v, radius.get(k, {})) for k, v in shared_centres.items()})
    home = cells.drop("low")
    others = _with_cells(asked.drop("cell", "cosine"), shared, "cells", _in_reach(least)).withColumn("cell", F.explode("cells")).drop("cells")
    others = checkpointed(others.join(home, ["label", "dim", "cell"]))
    counts = others.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / (4 * size)).cast("int").alias("blocks"))
    deal = lambda n: F.pmod(F.xxhash64("rep", F.lit("deal")), F.col(n)).cast("int")
    right = others.join(counts, ["label", "dim", "cell"]).withColumns({"block": deal("blocks"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    left = asked.where("asked").drop("cosine").join(home, ["label", "dim", "cell"]).join(counts, ["label", "dim", "cell"]).withColumns({"part": deal("parts"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    keys = ["label", "dim", "cell", "part", "block"]
    cols = [*keys, "rep", "n", "v", "asked"]

    def meet(a, b):
        import numpy as np

        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "links", "root")})
        ids = np.concatenate([t.column("rep").to_numpy() for t in (a, b)])
        names, first, which = np.unique(ids, return_index=True, return_inverse=True)
        x = unit(np.concatenate([_matrix(a), _matrix(b)])[first])
        n = np.concatenate([t.column("n").to_numpy() for t in (a, b)])[first]
        q, o = which[: a.num_rows], which[a.num_rows :]
        links, back, root = tile(x, q, o, n, b.column("asked").to_numpy(), least)
        rep, count = np.concatenate([names[q], names[o]]), np.concatenate([links, back])
        top = names[np.concatenate([root[q], root[o]])]
        some = (count > 0) | (top != rep)
        return pa.table({"rep": pa.array(rep[some]), "links": pa.array(count[some]), "root": pa.array(top[some])})

    return left.select(*cols).groupBy(*keys).cogroup(right.select(*cols).groupBy(*keys)).applyInArrow(meet, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, size: int = 2048, overlap: int = 3, most_centres: int = 16384, audit: int = 100) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept, audit_recall.

    Links: two vectors of equal non-null label (and length) with cosine >= least. n_links counts the other rows linked,
    component_id is the smallest vec_id reachable, kept says whether that is the row's own. Vectors that are null,
    zero or hold null or non-finite components, and null labels or ids, link with nothing. Equal vectors of a label are one
    class before any search. Repeated vec_ids are rows of their own, of one class or of several, each with its vector's links. An empty table gives no rows.

    Pairs of a dense row (one with more others in range than a list of the graph holds) are found exactly, see _dense_links; the
    others by the graph, where a pair in several shards counts in the first that found it. What leaves a task is, per vector, a
    count and star edges, and for graph pairs that lie in several shards the pairs (a few per vector, as neither end is dense).
    audit_recall is the share found of the links of `audit` sampled classes, by brute force over all vectors of their labels
    (null: the sample has no link); the sample is all that is broadcast. Labels in which the audit misses a link are searched
    again with all their rows as dense ones, which misses none.
    """
    import pyarrow as pa

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    fit = rows.where("vec_id is not null and label is not null and embedding is not null").where(ok).select("vec_id", "label", v.alias("v"))
    reps = fit.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("dim", F.size("v"))
    reps = checkpointed(reps.withColumn("rep", F.monotonically_increasing_id()))  # a class's own number: classes may share a vec_id
    centres = _centres(reps, size, overlap, most_centres)
    shared = reps.sparkSession.sparkContext.broadcast({k: (v_, None) for k, v_ in centres.items()})
    placed = _with_cells(reps.select("rep", "n", "label", "dim", "v"), shared, "shards", _nearest(overlap))
    placed = checkpointed(_with_cosine(placed, shared))
    members = placed.withColumn("shard", F.explode("shards"))

    def graph(table):
        import numpy as np

        ids = table.column("rep").to_numpy()
        a, b, dense = build(unit(_matrix(table)).astype("f4"), least)
        first = np.searchsorted(a, np.arange(len(ids) + 1))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids[b]))
        return pa.table({"rep": pa.array(ids), "near": lists, "dense": pa.array(dense)})

    lists = members.select("label", "dim", "shard", "rep", "v").groupBy("label", "dim", "shard").applyInArrow(graph, "rep long, near array<long>, dense boolean")
    united = lists.groupBy(F.col("rep").alias("__rep")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.bool_or("dense").alias("dense"))  # bounded: overlap lists per vector
    linked = checkpointed(members.join(united, F.col("rep") == F.col("__rep")).select("label", "dim", "shard", "rep", "n", "v", "near", "dense", (F.size("shards") > 1).alias("shares")))

    def search(table):
        import numpy as np

        table = table.sort_by("rep")
        ids, dense = table.column("rep").to_numpy(), table.column("dense").to_numpy()
        x64 = unit(_matrix(table))
        near = table.column("near").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(near.offsets.to_numpy()))
        to = np.searchsorted(ids, flat := near.flatten().to_numpy(zero_copy_only=False))
        inside = (to < len(ids)) & (ids[np.minimum(to, len(ids) - 1)] == flat)  # lists also name vectors of other shards
        owner, to = owner[inside], to[inside]
        first = np.searchsorted(owner, np.arange(len(ids) + 1))
        found = [np.zeros((0, 2), "i8")]
        for a, b in expand(x64.astype("f4"), first, to, least, least - 0.6 * (1 - least)):
            use = ~dense[a] & ~dense[b]
            a, b = a[use], b[use]
            yes = cosines(x64, a, b) >= least
            found.append(np.stack([a[yes], b[yes]], 1))
        pair = np.concatenate(found)
        return pa.table({"a": pa.array(ids[pair[:, 0]]), "b": pa.array(ids[pair[:, 1]])})

    # rows below the graph's degree: at most a few pairs per row and shard
    pairs = linked.groupBy("label", "dim", "shard").applyInArrow(search, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = checkpointed(pairs)
    weight = reps.select(F.col("rep").alias("__b"), F.col("n").alias("__n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sparse = both.join(weight, F.col("b") == F.col("__b")).groupBy(F.col("a").alias("rep")).agg(F.sum("__n").alias("links"))
    flags = linked.where("dense").select("rep", "label").distinct()
    recall = None
    for last in (False, True):
        dense = checkpointed(_dense_links(placed, flags, centres, least, size))
        counts = checkpointed(reps.select("rep", "label").join(sparse.unionByName(dense.select("rep", "links")).groupBy(F.col("rep").alias("__s")).agg(F.sum("links").alias("links")), F.col("rep") == F.col("__s"), "left").select("rep", "label", F.coalesce("links", F.lit(0)).alias("links")))
        recall, missed = _audit(reps, counts, least, audit) if audit else (None, [])
        if last or not missed:
            break
        again = F.col("label").isin(missed)
        flags = flags.unionByName(reps.where(again).select("rep", "label")).distinct()
        sparse = sparse.join(reps.where(again).select(F.col("rep").alias("__s")), F.col("rep") == F.col("__s"), "left_anti")
    parts = components(dense.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(pairs))
    named = reps.join(counts.select(F.col("rep").alias("__r"), "links"), F.col("rep") == F.col("__r")).join(parts, F.col("rep") == F.col("node"), "left")
    named = checkpointed(named.select(F.col("label").alias("__label"), F.col("v").alias("__v"), (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("__part"), "least"))
    first = named.groupBy(F.col("__part").alias("__q")).agg(F.min("least").alias("component_id"))
    named = named.join(first, F.col("__part") == F.col("__q")).select("__label", "__v", "n_links", "component_id")
    full = rows.select("vec_id", "label", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(ok, F.lit(False)), v).alias("v"))
    out = full.join(named, (F.col("label") == F.col("__label")) & (F.col("v") == F.col("__v")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audit_recall", F.lit(recall).cast("double"))


def _with_cosine(placed: DataFrame, shared) -> DataFrame:
    """placed with the cosine to the nearest centre (its home), -1 where a group has no centres: the whole group is in its reach."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    def make():
        import numpy as np

        known = {k: unit(np.array(v)) for k, (v, _) in shared.value.items()}

        def run(batches):
            for b in batches:
                out = [-1.0] * b.num_rows
                for i, (label, dim, shards) in enumerate(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("shards").to_pylist())):
                    if (label, dim) in known:
                        x = b.column("v")[i].values.to_numpy(zero_copy_only=False)
                        out[i] = float(unit(x[None])[0] @ known[(label, dim)][shards[0]])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "cosine"])

        return run

    return map_arrow(placed, make, StructType(list(placed.schema.fields)).add("cosine", "double"))


def _audit(reps: DataFrame, counts: DataFrame, least: float, sample: int) -> tuple[float | None, list[int]]:
    """(share of the links of sampled classes that the search has counted, labels of those with a link missed)."""
    import pyarrow as pa

    chosen = counts.where("links > 0").orderBy(F.xxhash64("rep", F.lit("audit")), "rep").limit(sample // 2).unionByName(counts.orderBy(F.xxhash64("rep", F.lit("any")), "rep").limit(sample // 2)).dropDuplicates(["rep"])
    asked = reps.join(F.broadcast(chosen.select(F.col("rep").alias("__r"), "links")), F.col("rep") == F.col("__r")).select("rep", "label", "dim", "v", "links").collect()  # bounded by the sample
    if not asked:
        return None, []
    questions = [(r.rep, r.label, r.dim, r.v) for r in asked]

    def make():
        import numpy as np

        by: dict = {}
        for rep, label, dim, v in questions:
            by.setdefault((label, dim), []).append((rep, v))

        def run(batches):
            total: dict[int, int] = {}
            for b in batches:
                labels, dims = b.column("label").to_numpy(zero_copy_only=False), b.column("dim").to_numpy(zero_copy_only=False)
                for (label, dim), asked_ in by.items():
                    at = np.flatnonzero((labels == label) & (dims == dim))
                    if len(at):
                        t = b.take(pa.array(at))
                        x = unit(t.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                        near = unit(np.array([v for _, v in asked_])) @ x.T >= least
                        ids, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
                        for (rep, _), hit in zip(asked_, near):
                            total[rep] = total.get(rep, 0) + int(n[hit & (ids != rep)].sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["rep", "links"])

        return run

    truth = {r[0]: r[1] for r in map_arrow(reps.select("rep", "label", "dim", "v", "n"), make, "rep long, links long").groupBy("rep").agg(F.sum("links")).collect()}
    want = sum(truth.values())
    missed = sorted({r.label for r in asked if r.links < truth.get(r.rep, 0)})
    return sum(min(r.links, truth.get(r.rep, 0)) for r in asked) / want if want else None, missed
