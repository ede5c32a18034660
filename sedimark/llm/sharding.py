"""Sharding by histogram sort: candidate boundaries are probed with exact counts until the splitters meet their tolerance,
then every row is exchanged once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.llm.common import checkpointed, map_arrow, shuffle_width, without, written

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Sort key: hash of the text, doc_id, and a number that tells rows equal in both apart where they are too many.
KEY = ("h", "d", "e")


def _cells_of(keys, bounds):
    """How many of the boundaries, in order, are at or below each key; keys and boundaries are lists of columns."""
    import numpy as np

    if len(keys) == 1:
        return np.searchsorted(bounds[0], keys[0], "right")
    low, high = np.searchsorted(bounds[0], keys[0], "left"), np.searchsorted(bounds[0], keys[0], "right")
    out = low.astype("i8")
    same = high > low
    for a in np.unique(low[same]):
        rows = same & (low == a)
        out[rows] += _cells_of([k[rows] for k in keys[1:]], [x[a : high[rows][0]] for x in bounds[1:]])
    return out


def _columns(bounds: list[tuple]):
    import numpy as np

    return [np.array([b[i] for b in bounds], "i8") for i in range(len(KEY))]


def _count(keys: DataFrame, bounds: list[tuple], wanted: set[int]) -> dict[int, tuple]:
    """cell -> (rows, bytes, (least, greatest) of each key column), of the wanted cells; each partition counts its own rows, and
    one row per partition and non-empty cell is shuffled."""
    keep_ = sorted(wanted)
    ends = [f"{k}{e}" for k in KEY for e in (0, 1)]

    def make():
        import numpy as np
        import pyarrow as pa

        columns, keep = _columns(bounds), np.array(keep_, "i8")

        def run(batches):
            n = len(bounds) + 1
            rows, size = np.zeros(n, "i8"), np.zeros(n, "i8")
            least, most = np.full((len(KEY), n), HIGH), np.full((len(KEY), n), LOW)
            for b in batches:
                *k, s = (b.column(c).to_numpy(zero_copy_only=False) for c in (*KEY, "size"))
                c = _cells_of(k, columns)
                ok = np.isin(c, keep)
                c = c[ok]
                rows += np.bincount(c, minlength=n)
                np.add.at(size, c, s[ok])
                for i, x in enumerate(k):
                    np.minimum.at(least[i], c, x[ok])
                    np.maximum.at(most[i], c, x[ok])
            at = np.flatnonzero(rows)
            cols = [at, rows[at], size[at], *[x[i][at] for i in range(len(KEY)) for x in (least, most)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["cell", "n", "b", *ends])

        return run

    parts = map_arrow(keys, make, ", ".join(f"{c} long" for c in ("cell", "n", "b", *ends)))
    total = parts.groupBy("cell").agg(F.sum("n"), F.sum("b"), *[(F.max if c[-1] == "1" else F.min)(c) for c in ends])
    return {r[0]: (r[1], r[2], [(r[3 + 2 * i], r[4 + 2 * i]) for i in range(len(KEY))]) for r in total.collect()}  # bounded: the wanted cells


def _refined(cell: tuple, start: tuple, probes: int) -> list[tuple]:
    """Boundaries that cut a cell by the first key column that differs in it. The first is the cell's own start."""
    level = next(i for i, (low, high) in enumerate(cell[2]) if low < high)
    low, high = cell[2][level]
    before = tuple(c[0] for c in cell[2][:level])
    width = max(1, -(-(high - low + 1) // probes))
    return [start, *((*before, x, *(LOW,) * (len(KEY) - level - 1)) for x in range(low + width, high + 1, width))]


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.005, probes: int = 256, first: int = 1024, cell_rows: int | None = None):
    """(boundaries, rows of each cell, shard of each cell, keys of cells that are too large but can't be cut).

    keys: (h long, d long, e long, size long). Probing goes on until each splitter's cumulated bytes are within `tolerance` of a
    shard's mean of the ideal ones and no cell has more than cell_rows rows, or the cells in question hold one single key.
    Boundaries are bounded by the number of probes and of rows a cell may have, not by the rows.
    """
    low = (LOW,) * (len(KEY) - 1)
    bounds = [(LOW + i * (1 << 64) // first, *low) for i in range(1, first)]
    starts = [(LOW, *low), *bounds]
    cells = _count(keys, bounds, set(range(first)))
    state = [(s, cells.get(i)) for i, s in enumerate(starts) if i in cells]
    total, rows = sum(c[1] for _, c in state), sum(c[0] for _, c in state)
    limit = cell_rows or max(64, rows // (4 * max(shards, shuffle_width(keys))))
    while True:
        below, open_, stuck = 0, set(), []
        for i, (_, c) in enumerate(state):
            holds = shards > 1 and (below * shards) // max(total, 1) != ((below + c[1]) * shards - 1) // max(total, 1)
            if c[0] > limit or holds and c[0] > 1 and c[1] > tolerance * total / shards:
                if any(a < b for a, b in c[2]):
                    open_.add(i)
                else:
                    stuck.append(tuple(a for a, _ in c[2]))
            below += c[1]
        if not open_:
            break
        fresh: list[tuple] = []
        for i, (s, c) in enumerate(state):
            fresh += [(x, None) for x in _refined(c, s, probes)] if i in open_ else [(s, c)]
        got = _count(keys, [s for s, _ in fresh[1:]], {i for i, (_, c) in enumerate(fresh) if c is None})
        state = [(s, c or got.get(i)) for i, (s, c) in enumerate(fresh) if c or i in got]
    # each cell goes to the shard that holds its middle: the splitter is the cell boundary nearest to the ideal one
    below, of = 0, []
    for _, c in state:
        of.append(min(shards - 1, (2 * below + c[1]) * shards // max(2 * total, 1)))
        below += c[1]
    return [s for s, _ in state[1:]], [c[0] for _, c in state], of, stuck


def _spread(d: DataFrame, stuck: list[tuple]) -> DataFrame:
    """d with the rows of the stuck keys numbered in __e. They are written first, as a number must stay with its row when a task is
    repeated; equal texts compress well."""
    keys = d.sparkSession.createDataFrame([k[:2] for k in stuck], "__sh long, __sd long")  # bounded: cells that are too large
    same = (F.col("__h") == F.col("__sh")) & (F.col("__d") == F.col("__sd"))
    hot = written(d.join(F.broadcast(keys), same, "left_semi").withColumn("__e", F.monotonically_increasing_id()), "sharding")
    return d.join(F.broadcast(keys), same, "left_anti").unionByName(hot)


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.005) -> DataFrame:
    """All columns of docs and: size, law ("bytes"), shard (0 to shards - 1), slot (gapless from 0 in its shard).

    Size is the text's UTF-8 bytes (null: none) plus 16; shards get near equal bytes. The order is (hash of the text,
    doc_id): equal texts lie together and share a shard unless their group is larger than the tolerance; such a group is cut
    by doc_id. Rows equal in both are cut too where they are too many, by numbers they get for that. Null doc_ids come first in
    their text's group. An empty table gives no rows; columns of docs with the names of the new ones are replaced.

    The probing passes read (hash, doc_id, size) from the checkpoint folder, not the texts. Slots are numbered inside cells
    of a bounded number of rows, whose bases the histogram gives, so a shard is never one task.
    """
    docs = without(docs, ["size", "law", "shard", "slot", "__h", "__d", "__e", "__at", "__cell", "__sh", "__sd"])
    d = docs.withColumns({"size": F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16, "__h": F.xxhash64(F.coalesce("text", F.lit(""))), "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)), "__e": F.lit(0).cast("long")})
    keys = lambda x: checkpointed(x.select(F.col("__h").alias("h"), F.col("__d").alias("d"), F.col("__e").alias("e"), "size"))
    bounds, rows, of, stuck = splitters(keys(d), shards, tolerance)
    if stuck:
        d = _spread(d, stuck)
        bounds, rows, of, _ = splitters(keys(d), shards, tolerance)
    base, seen = [], [0] * shards
    for n, s in zip(rows, of):
        base.append(seen[s])
        seen[s] += n

    @F.pandas_udf("cell long, shard int, base long")
    def place(h: pd.Series, d: pd.Series, e: pd.Series) -> pd.DataFrame:
        import numpy as np

        cell = _cells_of([x.to_numpy() for x in (h, d, e)], _columns(bounds))
        return pd.DataFrame({"cell": cell, "shard": np.array(of or [0], "i4")[cell], "base": np.array(base or [0], "i8")[cell]})

    w = W.partitionBy("__cell.cell").orderBy("__h", "__d", "__e")
    out = d.withColumn("__cell", place("__h", "__d", "__e")).withColumn("__at", F.row_number().over(w))
    return out.select(*docs.columns, "size", F.lit("bytes").alias("law"), F.col("__cell.shard").alias("shard"), (F.col("__cell.base") + F.col("__at") - 1).cast("long").alias("slot"))
