"""Packing token streams into fixed windows: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from sedimark.llm.bpe import loaded
from sedimark.llm.common import chunks, map_arrow


class OpenWindows:
    """Open windows by remaining capacity: leaf c counts the windows with c places left; `tightest` finds the least c >= n
    with a window, by going down from the lowest ancestor whose right part has one. `opened` numbers the windows."""

    def __init__(self, window: int) -> None:
        self.opened = 0
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, which: int) -> None:
        self.at[capacity].append(which)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, capacity: int) -> int:
        i = self.leaves + capacity
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.at[capacity].pop()

    def tightest(self, n: int) -> int:
        """-1: none fits."""
        i, count = self.leaves + n, self.count
        if count[i]:
            return n
        while i > 1 and (i & 1 or not count[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: list[int], window: int, tree: OpenWindows | None = None) -> list[tuple[int, int]]:
    """(window number, offset) of each piece, none longer than `window`; longest first, ties in the order given. Windows that `tree` has
    open are filled too, and those that stay open are left in it."""
    by: list[list[int]] = [[] for _ in range(window + 1)]
    for i, n in enumerate(lengths):
        by[n].append(i)
    out, tree = [(0, 0)] * len(lengths), tree or OpenWindows(window)
    for n in range(window, 0, -1):
        for i in by[n]:
            left = tree.tightest(n)
            if left < 0:
                which, left = tree.opened, window
                tree.opened += 1
            else:
                which = tree.take(left)
            out[i] = (which, window - left)
            if left > n:
                tree.put(left - n, which)
    return out


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, with_ids: bool = True, run_ids: int = 2_000_000, words: int = 240_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids binary (little-endian unsigned 32-bit; null without with_ids),
    ids_crc32, doc_tokens, sequence_id, offset.

    A document's stream is its ids, then end_id. Streams longer than the window are cut into full windows first; rests
    and short documents are packed best-fit decreasing. Every input partition packs its own pieces, in runs of about
    `run_ids` ids; windows that a run leaves open are open to the next one. So nothing is shuffled and each partition
    leaves at most its last windows part-filled; sequence_id is the partition's number times 2**33 plus the window's
    number in it. A null text is empty (the end_id alone); repeated rows are packed each; a null doc_id stays null; an
    empty table gives no rows; further columns are ignored.

    Memory: a run's pieces with their ids (and a block of about 2 MB of text, one document at least), a number for every
    open window of the partition, and the encoder's tables of `words` words; none but the open windows follows the input split.
    """

    def make():
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, part = loaded(path, words, decodes=False), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

        def placed(rows, tree):
            places = best_fit_decreasing([r[2] for r in rows], window, tree)
            for a in range(0, len(rows), 1024):
                cut = slice(a, a + 1024)
                cols = [pa.array(x, kind) for x, kind in zip(zip(*rows[cut]), kinds)]
                cols += [pa.array([(part << 33) + w for w, _ in places[cut]], pa.int64()), pa.array([o for _, o in places[cut]], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def run(batches):
            rows, held, tree = [], 0, OpenWindows(window)
            for b in chunks(batches, "text"):
                names, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
                del b  # it holds its whole Arrow batch while the next one is read
                for doc, (ids, _) in zip(names, bpe.packed(texts)):
                    ids += end
                    total = len(ids) // 4
                    for at in range(0, total, window):
                        piece = ids[4 * at : 4 * (at + window)]
                        rows.append((doc, at, len(piece) // 4, piece if with_ids else None, zlib.crc32(piece), total))
                    held += total
                    if held >= run_ids:
                        yield from placed(rows, tree)
                        rows, held = [], 0
            yield from placed(rows, tree)

        return run

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long", "bpe")
