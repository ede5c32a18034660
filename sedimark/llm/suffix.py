"""Exact substring deduplication with an enhanced suffix array and its tree of common-prefix intervals.

A string of `least` bytes that occurs twice is found at content-chosen anchors: of all 16-byte strings inside a window of
`least` bytes the one of smallest hash is the window's anchor, so equal windows have equal anchors at equal places. Windows
in a row with one anchor form a segment.

1. Segments that are equal as a whole need no suffix sorting: all but the earliest are repeats throughout.
2. Distinct segments with one anchor go, with their bytes, to a sparse enhanced suffix array: suffixes start at the anchors,
   neighbours' common prefixes are kept beside them. A stack scan lists the intervals of common prefixes. In each
   interval the same scan over the reversed bytes to the left gives the sets of occurrences whose left extensions differ:
   these, if their right extensions differ too, are maximal repeats with all their occurrences among the segments.
3. In each maximal repeat of `least` bytes or more all occurrences but the earliest are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import checkpointed, chunks, map_arrow, without

GRAM = 16
PIECE = 1 << 20
#: start, bytes before the anchor and size of a segment share one long: shuffled rows are short
AHEAD, SIZE = 13, 14


def packed(start, ahead, size):
    return start << (AHEAD + SIZE) | ahead << SIZE | size


def unpacked(at):
    return at >> (AHEAD + SIZE), at >> SIZE & ((1 << AHEAD) - 1), at & ((1 << SIZE) - 1)


def anchors(data: bytes, least: int):
    """(anchor hash, anchor place, first window, last window) of each segment, as arrays; windows are numbered by first byte."""
    import numpy as np

    u = np.uint64
    n = len(data)
    if n < least:
        return tuple(np.zeros(0, t) for t in ("u8", "i8", "i8", "i8"))
    if n > PIECE:
        step, parts = PIECE - least, []
        for a in range(0, n - least + 1, step):
            h, p, s, e = anchors(data[a : min(n, a + step + least - 1)], least)
            parts.append((h, p + a, s + a, e + a))
        return tuple(np.concatenate(x) for x in zip(*parts))
    x = np.frombuffer(data, "u1").astype("u8")
    for bits, hop in ((8, 1), (16, 2), (32, 4)):
        x = x[:-hop] | x[hop:] << u(bits)
    h = x[:-8] * u(0x9E3779B97F4A7C15) + x[8:] * u(0xC2B2AE3D27D4EB4F)
    h ^= h >> u(29)
    h *= u(0xFF51AFD7ED558CCD)
    low = u(PIECE - 1)  # the place breaks ties: leftmost first
    m, have, want = (h & ~low) | np.arange(len(h), dtype="u8"), 1, least - GRAM + 1
    while 2 * have <= want:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if want > have:
        m = np.minimum(m[: have - want], m[want - have :])
    place = (m & low).astype("i8")
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    return h[place[first]], place[first], first, last


def merged(starts, ends):
    """Sorted union of intervals; touching ones become one."""
    import numpy as np

    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1])) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate((at[1:] - 1, [len(e) - 1]))] if len(at) else e


def common(rows, sizes):
    """Common prefixes of neighbouring rows of a byte matrix, no longer than either row's size."""
    import numpy as np

    if len(rows) < 2:
        return np.zeros(0, "i8")
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def intervals(prefixes: list[int], floor: int):
    """Stack scan over neighbours' common prefixes: (prefix length, first row, last row) of every interval of at least floor."""
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefixes, -1]):
        low = i
        while stack and stack[-1][0] > p:
            size, low = stack.pop()
            yield size, low, i
        if p >= floor and (not stack or stack[-1][0] < p):
            stack.append((p, low))


class Least:
    """Minima of ranges, from a table of minima over powers of two."""

    def __init__(self, values) -> None:
        import numpy as np

        self.table, hop = [np.asarray(values)], 1
        while 2 * hop <= len(values):
            t = self.table[-1]
            self.table.append(np.minimum(t[:-hop], t[hop:]))
            hop *= 2

    def __call__(self, a, b):
        """Over [a, b), a < b, as arrays."""
        import numpy as np

        level = np.frexp((b - a).astype("f8"))[1] - 1
        out = np.empty(len(a), "i8")
        for k in np.unique(level):
            at = level == k
            t = self.table[k]
            out[at] = np.minimum(t[a[at]], t[b[at] - (1 << int(k))])
        return out


def maximal_repeats(right, right_size, left, left_size, least: int, core: int, back: int):
    """(rows, bytes to the left, bytes to the right) of every maximal repeat of at least `least` bytes around the common anchor of
    some suffixes. right: what follows the `core` bytes that all have in common (a byte matrix, rows in order); left: the
    reversed bytes before them, after `back` common ones."""
    import numpy as np

    prefixes = common(right, right_size) + core
    by_left = np.lexsort(left.T[::-1])
    place = np.empty(len(by_left), "i8")
    place[by_left] = np.arange(len(by_left))
    before = common(left[by_left], left_size[by_left]) + back
    if not len(before) or before.max() + prefixes.max() < least:
        return
    least_before = Least(before)
    for size, a, b in intervals(prefixes.tolist(), core):
        ranks = np.sort(place[a : b + 1])
        shared = least_before(ranks[:-1], ranks[1:])
        if shared.max() < least - size:
            continue
        rows = by_left[ranks]
        child = np.concatenate(([0], np.cumsum(prefixes[a:b] == size)))[rows - a]
        for ahead, c, d in intervals(shared.tolist(), max(0, least - size)):
            kids = child[c : d + 1]
            if (kids != kids[0]).any():
                yield rows[c : d + 1], ahead, size


def _find(docs: DataFrame, least: int) -> DataFrame:
    """(key, seg, doc, at, span) of the segments (at: packed); span not null: one that is a repeat already, at is its start.

    Inside a block of about 8 MB equal segments are combined: the earliest stays, the others are spans (one row for several
    that touch). A segment common to all documents so has one row per block.
    """

    def make():
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def run(batches):
            for b in chunks(batches, "text", 8 << 20):
                parts = []
                for doc, data in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                    h, p, first, last = anchors(data, least)
                    if len(h):
                        ends = last + least
                        seg = np.array([xxh64_intdigest(data[s:e]) for s, e in zip(first.tolist(), ends.tolist())], "u8")
                        parts.append((h.view("i8"), seg.view("i8"), np.full(len(h), doc), first, p - first, ends - first))
                if not parts:
                    continue
                key, seg, doc, start, ahead, size = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((start, doc, seg, key))
                again = np.zeros(len(order), bool)
                again[1:] = (key[order[1:]] == key[order[:-1]]) & (seg[order[1:]] == seg[order[:-1]])
                copy = np.sort(order[again])
                keep = order[~again]
                cols = [key[keep], seg[keep], doc[keep], packed(start[keep], ahead[keep], size[keep]), np.zeros(len(keep), "i8")]
                null = np.ones(len(keep), bool)
                if len(copy):
                    far = doc[copy].astype("i8")
                    # documents lie in row order here; a jump of one text's length parts them
                    bounds, spans = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1]))), []
                    for a, z in zip(bounds, [*bounds[1:], len(copy)]):
                        s, e = merged(start[copy[a:z]], start[copy[a:z]] + size[copy[a:z]])
                        spans.append((s * 0x9E3779B1 + far[a], s, np.full(len(s), far[a]), s, e - s))
                    cols = [np.concatenate([c, *x]) for c, *x in zip(cols, *spans)]
                    null = np.concatenate((null, np.zeros(len(cols[0]) - len(null), bool)))
                arrays = [pa.array(c, mask=null if i == 4 else None) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "seg", "doc", "at", "span"])

        return run

    return map_arrow(docs, make, "key long, seg long, doc long, at long, span long")


def _runs(batches, most: int):
    """Blocks of whole keys (batches sorted by `key`), of about `most` rows: tables. A larger key's batches are put together once."""
    import numpy as np
    import pyarrow as pa

    held, rows, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        if rows >= most and key[-1] != last:
            cut = int(np.searchsorted(key, last, "right"))
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held, rows, b = [], 0, b.slice(cut)
        held.append(b)
        rows += b.num_rows
        last = key[-1]
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _first(found: DataFrame, most: int) -> DataFrame:
    """(doc, key, at, span): spans, and the segments to compare: the earliest of each distinct one, where an anchor has
    several. Other segments need nothing."""

    def make():
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for t in _runs(batches, most):
                key, doc, at, seg = (t.column(c).to_numpy() for c in ("key", "doc", "at", "seg"))
                span, is_span = t.column("span").fill_null(0).to_numpy(), t.column("span").is_valid().to_numpy()
                rows = np.flatnonzero(~is_span)
                k, s = key[rows], seg[rows]
                newkey = np.ones(len(rows), bool)
                newkey[1:] = k[1:] != k[:-1]
                newseg = newkey.copy()
                newseg[1:] |= s[1:] != s[:-1]
                firsts, again = rows[newseg], rows[~newseg]
                group = np.cumsum(newkey)[newseg] - 1
                many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
                start, _, size = unpacked(at[again])
                old = np.flatnonzero(is_span)
                use = firsts[many]
                cols = [np.concatenate(x) for x in ((doc[old], doc[again], doc[use]), (key[old], key[again], key[use]), (at[old], start, at[use]), (span[old], size, span[use]))]
                null = np.arange(len(cols[0])) >= len(old) + len(again)
                yield pa.RecordBatch.from_arrays([pa.array(x, mask=null if i == 3 else None) for i, x in enumerate(cols)], ["doc", "key", "at", "span"])

        return run

    return map_arrow(found.repartition("key").sortWithinPartitions("key", "seg", "doc", "at"), make, "doc long, key long, at long, span long")


def _fetch(items: DataFrame, least: int) -> DataFrame:
    """(key, check, doc, at, side, data): per document its merged spans (data null; at, side: start and size), and its segments
    with their bytes, once or twice: a pair that shares `least` bytes shares half of them to the right of the anchor or to the
    left, so segments meet by two hashes of these bytes (128 bits), which needn't travel themselves: data is the rest. side: 1
    right, 0 left."""
    half = least // 2

    def make():
        import numpy as np
        import pyarrow as pa
        import zstandard
        from xxhash import xxh64_intdigest

        def run(batches):
            unpack = zstandard.ZstdDecompressor().decompress
            for b in batches:
                out: list[list] = [[] for _ in range(6)]

                def put(*row):
                    for o, x in zip(out, row):
                        o.append(x)

                for i in range(b.num_rows):
                    doc = b.column("doc")[i].as_py()
                    parts = b.column("items")[i].values
                    is_span = parts.field("span").is_valid().to_numpy(zero_copy_only=False)
                    key, at = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("key", "at"))
                    if is_span.any():
                        size = parts.field("span").fill_null(0).to_numpy(zero_copy_only=False)[is_span]
                        for s, e in zip(*merged(at[is_span], at[is_span] + size)):
                            put(doc, 0, doc, int(s), int(e - s), None)
                    rest = np.flatnonzero(~is_span)
                    if len(rest):
                        text = unpack(b.column("z")[i].as_py())
                        start, ahead, size = unpacked(at[rest])
                        for k, x, s, a, n in zip(key[rest].tolist(), at[rest].tolist(), start.tolist(), ahead.tolist(), size.tolist()):
                            data = text[s : s + n]
                            for side, low, high in ((1, a, a + half), (0, a - (least - half), a + GRAM)):
                                if low >= 0 and high <= n:
                                    core = data[low:high]
                                    put(_signed(xxh64_intdigest(core, 2 * (k & 0xFFFFFFFF) + side)), _signed(xxh64_intdigest(core, side)), doc, x, side, data[:low] + data[high:])
                    if len(out[0]) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names)
                        out = [[] for _ in range(6)]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names)

        names = ["key", "check", "doc", "at", "side", "data"]
        types = [pa.int64()] * 5 + [pa.binary()]
        return run

    return map_arrow(items, make, "key long, check long, doc long, at long, side long, data binary")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(fetched: DataFrame, least: int, most: int) -> DataFrame:
    """(doc, start, size): spans, those known before and those of the maximal repeats."""
    half = least // 2

    def matrix(np, rows, width):
        """Rows of bytes as a matrix of that width, zero-filled, and their sizes."""
        size = np.fromiter(map(len, rows), "i8", len(rows))
        out = np.zeros((len(rows), width), "u1")
        flat = np.frombuffer(b"".join(rows), "u1")
        out[np.arange(width) < size[:, None]] = flat
        return out, size

    def make():
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for t in _runs(batches, most):
                key, check, doc, at, side = (t.column(c).to_numpy() for c in ("key", "check", "doc", "at", "side"))
                data = t.column("data").to_pylist()
                known = np.array([x is None for x in data])
                spans = [(doc[known], at[known], side[known])]
                start, ahead, _ = unpacked(at)
                rows = np.flatnonzero(~known)
                if len(rows):
                    k, c = key[rows], check[rows]
                    edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]), [True])))
                    for a, b in zip(edge[:-1], edge[1:]):
                        if b - a < 2:
                            continue
                        group = rows[a:b]
                        for facing in (1, 0):
                            g = group[side[group] == facing]
                            if len(g) > 1:
                                spans += repeats(g, facing, data, doc, start, ahead)
                d, s, n = (np.concatenate(x) for x in zip(*spans))
                names, which = np.unique(d, return_inverse=True)
                s, e = merged(which << 40 | s, (which << 40 | s) + n)  # nested and touching spans of a document are one
                yield pa.RecordBatch.from_arrays([pa.array(names[s >> 40]), pa.array(s & (1 << 40) - 1), pa.array(e - s)], ["doc", "start", "size"])

        def repeats(g, facing, data, doc, start, ahead):
            cut = ahead if facing else ahead - (least - half)
            after, before = [data[i][cut[i] :] for i in g], [data[i][: cut[i]][::-1] for i in g]
            if not facing:
                after, before = before, after
            order = sorted(range(len(g)), key=after.__getitem__)
            g = g[order]
            right, right_size = matrix(np, [after[i] for i in order], max(1, max(map(len, after))))
            left, left_size = matrix(np, [before[i] for i in order], max(1, max(map(len, before))))
            for rows, left_bytes, right_bytes in maximal_repeats(right, right_size, left, left_size, least, half if facing else least - half, 0 if facing else GRAM):
                who = g[rows]
                others = who[np.lexsort((start[who] + ahead[who], doc[who]))[1:]]
                pre, post = (left_bytes, right_bytes) if facing else (right_bytes, left_bytes)
                yield doc[others], start[others] + ahead[others] - pre, np.full(len(others), pre + post)

        return run

    return map_arrow(fetched.repartition("key").sortWithinPartitions("key", "check"), make, "doc long, start long, size long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with __doc (and whether doc_ids are unique): doc_id itself, or where doc_ids are null or repeat a number in the order of (doc_id, hash of the text)."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn("__doc", F.col("doc_id").cast("long")), True
    d = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = d.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h")).distinct().sort(F.asc_nulls_first("__id"), "__h")
    order = checkpointed(order.withColumn("__doc", F.monotonically_increasing_id()))  # range-sorted, so it keeps the order
    return d.join(order, d.doc_id.eqNullSafe(order["__id"]) & (d["__hash"] == order["__h"])).drop("__id", "__h", "__hash"), False


def remove_repeats(docs: DataFrame, least: int = 100, most: int = 200_000) -> DataFrame:
    """All columns of docs and: n_bytes long, spans array<struct<start,size>> (removed runs, in order), kept binary, rest string:
    the text that is left if spans are cut back so that no character is split.

    Texts are UTF-8 bytes (null: empty). Removed is every byte of a `least`-byte string that also starts earlier: in a
    smaller doc_id, or before in the same document; matches never cross documents. Rows equal in doc_id and text are one
    document; of several texts with one doc_id that of the smaller hash is the earlier; null doc_ids come first. Columns with
    the new names are replaced; an empty table gives no rows.

    Texts are shuffled twice, zstd-compressed; else only rows of four longs per segment (about one per 40 bytes of text) are,
    and the bytes of those segments whose anchor has other segments too. What
    a task holds is a block of `most` rows and the largest group of distinct segments with equal halves around one anchor.
    """
    if not 2 * GRAM <= least < 1 << AHEAD:
        raise ValueError(f"least must be from {2 * GRAM} to {(1 << AHEAD) - 1} bytes")
    docs = without(docs, ["n_bytes", "spans", "kept", "rest", "__doc", "__z", "__d", "__spans", "__id", "__h", "__hash"])
    d, unique = _numbered(docs)
    texts = d.select(F.col("__doc").alias("doc"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text")).where(F.octet_length("text") >= least)
    texts = texts if unique else texts.dropDuplicates(["doc"])
    first = _first(_find(texts, least), most)
    items = first.groupBy("doc").agg(F.collect_list(F.struct("key", "at", "span")).alias("items"))
    fetched = _fetch(items.join(_compressed(texts, "z").withColumnRenamed("doc", "__d"), F.col("doc") == F.col("__d")).select("doc", "items", "z"), least)
    spans = _compare(fetched, least, most).groupBy(F.col("doc").alias("__d")).agg(F.collect_list(F.struct("start", "size")).alias("__spans"))
    whole = _compressed(d.withColumn("text", F.encode(F.coalesce("text", F.lit("")), "utf-8")), "__z")
    return _cut(whole.join(spans, F.col("__doc") == F.col("__d"), "left").drop("__d", "__doc"), docs)


def _compressed(texts: DataFrame, name: str) -> DataFrame:
    """texts with the column text replaced by its zstd-compressed bytes."""
    from pyspark.sql.types import StructType

    others = [c for c in texts.columns if c != "text"]

    def make():
        import pyarrow as pa
        import zstandard

        def run(batches):
            pack = zstandard.ZstdCompressor(level=3).compress
            for b in batches:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array([pack(x) for x in b.column("text").to_pylist()], pa.binary())], [*others, name])

        return run

    return map_arrow(texts, make, StructType([texts.schema[c] for c in others]).add(name, "binary"))


def whole_characters(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    """UTF-8 data without the spans, each cut back to whole characters."""
    kept, at = [], 0
    for a, b in zip(starts, ends):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _cut(rows: DataFrame, docs: DataFrame) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StructType

    names = docs.columns
    schema = StructType([docs.schema[c] for c in names]).add("n_bytes", "long").add("spans", ArrayType(StructType().add("start", LongType()).add("size", LongType()))).add("kept", "binary").add("rest", "string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))

    def make():
        import numpy as np
        import zstandard

        def run(batches):
            unpack = zstandard.ZstdDecompressor().decompress
            for b in batches:
                texts, total, spans, kept, rest = [], [], [], [], []
                given = b.column("__spans")
                for i, z in enumerate(b.column("__z").to_pylist()):
                    data = unpack(z)
                    texts.append(data)
                    total.append(len(data))
                    if not given[i].is_valid:
                        spans.append([])
                        kept.append(data)
                        rest.append(data)
                        continue
                    parts = given[i].values
                    s = parts.field("start").to_numpy(zero_copy_only=False)
                    s, e = merged(s, s + parts.field("size").to_numpy(zero_copy_only=False))
                    spans.append([{"start": int(x), "size": int(y - x)} for x, y in zip(s, e)])
                    rest.append(whole_characters(data, s.tolist(), e.tolist()))
                    ends = [0, *e.tolist()]
                    kept.append(b"".join([data[x:y] for x, y in zip(ends, [*s.tolist(), len(data)])]))
                cols = [b.column(c) if c != "text" else pa.array(texts, pa.binary()).cast(pa.string()) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(rest, pa.binary()).cast(pa.string())], [*names, "n_bytes", "spans", "kept", "rest"])

        return run

    return map_arrow(rows, make, schema)
