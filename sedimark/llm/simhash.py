"""SimHash near-duplicates: forests of BK-trees over fingerprints that share two of six bit blocks.

Two fingerprints within four bits of each other agree on at least two of six blocks, so every link lies in one of the
fifteen trees that both belong to. A shard of trees travels to the fingerprints that search it (they have its key)
rather than to every executor: the trees grow with the corpus, so they have no bound that a broadcast could rest on.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import checkpointed, chunks, components, key_runs, map_arrow, released

BLOCKS = (11, 11, 11, 11, 10, 10)


def shingle_hashes(text: bytes, width: int, seed: int):
    """uint64 XXH64 hashes of the word shingles of a text; fewer words: the whole sequence; none: an empty array."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, seed)] if words else [], "u8")
    size = np.fromiter(map(len, words), "i8", len(words))
    start = np.cumsum(size + 1) - size - 1
    last = start[width - 1 :] + size[width - 1 :]
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(start.tolist(), last.tolist())], "u8")


def remixed(hashes, table: int):
    """Independent hashes from hashes; table 0 is the hashes themselves."""
    import numpy as np

    if not table or not len(hashes):
        return hashes
    u = np.uint64
    x = hashes ^ u(0x9E3779B97F4A7C15 * table % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(shift))) * u(factor)
    return x ^ (x >> u(31))


def majority(hashes) -> int:
    """The bits set in over half the hashes; 0 for none."""
    import numpy as np

    if not len(hashes):
        return 0
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    counts = np.zeros((8, 256), "i8")
    for i in range(0, len(hashes), 1 << 16):
        b = hashes[i : i + (1 << 16)].astype("<u8").view("u1").reshape(-1, 8).astype("i8") + np.arange(8) * 256
        counts += np.bincount(b.ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((2 * (counts @ bits) > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, tables: int = 0) -> DataFrame:
    """doc_id, fp long (the 64 bits, signed) of every row; a null or word-less text has fingerprint 0.

    With tables, also wide array<long>: as many fingerprints of independent hashes (the first is fp), each distinct shingle
    counted once."""

    def make():
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for b in chunks(batches, "text"):
                texts = b.column("text").cast(pa.binary()).to_pylist()
                hashes = (shingle_hashes(t or b"", width, seed) for t in texts)
                hashes = map(np.unique, hashes) if tables else hashes
                fp = np.array([[majority(remixed(h, k)) for k in range(max(1, tables))] for h in hashes], "u8").view("i8").reshape(len(texts), -1)
                cols = [b.column("doc_id"), pa.array(fp[:, 0].copy())]
                if tables:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * tables, pa.int32()), pa.array(fp.ravel())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "wide"][: len(cols)])

        return run

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, fp long" + ", wide array<long>" * bool(tables))


def minwise_bits(hashes, words: int):
    """64 * words bits of a set of hashes, uint64: of as many orders of the hashes, a bit of the first in each. Bits of two sets of Jaccard
    similarity s differ with probability (1 - s) / 2. An empty set has zeros."""
    import numpy as np

    n = 64 * words
    factor = remixed(np.arange(1, n + 1, dtype="u8"), 1) | np.uint64(1)
    low = np.full(n, np.iinfo("u8").max, "u8")
    for i in range(0, len(hashes), 256):
        low = np.minimum(low, (hashes[i : i + 256, None] * factor).min(axis=0))
    bits = remixed(low, 2) & np.uint64(1) if len(hashes) else np.zeros(n, "u8")
    return np.packbits(bits.astype("u1"), bitorder="little").view("<u8")


def sketches(texts: DataFrame, width: int, words: int, seed: int = 42) -> DataFrame:
    """node, bits array<long>: the minwise bits of each text's shingles."""

    def make():
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for b in chunks(batches, "text"):
                found = [minwise_bits(np.unique(shingle_hashes(t, width, seed)), words) for t in b.column("text").cast(pa.binary()).to_pylist()]
                flat = pa.array(np.concatenate(found).view("i8"))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * words, pa.int32()), flat)], ["node", "bits"])

        return run

    return map_arrow(texts.select("node", "text"), make, "node long, bits array<long>")


def apart(a, b):
    """Differing bits of fingerprints, rows of one or more words."""
    import numpy as np

    return np.bitwise_count(a ^ b).sum(axis=1, dtype="i8")


class Forest:
    """BK-trees over fingerprints, one per key. Rows must be sorted by key; row i is node i.

    Built level by level for all trees at once: among the rows that fall to the same child (parent, distance) the first
    becomes that child's node, the others go on below it. Children of a node lie in order of their distance to it.
    """

    def __init__(self, keys, fps) -> None:
        import numpy as np

        n, self.fps = len(fps), fps
        parent, edge = np.full(n, -1), np.zeros(n, "i8")
        first = np.ones(n, bool)
        first[1:] = keys[1:] != keys[:-1]
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        at, rows = self.root.copy(), np.flatnonzero(~first)
        while len(rows):
            d = apart(fps[rows], fps[at[rows]])
            order = np.lexsort((rows, d, at[rows]))
            r, d = rows[order], d[order]
            a = at[r]
            head = np.ones(len(r), bool)
            head[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            parent[r[head]], edge[r[head]] = a[head], d[head]
            at[r] = r[np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))]
            rows = np.sort(r[~head])
        below = np.flatnonzero(parent >= 0)
        order = below[np.lexsort((edge[below], parent[below]))]
        self.children, self.edge = order, edge[order]
        self.slot = parent[order] << 16 | self.edge  # ascending: a range of edges of a node is a range of slots

    def links(self, radius: int, rows, most: int = 1 << 20):
        """Blocks of (row, other row) within radius of the given rows, following only edges that differ from the node's
        distance by no more than the radius."""
        import numpy as np

        step = 1 << 14
        for a in range(0, len(rows), step):
            stack = [(q := rows[a : a + step], self.root[q])]
            while stack:
                q, node = stack.pop()
                if len(q) > most:
                    stack += [(q[most:], node[most:])]
                    q, node = q[:most], node[:most]
                d = apart(self.fps[q], self.fps[node])
                hit = (d <= radius) & (q != node)
                yield q[hit], node[hit]
                low = np.searchsorted(self.slot, node << 16 | np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self.slot, node << 16 | (d + radius), "right") - low
                if total := int(n.sum()):
                    child = np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)
                    stack.append((np.repeat(q, n), self.children[child]))


def leaders(keys, fps, radius: int):
    """(rows, their leaders, whether a row has one). Of four rows of a key the one with most rows of the key in its radius
    leads these: they are one component already, so none of them needs a search of its own."""
    import numpy as np

    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((first, [len(keys)])))
    group = np.repeat(np.arange(len(first)), size)
    best, most = np.zeros(len(keys), bool), np.zeros(len(first), "i8")
    lead = np.zeros(len(first), "i8")
    for part in range(4):
        who = first + size * part // 4
        near = apart(fps, fps[who[group]]) <= radius
        n = np.bincount(group, near, minlength=len(first)).astype("i8")
        better = n > most
        most, lead = np.where(better, n, most), np.where(better, who, lead)
        best = np.where(better[group], near, best)
    rows = np.flatnonzero(best)
    return rows, lead[group[rows]], best


def joined(n: int, blocks) -> object:
    """Roots of the components of n rows under blocks of links (vectorised union by smallest row)."""
    import numpy as np

    root = np.arange(n)

    def settle():
        while True:
            up = root[root]
            if (up == root).all():
                return
            root[:] = up

    for a, b in blocks:
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            settle()
    return root


def _alone(keys):
    import numpy as np

    alone = np.ones(len(keys), bool)
    alone[1:] &= keys[1:] != keys[:-1]
    alone[:-1] &= keys[:-1] != keys[1:]
    return alone


def _by_key(keyed: DataFrame, columns: list[str], words: list[str], search, most: int, names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The long columns `names` of search(keys, fps, columns...) over runs of about `most` rows of each partition that end between keys."""
    keyed = keyed.repartition("key").sortWithinPartitions("key", words[0])

    def make():
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for k, *rest in key_runs(batches, ["key", *words, *columns], most):
                use = ~_alone(k)
                if use.any():
                    fps = np.stack([w[use].view("u8") for w in rest[: len(words)]], 1)
                    for out in search(k[use], fps, *[c[use] for c in rest[len(words) :]]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], list(names))

        return run

    return map_arrow(keyed, make, ", ".join(f"{n} long" for n in names))


def stars(radius: int):
    """A search: the components of each key's rows under links within the radius, as edges to their smallest row."""

    def search(keys, fps, reps):
        import numpy as np

        rows, lead, led = leaders(keys, fps, radius)
        forest = Forest(keys, fps)

        def blocks():
            yield rows, lead
            yield from forest.links(radius, np.flatnonzero(~led))

        root = joined(len(keys), blocks())
        far = root != np.arange(len(keys))
        pair = np.unique(np.stack([reps[far], reps[root[far]]], 1), axis=0)
        yield pair[:, 0].copy(), pair[:, 1].copy()

    return search


def _pair_keys(word) -> list:
    """A key for each two of six bit blocks of a word: two words within four bits agree in one of them."""
    low = [sum(BLOCKS[:i]) for i in range(6)]
    block = [F.shiftrightunsigned(word, low[i]).bitwiseAND((1 << BLOCKS[i]) - 1) for i in range(6)]
    return [F.lit(c << 22) + block[i] * (1 << 11) + block[j] for c, (i, j) in enumerate(combinations(range(6), 2))]


def split_hot(keyed: DataFrame, word: str, most: int) -> DataFrame:
    """keyed with the rows of keys of more than `most` rows under finer keys: the same pigeonhole once more, over six sets of bits that
    cut across the blocks (every sixth bit), so that two rows of a hot key within four bits still share one: some 36 bits in all.
    Keys are hashes from here on."""
    hot = keyed.groupBy(F.col("key").alias("__k")).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("__k")
    mask = [sum(1 << i for i in range(k, 64, 6)) for k in range(6)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    finer = [F.xxhash64(F.lit(c), F.col(word).bitwiseAND(signed(mask[i] | mask[j]))) for c, (i, j) in enumerate(combinations(range(6), 2))]
    flagged = keyed.join(hot, F.col("key") == F.col("__k"), "left")
    fine = F.when(F.col("__k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(*finer))
    return flagged.withColumn("__f", F.explode(fine)).withColumn("key", F.xxhash64("key", "__f")).drop("__k", "__f")


def near_duplicates(prints: DataFrame, radius: int = 4, most: int = 400_000) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most `radius` (up to 4) differing bits.

    prints: (doc_id, fp). Equal fingerprints are one class before any search; rows of a class meet only in map-side
    combined minima. Rows of null doc_id link like others, also in the middle of a chain, but name no component (one of nulls only has
    component null). Each shuffle partition searches its trees in runs of about `most` rows that end between keys. A key of more than
    `most` distinct fingerprints is dealt to finer keys first, so that a tree's rows have some 36 bits in common; what
    leaves a task are star edges, one per fingerprint and key at most, never the pairs of a group.
    """
    if not 0 <= radius <= 4:
        raise ValueError("six blocks, two of them equal: the radius must be 0 to 4")
    prints = checkpointed(prints.select("doc_id", "fp"))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    keyed = classes.select(F.explode(F.array_distinct(F.array(*_pair_keys("fp")))).alias("key"), "fp", F.col("fp").alias("node"))
    parts = components(_by_key(split_hot(keyed, "fp", most), ["node"], ["fp"], stars(radius), most))
    parts = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    parts = checkpointed(parts)
    least = parts.groupBy(F.col("part").alias("__p")).agg(F.min("rep").alias("component_id"))
    named = parts.join(least, F.col("part") == F.col("__p")).select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(named, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def similarity(a, b) -> float:
    """Jaccard similarity of sorted distinct hashes; of two empty sets 1."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def first_partners(radius: int):
    """A search: of every row that has another of its key within the radius, one such pair (with the key's leader where it can)."""

    def search(keys, fps, nodes):
        import numpy as np

        rows, lead, led = leaders(keys, fps, radius)
        yield nodes[rows[rows != lead]], nodes[lead[rows != lead]]
        if not led.all():
            for q, other in Forest(keys, fps).links(radius, np.flatnonzero(~led)):
                named = np.unique(nodes[other])
                order = np.lexsort((nodes[other], q))
                q, other = q[order], other[order]
                head = np.ones(len(q), bool)
                head[1:] = q[1:] != q[:-1]
                yield nodes[q[head]], nodes[other[head]]
                yield named, named  # so that they take part from here on

    return search


def open_cells(radius: int):
    """A search: (x, y, node) for both ends of all pairs of a key within the radius whose parts differ; x <= y are the blocks of the
    two ends, and a node is named once for each two blocks. One end of such a pair lies outside the key's largest part, so the
    rows of that part start no search."""

    def search(keys, fps, nodes, parts, blocks):
        import numpy as np

        order = np.lexsort((parts, keys))
        k, p = keys[order], parts[order]
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(k)))
        best = np.lexsort((n, k[at]))
        last = np.ones(len(best), bool)
        last[:-1] = k[at][best][1:] != k[at][best][:-1]
        largest = p[at][best][last]  # one per key, in the order of keys
        number = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
        rows = np.flatnonzero(parts != largest[number])
        if not len(rows):
            return
        mixed = np.zeros(len(largest), bool)
        mixed[number[rows]] = True
        keep = mixed[number]
        at = np.cumsum(keep) - 1
        parts, nodes, blocks, fps, keys, rows = parts[keep], nodes[keep], blocks[keep], fps[keep], keys[keep], at[rows]
        ends = np.empty((0, 3), "i8")
        for q, other in Forest(keys, fps).links(radius, rows):
            differ = parts[q] != parts[other]
            q, other = q[differ], other[differ]
            x, y = np.minimum(blocks[q], blocks[other]), np.maximum(blocks[q], blocks[other])
            ends = np.unique(np.concatenate([ends, np.stack([x, y, nodes[q]], 1), np.stack([x, y, nodes[other]], 1)]), axis=0)
            if len(ends) > 1 << 20:
                yield tuple(ends.T.copy())
                ends = ends[:0]
        yield tuple(ends.T.copy())

    return search


def common_counts(sets, rows):
    """How many hashes each of the given rows shares with every row: products of 0/1 matrices over slices of the hashes that two or more rows have."""
    import numpy as np

    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(rows), len(sets)))
    for low in range(0, int(shared.sum()), step := 1 << 12):
        a, b = np.searchsorted(column, (low, low + step))
        held = np.zeros((len(sets), step), "f4")
        held[owner[a:b], column[a:b] - low] = 1
        out += held[rows] @ held.T  # whole numbers of at most `step`: exact
    return out


def cell_links(least: float, width: int, seed: int = 42):
    """A cell's rows (node, text, part) -> edges (a, b) between parts that hold texts of Jaccard similarity `least` or more: every pair
    of the cell's rows is decided on whole shingle sets, and what leaves is a star for each set of parts so joined."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        texts = table.column("text").cast(pa.binary()).to_pylist()
        sets = [np.unique(shingle_hashes(t, width, seed)) for t in texts]
        parts, at, n = np.unique(table.column("part").to_numpy(), return_inverse=True, return_counts=True)
        rows = np.flatnonzero(at != n.argmax())  # two rows of different parts: one of them is here
        size = np.array([len(x) for x in sets])
        links = []
        for few in (rows[i : i + 512] for i in range(0, len(rows), 512)):
            both = common_counts(sets, few)
            either = size[few][:, None] + size - both
            alike = np.divide(both, either, out=np.ones_like(both), where=either > 0) >= least
            q, other = np.nonzero(alike & (at[few][:, None] != at))
            links.append(np.unique(np.stack([at[few[q]], at[other]], 1), axis=0))
        root = joined(len(parts), [(x[:, 0], x[:, 1]) for x in links])
        far = root != np.arange(len(parts))
        return pa.table({"a": parts[far], "b": parts[root[far]]})

    return run


def verified(pairs: DataFrame, texts: DataFrame, least: float, width: int, seed: int = 42) -> DataFrame:
    """The pairs (a, b) whose whole texts (node, text) have shingle sets of Jaccard similarity `least` or more."""
    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def make():
        import numpy as np
        import pyarrow as pa

        def run(batches):
            known: dict[bytes, object] = {}

            def shingles(text):
                if text not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[text] = np.unique(shingle_hashes(text, width, seed))
                return known[text]

            for x in chunks(batches, "ta"):
                ta, tb = (x.column(c).cast(pa.binary()).to_pylist() for c in ("ta", "tb"))
                yes = [similarity(shingles(p), shingles(q)) >= least for p, q in zip(ta, tb)]
                yield x.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

        return run

    return map_arrow(both, make, "a long, b long")


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, tables: int = 8, bands: int = 80, band_bits: int = 15, minwise: int = 16, most: int = 200_000, block_texts: int = 2048, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, node, component_id, leads for near copies: texts whose sets of `width`-word shingles have Jaccard similarity
    `similarity` or more, and what is reachable over such links. node is the hash of the row's text (equal texts are one),
    component_id the smallest doc_id of the component (null: no row of it has one). leads marks the component's first row by
    (doc_id, nulls last, then node); equal rows lead together.

    Candidates come from SimHash over the distinct shingles: two sets of Jaccard similarity s have cosine about
    2 s / (1 + s), and each bit differs with probability arccos(cosine) / pi. Documents are compared when one of `bands`
    bands of band_bits of the 64 * tables bits agrees, and are candidates when of the bits that travel (half of them) at most
    the expected number at `similarity` plus four standard deviations differ. Every link is decided on the whole texts.

    First each document is verified against up to two candidates, leaders before others, which joins the tight groups. Those
    candidates also make families, and a family's texts are dealt to blocks of about `block_texts` texts or `block_bytes` bytes. Then
    every pair of a band whose ends are still in different parts names the cell of its two blocks, unless 64 * minwise bits of both
    sets (minwise_bits) tell them apart: more of these differ than the expected number at `similarity` plus four standard deviations. A text
    travels once to each cell that needs it, where all pairs are decided at once. So no pair leaves a task, a cell is bounded (a longer
    text is alone in its block), and no pair of candidates stays undecided. Runs and memory are as in near_duplicates.
    """
    bits, sent = 64 * tables, max(1, tables // 2)
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = int(64 * sent * p + 4 * math.sqrt(64 * sent * p * (1 - p)))
    q = (1 - similarity) / 2
    near = int(64 * minwise * q + 4 * math.sqrt(64 * minwise * q * (1 - q)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    prints = fingerprints(rows.select(F.col("node").alias("doc_id"), "text"), width, tables=tables)
    prints = checkpointed(prints.groupBy(F.col("doc_id").alias("node")).agg(F.first("wide").alias("wide")))
    words = [f"w{k}" for k in range(tables)]
    starts = [i * (bits - band_bits) // max(1, bands - 1) for i in range(bands)]

    def band(start: int):
        word, low = divmod(start, 64)
        value = F.shiftrightunsigned(words[word], low)
        if low + band_bits > 64:
            value = value.bitwiseOR(F.shiftleft(words[word + 1], 64 - low))
        return value.bitwiseAND((1 << band_bits) - 1)

    def keyed(of: DataFrame, *more: str) -> DataFrame:
        flat = of.select("node", *more, *[F.col("wide")[k].alias(w) for k, w in enumerate(words)])
        return flat.select(F.explode(F.array(*[F.lit(i << 32) + band(s) for i, s in enumerate(starts)])).alias("key"), "node", *more, *[w for w in words[:sent] if not more])

    first = _by_key(keyed(prints), ["node"], words[:sent], first_partners(radius), most)
    first = released(first.groupBy("a").agg(F.min(F.when(F.col("a") != F.col("b"), F.col("b"))).alias("low"), F.max(F.when(F.col("a") != F.col("b"), F.col("b"))).alias("high")))
    pairs = first.select("a", F.explode(F.array("low", "high")).alias("b")).where("b is not null")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    active = pairs.select(F.col("a").alias("__n")).union(pairs.select(F.col("b").alias("__n"))).union(first.select(F.col("a").alias("__n"))).distinct()
    texts = checkpointed(rows.join(active, F.col("node") == F.col("__n"), "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    sure = released(verified(pairs, texts, similarity, width))
    parts = components(sure)
    by_node = lambda of, name: of.select(F.col("node").alias("__p"), F.col("component").alias(name))
    held = texts.select("node", F.octet_length("text").alias("bytes"))
    held = held.join(by_node(parts, "part"), F.col("node") == F.col("__p"), "left").drop("__p")
    held = held.join(by_node(components(pairs), "family"), F.col("node") == F.col("__p"), "left")
    held = checkpointed(held.select("node", "bytes", F.coalesce("part", "node").alias("part"), F.coalesce("family", "node").alias("family")))
    blocks = F.ceil(F.greatest(F.count("*") / block_texts, F.sum("bytes") / block_bytes))
    sizes = held.groupBy(F.col("family").alias("__f")).agg(F.greatest(blocks, F.lit(1)).alias("blocks"))
    block = F.when(F.col("blocks") <= 1, F.col("family")).otherwise(F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("blocks")))).alias("block")
    held = released(held.join(sizes, F.col("family") == F.col("__f")).select(F.col("node").alias("__n"), "part", block))
    told = [f"m{k}" for k in range(minwise)]
    among = prints.join(held, F.col("node") == F.col("__n")).join(sketches(texts, width, minwise).withColumnRenamed("node", "__m"), F.col("node") == F.col("__m"))
    among = among.select("node", "wide", "part", "block", *[F.col("bits")[k].alias(m) for k, m in enumerate(told)])
    cells = _by_key(keyed(among, "part", "block", *told), ["node", "part", "block"], told, open_cells(near), most, ("x", "y", "node")).distinct()
    met = cells.join(texts.join(held, F.col("node") == F.col("__n")).select("node", "text", "part"), "node")
    more = released(met.groupBy("x", "y").applyInArrow(cell_links(similarity, width), "a long, b long"))
    linked = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    found = components(linked).withColumnRenamed("node", "__p")
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("id")).join(found, F.col("node") == F.col("__p"), "left").select("node", F.coalesce("component", "node").alias("part"), "id")
    ids = checkpointed(ids)
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("node").alias("first"))).alias("head")
    named = ids.join(ids.groupBy(F.col("part").alias("__q")).agg(head), F.col("part") == F.col("__q")).select(F.col("node").alias("__m"), "head")
    leads = (F.col("node") == F.col("head.first")) & F.col("doc_id").eqNullSafe(F.col("head.id"))
    return rows.join(named, F.col("node") == F.col("__m")).select("doc_id", "node", F.col("head.id").alias("component_id"), leads.alias("leads"))
