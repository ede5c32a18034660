"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items scans every text once.

The automaton's patterns are runs of normalised words between boundary guards; what it finds is mapped back to words and to
character offsets of the original text.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sedimark.llm.automata import SPACED, automaton, guarded, words
from sedimark.llm.common import checkpointed, chunks, map_arrow, without

ADDED = ["n_words", "n_hit", "items", "spans", "contaminated"]
SPANS = ArrayType(StructType().add("first", "long").add("last", "long").add("start", "long").add("end", "long"))


def windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(item_id, win), distinct: every `width` consecutive words of an item, space-joined; an item of fewer words, but not none, is one."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, width), " "))
    return w.select("item_id", F.explode(runs).alias("win")).distinct()


def _scan(docs: DataFrame, rows: list[tuple], item_type) -> DataFrame:
    """docs with n_words, items and spans of what one round's (win, item_id) rows hit."""
    import pyarrow as pa

    names = sorted({r[0] for r in rows})
    at = {w: i for i, w in enumerate(names)}
    owners: list[set] = [set() for _ in names]
    for w, item in rows:
        if item is not None:
            owners[at[w]].add(item)
    sizes = [n.count(" ") + 1 for n in names]
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((guarded(names), sizes, owners))  # bounded: a round's windows
    schema = StructType(list(docs.schema.fields)).add("n_words", "long").add("items", ArrayType(item_type)).add("spans", SPANS)

    def make():
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema

        patterns, lengths, items = shared.value
        find, lengths, kinds = automaton(token, patterns), np.array(lengths, "i8"), to_arrow_schema(schema)

        def hit(data: bytes, plain: bytes, found: list[tuple[int, int]]):
            ends, which = np.array(found).T
            gaps = np.flatnonzero(np.frombuffer(plain, "u1") == 32)
            last = np.searchsorted(gaps, ends)  # a match ends in the guard behind its last word
            marks = np.zeros(len(gaps) + 1, "i8")
            np.add.at(marks, last - lengths[which], 1)
            np.add.at(marks, last, -1)
            inside = np.diff(np.concatenate(([0], marks.cumsum() > 0)).astype("i1"), append=0)
            first, last = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1) - 1
            letters = np.diff((np.frombuffer(data.translate(SPACED), "u1") != 32).astype("i1"), prepend=0, append=0)
            chars = np.concatenate(([0], ((np.frombuffer(data, "u1") & 0xC0) != 0x80).cumsum()))  # characters before each byte
            start, end = chars[np.flatnonzero(letters == 1)[first]], chars[np.flatnonzero(letters == -1)[last]]
            own = sorted(set().union(*(items[i] for i in np.unique(which))))
            return own, [dict(zip(("first", "last", "start", "end"), map(int, s))) for s in zip(first, last, start, end)]

        def run(batches):
            for b in chunks(batches, "text"):
                n_words, own, spans = [], [], []
                for data in b.column("text").cast(pa.binary()).to_pylist():
                    plain = b" ".join((data or b"").translate(SPACED).split())
                    n_words.append(plain.count(b" ") + 1 if plain else 0)
                    plain = b" %b " % plain
                    found = list(find.iter(plain.decode("latin-1"))) if n_words[-1] else []
                    i, s = hit(data, plain, found) if found else ([], [])
                    own.append(i)
                    spans.append(s)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), pa.array(own, kinds.field("items").type), pa.array(spans, kinds.field("spans").type)], kinds.names)

        return run

    return map_arrow(docs, make, schema, "automata")


def _merged(spans):
    """Spans of several rounds, ordered, those that meet or overlap made one."""
    empty = F.array().cast(SPANS)
    joined = lambda a, s: F.struct(a["first"].alias("first"), F.greatest(a["last"], s["last"]).alias("last"), a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"))

    def step(done, s):
        before = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["last"] + 1 >= s["first"])
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined(before, s)))).otherwise(F.concat(done, F.array(s))).cast(SPANS)

    return F.aggregate(F.array_sort(spans), empty, step)


def contaminations(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_chars: int = 1 << 21) -> DataFrame:
    """All columns of docs with n_words, n_hit (words inside an occurrence of a window), items (ids of the items with windows that
    occur, sorted, distinct), spans (maximal runs of hit words: first and last word from 0, start and end as character offsets of the
    original text), contaminated (n_hit > 0). Columns of these names are replaced.

    Whole texts are scanned in blocks of about 2 MB; nothing is shuffled. A null text has no words. Rows of the benchmark that share
    an item_id are one item with the windows of all; an item of null id hits, but isn't named in `items`; null, empty and wordless
    items have no window. Repeated documents get a row each, an empty table gives no rows, an empty benchmark hits nothing.

    One automaton holds up to about `most_chars` characters of windows (that bounds what is collected and broadcast: some 100 bytes
    a character in a worker). A larger benchmark is dealt by hash into rounds, an automaton and a scan of the texts each; a round
    keeps its hits by the text's digest only, and they are joined at the end.
    """
    docs = without(docs, ADDED)
    wins = windows(benchmark, width)
    item_type = wins.schema["item_id"].dataType
    total = wins.agg(F.sum(F.octet_length("win") + 2)).first()[0] or 0
    rounds = max(1, math.ceil(total / most_chars))

    def of_round(k: int) -> list[tuple]:
        mine = wins.where(F.pmod(F.xxhash64("win", "item_id"), F.lit(rounds)) == k) if rounds > 1 else wins
        return [(r.win, r.item_id) for r in mine.select("win", "item_id").collect()]

    if rounds == 1:
        out = _scan(docs, of_round(0), item_type)
    else:
        digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("__text")
        texts, parts = docs.select(digest, "text"), None
        for k in range(rounds):
            found = _scan(texts, of_round(k), item_type).where(F.size("spans") > 0)
            found = checkpointed(found.groupBy("__text").agg(F.first("items").alias("items"), F.first("spans").alias("spans")))
            parts = found if parts is None else parts.unionByName(found)
        hits = parts.groupBy("__text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"))
        plain = docs.select("*", digest, F.size(words(F.col("text"))).cast("long").alias("n_words"))
        empty = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
        out = plain.join(hits, "__text", "left").select(*docs.columns, "n_words", empty("items"), empty("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.select(*docs.columns, "n_words", n_hit.alias("n_hit"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))
