"""Ranked lexical search: a boundary-guarded Aho-Corasick automaton of all item terms counts term frequencies straight from the texts.

No index of the documents is kept: one scan counts what the weights need (documents, words, documents of each term), a second one
scores and keeps each item's best.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sedimark.llm.automata import SPACED, automaton, guarded, words
from sedimark.llm.common import chunks, map_arrow


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def items_of(items: DataFrame) -> DataFrame:
    """(item_id, terms): rows of one item_id are one item with the terms of all its different texts, in the texts' order."""
    texts = items.select("item_id", "text").where("text is not null").distinct()
    return texts.groupBy("item_id").agg(F.array_sort(F.collect_list("text")).alias("t")).select("item_id", F.flatten(F.transform("t", words)).alias("terms"))


def _counts(b, find):
    """(words, distinct terms' places, their frequencies) of each text of a batch, by one pass of the automaton over the text."""
    import numpy as np
    import pyarrow as pa

    for data in b.column("text").cast(pa.binary()).to_pylist():
        plain = (data or b"").translate(SPACED)
        n = len(plain.split())
        found = np.fromiter((v for _, v in find.iter(f" {plain.decode('latin-1')} ")), "i8") if n else np.zeros(0, "i8")
        yield n, *np.unique(found, return_counts=True)


def statistics(docs: DataFrame, terms: list[str]) -> tuple[int, int, dict[str, int]]:
    """Documents with a word, words in all, and documents that hold each of `terms`. Tasks add up before anything is shuffled."""
    token, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(guarded(terms))  # bounded: a block's terms

    def make():
        import numpy as np
        import pyarrow as pa

        find, df = automaton(token, shared.value), np.zeros(len(shared.value) + 2, "i8")

        def run(batches):
            for b in chunks(batches, "text"):
                for n, which, _ in _counts(b, find):
                    df[which] += 1
                    df[-2:] += (n > 0, n)
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])

        return run

    rows = map_arrow(docs.select("text"), make, "term long, n long", "automata").groupBy("term").agg(F.sum("n").alias("n")).collect()
    got = {r.term: r.n for r in rows}
    return got.get(len(terms), 0), got.get(len(terms) + 1, 0), {t: got.get(i, 0) for i, t in enumerate(terms)}


def _best(docs: DataFrame, block: list[tuple[int, list[str]]], most: int) -> DataFrame:
    """(item, doc_id, score): each task's `most` best documents of each item of the block."""
    terms = sorted({t for _, ts in block for t in ts})
    n_docs, n_words, df = statistics(docs, terms)
    weights = [term_weight(n_docs, df[t]) for t in terms]
    place, postings = {t: i for i, t in enumerate(terms)}, [{} for _ in terms]
    for k, (_, ts) in enumerate(block):
        for t in ts:
            postings[place[t]][k] = postings[place[t]].get(k, 0) + 1
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((guarded(terms), weights, postings, n_docs, n_words, len(block)))  # bounded: a block's terms and their uses

    def make():
        import numpy as np
        import pyarrow as pa

        patterns, w, uses, big_n, big_l, n_items = shared.value
        find, w = automaton(token, patterns), np.array(w, "i8")
        first = np.concatenate(([0], np.cumsum([len(u) for u in uses]))).astype("i8")
        whose = np.array([k for u in uses for k in u], "i8")
        times = np.array([n for u in uses for n in u.values()], "i8")
        late = np.iinfo("i8").max  # stands for a null doc_id: behind all others

        def scores(n: int, which, tf):
            """Of every item, exactly, in 64-bit integers."""
            m = 100 - 75 + (75 * n * big_n) // big_l
            gain = w[which] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            size = first[which + 1] - first[which]
            at = np.repeat(first[which] - np.concatenate(([0], size.cumsum()[:-1])), size) + np.arange(size.sum())
            out = np.zeros(n_items, "i8")
            np.add.at(out, whose[at], np.repeat(gain, size) * times[at])
            return out

        def run(batches):
            kept_score, kept_doc = np.zeros((0, n_items), "i8"), np.zeros((0, n_items), "i8")
            held, step = [], max(1, min(256, (1 << 21) // max(1, n_items)))

            def settled():
                nonlocal kept_score, kept_doc
                score = np.concatenate([kept_score, [s for _, s in held]])
                doc = np.concatenate([kept_doc, np.repeat([[i] for i, _ in held], n_items, axis=1)])
                order = np.lexsort((doc, -score), axis=0)[:most]
                kept_score, kept_doc = np.take_along_axis(score, order, 0), np.take_along_axis(doc, order, 0)
                held.clear()

            for b in chunks(batches, "text", 1 << 20):
                for i, (n, which, tf) in zip(b.column("doc_id").to_pylist(), _counts(b, find)):
                    if len(which):
                        held.append((late if i is None else i, scores(n, which, tf)))
                        if len(held) == step:
                            settled()
            if held:
                settled()
            place_, item = np.nonzero(kept_score)
            score, doc = kept_score[place_, item], kept_doc[place_, item]
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == late), pa.array(score)], ["item", "doc_id", "score"])

        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "item long, doc_id long, score long", "automata")


def ranked(docs: DataFrame, items: DataFrame, most: int = 10, block_chars: int = 1 << 21) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: each item's `most` best documents with a score above 0, equal scores by ascending
    doc_id (nulls last). All else of docs and items is ignored.

    Whole texts are scanned, twice. Null and wordless texts count nowhere; null, empty and wordless items find nothing. Rows that
    share an item_id are one item (see items_of); repeated documents are ranked each, so ranks stay unique. Empty tables give no rows.

    Items are searched in blocks of about `block_chars` characters of terms, repeats included: that bounds what is collected, broadcast
    and held by a worker (an item is not cut). A task leaves at most `most` rows for each item of the block; ranks are taken over those.
    """
    parts = items_of(items).where(F.size("terms") > 0)
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 2)
    total = parts.agg(F.sum(size)).first()[0] or 0
    blocks, out = max(1, math.ceil(total / block_chars)), None
    for k in range(blocks):
        mine = parts.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == k).orderBy("item_id").collect()
        found = _best(docs, [(i, r.terms) for i, r in enumerate(mine)], most)
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found = found.withColumn("rank", rank).where(F.col("rank") <= most)
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(mine)], f"item long, item_id {parts.schema['item_id'].dataType.simpleString()}")
        found = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
