"""Packing: what a worker holds doesn't follow the partition."""

import zlib
from collections import defaultdict

import pyspark

from sedimark.llm import bpe, packing, queries


def packer(monkeypatch, **given):
    """The function that packs a partition's batches."""

    class Context:
        @staticmethod
        def partitionId():
            return 3

    class Docs:
        def select(self, *columns):
            return self

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: Context)
    monkeypatch.setattr(packing, "map_arrow", lambda df, make, *_: make())
    return packing.pack_documents(Docs(), queries.tokenizer_path(), **given)


def batches(count, seen, words=lambda i: 1 + i * 37 % 900):
    import pyarrow as pa

    for i in range(count):
        seen.append(i)
        texts = [("a b c d " * (1 + words(100 * i + j) // 4))[: 2 * words(100 * i + j)] for j in range(100)]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(100 * i, 100 * i + 100), pa.int64()), "text": texts})


def test_pieces_leave_before_the_partition_is_read(monkeypatch):
    seen = []
    first = next(iter(packer(monkeypatch)(batches(80, seen, lambda i: 500))))
    assert len(seen) < 45 and first.num_rows <= 1024


def test_runs_fill_the_windows_that_earlier_runs_left_open(monkeypatch):
    spans, tokens, pieces = defaultdict(list), 0, defaultdict(int)
    for out in packer(monkeypatch, run_ids=5000)(batches(10, [])):
        for r in out.to_pylist():
            assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["sequence_id"] >> 33 == 3
            spans[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
            tokens += r["length"]
    assert len(pieces) == 1000 and all(n == total for (_, total), n in pieces.items())
    for parts in spans.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(spans) <= 1.01 * tokens / 2048 + 2


def test_words_met_again_outlast_those_met_once():
    coder = bpe.Bpe(queries.tokenizer_path(), most=1000)
    often, name = {f"again{chr(97 + i)}" for i in range(20)}, lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    for block in range(30):
        coder.learn({name(100 * block + i) for i in range(100)} | (often if block % 4 == 0 else set()))
        assert len(coder.ids) <= 1000 and coder.ids.keys() == coder.texts.keys()
        assert block < 4 or often <= coder.ids.keys()


def test_long_words_are_not_kept_by_number_alone():
    coder = bpe.Bpe(queries.tokenizer_path(), most=1000)
    for block in range(20):
        coder.learn({f"{chr(97 + block)}{chr(97 + i)}" * 200 for i in range(20)})
        assert sum(map(len, coder.ids)) <= 64 * 1000 + 2 * 20 * 400
