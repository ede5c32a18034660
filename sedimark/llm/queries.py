"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import ann, bpe, chat, decontam, langid, lexical, merkle, packing, quality, sharding, simhash, suffix, vecdedup
from sedimark.llm.common import load


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a null doc_id is not held out, null and letterless texts are `und`. Repeated rows are classified each, an
    empty table gives no rows."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~_held_out()))
    return langid.classify(docs.select("doc_id", "text"), model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op2_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document, null texts as empty ones; scores are null where labels of both classes are missing."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model).drop("text", "source", "lang", "n_chars")


def op3_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, groups and audit of every vector; null, zero and non-finite ones link with nothing."""
    return vecdedup.near_duplicates(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law `bytes`; a null text has no bytes, repeated rows get a slot each."""
    out = sharding.shard(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document; a null text is empty, repeated rows are coded each."""
    coded = bpe.encode_documents(load(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op6_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document; a null text is empty, rows equal in doc_id and text are one document and get a row each."""
    out = suffix.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_bk_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; null and wordless texts have fingerprint zero and link like others."""
    out = simhash.near_duplicates(simhash.fingerprints(load(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one more, formatted and read back; null texts and roles are empty, equal turns are ordered by role and text."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    template = chat.Template()
    out = chat.read_chats(chat.format_chats(turns.unionByName(odd), template), template)
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"], template)), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op9_block_matrix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every query vector; null, zero and non-finite vectors take no part, ties go to the smaller vec_id."""
    vectors = load(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document; a null text is its end token alone, repeated rows are packed each."""
    packed = packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, words=800_000)
    return packed.drop("ids")


def op11_window_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window; a null text has no words, repeated rows are scanned each."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contaminations(docs, load(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the check of each where every other one is tampered with; nulls are `-`, a null doc_id
    comes first in its source and is left alone, repeated rows are leaves of their own."""
    docs = load(spark, sf_dir, "documents")
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select(F.col("source").alias("tree"), "doc_id", merkle.leaf(*kept, F.col("text")).alias("digest"), merkle.leaf(*kept, changed).alias("tampered"))
    out = merkle.manifest(leaves, ["doc_id"])
    said = F.sha2(F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", said.alias("proof_sha256"), merkle.folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; null texts and wordless items take no part, repeated rows are ranked each."""
    return lexical.ranked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_string_kernel, op2_co_training, op3_flat_graph, op4_histogram_sort, op5_trie_bpe, op6_interval_tree, op7_bk_simhash, op8_chat_format, op9_block_matrix_search, op10_best_fit_packing, op11_window_automaton, op12_merkle_manifest, op13_lexical_scan)}


def _chat_sql() -> str:
    t = chat.Template()

    def text(s: str) -> str:
        return "chr(10)".join(f"'{p}'" for p in s.split("\n")).replace("''chr(10)", "chr(10)||").replace("chr(10)''", "||chr(10)") if "\n" in s else f"'{s}'"

    def escaped(c: str) -> str:
        out = f"replace({c}, '\\', '\\0')"
        for i, x in enumerate(t.controls()):
            out = f"replace({out}, {text(x)}, '\\{chr(ord('a') + i)}')"
        return out

    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
folded AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS lost,
    sum(length({escaped('text')}) + CASE role {marks} ELSE {sum(map(len, t.other))} + length({escaped('role')}) END) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS LAST, role, text) AS roles
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM folded"""


#: The words of a text, as the automaton operators take them.
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_WINDOW_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1:i + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT k, size, w, unnest(range(0, greatest(len(w) - size + 1, 0))) AS i FROM dw, (SELECT DISTINCT size FROM wins)),
found AS (
  SELECT p.k, p.i, p.size, v.item_id FROM (SELECT k, size, i, array_to_string(w[i + 1:i + size], ' ') AS win FROM places) p
  JOIN wins v ON v.size = p.size AND v.win = p.win),
hits AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS x FROM found) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT k, item_id FROM found) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (k) LEFT JOIN named USING (k)"""

_MERKLE_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc,
    list_reduce(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), lambda a, b: a || b) AS head
  FROM documents),
texts AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM rows),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed)::VARCHAR || ':' || changed, '-')) AS tampered FROM texts),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
levels AS (
  SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT p.source, p.leaf, p.place AS start, s.place AS top, l.level AS step, p.place // (3 ** l.level)::BIGINT AS own, l.nodes
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN levels l ON l.source IS NOT DISTINCT FROM s.source AND l.level < s.depth
  UNION ALL
  SELECT p.source, p.leaf, p.place, s.place, s.depth + t.level, s.place // (3 ** t.level)::BIGINT, t.nodes
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN tops t ON len(t.nodes) > 1),
sides AS (
  SELECT source, start, step, array_to_string(nodes[own - own % 3 + 1:own], '') AS lefts, array_to_string(nodes[own + 2:own - own % 3 + 3], '') AS rights FROM steps),
said AS (SELECT source, start, list({'l': lefts, 'r': rights} ORDER BY step) AS proof FROM sides GROUP BY source, start),
folds AS (
  SELECT p.*, coalesce(proof, []) AS proof, 0 AS step, tampered AS node FROM placed p LEFT JOIN said s ON s.source IS NOT DISTINCT FROM p.source AND s.start = p.place
  UNION ALL
  SELECT * REPLACE (step + 1 AS step, sha256(proof[step + 1].l || node || proof[step + 1].r) AS node) FROM folds WHERE step < len(proof)),
root AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)
SELECT f.doc_id, f.leaf, s.subroot, r.root, sha256(array_to_string(list_transform(f.proof, lambda p: p.l || p.r), '')) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM folds f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source, root r WHERE f.step = len(f.proof)"""

_LEXICAL_SQL = f"""
WITH dw AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT k, doc_id, len(w)::HUGEINT AS n, w FROM dw WHERE len(w) > 0),
totals AS (SELECT count(*)::HUGEINT AS n_docs, sum(n)::HUGEINT AS n_words FROM docs),
tfs AS (SELECT k, term, count(*)::HUGEINT AS tf FROM (SELECT k, unnest(w) AS term FROM docs) GROUP BY k, term),
uses AS (SELECT item_id, term, count(*)::HUGEINT AS uses FROM (SELECT item_id, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY item_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w FROM tfs, totals GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, k, sum(uses * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words)))) AS score
  FROM uses JOIN tfs USING (term) JOIN weights USING (term) JOIN (SELECT k, doc_id, n FROM docs) USING (k), totals GROUP BY item_id, doc_id, k),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM placed WHERE rank <= 10"""

SQL: dict[str, str] = {"op8_chat_format": _chat_sql(), "op11_window_automaton": _WINDOW_SQL, "op12_merkle_manifest": _MERKLE_SQL, "op13_lexical_scan": _LEXICAL_SQL}
