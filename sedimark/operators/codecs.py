"""Text and document codecs (D operators): statement streams, sections, budgets, weights. Built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.functions.scalars import AMINO, bucket_size, keyed_hash, keyed_uniform, once
from sedimark.operators.windows import running_sum

#: Fixed values of the document format: its section and statement words.
SEQUENCE, STATEMENTS, END, CONTACT, RETRACT = "<begin_sequence>", "<begin_statements>", "<end>", "<contact>", "<retract>"


def statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, a, b) of the ordered `<contact> <pA> <pB>` and `<retract> <pA> <pB>` statements after the last section mark;
    the sequence section never matches."""
    body = F.element_at(F.split(F.col(text), F.lit(STATEMENTS)), -1)
    pattern = r"<(contact|retract)>\s+<p(\d+)>\s+<p(\d+)>"
    parts = [F.regexp_extract_all(body, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
    rows = df.select(F.col(key), F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("kind", "a", "b"))])).alias("pos", "s"))
    return rows.select(key, "pos", F.col("s.kind").alias("kind"), F.col("s.a").cast("int").alias("a"), F.col("s.b").cast("int").alias("b"))


def fold_statements(events: DataFrame, key: str, order: Sequence[str], kind: str = "kind", a: str = "a", b: str = "b") -> DataFrame:
    """Live pairs of an edit stream: (key, i, j, live, emits, re_emits, redundant, retracts, absent_retracts).

    A pair's last statement decides whether it lives; contact after a retract is a re-emit, contact while live is redundant,
    retract while not live is absent."""
    e = events.select(key, *order, F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), (F.col(kind) == "contact").alias("on"))
    w = W.partitionBy(key, "i", "j").orderBy(*order)
    e = e.withColumns({"before": F.lag("on").over(w), "last": F.row_number().over(W.partitionBy(key, "i", "j").orderBy(*[F.desc(o) for o in order])) == 1})
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    was = F.coalesce("before", F.lit(False))
    return e.groupBy(key, "i", "j").agg(
        F.bool_or(F.col("last") & F.col("on")).alias("live"), n(F.col("on")).alias("emits"), n(F.col("on") & F.col("before").isNotNull() & ~was).alias("re_emits"),
        n(F.col("on") & was).alias("redundant"), n(~F.col("on")).alias("retracts"), n(~F.col("on") & ~was).alias("absent_retracts"),
    )


def split_sections(df: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, section, body) of the parts after each marker, numbered from 0; what comes before the first is left out."""
    parts = F.split(F.col(text), F.regexp_replace(F.lit(marker), r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    return df.select(F.col(key), F.posexplode(parts).alias("n", "body")).where("n > 0").select(key, (F.col("n") - 1).alias("section"), "body")


def parse_document(document: Column, length: Column, n_term: Column, modulus: int = 2000) -> Column:
    """struct<sequence, pairs array<struct<i,j>>>: residues are named at (position - n_term) modulo the index space, X where none
    is or the name is unknown; pairs come from the contact statements, sorted and distinct, both ends inside the sequence."""
    names = F.create_map(*[F.lit(x) for kv in AMINO.items() for x in kv])
    head = F.element_at(F.split(document, F.lit(STATEMENTS)), 1)
    body = F.element_at(F.split(document, F.lit(STATEMENTS)), -1)
    where = lambda p, first: F.pmod(p.cast("int") - first, F.lit(modulus))
    rows = F.arrays_zip(F.regexp_extract_all(head, F.lit(r"<p(\d+)>\s+<([A-Z]{3})>"), F.lit(1)).alias("p"), F.regexp_extract_all(head, F.lit(r"<p(\d+)>\s+<([A-Z]{3})>"), F.lit(2)).alias("aa"))
    placed = lambda first: F.map_from_entries(F.array_distinct(F.transform(rows, lambda r: F.struct(where(r["p"], first), F.coalesce(F.try_element_at(names, r["aa"]), F.lit("X"))))))
    letters = lambda first: once(placed(first), lambda m: F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit("X"))))
    ends = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(r"<contact>\s+<p(\d+)>\s+<p(\d+)>"), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "b"))])
    inside = lambda pairs: F.filter(pairs, lambda p: p["j"] < length)
    pairs = lambda first: F.transform(ends, lambda e: F.struct(F.least(where(e["a"], first), where(e["b"], first)).alias("i"), F.greatest(where(e["a"], first), where(e["b"], first)).alias("j")))

    def read(first: Column) -> Column:
        sequence = F.when(length > 0, F.array_join(letters(first), "")).otherwise("")
        return F.struct(sequence.alias("sequence"), F.array_sort(F.array_distinct(inside(pairs(first)))).alias("pairs"))

    return once(n_term, read)


def build_documents(entries: DataFrame, contacts: DataFrame, context: int, least_degree: float = 0.0, modulus: int = 2000) -> DataFrame:
    """entry_id, document, n_contacts, n_excluded, truncated, in the order that each entry's own hash gives.

    entries: entry_id, sequence array<string> of residue names; contacts: entry_id, i, j, degree. The token budget is context
    less the fixed part (two tokens per residue, three marks); each contact takes three. Strongest contacts are kept first,
    then shuffled by keyed hash; the ends of each swap by a keyed coin. Positions start at a keyed offset modulo the index
    space. The hash order replaces a sequential generator, so results don't depend on partitions."""
    start = F.floor(keyed_uniform(F.col("entry_id"), "start") * modulus).cast("int")
    n = F.size("sequence")
    told = lambda first: F.transform("sequence", lambda r, i: F.concat_ws(" ", F.concat(F.lit("<p"), F.pmod(i + first, F.lit(modulus)).cast("string"), F.lit(">")), F.concat(F.lit("<"), r, F.lit(">"))))
    head = F.array_join(once(start, told), " ")
    base = entries.select("entry_id", head.alias("head"), start.alias("start"), F.greatest(F.floor((F.lit(context) - 2 * n - 3) / 3), F.lit(0)).alias("budget"))
    c = contacts.where(F.col("degree") >= least_degree).withColumn("__r", F.row_number().over(W.partitionBy("entry_id").orderBy(F.desc("degree"), "i", "j")))
    c = c.join(base.select("entry_id", "start", "budget"), "entry_id")
    p = lambda x: F.concat(F.lit("<p"), F.pmod(F.col(x) + F.col("start"), F.lit(modulus)).cast("string"), F.lit(">"))
    coin = keyed_uniform(F.col("entry_id"), "coin", F.col("i"), F.col("j")) < 0.5
    line = F.concat_ws(" ", F.lit(CONTACT), F.when(coin, F.concat_ws(" ", p("i"), p("j"))).otherwise(F.concat_ws(" ", p("j"), p("i"))))
    kept = F.when(F.col("__r") <= F.col("budget"), F.struct(keyed_hash(F.col("entry_id"), "order", F.col("i"), F.col("j")).alias("h"), line.alias("line")))
    lines = c.groupBy("entry_id").agg(F.count("*").alias("__n"), F.array_sort(F.collect_list(kept)).alias("lines"))  # bounded by the budget; a list leaves nulls out
    out = base.join(lines, "entry_id", "left")
    body = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), " "), F.lit(""))
    text = F.concat_ws(" ", F.lit(SEQUENCE), F.when(F.col("head") != "", F.col("head")), F.lit(STATEMENTS), F.when(body != "", body), F.lit(END))
    kept_n, total = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce("__n", F.lit(0))
    return out.select("entry_id", text.alias("document"), kept_n.alias("n_contacts"), (total - kept_n).alias("n_excluded"), (total > kept_n).alias("truncated"))


def sequence_document(sequence: Column) -> Column:
    """Document of a sequence alone: residues at positions from 0, no statements."""
    body = F.array_join(F.transform(sequence, lambda r, i: F.concat(F.lit("<p"), i.cast("string"), F.lit("> <"), r, F.lit(">"))), " ")
    return F.concat_ws(" ", F.lit(SEQUENCE), F.when(body != "", body), F.lit(STATEMENTS), F.lit(END))


def pause_overhead(key: Column, rate: float, p: float, slots: int) -> Column:
    """Tokens of pause runs: per slot a keyed gate of that rate, then a geometric length by the inverse CDF."""
    import math

    one = lambda s: F.when(keyed_uniform(key, "gate", s) < rate, F.greatest(F.ceil(F.log(1 - keyed_uniform(key, "run", s)) / math.log(1 - p)), F.lit(1))).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(slots)), F.lit(0).cast("long"), lambda acc, s: acc + one(s))


def pack_until_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Rows of each group, in order (its first column a number or a time), up to the first that would pass the budget: packing stops
    there, it doesn't skip."""
    return running_sum(df, keys, order, size, "used").where(F.col("used") <= budget)


def draft_size(m: Column, alpha: float, u: Column) -> Column:
    """Truncated power-law draw on 1..m by the inverse CDF of u in [0, 1)."""
    if alpha == 1.0:
        x = F.exp(u * F.log(m + 1.0))
    else:
        x = F.pow(1 + u * (F.pow(m + 1.0, F.lit(1 - alpha)) - 1), F.lit(1 / (1 - alpha)))
    return F.least(F.floor(x), m).cast("int")


def span_weights(ids: Column, header: float, draft: float, final: float, begin: int) -> Column:
    """Weight per token: header before the first begin, final from the last on, draft between; without a begin all header."""
    marks = F.transform(ids, lambda x: (x == begin).cast("int"))
    total = F.aggregate(marks, F.lit(0), lambda a, m: a + m)
    return F.transform(ids, lambda x, i: F.when(total == 0, header).when(_seen(marks, i) == 0, header).when(_seen(marks, i) == total, final).otherwise(draft))


def _seen(marks: Column, i: Column) -> Column:
    return F.aggregate(F.slice(marks, F.lit(1), i + 1), F.lit(0), lambda a, m: a + m)


def word_level(df: DataFrame, key: str, text: str | Column, vocabulary: DataFrame, unknown: int, end: int) -> DataFrame:
    """(key, ids) of each row by whitespace words through a (token, id) table; unknown words get `unknown`, `end` closes. Rows that share a
    key stay apart."""
    text = F.col(text) if isinstance(text, str) else text
    rows = df.select(F.col(key), F.monotonically_increasing_id().alias("__row"), text.alias("__t"))
    words = rows.select("__row", F.posexplode(F.filter(F.split(F.coalesce("__t", F.lit("")), r"\s+"), lambda w: w != "")).alias("pos", "token"))
    ids = words.join(vocabulary, "token", "left").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("__i"))
    return rows.join(ids, "__row", "left").select(key, F.concat(F.coalesce(F.transform("__i", lambda x: x["id"].cast("int")), F.array().cast("array<int>")), F.array(F.lit(end))).alias("ids"))


def token_faults(ids: Column, vocabulary: int, unknown: int, end: int, least: int, most: int) -> Column:
    """Names of the checks that a token record fails."""
    n = F.size(ids)
    tests = [("empty", n == 0), ("too_short", n < least), ("too_long", n > most), ("out_of_range", F.exists(ids, lambda x: (x < 0) | (x >= vocabulary))), ("unknown_token", F.array_contains(ids, unknown)), ("no_end", (n > 0) & (F.element_at(ids, -1) != end))]
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in tests]), lambda x: x.isNotNull())


def shuffled(items: Column, key: Column, *salt) -> Column:
    """The array in the order of keyed hashes of (key, salts, place)."""
    return F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct(keyed_hash(key, *salt, i).alias("h"), i.alias("i"), x.alias("x")))), lambda s: s["x"])


def to_parallel(contacts: Column) -> Column:
    """array<struct<seq_i,seq_j,degree>> -> struct of parallel arrays, without loss."""
    field = lambda f: F.transform(contacts, lambda c: c[f]).alias(f)
    return F.struct(*[field(f) for f in ("seq_i", "seq_j", "degree")])


def from_parallel(store: Column) -> Column:
    return F.transform(F.arrays_zip(store["seq_i"], store["seq_j"], store["degree"]), lambda c: F.struct(c["seq_i"].alias("seq_i"), c["seq_j"].alias("seq_j"), c["degree"].alias("degree")))


def budget_batches(df: DataFrame, size: str, order: Sequence[str], buckets: Sequence[int], budget: int) -> DataFrame:
    """df with bucket (the smallest of at least `size`, else the size) and batch: rows of a bucket in order, budget // bucket of them (one
    at least) a batch."""
    d = df.withColumn("bucket", bucket_size(F.col(size), buckets))
    place = F.row_number().over(W.partitionBy("bucket").orderBy(*order)) - 1
    return d.withColumn("batch", F.floor(place / F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))))
