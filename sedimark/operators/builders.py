"""Document builders that lay out several chains or mix contacts with distances. Draws are keyed hashes, so no generator is threaded
through a document and every step is a built-in expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.functions.scalars import distance_bin, keyed_hash, keyed_uniform, quality_bin


def layout_chains(chains: DataFrame, positions: int, least_gap: int) -> DataFrame:
    """entry_id, chain, length, slot, start: where each chain's first residue lies on a ring of that many positions.

    chains: entry_id, chain, length. Chains follow each other in keyed order from a keyed offset; between them lie gaps of at least
    least_gap (none is asked of a single chain), the slack being dealt by sorted keyed cuts. Entries that don't fit are left out.
    The start of slot s has a closed form: offset, the lengths before it, s least gaps, and the s-th cut."""
    e = W.partitionBy("entry_id")
    order = e.orderBy(keyed_hash(F.col("entry_id"), "slot", F.col("chain")), "chain")
    d = chains.withColumns({"slot": F.row_number().over(order) - 1, "__k": F.count("*").over(e), "__total": F.sum("length").over(e)})
    d = d.withColumn("__before", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length"))
    gap = F.when(F.col("__k") == 1, 0).otherwise(least_gap)
    slack = F.lit(positions) - F.col("__total") - F.col("__k") * gap
    d = d.withColumns({"__gap": gap, "__slack": slack}).where("__slack >= 0")
    draws = F.transform(F.sequence(F.lit(1), F.col("__k").cast("int")), lambda t: F.floor(keyed_uniform(F.col("entry_id"), "cut", t) * (F.col("__slack") + 1)))
    cuts = F.array_sort(F.slice(draws, F.lit(1), F.greatest(F.col("__k").cast("int") - 1, F.lit(0))))
    offset = F.floor(keyed_uniform(F.col("entry_id"), "offset") * positions)
    start = offset + F.col("__before") + F.col("slot") * F.col("__gap") + F.when(F.col("slot") > 0, F.try_element_at(cuts, F.col("slot"))).otherwise(0)
    return d.select("entry_id", "chain", "length", "slot", F.pmod(start, F.lit(positions)).cast("int").alias("start"))


def weighted_draw(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, u: str) -> DataFrame:
    """One row per group: the first whose cumulated weight passes u (a column in [0, 1)) times the total."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.withColumns({"__c": F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, 0)), "__t": F.sum(weight).over(W.partitionBy(*keys))})
    d = d.where(F.col("__c") > F.col(u) * F.col("__t")).withColumn("__r", F.row_number().over(w))
    return d.where("__r = 1").drop("__c", "__t", "__r")


def distance_documents(residues: DataFrame, context: int, fractions: tuple[float, float] = (0.0, 0.4), cutoff: float = 8.0, bands: Sequence[tuple[str, int, int | None]] = (("short", 6, 12), ("medium", 12, 24), ("long", 24, None)), quality_edges: Sequence[float] = (50, 70, 90)) -> DataFrame:
    """entry_id, document, n_contacts, n_distances of entries that fit.

    residues: entry_id, i, name, x, y, z, quality (one point per residue). Overhead is five tokens and one per residue. Each band of
    separations gets a keyed fraction of what is left, at three tokens a contact; distances between keyed pairs of residues, six tokens
    each, fill the rest. Statements come in keyed order. Contacts are found in grid cells of the cutoff's size, not among all pairs."""
    from sedimark.operators.joins import within_distance

    entry = residues.groupBy("entry_id").agg(F.count("*").alias("n"), F.avg("quality").alias("q"), F.array_sort(F.collect_list(F.struct("i", "name", "x", "y", "z"))).alias("all")).withColumn("room", F.lit(context - 5) - F.col("n")).where("n >= 2 and room > 0")
    point = residues.select(F.struct("entry_id", "i").alias("id"), "x", "y", "z", F.crc32(F.col("entry_id").cast("binary")).cast("double").alias("__e"))
    # the entry is a fourth axis, so that cells of different entries are apart
    near = within_distance(point.withColumn("e", F.col("__e") * cutoff * 3), point.withColumn("e", F.col("__e") * cutoff * 3), cutoff, ("x", "y", "z", "e"))
    near = near.where("a_id.entry_id = b_id.entry_id and a_id.i < b_id.i").select(F.col("a_id.entry_id").alias("entry_id"), F.col("a_id.i").alias("i"), F.col("b_id.i").alias("j"))
    band = F.lit(None).cast("string")
    for name, low, high in bands:
        inside = (F.col("j") - F.col("i") >= low) & (F.lit(True) if high is None else F.col("j") - F.col("i") < high)
        band = F.when(inside, name).otherwise(band)
    share = lambda name: F.lit(fractions[0]) + keyed_uniform(F.col("entry_id"), "share", name) * (fractions[1] - fractions[0])
    near = near.withColumn("band", band).where("band is not null").join(entry.select("entry_id", "room"), "entry_id")
    rank = F.row_number().over(W.partitionBy("entry_id", "band").orderBy(keyed_hash(F.col("entry_id"), "contact", F.col("i"), F.col("j"))))
    contacts = near.withColumn("__r", rank).where(F.col("__r") <= F.floor(F.floor(F.col("room") * share(F.col("band"))) / 3))
    line = F.concat(F.lit("<contact> <p"), F.col("i"), F.lit("> <p"), F.col("j"), F.lit(">"))
    lists = contacts.groupBy("entry_id").agg(F.collect_list(F.struct(keyed_hash(F.col("entry_id"), "c", F.col("i"), F.col("j")).alias("h"), line.alias("s"))).alias("contacts"))  # bounded by the context
    none = F.array().cast("array<struct<h:string,s:string>>")
    e = entry.join(lists, "entry_id", "left").withColumn("contacts", F.coalesce("contacts", none))
    n_dist = F.greatest(F.floor((F.col("room") - 3 * F.size("contacts")) / 6), F.lit(0)).cast("int")

    def one(k):
        a = F.floor(keyed_uniform(F.col("entry_id"), "a", k) * F.col("n")).cast("int")
        b = F.floor(keyed_uniform(F.col("entry_id"), "b", k) * (F.col("n") - 1)).cast("int")
        b = b + (b >= a).cast("int")
        p, q = F.get(F.col("all"), F.least(a, b)), F.get(F.col("all"), F.greatest(a, b))
        far = F.sqrt(sum((p[x] - q[x]) ** 2 for x in "xyz"))
        text = F.concat(F.lit("<distance> <p"), p["i"], F.lit("> <p"), q["i"], F.lit("> <CA> <CA> <d"), distance_bin(far), F.lit(">"))
        return F.struct(keyed_hash(F.col("entry_id"), "d", k).alias("h"), text.alias("s"))

    draws = F.when(n_dist > 0, F.transform(F.sequence(F.lit(1), F.greatest(n_dist, F.lit(1))), one)).otherwise(none)
    e = e.withColumn("distances", draws)
    body = F.array_join(F.transform(F.array_sort(F.concat("contacts", "distances")), lambda s: s["s"]), " ")
    head = F.array_join(F.transform("all", lambda r: F.concat(F.lit("<"), r["name"], F.lit(">"))), " ")
    text = F.concat_ws(" ", F.lit("<contacts-and-distances> <begin_sequence>"), head, F.lit("<begin_statements>"), F.when(body != "", body), F.concat(F.lit("<q"), quality_bin(F.col("q"), quality_edges), F.lit(">")), F.lit("<end>"))
    return e.select("entry_id", text.alias("document"), F.size("contacts").alias("n_contacts"), F.size("distances").alias("n_distances"))


def multi_draft_documents(entries: DataFrame, rollouts: DataFrame, budget: int, alpha: float, least_gap: int = 6, modulus: int = 2000) -> DataFrame:
    """entry_id, document, n_residues, n_true, n_drafts, n_tokens, mean_f1: drafts of keyed sizes from an entry's rollouts, then its true pairs,
    under one token budget.

    entries: entry_id, residues array<string>, pairs array<int> (flat true pairs); rollouts: entry_id, rollout, pairs array<int>, f1. A document is
    its kind, the sequence section (a mark and two tokens a residue), a section per draft (a mark, three tokens a pair), the final
    section of true pairs, and the end. True pairs come first: only what they leave is packed with drafts, and they are cut by keyed
    order only where they alone pass the budget. Drafts are tried in keyed order; a draft's size is a power law draw on its rollout's
    pairs, none is shrunk to fit, and the first that doesn't fit ends the packing. Rollouts without a pair inside the sequence are passed
    over. Entries without residues, or whose sequence alone passes the budget, have no document; mean_f1 is null without drafts. Pairs
    repeated in an array count once; draws are functions of keys."""
    from sedimark.functions.scalars import canonical_pairs
    from sedimark.operators.codecs import draft_size

    n, e = F.size("residues"), F.col("entry_id")
    start = F.floor(keyed_uniform(e, "start") * modulus).cast("int")
    inside = lambda flat, size: F.filter(canonical_pairs(flat, least_gap), lambda p: (p["i"] >= 0) & (p["j"] < size))
    shuffled = lambda pairs, *salt: F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(keyed_hash(e, *salt, p["i"], p["j"]).alias("h"), p.alias("p")))), lambda s: s["p"])
    base = entries.where("residues is not null and size(residues) > 0").select("entry_id", "residues", n.alias("n"), start.alias("start"), (F.lit(budget - 4) - 2 * n).alias("room"), F.col("pairs").alias("flat"))
    base = base.where("room >= 0 and n <= " + str(modulus)).withColumn("true", F.slice(shuffled(inside(F.coalesce("flat", F.array().cast("array<int>")), F.col("n")), "true"), F.lit(1), F.floor(F.col("room") / 3).cast("int")))
    base = base.withColumn("left", F.col("room") - 3 * F.size("true")).drop("flat")
    r = rollouts.where("pairs is not null").join(base.select("entry_id", "n", "left", "start"), "entry_id")
    r = r.withColumn("own", inside(F.col("pairs"), F.col("n"))).where("size(own) > 0")
    r = r.withColumn("k", draft_size(F.size("own"), alpha, keyed_uniform(e, "size", F.col("rollout"))))
    w = W.partitionBy("entry_id").orderBy(keyed_hash(e, "slot", F.col("rollout")), "rollout").rowsBetween(W.unboundedPreceding, 0)  # a few rollouts per entry
    r = r.withColumn("used", F.sum(3 * F.col("k") + 1).over(w)).where(F.col("used") <= F.col("left"))
    told = lambda pairs, *salt: F.transform(pairs, lambda p: _statement(e, p, F.col("start"), modulus, *salt))
    draft = F.array_join(told(F.slice(shuffled(F.col("own"), "draft", F.col("rollout")), F.lit(1), F.col("k")), "turn", F.col("rollout")), " ")
    packed = r.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("used", "k", draft.alias("text")))).alias("drafts"), F.avg("f1").alias("mean_f1"))  # bounded by the budget
    out = base.join(packed, "entry_id", "left").withColumn("drafts", F.coalesce("drafts", F.array().cast("array<struct<used:bigint,k:int,text:string>>")))
    head = F.array_join(F.transform("residues", lambda x, i: F.concat(F.lit("<p"), F.pmod(i + F.col("start"), F.lit(modulus)), F.lit("> <"), x, F.lit(">"))), " ")
    sections = F.transform("drafts", lambda d: F.concat(F.lit("<begin_statements> "), d["text"]))
    final = F.array_join(told(F.col("true"), "turn"), " ")
    text = F.concat_ws(" ", F.lit("<contacts-multi> <begin_sequence>"), head, F.array_compact(sections), F.lit("<begin_statements>"), F.when(final != "", final), F.lit("<end>"))
    tokens = 4 + 2 * F.col("n") + 3 * F.size("true") + F.aggregate("drafts", F.lit(0), lambda a, d: a + 1 + 3 * d["k"])
    return out.select("entry_id", text.alias("document"), F.col("n").alias("n_residues"), F.size("true").alias("n_true"), F.size("drafts").alias("n_drafts"), tokens.alias("n_tokens"), "mean_f1")


def _statement(entry, pair, start, modulus: int, *salt):
    """A contact of a pair at its positions, its ends turned by a keyed coin."""
    p = lambda x: F.concat(F.lit("<p"), F.pmod(x + start, F.lit(modulus)).cast("string"), F.lit(">"))
    turn = keyed_uniform(entry, *salt, pair["i"], pair["j"]) < 0.5
    return F.concat_ws(" ", F.lit("<contact>"), F.when(turn, p(pair["j"])).otherwise(p(pair["i"])), F.when(turn, p(pair["i"])).otherwise(p(pair["j"])))
