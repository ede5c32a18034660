"""Decontamination and similarity (N operators): drop lists, ladders of tiers, survival, neighbour votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.operators.aggregates import best_evidence
from sedimark.operators.filters import is_contaminant

TIERS = ("A", "B", "C")


def tiers_up_to(tier: str) -> tuple[str, ...]:
    """Cumulative: A is in B, B in C."""
    return TIERS[: TIERS.index(tier) + 1]


def drop_list(hits: DataFrame, keys: Sequence[str], least_identity: float = 0.30, least_coverage: float = 0.50, most_evalue: float | None = 1e-3, ceiling: float = 10.0) -> DataFrame:
    """One row per contaminated key: best identity with its coverage, E-value and nearest query, and the rule that applied
    (evalue, identity_coverage or both over all its hits). hits: keys, query, fident, cov, evalue. Hits above the reporting
    ceiling of the E-value are left out before anything else; equal identities go to the smaller query."""
    h = hits.where(F.col("evalue") <= ceiling)
    by_id = (F.col("fident") >= least_identity) & (F.col("cov") >= least_coverage)
    by_e = F.lit(False) if most_evalue is None else F.col("evalue") <= most_evalue
    h = h.where(is_contaminant(F.col("fident"), F.col("cov"), F.col("evalue"), least_identity, least_coverage, most_evalue)).withColumns({"__i": by_id, "__e": by_e})
    each = h.groupBy(*keys, "fident").agg(F.min(F.struct("query", "cov", "evalue")).alias("__p"), F.bool_or("__i").alias("__i"), F.bool_or("__e").alias("__e"), F.count("*").alias("__n"))
    best = each.groupBy(*keys).agg(F.max_by(F.struct("fident", "__p"), F.struct(F.col("fident").isNotNull(), "fident")).alias("__b"), F.bool_or("__i").alias("__i"), F.bool_or("__e").alias("__e"), F.sum("__n").alias("n_hits"))
    rule = F.when(F.col("__i") & F.col("__e"), "both").when(F.col("__e"), "evalue").otherwise("identity_coverage")
    return best.select(*keys, F.col("__b.fident").alias("fident"), F.col("__b.__p.query").alias("query"), F.col("__b.__p.cov").alias("cov"), F.col("__b.__p.evalue").alias("evalue"), "n_hits", rule.alias("rule"))


def union_drop_lists(lists: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Each key once, with the evidence of the strongest reference (set union, not a sum)."""
    out = None
    for name, df in lists.items():
        df = df.withColumn("reference", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return best_evidence(out, keys, "fident", ["reference"], ["query"])


def apply_drop_list(corpus: DataFrame, dropped: DataFrame, keys: Sequence[str]) -> DataFrame:
    return corpus.join(dropped.select(*keys).distinct(), list(keys), "left_anti")


def reconcile(corpus: DataFrame, dropped: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Counts of total, dropped and kept rows; raises unless they add up."""
    flag = dropped.select(*keys).distinct().withColumn("__d", F.lit(1))
    row = corpus.join(flag, list(keys), "left").agg(F.count("*").alias("total"), F.count("__d").alias("dropped")).first()
    kept = apply_drop_list(corpus, dropped, keys).count()
    if kept != row.total - row.dropped:
        raise ValueError(f"{row.total} rows less {row.dropped} dropped aren't {kept} kept")
    return {"total": row.total, "dropped": row.dropped, "kept": kept}


def threshold_sweep(best: DataFrame, value: str, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """n, survivors and share per threshold off one pass: rows (a value per entity, null: no hit) are counted for all
    thresholds at once."""
    aggs = [F.count("*").alias("n")] + [F.sum(F.when(F.col(value).isNull() | (F.col(value) < t), 1).otherwise(0)).alias(f"t{i}") for i, t in enumerate(thresholds)]
    row = best.groupBy(*keys).agg(*aggs)
    items = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("survivors")) for i, t in enumerate(thresholds)])).alias("s")
    return row.select(*keys, "n", items).select(*keys, "s.threshold", "n", "s.survivors", (F.col("s.survivors") / F.col("n")).alias("share"))


def best_per_query(queries: DataFrame, hits: DataFrame, least_coverage: float = 0.5, most_evalue: float = 1e-3, most: int = 1000) -> DataFrame:
    """One row per query, hit-less ones too: n_hits, n_significant, best_any, best_covered, censored (n_hits at the search's
    limit). queries: query; hits: query, target, fident, cov, evalue."""
    significant = F.col("evalue") <= most_evalue
    agg = hits.groupBy(F.col("query").alias("__q")).agg(
        F.count("*").alias("n_hits"), F.sum(F.when(significant, 1).otherwise(0)).alias("n_significant"),
        F.max(F.when(significant, F.col("fident"))).alias("best_any"), F.max(F.when(significant & (F.col("cov") >= least_coverage), F.col("fident"))).alias("best_covered"),
    )
    out = queries.join(agg, F.col("query") == F.col("__q"), "left").drop("__q").fillna(0, ["n_hits", "n_significant"])
    return out.withColumn("censored", (F.col("n_hits") >= most).cast("int"))


def residual_category(df: DataFrame, key: str, ordered: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    """First category, in order, that any of a key's rows falls in."""
    flags = df.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"__{i}") for i, (_, c) in enumerate(ordered)])
    out = F.lit(otherwise)
    for i, (name, _) in reversed(list(enumerate(ordered))):
        out = F.when(F.col(f"__{i}"), name).otherwise(out)
    return flags.select(key, out.alias("category"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, size: int = 8192, block: int = 4096) -> DataFrame:
    """(query, vec_id, score, rank): the k vectors of largest inner product (rounded, equal ones by smaller id) for each query, itself left out.

    queries: query long, q array; vectors: vec_id long, v array. Queries are dealt to blocks and vectors to parts of bounded size, both
    counted first; a block meets a part as a matrix product, a few rows of it at a time, and leaves k rows per query. Vectors travel once
    per block, so a question set of up to `block` rows sends each vector once."""
    from sedimark.operators.windows import top_k

    nq, nv = queries.count(), vectors.count()
    blocks, parts = max(1, -(-nq // block)), max(1, -(-nv // size))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("query").cast("long").alias("query"), F.col("q").cast("array<double>").alias("q"), deal("query", blocks).alias("block"), every(parts).alias("part"))
    right = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), deal("vec_id", parts).alias("part"), every(blocks).alias("block"))

    def tile(a, b):
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if a.num_rows and b.num_rows:
            matrix = lambda c, n: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            q, v = matrix(a.column("q"), a.num_rows), matrix(b.column("v"), b.num_rows)
            ids, cid = a.column("query").to_numpy(), b.column("vec_id").to_numpy()
            for at in range(0, len(ids), 256):
                s = np.round(q[at : at + 256] @ v.T, digits)
                s[ids[at : at + 256, None] == cid] = -np.inf
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
                row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                order = np.lexsort((cid[col], -s[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, np.arange(len(s)))
                keep = np.arange(len(row)) - first[row] < k
                for o, x in zip(out, (ids[at + row[keep]], cid[col[keep]], s[row[keep], col[keep]])):
                    o.append(x)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table({"query": cat(out[0], pa.int64()), "vec_id": cat(out[1], pa.int64()), "score": cat(out[2], pa.float64())})

    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(tile, "query long, vec_id long, score double")
    return top_k(hits, ["query"], [F.desc("score"), "vec_id"], k)


def neighbour_votes(neighbours: DataFrame, labels: DataFrame, ks: Sequence[int], with_self: bool = False) -> DataFrame:
    """(query, k, label, votes, weight) for each k of a sweep. neighbours: query, vec_id, rank, score; labels: vec_id, label."""
    n = neighbours if with_self else neighbours.where("query <> vec_id")
    n = n.join(labels, "vec_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    return n.groupBy("query", "k", "label").agg(F.count("*").alias("votes"), F.sum("score").alias("weight"))


def winning_label(votes: DataFrame) -> DataFrame:
    """The label of most votes, then weight, then the smaller label."""
    w = W.partitionBy("query", "k").orderBy(F.desc("votes"), F.desc("weight"), "label")
    return votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def tie_broken(df: DataFrame, keys: Sequence[str], count: str, second: str, column: str = "score") -> DataFrame:
    """count + half the group's min-max of a second score: never enough to cross a count."""
    w = W.partitionBy(*keys)
    low, high = F.min(second).over(w), F.max(second).over(w)
    return df.withColumn(column, F.col(count) + F.coalesce(F.try_divide(F.col(second) - low, high - low), F.lit(0.0)) * 0.5)


def grams(text: str | Column, n: int) -> Column:
    """array<string> of the lower-case word n-grams of a text, in order, repeats included: one pass of a pattern that looks ahead for n
    words from each word's start."""
    one = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.regexp_extract_all(one, F.lit(r"(?<![^ ])(?=(" + " ".join(["[^ ]+"] * n) + r")(?![^ ]))"), F.lit(1))


def word_grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram) distinct lower-case word n-grams."""
    return df.select(F.col(key), F.explode(F.array_distinct(grams(text, n))).alias("gram"))


def gram_overlap(corpus: DataFrame, reference: DataFrame, key: str, text: str, ref_key: str, ref_text: str, n: int) -> DataFrame:
    """(key, ref_key, shared, coverage of the reference's grams) of every pair that shares a gram.

    The reference's grams are the small side, broadcast by the planner where their size allows: grams of the corpus that aren't among
    them don't leave their task, and only those that are get counted as distinct ones."""
    ref = word_grams(reference, ref_key, ref_text, n)
    size = ref.groupBy(ref_key).agg(F.count("*").alias("n_grams"))
    met = corpus.select(F.col(key), F.explode(grams(text, n)).alias("gram")).join(ref, "gram")
    shared = met.select(key, ref_key, "gram").distinct().groupBy(key, ref_key).agg(F.count("*").alias("shared"))
    return shared.join(size, ref_key).select(key, ref_key, "shared", (F.col("shared") / F.col("n_grams")).alias("coverage"))
