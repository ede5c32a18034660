"""Queries of cluster purges, survival, evaluation sets and consolidation. Lines stand for alignments: a supplier is the query, a source
the training cluster that is hit."""

from pyspark.sql import functions as F

from sedimark.operators import curation as C
from sedimark.plans.registry import query

TIERS = {"B": 0.7, "C": 0.6}
CLUSTERS = """h AS (SELECT 'src' || (l_partkey % 30)::VARCHAR AS target, l_suppkey AS query, round(l_discount * 10 - (l_partkey % 30) / 60.0, 6)::DOUBLE AS q, round(l_tax * 10, 6) AS t, l_quantity AS fident, l_orderkey, l_linenumber FROM lineitem),
m AS (SELECT * FROM h SEMI JOIN (SELECT 'src' || (p_partkey % 25)::VARCHAR AS target FROM part) r USING (target)),
clus AS (SELECT target AS cluster, q AS best_q, max_tm, query, fident FROM (SELECT *, max(greatest(q, t)) OVER (PARTITION BY target) AS max_tm, row_number() OVER (PARTITION BY target ORDER BY q DESC, l_orderkey, l_linenumber, query, fident) AS r FROM m) WHERE r = 1),
sizes AS (SELECT source AS cluster, count(*) AS size FROM documents GROUP BY 1), tiers AS (SELECT * FROM (VALUES ('B', 0.7::DOUBLE), ('C', 0.6::DOUBLE)) t(tier, threshold))"""


def clusters(t):
    target = lambda c: F.concat(F.lit("src"), (F.col(c) % t_mod[c]).cast("string"))
    t_mod = {"l_partkey": 30, "p_partkey": 25}
    h = t("lineitem").select(target("l_partkey").alias("target"), F.col("l_suppkey").alias("query"), F.round(F.col("l_discount") * 10 - (F.col("l_partkey") % 30) / 60.0, 6).alias("q"), F.round(F.col("l_tax") * 10, 6).alias("t"), F.col("l_quantity").alias("fident"), "l_orderkey", "l_linenumber")
    return C.best_cluster_hits(h, t("part").select(target("p_partkey").alias("target")), ["l_orderkey", "l_linenumber"])


@query(f"WITH {CLUSTERS} SELECT * FROM clus")
def cluster_drop_list(spark, t):
    return clusters(t)


@query(f"""WITH {CLUSTERS} SELECT doc_id, source, coalesce(x.dropped, false) AS seq_dropped, coalesce(best_q >= 0.7, false) AS "struct_dropped_B", coalesce(best_q >= 0.6, false) AS "struct_dropped_C"
FROM documents LEFT JOIN (SELECT DISTINCT doc_id, true AS dropped FROM labels WHERE toxic = 1) x USING (doc_id) LEFT JOIN clus ON source = cluster""")
def purge_flags(spark, t):
    return C.purge_flags(t("documents").select("doc_id", "source"), t("labels").where("toxic = 1"), clusters(t), "doc_id", "source", "best_q", TIERS)


@query(f"""WITH {CLUSTERS} SELECT tier, threshold, count(*) AS n_clusters_hit, count(size) AS n_present, coalesce(sum(size), 0)::BIGINT AS n_documents, coalesce(quantile_cont(size, 0.5), 0)::DOUBLE AS median_size, coalesce(max(size), 0) AS max_size
FROM clus LEFT JOIN sizes USING (cluster), tiers WHERE best_q >= threshold GROUP BY 1, 2""")
def cluster_purge(spark, t):
    return C.cluster_purge(t("documents"), clusters(t), "source", "best_q", TIERS)


@query(f"""WITH {CLUSTERS}, s AS (SELECT unnest(['all', CASE WHEN query % 2 = 0 THEN 'designed' ELSE 'natural' END]) AS scope, cluster, best_q FROM clus)
SELECT scope, tier, count(*) AS n_clusters, coalesce(sum(size), 0)::BIGINT AS n_documents, round(100 * coalesce(sum(size), 0) / (SELECT count(*) FROM documents), 3) AS pct_of_corpus FROM s LEFT JOIN sizes USING (cluster), tiers WHERE best_q >= threshold GROUP BY 1, 2""")
def scoped_purge(spark, t):
    return C.scoped_purge(t("documents"), clusters(t), "source", "best_q", F.col("query") % 2 == 0, TIERS)


@query("SELECT source, count(*) AS n, sum((toxic = 1)::INT)::BIGINT AS dropped, round(100 * sum((toxic = 1)::INT) / count(*), 3) AS pct, (count(*) - sum((toxic = 1)::INT))::BIGINT AS surviving FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def purge_cost(spark, t):
    return C.purge_cost(t("labels").join(t("documents").select("doc_id", "source"), "doc_id"), F.col("toxic") == 1, ["source"])


PARTS = "p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 10 <> 0 THEN p_size / 50 END AS v, p_size / 40 AS w, p_partkey % 3 <> 0 AS old, p_size % 2 = 0 AS d FROM part)"


def parts(t):
    return t("part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 50).alias("v"), (F.col("p_size") / 40).alias("w"), (F.col("p_partkey") % 3 != 0).alias("old"), (F.col("p_size") % 2 == 0).alias("d"))


def _headline_sql() -> str:
    one = lambda name, cond: ", ".join([
        f"count(*) FILTER (WHERE {cond}) AS {name}_n", f"count(*) FILTER (WHERE {cond} AND ok) AS {name}_survive", f"count(*) FILTER (WHERE {cond} AND ok AND NOT d) AS {name}_natural",
        f"count(*) FILTER (WHERE {cond} AND ok AND d) AS {name}_designed", f"count(*) FILTER (WHERE {cond} AND free) AS {name}_survive_loose"])
    return f"""WITH {PARTS}, x AS (SELECT threshold, old, d, v IS NULL OR v < threshold AS ok, w IS NULL OR w < threshold AS free FROM p, (SELECT unnest([0.3, 0.5, 0.9]::DOUBLE[]) AS threshold)),
g AS (SELECT threshold, {one('old', 'old')}, {one('all', 'true')} FROM x GROUP BY 1) SELECT *, all_survive - old_survive AS gain_survive, all_natural - old_natural AS gain_natural, round(100 * (all_natural - old_natural) / old_natural, 1) AS gain_natural_pct FROM g"""


@query(_headline_sql())
def survival_headline(spark, t):
    return C.survival_headline(parts(t), "v", "w", F.col("old"), F.col("d"), [0.3, 0.5, 0.9])


@query(f"""WITH {PARTS} SELECT p_partkey, p_brand, d, (v IS NULL OR v < 0.2)::INT AS "passes_20", (v IS NULL OR v < 0.3)::INT AS "passes_30", (w < 0.5)::INT AS passes_loose FROM p WHERE v IS NULL OR v <= 0.5""")
def filtered_set(spark, t):
    return C.filtered_set(parts(t), "v", "w", 0.5, [0.2, 0.3], keep_boundary=True).select("p_partkey", "p_brand", "d", "passes_20", "passes_30", "passes_loose")


@query(f"""WITH {PARTS} SELECT CASE WHEN grouping(p_brand) = 1 THEN 'ALL' ELSE p_brand END AS "group", count(*) AS n, sum((NOT d)::INT)::BIGINT AS n_natural, sum((v IS NULL OR v < 0.2)::INT)::BIGINT AS passes_20, sum((w < 0.5)::INT)::BIGINT AS passes_loose FROM p WHERE v IS NULL OR v < 0.5 GROUP BY ROLLUP (p_brand)""")
def filtered_set_summary(spark, t):
    return C.set_summary(C.filtered_set(parts(t), "v", "w", 0.5, [0.2]), "p_brand", F.col("d"), ["passes_20", "passes_loose"])


@query("""WITH d AS (SELECT *, n_chars > 2000 AS long, CASE WHEN n_chars > 2000 THEN n_chars ELSE 0 END AS lc, [doc_id % 7 - 1, doc_id % 5 - 1] AS ids FROM documents)
SELECT lang, count(*) AS documents, count(DISTINCT source) AS distinct_source, count(DISTINCT md5(text)) AS distinct_h, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5)::DOUBLE AS median, max(n_chars) AS max, round(coalesce(sum(lc) / nullif(sum(n_chars), 0), 0), 9) AS fraction, round(avg(long::INT), 9) AS share_long,
(SELECT count(DISTINCT x) FROM (SELECT unnest(ids) AS x, lang AS l FROM d) e WHERE x >= 0 AND e.l IS NOT DISTINCT FROM d.lang) AS distinct_ids FROM d GROUP BY lang""")
def corpus_profile(spark, t):
    d = t("documents").select("lang", "source", F.md5("text").alias("h"), "n_chars", (F.col("n_chars") > 2000).alias("long"), F.when(F.col("n_chars") > 2000, F.col("n_chars")).otherwise(0).alias("lc"), F.array(F.col("doc_id") % 7 - 1, F.col("doc_id") % 5 - 1).alias("ids"))
    out = C.corpus_profile(d, "lang", "n_chars", "lc", "n_chars", ["source", "h"], "long", "ids")
    return out.withColumns({"mean": F.round("mean", 6), "fraction": F.round("fraction", 9), "share_long": F.round("share_long", 9)})


@query("SELECT doc_id, CASE WHEN lang = 'es' THEN 'denovo' WHEN doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) THEN 'val' ELSE 'test' END AS eval_set FROM documents")
def evaluation_sets(spark, t):
    return C.assign_sets(t("documents").select("doc_id", "lang"), ["doc_id"], F.col("lang") == "es", 100).drop("lang")


@query("""WITH h AS (SELECT l_suppkey AS query, l_partkey AS target, round(l_discount * 10 - 0.1 * (l_partkey % 4), 6)::DOUBLE AS score, l_quantity AS fident FROM lineitem), m AS (SELECT p_partkey AS target, CASE WHEN p_partkey % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM part WHERE p_size < 45),
j AS (SELECT h.*, split FROM h LEFT JOIN m USING (target)), n AS (SELECT query, count(*) FILTER (WHERE score >= 0.5) AS n_hits, count(*) FILTER (WHERE score >= 0.5 AND split = 'train') AS n_train_hits, count(*) FILTER (WHERE split IS NULL) AS n_unmatched FROM j GROUP BY 1),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target, fident) AS r FROM j) WHERE r = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target, fident) AS r FROM j WHERE split = 'train') WHERE r = 1)
SELECT c_custkey AS query, a.target AS best_target, a.split AS best_split, a.score AS best_score, b.target AS best_train_target, b.score AS best_train_score, b.fident AS best_train_fident, coalesce(n_hits, 0) AS n_hits, coalesce(n_train_hits, 0) AS n_train_hits, coalesce(n_unmatched, 0) AS n_unmatched,
CASE WHEN b.score >= 0.9 THEN 'redundant' WHEN b.score >= 0.5 THEN 'same_fold' ELSE 'novel_fold' END AS verdict FROM customer LEFT JOIN n ON n.query = c_custkey LEFT JOIN a ON a.query = c_custkey LEFT JOIN b ON b.query = c_custkey""")
def verdict_rows(spark, t):
    h = t("lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("target"), F.round(F.col("l_discount") * 10 - 0.1 * (F.col("l_partkey") % 4), 6).alias("score"), F.col("l_quantity").alias("fident"))
    m = t("part").where("p_size < 45").select(F.col("p_partkey").alias("target"), F.when(F.col("p_partkey") % 3 == 0, "val").otherwise("train").alias("split"))
    return C.verdict_rows(t("customer").select(F.col("c_custkey").alias("query")), h, m, "score")


@query("""SELECT 'r1' AS run, c_custkey, c_nationkey, n, best, n_events FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY 1) USING (c_custkey) LEFT JOIN (SELECT user_id AS c_custkey, count(*) AS n_events FROM events GROUP BY 1) USING (c_custkey)""")
def consolidated_targets(spark, t):
    best = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"), F.lit(-1).alias("c_nationkey"))
    acc = t("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"), F.lit(0).alias("n"))
    return C.consolidate(t("customer").select("c_custkey", "c_nationkey"), "c_custkey", [best, acc], "r1")


@query("""SELECT c_custkey, round(log10(1 + n), 9) AS log_n, round(-log10(greatest(e, 1e-300)), 9) AS log_e, k AS events FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, min(o_totalprice) / 1e9 AS e FROM orders GROUP BY 1) USING (c_custkey) LEFT JOIN (SELECT user_id AS c_custkey, min(value) AS k FROM events GROUP BY 1) USING (c_custkey)""")
def support_features(spark, t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), (F.min("o_totalprice") / 1e9).alias("e"))
    e = t("events").where("value is not null").select(F.col("user_id").alias("c_custkey"), "value")
    out = C.lookup_features(t("customer").select("c_custkey"), "c_custkey", [(o, [("log_n", C.log_count(F.col("n"))), ("log_e", C.log_evalue(F.col("e")))]), (e, [("events", F.col("value"))])])
    return out.withColumns({"log_n": F.round("log_n", 9), "log_e": F.round("log_e", 9)})


@query("""WITH c AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 2500), g AS (SELECT source, count(*) AS n, min(lang) AS one FROM c GROUP BY 1)
SELECT w.source, CASE WHEN n = 1 THEN one WHEN c.lang IS NOT NULL THEN c.lang END AS chain, CASE WHEN n = 1 THEN 'single' WHEN c.lang IS NOT NULL THEN 'by_name' ELSE 'missing' END AS mode FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) w LEFT JOIN g USING (source) LEFT JOIN c ON c.source = w.source AND c.lang = 'de'""")
def reference_chains(spark, t):
    c = t("documents").where("n_chars > 2500").select("source", F.col("lang").alias("chain")).distinct()
    w = t("documents").where("source is not null").select("source", F.lit("de").alias("wanted")).distinct()
    return C.resolve_reference(c, w, "source")


@query("""SELECT o_orderkey, round(o_totalprice * CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN 0.5 ELSE 2.0 END, 4) AS o_totalprice, o_totalprice AS o_totalprice_raw, o_orderstatus FROM orders""")
def rescaled_values(spark, t):
    return C.rescaled(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice", "o_orderstatus", {"F": 0.5, "P": 2.0}, "O").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("""WITH e AS (SELECT event_id, ['<contact>', '<p' || event_id % 20 || '>', '<p' || event_id % 13 || '>', 'x', '<contact>', '<p7>', '<contact>', '<p' || event_id % 13 || '>', '<p' || event_id % 20 || '>', '<contact>', '<p1>', '<p' || (event_id % 30) || '>'] AS w FROM events),
k AS (SELECT event_id, k - 1 AS k, try_cast(regexp_extract(w[k+1], '^<p([0-9]+)>$', 1) AS INT) AS a, try_cast(regexp_extract(w[k+2], '^<p([0-9]+)>$', 1) AS INT) AS b FROM (SELECT event_id, w, unnest(range(1, 11)) AS k FROM e) WHERE w[k] = '<contact>')
SELECT event_id, i, j, k::INT AS k FROM (SELECT event_id, least(a, b) AS i, greatest(a, b) AS j, k, row_number() OVER (PARTITION BY event_id, least(a, b), greatest(a, b) ORDER BY k) AS r FROM k WHERE a IS NOT NULL AND b IS NOT NULL AND abs(a - b) >= 6) WHERE r = 1""")
def ordered_contacts(spark, t):
    p = lambda x: F.concat(F.lit("<p"), x.cast("string"), F.lit(">"))
    e, c = F.col("event_id"), F.lit("<contact>")
    tokens = F.array(c, p(e % 20), p(e % 13), F.lit("x"), c, F.lit("<p7>"), c, p(e % 13), p(e % 20), c, F.lit("<p1>"), p(e % 30))
    return t("events").select("event_id", tokens.alias("w")).select("event_id", F.explode(C.ordered_contacts(F.col("w"))).alias("r")).select("event_id", "r.*")


@query("""WITH r AS (SELECT o_orderpriority AS label, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1) SELECT *, 'primary' AS choice FROM r WHERE label = '3-MEDIUM' UNION ALL (SELECT *, 'best' FROM r ORDER BY score DESC, label LIMIT 1)""")
def rule_choice(spark, t):
    r = t("orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"))
    return C.pick_rules(r, "label", "score", "3-MEDIUM")


@query("SELECT doc_id, lang FROM documents LIMIT 7")
def take_per_file(spark, t):
    """The first seven rows of each file of documents (the limit is the operator)."""
    return C.take_per_file(t("documents"), 7).select("doc_id", "lang")


@query("SELECT 'documents.parquet' AS file, min(doc_id) AS low, max(doc_id) AS high FROM documents")
def first_file_with(spark, t):
    d = t("documents")
    return C.first_file_with(d, "doc_id", 0)
