"""Queries of nearest neighbours, votes, rankings and their metrics, over the embeddings and the star schema.

Neighbours come from a stated question set: vectors whose id is divisible by 50, against all vectors.
"""

from pyspark.sql import functions as F

from sedimark.functions import scalars as S
from sedimark.operators import evaluation as V
from sedimark.operators import similarity as N
from sedimark.operators import windows as W
from sedimark.plans.registry import query

DOT = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
NEAR = f"""near AS (SELECT query, vec_id, rank, score FROM (SELECT a.vec_id AS query, b.vec_id AS vec_id, {DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10)"""


def neighbours(spark, t, k=10):
    """The k nearest of a stated question set against all vectors."""
    vectors = t("embeddings").select("vec_id", F.col("embedding").alias("v"))
    return N.nearest(vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q")), vectors, k)


@query(f"""WITH {NEAR}, h AS (SELECT query, vec_id, score FROM near WHERE score >= 0.3) SELECT e.vec_id AS query, count(h.vec_id) AS n_hits, arg_min(h.vec_id, (-h.score, h.vec_id)) AS best, round(max(h.score), 3) AS score, coalesce((count(h.vec_id) >= 10)::INT, 0) AS censored FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) e LEFT JOIN h ON h.query = e.vec_id GROUP BY 1""")
def structural_hits(spark, t):
    """Similarity search of a question set with a floor on the score: one row per question, hit-less ones too."""
    h = neighbours(spark, t).where("score >= 0.3")
    g = h.groupBy("query").agg(F.count("*").alias("n_hits"), F.min_by("vec_id", "rank").alias("best"), F.round(F.max("score"), 3).alias("score"))
    q = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"))
    return q.join(g, "query", "left").fillna(0, ["n_hits"]).withColumn("censored", (F.col("n_hits") >= 10).cast("int"))


@query(f"WITH {NEAR} SELECT query, vec_id, rank, round(score, 3) AS score FROM near")
def knn_topk(spark, t):
    return neighbours(spark, t).select("query", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 3).alias("score"))


@query(f"""WITH {NEAR}, v AS (SELECT query, k, label, count(*) AS votes, sum(score) AS weight FROM near JOIN embeddings USING (vec_id), (SELECT unnest([3, 10]) AS k) WHERE rank <= k GROUP BY ALL)
SELECT query, k, label, votes, round(weight, 4) AS weight FROM v""")
def knn_votes(spark, t):
    return N.neighbour_votes(neighbours(spark, t), t("embeddings").select("vec_id", "label"), [3, 10]).withColumn("weight", F.round("weight", 4))


@query(f"""WITH {NEAR}, v AS (SELECT query, k, label, count(*) AS votes, round(sum(score), 6) AS weight FROM near JOIN embeddings USING (vec_id), (SELECT unnest([3, 10]) AS k) WHERE rank <= k GROUP BY ALL)
SELECT query, k, label FROM (SELECT *, row_number() OVER (PARTITION BY query, k ORDER BY votes DESC, weight DESC, label) AS r FROM v) WHERE r = 1""")
def knn_vote_label(spark, t):
    votes = N.neighbour_votes(neighbours(spark, t), t("embeddings").select("vec_id", "label"), [3, 10]).withColumn("weight", F.round("weight", 6))
    return N.winning_label(votes).select("query", "k", "label")


@query(f"""WITH {NEAR}, s AS (SELECT n.query, n.rank, q.label = c.label AS hit FROM near n JOIN embeddings q ON q.vec_id = n.query JOIN embeddings c ON c.vec_id = n.vec_id)
SELECT query, round(avg(hit::INT) FILTER (WHERE rank <= 10), 9) AS "p_L", round(avg(hit::INT) FILTER (WHERE rank <= 5), 9) AS "p_L_2", round(avg(hit::INT) FILTER (WHERE rank <= 2), 9) AS "p_L_5", coalesce(round(avg(hit::INT) FILTER (WHERE rank <= r), 9), 'NaN'::DOUBLE) AS "p_R", count(*) AS n_candidates, max(r)::BIGINT AS n_true
FROM (SELECT *, sum(hit::INT) OVER (PARTITION BY query) AS r FROM s) GROUP BY query""")
def topk_precision(spark, t):
    lab = t("embeddings").select("vec_id", "label")
    n = neighbours(spark, t).join(lab.withColumnRenamed("label", "found"), "vec_id").join(lab.select(F.col("vec_id").alias("query"), "label"), "query")
    out = W.top_precision(n.withColumn("hit", F.col("found") == F.col("label")).withColumn("size", F.lit(10)), ["query"], "score", ["vec_id"], "hit", "size")
    return out.select("query", *[F.round(c, 9).alias(c) for c in ("p_L", "p_L_2", "p_L_5", "p_R")], "n_candidates", "n_true")


@query(f"""WITH {NEAR}, b AS (SELECT e.vec_id, max(score) AS best FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) e LEFT JOIN near ON query = e.vec_id GROUP BY 1)
SELECT vec_id, CASE WHEN best >= 0.9 THEN 'redundant' WHEN best >= 0.3 THEN 'same_fold' ELSE 'novel' END AS verdict, CASE WHEN best IS NULL THEN 'no_homolog' WHEN best < 0.2 THEN 'remote' WHEN best < 0.3 THEN 'id_20_30' WHEN best < 0.5 THEN 'id_30_50' WHEN best < 0.7 THEN 'id_50_70' ELSE 'id_ge_70' END AS stratum FROM b""")
def novelty_strata(spark, t):
    best = neighbours(spark, t).groupBy(F.col("query").alias("vec_id")).agg(F.max("score").alias("best"), F.count("*").alias("n"))
    q = t("embeddings").where("vec_id % 50 = 0").select("vec_id").join(best, "vec_id", "left")
    return q.select("vec_id", S.similarity_verdict(F.col("best"), 0.3, 0.9).alias("verdict"), S.novelty_stratum(F.col("n"), F.col("best")).alias("stratum"))


#: Lines stand for ballots: an order's parts and suppliers are the voters and the pairs they name.
BALLOTS = """u AS (SELECT n_nationkey AS entity, i, i + d AS j FROM nation, (SELECT unnest(range(0, 60)) AS i), (SELECT unnest(range(1, 60)) AS d) WHERE i + d < 60),
b AS (SELECT DISTINCT s_nationkey AS entity, (l_linenumber % 4)::INT AS voter, least(l_partkey % 60, l_orderkey % 60)::INT AS i, greatest(l_partkey % 60, l_orderkey % 60)::INT AS j FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 60 <> l_orderkey % 60),
t AS (SELECT DISTINCT c_nationkey AS entity, (c_custkey % 59)::INT AS i, (c_custkey % 59 + 1)::INT AS j FROM customer WHERE c_mktsegment = 'BUILDING')"""


def ballots(t):
    universe = V.candidate_universe(t("nation").select(F.col("n_nationkey").alias("entity"), F.lit(60).alias("length")), 1)
    x, y = F.col("l_partkey") % 60, F.col("l_orderkey") % 60
    b = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where(x != y)
    b = b.select(F.col("s_nationkey").alias("entity"), (F.col("l_linenumber") % 4).alias("voter"), F.least(x, y).cast("int").alias("i"), F.greatest(x, y).cast("int").alias("j")).distinct()
    truth = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("entity"), (F.col("c_custkey") % 59).cast("int").alias("i"), (F.col("c_custkey") % 59 + 1).cast("int").alias("j")).distinct()
    return universe, b, truth


RPREC = "coalesce(sum((rk <= n AND t)::INT) / nullif(sum((rk <= n)::INT), 0), 'NaN'::DOUBLE)"


@query(f"""WITH {BALLOTS}, v AS (SELECT entity, i, j, count(*) AS votes FROM b GROUP BY ALL), n AS (SELECT entity, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT u.entity, coalesce(n.n, 0) AS n, t.entity IS NOT NULL AS t, row_number() OVER (PARTITION BY u.entity ORDER BY coalesce(votes, 0) DESC, u.i, u.j) AS rk FROM u LEFT JOIN v USING (entity, i, j) LEFT JOIN t USING (entity, i, j) LEFT JOIN n ON n.entity = u.entity)
SELECT entity, n AS n_true, round({RPREC}, 9) AS r_precision FROM k GROUP BY 1, 2""")
def r_precision(spark, t):
    universe, b, truth = ballots(t)
    votes = b.groupBy("entity", "i", "j").agg(F.count("*").alias("votes"))
    return V.r_precision(V.vote_ranking(universe, votes), truth).withColumn("r_precision", F.round("r_precision", 9))


@query(f"""WITH {BALLOTS}, n AS (SELECT entity, count(*) AS n FROM t GROUP BY 1), w AS (SELECT DISTINCT entity, voter FROM b),
one AS (SELECT w.entity, w.voter, u.i, u.j, count(b.voter) AS votes FROM w JOIN u ON u.entity = w.entity LEFT JOIN b ON b.entity = u.entity AND b.i = u.i AND b.j = u.j AND b.voter <> w.voter GROUP BY ALL),
al AS (SELECT u.entity, u.i, u.j, count(b.voter) AS votes FROM u LEFT JOIN b USING (entity, i, j) GROUP BY ALL),
ro AS (SELECT entity, voter, {RPREC} AS r FROM (SELECT o.entity, voter, coalesce(n.n, 0) AS n, t.entity IS NOT NULL AS t, row_number() OVER (PARTITION BY o.entity, voter ORDER BY votes DESC, o.i, o.j) AS rk FROM one o LEFT JOIN t USING (entity, i, j) LEFT JOIN n ON n.entity = o.entity) GROUP BY 1, 2),
ra AS (SELECT entity, {RPREC} AS r FROM (SELECT o.entity, coalesce(n.n, 0) AS n, t.entity IS NOT NULL AS t, row_number() OVER (PARTITION BY o.entity ORDER BY votes DESC, o.i, o.j) AS rk FROM al o LEFT JOIN t USING (entity, i, j) LEFT JOIN n ON n.entity = o.entity) GROUP BY 1)
SELECT ro.entity, voter, round(ra.r - ro.r, 9) + 0 AS marginal FROM ro JOIN ra USING (entity)""")
def leave_one_out_marginals(spark, t):
    return V.loo_marginals(*ballots(t)).withColumn("marginal", F.round("marginal", 9) + 0)


@query(f"""WITH {BALLOTS}, v AS (SELECT entity, i, j, count(*) AS v FROM b GROUP BY ALL), s AS (SELECT entity, voter, count(*) AS n FROM b GROUP BY ALL),
e AS (SELECT entity, count(*) AS union_size, round(-sum(p * ln(p)), 6) AS vote_entropy FROM (SELECT *, v / sum(v) OVER (PARTITION BY entity) AS p FROM v) GROUP BY 1),
pr AS (SELECT x.entity, x.voter AS va, y.voter AS vb, x.n AS na, y.n AS nb FROM s x JOIN s y ON x.entity = y.entity AND x.voter < y.voter),
c AS (SELECT x.entity, x.voter AS va, y.voter AS vb, count(*) AS c FROM b x JOIN b y ON x.entity = y.entity AND x.i = y.i AND x.j = y.j AND x.voter < y.voter GROUP BY ALL),
jc AS (SELECT entity, round(avg(coalesce(c, 0) / (na + nb - coalesce(c, 0))), 6) AS mean_jaccard FROM pr LEFT JOIN c USING (entity, va, vb) GROUP BY 1)
SELECT q.entity, n_voters, union_size, vote_entropy, mean_jaccard FROM (SELECT entity, count(*) AS n_voters FROM s GROUP BY 1) q JOIN e USING (entity) LEFT JOIN jc USING (entity)""")
def group_diagnostics(spark, t):
    _, b, _ = ballots(t)
    return V.group_diagnostics(b).withColumns({c: F.round(c, 6) for c in ("vote_entropy", "mean_jaccard")}).select("entity", "n_voters", "union_size", "vote_entropy", "mean_jaccard")


@query("""WITH k AS (SELECT l_returnflag, l_quantity, l_extendedprice, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(l_extendedprice) FILTER (WHERE r <= greatest(1, n // 100)) AS best_1pct, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS oracle FROM k GROUP BY 1""")
def likelihood_selection(spark, t):
    d = t("lineitem").withColumn("tie", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return V.likelihood_selection(d, "l_returnflag", "l_quantity", "l_extendedprice", "tie").select("l_returnflag", "best_1pct", F.round("mean", 4).alias("mean"), "oracle")


@query("""WITH q AS (SELECT l_returnflag, l_quantity AS x, l_discount * l_quantity / l_quantity AS q FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(q), 8) AS mean, round(quantile_cont(q, 0.1), 8) AS p10, round(quantile_cont(q, 0.5), 8) AS p50, round(quantile_cont(q, 0.9), 8) AS p90, round(avg((q < 0.05)::INT), 8) AS low_share, round(corr(x, q), 6) AS corr, round(regr_slope(q, x), 8) AS slope FROM q GROUP BY 1""")
def short_document_bias(spark, t):
    d = t("lineitem").withColumn("y", F.col("l_discount") * F.col("l_quantity")).withColumn("q", F.col("y") / F.col("l_quantity"))
    out = V.ratio_bias(d, ["l_returnflag"], "l_quantity", "y").join(d.groupBy("l_returnflag").agg(F.avg((F.col("q") < 0.05).cast("double")).alias("low_share")), "l_returnflag")
    return out.select("l_returnflag", "n", *[F.round(c, 8).alias(c) for c in ("mean", "p10", "p50", "p90", "low_share")], F.round("corr", 6).alias("corr"), F.round("slope", 8).alias("slope"))


@query("SELECT s_nationkey, round(sum(l_quantity) / sum(l_tax + 0.01), 6) AS rate, round(1000 / (sum(l_quantity) / sum(l_tax + 0.01)), 6) AS projected_seconds FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def throughput_projection(spark, t):
    d = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("sec", F.col("l_tax") + 0.01)
    return V.throughput(d, ["s_nationkey"], "l_quantity", "sec", 1000.0).select("s_nationkey", F.round("rate", 6).alias("rate"), F.round("projected_seconds", 6).alias("projected_seconds"))


@query("""WITH g AS (SELECT p_brand, avg(p_retailprice) AS m, count(DISTINCT p_type) AS n FROM part GROUP BY 1) SELECT p_brand, round(m, 6) AS mean, n, rank() OVER (ORDER BY m DESC) AS place FROM g WHERE n = (SELECT count(DISTINCT p_type) FROM part)""")
def leaderboard(spark, t):
    n = t("part").agg(F.count_distinct("p_type")).first()[0]
    return V.leaderboard(t("part"), "p_brand", "p_type", "p_retailprice", n).select("p_brand", F.round("mean", 6).alias("mean"), "n", F.col("place").cast("long").alias("place"))


@query("SELECT least(p_size, 5) AS depth, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1 HAVING count(*) >= 20")
def depth_breakdown(spark, t):
    return V.depth_breakdown(t("part"), "p_size", "p_retailprice").withColumn("mean", F.round("mean", 6))


@query("""WITH f AS (SELECT source, coalesce(quality = 0, false) AS old, coalesce(toxic = 1, false) AS new FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS n, sum((old <> new)::INT)::BIGINT AS changed, sum((NOT old AND new)::INT)::BIGINT AS gained, sum((old AND NOT new)::INT)::BIGINT AS lost FROM f GROUP BY ROLLUP (source)""")
def label_audit(spark, t):
    d = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").select("source", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("old"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("new"))
    return V.label_audit(d, "old", "new", "source")


@query("""SELECT c."class", count(d.doc_id) AS n, round(count(d.doc_id) / sum(count(d.doc_id)) OVER (), 9) AS share FROM (SELECT unnest(['tiny', 'toxic', 'none', 'rest']) AS "class") c LEFT JOIN (SELECT doc_id, CASE WHEN n_chars < 100 THEN 'tiny' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 0 THEN 'none' ELSE 'rest' END AS "class" FROM documents LEFT JOIN labels USING (doc_id)) d USING ("class") GROUP BY 1""")
def mechanism_ladder(spark, t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    out = V.mechanism(d, [("tiny", F.col("n_chars") < 100), ("toxic", F.coalesce(F.col("toxic") == 1, F.lit(False))), ("none", F.col("n_chars") < 0)], "rest")
    return out.withColumn("share", F.round("share", 9))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS entity, l_linenumber AS i, (l_linenumber + l_partkey % 40)::BIGINT AS j FROM lineitem), g AS (SELECT entity, count(*) AS n, avg(j - i) AS m, avg((j - i < 12)::INT) AS s, avg((j - i BETWEEN 12 AND 23)::INT) AS d, avg((j - i >= 24)::INT) AS l, quantile_cont(j - i, 0.5) AS q FROM c GROUP BY 1)
SELECT o_orderkey AS entity, coalesce(n, 0) AS n, coalesce(round(m / 50, 9), 'NaN'::DOUBLE) AS relative_order, coalesce(round(s, 9), 'NaN'::DOUBLE) AS short, coalesce(round(d, 9), 'NaN'::DOUBLE) AS medium, coalesce(round(l, 9), 'NaN'::DOUBLE) AS long, coalesce(q, 'NaN'::DOUBLE) AS median_gap FROM orders LEFT JOIN g ON entity = o_orderkey""")
def contact_features(spark, t):
    c = t("lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("i"), (F.col("l_linenumber") + F.col("l_partkey") % 40).alias("j")).distinct()
    out = V.contact_features(c, t("orders").select(F.col("o_orderkey").alias("entity"), F.lit(50).alias("length")))
    return out.select("entity", "n", *[F.round(x, 9).alias(x) for x in ("relative_order", "short", "medium", "long")], "median_gap")


@query(f"""WITH {BALLOTS}, c AS (SELECT entity, i, j, count(*) AS votes, sum(voter)::DOUBLE AS w FROM b GROUP BY ALL) SELECT entity, i, j, round(votes + coalesce((w - min(w) OVER x) / nullif(max(w) OVER x - min(w) OVER x, 0), 0) * 0.5, 9) AS score FROM c WINDOW x AS (PARTITION BY entity)""")
def tie_broken_votes(spark, t):
    _, b, _ = ballots(t)
    c = b.groupBy("entity", "i", "j").agg(F.count("*").alias("votes"), F.sum("voter").cast("double").alias("w"))
    return N.tie_broken(c, ["entity"], "votes", "w").select("entity", "i", "j", F.round("score", 9).alias("score"))


@query(f"""WITH {BALLOTS}, p AS (SELECT DISTINCT entity, i, j FROM b), f AS (SELECT coalesce(p.entity, t.entity) AS entity, coalesce(p.j - p.i, t.j - t.i) AS gap, p.entity IS NOT NULL AS p, t.entity IS NOT NULL AS t FROM p FULL JOIN t ON p.entity = t.entity AND p.i = t.i AND p.j = t.j),
g AS (SELECT entity, band, sum((p AND gap >= lo AND (hi IS NULL OR gap < hi))::INT) AS np, sum((t AND gap >= lo AND (hi IS NULL OR gap < hi))::INT) AS nt, sum((p AND t AND gap >= lo AND (hi IS NULL OR gap < hi))::INT) AS hit FROM f, (VALUES ('near', 1, 3), ('far', 3, NULL)) AS bands(band, lo, hi) GROUP BY 1, 2)
SELECT entity, band, CASE WHEN nt = 0 THEN 'NaN'::DOUBLE WHEN np = 0 THEN 0 ELSE round(hit / np, 9) END AS "precision", CASE WHEN nt = 0 THEN 'NaN'::DOUBLE ELSE round(hit / nt, 9) END AS recall, CASE WHEN nt = 0 THEN 'NaN'::DOUBLE ELSE round(2 * hit / (np + nt), 9) END AS f1 FROM g""")
def band_scores(spark, t):
    _, b, truth = ballots(t)
    out = V.band_scores(b, truth, [("near", 1, 3), ("far", 3, None)])
    return out.select("entity", "band", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])
