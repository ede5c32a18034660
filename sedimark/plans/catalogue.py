"""Queries of the smaller operators: set scores, contracts of joins and sets, ranks, documents, draws and window frames."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedimark.functions import scalars as S
from sedimark.operators import aggregates as A
from sedimark.operators import builders as B
from sedimark.operators import codecs as D
from sedimark.operators import evaluation as V
from sedimark.operators import filters as P
from sedimark.operators import joins as J
from sedimark.operators import sampling as R
from sedimark.operators import setops as U
from sedimark.operators import similarity as N
from sedimark.operators import stats as T
from sedimark.operators import windows as W
from sedimark.plans.registry import query
from sedimark.plans.rewards import _poisson_sql


@query("""WITH e AS (SELECT event_id, [event_id % 5, event_id % 7, 3] AS p, CASE WHEN event_id % 11 = 0 THEN [] ELSE [event_id % 3, 3, 4] END AS t FROM events), d AS (SELECT event_id, len(list_distinct(p)) AS np, len(list_distinct(t)) AS nt, len(list_intersect(p, t)) AS h FROM e)
SELECT event_id, CASE WHEN nt = 0 THEN 'NaN'::DOUBLE ELSE round(h / np, 9) END AS "precision", CASE WHEN nt = 0 THEN 'NaN'::DOUBLE ELSE round(h / nt, 9) END AS recall, CASE WHEN nt = 0 THEN 'NaN'::DOUBLE ELSE round(2 * h / (np + nt), 9) END AS f1, round(h / (np + nt - h), 9) AS jaccard FROM d""")
def set_scores(spark, t):
    e = F.col("event_id")
    p, none = F.array(e % 5, e % 7, F.lit(3).cast("long")), F.array().cast("array<bigint>")
    true = F.when(e % 11 == 0, none).otherwise(F.array(e % 3, F.lit(3).cast("long"), F.lit(4).cast("long")))
    d = t("events").select("event_id", A.set_scores(p, true).alias("s"), S.jaccard(p, true).alias("jaccard"))
    return d.select("event_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("precision", "recall", "f1")], F.round("jaccard", 9).alias("jaccard"))


@query("""WITH r AS (SELECT o_custkey, (o_orderstatus = 'F')::INT AS hit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey) AS n FROM orders),
f AS (SELECT o_custkey, k, 2.0 * sum(hit) OVER (PARTITION BY o_custkey ORDER BY k) / (k + n) AS f FROM r) SELECT o_custkey, round(max(f), 9) AS best_f1, arg_min(k, (-f, k)) AS best_k FROM f GROUP BY 1""")
def best_prefix_f1(spark, t):
    d = t("orders").withColumn("hit", F.col("o_orderstatus") == "F")
    return A.best_prefix_f1(d, ["o_custkey"], "o_totalprice", "o_orderkey", "hit").select("o_custkey", F.round("best_f1", 9).alias("best_f1"), F.col("best_k").cast("long").alias("best_k"))


@query("SELECT l_suppkey, round(sum(1 / n), 6) AS neff FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def effective_count(spark, t):
    return A.effective_count(t("lineitem"), ["l_suppkey"], "l_partkey").withColumn("neff", F.round("neff", 6))


@query("SELECT b AS bin, count(e) AS n FROM (SELECT unnest(range(0, 9)) AS b) LEFT JOIN (SELECT unnest([event_id % 7, event_id % 5, 1]) AS e FROM events) ON e = b GROUP BY 1")
def token_bincount(spark, t):
    e = F.col("event_id")
    return A.bincount(t("events").select(F.array(e % 7, e % 5, F.lit(1).cast("long")).alias("ids")), "ids", 9)


@query("SELECT event_type, arg_max(event_id, (value, -event_id)) AS most, arg_min(event_id, (value, event_id)) AS least FROM events GROUP BY 1")
def extreme_rows(spark, t):
    d = t("events").select("event_type", "event_id", "value")
    top = W.keep_one(d, ["event_type"], [F.desc("value"), "event_id"]).select("event_type", F.col("event_id").alias("most"))
    return top.join(W.keep_one(d, ["event_type"], ["value", "event_id"]).select("event_type", F.col("event_id").alias("least")), "event_type")


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS y,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS z FROM lineitem), c AS (SELECT l_returnflag, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY 1)
SELECT l_returnflag, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 7) AS rho FROM c""")
def partial_spearman(spark, t):
    return T.partial_spearman(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", ["l_discount"]).withColumn("rho", F.round("rho", 7))


@query("""WITH d AS (SELECT o_orderpriority, o_totalprice - 250000 - o_orderkey % 100 * 1000 AS d FROM orders), r AS (SELECT o_orderpriority, d, rank() OVER (PARTITION BY o_orderpriority ORDER BY abs(d)) + (count(*) OVER (PARTITION BY o_orderpriority, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0)
SELECT o_orderpriority, count(*) AS n, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)) AS w FROM r GROUP BY 1""")
def wilcoxon(spark, t):
    d = t("orders").withColumn("base", 250000.0 + F.col("o_orderkey") % 100 * 1000)
    return T.wilcoxon(d, ["o_orderpriority"], "o_totalprice", "base").select("o_orderpriority", "n", "w")


@query("""WITH f AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1), x AS (SELECT event_type, round(v) AS v FROM f UNION ALL SELECT 'absent', 1.0) SELECT x.event_type, x.v AS expected, round(f.v, 6) AS found FROM x LEFT JOIN f USING (event_type) WHERE f.v IS NULL OR abs(f.v - x.v) > 0.2""")
def parity_report(spark, t):
    f = t("events").groupBy("event_type").agg(F.avg("value").alias("v"))
    x = f.withColumn("v", F.round("v")).unionByName(spark.createDataFrame([("absent", 1.0)], "event_type string, v double"))
    return T.parity(f, x, ["event_type"], "v", 0.2).withColumn("found", F.round("found", 6))


@query("""SELECT p_brand, p_partkey, round(0.3 * (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2) + 0.7 * (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2), 6) AS ensemble FROM part""")
def rank_ensemble(spark, t):
    return T.rank_ensemble(t("part"), ["p_brand"], "p_size", "p_retailprice", 0.3).select("p_brand", "p_partkey", F.round("ensemble", 6).alias("ensemble"))


@query("""WITH c AS (SELECT l_suppkey AS entity, l_linenumber AS pos, l_returnflag AS aa, max(l_discount) AS logp FROM lineitem GROUP BY ALL), w AS (SELECT entity, pos, min(aa) AS wild FROM c GROUP BY ALL)
SELECT c.entity, c.pos, c.aa, round(c.logp - b.logp, 6) + 0 AS log_ratio FROM c JOIN w USING (entity, pos) JOIN c b ON b.entity = c.entity AND b.pos = c.pos AND b.aa = w.wild""")
def substitution_scores(spark, t):
    c = t("lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("aa")).agg(F.max("l_discount").alias("logp"))
    w = c.groupBy("entity", "pos").agg(F.min("aa").alias("wild"))
    return T.substitution_scores(c, w).withColumn("log_ratio", F.round("log_ratio", 6) + 0)


@query("SELECT source, round(avg(n_chars) FILTER (WHERE doc_id % 10 >= 5), 6) AS mean FROM documents GROUP BY 1")
def conditional_mean(spark, t):
    return T.conditional_mean(t("documents").withColumn("context", F.col("doc_id") % 10), ["source"], "n_chars", "context", 5).withColumn("mean", F.round("mean", 6))


@query("""SELECT 'customer' AS origin, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def labelled_union(spark, t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return U.labelled_union({"customer": c, "supplier": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))})


@query("""SELECT NULL::VARCHAR AS arm, c_custkey AS id, c_acctbal AS balance, NULL::INT AS nation FROM customer UNION ALL SELECT NULL, s_suppkey, NULL, s_nationkey FROM supplier""")
def aligned_union(spark, t):
    return U.aligned_union([t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))], ["arm", "id"])


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark, t):
    return J.drop_members(t("documents").select("doc_id").distinct(), t("labels"), ["doc_id"])


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersection(spark, t):
    return J.keep_members(t("documents").select("doc_id").distinct(), t("labels"), ["doc_id"])


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_rows(spark, t):
    return t("documents").select("source", "lang").distinct()


@query("""SELECT 'labels within documents' AS claim, count(*) = 0 AS holds FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'documents within labels', count(*) = 0 FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'toxic and clean are disjoint', count(*) = 0 FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0) UNION ALL SELECT 'labels and documents are disjoint', count(*) = 0 FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)""")
def set_proofs(spark, t):
    d, lab = t("documents").select("doc_id"), t("labels")
    rows = [("labels within documents", U.is_subset(lab, d, ["doc_id"])), ("documents within labels", U.is_subset(d, lab, ["doc_id"])), ("toxic and clean are disjoint", J.disjoint(lab.where("toxic = 1"), lab.where("toxic = 0"), ["doc_id"])), ("labels and documents are disjoint", J.disjoint(lab, d, ["doc_id"]))]
    return spark.createDataFrame(rows, "claim string, holds boolean")


@query("SELECT n_nationkey, n_name, n.customers FROM nation JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer GROUP BY 1) n USING (n_nationkey)")
def one_to_one_join(spark, t):
    c = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return J.validated_join(t("nation").select("n_nationkey", "n_name"), c, ["n_nationkey"], "inner", "one_to_one")


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'AB-CD' ELSE 'A-BCD' END AS q, CASE WHEN event_id % 2 = 0 THEN 'ABC-D' ELSE 'AB-CD' END AS t, (event_id % 9 + 1)::INT AS qs, (event_id % 7 + 1)::INT AS ts FROM events),
p AS (SELECT event_id, q, t, qs, ts, unnest(range(1, 6)) AS k FROM a)
SELECT event_id, (ts - 1 + length(replace(t[:k-1], '-', '')))::INT AS target, (qs - 1 + length(replace(q[:k-1], '-', '')))::INT AS query FROM p WHERE q[k] <> '-' AND t[k] <> '-'""")
def alignment_map(spark, t):
    e = F.col("event_id")
    d = t("events").select("event_id", F.when(e % 3 == 0, "AB-CD").otherwise("A-BCD").alias("qaln"), F.when(e % 2 == 0, "ABC-D").otherwise("AB-CD").alias("taln"), (e % 9 + 1).cast("int").alias("qstart"), (e % 7 + 1).cast("int").alias("tstart"))
    return J.alignment_map(d).select("event_id", F.explode("target_to_query").alias("target", "query"))


@query("""WITH n AS (SELECT DISTINCT 'src' || (p_size % 12)::VARCHAR AS name FROM part), d AS (SELECT doc_id, source || (doc_id % 30)::VARCHAR || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS s FROM documents)
SELECT doc_id, s, (SELECT arg_max(name, length(name)) FROM n WHERE starts_with(s, name) AND regexp_full_match(substr(s, length(name) + 1), '[0-9]*')) AS matched FROM d""")
def longest_prefix(spark, t):
    names = t("part").select(F.concat(F.lit("src"), (F.col("p_size") % 12).cast("string")).alias("name"))
    d = t("documents").select("doc_id", F.concat("source", (F.col("doc_id") % 30).cast("string"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")).alias("s"))
    return J.longest_prefix(d, names, "s", "name")


@query("""WITH i AS (SELECT doc_id % 40 AS shard, doc_id // 40 AS row, doc_id::VARCHAR AS e FROM documents), o AS (SELECT doc_id % 40 AS shard, doc_id // 40 AS row, (doc_id + (doc_id % 13 = 0)::INT)::VARCHAR AS e FROM documents WHERE lang <> 'fr')
SELECT coalesce(i.shard, o.shard) AS shard, coalesce(i.row, o.row) AS row, i.e AS entry_a, o.e AS entry_b FROM i FULL JOIN o ON i.shard = o.shard AND i.row = o.row WHERE i.e IS DISTINCT FROM o.e""")
def address_mismatches(spark, t):
    d, k = t("documents"), F.col("doc_id")
    at = [(k % 40).alias("shard"), F.floor(k / 40).alias("row")]
    return J.address_mismatches(d.select(*at, k.cast("string").alias("entry_id")), d.where("lang <> 'fr'").select(*at, (k + (k % 13 == 0).cast("int")).cast("string").alias("entry_id")))


@query("""WITH e AS (SELECT event_id, list_distinct([event_id % 50, event_id % 60, 7, event_id % 50]) AS ids FROM events), m AS (SELECT p_partkey AS id FROM part WHERE p_size < 10) SELECT event_id, count(*) AS n_members FROM (SELECT event_id, unnest(ids) AS id FROM e) SEMI JOIN m USING (id) GROUP BY 1""")
def array_members(spark, t):
    e = F.col("event_id")
    d = t("events").select("event_id", F.array(e % 50, e % 60, F.lit(7).cast("long"), e % 50).alias("ids"))
    return J.array_members(d, "ids", t("part").where("p_size < 10"), "p_partkey").drop("ids")


@query("SELECT p_partkey, regexp_full_match(p_name, '(?s).*' || substr(p_brand, 7, 1) || '.*' || substr(p_brand, 8, 1) || '.*') AS within FROM part")
def ordered_subsequence(spark, t):
    return t("part").select("p_partkey", J.is_subsequence(F.substring("p_brand", 7, 2), F.col("p_name")).alias("within"))


@query("""SELECT doc_id, tier, n_chars >= CASE tier WHEN 'A' THEN 10000 WHEN 'B' THEN 3000 ELSE 500 END AS flagged FROM documents, (SELECT unnest(['A', 'B', 'C']) AS tier) WHERE n_chars >= CASE tier WHEN 'A' THEN 10000 WHEN 'B' THEN 3000 ELSE 500 END""")
def cumulative_tiers(spark, t):
    """A document of tier A is in B and C too."""
    n = F.col("n_chars")
    own = F.when(n >= 10000, "A").when(n >= 3000, "B").when(n >= 500, "C")
    table = F.create_map(*[F.lit(x) for tier in N.TIERS for x in (tier, ",".join(u for u in N.TIERS if tier in N.tiers_up_to(u)))])
    return t("documents").select("doc_id", F.explode(F.split(table[own], ",")).alias("tier")).withColumn("flagged", F.lit(True))


@query("""SELECT doc_id FROM (SELECT doc_id, n_chars > 9000 AS truncated, n_chars AS length, doc_id % 50 AS contacts, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 9 END AS resolution FROM documents) WHERE NOT truncated AND length <= 5000 AND contacts >= 5 AND (resolution IS NULL OR resolution <= 4)""")
def usable_rows(spark, t):
    k = F.col("doc_id")
    d = t("documents").select("doc_id", (F.col("n_chars") > 9000).alias("truncated"), F.col("n_chars").alias("length"), (k % 50).alias("contacts"), F.when(k % 3 != 0, k % 9).alias("resolution"))
    return P.usable_rows(d, 5000, 5, 4).select("doc_id")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS q, l_tax * 12.5 AS c, CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(q, c), 6) AS shorter, round(q, 6) AS reference, round(c, 6) AS training, round(least(q, c), 6) AS both_sides, i IS NULL OR i < 0.5 AS survives, coalesce(round(i, 6) = 1 AND q = 1 AND round(c, 6) = 1, false) AS self_hit FROM h""")
def coverage_modes(spark, t):
    q, c, i = F.col("l_quantity") / 50, F.col("l_tax") * 12.5, F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10)
    r = lambda m: F.round(P.coverage(m, q, c), 6)
    return t("lineitem").select("l_orderkey", "l_linenumber", r("shorter").alias("shorter"), r("reference").alias("reference"), r("training").alias("training"), r("both").alias("both_sides"), P.survives(i, 0.5).alias("survives"), F.coalesce(P.is_self_hit(F.round(i, 6), q, F.round(c, 6)), F.lit(False)).alias("self_hit"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
def tuple_membership(spark, t):
    return t("lineitem").where(P.in_tuples(["l_returnflag", "l_linestatus"], [("A", "F"), ("N", "O")])).select("l_orderkey", "l_linenumber")


@query("SELECT unnest(['doc_id', 'n_chars', 'half']) AS feature")
def feature_columns(spark, t):
    d = t("documents").select("doc_id", "n_chars", "lang", F.lit(1.0).alias("constant"), F.when(F.col("doc_id") % 3 == 0, 1.0 * F.col("doc_id")).alias("sparse"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") / 2).alias("half"))
    return spark.createDataFrame([(c,) for c in P.feature_columns(d)], "feature string")


@query("SELECT doc_id, row_index FROM (SELECT doc_id, n_chars, row_number() OVER () - 1 AS row_index FROM documents) WHERE n_chars > 500")
def row_addresses(spark, t):
    return P.row_addresses(t("documents")).where("n_chars > 500").select("doc_id", "row_index")


@query("SELECT doc_id, n_chars, lang, source FROM documents")
def assembled_rows(spark, t):
    d = t("documents").withColumn("extra", F.lit(1))
    return P.assemble(d, ["doc_id", "n_chars"], ["lang", "n_chars", "absent", "source"])


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'followed' WHEN 'purchase' THEN 'bought' WHEN 'error' THEN 'failed' ELSE 'other' END AS event_type FROM events")
def relabelled(spark, t):
    names = {"view": "seen", "click": "followed", "purchase": "bought", "error": "failed"}
    return P.relabel(t("events").select("event_id", "event_type"), "event_type", names, "other")


@query("SELECT user_id, event_type, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY 1, 2")
def best_runs(spark, t):
    return V.select_best(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "value", ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, round(0.1 + 0.8 * least(greatest(event_id / 500.0, 0), 1), 9) AS p FROM events")
def linear_schedule(spark, t):
    e = F.col("event_id")
    return t("events").select("event_id", F.round(W.linear_schedule(e, 0.1, 0.9, 500), 9).alias("p"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 4 <> 0 THEN p_size % 4 END ASC NULLS LAST, p_retailprice DESC, p_partkey) AS place FROM part")
def mixed_order(spark, t):
    d = t("part").withColumn("resolution", F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4))
    d = d.withColumn("least", -F.col("p_retailprice"))
    return W.place_in_order(d, "resolution", "least", ["p_partkey"]).select("p_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY abs(s_acctbal) DESC, s_suppkey LIMIT 20")
def largest_magnitudes(spark, t):
    return W.by_magnitude(t("supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", 20)


@query("SELECT doc_id, row_number() OVER (ORDER BY sha1(doc_id::VARCHAR || '|mix'), doc_id) AS place FROM documents")
def keyed_shuffle(spark, t):
    d = t("documents").select("doc_id").withColumn("hash", S.keyed_hash(F.col("doc_id"), "mix"))
    d = d.withColumn("head", F.conv(F.substring("hash", 1, 12), 16, 10).cast("long"))  # cuts need a number; the hash itself settles equal heads
    return W.place(d, [], "head", ["hash", "doc_id"]).select("doc_id", F.col("place").cast("long").alias("place"))


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN n <= 1 THEN 'orphan' WHEN n < 16 THEN 'low' WHEN n < 64 THEN 'marginal' ELSE 'deep' END AS tier FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)""")
def depth_tiers(spark, t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", S.depth_tier(F.col("n")).alias("tier"))


@query("""WITH p AS (SELECT count(*) AS n FROM labels) SELECT 'labels' AS source, least(n, 100) AS share FROM p UNION ALL SELECT 'a', (100 - least(n, 100)) // 2 + (100 - least(n, 100)) % 2 FROM p UNION ALL SELECT 'b', (100 - least(n, 100)) // 2 FROM p""")
def quota_split(spark, t):
    n = t("labels").count()
    return spark.createDataFrame(list(zip(("labels", "a", "b"), S.quota(100, n, 2))), "source string, share long")


@query("SELECT event_id, 'clusters:' || array_to_string(list_sort([event_id % 7 - 1, event_id % 5]), ',') AS key FROM events WHERE event_id % 7 > 0 UNION ALL SELECT event_id, 'seq:2:' || sha1(event_id::VARCHAR) FROM events WHERE event_id % 7 = 0")
def group_keys(spark, t):
    e = F.col("event_id")
    return t("events").select("event_id", S.group_key(F.array(e % 7 - 1, e % 5), F.sha1(e.cast("string").cast("binary"))).alias("key"))


@query("""WITH f AS (SELECT event_id, [event_id % 20, event_id % 13, 3, 12, 12, 3, event_id % 9, event_id % 31] AS f FROM events), p AS (SELECT DISTINCT event_id, least(f[2*k-1], f[2*k])::INT AS i, greatest(f[2*k-1], f[2*k])::INT AS j FROM (SELECT event_id, f, unnest(range(1, 5)) AS k FROM f)) SELECT * FROM p WHERE j - i >= 6""")
def canonical_pairs(spark, t):
    e = F.col("event_id")
    flat = F.array(*[x.cast("int") for x in (e % 20, e % 13, F.lit(3), F.lit(12), F.lit(12), F.lit(3), e % 9, e % 31)])
    return t("events").select("event_id", F.explode(S.canonical_pairs(flat)).alias("p")).select("event_id", "p.*")


@query("""WITH e AS (SELECT event_id, '<begin_sequence> <contact> <p1> <p2> <begin_statements> <contact> <p' || (event_id % 9) || '> <p' || (event_id % 40) || '> <retract> <p' || (event_id % 40) || '> <p3> <contact> <p5>' AS s FROM events)
SELECT event_id, 0 AS pos, 'contact' AS kind, (event_id % 9)::INT AS a, (event_id % 40)::INT AS b FROM e UNION ALL SELECT event_id, 1, 'retract', (event_id % 40)::INT, 3 FROM e""")
def statement_tokens(spark, t):
    e = F.col("event_id")
    p = lambda x: F.concat(F.lit("<p"), x.cast("string"), F.lit(">"))
    text = F.concat_ws(" ", F.lit("<begin_sequence> <contact> <p1> <p2> <begin_statements> <contact>"), p(e % 9), p(e % 40), F.lit("<retract>"), p(e % 40), F.lit("<p3> <contact> <p5>"))
    return D.statements(t("events").select("event_id", text.alias("s")), "event_id", "s")


@query("""SELECT p_partkey, '<begin_sequence> ' || list_aggregate(list_transform(range(0, (p_size % 4 + 1)::BIGINT), lambda i: '<p' || i || '> <GLY>'), 'string_agg', ' ') || ' <begin_statements> <end>' AS document FROM part""")
def sequence_documents(spark, t):
    seq = F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), lambda _: F.lit("GLY"))
    return t("part").select("p_partkey", D.sequence_document(seq).alias("document"))


@query("""WITH i AS (SELECT event_id, unnest(range(0, 6)) AS k FROM events) SELECT event_id, string_agg(k::VARCHAR, ',' ORDER BY sha1(event_id::VARCHAR || '|perm|' || k), k) AS items FROM i GROUP BY 1""")
def statement_permutation(spark, t):
    e = F.col("event_id")
    items = F.sequence(F.lit(0), F.lit(5))
    return t("events").select("event_id", F.array_join(F.transform(D.shuffled(items, e, "perm"), lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT event_id, (event_id % 5)::INT AS seq_i, (event_id % 5 + 9)::INT AS seq_j, value AS degree FROM events")
def contact_store_round_trip(spark, t):
    e = F.col("event_id")
    c = F.array(F.struct((e % 5).cast("int").alias("seq_i"), (e % 5 + 9).cast("int").alias("seq_j"), F.col("value").alias("degree")))
    return t("events").select("event_id", F.explode(D.from_parallel(D.to_parallel(c))).alias("c")).select("event_id", "c.*")


@query("""WITH u AS (SELECT event_id, (('0x' || substr(sha1(event_id::VARCHAR || '|size'), 1, 13))::BIGINT / 4503599627370496.0) AS u FROM events) SELECT event_id, least(floor(pow(1 + u * (pow(13.0, -1.0) - 1), -1.0)), 12)::INT AS k FROM u""")
def draft_sizes(spark, t):
    e = F.col("event_id")
    return t("events").select("event_id", D.draft_size(F.lit(12), 2.0, S.keyed_uniform(e, "size")).alias("k"))


@query("""WITH u AS (SELECT event_id, unnest(range(1, 5)) AS s FROM events), x AS (SELECT event_id, (('0x' || substr(sha1(event_id::VARCHAR || '|gate|' || s), 1, 13))::BIGINT / 4503599627370496.0) AS g, (('0x' || substr(sha1(event_id::VARCHAR || '|run|' || s), 1, 13))::BIGINT / 4503599627370496.0) AS r FROM u)
SELECT event_id, sum(CASE WHEN g < 0.3 THEN greatest(ceil(ln(1 - r) / ln(0.5)), 1) ELSE 0 END)::BIGINT AS tokens FROM x GROUP BY 1""")
def pause_overhead(spark, t):
    e = F.col("event_id")
    return t("events").select("event_id", D.pause_overhead(e, 0.3, 0.5, 4).alias("tokens"))


@query("""WITH d AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS c, sum(n_chars) OVER (PARTITION BY source) AS t, (('0x' || substr(sha1(source || '|draw'), 1, 13))::BIGINT / 4503599627370496.0) AS u FROM documents)
SELECT source, min(doc_id) AS doc_id FROM d WHERE c > u * t GROUP BY 1""")
def weighted_draw(spark, t):
    d = t("documents").select("source", "doc_id", "n_chars", S.keyed_uniform(F.col("source"), "draw").alias("u"))
    return B.weighted_draw(d, ["source"], ["doc_id"], "n_chars", "u").select("source", "doc_id")


@query()
def chain_layout(spark, t):
    """Chains of orders (a line each) on a ring of 2000 positions."""
    c = t("lineitem").select(F.col("l_orderkey").cast("string").alias("entry_id"), F.col("l_linenumber").cast("string").alias("chain"), (F.col("l_quantity") + 1).cast("int").alias("length")).dropDuplicates(["entry_id", "chain"])
    return B.layout_chains(c, 2000, 10)


@query("SELECT source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) ORDER BY sha1(source || '|files'), source LIMIT 5")
def drawn_files(spark, t):
    return R.draw_files(t("documents").where("source is not null"), "source", 5, "files")


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after2, first_value(value) OVER w AS first, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, round(cume_dist() OVER w, 9) AS cume,
round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 30 PRECEDING AND CURRENT ROW), 4) AS near, dense_rank() OVER w AS dense, ntile(4) OVER w AS tile FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_frames(spark, t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole, near = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-30, 0)
    return t("events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after2"), F.first("value").over(w).alias("first"), F.nth_value("value", 2).over(whole).alias("second"), F.round(F.cume_dist().over(w), 9).alias("cume"), F.round(F.sum("value").over(near), 4).alias("near"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(w).cast("long").alias("tile"))


@query("SELECT upper(split_part(p_name || '-assembly' || p_size, '-', 1)) AS base, count(*) AS n FROM part GROUP BY 1")
def base_entries(spark, t):
    return t("part").groupBy(S.base_entry(F.concat("p_name", F.lit("-assembly"), F.col("p_size").cast("string"))).alias("base")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, (p_size * 2)::INT AS n, [p_size % 5, p_size % 5 + 1, p_size % 5 + 2, 20]::VARCHAR AS shards FROM part")
def expression_parsers(spark, t):
    lo = F.col("p_size") % 5
    text = F.concat(lo.cast("string"), F.lit("-"), (lo + 2).cast("string"), F.lit(",20"))
    ops = F.concat(F.lit("(1-"), F.col("p_size").cast("string"), F.lit(")(6,7)"))
    shards = F.concat(F.lit("["), F.array_join(F.transform(S.shard_ranges(text), lambda x: x.cast("string")), ", "), F.lit("]"))
    return t("part").select("p_partkey", S.operator_count(ops).cast("int").alias("n"), shards.alias("shards"))


@query("SELECT entity, count(*) AS n FROM (SELECT DISTINCT user_id AS entity, event_type FROM events) GROUP BY 1")
def unsplit_entities(spark, t):
    """Entities that lie in one part each (another result raises), counted."""
    d = t("events").select(F.col("user_id").alias("entity"), "event_type", (F.col("user_id") % 4).alias("part"))
    return V.refuse_split_entities(d, "entity", "part").select("entity", "event_type").distinct().groupBy("entity").agg(F.count("*").alias("n"))


@query("SELECT 0 AS missing_shards, 0 AS surplus, 0 AS repeated, 0 AS survivors")
def output_audit(spark, t):
    d = t("documents").select("doc_id", (F.col("doc_id") % 4).alias("shard"))
    dropped = t("labels").where("toxic = 1")
    kept = N.apply_drop_list(d, dropped, ["doc_id"])
    n = N.reconcile(d, dropped, ["doc_id"])["kept"]
    found = V.output_audit(kept, "doc_id", "shard", 4, n, dropped)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query(f"""WITH v AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT event_type, count(*) AS n, avg(v) AS mean FROM v GROUP BY 1), w AS (SELECT event_type, rep, v, {_poisson_sql('user_id', 'boot')} AS w FROM v, (SELECT unnest(range(60)) AS rep)),
m AS (SELECT event_type, rep, sum(w * v) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1, 2) SELECT g.event_type, n, round(mean, 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM g JOIN m USING (event_type) GROUP BY ALL""")
def bootstrap_ci(spark, t):
    """Poisson bootstrap of the mean per event type, 60 replicates."""
    v = t("events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    return T.bootstrap_means(v, ["event_type"], "user_id", "v", 60, "boot").select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query("""WITH g AS (SELECT source, sum((quality = 1 AND toxic = 1)::INT) AS a, sum((quality = 1 AND toxic <> 1)::INT) AS b, sum((quality <> 1 AND toxic = 1)::INT) AS c, sum((quality <> 1 AND toxic <> 1)::INT) AS d FROM labels JOIN documents USING (doc_id) GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d))::BIGINT, (least(a + b, a + c) + 1)::BIGINT)) AS x FROM g),
p AS (SELECT *, exp(lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1) + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(d - a + x + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + b + 1) - lgamma(c + d + 1))) AS p FROM x)
SELECT source, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(least(sum(p) FILTER (WHERE p <= seen * (1 + 1e-7)), 1), 6) AS p FROM (SELECT *, max(p) FILTER (WHERE x = a) OVER (PARTITION BY source) AS seen FROM p) GROUP BY 1, 2, 3, 4, 5""")
def fisher_by_source(spark, t):
    """Two-sided exact test of toxicity against quality by source."""
    d = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    g = d.groupBy("source").agg(n(q & x).alias("a"), n(q & ~x).alias("b"), n(~q & x).alias("c"), n(~q & ~x).alias("d"))
    return g.withColumn("p", F.round(T.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6))
