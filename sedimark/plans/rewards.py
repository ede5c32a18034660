"""Queries of section rewards, consensus modes, selection and resampling statistics."""

from pyspark.sql import functions as F

from sedimark.operators import evaluation as V
from sedimark.operators import rewards as Q
from sedimark.operators import stats as T
from sedimark.plans.registry import query

#: Lines stand for pairs that the sections of rollouts name, nations for entities.
SECTIONS = """u AS (SELECT n_nationkey AS entity, i, i + d AS j FROM nation, (SELECT unnest(range(0, 24)) AS i), (SELECT unnest(range(1, 24)) AS d) WHERE i + d < 24),
l AS (SELECT s_nationkey AS entity, (l_linenumber % 3)::INT AS rollout, (l_suppkey % 4)::INT AS k, l_partkey AS rank, least(l_partkey % 24, l_orderkey % 24)::INT AS i, greatest(l_partkey % 24, l_orderkey % 24)::INT AS j FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 24 <> l_orderkey % 24),
s AS (SELECT DISTINCT entity, rollout, k, i, j FROM l), t AS (SELECT DISTINCT c_nationkey AS entity, (c_custkey % 23)::INT AS i, (c_custkey % 23 + 1 + c_custkey % 2)::INT AS j FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 23 + 1 + c_custkey % 2 < 24)"""


def sections(t):
    universe = V.candidate_universe(t("nation").select(F.col("n_nationkey").alias("entity"), F.lit(24).alias("length")), 1)
    x, y = F.col("l_partkey") % 24, F.col("l_orderkey") % 24
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where(x != y).select(F.col("s_nationkey").alias("entity"), (F.col("l_linenumber") % 3).cast("int").alias("rollout"), (F.col("l_suppkey") % 4).cast("int").alias("k"), F.col("l_partkey").alias("rank"), F.least(x, y).cast("int").alias("i"), F.greatest(x, y).cast("int").alias("j"))
    a = F.col("c_custkey") % 23
    truth = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("entity"), a.cast("int").alias("i"), (a + 1 + F.col("c_custkey") % 2).cast("int").alias("j")).where("j < 24").distinct()
    return universe, rows, truth


PREFIX = f"""{SECTIONS}, st AS (SELECT DISTINCT entity, rollout, k FROM s), v AS (SELECT st.entity, st.rollout, st.k, s.i, s.j, count(*) AS votes FROM st JOIN s ON s.entity = st.entity AND s.rollout = st.rollout AND s.k <= st.k GROUP BY ALL), n AS (SELECT entity, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT st.entity, st.rollout, st.k, t.entity IS NOT NULL AS hit, n.n, row_number() OVER (PARTITION BY st.entity, st.rollout, st.k ORDER BY coalesce(votes, 0) DESC, u.i, u.j) AS rk FROM st JOIN u ON u.entity = st.entity LEFT JOIN v ON v.entity = st.entity AND v.rollout = st.rollout AND v.k = st.k AND v.i = u.i AND v.j = u.j LEFT JOIN t ON t.entity = u.entity AND t.i = u.i AND t.j = u.j LEFT JOIN n ON n.entity = st.entity),
c AS (SELECT entity, rollout, k, coalesce(sum((rk <= n AND hit)::INT) / nullif(sum((rk <= n)::INT), 0), 0) AS c FROM r GROUP BY ALL), pm AS (SELECT entity, rollout, k, c - coalesce(lag(c) OVER (PARTITION BY entity, rollout ORDER BY k), 0) AS marginal FROM c)"""


@query(f"WITH {PREFIX} SELECT entity, rollout, k, round(marginal, 9) + 0 AS marginal FROM pm")
def prefix_marginals(spark, t):
    return Q.prefix_marginals(*sections(t)).withColumn("marginal", F.round("marginal", 9) + 0)


@query(f"WITH {PREFIX} SELECT entity, rollout, k, round(marginal - avg(marginal) OVER (PARTITION BY entity, k), 8) + 0 AS centred FROM pm")
def positional_baseline(spark, t):
    return Q.centred(Q.prefix_marginals(*sections(t)), ["entity"], "k", "marginal").select("entity", "rollout", "k", (F.round("centred", 8) + 0).alias("centred"))


@query(f"""WITH {SECTIONS}, f AS (SELECT s.entity, rollout, k, count(*) AS n, coalesce(2.0 * count(t.entity) / (count(*) + max(nn)), 0) AS f1 FROM s LEFT JOIN t USING (entity, i, j) LEFT JOIN (SELECT entity, count(*) AS nn FROM t GROUP BY 1) z ON z.entity = s.entity GROUP BY ALL),
p AS (SELECT entity, rollout, max(k) AS last, coalesce((list_sort(list(k), 'DESC'))[2], max(k)) AS second_last, arg_max(k, (f1, -k)) AS best FROM f GROUP BY ALL)
SELECT 'consensus' AS mode, entity, rollout, i, j, count(*)::DOUBLE AS score FROM s GROUP BY ALL UNION ALL SELECT m.mode, s.entity, s.rollout, i, j, 1.0 FROM s JOIN (SELECT * FROM p UNPIVOT (k FOR mode IN (last, second_last, best))) m ON m.entity = s.entity AND m.rollout = s.rollout AND m.k = s.k""")
def consensus_modes(spark, t):
    _, rows, truth = sections(t)
    out = None
    for mode in ("consensus", "last", "second_last", "best"):
        one = Q.consensus_scores(rows, truth, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {SECTIONS}, b AS (SELECT * FROM (VALUES ('near', 1, 4), ('far', 4, NULL), ('none', 40, NULL)) b(band, lo, hi)), nt AS (SELECT entity, band, count(*) AS n FROM t, b WHERE j - i >= lo AND (hi IS NULL OR j - i < hi) GROUP BY ALL),
p AS (SELECT l.entity, band, rollout, i, j, row_number() OVER (PARTITION BY l.entity, band, rollout ORDER BY rank, i, j) AS r FROM l, b WHERE j - i >= lo AND (hi IS NULL OR j - i < hi)),
h AS (SELECT p.entity, p.band, rollout, count(t.entity) / count(*) AS c FROM p JOIN nt ON nt.entity = p.entity AND nt.band = p.band AND r <= n LEFT JOIN t ON t.entity = p.entity AND t.i = p.i AND t.j = p.j GROUP BY ALL),
e AS (SELECT entity, band FROM (SELECT entity FROM l UNION SELECT entity FROM t), b)
SELECT e.entity, e.band, coalesce(n, 0) AS n_true, CASE WHEN n IS NULL THEN 'NaN'::DOUBLE ELSE round(coalesce(max(c), 0), 9) END AS r_oracle, coalesce(arg_max(rollout, (c, -rollout)), -1)::INT AS rollout FROM e LEFT JOIN nt USING (entity, band) LEFT JOIN (SELECT * FROM h WHERE c > 0) h USING (entity, band) GROUP BY e.entity, e.band, n""")
def oracle_rollouts(spark, t):
    _, rows, truth = sections(t)
    return Q.oracle_rollouts(rows, truth, [("near", 1, 4), ("far", 4, None), ("none", 40, None)]).withColumn("r_oracle", F.round("r_oracle", 9))


STUDY = """e AS (SELECT user_id, event_id, value AS metric, (event_id * 7919) % 101 AS quality FROM events), f AS (SELECT user_id, count(*) AS n, count(DISTINCT metric) AS d, arg_min(quality, (metric, event_id))::DOUBLE AS selected, avg(quality) AS mean, max(quality)::DOUBLE AS oracle, min(quality)::DOUBLE AS worst FROM e GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT metric) >= 3),
r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY metric) + (count(*) OVER (PARTITION BY user_id, metric) - 1) / 2 AS x, rank() OVER (PARTITION BY user_id ORDER BY quality) + (count(*) OVER (PARTITION BY user_id, quality) - 1) / 2 AS y FROM e SEMI JOIN f USING (user_id)),
s AS (SELECT user_id, corr(x, y) AS rho FROM r GROUP BY 1)"""


def study(t):
    e = t("events").select("user_id", "event_id", F.col("value").alias("metric"), (F.col("event_id") * 7919 % 101).cast("double").alias("quality"))
    return Q.selection_study(e, "user_id", "metric", "quality", "event_id")


@query(f"WITH {STUDY} SELECT user_id, selected, round(mean, 6) AS mean, oracle, worst, round(rho, 6) AS rho FROM f JOIN s USING (user_id)")
def selection_by_entity(spark, t):
    return study(t)[0].withColumns({"mean": F.round("mean", 6), "rho": F.round("rho", 6)})


@query(f"WITH {STUDY} SELECT count(*) AS n, round(avg(rho), 6) AS mean_rho, round(avg((rho < 0)::INT), 6) AS share_negative, round(avg(selected - mean), 6) AS selection_gain, round(avg(oracle - mean), 6) AS oracle_gain FROM f JOIN s USING (user_id)")
def selection_study(spark, t):
    out = study(t)[1]
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"""WITH {SECTIONS}, o AS (SELECT DISTINCT entity, rollout AS voter, i, j FROM s), z AS (SELECT entity, voter, count(*) AS n FROM o GROUP BY ALL), c AS (SELECT a.entity, a.voter, b.voter AS other, count(*) AS c FROM o a JOIN o b ON a.entity = b.entity AND a.i = b.i AND a.j = b.j AND a.voter <> b.voter GROUP BY ALL)
SELECT x.entity, x.voter, round(avg(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0))), 9) AS mean_similarity FROM z x JOIN z y ON x.entity = y.entity AND x.voter <> y.voter LEFT JOIN c ON c.entity = x.entity AND c.voter = x.voter AND c.other = y.voter GROUP BY ALL""")
def sibling_similarity(spark, t):
    _, rows, _ = sections(t)
    return Q.sibling_similarity(rows.withColumnRenamed("rollout", "voter")).withColumn("mean_similarity", F.round("mean_similarity", 9))


def _poisson_sql(key: str, salt: str) -> str:
    """Poisson(1) count by the inverse of its distribution function, as the operator draws it."""
    import math

    u, total, steps = f"(('0x' || substr(sha1({key} || '|{salt}|' || rep), 1, 13))::BIGINT / 4503599627370496.0)", 0.0, ""
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps += f" WHEN {u} < {total!r}::DOUBLE THEN {k}"
    return f"CASE{steps} ELSE 8 END"


REPS = 40


@query(f"""WITH d AS (SELECT o_orderpriority, o_orderkey, o_totalprice AS v, o_orderstatus = 'F' AS a FROM orders), g AS (SELECT o_orderpriority, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE NOT a) AS n_b, avg(v) FILTER (WHERE a) AS mean_a, avg(v) FILTER (WHERE NOT a) AS mean_b FROM d GROUP BY 1),
w AS (SELECT o_orderpriority, rep, a, v, {_poisson_sql('o_orderkey', 'gap')} AS w FROM d, (SELECT unnest(range({REPS})) AS rep)), m AS (SELECT o_orderpriority, rep, sum(w * v) FILTER (WHERE a) / sum(w) FILTER (WHERE a) - sum(w * v) FILTER (WHERE NOT a) / sum(w) FILTER (WHERE NOT a) AS d FROM w WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT o_orderpriority, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM m GROUP BY 1)
SELECT o_orderpriority, n_a, n_b, round(mean_a - mean_b, 3) AS gap, round(low, 3) AS low, round(high, 3) AS high, low > 0 OR high < 0 AS significant FROM g JOIN c USING (o_orderpriority)""")
def two_sample_gap(spark, t):
    out = T.two_sample_gap(t("orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", "o_orderkey", "o_totalprice", REPS, "gap")
    return out.select("o_orderpriority", "n_a", "n_b", *[F.round(c, 3).alias(c) for c in ("gap", "low", "high")], "significant")


@query(f"""WITH d AS (SELECT p_brand, p_partkey, p_retailprice - 30 * p_size AS v, p_partkey % 2 = 0 AS a FROM part), g AS (SELECT p_brand, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE NOT a) AS n_b, avg(v) FILTER (WHERE a) - avg(v) FILTER (WHERE NOT a) AS gap FROM d GROUP BY 1),
w AS (SELECT p_brand, rep, a, v, {_poisson_sql('p_partkey', 'int')} AS w FROM d, (SELECT unnest(range({REPS})) AS rep)), m AS (SELECT p_brand, rep, sum(w * v) FILTER (WHERE a) / sum(w) FILTER (WHERE a) - sum(w * v) FILTER (WHERE NOT a) / sum(w) FILTER (WHERE NOT a) AS d FROM w WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT p_brand, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM m GROUP BY 1)
SELECT p_brand, n_a, n_b, round(gap, 2) AS gap, round(low, 2) AS low, round(high, 2) AS high FROM g JOIN c USING (p_brand) WHERE n_a >= 3 AND n_b >= 3""")
def interaction_test(spark, t):
    d = t("part").withColumn("__base", 30.0 * F.col("p_size"))
    out = T.interaction(d, ["p_brand"], "p_partkey", "p_retailprice", "__base", F.col("p_partkey") % 2 == 0, REPS, "int")
    return out.select("p_brand", "n_a", "n_b", *[F.round(c, 2).alias(c) for c in ("gap", "low", "high")])


@query("""WITH d AS (SELECT unnest(list_filter(['all', CASE WHEN p_size % 2 = 0 THEN 'even' END, CASE WHEN p_size % 2 = 1 THEN 'odd' END], lambda x: x IS NOT NULL)) AS split, p_brand, p_size AS x, p_retailprice, p_partkey FROM part),
v AS (SELECT split, p_brand, x, 'p_retailprice' AS value, p_retailprice AS y FROM d UNION ALL SELECT split, p_brand, x, 'p_partkey', p_partkey FROM d),
r AS (SELECT split, p_brand, value, rank() OVER (PARTITION BY split, p_brand, value ORDER BY x) + (count(*) OVER (PARTITION BY split, p_brand, value, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY split, p_brand, value ORDER BY y) + (count(*) OVER (PARTITION BY split, p_brand, value, y) - 1) / 2 AS ry, count(*) OVER (PARTITION BY split, p_brand, value) AS n FROM v)
SELECT split, p_brand, value, n, round(corr(rx, ry), 8) AS rho FROM r WHERE n >= 10 GROUP BY ALL""")
def identity_slopes(spark, t):
    d = t("part").select("p_brand", "p_size", "p_retailprice", F.col("p_partkey").cast("double").alias("p_partkey"))
    out = T.slopes(d, [("all", F.lit(True)), ("even", F.col("p_size") % 2 == 0), ("odd", F.col("p_size") % 2 == 1)], ["p_brand"], "p_size", ["p_retailprice", "p_partkey"])
    return out.withColumn("rho", F.round("rho", 8))


@query()
def cross_validated_ridge(spark, t):
    """Price of an order from its lines; predictions of the folds that did not see it."""
    from sedimark.operators.stats import cross_validated_ridge as ridge

    x = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"), F.avg("l_discount").alias("d"))
    d = t("orders").join(x, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "q", "n", "d", "o_totalprice")
    return ridge(d, "o_orderkey", ["q", "n", "d"], "o_totalprice")[0].select("o_orderkey", "fold", "prediction")


@query()
def boosted_importances(spark, t):
    """Price of an order from its lines by boosted trees: R squared on each fold's own rows, and what every feature's loss costs there."""
    from sedimark.operators import boosting

    x = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"), F.avg("l_discount").alias("d"))
    d = t("orders").join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "q", "n", "d", "o_totalprice")
    report = boosting.cross_validated(d, "o_orderkey", ["q", "n", "d"], "o_totalprice", rounds=12, rate=0.2)[1]
    return report.select("fold", "feature", "n", F.round("r2", 9).alias("r2"), F.round("importance", 9).alias("importance"))


@query("""WITH a AS (SELECT c_nationkey AS g, c_custkey AS id, string_split(lpad((c_custkey * 7919 % 1000)::VARCHAR, 3, '0') || CASE WHEN c_custkey % 5 = 0 THEN '---' ELSE lpad((c_custkey % 50)::VARCHAR, 3, '-') END, '') AS s FROM customer),
p AS (SELECT g, id, unnest(range(1, 7)) AS k, unnest(s) AS c FROM a), m AS (SELECT x.g, x.id, y.id AS other, sum((x.c = y.c)::INT) AS same, count(*) AS met FROM p x JOIN p y ON x.g = y.g AND x.k = y.k WHERE x.c <> '-' AND y.c <> '-' GROUP BY ALL),
n AS (SELECT g, id, sum((same / met >= 0.6)::INT) AS n FROM m GROUP BY ALL) SELECT g, round(sum(1 / n), 6) AS neff FROM n GROUP BY 1""")
def effective_depth(spark, t):
    tail = F.when(F.col("c_custkey") % 5 == 0, "---").otherwise(F.lpad((F.col("c_custkey") % 50).cast("string"), 3, "-"))
    a = t("customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.concat(F.lpad((F.col("c_custkey") * 7919 % 1000).cast("string"), 3, "0"), tail).alias("s"))
    return T.effective_depth(a, "g", "id", "s", 0.6).withColumn("neff", F.round("neff", 6))
