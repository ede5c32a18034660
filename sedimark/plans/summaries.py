"""Queries of summaries over several tables, versions and subsets."""

from pyspark.sql import functions as F

from sedimark.functions import scalars as S
from sedimark.operators import aggregates as A
from sedimark.operators import codecs as D
from sedimark.operators import filters as P
from sedimark.operators import joins as J
from sedimark.operators import setops as U
from sedimark.operators import similarity as N
from sedimark.operators import stats as T
from sedimark.operators import windows as W
from sedimark.plans.registry import query
from sedimark.plans.rewards import _poisson_sql


@query("""SELECT role, count(*) AS n, round(sum(length(text) - length(regexp_replace(text, '[aeiouAEIOU]', '', 'g'))) / sum(length(text)), 9) AS vowels, round(sum(length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / sum(length(text)), 9) AS digits FROM conversations GROUP BY 1""")
def class_fractions(spark, t):
    share = lambda p: F.round(F.sum(F.length("text") - F.length(F.regexp_replace("text", p, ""))) / F.sum(F.length("text")), 9)
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), share("[aeiouAEIOU]").alias("vowels"), share("[0-9]").alias("digits"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("""WITH s AS (SELECT s_suppkey, floor(s_acctbal / 2000)::BIGINT AS x, floor(s_nationkey / 5)::BIGINT AS y, s_suppkey % 3 AS z FROM supplier), d AS (SELECT unnest([-1, 0, 1]) AS d)
SELECT a.s_suppkey, count(b.s_suppkey) AS n FROM (SELECT s_suppkey, x + i.d AS x, y + j.d AS y, z + k.d AS z FROM s, d i, d j, d k WHERE NOT (i.d = 0 AND j.d = 0 AND k.d = 0)) a LEFT JOIN s b USING (x, y, z) GROUP BY 1""")
def grid_neighbours(spark, t):
    s = t("supplier").select("s_suppkey", S.grid_cell(F.col("s_acctbal"), 2000.0).alias("x"), S.grid_cell(F.col("s_nationkey"), 5.0).alias("y"), (F.col("s_suppkey") % 3).alias("z"))
    around = s.select("s_suppkey", F.explode(S.neighbour_cells(F.col("x"), F.col("y"), F.col("z"))).alias("c")).select("s_suppkey", "c.*")
    return around.join(s.withColumnRenamed("s_suppkey", "other"), ["x", "y", "z"], "left").groupBy("s_suppkey").agg(F.count("other").alias("n"))


@query("""WITH b AS (SELECT doc_id, n_chars, CASE WHEN n_chars <= 256 THEN 256 WHEN n_chars <= 1024 THEN 1024 WHEN n_chars <= 4096 THEN 4096 ELSE n_chars END AS bucket FROM documents)
SELECT doc_id, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) - 1) // greatest(8192 // bucket, 1) AS batch FROM b""")
def budget_batches(spark, t):
    return D.budget_batches(t("documents").select("doc_id", "n_chars"), "n_chars", ["n_chars", "doc_id"], [256, 1024, 4096], 8192).select("doc_id", "bucket", "batch")


@query("""WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id % 2 AS half, count(*) AS n, sum((a.v > b.v)::INT)::BIGINT AS wins, sum((a.v < b.v)::INT)::BIGINT AS losses, sum((a.v = b.v)::INT)::BIGINT AS ties, round(avg(a.v - b.v), 6) AS delta FROM a JOIN b USING (user_id) GROUP BY 1""")
def wins_and_losses(spark, t):
    v = lambda kind: t("events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("v"))
    return T.paired_wins(v("view").withColumn("half", F.col("user_id") % 2), v("click"), ["user_id"], "v", ["half"]).withColumn("delta", F.round("delta", 6))


@query("""WITH a AS (SELECT doc_id, lang AS tag, source FROM documents), b AS (SELECT doc_id, 'junk' AS tag FROM labels WHERE quality = 0), c AS (SELECT doc_id, 'toxic' AS tag, 'x' AS source FROM labels WHERE toxic = 1)
SELECT * FROM c UNION ALL SELECT doc_id, tag, NULL FROM b ANTI JOIN c USING (doc_id) UNION ALL SELECT * FROM a ANTI JOIN c USING (doc_id) ANTI JOIN b USING (doc_id)""")
def layered_rows(spark, t):
    lab = t("labels")
    return U.layered([t("documents").select("doc_id", F.col("lang").alias("tag"), "source"), lab.where("quality = 0").select("doc_id", F.lit("junk").alias("tag")), lab.where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag"), F.lit("x").alias("source"))], ["doc_id"])


@query("""WITH d AS (SELECT d.source, coalesce(l.toxic, 0) = 1 AS flag, n_chars FROM documents d LEFT JOIN labels l USING (doc_id)), s AS (SELECT unnest(list_filter(['all', CASE WHEN flag THEN 'flagged' END, CASE WHEN n_chars > 3000 THEN 'long' END], lambda x: x IS NOT NULL)) AS subset, source, n_chars FROM d)
SELECT subset, source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM s GROUP BY ALL""")
def replaced_flag_subsets(spark, t):
    """A flag from a validated join, then overlapping subsets by it."""
    d = J.validated_join(t("documents").select("doc_id", "source", "n_chars"), t("labels").select("doc_id", "toxic"), ["doc_id"]).withColumn("flag", F.coalesce("toxic", F.lit(0)) == 1)
    return A.overlapping(d, [("all", F.lit(True)), ("flagged", F.col("flag")), ("long", F.col("n_chars") > 3000)]).groupBy("subset", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT regexp_replace(p_brand || CASE WHEN p_size % 3 = 0 THEN '-' || p_size ELSE '' END, '-[0-9]+$', '') AS chain, count(*) AS n FROM part GROUP BY 1")
def base_chains(spark, t):
    copy = F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(""))
    return t("part").groupBy(S.base_chain(copy).alias("chain")).agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, max(l_discount) AS best_d, max(l_tax) AS best_t, arg_min(l_orderkey, (-l_discount, l_orderkey, l_linenumber)) AS at_best_d FROM lineitem GROUP BY 1""")
def two_maxima(spark, t):
    d = t("lineitem")
    return A.best_evidence(d, ["l_suppkey"], "l_discount", ["l_orderkey", "l_linenumber"], []).join(d.groupBy("l_suppkey").agg(F.max("l_tax").alias("best_t")), "l_suppkey").select("l_suppkey", F.col("l_discount").alias("best_d"), "best_t", F.col("l_orderkey").alias("at_best_d"))


@query("""SELECT l_suppkey, coalesce(l_returnflag, 'all') AS arm, count(*) AS n, (count(*) FILTER (WHERE l_tax <= 0.03))::BIGINT AS significant, max(l_discount) FILTER (WHERE l_tax <= 0.03) AS best FROM lineitem GROUP BY GROUPING SETS ((l_suppkey), (l_suppkey, l_returnflag))""")
def arm_accumulators(spark, t):
    ok = F.col("l_tax") <= 0.03
    out = A.grouping_sets(t("lineitem"), [["l_suppkey"], ["l_suppkey", "l_returnflag"]], [F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("significant"), F.max(F.when(ok, F.col("l_discount"))).alias("best")])
    return out.select("l_suppkey", F.coalesce("l_returnflag", F.lit("all")).alias("arm"), "n", "significant", "best")


@query("""WITH v AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), s AS (SELECT unnest(list_filter(['all', CASE WHEN user_id % 2 = 0 THEN 'even' END, CASE WHEN user_id < 100 THEN 'old' END], lambda x: x IS NOT NULL)) AS subset, * FROM v)
SELECT x.subset, x.event_type AS model_a, y.event_type AS model_b, count(*) AS n, round(avg(x.v - y.v), 6) AS delta FROM s x JOIN s y ON x.user_id = y.user_id AND x.subset = y.subset AND x.event_type < y.event_type GROUP BY ALL""")
def subset_deltas(spark, t):
    v = A.overlapping(t("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v")), [("all", F.lit(True)), ("even", F.col("user_id") % 2 == 0), ("old", F.col("user_id") < 100)])
    out = None
    for name in ("all", "even", "old"):
        one = T.paired_difference(v.where(F.col("subset") == name), "user_id", "event_type", "v").select(F.lit(name).alias("subset"), "model_a", "model_b", "n", F.round("delta", 6).alias("delta"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH a AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') - avg(value) FILTER (WHERE event_type = 'click') AS d FROM events GROUP BY 1), v AS (SELECT user_id % 3 AS g, user_id, d FROM a WHERE d IS NOT NULL), n AS (SELECT g, count(*) AS n, avg(d) AS mean FROM v GROUP BY 1),
w AS (SELECT g, rep, d, {_poisson_sql('user_id', 'pair')} AS w FROM v, (SELECT unnest(range(60)) AS rep)), m AS (SELECT g, rep, sum(w * d) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1, 2), c AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT g, n, round(mean, 4) AS mean, CASE WHEN n >= 3 THEN round(low, 4) END AS low, CASE WHEN n >= 3 THEN round(high, 4) END AS high, CASE WHEN n >= 3 THEN low > 0 OR high < 0 END AS significant FROM n JOIN c USING (g)""")
def paired_bootstrap(spark, t):
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    d = t("events").groupBy("user_id").agg((of("view") - of("click")).alias("d")).withColumn("g", F.col("user_id") % 3)
    return T.bootstrap_means(d, ["g"], "user_id", "d", 60, "pair").select("g", "n", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")], "significant")


@query("""WITH v AS (SELECT event_id, user_id, value * 137 / pow(10.0, event_id % 3 * 4) AS x FROM events),
u AS (SELECT *, CASE WHEN x = 0 THEN pow(2.0, -24) ELSE greatest(pow(2.0, floor(log2(abs(x))) - 10), pow(2.0, -24)) END AS unit FROM v),
h AS (SELECT event_id, user_id, CASE WHEN abs(x) >= 65520 THEN sign(x) * 'inf'::DOUBLE ELSE round_even(x / unit, 0) * unit END AS half FROM u)
SELECT event_id, half, rank() OVER (PARTITION BY user_id ORDER BY half) AS place FROM h""")
def half_precision_ranks(spark, t):
    """Ranks after rounding to half precision, over its normal and its smallest range: the rounding makes ties."""
    d = t("events").select("event_id", "user_id", S.half_precision(F.col("value") * 137 / F.pow(F.lit(10.0), F.col("event_id") % 3 * 4)).alias("half"))
    from pyspark.sql import Window

    return d.withColumn("place", F.rank().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("half"))).cast("long")).drop("user_id")


def _p_sql(z: str) -> str:
    k = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2)))"
    poly = repr(T.ERFC[0]) + "::DOUBLE"
    for c in T.ERFC[1:]:
        poly = f"({poly} * {k} + {c!r}::DOUBLE)"
    return f"least({k} * exp(-({z}) * ({z}) / 2 - 1.26551223 + {poly} * {k}), 1)"


@query(f"""WITH v AS (SELECT p_brand, p_size AS x, 'p_retailprice' AS feature, p_retailprice AS y FROM part UNION ALL SELECT p_brand, p_size, 'p_partkey', p_partkey FROM part),
r AS (SELECT p_brand, feature, rank() OVER (PARTITION BY p_brand, feature ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY p_brand, feature ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, feature, y) - 1) / 2 AS ry FROM v),
c AS (SELECT p_brand, feature, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY ALL HAVING count(*) >= 3), s AS (SELECT *, round({_p_sql('rho * sqrt(n - 1)')}, 12) AS p FROM c)
SELECT p_brand, feature, n, round(rho, 7) AS rho, round(p, 7) AS p, round(least(p * count(*) OVER () / row_number() OVER (ORDER BY p, p_brand, feature), 1), 6) AS q FROM s""")
def association_screen(spark, t):
    d = t("part").select("p_brand", "p_size", "p_retailprice", F.col("p_partkey").cast("double").alias("p_partkey"))
    out = T.association_screen(d, ["p_brand"], "p_size", ["p_retailprice", "p_partkey"])
    return out.select("p_brand", "feature", "n", F.round("rho", 7).alias("rho"), F.round("p", 7).alias("p"), F.round("q", 6).alias("q"))


@query("""WITH b AS (SELECT l_suppkey, CASE WHEN l_linenumber < 3 THEN 'near' WHEN l_linenumber < 5 THEN 'mid' ELSE 'far' END AS band, l_returnflag = 'R' AS hit, row_number() OVER (PARTITION BY l_suppkey, CASE WHEN l_linenumber < 3 THEN 'near' WHEN l_linenumber < 5 THEN 'mid' ELSE 'far' END ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem)
SELECT l_suppkey, band, round(avg(hit::INT) FILTER (WHERE r <= 20), 9) AS "p_L", round(avg(hit::INT) FILTER (WHERE r <= 10), 9) AS "p_L_2", round(avg(hit::INT) FILTER (WHERE r <= 4), 9) AS "p_L_5", count(*) AS n_candidates FROM b GROUP BY ALL""")
def banded_precision(spark, t):
    d = P.with_bands(t("lineitem"), "l_linenumber", [("near", 1, 3), ("mid", 3, 5), ("far", 5, None)]).withColumn("hit", F.col("l_returnflag") == "R").withColumn("size", F.lit(20))
    out = W.top_precision(d, ["l_suppkey", "band"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], "hit", "size")
    return out.select("l_suppkey", "band", *[F.round(c, 9).alias(c) for c in ("p_L", "p_L_2", "p_L_5")], "n_candidates")


LEDGER = [("no_source", "source IS NULL"), ("no_text", "text IS NULL"), ("empty", "n_chars = 0"), ("short", "n_chars < 60"), ("long", "n_chars > 15000"), ("french", "lang = 'fr'"), ("first", "source = 'src1'"), ("second", "source = 'src2'")]


@query("SELECT CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in LEDGER) + " ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def chain_ledger(spark, t):
    """Eight drop rules in order; the first that applies is the reason."""
    return P.reason_tally(P.first_reason(t("documents"), [(n, F.expr(c)) for n, c in LEDGER]))


@query("""SELECT l_suppkey, score, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey FROM (SELECT l_suppkey, l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS score, max(greatest(l_discount, l_tax)) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) WHERE score = m GROUP BY 1, 2""")
def combined_coverage(spark, t):
    d = t("lineitem").withColumn("score", P.coverage("shorter", F.col("l_discount"), F.col("l_tax")))
    return A.best_evidence(d, ["l_suppkey"], "score", ["l_orderkey", "l_linenumber"], []).select("l_suppkey", "score", "l_orderkey")


@query("""SELECT lang, threshold, count(*) AS n, sum((v IS NULL OR v < threshold)::INT)::BIGINT AS survivors, round(avg((v IS NULL OR v < threshold)::INT), 9) AS share FROM (SELECT lang, CASE WHEN doc_id % 4 <> 0 THEN n_chars / 10000 END AS v FROM documents), (SELECT unnest([0.1, 0.5, 1.0]::DOUBLE[]) AS threshold) GROUP BY 1, 2""")
def survival_by_language(spark, t):
    d = t("documents").select("lang", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") / 10000).alias("v"))
    return N.threshold_sweep(d, "v", [0.1, 0.5, 1.0], ["lang"]).withColumn("share", F.round("share", 9))


@query("""WITH d AS (SELECT source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'mid' ELSE 'long' END AS bin, n_chars FROM documents)
SELECT coalesce(CASE WHEN grouping(bin) = 0 THEN 'bin ' || bin WHEN grouping(source) = 0 THEN 'source ' || source END, 'all') AS block, count(*) AS n, round(avg(n_chars), 6) AS mean FROM d GROUP BY GROUPING SETS ((), (bin), (source))""")
def summary_blocks(spark, t):
    d = t("documents").select("source", S.bucket_label(F.col("n_chars"), [500, 3000], ["short", "mid", "long"]).alias("bin"), "n_chars")
    out = A.grouping_sets(d, [[], ["bin"], ["source"]], [F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean")])
    return out.select(F.coalesce(F.when(F.col("level") == "bin", F.concat(F.lit("bin "), "bin")), F.when(F.col("level") == "source", F.concat(F.lit("source "), "source")), F.lit("all")).alias("block"), "n", "mean")


@query("""SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS finished, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS open, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1""")
def derived_labels_wide(spark, t):
    """Labels by a dictionary (an unknown one raises), then wide."""
    d = P.relabel(t("orders"), "o_orderstatus", {"F": "finished", "O": "open", "P": "pending"})
    return A.wide(d, ["o_custkey"], "o_orderstatus", "o_totalprice", ["finished", "open", "pending"], F.max)


KINDS = ("click", "error", "purchase", "view")


def kind_sequences(t):
    """(user_id, ids): each user's event types in order as tokens from 1, the last one standing for types outside the vocabulary."""
    at = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type"))
    d = t("events").withColumn("id", F.when(at > 0, at).otherwise(len(KINDS) + 1).cast("int"))
    return d.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "id"))), lambda x: x["id"]).alias("ids"))


@query("""WITH s AS (SELECT user_id, ts, event_id, coalesce(nullif(list_position(['click', 'error', 'purchase', 'view'], event_type), 0), 5)::INT AS b FROM events), p AS (SELECT user_id, b, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS a FROM s),
n AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT a, sum(n) AS t FROM n GROUP BY 1) SELECT user_id, count(*) AS n_tokens, round(sum(ln((n + 1) / (t + 6))), 6) AS logprob FROM p JOIN n USING (a, b) JOIN t USING (a) GROUP BY 1""")
def teacher_forced_scores(spark, t):
    """Event types as tokens, those outside the vocabulary as an unknown one: log-probability of each user's sequence under a bigram model of all."""
    from sedimark.operators import backends

    seq = kind_sequences(t)
    counts = backends.bigram_counts(seq, "ids", len(KINDS) + 2, 0)
    out = backends.teacher_forced(seq, "user_id", "ids", lambda: backends.Bigrams(counts, 0))
    return out.select("user_id", F.size("logprobs").cast("long").alias("n_tokens"), F.round(F.aggregate("logprobs", F.lit(0.0), lambda a, x: a + x), 6).alias("logprob"))


@query("""WITH s AS (SELECT user_id, ts, event_id, coalesce(nullif(list_position(['click', 'error', 'purchase', 'view'], event_type), 0), 5)::INT AS b FROM events),
p AS (SELECT user_id, row_number() OVER w - 1 AS pos, b, coalesce(lag(b) OVER w, 0) AS a, lead(b) OVER w AS c FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), v AS (SELECT unnest(range(0, 6))::INT AS x), t AS (SELECT x AS a, coalesce(sum(n), 0) AS t FROM v LEFT JOIN n ON n.a = v.x GROUP BY 1),
m AS (SELECT y.x AS a, z.x AS b, (coalesce(n, 0) + 1) / (t + 6) AS q FROM v y JOIN v z ON true LEFT JOIN n ON n.a = y.x AND n.b = z.x JOIN t ON t.a = y.x),
f AS (SELECT user_id, pos, p.b AS wild, v.x AS token, one.q * coalesce(two.q, 1) AS f FROM p JOIN v ON true JOIN m one ON one.a = p.a AND one.b = v.x LEFT JOIN m two ON two.a = v.x AND two.b = p.c)
SELECT user_id, f.pos, token, round(ln(f.f) - ln(own.f), 6) AS log_ratio FROM f JOIN (SELECT user_id, pos, f FROM f WHERE token = wild) own USING (user_id, pos)""")
def masked_substitutions(spark, t):
    """Log ratio of every token to a place's own when the place is hidden, under the bigram model of all sequences."""
    from sedimark.operators import backends, stats

    seq = kind_sequences(t)
    counts = backends.bigram_counts(seq, "ids", len(KINDS) + 2, 0)
    m = backends.masked_marginals(seq, "user_id", "ids", lambda: backends.Bigrams(counts, 0)).select(F.col("user_id").alias("entity"), "pos", "wild", F.col("token").alias("aa"), "logp")
    out = stats.substitution_scores(m.drop("wild"), m.select("entity", "pos", "wild").distinct())
    return out.select(F.col("entity").alias("user_id"), F.col("pos").cast("long").alias("pos"), F.col("aa").alias("token"), F.round("log_ratio", 6).alias("log_ratio"))
