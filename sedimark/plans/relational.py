"""Queries of joins, aggregates, windows and events over the star schema."""

from pyspark.sql import functions as F

from sedimark.functions import scalars as S
from sedimark.operators import aggregates as A
from sedimark.operators import evaluation as V
from sedimark.operators import filters as P
from sedimark.operators import joins as J
from sedimark.operators import stats as T
from sedimark.operators import windows as W
from sedimark.plans.registry import query
from sedimark.streaming import events as X


def r(c, n=6, name=None):
    return F.round(c, n).alias(name or c)


def rounded(c, n=6):
    """A number of 0 or more, below 2**53 / 10**n, to n places, halves up: in binary, without the decimal text that round() makes of each
    value. For results of very many rows."""
    scaled = F.col(c) * 10.0**n
    whole = F.floor(scaled).cast("double")
    return ((whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**n).alias(c)


@query("SELECT o_orderpriority, count(*) AS n, count(o_totalprice) AS n_valid, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS sem FROM orders GROUP BY 1")
def stratum_means(spark, t):
    return A.group_means(t("orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", "n", "n_valid", r("mean"), r("sem"))


@query("""WITH a AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS v FROM customer GROUP BY ALL), b AS (SELECT c_mktsegment, avg(v) AS v FROM a GROUP BY 1) SELECT c_mktsegment, round(v, 6) AS c_acctbal FROM b""")
def mean_of_means(spark, t):
    return A.mean_of_means(t("customer"), [["c_nationkey", "c_mktsegment"], ["c_mktsegment"]], "c_acctbal").select("c_mktsegment", r("c_acctbal"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 3) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, t):
    d = t("lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 3).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P", count(*) AS total FROM orders GROUP BY 1""")
def crosstab(spark, t):
    return A.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS "F", round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY 1""")
def wide_pivot(spark, t):
    return A.wide(t("lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"], F.avg).select("l_returnflag", r("F"), r("O"))


@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) UNPIVOT (value FOR name IN (p_size, p_retailprice))")
def unpivot_long(spark, t):
    return A.long(t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, concat_ws(',', CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' END, CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' END) AS level
FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderstatus, o_orderpriority))""")
def grouping_sets(spark, t):
    return A.grouping_sets(t("orders"), [[], ["o_orderstatus"], ["o_orderstatus", "o_orderpriority"]], [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")])


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_counts(spark, t):
    return t("customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events GROUP BY 1")
def length_profile(spark, t):
    return A.summary(t("events"), ["event_type"], "value").select("event_type", "n", r("min"), r("median"), r("mean"), r("max"))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS q2_5, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.975), 6) AS q97_5 FROM events GROUP BY 1")
def exact_quantiles(spark, t):
    return A.quantiles(t("events"), ["event_type"], "value", [0.025, 0.5, 0.975]).select("event_type", r("q2_5"), r("q50"), r("q97_5"))


@query("SELECT c_custkey, max(o_totalprice) AS o_totalprice, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def arg_max_evidence(spark, t):
    j = t("customer").select("c_custkey").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    return A.best_evidence(j, ["c_custkey"], "o_totalprice", ["o_orderkey"], [])


@query("""SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def dimension_joins(spark, t):
    d = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def unmatched_left(spark, t):
    agg = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("best"))
    return t("customer").select("c_custkey").join(agg, "c_custkey", "left").fillna(0, ["n_orders"])


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_key(spark, t):
    return W.top_k(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def global_topk(spark, t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("SELECT event_type, event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rank FROM events")
def average_rank(spark, t):
    return W.average_rank(t("events").select("event_type", "event_id", "value"), ["event_type"], "value").select("event_type", "event_id", "rank")


@query("""SELECT user_id, event_id, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil(4 * (rn - 1) / (n - 1))) END::INT AS quartile FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def quartile(spark, t):
    return W.quartile(t("events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id").select("user_id", "event_id", "quartile")


@query("SELECT user_id, event_id, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value, event_id), 9) AS rank01 FROM events")
def normalised_rank(spark, t):
    return W.normalised_rank(t("events"), ["user_id"], ["value", "event_id"]).select("user_id", "event_id", r("rank01", 9))


@query("SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def z_score(spark, t):
    return W.z_score(t("events"), ["event_type"], "value").select("event_id", r("z"))


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(quantile_cont(value, 0.5) OVER w, 6) END AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_median(spark, t):
    return W.rolling_median(t("events"), ["user_id"], ["ts", "event_id"], "value", 5, 3).select("event_id", r("rolling"))


@query("SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM events")
def section_counter(spark, t):
    return W.sections(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "section")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM e)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS length FROM s GROUP BY ALL""")
def run_segmentation(spark, t):
    return W.run_table(t("events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def keep_last(spark, t):
    return W.keep_one(t("events").select("user_id", "event_id", "value", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""SELECT user_id, event_id, place::BIGINT AS place, "end" FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, 'head' AS "end" FROM events UNION ALL SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC), 'tail' FROM events) WHERE place <= 2""")
def head_and_tail(spark, t):
    return W.head_and_tail(t("events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 2).select("user_id", "event_id", F.col("place").cast("long").alias("place"), "end")


@query("SELECT event_id, round((sum(value) OVER w - value) / nullif(count(value) OVER w - 1, 0) + 1e-7, 4) AS mean_without FROM events WINDOW w AS (PARTITION BY user_id)")
def leave_one_out(spark, t):
    return W.leave_one_out(t("events"), ["user_id"], "value").select("event_id", F.round(F.col("mean_without") + 1e-7, 4).alias("mean_without"))


@query("SELECT event_id, round(CASE WHEN count(*) OVER w = 1 THEN value ELSE (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6) END, 5) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantage(spark, t):
    return W.standardised_advantage(t("events"), ["user_id"], "value").select("event_id", r("advantage", 5))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= greatest(1, n // 100)")
def smallest_percent(spark, t):
    return W.smallest_share(t("events"), ["event_type"], "value", "event_id").select("event_type", "event_id")


@query("SELECT event_type, median FROM (SELECT event_type, value AS median, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = n // 2")
def upper_median(spark, t):
    return V.upper_median(t("events"), ["event_type"], "value")


@query("""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders), e AS (SELECT user_id, ts::DATE::TIMESTAMP AS at, max(value) AS value FROM events GROUP BY ALL)
SELECT o_orderkey, (SELECT max_by(e.value, e.at) FROM e WHERE e.user_id = o.o_custkey AND e.at <= o.o_orderdate + INTERVAL 26 YEAR) AS asof_value FROM o""")
def as_of_join(spark, t):
    e = t("events").groupBy("user_id", F.to_date("ts").cast("timestamp_ntz").alias("at")).agg(F.max("value").alias("value"))
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("interval 26 years")).alias("at"))
    return J.as_of(o, e, ["user_id"], "at", ["value"]).select("o_orderkey", "asof_value")


@query("""SELECT a.event_id AS event_id, b.event_id AS span_id FROM (SELECT event_id, user_id, epoch(ts) AS tm FROM events) a JOIN (SELECT event_id, user_id, epoch(ts) AS s, epoch(ts) + 3600 AS e FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.tm >= b.s AND a.tm < b.e""")
def interval_join(spark, t):
    sec = F.col("ts").cast("timestamp").cast("double")
    e = t("events").select("event_id", "user_id", sec.alias("at"))
    spans = t("events").where("event_type = 'error'").select(F.col("event_id").alias("span_id"), "user_id", sec.alias("s"), (sec + 3600).alias("e"))
    return J.interval_join(e, spans, ["user_id"], "at", "s", "e", 3600.0).select("event_id", "span_id")


@query("""SELECT a.s_suppkey AS a_id, b.c_custkey AS b_id, round(sqrt(pow(a.s_acctbal - b.c_acctbal, 2) + pow(20.0 * (a.s_nationkey - b.c_nationkey), 2)), 6) AS distance FROM supplier a, customer b WHERE sqrt(pow(a.s_acctbal - b.c_acctbal, 2) + pow(20.0 * (a.s_nationkey - b.c_nationkey), 2)) <= 300""")
def spatial_join(spark, t):
    a = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 20.0).alias("y"))
    b = t("customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 20.0).alias("y"))
    return J.within_distance(a, b, 300.0, ("x", "y"), ("s_suppkey", "c_custkey")).select("a_id", "b_id", rounded("distance"))


@query("""SELECT DISTINCT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber - a.l_linenumber >= 3""")
def pair_range_join(spark, t):
    return J.pairs_within(t("lineitem"), "l_orderkey", "l_linenumber", 3)


@query("SELECT event_type, user_id, count(*) AS votes, round(sum(w), 4) AS weight FROM (SELECT event_type, user_id, ts::DATE AS d, max(value) AS w FROM events GROUP BY ALL) GROUP BY 1, 2")
def vote_counts(spark, t):
    return A.votes(t("events").withColumn("d", F.to_date("ts")), ["event_type", "user_id"], "d", "value").withColumn("weight", F.round("weight", 4))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def value_frequencies(spark, t):
    return A.frequencies(t("events"), "event_type").withColumn("share", F.round("share", 9))


@query("SELECT count(DISTINCT o_custkey) AS left_covered, count(DISTINCT l_partkey) AS right_covered FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def two_ended_coverage(spark, t):
    return A.two_ended_coverage(t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "l_partkey")


@query("""SELECT * FROM (SELECT 'all' AS subset, count(*) AS n FROM orders UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'dear', count(*) FROM orders WHERE o_totalprice > 250000)""")
def overlapping_subsets(spark, t):
    d = A.overlapping(t("orders"), [("all", F.lit(True)), ("urgent", F.col("o_orderpriority") == "1-URGENT"), ("dear", F.col("o_totalprice") > 250000)])
    return d.groupBy("subset").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END AS bucket FROM events")
def bucket_labels(spark, t):
    return t("events").select("event_id", S.bucket_label(F.col("value"), [5, 20], ["low", "mid", "high"]).alias("bucket"))


@query("SELECT event_id, band FROM (SELECT event_id, unnest(list_filter([CASE WHEN value >= 0 THEN 'all' END, CASE WHEN value >= 5 AND value < 20 THEN 'mid' END, CASE WHEN value >= 20 THEN 'high' END], lambda x: x IS NOT NULL)) AS band FROM events)")
def band_filter(spark, t):
    return P.with_bands(t("events").select("event_id", "value"), "value", [("all", 0, None), ("mid", 5, 20), ("high", 20, None)]).select("event_id", "band")


@query("SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) / sum(value), 6) AS rate, count(*) AS n FROM events GROUP BY 1")
def ratio_of_sums(spark, t):
    return t("events").groupBy("user_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)) / F.sum("value"), 6).alias("rate"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, t):
    return X.tumbling(t("events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1""")
def sliding_windows(spark, t):
    return X.sliding(t("events"), "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r("mean"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, t):
    return X.sessions(t("events"), "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, t):
    """The tumbling windows as a stream over all files there are, with a watermark."""
    import uuid

    src = t("events")
    path = src.inputFiles()[0].rsplit("/", 1)
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", path[1]).parquet(path[0]).withColumn("ts", F.col("ts").cast("timestamp"))
    return X.drain(X.tumbling(stream, "1 hour", "1 day"), f"stream_{uuid.uuid4().hex}", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT model_a, model_b, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS delta, round(stddev_samp(a - b) / sqrt(count(*)), 6) AS sem, round(avg((a > b)::INT), 6) AS win_rate, round(avg((a = b)::INT), 6) AS tie_rate FROM
(SELECT x.event_type AS model_a, y.event_type AS model_b, x.v AS a, y.v AS b FROM (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) x JOIN (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) y ON x.user_id = y.user_id AND x.event_type < y.event_type) GROUP BY 1, 2""")
def paired_model_deltas(spark, t):
    v = t("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return T.paired_difference(v, "user_id", "event_type", "v").select("model_a", "model_b", "n", *[r(c) for c in ("mean_a", "mean_b", "delta", "sem", "win_rate", "tie_rate")])


@query("""WITH d AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2 AS ry FROM d)
SELECT l_returnflag, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM k GROUP BY 1""")
def spearman(spark, t):
    return T.spearman(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "n", r("rho", 8))


@query("""WITH k AS (SELECT o_orderpriority, (o_orderstatus = 'F')::INT AS l, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 AS rk FROM orders)
SELECT o_orderpriority, sum(l)::BIGINT AS n_pos, sum(1 - l)::BIGINT AS n_neg, round((sum(rk * l) - sum(l) * (sum(l) + 1) / 2) / (sum(l) * sum(1 - l)), 8) AS auc FROM k GROUP BY 1""")
def auc_mann_whitney(spark, t):
    d = t("orders").withColumn("done", F.col("o_orderstatus") == "F")
    return T.auc(d, ["o_orderpriority"], "o_totalprice", "done").select("o_orderpriority", "n_pos", "n_neg", r("auc", 8))


@query("""WITH p AS (SELECT event_type, round(avg(value) / 100, 9) AS p FROM events GROUP BY 1) SELECT event_type, p, round(least(p * count(*) OVER () / row_number() OVER (ORDER BY p, event_type), 1), 9) AS q FROM p""")
def adjusted_p_values(spark, t):
    p = t("events").groupBy("event_type").agg(F.round(F.avg("value") / 100, 9).alias("p"))
    return T.adjusted_p(p, "p", ["event_type"]).withColumn("q", F.round("q", 9))


@query("""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS estimate, round(sum(l_quantity), 3) AS "precision" FROM lineitem GROUP BY 1""")
def precision_weighted(spark, t):
    return T.precision_weighted(t("lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_returnflag", r("estimate", 4), r("precision", 3))


@query("""WITH e AS (SELECT event_type, event_id, weight FROM (SELECT event_type, event_id, exp(-(value - min(value) OVER w) / 10) AS e, sum(exp(-(value - mv) / 10)) OVER w AS s, exp(-(value - mv) / 10) / sum(exp(-(value - mv) / 10)) OVER w AS weight FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS mv FROM events) WINDOW w AS (PARTITION BY event_type))) SELECT event_type, event_id, round(weight, 10) AS weight FROM e""")
def softmax_weights(spark, t):
    return A.softmax_weights(t("events"), ["event_type"], "value", 10.0).select("event_type", "event_id", r("weight", 10))
