"""Evaluation analytics (V and M operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.operators.stats import correlation
from sedimark.operators.windows import least_rows


def select_best(runs: DataFrame, keys: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """Best run per key; the first in order wins ties. A best run whose file is missing raises, it isn't replaced."""
    best = runs.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *order))).where("__r = 1").drop("__r")
    if "has_file" in runs.columns:
        best = best.withColumn("has_file", F.when(F.col("has_file"), True).otherwise(F.raise_error("the best run has no file")))
    return best


def candidate_universe(entities: DataFrame, least_gap: int, most_gap: int | None = None) -> DataFrame:
    """(entity, i, j) of all candidate pairs of each entity of length `length`."""
    i = entities.where(F.col("length") > least_gap).select("entity", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1 - least_gap)).alias("i"))
    last = F.col("length") - 1 if most_gap is None else F.least(F.col("length") - 1, F.col("i") + most_gap)
    return i.select("entity", "i", F.explode(F.sequence(F.col("i") + least_gap, last)).alias("j"))


def vote_ranking(universe: DataFrame, votes: DataFrame) -> DataFrame:
    """Every candidate with its votes (0 if none; votes outside the universe are left out) and its rank: votes descending,
    then i, j."""
    v = universe.join(votes, ["entity", "i", "j"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    return v.withColumn("rank", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("votes"), "i", "j")))


def r_precision(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(entity, n_true, r_precision): share of true pairs among the first n_true; NaN without candidates or truth."""
    t = truth.select("entity", "i", "j").distinct()
    n = t.groupBy("entity").agg(F.count("*").alias("n_true"))
    hit = ranked.join(t.withColumn("__t", F.lit(1)), ["entity", "i", "j"], "left").join(n, "entity", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    inside = F.col("rank") <= F.col("n_true")
    value = F.try_divide(F.sum(F.when(inside & F.col("__t").isNotNull(), 1).otherwise(0)), F.sum(F.when(inside, 1).otherwise(0)))
    return hit.groupBy("entity", "n_true").agg(F.when(F.sum(F.when(inside, 1).otherwise(0)) > 0, value).otherwise(float("nan")).alias("r_precision"))


def loo_marginals(universe: DataFrame, ballots: DataFrame, truth: DataFrame) -> DataFrame:
    """(entity, voter, marginal): R-precision of all voters less that without the voter. Every voter's absence is a ranking of
    its own: votes less the voter's own ballot."""
    once = ballots.select("entity", "voter", "i", "j").distinct()
    total = once.groupBy("entity", "i", "j").agg(F.count("*").alias("votes"))
    full = r_precision(vote_ranking(universe, total), truth).select("entity", F.col("r_precision").alias("__all"))
    voters = once.select("entity", "voter").distinct()
    each = total.join(voters, "entity").join(once.withColumn("__own", F.lit(1)), ["entity", "voter", "i", "j"], "left")
    each = each.select(F.struct("entity", "voter").alias("entity"), "i", "j", (F.col("votes") - F.coalesce("__own", F.lit(0))).alias("votes"))
    many = universe.join(voters, "entity").select(F.struct("entity", "voter").alias("entity"), "i", "j")
    t = truth.select("entity", "i", "j").distinct().join(voters, "entity").select(F.struct("entity", "voter").alias("entity"), "i", "j")
    without = r_precision(vote_ranking(many, each), t).select("entity.entity", "entity.voter", F.col("r_precision").alias("__w"))
    return without.join(full, "entity").select("entity", "voter", (F.col("__all") - F.col("__w")).alias("marginal"))


def group_diagnostics(ballots: DataFrame) -> DataFrame:
    """(entity, n_voters, union_size, mean_jaccard, vote_entropy): agreement of the voters of each entity."""
    once = ballots.select("entity", "voter", "i", "j").distinct()
    sizes = once.groupBy("entity", "voter").agg(F.count("*").alias("n"))
    a, b = sizes.select("entity", F.col("voter").alias("va"), F.col("n").alias("na")), sizes.select("entity", F.col("voter").alias("vb"), F.col("n").alias("nb"))
    pairs = a.join(b, "entity").where("va < vb")
    x, y = once.select("entity", F.col("voter").alias("va"), "i", "j"), once.select("entity", F.col("voter").alias("vb"), "i", "j")
    common = x.join(y, ["entity", "i", "j"]).where("va < vb").groupBy("entity", "va", "vb").agg(F.count("*").alias("c"))
    jac = pairs.join(common, ["entity", "va", "vb"], "left").fillna(0, ["c"]).groupBy("entity").agg(F.avg(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("mean_jaccard"))
    votes = once.groupBy("entity", "i", "j").agg(F.count("*").alias("v"))
    share = F.col("v") / F.sum("v").over(W.partitionBy("entity"))
    ent = votes.withColumn("p", share).groupBy("entity").agg(F.count("*").alias("union_size"), (-F.sum(F.col("p") * F.log("p"))).alias("vote_entropy"))
    return sizes.groupBy("entity").agg(F.count("*").alias("n_voters")).join(ent, "entity").join(jac, "entity", "left")


def likelihood_selection(df: DataFrame, target: str, loss: str, quality: str, tie: str) -> DataFrame:
    """Per target: quality of the least loss, best of the lowest 1 % of losses, mean, oracle, and the gap closed by selection."""
    whole = df.groupBy(target).agg(F.min_by(quality, F.struct(loss, tie)).alias("selected"), F.avg(quality).alias("mean"), F.max(quality).alias("oracle"))
    below, at = least_rows(df, [target], loss, tie)
    best = below.select(target, quality).unionByName(at.select(target, quality)).groupBy(F.col(target).alias("__k")).agg(F.max(quality).alias("best_1pct"))
    g = whole.join(best, F.col(target).eqNullSafe(F.col("__k"))).select(target, "selected", "best_1pct", "mean", "oracle")
    return g.withColumn("gap_closed", F.try_divide(F.col("selected") - F.col("mean"), F.col("oracle") - F.col("mean")))


def ratio_bias(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Of y / x: mean, p10, p50, p90, shares below .5 and from .8 on; correlation and least-squares slope of the ratio on x."""
    r = F.try_divide(F.col(y), F.col(x))
    d = df.withColumn("__q", r).where("__q is not null")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__q").alias("mean"), *[F.percentile("__q", F.lit(p / 100)).alias(f"p{p}") for p in (10, 50, 90)], F.avg((F.col("__q") < 0.5).cast("double")).alias("below_half"), F.avg((F.col("__q") >= 0.8).cast("double")).alias("from_080"), correlation(x, "__q").alias("corr"), F.try_divide(F.covar_pop(x, "__q"), F.var_pop(x)).alias("slope"))


def throughput(df: DataFrame, keys: Sequence[str], amount: str, seconds: str, full: float) -> DataFrame:
    """Ratio of sums (not the mean of ratios), and the seconds a full run would take."""
    rate = F.sum(amount) / F.sum(seconds)
    return df.groupBy(*keys).agg(rate.alias("rate"), (F.lit(full) / rate).alias("projected_seconds"))


def band_scores(predicted: DataFrame, truth: DataFrame, bands: Sequence[tuple[str, int, int | None]]) -> DataFrame:
    """(entity, band, precision, recall, f1): no truth in the band NaN, no prediction 0."""
    from sedimark.operators.filters import with_bands

    both = predicted.select("entity", "i", "j").distinct().withColumn("p", F.lit(1)).join(truth.select("entity", "i", "j").distinct().withColumn("t", F.lit(1)), ["entity", "i", "j"], "full")
    d = with_bands(both.withColumn("gap", F.col("j") - F.col("i")), "gap", bands)
    names = d.select("entity").distinct().withColumn("band", F.explode(F.array(*[F.lit(b[0]) for b in bands])))
    g = d.groupBy("entity", "band").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("hit"))
    g = names.join(g, ["entity", "band"], "left").fillna(0)
    score = lambda n, m: F.when(F.col("nt") == 0, float("nan")).when(m == 0, 0.0).otherwise(F.try_divide(n, m))
    return g.select("entity", "band", score(F.col("hit"), F.col("np")).alias("precision"), score(F.col("hit"), F.col("nt")).alias("recall"), score(2 * F.col("hit"), F.col("np") + F.col("nt")).alias("f1"))


def leaderboard(df: DataFrame, model: str, unit: str, value: str, n_units: int) -> DataFrame:
    """Models that cover all units, by mean, with their place."""
    g = df.groupBy(model).agg(F.avg(value).alias("mean"), F.count_distinct(unit).alias("n")).where(F.col("n") == n_units)
    return g.withColumn("place", F.rank().over(W.orderBy(F.desc("mean"))))


def depth_breakdown(df: DataFrame, depth: str, value: str, most: int = 5, support: int = 20) -> DataFrame:
    """Mean by depth 1..most (the last open), only with enough rows."""
    return df.groupBy(F.least(F.col(depth), F.lit(most)).alias("depth")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= support)


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The element at n // 2 (from 0) of the sorted values: not interpolated."""
    w = W.partitionBy(*keys)
    d = df.where(F.col(value).isNotNull()).withColumns({"__r": F.row_number().over(w.orderBy(value)) - 1, "__n": F.count("*").over(w)})
    return d.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(*keys, F.col(value).alias("median"))


def label_audit(df: DataFrame, old: str, new: str, by: str) -> DataFrame:
    """Per value of `by` and in TOTAL: n, changed, gained (old false, new true) and lost."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.rollup(by).agg(F.count("*").alias("n"), n(~F.col(old).eqNullSafe(F.col(new))).alias("changed"), n(~F.col(old) & F.col(new)).alias("gained"), n(F.col(old) & ~F.col(new)).alias("lost"), F.grouping(by).alias("__g"))
    return out.withColumn(by, F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col(by))).drop("__g")


def status(records: DataFrame, scores: DataFrame, key: str, value: str) -> DataFrame:
    """ok, empty (scored without a value) or missing, per record."""
    s = scores.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lit(1).alias("__s"))
    return records.join(s, F.col(key) == F.col("__k"), "left").withColumn("status", F.when(F.col("__s").isNull(), "missing").when(F.col("__v").isNull(), "empty").otherwise("ok")).drop("__k", "__v", "__s")


def refuse_split_entities(df: DataFrame, entity: str, part: str) -> DataFrame:
    """df, or an error if an entity is in two parts."""
    if not df.groupBy(entity).agg(F.count_distinct(part).alias("n")).where("n > 1").limit(1).isEmpty():
        raise ValueError(f"a {entity} is in more than one {part}")
    return df


def output_audit(df: DataFrame, key: str, shard: str, n_shards: int, expected: int, dropped: DataFrame) -> dict[str, int]:
    """missing shards, row surplus, survivors of the drop list and repeated keys of a published table; raises if any isn't 0."""
    row = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("k"), F.count_distinct(shard).alias("s")).first()
    found = {"missing_shards": n_shards - row.s, "surplus": row.n - expected, "repeated": row.n - row.k, "survivors": df.join(dropped.select(key), key, "left_semi").count()}
    if any(found.values()):
        raise ValueError(f"the output is not as it should be: {found}")
    return found


def _edit_steps(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Statements as (key, i, j, n, contact, gone, distance): gone where a live pair is taken back, distance the statements since its
    last emission. A pair is live if its statement before this one was a contact."""
    e = events.select(key, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), (F.col("kind") == "contact").alias("contact"), F.row_number().over(W.partitionBy(key).orderBy(*order)).alias("n"))
    w = W.partitionBy(key, "i", "j").orderBy("n")
    gone = ~F.col("contact") & F.coalesce(F.lag("contact").over(w), F.lit(False))
    return e.withColumns({"gone": gone, "before": F.lag("n").over(w)}).withColumn("distance", F.when(F.col("gone"), F.col("n") - F.col("before"))).drop("before")


def diagnose_edits(events: DataFrame, truth: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Per document: statements, contacts, retracts, those of pairs that weren't live (absent), pairs kept and pairs retracted at any
    time, true and false, and the mean distance of a live retract from the emission it takes back. A pair emitted again after
    a retract still counts as retracted."""
    e = _edit_steps(events, key, order)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = e.groupBy(key).agg(F.count("*").alias("n_statements"), n(F.col("contact")).alias("n_contacts"), n(~F.col("contact")).alias("n_retracts"), n(F.col("gone")).alias("n_retracted"), n(~F.col("contact") & ~F.col("gone")).alias("absent_retracts"), F.avg("distance").alias("distance"))
    pairs = e.groupBy(key, "i", "j").agg(F.bool_or("contact").alias("__c"), F.bool_or("gone").alias("__g")).where("__c")
    pairs = pairs.join(truth.select(key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().withColumn("__t", F.lit(True)), [key, "i", "j"], "left")
    t, g = F.col("__t").isNotNull(), F.col("__g")
    kinds = pairs.groupBy(key).agg(n(~g & t).alias("kept_tp"), n(~g & ~t).alias("kept_fp"), n(g & t).alias("retracted_tp"), n(g & ~t).alias("retracted_fp"))
    return counts.join(kinds, key, "left").fillna(0, ["kept_tp", "kept_fp", "retracted_tp", "retracted_fp"])


def edit_distances(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(distance, n): how many live retracts lie that many statements after the emission."""
    return _edit_steps(events, key, order).where("gone").groupBy("distance").agg(F.count("*").alias("n"))


def retraction_summary(diagnoses: DataFrame, distances: DataFrame, recovered: DataFrame | None = None) -> DataFrame:
    """One row over all documents, ratios of sums throughout: share of documents with a retract, base rate of false pairs, precision and
    recall of retracts, enrichment (precision over base rate), mean and upper-middle median distance, share of immediate retracts
    (distance 1 at most), and with `recovered` (n_recoveries by document) the recovery rate. NaN where a divisor is 0."""
    s = {c: F.sum(c) for c in ("kept_tp", "kept_fp", "retracted_tp", "retracted_fp", "n_retracted", "absent_retracts")}
    false, taken = s["kept_fp"] + s["retracted_fp"], s["retracted_fp"] + s["retracted_tp"]
    emitted = false + s["kept_tp"] + s["retracted_tp"]
    nan = lambda x: F.coalesce(x, F.lit(float("nan")))
    precision, base = F.try_divide(s["retracted_fp"], taken), F.try_divide(false, emitted)
    out = diagnoses.agg(
        F.count("*").alias("n_documents"), F.avg((F.col("n_retracts") > 0).cast("double")).alias("share_with_retract"), F.avg("n_retracts").alias("mean_retracts"), F.avg("n_contacts").alias("mean_contacts"), emitted.alias("n_emitted"),
        nan(base).alias("base_rate"), nan(precision).alias("precision"), nan(F.try_divide(s["retracted_fp"], false)).alias("recall"), nan(F.try_divide(precision, base)).alias("enrichment"), s["retracted_tp"].alias("retracted_tp"), s["n_retracted"].alias("n_retracted"), s["absent_retracts"].alias("absent_retracts"),
    )
    w = W.orderBy("distance")  # a row per distinct distance
    d = distances.withColumns({"__below": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), "__all": F.sum("n").over(W.partitionBy())})
    far = d.agg(nan(F.try_divide(F.sum(F.col("distance") * F.col("n")), F.sum("n"))).alias("mean_distance"), F.min(F.when(F.col("__below") > F.floor(F.col("__all") / 2), F.col("distance"))).alias("median_distance"), nan(F.try_divide(F.sum(F.when(F.col("distance") <= 1, F.col("n")).otherwise(0)), F.sum("n"))).alias("immediate_share"))
    out = out.join(far, F.lit(True))  # one row each
    if recovered is None:
        return out
    return out.join(recovered.agg(F.sum("n_recoveries").alias("__r")), F.lit(True)).withColumn("recovery_rate", nan(F.try_divide("__r", "n_retracted"))).drop("__r")


def recoveries(events: DataFrame, truth: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, n_recoveries): each true contact, in order, makes good the first retract before it that is still open and shares a
    residue with it, the same pair's own included. Only live retracts open one. A fold over the document's statements."""
    e = _edit_steps(events, key, order).where(F.col("contact") | F.col("gone"))
    t = truth.select(key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().withColumn("__t", F.lit(True))
    e = e.join(t, [key, "i", "j"], "left").where(F.col("gone") | F.col("__t"))
    steps = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "gone", "i", "j"))).alias("steps"))
    none = F.struct(F.array().cast("array<struct<i:int,j:int>>").alias("open"), F.lit(0).cast("long").alias("done"))

    def fold(acc, x):
        meets = lambda p: (p["i"] == x["i"]) | (p["j"] == x["j"]) | (p["i"] == x["j"]) | (p["j"] == x["i"])
        at = F.array_position(F.transform(acc["open"], meets), True).cast("int")
        rest = F.concat(F.slice(acc["open"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(acc["open"], at + 1, F.greatest(F.size(acc["open"]) - at, F.lit(0))))
        opened = F.concat(acc["open"], F.array(F.struct(x["i"].cast("int").alias("i"), x["j"].cast("int").alias("j"))))
        return F.when(x["gone"], F.struct(opened.alias("open"), acc["done"].alias("done"))).when(at > 0, F.struct(rest.alias("open"), (acc["done"] + 1).alias("done"))).otherwise(acc)

    names = events.select(key).distinct()
    return names.join(steps.select(key, F.aggregate("steps", none, fold, lambda acc: acc["done"]).alias("n_recoveries")), key, "left").fillna(0, ["n_recoveries"])


def contact_features(contacts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per entity: n, relative contact order, shares of short, medium and long range, median gap; NaN without contacts."""
    c = contacts.withColumn("gap", F.col("j") - F.col("i"))
    g = c.groupBy("entity").agg(F.count("*").alias("n"), F.avg("gap").alias("__m"), *[F.avg(cond.cast("double")).alias(n) for n, cond in (("short", F.col("gap") < 12), ("medium", F.col("gap").between(12, 23)), ("long", F.col("gap") >= 24))], F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    nan = F.lit(float("nan"))
    return lengths.join(g, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("__m") / F.col("length"), nan).alias("relative_order"), *[F.coalesce(c_, nan).alias(c_) for c_ in ("short", "medium", "long", "median_gap")])


def mechanism(df: DataFrame, steps: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    """n and share of each first-match class, classes without rows included."""
    out = F.lit(otherwise)
    for name, c in reversed(list(steps)):
        out = F.when(c, name).otherwise(out)
    counts = df.groupBy(out.alias("class")).agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(n,) for n, _ in steps] + [(otherwise,)], "class string")
    return names.join(counts, "class", "left").fillna(0, ["n"]).withColumn("share", F.try_divide("n", F.sum("n").over(W.partitionBy())))
