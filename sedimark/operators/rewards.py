"""Rewards and selection over sections and rollouts (W, F, M and V operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.operators.evaluation import r_precision, vote_ranking
from sedimark.operators.filters import with_bands
from sedimark.operators.stats import spearman


def prefix_marginals(universe: DataFrame, sections: DataFrame, truth: DataFrame) -> DataFrame:
    """(entity, rollout, k, marginal): R-precision of the votes of sections 0 to k less that of sections 0 to k - 1, the empty prefix
    scoring 0; 0 throughout where nothing can be scored. sections: entity, rollout, k, i, j. Each prefix is a ranking of its own: a
    section's vote counts from its k on."""
    once = sections.select("entity", "rollout", "k", "i", "j").distinct()
    steps = once.select("entity", "rollout", "k").distinct()
    last = steps.groupBy("entity", "rollout").agg(F.max("k").alias("last"))
    votes = once.join(last, ["entity", "rollout"]).select("entity", "rollout", "i", "j", F.explode(F.sequence("k", "last")).alias("k")).groupBy("entity", "rollout", "k", "i", "j").agg(F.count("*").alias("votes"))
    key = F.struct("entity", "rollout", "k").alias("entity")
    many = universe.join(steps, "entity").select(key, "i", "j")
    true = truth.select("entity", "i", "j").distinct().join(universe, ["entity", "i", "j"], "left_semi")  # pairs outside the universe can't be found
    ranked = vote_ranking(many, votes.select(key, "i", "j", "votes"))
    score = r_precision(ranked, true.join(steps, "entity").select(key, "i", "j"))
    score = steps.join(score.select("entity.entity", "entity.rollout", "entity.k", F.nanvl("r_precision", F.lit(0.0)).alias("c")), ["entity", "rollout", "k"], "left").fillna(0.0, ["c"])
    w = W.partitionBy("entity", "rollout").orderBy("k")
    return score.select("entity", "rollout", "k", (F.col("c") - F.coalesce(F.lag("c").over(w), F.lit(0.0))).alias("marginal"))


def positional_baseline(marginals: DataFrame, group: Sequence[str], position: str, value: str) -> DataFrame:
    """(group, position, baseline): the mean over the rollouts that reach the position."""
    return marginals.groupBy(*group, position).agg(F.avg(value).alias("baseline"))


def centred(marginals: DataFrame, group: Sequence[str], position: str, value: str) -> DataFrame:
    """marginals with `centred`: the value less its position's baseline in the group."""
    return marginals.join(positional_baseline(marginals, group, position, value), [*group, position]).withColumn("centred", F.col(value) - F.col("baseline")).drop("baseline")


def section_f1(sections: DataFrame, truth: DataFrame) -> DataFrame:
    """(entity, rollout, k, n, f1) of each section's pairs against the truth; 0 without pairs or truth in common."""
    once = sections.select("entity", "rollout", "k", "i", "j").distinct()
    t = truth.select("entity", "i", "j").distinct().withColumn("__t", F.lit(1))
    size = t.groupBy("entity").agg(F.count("*").alias("__n"))
    g = once.join(t, ["entity", "i", "j"], "left").groupBy("entity", "rollout", "k").agg(F.count("*").alias("n"), F.count("__t").alias("__h"))
    return g.join(size, "entity", "left").select("entity", "rollout", "k", "n", F.coalesce(F.try_divide(2.0 * F.col("__h"), F.col("n") + F.col("__n")), F.lit(0.0)).alias("f1"))


def consensus_scores(sections: DataFrame, truth: DataFrame, mode: str) -> DataFrame:
    """(entity, rollout, i, j, score) under one rule: `consensus` votes over the sections, or 1 for the pairs of one section: `last`,
    `second_last` (the last where there is one only), `best` (the highest F1 by the truth, an oracle; the first wins ties)."""
    once = sections.select("entity", "rollout", "k", "i", "j").distinct()
    if mode == "consensus":
        return once.groupBy("entity", "rollout", "i", "j").agg(F.count("*").cast("double").alias("score"))
    if mode == "best":
        pick = section_f1(sections, truth).groupBy("entity", "rollout").agg(F.max_by("k", F.struct("f1", -F.col("k"))).alias("k"))
    elif mode in ("last", "second_last"):
        ks = F.array_sort(F.collect_set("k"))
        back = F.lit(-1) if mode == "last" else -F.least(F.size("__k"), F.lit(2))
        pick = once.groupBy("entity", "rollout").agg(ks.alias("__k")).select("entity", "rollout", F.element_at("__k", back).alias("k"))  # a rollout's sections
    else:
        raise ValueError(mode)
    return once.join(pick, ["entity", "rollout", "k"], "left_semi").select("entity", "rollout", "i", "j", F.lit(1.0).alias("score"))


def oracle_rollouts(predictions: DataFrame, truth: DataFrame, bands: Sequence[tuple[str, int, int | None]]) -> DataFrame:
    """(entity, band, n_true, r_oracle, rollout): the rollout whose first n_true predictions of a band are most often true (share of those
    it has), the smaller one on ties; 0 and rollout -1 where none has a hit, NaN where a band has no truth. predictions: entity,
    rollout, rank, i, j; bands by j - i, upper ends open."""
    gap = lambda d: with_bands(d.withColumn("gap", F.col("j") - F.col("i")), "gap", bands)
    t = truth.select("entity", "i", "j").distinct()
    n = gap(t).groupBy("entity", "band").agg(F.count("*").alias("n_true"))
    cells = predictions.select("entity").union(t.select("entity")).distinct().withColumn("band", F.explode(F.array(*[F.lit(b[0]) for b in bands]))).join(n, ["entity", "band"], "left").fillna(0, ["n_true"])
    p = gap(predictions).withColumn("__r", F.row_number().over(W.partitionBy("entity", "band", "rollout").orderBy("rank", "i", "j"))).join(n, ["entity", "band"]).where("__r <= n_true")
    hit = p.join(t.withColumn("__t", F.lit(1)), ["entity", "i", "j"], "left").groupBy("entity", "band", "rollout").agg((F.count("__t") / F.count("*")).alias("precision"))
    best = hit.where("precision > 0").groupBy("entity", "band").agg(F.max_by(F.struct("precision", "rollout"), F.struct("precision", -F.col("rollout"))).alias("b"))
    out = cells.join(best, ["entity", "band"], "left")
    return out.select("entity", "band", "n_true", F.when(F.col("n_true") == 0, float("nan")).otherwise(F.coalesce("b.precision", F.lit(0.0))).alias("r_oracle"), F.coalesce("b.rollout", F.lit(-1)).alias("rollout"))


def selection_study(df: DataFrame, entity: str, metric: str, quality: str, tie: str, least_rows: int = 8, least_values: int = 3) -> tuple[DataFrame, DataFrame]:
    """(per entity: rho of metric and quality, quality of the least metric, mean, oracle, worst; one summary row: n, mean rho, share of
    negative rho, mean gain of selection and of the oracle over the mean). Entities with fewer rows or distinct metric values are
    left out."""
    d = df.where(F.col(metric).isNotNull() & F.col(quality).isNotNull())
    fit = d.groupBy(entity).agg(F.count("*").alias("__n"), F.count_distinct(metric).alias("__v"), F.min_by(quality, F.struct(metric, tie)).alias("selected"), F.avg(quality).alias("mean"), F.max(quality).alias("oracle"), F.min(quality).alias("worst")).where((F.col("__n") >= least_rows) & (F.col("__v") >= least_values)).drop("__n", "__v")
    rho = spearman(d.join(fit.select(entity), entity, "left_semi"), [entity], metric, quality).select(entity, "rho")
    each = fit.join(rho, entity)
    known = F.when(~F.isnan("rho"), F.col("rho"))
    total = each.agg(F.count("*").alias("n"), F.avg(known).alias("mean_rho"), F.avg(F.when(known < 0, 1.0).otherwise(0.0)).alias("share_negative"), F.avg(F.col("selected") - F.col("mean")).alias("selection_gain"), F.avg(F.col("oracle") - F.col("mean")).alias("oracle_gain"))
    return each, total


def sibling_similarity(ballots: DataFrame) -> DataFrame:
    """(entity, voter, mean_similarity): mean Jaccard similarity of a voter's pairs to each sibling's; null for a lone voter. Only pairs of
    voters that share an item meet; others add 0."""
    once = ballots.select("entity", "voter", "i", "j").distinct()
    size = once.groupBy("entity", "voter").agg(F.count("*").alias("n"))
    others = size.groupBy("entity").agg(F.count("*").alias("__all"))
    left, right = once, once.select("entity", "i", "j", F.col("voter").alias("other"))
    common = left.join(right, ["entity", "i", "j"]).where("voter <> other").groupBy("entity", "voter", "other").agg(F.count("*").alias("c"))
    jac = common.join(size, ["entity", "voter"]).join(size.select("entity", F.col("voter").alias("other"), F.col("n").alias("m")), ["entity", "other"])
    total = jac.groupBy("entity", "voter").agg(F.sum(F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("s"))
    out = size.join(others, "entity").join(total, ["entity", "voter"], "left")
    return out.select("entity", "voter", F.when(F.col("__all") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("__all") - 1)).alias("mean_similarity"))
