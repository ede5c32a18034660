"""Queries of corpus construction, curation, decontamination and sampling."""

from pyspark.sql import functions as F

from sedimark.functions import scalars as S
from sedimark.operators import aggregates as A
from sedimark.operators import evaluation as V
from sedimark.operators import filters as P
from sedimark.operators import joins as J
from sedimark.operators import sampling as R
from sedimark.operators import setops as U
from sedimark.operators import similarity as N
from sedimark.operators import windows as W
from sedimark.plans.registry import query

MANIFEST = "SELECT doc_id, source, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 20000 AND source IS NOT NULL"


def manifest(t):
    return P.between_not_null(t("documents").select("doc_id", "source", "n_chars"), "n_chars", 200, 20000, "source")


@query(f"""WITH m AS ({MANIFEST}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS round, count(*) OVER (PARTITION BY source) AS cluster_size FROM m)
SELECT source, doc_id, n_chars, round, cluster_size FROM r WHERE cluster_size >= 3 AND round < 5""")
def round_selection(spark, t):
    return W.select_rounds(manifest(t), "source", "n_chars", "doc_id", 3, 5).select("source", "doc_id", "n_chars", F.col("round").cast("long").alias("round"), "cluster_size")


@query(f"""WITH m AS ({MANIFEST}), s AS (SELECT source, count(*) AS n FROM m GROUP BY source)
SELECT count(*) FILTER (WHERE n >= 45) AS kept_clusters, count(*) FILTER (WHERE n < 45) AS dropped_clusters, sum(n)::BIGINT AS usable_rows, (sum(n) FILTER (WHERE n >= 45))::BIGINT AS rows_in_kept FROM s""")
def selection_stats(spark, t):
    n = F.col("n")
    s = manifest(t).groupBy("source").agg(F.count("*").alias("n"))
    return s.agg(F.count(F.when(n >= 45, 1)).alias("kept_clusters"), F.count(F.when(n < 45, 1)).alias("dropped_clusters"), F.sum("n").alias("usable_rows"), F.sum(F.when(n >= 45, n)).alias("rows_in_kept"))


RULES = "CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars > 10000 THEN 'long' WHEN lang <> 'en' THEN 'language' WHEN source = 'src0' THEN 'source' END"


def rules():
    return [("short", F.col("n_chars") < 100), ("long", F.col("n_chars") > 10000), ("language", F.col("lang") != "en"), ("source", F.col("source") == "src0")]


@query(f"SELECT coalesce({RULES}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_reason_cascade(spark, t):
    return P.reason_tally(P.first_reason(t("documents"), rules()))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN n_chars > 10000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN source = 'src0' THEN 'source' END], lambda x: x IS NOT NULL)) AS reason FROM documents) GROUP BY 1""")
def drop_funnel(spark, t):
    return A.reasons_funnel(P.all_reasons(t("documents"), rules()), "reasons")


SEED = "('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT"


@query(f"SELECT doc_id, {SEED} AS seed, CASE WHEN {SEED} % 1000 < 100 THEN 'test' WHEN {SEED} % 1000 < 250 THEN 'val' ELSE 'train' END AS split FROM documents")
def split_by_hash(spark, t):
    return t("documents").select("doc_id", S.key_seed(F.col("doc_id")).alias("seed"), S.split_label(F.col("doc_id"), 150, 100).alias("split"))


@query("SELECT d.doc_id, sha1(text) AS text_sha1, n_copies, first_key FROM documents d JOIN (SELECT sha1(text) AS h, count(*) AS n_copies, min(doc_id) AS first_key FROM documents GROUP BY 1) g ON sha1(d.text) = g.h")
def exact_dedup(spark, t):
    return U.exact_duplicates(t("documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 2")
def group_dedup_best(spark, t):
    return U.best_per_group(t("documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.desc("n_chars"), "doc_id"], 2)


GRAMS = """words AS (SELECT {k} AS k, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {t}),
{n} AS (SELECT DISTINCT k, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM words) WHERE len(w) >= 5)"""
OVERLAP = f"""WITH a AS (WITH {GRAMS.format(k='doc_id', t='documents', n='g')} SELECT * FROM g), b AS (WITH {GRAMS.format(k='item_id', t='benchmark', n='g')} SELECT * FROM g),
s AS (SELECT k, count(*) AS n FROM b GROUP BY k),
hits AS (SELECT a.k AS doc_id, b.k AS item_id, count(*) AS shared, count(*) / max(s.n) AS coverage FROM a JOIN b ON a.gram = b.gram JOIN s ON s.k = b.k GROUP BY 1, 2)"""


def overlap(t):
    return N.gram_overlap(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text", 5)


@query(OVERLAP + " SELECT doc_id, item_id, shared, round(coverage, 9) AS coverage FROM hits")
def decontam_ngram_overlap(spark, t):
    return overlap(t).select("doc_id", "item_id", "shared", F.round("coverage", 9).alias("coverage"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0")
def decontam_exact_substring(spark, t):
    """Exact passages: candidates share an n-gram with the item (an equi-join), then the passage is looked for. The gram has five words, or as
    many as the item has without its outer words; items of one or two words have none and are looked for in every document."""
    return exact_passages(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", F.col("text").alias("item")))


def exact_passages(docs, items):
    parts = F.split("item", r"\s+")  # the outer ones may be parts of longer words in a document
    n = F.greatest(F.size("parts") - 2, F.lit(0))
    items = items.withColumn("parts", parts).withColumn("n", n).withColumn("inner", F.array_join(F.slice("parts", 2, n), " "))
    found = docs.join(items.where("n = 0"), F.instr("text", F.col("item")) > 0).select("doc_id", "item_id")
    sizes = [r[0] for r in items.select(F.least("n", F.lit(5)).alias("n")).where("n > 0").distinct().collect()]  # five at most
    for n in sorted(sizes):  # a document's grams meet the items' before they are made distinct
        grams = N.word_grams(items.where(F.least("n", F.lit(5)) == n), "item_id", "inner", n).groupBy("item_id").agg(F.min("gram").alias("gram"))
        pairs = docs.select("doc_id", F.explode(N.grams("text", n)).alias("gram")).join(grams, "gram").select("doc_id", "item_id").distinct()
        found = found.unionByName(pairs.join(docs, "doc_id").join(items, "item_id").where(F.instr("text", F.col("item")) > 0).select("doc_id", "item_id"))
    return found


def droplist_hits(t):
    return overlap(t).select("doc_id", F.col("item_id").alias("query"), F.round("coverage", 9).alias("fident"), F.round(F.least(F.col("shared") / 10.0, F.lit(1.0)), 9).alias("cov"), (1.0 / F.col("shared")).alias("evalue"))


@query(OVERLAP + """, h AS (SELECT doc_id, item_id AS query, round(coverage, 9) AS fident, round(least(shared / 10.0, 1.0), 9) AS cov, 1.0 / shared AS evalue FROM hits),
k AS (SELECT *, fident >= 0.3 AND cov >= 0.5 AS by_i, evalue <= 0.05 AS by_e FROM h WHERE evalue <= 10 AND (evalue <= 0.05 OR (fident >= 0.3 AND cov >= 0.5))),
r AS (SELECT doc_id, bool_or(by_i) AS i, bool_or(by_e) AS e, count(*) AS n_hits FROM k GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fident DESC, query) AS rn FROM k) WHERE rn = 1)
SELECT best.doc_id, best.fident, best.query, best.cov, round(best.evalue, 9) AS evalue, r.n_hits, CASE WHEN i AND e THEN 'both' WHEN e THEN 'evalue' ELSE 'identity_coverage' END AS rule FROM best JOIN r USING (doc_id)""")
def droplist_evidence(spark, t):
    return N.drop_list(droplist_hits(t), ["doc_id"], most_evalue=0.05).withColumn("evalue", F.round("evalue", 9))


@query(OVERLAP + """, best AS (SELECT d.doc_id, max(coverage) AS c FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY 1)
SELECT threshold, count(*) AS n, sum(CASE WHEN c IS NULL OR c < threshold THEN 1 ELSE 0 END)::BIGINT AS survivors, round(sum(CASE WHEN c IS NULL OR c < threshold THEN 1 ELSE 0 END) / count(*), 9) AS share
FROM best, (SELECT unnest([0.1, 0.3, 0.5, 0.9]::DOUBLE[]) AS threshold) GROUP BY threshold""")
def threshold_sweep(spark, t):
    best = t("documents").select("doc_id").join(overlap(t).groupBy("doc_id").agg(F.max("coverage").alias("c")), "doc_id", "left")
    return N.threshold_sweep(best, "c", [0.1, 0.3, 0.5, 0.9]).withColumn("share", F.round("share", 9))


@query(OVERLAP + """, f AS (SELECT d.doc_id, coalesce(max(coverage), 0) >= 0.5 AS a, coalesce(max(l.toxic), 0) = 1 AS b, any_value(d.source) AS source FROM documents d LEFT JOIN hits USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
SELECT source, sum((a AND NOT b)::INT)::BIGINT AS only_a, sum((b AND NOT a)::INT)::BIGINT AS only_b, sum((a AND b)::INT)::BIGINT AS both, sum((NOT a AND NOT b)::INT)::BIGINT AS kept FROM f GROUP BY 1""")
def tier_survival(spark, t):
    best = overlap(t).groupBy("doc_id").agg(F.max("coverage").alias("c"))
    d = t("documents").select("doc_id", "source").join(best, "doc_id", "left").join(t("labels").select("doc_id", "toxic"), "doc_id", "left")
    return A.axis_decomposition(d, F.coalesce("c", F.lit(0.0)) >= 0.5, F.coalesce("toxic", F.lit(0)) == 1, ["source"])


@query(OVERLAP + """ SELECT b.item_id AS query, count(h.doc_id) AS n_hits, (count(*) FILTER (WHERE shared >= 20))::BIGINT AS n_significant,
round(max(coverage) FILTER (WHERE shared >= 20), 9) AS best_any, round(max(coverage) FILTER (WHERE shared >= 20 AND coverage >= 0.5), 9) AS best_covered, (count(h.doc_id) >= 5)::INT AS censored FROM benchmark b LEFT JOIN hits h USING (item_id) GROUP BY 1""")
def best_hits_per_query(spark, t):
    hits = overlap(t).select(F.col("item_id").alias("query"), F.col("doc_id").alias("target"), F.col("coverage").alias("fident"), F.col("coverage").alias("cov"), (1.0 / F.col("shared")).alias("evalue"))
    out = N.best_per_query(t("benchmark").select(F.col("item_id").alias("query")), hits, 0.5, 1 / 20, 5)
    return out.select("query", "n_hits", "n_significant", F.round("best_any", 9).alias("best_any"), F.round("best_covered", 9).alias("best_covered"), "censored")


@query("""SELECT doc_id, CASE WHEN bool_or(toxic = 1) THEN 'toxic' WHEN bool_or(quality = 0) THEN 'junk' ELSE 'clean' END AS category FROM labels GROUP BY 1""")
def residual_attribution(spark, t):
    return N.residual_category(t("labels"), "doc_id", [("toxic", F.col("toxic") == 1), ("junk", F.col("quality") == 0)], "clean")


@query("SELECT * FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def drop_list_filter(spark, t):
    return N.apply_drop_list(t("documents"), t("labels").where("toxic = 1"), ["doc_id"])


@query("""WITH l AS (SELECT 'toxic' AS reference, doc_id, 1.0 AS fident, 'toxic' AS query FROM labels WHERE toxic = 1 UNION ALL SELECT 'junk', doc_id, 0.5, 'junk' FROM labels WHERE quality = 0)
SELECT doc_id, fident::DOUBLE AS fident, reference, query FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fident DESC, reference) AS r FROM l) WHERE r = 1""")
def drop_list_union(spark, t):
    one = lambda cond, f, name: t("labels").where(cond).select("doc_id", F.lit(f).alias("fident"), F.lit(name).alias("query"))
    return N.union_drop_lists({"toxic": one("toxic = 1", 1.0, "toxic"), "junk": one("quality = 0", 0.5, "junk")}, ["doc_id"])


@query("""SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1(doc_id::VARCHAR || '|pick')) AS r FROM documents) WHERE r <= 5""")
def keyed_subset(spark, t):
    return R.subset(t("documents").select("source", "doc_id"), ["source"], F.col("doc_id"), 5, "pick")


@query("""WITH u AS (SELECT source, doc_id, n_chars, greatest(('0x' || substr(sha1(doc_id::VARCHAR || '|race'), 1, 13))::BIGINT / 4503599627370496.0, 1e-300) AS u FROM documents WHERE n_chars > 0)
SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY -ln(u) / n_chars, sha1(doc_id::VARCHAR || '|race')) AS r FROM u) WHERE r <= 4""")
def weighted_subset(spark, t):
    return R.weighted_subset(t("documents").select("source", "doc_id", "n_chars"), ["source"], F.col("doc_id"), "n_chars", 4, "race").select("source", "doc_id")


@query("""SELECT doc_id, origin FROM (SELECT doc_id, 'en' AS origin, ('0x' || substr(sha1(doc_id::VARCHAR || '|mix|en'), 1, 13))::BIGINT / 4503599627370496.0 AS u, 0.5 AS f FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, 'other', ('0x' || substr(sha1(doc_id::VARCHAR || '|mix|other'), 1, 13))::BIGINT / 4503599627370496.0, 0.9 FROM documents WHERE lang <> 'en') WHERE u < f""")
def corpus_mixture(spark, t):
    d = t("documents").select("doc_id", "lang")
    return R.mixture({"en": (d.where("lang = 'en'"), 0.5), "other": (d.where("lang <> 'en'"), 0.9)}, "doc_id", "mix").select("doc_id", "origin")


@query("""WITH p AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1)
SELECT d.source, d.doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1(doc_id::VARCHAR || '|null')) AS r FROM documents WHERE lang = 'en') d JOIN p USING (source) WHERE r <= n""")
def profile_matched_null(spark, t):
    d = t("documents").select("source", "doc_id", "lang")
    return R.matched_null(d.where("lang = 'de'"), d.where("lang = 'en'"), "source", ["doc_id"], "null").select("source", "doc_id")


@query("""WITH dirty AS (SELECT doc_id FROM labels WHERE quality = 0), clean AS (SELECT doc_id FROM documents ANTI JOIN dirty USING (doc_id) ORDER BY sha1(doc_id::VARCHAR || '|blend'), doc_id LIMIT 100)
SELECT doc_id, 'dirty' AS half FROM dirty UNION ALL SELECT doc_id, 'clean' FROM clean""")
def disjoint_mix(spark, t):
    return R.clean_mix(t("labels").where("quality = 0").select("doc_id"), t("documents").select("doc_id"), "doc_id", 100, "blend")


@query("SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id) ORDER BY sha1(doc_id::VARCHAR || '|take'), doc_id LIMIT 50")
def first_survivors(spark, t):
    return R.first_n_surviving(t("documents").select("doc_id"), t("labels").where("toxic = 1"), "doc_id", 50, "take")


@query("""WITH b AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'und' ELSE lang END AS lang, n_chars + coalesce(toxic, 0) AS n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars >= 100), a AS (SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'fr')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.lang AS lang_left, b.lang AS lang_right, a.n_chars AS n_chars_left, b.n_chars AS n_chars_right, a.doc_id IS NOT NULL AS in_left, b.doc_id IS NOT NULL AS in_right,
a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.lang IS NOT DISTINCT FROM b.lang AND a.n_chars IS NOT DISTINCT FROM b.n_chars AS agrees FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def disagreement_report(spark, t):
    """Two curations of the same table: one without French, one without short texts and with the labels' corrections."""
    d = t("documents").select("doc_id", "lang", "n_chars")
    b = d.where("n_chars >= 100").join(t("labels"), "doc_id", "left").select("doc_id", F.when(F.col("quality") == 0, "und").otherwise(F.col("lang")).alias("lang"), (F.col("n_chars") + F.coalesce("toxic", F.lit(0))).alias("n_chars"))
    return J.compare(d.where("lang <> 'fr'"), b, ["doc_id"], ["lang", "n_chars"])


@query("""WITH old AS (SELECT doc_id, lang FROM documents WHERE lang <> 'fr'), new AS (SELECT doc_id, upper(lang) AS lang FROM documents WHERE lang IN ('fr', 'es'))
SELECT * FROM old ANTI JOIN new USING (doc_id) UNION ALL SELECT * FROM new""")
def idempotent_upsert(spark, t):
    d = t("documents").select("doc_id", "lang")
    return U.upsert(d.where("lang <> 'fr'"), d.where("lang in ('fr', 'es')").withColumn("lang", F.upper("lang")), ["doc_id"])


@query("""SELECT doc_id, value FROM (SELECT doc_id, quality AS value, 0 AS p FROM labels UNION ALL SELECT doc_id, -1, 1 FROM documents) QUALIFY p = min(p) OVER (PARTITION BY doc_id)""")
def prefer_older(spark, t):
    return U.prefer([t("labels").select("doc_id", F.col("quality").alias("value")), t("documents").select("doc_id", F.lit(-1).alias("value"))], ["doc_id"])


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality IS NULL THEN 'empty' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def score_status(spark, t):
    return V.status(t("documents").select("doc_id"), t("labels"), "doc_id", "quality")


@query("SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source FROM labels l LEFT JOIN documents d USING (doc_id)")
def quality_strata_join(spark, t):
    return J.validated_join(t("labels"), t("documents").select("doc_id", "lang", "source"), ["doc_id"], require_match=True).select("doc_id", "quality", "toxic", "lang", "source")


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def labelled_members(spark, t):
    return J.keep_members(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"])


@query("SELECT doc_id, 'esm|' || lpad((doc_id // 100)::VARCHAR, 5, '0') || '_' || (doc_id % 100)::VARCHAR || '_' || sha1(doc_id::VARCHAR) AS address, 'esm' AS arm, (doc_id // 100)::INT AS shard, (doc_id % 100)::INT AS row, sha1(doc_id::VARCHAR) AS entry_id FROM documents")
def row_address_round_trip(spark, t):
    a = S.address(F.lit("esm"), F.floor(F.col("doc_id") / 100).cast("int"), (F.col("doc_id") % 100).cast("int"), F.sha1(F.col("doc_id").cast("string").cast("binary")))
    return t("documents").select("doc_id", a.alias("address")).select("doc_id", "address", S.parse_address(F.col("address"), ["esm", "afdb"]).alias("p")).select("doc_id", "address", "p.*")
