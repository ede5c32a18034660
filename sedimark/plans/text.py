"""Queries over texts: parsing, statement streams, tokens, pages."""

from pyspark.sql import functions as F

from sedimark.functions import scalars as S
from sedimark.operators import aggregates as A
from sedimark.operators import codecs as D
from sedimark.operators import evaluation as V
from sedimark.operators import windows as W
from sedimark.plans.registry import query

#: Events stand for an edit stream: views and clicks state a pair, errors and purchases take one back.
EVENTS = """e AS (SELECT user_id AS key, event_id AS n, CASE WHEN event_type IN ('error', 'purchase') THEN 'retract' ELSE 'contact' END AS kind, (event_id % 5)::INT AS a, (event_id % 7)::INT AS b FROM events)"""


def edits(t):
    e = t("events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), F.when(F.col("event_type").isin("error", "purchase"), "retract").otherwise("contact").alias("kind"), (F.col("event_id") % 5).cast("int").alias("a"), (F.col("event_id") % 7).cast("int").alias("b"))


@query(f"""WITH {EVENTS}, p AS (SELECT key, n, least(a, b) AS i, greatest(a, b) AS j, kind = 'contact' AS on_, lag(kind = 'contact') OVER (PARTITION BY key, least(a, b), greatest(a, b) ORDER BY n) AS before FROM e)
SELECT key, i, j, arg_max(on_, n) AS live, sum(on_::INT)::BIGINT AS emits, sum((on_ AND before IS NOT NULL AND NOT before)::INT)::BIGINT AS re_emits, sum((on_ AND coalesce(before, false))::INT)::BIGINT AS redundant,
sum((NOT on_)::INT)::BIGINT AS retracts, sum((NOT on_ AND NOT coalesce(before, false))::INT)::BIGINT AS absent_retracts FROM p GROUP BY 1, 2, 3""")
def statement_fold(spark, t):
    return D.fold_statements(edits(t), "key", ["n"])


TRUTH = "t AS (SELECT DISTINCT user_id AS key, least(user_id % 5, user_id % 7 + 2)::INT AS i, greatest(user_id % 5, user_id % 7 + 2)::INT AS j FROM events)"


def edit_truth(t):
    return t("events").select(F.col("user_id").alias("key"), (F.col("user_id") % 5).cast("int").alias("i"), (F.col("user_id") % 7 + 2).cast("int").alias("j")).distinct()


#: Statements with their pair's statement before them: `gone` takes back a live pair.
STEPS = f"""{EVENTS}, {TRUTH}, p AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY n) AS n, kind = 'contact' AS c, least(a, b) AS i, greatest(a, b) AS j FROM e),
s AS (SELECT *, NOT c AND coalesce(lag(c) OVER w, false) AS gone, n - lag(n) OVER w AS far FROM p WINDOW w AS (PARTITION BY key, i, j ORDER BY n)),
d AS (SELECT key, count(*) AS n_statements, sum(c::INT)::BIGINT AS n_contacts, sum((NOT c)::INT)::BIGINT AS n_retracts, sum(gone::INT)::BIGINT AS n_retracted, sum((NOT c AND NOT gone)::INT)::BIGINT AS absent_retracts, avg(far) FILTER (WHERE gone) AS distance FROM s GROUP BY 1),
q AS (SELECT x.key, x.g, t.key IS NOT NULL AS t FROM (SELECT key, i, j, bool_or(gone) AS g FROM s GROUP BY 1, 2, 3 HAVING bool_or(c)) x LEFT JOIN t USING (key, i, j)),
k AS (SELECT key, sum((NOT g AND t)::INT)::BIGINT AS kept_tp, sum((NOT g AND NOT t)::INT)::BIGINT AS kept_fp, sum((g AND t)::INT)::BIGINT AS retracted_tp, sum((g AND NOT t)::INT)::BIGINT AS retracted_fp FROM q GROUP BY 1),
diag AS (SELECT d.* REPLACE (round(distance, 6) AS distance), coalesce(kept_tp, 0) AS kept_tp, coalesce(kept_fp, 0) AS kept_fp, coalesce(retracted_tp, 0) AS retracted_tp, coalesce(retracted_fp, 0) AS retracted_fp FROM d LEFT JOIN k USING (key))"""


@query(f"WITH {STEPS} SELECT * FROM diag")
def edit_diagnosis(spark, t):
    return V.diagnose_edits(edits(t), edit_truth(t), "key", ["n"]).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {STEPS}, a AS (SELECT count(*) AS n_documents, avg((n_retracts > 0)::INT) AS share_with_retract, avg(n_retracts) AS mean_retracts, avg(n_contacts) AS mean_contacts, sum(kept_tp + kept_fp + retracted_tp + retracted_fp)::BIGINT AS n_emitted,
sum(kept_fp + retracted_fp) / sum(kept_tp + kept_fp + retracted_tp + retracted_fp) AS base_rate, sum(retracted_fp) / sum(retracted_fp + retracted_tp) AS "precision", sum(retracted_fp) / sum(kept_fp + retracted_fp) AS recall, sum(retracted_tp)::BIGINT AS retracted_tp, sum(n_retracted)::BIGINT AS n_retracted, sum(absent_retracts)::BIGINT AS absent_retracts FROM diag),
f AS (SELECT avg(far) AS mean_distance, max(far) FILTER (WHERE r = n // 2)::INT AS median_distance, avg((far <= 1)::INT) AS immediate_share FROM (SELECT far, row_number() OVER (ORDER BY far) - 1 AS r, count(*) OVER () AS n FROM s WHERE gone))
SELECT a.* REPLACE (round(share_with_retract, 6) AS share_with_retract, round(mean_retracts, 6) AS mean_retracts, round(mean_contacts, 6) AS mean_contacts, round(base_rate, 6) AS base_rate, round("precision", 6) AS "precision", round(recall, 6) AS recall),
round("precision" / base_rate, 6) AS enrichment, round(mean_distance, 6) AS mean_distance, median_distance, round(immediate_share, 6) AS immediate_share FROM a, f""")
def retraction_summary(spark, t):
    """Ratios of sums over the edit streams' diagnoses."""
    out = V.retraction_summary(V.diagnose_edits(edits(t), edit_truth(t), "key", ["n"]), V.edit_distances(edits(t), "key", ["n"]))
    return out.withColumns({c: F.round(c, 6) for c in ("share_with_retract", "mean_retracts", "mean_contacts", "base_rate", "precision", "recall", "enrichment", "mean_distance", "immediate_share")})


@query()
def edit_recovery(spark, t):
    """Greedy matching of true pairs to the retracts before them."""
    return V.recoveries(edits(t), edit_truth(t), "key", ["n"])


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations""")
def turn_order(spark, t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t("conversations").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("""SELECT doc_id, (i - 2)::INT AS section, p[i] AS body FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents))""")
def section_split(spark, t):
    return D.split_sections(t("documents"), "doc_id", "text", ". ")


WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"


@query(f"""SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY 1""")
def token_vocab_count(spark, t):
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return t("documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, len(w) + 1 AS n_ids, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN x = 'the' THEN 2 WHEN x = 'of' THEN 3 WHEN x = 'and' THEN 4 ELSE 0 END)), 0)::BIGINT + 1 AS total FROM (SELECT conv_id, turn, [0] || [0] AS z, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)""")
def word_level_tokens(spark, t):
    """Ids through a vocabulary table: the, of and and; unknown 0, end 1."""
    vocabulary = spark.createDataFrame([("the", 2), ("of", 3), ("and", 4)], "token string, id int")
    d = t("conversations").withColumn("k", F.concat_ws(":", "conv_id", "turn"))
    ids = D.word_level(d, "k", F.col("text"), vocabulary, 0, 1)
    out = ids.select(F.split("k", ":")[0].cast("long").alias("conv_id"), F.split("k", ":")[1].cast("long").alias("turn"), F.size("ids").cast("long").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    return out


@query("""SELECT event_id, list_filter([CASE WHEN len(i) < 3 THEN 'too_short' END, CASE WHEN list_has_any(i, [6]) THEN 'out_of_range' END, CASE WHEN list_contains(i, 0) THEN 'unknown_token' END, CASE WHEN i[-1] <> 1 THEN 'no_end' END], lambda x: x IS NOT NULL)::VARCHAR AS faults FROM (SELECT event_id, list_transform(range(1, (event_id % 4 + 2)::BIGINT), lambda x: (event_id * x) % 7) || [event_id % 3] AS i FROM events)""")
def token_validation(spark, t):
    ids = F.concat(F.transform(F.sequence(F.lit(1), (F.col("event_id") % 4 + 1).cast("int")), lambda x: (F.col("event_id") * x % 7).cast("int")), F.array((F.col("event_id") % 3).cast("int")))
    faults = D.token_faults(ids, 6, 0, 1, 3, 100)
    return t("events").select("event_id", F.concat(F.lit("["), F.array_join(faults, ", "), F.lit("]")).alias("faults"))


@query("""SELECT role, letter, count(*) AS n FROM (SELECT role, unnest(string_split(lower(text), '')) AS letter FROM conversations) GROUP BY ALL""")
def char_composition(spark, t):
    return t("conversations").select("role", F.explode(F.split(F.lower("text"), "")).alias("letter")).where("letter <> ''").groupBy("role", "letter").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT item_id, list_filter(string_split(lower(text), ''), lambda c: regexp_matches(c, '[a-z]')) AS l FROM benchmark),
w AS (SELECT item_id, s, l[s:s+11] AS w FROM (SELECT item_id, l, unnest(range(1, len(l) - 10)) AS s FROM l)),
h AS (SELECT item_id, s, -sum(n / 12 * log2(n / 12)) AS h FROM (SELECT item_id, s, c, count(*) AS n FROM (SELECT item_id, s, unnest(w) AS c FROM w) GROUP BY ALL) GROUP BY 1, 2)
SELECT l.item_id, greatest(len(l) - 11, 1)::BIGINT AS n_windows, round(coalesce(k.low, 0) / greatest(len(l) - 11, 1), 9) AS low_share FROM l LEFT JOIN (SELECT item_id, sum((h < 2.9)::INT) AS low FROM h GROUP BY 1) k USING (item_id)""")
def window_entropy(spark, t):
    """Share of sliding windows of twelve letters whose entropy (in bits) is low."""
    letters = F.filter(F.split(F.lower("text"), ""), lambda c: c.rlike("[a-z]"))
    return t("benchmark").select("item_id", letters.alias("l")).select("item_id", F.greatest(F.size("l") - 11, F.lit(1)).cast("long").alias("n_windows"), F.round(S.low_entropy_share(F.col("l"), 12, 2.9), 9).alias("low_share"))


@query("""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS n_paragraphs, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS n_links FROM pages""")
def html_field_extract(spark, t):
    return t("pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).cast("long").alias("n_paragraphs"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))


@query("""SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, length(url) AS n FROM pages""")
def url_param_parse(spark, t):
    return t("pages").select("page_id", F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.length("url").cast("long").alias("n"))


@query("""SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY 1""")
def json_props(spark, t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query("""SELECT p_partkey, list_transform(list_filter(string_split(upper(regexp_replace(p_name, '[^a-z]', '', 'g')), ''), lambda c: c <> ''), lambda c: CASE c WHEN 'A' THEN 'ALA' WHEN 'R' THEN 'ARG' WHEN 'N' THEN 'ASN' WHEN 'D' THEN 'ASP' WHEN 'C' THEN 'CYS' WHEN 'Q' THEN 'GLN' WHEN 'E' THEN 'GLU' WHEN 'G' THEN 'GLY' WHEN 'H' THEN 'HIS' WHEN 'I' THEN 'ILE' WHEN 'L' THEN 'LEU' WHEN 'K' THEN 'LYS' WHEN 'M' THEN 'MET' WHEN 'F' THEN 'PHE' WHEN 'P' THEN 'PRO' WHEN 'S' THEN 'SER' WHEN 'T' THEN 'THR' WHEN 'W' THEN 'TRP' WHEN 'Y' THEN 'TYR' WHEN 'V' THEN 'VAL' ELSE 'UNK' END).list_aggregate('string_agg', ' ') AS residues FROM part""")
def residues_from_names(spark, t):
    return t("part").select("p_partkey", F.array_join(S.residues(F.regexp_replace("p_name", "[^a-z]", "")), " ").alias("residues"))


@query("""SELECT p_partkey, least(greatest(ceil((p_retailprice - 899) / 0.5), 1), 64)::INT AS d_bin, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS q_bin, CASE WHEN p_size <= 8 THEN 8 WHEN p_size <= 16 THEN 16 WHEN p_size <= 32 THEN 32 ELSE p_size END AS bucket, floor(p_retailprice / 10)::BIGINT AS cell FROM part""")
def numeric_bins(spark, t):
    return t("part").select("p_partkey", S.distance_bin(F.col("p_retailprice") - 899).alias("d_bin"), S.quality_bin(F.col("p_size"), [10, 30]).alias("q_bin"), S.bucket_size(F.col("p_size"), [8, 16, 32]).alias("bucket"), S.grid_cell(F.col("p_retailprice"), 10.0).alias("cell"))


@query("""SELECT doc_id, source, n_chars, used FROM (SELECT doc_id, source, n_chars, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) WHERE used <= 20000""")
def pack_until_budget(spark, t):
    return D.pack_until_budget(t("documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 20000)


NAMES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL"
ENTRIES = f"""o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, (o_orderkey % 6 + 13)::BIGINT AS n FROM orders), c AS (SELECT l_orderkey AS o_orderkey, l_linenumber AS i, l_linenumber + 6 AS j, max(l_quantity) AS degree FROM lineitem GROUP BY ALL),
q AS (SELECT o_orderkey, k, n, list_transform(range(0, n), lambda x: string_split('{NAMES}', ' ')[(o_orderkey + x) % 20 + 1]) AS names FROM o)"""


def _entries(t):
    """Orders stand for entries, their lines for contacts."""
    names = F.split(F.lit(NAMES), " ")
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("entry_id"), F.transform(F.sequence(F.lit(0), F.col("o_orderkey") % 6 + 12), lambda x: F.get(names, ((F.col("o_orderkey") + x) % 20).cast("int"))).alias("sequence"))
    c = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("entry_id"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").alias("degree")).withColumn("j", F.col("i") + 6).select("entry_id", "i", "j", "degree")
    return o, c


def _u(*salt: str) -> str:
    return "(('0x' || substr(sha1(" + " || '|' || ".join(salt) + "), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"""WITH {ENTRIES}, s AS (SELECT *, floor({_u("k", "'start'")} * 2000)::BIGINT AS start, greatest(floor((48 - 2 * n - 3) / 3), 0) AS budget FROM q),
r AS (SELECT s.o_orderkey, k, start, i, j, budget, row_number() OVER (PARTITION BY s.o_orderkey ORDER BY degree DESC, i, j) AS r FROM c JOIN s USING (o_orderkey) WHERE degree >= 5),
l AS (SELECT o_orderkey, string_agg('<contact> <p' || CASE WHEN coin THEN p ELSE q END || '> <p' || CASE WHEN coin THEN q ELSE p END || '>', ' ' ORDER BY h) AS body, count(*) AS n_contacts FROM
(SELECT o_orderkey, {_u("k", "'coin'", "i", "j")} < 0.5 AS coin, (i + start) % 2000 AS p, (j + start) % 2000 AS q, sha1(k || '|order|' || i || '|' || j) AS h FROM r WHERE r <= budget) GROUP BY 1), t AS (SELECT o_orderkey, count(*) AS total FROM r GROUP BY 1)
SELECT k AS entry_id, '<begin_sequence> ' || list_aggregate(list_transform(names, lambda x, i: '<p' || ((i - 1 + start) % 2000) || '> <' || x || '>'), 'string_agg', ' ') || ' <begin_statements>' || coalesce(' ' || body, '') || ' <end>' AS document,
coalesce(n_contacts, 0) AS n_contacts, coalesce(total, 0) > coalesce(n_contacts, 0) AS truncated FROM s LEFT JOIN l USING (o_orderkey) LEFT JOIN t USING (o_orderkey)""")
def doc_build_budget(spark, t):
    return D.build_documents(*_entries(t), context=48, least_degree=5.0).select("entry_id", "document", F.col("n_contacts").cast("long").alias("n_contacts"), "truncated")


LETTERS = "ARNDCQEGHILKMFPSTWYV"


@query(f"""WITH {ENTRIES}, p AS (SELECT o_orderkey, string_agg(i || '-' || j, ',' ORDER BY i) AS pairs FROM c JOIN o USING (o_orderkey) WHERE j < n GROUP BY 1)
SELECT k AS entry_id, list_aggregate(list_transform(range(0, n), lambda x: '{LETTERS}'[(o_orderkey + x) % 20 + 1]), 'string_agg', '') AS sequence, coalesce(pairs, '') AS pairs FROM q LEFT JOIN p USING (o_orderkey)""")
def doc_parse_round_trip(spark, t):
    """Documents built and read back: sequence and pairs come out as they went in."""
    o, c = _entries(t)
    docs = D.build_documents(o, c, context=200).join(o.withColumn("n", F.size("sequence")), "entry_id")
    start = F.floor(S.keyed_uniform(F.col("entry_id"), "start") * 2000).cast("int")
    d = docs.select("entry_id", D.parse_document(F.col("document"), F.col("n"), start).alias("d"))
    return d.select("entry_id", "d.sequence", F.array_join(F.transform("d.pairs", lambda p: F.concat_ws("-", p["i"], p["j"])), ",").alias("pairs"))


@query("""SELECT user_id, n::BIGINT AS ordinal, count(*) AS n_new FROM (SELECT user_id, props, min(rn) AS n FROM (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2) GROUP BY 1, 2""")
def novelty_marginals(spark, t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return W.first_seen(t("events").withColumn("ordinal", F.row_number().over(w).cast("long")), ["user_id"], ["props"], "ordinal")


@query("""SELECT event_id, unnest(i)::INT AS id, unnest(CASE WHEN len(list_filter(i, lambda x: x = 1)) = 0 THEN list_transform(i, lambda x: 0.1) ELSE list_transform(i, lambda x, k: CASE WHEN len(list_filter(i[:k], lambda y: y = 1)) = 0 THEN 0.1 WHEN len(list_filter(i[:k], lambda y: y = 1)) = len(list_filter(i, lambda y: y = 1)) THEN 1.0 ELSE 0.5 END) END)::DOUBLE AS weight FROM (SELECT event_id, list_transform(range(1, 8), lambda x: (event_id * x) % 3) AS i FROM events)""")
def span_loss_weights(spark, t):
    ids = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda x: (F.col("event_id") * x % 3).cast("int"))
    z = F.explode(F.arrays_zip(F.col("i").alias("id"), D.span_weights(F.col("i"), 0.1, 0.5, 1.0, 1).alias("weight")))
    return t("events").select("event_id", ids.alias("i")).select("event_id", z.alias("z")).select("event_id", "z.id", "z.weight")


@query("""SELECT event_id, mutation, substr(mutation, 1, 1) AS wild, substr(mutation, 2, length(mutation) - 2)::INT - 1 AS position, right(mutation, 1) AS mutant FROM (SELECT event_id, unnest(['A' || (event_id % 90 + 1)::VARCHAR || 'G', 'D7N']) AS mutation FROM events)""")
def mutation_parse(spark, t):
    text = F.concat(F.lit("A"), (F.col("event_id") % 90 + 1).cast("string"), F.lit("G:D7N"))
    d = t("events").select("event_id", F.explode(F.arrays_zip(F.split(text, ":").alias("mutation"), S.parse_mutations(text).alias("m"))).alias("z"))
    return d.select("event_id", "z.mutation", "z.m.wild", "z.m.position", "z.m.mutant")
