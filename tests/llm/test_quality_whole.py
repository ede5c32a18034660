"""Co-training reads every labelled row and every row of the pool."""

from sedimark.llm import quality


def test_every_label_and_the_whole_pool_count(spark, monkeypatch):
    """A word that only rows beyond the 6,000 labels of smallest hash hold, one of them very long, is learned; all others are the pool."""
    from pyspark.sql import functions as F

    rank = F.row_number().over(quality.W.orderBy(F.xxhash64("doc_id", F.lit("quality"))))
    docs = spark.range(12_000).withColumnRenamed("id", "doc_id").withColumn("rank", F.when(F.col("doc_id") < 7000, rank))
    ids = spark.range(7000).select(F.col("id").alias("doc_id")).withColumn("rank", rank)
    docs = docs.drop("rank").join(ids, "doc_id", "left").withColumn("late", F.coalesce(F.col("rank") > 6000, F.lit(False)))
    text = F.concat(F.lit("some plain words "), F.when(F.col("doc_id") % 2 == 0, "good ").otherwise("bad "), F.when(F.col("late"), "zebracrossing " ).otherwise(""), F.col("doc_id").cast("string"))
    text = F.when(F.col("rank") == 6500, F.concat(text, F.repeat(F.lit(" filler"), 6000))).otherwise(text)
    docs = docs.select("doc_id", text.alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.length(text).alias("n_chars"), "late")
    labels = docs.where("doc_id < 7000").select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.col("late").cast("int").alias("toxic"))
    pools, plain = [], quality._confident
    monkeypatch.setattr(quality, "_confident", lambda pool, *more: pools.append(pool.count()) or plain(pool, *more))
    model = quality.fit(docs.drop("late"), labels)
    assert b"zebracrossing" in model.vocabulary and pools == [5000]


def test_tables_and_rows_in_memory_give_one_model(spark):
    """Sums over tasks against the same rows in one block: the same first vocabulary, and the same scores after the fits."""
    import numpy as np

    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"], 12)) + (" prize" if rnd.random() < (0.8 if i % 2 else 0.2) else ""), "ab"[i % 3 == 0], "en", 60 + i % 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 < 2)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.fit(docs, labels)
    kept = {r[0]: r[1] for r in docs.select("doc_id", quality._kept()).collect()}
    memory = quality.Rows([(t.encode(), s, lang, n) for _, t, s, lang, n in rows], {"quality": np.arange(400) % 2, "toxic": (np.arange(400) % 5 < 2).astype(int)})
    memory.kept = np.array([kept[i] for i in range(400)])
    memory.use = np.flatnonzero(~memory.kept)
    memory.edges = lambda bins: (got.edges, got.lengths)
    want = quality.fitted(memory, None, None, rounds=0)
    assert list(got.vocabulary) == list(want.vocabulary)
    a, b = (m.score(memory.rows) for m in (got, want))
    assert all(np.allclose(x, y, atol=1e-3) for t in quality.TASKS for x, y in zip(a[t], b[t]))
