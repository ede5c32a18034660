"""Sinks (K operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def write_rounds(selected: DataFrame, path: str, split: str, shard_rows: int, tie: str) -> DataFrame:
    """Shards of one split and round each, rounds descending, in files partitioned by split and shard. Returns the shard table.

    A row's place inside its round comes from a per-round count and a rank by (split, round, block), blocks being 64 keyed parts:
    no window holds a whole round."""
    block = F.pmod(F.xxhash64(tie), F.lit(64))
    d = selected.withColumn("__b", block)
    sizes = d.groupBy(split, "round", "__b").agg(F.count("*").alias("__n"))
    offset = F.sum("__n").over(W.partitionBy(split, "round").orderBy("__b")) - F.col("__n")
    d = d.withColumn("__r", F.row_number().over(W.partitionBy(split, "round", "__b").orderBy(tie)) - 1).join(sizes.withColumn("__o", offset).drop("__n"), [split, "round", "__b"])
    d = d.withColumn("__s", F.floor((F.col("__o") + F.col("__r")) / shard_rows))
    rounds = sizes.groupBy(split, "round").agg(F.sum("__n").alias("__n")).withColumn("__k", F.ceil(F.col("__n") / shard_rows))
    first = F.sum("__k").over(W.partitionBy(split).orderBy(F.desc("round"))) - F.col("__k")
    d = d.join(rounds.withColumn("__f", first).select(split, "round", "__f"), [split, "round"]).withColumn("shard", (F.col("__f") + F.col("__s")).cast("int"))
    out = d.drop("__b", "__r", "__o", "__s", "__f")
    out.repartition(split, "shard").sortWithinPartitions(split, "shard", tie).write.partitionBy(split, "shard").mode("overwrite").parquet(path)
    return out.sparkSession.read.parquet(path).groupBy(split, "shard", "round").agg(F.count("*").alias("n"))


def write_documents(df: DataFrame, path: str, structure: str) -> int:
    """Stamps `structure` as last column and writes zstd parquet, or JSON lines by suffix; no rows is an error. Returns the count, which
    the write itself observes."""
    seen = Observation("documents")
    out = df.drop("structure").withColumn("structure", F.lit(structure)).observe(seen, F.count(F.lit(1)).alias("n"))
    if path.endswith((".jsonl", ".json")):
        out.write.mode("overwrite").json(path)
    else:
        out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if not seen.get["n"]:
        raise ValueError("no documents to write")
    return seen.get["n"]


def write_evaluation(spark: SparkSession, path: str, structure: str, metrics: dict[str, float], extras: dict, examples: DataFrame | None = None) -> None:
    """One row of metric_* columns, scalar and list extras, nested extras as extras_json; per-example rows beside it."""
    import json

    flat = {k: v for k, v in extras.items() if not isinstance(v, dict) and not (isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v))}
    nested = {k: v for k, v in extras.items() if k not in flat}
    row = {**{f"metric_{k}": float(v) for k, v in metrics.items()}, **flat, "extras_json": json.dumps(nested, sort_keys=True), "structure": structure}
    spark.createDataFrame([row]).select(*row).write.mode("overwrite").parquet(f"{path}/summary.parquet")
    if examples is not None:
        examples.withColumn("structure", F.lit(structure)).write.mode("overwrite").parquet(f"{path}/examples.parquet")


def write_limited(df: DataFrame, path: str, rows: int) -> None:
    """Files of at most that many rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str] = ("arm", "shard", "row")) -> None:
    """Globally ordered by a range exchange; files in order."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def shard_name(shard: int, total: int) -> str:
    return f"{shard:05d}-of-{total:05d}.parquet"


def _files(spark: SparkSession, path: str):
    """(file system, {name: path}) of a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, {f.getPath().getName(): f.getPath() for f in (fs.listStatus(at) if fs.exists(at) else [])}


def _renamed(fs, at, target) -> None:
    """A rename that failed is an error: a file system may say so by its answer alone."""
    if not fs.rename(at, target):
        raise OSError(f"{at} could not be renamed to {target}")


def write_shards(df: DataFrame, path: str, shard: str, total: int, order: Sequence[str], wanted: Sequence[int] | None = None, codec: str = "zstd", drop: Sequence[str] = ()) -> list[int]:
    """One file per shard, `{shard:05d}-of-{total:05d}.parquet`, rows in order, shards without rows as empty files; returns those.

    A shard's rows meet in one task, as they become one file. Files appear under their names only when all are written: they are
    renamed from a folder beside, so a run that broke off leaves no part of a file. wanted: the shards to write (default all); drop: columns
    that serve the order only."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    beside = f"{path.rstrip('/')}/_shards"
    wanted = list(range(total) if wanted is None else wanted)
    out = df.withColumn("__shard", F.col(shard).cast("int")).repartition(max(1, len(wanted)), "__shard").sortWithinPartitions("__shard", *order).drop(*drop)
    out.write.mode("overwrite").option("compression", codec).partitionBy("__shard").parquet(beside)
    fs, dirs = _files(spark, beside)
    empty = []
    for k in wanted:  # names only: rows don't pass through the driver
        target = hadoop(f"{path.rstrip('/')}/{shard_name(k, total)}")
        if f"__shard={k}" in dirs:
            (made,) = [p for n, p in _files(spark, f"{beside}/__shard={k}")[1].items() if n.endswith(".parquet")]
            _renamed(fs, made, target)
        else:
            empty.append(k)
    if empty:
        df.drop(*drop).limit(0).coalesce(1).write.mode("overwrite").option("compression", codec).parquet(f"{beside}-empty")
        (made,) = [p for n, p in _files(spark, f"{beside}-empty")[1].items() if n.endswith(".parquet")]
        for k in empty:
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, made, fs, hadoop(f"{path.rstrip('/')}/{shard_name(k, total)}"), False, spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(hadoop(f"{beside}-empty"), True)
    fs.delete(hadoop(beside), True)
    return empty


def rewrite_without(spark: SparkSession, files: Sequence[str], dropped: DataFrame, key: str, path: str, codec: str = "zstd") -> DataFrame:
    """(file, total, dropped, kept) of a filtered copy: each source file becomes one file of the same rank, in its order, empty ones too. Ranks
    are by file name, then by whole path, so files of one name in different folders are told apart. Files that a former run has written
    are left as they are. kept = total - dropped is checked for each file, kept being counted in what was written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    whole = lambda f: (p := hadoop(f)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    files = sorted(dict.fromkeys(map(whole, files)), key=lambda f: (f.rsplit("/", 1)[-1], f))
    number = {f: i for i, f in enumerate(files)}
    done = _files(spark, path)[1]
    todo = [f for f in files if shard_name(number[f], len(files)) not in done]
    read = lambda names: spark.read.parquet(*[hadoop(spark.sparkContext._jvm.java.net.URI(f)).toString() for f in names])
    ranks = spark.createDataFrame(list(number.items()), "file string, __rank int")  # a row per file
    source = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("__source")
    ranks = ranks.withColumn("__source", F.regexp_replace("file", "^file:/+", "file:/"))
    gone = dropped.select(key).distinct()
    if todo:
        columns = read(todo[:1]).columns
        rows = read(todo).select("*", source, F.col("_metadata.row_index").alias("__row_in_source")).join(ranks.select("__source", "__rank"), "__source")
        kept = rows.join(gone, key, "left_anti").select(*columns, F.col("__rank").alias("__rank_of_source"), "__row_in_source")
        write_shards(kept, f"{path.rstrip('/')}/_new", "__rank_of_source", len(files), ["__row_in_source"], sorted(number[f] for f in todo), codec, ["__rank_of_source", "__row_in_source"])
        fs, made = _files(spark, f"{path.rstrip('/')}/_new")
        for name, at in made.items():
            if name.endswith(".parquet"):
                _renamed(fs, at, hadoop(f"{path.rstrip('/')}/{name}"))
        fs.delete(hadoop(f"{path.rstrip('/')}/_new"), True)
    before = read(files).select(key, source).join(gone.withColumn("__d", F.lit(1)), key, "left").groupBy("__source").agg(F.count("*").alias("total"), F.count("__d").alias("dropped"))
    after = spark.read.parquet(*[f"{path.rstrip('/')}/{shard_name(i, len(files))}" for i in range(len(files))]).groupBy(F.col("_metadata.file_name").alias("__f")).agg(F.count("*").alias("kept"))
    names = ranks.withColumn("__f", F.concat(F.lpad(F.col("__rank").cast("string"), 5, "0"), F.lit(f"-of-{len(files):05d}.parquet")))
    out = names.join(before, "__source", "left").join(after, "__f", "left").fillna(0, ["total", "dropped", "kept"]).orderBy("__rank").select("file", "total", "dropped", "kept")
    wrong = out.where("kept <> total - dropped").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]}: kept rows aren't the total less those dropped")
    return out


def pending(parts: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Parts that a former run has not written yet."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return parts
    return parts.join(done, key, "left_anti")


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_provenance(spark: SparkSession, path: str, facts: dict) -> None:
    """A JSON line of facts, through Spark's writer so that any store will do."""
    import json

    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
