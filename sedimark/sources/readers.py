"""Scans (S operators)."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headerless columns of an alignment table.
HITS = "query string, target string, fident double, alnlen int, qcov double, tcov double, evalue double, bits double"
STRUCTURES = (".cif", ".cif.gz", ".pdb", ".pdb.gz", ".mmcif")


def as_glob(path: str, suffix: str = ".parquet") -> str:
    """A file or glob as it is; a folder or prefix -> all its files of that suffix."""
    if any(c in path for c in "*?[{") or path.endswith(suffix):
        return path
    return posixpath.join(path.rstrip("/"), f"*{suffix}")


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, recursive: bool = False) -> DataFrame:
    """Parquet by path, folder, glob or list of paths, with the columns asked for (the scan reads no others)."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("recursiveFileLookup", recursive).parquet(*paths)
    return df.select(*columns) if columns else df


def resolve_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """Required columns (missing ones raise) and those optional ones that exist."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")
    return [*required, *[c for c in optional if c in df.columns and c not in required]]


def with_row_id(df: DataFrame, id_column: str | None) -> DataFrame:
    """Adds entry_id: the trimmed id, or `<file stem>:row<N>` where it is missing or blank. N counts the file's rows before filters."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")
    made = F.concat(stem, F.lit(":row"), F.col("_metadata.row_index").cast("string"))
    given = F.nullif(F.trim(F.col(id_column).cast("string")), F.lit("")) if id_column else F.lit(None).cast("string")
    return df.withColumn("entry_id", F.coalesce(given, made))


def map_rows(df: DataFrame, function: Callable[[dict], dict | None], schema: str, lenient: bool = False) -> DataFrame:
    """A Python function over rows, by Arrow batches; None drops the row. lenient: rows that raise are left out, else the error stands."""

    def run(batches):
        import logging

        import pyarrow as pa

        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    made = function(row)
                except Exception:
                    if not lenient:
                        raise
                    logging.getLogger(__name__).warning("row left out", exc_info=True)
                    continue
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def flat_map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list[dict] | None]], schema: str, threads: int = 1) -> DataFrame:
    """A Python function from a row to any number of rows. make() runs once per task and returns the function, so that what it needs is
    set up once. With threads (for functions that wait for other systems) a batch's rows run side by side and results keep the rows'
    order. None drops a row; an error stops the task."""

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        function = make()
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                rows = b.to_pylist()
                made = list(pool.map(function, rows)) if threads > 1 else list(map(function, rows))
                out = [r for rs in made if rs is not None for r in rs]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def query_files(spark: SparkSession, sql: str, tables: dict[str, str]) -> DataFrame:
    """SQL over Parquet at any path that Spark's file systems reach; a table's name stands in braces. Projections and filters go to the scan."""
    return spark.sql(sql, **{name: spark.read.parquet(path if path.endswith(".parquet") else as_glob(path)) for name, path in tables.items()})


def batches_of(df: DataFrame, size: int):
    """Lists of up to `size` rows; partitions are computed one at a time as they are asked for, so a reader that stops early leaves the
    rest unread."""
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def structure_files(spark: SparkSession, path: str, suffixes: Sequence[str] = STRUCTURES) -> DataFrame:
    """(path, content) of the structure files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    low = F.lower("path")
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | low.endswith(s)
    return df.where(cond).select("path", "content")


def structures(spark: SparkSession, path: str, text_column: str, id_column: str | None = None) -> DataFrame:
    """(entry_id, text): parquet shards take precedence over loose structure files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(as_glob(path))
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if found is not None and len(found):
        df = spark.read.parquet(as_glob(path))
        return with_row_id(df, id_column).select("entry_id", F.col(text_column).alias("text"))
    return structure_files(spark, path).select(F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z]+)+$", 1).alias("entry_id"), F.decode("content", "utf-8").alias("text"))


def with_content(df: DataFrame, uri: str, files: DataFrame, missing_ok: bool = False) -> DataFrame:
    """Joins each row's file (path, content); a missing one raises or, if allowed, gives null."""
    out = df.join(files.select(F.col("path").alias("__p"), "content"), F.col(uri) == F.col("__p"), "left").drop("__p")
    return out if missing_ok else out.withColumn("content", F.coalesce("content", F.raise_error(F.concat(F.lit("no file "), F.col(uri))).cast("binary")))


def read_fasta(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, description, sequence); compressed files are read by their suffix."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    value = F.regexp_replace("value", r"^>", "")
    head = F.substring_index(value, "\n", 1)
    body = F.when(F.instr(value, "\n") > 0, F.regexp_replace(F.substr(value, F.instr(value, "\n") + 1), r"\s", "")).otherwise("")
    out = raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("sequence"))
    return out.limit(limit) if limit is not None else out


def read_hits(spark: SparkSession, path: str, schema: str = HITS) -> DataFrame:
    """Headerless tab-separated alignment rows, split by the reader."""
    return spark.read.csv(path, schema=schema, sep="\t")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(key, cluster): a line of keys is a cluster, numbered from 0 in the order of (file name, line).

    Lines are placed by file and the split's order inside it (a split's row numbers grow, and splits are ordered by their first
    byte); numbers come from counts by split and their prefix sums, so no window holds more than a split's lines."""
    from pyspark.sql import Window as W

    part = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")]
    lines = spark.read.text(path).select("value", *part, F.monotonically_increasing_id().alias("n")).where(F.trim("value") != "")
    sizes = lines.groupBy("f", "b").agg(F.count("*").alias("k"))
    first = sizes.withColumn("first", F.sum("k").over(W.orderBy("f", "b")) - F.col("k")).drop("k")  # a row per file split
    numbered = lines.withColumn("r", F.row_number().over(W.partitionBy("f", "b").orderBy("n")) - 1).join(first, ["f", "b"])
    return numbered.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("key"), (F.col("first") + F.col("r")).cast("long").alias("cluster"))


def read_a3m(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, aligned): insertions (lower case) dropped; unequal lengths in a file raise."""
    rows = read_fasta(spark, path).select(F.input_file_name().alias("file"), "id", F.regexp_replace("sequence", "[a-z]", "").alias("aligned"))
    sizes = rows.groupBy("file").agg(F.min(F.length("aligned")).alias("low"), F.max(F.length("aligned")).alias("high"))
    checked = sizes.select(F.col("file").alias("__f"), F.assert_true(F.col("low") == F.col("high"), F.lit("aligned rows differ in length")).alias("ok"))
    return rows.join(checked, F.col("file") == F.col("__f")).where(F.col("ok").isNull()).drop("__f", "ok")


def read_score_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, stem, i, j, score) of square `score` matrices in `<dataset>__<stem>.npz` files; others are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                name = p.rsplit("/", 1)[-1][: -len(".npz")]
                with np.load(io.BytesIO(content)) as z:
                    m = z["score"] if "score" in z.files else None
                if m is None or m.ndim != 2 or m.shape[0] != m.shape[1] or "__" not in name:
                    continue
                dataset, stem = name.split("__", 1)
                n = len(m)
                yield pa.RecordBatch.from_arrays([pa.array([dataset] * (n * n)), pa.array([stem] * (n * n)), pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n)), pa.array(m.astype("f8").ravel())], ["dataset", "stem", "i", "j", "score"])

    return files.mapInArrow(run, "dataset string, stem string, i long, j long, score double")


def read_zipped_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(archive, member, columns as strings) of the CSV members of ZIP files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches):
        import csv
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if n.endswith(".csv")):
                        rows = list(csv.DictReader(io.TextIOWrapper(z.open(member), "utf-8")))
                        yield pa.RecordBatch.from_arrays([pa.array([p.rsplit("/", 1)[-1]] * len(rows), pa.string()), pa.array([member] * len(rows), pa.string()), *[pa.array([r.get(c) for r in rows], pa.string()) for c in columns]], ["archive", "member", *columns])

    return files.mapInArrow(run, "archive string, member string, " + ", ".join(f"{c} string" for c in columns))


def scan_headers(spark: SparkSession, path: str, items: dict[str, str]) -> DataFrame:
    """Flat metadata of mmCIF-like texts: for each column the value of a `_category.item value` line; `error` holds what went wrong."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    text = F.decode("content", "utf-8")
    cols = []
    for name, item in items.items():
        pattern = "(?m)^" + item.replace(".", r"\.") + r"[ \t]+(?:'([^'\n]*)'|\"([^\"\n]*)\"|(\S+))"
        value = F.concat(*[F.regexp_extract(text, pattern, g) for g in (1, 2, 3)])
        cols.append(F.nullif(F.nullif(F.nullif(value, F.lit("")), F.lit("?")), F.lit(".")).alias(name))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), *cols, F.when(F.length(text) == 0, "empty file").alias("error"))


def read_keyed_parts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Parquet parts; where the key column is absent it is the file's stem."""
    df = spark.read.parquet(path)
    return df if key in df.columns else df.withColumn(key, F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet$", 1))


def size_groups(files: DataFrame, n: int) -> DataFrame:
    """(path, size, group): files dealt to n groups of near equal bytes by their running size in path order; no group is split over
    a scan because spark.sql.files.maxPartitionBytes does the rest."""
    from pyspark.sql import Window as W

    before = F.sum("size").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    total = F.sum("size").over(W.partitionBy())
    return files.withColumn("group", F.least(F.floor((before + F.col("size") / 2) * n / F.greatest(total, F.lit(1))), F.lit(n - 1)).cast("int"))


def registry(entries: Sequence[dict], required: Sequence[str], unique: str) -> list[dict]:
    """Entries of a registry, checked: required fields are there and names don't repeat."""
    names = set()
    for e in entries:
        missing = [f for f in required if not e.get(f)]
        if missing:
            raise ValueError(f"{e} lacks {missing}")
        if e[unique] in names:
            raise ValueError(f"{e[unique]} is there twice")
        names.add(e[unique])
    return list(entries)
