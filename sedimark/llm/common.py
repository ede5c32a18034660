"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a local master (tests) may do without: a folder of this
    machine then; on a cluster a machine's own folder would be read in parts, so that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return os.path.join(tempfile.gettempdir(), f"sedimark-checkpoints-{os.getpid()}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files: a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """df checkpointed, after a large shuffle. Spark deletes the shuffle files and checkpoints of frames that nobody holds any more when
    the driver's heap is collected, so that is asked for here: otherwise the disk holds those of all steps so far."""
    out = checkpointed(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session wrote and nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns that an operator is about to add (case-insensitively, as Spark resolves names)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def chunks(batches: Iterator, column: str, limit: int = 2 << 20) -> Iterator:
    """Cut Arrow batches to slices of about `limit` bytes of `column` (one row at least), so that memory does not follow the batch size."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            rest = batch.slice(start)
            del batch  # not held while the next one is read
            yield rest
            del rest


def key_runs(batches: Iterator, columns: list[str], most: int) -> Iterator[list]:
    """Arrow batches sorted by the first column -> lists of arrays, one per column, of about `most` rows that end between keys. A key
    larger than that is held alone; its batches are put together once."""
    import numpy as np

    held: list[list] = []
    rows, last = 0, None

    def whole():
        return [np.concatenate(x) for x in zip(*held)]

    for b in batches:
        if not b.num_rows:
            continue
        part = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if rows >= most and part[0][-1] != last:  # what is held can go: it ends where this batch's first new key begins
            cut = int(np.searchsorted(part[0], last, "right"))
            held.append([c[:cut] for c in part])
            yield whole()
            held, rows, part = [], 0, [c[cut:] for c in part]
        held.append(part)
        rows += len(part[0])
        last = part[0][-1]
    if rows:
        yield whole()


#: What operators keep in a Python worker from task to task: a function that frees it, by operator.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(owner: str | None) -> None:
    """At a task's start: frees what other operators keep in this worker and hands free memory back to the system, so that a
    worker holds one operator's tables at a time."""
    import ctypes
    import gc

    for name, free in KEPT.items():
        if name != owner:
            free()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # not glibc: nothing to hand back


def map_arrow(df: DataFrame, make: Callable[[], Callable], schema, owner: str | None = None) -> DataFrame:
    """mapInArrow with a per-task initialiser: make() runs once in the worker and returns batches -> batches."""

    def run(batches):
        tidy(owner)
        yield from make()(batches)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b), for every node named in an edge.

    Alternating large-star and small-star rounds (O(log^2 n) of them). Each round is two map-side combined minima and two
    shuffle joins, which the adaptive planner splits where a hub is hot; between rounds the edges go to the checkpoint
    folder. Nothing is collected but a row count and a checksum. Self edges are allowed; null nodes are left out.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    e = checkpointed(e.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    seen = None
    while True:
        # large star: every larger neighbour of a node is joined to the node's smallest neighbour (itself included)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.where("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and the node itself are joined to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = now
