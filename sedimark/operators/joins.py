"""Joins with contracts (J operators). Sides are broadcast by the planner from their measured size, never by hint here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").limit(1)


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "many_to_one", require_match: bool = False) -> DataFrame:
    """Equi-join that raises if the right side (one_to_one: either side) repeats a key, or, asked to, if a left row has no match."""
    for side, frame in (("right", right), *((("left", left),) if validate == "one_to_one" else ())):
        if not _repeated(frame, keys).isEmpty():
            raise ValueError(f"the {side} side repeats a key of {list(keys)}")
    if require_match and not left.join(right, list(keys), "left_anti").limit(1).isEmpty():
        raise ValueError(f"rows of the left side have no match by {list(keys)}")
    return left.join(right, list(keys), how)


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members, list(keys), "left_semi")


def drop_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members, list(keys), "left_anti")


def disjoint(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    return a.join(b, list(keys), "left_semi").limit(1).isEmpty()


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer comparison: keys, value_left, value_right and agrees (nulls agree with nulls) for each value."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values], F.lit(True).alias("in_left"))
    b = right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values], F.lit(True).alias("in_right"))
    out = a.join(b, list(keys), "full").fillna(False, ["in_left", "in_right"])
    same = F.col("in_left") & F.col("in_right")
    for v in values:
        same = same & F.col(f"{v}_left").eqNullSafe(F.col(f"{v}_right"))
    return out.withColumn("agrees", same)


def pairs_within(df: DataFrame, key: str, index: str, least_gap: int) -> DataFrame:
    """Ordered pairs i < j of a group's indices with j - i >= least_gap: (key, i, j). The group's list must be short."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_set(index)).alias("all"))
    i = lists.select(key, "all", F.explode("all").alias("i"))
    return i.select(key, "i", F.explode(F.filter("all", lambda x: x - F.col("i") >= least_gap)).alias("j"))


def within_distance(a: DataFrame, b: DataFrame, radius: float, axes: Sequence[str] = ("x", "y", "z"), ids: tuple[str, str] = ("id", "id"), size: int = 8192) -> DataFrame:
    """Pairs (a_id, b_id, distance) within radius: grid cells of that size make it an equi-join; each row of a looks into
    its neighbouring cells.

    What two sides of a cell have to compare is cut into tiles of about `size` rows by `size` rows, which are dealt to all shuffle partitions:
    few cells, or one that holds most rows, are not few tasks, and neither side is broadcast, as pairs grow faster than bytes. A row is
    shuffled once per tile of its cell's other side, so tiles are as large as a task's buffer of one side may be: of all pairs compared, one in size / 2 is a shuffled row."""
    left, right, key = tiled(a, b, radius, axes, ids, size)
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    square = sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 for x in axes), F.lit(0.0))
    both = left.repartition(n, *key).hint("merge").join(right.repartition(n, *key), key)
    return both.withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius).select("a_id", "b_id", "distance")


def tiled(a: DataFrame, b: DataFrame, radius: float, axes: Sequence[str], ids: tuple[str, str], size: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of `within_distance` as rows of tiles, and the columns that name a tile."""
    cell = [F.floor(F.col(x) / radius).cast("long") for x in axes]
    cells = [f"c_{x}" for x in axes]
    shifts = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = a.select(F.col(ids[0]).alias("a_id"), *[F.col(x).alias(f"a_{x}") for x in axes], *[c.alias(n) for c, n in zip(cell, cells)])
    for x in axes:
        left = left.withColumn(f"__s_{x}", F.explode(shifts)).withColumn(f"c_{x}", F.col(f"c_{x}") + F.col(f"__s_{x}")).drop(f"__s_{x}")
    right = b.select(F.col(ids[1]).alias("b_id"), *[F.col(x).alias(f"b_{x}") for x in axes], *[c.alias(n) for c, n in zip(cell, cells)])
    number = lambda d, name: d.groupBy(*cells).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    tiles = number(left, "__na").join(number(right, "__nb"), cells)  # of cells that hold rows of both
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda row, n: F.pmod(F.xxhash64(row), F.col(n)).cast("int")
    left = left.join(tiles, cells).withColumn("__i", own("a_id", "__na")).withColumn("__j", every("__nb")).drop("__na", "__nb")
    right = right.join(tiles, cells).withColumn("__j", own("b_id", "__nb")).withColumn("__i", every("__na")).drop("__na", "__nb")
    return left, right, [*cells, "__i", "__j"]


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside [start, end) by key: spans are laid over bins of `width`, so the range join is an equi-join on the bin."""
    s = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    return p.join(s, [*keys, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], width: str = "1 month") -> DataFrame:
    """Left rows with the latest right values (those that aren't null) at or before them, as asof_<value>. A null key equals nothing: such left
    rows have no values, such right rows aren't used. A null time is before all others on the left and unused on the right.

    Both sides meet in windows by key and bucket of `width` (a calendar unit or a number of them), not in one window per key: each
    bucket's last values are carried over to the later buckets of the key, by a window over a row per bucket."""
    from pyspark.sql import Window as W

    count, unit = width.split(" ")
    cell = F.floor((F.year(at) * 12 + F.month(at) - 1) / int(count)) if unit.startswith("month") else F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / (int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]))
    tagged = left.select(*keys, F.col(at), F.struct("*").alias("__row"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("__side"))
    right = right.where(" and ".join(f"`{k}` is not null" for k in [*keys, at]))
    other = right.select(*keys, F.col(at), F.lit(None).cast(tagged.schema["__row"].dataType).alias("__row"), *values, F.lit(0).alias("__side"))
    both = tagged.unionByName(other).withColumn("__cell", cell)
    w = W.partitionBy(*keys, "__cell").orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    cells = both.groupBy(*keys, "__cell").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(at))).alias(f"__last_{v}") for v in values])  # a left row's values are null
    earlier = W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    carried = cells.select(*keys, "__cell", *[F.last(f"__last_{v}", ignorenulls=True).over(earlier).alias(f"__carry_{v}") for v in values])
    for v in values:
        both = both.withColumn(f"__{v}", F.last(v, ignorenulls=True).over(w))
    out = both.where("__side = 1").join(carried, [*keys, "__cell"], "left")
    return out.select("__row.*", *[F.coalesce(f"__{v}", f"__carry_{v}").alias(f"asof_{v}") for v in values])


def array_members(df: DataFrame, array: str, members: DataFrame, member: str) -> DataFrame:
    """Rows of which some array element is a member, each row for itself, with the number of its distinct member elements. Only row
    numbers and elements are shuffled by element; rows meet their counts by number."""
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    hit = rows.select("__row", F.explode(F.array_distinct(array)).alias("__m")).join(members.select(F.col(member).alias("__m")).distinct(), "__m", "left_semi")
    return rows.join(hit.groupBy("__row").agg(F.count("*").alias("n_members")), "__row").drop("__row")


def longest_prefix(df: DataFrame, names: DataFrame, column: str, prefix: str) -> DataFrame:
    """df with `matched`, the longest name that column starts with and that only digits follow (null: none). Prefixes of each distinct value
    are joined by equality; rows meet the answer by their value."""
    v = df.select(F.col(column).alias("__v")).where("__v is not null").distinct()
    parts = v.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__v"), F.lit(1))), lambda n: F.substr(F.col("__v"), F.lit(1), n))))
    hit = parts.join(names.select(F.col(prefix).alias("__p")).distinct(), "__p").where(F.regexp_like(F.substr(F.col("__v"), F.length("__p") + 1), F.lit("^[0-9]*$")))
    best = hit.groupBy("__v").agg(F.max_by("__p", F.length("__p")).alias("matched"))
    return df.join(best, F.col(column) == F.col("__v"), "left").drop("__v")


def is_subsequence(query: Column, target: Column) -> Column:
    """Whether query's characters occur in target in order: a fold over target that eats query."""
    rest = F.aggregate(F.split(target, ""), query, lambda q, c: F.when((c != "") & (F.substring(q, 1, 1) == c), F.substr(q, F.lit(2))).otherwise(q))
    return F.length(rest) == 0


def address_mismatches(index: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose (shard, row) and entry_id disagree in either direction."""
    a, b = index.select("shard", "row", F.col("entry_id").alias("entry_a")), other.select("shard", "row", F.col("entry_id").alias("entry_b"))
    return a.join(b, ["shard", "row"], "full").where(~F.col("entry_a").eqNullSafe(F.col("entry_b")))


def alignment_map(rows: DataFrame, query: str = "qaln", target: str = "taln", qstart: str = "qstart", tstart: str = "tstart") -> DataFrame:
    """Adds map<int,int> from 0-based target positions to query positions of a gapped alignment with 1-based starts."""
    q, t = F.split(F.col(query), ""), F.split(F.col(target), "")
    steps = F.arrays_zip(q.alias("q"), t.alias("t"))
    zero = F.struct((F.col(qstart) - 1).cast("int").alias("q"), (F.col(tstart) - 1).cast("int").alias("t"), F.array().cast("array<struct<key:int,value:int>>").alias("pairs"))

    def move(acc: Column, c: Column) -> Column:
        in_q, in_t = (c["q"] != "-") & (c["q"] != ""), (c["t"] != "-") & (c["t"] != "")
        both = F.concat(acc["pairs"], F.when(in_q & in_t, F.array(F.struct(acc["t"].alias("key"), acc["q"].alias("value")))).otherwise(F.array().cast("array<struct<key:int,value:int>>")))
        return F.struct((acc["q"] + in_q.cast("int")).alias("q"), (acc["t"] + in_t.cast("int")).alias("t"), both.alias("pairs"))

    return rows.withColumn("target_to_query", F.map_from_entries(F.aggregate(steps, zero, move, lambda a: a["pairs"])))
