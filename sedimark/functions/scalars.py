"""Scalar column functions: keys, seeds, bins, ladders and small parsers. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_seed(key: Column) -> Column:
    """First eight hex digits of sha1(key) as a long: all randomness of a record derives from it."""
    return F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once per row: a column that a lambda uses would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyed_uniform(key: Column, *salt) -> Column:
    """Uniform in [0, 1) from a key and salts: the first 13 hex digits of a sha1 over 2**52."""
    parts = F.concat_ws("|", key.cast("string"), *[F.lit(str(s)) if not isinstance(s, Column) else s.cast("string") for s in salt])
    return F.conv(F.substring(F.sha1(parts.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def keyed_hash(key: Column, *salt) -> Column:
    """Hex sha1 of key and salts, the order of deterministic shuffles."""
    parts = F.concat_ws("|", key.cast("string"), *[F.lit(str(s)) if not isinstance(s, Column) else s.cast("string") for s in salt])
    return F.sha1(parts.cast("binary"))


def split_label(key: Column, val_per_mille: int = 10, test_per_mille: int = 10) -> Column:
    """test, val or train by key_seed modulo 1000."""
    bucket = F.pmod(key_seed(key), F.lit(1000))
    return F.when(bucket < test_per_mille, "test").when(bucket < test_per_mille + val_per_mille, "val").otherwise("train")


def bucket_label(value: Column, edges: Sequence[float], labels: Sequence[str], missing: str | None = None) -> Column:
    """Right-open bins: label i below edges[i], the last label from the last edge on."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges")
    out = F.when(value.isNull(), F.lit(missing))
    for e, name in zip(edges, labels):
        out = out.when(value < e, name)
    return out.otherwise(labels[-1])


def ladder(*steps: tuple[Column, str], otherwise: str | None = None) -> Column:
    """First condition that holds names the row."""
    first, *rest = steps
    out = F.when(*first)
    for cond, name in rest:
        out = out.when(cond, name)
    return out.otherwise(F.lit(otherwise))


def novelty_stratum(n_significant: Column, identity: Column) -> Column:
    """no_homolog, remote, then right-open identity bands."""
    return ladder(
        (F.coalesce(n_significant, F.lit(0)) == 0, "no_homolog"),
        (identity.isNull() | (identity < 0.20), "remote"),
        (identity < 0.30, "id_20_30"), (identity < 0.50, "id_30_50"), (identity < 0.70, "id_50_70"),
        otherwise="id_ge_70",
    )


def similarity_verdict(best: Column, fold: float = 0.5, redundant: float = 0.9) -> Column:
    """redundant, same_fold or novel; missing is novel."""
    return ladder((best >= redundant, "redundant"), (best >= fold, "same_fold"), otherwise="novel")


def depth_tier(depth: Column) -> Column:
    """missing, orphan, low, marginal or deep."""
    return ladder((depth.isNull(), "missing"), (depth <= 1, "orphan"), (depth < 16, "low"), (depth < 64, "marginal"), otherwise="deep")


def distance_bin(distance: Column, width: float = 0.5, bins: int = 64) -> Column:
    """1-based bin of fixed width, closed above; the last is open."""
    return F.least(F.greatest(F.ceil(distance / width), F.lit(1)), F.lit(bins)).cast("int")


def quality_bin(value: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge greater than value; past the last edge, their number."""
    out = F.when(value < edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(value < e, i)
    return out.otherwise(len(edges))


def bucket_size(n: Column, buckets: Sequence[int]) -> Column:
    """Smallest bucket of at least n, else n."""
    out = F.when(n <= min(buckets), min(buckets))
    for b in sorted(buckets)[1:]:
        out = out.when(n <= b, b)
    return out.otherwise(n)


def half_precision(x: Column) -> Column:
    """x as a half-precision float holds it: eleven significant bits, ties to even, steps of 2^-24 below 2^-14, infinity from 65520 on."""
    x = x.cast("double")
    unit = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 10), F.lit(2.0**-24))
    return F.when(F.isnan(x), x).when(F.abs(x) >= 65520, F.signum(x) * float("inf")).otherwise(F.rint(x / unit) * unit)


def grid_cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def neighbour_cells(x: Column, y: Column, z: Column, with_own: bool = False) -> Column:
    """array<struct<x,y,z>> of the 26 cells around a grid cell, or 27 with its own."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if with_own or (i, j, k) != (0, 0, 0)]
    return F.array(*[F.struct((x + i).alias("x"), (y + j).alias("y"), (z + k).alias("z")) for i, j, k in steps])


def canonical_pairs(flat: Column, least_gap: int = 6) -> Column:
    """array<int> of flat pairs -> sorted distinct array<struct<i,j>> with i < j and j - i >= least_gap."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda k: F.struct(F.least(flat[2 * k], flat[2 * k + 1]).alias("i"), F.greatest(flat[2 * k], flat[2 * k + 1]).alias("j")))
    safe = F.when(F.size(flat) >= 2, pairs).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    return F.array_sort(F.array_distinct(F.filter(safe, lambda p: p["j"] - p["i"] >= least_gap)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))


def group_key(cluster_ids: Column, sequence_sha1: Column) -> Column:
    """Sorted cluster tuple, or (number of chains, hash) where any id is negative; the two namespaces are disjoint."""
    tupled = F.concat(F.lit("clusters:"), F.array_join(F.transform(F.array_sort(cluster_ids), lambda c: c.cast("string")), ","))
    hashed = F.concat(F.lit("seq:"), F.size(cluster_ids).cast("string"), F.lit(":"), sequence_sha1)
    return F.when(F.exists(cluster_ids, lambda c: c < 0), hashed).otherwise(tupled)


def parse_address(address: Column, arms: Sequence[str]) -> Column:
    """`arm|shard_row_entry` -> struct; an unknown arm or non-digit parts raise."""
    pattern = r"^([^|]+)\|(\d+)_(\d+)_(.+)$"
    arm = F.regexp_extract(address, pattern, 1)
    value = F.struct(arm.alias("arm"), F.regexp_extract(address, pattern, 2).cast("int").alias("shard"), F.regexp_extract(address, pattern, 3).cast("int").alias("row"), F.regexp_extract(address, pattern, 4).alias("entry_id"))
    return F.when(arm.isin(*arms), value).otherwise(F.raise_error(F.concat(F.lit("not a row address: "), address)))


def address(arm: Column, shard: Column, row: Column, entry: Column) -> Column:
    return F.concat(arm, F.lit("|"), F.lpad(shard.cast("string"), 5, "0"), F.lit("_"), row.cast("string"), F.lit("_"), entry)


def base_entry(name: Column) -> Column:
    """Upper-case entry without an assembly suffix such as `-assembly1`."""
    return F.upper(F.substring_index(name, "-", 1))


def base_chain(name: Column) -> Column:
    """A chain's name without the number of a symmetry copy (`A-2` is chain A)."""
    return F.regexp_replace(name, r"-\d+$", "")


def parse_mutations(variants: Column) -> Column:
    """`A24G:D30N` -> array<struct<wild,position (from 0),mutant>>; empty or null gives an empty array."""
    parts = F.filter(F.split(F.coalesce(variants, F.lit("")), ":"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1).alias("wild"), (F.substr(p, F.lit(2), F.length(p) - 2).cast("int") - 1).alias("position"), F.substr(p, F.length(p), F.lit(1)).alias("mutant")))


def low_entropy_share(letters: Column, width: int, least: float) -> Column:
    """Share of the sliding windows of `width` elements of an array whose Shannon entropy, in bits, is below `least`; 0 without a full
    window. Each window is n log2 n summed over its letters: H = log2(width) - sum(n log2 n) / width, and an element with n
    equals in its window brings log2 n."""
    import math

    starts = F.when(F.size(letters) >= width, F.sequence(F.lit(1), F.size(letters) - (width - 1))).otherwise(F.array().cast("array<int>"))

    def entropy(s: Column) -> Column:
        window = F.slice(letters, s, width)
        total = F.aggregate(window, F.lit(0.0), lambda acc, c: acc + F.log2(F.size(F.filter(window, lambda x: x == c)).cast("double")))
        return math.log2(width) - total / width

    low = F.size(F.filter(starts, lambda s: entropy(s) < least))
    return low / F.greatest(F.size(starts), F.lit(1))


def quota(total: int, finite: int, others: int) -> list[int]:
    """A finite source first, then the rest split evenly (earlier sources get the remainder)."""
    first = min(total, finite)
    rest = total - first
    return [first, *[rest // others + (i < rest % others) for i in range(others)]]


#: The twenty amino acids' three-letter and one-letter names.
AMINO = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), "ARNDCQEGHILKMFPSTWYV"))


def residues(sequence: Column) -> Column:
    """Trimmed, upper-cased one-letter sequence -> array of three-letter names, UNK for others."""
    names = F.create_map(*[F.lit(x) for k, v in AMINO.items() for x in (v, k)])
    letters = F.filter(F.split(F.upper(F.regexp_replace(sequence, r"\s", "")), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.coalesce(F.try_element_at(names, c), F.lit("UNK")))


def operator_count(expression: Column) -> Column:
    """Number of operators of an assembly expression such as `(1-5)(6,7)`: the product over its bracketed lists."""
    groups = F.regexp_extract_all(expression, F.lit(r"\(([^)]*)\)"), F.lit(1))
    groups = F.when(F.size(groups) == 0, F.array(expression)).otherwise(groups)

    def one(item: Column) -> Column:
        low, high = F.regexp_extract(item, r"^\s*(\d+)-(\d+)\s*$", 1), F.regexp_extract(item, r"^\s*(\d+)-(\d+)\s*$", 2)
        return F.when(low != "", high.try_cast("int") - low.try_cast("int") + 1).otherwise(1)

    return F.aggregate(groups, F.lit(1), lambda acc, g: acc * F.aggregate(F.split(g, ","), F.lit(0), lambda n, item: n + one(item)))


def shard_ranges(text: Column) -> Column:
    """`0-2,20` -> array of ints [0, 1, 2, 20]."""
    return F.flatten(F.transform(F.split(text, ","), lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))))
