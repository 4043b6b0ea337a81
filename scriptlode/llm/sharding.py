"""Sharding by best-fit-decreasing bin packing (operator 1).

Documents with equal texts form one indivisible group. Groups sorted by size enter the bin with the
tightest remaining capacity that still holds them; a balanced tree over the remaining capacities finds
that bin in logarithmic time. Packing is sequential by nature, so it runs over a bounded number of units:
a group larger than 1/UNITS of all bytes is a unit of its own (there are fewer than UNITS of them), and
all smaller groups are gathered by hash into UNITS bundles. Sizes, group sums, assignment and slots are
Spark jobs over all rows; only the sizes of the units, about 2 * UNITS numbers, reach the driver.

With a given capacity a bundle is at most about 1/FINE of a shard. If that needs more than UNITS bundles, the groups are dealt
by hash into parts of about UNITS / FINE shards, and each part is packed by one task; no sizes reach the driver then.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import prefix_sums, spread, staged, table

UNITS = 1 << 13
FINE = 16


class CapacityTree:
    """Bins by remaining capacity in a balanced (AVL) tree."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # (key, left, right, height)

    @staticmethod
    def _node(key, left, right):
        height = 1 + max(left[3] if left else 0, right[3] if right else 0)
        return key, left, right, height

    @classmethod
    def _balanced(cls, key, left, right):
        tilt = (left[3] if left else 0) - (right[3] if right else 0)
        if tilt > 1:
            k, a, b, _ = left
            if (a[3] if a else 0) < (b[3] if b else 0):
                return cls._node(b[0], cls._node(k, a, b[1]), cls._node(key, b[2], right))
            return cls._node(k, a, cls._node(key, b, right))
        if tilt < -1:
            k, a, b, _ = right
            if (a[3] if a else 0) > (b[3] if b else 0):
                return cls._node(a[0], cls._node(key, left, a[1]), cls._node(k, a[2], b))
            return cls._node(k, cls._node(key, left, a), b)
        return cls._node(key, left, right)

    @classmethod
    def _with(cls, node, key):
        if node is None:
            return key, None, None, 1
        k, a, b, _ = node
        return cls._balanced(k, cls._with(a, key), b) if key < k else cls._balanced(k, a, cls._with(b, key))

    @classmethod
    def _without(cls, node, key):
        k, a, b, _ = node
        if key < k:
            return cls._balanced(k, cls._without(a, key), b)
        if key > k:
            return cls._balanced(k, a, cls._without(b, key))
        if a is None or b is None:
            return a or b
        least = b
        while least[1]:
            least = least[1]
        return cls._balanced(least[0], a, cls._without(b, least[0]))

    def add(self, remaining: int, bin_: int) -> None:
        self.root = self._with(self.root, (remaining, bin_))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least remaining capacity that is at least `size`."""
        found, node = None, self.root
        while node:
            if node[0] >= (size, -1):
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found:
            self.root = self._without(self.root, found)
        return found


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item; items are placed from the largest, equal ones in their given order. A new bin is
    opened if none fits; None if that needs more than `most` bins. An item above the capacity has a bin alone."""
    tree, bins, out = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.tightest(sizes[i])
        if at is None:
            if bins == most:
                return None
            at, bins = (max(capacity, sizes[i]), bins), bins + 1
        out[i] = at[1]
        tree.add(at[0] - sizes[i], at[1])
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins for a fixed number of shards: the least capacity for which best fit decreasing needs no more."""
    low = max(-(-sum(sizes) // shards), max(sizes, default=0))
    high = max(low, 2 * low)
    while best_fit_decreasing(sizes, high, shards) is None:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return best_fit_decreasing(sizes, high, shards) or []


def _packed(capacity: int):
    def run(part):
        found = sorted(part.select(["part", "grp", "bundle", "size"]).to_pylist(), key=lambda u: (-u["size"], u["grp"] is None, u["grp"] or 0, u["bundle"] or 0))
        bins = best_fit_decreasing([u["size"] for u in found], capacity)
        return pa.table({"part": pa.array([u["part"] for u in found], pa.int64()), "grp": pa.array([u["grp"] for u in found], pa.int64()),
                         "bundle": pa.array([u["bundle"] for u in found], pa.int64()), "bin": pa.array(bins, pa.int32())})
    return run


def _in_parts(units: DataFrame, capacity: int) -> DataFrame:
    """(part, grp, bundle, bin) of all units, each part packed by itself; the bins of a part follow those of the parts before."""
    packed = staged(units.groupBy("part").applyInArrow(_packed(capacity), "part long, grp long, bundle long, bin int"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    first = packed.groupBy("part").agg((F.max("bin") + 1).alias("bins")).select("part", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("first"))
    return staged(packed.join(F.broadcast(first), "part").select("part", "grp", "bundle", (F.col("bin") + F.col("first")).cast("int").alias("bin")))


def sharded(docs: DataFrame, shards: int | None = None, capacity: int | None = None, units: int = UNITS,
            carry: Column | None = None) -> DataFrame:
    """Shard and slot of every row of `docs` (doc_id, text; other columns only through `carry`).

    Give `shards`, a fixed number of shards of nearly equal bytes, or `capacity`, the bytes of a shard;
    the operator then opens as few shards as best fit decreasing needs. A row's size is the UTF-8 length of its
    text (0 for null) plus 1; all rows with the same text, all nulls too, form one group that is never
    divided, so a group above the capacity has a shard alone. Slots count from 0 without gaps in hash
    order of the ids. Returns doc_id, size, text_crc32 (null for null), shard, slot. Repeated rows have slots of
    their own; an empty table gives no rows.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.col("text").cast("binary")
    group = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    key = spread(F.col("doc_id"), F.col("text"))
    narrow = staged(docs.select(group.alias("grp"), size.alias("size"), key.alias("key")))
    groups = staged(narrow.groupBy("grp").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total * FINE // (capacity * units))) if capacity else 1
    part, bundle = F.pmod(F.xxhash64("grp"), F.lit(parts)), F.pmod("grp", F.lit(units))
    groups = groups.withColumn("part", part).withColumn("bundle", bundle)
    own = groups.filter(F.col("size") * F.lit(units * parts) > total)  # fewer than `units` rows for each part, but for chance
    small = groups.filter(F.col("size") * F.lit(units * parts) <= total)
    rest = small.groupBy("part", "bundle").agg(F.sum("size").alias("size"))
    if capacity:  # a bundle that chance made large is packed by its groups
        heavy = F.col("size") * 4 > capacity
        own = own.unionByName(small.join(rest.filter(heavy).select("part", "bundle"), ["part", "bundle"], "left_semi").select(own.columns))
        rest = rest.filter(~heavy)
    listed = own.select("part", "grp", F.lit(None).cast("long").alias("bundle"), "size").unionByName(
        rest.select("part", F.lit(None).cast("long").alias("grp"), F.col("bundle").cast("long").alias("bundle"), "size"))
    if parts > 1:
        at = _in_parts(listed, capacity)
        hint = lambda df: df
    else:
        found = [(r.grp, r.bundle, r.size) for r in listed.collect()]
        found.sort(key=lambda u: (-u[2], u[0] is None, u[0] or 0, u[1] or 0))
        sizes = [u[2] for u in found]
        bins = pack(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
        at = docs.sparkSession.createDataFrame([(0, u[0], u[1], b) for u, b in zip(found, bins)], "part long, grp long, bundle long, bin int")
        hint = F.broadcast
    large = at.filter("grp IS NOT NULL").select("grp", F.col("bin").alias("own_shard"))
    bundled = at.filter("grp IS NULL").select("part", "bundle", F.col("bin").alias("bundle_shard"))

    def placed(df):
        return (df.withColumn("part", part).withColumn("bundle", bundle).join(hint(large), "grp", "left").join(hint(bundled), ["part", "bundle"], "left")
                .withColumn("shard", F.coalesce("own_shard", "bundle_shard")).drop("grp", "part", "bundle", "own_shard", "bundle_shard"))

    wide = placed(docs.select("doc_id", group.alias("grp"), size.alias("size"), key.alias("key"),
                              F.crc32(text).alias("text_crc32"), (carry if carry is not None else F.lit(None)).alias("carry")))
    one = F.lit(1).cast("long")
    slots = prefix_sums(wide.withColumn("one", one).withColumn("tie", F.struct("doc_id", "text_crc32")),
                        placed(narrow).withColumn("one", one), "shard", "key", "one", "tie")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("before").cast("long").alias("slot"), "carry")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the documents with their shard (0 to 7) and slot. Columns of these names are replaced."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    out = sharded(docs, shards=8, carry=F.struct(*[F.col(c) for c in columns]))
    return out.select("carry.*", "shard", "slot")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of 8; shards hold nearly equal bytes."""
    return sharded(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
