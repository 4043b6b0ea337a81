"""Helpers shared by the operators: tables, staging, words, prefix sums and components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut

SHINGLE = 5
SIMILAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: later jobs neither recompute nor depend on executors."""
    return cut(df)


def text_key(text: Column) -> Column:
    """128-bit digest of a text; null for null."""
    return F.md5(text.cast("binary"))


def split_words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters (ASCII white space), empty for null."""
    blanks = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t-\\r]", " ")  # splitting at one plain character is faster
    return F.array_remove(F.split(blanks, " "), "")


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body`: a lambda variable is not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number_list(values, kind: str = "bigint") -> Column:
    """A constant array column; one literal in the plan, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Bloom:
    """Bloom filter of fixed size over a column of 64-bit hashes; may say yes wrongly, never no wrongly.

    At most `bits` / 64 rows reach the driver, whatever the size of the table: a filter for too many hashes
    fills up and lets everything pass, which costs time and changes no result.
    """

    def __init__(self, hashes: DataFrame, column: str, bits: int = 1 << 20, probes: int = 3):
        self.bits, self.probes = bits, probes
        at = F.explode(F.array(*[self._bit(F.col(column), k) for k in range(probes)]))
        cells = (hashes.select(at.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("mask")))
        filled = [0] * (bits // 64)
        for cell, mask in cells.collect():
            filled[cell] = mask
        self._cells = number_list(filled)

    def _bit(self, h: Column, k: int) -> Column:
        return F.shiftrightunsigned(h, k * 21).bitwiseAND(self.bits - 1).cast("int")

    def maybe(self, h: Column) -> Column:
        one = F.lit(1).cast("long")
        return all_of([F.get(self._cells, F.shiftright(self._bit(h, k), 6)).bitwiseAND(
            F.call_function("shiftleft", one, self._bit(h, k).bitwiseAND(63))) != 0 for k in range(self.probes)])


# -- distributed prefix sums -------------------------------------------------------------------

def prefix_sums(df: DataFrame, narrow: DataFrame, group: str, key: str, value: str, tie: str) -> DataFrame:
    """Add `before`, the sum of `value` over the rows of the same group that come earlier by `key`, `tie`.

    `narrow` holds the group, key and value of the same rows without the rest, so that `df` may carry
    whole texts and is shuffled once. `group` is a number, not null; `key` is a hash spread evenly over
    0 .. 2^32-1. The keys of a group are cut into ranges of about 4096 rows (2^16 ranges at most), so a
    group that holds a third of all rows is summed by many tasks; only the sums of the ranges meet.
    """
    cell = F.shiftright(key, 16)
    cells = staged(narrow.groupBy(F.col(group).alias(group), cell.alias("__cell"))
                   .agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__s")))
    bits = F.least(F.lit(16), F.greatest(F.lit(0), F.ceil(F.log2(F.sum("__n") / 4096)))).cast("int")
    ranges = staged(cells.groupBy(group).agg(bits.alias("__bits")))
    over = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cells.join(ranges, group).groupBy(group, F.expr("shiftright(__cell, 16 - __bits)").alias("__range"))
              .agg(F.sum("__s").alias("__s"))
              .select(group, "__range", F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__start")))
    inside = Window.partitionBy(group, "__range").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(ranges, group).withColumn("__range", F.expr(f"shiftright(shiftright({key}, 16), 16 - __bits)"))
            .withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(starts, [group, "__range"]).withColumn("before", F.col("__start") + F.col("__local"))
            .drop("__range", "__bits", "__start", "__local"))


def spread(*columns: Column) -> Column:
    """Hash of the columns, even over 0 .. 2^32-1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 32)


def least_by_hash(df: DataFrame, key: str, most: int, *tie: str) -> DataFrame:
    """The `most` rows of `df` with the least `key` (even over 0 .. 2^32-1), or all if there are no more.

    A count comes first: rows whose key is far above the expected cut are left out where they are read, so that
    the one task that sorts gets about twice `most` rows, not `most` of every partition. If chance leaves
    too few, the bound is widened, so the result is the same as that of a whole sort.
    """
    n, share = df.count(), 2.0
    while share * most < n:
        near = df.filter(F.col(key) < int(share * most / n * 2 ** 32))
        if near.select(key).count() >= most:
            return near.orderBy(key, *tie).limit(most)
        share *= 8
    return df.orderBy(key, *tie).limit(most)


# -- connected components ----------------------------------------------------------------------

def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label) of each node in `edges` (a, b): label is the least node of its component.

    Alternates the large-star and small-star steps; every round is written to the shared folder and
    nothing is collected. A step never emits more rows than it reads.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = staged(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node")
            .agg(F.min("label").alias("label")))


# -- words of a batch, inside a task -----------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one piece holds about `most` bytes of text, or one long row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        which = np.cumsum(sizes, dtype=np.int64) // most
        edges = np.flatnonzero(np.diff(which, prepend=-1, append=-2))
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield batch.slice(int(lo), int(hi - lo))
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def word_lists(texts: pa.Array, ascii_only: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of a text column one after another, and the number in each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = (pc.ascii_lower if ascii_only else pc.utf8_lower)(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # a text without words splits into one empty word
    if blank.any():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(owner[blank], minlength=len(counts))
        flat = flat.filter(pa.array(~blank))
    return flat, counts


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word of the batch is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return codes[coded.indices.to_numpy(zero_copy_only=False)]


_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                 0xA0761D6478BD642F)]


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a batch and the row of each. A text of fewer than five words has
    one shingle, all its words; a text without words has none."""
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.repeat(counts, counts)
    out = words * _STEPS[0]
    for j in range(1, SHINGLE):
        if len(words) > j:
            out[:-j] += np.where((place + j < length)[:-j], mix(words[j:] + _STEPS[j]) * _STEPS[j], np.uint64(0))
    first = place < np.maximum(length - (SHINGLE - 1), 1)
    return mix(out[first]), owner[first]


def multiset(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their multiplicities, ordered by row."""
    if not len(hashes):
        return hashes, owner, np.zeros(0, np.int64)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    return h[new], o[new], np.diff(np.r_[new, len(h)])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
