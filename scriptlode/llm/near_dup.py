"""Near-duplicate documents by BagMinHash (operator 9).

A document is the multiset of its five-word shingles (lower-cased words). For every shingle a
hierarchy of Poisson processes runs over its discretised weight: level 0 covers weight (0, 1], level l
covers (2^(l-1), 2^l] with that interval's width as rate. Each arrival picks a signature slot and a
unit weight inside the interval and counts only if the shingle's multiplicity reaches that unit. A slot
keeps the earliest arrival, so two signatures agree in a slot with probability equal to the weighted
Jaccard similarity of the multisets. All arrivals later than the latest slot are skipped, which makes
the signature cheap for long documents.

Bands of slots give candidate buckets. Equal multisets are one class from the start. Members of a bucket
are compared with one head, not with each other, in a few rounds with other heads for what is not yet
in one component. What is still apart then is joined exactly: each multiset's rarest shingles, as many as
the prefix filter for the similarity asks for, are the join keys, so texts that only share a frequent
passage never meet, and no link between different texts of a bucket is lost. Every link is verified by
the exact weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import SIMILAR, components, hashed, mix, multiset, pieces, shingles, staged, table, text_key, word_lists

BANDS, ROWS = 64, 8  # a pair at similarity 0.8 shares no bucket with probability 0.000008
ROUNDS = 3

_BAGS = "doc_id long, key string, bag long, n_units long, bands array<long>"
_UNIT = np.uint64(0x9E3779B97F4A7C15)


def signatures(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """BagMinHash signatures, one row of `slots` arrival times per multiset; infinity for an empty one."""
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))  # interval (low, low + width]
    width = np.maximum(low, 1)
    seed = mix(hashes[which] + level.astype(np.uint64) * _UNIT)
    row, reach, rate = owner[which], weight[which] - low, width.astype(np.float64)
    when, turn = np.zeros(len(which)), 0
    best = np.full(n_rows * slots, np.inf)
    while len(row):
        turn += 1
        draw = mix(seed + np.uint64(turn * int(_UNIT) % 2 ** 64))
        when = when - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / rate
        draw = mix(draw + _UNIT)
        unit = (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % width
        slot = (draw >> np.uint64(32)).astype(np.int64) % slots
        counts = unit < reach
        np.minimum.at(best, row[counts] * slots + slot[counts], when[counts])
        live, place = np.unique(row, return_inverse=True)
        latest = best.reshape(n_rows, slots)[live].max(axis=1)
        on = when < latest[place]
        seed, row, reach, rate, width, when = seed[on], row[on], reach[on], rate[on], width[on], when[on]
    return best.reshape(n_rows, slots)


def _units(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each unit of multiplicity: the multiset written as a set."""
    which = np.repeat(np.arange(len(hashes)), weight)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(weight) - weight, weight)
    return mix(hashes[which] + turn.astype(np.uint64) * _UNIT), owner[which]


def _sign(bands: int, rows: int):
    def run(batches):
        for piece in pieces(batches, "text"):
            words, counts = word_lists(piece.column("text"))
            h, o = shingles(hashed(words), counts)
            h, o, w = multiset(h, o)
            n = piece.num_rows
            best = signatures(h, o, w, n, bands * rows).view(np.uint64).reshape(n, bands, rows)
            band = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
            for j in range(rows):
                band = mix(band * _UNIT + best[:, :, j] + np.uint64(j))
            units, owner = _units(h, o, w)
            size = np.bincount(owner, minlength=n)
            digest = np.zeros(n, np.uint64)
            np.add.at(digest, owner, mix(units + _UNIT))
            some = size > 0
            offsets = np.r_[0, np.cumsum(np.where(some, bands, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), piece.column("key"),
                pa.array(mix(digest).view(np.int64)), pa.array(size.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].ravel().view(np.int64)))],
                names=["doc_id", "key", "bag", "n_units", "bands"])
    return run


def _unit_lists(batches):
    for piece in pieces(batches, "text"):
        words, counts = word_lists(piece.column("text"))
        units, owner = _units(*multiset(*shingles(hashed(words), counts)))
        size = np.bincount(owner, minlength=piece.num_rows)
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [piece.column("bag"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(units.view(np.int64)))],
            names=["bag", "units"])


def _verified(pairs: DataFrame, units: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) whose exact weighted Jaccard similarity reaches `similar`."""
    left = units.select(F.col("bag").alias("a"), F.col("units").alias("ua"))
    right = units.select(F.col("bag").alias("b"), F.col("units").alias("ub"))
    common = F.size(F.array_intersect("ua", "ub"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(common >= F.lit(similar) * (F.size("ua") + F.size("ub") - common)).select("a", "b"))


def _apart(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """(bucket, bag, label) of the buckets that hold several components; a bag without links is its own."""
    if label is None:
        return shared.withColumn("label", F.col("bag"))
    at = shared.join(label, shared["bag"] == label["node"], "left").select("bucket", "bag", F.coalesce("label", "bag").alias("label"))
    several = (at.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
               .filter("lo <> hi").select("bucket"))
    return staged(at.join(several, "bucket", "left_semi"))


def _prefix_pairs(at: DataFrame, units: DataFrame, similar: float) -> DataFrame:
    """Pairs of different components among the bags of `at` that can reach `similar`, by prefix, length and
    positional filters. With t the similarity, units of a bag ordered from the rarest, and na <= nb:
    J(a, b) >= t needs an overlap of t / (1 + t) * (na + nb), so a and b share one of the first
    na - 2t / (1 + t) na + 1 units of a and the first nb - t nb + 1 units of b, and behind their first
    common units at places i and j there must be enough left."""
    member = at.select("bag", "label").distinct()
    listed = units.join(member, "bag").select("bag", "label", F.size("units").alias("n"), F.explode("units").alias("unit"))
    often = listed.groupBy("unit").agg(F.count(F.lit(1)).alias("df"))
    ranked = (listed.join(often, "unit").groupBy("bag", "label", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "unit"))).alias("us")))  # one document's units
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    post = staged(ranked.select("bag", "label", "n", F.posexplode("us").alias("at", "u"))
                  .filter((F.col("u.df") > 1) & (F.col("at") < first(similar))).select("bag", "label", "n", "at", "u.unit"))
    half = similar / (1 + similar)
    one = post.filter(F.col("at") < first(2 * half)).select("unit", *[F.col(c).alias(c[0] + "a") for c in ("bag", "label", "n", "at")])
    two = post.select("unit", *[F.col(c).alias(c[0] + "b") for c in ("bag", "label", "n", "at")])
    left = 1 + F.least(F.col("na") - F.col("aa") - 1, F.col("nb") - F.col("ab") - 1)
    return (one.join(two, "unit").filter(
        (F.struct("na", "ba") < F.struct("nb", "bb")) & (F.col("la") != F.col("lb"))
        & (F.col("na") >= F.lit(similar) * F.col("nb") - 1e-9) & (left >= F.lit(half) * (F.col("na") + F.col("nb")) - 1e-9))
        .select(F.col("ba").alias("a"), F.col("bb").alias("b")).distinct())


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """Near-duplicate class of every row of `docs` (doc_id, text; other columns are ignored).

    Returns doc_id, key (digest of the text), class_id (least doc_id of the class; null only if all its
    ids are null), class_size and kept (true for the row with the least doc_id, then least key).
    A class is a connected component of links with weighted Jaccard similarity >= `similar`. A null text
    is a class of its own; texts without a word are one class; repeated rows are one class and all
    marked alike. An empty table gives no rows.
    """
    bags = staged(docs.select(F.col("doc_id").cast("long"), "text", text_key(F.col("text")).alias("key"))
                  .mapInArrow(_sign(bands, rows), _BAGS))
    known = bags.filter("key IS NOT NULL AND n_units > 0")
    # Copies collapse before the buckets are made; a bucket of one multiset is no candidate.
    posts = known.select("bag", "bands").dropDuplicates(["bag"]).select("bag", F.explode("bands").alias("bucket"))
    full = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    shared = staged(posts.join(full, "bucket"))

    holders = known.join(shared.select("bag").distinct(), "bag", "left_semi").groupBy("bag").agg(F.min("key").alias("key"))
    units = staged(docs.select("text", text_key(F.col("text")).alias("key"))
                   .join(holders.hint("shuffle_hash"), "key").dropDuplicates(["key"]).select("bag", "text")
                   .mapInArrow(_unit_lists, "bag long, units array<long>"))

    links = label = None
    for turn in range(ROUNDS):
        at = _apart(shared, label)
        head = at.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bag", F.lit(turn)).alias("h"), "bag", "label")).alias("head"))
        stars = (at.join(head, "bucket").filter(F.col("label") != F.col("head.label"))
                 .select(F.col("bag").alias("a"), F.col("head.bag").alias("b")).distinct())
        found = staged(_verified(stars, units, similar))
        links = found if links is None else links.unionByName(found)
        label = components(links)
    rest = _verified(_prefix_pairs(_apart(shared, label), units, similar), units, similar)
    label = components(links.unionByName(rest))

    rows_ = bags.join(label, bags["bag"] == label["node"], "left").select(
        "doc_id", "key",
        F.when(F.col("key").isNotNull(), F.coalesce("label", "bag")).alias("label"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    sizes = (rows_.filter("label IS NOT NULL").groupBy("label")
             .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("class_size")))
    return rows_.join(sizes, "label", "left").select(
        "doc_id", "key", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.when(F.col("label").isNull(), F.lit(True)).otherwise(
            F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key"))).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: one document of each near-duplicate class stays, the one with the least doc_id; of rows with
    the same doc_id and text one stays. Null texts stay. All columns are returned."""
    gone = staged(classes(docs))
    keep = gone.filter("kept AND key IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("key").alias("__k")).distinct()
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    kept = keyed.join(keep, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left_semi")
    again = Window.partitionBy("__key", "doc_id").orderBy("__key")
    return (kept.withColumn("__n", F.row_number().over(again)).filter("__n = 1").select(docs.columns)
            .unionByName(docs.filter(F.col("text").isNull())))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
