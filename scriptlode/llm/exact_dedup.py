"""Exact dedup by a cuckoo-filter index of live digests (operator 13).

Texts are known by the SHA-256 of their normalised form. The index is dealt by digest into parts of bounded size; a part holds a
cuckoo filter (buckets of four 16-bit fingerprints, two candidate buckets for each digest) and, for every slot, the stored key with its
row of keep and its count. A digest whose fingerprint is in neither bucket is new; a hit is verified against the full
digest stored for the slot. When a place can't be found the filter is doubled and filled again from the stored keys.
Inserts and deletes are events that each part takes in order, so an index can be kept up to date batch by batch. Copies are counted
inside every task before they are shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import staged, table

SLOTS = 4
KICKS = 200
PER_PART = 2048  # keys of a part when the index is dealt; dealt anew beyond four times as many
HOT = 1000  # a group of at least 1/HOT of all rows is hot: there are at most HOT of them

_FILTER, _KEY, _INSERT, _DELETE, _KEEPER, _PROBE = range(6)
_EVENTS = "part int, kind int, no long, digest binary, least long, batch int, at long, copies long, slots binary, owners binary"


class CuckooFilter:
    """Cuckoo filter over stored keys, with deletion and resizing.

    `keys` holds [digest, ...] or None for a deleted key; a slot holds a fingerprint (0: free) and the number of its key.
    """

    __slots__ = ("buckets", "slots", "owners", "keys")

    def __init__(self, keys: list, buckets: int = 64):
        self.keys = keys
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets, self.slots, self.owners = buckets, array("H", bytes(2 * SLOTS * buckets)), array("i", bytes(4 * SLOTS * buckets))

    @classmethod
    def loaded(cls, keys: list, slots: bytes, owners: bytes) -> CuckooFilter:
        it = cls.__new__(cls)
        it.keys, it.slots, it.owners = keys, array("H", slots), array("i", owners)
        it.buckets = len(it.slots) // SLOTS
        return it

    @staticmethod
    def print_of(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[2:8], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 5 & self.buckets - 1)

    def find(self, digest: bytes) -> int:
        """Slot of a live digest, or -1: a fingerprint that fits is verified against the stored key."""
        mark, bucket = self.print_of(digest), self._first(digest)
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.slots[slot] == mark and self.keys[self.owners[slot]][0] == digest:
                    return slot
        return -1

    def _place(self, mark: int, owner: int, bucket: int) -> bool:
        other = self._other(bucket, mark)
        for b in (bucket, other):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.slots[slot]:
                    self.slots[slot], self.owners[slot] = mark, owner
                    return True
        bucket = other
        for turn in range(KICKS):
            slot = bucket * SLOTS + (turn + mark) % SLOTS
            mark, self.slots[slot] = self.slots[slot], mark
            owner, self.owners[slot] = self.owners[slot], owner
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.slots[slot]:
                    self.slots[slot], self.owners[slot] = mark, owner
                    return True
        return False  # one fingerprint has no place; the stored keys still hold all

    def add(self, key: list) -> None:
        """Insert a digest that is not live."""
        self.keys.append(key)
        if not self._place(self.print_of(key[0]), len(self.keys) - 1, self._first(key[0])):
            self._resize()

    def _resize(self) -> None:
        buckets = self.buckets
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(self.print_of(key[0]), no, self._first(key[0])) for no, key in enumerate(self.keys) if key):
                return

    def remove(self, slot: int) -> None:
        """Delete the live digest of a slot."""
        self.keys[self.owners[slot]] = None
        self.slots[slot] = 0


def _earlier(a: tuple, b: tuple) -> bool:
    """Whether the row (least, batch, at) of `a` is to be kept before that of `b`; a null id comes last."""
    return (a[0] is None, a[0] or 0, a[1], a[2]) < (b[0] is None, b[0] or 0, b[1], b[2])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the events of each part, sorted by part and kind; give its new state."""
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("no", pa.int64()), ("digest", pa.binary()), ("least", pa.int64()),
                        ("batch", pa.int32()), ("at", pa.int64()), ("copies", pa.int64()), ("slots", pa.binary()), ("owners", pa.binary())])
    part = cuckoo = None
    stored, keys, answers = None, [], []

    def opened():
        return CuckooFilter.loaded(keys, *stored) if stored else CuckooFilter(keys)

    def close(cuckoo):
        # Deleted keys leave the numbering when their part is written.
        live = [no for no, key in enumerate(keys) if key]
        number = {no: i for i, no in enumerate(live)}
        owners = array("i", (number.get(o, 0) for o in cuckoo.owners))
        rows = [(part, _FILTER, 0, None, None, None, None, None, cuckoo.slots.tobytes(), owners.tobytes())]
        rows += [(part, _KEY, number[no], *keys[no], None, None) for no in live] + answers
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for at_part, kind, no, digest, least, turn, at, copies, slots, owners in zip(*(c.to_pylist() for c in batch.columns)):
            if at_part != part:
                if part is not None:
                    yield close(cuckoo or opened())
                part, keys, answers, stored, cuckoo = at_part, [], [], None, None
            if kind == _FILTER:
                stored = slots, owners
                continue
            if kind == _KEY:
                keys.append([digest, least, turn, at, copies])
                continue
            cuckoo = cuckoo or opened()
            slot = cuckoo.find(digest)
            if kind == _PROBE:
                key = keys[cuckoo.owners[slot]] if slot >= 0 else None
                answers.append((part, _PROBE, at, digest, key and key[1], key and key[2], key and key[3], key[4] if key else 0, None, None))
            elif slot < 0:
                if kind == _INSERT:
                    cuckoo.add([digest, least, turn, at, copies])
            else:
                key = keys[cuckoo.owners[slot]]
                if kind == _INSERT:
                    key[4] += copies
                    if _earlier((least, turn, at), (key[1], key[2], key[3])):
                        key[1:4] = least, turn, at
                elif kind == _DELETE:
                    key[4] -= copies
                    if key[4] <= 0:
                        cuckoo.remove(slot)
                else:
                    key[1:4] = least, turn, at
    if part is not None:
        yield close(cuckoo or opened())


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal digest in one: the first by doc_id (null last) and at, and the number of rows."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch]).sort_by([("doc_id", "ascending"), ("at", "ascending")])
            sums = rows.group_by("digest", use_threads=False).aggregate([("doc_id", "first"), ("at", "first"), ("at", "count")])
            yield from sums.select(["digest", "doc_id_first", "at_first", "at_count"]).rename_columns(["digest", "least", "at", "copies"]).to_batches()


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _digests(docs: DataFrame, batch: int) -> DataFrame:
    """One narrow row for each document; `batch` and `at` name the row."""
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
                  .withColumn("batch", F.lit(batch)).withColumn("at", F.monotonically_increasing_id()))


@dataclass
class CuckooIndex:
    """Index of live texts: `state` (filters and stored keys of all parts) and `members` (a row for each live document).

    Both are tables in the shared folder. `insert` and `delete` return a new index; the old one stays as it is.
    """

    parts: int
    batches: int
    state: DataFrame
    members: DataFrame

    @classmethod
    def build(cls, docs: DataFrame) -> CuckooIndex:
        """Index of all rows of `docs` (doc_id, text; other columns are ignored)."""
        spark = docs.sparkSession
        empty = spark.createDataFrame([], "doc_id long, digest binary, batch int, at long")
        return cls(1, 0, spark.createDataFrame([], _EVENTS), empty).insert(docs)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.parts)).cast("int")

    def _events(self, rows: DataFrame, kind: int) -> DataFrame:
        none = F.lit(None)
        have = set(rows.columns)
        pick = lambda c, t: (F.col(c) if c in have else none).cast(t).alias(c)
        return rows.select(self._part().alias("part"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("no"), "digest", pick("least", "long"),
                           pick("batch", "int"), pick("at", "long"), pick("copies", "long"), none.cast("binary").alias("slots"), none.cast("binary").alias("owners"))

    def _taken(self, *events: DataFrame) -> DataFrame:
        """State of all parts after events, and the answers to probes."""
        rows = self.state
        for more in events:
            rows = rows.unionByName(more)
        dealt = rows.repartition("part").sortWithinPartitions("part", "kind", "no", F.asc_nulls_last("least"), "batch", "at")
        return staged(dealt.mapInArrow(_apply, _EVENTS))

    def _dealt(self, more: int) -> CuckooIndex:
        """The index with room for `more` digests: parts are doubled, and filled again from the stored keys."""
        live = self.state.filter(F.col("kind") == _KEY)
        n, parts = live.count() + more, self.parts
        if n <= 4 * PER_PART * parts:
            return self
        while n > PER_PART * parts:
            parts *= 2
        bare = CuckooIndex(parts, self.batches, self.state.limit(0), self.members)
        return CuckooIndex(parts, self.batches, bare._taken(bare._events(live, _INSERT)), self.members) if self.batches else bare

    def insert(self, docs: DataFrame) -> CuckooIndex:
        """Add every row of `docs`, in order of doc_id, null last. Equal rows are rows of their own."""
        batch = self.batches + 1
        new = _digests(docs, batch)
        met = staged(new.select("digest", "doc_id", "at").mapInArrow(_combine, "digest binary, least long, at long, copies long"))
        index = self._dealt(met.count())
        state = index._taken(index._events(met.withColumn("batch", F.lit(batch)), _INSERT))
        members = self.members.unionByName(new) if self.batches else new
        return CuckooIndex(index.parts, batch, state, members)

    def delete(self, docs: DataFrame) -> CuckooIndex:
        """Take out every live row with the doc_id and text of a row of `docs`; a null id equals a null id. Others are ignored.

        A digest without rows leaves its filter. If the row that stays goes, the next one by doc_id takes its place.
        """
        gone = _digests(docs, 0).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone")).distinct()
        match = (F.col("digest") == F.col("gone")) & F.col("doc_id").eqNullSafe(F.col("gone_id"))
        out = staged(self.members.join(gone, match, "left_semi"))
        members = staged(self.members.join(gone, match, "left_anti"))
        fewer = out.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "batch", "at"))
        keepers = (members.join(fewer.select("digest"), "digest", "left_semi").groupBy("digest").agg(first.alias("k"))
                   .select("digest", F.col("k.doc_id").alias("least"), "k.batch", "k.at"))
        state = self._taken(self._events(fewer, _DELETE), self._events(keepers, _KEEPER))
        return CuckooIndex(self.parts, self.batches, state.filter(F.col("kind") != _PROBE), members)

    def seen(self, docs: DataFrame) -> DataFrame:
        """Every row of `docs` as doc_id, keep_id (of the live row with that text, null if there is none) and live copies."""
        asked = _digests(docs, 0)
        each = asked.groupBy("digest").agg(F.min("at").alias("at"))
        found = self._taken(self._events(each, _PROBE)).filter(F.col("kind") == _PROBE)
        return asked.join(found.select("digest", F.col("least").alias("keep_id"), "copies"), "digest").select("doc_id", "keep_id", "copies")

    def groups(self) -> DataFrame:
        """Every live row: doc_id, keep_id, group_size, kept, text_sha256.

        Groups of 1/HOT of all rows or more, HOT of them at most, are broadcast; of the others none is a large part of a join.
        """
        keys = self.state.filter(F.col("kind") == _KEY).select("digest", "least", F.col("batch").alias("keep_batch"), F.col("at").alias("keep_at"), "copies")
        bound = max(1, self.members.count() // HOT)
        hot = F.broadcast(keys.filter(F.col("copies") > bound).withColumnRenamed("digest", "hot"))
        large = self.members.join(hot, F.col("digest") == F.col("hot")).drop("hot")
        small = (self.members.join(hot.select("hot"), F.col("digest") == F.col("hot"), "left_anti")
                 .join(keys.filter(F.col("copies") <= bound), "digest"))
        kept = (F.col("batch") == F.col("keep_batch")) & (F.col("at") == F.col("keep_at"))
        return large.unionByName(small).select("doc_id", F.col("least").alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"),
                                               F.lower(F.hex("digest")).alias("text_sha256"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts among all rows of `docs` (doc_id, text; other columns are ignored).

    Returns doc_id, keep_id, group_size, kept and text_sha256 of the normalised text. Texts are equal if they are after every run
    of blanks, tabs and line ends becomes one space; a null text counts as empty. The row with the least doc_id stays, a null id last, and of
    rows with the same id one. Texts of any length are digested in their row; an empty table gives no rows.
    """
    return CuckooIndex.build(docs).groups()


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
