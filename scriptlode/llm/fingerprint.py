"""Document fingerprints as threshold-scaled sketches (operator 5).

A document's fingerprint is every hash of its five-word shingles below a fixed fraction of the hash range,
so its size follows the text and the sketch of a union is the union of sketches. Jaccard similarity
and containment, also between very unequal texts, are estimated from the hashes both keep. A text
none of whose hashes is low enough keeps its least one; merging drops it as soon as another is below
the threshold. All work is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import SHINGLE, bind, number_list, split_words, table

SCALE_BITS = 3  # one hash of 8 is kept
ROWS_PER_RANGE = 2048
MOST_RANGES = 4096  # cut points that reach the driver


def sketch(text: Column, scale_bits: int = SCALE_BITS) -> Column:
    """Sorted shingle hashes (unsigned order) below 2^64 / 2^scale_bits. Words are lower-cased; a text of one to four
    words is one shingle; null and wordless texts have none."""
    def of(hs):
        n = F.size(hs)
        all_ = F.when(n >= SHINGLE, F.transform(
            F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(hs, i + j) for j in range(SHINGLE)]))).when(n > 0, F.array(F.xxhash64(hs)))
        return bind(F.coalesce(all_, F.array().cast("array<bigint>")), kept)

    def kept(hashes):
        low = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)
        return bind(low, lambda x: F.when(F.size(x) > 0, F.sort_array(F.array_distinct(x))).when(
            F.size(hashes) > 0, F.array(_least(hashes))).otherwise(x))

    return bind(F.transform(split_words(F.lower(text)), lambda w: F.xxhash64(w)), of)


def _least(hashes: Column) -> Column:
    """Least hash in unsigned order."""
    positive = F.array_min(F.filter(hashes, lambda h: h >= 0))
    return F.coalesce(positive, F.array_min(hashes))


def merge(a: Column, b: Column, scale_bits: int = SCALE_BITS) -> Column:
    """Sketch of the union of two shingle sets, from their sketches."""
    def kept(both):
        low = F.filter(both, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)
        return bind(low, lambda x: F.when((F.size(x) > 0) | (F.size(both) == 0), F.sort_array(x)).otherwise(F.array(_least(both))))
    return bind(F.array_union(a, b), kept)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def written(a: Column) -> Column:
    return F.concat_ws(",", F.transform(a, lambda h: F.lower(F.hex(h))))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, sketch) with the text and sketch of the next document by id, after the last the first.

    Ids are cut into ranges at quantiles (actual ids, at most MOST_RANGES numbers on the driver). Every row
    goes to its range once; the first row of a range also goes to the range before, the very first to the
    last one. So texts are shuffled once and no task holds more than a range. Null ids come first; rows that share an
    id follow one another in the order of their texts.
    """
    lowest = -(1 << 63)
    docs = docs.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)))
    n, first = docs.agg(F.count(F.lit(1)), F.min("k")).first()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = docs.agg(F.percentile_approx("k", shares, 10 * ranges)).first()[0]
        cuts = sorted(set(found) - {first})
    first = lowest if first is None else first
    if cuts:
        steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
        of = number_list(cuts)
        at = F.aggregate(number_list(steps, "int"), F.lit(0), lambda done, step: F.when(
            F.coalesce(F.get(of, done + step - 1) <= F.col("k"), F.lit(False)), done + step).otherwise(done))
    else:
        of, at = F.array().cast("array<bigint>"), F.lit(0)
    docs = docs.withColumn("at", at)
    place = lambda r, late, ghost: F.struct(r.alias("range"), F.lit(late).alias("late"), F.lit(ghost).alias("ghost"))
    opens = (F.col("at") > 0) & (F.get(of, F.col("at") - 1) == F.col("k"))
    places = F.array_compact(F.array(place(F.col("at"), 0, False), F.when(opens, place(F.col("at") - 1, 0, True)),
                                     F.when(F.col("k") == first, place(F.lit(len(cuts)), 1, True))))
    order = Window.partitionBy("range").orderBy("late", "k", "text")
    return (docs.select("doc_id", "k", "text", "sketch", F.explode(places).alias("p")).select("*", "p.range", "p.late", "p.ghost")
            .withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
            .filter(~F.col("ghost")).select("doc_id", "text", "sketch", "next_text", "next_sketch"))


def fingerprints(docs: DataFrame, scale_bits: int = SCALE_BITS) -> DataFrame:
    """Fingerprint of every row of `docs` (doc_id, text; null texts are empty; other columns are ignored) and of its
    edited text: the last half of its code points replaced by the first as many of the next document.
    An empty table gives no rows; a single document is its own next one."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(own.withColumn("sketch", sketch(F.col("text"), scale_bits)))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = own.select("*", F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                                      F.substring("next_text", F.lit(1), half)).alias("edited"))
    out = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                        "sketch", "next_sketch", bind(sketch(F.col("edited"), scale_bits), lambda s: F.struct(s.alias("s"))).alias("e"))
    return out.select("doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"),
                      written(F.col("e.s")).alias("edited_fingerprint"),
                      likeness(F.col("sketch"), F.col("e.s")).alias("near_edited"),
                      likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                      containment(F.col("sketch"), F.col("e.s")).alias("held_by_edited"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
