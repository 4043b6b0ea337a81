"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 2).

Words are lower-cased runs without white space, punctuation or symbols. A benchmark item of m words is
compared with windows of m words of every document. A window that holds none of the benchmark's
shingles has similarity 0, so only windows that a shared shingle aligns with an item are built (cut at the ends of the text); a Bloom
filter of fixed size finds those places while the text is scanned. Window and item get a 64-bit SimHash
of their shingles, weighted by multiplicity. The fingerprint is cut into blocks; two fingerprints within
`radius` agree in at least one block up to radius // blocks bits, so an equality join on the blocks and
their near variants finds every pair within the radius. The weighted Jaccard similarity of
the shingles then decides. All work is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SHINGLE, SIMILAR, Bloom, bind, staged, table, text_key

BITS, BLOCKS, RADIUS = 64, 8, 15


def _word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{P}\p{S}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingle(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(width)])


def _places(hashes: Column, width: int) -> Column:
    n = F.size(hashes)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _listed(hashes: Column, width: int) -> Column:
    """(h, off) of every shingle."""
    return F.transform(_places(hashes, width), lambda i: F.struct(_shingle(hashes, i, width).alias("h"), i.alias("off")))


def _by_width(widths: list[int], value) -> Column:
    """`value(width)` for the row's shingle width."""
    return F.coalesce(*[F.when(F.col("width") == w, value(w)) for w in widths])


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, hs (word hashes), m, width."""
    hs = benchmark.select("item_id", _word_hashes(F.col("text")).alias("hs"))
    return hs.select("item_id", "hs", F.size("hs").alias("m"), F.least(F.size("hs"), F.lit(SHINGLE)).alias("width")).filter("m > 0")


def _exploded(df: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """Shingles of the word hashes `hs` of each row: keys, h, weight (multiplicity)."""
    found = F.explode(_by_width(widths, lambda w: _listed(F.col("hs"), w)))
    return (df.select(*keys, found.alias("x")).groupBy(*keys, F.col("x.h").alias("h"))
            .agg(F.count(F.lit(1)).alias("weight")))


def _fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of weighted shingles, and their total weight."""
    bit = lambda b: F.shiftrightunsigned(F.col("h"), b).bitwiseAND(F.lit(1).cast("long")) * 2 - 1
    votes = shingles.groupBy(*keys).agg(F.sum("weight").alias("total"),
                                        *[F.sum(F.col("weight") * bit(b)).alias(f"v{b}") for b in range(BITS)])
    print_ = F.lit(0).cast("long")
    for b in range(BITS):
        one = F.shiftleft(F.lit(1).cast("long"), b)
        print_ = print_.bitwiseOR(F.when(F.col(f"v{b}") > 0, one).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, "total", print_.alias("fp"))


def _block(fp: Column, b: int) -> Column:
    size = BITS // BLOCKS
    return F.shiftrightunsigned(fp, b * size).bitwiseAND(F.lit((1 << size) - 1).cast("long")).cast("int")


def _within(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """All (window, item) pairs of one window size whose fingerprints differ in at most `radius` bits."""
    size, near = BITS // BLOCKS, radius // BLOCKS
    masks = [m for m in range(1 << size) if m.bit_count() <= near]
    blocks = lambda fp, variants: F.explode(F.flatten(F.array(*[
        F.array(*[F.struct(F.lit(b).alias("b"), _block(fp, b).bitwiseXOR(F.lit(m)).alias("v")) for m in variants])
        for b in range(BLOCKS)])))
    left = windows.select("key", "start", "m", "fp", blocks(F.col("fp"), [0]).alias("at"))
    right = items.select("item_id", F.col("m").alias("im"), F.col("fp").alias("ifp"), blocks(F.col("fp"), masks).alias("iat"))
    return (left.join(right, (F.col("m") == F.col("im")) & (F.col("at.b") == F.col("iat.b")) & (F.col("at.v") == F.col("iat.v")))
            .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
            .select("key", "start", "m", "item_id").distinct())


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """Benchmark passages in documents.

    Returns doc_id, key (digest of the text), item_id, similarity (of the best window) and start (its
    first word, the least if several are equally good), one row for each row of `docs` and item. Reads
    doc_id and text of `docs`, item_id and text of `benchmark`. Null or empty texts and items without a
    word match nothing; an item of fewer than five words is one shingle; repeated rows give repeated
    rows; equal items are each reported; an empty table gives no rows.
    """
    items = staged(_items(benchmark))
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()] or [SHINGLE]  # at most five
    item_shingles = staged(_exploded(items, ["item_id", "m", "width"], widths))

    bloom = Bloom(item_shingles, "h")

    def places_of(hs, width):
        """Places whose shingle may be the benchmark's, as (pos, width, h)."""
        all_ = F.transform(_places(hs, width), lambda i: _shingle(hs, i, width))
        return F.array_compact(F.transform(all_, lambda h, i: F.when(
            bloom.maybe(h), F.struct(i.alias("pos"), F.lit(width).alias("width"), h.alias("h")))))

    def hits(hs):
        return F.struct(hs.alias("hs"), F.concat(*[places_of(hs, w) for w in widths]).alias("hits"))

    scanned = docs.select("doc_id", "text", bind(_word_hashes(F.col("text")), hits).alias("x"))
    holders = staged(scanned.filter(F.size("x.hits") > 0).select("doc_id", text_key(F.col("text")).alias("key"), "x.hs", "x.hits"))
    texts = holders.dropDuplicates(["key"])

    offsets = (items.select("m", "width", F.explode(_by_width(widths, lambda w: _listed(F.col("hs"), w))).alias("p")).select("m", F.col("width").alias("iw"), "p.h", "p.off").distinct())
    windows = (texts.select("key", F.size("hs").alias("n"), F.explode("hits").alias("x")).select("key", "n", "x.pos", "x.width", "x.h")
               .join(offsets, "h").filter("width = iw")
               .select("key", "m", "width", "n", (F.col("pos") - F.col("off")).alias("start")).distinct())
    # `start` is below 0 if the window is cut at the beginning of the text, so that it tells such windows apart.
    first = F.greatest(F.lit(0), F.col("start"))
    cut = staged(windows.join(texts.select("key", "hs"), "key").select(
        "key", "start", "m", "width", F.slice("hs", first + 1, F.least(F.col("n"), F.col("start") + F.col("m")) - first).alias("hs")))
    in_windows = staged(_exploded(cut, ["key", "start", "m"], widths))
    window_prints = _fingerprints(in_windows, ["key", "start", "m"])
    item_prints = _fingerprints(item_shingles, ["item_id", "m"])
    pairs = _within(window_prints, item_prints, radius)

    common = (pairs.join(in_windows, ["key", "start", "m"])
              .join(item_shingles.select("item_id", "h", F.col("weight").alias("iw")), ["item_id", "h"])
              .groupBy("key", "start", "m", "item_id").agg(F.sum(F.least("weight", "iw")).alias("both")))
    totals = lambda df, keys, name: df.groupBy(*keys).agg(F.sum("weight").alias(name))
    scored = (common.join(totals(in_windows, ["key", "start", "m"], "wt"), ["key", "start", "m"])
              .join(totals(item_shingles, ["item_id"], "it"), "item_id")
              .withColumn("similarity", F.col("both") / (F.col("wt") + F.col("it") - F.col("both")))
              .filter(F.col("similarity") >= similar))
    best = scored.groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    return holders.select("doc_id", "key").join(
        best.select("key", "item_id", F.col("b.similarity").alias("similarity"), F.greatest(F.lit(0), -F.col("b.s")).alias("start")), "key").select(
        "doc_id", "key", "item_id", "similarity", "start")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that hold a benchmark passage go. All columns are returned; null texts stay."""
    found = staged(leaks(docs, table(spark, sf_dir, "benchmark")))
    bad = found.select(F.col("key").alias("__bad")).distinct()
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    return keyed.join(bad, F.col("__key") == F.col("__bad"), "left_anti").select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage, with the item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "similarity", "start")
