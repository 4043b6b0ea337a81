"""Mixing sources to target weights by hash order and prefix sums (operator 6).

Every document gets a hash-random key from its id. Inside a source the documents are ordered by that
key; distributed prefix sums of their word counts say where each one lies, and the source is cut
at its budget. A source whose target exceeds its size is gone through in whole epochs first. All
work is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import prefix_sums, staged, table

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
MOST_BROADCAST = 4096  # more sources than that are joined by a shuffle


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Target words of each source (source, source_size): no, source, source_size, target.

    Sources in code point order, null last, weigh `weights`, repeating, and share the sum of all sizes.
    A target stops at `epochs` times its source's size; the excess goes to the others by weight
    until none is above. In the order of size by weight, a source is full if its limit is within the
    share that it and all later ones would get.
    """
    big = "decimal(38,0)"
    turn = (Window.orderBy(F.col("source").isNull(), "source"))
    s = sizes.select("source", "source_size", F.row_number().over(turn).alias("no"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") - 1) % len(weights) + 1))
    s = s.withColumn("most", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("most").cast("double") / F.col("w"), "no")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = (s.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(earlier), F.lit(0)))
         .withColumn("share", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0)))
         .withColumn("open", F.col("most").cast(big) * F.col("share").cast("decimal(18,0)") > F.col("left").cast(big) * F.col("w").cast("decimal(18,0)")))
    first = lambda c: F.min(F.when(F.col("open"), F.struct(F.col("share").alias("k"), F.col(c).alias("v")))).over(whole)
    # The first open source has the largest remaining share of the open ones.
    s = s.withColumn("top", F.max(F.when(F.col("open"), F.struct("share", F.col("left").alias("rest")))).over(whole))
    target = F.when(F.col("open"), F.col("w") * F.col("top.rest").cast("double") / F.col("top.share")).otherwise(F.col("most").cast("double"))
    return s.select("no", "source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, carry: Column | None = None) -> DataFrame:
    """The mix of every row of `docs` (doc_id, text, source; other columns only through `carry`).

    Returns doc_id, source, size (words), source_size, target (words wanted of its source), taken (words
    the mix takes of the row, repeats counted; the row at the cut is taken in part, so that a source gives
    exactly the whole part of its target) and copies (times the row is taken as a whole, the row at the
    cut rounded to the nearer side). Null and empty texts have no words and are taken 0 times; a null
    source is a source, and one without words has the target 0; a null doc_id has a key like any other; equal rows are taken one after another;
    an empty table gives no rows. The same rows give the same mix.
    """
    digest = F.md5(F.concat(F.lit("mix "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    tie = F.concat(digest, F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    words = n_words(F.col("text"))
    narrow = staged(docs.select(F.col("source").alias("src"), words.alias("size"), key.alias("key")))
    sizes = narrow.groupBy(F.col("src").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, epochs)
    budget = F.floor("target")
    plan = staged(plan.withColumn("full", F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)).cast("long"))
                  .withColumn("rest", (budget - F.col("full") * F.col("source_size")).cast("long")))
    # A row for each source: few are sent to every task, many are met by a shuffle.
    small = F.broadcast if plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda df: df
    of = plan.select("no", F.col("source").alias("of"))
    numbered = narrow.join(small(of), F.col("src").eqNullSafe(F.col("of")))
    wide = docs.select("doc_id", F.col("source").alias("src"), words.alias("size"), key.alias("key"), tie.alias("tie"),
                       (carry if carry is not None else F.lit(None)).alias("carry"))
    wide = wide.join(small(of), F.col("src").eqNullSafe(F.col("of"))).drop("of", "src")
    placed = prefix_sums(wide, numbered, "no", "key", "size", "tie").join(small(plan), "no")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "carry",
        (F.col("full") * F.col("size") + part).cast("long").alias("taken"),
        F.when(F.col("size") == 0, 0).otherwise(F.col("full") + (part * 2 >= F.col("size")).cast("int")).cast("int").alias("copies"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: each document as many times as the mix takes it. All columns are returned; documents without
    words are not in the mix."""
    taken = mixed(docs, carry=F.struct(*[F.col(c) for c in docs.columns])).filter("copies > 0")
    return taken.select("carry", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__turn")).select("carry.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
                  md5('mix ' || coalesce(doc_id::VARCHAR, '')) AS k1, coalesce(md5(text), '') AS k2 FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS no FROM s),
w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS most FROM r),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER e, 0) AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS share
      FROM w WINDOW e AS (ORDER BY most::DOUBLE / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, most * share > rest * w AS open FROM o),
f AS (SELECT arg_max(rest, share) AS rest, max(share) AS share FROM p WHERE open),
t AS (SELECT p.source, p.source_size::BIGINT AS source_size,
             CASE WHEN open THEN w * f.rest::DOUBLE / f.share::DOUBLE ELSE most::DOUBLE END AS target FROM p LEFT JOIN f ON TRUE),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
x AS (SELECT d.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k1, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x
"""
