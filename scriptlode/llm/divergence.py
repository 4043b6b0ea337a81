"""Source divergence audit by length-bucketed packing of terms (operator 12).

Tasks count the terms of their texts in numpy: a term of up to 8 bytes is one 64-bit word, one of up to 16 bytes
two words, and these are radix-sorted by 16-bit digits and counted by runs; longer terms go to buckets of doubling width
that are sorted as bytes. What a task has counted meets in Spark by (lang, source, term). The audit on those counts is
DataFrame expressions on whole numbers, so every value is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import pieces, staged, table

UNIT = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
PIECE = 2_000_000  # bytes of text counted at once

_COUNTS = "lang string, source string, term string, n long, docs long"
# Letters and every byte beyond ASCII belong to terms; all others are 0, which ends a term.
_LOWER = np.zeros(256, np.uint8)
_LOWER[0x61:0x7B] = _LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned integer keys, the most significant first: one counting pass for each 16-bit digit."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(sorted_keys: list[np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and number of documents of each run of equal keys."""
    new = np.ones(len(owner), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    turn = new.copy()
    turn[1:] |= owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(owner)]), np.add.reduceat(turn.astype(np.int64), first)


def _take(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The substrings of `data` as a text column."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.r_[np.int64(0), ends].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def count_terms(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of each distinct (group, term) of some texts."""
    texts = pc.binary_join_element_wise(texts.cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))  # a term never spans two texts
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset + 1: texts.offset + len(texts) + 1]
    low = np.zeros((int(ends[-1]) if len(ends) else 0) + 16, np.uint8)
    if len(low) > 16:
        low[:-16] = _LOWER[np.frombuffer(data, np.uint8)[:len(low) - 16]]
    inside = low != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.r_[0, edges]
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    owner = np.searchsorted(ends, starts, side="right")
    eight = np.ndarray(len(low) - 7, ">u8", low, strides=(1,))  # the eight bytes from each place, unaligned
    out = []

    def add(pick, keys, order):
        who = group[owner[pick]][order]
        first, n, docs = _runs([k[order] for k in keys] + [who], owner[pick][order])
        at = pick[order[first]]
        out.append((who[first], _take(low, starts[at], sizes[at]), n, docs))

    def word(at, size):  # bytes beyond `size` are zero; no term holds a zero
        return eight[at].astype(np.uint64) & (~np.uint64(0) << (np.uint64(64) - size.astype(np.uint64) * np.uint64(8)))

    pick = np.flatnonzero(sizes <= 8)
    if len(pick):
        keys = [word(starts[pick], sizes[pick])]
        add(pick, keys, radix_order([*keys, group[owner[pick]]]))
    pick = np.flatnonzero((sizes > 8) & (sizes <= 16))
    if len(pick):
        keys = [eight[starts[pick]].astype(np.uint64), word(starts[pick] + 8, sizes[pick] - 8)]
        add(pick, keys, radix_order([*keys, group[owner[pick]]]))
    width = 16
    while (pick := np.flatnonzero(sizes > width)).size:
        pick = pick[sizes[pick] <= 2 * width]
        width *= 2
        if len(pick):
            terms = np.zeros(len(pick), f"S{width}")
            rows = terms.view(np.uint8).reshape(len(pick), width)
            size = sizes[pick]
            cell = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            rows[np.repeat(np.arange(len(pick)), size), cell] = low[np.repeat(starts[pick], size) + cell]
            order = radix_order([group[owner[pick]]])
            add(pick, [terms], order[np.argsort(terms[order], kind="stable")])
    if not out:
        return np.zeros(0, np.uint32), pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate([o[0] for o in out]), pa.concat_arrays([o[1] for o in out]),
            np.concatenate([o[2] for o in out]), np.concatenate([o[3] for o in out]))


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts of about `most` bytes that end at the end of a term."""
    lo, view = 0, np.frombuffer(text, np.uint8)
    while lo < len(text):
        hi = min(lo + most, len(text))
        while hi < len(text) and not (gap := np.flatnonzero(_LOWER[view[hi:hi + 4096]] == 0)).size:
            hi = min(hi + 4096, len(text))
        hi += int(gap[0]) if hi < len(text) else 0
        yield text[lo:hi]
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text", PIECE):
        lang, source = piece.column("lang").dictionary_encode(), piece.column("source").dictionary_encode()
        code = (lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary))
                + source.indices.to_numpy(zero_copy_only=False))
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        group = group.astype(np.uint32)
        texts = piece.column("text")
        if piece.num_rows == 1 and texts[0].as_buffer().size > PIECE:  # one long text: its parts meet before they leave
            found = [count_terms(pa.array([part.decode("utf-8", "replace")], pa.large_string()), group) for part in _parts(texts[0].as_buffer().to_pybytes(), PIECE)]
            met = pa.table({"term": pa.concat_arrays([f[1] for f in found]), "n": np.concatenate([f[2] for f in found])}).group_by("term").aggregate([("n", "sum")])
            term, n = met["term"].combine_chunks(), met["n_sum"].to_numpy()
            who, docs = np.zeros(len(n), np.uint32), np.ones(len(n), np.int64)
        else:
            who, term, n, docs = count_terms(texts, group)
        # A row without a term tells that the group is there.
        who = np.r_[np.arange(len(first)), who].astype(np.int64)
        term = pa.concat_arrays([pa.nulls(len(first), pa.large_string()), term])
        zero = np.zeros(len(first), np.int64)
        at = pa.array(first[who])
        yield pa.RecordBatch.from_arrays([piece.column("lang").take(at), piece.column("source").take(at), term.cast(pa.string()),
                                          pa.array(np.r_[zero, n]), pa.array(np.r_[zero, docs])], ["lang", "source", "term", "n", "docs"])


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), exact for any long."""
    small = F.call_function("div", F.lit(UNIT).cast("long") * (n + 1), total + kept)
    large = F.call_function("div", F.lit(UNIT).cast("decimal(11,0)") * (n + 1).cast("decimal(20,0)"), (total + kept).cast("decimal(20,0)"))
    return F.when(kept > 0, 1 + F.when(n < 9_000_000_000, small).otherwise(large))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Divergence of the sources (text, lang, source; all other columns are ignored).

    Returns lang, source, part ('pair' or 'term'), item, value and rank. Terms are the runs of letters and of characters
    beyond ASCII, with A-Z in lower case; a language keeps those in at least `least_docs` of its documents. Part 'pair' sums the
    gap over all kept terms for each other source of the language, part 'term' lists the `top` terms that the source uses
    more than its language. Null text, lang and source read as ''. A group without terms takes part with count 0 of
    every kept term; a language that keeps no term has pairs of value 0. Repeated rows are documents of their own;
    equal values rank by item; an empty table gives no rows. Texts and terms may be of any length: a long text is counted
    in parts. Pairs of sources of a language are the result itself; nothing else is paired.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # A worker's rows of one piece meet here with those of other pieces and tasks; sums start before the shuffle.
    counts = staged(rows.mapInArrow(_count, _COUNTS).groupBy("term", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    words = counts.filter("term IS NOT NULL")
    kept = staged(words.groupBy("term", "lang").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                  .filter(F.col("docs") >= least_docs).drop("docs"))
    used = staged(words.drop("docs").join(kept, ["term", "lang"]))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = (counts.filter("term IS NULL").select("lang", "source")
              .join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"]))
    groups = staged(groups.withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    shares = used.join(groups.select("lang", "source", "total", "v", "lang_total", "p0"), ["lang", "source"])
    shares = staged(shares.select("lang", "source", "term", "p0", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                                  _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")))

    better = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = better.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)

    # A pair's sum over all kept terms: as if neither had any, plus what each one's terms and the shared terms change.
    # Terms of equal share are one row, so only the terms that two sources share are met by name.
    bare = groups.select("lang", "source", "v", "p0")
    other = bare.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    zero = _gap(F.col("p0"), F.col("q0"))
    alike = shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("terms"))
    differ = "source <> item"
    none = bare.join(other, "lang").filter(differ).select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * zero).otherwise(0).alias("value"))
    own = alike.join(other, "lang").filter(differ).select("lang", "source", "item", (F.col("terms") * (_gap(F.col("p"), F.col("q0")) - zero)).alias("value"))
    theirs = (alike.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("p").alias("q"), "terms")
              .join(bare.select("lang", "source", "p0"), "lang").filter(differ)
              .select("lang", "source", "item", (F.col("terms") * (_gap(F.col("p0"), F.col("q")) - zero)).alias("value")))
    mate = shares.select("lang", "term", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("p").alias("q1"))
    both = (shares.select("lang", "term", "source", "p0", "p").join(mate, ["term", "lang"]).filter(differ)
            .select("lang", "source", "item", (_gap(F.col("p"), F.col("q1")) - _gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q1")) + zero).alias("value")))
    sums = [part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for part in (none, own, theirs, both)]
    pairs = sums[0]
    for part in sums[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(place))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(terms, "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT lang, source, r, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + v.v) AS p,
             1 + 1000000000 * (k.n + 1) // (v.total + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM x a JOIN x b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM x WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
