"""Points inside intervals by an equi-join.

An interval is cut into blocks of power-of-two size, at most two of each size, and a point lies in one block
of each size. So a point and an interval around it share exactly one block, and the join key is the block: no pair is
made that does not belong together, however many points and intervals share the other keys.
"""

from pyspark.sql import Column, DataFrame, functions as F


def _shift(n: Column, k: Column) -> Column:
    return F.call_function("shiftright", n, k)


def _blocks(lo: Column, hi: Column) -> Column:
    """Blocks (size, block) of the whole numbers from lo to hi; lo is at least 1. None if hi is less."""
    def at(k):
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        first, end = _shift(lo + one - 1, k), _shift(hi + 1, k)
        odd = lambda n: n.bitwiseAND(1)
        block = lambda n: F.struct(k.alias("size"), n.alias("block"))
        return F.array(F.when((first < end) & (odd(first) == 1), block(first)),
                       F.when((first + odd(first) < end) & (odd(end) == 1), block(end - 1)))

    sizes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.lit(1), hi - lo + 1)))).cast("int"))
    return F.when(hi >= lo, F.array_compact(F.flatten(F.transform(sizes, at))))


def within(points: DataFrame, spans: DataFrame, on: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Join points to the spans around them (lo <= at <= hi) that agree on `on`. Places are whole numbers from 0."""
    place = F.col(at).cast("bigint") + 1  # from 1, so that a point needs no block larger than itself
    own = F.transform(F.sequence(F.lit(0), F.floor(F.log2(place)).cast("int")),
                      lambda k: F.struct(k.alias("size"), _shift(place, k).alias("block")))
    blocks = _blocks(F.col(lo).cast("bigint") + 1, F.col(hi).cast("bigint") + 1)
    return (points.select("*", F.inline(own)).join(spans.select("*", F.inline(blocks)), [*on, "size", "block"])
            .drop("size", "block"))
