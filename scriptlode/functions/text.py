"""Text expressions. Every function takes and returns a Spark Column.

Group loops use possessive quantifiers, so a long or unbalanced text costs linear time and no
stack in the executor JVM.
"""

from pyspark.sql import Column, functions as F

# A column name, a part of a table name, and a dotted table name; parts may be quoted.
_QUOTED = r"""`[^`]+`|"[^"]+"|\[[^\]]+\]|'[^']+'"""
IDENT = rf"""(?:{_QUOTED}|[^\s()`"'\[\],;]+)"""
_PART = rf"""(?:{_QUOTED}|[^\s()`"'\[\],;.]+)"""
NAME = _PART + r"(?:\s*\.[\s.]*" + _PART + r")*+"

_COMMENT = r"('[^'\n]*')|--[^\n]*|(?s:/\*.*?\*/)|#[ \t][^\n]*"


def strip_comments(c: Column) -> Column:
    """Drop line, block and hash comments; quoted text on one line is kept as it is."""
    return F.regexp_replace(c, _COMMENT, "$1")


def normalize_text(c: Column) -> Column:
    """Strip comments and collapse white space to single blanks."""
    return F.trim(F.regexp_replace(strip_comments(c), r"\s+", " "))


def clean_stmt(c: Column) -> Column:
    """Drop COMMENT '...' attributes and numeric size suffixes such as (11) or (10,2)."""
    no_comment = F.regexp_replace(
        c, r"""(?i)\s+comment\s*=?\s*(?:'[^']*'|"[^"]*")\s*([,;)]|$)""", "$1")
    return F.regexp_replace(no_comment, r"\(\s*\d[\d\s,]*\)", "")


def strip_hints(c: Column) -> Column:
    """Drop (nolock), (+) and (-)."""
    return F.regexp_replace(c, r"(?i)\(nolock\)|\(\+\)|\(-\)", "")


def mask_literals(c: Column) -> Column:
    """Empty the content of single-quoted literals."""
    return F.regexp_replace(c, r"'[^']*'", "''")


def mask_punctuated_literals(c: Column) -> Column:
    """Drop only the single-quoted literals that hold a comma or a parenthesis."""
    return F.regexp_replace(c, r"('[^',()]*')|'[^']*'", "$1")


def clean_ident(c: Column) -> Column:
    """Drop quotes and brackets, blanks around dots, and trailing asc/desc and null order."""
    bare = F.regexp_replace(c, r"""[`"'\[\]]""", "")
    bare = F.regexp_replace(bare, r"\s*\.\s*", ".")
    return F.trim(F.regexp_replace(
        bare, r"(?i)(?:\s+(?:asc|desc|nulls\s+(?:last|first)))+\s*$", ""))


def norm_type(c: Column) -> Column:
    """Type base: text before a parenthesis, after the last '::', brackets off, lower case."""
    bare = F.regexp_replace(F.lower(c), r"[`\"'\[\]]", "")
    before = F.substring_index(F.substring_index(bare, "(", 1), ")", 1)
    return F.trim(F.substring_index(before, "::", -1))


def after_kw(c: Column, keyword: str) -> Column:
    """Text after the first occurrence of a keyword, ignoring case; all of it when absent."""
    at = F.instr(F.lower(c), keyword.lower())
    return F.when(at > 0, F.substring(c, at + F.lit(len(keyword)), F.length(c))).otherwise(c)


def before_kw(c: Column, keyword: str) -> Column:
    """Text before the first occurrence of a keyword, ignoring case; all of it when absent."""
    at = F.instr(F.lower(c), keyword.lower())
    return F.when(at > 0, F.substring(c, F.lit(1), at - F.lit(1))).otherwise(c)


def last_part(c: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(c, ".", -1)


def clean_table(c: Column) -> Column:
    """Export name of a table: second dotted part when there is one, punctuation trimmed."""
    parts = F.split(c, r"\.")
    pick = F.when(F.size(parts) > 1, parts[1]).otherwise(c)
    return F.btrim(pick, F.lit("#@'`\"[]"))


def clean_column(c: Column) -> Column:
    """Export name of a column."""
    return F.btrim(c, F.lit("@'`\"[]"))


def to_snake(c: Column) -> Column:
    """Camel case to snake case; an underscore only between a small and a capital letter."""
    return F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"))


def _delta(t):
    return F.when(t == "(", F.lit(1)).when(t == ")", F.lit(-1)).otherwise(F.lit(0))


def _let(value: Column, use) -> Column:
    """Evaluate an expression once and use it several times."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


# --- brackets ------------------------------------------------------------------------------------
#
# Depth is a running sum over the pieces of a text; places where it is zero are cuts, and an item is one slice
# between two cuts. No text is built up piece by piece, so the cost hardly depends on length or depth.

HELD = "\u0003"  # encloses the number of a parenthesis group that is kept apart
_TOKENS = r"[()]|[^()]+"


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """Sum (or another associative `join`) of an array up to each place, inside the row.

    Each pass joins what lies twice as far back: as many passes as the length has binary digits.
    """
    def passes(v):
        reach = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)

        def step(acc, k):
            back = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda x, i: F.when(i >= back, join(x, F.get(acc, i - back))).otherwise(x))

        return F.when(F.size(v) > 1, F.aggregate(reach, v, step)).otherwise(v)

    return _let(values, passes)


def _places(values: Column, test) -> Column:
    """Numbers of the places of an array that pass a test."""
    return F.filter(F.transform(values, lambda v, i: F.when(test(v, i), i)), lambda i: i.isNotNull())


def _cut(parts: Column, ends: Column, sep: str) -> Column:
    """Join the parts up to each end, from behind the one before."""
    return F.transform(ends, lambda e, j: _let(
        F.coalesce(F.get(ends, j - 1), F.lit(-1)), lambda b: F.array_join(F.slice(parts, b + 2, e - b), sep)))


def split_top(c: Column) -> Column:
    """Items of a comma list; commas inside parentheses do not split, at any depth. Runs inside the row (no shuffle)."""
    def opened(part):
        return F.length(F.translate(part, ")", "")) - F.length(F.translate(part, "(", ""))

    def by_depth(parts):
        def cut(steps):
            ends = _let(running(steps), lambda depth: _places(depth, lambda d, i: (d <= 0) | (i == F.size(depth) - 1)))
            return F.when(F.exists(steps, lambda s: s != 0), _let(ends, lambda e: _cut(parts, e, ","))).otherwise(parts)

        return _let(F.transform(parts, opened), cut)

    parts = F.split(c, ",")
    items = F.when(F.contains(c, F.lit("(")), _let(parts, by_depth)).otherwise(parts)
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def first_group(c: Column) -> Column:
    """Content of the first balanced parenthesis group; null without an opening parenthesis.

    An unclosed group runs to the end of the text.
    """
    at = F.instr(c, "(")
    parts = F.split(F.substring(c, at + 1, F.length(c)), "\\)")
    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))

    def step(a, part):
        depth = a["depth"] + F.length(part) - F.length(F.translate(part, "(", "")) - 1
        return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), (a["taken"] + 1).alias("taken")))

    def content(parts):
        return F.when(~F.contains(F.get(parts, F.lit(0)), F.lit("(")), F.get(parts, F.lit(0))).otherwise(
            F.array_join(F.slice(parts, F.lit(1), F.aggregate(parts, zero, step, lambda a: a["taken"])), ")"))

    return F.when(at > 0, _let(parts, content))


def outer_text(c: Column) -> Column:
    """Text with every parenthesis group taken out, at any depth."""
    def outer(tokens):
        depth = running(F.transform(tokens, _delta))
        return _let(depth, lambda d: F.array_join(F.filter(
            tokens, lambda t, i: (F.get(d, i) <= 0) & ~t.isin("(", ")")), ""))

    return F.when(c.rlike("[()]"), _let(F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0)), outer)).otherwise(c)


def hold_groups(c: Column) -> Column:
    """Struct of `text`, in which a number stands for the content of each outermost parenthesis group, and `groups`, the contents.

    A pattern over `text` sees only what is outside parentheses; `with_groups` puts the contents back. A parenthesis
    without a counterpart is a character like any other.
    """
    def matched(tokens, depth):
        """Steps of depth without the parentheses that have no counterpart."""
        low = running(F.transform(depth, lambda d: F.least(d, F.lit(0))), F.least)
        later = F.reverse(running(F.reverse(depth), F.least))
        return F.transform(tokens, lambda t, i: F.when((t == "(") & (F.get(later, i + 1) < F.get(depth, i)), 1)
                           .when((t == ")") & (F.get(depth, i) >= F.coalesce(F.get(low, i - 1), F.lit(0))), -1).otherwise(0))

    def held(tokens):
        plain = running(F.transform(tokens, _delta))

        def by(depth):
            before = lambda i: F.coalesce(F.get(depth, i - 1), F.lit(0))
            starts = _places(depth, lambda d, i: (d == 1) & (before(i) == 0))
            ends = _places(depth, lambda d, i: (d == 0) & (before(i) == 1))
            return _let(starts, lambda s: _let(ends, lambda e: apart(s, e)))

        def apart(starts, ends):
            groups = F.transform(starts, lambda s, g: F.array_join(F.slice(tokens, s + 2, F.get(ends, g) - s - 1), ""))
            outside = F.transform(starts, lambda s, g: _let(F.coalesce(F.get(ends, g - 1), F.lit(-1)), lambda b: F.concat(
                F.array_join(F.slice(tokens, b + 2, s - b - 1), ""), F.lit(f"({HELD}"), g.cast("string"), F.lit(f"{HELD})"))))
            rest = _let(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(-1)), lambda b: F.array_join(
                F.slice(tokens, b + 2, F.size(tokens)), ""))
            return F.struct(F.concat(F.array_join(outside, ""), rest).alias("text"), groups.alias("groups"))

        def judge(depth):
            even = (F.array_min(depth) >= 0) & (F.element_at(depth, -1) == 0)
            return _let(F.when(even, depth).otherwise(running(matched(tokens, depth))), by)

        return _let(plain, judge)

    none = F.struct(c.alias("text"), F.array().cast("array<string>").alias("groups"))
    return F.when(F.contains(c, F.lit("(")), _let(F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0)), held)).otherwise(none)


def with_groups(c: Column, groups: Column) -> Column:
    """Text with its parenthesis groups again in place of their numbers."""
    parts = F.transform(F.split(c, HELD), lambda p, i: F.when(i % 2 == 1, F.get(groups, p.cast("int"))).otherwise(p))
    return F.when(F.contains(c, F.lit(HELD)), F.array_join(parts, "")).otherwise(c)


def ident_list(c: Column) -> Column:
    """Array of cleaned identifiers of a comma list; null for an absent list."""
    items = F.filter(F.transform(F.split(c, ","), clean_ident), lambda x: x != "")
    return F.when(c.isNotNull() & (F.trim(c) != ""), items)


def group_of(c: Column, pattern: str, idx: int = 1) -> Column:
    """Regular expression group, null when it is absent or empty."""
    return F.nullif(F.regexp_extract(c, pattern, idx), F.lit(""))
