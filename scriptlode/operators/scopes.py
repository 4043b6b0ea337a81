"""Query scopes. Every SELECT is a scope; an arm of a set operation is a scope of its own.

A query without a nested select or a set operation is one scope and takes no shuffle. The others
are cut at parentheses and set operators; running counts over the pieces of one statement give the
select depth, the enclosing block and the arm of each piece. A mention of a common table expression in a
from clause is bound to the block of its body, like a derived table.
"""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import text as X
from ..functions.fixed import AGGREGATES, CONDITION_WORDS, OP_NAMES
from ..session import cut

_SETOP = "\u0001"
_USER = "\u0002"  # stands between ( and # where a script itself writes (#1), the form of a placeholder
_END = 2147483647
_NESTED = r"(?i)\(\s*(?:select|with)\b|\b(?:union|intersect|except|minus)\b"
_SELECT = r"(?i)\bselect\b"
_WITH = r"(?i)\bwith\s+(?:recursive\s+)?[^\s()]+\s*(?:\([^()]*\)\s*)?as\s*(?:(?:not\s+)?materialized\s*)?\("
_KEYS = ["stmt_id", "repo_url", "file_id"]


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Add q: the statement without hints and with empty literals. The characters that mark
    pieces below and groups are removed from the script first."""
    plain = F.regexp_replace(X.mask_literals(X.strip_hints(F.col("stmt"))), rf"[\s{_SETOP}{_USER}{X.HELD}]+", " ")
    return queries.withColumn("q", F.regexp_replace(plain, r"\((?=#\d+\))", f"({_USER}"))


def is_union(queries: DataFrame) -> DataFrame:
    return queries.withColumn("is_union", F.col("stmt").rlike(r"(?i)\bunion\b"))


def _pieces(nested: DataFrame) -> DataFrame:
    # cte, the same for a whole statement, is a key of every window so that a filter on it reaches the statements.
    marked = F.regexp_replace("q", r"(?i)\b(?:union(?:\s+all)?|intersect|except|minus)\b", _SETOP)
    toks = F.regexp_extract_all(marked, F.lit(f"[(){_SETOP}]|[^(){_SETOP}]+"), F.lit(0))
    rows = nested.select(*_KEYS, "cte", F.posexplode(toks).alias("pos", "tok"))
    stmt = W.partitionBy("stmt_id", "cte").orderBy("pos")
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    rows = (rows.withColumn("after", F.sum(step).over(stmt))
            .withColumn("opens", (F.col("tok") == "(")
                        & F.coalesce(F.lead("tok").over(stmt), F.lit("")).rlike(r"(?i)^\s*(?:select|with)\b"))
            .withColumn("level", F.col("after") + F.when(F.col("tok") == ")", 1).otherwise(0)))
    # A closing parenthesis belongs to the last one opened at its level.
    same_level = W.partitionBy("stmt_id", "cte", "level").orderBy("pos")
    opened = F.last(F.when(F.col("tok") == "(", F.col("opens")), ignorenulls=True).over(same_level)
    rows = rows.withColumn("closes", (F.col("tok") == ")") & F.coalesce(opened, F.lit(False)))
    step = F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)
    rows = (rows.withColumn("sel_after", F.sum(step).over(stmt))
            .withColumn("depth", F.col("sel_after") + F.when(F.col("closes"), 1).otherwise(0)))
    # The enclosing scope sees a placeholder (#pos) where a nested select starts.
    own = F.struct(F.col("depth").alias("depth"), F.col("tok").alias("tok"),
                   (F.col("opens") | F.col("closes") | (F.col("tok") == _SETOP)).alias("mark"),
                   F.lit(None).cast("int").alias("child"))
    hole = F.struct((F.col("depth") - 1).alias("depth"),
                    F.concat(F.lit("(#"), F.col("pos").cast("string"), F.lit(")")).alias("tok"),
                    F.lit(False).alias("mark"), F.col("pos").alias("child"))
    rows = rows.select(*_KEYS, "cte", "pos", "opens",
                       F.inline(F.when(F.col("opens"), F.array(own, hole)).otherwise(F.array(own))))
    is_open = F.col("opens") & F.col("child").isNull()
    block = F.last(F.when(is_open, F.col("pos")), ignorenulls=True).over(
        W.partitionBy("stmt_id", "cte", "depth").orderBy("pos"))
    rows = rows.withColumn("block", F.when(F.col("depth") > 0, F.coalesce(block, F.lit(-1))).otherwise(-1))
    arm = F.sum(F.when(F.col("tok") == _SETOP, 1).otherwise(0)).over(
        W.partitionBy("stmt_id", "cte", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("arm", F.coalesce(arm, F.lit(0)))


def _nested_scopes(nested: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.when(~F.col("mark"), F.struct("pos", "tok"))))
    arms = _pieces(nested).groupBy("stmt_id", "block", "arm", "repo_url", "file_id", "cte").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("top"), F.max("depth").alias("depth"),
        F.array_join(F.transform(parts, lambda p: p["tok"]), "").alias("own_text"))
    in_block = W.partitionBy("stmt_id", "cte", "block")
    last_arm = F.col("arm") == F.max("arm").over(in_block)
    hi = F.when((F.col("block") == -1) & last_arm, F.lit(_END)).otherwise(F.col("top"))
    arms = (arms.withColumn("hi", hi).withColumn("block_hi", F.max("hi").over(in_block))
            .withColumn("own_text", F.trim(F.regexp_replace("own_text", r"\s+", " "))))
    selects = arms.filter(F.col("own_text").rlike(_SELECT))
    # Parent: the last scope one level up that starts before and still encloses this one. Each
    # scope takes part at its own level and, as a possible parent, one level deeper.
    as_child = F.struct((F.col("depth") + 1).alias("level"), F.struct("lo", "hi").alias("parent"))
    here = F.struct(F.col("depth").alias("level"), F.lit(None).cast("struct<lo:int,hi:int>").alias("parent"))
    both = selects.select("*", F.inline(F.array(here, as_child)))
    parent = F.last("parent", ignorenulls=True).over(W.partitionBy("stmt_id", "cte", "level").orderBy("lo"))
    linked = both.withColumn("up", parent).filter(F.col("parent").isNull())
    return linked.withColumn("parent_lo", F.when(F.col("up.hi") >= F.col("lo"), F.col("up.lo")))


def scopes(queries: DataFrame) -> DataFrame:
    """One row per SELECT: its interval (lo, hi) of pieces, its parent's lo, depth and own text.

    A nested select shows up in the parent's own text as (#n), where n is the child's block. `cte` tells that the
    statement has common table expressions.
    """
    q = queries if "q" in queries.columns else prepare_queries(queries)
    cols = [*_KEYS, "block", "block_hi", "lo", "hi", "parent_lo", "depth", "nested", "cte", "own_text"]
    flat = q.filter(~F.col("q").rlike(_NESTED)).select(
        *_KEYS, F.lit(-1).alias("block"), F.lit(_END).alias("block_hi"), F.lit(0).alias("lo"),
        F.lit(_END).alias("hi"), F.lit(None).cast("int").alias("parent_lo"),
        F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("nested"), F.lit(False).alias("cte"), F.trim("q").alias("own_text"))
    nested = _nested_scopes(q.filter(F.col("q").rlike(_NESTED)).withColumn("cte", F.col("q").rlike(_WITH)))
    return flat.unionByName(nested.withColumn("nested", F.lit(True)).select(*cols))


# --- parts of one scope, all inside the row ------------------------------------------------------

# What ends a scope; words that are also usual names count only with what must follow them.
_TAIL = (r"\s+order\s+by\s|\s+having\s|\s+limit\s|\s+offset\s+[\d:?$@]|\s+fetch\s+(?:first|next)\s"
         r"|\s+for\s+(?:update|share)\b|\s+qualify\s|\s+window\s+\w+\s+as\s|\s+connect\s+by\s|;|$")
_AFTER_WHERE = rf"(?:\s+group\s+by\s|{_TAIL})"
_STOP = rf"(?:\s+where\s|\s+group\s+by\s|{_TAIL})"
_NO_ALIAS = ("on using where natural left right inner full cross outer join and or set as group order "
             "having limit union offset fetch for qualify window connect").split()
_JOIN = r"(?i)\s+(?:(?:natural|inner|left|right|full|cross|outer)\s+)*join\s+"


def join_type(own_text: Column) -> Column:
    """Majority of the join keywords, ties in the order inner, left, right, full, cross."""
    low = F.lower(own_text)

    def times(pattern):
        return F.regexp_count(low, F.lit(pattern))

    counts = [("inner", times("inner join")), ("left", times("left (?:outer )?join")),
              ("right", times("right (?:outer )?join")), ("full", times("full (?:outer )?join")),
              ("cross", times("cross join"))]
    best = F.greatest(*[c for _, c in counts])
    picked = F.when(~low.contains("join"), "inner")
    for name, count in counts:
        picked = picked.when(count == best, name)
    return picked


def scope_join_type(scope_rows: DataFrame) -> DataFrame:
    return scope_rows.withColumn("join_type", join_type(F.col("own_text")))


def scope_parts(scope_rows: DataFrame) -> DataFrame:
    """Add the clause texts and arrays of a scope:

    from_tables (alias, table_ref, child), select_items, group_items and atoms. Tables of the from clause that
    a common table expression names are bound to its body (child).
    """
    parts = _parts(scope_rows)
    plain = parts.filter("not cte").drop("held")
    held = cut(_with_definitions(parts.filter("cte")).drop("held"))
    return plain.unionByName(_bind_definitions(held).select(plain.columns))


def _parts(scope_rows: DataFrame) -> DataFrame:
    # Keywords inside parentheses, as in extract(year from x), bound no clause.
    rows = scope_rows.withColumn("held", X.hold_groups(F.col("own_text")))
    outside = F.col("held.text")

    def clause(name, pattern):
        return X.with_groups(F.regexp_extract(outside, pattern, 1), F.col("held.groups")).alias(name)

    rows = rows.select(
        "*", clause("select_text", r"(?i)\bselect\s+(?:distinct\s+|all\s+|top\s+\d+\s+)?(.*?)(?:\s+from\s|$)"),
        clause("from_text", r"(?i)\bselect\s.*?\s+from\s+(.*?)" + _STOP),
        clause("where_text", r"(?i)\swhere\s+(.*?)" + _AFTER_WHERE),
        clause("group_text", rf"(?i)\sgroup\s+by\s+(.*?)(?:{_TAIL})"))
    commas = X.split_top(F.col("from_text"))
    from_items = F.flatten(F.transform(commas, lambda c: F.split(c, _JOIN)))
    rows = (rows.withColumn("from_items", from_items)
            .withColumn("from_tables", _from_items(F.col("from_items")))
            .withColumn("select_items", _select_items(X.split_top(F.col("select_text"))))
            .withColumn("group_items", F.transform(F.split("group_text", ","),
                                                   lambda g: F.lower(_unquote(F.trim(g))))))
    ons = F.filter(F.transform("from_items", lambda i: F.regexp_extract(i, r"(?i)\son\b\s*(.*)$", 1)),
                   lambda t: t != "")
    cond = F.concat_ws(" and ", ons, F.nullif(F.trim("where_text"), F.lit("")))
    rows = rows.withColumn("cond_text", cond).withColumn("limit_cols", condition_columns(F.col("cond_text")))
    listed = lambda c: F.array_contains("limit_cols", c)
    limited = F.transform(_atoms(F.col("cond_text")), lambda a: a.withField(
        "is_limited", a["is_join"] & ((F.size("limit_cols") == 0) | (listed(a["l"]) & listed(a["r"])))))
    return rows.withColumn("atoms", limited).drop("from_items", "cond_text")


def condition_columns(cond: Column) -> Column:
    """Columns named in the text of join and where conditions: the words that are no function, number or keyword."""
    words = F.regexp_extract_all(F.lower(_unquote(cond)), F.lit(r"(?<![\w$#@.:'])([a-z_#@$\u0080-\uffff][\w$#@.]*+)(?!\s*\()"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*CONDITION_WORDS)))


# --- common table expressions --------------------------------------------------------------------

_GROUP_NO = rf"{X.HELD}(\d+){X.HELD}"
_DEFINITION = (rf"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)([^\s(),]+)\s*(?:\({_GROUP_NO}\)\s*)?"
               rf"as\s*(?:(?:not\s+)?materialized\s*)?\({_GROUP_NO}\)")


def _with_definitions(rows: DataFrame) -> DataFrame:
    """Add `definitions` (name, columns, child) of the with clause of a scope, and whether it is recursive."""
    head = F.regexp_extract("held.text", r"(?i)^(.*?)\bselect\s", 1)
    found = F.regexp_extract_all(head, F.lit(_DEFINITION), F.lit(0))

    def group(text, number):
        no = F.nullif(F.regexp_extract(text, _DEFINITION, number), F.lit(""))
        return F.when(no.isNotNull(), F.get("held.groups", no.cast("int")))

    made = F.transform(found, lambda d: F.struct(
        F.lower(_unquote(F.regexp_extract(d, _DEFINITION, 1))).alias("name"),
        F.transform(F.split(F.lower(_unquote(group(d, 2))), ","), lambda c: F.trim(c)).alias("columns"),
        F.nullif(F.regexp_extract(group(d, 3), r"^\s*#(\d+)\s*$", 1), F.lit("")).try_cast("int").alias("child")))
    return (rows.withColumn("definitions", F.filter(made, lambda d: d["child"].isNotNull()))
            .withColumn("recursive", head.rlike(r"(?i)\bwith\s+recursive\b")))


def _bind_definitions(held: DataFrame) -> DataFrame:
    """Bind mentions to the nearest definition in sight, and name the columns of bodies that have a column list.

    A definition is seen from its own select and from all that follows its body inside the block that holds the with clause;
    a recursive one from its body too. Mentions meet definitions by statement and name only.
    """
    ends = held.select("stmt_id", F.col("block").alias("child"), F.col("block_hi").alias("body_hi")).distinct()
    made = (held.select("stmt_id", F.col("lo").alias("w_lo"), F.col("block_hi").alias("w_hi"), "recursive", F.inline("definitions"))
            .join(ends, ["stmt_id", "child"]))
    asked = (held.select("stmt_id", "lo", F.posexplode("from_tables").alias("t_pos", "t")).filter("t.child is null")
             .select("stmt_id", "lo", "t_pos", F.lower("t.table_ref").alias("name")))
    lo = F.col("lo")
    seen = (lo >= F.col("w_lo")) & (lo <= F.col("w_hi")) & (
        (lo == F.col("w_lo")) | (lo > F.col("body_hi")) | (F.col("recursive") & (lo >= F.col("child"))))
    bound = (asked.join(made, ["stmt_id", "name"]).filter(seen).groupBy("stmt_id", "lo", "t_pos")
             .agg(F.max(F.struct("w_lo", "child"))["child"].alias("child"))
             .groupBy("stmt_id", "lo").agg(F.map_from_entries(F.collect_list(F.struct("t_pos", "child"))).alias("bound")))
    named = (made.filter(F.size("columns") > 0).groupBy("stmt_id", F.col("child").alias("lo"))
             .agg(F.first("columns").alias("given")))
    rows = held.join(bound, ["stmt_id", "lo"], "left").join(named, ["stmt_id", "lo"], "left")
    tables = F.transform("from_tables", lambda t, i: F.when(F.col("bound")[i].isNotNull(), F.struct(
        t["alias"].alias("alias"), F.lit(None).cast("string").alias("table_ref"), F.col("bound")[i].alias("child"))).otherwise(t))
    items = F.transform("select_items", lambda s, i: F.when(F.get("given", i).isNotNull() & ~F.coalesce(
        s["expr"].endswith("*"), F.lit(False)), s.withField("out", F.get("given", i)).withField("aliased", F.lit(True))).otherwise(s))
    return (rows.withColumn("from_tables", F.when(F.col("bound").isNull(), F.col("from_tables")).otherwise(tables))
            .withColumn("select_items", F.when(F.col("given").isNull(), F.col("select_items")).otherwise(items)))


def _unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"""[`"\[\]]""", "")


_FROM = rf"(?i)^(?:\(?#(\d+)\)|{_USER}?({X.NAME})\s*\)?)\s*(?:as\s+)?([`\"\[]?[\w$#@]+[`\"\]]?)?"


def _from_items(items: Column) -> Column:
    """Alias with the table, or with the block of the derived table, of each item of a from
    clause. Built in steps, so that no pattern runs twice."""
    opened = F.transform(items, lambda i: F.regexp_replace(i, r"^[\s(]+(?!#)", ""))
    found = F.transform(opened, lambda i: F.struct(
        F.nullif(F.regexp_extract(i, _FROM, 1), F.lit("")).try_cast("int").alias("child"),
        F.nullif(X.clean_ident(F.regexp_extract(i, _FROM, 2)), F.lit("")).alias("table_ref"),
        F.lower(_unquote(F.regexp_extract(i, _FROM, 3))).alias("word")))
    known = F.filter(found, lambda t: t["child"].isNotNull() | (
        t["table_ref"].isNotNull() & ~t["table_ref"].startswith("(#")))
    return F.transform(known, lambda t: F.struct(
        F.coalesce(F.when(~t["word"].isin("", *_NO_ALIAS), t["word"]),
                   F.lower(X.last_part(t["table_ref"]))).alias("alias"),
        t["table_ref"].alias("table_ref"), t["child"].alias("child")))


_AGG = "|".join(AGGREGATES)
_COLREF = r"[\w$#@.\[\]`\"]+"


_IS_REF = r"^(?:[a-z_#@$\u0080-\uffff][\w$#@]*\.)*+[a-z_#@$\u0080-\uffff][\w$#@]*$"


def _select_items(items: Column) -> Column:
    """expr (column reference or star, lower case), out (output name), func and aliased of each
    select item. Built in steps, so that no pattern runs twice."""
    named = F.transform(items, lambda i: F.struct(
        i.alias("item"), F.regexp_extract(i, r"(?i)\s+as\s+(\S+)$", 1).alias("named")))
    bare = F.transform(named, lambda f: f.withField("bare", F.when(
        f["named"] == "", F.regexp_extract(f["item"], r"^(?:\S+|.*\))\s+([\w$#@`\"\[\]]+)$", 1)).otherwise("")))
    split = F.transform(bare, lambda f: F.struct(
        F.coalesce(F.nullif(f["named"], F.lit("")), F.nullif(f["bare"], F.lit(""))).alias("alias"),
        F.when(f["named"] != "", F.regexp_replace(f["item"], r"(?i)\s+as\s+\S+$", ""))
        .when(f["bare"] != "", F.regexp_replace(f["item"], r"\s+\S+$", "")).otherwise(f["item"]).alias("expr")))
    called = F.transform(split, lambda f: F.when(F.contains(f["expr"], F.lit("(")), F.struct(
        f["alias"].alias("alias"), f["expr"].alias("expr"),
        F.lower(F.regexp_extract(f["expr"], rf"(?i)^({_AGG})\s*\(", 1)).alias("func"),
        F.regexp_extract(f["expr"], r"(?i)^\w+\s*\(\s*(?:distinct\s+)?([^()]*?)\s*\)$", 1).alias("inner")))
        .otherwise(F.struct(f["alias"].alias("alias"), f["expr"].alias("expr"),
                            F.lit("").alias("func"), F.lit("").alias("inner"))))
    refs = F.transform(called, lambda f: F.struct(
        F.lower(_unquote(f["alias"])).alias("alias"), f["func"].alias("func"), (f["inner"] == "").alias("plain"),
        F.lower(_unquote(F.trim(F.when(f["inner"] != "", f["inner"]).otherwise(f["expr"])))).alias("ref")))
    judged = F.transform(refs, lambda f: F.struct(
        f["alias"].alias("alias"), f["func"].alias("func"), f["ref"].alias("ref"),
        f["ref"].rlike(_IS_REF).alias("is_ref"),
        (f["plain"] & f["ref"].rlike(r"^(?:[\w$#@.]+\.)?\*$")).alias("is_star")))
    return F.transform(judged, lambda f: F.struct(
        F.when(f["is_ref"] | f["is_star"], f["ref"]).alias("expr"),
        F.coalesce(f["alias"], F.when(f["is_ref"], X.last_part(f["ref"]))).alias("out"),
        F.when(f["is_ref"], F.nullif(f["func"], F.lit(""))).alias("func"),
        f["alias"].isNotNull().alias("aliased")))


def _atoms(cond: Column) -> Column:
    """Comparison atoms of a condition text, split and judged in steps."""
    pieces = F.transform(F.split(cond, r"(?i)\s+(?:and|or)\s+"), lambda a: _bare_atom(a))
    plain = F.transform(F.filter(pieces, lambda a: a != ""), lambda a: F.struct(
        a.alias("atom"), F.lower(F.regexp_replace(F.when(a.contains('"'), F.regexp_replace(
            a, r"\"([^\"]*)\"\.|\.\"([^\"]*)\"", "$1.$2")).otherwise(a), r"::\s*\w+", "")).alias("plain")))
    parts = r"^(.*?)\s*(<=|>=|<>|!=|==|=|<|>)\s*(.*)$"
    sides = F.transform(plain, lambda a: F.struct(
        a["atom"].alias("atom"), a["plain"].alias("plain"),
        F.regexp_extract(a["plain"], parts, 1).alias("l"), F.regexp_extract(a["plain"], parts, 2).alias("op"),
        F.regexp_extract(a["plain"], parts, 3).alias("r")))
    names = F.create_map(*[F.lit(v) for kv in OP_NAMES.items() for v in kv])
    known = F.transform(sides, lambda a: a.withField(
        "op_name", F.when((a["l"] != "") & (a["r"] != ""), names[a["op"]]))
        .withField("l_literal", a["l"].rlike(_LITERAL)).withField("r_literal", a["r"].rlike(_LITERAL)))
    return F.transform(known, _judge)


def _bare_atom(a: Column) -> Column:
    """An atom without the parentheses left over from splitting at AND and OR."""
    opened = F.trim(F.regexp_replace(a, r"^[\s(]+(?!#)", ""))
    return F.when(~a.rlike("[()]"), F.trim(a)).when(F.contains(opened, F.lit("(")), opened).otherwise(
        F.regexp_replace(opened, r"[\s)]+$", ""))


_VALUE = r"^[-+]?\$?\s*[0-9]+(?:\.[0-9]*)?(?:e[-+]?[0-9]+)?$|^(?:default|true|false|null)$"
_LITERAL = r"^[-+]?\$?\s*[0-9]+(?:\.[0-9]*)?(?:e[-+]?[0-9]+)?$|^n?'|^\""


def _side(c: Column) -> Column:
    """A side as a column reference; a trailing word after a blank is dropped."""
    return _unquote(F.when(c.rlike(r"[\[\]]"), c).otherwise(F.regexp_replace(c, r"\s+\S*$", "")))


def _judge(a: Column) -> Column:
    """Whether the atom can be a join condition, and whether it selects by a literal."""
    words = a["plain"].rlike(r"\b(?:select|from|join|where)\s")
    marks = a["plain"].rlike(r"[,()+?@:'\"]")
    spaces = (F.regexp_count(a["l"], F.lit(" ")) > 1) | (F.regexp_count(a["r"], F.lit(" ")) > 1)
    kept = a["op_name"].isNotNull()
    join = kept & ~marks & ~words & ~spaces & ~a["l"].rlike(_VALUE) & ~a["r"].rlike(_VALUE)
    return F.struct(a["atom"].alias("atom"), a["op"].alias("op"), a["op_name"].alias("op_name"),
                    _side(a["l"]).alias("l"), _side(a["r"]).alias("r"), join.alias("is_join"),
                    (kept & (a["l_literal"] | a["r_literal"])).alias("is_selection"),
                    a["l_literal"].alias("l_literal"), a["r_literal"].alias("r_literal"))


def scope_tables(parts: DataFrame) -> DataFrame:
    """Tables and derived tables of each scope with their alias; equal ones once.

    Here and below the outer form of explode: the plain one adds a filter on the array, which the optimizer pushes down
    and so computes the array twice.
    """
    return (parts.select(*_KEYS, "lo", "hi", F.posexplode_outer("from_tables").alias("t_pos", "t")).filter("t is not null")
            .select(*_KEYS, "lo", "hi", "t_pos", "t.alias", "t.table_ref", "t.child"))


def comparisons(parts: DataFrame) -> DataFrame:
    """Comparison atoms of ON and WHERE, in order."""
    return (parts.select(*_KEYS, "lo", F.posexplode_outer("atoms").alias("atom_seq", "a"))
            .filter("a.op <> ''").select(*_KEYS, "lo", "atom_seq", "a.*"))


def join_candidates(atoms: DataFrame) -> DataFrame:
    return atoms.filter("is_join")


def norm_op(atoms: DataFrame) -> DataFrame:
    """Comparisons of the five kept operators, by name."""
    return atoms.filter(F.col("op_name").isNotNull())
