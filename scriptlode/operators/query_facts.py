"""Query facts: join conditions, projections, selections, aggregates and group-bys, resolved
against the catalog of their repository.

Every mention of a column becomes one row; aliases of the same scope are bound inside the row, and
only mentions of derived tables, of common table expressions or of enclosing scopes are joined, by the
intervals of their statement. All kinds are resolved by one lookup of the distinct (repository, table, column)
mentions. Candidates are ordered by `c_pos`, a list of numbers: (0, place) for a table of the own scope, (1 or 2, scope,
place) for one inside a derived table (2: before the select that renames the column), (9) for any table.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.fixed import MIRRORED
from ..session import cut, cut_all
from . import scopes as Q
from .catalog import Catalog, Names, resolve_column, resolve_table
from .intervals import within

_KEYS = ["stmt_id", "repo_url", "file_id"]
_REF = ["stmt_id", "lo", "seq", "kind", "side", "func", "atom", "repo_url", "file_id"]
_PART = r"[a-z_#@$\u0080-￿][\w$#@]*"


def _order(*numbers) -> Column:
    return F.array(*[n.cast("int") if isinstance(n, Column) else F.lit(n) for n in numbers])


def _mention(kind, seq, ref, side="", func=None, atom=None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), seq.alias("seq"), F.lit(side).alias("side"),
                    (F.lit("") if func is None else F.coalesce(func, F.lit(""))).alias("func"),
                    (F.lit("") if atom is None else atom).alias("atom"), ref.alias("ref"))


KINDS = ("projection", "aggregate", "groupby", "selection", "condition")


def mentions(parts: DataFrame, kinds: tuple = KINDS) -> DataFrame:
    """One row per column mention of a scope, with the tables it may belong to; only mentions of the given kinds.

    mode: named (one base table), bare (no prefix), derived (a sub-select's alias) or outer (an
    alias not bound in the own scope of a nested statement).
    """
    group_ref = lambda g: F.coalesce(
        F.get(F.filter("select_items", lambda s: s["aliased"] & (s["out"] == g)), F.lit(0))["expr"], g)
    listed = {
        "projection": [F.transform("select_items", lambda s, i: _mention("projection", i, s["expr"]))],
        "aggregate": [F.transform("select_items", lambda s, i: _mention(
            "aggregate", i, F.when(s["func"].isNotNull(), s["expr"]), func=s["func"]))],
        "groupby": [F.transform("group_items", lambda g, i: _mention("groupby", i, group_ref(g)))],
        "selection": [F.transform("atoms", lambda a, i: _mention(
            "selection", i, F.when(a["is_selection"] & ~a["l_literal"], a["l"]))),
            F.transform("atoms", lambda a, i: _mention(
                "selection", i, F.when(a["is_selection"] & ~a["r_literal"], a["r"])))],
        "condition": [F.transform("atoms", lambda a, i: _mention(
            "condition", i, F.when(a["is_limited"], a["l"]), "l", a["op_name"], a["atom"])),
            F.transform("atoms", lambda a, i: _mention(
                "condition", i, F.when(a["is_limited"], a["r"]), "r", a["op_name"], a["atom"]))]}
    arrays = [array for kind in kinds for array in listed[kind]]
    refs = F.filter(F.concat(*arrays), lambda m: m["ref"].rlike(rf"^(?:{_PART}\.)*+(?:{_PART}|\*)$"))
    named = F.transform(refs, lambda m: m.withField(
        "prefix", F.nullif(F.regexp_extract(m["ref"], r"^(.*)\.[^.]+$", 1), F.lit("")))
        .withField("lcol", X.last_part(m["ref"])))
    bound = F.transform(named, lambda m: m.withField("bound", F.when(
        m["prefix"].isNotNull(), F.get(F.filter("from_tables", lambda t: (t["alias"] == m["prefix"])
                                                | (F.lower(t["table_ref"]) == m["prefix"])), F.lit(0)))))
    rows = parts.select(*_KEYS, "lo", "hi", "nested", "from_tables", F.inline(bound))
    mode = (F.when(F.col("prefix").isNull(), "bare")
            .when(F.col("bound.child").isNotNull(), "derived")
            .when(F.col("bound").isNotNull() | ~F.col("nested"), "named")
            .otherwise("outer"))
    return rows.withColumn("mode", mode)


def _named_and_bare(rows: DataFrame) -> DataFrame:
    """Candidates of named mentions (one) and of bare ones: each table of the scope and, for a
    condition in the end, any table of the repository."""
    def entry(table_ref):
        return F.struct(F.lit(None).cast("string").alias("alias"), table_ref.alias("table_ref"),
                        F.lit(None).cast("int").alias("child"))

    bare = F.when(F.col("kind") == "condition", F.array_append("from_tables", entry(F.lit("*")))).otherwise(
        F.col("from_tables"))
    listed = F.when(F.col("mode") == "named",
                    F.array(entry(F.coalesce("bound.table_ref", "prefix")))).otherwise(bare)
    return (rows.filter(F.col("mode").isin("named", "bare"))
            .select(*_REF, "mode", "lcol", F.posexplode(listed).alias("pos", "t"))
            .select(*_REF, "mode", "lcol",
                    F.when(F.col("t.table_ref") == "*", _order(9)).otherwise(_order(0, F.col("pos"))).alias("c_pos"),
                    "t.table_ref", "t.child"))


def _outer(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Bind aliases of enclosing scopes: the nearest enclosing scope that has the alias."""
    cols = [*_REF, "mode", "lcol", "prefix"]
    asked = rows.filter(F.col("mode") == "outer").select(*cols)
    # Only names that are asked for, and only as far as the last mention: the outermost scope has no end of its own.
    last = asked.groupBy("stmt_id", "prefix").agg(F.max("lo").alias("last"))
    names = tables.select(
        "stmt_id", F.col("lo").alias("t_lo"), (F.col("lo") + 1).alias("t_from"), F.col("hi").alias("t_hi"), "table_ref", "child",
        F.explode(F.array_distinct(F.array_compact(F.array("alias", F.lower("table_ref"))))).alias("prefix")
    ).join(last, ["stmt_id", "prefix"]).withColumn("t_hi", F.least("t_hi", "last")).drop("last")
    found = within(asked, names, ["stmt_id", "prefix"], "lo", "t_from", "t_hi").select(
        *cols, F.struct("t_lo", "table_ref", "child").alias("t"))
    none = asked.select(*cols, F.lit(None).cast(found.schema["t"].dataType).alias("t"))
    best = found.unionByName(none).groupBy(*cols).agg(F.max("t").alias("t"))
    # An alias that no enclosing scope binds names a table.
    return best.select(
        *_REF, "mode", "lcol", _order(0, 0).alias("c_pos"),
        F.when(F.col("t").isNull(), F.col("prefix")).otherwise(F.col("t.table_ref")).alias("table_ref"),
        F.col("t.child").alias("child"))


def _renames(inside: DataFrame) -> DataFrame:
    """Select items that give a column another name: s_lo, lcol (the new name), src, and the block they take it from if that is
    a derived table."""
    items = F.transform("select_items", lambda s: s.withField(
        "prefix", F.nullif(F.regexp_extract(s["expr"], r"^(.*)\.[^.]+$", 1), F.lit(""))))
    rows = (inside.select("stmt_id", F.col("lo").alias("s_lo"), "from_tables", F.inline(items))
            .filter(F.col("aliased") & F.col("expr").isNotNull()))
    bound = F.filter("from_tables", lambda t: (t["alias"] == F.col("prefix")) | (F.lower(t["table_ref"]) == F.col("prefix")))
    only = F.when(F.size("from_tables") == 1, F.col("from_tables"))
    source = F.get(F.when(F.col("prefix").isNotNull(), bound).otherwise(only), F.lit(0))
    return rows.select("stmt_id", "s_lo", F.col("out").alias("lcol"), X.last_part(F.col("expr")).alias("src"),
                       source["child"].alias("src_child"))


def _derived(cands: DataFrame, parts: DataFrame) -> DataFrame:
    """Replace a derived table by the base tables inside it, in order of appearance.

    A column that a select alias inside renames is traced to its source column, and the tables of the renaming
    select come first. If that select takes the column from a derived table of its own, or a scope inside names a
    common table expression, that one is asked in turn; how many turns it takes is the depth of the nesting.
    """
    inside = parts.filter("nested")
    blocks = inside.select("stmt_id", F.col("block").alias("child"), "block_hi").distinct()
    renames = _renames(inside)
    held = Q.scope_tables(inside).select(
        "stmt_id", F.col("lo").alias("s_lo"), "t_pos", F.col("table_ref").alias("base_ref"), F.col("child").alias("base_child"))
    asked = (cands.filter(F.col("child").isNotNull() & (F.col("lcol") != "*"))
             .withColumn("mode", F.when(F.col("mode") == "bare", "bare_derived").otherwise("derived"))
             .select(*_REF, "mode", "lcol", _order().cast("array<int>").alias("c_pos"), "child", F.array("child").alias("trail")))
    # Each turn uses these several times; they are narrow, and written once.
    asked, renames, held = cut_all([asked, renames, held])
    nested_deeper = inside.filter("depth > 1 or cte").limit(1).count() > 0
    out = []
    while True:
        spans = asked.select("stmt_id", "child", "lcol").distinct().join(blocks, ["stmt_id", "child"])
        first = (within(renames, spans, ["stmt_id", "lcol"], "s_lo", "child", "block_hi")
                 .groupBy("stmt_id", "child", "lcol").agg(F.min(F.struct("s_lo", "src", "src_child")).alias("r")))
        traced = cut(spans.join(first, ["stmt_id", "child", "lcol"], "left"))
        # A source block around the select itself is the table of a recursive definition; its base tables are asked already.
        onward = F.col("r.src_child").isNotNull() & ~((F.col("r.src_child") <= F.col("r.s_lo")) & (F.col("r.src_child") == F.col("child")))
        stays = traced.filter(~F.coalesce(onward, F.lit(False)))
        found = cut(within(held, stays, ["stmt_id"], "s_lo", "child", "block_hi").select(
            "stmt_id", "child", "lcol", F.coalesce("r.src", "lcol").alias("src_col"),
            _order(F.when(F.col("s_lo") < F.col("r.s_lo"), 2).otherwise(1), F.col("s_lo"), F.col("t_pos")).alias("place"),
            "base_ref", "base_child", ((F.col("base_child") >= F.col("child")) & (F.col("base_child") <= F.col("block_hi"))).alias("own")))
        hits = asked.join(found.filter("base_ref is not null"), ["stmt_id", "child", "lcol"])
        out.append(hits.select(*_REF, "mode", F.col("src_col").alias("lcol"), F.concat("c_pos", "place").alias("c_pos"),
                               F.col("base_ref").alias("table_ref")))
        if not nested_deeper:
            break
        further = found.filter("base_child is not null and not own").select(
            "stmt_id", "child", "lcol", "src_col", "place", F.col("base_child").alias("next"))
        renamed = traced.filter(onward).select(
            "stmt_id", "child", "lcol", F.col("r.src").alias("src_col"), _order(1, F.col("r.s_lo"), 0).alias("place"), F.col("r.src_child").alias("next"))
        asked = cut(asked.join(further.unionByName(renamed), ["stmt_id", "child", "lcol"])
                    .filter(~F.array_contains("trail", F.col("next")))
                    .select(*_REF, "mode", F.col("src_col").alias("lcol"), F.concat("c_pos", "place").alias("c_pos"),
                            F.col("next").alias("child"), F.array_append("trail", F.col("next")).alias("trail")))
        if asked.isEmpty():
            break
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def candidates(parts: DataFrame, kinds: tuple = KINDS) -> DataFrame:
    """Each mention of the given kinds with the tables that may hold it, in order of preference (c_pos).

    Statements of one scope are bound row by row, without a shuffle; only the mentions of nested
    statements are joined to the scopes around and inside them.
    """
    flat, nested = mentions(parts.filter("not nested"), kinds), cut(mentions(parts.filter("nested"), kinds))
    tables = Q.scope_tables(parts.filter("nested"))
    direct = _named_and_bare(nested).unionByName(cut(_outer(nested, tables)))
    named_child = nested.filter(F.col("mode") == "derived").select(
        *_REF, "mode", "lcol", _order(0, 0).alias("c_pos"),
        F.lit(None).cast("string").alias("table_ref"), F.col("bound.child").alias("child"))
    inner = _derived(direct.filter(F.col("child").isNotNull()).unionByName(named_child), parts)
    held = _named_and_bare(flat).unionByName(direct).filter(F.col("table_ref").isNotNull()).drop("child")
    return held.unionByName(inner)


def resolved(cands: DataFrame, catalog: Catalog | Names, columns: DataFrame | None = None) -> DataFrame:
    """Candidates with the table and column found; null where not. `columns` are needed if only the names of a catalog are built."""
    plain = cands.filter("lcol <> '*'")
    found = resolve_column(plain, catalog.all_tables, catalog.columns if columns is None else columns, index=catalog.lookup)
    return plain.join(found, ["lcol", "table_ref", "repo_url"], "left")


def star_columns(cands: DataFrame, catalog: Catalog) -> DataFrame:
    """Columns of the tables named by star projections."""
    stars = cands.filter("lcol = '*' and table_ref <> '*'").select(*_REF, "table_ref").distinct()
    names = resolve_table(stars, catalog.all_tables, prefixes=True, index=catalog.lookup)
    return (stars.join(names, ["table_ref", "repo_url"])
            .join(catalog.columns.select("repo_url", "table_name", "col_name"), ["table_name", "repo_url"]))


def query_refs(found: DataFrame, stars: DataFrame) -> DataFrame:
    """Distinct facts of a query: kind, func, table_name and col_name.

    A column without prefix is credited to every table of its scope that holds it, a column of a
    derived table to the first table inside that holds it.
    """
    hits = found.filter((F.col("kind") != "condition") & F.col("col_name").isNotNull())
    out = ["stmt_id", "repo_url", "file_id", "kind", "func", "table_name", "col_name"]
    inner = F.col("mode").isin("derived", "bare_derived", "outer")
    first = (hits.filter(inner).groupBy(*_REF)
             .agg(F.min(F.struct("c_pos", "table_name", "col_name")).alias("t"))
             .select(*out[:5], "t.table_name", "t.col_name"))
    return (hits.filter(~inner).select(*out).unionByName(first)
            .unionByName(stars.select(*out)).distinct())


def projections(refs: DataFrame) -> DataFrame:
    return refs.filter("kind = 'projection'")


def selections(refs: DataFrame) -> DataFrame:
    return refs.filter("kind = 'selection'")


def aggregates(refs: DataFrame) -> DataFrame:
    return refs.filter("kind = 'aggregate'")


def groupbys(refs: DataFrame) -> DataFrame:
    return refs.filter("kind = 'groupby'")


def limit_conditions(parts: DataFrame) -> DataFrame:
    """Join candidates whose two columns occur among the columns of the scope's join and where clauses, when
    that list is not empty. Only these are resolved."""
    return (parts.select(*_KEYS, "lo", F.posexplode_outer("atoms").alias("atom_seq", "a"))
            .filter("a.is_limited").select(*_KEYS, "lo", "atom_seq", "a.*"))


def conditions(found: DataFrame) -> DataFrame:
    """Join conditions with both sides resolved to the first candidate that holds the column, or
    with the side and reason of the first failed check.

    One aggregate per comparison, so a group never exceeds a statement.
    """
    rows = found.filter("kind = 'condition'")

    def hit(side):
        ok = (F.col("side") == side) & F.col("col_name").isNotNull()
        return F.min(F.when(ok, F.struct("c_pos", "table_name", "col_name", "mode")))

    def any_table(side):
        named = F.col("table_name").isNotNull() & (F.col("mode") != "bare")
        return F.coalesce(F.max(F.when(F.col("side") == side, named)), F.lit(False))

    def asked(side):
        return F.min(F.when((F.col("side") == side) & (F.col("mode") != "bare"),
                            F.struct("c_pos", "table_ref")))

    def column(side):
        return F.min(F.when(F.col("side") == side, F.col("lcol")))

    rows = rows.groupBy("stmt_id", "lo", F.col("seq").alias("atom_seq"), F.col("func").alias("op"),
                        F.col("atom").alias("condition"), "repo_url", "file_id").agg(
        hit("l").alias("l"), hit("r").alias("r"), any_table("l").alias("lt"), any_table("r").alias("rt"),
        asked("l").alias("la"), asked("r").alias("ra"), column("l").alias("lc"), column("r").alias("rc"))
    side = F.when(F.col("l").isNull(), "left").when(F.col("r").isNull(), "right")
    reason = F.when(F.col("l").isNull(), F.when(F.col("lt"), "column").otherwise("table")).when(
        F.col("r").isNull(), F.when(F.col("rt"), "column").otherwise("table"))
    rows = rows.withColumn("failed_side", side).withColumn("reason", reason)
    left = F.col("failed_side") == "left"
    name = F.when(F.col("reason") == "table", F.when(left, F.col("la.table_ref")).otherwise(F.col("ra.table_ref"))
                  ).when(F.col("reason") == "column", F.when(left, F.col("lc")).otherwise(F.col("rc")))
    return rows.select(
        *_KEYS, "lo", "atom_seq", "condition", "op",
        F.col("l.table_name").alias("l_table"), F.col("l.col_name").alias("l_col"),
        F.col("r.table_name").alias("r_table"), F.col("r.col_name").alias("r_col"),
        F.coalesce(F.col("l.mode").contains("derived") | F.col("r.mode").contains("derived"),
                   F.lit(False)).alias("derived"),
        "failed_side", "reason", name.alias("name"))


def derived_joins(conds: DataFrame) -> DataFrame:
    return conds.filter("derived and reason is null")


def resolution_failures(conds: DataFrame) -> DataFrame:
    return conds.filter("reason is not null").select(
        *_KEYS, "lo", "condition", F.col("failed_side").alias("side"), "reason", "name")


def unfound_tables(failures: DataFrame) -> DataFrame:
    return (failures.filter("reason = 'table' and name is not null")
            .select("repo_url", F.col("name").alias("table_ref")).distinct())


def binary_joins(conds: DataFrame, scope_rows: DataFrame) -> DataFrame:
    """One row per unordered table pair of a scope with its conditions; a flipped condition gets
    the mirrored operator."""
    mirror = F.create_map(*[F.lit(v) for kv in MIRRORED.items() for v in kv])
    flip = F.col("l_table") > F.col("r_table")
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    rows = conds.filter("reason is null").select(
        *_KEYS, "lo", pick("l_table", "r_table").alias("l_table"), pick("r_table", "l_table").alias("r_table"),
        F.struct(pick("l_col", "r_col").alias("l"), F.when(flip, mirror[F.col("op")]).otherwise(F.col("op")).alias("op"),
                 pick("r_col", "l_col").alias("r")).alias("cond"))
    pairs = rows.groupBy("stmt_id", "lo", "l_table", "r_table", "repo_url", "file_id").agg(
        F.array_sort(F.collect_set("cond")).alias("conditions"))
    types = Q.scope_join_type(scope_rows).select("stmt_id", "lo", "join_type")
    return pairs.join(types, ["stmt_id", "lo"], "left")


def queries(refs: DataFrame, joins: DataFrame) -> DataFrame:
    """Queries that have any fact, with the kinds they have. Counts are combined before the
    shuffle."""
    rows = refs.select("repo_url", "file_id", "stmt_id", "kind", F.lit(0).alias("joins"), F.lit(0).alias("conds")).unionByName(
        joins.select("repo_url", "file_id", "stmt_id", F.lit("join").alias("kind"), F.lit(1).alias("joins"),
                     F.size("conditions").alias("conds")))

    def has(kind):
        return F.max(F.col("kind") == kind)

    return rows.groupBy(*_KEYS).agg(
        F.sum("joins").alias("n_joins"), F.sum("conds").alias("n_conditions"),
        has("projection").alias("has_projection"), has("aggregate").alias("has_aggregate"),
        has("selection").alias("has_selection"), has("groupby").alias("has_groupby"))


@dataclass
class QueryFacts:
    """Query fact tables of a corpus. Each is a lazy DataFrame."""

    statements: DataFrame
    scopes: DataFrame
    parts: DataFrame
    candidates: DataFrame
    conditions: DataFrame
    refs: DataFrame
    binary_joins: DataFrame
    failures: DataFrame
    queries: DataFrame


@dataclass
class Conditions:
    """What leads to the join conditions of a corpus and no further: `candidates` of kind condition, and the conditions."""

    candidates: DataFrame
    conditions: DataFrame


def build_parts(query_stmts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query statements made ready, and the parts of their scopes; both are written."""
    query_stmts = cut(Q.prepare_queries(query_stmts))
    return query_stmts, cut(Q.scope_parts(Q.scopes(query_stmts)))


def build_condition_candidates(parts: DataFrame) -> DataFrame:
    return cut(candidates(parts, ("condition",)))


def build_conditions(cands: DataFrame, names: Names, columns: DataFrame) -> Conditions:
    """Join conditions from their candidates and the names and columns of the catalog."""
    return Conditions(cands, cut(conditions(resolved(cands, names, columns))))


def build_query_facts(query_stmts: DataFrame, catalog: Catalog, parts: tuple[DataFrame, DataFrame] | None = None,
                      made: Conditions | None = None) -> QueryFacts:
    """Extract and resolve the facts of query statements. `parts` and `made` are the results of build_parts and
    build_conditions, if they were built before; then only the other kinds of mentions are resolved."""
    query_stmts, parts = build_parts(query_stmts) if parts is None else parts
    cands = cut(candidates(parts, KINDS if made is None else KINDS[:-1]))
    found = cut(resolved(cands, catalog))
    every = cands if made is None else cands.unionByName(made.candidates)
    conds, refs = cut_all([conditions(found), query_refs(found, star_columns(every, catalog))]) if made is None else (
        made.conditions, cut(query_refs(found, star_columns(every, catalog))))
    joins = cut(binary_joins(conds, parts))
    return QueryFacts(query_stmts.drop("q"), parts, parts, every, conds, refs, joins,
                      resolution_failures(conds), cut(queries(refs, joins)))
