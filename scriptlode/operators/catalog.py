"""Catalog resolution. All joins are equi-joins inside one repository.

Scale rules used here: a "pick one per group" is row_number() = 1, which Spark cuts to one row per
group before the shuffle (WindowGroupLimit); references are reduced to distinct names by a
partial aggregate before any lookup; lookups go to sides that are unique on the join key, so a
name that holds a large share of the rows can be split by adaptive execution. Key lists start with the most selective name: repository urls share a long
prefix, which would make every sort compare whole strings.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import text as X
from ..functions.fixed import base_type_rows
from ..session import cut, cut_all
from . import ddl


def _top1(df: DataFrame, by: list, *order) -> DataFrame:
    return (df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
            .filter(F.col("_rn") == 1).drop("_rn"))


# --- tables ------------------------------------------------------------------------------------

def table_versions(facts: DataFrame) -> DataFrame:
    """Create-table statements as versions of a table with their column and key counts.

    n_keys counts valid keys and declared foreign keys.
    """
    return (facts.filter(F.col("table_name").isNotNull())
            .withColumn("n_cols", F.size("cols"))
            .withColumn("n_keys", F.size("keys") + F.size("fks")))


def pick_tables(versions: DataFrame) -> DataFrame:
    """One version per (repo, name): most columns, then most keys, then the newest."""
    return _top1(versions, ["table_name", "repo_url"],
                 F.desc("n_cols"), F.desc("n_keys"), F.desc("file_id"), F.desc("stmt_seq"))


def dropped_versions(versions: DataFrame, picked: DataFrame) -> DataFrame:
    """Versions that lost, next to the one that was kept.

    Joins to the one kept row of each name instead of ranking a whole group in one task.
    """
    kept = picked.select("repo_url", "table_name", F.col("stmt_id").alias("saved_stmt_id"),
                         F.col("n_cols").alias("saved_n_cols"), F.col("n_keys").alias("saved_n_keys"),
                         F.col("lcols").alias("saved_lcols"))
    return (versions.join(kept, ["table_name", "repo_url"])
            .filter(F.col("stmt_id") != F.col("saved_stmt_id")))


def lost_columns(dropped: DataFrame) -> DataFrame:
    """Number of columns of each dropped version that the kept version lacks."""
    return dropped.select("repo_url", "table_name", "stmt_id",
                          F.size(F.array_except("lcols", "saved_lcols")).alias("n_lost"))


def name_variants(name: Column, prefixes: bool = True) -> Column:
    """Lookup forms of a table name in priority order: as it is, in lower case, last dotted part,
    and, with prefixes, the lower-case forms without the leading marks # and @."""
    low = F.lower(name)
    forms = [low, X.last_part(low)]
    if prefixes:
        forms += [F.regexp_replace(f, "^[#@]+", "") for f in forms]
    forms = [name, *forms]
    return F.filter(F.array_distinct(F.array(*forms)), lambda f: f != "")


def table_keys(tables: DataFrame, prefixes: bool = True) -> DataFrame:
    """Lookup index of tables, unique on (repo_url, lookup)."""
    rows = tables.select(
        "repo_url", "table_name", "file_id", "stmt_seq",
        F.posexplode(name_variants(F.col("table_name"), prefixes)).alias("form", "lookup"))
    return (_top1(rows, ["lookup", "repo_url"], "form", "file_id", "stmt_seq", "table_name")
            .select("repo_url", "lookup", "table_name"))


def lookup_index(tables: DataFrame) -> DataFrame:
    """Both lookup indexes in one table, unique on (repo_url, lookup), to be written once: table_name is what the
    lookup finds with prefixes, plain_name without (null if only a form without its marks finds a table)."""
    rows = tables.select("repo_url", "table_name", "file_id", "stmt_seq",
                         F.size(name_variants(F.col("table_name"), False)).alias("n_plain"),
                         F.posexplode(name_variants(F.col("table_name"))).alias("form", "lookup"))
    place = F.struct("form", "file_id", "stmt_seq", "table_name")
    return (rows.groupBy("lookup", "repo_url")
            .agg(F.min(place).alias("any"), F.min(F.when(F.col("form") < F.col("n_plain"), place)).alias("plain"))
            .select("repo_url", "lookup", "any.table_name", F.col("plain.table_name").alias("plain_name")))


def resolve_table(refs: DataFrame, tables: DataFrame, prefixes: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Distinct (repo_url, table_ref) with the table they name; null when there is none.

    Exact name first (ignoring case), then the last dotted part; with prefixes also # and @ forms
    and schema prefixes such as dbo., public. and mydb. `index`, if given, is a stored lookup_index of the tables.
    """
    names = refs.select("repo_url", "table_ref").distinct()
    forms = names.select("repo_url", "table_ref", F.posexplode(
        name_variants(F.col("table_ref"), prefixes)).alias("form", "lookup"))
    if index is None:
        keys = table_keys(tables, prefixes)
    else:
        keys = index.select("repo_url", "lookup", F.col("table_name" if prefixes else "plain_name").alias("table_name"))
    found = forms.join(keys, ["lookup", "repo_url"], "left")
    return found.groupBy("table_ref", "repo_url").agg(
        F.min_by("table_name", F.when(F.col("table_name").isNotNull(), F.col("form"))).alias("table_name"))


def resolve_table_variants(refs: DataFrame, tables: DataFrame, index: DataFrame | None = None) -> DataFrame:
    return resolve_table(refs, tables, prefixes=True, index=index)


def resolve_column(refs: DataFrame, tables: DataFrame, columns: DataFrame,
                   prefixes: bool = True, index: DataFrame | None = None) -> DataFrame:
    """Distinct (repo_url, table_ref, lcol) with table_name and col_name, null where not found.

    A reference with table_ref '*' means any table of the repository; the first one in catalog
    order that holds the column is taken.
    """
    names = refs.select("repo_url", "table_ref", "lcol").distinct()
    named, any_table = names.filter("table_ref <> '*'"), names.filter("table_ref = '*'")
    found = (named.join(resolve_table(named, tables, prefixes, index), ["table_ref", "repo_url"], "left")
             .join(columns.select("repo_url", "table_name", "lcol", "col_name"),
                   ["lcol", "table_name", "repo_url"], "left"))
    # The owner is picked before the join: rows of a name that very many tables share are cut
    # before they are shuffled.
    owners = first_owner(columns)
    return found.select("repo_url", "table_ref", "lcol", "table_name", "col_name").unionByName(
        any_table.join(owners, ["lcol", "repo_url"], "left")
        .select("repo_url", "table_ref", "lcol", "table_name", "col_name"))


def first_owner(columns: DataFrame) -> DataFrame:
    """The first table, in catalog order, that holds each column name of a repository."""
    return _top1(columns.select("repo_url", "lcol", "table_name", "col_name", "file_id", "stmt_seq"),
                 ["lcol", "repo_url"], "file_id", "stmt_seq", "table_name")


def adopt_names(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """Names used by later stages, each with the table it means.

    Input: repo_url, table_ref, stage, file_id, stmt_seq, stmt_id. An unknown name becomes a new
    table, spelled as in its first use; names with the same last part mean the same new table.
    Output adds table_name and is_new; the row of a new table is the one with its own name.
    """
    at = ["stage", "file_id", "stmt_seq", "stmt_id"]
    first = refs.groupBy("table_ref", "repo_url").agg(F.min(F.struct(*at)).alias("at"))
    known = (first.join(resolve_table(first, tables), ["table_ref", "repo_url"], "left")
             .withColumn("lbase", X.last_part(F.lower("table_ref"))))
    new = (known.filter(F.col("table_name").isNull()).groupBy("lbase", "repo_url")
           .agg(F.min(F.struct("at", "table_ref")).alias("first")))
    return known.join(
        new.select("repo_url", "lbase", F.col("first.table_ref").alias("new_name")),
        ["lbase", "repo_url"], "left").select(
        "repo_url", "table_ref", F.coalesce("table_name", "new_name").alias("table_name"),
        F.col("table_name").isNull().alias("is_new"), "at.*")


def new_tables(names: DataFrame, stages=("alter", "insert")) -> DataFrame:
    return (names.filter(F.col("is_new") & (F.col("table_ref") == F.col("table_name"))
                         & F.col("stage").isin(*stages)).select(*_TABLE))


def first_mentions(rows: DataFrame) -> DataFrame:
    """The first mention of each column of each table name; repeats are dropped before the
    shuffle, so a table filled by very many statements costs little."""
    return (rows.withColumn("lcol", F.lower("col_name")).groupBy("lcol", "table_ref", "repo_url")
            .agg(F.min(F.struct("file_id", "stmt_seq", F.col("clause_seq").alias("ord"), "stmt_id",
                                "col_name", "col_type", "not_null")).alias("c"))
            .select("repo_url", "table_ref", "lcol", "c.*"))


_TABLE = ["repo_url", "table_name", "file_id", "stmt_seq", "stmt_id"]
_COLUMN = ["repo_url", "table_name", "col_name", "lcol", "col_type", "not_null", "origin",
           "file_id", "stmt_seq", "ord"]


def merge_columns(base: DataFrame, mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Columns of the created tables and, where they lack it, of later statements.

    One pick per (repo, table, column): created before altered before inserted, then the first.
    """
    later = mentions.join(names.select("repo_url", "table_ref", "table_name"), ["table_ref", "repo_url"])
    rows = base.unionByName(later.select(*_COLUMN))
    rank = F.when(F.col("origin") == "create", 0).when(F.col("origin") == "alter", 1).otherwise(2)
    return _top1(rows, ["lcol", "table_name", "repo_url"], rank, "file_id", "stmt_seq", "ord")


def ctas_columns(items: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of tables and views made by a select: named items, and stars expanded to the
    columns of their source table."""
    named = items.filter(~F.col("is_star")).select(
        "repo_url", "file_id", "stmt_seq", "stmt_id", "table_name", "item_seq",
        F.lit(0).alias("ord"), "col_name", F.lit(None).cast("string").alias("col_type"))
    stars = items.filter("is_star").withColumn("table_ref", F.col("star_source"))
    sources = resolve_table(stars, tables).withColumnRenamed("table_name", "source_table")
    source_columns = columns.select("repo_url", F.col("table_name").alias("source_table"),
                                    "ord", "col_name", "col_type")
    expanded = (stars.join(sources, ["table_ref", "repo_url"])
                .join(source_columns.withColumnRenamed("col_name", "star_col"),
                      ["source_table", "repo_url"])
                .select("repo_url", "file_id", "stmt_seq", "stmt_id", "table_name", "item_seq",
                        "ord", F.col("star_col").alias("col_name"), "col_type"))
    rows = named.unionByName(expanded).withColumn("lcol", F.lower("col_name"))
    return (rows.groupBy("stmt_id", "lcol", "repo_url", "file_id", "stmt_seq", "table_name")
            .agg(F.min(F.struct("item_seq", "ord", "col_name", "col_type")).alias("c"))
            .select("repo_url", "file_id", "stmt_seq", "stmt_id", "table_name", "lcol",
                    "c.item_seq", "c.ord", "c.col_name", "c.col_type"))


def _ctas_versions(ctas_cols: DataFrame, like: DataFrame) -> DataFrame:
    """Create-as-select statements as table versions; a statement bounds its column list."""
    cols = F.array_sort(F.collect_list(F.struct("item_seq", "ord", "col_name", "lcol", "col_type")))
    listed = (ctas_cols.groupBy("stmt_id", "repo_url", "file_id", "stmt_seq", "table_name")
              .agg(cols.alias("found")))
    struct = F.transform("found", lambda c, i: F.struct(
        i.alias("ord"), c["col_name"].alias("col_name"), c["lcol"].alias("lcol"),
        c["col_type"].alias("col_type"), F.lit(False).alias("not_null"),
        F.lit("as_select").alias("clause_kind")))
    schema = like.schema
    return (listed.withColumn("cols", struct).withColumn("lcols", F.col("found.lcol"))
            .withColumn("keys", F.array().cast(schema["keys"].dataType))
            .withColumn("fks", F.array().cast(schema["fks"].dataType))
            .withColumn("declared", F.array().cast(schema["declared"].dataType))
            .withColumn("lname", F.lower("table_name"))
            .withColumn("n_cols", F.size("found")).withColumn("n_keys", F.lit(0))
            .select(like.columns))


def _columns_of(picked: DataFrame, origin: str) -> DataFrame:
    return (picked.select("repo_url", "table_name", "file_id", "stmt_seq", F.inline("cols"))
            .withColumn("origin", F.lit(origin)).select(*_COLUMN))


# --- keys --------------------------------------------------------------------------------------

def checked_keys(keys: DataFrame, columns: DataFrame) -> DataFrame:
    """Keys with a table_name: `valid` tells whether every column exists, `cols` then holds the
    columns in declared order, spelled as defined."""
    parts = (keys.withColumn("n", F.size("cols"))
             .select("repo_url", "table_name", "stmt_id", "clause_seq", "key_type", "n",
                     "file_id", "stmt_seq", F.posexplode("cols").alias("pos", "written"))
             .withColumn("lcol", F.lower("written")))
    found = parts.join(columns.select("repo_url", "table_name", "lcol", "col_name"),
                       ["lcol", "table_name", "repo_url"], "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("col_name", "written").alias("name"))))
    return (found.groupBy("stmt_id", "clause_seq", "repo_url", "table_name", "key_type", "n",
                          "file_id", "stmt_seq")
            .agg(F.count("col_name").alias("n_found"), listed.alias("parts"))
            .select("repo_url", "table_name", "stmt_id", "clause_seq", "file_id", "stmt_seq",
                    "key_type", F.col("parts.name").alias("cols"),
                    (F.col("n_found") == F.col("n")).alias("valid")))


def valid_keys(keys: DataFrame, columns: DataFrame) -> DataFrame:
    return checked_keys(keys, columns).filter("valid").drop("valid")


def canonical_cols(keys: DataFrame, columns: DataFrame) -> DataFrame:
    """Valid keys with their columns spelled as defined, in declared order."""
    return valid_keys(keys, columns)


# --- foreign keys ------------------------------------------------------------------------------

def _single_pk(keys: DataFrame) -> DataFrame:
    """The one column of the only primary key of a table."""
    pks = (keys.filter("key_type = 'PrimaryKey'").groupBy("table_name", "repo_url")
           .agg(F.countDistinct("cols").alias("n"), F.min("cols").alias("cols")))
    return pks.filter((F.col("n") == 1) & (F.size("cols") == 1)).select(
        "repo_url", F.col("table_name").alias("ref_name"), F.col("cols").alias("pk_cols"))


def resolve_fks(fk_refs: DataFrame, tables: DataFrame, columns: DataFrame, keys: DataFrame,
                index: DataFrame | None = None) -> DataFrame:
    """Foreign keys against the whole catalog, equal ones once.

    Input: repo_url, stmt_id, clause_seq, file_id, stmt_seq, table_ref, cols, ref_table, ref_cols.
    Output adds table_name, ref_name and `resolved`; the columns are then spelled as defined.
    """
    same = ["table_ref", "ref_table", "cols", "ref_cols", "repo_url"]
    distinct = fk_refs.groupBy(*same).agg(
        F.min(F.struct("file_id", "stmt_seq", "stmt_id", "clause_seq")).alias("at"))
    refs = distinct.select(*same, F.concat_ws("#", "at.stmt_id", F.col("at.clause_seq").cast("string")).alias("fk_id"))
    both = refs.select("repo_url", "table_ref").unionByName(
        refs.select("repo_url", F.col("ref_table").alias("table_ref")))
    names = resolve_table(both, tables, index=index)
    owned = (refs.join(names, ["table_ref", "repo_url"], "left")
             .join(names.select("repo_url", F.col("table_ref").alias("ref_table"),
                                F.col("table_name").alias("ref_name")),
                   ["ref_table", "repo_url"], "left")
             .join(_single_pk(keys), ["ref_name", "repo_url"], "left")
             .withColumn("to_cols", F.coalesce("ref_cols", "pk_cols", F.array().cast("array<string>"))))
    ends = owned.withColumn("n", F.when(F.size("cols") == F.size("to_cols"), F.size("cols")).otherwise(-1))
    parts = ends.select(
        "repo_url", "fk_id", "n", F.posexplode(F.arrays_zip(F.col("cols").alias("own"), F.col("to_cols").alias("to")))
        .alias("pos", "pair"), "table_name", "ref_name")
    sides = parts.select("repo_url", "fk_id", "pos", F.inline(F.array(
        F.struct(F.lit("own").alias("side"), F.col("table_name").alias("table_name"), F.col("pair.own").alias("written")),
        F.struct(F.lit("to").alias("side"), F.col("ref_name").alias("table_name"),
                 F.col("pair.to").alias("written")))))
    found = (sides.withColumn("lcol", F.lower("written"))
             .join(columns.select("repo_url", "table_name", "lcol", "col_name"),
                   ["lcol", "table_name", "repo_url"]))

    def spelled(side):
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "col_name"))))

    done = found.groupBy("fk_id", "repo_url").agg(
        F.count("*").alias("n_found"), spelled("own").alias("own"), spelled("to").alias("to"))
    return (ends.join(done, ["fk_id", "repo_url"], "left")
            .withColumn("resolved", F.coalesce(F.col("n_found") == 2 * F.col("n"), F.lit(False)))
            .withColumn("cols", F.when(F.col("resolved"), F.col("own.col_name")).otherwise(F.col("cols")))
            .withColumn("ref_cols", F.when(F.col("resolved"), F.col("to.col_name")).otherwise(F.col("ref_cols")))
            .select("repo_url", "fk_id", "table_ref", "table_name", "cols", "ref_table", "ref_name",
                    "ref_cols", "resolved"))


def foreign_keys(fks: DataFrame) -> DataFrame:
    """Resolved foreign keys, one row per distinct (table, columns, target, columns)."""
    return (fks.filter("resolved")
            .select("repo_url", "table_name", "cols", "ref_name", "ref_cols").distinct())


def fk_unresolved(fks: DataFrame) -> DataFrame:
    return fks.filter("not resolved").select("repo_url", "table_ref", "cols", "ref_table", "ref_cols")


# --- the catalog -------------------------------------------------------------------------------

def with_base_type(columns: DataFrame) -> DataFrame:
    """Add the type family of a column; null for an unknown type. The lookup has 112 fixed rows."""
    types = columns.sparkSession.createDataFrame(base_type_rows(), "col_type string, base_type string")
    return columns.join(F.broadcast(types), "col_type", "left")


def finalize_catalog(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables that have columns; a repository without such a table disappears with them."""
    return tables.join(columns.select("repo_url", "table_name"), ["table_name", "repo_url"], "left_semi")


@dataclass
class Catalog:
    """Fact tables of a corpus. Each is a lazy DataFrame."""

    versions: DataFrame
    picked: DataFrame
    names: DataFrame
    all_tables: DataFrame
    lookup: DataFrame
    tables: DataFrame
    columns: DataFrame
    later_keys: DataFrame
    keys: DataFrame
    fks: DataFrame

    def columns_before_inserts(self) -> DataFrame:
        return self.columns.filter(F.col("origin") != "insert")

    def indexes(self) -> DataFrame:
        return self.keys.filter(F.col("key_type").isin("Index", "UniqueIndex")).withColumnRenamed(
            "key_type", "index_type")


_KEY = ["repo_url", "table_name", "stmt_id", "clause_seq", "file_id", "stmt_seq", "key_type", "cols"]
_FK = ["repo_url", "file_id", "stmt_seq", "stmt_id", "clause_seq", "table_ref", "cols", "ref_table",
       "ref_cols"]


@dataclass
class Names:
    """The tables of a corpus and what its statements declare, each of them a written table or a narrow read of one."""

    stmts: DataFrame
    created: DataFrame
    altered: DataFrame
    inserted: DataFrame
    versions: DataFrame
    picked: DataFrame
    names: DataFrame
    all_tables: DataFrame
    lookup: DataFrame


def build_names(stmts: DataFrame, stored: bool = False) -> Names:
    """The steps of the catalog up to its table names, for readers that need no columns. `stored` tells that the statements are
    a written table already."""
    stmts = stmts if stored else cut(stmts, "kind")
    untyped = [F.lit(None).cast("string").alias("col_type"), F.lit(False).alias("not_null")]
    created, items, altered, inserted = cut_all([
        table_versions(ddl.create_facts(stmts)), ddl.ctas_items(stmts), ddl.alter_facts(stmts),
        first_mentions(ddl.insert_columns(stmts).select("*", *untyped))])

    first_pick = pick_tables(created)
    ctas = ctas_columns(items, first_pick, _columns_of(first_pick, "create"))
    versions = created.unionByName(_ctas_versions(ctas, created))
    picked = cut(pick_tables(versions))
    base_tables = picked.select(*_TABLE)

    at = ["repo_url", "table_ref", "file_id", "stmt_seq", "stmt_id"]
    # A statement that only names a table still makes it known.
    heads = stmts.filter(F.col("kind") == "alter_table").withColumn(
        "table_ref", ddl.target_name(F.col("stmt"), "alter")).filter(F.col("table_ref").isNotNull())
    refs = heads.select(*at, F.lit("alter").alias("stage")).unionByName(
        inserted.select(*at, F.lit("insert").alias("stage")))
    names = cut(adopt_names(refs, base_tables))
    all_tables = base_tables.unionByName(new_tables(names))
    return Names(stmts, created, altered, inserted, versions, picked, names, all_tables, cut(lookup_index(all_tables)))


def build_columns(made: Names) -> DataFrame:
    """The columns of the catalog, for readers that need no keys."""
    mentions = first_mentions(ddl.alter_columns(made.altered)).withColumn("origin", F.lit("alter")).unionByName(
        made.inserted.withColumn("origin", F.lit("insert")))
    return cut(merge_columns(_columns_of(made.picked, "create"), mentions, made.names))


def build_catalog(stmts: DataFrame, stored: bool = False, made: Names | None = None, columns: DataFrame | None = None) -> Catalog:
    """Resolve DDL statements to a catalog.

    Stages see what earlier ones made: create, alter, insert; foreign keys see everything. Every
    step is written to the shared folder: the text is scanned once, each statement is parsed once,
    and the joins read small typed tables. `stored` tells that the statements are a written table already; `made` and
    `columns` are the results of build_names and build_columns on them, if they were built before.
    """
    made = build_names(stmts, stored) if made is None else made
    columns = build_columns(made) if columns is None else columns
    indexed, names = cut(ddl.create_index(made.stmts)), made.names
    base_tables = made.picked.select(*_TABLE)

    altered_keys = ddl.alter_keys(made.altered).join(
        names.select("repo_url", "table_ref", "table_name"), ["table_ref", "repo_url"])
    known = base_tables.unionByName(new_tables(names, ("alter",)))
    index_keys = indexed.join(resolve_table(indexed, known), ["table_ref", "repo_url"])
    later_keys = altered_keys.select(*_KEY).unionByName(index_keys.select(*_KEY))
    own_keys = (made.picked.select(*_TABLE, F.inline("keys"))
                .withColumn("clause_seq", F.col("seq")).select(*_KEY))
    before_inserts = columns.filter(F.col("origin") != "insert")
    keys = cut(own_keys.unionByName(valid_keys(later_keys, before_inserts).select(*_KEY)))

    own_fks = (made.created.select("repo_url", "file_id", "stmt_seq", "stmt_id",
                                   F.col("table_name").alias("table_ref"), F.inline("fks"))
               .withColumn("clause_seq", F.col("seq")).select(*_FK))
    fk_refs = own_fks.unionByName(ddl.alter_fk(made.altered).select(*_FK))
    fks, tables = cut_all([resolve_fks(fk_refs, made.all_tables, columns, keys, made.lookup),
                           finalize_catalog(made.all_tables, columns)])
    return Catalog(made.versions, made.picked, names, made.all_tables, made.lookup, tables, columns, later_keys, keys, fks)


# --- nearest names -----------------------------------------------------------------------------

NEAR = 2  # differences of length that are looked at first
BLOCK = 256  # names of one length that are compared in one step


def nearest_names(missing: DataFrame, tables: DataFrame, k: int = 3) -> DataFrame:
    """For each missing (repo_url, table_ref), the k nearest table names of the repository by edit distance, equal
    distances by name; fewer only if the repository has fewer tables.

    Names lie in blocks of one length and about BLOCK names, so that the names of a large repository are compared by many
    tasks; a block gives its k nearest. The difference of two lengths is a lower bound of the distance:
    names of similar length come first, and then only lengths that the k-th of them does not rule out.
    """
    asked = missing.select("repo_url", "table_ref").distinct().withColumn("n", F.length(F.lower("table_ref")))
    names = tables.select("repo_url", "table_name").distinct().withColumn("len", F.length(F.lower("table_name")))
    sizes = names.groupBy("len", "repo_url").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = names.join(sizes, ["len", "repo_url"]).withColumn("block", F.pmod(F.xxhash64("table_name"), "blocks").cast("int"))
    blocks = cut(dealt.groupBy("block", "len", "repo_url").agg(F.collect_list("table_name").alias("names")))
    asked, sizes = cut_all([asked, sizes])

    def best(pairs):
        """The k nearest of the blocks that each name (repo_url, table_ref) is held against: (len, blocks) of its repository."""
        each = pairs.select("repo_url", "table_ref", "len", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        near = F.transform("names", lambda t: F.struct(F.levenshtein(F.lower("table_ref"), F.lower(t)).alias("distance"), t.alias("table_name")))
        return each.join(blocks, ["block", "len", "repo_url"]).select(
            "repo_url", "table_ref", F.inline(F.slice(F.array_sort(near), 1, k)))

    def merged(rows):
        place = W.partitionBy("table_ref", "repo_url").orderBy("distance", "table_name")
        return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

    def lengths(rows, reach):
        return rows.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - reach), F.col("n") + reach)))

    close = cut(merged(best(lengths(asked, F.lit(NEAR)).join(sizes, ["len", "repo_url"]))))
    kth = close.filter(F.col("rank") == k).select("repo_url", "table_ref", F.col("distance").alias("kth"))
    rest = asked.join(kth, ["table_ref", "repo_url"], "left")
    bounded = lengths(rest.filter(F.col("kth") > NEAR), F.col("kth")).join(sizes, ["len", "repo_url"])
    unbounded = rest.filter("kth is null").join(sizes, "repo_url")
    far = F.abs(F.col("len") - F.col("n")) > NEAR
    cols = ["repo_url", "table_ref", "len", "blocks"]
    more = best(bounded.filter(far).select(*cols).unionByName(unbounded.filter(far).select(*cols)))
    return merged(close.drop("rank").unionByName(more))
