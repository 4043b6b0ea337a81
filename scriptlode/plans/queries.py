"""Registered queries over the derived script corpus: one or more per operator.

Every query returns flat columns (arrays joined by commas, integers as bigint), so that a SQL
engine can be compared with it.
"""

import itertools
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X
from ..operators import analytics as A, catalog as C, ddl as D, export as E
from ..operators import query_facts as QF, scopes as Q, statements as S, store as ST
from ..session import cut, shared_folder, tune
from ..sources import scripts as R
from ..sources.corpus import corpus

_BUILT: dict = {}


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(tune(spark), sf_dir)


def stmts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statements(scripts(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.create_facts(stmts(spark, sf_dir))


def _once(spark: SparkSession, sf_dir: str, what: str, build):
    """What `build` makes, made once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def _made(spark: SparkSession, sf_dir: str, what: str):
    return _BUILT.get((spark.sparkContext.applicationId, sf_dir, what))


def stored_stmts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL statements of the corpus, read from the scripts and written once."""
    return _once(spark, sf_dir, "statements", lambda: cut(stmts(spark, sf_dir), "kind"))


def catalog_names(spark: SparkSession, sf_dir: str) -> C.Names | C.Catalog:
    """Table names and lookup index of the catalog, without its columns and keys; the whole catalog if there is one already."""
    return _made(spark, sf_dir, "catalog") or _once(
        spark, sf_dir, "names", lambda: C.build_names(stored_stmts(spark, sf_dir), stored=True))


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the catalog, without its keys."""
    whole = _made(spark, sf_dir, "catalog")
    return whole.columns if whole else _once(spark, sf_dir, "columns", lambda: C.build_columns(catalog_names(spark, sf_dir)))


def catalog(spark: SparkSession, sf_dir: str) -> C.Catalog:
    """Catalog of the corpus, extracted and written once. It goes on from what is built of it already."""
    return _once(spark, sf_dir, "catalog", lambda: C.build_catalog(
        stored_stmts(spark, sf_dir), stored=True, made=catalog_names(spark, sf_dir), columns=catalog_columns(spark, sf_dir)))


def query_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _once(spark, sf_dir, "parts", lambda: QF.build_parts(S.query_statements(scripts(spark, sf_dir))))


def condition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the join conditions. They need no catalog."""
    whole = _made(spark, sf_dir, "queries")
    return whole.candidates.filter("kind = 'condition'") if whole else _once(
        spark, sf_dir, "condition candidates", lambda: QF.build_condition_candidates(query_parts(spark, sf_dir)[1]))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that were not resolved. They need the names and columns of the catalog and no other kind of mention."""
    whole = _made(spark, sf_dir, "queries")
    return whole.failures if whole else QF.resolution_failures(_once(spark, sf_dir, "conditions", lambda: QF.build_conditions(
        condition_candidates(spark, sf_dir), catalog_names(spark, sf_dir), catalog_columns(spark, sf_dir))).conditions)


def query_facts(spark: SparkSession, sf_dir: str) -> QF.QueryFacts:
    """Query facts of the corpus, extracted and written once. They go on from what is built of them already."""
    def build():
        parts = _made(spark, sf_dir, "parts")
        return QF.build_query_facts(None if parts else S.query_statements(scripts(spark, sf_dir)), catalog(spark, sf_dir),
                                    parts, _made(spark, sf_dir, "conditions"))

    return _once(spark, sf_dir, "queries", build)


def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.scopes(S.query_statements(scripts(spark, sf_dir)))


def scope_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.scope_parts(scope_rows(spark, sf_dir))


def _flat(df: DataFrame, *cols: str) -> DataFrame:
    """Named columns with lists as text and integers as bigint; a missing text becomes empty."""
    out = []
    for name in cols or df.columns:
        kind = df.schema[name].dataType
        c = F.col(name)
        if isinstance(kind, T.ArrayType):
            c = F.coalesce(F.concat_ws(",", c), F.lit(""))
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.StringType):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(name))
    return df.select(*out)


# --- sources -----------------------------------------------------------------------------------

def _folder(spark, what: str) -> str:
    return f"{shared_folder(tune(spark))}/{what}-{uuid.uuid4().hex}"


SHELVES = 256  # folders of script folders: each is written by one task and listed by one task


def _write_shelf(root: str):
    """Writes sorted rows (shelf, name, line) below a local folder: one file for each name, a line for each row. A file gets its
    name when it is whole, so another attempt at the same task puts the same file in its place."""
    def run(rows):
        for (shelf, name), group in itertools.groupby(rows, key=lambda r: (r.shelf, r.name)):
            folder = f"{root}/shelf={shelf}/name={name}"
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.writelines(bytes(r.line or b"") + b"\n" for r in group)
            os.replace(part, f"{folder}/part.txt")
    return run


def _write_scripts(rows: DataFrame, path: str) -> None:
    """One file for each name (shelf, name, line), in a folder of its own.

    On a local file system Spark's writer starts a process (chmod) for each folder, file and checksum that it makes, which takes longer
    than all the rest; there the tasks write the files themselves.
    """
    rows = rows.repartition("shelf")
    home = R.qualified(rows.sparkSession, path)
    if home.getScheme() == "file":
        rows.sortWithinPartitions("shelf", "name").foreachPartition(_write_shelf(home.getPath()))
    else:
        rows.select("shelf", "name", F.col("line").cast("string").alias("value")).write.partitionBy("shelf", "name").text(path)


def _script_files(spark, sf) -> DataFrame:
    """Scripts written as files, one folder for each, in two encodings, and read back: file_id and text."""
    name = F.substring_index("file_id", ".", 1)
    odd = name.cast("bigint") % 2 == 1
    line = F.concat("text", F.lit(" é"))
    coded = F.when(odd, F.encode(line, "ISO-8859-1")).otherwise(F.encode(line, "UTF-8"))
    path = _folder(spark, "scripts")
    rows = scripts(spark, sf).select(F.pmod(F.xxhash64(name), F.lit(SHELVES)).alias("shelf"), name.alias("name"), coded.alias("line"))
    _write_scripts(rows, path)
    read = R.read_scripts(spark, path, "*.txt")
    return read.select(F.concat(F.regexp_extract("file_id", "/name=([^/]+)/", 1), F.lit(".sql")).alias("file_id"),
                       F.substring("text", F.lit(1), F.length("text") - 1).alias("text"))  # the writer ends the line


def a1_script_decode(spark, sf):
    return _script_files(spark, sf)


def _manifest_lines(spark, sf) -> DataFrame:
    """Each file twice, again at another address, and once under the name of a file that was not scanned."""
    name = F.substring_index("file_id", ".", 1)
    again = F.concat("raw_url", F.lit("?again"))
    rows = scripts(spark, sf).select("repo_url", F.inline(F.array(*[
        F.struct(h.alias("hash"), u.alias("raw_url")) for h, u in (
            (name, F.col("raw_url")), (name, F.col("raw_url")), (name, again), (F.concat(name, F.lit("_gone")), F.col("raw_url")))])))
    return rows.select(F.concat_ws("\t", "hash", F.concat("repo_url", F.lit("/blob/main/"), "hash"),
                                   "raw_url").alias("value"))


def a2_manifest_files(spark, sf):
    """Manifest lines written to a file and read back, against the scripts that were read from files."""
    path = _folder(spark, "manifest")
    _manifest_lines(spark, sf).write.text(path)
    return R.manifest_files(R.read_manifest(spark, path), _script_files(spark, sf))


def a3_repo_grouping(spark, sf):
    rows = R.with_repo(R.parse_manifest(_manifest_lines(spark, sf)))
    return rows.filter("raw_url not like '%?again'").groupBy("repo_url", "user", "repo_name").agg(F.count("*").alias("n_lines"))


def a4_repo_limit(spark, sf):
    return R.limit_repos(scripts(spark, sf), 10).select("repo_url", "file_id")


def a4_first_users(spark, sf):
    return R.first_users(scripts(spark, sf), 10).select("user", "repo_url", "file_id")


def a4_repo_sample(spark, sf):
    return R.sample_repos(scripts(spark, sf), 25, "s").select("repo_url", "file_id")


def a4_repos_with_tables(spark, sf):
    return R.repos_with_tables(catalog(spark, sf).tables, 3)


def log_input(spark: SparkSession, sf: str) -> DataFrame:
    """Run-log lines derived from the orders table."""
    o = tune(spark).read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    a, b = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    line = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(
        F.lit("create table total: "), a, F.lit(", create table succ: "), b, F.lit(", create table except: 1")))
        .when(F.col("o_orderkey") % 4 == 1, F.lit("repo parse done"))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("query_succ: "), b, F.lit(", query_except: "), a))
        .otherwise(F.concat(F.lit("create: "), a, F.lit(".sql"))))
    return o.select(line.alias("value"))


def a5_log_lines(spark, sf):
    """Run-log lines written to files and read back."""
    path = _folder(spark, "log")
    log_input(spark, sf).write.text(path)
    return R.read_log(spark, path)


# --- statement shaping ---------------------------------------------------------------------------

def b1_ddl_statements(spark, sf):
    return _flat(S.ddl_statements(scripts(spark, sf)), "stmt_id", "stmt_seq", "stmt")


def b2_stage_filter(spark, sf):
    return _flat(S.stage_filter(S.ddl_statements(scripts(spark, sf))), "stmt_id", "stage")


def b3_size_guard(spark, sf):
    docs = tune(spark).read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("stmt"))
    kept = S.size_guard(docs).withColumn("guard", F.lit("ddl")).unionByName(
        S.size_guard(docs, query=True).withColumn("guard", F.lit("query")))
    return kept.select("guard", "doc_id", F.length("stmt").cast("bigint").alias("n_chars"))


def b4_normalize_text(spark, sf):
    return scripts(spark, sf).select("file_id", X.normalize_text(F.col("text")).alias("text"))


def b5_clean_statements(spark, sf):
    rows = S.stage_filter(S.ddl_statements(scripts(spark, sf)))
    return _flat(S.clean_statements(rows), "stmt_id", "stmt")


def b6_classify_stmt(spark, sf):
    return _flat(stmts(spark, sf), "stmt_id", "kind")


def b7_query_statements(spark, sf):
    return _flat(S.query_statements(scripts(spark, sf)), "stmt_id", "stmt")


def b7_join_statements(spark, sf):
    return _flat(S.query_statements(scripts(spark, sf), join_only=True), "stmt_id", "stmt")


def b8_strip_hints(spark, sf):
    return S.query_statements(scripts(spark, sf)).select("stmt_id", X.strip_hints(F.col("stmt")).alias("stmt"))


def b9_join_like(spark, sf):
    return _flat(S.join_like(scripts(spark, sf)), "file_id", "block_seq", "join_like")


def b10_clean_identifiers(spark, sf):
    part = tune(spark).read.parquet(f"{sf}/part.parquet")
    name = F.concat(F.lit('"App" . `'), "p_brand", F.lit("` DESC"))
    typ = F.concat(F.lit("[VarChar]("), F.col("p_size").cast("string"), F.lit(")"))
    cast = F.concat(F.lit("'1'::"), F.upper("p_type"))
    return part.select(
        "p_partkey", X.clean_ident(name).alias("ident"), X.norm_type(typ).alias("type_base"),
        X.norm_type(cast).alias("cast_type"), X.after_kw(F.concat(F.lit("x AS "), "p_name"), " as ").alias("after"),
        X.before_kw(F.concat("p_name", F.lit(" VALUES (1)")), " values").alias("before"),
        X.clean_table(F.concat(F.lit("dbo.[#"), "p_brand", F.lit("]"))).alias("table_name"))


def b11_to_snake(spark, sf):
    part = tune(spark).read.parquet(f"{sf}/part.parquet")
    camel = F.concat(F.lit("part"), F.initcap("p_type"), F.lit("HTTPCode2X_"), "p_brand")
    return part.select("p_partkey", X.to_snake(camel).alias("snake"))


# --- DDL facts -----------------------------------------------------------------------------------

def c1_table_headers(spark, sf):
    return _flat(D.table_headers(stmts(spark, sf)), "stmt_id", "table_name")


def c2_clauses(spark, sf):
    return _flat(D.clauses(stmts(spark, sf)), "stmt_id", "clause_seq", "clause")


def c3_clause_kinds(spark, sf):
    return _flat(D.classify_clause(D.clauses(stmts(spark, sf))), "stmt_id", "clause_seq", "clause_kind")


def c4_column_defs(spark, sf):
    return _flat(D.column_defs(facts(spark, sf)), "stmt_id", "table_name", "ord", "col_name", "lcol", "col_type")


def c5_not_null(spark, sf):
    return _flat(D.column_defs(facts(spark, sf)), "stmt_id", "col_name", "not_null")


def _keys(df):
    return _flat(df, "stmt_id", "table_name", "seq", "clause_kind", "key_type", "cols")


def c6_inline_pk(spark, sf):
    return _keys(D.inline_pk(facts(spark, sf)))


def c7_table_pk(spark, sf):
    return _keys(D.table_pk(facts(spark, sf)))


def _raw_fks(df):
    return _flat(df, "stmt_id", "table_name", "seq", "cols", "ref_table", "ref_cols")


def c8_constraint_fk(spark, sf):
    return _raw_fks(D.constraint_fk(facts(spark, sf)))


def c9_fk_clause(spark, sf):
    return _raw_fks(D.fk_clause(facts(spark, sf)))


def c10_column_fk(spark, sf):
    return _raw_fks(D.column_fk(facts(spark, sf)))


def c11_inline_pk_fk(spark, sf):
    return _raw_fks(D.inline_pk_fk(facts(spark, sf)))


def c12_unique_keys(spark, sf):
    return _keys(D.unique_keys(facts(spark, sf)))


def c13_candidate_keys(spark, sf):
    return _keys(D.candidate_keys(facts(spark, sf)))


def c14_indexes(spark, sf):
    return _flat(D.indexes(facts(spark, sf)), "stmt_id", "table_name", "seq", "index_type", "cols")


def c15_ctas_columns(spark, sf):
    made = C.pick_tables(C.table_versions(facts(spark, sf)))
    rows = C.ctas_columns(D.ctas_items(stmts(spark, sf)), made, C._columns_of(made, "create"))
    return _flat(rows, "stmt_id", "table_name", "lcol", "col_name", "col_type")


def _alter(spark, sf):
    return D.alter_facts(stmts(spark, sf))


_ALTER_KEY = ("stmt_id", "clause_seq", "table_ref", "key_type", "cols")


def c16_alter_pk(spark, sf):
    return _flat(D.alter_pk(_alter(spark, sf)), *_ALTER_KEY)


def c17_alter_fk(spark, sf):
    return _flat(D.alter_fk(_alter(spark, sf)), "stmt_id", "clause_seq", "table_ref", "cols", "ref_table", "ref_cols")


def c18_alter_unique(spark, sf):
    return _flat(D.alter_unique(_alter(spark, sf)), *_ALTER_KEY)


def c19_alter_key(spark, sf):
    return _flat(D.alter_key(_alter(spark, sf)), *_ALTER_KEY)


def c20_alter_columns(spark, sf):
    return _flat(catalog(spark, sf).columns.filter("origin = 'alter'"), "repo_url", "table_name", "lcol", "col_name", "col_type",
                 "file_id", "stmt_seq", "ord")


def c21_alter_clauses(spark, sf):
    return _flat(D.alter_clauses(stmts(spark, sf)), "stmt_id", "clause_seq", "table_ref", "clause")


def c21_later_tables(spark, sf):
    """Tables that only alter or insert statements name."""
    c = catalog(spark, sf)
    later = c.all_tables.join(c.picked.select("repo_url", "table_name"), ["repo_url", "table_name"], "left_anti")
    return _flat(later, "repo_url", "table_name", "file_id", "stmt_seq")


def c22_create_index(spark, sf):
    return _flat(D.create_index(stmts(spark, sf)), "stmt_id", "table_ref", "key_type", "cols")


def c23_insert_columns(spark, sf):
    return _flat(catalog(spark, sf).columns.filter("origin = 'insert'"), "repo_url", "table_name", "lcol", "col_name",
                 "file_id", "stmt_seq", "ord")


# --- catalog resolution --------------------------------------------------------------------------

def d1_pick_tables(spark, sf):
    return _flat(catalog(spark, sf).picked, "repo_url", "table_name", "stmt_id", "n_cols", "n_keys")


def _dropped(spark, sf):
    c = catalog(spark, sf)
    return C.dropped_versions(c.versions, c.picked)


def d2_dropped_versions(spark, sf):
    return _flat(_dropped(spark, sf), "repo_url", "table_name", "stmt_id", "n_cols", "n_keys",
                 "saved_stmt_id", "saved_n_cols", "saved_n_keys")


def d3_lost_columns(spark, sf):
    return _flat(C.lost_columns(_dropped(spark, sf)), "repo_url", "table_name", "stmt_id", "n_lost")


def _fk_targets(spark, sf):
    return D.raw_fks(D.create_facts(stored_stmts(spark, sf))).select("repo_url", F.col("ref_table").alias("table_ref"))


def d4_resolve_table(spark, sf):
    c = catalog(spark, sf)
    return _flat(C.resolve_table(_fk_targets(spark, sf), c.all_tables, index=c.lookup))


def d5_key_validity(spark, sf):
    c = catalog(spark, sf)
    return _flat(C.checked_keys(c.later_keys, c.columns_before_inserts()), "stmt_id", "clause_seq", "table_name", "key_type", "valid")


def d6_canonical_cols(spark, sf):
    return _flat(catalog(spark, sf).keys, "repo_url", "table_name", "stmt_id", "clause_seq", "key_type", "cols")


def d7_foreign_keys(spark, sf):
    return _flat(C.foreign_keys(catalog(spark, sf).fks))


def d7_fk_unresolved(spark, sf):
    return _flat(C.fk_unresolved(catalog(spark, sf).fks))


def d8_final_tables(spark, sf):
    return _flat(catalog(spark, sf).tables, "repo_url", "table_name", "file_id", "stmt_seq")


def d9_base_types(spark, sf):
    return (C.with_base_type(catalog(spark, sf).columns)
            .groupBy(F.coalesce("base_type", F.lit("")).alias("base_type")).agg(F.count("*").alias("n")))


def d10_name_variants(spark, sf):
    c = catalog_names(spark, sf)
    low = "T"
    forms = F.array(F.concat(F.lit("[dbo].["), low, F.lit("]")), F.concat(F.lit("#"), low),
                    F.concat(F.lit("@"), low), F.concat(F.lit("public."), low), F.concat(F.lit("mydb."), "TU"),
                    F.concat(F.lit("["), low, F.lit("]")))
    refs = corpus(tune(spark), sf, ("T", "TU")).select("repo_url", F.explode(forms).alias("table_ref"))
    refs = refs.withColumn("table_ref", X.clean_ident(F.col("table_ref")))
    return _flat(C.resolve_table_variants(refs, c.all_tables, c.lookup))


def d11_resolve_column(spark, sf):
    c = catalog(spark, sf)
    refs = corpus(tune(spark), sf, ("TU", "V")).select("repo_url", F.explode(F.array("TU", "V")).alias("table_ref"))
    names = F.array(*[F.lit(n) for n in ("username", "id", "memo", "extra", "absent")])
    return _flat(C.resolve_column(refs.withColumn("lcol", F.explode(names)), c.all_tables, c.columns, index=c.lookup))


def d12_nearest_names(spark, sf):
    missing = QF.unfound_tables(failures(spark, sf))
    return _flat(C.nearest_names(missing, catalog(spark, sf).tables, 3))


def d13_first_owner(spark, sf):
    return _flat(C.first_owner(catalog(spark, sf).columns))


# --- query facts ---------------------------------------------------------------------------------

def e1_scopes(spark, sf):
    rows = scope_rows(spark, sf).withColumn("parent_lo", F.coalesce("parent_lo", F.lit(-1)))
    return _flat(rows, "stmt_id", "lo", "hi", "parent_lo", "depth", "own_text")


def e2_scope_tables(spark, sf):
    rows = Q.scope_tables(scope_parts(spark, sf)).withColumn("child", F.coalesce("child", F.lit(-1)))
    return _flat(rows, "stmt_id", "lo", "t_pos", "alias", "table_ref", "child")


def e3_join_type(spark, sf):
    return _flat(Q.scope_join_type(scope_rows(spark, sf)), "stmt_id", "lo", "join_type")


def _atoms(spark, sf):
    return Q.comparisons(scope_parts(spark, sf))


def e4_comparisons(spark, sf):
    return _flat(_atoms(spark, sf), "stmt_id", "lo", "atom_seq", "atom")


def e5_join_candidates(spark, sf):
    return _flat(Q.join_candidates(_atoms(spark, sf)), "stmt_id", "lo", "atom_seq", "atom")


def e6_operator_names(spark, sf):
    return _flat(Q.norm_op(_atoms(spark, sf)), "stmt_id", "lo", "atom_seq", "op_name")


def e7_side_resolution(spark, sf):
    found = condition_candidates(spark, sf).filter("kind = 'condition' and table_ref <> '*'")
    return _flat(found.select("stmt_id", "lo", F.col("seq").alias("atom_seq"), "side",
                              F.lower("table_ref").alias("table_ref"), "lcol"))


def e8_limit_conditions(spark, sf):
    return _flat(QF.limit_conditions(scope_parts(spark, sf)), "stmt_id", "lo", "atom_seq", "atom")


_COND = ("stmt_id", "lo", "atom_seq", "op", "l_table", "l_col", "r_table", "r_col")


def e9_derived_joins(spark, sf):
    return _flat(QF.derived_joins(query_facts(spark, sf).conditions), *_COND)


def e10_binary_joins(spark, sf):
    rows = query_facts(spark, sf).binary_joins.withColumn("conditions", F.transform(
        "conditions", lambda c: F.concat_ws(" ", c["l"], c["op"], c["r"])))
    return _flat(rows, "stmt_id", "lo", "l_table", "r_table", "join_type", "conditions")


def e11_failures(spark, sf):
    return _flat(failures(spark, sf), "stmt_id", "lo", "condition", "side", "reason", "name")


def e11_unfound_tables(spark, sf):
    return QF.unfound_tables(failures(spark, sf))


_FACT = ("stmt_id", "table_name", "col_name")


def e12_projections(spark, sf):
    return _flat(QF.projections(query_facts(spark, sf).refs), *_FACT)


def e13_selections(spark, sf):
    return _flat(QF.selections(query_facts(spark, sf).refs), *_FACT)


def e14_aggregates(spark, sf):
    return _flat(QF.aggregates(query_facts(spark, sf).refs), "stmt_id", "func", "table_name", "col_name")


def e15_groupbys(spark, sf):
    return _flat(QF.groupbys(query_facts(spark, sf).refs), *_FACT)


def e16_queries(spark, sf):
    return _flat(query_facts(spark, sf).queries, "stmt_id", "n_joins", "n_conditions", "has_projection",
                 "has_aggregate", "has_selection", "has_groupby")


def e17_union_flag(spark, sf):
    return Q.is_union(S.query_statements(scripts(spark, sf))).select("stmt_id", "is_union")


def e18_inner_selects(spark, sf):
    """Facts reach the innermost select of any statement: columns projected by nested scopes."""
    rows = scope_parts(spark, sf).filter("depth > 0").select("stmt_id", "lo", F.inline_outer("select_items"))
    return _flat(rows.filter("expr is not null"), "stmt_id", "lo", "expr", "out", "func")


# --- analytics -----------------------------------------------------------------------------------

def f1_corpus_stats(spark, sf):
    return A.corpus_stats(catalog(spark, sf), query_facts(spark, sf))


def f2_type_frequency(spark, sf):
    return A.type_frequency(catalog(spark, sf).columns)


def f3_missing_in_user(spark, sf):
    return A.missing_in_user(failures(spark, sf), catalog(spark, sf).tables)


def f4_failure_counts(spark, sf):
    return A.failure_counts(failures(spark, sf))


def f5_failure_sample(spark, sf):
    rows = A.failure_sample(failures(spark, sf), 60, 25, "s")
    return _flat(rows, "repo_url", "stmt_id", "lo", "condition", "reason")


def f6_table_sample(spark, sf):
    return A.table_sample(catalog(spark, sf).tables, 20, 3, "s")


def f7_fk_join_overlap(spark, sf):
    c = catalog(spark, sf)
    return A.fk_join_overlap(C.foreign_keys(c.fks), query_facts(spark, sf).binary_joins)


def _signatures(spark, sf):
    c = catalog(spark, sf)
    return A.table_signatures(c.tables, c.columns)


def f8_dup_clusters(spark, sf):
    return A.dup_clusters(_signatures(spark, sf))


def f8_keep_first(spark, sf):
    return A.keep_first(_signatures(spark, sf))


def labels(spark, sf) -> DataFrame:
    c = catalog(spark, sf)
    return E.label_rows(c.tables, c.columns, c.keys)


def _constraints(spark, sf):
    return A.table_constraints(labels(spark, sf))


def f9_filter_tables(spark, sf):
    return A.filter_tables(_constraints(spark, sf), True, 0.5)


def f10_training_stats(spark, sf):
    return A.training_stats(catalog(spark, sf).all_tables, _constraints(spark, sf), _signatures(spark, sf), True, 0.5)


def f11_log_coverage(spark, sf):
    return A.log_coverage(log_input(spark, sf))


def f11_log_totals(spark, sf):
    return A.log_totals(log_input(spark, sf))


def f12_extraction_counts(spark, sf):
    q = query_facts(spark, sf)
    rows = A.statement_outcomes(stored_stmts(spark, sf)).select("kind", "ok").unionByName(
        A.query_outcomes(q.statements, q.queries).select("kind", "ok"))
    return A.extraction_counts(rows)


# --- exports -------------------------------------------------------------------------------------

def g1_label_rows(spark, sf):
    return labels(spark, sf).select("repo_url", "file", "table", "column", "label")


def g2_training_csv(spark, sf):
    """Write the training files and read the rows back."""
    path = _folder(spark, "training")
    E.write_training(labels(spark, sf), A.dup_clusters(_signatures(spark, sf)), path, "s")
    rows = spark.read.schema("file string, `table` string, `column` string, label string").csv(f"{path}/rows")
    return _flat(rows)


def g3_catalog_folder(spark, sf):
    """Write two batches of the columns table, and read the merged folder."""
    path = _folder(spark, "catalog")
    cols = catalog(spark, sf).columns
    first = F.col("origin") == "create"
    E.write_catalog({"columns": cols.filter(first)}, path, 4, mode="overwrite")
    E.write_catalog({"columns": cols.filter(~first)}, path, 4)
    return _flat(E.read_catalog(spark, path, "columns"), "repo_url", "table_name", "col_name", "col_type", "origin")


def _part_of(facts, batch: int):
    """The facts of every second repository."""
    mine = F.pmod(F.xxhash64("repo_url"), F.lit(2)) == batch
    return type(facts)(**{name: df.filter(mine) for name, df in vars(facts).items()})


def g3_reloaded_stats(spark, sf):
    """Corpus counters over stored facts: two batches are written, the first one twice, and loaded."""
    c, q = catalog(spark, sf), query_facts(spark, sf)
    path = _folder(spark, "facts")
    for batch in (0, 1, 0):
        ST.write_batch(spark, path, str(batch), _part_of(c, batch), _part_of(q, batch))
    return A.corpus_stats(ST.load_catalog(spark, path), ST.load_query_facts(spark, path))


def _listed(items, form) -> Column:
    return F.coalesce(F.array_join(F.array_sort(F.transform(items, form)), ";"), F.lit(""))


def g4_table_view(spark, sf):
    c = catalog(spark, sf)
    view = E.table_view(c.tables, c.columns, c.keys, C.foreign_keys(c.fks))
    return view.select(
        "repo_url", "table_name",
        _listed("cols", lambda c: F.concat_ws(" ", c["col_name"], F.coalesce(c["col_type"], F.lit("")), c["not_null"].cast("string"))).alias("cols"),
        _listed("keys", lambda k: F.concat(k["key_type"], F.lit("("), F.array_join(k["cols"], ","), F.lit(")"))).alias("keys"),
        _listed("fks", lambda k: F.concat(F.array_join(k["cols"], ","), F.lit(">"), k["ref_name"], F.lit("("),
                                          F.array_join(k["ref_cols"], ","), F.lit(")"))).alias("fks"))


def g4_query_view(spark, sf):
    q = query_facts(spark, sf)
    view = E.query_view(q.queries, q.binary_joins, q.refs)
    conds = lambda j: F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(
        j["conditions"], lambda c: F.concat_ws(" ", c["l"], c["op"], c["r"]))), ","), F.lit("]"))
    return view.select(
        "stmt_id",
        _listed("joins", lambda j: F.concat_ws(" ", j["lo"].cast("string"), j["l_table"], j["join_type"], j["r_table"], conds(j))).alias("joins"),
        _listed("refs", lambda r: F.concat_ws(" ", r["kind"], r["func"], F.concat_ws(".", r["table_name"], r["col_name"]))).alias("refs"))


def all_queries() -> dict:
    import re
    return {n: f for n, f in globals().items() if callable(f) and re.match(r"^[a-g]\d+_", n)}
