"""Corpus statistics. Counts are combined before each shuffle; picks of one row per group are cut
before the shuffle; no group is collected."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import text as X
from ..session import cut
from .catalog import Catalog
from .query_facts import QueryFacts


def _count_if(cond) -> Column:
    return F.count_if(cond).cast("bigint")


def _counters(*parts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Sums over several tables as (metric, value) rows, in one aggregate: the rows of all tables meet with a value for
    each of their own metrics, and are summed before the shuffle."""
    names = [n for _, metrics in parts for n in metrics]
    rows = reduce(DataFrame.unionByName, [
        df.select(*[(metrics[n].cast("bigint") if n in metrics else F.lit(0).cast("bigint")).alias(n) for n in names])
        for df, metrics in parts])
    total = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return total.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def corpus_stats(catalog: Catalog, facts: QueryFacts) -> DataFrame:
    """Corpus counters, one row per metric; each fact table is scanned once."""
    repos = catalog.tables.select("repo_url").union(facts.queries.select("repo_url")).distinct()
    kt = F.col("key_type")
    each = F.lit(1)
    links = catalog.fks.filter("resolved").groupBy(
        F.md5(F.to_json(F.struct("repo_url", "table_name", "cols", "ref_name", "ref_cols")))).agg(F.lit(1).alias("one"))
    return _counters(
        (repos, {"nonempty_repos": each}),
        (catalog.all_tables, {"tables": each}),
        (catalog.tables, {"nonempty_tables": each}),
        (catalog.columns, {"columns": each, "typed_columns": F.col("col_type").isNotNull()}),
        (catalog.keys, {"primary_keys": kt == "PrimaryKey", "candidate_keys": kt == "CandidateKey",
                        "unique_constraints": kt.contains("Unique"), "indexes": kt.isin("Index", "UniqueIndex")}),
        (links, {"foreign_keys": each}),
        (facts.queries, {"queries": each, "binary_joins": F.col("n_joins"), "conditions": F.col("n_conditions"),
                         **{f"queries_with_{k}": F.col(f"has_{k}") for k in ("projection", "aggregate", "selection", "groupby")}}))


def type_frequency(columns: DataFrame) -> DataFrame:
    """Columns per type, untyped ones under None, most frequent first."""
    return (columns.groupBy(F.coalesce("col_type", F.lit("None")).alias("col_type"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "col_type"))


def _with_user(df: DataFrame) -> DataFrame:
    return df.withColumn("user", F.try_element_at(F.split("repo_url", "/"), F.lit(-2)))


def missing_in_user(failures: DataFrame, tables: DataFrame) -> DataFrame:
    """Mentions of unknown tables and how many name a table of another repository of the user."""
    asked = (failures.filter("reason = 'table' and name is not null")
             .groupBy("repo_url", F.lower("name").alias("lname")).agg(F.count("*").alias("n")))
    names = tables.select("repo_url", F.lower("table_name").alias("lname")).distinct()
    absent = _with_user(asked.join(names, ["lname", "repo_url"], "left_anti"))
    elsewhere = _with_user(names).select("user", "lname").distinct()
    hits = absent.join(elsewhere, ["user", "lname"], "left_semi")
    zero = F.lit(0).cast("bigint")
    counts = asked.select(F.col("n").alias("total"), zero.alias("found")).unionByName(
        hits.select(zero.alias("total"), F.col("n").alias("found"))).agg(
        F.coalesce(F.sum("total"), zero).alias("total"), F.coalesce(F.sum("found"), zero).alias("found"))
    return counts.select("total", "found", F.try_divide(F.col("found"), F.col("total")).alias("share"))


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.agg(F.count("*").alias("total"), _count_if(F.col("reason") == "table").alias("table_failed"),
                        _count_if(F.col("reason") == "column").alias("column_failed"))


def _seeded(*cols, seed: str) -> Column:
    return F.md5(F.concat_ws("|", *cols, F.lit(seed)))


def failure_sample(failures: DataFrame, n_repos: int = 600, per_reason: int = 100, seed: str = "") -> DataFrame:
    """One failure of each of n_repos repositories, at most per_reason of each reason."""
    order = _seeded("stmt_id", F.col("lo").cast("string"), "condition", seed=seed)
    one = W.partitionBy("repo_url").orderBy(order, "stmt_id", "lo", "condition")
    picked = (failures.withColumn("_rn", F.row_number().over(one)).filter("_rn = 1").drop("_rn")
              .withColumn("_o", _seeded("repo_url", seed=seed)).orderBy("_o", "repo_url").limit(n_repos))
    rank = F.row_number().over(W.partitionBy("reason").orderBy("_o", "repo_url"))
    return picked.withColumn("_rn", rank).filter(F.col("_rn") <= per_reason).drop("_rn", "_o")


def table_sample(tables: DataFrame, n_repos: int = 100, at_least: int = 3, seed: str = "") -> DataFrame:
    """One table of each of n_repos repositories that have enough tables."""
    repos = (tables.groupBy("repo_url").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
             .orderBy(_seeded("repo_url", seed=seed), "repo_url").limit(n_repos).select("repo_url"))
    one = W.partitionBy("repo_url").orderBy(_seeded("repo_url", "table_name", seed=seed), "table_name")
    return (tables.join(repos, "repo_url", "left_semi")
            .withColumn("_rn", F.row_number().over(one)).filter("_rn = 1").drop("_rn")
            .select("repo_url", "table_name", "file_id"))


def _column_pairs(df: DataFrame, l_table, l_col, r_table, r_col) -> DataFrame:
    a = F.concat_ws(".", F.lower(l_table), F.lower(l_col))
    b = F.concat_ws(".", F.lower(r_table), F.lower(r_col))
    return df.select("repo_url", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def fk_join_overlap(foreign_keys: DataFrame, joins: DataFrame) -> DataFrame:
    """Column pairs declared as foreign keys, observed as equality joins, and both."""
    fk_rows = foreign_keys.select("repo_url", "table_name", "ref_name",
                                  F.explode(F.arrays_zip("cols", "ref_cols")).alias("p"))
    fk = _column_pairs(fk_rows, "table_name", "p.cols", "ref_name", "p.ref_cols").withColumn("fk", F.lit(True))
    join_rows = joins.select("repo_url", "l_table", "r_table", F.explode("conditions").alias("c")).filter("c.op = 'Eq'")
    jn = _column_pairs(join_rows, "l_table", "c.l", "r_table", "c.r").withColumn("jn", F.lit(True))
    both = fk.join(jn, ["repo_url", "a", "b"], "full")
    counts = both.agg(F.count("fk").alias("fk_pairs"), F.count("jn").alias("join_pairs"),
                      _count_if(F.col("fk") & F.col("jn")).alias("both"))
    return counts.select("*", F.try_divide("both", "fk_pairs").alias("share_of_fk"),
                         F.try_divide("both", "join_pairs").alias("share_of_join"))


def table_signatures(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with the key under which equal tables cluster: name and sorted column names."""
    names = F.array_join(F.array_sort(F.collect_list("col_name")), "___")
    keys = columns.groupBy("table_name", "repo_url").agg(names.alias("names"))
    return (tables.select("repo_url", "table_name", "file_id").join(keys, ["table_name", "repo_url"])
            .select("repo_url", "table_name", "file_id",
                    F.concat("table_name", F.lit(":"), "names").alias("cluster_key")))


def dup_clusters(signatures: DataFrame) -> DataFrame:
    """Clusters of equal tables with their size, largest first."""
    return (signatures.groupBy("cluster_key").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "cluster_key"))


def keep_first(signatures: DataFrame) -> DataFrame:
    """The first table of each cluster; losers are cut before the shuffle."""
    one = W.partitionBy("cluster_key").orderBy("repo_url", "file_id", "table_name")
    return signatures.withColumn("_rn", F.row_number().over(one)).filter("_rn = 1").drop("_rn")


def table_constraints(labels: DataFrame) -> DataFrame:
    """Label counts per table and the share of its columns that cannot be null."""
    label = F.col("label")
    return (labels.groupBy("table_name", "repo_url").agg(
        F.count("*").alias("n_cols"), _count_if(label == "[UNIQUE]").alias("n_unique"),
        _count_if(label == "[NOTNULL]").alias("n_notnull"), _count_if(label == "").alias("n_none"),
        _count_if(F.col("not_null_col")).alias("n_not_null_cols"))
        .withColumn("notnull_share", F.col("n_not_null_cols") / F.col("n_cols")))


def filter_tables(constraints: DataFrame, skip_no_constraint: bool = True,
                  max_notnull_share: float = 1.0) -> DataFrame:
    """Tables kept for training: some constraint, and not too many not-null columns."""
    keep = F.col("notnull_share") <= max_notnull_share
    if skip_no_constraint:
        keep = keep & (F.col("n_none") < F.col("n_cols"))
    return constraints.filter(keep)


def training_stats(all_tables: DataFrame, constraints: DataFrame, signatures: DataFrame,
                   skip_no_constraint: bool = True, max_notnull_share: float = 1.0,
                   dedup: bool = True) -> DataFrame:
    """Counters of the training export: tables in, skipped, duplicate, out, and labels out."""
    constraints = cut(constraints)
    bare = F.col("n_none") == F.col("n_cols")
    high = F.col("notnull_share") > max_notnull_share
    no_constraint = bare if skip_no_constraint else F.lit(False)
    kept = filter_tables(constraints, skip_no_constraint, max_notnull_share)
    kept_keys = signatures.join(kept, ["table_name", "repo_url"])
    turn = F.row_number().over(W.partitionBy("cluster_key").orderBy("repo_url", "file_id", "table_name")) if dedup else F.lit(1)
    first = F.col("turn") == 1
    of_first = lambda n: F.when(first, F.col(n)).otherwise(0)
    # Of a large cluster each table but one only counts as a duplicate: those rows are narrow.
    ranked = kept_keys.select(F.md5("cluster_key").alias("cluster_key"), "repo_url", "file_id", "table_name",
                              "n_unique", "n_notnull", "n_none").withColumn("turn", turn)
    return _counters(
        (all_tables, {"input_tables": F.lit(1)}),
        (constraints, {"skipped_no_constraint": no_constraint, "skipped_high_notnull": high & ~no_constraint}),
        (ranked, {"duplicate_tables": ~first, "output_tables": first, "unique_columns": of_first("n_unique"),
                  "notnull_columns": of_first("n_notnull"), "none_columns": of_first("n_none")}))


def log_coverage(lines: DataFrame) -> DataFrame:
    """Success share of each progress line that reports successes and exceptions."""
    pattern = r"query_succ:\s(\d+),\squery_except:\s(\d+)"
    rows = lines.filter(F.col("value").rlike(pattern)).select(
        "value", F.regexp_extract("value", pattern, 1).try_cast("bigint").alias("succ"),
        F.regexp_extract("value", pattern, 2).try_cast("bigint").alias("failed"))
    return (rows.filter(F.col("succ") + F.col("failed") > 0)
            .withColumn("coverage", F.col("succ") / (F.col("succ") + F.col("failed"))))


def log_totals(lines: DataFrame) -> DataFrame:
    """Totals of create-table lines with three numbers, and finished repositories."""
    numbers = F.regexp_extract_all("value", F.lit(r"(\d+)"), F.lit(1))
    counted = F.col("value").contains("create table succ") & (F.size(numbers) == 3)
    pick = lambda i: F.sum(F.when(counted, F.get(numbers, F.lit(i)).try_cast("bigint")))
    done = F.col("value").contains("repo parse done") & ~F.col("value").contains("create table succ")
    return lines.agg(
        F.coalesce(pick(0), F.lit(0)).alias("total"), F.coalesce(pick(1), F.lit(0)).alias("succ"),
        F.coalesce(pick(2), F.lit(0)).alias("failed"), _count_if(done).alias("repos")).withColumn(
        "coverage", F.try_divide("succ", "total"))


def extraction_counts(statement_rows: DataFrame) -> DataFrame:
    """Statements per kind and status; the input has one row per statement with kind and ok."""
    status = F.when(F.col("ok"), "ok").otherwise("failed")
    return statement_rows.groupBy("kind", status.alias("status")).agg(F.count("*").alias("n"))


def statement_outcomes(stmts: DataFrame) -> DataFrame:
    """DDL statements with ok: whether a table name, and where it applies a column list, was found."""
    from . import ddl
    kind, stmt = F.col("kind"), F.col("stmt")
    target = (F.when(kind == "create_table", ddl.target_name(stmt, "create") .isNotNull() & stmt.contains("("))
              .when(kind == "create_as_select", ddl.target_name(stmt, "ctas").isNotNull())
              .when(kind == "alter_table", ddl.target_name(stmt, "alter").isNotNull())
              .when(kind.isin("create_index", "create_unique_index"), ddl.target_name(stmt, "index").isNotNull())
              .when(kind == "insert", ddl.target_name(X.before_kw(stmt, "values"), "insert").isNotNull())
              .otherwise(False))
    return stmts.withColumn("ok", F.coalesce(target, F.lit(False)))


def query_outcomes(query_stmts: DataFrame, queries: DataFrame) -> DataFrame:
    """Query statements with ok: whether any fact was found."""
    kept = queries.select("stmt_id").withColumn("ok", F.lit(True))
    return (query_stmts.join(kept, "stmt_id", "left").withColumn("kind", F.lit("query"))
            .withColumn("ok", F.coalesce("ok", F.lit(False))))
