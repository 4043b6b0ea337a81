"""Exports: labelled column rows, training files, catalog folders, nested views."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..functions.fixed import LABEL_NOTNULL, LABEL_UNIQUE


def _token(c: Column) -> Column:
    return F.regexp_replace(X.to_snake(c), "[ ,]", "_")


def label_rows(tables: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per column: file, table, column, label.

    [UNIQUE] for the only column of a primary key or unique column, unless the table has several
    primary keys; else [NOTNULL] for a not-null column or any primary key column; else empty.
    """
    marking = keys.filter(F.col("key_type").isin("PrimaryKey", "UniqueColumn"))
    marks = (marking.select("repo_url", "table_name", (F.col("key_type") == "PrimaryKey").alias("pk"),
                            (F.size("cols") == 1).alias("single"), F.explode("cols").alias("col_name"))
             .groupBy("col_name", "table_name", "repo_url")
             .agg(F.max("pk").alias("in_pk"), F.max("single").alias("single")))
    several = (marking.filter("key_type = 'PrimaryKey'").groupBy("table_name", "repo_url")
               .agg(F.count("*").alias("n_pk")).filter("n_pk > 1"))
    rows = (columns.select("repo_url", "table_name", "col_name", "not_null", "origin",
                           F.col("file_id").alias("from_file"), "stmt_seq", "ord")
            .join(tables.select("repo_url", "table_name", "file_id"), ["table_name", "repo_url"])
            .join(marks, ["col_name", "table_name", "repo_url"], "left")
            .join(several, ["table_name", "repo_url"], "left"))
    cannot_be_null = F.col("not_null") | F.coalesce("in_pk", F.lit(False))
    unique = F.coalesce("single", F.lit(False)) & F.col("n_pk").isNull()
    label = F.when(unique, LABEL_UNIQUE).when(cannot_be_null, LABEL_NOTNULL).otherwise("")
    return rows.select("repo_url", "table_name", "col_name", F.col("file_id").alias("file"),
                       _token(X.clean_table(F.col("table_name"))).alias("table"),
                       _token(X.clean_column(F.col("col_name"))).alias("column"),
                       label.alias("label"), cannot_be_null.alias("not_null_col"),
                       *_ORDER[1:], F.col("origin"))


_ORDER = ("table_name", "from_file", "stmt_seq", "ord")


def write_training(labels: DataFrame, clusters: DataFrame, path: str, seed: str = "") -> None:
    """Training CSV with the tables in a repeatable random order, columns of a table together,
    and the duplicate clusters next to it."""
    lot = F.md5(F.concat_ws("|", "repo_url", "table_name", F.lit(seed)))
    rank = F.when(F.col("origin") == "create", 0).when(F.col("origin") == "alter", 1).otherwise(2)
    (labels.orderBy(lot, "repo_url", "table_name", rank, "from_file", "stmt_seq", "ord")
     .select("file", "table", "column", "label")
     .write.mode("overwrite").option("emptyValue", "").csv(f"{path}/rows"))
    clusters.select("n", "cluster_key").write.mode("overwrite").csv(f"{path}/clusters")


def write_catalog(tables: dict, path: str, buckets: int = 64, mode: str = "append") -> None:
    """Write each fact table below path, partitioned by a hash bucket of the repository; further
    batches append, so reading the folder merges them.

    The rebalance hint gathers a bucket's rows into few files and splits a bucket that one large
    repository fills.
    """
    for name, df in tables.items():
        rows = df.withColumn("bucket", F.pmod(F.xxhash64("repo_url"), F.lit(buckets)).cast("int"))
        rows.hint("rebalance", F.col("bucket")).write.mode(mode).partitionBy("bucket").parquet(f"{path}/{name}")


def read_catalog(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("bucket")


def table_view(tables: DataFrame, columns: DataFrame, keys: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Tables with their columns, keys and foreign keys as nested arrays."""
    by = ["table_name", "repo_url"]
    cols = columns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "file_id", "stmt_seq", "ord", "col_name", "col_type", "not_null"))).alias("cols"))
    key_lists = keys.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("key_type", "cols"))).alias("keys"))
    fks = foreign_keys.groupBy(*by).agg(F.array_sort(F.collect_set(
        F.struct("cols", "ref_name", "ref_cols"))).alias("fks"))
    return (tables.select(*by, "file_id").join(cols.withColumn("cols", F.transform(
        "cols", lambda c: F.struct(c["col_name"].alias("col_name"), c["col_type"].alias("col_type"),
                                   c["not_null"].alias("not_null")))), by)
            .join(key_lists, by, "left").join(fks, by, "left"))


def query_view(queries: DataFrame, joins: DataFrame, refs: DataFrame) -> DataFrame:
    """Queries with their joins and referenced columns as nested arrays."""
    by = ["repo_url", "file_id", "stmt_id"]
    join_lists = joins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "lo", "l_table", "r_table", "join_type", "conditions"))).alias("joins"))
    ref_lists = refs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "kind", "func", "table_name", "col_name"))).alias("refs"))
    return queries.join(join_lists, by, "left").join(ref_lists, by, "left")
