"""Fact tables of many batches in one folder.

A batch is a set of whole repositories. Every fact table has a folder with one partition for each batch, so a batch that is run
again replaces what it wrote before, in every table. A ledger tells which batches are complete, how many rows each of
their tables has and its schema: a batch is open from before its first table is written until after the last, and
readers see only complete ones.
"""

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources import scripts as R
from .catalog import Catalog, build_catalog
from .query_facts import QueryFacts, build_query_facts
from .statements import query_statements, statements

_LEDGER = "batch string, name string, n_rows long, schema string"
_OPEN = "(open)"


def _replace(rows: DataFrame, path: str) -> None:
    """Write rows (with a column batch) over the partitions of their batches."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _tables(facts: Catalog | QueryFacts, kind: str) -> dict[str, DataFrame]:
    return {f"{kind}/{f.name}": getattr(facts, f.name) for f in fields(facts)}


def write_batch(spark: SparkSession, path: str, batch: str, catalog: Catalog, facts: QueryFacts) -> None:
    """Write all fact tables of a batch, in place of those that an earlier run of the batch has written.

    The rebalance hint makes few files and splits what one large repository fills.
    """
    tables = _tables(catalog, "catalog") | _tables(facts, "queries")
    ledger = f"{path}/ledger"
    _replace(spark.createDataFrame([(batch, _OPEN, 0, "")], _LEDGER), ledger)

    def write(name):
        df = tables[name]
        _replace(df.withColumn("batch", F.lit(batch)).hint("rebalance"), f"{path}/{name}")
        n = spark.read.schema(_with_batch(df.schema)).parquet(f"{path}/{name}").filter(F.col("batch") == batch)
        # Without rows no partition is written and an older one is left: the ledger then says that it has none.
        return batch, name, 0 if df.isEmpty() else n.count(), df.schema.json()

    with ThreadPoolExecutor(4) as pool:  # independent tables share the executors
        rows = list(pool.map(write, tables))
    _replace(spark.createDataFrame(rows, _LEDGER), ledger)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.StringType())])


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Tables of the complete batches: batch, name, n_rows, schema."""
    rows = spark.read.schema("name string, n_rows long, schema string, batch string").parquet(f"{path}/ledger")
    opened = rows.filter(F.col("name") == _OPEN).select("batch")
    return rows.join(opened, "batch", "left_anti")


def _loaded(spark: SparkSession, path: str, kind: str, made):
    """All tables of one kind over the complete batches. The ledger has a row for each table and batch; what is fetched is the schema of
    each table."""
    done = ledger(spark, path)
    schemas = {r["name"]: T.StructType.fromJson(json.loads(r["schema"])) for r in
               done.filter(F.col("name").startswith(f"{kind}/")).groupBy("name").agg(F.max_by("schema", "batch").alias("schema")).collect()}

    def table(name):
        live = done.filter((F.col("name") == name) & (F.col("n_rows") > 0)).select("batch")
        schema = schemas[name]
        return spark.read.schema(_with_batch(schema)).parquet(f"{path}/{name}").join(live, "batch", "left_semi").select(*schema.names)

    return made(**{f.name: table(f"{kind}/{f.name}") for f in fields(made)})


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """The catalog of all complete batches."""
    return _loaded(spark, path, "catalog", Catalog)


def load_query_facts(spark: SparkSession, path: str) -> QueryFacts:
    """The query facts of all complete batches."""
    return _loaded(spark, path, "queries", QueryFacts)


def run_batch(spark: SparkSession, files: str, manifest: str, path: str, batch: str) -> None:
    """From a folder of scripts and a manifest to the stored facts of a batch."""
    scripts = R.scripts_from(R.read_manifest(spark, manifest), R.read_scripts(spark, files))
    catalog = build_catalog(statements(scripts))
    write_batch(spark, path, batch, catalog, build_query_facts(query_statements(scripts), catalog))
