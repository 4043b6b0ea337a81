"""Documents to training shards: quality, near duplicates, decontamination, mixing, sharding.

Each stage works on everything that the one before it kept; its rows are written as Parquet to the shared
folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptlode.llm.common import staged, table
from scriptlode.llm.decontaminate import drop_contaminated
from scriptlode.llm.mixing import mix_sources
from scriptlode.llm.near_dup import drop_near_duplicates
from scriptlode.llm.quality import keep_good
from scriptlode.llm.sharding import shard

STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# The trained scorer, the signatures and the bin packing have no SQL form; tests hold the stages
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; the columns of documents with shard and slot."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
