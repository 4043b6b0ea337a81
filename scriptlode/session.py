"""Session settings used by the library."""

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

# Runtime settings; resolution joins may meet a name that holds a large share of all rows, and
# adaptive execution then splits that partition even if another shuffle must follow.
# Tables are never broadcast by the size of their files: names and urls compress so well that a file of 10 MB becomes more
# than 80 MB in the driver. Adaptive execution broadcasts what a shuffle has measured.
_RUNTIME = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows of script text are costly per byte: do not merge small shuffles into one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder named in spark.checkpoint.dir. Only a local session without one gets a temporary
    folder; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: later stages read typed columns, not script text, with column pruning and
    known sizes, and a lost executor costs no recomputation.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_all(dfs: list) -> list:
    """Cut several independent tables; their jobs share the executors."""
    with ThreadPoolExecutor(max(1, len(dfs))) as pool:
        return list(pool.map(cut, dfs))
