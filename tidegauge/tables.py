"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: on one machine a folder of this process that goes when it ends, on a cluster one in the warehouse, which has to be a shared store."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if re.match(r"local(\[|$)", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="tidegauge-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            # All machines of a local cluster are this one.
            if re.match(r"(file:|/)", warehouse) and not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = f"{warehouse}/tidegauge-{uuid.uuid4().hex}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders that materialise() has written and release() not yet removed.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove all tables that materialise() has written; for callers that know that no result still to be computed reads them."""
    jvm = spark.sparkContext._jvm
    for path in _WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.clear()


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(rows: DataFrame, most: int = 250_000) -> int:
    """How many tasks have at most about `most` of the rows each, however large the table and its files' splits are; rows are counted for it."""
    return max(1, -(-rows.count() // most))


def small_enough(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df, a few columns of a written table, marked for broadcast if it has at most `most` rows; more of them are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df
