"""Shared folders for tables and stream checkpoints of a job."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's spark.checkpoint.dir; a temporary one where it is unset.
    What is there is deleted when the driver's process ends, if its session still runs."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rankspark-")
    path = f"{base.rstrip('/')}/rankspark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def by_key(df: DataFrame, name: str, key: str, *order: str) -> DataFrame:
    """``df`` written once in spark.sql.shuffle.partitions buckets of ``key``, in ``order`` within it.
    Windows, groups and joins by the key then need no exchange, however many read the table."""
    spark, table = df.sparkSession, f"rankspark_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    atexit.register(_drop, spark, table)
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key, *order).option("path", folder(spark, name)).saveAsTable(table)
    return spark.table(table)


def _drop(spark: SparkSession, table: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Py4JError as why:
        print(f"rankspark: {path} was not deleted: {why}", file=sys.stderr)
