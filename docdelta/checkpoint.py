"""Written tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    That is spark.checkpoint.dir; where the session has none and runs on one machine (tests), a temporary
    folder takes its place. On a cluster no folder of one machine will do, and an error says so.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, so that a long job holds only what it needs."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_stored: dict[tuple, DataFrame] = {}


def stored(key: tuple, source: DataFrame, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make() as a written table that later callers with that key read again, as long as source reads the same files in this application and the table is there."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), *key, tuple(sorted(source.inputFiles())))
    if (table := _stored.get(key)) is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return table
    table = written(make(), name)
    _stored[(*key[:1], spark.conf.get("spark.checkpoint.dir", None), *key[2:])] = table
    return table
