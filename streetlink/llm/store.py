"""Intermediate tables that survive the loss of executors.

Lineage is cut by writing Parquet to the folder the session names in
``spark.checkpoint.dir``, which driver and executors share. Only where that
setting is empty (tests, a laptop) a local folder is made, and only for a local
master: on a cluster a machine-local folder would lose rows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="streetlink-")
        atexit.register(shutil.rmtree, _local[app], True)
    return f"file://{_local[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streetlink/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df once and return it as read back; later plans start from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    # shuffle files of the step leave the disk when it ends, not when the driver's heap fills
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once all that is made from it is written itself."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/streetlink/" not in name:
            raise ValueError(f"{name} is not a scratch table")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this module wrote; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/streetlink")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)
