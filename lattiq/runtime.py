"""Reliable cuts of lineage: checkpoints in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see; only a local session without that setting gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lattiq-")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root, in the application's own folder."""
    return f"{shared_root(spark).rstrip('/')}/lattiq/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes what this application has stored on the way; call it when no result is to be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark).rstrip('/')}/lattiq/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Checkpoints df into the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys into as many parts as shuffles have, whatever its size.

    For rows that are few bytes but much work: AQE would merge them into one task by their size.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


#: Rows that a task of a large shuffle takes; fixed, so that a task's memory doesn't grow with the input.
TASK_ROWS = 1 << 19


def cut_by_rows(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys into tasks of TASK_ROWS rows or so; as it is if they are few, which Spark may part as it likes."""
    n = df.count() // TASK_ROWS + 1
    return df.repartition(n, *keys) if n > 8 else df


def put_file(uri: str, data: bytes) -> None:
    """Writes a file at a path or URI under a passing name and renames it; usable on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        files, path = fs.LocalFileSystem(), os.path.abspath(uri)
    else:
        files, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    passing = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(passing) as out:
        out.write(data)
    files.move(passing, path)
