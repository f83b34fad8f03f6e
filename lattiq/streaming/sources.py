"""Incremental extraction: a stream over a folder of sources, project by project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extract

SOURCES = "path string, modificationTime timestamp, length bigint, content binary"


def source_stream(spark: SparkSession, folder: str, depth: int = 1, files_a_trigger: int = 1000) -> DataFrame:
    """project, path, content of new .sol files under folder/project/...; the project is the depth-th folder below."""
    files = spark.readStream.format("binaryFile").schema(SOURCES).option("pathGlobFilter", "*.sol").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    root = folder.removeprefix("file:").rstrip("/")
    rest = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^/*{root.lstrip('/')}/", "")
    return files.select(F.get(F.split(rest, "/"), F.lit(depth - 1)).alias("project"), F.col("path"), "content")


def extract_stream(sources: DataFrame, folder: str, checkpoint: str, known: str) -> StreamingQuery:
    """Keeps graphs of changed projects current: folder/batch=N holds nodes and edges of the projects that batch N touched.

    All files seen so far lie in ``known``; a project with a new file is extracted anew from all of its files.  A
    batch that is run again overwrites its own output, so each is counted once.  Runs until what is there is
    done (availableNow).
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{known}/batch={n}")
        seen = spark.read.option("basePath", known).parquet(*[f"{known}/batch={i}" for i in range(n + 1) if _there(spark, f"{known}/batch={i}")])
        touched = spark.read.parquet(f"{known}/batch={n}").select("project").distinct()
        last = seen.join(touched, "project", "left_semi").groupBy("project", "path").agg(F.max_by("content", "batch").alias("content"))
        if last.isEmpty():
            return
        g = extract(last)
        g.nodes.write.mode("overwrite").parquet(f"{folder}/nodes/batch={n}")
        g.edges.write.mode("overwrite").parquet(f"{folder}/edges/batch={n}")

    return sources.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
