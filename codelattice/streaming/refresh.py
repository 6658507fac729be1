"""Rebuilds when sources change; windows over a stream of commits.

The rebuild is the engine's only event-driven behaviour. The windowed churn
is an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names
from ..operators.durable import durable


STATE = "path string, modified timestamp, length bigint"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, length of the files below ``root`` in a known language; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names.GLOB).load(root)
    return raw.select("path", F.col("modificationTime").alias("modified"), "length")


def poll(spark: SparkSession, root: str, state: str, rebuild: Callable[[DataFrame, DataFrame, int], None]) -> bool:
    """Call ``rebuild(changed files, removed paths, turn)`` if files below ``root`` are new, edited or gone; whether it was.

    ``state`` is a folder with the listing of each turn. A file is edited if
    its time or length is another. The listing is written after the rebuild,
    so a rebuild that fails is done again.
    """
    root_path = spark._jvm.org.apache.hadoop.fs.Path(state)
    store = root_path.getFileSystem(spark._jsc.hadoopConfiguration())
    turns = sorted(int(f.getPath().getName()) for f in store.listStatus(root_path) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) if store.exists(root_path) else []
    turn = turns[-1] + 1 if turns else 0
    known = spark.read.schema(STATE).parquet(f"{state}/{turns[-1]}") if turns else spark.createDataFrame([], STATE)
    now = durable(listing(spark, root))
    fresh = now.join(known, ["path", "modified", "length"], "left_anti")
    base = root.removeprefix("file://").rstrip("/")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    gone = known.join(now, "path", "left_anti").select(names.relative_path(base, plain(F.col("path"))).alias("relpath"))
    paths = [r[0] for r in fresh.select("path").collect()]
    if not paths and gone.isEmpty():
        return False
    # The changed files, and no others, are opened.
    text = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    files = text.select(plain(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("content")).withColumn("lang", names.language(F.col("path"))).withColumn("relpath", names.relative_path(base, F.col("path")))
    rebuild(files, gone, turn)
    now.write.mode("overwrite").parquet(f"{state}/{turn}")
    return True


def watch(spark: SparkSession, root: str, rebuild: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """``poll`` at each trigger of a stream, until it is stopped.

    Spark's own file source knows files by path and would miss an edit.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    look = lambda _, __: poll(spark, root, f"{checkpoint}/listings", rebuild)
    return ticks.writeStream.foreachBatch(look).option("checkpointLocation", f"{checkpoint}/ticks").trigger(processingTime=every).start()


def changed(old: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Files of an index after a change: a fresh file replaces the old one, a file that is gone goes."""
    stay = old.join(fresh.select("relpath"), "relpath", "left_anti")
    if gone is not None:
        stay = stay.join(gone.select("relpath"), "relpath", "left_anti")
    return stay.unionByName(fresh.select(*old.columns))


def churn_windows(commits: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Churn by path in tumbling windows over a stream (ts, path, added, deleted)."""
    return commits.withWatermark("ts", late).groupBy(F.window("ts", width), "path").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count(F.lit(1)).alias("touches"))
