"""Shared helpers: table access, durable intermediate tables, text defaults."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="codelattice-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def _new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/codelattice/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This ends the lineage in replicated or shared files, so a lost executor
    costs a reread and not a recomputation of what lies before. The files go
    when ``drop_cut`` or ``drop_cuts`` deletes them, or when the driver ends.
    """
    path = _new_path(df.sparkSession, tag)
    df.write.parquet(path)
    _leave(df.sparkSession, path)
    return _read_cut(df.sparkSession, df.schema, path)


def _read_cut(spark: SparkSession, schema, path: str) -> DataFrame:
    back = spark.read.schema(schema).parquet(path)
    back._cut_path = path
    return back


def cut_by(df: DataFrame, tag: str, column: str, values: list[str]) -> list[DataFrame]:
    """As ``cut``, a table for each value of ``column``; each can be dropped by itself."""
    spark, path = df.sparkSession, _new_path(df.sparkSession, tag)
    df.write.partitionBy(column).parquet(path)
    _leave(spark, path)
    plain, out = df.drop(column).schema, []
    for value in values:
        own = f"{path}/{column}={value}"
        there, at = _file(spark, own)
        out.append(_read_cut(spark, plain, own) if there.exists(at) else spark.createDataFrame([], plain))
    return out


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Folders of cut tables that have not been deleted yet.
_cuts: set[str] = set()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends."""
    there, at = _file(spark, path)
    there.deleteOnExit(at)


def _leave(spark: SparkSession, path: str) -> None:
    delete_at_end(spark, path)
    _cuts.add(path)


def delete(spark: SparkSession, path: str) -> None:
    there, at = _file(spark, path)
    there.delete(at, True)


def drop_cuts(spark: SparkSession, kept: set[str] = frozenset()) -> None:
    """Delete all cut tables but ``kept``, once no result is read from them any more."""
    for path in list(_cuts - kept):
        delete(spark, path)
        _cuts.discard(path)


def cut_paths() -> set[str]:
    return set(_cuts)


def drop_cut(df: DataFrame | None) -> None:
    """Delete the files of a table that ``cut`` made and nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        delete(df.sparkSession, path)
        _cuts.discard(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished phases."""
    gc.collect()
    spark._jvm.System.gc()


def trimmed(out):
    """``out``, after what was freed went back to the system, where the C library can do that.

    Spark keeps a Python worker for later stages, with all memory it has.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    return out
