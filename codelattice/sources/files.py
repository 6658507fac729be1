"""Source trees as a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, relpath, lang, content of all files below ``root`` in a known language.

    Extensions are filtered when files are listed, so no other file is opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names.GLOB).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/")
    found = raw.select(path.alias("path"), "content").withColumn("lang", names.language(F.col("path"))).filter("lang is not null")
    return found.select("path", names.relative_path(base, F.col("path")).alias("relpath"), "lang", F.decode("content", "UTF-8").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """relpath, lang, row (0-based), line."""
    return files.select("relpath", "lang", F.posexplode(F.split("content", "\n")).alias("row", "line"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """rank, symbol_id, score of a risk snapshot; the id may be path:row."""
    raw = spark.read.option("multiLine", "true").json(path)
    rows = raw.select(F.posexplode("risk_hotspots").alias("pos", "h"))
    symbol = rows.schema["h"].dataType["symbol"].dataType.fieldNames()
    key = F.col("h.symbol.id") if "id" in symbol else F.concat_ws(":", "h.symbol.path", F.element_at("h.symbol.range", 1).cast("string"))
    return rows.select((F.col("pos") + 1).alias("rank"), key.cast("string").alias("symbol_id"), F.col("h.score").cast("double").alias("score"))


def external_calls(raw: DataFrame, symbols: DataFrame, roots: list[str], client_id: int | None = None) -> DataFrame:
    """(src, name, path) candidates of an outside call hierarchy.

    ``raw``: client_id, src_id, dst_name, dst_path. Other clients' answers and
    files outside the roots are left out.
    """
    rows = raw if client_id is None else raw.filter(F.col("client_id") == client_id)
    inside = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        inside = inside | (F.col("dst_path") == root) | F.col("dst_path").startswith(root + "/")
    return rows.filter(inside).select(F.col("src_id").alias("src"), F.col("dst_name").alias("name"), F.col("dst_path").alias("path")).distinct().join(symbols.select(F.col("symbol_id").alias("src")), "src", "left_semi")
