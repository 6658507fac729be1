"""Graph tables: transposition, degrees, module and package roll-ups.

Symbols have symbol_id, sym_ord, name, short_name, container, symbol_kind,
relpath, module_id, package_id. Edges have src and dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..options import DeadCode


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    return transpose(edges) if direction == "incoming" else edges.select("src", "dst")


def degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, in_degree, out_degree of every symbol.

    One aggregation over both ends, so edges are shuffled once.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("symbol_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("bigint")
    return symbols.select("symbol_id").join(sums, "symbol_id", "left").select("symbol_id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def roll_up(symbols: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """Distinct (src, dst) of modules or packages; edges inside one stay."""
    key = f"{level}_id"
    ids = symbols.select("symbol_id", F.col(key).alias("group"))
    a, b = ids.toDF("src", "a"), ids.toDF("dst", "b")
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def group_nodes(symbols: DataFrame, level: str) -> DataFrame:
    """Modules or packages with their first symbol as target."""
    key = f"{level}_id"
    return symbols.groupBy(F.col(key).alias("id")).agg(F.min_by("symbol_id", "sym_ord").alias("target"), F.count(F.lit(1)).alias("symbols"))


def dead_code(symbols: DataFrame, edges: DataFrame, options: DeadCode = DeadCode()) -> DataFrame:
    """Symbols that nothing calls, but for ignored ones."""
    live = symbols.filter(~names.ignored(F.col("relpath"), F.col("name"), options))
    return live.join(edges.select(F.col("dst").alias("symbol_id")), "symbol_id", "left_anti")


def symbol_at(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """The innermost symbol at each point (relpath, row, col), by equi-join on the file.

    Ranges are zero-based and end before (er, ec).
    """
    from pyspark.sql import Window

    met = points.join(symbols.select("symbol_id", "sym_ord", "relpath", "sr", "sc", "er", "ec"), "relpath")
    after = (F.col("row") > F.col("sr")) | ((F.col("row") == F.col("sr")) & (F.col("col") >= F.col("sc")))
    before = (F.col("row") < F.col("er")) | ((F.col("row") == F.col("er")) & (F.col("col") < F.col("ec")))
    size = (F.col("er") - F.col("sr")) * 10000 + (F.col("ec") - F.col("sc"))
    first = Window.partitionBy("relpath", "row", "col").orderBy(size, "sym_ord")
    return met.filter(after & before).withColumn("n", F.row_number().over(first)).filter("n = 1").select("relpath", "row", "col", "symbol_id")


def local_graph(symbols: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Calls inside one file by name: each call to the first definition it matches."""
    src = symbols.select(F.col("symbol_id").alias("src"), "relpath", F.col("name").alias("src_name"))
    defs = symbols.select("relpath", "sym_ord", F.col("name").alias("dst_name"), F.explode(F.array_distinct(F.array("name", "short_name"))).alias("call_name"))
    met = call_sites.select("src", "call_name").join(src, "src").join(defs, ["relpath", "call_name"])
    first = met.groupBy("relpath", "src_name", "src", "call_name").agg(F.min_by("dst_name", "sym_ord").alias("dst_name"))
    return first.select("relpath", "src_name", "dst_name").distinct()
