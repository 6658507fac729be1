"""Version-control history as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: starts a commit's line in the log.
MARK = "@@@"
#: Line numbers that are read in order by one task.
RANGE = 1 << 20
#: Fixed value: hash, date, author, subject of a commit.
FORMAT = f"{MARK}%H%x09%ad%x09%an%x09%s"


def _git(args: list[str], cwd: str, timeout: float) -> str:
    return subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, timeout=timeout, check=True).stdout


def repo_root(path: str, timeout: float = 4) -> str:
    return _git(["rev-parse", "--show-toplevel"], path, timeout).strip()


def read_log(spark: SparkSession, root: str, limit: int = 30, include_merges: bool = False, since: str | None = None, path: str | None = None, timeout: float = 5) -> DataFrame:
    """line_no, line of the newest commits of a repository on the driver."""
    args = ["log", "--date=iso-strict", f"--pretty=format:{FORMAT}", "--numstat", "-n", str(max(1, int(limit)))]
    args += [] if include_merges else ["--no-merges"]
    args += [f"--since={since}"] if since else []
    args += ["--", path] if path else []
    lines = _git(args, root, timeout).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")


def parse_log(lines: DataFrame, log_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """commits and files of log lines (line_no, line).

    Lines of one log are numbered in order, gaps allowed; ``log_id`` names a
    column that tells logs apart. A line belongs to the last header before it:
    the last one of its own range of ``RANGE`` numbers, else of an earlier
    range. So one log is parsed in parallel; what the ranges hand on is a row
    for each. A count of ``-`` (binary) is 0.
    """
    key = [log_id] if log_id else []
    head = F.col("line").startswith(MARK)
    body = F.split(F.substring("line", len(MARK) + 1, 1 << 30), "\t", 4)
    field = lambda i: F.try_element_at(body, F.lit(i))
    lines = lines.withColumn("head", head).withColumn("own", F.when(head, field(1))).withColumn("range", F.floor(F.col("line_no") / RANGE))
    ends = lines.groupBy(*key, "range").agg(F.max_by("own", F.when(F.col("head"), F.col("line_no"))).alias("last"))
    earlier = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, "range", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    order = Window.partitionBy(*key, "range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("hash", F.last("own", ignorenulls=True).over(order)).join(carried, [*key, "range"], "left").withColumn("hash", F.coalesce("hash", "carried")).drop("own", "carried", "range")
    cells = F.split("line", "\t", 3)
    number = lambda i: F.coalesce(F.try_element_at(cells, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))
    files = marked.filter(~F.col("head") & (F.size(cells) == 3) & F.col("hash").isNotNull()).select(*key, "hash", F.element_at(cells, 3).alias("path"), number(1).alias("added"), number(2).alias("deleted"))
    heads = marked.filter("head").select(*key, "hash", field(2).alias("date"), field(3).alias("author"), field(4).alias("subject"), F.col("line_no").alias("seq"))
    sums = files.groupBy(*key, "hash").agg(F.count(F.lit(1)).alias("files_count"), F.sum("added").alias("insertions"), F.sum("deleted").alias("deletions"))
    commits = heads.join(sums, [*key, "hash"], "left").fillna(0, ["files_count", "insertions", "deletions"])
    return commits, files
