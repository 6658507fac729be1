"""Import tokens of source lines, and the files they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

#: What follows a relative import's path, in order of preference.
RELATIVE_ENDS = ("", ".lua", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", "/init.lua", "/index.ts", "/index.js", "/__init__.py", "/mod.rs")
#: Files that a dotted module of a language may be.
MODULE_ENDS = {"lua": (".lua", "/init.lua"), "python": (".py", "/__init__.py")}

_Q, _NQ = "[\"']", "[^\"']"
#: Fixed values: (all matches of the line?, pattern) by language, in order.
PATTERNS = {
    "lua": [(True, rf"require\s*\(\s*{_Q}({_NQ}+){_Q}\s*\)"), (True, rf"require\s+{_Q}({_NQ}+){_Q}")],
    "python": [(False, r"^\s*from\s+([A-Za-z0-9_.]+)\s+import\s+"), (False, r"^\s*import\s+([A-Za-z0-9_.]+)")],
    "typescript": [(False, rf"from\s+{_Q}({_NQ}+){_Q}"), (False, rf"require\s*\(\s*{_Q}({_NQ}+){_Q}\s*\)"), (False, rf"^\s*import\s+{_Q}({_NQ}+){_Q}")],
    "go": [(False, rf"^\s*import\s+{_Q}({_NQ}+){_Q}"), (True, rf"{_Q}({_NQ}+){_Q}")],
    "rust": [(False, r"^\s*use\s+([^;]+)"), (False, r"^\s*mod\s+([A-Za-z0-9_]+)")],
}
PATTERNS["javascript"] = PATTERNS["typescript"]


def line_tokens(line: Column, lang: Column) -> Column:
    """The import tokens of a line as an array."""
    out = F.array().cast("array<string>")
    for name, patterns in PATTERNS.items():
        found = []
        for every, pattern in patterns:
            all_ = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
            found.append(all_ if every else F.slice(all_, 1, 1))
        out = F.when(lang == name, F.concat(*found)).otherwise(out)
    return out


def tokens(files: DataFrame) -> DataFrame:
    """relpath, lang, token, ord of files (relpath, lang, content), repeated tokens once."""
    lines = files.select("relpath", "lang", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    found = lines.select("relpath", "lang", "line_no", F.posexplode(line_tokens(F.col("line"), F.col("lang"))).alias("pos", "token"))
    first = found.groupBy("relpath", "lang", "token").agg(F.min(F.struct("line_no", "pos")).alias("o"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("relpath").orderBy("o"))).select("relpath", "lang", "token", "ord")


def candidates(relpath: Column, lang: Column, token: Column) -> Column:
    """The files a token may name, in order."""
    folder = F.regexp_replace(F.regexp_extract(relpath, "^(.*)/[^/]*$", 1), "/$", "")
    near = F.concat_ws("/", F.when(folder != "", folder), token)
    dotted = F.translate(token, ".", "/")
    out = F.array().cast("array<string>")
    for name, ends in MODULE_ENDS.items():
        out = F.when(lang == name, F.array(*[F.concat(dotted, F.lit(e)) for e in ends])).otherwise(out)
    out = F.when(token.startswith("."), F.array(*[F.concat(names.fold_path(near), F.lit(e)) for e in RELATIVE_ENDS])).otherwise(out)
    return F.transform(out, names.fold_path)


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """relpath, token, target: the first candidate that is a file, null if none is."""
    asked = found.select("relpath", "lang", "token", F.posexplode(candidates(F.col("relpath"), F.col("lang"), F.col("token"))).alias("pos", "target"))
    hit = asked.join(files.select(F.col("relpath").alias("target")).distinct(), "target", "left_semi")
    first = hit.groupBy("relpath", "token").agg(F.min_by("target", "pos").alias("target"))
    return found.select("relpath", "lang", "token", "ord").join(first, ["relpath", "token"], "left")


def graph(files: DataFrame) -> DataFrame:
    """Distinct (src, dst) of files."""
    return resolve(tokens(files), files).filter("target is not null").select(F.col("relpath").alias("src"), F.col("target").alias("dst")).distinct()
