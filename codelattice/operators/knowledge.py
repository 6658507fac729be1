"""The typed knowledge graph over symbols, files, modules, packages, types and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..options import Knowledge

SCHEMA_VERSION = "knowledge_graph.v1"
NODE_TYPES = ("function", "type", "file", "module", "package", "test")

_ATTRS = {"source_backend": "string", "confidence": "string", "dynamic": "boolean", "polymorphic": "boolean", "call": "string", "external": "boolean"}
_NODE = {"label": "string", "path": "string", "relpath": "string", "lang": "string", "symbol_kind": "string", "module_id": "string", "package_id": "string", "external": "boolean"}


def _id(kind: str, *columns) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def _type_id():
    return F.concat(F.lit("type:"), F.col("relpath"), F.lit(":"), F.col("container"))


def _external_id():
    return F.concat(F.lit("fn_external:"), F.col("cand_path"), F.lit(":"), F.col("cand_name"))


def _nodes(rows: DataFrame, turn: int, kind: str, node_id, **attrs) -> DataFrame:
    """Node records. Those of one turn and id are alike; the first turn names a node."""
    fields = [attrs[c].alias(c) if c in attrs else F.lit(None).cast(t).alias(c) for c, t in _NODE.items()]
    return rows.select(node_id.alias("id"), F.lit(kind).alias("type"), *fields, F.lit(turn).alias("turn"))


def _edges(rows: DataFrame, kind, source, target, **attrs) -> DataFrame:
    """Edge records; those with one type and ends are alike."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [attrs[c].cast(t).alias(c) if c in attrs else F.lit(None).cast(t).alias(c) for c, t in _ATTRS.items()]
    return rows.select(kind.alias("type"), source.alias("source"), target.alias("target"), *fields)


def edge_lookup(chosen: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """src, dst and facts of the last call that resolves to dst.

    Without ``resolved``, ``chosen`` are all targets of their calls, dealt by
    caller or not; if they are, they are not dealt again.
    """
    if resolved is None:
        many = F.count(F.lit(1)).over(Window.partitionBy("src", "call_ord")) > 1
        met = chosen.withColumn("dynamic", many).withColumn("polymorphic", many).filter("cand_id is not null")
    else:
        flags = resolved.select("src", "call_ord", "dynamic", "polymorphic")
        met = chosen.filter("cand_id is not null").join(flags, ["src", "call_ord"])
    last = met.groupBy("src", F.col("cand_id").alias("dst")).agg(F.max_by(F.struct(F.col("source").alias("source_backend"), "confidence", "dynamic", "polymorphic", F.col("call_name").alias("call")), F.struct("call_ord", "target_ord")).alias("m"))
    return last.select("src", "dst", "m.*")


def build(symbols: DataFrame, edges: DataFrame | None, chosen: DataFrame | None = None, resolved: DataFrame | None = None, cands: DataFrame | None = None, imports: DataFrame | None = None, options: Knowledge = Knowledge()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, and edge records before their dedup (for the counts by type).

    Without ``edges``, the calls are those of ``chosen``, all of them targets among the symbols.
    """
    s = symbols.withColumn("test", names.is_test(F.col("relpath"), F.col("name")))
    c = F.col
    fn, file, module, package = _id("fn", "symbol_id"), _id("file", "relpath"), _id("module", "module_id"), _id("package", "package_id")
    nodes = [
        _nodes(s, 0, "function", fn, label=c("name"), path=c("path"), relpath=c("relpath"), lang=c("lang"), symbol_kind=c("symbol_kind"), module_id=c("module_id"), package_id=c("package_id")),
        _nodes(s, 1, "file", file, label=c("relpath"), path=c("path"), relpath=c("relpath")),
        _nodes(s, 2, "module", module, label=c("module_id")), _nodes(s, 3, "package", package, label=c("package_id")),
    ]
    records = [
        _edges(s, "defines", file, fn), _edges(s, "belongs_to_module", fn, module),
        _edges(s, "belongs_to_package", fn, package), _edges(s, "contains_module", package, module),
    ]
    if options.include_types:
        typed = s.filter("container is not null and container != ''")
        nodes.append(_nodes(typed, 4, "type", _type_id(), label=c("container"), path=c("path"), relpath=c("relpath"), module_id=c("module_id"), package_id=c("package_id")))
        records += [_edges(typed, "defines_type", file, _type_id()), _edges(typed, "belongs_to_type", fn, _type_id())]
    if options.include_tests:
        tests = s.filter("test")
        nodes.append(_nodes(tests, 5, "test", _id("test", "symbol_id"), label=c("name"), path=c("path"), relpath=c("relpath")))
        records.append(_edges(tests, "test_covers", _id("test", "symbol_id"), fn))
    ends = s.select("symbol_id", "test")
    callers = ends.toDF("src", "test")
    if edges is None:
        calls = edge_lookup(chosen, resolved).join(callers, "src")
    else:
        calls = edges.select("src", "dst").join(callers, "src").join(ends.select(c("symbol_id").alias("dst")), "dst", "left_semi")
    if edges is not None and chosen is not None:
        calls = calls.join(edge_lookup(chosen, resolved), ["src", "dst"], "left")
    elif edges is not None:
        calls = calls.select("*", *[F.lit(None).cast(t).alias(n) for n, t in _ATTRS.items() if n != "external"])
    records.append(_edges(calls, F.when(c("test"), "tests").otherwise("calls"), _id("fn", "src"), _id("fn", "dst"), source_backend=F.coalesce("source_backend", F.lit("index")), confidence=F.coalesce("confidence", F.lit("unknown")), dynamic=F.coalesce("dynamic", F.lit(False)), polymorphic=F.coalesce("polymorphic", F.lit(False)), call=c("call")))
    if options.include_external and cands is not None:
        # A symbol's first call of an outside function is its edge.
        outside = cands.filter("cand_id is null and cand_path is not null and cand_name is not null")
        first = F.min_by(F.struct("source", "confidence", "call_name"), F.struct("call_ord", -F.col("score")))
        outside = outside.groupBy("src", "cand_path", "cand_name").agg(first.alias("f")).select("src", "cand_path", "cand_name", "f.*")
        nodes.append(_nodes(outside, 6, "function", _external_id(), label=c("cand_name"), path=c("cand_path"), relpath=c("cand_path"), external=F.lit(True)))
        records.append(_edges(outside, "calls_external", _id("fn", "src"), _external_id(), source_backend=c("source"), confidence=c("confidence"), call=c("call_name"), external=F.lit(True)))
    if options.include_imports and imports is not None:
        both = imports.select(F.explode(F.array("src", "dst")).alias("relpath")).distinct()
        nodes.append(_nodes(both, 7, "file", file, label=c("relpath")))
        records.append(_edges(imports, "imports", _id("file", "src"), _id("file", "dst"), source_backend=F.lit("index"), confidence=F.lit("high")))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    attrs = ["type", *_NODE]
    first = union(nodes).groupBy("id").agg(F.min_by(F.struct(*attrs), "turn").alias("n"))
    all_records = union(records)
    facts = list(_ATTRS)
    once = all_records.groupBy("type", "source", "target").agg(F.min(F.struct(*facts)).alias("a")).select("type", "source", "target", "a.*")
    return first.select("id", "n.*"), once, all_records


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, n: nodes by type and totals."""
    by = nodes.groupBy(F.concat(F.col("type"), F.lit("_nodes")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_nodes").alias("name"), "n")).unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_edges").alias("name"), "n"))


def edge_type_counts(records: DataFrame) -> DataFrame:
    """type, attempts (records before the dedup), n (distinct edges)."""
    return records.groupBy("type").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("source", "target").alias("n"))


def validate(nodes: DataFrame, edges: DataFrame, schema_version: str | None = SCHEMA_VERSION) -> DataFrame:
    """problem, id: another schema version, missing ids, unknown types, edges without an end."""
    version = nodes.sparkSession.createDataFrame([] if schema_version == SCHEMA_VERSION else [("unsupported_schema_version", str(schema_version))], "problem string, id string")
    ids = nodes.select("id")
    missing = nodes.filter("id is null").select(F.lit("missing_id").alias("problem"), F.lit("").alias("id"))
    kinds = nodes.filter(~F.col("type").isin(*NODE_TYPES)).select(F.lit("unsupported_type").alias("problem"), "id")
    # Both ends of an edge at once, as edges may be costly to read twice.
    end = lambda c: F.struct(F.lit(f"dangling_{c}").alias("problem"), F.col(c).alias("id"))
    ends = edges.select(F.explode(F.array(end("source"), end("target"))).alias("e")).select("e.*").join(ids, "id", "left_anti")
    return version.unionByName(missing).unionByName(kinds).unionByName(ends.select("problem", "id"))
