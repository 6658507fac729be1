"""Subgraphs and snapshots as files.

Graph exports are drawings for people: their nodes and edges are collected,
in order. Snapshots of whole tables are written by Spark.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout as layouts
from ..options import Layout

#: Formats and their other names.
FORMATS = {"json": "json", "graphviz": "dot", "dot": "dot", "gv": "dot", "mermaid": "mmd", "mmd": "mmd"}


def payload(symbols: DataFrame, nodes: DataFrame, edges: DataFrame, notes: DataFrame | None = None, options: Layout = Layout(), **meta) -> dict:
    """Nodes by id and edges by ends; edges repeat as often as their multiplicity."""
    placed = layouts.place(nodes, edges, options).join(symbols.select("symbol_id", "name", "relpath", "lang", "sr", "sc", "er", "ec"), "symbol_id")
    ids = placed.select("symbol_id")
    inner = edges.join(ids.withColumnRenamed("symbol_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi")
    if notes is not None:
        inner = inner.join(notes.select("src", "dst", "calls", F.lit(True).alias("dynamic")), ["src", "dst"], "left")
    else:
        inner = inner.withColumn("dynamic", F.lit(False)).withColumn("calls", F.array().cast("array<string>"))
    count = F.col("multiplicity") if "multiplicity" in edges.columns else F.lit(1)
    inner = inner.withColumn("n", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    shown = [{"id": r["symbol_id"], "name": r["name"], "label": f"{r['name']}\\n{r['relpath']}", "path": r["relpath"], "relpath": r["relpath"], "lang": r["lang"], "range": [r["sr"], r["sc"], r["er"], r["ec"]], "layout": {"x": r["x"], "y": r["y"], "depth": r["depth"], "layer_index": r["layer_index"]}} for r in placed.orderBy("symbol_id").collect()]
    links = [{"source": r["src"], "target": r["dst"], "dynamic": bool(r["dynamic"]), "polymorphic": bool(r["dynamic"]), "calls": list(r["calls"] or [])} for r in inner.orderBy("src", "dst").collect()]
    algorithm = "force" if options.algorithm.startswith("force") else "hierarchical"
    return {"meta": {**meta, "layout_algorithm": algorithm}, "nodes": shown, "edges": links}


def _dot_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


# The literal lines of both drawing formats.


def to_dot(graph: dict) -> str:
    force = graph["meta"]["layout_algorithm"] == "force"
    lines = ["digraph CodeGraph {", f"  // layout: {graph['meta']['layout_algorithm']}", "  rankdir=LR;", "  node [shape=box];"]
    lines += ["  layout=neato;", "  overlap=false;", "  splines=true;"] * force
    var = {node["id"]: f"n{i + 1}" for i, node in enumerate(graph["nodes"])}
    for node in graph["nodes"]:
        at = node["layout"]
        pin = f', pos="{at["x"]:.2f},{at["y"]:.2f}!", pin=true' if force else ""
        lines.append(f'  {var[node["id"]]} [label="{_dot_text(node["label"])}"{pin}];')
    if not force:
        layers: dict = {}
        for node in graph["nodes"]:
            layers.setdefault(node["layout"]["depth"], []).append(node)
        for _, layer in sorted(layers.items()):
            if len(layer) > 1:
                same = sorted(layer, key=lambda n: n["layout"]["layer_index"])
                lines.append(f"  {{ rank=same; {'; '.join(var[n['id']] for n in same)}; }}")
    lines += [f"  {var[e['source']]} -> {var[e['target']]};" for e in graph["edges"]]
    return "\n".join([*lines, "}"]) + "\n"


def to_mermaid(graph: dict) -> str:
    clean = lambda s: s.replace('"', "'").replace("<", "&lt;").replace(">", "&gt;")
    lines = ["flowchart TD" if graph["meta"]["layout_algorithm"] == "force" else "flowchart LR", f"%% layout: {graph['meta']['layout_algorithm']}"]
    var = {node["id"]: f"n{i + 1}" for i, node in enumerate(graph["nodes"])}
    lines += [f'  {var[n["id"]]}["{clean(n["name"])}<br/>{clean(n["relpath"])}"]' for n in graph["nodes"]]
    lines += [f"  {var[e['source']]} --> {var[e['target']]}" for e in graph["edges"]]
    return "\n".join(lines) + "\n"


def to_json(graph: dict, pretty: bool = False) -> str:
    return json.dumps(graph, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def export(graph: dict | None, kind: str, path: str | None, pretty: bool = False) -> str:
    """Write a payload; returns the path."""
    if graph is None:
        raise ValueError("index and subgraph are required")
    if kind not in FORMATS:
        raise ValueError(f"unsupported export format: {kind}")
    if not path:
        raise ValueError("export path is required")
    text = {"json": lambda: to_json(graph, pretty), "dot": lambda: to_dot(graph), "mmd": lambda: to_mermaid(graph)}[FORMATS[kind]]()
    Path(path).write_text(text)
    return path


def default_path(stem: str, kind: str, folder: str = ".") -> str:
    return str(Path(folder) / f"code-graph-{re.sub(r'[^A-Za-z0-9_-]', '_', stem)}.{FORMATS.get(kind, kind)}")


def knowledge_lines(nodes: DataFrame, edges: DataFrame, meta: dict) -> DataFrame:
    """A knowledge graph as JSON lines: the meta record, then nodes, then edges."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "", json.dumps({"record": "meta", **meta}))], "part int, key string, value string")
    line = lambda df, kind, part, key: df.select(F.lit(part).alias("part"), key.alias("key"), F.to_json(F.struct(F.lit(kind).alias("record"), *df.columns)).alias("value"))
    rows = head.unionByName(line(nodes, "node", 1, F.col("id"))).unionByName(line(edges, "edge", 2, F.concat_ws("|", "type", "source", "target")))
    return rows


def write_lines(rows: DataFrame, path: str) -> None:
    """Ordered lines (part, key, value) as text files, in order over the files."""
    rows.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("value").write.mode("overwrite").text(path)


def write_report(tables: dict[str, DataFrame], path: str, kind: str = "json", pretty: bool = False, limit: int = 100_000, **meta) -> None:
    """A report's tables as one JSON document.

    Top lists and totals are small; a table of more than ``limit`` rows is
    refused, as a document is no place for it (``CodeIndex.save`` is).
    """
    large = [name for name, df in tables.items() if df.limit(limit + 1).count() > limit]
    if large:
        raise ValueError(f"too many rows for a document: {', '.join(large)}")
    if kind not in ("json", "jsonl"):
        raise ValueError(f"unsupported format: {kind}")
    out = {**meta, **{name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}}
    Path(path).write_text(json.dumps(out, default=str, indent=2 if pretty and kind == "json" else None) + ("\n" if kind == "jsonl" else ""))
