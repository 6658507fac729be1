"""Reports as lines of text, from small collected results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, *order, limit: int | None = None):
    df = df.orderBy(*order) if order else df
    return (df.limit(limit) if limit else df).collect()


def table(title: str, df: DataFrame, columns: list[str], *order, limit: int = 50) -> list[str]:
    """A titled list, one line for each row."""
    rows = _rows(df.select(*columns), *order, limit=limit)
    body = ["  " + "  ".join(f"{c}={_text(r[c])}" for c in columns) for r in rows]
    return [title, "-" * len(title), *(body or ["  (none)"])]


def _text(value) -> str:
    return f"{value:.3f}" if isinstance(value, float) else "-" if value is None else ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def call_tree(index, root, depth: int = 2, direction: str = "outgoing", ascii_: bool = False, previews: int = 8) -> list[str]:
    """The subgraph as a tree; shared children are shown again, cycles are marked.

    Sites with more than one target are marked with their number, their edges
    as dynamic.
    """
    nodes, edges, notes = index.call_graph(root, depth, direction)
    names = {r["symbol_id"]: (r["name"], r["relpath"]) for r in index.symbols.join(nodes.select("symbol_id"), "symbol_id", "left_semi").select("symbol_id", "name", "relpath").collect()}
    links, count = {}, 0
    for r in edges.orderBy("src", "dst").collect():
        links.setdefault(r["src"], []).append(r["dst"])
        count += r["multiplicity"]
    dynamic = {(r["src"], r["dst"]) for r in notes.select("src", "dst").collect()}
    many = {r["src"]: r["n"] for r in index.targets.join(nodes.select(F.col("symbol_id").alias("src")), "src", "left_semi").groupBy("src", "call_ord").agg(F.count(F.lit(1)).alias("n")).groupBy("src").agg(F.max("n").alias("n")).filter("n > 1").collect()}
    tee, last, bar, gap = ("+- ", "`- ", "|  ", "   ") if ascii_ else ("├─ ", "└─ ", "│  ", "   ")
    scoped = index.resolutions().join(nodes.select(F.col("symbol_id").alias("src")), "src", "left_semi").agg(F.coalesce(F.sum(F.col("unresolved").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("polymorphic").cast("int")), F.lit(0))).first()
    out = [f"Call graph ({direction}, depth {depth})", f"nodes: {len(names)}  edges: {count}  unresolved: {scoped[0]}  polymorphic: {scoped[1]}", ""]

    def show(node, prefix: str, mark: str, path: tuple) -> None:
        name, rel = names[node]
        poly = f" [poly:{many[node]}]" if node in many else ""
        dyn = " [dynamic]" if path and (path[-1], node) in dynamic else ""
        cycle = " (cycle)" if node in path else ""
        out.append(f"{prefix}{mark}{name} - {rel}{poly}{dyn}{cycle}")
        if cycle or len(path) >= depth:
            return
        under = prefix + ("" if not mark else gap if mark == last else bar)
        children = [c for c in links.get(node, []) if c in names]
        for i, child in enumerate(children):
            show(child, under, last if i == len(children) - 1 else tee, (*path, node))

    if root in names:
        show(root, "", "", ())
    alternatives = index.targets.filter(F.col("src") == F.lit(root)).filter("target_ord > 1").orderBy("call_ord", "target_ord").limit(previews).collect()
    out += [f"  alt -> {r['call_name']}: {r['cand_name']} - {r['cand_path']} ({r['confidence']})" for r in alternatives]
    return out


def viewer(index, session, ascii_: bool = False) -> list[str]:
    """The state of an interactive viewer, then the graph it shows."""
    nodes, edges, counts = session.query(index.symbols, index.edges)
    totals = counts.first()
    head = [
        "Viewer", "------", f"focus: {session.root}", f"depth: {session.depth}", f"path filter: {session.path_prefix or '-'}", f"search: {session.search or '-'}",
        f"dynamic only: {str(bool(session.dynamic_only)).lower()}", f"kind: {session.kind or 'all'}", f"history: {len(session.history)}",
        f"hidden nodes: {totals['hidden_nodes']}", f"nodes before filters: {totals['total_nodes']}", "",
    ]
    names = {r["symbol_id"]: f"{r['name']} - {r['relpath']}" for r in index.symbols.join(nodes.select("symbol_id"), "symbol_id", "left_semi").select("symbol_id", "name", "relpath").collect()}
    return head + _tree(names, edges, session.root, session.depth, ascii_)


def hierarchy(nodes: DataFrame, edges: DataFrame, root, labels: dict, depth: int = 2, direction: str = "outgoing", ascii_: bool = False) -> list[str]:
    """An outside call hierarchy as a tree."""
    count = edges.count()
    names = {r["id"]: labels.get(r["id"], str(r["id"])) for r in nodes.collect()}
    return [f"Call hierarchy ({direction}, depth {depth})", f"nodes: {len(names)}  edges: {count}", "", *_tree(names, edges, root, depth, ascii_)]


def _tree(names: dict, edges: DataFrame, root, depth: int, ascii_: bool) -> list[str]:
    """Labels of what a root reaches; shared children are shown again, cycles are marked."""
    tee, last, bar, gap = ("+- ", "`- ", "|  ", "   ") if ascii_ else ("├─ ", "└─ ", "│  ", "   ")
    links: dict = {}
    for r in edges.select("src", "dst").distinct().orderBy("src", "dst").collect():
        links.setdefault(r["src"], []).append(r["dst"])
    out: list[str] = []

    def show(node, prefix: str, mark: str, path: tuple) -> None:
        cycle = node in path
        out.append(f"{prefix}{mark}{names[node]}{' (cycle)' if cycle else ''}")
        if cycle or len(path) >= depth:
            return
        under = prefix + ("" if not mark else gap if mark == last else bar)
        children = [c for c in links.get(node, []) if c in names]
        for i, child in enumerate(children):
            show(child, under, last if i == len(children) - 1 else tee, (*path, node))

    if root in names:
        show(root, "", "", ())
    return out


def expanded_tree(edges: DataFrame, root: str, expanded: set[str]) -> list[str]:
    """A tree over local names (src_name, dst_name); closed nodes show [+], open ones [-]."""
    links: dict[str, list[str]] = {}
    for r in edges.select("src_name", "dst_name").distinct().orderBy("src_name", "dst_name").collect():
        links.setdefault(r[0], []).append(r[1])
    out: list[str] = []

    def show(name: str, level: int, path: tuple) -> None:
        mark = "" if not links.get(name) else "[-] " if name in expanded else "[+] "
        out.append("  " * level + mark + name + (" (cycle)" if name in path else ""))
        if name in expanded and name not in path:
            for child in links.get(name, []):
                show(child, level + 1, (*path, name))

    show(root, 0, ())
    return out


def dependency_tree(edges: DataFrame, title: str = "Dependencies", limit: int = 5000) -> list[str]:
    """The first ``limit`` dependencies by source, and how many there are."""
    total = edges.count()
    rows = _rows(edges.select("src", "dst"), "src", "dst", limit=limit)
    if total > limit:
        title = f"{title} (first {limit} of {total})"
    out, at = [title, "-" * len(title)], None
    for r in rows:
        if r["src"] != at:
            at = r["src"]
            out.append(f"  {at}")
        out.append(f"    -> {r['dst']}")
    return out


def dead_code(df: DataFrame) -> list[str]:
    return table("Dead code", df, ["relpath", "name"], "relpath", "name")


def impact(df: DataFrame) -> list[str]:
    out = table("Direct callers", df.filter("direct"), ["name", "relpath"], "name", "relpath")
    out += ["", *table("Impacted symbols", df, ["relpath", "name", "depth"], "relpath", "name")]
    return out + ["", *table("Impacted modules", df.select("module_id").distinct(), ["module_id"], "module_id"), "", *table("Impacted tests", df.filter("is_test"), ["name", "relpath"], "name")]


def hot_path(hot: DataFrame, chains: DataFrame) -> list[str]:
    out = table("Hot paths", hot, ["rank", "label", "score", "rationale"], "rank")
    return out + ["", *table("Chains", chains, ["root", "pos", "symbol_id", "score", "bottleneck"], "root", "pos")]


def complexity(report: dict[str, DataFrame]) -> list[str]:
    out = table("Complexity", report["hotspots"], ["rank", "label", "score", "severity", "rationale"], "rank")
    out += ["", *table("Components", report["components"], ["rank", "size", "density", "has_cycle", "preview"], "rank")]
    out += ["", *table("Clusters", report["clusters"], ["module_id", "symbols", "edges", "density"], F.col("density").desc(), F.col("symbols").desc(), "module_id", limit=8)]
    return out + ["", *table("Suggestions", report["suggestions"], ["ord", "suggestion"], "ord")]


def risk(report: dict[str, DataFrame]) -> list[str]:
    out = table("Risk map", report["risk_hotspots"], ["rank", "label", "score", "severity", "rationale"], "rank")
    for level in ("modules", "packages"):
        out += ["", *table(level.title(), report[level], ["id", "avg_score", "score", "count"], F.col("avg_score").desc(), F.col("score").desc(), "id", limit=8)]
    if "trend" in report:
        out += ["", *table("Trend", report["trend"], report["trend"].columns)]
    return out + ["", *table("Suggestions", report["suggestions"], ["ord", "suggestion"], "ord")]


def architecture(report: dict[str, DataFrame]) -> list[str]:
    out = table("Groups", report["groups"], ["group_id", "symbol_count"], "group_id")
    out += ["", *table("Dependencies", report["edges"], ["source_group", "target_group", "count"], "source_group", "target_group")]
    order = (F.col("severity_score").desc(), F.col("count").desc(), "source_group", "target_group")
    return out + ["", *table("Violations", report["violations"], ["severity", "severity_score", "count", "source_group", "target_group"], *order)]


def evolution(report: dict[str, DataFrame]) -> list[str]:
    out = table("Timeline", report["timeline"], ["date", "short_hash", "files_count", "churn", "touched_symbols", "touched_edges"], "date", "short_hash")
    out += ["", *table("File hotspots", report["files"], ["rank", "path", "churn", "touches"], "rank")]
    return out + ["", *table("Symbol hotspots", report["symbols"], ["rank", "name", "touches", "churn"], "rank")]


def knowledge(report: dict[str, DataFrame]) -> list[str]:
    out = table("Knowledge graph", report["counts"], ["name", "n"], "name")
    return out + ["", *table("Edge types", report["edge_types"], ["type", "attempts", "n"], "type"), "", *table("Problems", report["problems"], ["problem", "id"], "problem", "id")]
