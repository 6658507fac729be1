"""The registered queries: each operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..functions import names
from ..operators import graphs, imports, knowledge, layout, reports, resolve, scc, traverse, viewer
from ..operators.durable import durable
from ..options import Architecture, Layout, Resolution, Risk
from ..sinks import export
from ..sources import extract, gitlog
from . import documents
from .index import CodeIndex

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
    return f


def _r(column: str):
    return F.round(F.col(column).cast("double"), 6).alias(column)


def busiest(edges: DataFrame, end: str):
    """The id with the most edges at ``end``, the smallest of equals."""
    row = edges.groupBy(end).count().orderBy(F.col("count").desc(), end).first()
    return row[0] if row else -1


# Columns and symbols.


@query
def module_package_ids(x):
    return x.symbols.select("symbol_id", "module_id", "package_id")


@query
def test_symbol_flags(x):
    return x.symbols.select("symbol_id", names.is_test(F.col("relpath"), F.col("name")).alias("is_test"))


@query
def entrypoint_flags(x):
    return x.symbols.select("symbol_id", names.is_entrypoint(F.col("short_name")).alias("is_entrypoint"), names.range_label(F.col("sr"), F.col("sc"), F.col("er"), F.col("ec")).alias("range_label"), names.label(F.col("name"), F.col("relpath")).alias("label"), names.language(F.col("relpath")).alias("lang"))


@query
def call_parse(x):
    return x.calls.select("src", "call_ord", *[c.alias(n) for n, c in names.parse_call(F.col("raw")).items()])


@query
def symbol_at(x):
    points = x.symbols.select("relpath", (F.col("sr") + 3).alias("row"), F.lit(0).alias("col")).distinct()
    return graphs.symbol_at(x.symbols, points)


@query
def local_graph(x):
    return graphs.local_graph(x.symbols, resolve.call_sites(x.calls))


# Graph tables.


@query
def degree_hotspots(x):
    d = graphs.degrees(x.symbols, x.edges).join(x.symbols.select("symbol_id", "name", "relpath"), "symbol_id")
    score = F.col("in_degree") * 2.2 + F.col("out_degree") * 1.6 + F.least("in_degree", "out_degree") * 2.4
    top = reports.ranked(d.withColumn("score", F.round(score, 6)), [F.col("score").desc(), F.col("symbol_id")], 10)
    return top.select("rank", "symbol_id", "in_degree", "out_degree", "score")


@query
def reverse_edges(x):
    return graphs.transpose(x.edges)


@query
def dead_code(x):
    """In the order of the report: as it is written out, so it is numbered."""
    dead = graphs.dead_code(x.symbols, x.edges).select("symbol_id", "relpath", "name")
    return reports.ranked(dead, list(reports.DEAD_ORDER))


@query
def module_edges(x):
    return graphs.roll_up(x.symbols, x.edges, "module")


@query
def package_edges(x):
    return graphs.roll_up(x.symbols, x.edges, "package")


@query
def module_edge_summary(x):
    nodes = graphs.group_nodes(x.symbols, "module")
    out = graphs.roll_up(x.symbols, x.edges, "module")
    a = out.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    b = out.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    return nodes.join(a, "id", "left").join(b, "id", "left").fillna(0).select(F.col("id").alias("module_id"), "target", "symbols", "n_out", "n_in")


# Resolution.


def _cands(x):
    """All candidates: outside sources are merged with these."""
    sites = resolve.call_sites(x.calls)
    return sites, resolve.candidates(x.symbols, sites, x.receiver_types)


def _chosen(x):
    sites = durable(resolve.call_sites(x.calls))
    return sites, resolve.targets(resolve.likely_candidates(durable(x.symbols), sites, x.receiver_types))


@query
def resolve_candidates(x):
    return _cands(x)[1].select("src", "call_ord", "cand_id", "score", "confidence", F.array_join("reasons", ",").alias("reasons"))


@query
def resolve_targets(x):
    return _chosen(x)[1].select("src", "call_ord", "target_ord", "cand_id", "score", "confidence")


def _resolved(x):
    sites, chosen = _chosen(x)
    return sites, chosen, resolve.resolutions(sites, chosen)


@query
def call_resolutions(x):
    return _resolved(x)[2].select("src", "call_ord", "call_name", "kind", "receiver", "best_id", "n_targets", "polymorphic", "dynamic", "unresolved")


@query
def polymorphic_calls(x):
    return _resolved(x)[2].filter("polymorphic").select("src", "call_ord", "call_name", "n_targets")


@query
def unresolved_calls(x):
    return _resolved(x)[2].agg(F.sum(F.col("unresolved").cast("bigint")).alias("unresolved_count"), F.count(F.lit(1)).alias("call_sites"))


@query
def resolved_call_edges(x):
    return resolve.resolved_edges(x.symbols, _resolved(x)[1])


def _beside(x):
    """Symbols and call sites with the candidates of the outside source."""
    symbols, sites = durable(x.symbols), durable(resolve.call_sites(x.calls))
    return symbols, sites, resolve.external_candidates(symbols, x.external, Resolution())


def _merged(x):
    symbols, sites, outside = _beside(x)
    return sites, resolve.likely_merged(symbols, sites, x.receiver_types, outside)


@query
def external_merge(x):
    _, merged = _merged(x)
    return resolve.targets(merged).select("src", "call_ord", "target_ord", "cand_id", "cand_name", "cand_path", "source", "score", "confidence")


# Traversals.


def _around(x, depth=2):
    symbols, edges = x.symbols, durable(x.edges)
    root = busiest(edges, "src")
    return symbols, edges, root, *traverse.subgraph(symbols, edges, root, depth)


@query
def subgraph_nodes(x):
    return _around(x)[3].select("symbol_id", "depth")


@query
def subgraph_edges_multiset(x):
    return _around(x, 4)[4]


@query
def edge_annotations(x):
    """Annotated edges of the subgraph over resolved calls."""
    symbols, (_, chosen, _) = x.symbols, _resolved(x)
    chosen = durable(chosen)
    edges = durable(resolve.resolved_edges(symbols, chosen))
    nodes, _ = traverse.subgraph(symbols, edges, busiest(edges, "src"), 2)
    notes = traverse.edge_annotations(nodes, chosen)
    return notes.select("src", "dst", "n_calls", F.array_join("calls", ",").alias("calls"))


@query
def dep_subgraph(x):
    edges = durable(graphs.roll_up(x.symbols, x.edges, "module"))
    nodes, inner = traverse.dependency_subgraph(edges, busiest(edges, "src"), 2)
    return inner.join(nodes.select(F.col("symbol_id").alias("src"), F.col("depth").alias("src_depth")), "src").select("src", "dst", "multiplicity", "src_depth")


@query
def filtered_subgraph(x):
    symbols, _, root, nodes, edges = _around(x, 3)
    keep = symbols.filter(viewer.keeps(kind="function"))
    return traverse.filtered_subgraph(nodes, edges, root, keep)[1]


@query
def dynamic_only_subgraph(x):
    symbols, (_, chosen, _) = x.symbols, _resolved(x)
    chosen = durable(chosen)
    edges = durable(resolve.resolved_edges(symbols, chosen).select("src", "dst"))
    root = busiest(edges, "src")
    nodes, inner = traverse.subgraph(symbols, edges, root, 2)
    return traverse.dynamic_only(nodes, inner, traverse.edge_annotations(nodes, chosen), root)[1]


@query
def call_hierarchy(x):
    """An outside call source of which only two folders count."""
    paths = x.symbols.select(F.col("symbol_id").alias("dst"), F.col("relpath").alias("dst_path"))
    calls = durable(x.edges.join(paths, "dst"))
    nodes, edges = traverse.call_hierarchy(calls, busiest(calls, "src"), 3, inside=lambda p: p.startswith("ui/") | p.startswith("service/"))
    return edges.join(nodes.select(F.col("id").alias("src"), F.col("depth").alias("src_depth")), "src")


@query
def viewer_query(x):
    symbols, edges = x.symbols, durable(x.edges)
    session = viewer.Session(root=busiest(edges, "src"), depth=4, search="brand", kind="function")
    return session.query(symbols, edges)[2]


def _impact(x):
    edges = durable(x.edges)
    return reports.impact(x.symbols, edges, busiest(edges, "dst"))


@query
def impact_transitive(x):
    return _impact(x).select("symbol_id", "depth")


@query
def impact_direct(x):
    return reports.ranked(_impact(x).filter("direct").select("symbol_id", "name", "relpath"), list(reports.LABEL_ORDER))


@query
def impact_modules(x):
    return _impact(x).groupBy("module_id", "package_id").agg(F.count(F.lit(1)).alias("symbols"))


@query
def impact_tests(x):
    """Callers that are tests, where every third module is a test file."""
    edges = durable(x.edges)
    marked = x.symbols.withColumn("relpath", F.regexp_replace("relpath", r"m3\.lua$", "m3_test.lua"))
    tests = reports.impact(marked, edges, busiest(edges, "dst")).filter("is_test").select("symbol_id", "name", "relpath")
    return reports.ranked(tests, list(reports.LABEL_ORDER))


@query
def reach_counts(x):
    return traverse.reach_counts(x.symbols, durable(x.edges))


# History.


def _recent(x, limit):
    return durable(reports.latest(x.commits, limit)), x.files


@query
def file_churn(x):
    return reports.file_churn(*_recent(x, 60))


@query
def file_hotspots(x):
    return reports.file_hotspots(reports.file_churn(*_recent(x, 60)))


@query
def commit_timeline(x):
    t = reports.ranked(reports.commit_timeline(x.symbols, x.edges, *_recent(x, 30)), list(reports.TIMELINE_ORDER))
    return t.select("rank", "hash", "short_hash", "date", "files_count", "insertions", "deletions", "churn", "touched_symbols", "touched_edges", F.array_join("changed_files", ",").alias("changed_files"))


@query
def symbol_hotspots(x):
    return reports.symbol_hotspots(x.symbols, *_recent(x, 30))


@query
def evolution_totals(x):
    return reports.evolution_totals(*_recent(x, 30))


@query
def numstat_parse(x):
    commits, _ = gitlog.parse_log(x.log)
    return commits.select("hash", "date", "author", "subject", "files_count", "insertions", "deletions")


@query
def numstat_files(x):
    return gitlog.parse_log(x.log)[1].select("hash", "path", "added", "deleted")


# Hot paths, complexity.


def _hot(x):
    edges = durable(x.edges)
    return edges, reports.hot_scores(x.symbols, edges, reports.file_churn(*_recent(x, 60)))


@query
def hot_path_report(x):
    hot = reports.hot_path(_hot(x)[1])
    return hot.select("rank", "symbol_id", "label", _r("score"), "in_degree", "out_degree", "balance", "reach", "out_reach", "in_reach", "churn", "rationale")


@query
def hot_paths(x):
    edges, scores = _hot(x)
    scores = durable(scores.select("symbol_id", "score", "reach", "label", "in_degree", "out_degree", "balance", "churn"))
    return reports.hot_chains(edges, scores, reports.hot_path(scores)).select("root", "pos", "symbol_id", _r("score"), _r("bottleneck"))


def _graph(x):
    """Symbols, as far as scores need them, and edges: kept, as scores read them several times."""
    return durable(x.symbols.select("symbol_id", "sym_ord", "name", "relpath", "module_id", "package_id")), durable(x.edges)


def _complexity(x):
    return reports.complexity_scores(*_graph(x))


@query
def strong_components(x):
    return scc.strong_components(reports.analyzed(x.symbols, False), durable(x.edges))


@query
def scc_stats(x):
    scores, stats = _complexity(x)
    return reports.top_components(scores, stats).select("rank", "scc_id", "size", "edge_count", _r("density"), "has_cycle", "preview")


@query
def complexity_report(x):
    c = reports.complexity(_complexity(x)[0])
    return c.select("rank", "symbol_id", _r("score"), "severity", "in_degree", "out_degree", "bridge", "scc_size", "in_cycle")


@query
def module_clusters(x):
    rows = reports.ranked(reports.module_clusters(x.symbols, x.edges), reports.cluster_order())
    return rows.select("rank", "module_id", "symbols", "edges", _r("density"))


@query
def complexity_severity_counts(x):
    return reports.severity_counts(reports.complexity(_complexity(x)[0]))


def _structure(x):
    symbols, edges = _graph(x)
    scores, stats = reports.complexity_scores(symbols, edges)
    scores = durable(scores)
    return scores, reports.structural_score(scores, stats, reports.module_clusters(symbols, edges))


@query
def structural_score(x):
    return _structure(x)[1].select(_r("average"), "cyclic_sccs", "largest_cycle", _r("max_density"), _r("structural_score"), "severity")


@query
def complexity_suggestions(x):
    scores, structure = _structure(x)
    return reports.complexity_suggestions(structure, reports.complexity(scores))


# Architecture.


@query
def layer_domain(x):
    return reports.layer_domain(x.symbols, Architecture(include_tests=True)).select("symbol_id", "layer", "domain")


@query
def arch_groups(x):
    return reports.architecture(x.symbols, x.edges)["groups"]


@query
def arch_edges(x):
    rows = reports.architecture(x.symbols, x.edges)["edges"]
    first = F.array_join(F.transform("examples", lambda e: F.concat_ws(">", e["src"].cast("string"), e["dst"].cast("string"))), ",")
    return rows.select("source_group", "target_group", "count", first.alias("examples"))


@query
def arch_violations(x):
    rows = reports.ranked(reports.architecture(x.symbols, x.edges)["violations"], reports.violation_order())
    return rows.select("rank", "source_group", "target_group", "source_layer", "target_layer", "count", "severity_score", "severity")


@query
def arch_severity_counts(x):
    return reports.architecture(x.symbols, x.edges)["severities"]


# Risk.


def _risk(x, edges=None):
    # The commits are not kept: by their limit Spark knows them to be few, and files are filtered before they are summed.
    churn = reports.file_churn(reports.latest(x.commits, 60), x.files)
    return reports.risk_scores(x.symbols, durable(x.edges) if edges is None else edges, churn)


@query
def risk_map(x):
    return reports.risk_map(_risk(x)).select("rank", "symbol_id", _r("score"), "severity", _r("hot_score"), _r("complexity_score"), "architecture_hits", "churn")


@query
def risk_severity_counts(x):
    return reports.severity_counts(reports.risk_map(_risk(x)))


def _group_risk(x, level):
    return reports.ranked(reports.group_risk(_risk(x), level), reports.group_risk_order()).select("rank", "id", _r("score"), "count", _r("avg_score"))


@query
def module_risk(x):
    return _group_risk(x, "module")


@query
def package_risk(x):
    return _group_risk(x, "package")


@query
def risk_trend(x):
    """Against a baseline in which even ids scored 0.9 of today's."""
    now = durable(reports.risk_map(_risk(x)).select("rank", "symbol_id", "score"))
    old = reports.ranked(now.filter("symbol_id % 2 = 0").select("symbol_id", (F.col("score") * 0.9).alias("score")), [F.col("score").desc(), F.col("symbol_id")])
    return reports.risk_trend(now, old).select(_r("avg_top_score_delta"), _r("top1_score_delta"), "top_overlap_count", _r("top_overlap_ratio"))


@query
def risk_suggestions(x):
    symbols, edges = _graph(x)
    bad = reports.architecture(symbols, edges, Risk().architecture)["violations"]
    return reports.risk_suggestions(bad, reports.risk_map(_risk(x, edges)))


# Knowledge graph, imports.


def _knowledge(x):
    symbols, sites, outside = _beside(x)
    # The targets stay dealt by caller until they are edges; nothing else reads them, so they are not kept.
    chosen = resolve.targets(resolve.likely_merged(symbols, sites, x.receiver_types, outside))
    # Of all candidates only those without a symbol become nodes and edges.
    alone = durable(resolve.unindexed(outside, sites).select("src", "call_ord", "cand_id", "cand_name", "cand_path", "call_name", "source", "score", "confidence"))
    return knowledge.build(x.symbols, None, chosen, None, alone, imports.graph(x.sources))


@query
def kg_nodes(x):
    return _knowledge(x)[0].select("id", "type", "label", "relpath", "module_id", "package_id", "external")


@query
def kg_edges(x):
    return _knowledge(x)[1].select("type", "source", "target", "source_backend", "confidence", "dynamic", "polymorphic", "call", "external")


@query
def kg_edge_type_counts(x):
    return knowledge.edge_type_counts(_knowledge(x)[2])


@query
def kg_counts(x):
    nodes, edges, _ = _knowledge(x)
    return knowledge.counts(nodes, edges)


@query
def kg_validation(x):
    """Without its packages, and under another schema version."""
    nodes, edges, _ = _knowledge(x)
    return knowledge.validate(nodes.filter("type != 'package'"), edges, "knowledge_graph.v0")


@query
def import_tokens(x):
    return imports.tokens(x.sources).select("relpath", "token")


@query
def import_edges(x):
    return imports.graph(x.sources)


@query
def import_reverse(x):
    edges = graphs.transpose(imports.graph(x.sources))
    return edges.groupBy(F.col("src").alias("file")).agg(F.count(F.lit(1)).alias("importers"))


# Layouts.


@query
def layout_hierarchical(x):
    return layout.hierarchical(_around(x, 3)[3])


@query
def layout_force(x):
    _, _, _, nodes, edges = _around(x)
    return layout.force(nodes, edges)


# Extraction: the symbols written out as source files and read back.


def _written(x):
    body = F.concat(F.lit("function "), F.col("name"), F.lit("(a)\n  -- end {\n  return other."), F.col("short_name"), F.lit("(a, 'end')\nend\n"))
    rows = x.symbols.select("relpath", "lang", "sym_ord", body.alias("body"))
    return rows.groupBy("relpath", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sym_ord", "body"))), lambda r: r["body"]), "").alias("content"))


@query
def extract_functions(x):
    rows = extract.extract_files(_written(x))
    return rows.select("relpath", "name", "short_name", "container", "symbol_kind", "sr", "sc", "er", "ec")


@query
def extract_calls(x):
    _, calls, _ = extract.tables(extract.extract_files(_written(x)))
    return calls.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


# The same results through the index facade.


def _facade(x):
    none = x.spark.createDataFrame([], "src bigint, call_ord int, cand_id bigint")
    return CodeIndex(x.symbols, none, x.receiver_types, none, none, durable(x.edges), x.sources, history=(x.commits, x.files))


@query
def api_build(x):
    """A table of files to symbols, built, saved as tables and built again."""
    index = CodeIndex.build(x.spark, files=_written(x)).refresh(x.spark)
    return index.symbols.select("relpath", "name", "short_name", "container", "symbol_kind", "sr", "sc", "er", "ec")


@query
def api_run(x):
    """From symbols and calls to the edges of the project graph."""
    return CodeIndex.assemble(x.symbols, x.calls, x.receiver_types, x.sources).edges.select("src", "dst", "edge_ord")


@query
def api_project_graph(x):
    index = CodeIndex.assemble(x.symbols, x.calls, x.receiver_types, x.sources)
    return index.call_graph(busiest(index.edges, "src"), 2)[2].select("src", "dst", "n_calls", F.array_join("calls", ",").alias("calls"))


@query
def api_module_graph(x):
    return _facade(x).module_graph()


@query
def api_package_graph(x):
    return _facade(x).package_graph()


@query
def api_import_graph(x):
    return _facade(x).import_graph()


@query
def api_dead_code(x):
    return reports.ranked(_facade(x).dead_code().select("symbol_id", "relpath", "name"), list(reports.DEAD_ORDER))


@query
def api_impact(x):
    index = _facade(x)
    return index.impact(busiest(index.edges, "dst"), 8).select("symbol_id", "depth")


@query
def api_hot_path(x):
    hot, _ = _facade(x).hot_path()
    return hot.select("rank", "symbol_id", "label", _r("score"), "in_degree", "out_degree", "balance", "reach", "out_reach", "in_reach", "churn", "rationale")


@query
def api_complexity(x):
    c = _facade(x).complexity()["hotspots"]
    return c.select("rank", "symbol_id", _r("score"), "severity", "in_degree", "out_degree", "bridge", "scc_size", "in_cycle")


@query
def api_architecture(x):
    rows = reports.ranked(_facade(x).architecture()["violations"], reports.violation_order())
    return rows.select("rank", "source_group", "target_group", "source_layer", "target_layer", "count", "severity_score", "severity")


@query
def api_evolution(x):
    return _facade(x).evolution()["totals"]


@query
def api_risk_map(x):
    top = _facade(x).risk_map()["risk_hotspots"]
    return top.select("rank", "symbol_id", _r("score"), "severity", _r("hot_score"), _r("complexity_score"), "architecture_hits", "churn")


@query
def api_viewer(x):
    index = _facade(x)
    session = index.view(busiest(index.edges, "src"), depth=4, search="brand", kind="function")
    return session.query(index.symbols, index.edges)[2]


# Drawings and documents, as lines.


def _lines(x, lines):
    return x.spark.createDataFrame(list(enumerate(lines)), "line_no int, text string")


def _drawing(x, options=Layout()):
    symbols, _, root, nodes, edges = _around(x)
    return export.payload(symbols, durable(nodes), durable(edges), options=options, direction="outgoing", depth_limit=2, root_id=root)


@query
def export_dot(x):
    return _lines(x, export.to_dot(_drawing(x)).splitlines())


@query
def export_dot_force(x):
    return _lines(x, export.to_dot(_drawing(x, Layout(algorithm="force"))).splitlines())


@query
def export_mermaid(x):
    return _lines(x, export.to_mermaid(_drawing(x)).splitlines())


@query
def export_json(x):
    return _lines(x, [export.to_json(_drawing(x))])


@query
def kg_lines(x):
    nodes, edges, _ = _knowledge(x)
    return export.knowledge_lines(nodes, edges, {"schema_version": knowledge.SCHEMA_VERSION}).select("part", "value")


@query
def render_hot_path(x):
    edges, scores = _hot(x)
    scores = durable(scores)
    hot = durable(reports.hot_path(scores))
    return _lines(x, documents.hot_path(hot, reports.hot_chains(edges, scores, hot)))


@query
def render_architecture(x):
    return _lines(x, documents.architecture(reports.architecture(x.symbols, x.edges)))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: hot paths with degrees, reach and churn."""
    return QUERIES["hot_path_report"](spark, sf_dir)
