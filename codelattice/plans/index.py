"""The index: tables of a source tree, and one method for each report."""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, imports, knowledge, reports, resolve, traverse, viewer
from ..operators.durable import durable
from ..options import Architecture, Complexity, DeadCode, Evolution, HotPath, Knowledge, Layout, Resolution, Risk
from ..sinks import export as sink
from ..sources import extract, files as sources, gitlog
from ..streaming import refresh


@dataclass
class CodeIndex:
    symbols: DataFrame
    sites: DataFrame
    receiver_types: DataFrame
    candidates: DataFrame
    targets: DataFrame | None = field(repr=False)
    edges: DataFrame | None = field(repr=False)
    files: DataFrame
    resolution: Resolution = Resolution()
    root: str | None = None
    history: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False)

    # Building.

    def __post_init__(self):
        for name in ("targets", "edges"):
            if self.__dict__[name] is None:
                del self.__dict__[name]

    def __getattr__(self, name: str) -> DataFrame:
        """Targets and edges that were not given are computed when they are first read, and kept."""
        if name == "targets":
            table = resolve.targets(resolve.likely_candidates(self.symbols, self.sites, self.receiver_types, self.resolution), self.resolution)
        elif name == "edges":
            table = resolve.resolved_edges(self.symbols, self.targets)
        else:
            raise AttributeError(name)
        self.__dict__[name] = durable(table)
        return self.__dict__[name]

    def _with(self, **changes) -> CodeIndex:
        """A copy; unlike ``dataclasses.replace`` it reads no table."""
        out = copy(self)
        out.__dict__.update(changes)
        return out

    @classmethod
    def build(cls, spark: SparkSession, root: str | None = None, files: DataFrame | None = None, resolution: Resolution = Resolution()) -> CodeIndex:
        """Index a source tree, or a table of files (relpath, lang, content)."""
        if files is None:
            files = sources.scan(spark, root)
        files = files.select("relpath", "lang", "content")
        symbols, calls, types = extract.tables(durable(extract.extract_files(files)))
        return cls.assemble(symbols, calls, types, files, resolution, root)

    @classmethod
    def assemble(cls, symbols, calls, types, files, resolution=Resolution(), root=None) -> CodeIndex:
        symbols = durable(symbols)
        sites = durable(resolve.call_sites(calls))
        # All candidates are only needed, and only then computed, to merge outside sources.
        cands = resolve.candidates(symbols, sites, types)
        return cls(symbols, sites, types, cands, None, None, files, resolution, root)

    def refresh(self, spark: SparkSession) -> CodeIndex:
        return CodeIndex.build(spark, self.root, None if self.root else self.files, self.resolution)

    def watch(self, spark: SparkSession, checkpoint: str, done, every: str = "10 seconds"):
        """Build anew whenever files below the root are new, edited or gone; ``done(index)`` gets each index."""
        held = {"files": self.files}

        def rebuild(fresh, gone, turn):
            base = held["files"] if turn else fresh.select("relpath", "lang", "content").limit(0)
            held["files"] = durable(refresh.changed(base, fresh, gone))
            done(CodeIndex.build(spark, files=held["files"], resolution=self.resolution)._with(root=self.root))

        return refresh.watch(spark, self.root, rebuild, checkpoint, every)

    def merge_external(self, external: DataFrame) -> CodeIndex | None:
        """With an outside call source (src, name, path) merged in; None if nothing matched."""
        outside = resolve.external_candidates(self.symbols, external)
        merged = durable(resolve.merge_external(self.candidates, outside, self.sites))
        if merged.filter("source != 'index'").isEmpty():
            return None
        chosen = durable(resolve.targets(resolve.leading(merged, self.resolution), self.resolution))
        return self._with(candidates=merged, targets=chosen, edges=durable(resolve.resolved_edges(self.symbols, chosen)))

    def with_history(self, commits: DataFrame, files: DataFrame) -> CodeIndex:
        return self._with(history=(commits, files))

    def read_history(self, spark: SparkSession, limit: int = 60, **options) -> CodeIndex:
        commits, files = gitlog.parse_log(gitlog.read_log(spark, gitlog.repo_root(self.root), limit, **options))
        return self.with_history(commits.withColumn("is_merge", F.lit(False)), files)

    # Lookups.

    def symbol_id(self, name: str) -> str | None:
        """The first symbol of that name or short name."""
        row = self.symbols.filter((F.col("name") == name) | (F.col("short_name") == name)).orderBy("sym_ord").select("symbol_id").first()
        return row[0] if row else None

    def symbol_at(self, relpath: str, row: int, col: int) -> str | None:
        point = self.symbols.sparkSession.createDataFrame([(relpath, row, col)], "relpath string, row int, col int")
        hit = graphs.symbol_at(self.symbols, point).first()
        return hit["symbol_id"] if hit else None

    def resolutions(self) -> DataFrame:
        return resolve.resolutions(self.sites, self.targets)

    def unresolved_count(self) -> int:
        return self.resolutions().filter("unresolved").count()

    def local_functions(self, relpath: str) -> DataFrame:
        return self.symbols.filter(F.col("relpath") == relpath).orderBy("sym_ord")

    def local_graph(self, relpath: str) -> DataFrame:
        inside = self.symbols.filter(F.col("relpath") == relpath)
        return graphs.local_graph(inside, self.sites)

    # Graphs.

    def call_graph(self, root, depth: int = 2, direction: str = "outgoing") -> tuple[DataFrame, DataFrame, DataFrame]:
        """nodes, edges, annotations; nodes and edges are kept, as all drawings use them."""
        nodes, edges = traverse.subgraph(self.symbols, self.edges, root, depth, direction)
        nodes, edges = durable(nodes), durable(edges)
        return nodes, edges, traverse.edge_annotations(nodes, self.targets)

    def module_graph(self, level: str = "module") -> DataFrame:
        return graphs.roll_up(self.symbols, self.edges, level)

    def package_graph(self) -> DataFrame:
        return self.module_graph("package")

    def call_hierarchy(self, calls: DataFrame, root, depth: int = 2, direction: str = "outgoing", inside=None, include_external: bool = False):
        """nodes, edges of an outside call source's answers (src, dst, src_path, dst_path) around a root."""
        nodes, edges = traverse.call_hierarchy(calls, root, depth, direction, inside, include_external)
        return durable(nodes), durable(edges)

    def import_graph(self, direction: str = "outgoing") -> DataFrame:
        return graphs.oriented(imports.graph(self.files), direction)

    def dependency_graph(self, edges: DataFrame, root: str, depth: int = 2, direction: str = "outgoing"):
        return traverse.dependency_subgraph(edges, root, depth, direction)

    def view(self, root, **filters) -> viewer.Session:
        return viewer.Session(root=root, **filters)

    # Reports.

    def _churn(self, limit: int = 60, since: str | None = None) -> DataFrame:
        if self.history is None:
            return self.symbols.sparkSession.createDataFrame([], "path string, churn bigint, touches bigint")
        commits, files = self.history
        return reports.file_churn(reports.latest(commits, limit, since=since), files)

    def dead_code(self, options: DeadCode = DeadCode()) -> DataFrame:
        return graphs.dead_code(self.symbols, self.edges, options).orderBy("relpath", "name")

    def impact(self, root, depth: int = 6) -> DataFrame:
        return reports.impact(self.symbols, self.edges, root, depth)

    def hot_path(self, options: HotPath = HotPath()) -> tuple[DataFrame, DataFrame]:
        """hotspots and chains."""
        scores = durable(reports.hot_scores(self.symbols, self.edges, self._churn(options.churn_limit, options.churn_since), options))
        hot = durable(reports.hot_path(scores, options))
        return hot, reports.hot_chains(self.edges, scores, hot, options)

    def complexity(self, options: Complexity = Complexity()) -> dict[str, DataFrame]:
        scores, stats = reports.complexity_scores(self.symbols, self.edges, options)
        scores = durable(scores)
        top, clusters = reports.complexity(scores, options), reports.module_clusters(self.symbols, self.edges, options.include_tests)
        structure = durable(reports.structural_score(scores, stats, clusters, options))
        return {"hotspots": top, "components": reports.top_components(scores, stats, options.scc_limit), "clusters": clusters, "structure": structure, "severities": reports.severity_counts(top), "suggestions": reports.complexity_suggestions(structure, top, options)}

    def architecture(self, options: Architecture = Architecture()) -> dict[str, DataFrame]:
        return reports.architecture(self.symbols, self.edges, options)

    def evolution(self, options: Evolution = Evolution()) -> dict[str, DataFrame]:
        if self.history is None:
            raise ValueError("history is required")
        return reports.evolution(self.symbols, self.edges, *self.history, options)

    def risk_map(self, options: Risk = Risk(), baseline: DataFrame | str | None = None) -> dict[str, DataFrame]:
        scores = durable(reports.risk_scores(self.symbols, self.edges, self._churn(options.churn_limit, options.churn_since), options))
        top = durable(reports.risk_map(scores, options))
        bad = reports.architecture(self.symbols, self.edges, options.architecture)["violations"]
        out = {"risk_hotspots": top, "modules": reports.group_risk(scores, "module"), "packages": reports.group_risk(scores, "package"), "severities": reports.severity_counts(top), "suggestions": reports.risk_suggestions(bad, top, options)}
        if isinstance(baseline, str):
            # A snapshot that cannot be read is reported beside the map, it does not stop it.
            try:
                baseline = durable(sources.baseline(self.symbols.sparkSession, baseline))
            except Exception as e:
                out["trend_error"] = self.symbols.sparkSession.createDataFrame([(str(e).splitlines()[0],)], "error string")
                return out
        if baseline is not None:
            out["trend"] = reports.risk_trend(top.select("rank", "symbol_id", "score"), baseline)
        return out

    def knowledge(self, options: Knowledge = Knowledge()) -> dict[str, DataFrame]:
        nodes, edges, records = knowledge.build(self.symbols, self.edges, self.targets, self.resolutions(), self.candidates, imports.graph(self.files), options)
        nodes, edges = durable(nodes), durable(edges)
        return {"nodes": nodes, "edges": edges, "counts": knowledge.counts(nodes, edges), "edge_types": knowledge.edge_type_counts(records), "problems": knowledge.validate(nodes, edges)}

    def export(self, root, kind: str, path: str | None = None, depth: int = 2, direction: str = "outgoing", layout: Layout = Layout()) -> str:
        nodes, edges, notes = self.call_graph(root, depth, direction)
        graph = sink.payload(self.symbols, nodes, edges, notes, layout, direction=direction, depth_limit=depth, root_id=root)
        return sink.export(graph, kind, path or sink.default_path(str(root), kind))

    def save(self, path: str) -> None:
        """The tables as Parquet below ``path``."""
        for name in ("symbols", "sites", "receiver_types", "candidates", "targets", "edges", "files"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> CodeIndex:
        read = {n: spark.read.parquet(f"{path}/{n}") for n in ("symbols", "sites", "receiver_types", "candidates", "targets", "edges", "files")}
        return cls(**read, **options)
