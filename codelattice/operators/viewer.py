"""The interactive viewer's queries, without its screen."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import traverse


def keeps(path_prefix: str | None = None, search: str | None = None, kind: str = "all") -> Column:
    """The viewer's filter over relpath, name, symbol_kind."""
    out = F.lit(True)
    if path_prefix:
        out = out & F.col("relpath").startswith(path_prefix)
    if search:
        out = out & F.lower(F.concat_ws(" ", "name", "relpath")).contains(search.lower())
    if kind in ("method", "function"):
        out = out & (F.lower(F.coalesce("symbol_kind", F.lit("Function"))) == kind)
    return out


@dataclass(frozen=True)
class Session:
    """A focus with its history, and the filters; every change is a new session."""

    root: object
    depth: int = 3
    direction: str = "outgoing"
    search: str = ""
    path_prefix: str = ""
    dynamic_only: bool = False
    kind: str = "all"
    history: tuple = ()
    position: int = 0
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        if not self.history:
            object.__setattr__(self, "history", (self.root,))

    def focus(self, root) -> Session:
        """Look at another symbol; what was ahead in the history goes."""
        if root == self.root:
            return self
        past = self.history[: self.position + 1] + (root,)
        return replace(self, root=root, history=past, position=len(past) - 1)

    def pan(self, step: int) -> Session:
        at = min(max(0, self.position + step), len(self.history) - 1)
        return replace(self, root=self.history[at], position=at)

    def deeper(self, step: int) -> Session:
        return replace(self, depth=max(0, self.depth + step))

    def where(self, **filters) -> Session:
        return replace(self, **filters)

    def query(self, symbols: DataFrame, edges: DataFrame, notes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """nodes, edges, and one row with total_nodes and hidden_nodes."""
        key = (self.root, self.depth, self.direction, self.search, self.path_prefix, self.dynamic_only, self.kind)
        if key not in self._cache:
            self._cache.clear()
            nodes, links = traverse.subgraph(symbols, edges, self.root, self.depth, self.direction)
            keep = symbols.join(nodes.select("symbol_id"), "symbol_id", "left_semi").filter(keeps(self.path_prefix, self.search, self.kind))
            kept, inner = traverse.filtered_subgraph(nodes, links, self.root, keep)
            if self.dynamic_only and notes is not None:
                inside = notes.join(kept.select(F.col("symbol_id").alias("src")), "src", "left_semi").join(kept.select(F.col("symbol_id").alias("dst")), "dst", "left_semi")
                kept, inner = traverse.dynamic_only(kept, inner, inside, self.root)
            total = nodes.agg(F.count(F.lit(1)).alias("total_nodes")).crossJoin(kept.agg(F.count(F.lit(1)).alias("n")))
            self._cache[key] = (kept, inner, total.select("total_nodes", (F.col("total_nodes") - F.col("n")).alias("hidden_nodes")))
        return self._cache[key]

    def neighbour(self, edges: DataFrame):
        """The smallest id next to the root in the session's direction, or None."""
        a, b = ("dst", "src") if self.direction == "incoming" else ("src", "dst")
        return edges.filter(F.col(a) == F.lit(self.root)).agg(F.min(b)).first()[0]


def search_lines(lines: list[str], query: str) -> list[int]:
    """Numbers of the lines that hold the query, any case."""
    return [i for i, line in enumerate(lines) if query and query.lower() in line.lower()]


def next_match(matches: list[int], line: int, step: int = 1) -> int | None:
    """The next (or previous) match from a line, around the end."""
    if not matches:
        return None
    if step >= 0:
        return next((m for m in matches if m > line), matches[0])
    return next((m for m in reversed(matches) if m < line), matches[-1])
