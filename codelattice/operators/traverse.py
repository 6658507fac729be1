"""Graph traversals: loops over frontiers, each level a join and a distinct.

Only ids move. Level by level the frontier is checkpointed, so plans stay
small and a lost executor costs one level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .graphs import oriented


#: Roots whose reach is held at one time.
ROOTS_AT_ONCE = 10_000_000


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def levels(edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """(root, id, depth): ids that a walk of exactly ``depth`` steps reaches, depth <= limit.

    ``roots``: (root). An id appears once for each depth at which it is met.
    """
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    now = roots.select("root", F.col("root").alias("id"))
    out = [now.withColumn("depth", F.lit(0))]
    for depth in range(1, limit + 1):
        now = durable(now.join(step, "id").select("root", F.col("next").alias("id")).distinct())
        if now.isEmpty():
            break
        out.append(now.withColumn("depth", F.lit(depth)))
    return _union(out)


def reach(edges: DataFrame, roots: DataFrame, limit: int | None) -> DataFrame:
    """(root, id, depth): each id within ``limit`` steps (any number if None), at its least depth, the root at 0."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    now = roots.select("root", F.col("root").alias("id"))
    seen, depth = now.withColumn("depth", F.lit(0)), 0
    while limit is None or depth < limit:
        depth += 1
        fresh = now.join(step, "id").select("root", F.col("next").alias("id")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti")
        now = durable(fresh)
        if now.isEmpty():
            break
        seen = seen.unionByName(now.withColumn("depth", F.lit(depth)))
        if depth % 16 == 0:
            seen = durable(seen)
    return seen


def counts_ahead(edges: DataFrame, limit: int, at_once: int = ROOTS_AT_ONCE) -> DataFrame:
    """(root, n): how many other ids each id reaches within ``limit`` steps.

    Roots are taken in blocks of ``at_once`` at most, of which only the counts
    are kept. A pair is expanded once, at the depth at which it is first met;
    a level is one join and one aggregation with the pairs met before.
    """
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    roots = durable(edges.select(F.col("src").alias("root")).distinct())
    blocks, parts = max(1, -(-roots.count() // at_once)), []
    for block in range(blocks):
        mine = roots if blocks == 1 else roots.filter(F.pmod(F.xxhash64("root"), F.lit(blocks)) == block)
        seen = mine.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"))
        for depth in range(1, limit + 1):
            fresh = seen.filter(F.col("depth") == depth - 1).join(step, "id").select("root", F.col("next").alias("id"), F.lit(depth).alias("depth"))
            seen = durable(seen.unionByName(fresh).groupBy("root", "id").agg(F.min("depth").alias("depth")))
        parts.append(durable(seen.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("n"))) if blocks > 1 else seen.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("n")))
    return _union(parts)


def reach_counts(symbols: DataFrame, edges: DataFrame, limit: int = 4) -> DataFrame:
    """symbol_id, out_reach, in_reach: distinct symbols within ``limit`` steps, without the symbol itself."""
    out = symbols.select("symbol_id")
    zero = F.lit(0).cast("bigint")
    for direction, name in (("outgoing", "out_reach"), ("incoming", "in_reach")):
        e = oriented(edges, direction)
        out = out.join(counts_ahead(e, limit).toDF("symbol_id", name), "symbol_id", "left").withColumn(name, F.coalesce(name, zero))
    return out


def subgraph(symbols: DataFrame, edges: DataFrame, root, limit: int = 2, direction: str = "outgoing") -> tuple[DataFrame, DataFrame]:
    """Nodes (symbol_id, depth) and edges (src, dst, multiplicity) around a root.

    A node met at k depths below the limit contributes its edges k times; that
    is the multiplicity. Ends that are no symbols stay in the edges only.
    """
    step = oriented(edges, direction)
    root_row = symbols.filter(F.col("symbol_id") == F.lit(root)).select(F.col("symbol_id").alias("root"))
    # Walks go on from symbols only.
    inner = step.join(symbols.select(F.col("symbol_id").alias("src")), "src", "left_semi")
    met = durable(levels(inner, root_row, limit))
    nodes = met.groupBy(F.col("id").alias("symbol_id")).agg(F.min("depth").alias("depth")).join(symbols.select("symbol_id"), "symbol_id", "left_semi")
    below = met.filter(F.col("depth") < limit).groupBy(F.col("id").alias("src")).agg(F.count(F.lit(1)).alias("multiplicity"))
    return nodes, inner.join(below, "src").select("src", "dst", "multiplicity")


def dependency_subgraph(edges: DataFrame, root: str, limit: int = 2, direction: str = "outgoing") -> tuple[DataFrame, DataFrame]:
    """As ``subgraph``, over module, package or import edges."""
    step = oriented(edges, direction)
    ids = edges.select(F.col("src").alias("symbol_id")).unionByName(edges.select(F.col("dst").alias("symbol_id"))).distinct()
    return subgraph(ids, step, root, limit)


def edge_annotations(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """src, dst, n_calls, calls of polymorphic calls between ``nodes``."""
    many = chosen.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("src", "call_ord"))).filter("n > 1")
    inside = _inside(many, nodes)
    return inside.groupBy("src", F.col("cand_id").alias("dst")).agg(F.count(F.lit(1)).alias("n_calls"), F.transform(F.sort_array(F.collect_list(F.struct("call_ord", "call_name"))), lambda x: x["call_name"]).alias("calls"))


def _inside(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes.select(F.col("symbol_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("symbol_id").alias("cand_id")), "cand_id", "left_semi")


def polymorphic_calls(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: the number of call sites with more than one target among ``nodes``."""
    linked = _inside(chosen, nodes).groupBy("src", "call_ord").agg(F.count(F.lit(1)).alias("n"))
    return linked.agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("bigint").alias("polymorphic_calls"))


def filtered_subgraph(nodes: DataFrame, edges: DataFrame, root, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph of ``keep`` (symbol_id) and the root, cut to what the root still reaches."""
    stay = nodes.join(keep.select("symbol_id").distinct(), "symbol_id", "left_semi").unionByName(nodes.filter(F.col("symbol_id") == F.lit(root))).dropDuplicates(["symbol_id"])
    inner = edges.join(stay.select(F.col("symbol_id").alias("src")), "src", "left_semi").join(stay.select(F.col("symbol_id").alias("dst")), "dst", "left_semi")
    inner, stay = durable(inner), durable(stay)
    met = reach(inner, stay.filter(F.col("symbol_id") == F.lit(root)).select(F.col("symbol_id").alias("root")), None)
    alive = met.select(F.col("id").alias("symbol_id"))
    return stay.join(alive, "symbol_id", "left_semi"), inner.join(alive.withColumnRenamed("symbol_id", "src"), "src", "left_semi")


def dynamic_only(nodes: DataFrame, edges: DataFrame, notes: DataFrame, root) -> tuple[DataFrame, DataFrame]:
    """The root and the ends of annotated (dynamic) edges, with these edges only."""
    ends = notes.select(F.col("src").alias("symbol_id")).unionByName(notes.select(F.col("dst").alias("symbol_id"))).distinct()
    kept = nodes.join(ends, "symbol_id", "left_semi").unionByName(nodes.filter(F.col("symbol_id") == F.lit(root))).dropDuplicates(["symbol_id"])
    return kept, edges.join(notes.select("src", "dst"), ["src", "dst"], "left_semi")


def callers(edges: DataFrame, root, limit: int = 8) -> DataFrame:
    """(symbol_id, depth) of transitive callers; the root itself if a cycle leads back to it."""
    back = oriented(edges, "incoming")
    roots = edges.sparkSession.range(1).select(F.lit(root).cast(edges.schema["src"].dataType).alias("root"))
    met = reach(back, roots, limit)
    out = met.filter("depth > 0").select(F.col("id").alias("symbol_id"), "depth")
    # A caller of the root that the root reaches: back at the root one step later.
    home = met.filter(F.col("depth") < limit).join(edges.filter(F.col("src") == F.lit(root)).select(F.col("dst").alias("id")), "id", "left_semi")
    again = home.agg(F.min("depth").alias("d")).filter("d is not null").select(F.lit(root).cast(edges.schema["src"].dataType).alias("symbol_id"), (F.col("d") + 1).alias("depth"))
    return out.unionByName(again)


def call_hierarchy(calls: DataFrame, root, limit: int = 2, direction: str = "outgoing", inside=None, include_external: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) and distinct edges (src, dst) of an outside call hierarchy around a root.

    ``calls`` (src, dst, and dst_path, src_path where files decide) is what the
    outside source answers: callees by caller. A node is expanded once, at its
    least depth, if that is below ``limit``. Nodes of files for which
    ``inside``, a function of the path column, is false are left out unless
    ``include_external``; the root stays in any case.
    """
    ends = ["src", "dst"] if direction == "outgoing" else ["dst", "src"]
    step = calls
    if inside is not None and not include_external:
        step = step.filter(inside(F.col(f"{ends[1]}_path")))
    step = durable(step.select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")).distinct())
    roots = calls.sparkSession.range(1).select(F.lit(root).cast(calls.schema["src"].dataType).alias("root"))
    met = durable(reach(step, roots, limit))
    nodes = met.select("id", "depth")
    return nodes, step.join(nodes.filter(F.col("depth") < limit).select(F.col("id").alias("src")), "src", "left_semi")


def hot_chains(edges: DataFrame, scores: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, pos, symbol_id, score): from each root on to the best unvisited neighbour.

    ``scores``: symbol_id, score; ids without one count as 0 and may be
    walked. Equal scores: the earlier edge (edge_ord, then id).
    """
    order = F.col("edge_ord") if "edge_ord" in edges.columns else F.lit(0)
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), order.alias("edge_ord"))
    value = scores.select(F.col("symbol_id").alias("next"), F.col("score").alias("next_score"))
    now = roots.select("root", F.col("root").alias("at"), F.array("root").alias("path"))
    best = Window.partitionBy("root").orderBy(F.col("s").desc(), "edge_ord", "next")
    paths = [now]
    for _ in range(max(1, depth) - 1):
        more = now.join(step, "at").filter(~F.array_contains("path", F.col("next"))).join(value, "next", "left").withColumn("s", F.coalesce("next_score", F.lit(0.0)))
        now = durable(more.withColumn("n", F.row_number().over(best)).filter("n = 1").select("root", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")))
        if now.isEmpty():
            break
        paths.append(now)
    longest = _union(paths).groupBy("root").agg(F.max_by("path", F.size("path")).alias("path"))
    out = longest.select("root", F.posexplode("path").alias("pos", "symbol_id")).join(scores.select("symbol_id", F.col("score").cast("double").alias("score")), "symbol_id", "left")
    return out.select("root", "pos", "symbol_id", "score")
