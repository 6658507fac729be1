"""Strongly connected components.

Large graphs: trim nodes without callers or callees, colour the rest by the
largest id that reaches them (a colour also takes over the colour of its own
node, so the reach doubles each round), and take from each colour's root what
also reaches the root; repeat on what is left. Graphs of a checked, bounded size
are done by one task with an iterative Tarjan search instead, and so is what is
left of a large one as soon as it is that small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Edges up to which one task may hold the graph (16 bytes each).
ONE_TASK_EDGES = 500_000
MAX_ROUNDS = 500


def tarjan(edges: list[tuple]) -> list[list]:
    """Components of the nodes that have an edge, without recursion."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number, low, on_stack, stack, out = {}, {}, set(), [], []
    for start in after:
        if start in number:
            continue
        work = [(start, iter(after[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on_stack.add(start)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    stack.append(to)
                    on_stack.add(to)
                    work.append((to, iter(after[to])))
                    break
                if to in on_stack:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on_stack.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    out.append(part)
    return out


def _tarjan_group(rows: pd.DataFrame) -> pd.DataFrame:
    found = tarjan(list(zip(rows["src"].tolist(), rows["dst"].tolist())))
    return pd.DataFrame([(x, least) for part, least in zip(found, map(min, found)) for x in part], columns=["symbol_id", "scc_id"])


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    return edges.groupBy(F.lit(0).alias("g")).applyInPandas(lambda rows: _tarjan_group(rows), f"symbol_id {kind}, scc_id {kind}")


def _by_colour(edges: DataFrame, one_task: int) -> DataFrame | None:
    """(symbol_id, scc_id) of components of more than one node, and of some with one."""
    left, found = durable(edges.filter("src != dst").distinct()), None
    for _ in range(MAX_ROUNDS):
        before = left.count()
        while True:
            cut = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            cut = durable(cut)
            n = cut.count()
            left, stopped = cut, n == before
            before = n
            if stopped or n <= one_task:
                break
        if not before:
            return found
        if before <= one_task:
            # Whole components were taken out, so those of the rest are the graph's.
            part = _in_one_task(left)
            return part if found is None else found.unionByName(part)
        colour = durable(left.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        mark = None
        for _ in range(MAX_ROUNDS):
            pushed = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("c"))
            colour = colour.join(pushed, "id", "left").select("id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"))
            # What reaches the node that names a colour reaches all that have the colour.
            jump = colour.select(F.col("id").alias("colour"), F.col("colour").alias("c"))
            colour = durable(durable(colour).join(jump, "colour").select("id", F.greatest("colour", "c").alias("colour")))
            now = colour.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(38,0)"))).first()[0]
            if now == mark:
                break
            mark = now
        else:
            raise RuntimeError("colours did not settle")
        inside = left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst", F.col("a").alias("colour"))
        inside = durable(inside)
        seen = durable(colour.filter("id = colour"))
        front = seen
        while True:
            back = inside.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = durable(back.join(seen.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
            seen = durable(seen.unionByName(front))
        part = seen.select(F.col("id").alias("symbol_id"), F.col("colour").alias("scc_id"))
        found = part if found is None else found.unionByName(part)
        done = seen.select("id")
        left = durable(left.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    raise RuntimeError("components did not settle")


def strong_components(symbols: DataFrame, edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(symbol_id, scc_id) of every symbol; scc_id is the smallest id of its component."""
    ids = symbols.select("symbol_id")
    inner = edges.select("src", "dst").join(ids.withColumnRenamed("symbol_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi")
    inner = durable(inner.select("src", "dst"))
    if inner.count() <= one_task:
        found = _in_one_task(inner)
    else:
        found = _by_colour(inner, one_task)
        if found is not None:
            least = found.groupBy("scc_id").agg(F.min("symbol_id").alias("least"))
            found = found.join(least, "scc_id").select("symbol_id", F.col("least").alias("scc_id"))
    if found is None:
        return ids.withColumn("scc_id", F.col("symbol_id"))
    return ids.join(found, "symbol_id", "left").select("symbol_id", F.coalesce("scc_id", "symbol_id").alias("scc_id"))


def component_stats(components: DataFrame, edges: DataFrame) -> DataFrame:
    """scc_id, size, edge_count, density, has_cycle."""
    size = components.groupBy("scc_id").agg(F.count(F.lit(1)).alias("size"))
    a, b = components.toDF("src", "scc_id"), components.toDF("dst", "other")
    own = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("scc_id = other")
    inner = own.groupBy("scc_id").agg(F.count(F.lit(1)).alias("edge_count"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("loop"))
    out = size.join(inner, "scc_id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0).cast("bigint")))
    return out.select("scc_id", "size", "edge_count", (F.col("edge_count") / F.greatest(F.lit(1), F.col("size") * (F.col("size") - 1))).alias("density"), ((F.col("size") > 1) | (F.coalesce("loop", F.lit(0)) == 1)).alias("has_cycle"))
