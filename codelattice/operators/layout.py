"""Positions of a subgraph's nodes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import Layout


def hierarchical(nodes: DataFrame, options: Layout = Layout()) -> DataFrame:
    """symbol_id, depth, layer_index, x, y from nodes with their BFS depth.

    Nodes without a depth go one layer below the deepest.
    """
    deepest = nodes.agg((F.coalesce(F.max("depth"), F.lit(0)) + 1).alias("last"))
    placed = nodes.crossJoin(deepest).withColumn("depth", F.coalesce("depth", "last")).drop("last")  # one row
    layer = Window.partitionBy("depth")
    i, n = F.row_number().over(layer.orderBy("symbol_id")), F.count(F.lit(1)).over(layer)
    placed = placed.withColumn("layer_index", i).withColumn("n", n)
    y = (F.col("layer_index") - 1) * float(options.spacing_y) - (F.col("n") - 1) * float(options.spacing_y) / 2
    return placed.select("symbol_id", "depth", "layer_index", (F.col("depth") * float(options.spacing_x)).alias("x"), y.alias("y"))


def force_positions(ids: list, pairs: list[tuple[int, int]], options: Layout = Layout()) -> np.ndarray:
    """(n, 2) positions by repulsion of all pairs and attraction along edges, from a circle."""
    n = len(ids)
    w, h = float(options.width), float(options.height)
    if n == 0:
        return np.zeros((0, 2))
    k = math.sqrt(w * h / n)
    turn = 2 * math.pi * np.arange(n) / n
    at = np.stack([w / 2 + 0.35 * min(w, h) * np.cos(turn), h / 2 + 0.35 * min(w, h) * np.sin(turn)], axis=1)
    speed = np.zeros((n, 2))
    a = np.array([p[0] for p in pairs], np.int64)
    b = np.array([p[1] for p in pairs], np.int64)
    for _ in range(options.iterations):
        gap = at[:, None, :] - at[None, :, :]
        dist = np.maximum(np.sqrt((gap**2).sum(axis=2)), 0.01)
        np.fill_diagonal(dist, np.inf)
        force = (gap / dist[:, :, None] * (k * k / dist)[:, :, None]).sum(axis=1)
        if len(a):
            pull = at[a] - at[b]
            d = np.maximum(np.sqrt((pull**2).sum(axis=1)), 0.01)[:, None]
            drag = pull / d * (d * d / k)
            np.add.at(force, a, -drag)
            np.add.at(force, b, drag)
        speed = (speed + 0.01 * force) * 0.85
        at = np.clip(at + speed, [0, 0], [w, h])
    return at


def force(nodes: DataFrame, edges: DataFrame, options: Layout = Layout()) -> DataFrame:
    """symbol_id, x, y. A drawing holds few nodes: they are placed by one task."""
    kind = nodes.schema["symbol_id"].dataType.simpleString()
    one = F.lit(0).alias("g")

    def place(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(own["symbol_id"].tolist())
        number = {x: i for i, x in enumerate(ids)}
        pairs = sorted((number[x], number[y]) for x, y in zip(links["src"], links["dst"]) if x in number and y in number and x != y)
        at = force_positions(ids, pairs, options)
        return pd.DataFrame({"symbol_id": ids, "x": at[:, 0], "y": at[:, 1]})

    return nodes.select(one, "symbol_id").groupBy("g").cogroup(edges.select(one, "src", "dst").groupBy("g")).applyInPandas(place, f"symbol_id {kind}, x double, y double")


def place(nodes: DataFrame, edges: DataFrame, options: Layout = Layout()) -> DataFrame:
    if options.algorithm in ("force", "force_directed"):
        return force(nodes, edges, options).join(nodes.select("symbol_id", "depth"), "symbol_id").withColumn("layer_index", F.lit(None).cast("int"))
    return hierarchical(nodes, options)
