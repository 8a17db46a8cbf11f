"""Force-directed layout: repulsion through a quadtree, attraction along edges, gravity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..shared import drop_saved, reach_workers, save, save_measured
from . import endpoints

#: The deepest level of the tree: 4^7 = 16,384 cells, whatever the number of nodes.
DEEPEST = 7
#: Finest cells a node, up to that, so that nodes that lie close still have cells of their own.
PER_NODE = 16
#: Rounds of a static layout: of graphs above ``MANY`` nodes and of others.
ROUNDS_MANY, ROUNDS_FEW, MANY = 120, 250, 600
#: A step is at most this part of the extent, at the start.
FIRST_STEP = 0.05

Tree = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def tree_of(cell: np.ndarray, mass: np.ndarray, mx: np.ndarray, my: np.ndarray, depth: int) -> Tree:
    """Mass and mass times x and y of all cells, a square array a level, from sums of the finest cells (row * side + column)."""
    side = 1 << depth
    level = tuple(np.bincount(cell, v, side * side).reshape(side, side) for v in (mass, mx, my))
    out = [level]
    for _ in range(depth):
        level = tuple(v[::2, ::2] + v[1::2, ::2] + v[::2, 1::2] + v[1::2, 1::2] for v in level)
        out.append(level)
    return out[::-1]


def repulsion(x: np.ndarray, y: np.ndarray, mass: np.ndarray, tree: Tree, x0: float, y0: float, extent: float, scaling: float) -> tuple[np.ndarray, np.ndarray]:
    """Forces on points: scaling * mass * mass' * d / (|d|^2 + 1), summed over the cells of a tree.

    From level to level, a cell is taken as one point where a cell of its size lies between it and the point's own (and its
    parent didn't count yet); what is nearer is left to the next level. Of the finest cells those beside the point and its
    own (without the point) count too. That is 27 cells a level and nine at last, however many points there are.
    """
    fx, fy = np.zeros(len(x)), np.zeros(len(x))
    depth = len(tree) - 1
    for level in range(1, depth + 1):
        side, wide = 1 << level, (1 << level) + 4
        m, sx, sy = tree[level]
        held = np.where(m > 1e-9, m, 0.0)
        safe = np.where(held > 0, m, 1.0)
        # two rows and columns of empty cells around: what lies outside pushes nothing
        weight, cx, cy = (np.pad(v, 2).ravel() for v in (held, np.where(held > 0, sx / safe, 0.0), np.where(held > 0, sy / safe, 0.0)))
        ix = np.clip(((x - x0) / extent * side).astype(np.int64), 0, side - 1)
        iy = np.clip(((y - y0) / extent * side).astype(np.int64), 0, side - 1)
        for odd_x in range(2):  # points at the same place in their parent see cells at the same offsets
            for odd_y in range(2):
                of = np.flatnonzero((ix & 1 == odd_x) & (iy & 1 == odd_y))
                if not len(of):
                    continue
                px, py, own = x[of], y[of], (iy[of] + 2) * wide + ix[of] + 2
                gx, gy = np.zeros(len(of)), np.zeros(len(of))
                for jx in range(-2 - odd_x, 4 - odd_x):
                    for jy in range(-2 - odd_y, 4 - odd_y):
                        near = abs(jx) <= 1 and abs(jy) <= 1
                        if near and (level < depth or jx == jy == 0):
                            continue
                        at = own + (jy * wide + jx)
                        dx, dy = px - cx[at], py - cy[at]
                        push = weight[at] / (dx * dx + dy * dy + 1.0)
                        gx += dx * push
                        gy += dy * push
                fx[of] = fx[of] + gx
                fy[of] = fy[of] + gy
    if depth:  # a point's own cell, without the point; indices are those of the finest level
        rest, wx, wy = m[iy, ix] - mass, sx[iy, ix] - mass * x, sy[iy, ix] - mass * y
        there = rest > 1e-9
        safe = np.where(there, rest, 1.0)
        dx, dy = x - wx / safe, y - wy / safe
        push = np.where(there, rest / (dx * dx + dy * dy + 1.0), 0.0)
        fx, fy = fx + dx * push, fy + dy * push
    return fx * (scaling * mass), fy * (scaling * mass)


def _pushed(at: DataFrame, box: dict, depth: int, scaling: float) -> DataFrame:
    """id, x, y, mass and the repulsion fx, fy of each. One sum by cell; no exchange of nodes.

    The finest cells, 4^depth rows at most, come to the driver and go to the tasks; no node does.
    """
    side, x0, y0 = 1 << depth, box["x0"], box["y0"]
    extent = max(box["x1"] - x0, box["y1"] - y0, 1e-9)
    place = lambda c, low: F.least(F.lit(side - 1), F.floor((F.col(c) - low) / extent * side)).cast("int")
    sums = at.groupBy((place("y", y0) * side + place("x", x0)).alias("cell")).agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("x")).alias("mx"), F.sum(F.col("mass") * F.col("y")).alias("my")).toArrow()
    tree = tree_of(sums["cell"].to_numpy(), *(sums[c].to_numpy() for c in ("m", "mx", "my")), depth)

    def forces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, mass = (batch[c].to_numpy() for c in ("x", "y", "mass"))
            fx, fy = repulsion(x, y, mass, tree, x0, y0, extent, scaling)
            yield pa.record_batch([*batch.columns, pa.array(fx), pa.array(fy)], names=[*batch.schema.names, "fx", "fy"])

    return at.select("id", "x", "y", "mass").mapInArrow(forces, "id string, x double, y double, mass double, fx double, fy double")


def force_layout(g: Graph, rounds: int | None = None, gravity: float = 1.2, scaling: float = 12.0) -> DataFrame:
    """id, x, y of every node, from the circular start, in ``rounds`` steps that cool down (250, above 600 nodes 120).

    A round is one sum by tree cell and one table: repulsion is reckoned where nodes are read (``repulsion``), attraction
    is a join of the edges with the places of their ends and a sum, the extent of the next round is observed while the
    table is written. A round's table goes when the next one is there. The tree's depth follows the number of nodes up to
    ``DEEPEST``; beyond, nodes of one finest cell meet as its centre.

    Defined results: an edge counts once whatever its number of calls, in both directions; loops and ends that aren't nodes
    move nothing; nodes without edges have mass 1; an empty graph gives no rows; with no rounds nodes stay on the circle.
    """
    reach_workers(g.spark)
    n = g.nodes.count()
    rounds = rounds if rounds is not None else (ROUNDS_MANY if n > MANY else ROUNDS_FEW)
    depth = next((d for d in range(1, DEEPEST) if 4**d >= PER_NODE * n), DEEPEST)
    there = g.edges.filter("src <> dst").select("src", "dst")
    ends = save(there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "layout-edges")
    mass = ends.groupBy(F.col("src").alias("id")).agg((F.count("*") + 1.0).alias("mass"))
    box = {"x0": F.min("x"), "x1": F.max("x"), "y0": F.min("y"), "y1": F.max("y")}
    at, told = save_measured(endpoints.layout_seed(g).select("id", "x", "y").join(mass, "id", "left").fillna(1.0, ["mass"]), "layout", **box)
    for step in range(rounds if n else 0):
        others = at.select(F.col("id").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        pulled = ends.join(others, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("ox").alias("ox"), F.sum("oy").alias("oy"), F.count("*").alias("k"))
        both = _pushed(at, told, depth, scaling).join(pulled, "id", "left").fillna(0.0, ["ox", "oy"]).fillna(0, ["k"])
        far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) + 1e-9
        force = lambda c: F.col(f"f{c}") + F.col(f"o{c}") - F.col("k") * F.col(c) - gravity * F.col("mass") * F.col(c) / far  # noqa: B023, E731
        both = both.select("id", "x", "y", "mass", force("x").alias("gx"), force("y").alias("gy"))
        longest = max(told["x1"] - told["x0"], told["y1"] - told["y0"], 1e-9) * FIRST_STEP * (1 - step / rounds)
        scale = F.least(1.0 / F.col("mass"), longest / (F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) + 1e-9))
        before = at
        at, told = save_measured(both.select("id", (F.col("x") + F.col("gx") * scale).alias("x"), (F.col("y") + F.col("gy") * scale).alias("y"), "mass"), "layout", **box)
        drop_saved(before)
    drop_saved(ends)
    return at.select("id", "x", "y")


def drawn(g: Graph, rounds: int | None = None) -> DataFrame:
    """One row on a layout: nodes, nodes with a finite place, whether linked nodes came nearer to each other than any two.

    ``nearer`` holds if the mean squared length of edges, over that between any two nodes, is below that of the start.
    """
    # nodes and edges may be dear to make, and are read several times
    g = g.having(nodes=save(g.nodes.select("id", "short", "in_degree", "grp", "node_ord"), "layout-graph"), edges=save(g.edges, "layout-graph"))
    start, end = save(endpoints.layout_seed(g).select("id", "x", "y"), "layout-start"), force_layout(g, rounds)
    linked = g.edges.filter("src <> dst").select("src", "dst").distinct()

    def shape(at: DataFrame) -> DataFrame:
        of = lambda p: at.select(F.col("id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
        long = linked.join(of("src"), "src").join(of("dst"), "dst").agg(F.avg(F.pow(F.col("srcx") - F.col("dstx"), 2) + F.pow(F.col("srcy") - F.col("dsty"), 2)).alias("long"))
        finite = F.col("x").between(-1e12, 1e12) & F.col("y").between(-1e12, 1e12)
        wide = at.agg((2 * (F.var_pop("x") + F.var_pop("y"))).alias("wide"), F.count("*").alias("n_nodes"), F.count_if(finite).alias("n_placed"))
        return long.crossJoin(wide)  # one row each

    was = shape(start).select((F.col("long") / F.col("wide")).alias("was"))
    return shape(end).crossJoin(was).select("n_nodes", "n_placed", (F.col("long") / F.col("wide") < F.col("was")).alias("nearer"))
