"""The force layout: repulsion against all pairs, whole layouts, odd graphs."""

import numpy as np
import pytest

from quillon.config import Config
from quillon.operators import endpoints, layout
from quillon.sources import graph_json

NODE = "node_ord long, id string, name string, short string, file string, module string, grp string, line long, kind string, exported boolean, signature string, doc string, humanized string, descr string, loc long, chars long, numeric_ops long, tested boolean, in_degree long, out_degree long"


def graph_of(spark, n, pairs):
    rows = [(i, f"n{i}", f"n{i}", f"n{i}", "f", "m", "core", i, "function", True, "", "", "", "", 1, 1, 0, False, 0, 0) for i in range(n)]
    edges = [(i, f"n{a}", f"n{b}", 1) for i, (a, b) in enumerate(pairs)]
    g = graph_json.empty(spark, Config(name="drawn"))
    return g.having(nodes=spark.createDataFrame(rows, NODE), edges=spark.createDataFrame(edges, "edge_ord long, src string, dst string, cnt long"))


def all_pairs(x, y, mass, scaling):
    dx, dy = x[:, None] - x[None], y[:, None] - y[None]
    push = scaling * mass[:, None] * mass[None] / (dx * dx + dy * dy + 1.0)
    return (dx * push).sum(1), (dy * push).sum(1)


@pytest.mark.parametrize("depth", [1, 3, 5, 7])
def test_repulsion_against_all_pairs(depth):
    rng = np.random.default_rng(depth)
    n = min(3000, max(2, 4**depth // layout.PER_NODE))
    x, y, mass = rng.normal(0, 300, n), rng.exponential(200, n), rng.integers(1, 9, n).astype(float)
    x[: n // 3] = x[: n // 3] / 10  # a third of all points in few cells
    x0, y0, extent, side = x.min(), y.min(), max(np.ptp(x), np.ptp(y)), 1 << depth
    cell = np.minimum(side - 1, ((y - y0) / extent * side).astype(int)) * side + np.minimum(side - 1, ((x - x0) / extent * side).astype(int))
    tree = layout.tree_of(cell, mass, mass * x, mass * y, depth)
    assert all(np.isclose(level[0].sum(), mass.sum()) for level in tree) and len(tree) == depth + 1
    got, exact = layout.repulsion(x, y, mass, tree, x0, y0, extent, 12.0), all_pairs(x, y, mass, 12.0)
    error = np.hypot(got[0] - exact[0], got[1] - exact[1]) / np.maximum(np.hypot(*exact), 1e-9)
    count = np.bincount(cell, minlength=side * side).reshape(side, side)
    padded = np.pad(count, 1)
    most = np.max([padded[i : i + side, j : j + side] for i in range(3) for j in range(3)], axis=0)
    apart = most.ravel()[cell] <= 1  # every point nearby has a finest cell of its own
    assert np.median(error) < 0.03 and apart.any() and (error[apart] < 0.1).mean() > 0.95


def test_two_points_and_equal_points():
    x, y, one = np.array([0.0, 8.0]), np.array([0.0, 0.0]), np.ones(2)
    tree = layout.tree_of(np.array([0, 1]), one, x, y, 1)
    fx, fy = layout.repulsion(x, y, one, tree, 0.0, 0.0, 8.0, 1.0)
    assert np.allclose(fx, [-8 / 65, 8 / 65]) and np.allclose(fy, 0)
    tree = layout.tree_of(np.array([0, 0]), one, x * 0, y, 1)
    assert all(np.allclose(f, 0) for f in layout.repulsion(x * 0, y, one, tree, 0.0, 0.0, 1e-9, 1.0))


def test_layout_parts_two_communities(spark):
    pairs = [(a, b) for side in (0, 1) for a in range(side, 24, 2) for b in range(side, a, 2)] + [(0, 1), (3, 3)]
    g = graph_of(spark, 25, pairs)  # neighbours on the starting circle are of different communities; the last node is alone
    at = {r["id"]: np.array([r["x"], r["y"]]) for r in layout.force_layout(g, 40).collect()}
    assert len(at) == 25 and all(np.isfinite(p).all() for p in at.values())
    centre = [np.mean([at[f"n{i}"] for i in range(side, 24, 2)], axis=0) for side in (0, 1)]
    assert all(np.linalg.norm(at[f"n{i}"] - centre[i % 2]) < np.linalg.norm(at[f"n{i}"] - centre[1 - i % 2]) for i in range(24))
    assert len({tuple(p.round(6)) for p in at.values()}) == 25


def test_layout_of_odd_graphs(spark):
    assert layout.force_layout(graph_of(spark, 0, [])).count() == 0
    one = layout.force_layout(graph_of(spark, 1, [(0, 0), (0, 7)]), 3).collect()
    assert len(one) == 1 and np.isfinite(one[0]["x"])
    g = graph_of(spark, 3, [(0, 1), (0, 1), (1, 0)])
    start = {r["id"]: (r["x"], r["y"]) for r in endpoints.layout_seed(g).collect()}
    assert {r["id"]: (r["x"], r["y"]) for r in layout.force_layout(g, 0).collect()} == start


def test_forces_are_cheap_and_those_of_all_cells():
    """One point against the sum over the cells that count for it, spelled out."""
    depth, side = 3, 8
    kind = np.random.default_rng(3)
    x, y, mass = kind.uniform(0, 8, 60), kind.uniform(0, 8, 60), kind.integers(1, 5, 60).astype(float)
    cell = np.minimum(7, y.astype(int)) * side + np.minimum(7, x.astype(int))
    tree = layout.tree_of(cell, mass, mass * x, mass * y, depth)
    fx, fy = layout.repulsion(x, y, mass, tree, 0.0, 0.0, 8.0, 12.0)
    for i in range(60):
        want = np.zeros(2)
        for level in range(1, depth + 1):
            n = 1 << level
            ix, iy = min(n - 1, int(x[i] / 8 * n)), min(n - 1, int(y[i] / 8 * n))
            for jx in range(max(0, ix // 2 * 2 - 2), min(n, ix // 2 * 2 + 4)):
                for jy in range(max(0, iy // 2 * 2 - 2), min(n, iy // 2 * 2 + 4)):
                    if level < depth and abs(jx - ix) <= 1 and abs(jy - iy) <= 1:
                        continue
                    m, sx, sy = (t[jy, jx] for t in tree[level])
                    if (jx, jy) == (ix, iy) and level == depth:
                        m, sx, sy = m - mass[i], sx - mass[i] * x[i], sy - mass[i] * y[i]
                    if m > 1e-9:
                        d = np.array([x[i] - sx / m, y[i] - sy / m])
                        want += d * 12.0 * mass[i] * m / (d @ d + 1)
        assert np.allclose([fx[i], fy[i]], want)
