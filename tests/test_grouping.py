"""Regions, splines, merges, cliques, sub-trees and kernel machines against plain versions."""

import random
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partweave.operators import graphs, margins, merges, regions, shapes


def inside(x, y, corners):
    """On an even-odd span of row y, its ends included, or a corner."""
    if (x, y) in corners:
        return True
    cross = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True) if min(ay, by) <= y < max(ay, by))
    return any(a - 1e-9 <= x <= b + 1e-9 for a, b in zip(cross[0::2], cross[1::2], strict=True))


def test_polygons_fill_as_a_loop_over_points(spark):
    rng = random.Random(1)
    shapes_ = {k: [(rng.randrange(15), rng.randrange(15)) for _ in range(rng.randrange(1, 9))] for k in range(25)}
    shapes_[90] = [(0, 0), (4, 0), (4, 4), (0, 4)]
    df = spark.createDataFrame([(k, i, x, y) for k, own in shapes_.items() for i, (x, y) in enumerate(own)], "key int, k int, x int, y int").repartition(3)
    got = {}
    for r in regions.filled(df, ["key"]).collect():
        got.setdefault(r["key"], set()).add((r["x"], r["y"]))
    for k, own in shapes_.items():
        assert got[k] == {(x, y) for x in range(15) for y in range(15) if inside(x, y, own)}
    assert regions.filled(df.where("false"), ["key"]).collect() == []


@pytest.mark.parametrize("exact", [0, 1 << 22])
def test_spans_of_many_polygons_equal_those_of_each(monkeypatch, exact):
    """Crossings as one number each, and by two keys where that would not be exact."""
    monkeypatch.setattr(regions, "EXACT", exact)
    rng = random.Random(8)
    own = [[(rng.randrange(-9, 40), rng.randrange(-7, 30)) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    ends = np.cumsum([0, *map(len, own)])
    x, y = (np.array([p[c] for o in own for p in o]) for c in (0, 1))
    nxt = np.concatenate([np.append(np.arange(a + 1, b), a) for a, b in zip(ends[:-1], ends[1:])])
    owner, row, first, last = regions._spans(np.repeat(np.arange(40), np.diff(ends)), x, y, nxt)
    for k, corners in enumerate(own):
        got = [(c, r) for r, a, b in zip(row[owner == k], first[owner == k], last[owner == k]) for c in range(a, b + 1)]
        assert len(got) == len(set(got)) and set(got) == {(c, r) for c in range(-9, 40) for r in range(-7, 30) if inside(c, r, corners)}


def test_splines_pass_the_points_and_their_length_is_the_integral(spark):
    rng = random.Random(2)
    points = [(key, k, rng.randrange(50), rng.randrange(50)) for key in range(4) for k in range((1, 2, 3, 12)[key])]
    pieces = regions.spline(spark.createDataFrame(points, "key int, k int, x int, y int"), ["key"]).withColumn("length", regions.piece_length()).collect()
    assert sorted((r["key"], r["k"]) for r in pieces) == [(key, k) for key, k, _, _ in sorted(points) if k < (1, 2, 3, 12)[key] - 1]
    place = {(key, k): (x, y) for key, k, x, y in points}
    t = np.linspace(0, 1, 20_001)
    for r in pieces:
        x, y = (sum(r[f"{c}{n}"] * t**n for n in range(4)) for c in "ab")
        assert np.allclose((x[0], y[0]), place[r["key"], r["k"]]) and np.allclose((x[-1], y[-1]), place[r["key"], r["k"] + 1])
        assert r["length"] == pytest.approx(np.hypot(np.diff(x), np.diff(y)).sum(), rel=0.02, abs=0.5)
    slope = {(r["key"], r["k"]): [(r[f"{c}1"], r[f"{c}1"] + 2 * r[f"{c}2"] + 3 * r[f"{c}3"]) for c in "ab"] for r in pieces}
    for key, k in slope:  # one piece goes on in the direction of the last
        if (key, k + 1) in slope:
            assert all(a[1] == pytest.approx(b[0]) for a, b in zip(slope[key, k], slope[key, k + 1], strict=True))


def test_fitted_cubics_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(t), *map(float, rng.normal(size=2))) for k, n in enumerate((40, 5, 4)) for t in rng.random(n)] + [(9, 0.5, 1.0, 2.0)]
    got = {r["key"]: r for r in regions.fitted_cubics(spark.createDataFrame(rows, "key int, t double, x double, y double"), ["key"]).collect()}
    for k in range(3):
        own = np.array([r[1:] for r in rows if r[0] == k])
        for name, column in (("cx", 1), ("cy", 2)):
            assert np.allclose(np.polynomial.polynomial.polyval(own[:, 0], got[k][name]), np.polynomial.polynomial.polyval(own[:, 0], np.polynomial.polynomial.polyfit(own[:, 0], own[:, column], 3)), atol=1e-4)
    assert np.polynomial.polynomial.polyval(0.5, got[9]["cx"]) == pytest.approx(1.0) and got[9]["n"] == 1


def queue_merges(costs, most):
    groups = {v: {v} for e in costs for v in e}
    cost = lambda a, b: max((costs.get((min(x, y), max(x, y)), np.inf) for x in groups[a] for y in groups[b]))
    while True:
        best = min(((cost(a, b), a, b) for a, b in combinations(sorted(groups), 2)), default=(np.inf, 0, 0))
        if best[0] > most:
            return {v: root for root, own in groups.items() for v in own if v != root}
        groups[best[1]] |= groups.pop(best[2])


def test_merges_equal_one_queue(spark):
    rng = random.Random(4)
    for n, share, most in ((12, 0.7, 0.6), (30, 0.3, 0.9), (20, 1.0, 0.5)):
        costs = {(a, b): rng.random() for a, b in combinations(range(n), 2) if rng.random() < share}
        df = spark.createDataFrame([(b, a, c) if rng.random() < 0.5 else (a, b, c) for (a, b), c in costs.items()], "a long, b long, cost double")
        got = {r["part"]: r["root"] for r in merges.merged_by_cost(df, most).collect()}
        assert got == queue_merges(costs, most) and got
    assert merges.merged_by_cost(df, -1.0).collect() == []


def test_split_cliques_equal_those_of_the_whole_graph(spark):
    rng = random.Random(5)
    rows = [(g, a, b) for g in range(4) for a, b in combinations(range(14), 2) if rng.random() < (0.2, 0.4, 0.6, 1.0)[g]]
    rows += [(9, 0, k) for k in range(1, 60)] + [(9, 1, 2), (0, 3, 3), (0, 5, 2), (0, 2, 5)]
    df = spark.createDataFrame(rows, "g int, a long, b long").repartition(3)
    want = sorted((r["g"], r["clique"]) for r in graphs.cliques(df.where("a <> b"), ["g"]).collect())
    assert sorted((r["g"], r["clique"]) for r in merges.split_cliques(df, ["g"]).collect()) == want
    alone = merges.split_cliques(df.where("g = 1").drop("g"), [])
    assert sorted(r["clique"] for r in alone.collect()) == [c for g, c in want if g == 1]


def test_no_triangle_of_a_graph_is_a_row(spark):
    """Neighbours' lists meet in a vertex's task: one join, of edges with lists."""
    df = spark.createDataFrame([(a, b) for a, b in combinations(range(40), 2)], "a long, b long")
    found = merges.split_cliques(df, [])
    assert [r["clique"] for r in found.collect()] == [list(range(40))]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_states_of_many_keys_are_summed_a_task(spark):
    rng = np.random.default_rng(13)
    keys, x = rng.integers(0, 50, 400), rng.normal(size=(400, 2))
    df = spark.createDataFrame([(int(k), [float(a) for a in v]) for k, v in zip(keys, x, strict=True)] + [(None, [1.0, 2.0])], "k int, v array<double>").coalesce(1)
    rows = shapes.covariance_states(df, "k", "v").collect()
    assert sorted(r["k"] for r in rows) == sorted(set(keys.tolist()))
    for r in rows:
        own = x[keys == r["k"]]
        assert r["n"] == len(own) and np.allclose(r["sums"], own.sum(axis=0)) and np.allclose(r["products"], (own.T @ own).ravel())


def test_a_cliques_shape_is_that_of_its_members_rows(spark):
    rng = np.random.default_rng(6)
    data = {k: rng.normal(size=(5 + k, 3)) for k in range(4)}
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, xs in data.items() for x in xs], "part int, v array<double>")
    states = shapes.merged_states(shapes.covariance_states(df, "part", "v"), "part")
    members = spark.createDataFrame([("a", 0), ("a", 2), ("b", 2), ("b", 3)], "name string, part int")
    models = shapes.shape_models(shapes.merged_states(members.join(states, "part").drop("part"), "name"), "name").collect()
    for r in models:
        xs = np.concatenate([data[k] for k in {"a": (0, 2), "b": (2, 3)}[r["name"]]])
        assert r["n"] == len(xs) and np.allclose(r["eigenvalues"], np.linalg.eigvalsh(np.cov(xs.T, bias=True))[::-1])


def plain_subtrees(near, root, depth, degree):
    parent, level, front = {root: None}, {root: 0}, [root]
    for d in range(1, depth + 1):
        new = {}
        for n in sorted(front):
            for o in near.get(n, ()):
                if o not in parent:
                    new[o] = min(new.get(o, n), n)
        parent |= new
        level |= dict.fromkeys(new, d)
        front = list(new)
    children = {}
    for n, up in parent.items():
        children.setdefault(up, []).append(n)

    def grow(n):
        """All trees below n, n included."""
        most = degree if n == root else degree - 1
        out = []
        for size in range(most + 1):
            for chosen in combinations(children.get(n, []), size):
                for below in product(*(grow(c) for c in chosen)):
                    out.append(frozenset({n}).union(*below))
        return out

    return grow(root), level


def test_subtrees_equal_an_exhaustive_search(spark):
    rng = random.Random(7)
    edges = {(a, b) for a, b in product(range(9), repeat=2) if a != b and rng.random() < 0.25}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    roots = spark.createDataFrame([(0,), (4,), (99,)], "root long")
    for depth, degree in ((2, 3), (3, 2)):
        got = merges.subtrees(df, roots, depth=depth, degree=degree).collect()
        for root in (0, 4, 99):
            want, level = plain_subtrees(near, root, depth, degree)
            own = [r for r in got if r["root"] == root]
            assert sorted(sorted(r["nodes"]) for r in own) == sorted(map(sorted, want))
            assert all(r["depth"] == max(level[n] for n in r["nodes"]) for r in own)
    assert {r["depth"] for r in merges.subtrees(df, roots, depth=2, degree=2, least_depth=2).collect()} == {2}


def test_subtrees_of_near_nodes_equal_an_exhaustive_search(spark):
    rng = random.Random(9)
    nodes = [(g, rng.randrange(-3, 6), rng.randrange(6), 100 * g + k) for g in range(5) for k in range(14 - 3 * g)] + [(7, 0, 0, 700), (8, None, 0, 800), (8, 0, 0, 801)]
    df = spark.createDataFrame(nodes, "g int, x int, y int, node_id long").repartition(3)
    near = {}
    for (g, x, y, a), (h, u, v, b) in product(nodes[:-3], repeat=2):
        if g == h and a != b and abs(x - u) <= 2 and abs(y - v) <= 1:
            near.setdefault(a, set()).add(b)
    for depth, degree in ((2, 2), (3, 2), (2, 3), (2, 1), (0, 2)):
        got = merges.near_subtrees(df, ["g"], 2, 1, depth=depth, degree=degree).collect()
        assert {r["root"] for r in got} == set(near)
        for root in near:
            want, level = plain_subtrees(near, root, depth, degree)
            own = [r for r in got if r["root"] == root]
            assert sorted(r["nodes"] for r in own) == sorted(map(sorted, want))
            assert all(r["g"] == root // 100 and r["depth"] == max(level[n] for n in r["nodes"]) for r in own)
    assert {r["depth"] for r in merges.near_subtrees(df, ["g"], 2, 1, depth=2, degree=2, least_depth=2).collect()} == {2}


def test_a_kernel_machine_equals_a_direct_solution(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 3, (80, 2))
    y = ((x**2).sum(axis=1) < 3).astype(float)
    rows = spark.createDataFrame([(k, [float(v) for v in row], int(label)) for k, (row, label) in enumerate(zip(x, y, strict=True))] + [(99, None, 1)], "id int, v array<double>, y int")
    machine = margins.train(rows, vector="v", label="y", gamma=4.0, landmarks=500, penalty=0.02, rounds=300)
    z = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    k = margins.kernel(z, z, 4.0)
    assert np.allclose(machine.mapped(x) @ machine.mapped(x).T, k, atol=1e-6)  # every row a landmark: exact
    # The dual by projected steps: max sum a - 1/2 a'Qa, 0 <= a <= C, sum a s = 0.
    s, bound = 2 * y - 1, 1 / (80 * 0.02)
    a, q = np.zeros(80), (s[:, None] * s[None]) * k
    for _ in range(40_000):
        g = a + 0.02 * (1 - q @ a)
        low, high = -50.0, 50.0
        for _ in range(60):  # the shift that keeps the balance
            mid = (low + high) / 2
            low, high = (mid, high) if (np.clip(g - mid * s, 0, bound) * s).sum() > 0 else (low, mid)
        a = np.clip(g - low * s, 0, bound)
    free = (a > 1e-4) & (a < bound - 1e-4)
    bias = np.median(s[free] - (k @ (a * s))[free])
    direct = k @ (a * s) + bias
    got = {r["id"]: r["margin"] for r in margins.margins(rows, machine, vector="v").collect()}
    ours = np.array([got[i] for i in range(80)])
    assert got[99] is None and np.abs(ours - direct).max() < 0.2
    cost = lambda m, size: np.maximum(0, 1 - s * m).mean() + 0.01 * size
    best = cost(direct, (a * s) @ k @ (a * s))
    assert best * (1 - 1e-6) <= cost(ours, machine.weights @ machine.weights) <= 1.01 * best
    assert ((ours > 0) == (direct > 0)).mean() > 0.95


def test_members_follow_their_classes(spark):
    members = spark.createDataFrame([(0, 0), (3, 0), (1, 1), (2, 2), (5, 2), (7, 7), (9, 7), (8, 8)], "part int, class int")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a int, b int")
    cliques = merges.member_cliques(members, edges, merges.split_cliques(edges, []))
    assert sorted(r["clique"] for r in cliques.collect()) == [[0, 1, 3], [1, 2, 5], [7, 9]]
    roots = spark.createDataFrame([(1, 0)], "part int, root int")
    assert {r["part"]: r["root"] for r in merges.merged_members(members, roots).collect()} == {3: 0, 1: 0, 5: 2, 9: 7}
