"""Operators without SQL form against plain loops on small cases."""

import itertools
import random

import numpy as np
import pytest

from partweave.operators import clustering, graphs, images, learning, suppression


def test_spanning_tree_weighs_as_kruskal(spark):
    rng = random.Random(3)
    pts = [(0, i, rng.randrange(50), rng.randrange(50)) for i in range(25)]
    got = graphs.spanning_trees(spark.createDataFrame(pts, "image_id long, node_id long, x int, y int"), ["image_id"]).collect()
    edges = sorted(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, a[1], b[1]) for a, b in itertools.combinations(pts, 2))
    root = {p[1]: p[1] for p in pts}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    total = 0
    for d2, a, b in edges:
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += d2
    assert len(got) == 24 and sum(r.d2 for r in got) == total


def test_cliques_are_all_maximal_ones(spark):
    rng = random.Random(5)
    edges = [(0, a, b) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.5]
    near = {frozenset(e[1:]) for e in edges}
    sets = [set(s) for n in range(2, 10) for s in itertools.combinations(range(9), n) if all(frozenset(p) in near for p in itertools.combinations(s, 2))]
    expected = {tuple(sorted(s)) for s in sets if not any(s < t for t in sets)}
    got = graphs.cliques(spark.createDataFrame(edges, "g int, a long, b long"), ["g"]).collect()
    assert {tuple(r.clique) for r in got} == expected


def test_greedy_boxes_follow_the_loop(spark):
    rng = random.Random(7)
    rows = [(0, i, rng.randrange(20), rng.randrange(20), rng.random()) for i in range(40)]
    boxes = [(g, i, x, y, x + 8, y + 8, v) for g, i, x, y, v in rows]
    df = spark.createDataFrame(boxes, "image_id int, box_id long, llx int, lly int, urx int, ury int, val double")
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[1])):
        def iou(c, b=b):
            i = max(0, min(b[4], c[4]) - max(b[2], c[2])) * max(0, min(b[5], c[5]) - max(b[3], c[3]))
            return i / (128 - i)
        if all(iou(c) <= 0.3 for c in kept):
            kept.append(b)
    got = suppression.suppress_boxes(df, ["image_id"], 0.3).select("box_id").collect()
    assert sorted(r.box_id for r in got) == sorted(b[1] for b in kept)


def test_cover_and_leaves(spark):
    rows = [(0, 1, 0.9, [1, 2, 3, 4]), (0, 2, 0.8, [3, 4]), (0, 3, 0.7, [5, 6, 7])]
    df = spark.createDataFrame(rows, "image_id int, node_id long, val double, leaves array<long>")
    assert {r.node_id for r in suppression.greedy_cover(df, ["image_id"], 0.5, 1.0).collect()} == {1, 3}
    assert {r.node_id for r in suppression.suppress_by_leaves(df, ["image_id"], 0.5).collect()} == {1, 3}


def test_peaks(spark):
    cells = [(0, 0, 0, 10.0), (0, 1, 0, 9.0), (0, 5, 5, 8.0), (0, 9, 9, 1.0)]
    got = suppression.pick_peaks(spark.createDataFrame(cells, "k int, dx int, dy int, v double"), ["k"], radius=2, share=0.5, most=3)
    assert {(r.dx, r.dy) for r in got.collect()} == {(0, 0), (5, 5)}


def test_islands(spark):
    cells = [(0, 0, 0, 1.0), (0, 1, 1, 1.0), (0, 5, 5, 1.0), (0, 2, 2, 0.1)]
    got = graphs.flood(spark.createDataFrame(cells, "image_id int, x int, y int, v double"), ["image_id"], 0.5).collect()
    assert {(r.x, r.y, r.island) for r in got} == {(0, 0, 0), (1, 1, 0), (5, 5, 1)}


def test_sampled_children_are_children_and_repeat(spark):
    rows = [(1, 0, 10, 0.1), (1, 0, 11, 0.9), (1, 1, 12, 0.5), (2, 0, 13, 0.0)]
    df = spark.createDataFrame(rows, "src long, idx int, dst long, r double")
    a = {(r.src, r.idx): r.dst for r in graphs.sampled_children(df, 1).collect()}
    assert a == {(r.src, r.idx): r.dst for r in graphs.sampled_children(df, 1).collect()}
    assert set(a) == {(1, 0), (1, 1)} and a[1, 1] == 12
    share = np.mean([{(r.src, r.idx): r.dst for r in graphs.sampled_children(df, s).collect()}[1, 0] == 11 for s in range(12)])
    assert share > 0.5


def test_mean_shift_finds_clouds(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal((0, 0), 0.5, (20, 2)), rng.normal((30, 30), 0.5, (20, 2))])
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "image_id int, node_id long, x double, y double")
    got = {r.node_id: r.cluster for r in clustering.mean_shift(df, ["image_id"], sigma=3.0).collect()}
    assert set(got.values()) == {0, 20} and all(got[i] == (0 if i < 20 else 20) for i in range(40))


def test_assignment_is_least(spark):
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 6)):
        cost = rng.random((n, m))
        got = clustering.assignment(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and cost[np.arange(n), got].sum() == pytest.approx(best)


def test_bending_energy():
    square = np.array([(0, 0), (0, 4), (4, 0), (4, 4), (2, 1)], dtype=float)
    assert clustering.bending_energy(square, square * 2 + 1) == pytest.approx(0, abs=1e-9)
    bent = square.copy()
    bent[4] += (1, 0)
    assert clustering.bending_energy(square, bent) > 0.01
    assert clustering.bending_energy(square, square[:3]) == -1


def test_principal_axes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * np.array([5, 2, 1, 0.5])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    mean, lam, axes = clustering.principal_axes(df, "v", 2)
    cov = np.cov(x.T, bias=True)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(lam, np.linalg.eigvalsh(cov)[::-1][:2])


def test_farthest_points(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.5, 0.5])], "id long, h array<double>")
    assert clustering.farthest_points(df, 3, id_col="id") == [0, 2, 3]


def test_greedy_types(spark):
    rows = [(0, i) for i in range(5)] + [(1, i) for i in range(3, 9)] + [(2, 9)]
    assert learning.greedy_types(spark.createDataFrame(rows, "m int, leaf long"), 5) == [(1, 6), (0, 3), (2, 1)]


def test_library_edits(spark):
    lib = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "part int, structure string")
    new = spark.createDataFrame([("b",), ("d",), ("e",)], "structure string")
    assert {(r.part, r.structure) for r in learning.inserted_parts(lib, new).collect()} == {(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")}
    kept = learning.kept_parts(lib, spark.createDataFrame([(2,), (0,)], "part int")).collect()
    assert {(r.part, r.old_part) for r in kept} == {(0, 0), (1, 2)}


def test_convolution_and_resize():
    rng = np.random.default_rng(6)
    img, k = rng.random((7, 9)), rng.random((3, 3))
    out = images.convolve(img, k)
    pad = np.pad(img, 1, mode="edge")
    direct = [[sum(pad[i + 2 - a, j + 2 - b] * k[a, b] for a in range(3) for b in range(3)) for j in range(9)] for i in range(7)]
    assert np.allclose(out, direct)
    assert np.allclose(images.resize(np.ones((8, 8)), 5, 3), 1)
    assert images.gaussian_kernel(5, 1.0).sum() == pytest.approx(1)
    assert all(abs(e.sum()) < 1e-9 and abs(o.sum()) < 1e-9 for e, o in images.gabor_kernels(4))


def test_gabor_prefers_its_orientation(spark):
    img = np.tile(np.sin(2 * np.pi * np.arange(32) / 5.0), (32, 1))
    df = spark.createDataFrame([(0, 0, 32, 32, [float(v) for v in img.ravel()])], images.IMAGE)
    got = images.oriented_energy(df, 4).where("x = 16 AND y = 16").orderBy("v", ascending=False).first()
    assert got.m == 0
    assert images.pyramid(df, factor=0.5, limit=10, most=5).count() == 2


def test_longest_path_of_a_tree(spark):
    from partweave.operators import paths

    rng = random.Random(8)
    edges = [(0, rng.randrange(k), k) for k in range(1, 30)]
    near = {v: {a + b - v for _, a, b in edges if v in (a, b)} for v in range(30)}

    def depth(v, before):
        return 1 + max((depth(w, v) for w in near[v] if w != before), default=0)

    got = paths.longest_paths(spark.createDataFrame(edges, "g int, a long, b long"), ["g"]).first().path
    assert len(got) == max(depth(v, None) for v in range(30))
    assert all(b in near[a] for a, b in zip(got, got[1:]))


def test_learning_finds_a_planted_pattern(spark):
    from partweave.operators import training
    from partweave.sources.projections import kernel

    rows = []
    for image in range(12):
        for k in range(3):
            x, y = 10 + 15 * k, 7 + image
            rows += [(image, 0, x, y, 0, 0.9), (image, 0, x + 3, y, 1, 0.9)]
        rows.append((image, 0, 2 + image, 60, 2, 0.9))
    nodes = spark.createDataFrame([(*r, 0.9, 0.9, i) for i, r in enumerate(rows)], "image_id long, z int, x int, y int, m int, r double, g double, rr double, node_id long")
    (center, sub, above), second = training.learn_layers(nodes, kernel(spark), [training.Settings(), training.Settings(radius=16, tolerance=2)])
    parts = {r.part: r.center_m for r in center.collect()}
    subs = {(parts[r.part], r.sub_m, r.dx, r.dy) for r in sub.collect()}
    assert subs == {(0, 1, 3, 0), (1, 0, -3, 0)}
    got = above.collect()
    assert len(got) == 72 and {r.z for r in got} == {1}
    assert len(training.covering_parts(above, 5)) == 2
    assert second[2].count() > 0
