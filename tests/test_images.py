"""Filter banks, blur, pyramids, offset peaks and part sequences against plain loops."""

import math
import random

import numpy as np
import pytest

from partweave.operators import images, learning
from partweave.plans import feature_queries
from partweave.sources import projections

IMAGE = "image_id long, width int, height int, pixels array<double>"


def made(spark, seed=1):
    rng = random.Random(seed)
    grids = {k: [[rng.random() for _ in range(w)] for _ in range(h)] for k, (h, w) in enumerate(((7, 9), (12, 5), (3, 3)))}
    return grids, spark.createDataFrame([(k, len(g[0]), len(g), [v for row in g for v in row]) for k, g in grids.items()], IMAGE)


def at(grid, y, x):
    """Edges repeated."""
    return grid[min(max(y, 0), len(grid) - 1)][min(max(x, 0), len(grid[0]) - 1)]


def test_blur_equals_direct_sums(spark):
    grids, df = made(spark)
    weights = {(j, i): math.exp(-(i * i + j * j) / (2 * 1.3**2)) for j in range(-2, 3) for i in range(-2, 3)}
    total = sum(weights.values())
    for r in images.blurred(df, 5, 1.3).collect():
        g = grids[r["image_id"]]
        want = [sum(w * at(g, y + j, x + i) for (j, i), w in weights.items()) / total for y in range(len(g)) for x in range(len(g[0]))]
        assert np.allclose(r["pixels"], want) and (r["height"], r["width"]) == (len(g), len(g[0]))
    for size, sigma in ((1, 1.3), (5, 0.0)):
        assert {r["image_id"]: list(r["pixels"]) for r in images.blurred(df, size, sigma).collect()} == {k: [v for row in g for v in row] for k, g in grids.items()}


def test_pyramids_equal_bilinear_sums(spark):
    grids, df = made(spark, 2)
    got = {}
    for r in images.pyramid(df, factor=0.7, limit=4, most=3).collect():
        got[r["image_id"], r["scale"]] = np.reshape(r["pixels"], (r["height"], r["width"]))
    for k, g in grids.items():
        now, scale = g, 0
        while True:
            assert np.allclose(got[k, scale], now)
            h, w = round(len(now) * 0.7), round(len(now[0]) * 0.7)
            if scale + 1 == 3 or max(h, w) < 4 or min(h, w) < 1:
                break
            new = []
            for y in range(h):
                cy = min(max((y + 0.5) * len(now) / h - 0.5, 0), len(now) - 1)
                row = []
                for x in range(w):
                    cx = min(max((x + 0.5) * len(now[0]) / w - 0.5, 0), len(now[0]) - 1)
                    a, b = int(cy), int(cx)
                    row.append(sum(at(now, a + j, b + i) * (1 - abs(cy - a - j)) * (1 - abs(cx - b - i)) for j in (0, 1) for i in (0, 1)))
                new.append(row)
            now, scale = new, scale + 1
        assert (k, scale + 1) not in got


def test_oriented_energy_equals_direct_sums(spark):
    grids, df = made(spark, 3)
    got = {(r["image_id"], r["m"], r["y"], r["x"]): r["v"] for r in images.oriented_energy(df, 3).collect()}
    assert len(got) == 3 * sum(len(g) * len(g[0]) for g in grids.values())
    for m in range(3):
        t = math.pi * m / 3
        parts = {}
        for j in range(-4, 5):
            for i in range(-4, 5):
                u, w = i * math.cos(t) + j * math.sin(t), -i * math.sin(t) + j * math.cos(t)
                hull = math.exp(-(u * u + 0.36 * w * w) / 8)
                parts[j, i] = hull * math.cos(2 * math.pi * u / 5), hull * math.sin(2 * math.pi * u / 5)
        mean = [sum(p[n] for p in parts.values()) / 81 for n in (0, 1)]
        for k, g in grids.items():
            for y in range(len(g)):
                for x in range(len(g[0])):
                    even, odd = (sum((p[n] - mean[n]) * at(g, y - j, x - i) for (j, i), p in parts.items()) for n in (0, 1))
                    assert got[k, m, y, x] == pytest.approx(math.hypot(even, odd), abs=1e-9)


def made_nodes(spark):
    rng = random.Random(4)
    places = [(g, x, y) for g in range(3) for x, y in rng.sample([(x, y) for x in range(14) for y in range(14)], 45)]
    nodes = [(g, k, x, y, rng.randrange(3), rng.randrange(1, 400) / 400) for k, (g, x, y) in enumerate(places)]
    return nodes, spark.createDataFrame(nodes, "image_id long, node_id long, x int, y int, m int, r double")


def plain_duplets(nodes, radius, peak_radius, share, most):
    maps = {}
    for g, a, x, y, m, _ in nodes:
        for h, b, u, v, o, r in nodes:
            if g == h and a != b and max(abs(u - x), abs(v - y)) <= radius:
                own = maps.setdefault((m, o), {})
                own[u - x, v - y] = own.get((u - x, v - y), 0) + r
    out = {}
    for key, own in maps.items():
        top, kept = max(own.values()), []
        for d, v in sorted(own.items(), key=lambda e: (-round(e[1], 12), e[0])):
            if v >= share * top and len(kept) < most and all(max(abs(d[0] - p[0]), abs(d[1] - p[1])) > peak_radius for p in kept):
                kept.append(d)
        out[key] = kept
    return out


def test_duplets_equal_a_plain_loop(spark):
    nodes, df = made_nodes(spark)
    got = {}
    for r in learning.duplets(df, radius=4, peak_radius=1, share=0.4, most=3).collect():
        got.setdefault((r["mc"], r["mn"]), set()).add((r["dx"], r["dy"]))
    assert got == {k: set(v) for k, v in plain_duplets(nodes, 4, 1, 0.4, 3).items()}


def test_part_sequences_equal_a_plain_loop(spark):
    nodes, df = made_nodes(spark)
    peaks = [(a, b, dx, dy) for (a, b), own in plain_duplets(nodes, 4, 1, 0.4, 2).items() for dx, dy in own]
    want = {}
    for g, _, x, y, m, _ in nodes:
        subs = []
        for mc, mn, dx, dy in peaks:
            if mc == m:
                near = [r for h, _, u, v, o, r in nodes if h == g and o == mn and abs(u - x - dx) <= 1 and abs(v - y - dy) <= 1 and r >= 0.3]
                if near:
                    subs.append((-max(near), mn, dx, dy))
        subs.sort()
        name = str(m)
        for k, mn, dx, dy in [s for s in subs if -s[0] >= 0.9 * -subs[0][0]][:3]:
            name += f">{mn}@{dx},{dy}"
            want[name] = want.get(name, 0) + 1
    table = spark.createDataFrame(peaks, "mc int, mn int, dx int, dy int")
    got = {r["seq"]: r["n"] for r in learning.part_sequences(df, table, tolerance=1, least=0.3, longest=3).collect()}
    assert got == want and max(s.count(">") for s in got) >= 2


def test_strong_energy_equals_the_filter_on_all_rows(spark):
    _, df = made(spark, 3)
    rows = lambda d: sorted((r.image_id, r.m, r.x, r.y, round(r.v, 9)) for r in d.collect())
    got = rows(images.strong_energy(df, 4, 0.8, 0.5))
    assert got and got == rows(images.strong_features(images.oriented_energy(df, 4), 0.8, 0.5))


def test_the_query_of_energies_has_every_pixel_and_orientation(spark, data):
    found = feature_queries.oriented_energy(spark, data).cache()
    n = projections.nodes(spark, data).select("image_id").distinct().count()
    assert found.count() == found.select("image_id", "m", "x", "y").distinct().count() == n * 6 * 64 * 64
    assert found.selectExpr("min(m)", "max(m)", "min(x)", "max(x)", "min(y)", "max(y)").first() == (0, 5, 0, 63, 0, 63)
    found.unpersist()


def test_images_of_few_pixels_equal_whole_ones(spark):
    whole = [0.0] * 48
    whole[5], whole[40] = 0.5, 2.0
    few = spark.createDataFrame([(7, 0, 8, 6, [40, 5], [2.0, 0.5])], "image_id long, scale int, width int, height int, at array<int>, v array<double>")
    df = spark.createDataFrame([(7, 0, 8, 6, whole)], images.IMAGE)
    for make in (lambda i: images.blurred(i, 5, 1.2), lambda i: images.pyramid(i, factor=0.8, limit=3, most=3)):
        assert make(few).orderBy("scale").collect() == make(df).orderBy("scale").collect()
