"""Covers, growing models, shape models, combinations and alignments against plain versions."""

import random
from itertools import combinations as subsets

import numpy as np
import pytest
from pyspark.sql import functions as F

from partweave.operators import alignment, covers, growth, mining, shapes
from partweave.plans import object_queries as oq
from partweave.sources import projections


def made_nodes(seed, images=3, count=40, side=24, types=3):
    rng = random.Random(seed)
    rows = []
    for image in range(images):
        places = rng.sample(range(side * side), count)
        for k, place in enumerate(places):
            x, y = place % side, place // side
            rows.append((image, image * 1000 + k, x, y, rng.randrange(types), rng.randrange(1, 100) / 100, [(y + j) * 100 + x + i for i in range(3) for j in range(3)]))
    return rows


NODE = "image_id long, node_id long, x int, y int, m int, r double, points array<long>"


# --- covers ------------------------------------------------------------------


def plain_objects(layers, every, rules, top, depths):
    """Objects of one image as a plain recursion; layers: z -> list of CoverNode."""

    def down(depth, covered):
        if depth == depths:
            return []
        nodes, cut = layers.get(top - depth, []), rules.at("overlap", depth)
        alive = sorted((n for n in nodes if n.points and len(n.points & covered) / len(n.points) < cut), key=lambda n: (-n.value, n.node_id))
        if not alive:
            return []
        whole = set()
        for n in nodes:
            whole |= n.points
        room = len(whole - covered)
        tabu, out = [], []
        for number in range(rules.at("most_covers", depth)):
            chosen, held = [], set()
            for n in alive:
                if not (len(held) < rules.at("enough", depth) * room and len(chosen) <= rules.at("most_parts", depth)):
                    break
                if tabu:
                    (tx, ty), forbidden = tabu[0]
                    if (n.x - tx) ** 2 + (n.y - ty) ** 2 <= rules.tabu_radius**2 or n.m in forbidden:
                        continue
                if len(n.points & held) <= int(cut * len(n.points)):
                    chosen.append(n)
                    held |= n.points
            if tabu:
                tabu.pop(0)
            for n in chosen:
                types = [n.m]
                for o in alive:
                    if abs(o.x - n.x) <= rules.types_radius and abs(o.y - n.y) <= rules.types_radius and o.m not in types and len(types) < rules.most_types:
                        if len(n.points & o.points) >= rules.types_share * len(n.points):
                            types.append(o.m)
                tabu.append(((n.x, n.y), set(types)))
            value = len(held & every) / len(every) if every else 0
            ids = [n.node_id for n in chosen]
            if len(chosen) >= rules.at("least_parts", depth) and value >= rules.at("enough", depth):
                out.append((f"{number}.", value, ids))
            else:
                below = sorted(down(depth + 1, frozenset(held)))[: rules.at("most_added", depth + 1)]
                out += [(f"{number}.{name}", value, ids + more) for name, _, more in below]
        return out

    return down(0, frozenset())


@pytest.mark.parametrize("enough", [(0.3, 0.3), (0.6, 0.1)])
def test_covers_equal_a_plain_recursion(spark, enough):
    rng = random.Random(4)
    rules = covers.CoverRules(enough=enough, most_parts=(4, 6), least_parts=(2, 1), overlap=(0.4, 0.3))
    rows, want = [], {}
    for image in range(6):
        layers = {}
        for z, count, size in ((2, 5, 12), (1, 14, 10)):
            for k in range(count):
                points = frozenset(rng.sample(range(40), rng.randrange(1, size)))
                n = covers.CoverNode(image * 1000 + z * 100 + k, rng.randrange(20), rng.randrange(20), rng.randrange(5), rng.randrange(6) / 5, points)
                layers.setdefault(z, []).append(n)
                rows.append((image, z, n.node_id, n.x, n.y, n.m, n.value, sorted(points)))
        every = frozenset(range(40))
        for name, value, ids in plain_objects(layers, every, rules, 2, 2):
            want[image, name] = (round(value, 9), ids)
    supports = spark.createDataFrame(rows, "image_id long, z int, node_id long, x int, y int, m int, value double, points array<long>")
    points = spark.createDataFrame([(k, list(range(40))) for k in range(6)], "image_id long, points array<long>")
    got = covers.covering_objects(supports, points, top=2, depths=2, rules=rules).collect()
    assert {(r["image_id"], r["object"]): (round(r["value"], 9), [t["node_id"] for t in r["parts"]]) for r in got} == want
    depths = {name.count(".") for _, name in want}
    assert 1 in depths if enough[0] == 0.3 else 2 in depths
    none = covers.covering_objects(supports.where("false"), points, top=2, depths=2)
    assert none.collect() == []


# --- growing models ----------------------------------------------------------


def test_peaks_of_blurred_maps():
    counts = np.zeros((21, 21))
    counts[10, 10], counts[18, 10], counts[4, 16], counts[5, 16], counts[0, 0] = 50, 9, 6, 5, 1
    got = growth.blurred_peaks(counts, sigma=0.75, share=0.05, radius=3, most=7)
    assert [(dx, dy) for dx, dy, _ in got][:2] in ([(8, 0), (-6, 6)], [(-6, 6), (8, 0)])
    assert (0, 0) not in [(dx, dy) for dx, dy, _ in got]  # the middle is shut
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) > 3 for a, b in subsets(got, 2))
    assert growth.blurred_peaks(np.zeros((5, 5)), sigma=0.75, share=0.05, radius=1, most=3) == []
    # The blur against a plain double sum.
    reach = 2
    k = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * 0.75**2))
    k /= k.sum()
    v = sum(counts[18 + i, 10 + j] * k[i + reach] * k[j + reach] for i in range(-2, 3) for j in range(-2, 3))
    assert abs(dict(((a, b), c) for a, b, c in got)[8, 0] - v) < 1e-6


def test_many_images_take_one_call_and_keep_large_ids(spark):
    large = 2**60
    supports = spark.createDataFrame([(i, z, large + 10 * i + z, 1, 1, 0, 1.0, [1, 2, 3]) for i in range(30) for z in (1, 2)], "image_id long, z int, node_id long, x int, y int, m int, value double, points array<long>")
    points = spark.createDataFrame([(i, [1, 2, 3]) for i in range(30)], "image_id long, points array<long>")
    found = covers.covering_objects(supports, points, top=2, depths=1, rules=covers.CoverRules(least_parts=(1,)))
    assert {(r.image_id, tuple(p.node_id for p in r.parts)) for r in found.collect() if r.object == "0."} == {(i, (large + 10 * i + 2,)) for i in range(30)}


def plain_models(rows, peaks, tolerance, longest, overlap, alike, distinct, start_overlap, most_starts, most_types):
    """A depth-first recursion over one image at a time."""
    often = {}
    for r in rows:
        often[r[4]] = often.get(r[4], 0) + 1
    out = {}
    for image in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == image), key=lambda r: (-often[r[4]], r[4], -r[5], r[1]))
        rank = {r[1]: k for k, r in enumerate(own)}
        by_id = {r[1]: r for r in own}

        def positions(model, held, m):
            found = {}
            for part in model:
                _, _, x, y, pm, _, _ = by_id[part]
                for a, b, _, dx, dy in peaks:
                    if (a, b) != (pm, m):
                        continue
                    near = [r for r in own if r[4] == m and abs(r[2] - x - dx) <= tolerance and abs(r[3] - y - dy) <= tolerance]
                    if near:
                        best = max(near, key=lambda r: (r[5], -r[1]))
                        if rank[best[1]] > rank[model[-1]] and len(set(best[6]) & held) < overlap * len(best[6]):
                            found[best[1]] = set(best[6])
            kept = []
            for n in sorted(found, key=rank.get):
                if all(len(found[n] & o) < alike * len(o) for _, o in kept):
                    kept.append((n, found[n]))
            return kept

        def down(model, held):
            out.setdefault(image, set())
            if len(model) >= 2:
                out[image].add(tuple(model))
            if len(model) == longest:
                return
            known, used = [], 0
            every = {m for a, m, *_ in peaks if a in {by_id[n][4] for n in model}}
            options = {}
            for m in every:  # types in the order of their first candidate
                raw = [n for part in model for n in candidates_of(part, m, model)]
                if raw:
                    options[m] = min(rank[n] for n in raw)
            for m in sorted(options, key=options.get):
                taken = False
                for n, points in positions(model, held, m):
                    if all(len(points & o) < distinct * len(points) for o in known):
                        known.append(points)
                        taken = True
                        down([*model, n], held | points)
                used += taken
                if used == most_types:
                    break

        def candidates_of(part, m, model):
            _, _, x, y, pm, _, _ = by_id[part]
            for a, b, _, dx, dy in peaks:
                if (a, b) == (pm, m):
                    near = [r for r in own if r[4] == m and abs(r[2] - x - dx) <= tolerance and abs(r[3] - y - dy) <= tolerance]
                    if near:
                        best = max(near, key=lambda r: (r[5], -r[1]))
                        if rank[best[1]] > rank[model[-1]]:
                            yield best[1]

        starts = []
        for r in own:
            if all(len(set(r[6]) & s) < start_overlap * len(r[6]) for _, s in starts):
                starts.append((r[1], set(r[6])))
        for n, points in starts[:most_starts]:
            down([n], points)
    return out


def test_models_equal_a_plain_recursion(spark):
    rows = made_nodes(8, count=60)
    peaks = [(a, b, k, dx, dy) for a in range(3) for b in range(3) for k, (dx, dy) in enumerate([(3, 1), (-2, 4)])]
    nodes = spark.createDataFrame(rows, NODE)
    table = spark.createDataFrame(peaks, "m int, o_m int, peak int, dx int, dy int")
    options = {"tolerance": 2, "longest": 4, "overlap": 0.4, "alike": 0.6, "distinct": 0.5, "start_overlap": 0.7, "most_starts": 4, "most_types": 2}
    got = growth.object_models(nodes, table, **options, most_models=10_000).collect()
    want = plain_models(rows, peaks, **options)
    assert {i: {tuple(r["model"]) for r in got if r["image_id"] == i} for i in want} == want
    assert max(map(len, (r["model"] for r in got))) == 4
    assert all(set(r["points"]) == set().union(*(set(x[6]) for x in rows if x[1] in r["model"])) for r in got)
    few = growth.object_models(nodes, table, **options, most_models=2).groupBy("image_id", F.size("model").alias("n")).count().collect()
    assert max(r["count"] for r in few) <= 2
    boxes = growth.model_boxes(spark.createDataFrame([(0, [rows[0][1], rows[1][1]])], "image_id long, model array<long>"), nodes).first()
    assert (boxes["llx"], boxes["urx"]) == (min(rows[0][2], rows[1][2]), max(rows[0][2], rows[1][2]) + 1)


# --- shape models ------------------------------------------------------------


def test_shape_models_equal_numpy(spark):
    rng = np.random.default_rng(5)
    data = {k: rng.normal(0, 1, (n, 3)) @ rng.normal(0, 1, (3, 6)) + rng.normal(0, 0.2, (n, 6)) for k, n in (("a", 200), ("b", 31), ("c", 1))}
    rows = [(k, i, [float(v) for v in x], [float((i + j) % 4 != 0) for j in range(6)]) for k, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame([*rows, ("a", 999, None, None)], "key string, id long, v array<double>, mask array<double>").repartition(5)
    states = shapes.merged_states(shapes.covariance_states(df, "key", "v"), "key").cache()
    cov = {(r["key"], r["i"], r["j"]): r["cov"] for r in shapes.covariances(states, "key").collect()}
    models = shapes.shape_models(states, "key", share=0.9)
    found = {r["key"]: r for r in models.collect()}
    for k, xs in data.items():
        want = np.cov(xs.T, bias=True) if len(xs) > 1 else np.zeros((6, 6))
        assert all(abs(cov[k, i, j] - want[i, j]) < 1e-9 for i in range(6) for j in range(i, 6))
        values, axes = np.linalg.eigh(want)
        values = values[::-1]
        count = len(found[k]["eigenvalues"])
        assert count == (0 if k == "c" else int(np.searchsorted(np.cumsum(values), 0.9 * values.sum())) + 1)
        assert np.allclose(found[k]["eigenvalues"], values[:count]) and np.allclose(found[k]["mean"], xs.mean(axis=0))
        assert all(abs(abs(np.dot(a, axes[:, -1 - n])) - 1) < 1e-6 for n, a in enumerate(found[k]["eigenvectors"]))
    for mask in (None, "mask"):
        for r in shapes.projected(df.where("v IS NOT NULL"), models, "key", "v", mask).collect():
            own = found[r["key"]]
            w = np.array(r["mask"]) if mask else np.ones(6)
            axes = np.array(own["eigenvectors"]).reshape(-1, 6)
            c = axes @ ((np.array(r["v"]) - own["mean"]) * w)
            back = own["mean"] + c @ axes
            assert np.allclose(r["coefficients"], c) and np.allclose(r["reconstruction"], back)
            assert abs(r["distance"] - np.sqrt((((np.array(r["v"]) - back) ** 2) * w).sum())) < 1e-9
            values = np.array(own["eigenvalues"])
            assert abs(r["density"] - np.exp(-(c[values > 0.01] ** 2 / values[values > 0.01]).sum() / 2)) < 1e-9


# --- combinations ------------------------------------------------------------


def test_combinations_equal_all_subsets(spark):
    rng = random.Random(6)
    rows = [(c % 3, c, c % 2, s, rng.randrange(4) + 10 * c, rng.random(), rng.sample(range(12), 4)) for c in range(12) for s in rng.sample(range(6), rng.randrange(6))]
    df = spark.createDataFrame(rows, "image_id long, centre long, centre_m int, sub int, node_id long, r double, points array<long>")
    for least, most in ((0, None), (1, 3)):
        got = mining.combinations(df, longest=3, least_shared=least, most_shared=most).collect()
        want = set()
        for c in range(12):
            own = sorted((r for r in rows if r[1] == c), key=lambda r: r[3])
            for n in (1, 2, 3):
                for chosen in subsets(own, n):
                    held, fits = set(chosen[0][6]), len({r[4] for r in chosen}) == n
                    for r in chosen[1:]:
                        shared = len(held & set(r[6]))
                        fits &= least <= shared and (most is None or shared <= most)
                        held |= set(r[6])
                    if fits:
                        want.add((c, tuple(r[3] for r in chosen), round(sum(r[5] for r in chosen), 9)))
        assert {(r["centre"], tuple(r["subs"]), round(r["value"], 9)) for r in got} == want
        assert len(got) == len(want)


# --- alignments --------------------------------------------------------------


def plain_alignment(path_a, path_b, edges_b):
    partner = {}
    for i, n in enumerate(path_a):
        f = (len(path_b) - 1) / (len(path_a) - 1) if len(path_a) > 1 else 0
        partner[path_b[int(f * i + 0.5)]] = n
    origin, near = {n: n for n in partner}, {}
    for a, b in edges_b:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    front = set(partner)
    while front:
        ahead = {}
        for n in front:
            for o in near.get(n, ()):
                if o not in origin:
                    ahead[o] = min(ahead.get(o, origin[n]), origin[n])
        origin |= ahead
        front = set(ahead)
    return {n: partner[o] for n, o in origin.items()}


def test_trees_align_as_in_a_plain_loop(spark):
    rng = random.Random(7)
    trees, edges, paths = {}, [], []
    for t in range(8):
        n = rng.randrange(2, 14)
        own = [(t * 100 + rng.randrange(k), t * 100 + k) for k in range(1, n)]
        trees[t] = own
        edges += [(f"t{t}", a, b) for a, b in own]
    from partweave.operators.paths import longest_paths

    table = spark.createDataFrame(edges, "tree string, a long, b long")
    found = {r["tree"]: list(r["path"]) for r in longest_paths(table, ["tree"]).collect()}
    paths = spark.createDataFrame([(k, v) for k, v in found.items()], "tree string, path array<long>")
    pairs = spark.createDataFrame([(f"{a}-{b}", f"t{a}", f"t{b}") for a in range(8) for b in (0, 3, 5)], "pair string, tree_a string, tree_b string")
    got = alignment.aligned_trees(pairs, paths, table).collect()
    for a in range(8):
        for b in (0, 3, 5):
            want = plain_alignment(found[f"t{a}"], found[f"t{b}"], trees[b])
            assert {r["node"]: r["partner"] for r in got if r["pair"] == f"{a}-{b}"} == want
            assert len(want) == len({n for e in trees[b] for n in e})
    points = spark.createDataFrame([(n, n % 7, n % 5) for n in range(800)], "node long, x int, y int")
    cost = {r["pair"]: r["cost"] for r in alignment.alignment_cost(spark.createDataFrame(got), points).collect()}
    own = [r for r in got if r["pair"] == "1-3"]
    assert cost["1-3"] == sum((r["node"] % 7 - r["partner"] % 7) ** 2 + (r["node"] % 5 - r["partner"] % 5) ** 2 for r in own)


def test_translations_equal_a_search_over_all(spark):
    rng = random.Random(11)
    sets = {0: [(rng.randrange(3), rng.randrange(30), rng.randrange(30)) for _ in range(25)]}
    sets[1] = [(m, x + 4 + rng.randrange(-1, 2), y - 3) for m, x, y in sets[0][:18]]
    sets[2] = [(rng.randrange(3), rng.randrange(30), rng.randrange(30)) for _ in range(20)]
    table = spark.createDataFrame([(k, *p) for k, own in sets.items() for p in own], "set int, label int, x int, y int")
    pairs = spark.createDataFrame([("a", 0, 1), ("b", 1, 2), ("c", 0, 0)], "pair string, set_a int, set_b int")
    got = {r["pair"]: (r["dx"], r["dy"], r["n"]) for r in alignment.best_translations(table, pairs, tolerance=1, reach=6).collect()}

    def best(a, b):
        def count(dx, dy):
            return sum(any(m == o and abs(x + dx - u) <= 1 and abs(y + dy - v) <= 1 for o, u, v in b) for m, x, y in set(a))

        return min(((-count(dx, dy), dx * dx + dy * dy, dx, dy) for dx in range(-6, 7) for dy in range(-6, 7)))

    for name, a, b in (("a", 0, 1), ("b", 1, 2), ("c", 0, 0)):
        n, _, dx, dy = best(sets[a], sets[b])
        assert got[name] == (dx, dy, -n)
    assert abs(got["a"][0] - 4) <= 1 and abs(got["a"][1] + 3) <= 1


# --- on the tables -----------------------------------------------------------


def test_validated_models_count_hits_as_a_plain_loop(spark, data):
    nodes = {(r["image_id"], r["node_id"]): r for r in projections.nodes(spark, data).collect()}
    truth = {}
    for t in projections.ground_truth(spark, data).collect():
        truth.setdefault(t["image_id"], []).append((t["llx"], t["lly"], t["urx"], t["ury"]))
    hits = {}
    for r in oq.grown_models(spark, data).collect():
        own = [nodes[r["image_id"], int(n)] for n in r["model"].split(",")]
        box = (min(n["x"] for n in own), min(n["y"] for n in own), max(n["x"] for n in own) + 1, max(n["y"] for n in own) + 1)
        best = 0.0
        for t in truth.get(r["image_id"], ()):
            w, h = min(box[2], t[2]) - max(box[0], t[0]), min(box[3], t[3]) - max(box[1], t[1])
            if w > 0 and h > 0:
                best = max(best, w * h / ((box[2] - box[0]) * (box[3] - box[1]) + (t[2] - t[0]) * (t[3] - t[1]) - w * h))
        kind = ",".join(str(n["m"]) for n in own)
        a, b = hits.get(kind, (0, 0))
        hits[kind] = (a + (best >= 0.2), b + (best < 0.2))
    want = {k: v for k, v in hits.items() if v[0] > 0 and v[0] / sum(v) >= 0.05}
    got = {r["m"]: (r["n_hits"], r["n_misses"]) for r in oq.validated_models(spark, data).collect()}
    assert got == want and len(got) > 3


def test_reconstructions_of_the_tables_equal_numpy(spark, data):
    rows = oq.line_shapes(spark, data).collect()
    got = {r["id"]: r for r in oq.masked_reconstructions(spark, data).collect()}
    for key in {r["key"] for r in rows}:
        own = [r for r in rows if r["key"] == key]
        xs = np.array([r["shape"] for r in own])
        values, axes = np.linalg.eigh(np.cov(xs.T, bias=True))
        values, axes = values[::-1], axes.T[::-1]
        count = int(np.searchsorted(np.cumsum(values), 0.95 * values.sum())) + 1
        for r, x in zip(own, xs, strict=True):
            w = np.array([float((r["id"] + k) % 3 != 0) for k in range(8)])
            back = xs.mean(axis=0) + (axes[:count] @ ((x - xs.mean(axis=0)) * w)) @ axes[:count]
            assert abs(got[r["id"]]["distance"] - np.sqrt((((x - back) ** 2) * w).sum())) < 2e-4


def test_models_grow_in_their_images_task(spark, data):
    """No node meets another by a join; offsets of peaks are those of all pairs."""
    plan = oq.grown_models(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join Inner" not in plan.replace("Join Cross", "")
    sets = [frozenset(random.Random(k).sample(range(12), 4)) for k in range(30)]
    assert [growth.first_apart(sets, 0.6, n) for n in (0, 3, 30)] == [growth.apart(sets, [], 0.6, False)[:n] for n in (0, 3, 30)]


def test_validated_models_grow_once(spark, data):
    """Models are written and read again, so the final plan grows none."""
    plan = oq.validated_models(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
