"""Faults of large inputs, and operators without SQL form, against plain loops."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from partweave.operators import clustering, graphs, ordering, structure, suppression, variants
from partweave.sources import projections, scratch, text
from partweave.streaming import frames, runs


def test_a_long_chain_is_closed_to_its_end(spark):
    edges = spark.createDataFrame([(k, k + 1, "n") for k in range(30)] + [(30, 0, "n")], "src long, dst long, name string")
    got = {(r.node, r.reached): r.dist for r in graphs.closure(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {(0, k): k for k in range(31)}
    assert graphs.shortest_distances(edges, spark.createDataFrame([(5,)], "node long"), 3).count() == 4


def test_running_sums_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(k % 3, rng.randrange(1000), rng.randrange(9)) for k in range(700)]
    rows = [(a, b * 1000 + k, v) for k, (a, b, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "key int, at long, v long").repartition(7)
    want = {}
    for key in range(3):
        total = 0
        for n, (_, at, v) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            total += v
            want[at] = (total, n)
    got = ordering.running_sum(df, ["key"], ["at"], F.col("v"), "s").join(ordering.numbered(df, ["key"], ["at"], "n").select("at", "n"), "at")
    assert {r.at: (r.s, r.n) for r in got.collect()} == want
    assert [r.n for r in ordering.numbered(df, [], [F.desc("at")], "n").orderBy(F.desc("at")).collect()] == list(range(1, 701))


def test_hull_areas_equal_those_by_half_planes(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(12), rng.randrange(12)) for g in range(8) for _ in range(rng.randrange(1, 14))]
    got = {r.g: r.area for r in clustering.hull_areas(spark.createDataFrame(rows, "g int, x int, y int"), ["g"]).collect()}
    for g in range(8):
        points = {(x, y) for k, x, y in rows if k == g}
        twice = 0.0
        for a, b in itertools.permutations(points, 2):
            side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in points]
            far = all(s > 0 or (s == 0 and (c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1]) <= 0) for s, c in zip(side, points, strict=True))
            twice += a[0] * b[1] - b[0] * a[1] if far else 0
        assert got[g] == abs(twice) / 2


def test_matched_distance_against_all_permutations(spark):
    rng = random.Random(6)
    sets = [([(rng.random(), rng.random()) for _ in range(rng.randrange(0, 5))], [(rng.random(), rng.random()) for _ in range(rng.randrange(0, 5))]) for _ in range(12)]
    point = "array<struct<x:double,y:double>>"
    got = clustering.matched_distance(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(sets)], f"k int, a {point}, b {point}"), "a", "b").collect()
    for r in got:
        a, b = sorted(sets[r.k], key=len)
        want = min((sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(a, order, strict=False)) for order in itertools.permutations(b, len(a))), default=0.0) if a else 0.0
        assert r.cost == pytest.approx(want)


def test_bending_energies(spark):
    point = "array<struct<x:double,y:double>>"
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]
    moved = [(x + 2, 3 * y) for x, y in square]
    bent = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.5, 1.5)]
    rows = [(0, square, moved), (1, square, bent), (2, square, bent[:3]), (3, [], [])]
    got = {r.k: r.energy for r in clustering.bending_energies(spark.createDataFrame(rows, f"k int, a {point}, b {point}"), "a", "b").collect()}
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] > 0.01 and got[2] == -1 and got[3] == 0


def test_greedy_discs_follow_the_loop(spark):
    rng = random.Random(9)
    rows = [(0, k, rng.randrange(20), rng.randrange(20), rng.random()) for k in range(60)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[1])):
        if all((r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2 > 9 for s in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "image_id int, node_id long, x int, y int, r double")
    assert {r.node_id for r in suppression.suppress_points(df, ["image_id"], 3.0, "r", "node_id").collect()} == {r[1] for r in kept}


def test_similarities_look_at_all_orders(spark):
    sub = [(0, 1, 1, 3, 0), (0, 2, 2, -3, 0), (0, 3, 3, 0, 3), (1, 1, 3, 0, 3), (1, 2, 1, 3, 0), (1, 3, 2, -3, 0), (2, 1, 1, 3, 0)]
    types = [(a, a, 1.0) for a in range(4)]
    got = {
        (r.part, r.other): r.similarity
        for r in structure.similarities(spark.createDataFrame(sub, "part int, idx int, sub_m int, dx int, dy int"), spark.createDataFrame(types, "m int, other int, s double"), 2.0, 0.05).collect()
    }
    assert got[0, 1] == got[1, 0] == got[0, 0] == got[2, 2] == pytest.approx(1) and (0, 2) not in got


def test_similarities_equal_all_pairs_and_orders(spark):
    rng = random.Random(3)
    subs = {k: [(rng.randrange(4), rng.randrange(-5, 6), rng.randrange(-5, 6)) for _ in range(rng.randrange(1, 5))] for k in range(25)}
    table = {(a, b): 1.0 if a == b else rng.random() for a in range(4) for b in range(4) if rng.random() < 0.8}
    sub = spark.createDataFrame([(k, i, *t) for k, own in subs.items() for i, t in enumerate(own)], "part int, idx int, sub_m int, dx int, dy int")
    types = spark.createDataFrame([(a, b, s) for (a, b), s in table.items()], "m int, other int, s double")
    for least in (0.1, 0.4):
        want = {}
        for a, b in itertools.product(subs, subs):
            if len(subs[a]) == len(subs[b]):
                term = lambda p, q: table.get((p[0], q[0]), 0.0) * np.exp(-((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) / 8)
                best = max(np.mean([term(p, q) for p, q in zip(subs[a], o, strict=True)]) for o in itertools.permutations(subs[b]))
                if best >= least:
                    want[a, b] = best
        got = {(r.part, r.other): r.similarity for r in structure.similarities(sub, types, 2.0, least).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mask_similarities_are_normalised_correlations(spark):
    masks = {0: {(0, 0): 1.0, (1, 0): 0.5}, 1: {(0, 0): 0.2, (1, 0): 0.1}, 2: {(0, 1): 1.0}, 3: {(0, 0): 0.0}}
    rows = [(m, x, y, v) for m, own in masks.items() for (x, y), v in own.items()]
    got = {(r.m, r.other): r.s for r in structure.mask_similarities(spark.createDataFrame(rows, "m int, x int, y int, v double")).collect()}
    assert got[0, 1] == pytest.approx(1) and (0, 2) not in got and not [k for k in got if 3 in k]


def test_draws_follow_their_weights(spark):
    df = spark.createDataFrame([(n, 0, 10 * n + k, float(w)) for n in range(3000) for k, w in enumerate((1, 2, 5, 0))], "src long, idx int, dst long, r double")
    got = [r.dst % 10 for r in graphs.sampled_children(df, 7).collect()]
    share = [got.count(k) / 3000 for k in range(4)]
    assert len(got) == 3000 and all(abs(a - w / 8) < 0.03 for a, w in zip(share, (1, 2, 5, 0), strict=True)) and share[3] == 0


def test_ways_and_paths_go_to_their_end_and_leave_circles(spark):
    edges = [(k, k + 1, 0) for k in range(12)] + [(5, 99, 1), (50, 51, 0), (51, 52, 0), (52, 51, 0), (60, 60, 0)]
    df = spark.createDataFrame(edges, "src long, dst long, idx int")
    start = spark.createDataFrame([(0,), (12,), (50,), (60,)], "node long")
    assert {(r.node, r.leaf) for r in structure.first_children(df, start).collect()} == {(0, 12), (12, 12)}
    paths = {(r.node, tuple(r.path)): r.reached for r in graphs.edge_paths(df, start).collect()}
    assert paths[0, (0,) * 12] == 12 and paths[0, (0,) * 5 + (1,)] == 99 and paths[50, (0, 0)] == 52
    assert max(len(p) for _, p in paths) == 12 and sum(n == 60 for n, _ in paths) == 1
    assert max(len(r.path) for r in graphs.edge_paths(df, start, 3).collect()) == 3


def test_repeated_batches_replace_what_they_wrote(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 2, 90.0, "a"), (2, 3, 7.0, "b")], "user_id long, event_id long, value double, m string").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ended, state = runs.run_with_state(frames.change_sessions(read(), 30.0))
    assert [(r.user_id, r.session, r.n) for r in ended.collect()] == [(1, 0, 1)]
    assert sorted((r.user_id, r.session, r.n, r.mean_value) for r in frames.open_sessions(state).collect()) == [(1, 1, 1, 90.0), (2, 0, 1, 7.0)]
    folder = runs._run(read(), "append")
    parts = {p.split("/")[-2] for p in spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out").inputFiles()}
    assert parts == {"part-0"}
    assert runs.run_available(read().where("value < 0")).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())
    assert scratch.shared_folder(spark).startswith("file:")


def test_lists_of_rectangles_boxes_points_and_raw_numbers(spark, tmp_path):
    (tmp_path / "r").write_text("a 1 2 3 4 0.5\nbroken\nb 1.9 2 3 4\n\n")
    assert [tuple(r) for r in text.read_rectangles(spark, str(tmp_path / "r")).collect()] == [("a", 1, 2, 3, 4, 0.5), ("b", 1, 2, 3, 4, None)]
    (tmp_path / "n").write_text("x: 1 2 3 4; 5 6 7 8\ny:\nz 1\n")
    assert [tuple(r) for r in text.read_annotations(spark, str(tmp_path / "n")).collect()] == [("x", 0, 1, 2, 3, 4), ("x", 1, 5, 6, 7, 8)]
    (tmp_path / "m").write_text("1 0\n1 2 3 4\n5 6 7 8\n")
    row = text.read_matchings(spark, str(tmp_path / "m")).first()
    assert row.permutation == [1, 0] and [(q.x, q.y) for q in row.source] == [(1, 2), (3, 4)] and row.target[1].y == 8
    values = np.arange(70_000) / 2
    values.tofile(tmp_path / "raw")
    got = text.read_raw_numbers(spark, str(tmp_path / "raw")).orderBy("at").toPandas()
    assert (got.v.to_numpy() == values).all() and (got["at"] == np.arange(70_000)).all()


def test_subspace_distances_and_principal_axes(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 5)) @ rng.standard_normal((5, 5))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, h array<double>").repartition(3)
    mean, values, axes = clustering.principal_axes(df, "h", 2)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert values == pytest.approx((s**2 / len(x))[:2])
    want = ((centred - centred @ vt[:2].T @ vt[:2]) ** 2).sum(axis=1)
    got = {r.id: r.d2 for r in variants.subspace_distances(df, mean.tolist(), axes.T.tolist()).collect()}
    assert [got[k] for k in range(40)] == pytest.approx(want.tolist(), abs=1e-9)


def test_copies_of_parts_are_compared_once(spark):
    rng = random.Random(8)
    kinds = [[(rng.randrange(3), rng.randrange(-2, 3), rng.randrange(-2, 3)) for _ in range(rng.randrange(1, 4))] for _ in range(12)]
    subs = {k: rng.sample(kinds[k % 12], len(kinds[k % 12])) for k in range(60)}
    sub = spark.createDataFrame([(k, i, *t) for k, own in subs.items() for i, t in enumerate(own)], "part int, idx int, sub_m int, dx int, dy int")
    types = spark.createDataFrame([(a, b, 1.0 if a == b else 0.9) for a in range(3) for b in range(3)], "m int, other int, s double")
    members, alike = structure.alike_classes(sub, types, 2.0, 0.8)
    assert {r["part"]: r["class"] for r in members.collect()} == {k: min(j for j in subs if sorted(subs[j]) == sorted(subs[k])) for k in subs}
    assert alike.count() <= 144
    term = lambda p, q: (1.0 if p[0] == q[0] else 0.9) * np.exp(-((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) / 8)
    want = {}
    for a, b in itertools.product(subs, subs):
        if len(subs[a]) == len(subs[b]):
            best = max(np.mean([term(p, q) for p, q in zip(subs[a], o, strict=True)]) for o in itertools.permutations(subs[b]))
            if best >= 0.8:
                want[a, b] = best
    got = {(r.part, r.other): r.similarity for r in structure.similarities(sub, types, 2.0, 0.8).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_of_similar_parts_do_not_move(spark):
    sub = spark.createDataFrame([(k, 1, 0, k % 5, 0) for k in range(50)], "part int, idx int, sub_m int, dx int, dy int")
    types = spark.createDataFrame([(0, 0, 1.0)], "m int, other int, s double")
    found = structure.similarities(sub, types, 2.0, 0.8)
    assert found.count() == 50 * 10 + 4 * 2 * 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "InArrow" in plan


def test_each_two_classes_have_one_row(spark):
    rng = random.Random(5)
    sub = spark.createDataFrame([(k, i, rng.randrange(3), rng.randrange(-2, 3), rng.randrange(-2, 3)) for k in range(60) for i in range(k % 3 + 1)], "part int, idx int, sub_m int, dx int, dy int")
    types = spark.createDataFrame([(a, b, 1.0 if a == b else 0.9) for a in range(3) for b in range(3)], "m int, other int, s double")
    both, single = ({(r["class"], r["other"]): r["similarity"] for r in structure.alike_classes(sub, types, 2.0, 0.8, once=once)[1].collect()} for once in (False, True))
    assert set(single) == {(a, b) for a, b in both if a <= b} and len(single) < len(both)
    assert all(abs(single[k] - both[k]) < 1e-12 for k in single)


@pytest.mark.parametrize("most, pairs", [(4096, 1 << 18), (4096, 7), (0, 1 << 18)])
def test_moves_that_are_looked_up_give_all_similar_pairs(spark, monkeypatch, most, pairs):
    """In pieces, and by comparing where there are too many moves."""
    monkeypatch.setattr(structure, "PAIRS", pairs)
    rng = np.random.default_rng(12)
    for n, least in ((1, 0.8), (2, 0.8), (3, 0.85), (3, 0.8)):
        rows = rng.integers(-4, 5, (120, n, 2))
        rows[60:] = rows[rng.integers(0, 60, 60)][:, rng.permutation(n)] + rng.integers(-1, 2, (60, n, 2))
        asks = np.arange(120) % 3 == 0
        monkeypatch.setattr(structure, "MOST_MOVES", most)
        moves = structure._moves(n, 1.0, 2.0, least)
        assert (moves is None) == (most == 0)
        if moves is None:
            continue
        got = [p for a, b in structure._moved_pairs(rows[:, :, 0], rows[:, :, 1], asks, moves) for p in zip(a.tolist(), b.tolist(), strict=True)]
        mean = lambda a, b: max(np.exp(-((rows[a] - rows[b][list(o)]) ** 2).sum(axis=1) / 8).mean() for o in itertools.permutations(range(n)))
        want = {(a, b) for a in np.flatnonzero(asks).tolist() for b in np.flatnonzero(~asks).tolist() if mean(a, b) >= least}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    far = np.array([[[0, 0]] * 4, [[10**9, 10**9]] * 4])
    assert structure._moved_pairs(far[:, :, 0], far[:, :, 1], np.array([True, False]), (np.zeros((1, 4)), np.zeros((1, 4)))) is None


def test_type_masks_count_nodes_without_a_place(spark, tmp_path):
    """A null part gives a node that counts in its type and meets no other."""
    rows = [(0, 0, 1), (0, 1, 1), (0, 0, 2), (64, None, 1), (64, None, 7), (None, 0, 1), (None, 1, 1), (70, 5, 1)]
    lines = spark.createDataFrame([(o, p, n, 1.0, 0.1, 0.1) for o, p, n in rows], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {(m, x, y): v for m, x, y, v in con.sql(projections.LIBRARY["masks"]).fetchall()}
    assert {(r.m, r.x, r.y): r.v for r in projections.type_masks(spark, str(tmp_path)).collect()} == want


def test_the_first_similar_class_of_each(spark):
    rng = random.Random(6)
    sub = spark.createDataFrame([(k, i, rng.randrange(3), rng.randrange(-2, 3), rng.randrange(-2, 3)) for k in range(60) for i in range(k % 3 + 1)], "part int, idx int, sub_m int, dx int, dy int")
    types = spark.createDataFrame([(a, b, 1.0 if a == b else 0.9) for a in range(3) for b in range(3)], "m int, other int, s double")
    classes = structure.part_classes(sub).where("part = class")
    every = structure.class_similarities(classes, types, 2.0, 0.8).groupBy("class").agg(F.min("other")).collect()
    first = structure.class_similarities(classes, types, 2.0, 0.8, first=True).groupBy("class").agg(F.min("other")).collect()
    assert sorted(first) == sorted(every) and len(every) > 10


def test_places_decide_where_types_are_nearly_alike(spark):
    rng = random.Random(7)
    sub = spark.createDataFrame([(k, i, rng.randrange(3), rng.randrange(-2, 3), rng.randrange(-2, 3)) for k in range(60) for i in range(k % 3 + 1)], "part int, idx int, sub_m int, dx int, dy int")
    types = lambda s, n=3: spark.createDataFrame([(a, b, 1.0 if a == b else s) for a in range(n) for b in range(n)], "m int, other int, s double")
    near = types(0.99999)
    members, places, one = structure.place_classes(sub, near, 2.0, 0.8)
    named = {r["part"]: r["class"] for r in members.collect()}
    found = {(r["class"], r["other"]) for r in structure.class_similarities(places, one, 2.0, 0.8).collect()}
    want = {(r["part"], r["other"]) for r in structure.similarities(sub, near, 2.0, 0.8).collect()}
    assert {(a, b) for a in named for b in named if (named[a], named[b]) in found} == want
    assert len(set(named.values())) < structure.part_classes(sub).select("class").distinct().count()
    # Types that part some pairs, or have no mask, decide themselves.
    assert structure.place_classes(sub, types(0.9), 2.0, 0.8) is None
    assert structure.place_classes(sub, types(0.99999, 2), 2.0, 0.8) is None
    assert structure.place_classes(sub, types(0.99999), 2.0, (1 + np.exp(-1 / 8)) / 2) is None
