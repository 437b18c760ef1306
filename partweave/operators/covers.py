"""Objects as covers of an image's support: greedy covers with a tabu list, going on
layer by layer below where a cover leaves points open.

A state is one object in the making: the points that it has covered and its parts. A
round takes the states of one depth to the nodes of the layer that the depth looks at
and makes up to ``most_covers`` covers of each state. Covers that suffice are objects;
the others are the states of the next depth, and what is found below is added to them.
States are rows: an image has at most the product of ``most_covers`` over the depths.

Of one state, covers are made in turn. A cover takes nodes by response, best first,
unless the node stands within ``tabu_radius`` of the tabu list's first entry or has one
of its types, or shares more than ``overlap`` of its points with the cover so far. It ends
with ``enough`` of the layer's open points, or ``most_parts`` + 1 parts. Each cover drops the
first entry of the list and adds one for each of its parts, so the next cover begins
elsewhere. A part stands for the types of near nodes with much the same points as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.operators.keyed import by_keys
from partweave.sources.scratch import stored

PART = "struct<z:int,node_id:long,x:int,y:int,types:array<int>>"
STATE = f"state string, depth int, covered array<long>, parts array<{PART}>, value double, done boolean"
#: The same for Arrow.
TYPES = [
    pa.string(), pa.int32(), pa.list_(pa.int64()),
    pa.list_(pa.struct([("z", pa.int32()), ("node_id", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("types", pa.list_(pa.int32()))])), pa.float64(), pa.bool_(),
]


@dataclass(frozen=True)
class CoverRules:
    """One entry a depth, from the top layer down; the last holds for all below."""

    most_covers: tuple[int, ...] = (3, 2)
    most_parts: tuple[int, ...] = (6,)
    least_parts: tuple[int, ...] = (2,)
    enough: tuple[float, ...] = (0.7,)
    overlap: tuple[float, ...] = (0.3,)
    most_added: tuple[int, ...] = (2,)
    tabu_radius: int = 3
    types_radius: int = 4
    types_share: float = 0.6
    most_types: int = 3

    def at(self, name: str, depth: int):
        found = getattr(self, name)
        return found[min(depth, len(found) - 1)]


@dataclass(frozen=True)
class CoverNode:
    node_id: int
    x: int
    y: int
    m: int
    value: float
    points: frozenset[int]


def covers_of(nodes: list[CoverNode], covered: frozenset[int], rules: CoverRules, depth: int) -> Iterator[tuple[list[tuple[CoverNode, list[int]]], frozenset[int]]]:
    """(parts with their types, points) of each cover of one state."""
    overlap = rules.at("overlap", depth)
    open_nodes = [n for n in nodes if n.points and len(n.points & covered) < overlap * len(n.points)]
    if not open_nodes:
        return
    open_nodes.sort(key=lambda n: (-n.value, n.node_id))
    aim = rules.at("enough", depth) * len(frozenset().union(*(n.points for n in nodes)) - covered)
    tabu: list[tuple[int, int, frozenset[int]]] = []
    for _ in range(rules.at("most_covers", depth)):
        parts: list[tuple[CoverNode, list[int]]] = []
        held: set[int] = set()
        for n in open_nodes:
            if len(held) >= aim or len(parts) > rules.at("most_parts", depth):
                break
            if tabu and ((n.x - tabu[0][0]) ** 2 + (n.y - tabu[0][1]) ** 2 <= rules.tabu_radius**2 or n.m in tabu[0][2]):
                continue
            if len(n.points & held) <= int(overlap * len(n.points)):
                parts.append((n, [n.m]))
                held |= n.points
        tabu = tabu[1:]
        for n, types in parts:
            near = [o for o in open_nodes if max(abs(o.x - n.x), abs(o.y - n.y)) <= rules.types_radius]
            for o in near:
                if len(types) < rules.most_types and o.m not in types and len(n.points & o.points) >= rules.types_share * len(n.points):
                    types.append(o.m)
            tabu.append((n.x, n.y, frozenset(types)))
        yield parts, frozenset(held)


COLUMNS = ["kind", "state", "node_id", "x", "y", "m", "value", "points"]


def _round(rules: CoverRules, depth: int, z: int):
    def image(rows: list[tuple]) -> list[tuple]:
        """One image's states: its nodes of the layer (kind 0), all its points (1), its states (2)."""
        nodes = [CoverNode(i, x, y, m, value, frozenset(points)) for kind, _, i, x, y, m, value, points in rows if kind == 0]
        every = {p for row in rows if row[0] == 1 for p in row[-1]}
        out = []
        for state, points in sorted((row[1], row[-1]) for row in rows if row[0] == 2):
            for number, (parts, held) in enumerate(covers_of(nodes, frozenset(points), rules, depth)):
                value = len(held & every) / len(every) if every else 0.0
                done = len(parts) >= rules.at("least_parts", depth) and value >= rules.at("enough", depth)
                own = [{"z": z, "node_id": n.node_id, "x": n.x, "y": n.y, "types": types} for n, types in parts]
                out.append((f"{state}{number}.", depth, sorted(held), own, value, done))
        return out

    def run(ends: np.ndarray, *columns: np.ndarray) -> tuple:
        """Many images."""
        *plain, points = columns
        rows = list(zip(*(c.tolist() for c in plain), [p.tolist() for p in points], strict=True))
        found = [image(rows[start:end]) for start, end in zip(ends[:-1], ends[1:], strict=True)]
        made = list(zip(*(row for own in found for row in own), strict=True)) or [()] * 6
        return np.repeat(np.arange(len(found)), [len(own) for own in found]), *[pa.array(c, kind) for c, kind in zip(made, TYPES, strict=True)]

    return run


def covering_objects(supports: DataFrame, points: DataFrame, top: int, depths: int, rules: CoverRules | None = None) -> DataFrame:
    """(image_id, object, value, n_parts, parts): ``supports`` is (image_id, z, node_id,
    x, y, m, value, points array<long>), ``points`` (image_id, points) all points of an
    image. ``object`` spells the cover's number at each depth. An image without nodes of
    the top layer, or whose nodes have no points, gives no object."""
    rules = rules or CoverRules()
    none = "CAST(NULL AS {}) AS {}"
    # Not null, which would make the ids floating-point numbers.
    blank = ["CAST(0 AS BIGINT) AS node_id", *[f"0 AS {c}" for c in "xym"]]
    nodes = supports.selectExpr("image_id", "0 AS kind", none.format("string", "state"), "z", "node_id", "x", "y", "m", "value", "points")
    every = points.selectExpr("image_id", "1 AS kind", none.format("string", "state"), "CAST(NULL AS INT) AS z", *blank, none.format("double", "value"), "points")
    states = supports.select("image_id").distinct().selectExpr("image_id", "'' AS state", "CAST(array() AS array<bigint>) AS covered")
    rounds = []
    for depth in range(depths):
        z = top - depth
        rows = nodes.where(F.col("z") == z).unionByName(every).unionByName(
            states.selectExpr("image_id", "2 AS kind", "state", "CAST(NULL AS INT) AS z", *blank, none.format("double", "value"), "covered AS points")
        )
        found = stored(by_keys(rows, ["image_id"], COLUMNS, ["kind"], STATE, _round(rules, depth, z)), "covers")
        rounds.append(found)
        states = found.where("NOT done").select("image_id", "state", "covered")
        if states.limit(1).count() == 0:
            break
    # From the lowest depth up: what a state has found below is added to its parts.
    objects = None
    for depth in range(len(rounds) - 1, -1, -1):
        found = rounds[depth]
        own = found.where("done").select("image_id", "state", "value", "parts")
        if objects is not None:
            below = objects.withColumn("parent", F.regexp_extract("state", rf"^((?:[0-9]+[.]){{{depth + 1}}})", 1)).withColumnRenamed("parts", "more").withColumnRenamed("state", "object")
            below = below.select("image_id", F.col("parent").alias("state"), "object", "more")
            order = F.array_sort(F.collect_list(F.struct("object", "more")))
            best = below.groupBy("image_id", "state").agg(F.slice(order, 1, rules.at("most_added", depth + 1)).alias("below"))
            grown = found.where("NOT done").join(best, ["image_id", "state"]).withColumn("b", F.explode("below"))
            own = own.unionByName(grown.select("image_id", F.col("b.object").alias("state"), "value", F.concat("parts", "b.more").alias("parts")))
        objects = own
    return objects.select("image_id", F.col("state").alias("object"), "value", F.size("parts").alias("n_parts"), "parts")
