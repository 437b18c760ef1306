"""Layer inference: candidates, window matching of subparts, responses, selection.

Candidates meet nodes in their image's task: what a candidate asks for, per subpart, is looked
up among the image's nodes of one type, and only what lies inside the kernel's window
becomes a row, so no sort or spill grows with what is asked. The library and the kernel
are tables of the model, whose size does not depend on the images; they go along as values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.operators.keyed import as_value, by_keys, near_pairs, owners, ranges
from partweave.operators.nodes import dedup_top_k, response_filter

def candidates(nodes: DataFrame, lib_center: DataFrame, least_r: float, least_g: float, allowed: list[int] | None = None) -> DataFrame:
    """Nodes with the parts whose centre type they have."""
    if allowed:
        lib_center = lib_center.where(F.col("part").isin(allowed))
    strong = response_filter(nodes, {"r": least_r, "g": least_g})
    return strong.join(lib_center, F.col("m") == F.col("center_m")).select(
        "image_id", "z", F.col("node_id").alias("cand_id"), "part", "bp",
        (F.col("x") + F.col("cmx")).alias("cx"), (F.col("y") + F.col("cmy")).alias("cy"), "x", "y", F.col("r").alias("r_c"), F.col("g").alias("g_c"),
    )


def matches(cand: DataFrame, nodes: DataFrame, lib_sub: DataFrame, kernel: DataFrame, least: float) -> DataFrame:
    """Per candidate and subpart the nodes in the kernel window whose response
    times the kernel weight is over ``least``."""
    whole = {"id": "long", "m": "int", "x": "int", "y": "int", "r": "double", "rr": "double"}
    cast = lambda **own: [F.col("image_id"), *[own.get(c, F.col(c)).cast(t).alias(c) for c, t in whole.items()]]
    asking = cand.select(*cast(id=F.col("cand_id"), m=F.col("part"), r=F.lit(None), rr=F.lit(None)), F.lit(True).alias("asks"))
    there = nodes.select(*cast(id=F.col("node_id")), F.lit(False).alias("asks")).dropna(subset=["r"])
    both = asking.unionByName(there).dropna(subset=["image_id", "m", "x", "y"])
    # No response is over 1, so cells of too little weight can never match.
    model = as_value(lib_sub.select("part", "idx", "sub_m", "dx", "dy"), kernel.where(F.col("w") > least).select("i", "j", "w"))

    def run(subs: dict, heavy: dict, ends: np.ndarray, id_: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray, rr: np.ndarray, asks: np.ndarray) -> tuple:
        owner, asks = owners(ends), asks.astype(bool)
        m, x, y = m.astype(np.int64), x.astype(np.int64), y.astype(np.int64)
        by_part = np.argsort(subs["part"], kind="stable")
        part, idx, sub_m, dx, dy = (subs[c][by_part].astype(np.int64) for c in ("part", "idx", "sub_m", "dx", "dy"))
        c, n = np.flatnonzero(asks), np.flatnonzero(~asks)
        k, s = ranges(np.searchsorted(part, m[c], "left"), np.searchsorted(part, m[c], "right"))
        c = c[k]
        if not len(c) or not len(n) or not len(heavy["w"]):
            c, s = c[:0], s[:0]
            heavy = {"i": np.zeros(1, int), "j": np.zeros(1, int), "w": np.zeros(1)}
        low, high = (heavy["i"].min(), heavy["j"].min()), (heavy["i"].max(), heavy["j"].max())
        weights = np.full((high[0] - low[0] + 1, high[1] - low[1] + 1), -np.inf)
        weights[heavy["i"] - low[0], heavy["j"] - low[1]] = heavy["w"]
        kinds = np.unique(np.concatenate([sub_m, m[n]]))
        kind = lambda own, of: own * len(kinds) + np.searchsorted(kinds, of)
        ax, ay = x[c] + dx[s], y[c] + dy[s]
        a, b = near_pairs(kind(owner[c], sub_m[s]), ax, ay, kind(owner[n], m[n]), x[n], y[n], (low[0], high[0]), (low[1], high[1]))
        to = n[b]
        v = r[to] * weights[x[to] - ax[a] - low[0], y[to] - ay[a] - low[1]]
        held = v > least
        a, to, v = a[held], to[held], v[held]
        return owner[c[a]], id_[c[a]], part[s[a]].astype(np.int32), idx[s[a]].astype(np.int32), id_[to], r[to], pa.array(rr[to], from_pandas=True), v

    found = by_keys(both, ["image_id"], [*whole, "asks"], [], "cand_id long, part int, idx int, sub_id long, s_r double, s_rr double, v double", run, model)
    return found.repartition("image_id")


def best_matches(found: DataFrame) -> DataFrame:
    """The best node of each candidate's subpart, ties to the smaller id."""
    key = F.struct(F.col("v"), (-F.col("sub_id")).alias("k"), F.col("s_r"), F.col("s_rr"))
    return found.groupBy("image_id", "cand_id", "part", "idx").agg(F.max(key).alias("b")).select(
        "image_id", "cand_id", "part", "idx", (-F.col("b.k")).alias("sub_id"), F.col("b.s_r").alias("s_r"), F.col("b.s_rr").alias("s_rr"), F.col("b.v").alias("v")
    )


def strong_links(found: DataFrame, share: float) -> DataFrame:
    """Matches of at least ``share`` of the best of their candidate's subpart;
    a share of 0 or less keeps all."""
    from pyspark.sql import Window

    if share <= 0:
        return found
    top = F.max("v").over(Window.partitionBy("image_id", "cand_id", "part", "idx"))
    return found.withColumn("_top", top).where(F.col("v") >= share * F.col("_top")).drop("_top")


def responses(cand: DataFrame, best: DataFrame, power: float = 1.0, multiply: bool = True) -> DataFrame:
    """r: mean of the centre's and the subparts' r; rr: realised share of basic
    parts; g: product (or sum) of the match values times rr."""
    per = best.groupBy("image_id", "cand_id", "part").agg(
        F.sum("s_r").alias("sum_r"), F.count(F.lit(1)).alias("n_sub"), F.sum("s_rr").alias("sum_rr"),
        (F.product("v") if multiply else F.sum("v")).alias("pv"),
    )
    met = cand.join(per, ["image_id", "cand_id", "part"])
    rr = (F.lit(1.0) + F.col("sum_rr")) / F.col("bp")
    return met.select(
        "image_id", (F.col("z") + 1).alias("z"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("part").alias("m"),
        F.pow((F.col("sum_r") + F.col("r_c")) / (F.col("n_sub") + 1), F.lit(power)).alias("r"),
        F.pow(F.col("pv") * rr, F.lit(power)).alias("g"),
        rr.alias("rr"), "n_sub", F.col("cand_id").alias("node_id"),
    )


def infer_layer(
    nodes: DataFrame, lib_center: DataFrame, lib_sub: DataFrame, kernel: DataFrame,
    *, least_r: float = 0.2, least_g: float = 0.2, match: float = 0.1, least_rr: float = 0.0, per_position: int = 2,
) -> DataFrame:
    """The next layer's nodes."""
    cand = candidates(nodes, lib_center, least_r, least_g)
    best = best_matches(matches(cand, nodes, lib_sub, kernel, match))
    kept = response_filter(responses(cand, best), {"r": least_r, "rr": least_rr})
    return dedup_top_k(kept, per_position)


def category_layer(nodes: DataFrame, categories: DataFrame) -> DataFrame:
    """Nodes again under the category of their type; ``categories`` is (m, category)."""
    return nodes.join(categories, "m").select("image_id", (F.col("z") + 1).alias("z"), "x", "y", F.col("category").alias("m"), "r", "g", "rr", "node_id")


def not_forbidden(cand: DataFrame, nodes: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Candidates without a node of a forbidden type at the forbidden offset;
    ``forbidden`` is (part, f_m, fx, fy)."""
    asked = cand.join(forbidden, "part").select("cand_id", "part", "image_id", (F.col("x") + F.col("fx")).alias("ax"), (F.col("y") + F.col("fy")).alias("ay"), "f_m")
    there = nodes.select(F.col("image_id").alias("i"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("m").alias("nm"))
    hit = asked.join(there, (F.col("image_id") == F.col("i")) & (F.col("ax") == F.col("nx")) & (F.col("ay") == F.col("ny")) & (F.col("f_m") == F.col("nm")))
    return cand.join(hit.select("cand_id", "part").distinct(), ["cand_id", "part"], "left_anti")
