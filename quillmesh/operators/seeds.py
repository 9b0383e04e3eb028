"""Seed rows for mixture models: first k, random, D^2-weighted, or spread out by a cover tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.rng import uniform
from ..plans.store import written
from .covertree import BASE, replaced


def first_k(points: DataFrame, k: int) -> DataFrame:
    return points.orderBy("id").limit(k)


def random_k(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return points.orderBy(uniform(seed, 0, F.col("id"), F.lit(1)), "id").limit(k)


def d2_weights(points: DataFrame, centers: list) -> DataFrame:
    """id, d2: squared distance to the nearest of the centres."""
    near = F.array_min(F.array(*[vec.dist2(F.col("v"), vec.literal(c)) for c in centers]))
    return points.select("id", "v", near.alias("d2"))


def plus_plus(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k-means++: every pass draws one row with odds d2, as the least of -log(u) / d2."""
    chosen = [random_k(points, 1, seed).select("v").first()["v"]]
    for step in range(1, k):
        key = -F.log(F.greatest(uniform(seed, step, F.col("id"), F.lit(2)), F.lit(1e-12))) / F.col("d2")
        row = d2_weights(points, chosen).where("d2 > 0").orderBy(key, "id").select("v").first()
        if row is None:
            break
        chosen.append(row["v"])
    return np.array(chosen)


def spread_out(points: DataFrame, k: int) -> np.ndarray:
    """k nodes of the cover tree of all points: its lowest level that is not too large, where children replace parents up to k.

    The tree inserts points from the remotest to the nearest to the mean, so that the next
    child of a node is the first of its points in this order that no earlier child covers:
    one pass a seed finds the upper nodes without building the tree, and only they are held.
    """
    points = points.select(F.col("id").cast("long").alias("id"), vec.vector("v").alias("v"))
    means = points.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").collect()
    far = F.sqrt(vec.dist2(F.col("v"), vec.literal([r["x"] for r in means])))
    points = written(points.select("id", "v", far.alias("far")))
    root = points.orderBy("far", F.desc("id")).first()
    if root is None:
        raise ValueError("fewer points than seeds")
    near = lambda v: vec.l2(F.col("v"), vec.literal(v))
    top = points.agg(F.max(near(root["v"]))).first()[0]
    level = int(np.ceil(np.log(top) / np.log(BASE))) if top > 0 else 0
    front, out, seen = [root], [], [root]
    rest = points.where(F.col("id") != root["id"]).withColumn("node", F.lit(root["id"]))
    while len(front) < k - len(out):
        level -= 1
        reach, kids_of, need, found = BASE**level, {}, k - len(out), 0
        for node in front:
            mine, kids = rest.where(F.col("node") == node["id"]), []
            while found <= need:
                row = mine.orderBy(F.desc("far"), "id").select("id", "v", "far").first()
                if row is None:
                    break
                kids.append(row)
                found += 1
                mine = mine.where((F.col("id") != row["id"]) & (near(row["v"]) > reach))
            kids_of[node["id"]] = kids
        below = [row for node in front for row in kids_of[node["id"]]]
        leaves = [node for node in front if not kids_of[node["id"]]]
        seen += below
        if not below:
            # the tree is all used up; parents have to stand beside their children
            if len(seen) < k:
                raise ValueError("fewer points than seeds")
            return np.array([r["v"] for r in seen[:k]])
        # leaves are told from nodes that were not looked at only where all were
        if found > need or found > need - len(leaves):
            return np.array([r["v"] for r in replaced(front, lambda n: kids_of[n["id"]], need, out)])
        out += leaves
        # a point goes to the nearest of its node's children that were inserted before it
        place = F.lit(None).cast("struct<d:double,nth:int,id:bigint>")
        for node, kids in kids_of.items():
            before = lambda c: (F.col("far") < c["far"]) | ((F.col("far") == c["far"]) & (F.col("id") > c["id"]))
            covers = [F.when(before(c) & (near(c["v"]) <= reach), F.struct(near(c["v"]).alias("d"), F.lit(i).alias("nth"), F.lit(c["id"]).alias("id"))) for i, c in enumerate(kids)]
            if covers:
                place = F.when(F.col("node") == node, F.array_min(F.array(*covers))).otherwise(place)
        rest = rest.where(~F.col("id").isin([r["id"] for r in below])).withColumn("node", place["id"])
        rest, front = written(rest), below
    return np.array([r["v"] for r in out + front])


def seed_centers(points: DataFrame, k: int, init, seed: int = 0) -> np.ndarray:
    """A (k, D) matrix; init is a name or the matrix itself."""
    if not isinstance(init, str):
        return np.asarray(init, float)
    if init in ("firstk", "random"):
        rows = first_k(points, k) if init == "firstk" else random_k(points, k, seed)
        return np.array([r["v"] for r in rows.select("v").collect()])
    if init == "kmeanspp":
        return plus_plus(points, k, seed)
    if init == "covertree":
        return spread_out(points, k)
    raise ValueError(f"unknown seeding: {init}")
