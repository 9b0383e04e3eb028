"""A cover tree: exact search by the triangle inequality, over one tree or a forest.

A tree is flat arrays (points, levels, parents, distance to the furthest descendant). A
DataFrame of points becomes a forest of trees of about TREE_ROWS points, one per partition
block; queries go against every tree and partial answers are merged, so a tree always fits
a task. Insert adds points to the trees of their blocks, remove marks nodes as gone, so only
trees that are touched change; a forest that has grown or shrunk by half is built anew.
Duplicates are kept unless told otherwise, as copies beside the node of the first one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.pack import pack, unpack
from ..plans.store import written
from .search import packed

BASE = 1.3
TREE_ROWS = 20_000
#: Blocks of queries whose best rows a task holds at a time.
HELD = 16


def replaced(front: list, children, need: int, before: list) -> list:
    """before and need more of a level: whole families of children for the first parents, then the parents themselves."""
    out, extra = list(before), need - len(front)
    for node in front:
        kids = children(node) if extra > 0 else []
        out += kids[: extra + 1] if kids else [node]
        extra -= max(len(kids[: extra + 1]) - 1, 0)
    return out[: len(before) + need]


class Tree:
    """In-memory tree over a few ten thousand points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, levels: int = -1):
        self.ids, self.points = np.asarray(ids, np.int64), np.asarray(points, float) + 0.0  # no negative zeros
        if len(self.ids) == 0:
            raise ValueError("a tree needs a point")
        mean = self.points.mean(0)
        far = np.sqrt(((self.points - mean) ** 2).sum(1))
        order = np.lexsort((self.ids, -far))
        self.root = int(order[-1])
        reach = np.sqrt(((self.points - self.points[self.root]) ** 2).sum(1))
        top = float(reach.max())
        self.level = np.zeros(len(self.ids), np.int64)
        self.level[self.root] = int(np.ceil(np.log(top) / np.log(BASE))) if top > 0 else 0
        self.parent = np.full(len(self.ids), -1)
        self.radius = np.zeros(len(self.ids))
        self.children: list[list[int]] = [[] for _ in self.ids]
        self.floor = self.level[self.root] - levels if levels > 0 else None
        self.skipped: list[int] = []
        self.alive = np.ones(len(self.ids), bool)
        self.copies: dict[int, list[int]] = {}
        self.known = {self.points[self.root].tobytes(): self.root}
        for i in order[:-1]:
            self._place(int(i))

    def _place(self, i: int) -> None:
        """A point that is there already becomes a copy of its node: many equal points make no chain."""
        first = self.known.setdefault(self.points[i].tobytes(), i)
        if first == i:
            self._insert(i)
        elif self.floor is not None and self.level[first] - 1 < self.floor:
            self.skipped.append(i)
        else:
            self.copies.setdefault(first, []).append(i)
            self.parent[i], self.level[i] = first, self.level[first] - 1

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        """More points, one after the other; the root's level grows where it has to."""
        at, more = len(self.ids), len(ids)
        self.ids = np.concatenate([self.ids, np.asarray(ids, np.int64)])
        self.points = np.concatenate([self.points, np.asarray(points, float) + 0.0])
        self.level, self.parent = np.concatenate([self.level, np.zeros(more, np.int64)]), np.concatenate([self.parent, np.full(more, -1)])
        self.radius, self.alive = np.concatenate([self.radius, np.zeros(more)]), np.concatenate([self.alive, np.ones(more, bool)])
        self.children += [[] for _ in range(more)]
        top = float(self._dist(self.root, np.arange(at, at + more)).max()) if more else 0.0
        if top > 0:
            self.level[self.root] = max(self.level[self.root], int(np.ceil(np.log(top) / np.log(BASE))))
        for i in range(at, at + more):
            self._place(i)

    def drop(self, points: np.ndarray) -> None:
        """These vectors are found no more; their nodes still lead to others."""
        for p in points + 0.0:
            node = self.known.get(p.tobytes())
            if node is not None:
                self.alive[[node, *self.copies.get(node, [])]] = False

    def _dist(self, i: int, others) -> np.ndarray:
        return np.sqrt(((self.points[others] - self.points[i]) ** 2).sum(1))

    def _insert(self, i: int) -> None:
        at, d, path = self.root, float(self._dist(i, [self.root])[0]), []
        while True:
            path.append((at, d))
            kids = self.children[at]
            if not kids:
                break
            dists = self._dist(i, kids)
            for j in np.argsort(dists, kind="stable"):
                if dists[j] <= BASE ** int(self.level[kids[j]]):
                    at, d = kids[j], float(dists[j])
                    break
            else:
                break
        level = int(self.level[at]) - 1
        if self.floor is not None and level < self.floor:
            self.skipped.append(i)
            return
        for node, reach in path:
            self.radius[node] = max(self.radius[node], reach)
        self.parent[i], self.level[i] = at, level
        self.children[at].append(i)

    def search(self, q: np.ndarray, k: int, radius: float = np.inf) -> list[tuple[float, int]]:
        """The k nearest within radius (strict), as (distance, id), ties by id."""
        best: list[tuple[float, int]] = []  # of negated pairs: the worst on top

        def offer(d: float, node: int) -> None:
            for i in (node, *self.copies.get(node, ())):
                one(d, i)

        def one(d: float, i: int) -> None:
            if d < radius and self.alive[i]:
                entry = (-d, -int(self.ids[i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)

        first = float(np.sqrt(((self.points[self.root] - q) ** 2).sum()))
        offer(first, self.root)
        stack = [(first, self.root)]
        while stack:
            d, node = stack.pop()
            bound = min(radius, -best[0][0]) if len(best) == k else radius
            if d - self.radius[node] > bound or not self.children[node]:
                continue
            kids = self.children[node]
            dists = np.sqrt(((self.points[kids] - q) ** 2).sum(1))
            for dist, kid in zip(dists, kids, strict=True):
                offer(float(dist), kid)
            stack += sorted(((float(a), b) for a, b in zip(dists, kids, strict=True)), reverse=True)
        return sorted((-d, -i) for d, i in best)

    def search_many(self, qs: np.ndarray, k: int, radius: float = np.inf, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of qs, ids and distances of what search() finds for each, in any order; k = 0: all within radius.

        The queries go down the tree together: a node is opened for those that its furthest
        descendant can still improve, and meets its children in one product of matrices; exact
        distances decide on what that leaves. bound, if given, is a distance per query beyond
        which nothing is wanted; it is tightened in place.
        """
        bound = np.full(len(qs), float(radius)) if bound is None else bound
        norms, q2 = (self.points**2).sum(1), (qs * qs).sum(1)
        best_d, best_i = np.full((len(qs), k), np.inf), np.full((len(qs), k), np.iinfo(np.int64).max)
        out: list[tuple] = []
        members = {n: np.array(sorted(i for i in (n, *c) if self.alive[i]), np.int64) for n, c in self.copies.items()}

        def offer(rows: np.ndarray, nodes: list[int], d2: np.ndarray, slack: np.ndarray) -> None:
            a, b = np.nonzero(d2 - slack <= bound[rows, None] ** 2)
            if not len(a):
                return
            row, node = rows[a], np.asarray(nodes)[b]
            d = np.empty(len(row))
            for at in range(0, len(row), 1 << 16):
                some = slice(at, at + (1 << 16))
                d[some] = np.sqrt(((self.points[node[some]] - qs[row[some]]) ** 2).sum(1))
            if members:
                lists = [members.get(n) for n in nodes]
                lists = [(np.array([n]) if self.alive[n] else np.zeros(0, np.int64)) if m is None else m[np.argsort(self.ids[m], kind="stable")][: k or None] for n, m in zip(nodes, lists, strict=True)]
                sizes = np.array([len(m) for m in lists])[b]
                starts = np.concatenate([[0], np.cumsum([len(m) for m in lists])])[b]
                flat = np.concatenate(lists).astype(np.int64)
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                row, d, node = np.repeat(row, sizes), np.repeat(d, sizes), flat[np.repeat(starts, sizes) + within]
            else:
                here = self.alive[node]
                row, d, node = row[here], d[here], node[here]
            keep = (d < radius) & (d <= bound[row])
            row, d, who = row[keep], d[keep], self.ids[node[keep]]
            if not k:
                out.append((row, who, d))
                return
            some = np.unique(row)
            if not len(some):
                return
            row = np.concatenate([row, np.repeat(some, k)])
            d, who = np.concatenate([d, best_d[some].ravel()]), np.concatenate([who, best_i[some].ravel()])
            order = np.lexsort((who, d, row))
            first = np.searchsorted(row[order], some)
            take = order[first[:, None] + np.arange(k)]
            best_d[some], best_i[some] = d[take], who[take]
            bound[some] = np.minimum(bound[some], best_d[some, -1])

        def distances(rows: np.ndarray, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
            both = q2[rows, None] + norms[nodes][None, :]
            return np.maximum(both - 2 * (qs[rows] @ self.points[nodes].T), 0), 1e-11 * both

        everyone = np.arange(len(qs))
        d2, slack = distances(everyone, [self.root])
        offer(everyone, [self.root], d2, slack)
        stack = [(self.root, everyone, np.sqrt(np.maximum(d2 - slack, 0))[:, 0])]
        while stack:
            node, rows, least = stack.pop()
            kids = self.children[node]
            open_ = least - self.radius[node] <= bound[rows] + 1e-9 * (1 + self.radius[node])
            rows = rows[open_]
            if not kids or not len(rows):
                continue
            for at in range(0, len(kids), 1024):
                some = kids[at : at + 1024]
                d2, slack = distances(rows, some)
                offer(rows, some, d2, slack)
                least = np.sqrt(np.maximum(d2 - slack, 0))
                stack += [(kid, rows, least[:, i]) for i, kid in enumerate(some) if self.children[kid]]
        if k:
            row, at = np.nonzero(np.isfinite(best_d))
            return row, best_i[row, at], best_d[row, at]
        return tuple(np.concatenate(c) if out else np.zeros(0, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (np.int64, np.int64, float), strict=True))

    def covering(self) -> bool:
        """Every child lies within its parent's cover distance."""
        kids = np.flatnonzero(self.parent >= 0)
        d = np.sqrt(((self.points[kids] - self.points[self.parent[kids]]) ** 2).sum(1)) if len(kids) else np.zeros(0)
        return bool((d <= BASE ** self.level[self.parent[kids]].astype(float) + 1e-9).all())

    def spread(self, k: int) -> np.ndarray:
        """Ids of k spread-out points: the lowest level that is not too large, in which children replace parents up to k."""
        under = lambda node: self.children[node] + self.copies.get(node, [])
        front, out, seen = [self.root], [], [self.root]
        while len(front) < k - len(out):
            below = [c for node in front for c in under(node)]
            leaves = [node for node in front if not under(node)]
            seen += below
            if not below:
                # the tree is all used up; parents have to stand beside their children
                if len(seen) < k:
                    raise ValueError("fewer points than asked for")
                return self.ids[seen[:k]]
            if len(below) > k - len(out) - len(leaves):
                break
            out, front = out + leaves, below
        return self.ids[replaced(front, under, k - len(out), out)]

    def to_bytes(self) -> bytes:
        fields = {f: getattr(self, f) for f in ("ids", "points", "level", "parent", "radius", "alive", "root", "floor", "skipped")}
        copy = np.zeros(len(self.ids), bool)
        copy[[i for some in self.copies.values() for i in some]] = True
        return pack(fields | {"copy": copy})

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(unpack(data))
        copy = tree.__dict__.pop("copy")
        tree.children, tree.copies = [[] for _ in tree.ids], {}
        for i in np.flatnonzero(tree.parent >= 0).tolist():
            (tree.copies.setdefault(int(tree.parent[i]), []) if copy[i] else tree.children[tree.parent[i]]).append(i)
        tree.known = {p.tobytes(): i for i, p in reversed(list(enumerate(tree.points))) if not copy[i]}
        return tree


def _build(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(np.asarray(batch.column(1)[i].values), vec.matrix(batch.column(2)[i].values), levels)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(tree.ids)], pa.int64()), pa.array([tree.to_bytes()])], names=["block", "n", "tree"])

    return run


class CoverTree:
    """A forest over a DataFrame of points(id, v)."""

    def __init__(self, points: DataFrame, trees: DataFrame, rows: int = TREE_ROWS, blocks: int = 1, built: int = 0):
        """built: number of points when the trees were last made, dealt to so many blocks."""
        self.points, self.trees, self.rows, self.blocks, self.built = points, trees, rows, blocks, built

    @classmethod
    def from_matrix(cls, points: DataFrame, trunc: int = -1, dedup: bool = False, rows: int = TREE_ROWS) -> CoverTree:
        """A forest of trees of about so many rows; trunc keeps so many levels of each."""
        points = points.select(F.col("id").cast("long").alias("id"), vec.vector("v").alias("v"))
        if dedup:
            points = points.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
        points = written(points)
        n = points.count()
        blocks = max(1, -(-n // rows))
        return cls(points, written(packed(points, "id", "v", blocks).mapInArrow(_build(trunc), "block long, n long, tree binary")), rows, blocks, n)

    def _changed(self, points: DataFrame, rows: DataFrame, function) -> CoverTree:
        """The forest with function(tree, ids, vectors) applied to the trees of these rows' blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    data = batch.column(1)[i].as_py()
                    if batch.column(2)[i].is_valid:
                        tree = Tree.from_bytes(data)
                        function(tree, np.asarray(batch.column(2)[i].values), vec.matrix(batch.column(3)[i].values))
                        data, size = tree.to_bytes(), int(tree.alive.sum())
                    else:
                        size = batch.column(4)[i].as_py()
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([size], pa.int64()), pa.array([data])], names=["block", "n", "tree"])

        some = packed(rows, "id", "v", self.blocks)
        both = self.trees.join(some, "block", "left").select("block", "tree", "ids", "vs", "n")
        return CoverTree(points, written(both.mapInArrow(run, "block long, n long, tree binary")), self.rows, self.blocks, self.built)

    def _fits(self, size: int) -> bool:
        return 2 * size >= self.built and size <= 2 * self.built and self.trees.count() == self.blocks

    def insert(self, more: DataFrame) -> CoverTree:
        """The forest with more points; ids that it has already are allowed."""
        more = written(more.select(F.col("id").cast("long").alias("id"), vec.vector("v").alias("v")))
        points = written(self.points.unionByName(more))
        if not self._fits(points.count()):
            return CoverTree.from_matrix(points, rows=self.rows)
        return self._changed(points, more, lambda tree, ids, x: tree.add(ids, x))

    def remove(self, vectors: DataFrame) -> tuple[CoverTree, bool]:
        """The forest without these vectors, and whether any was there."""
        gone = vectors.select(vec.vector("v").alias("v")).distinct()
        out = written(self.points.join(gone, "v", "left_semi").select("id", "v"))
        rest = written(self.points.join(gone, "v", "left_anti").select("id", "v"))
        if not self._fits(rest.count()):
            return CoverTree.from_matrix(rest, rows=self.rows), bool(out.take(1))
        return self._changed(rest, out, lambda tree, _, x: tree.drop(x)), bool(out.take(1))

    def _search(self, queries: DataFrame, k: int, radius: float) -> DataFrame:
        names = ["qid", "id", "dist"]

        def rows(qids: np.ndarray, found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(qids[found[0]]), pa.array(found[1]), pa.array(found[2])], names=names)

        def merged(old: tuple | None, new: tuple) -> tuple:
            """The k best of each query out of two answers."""
            if old is None:
                return new
            row, who, d = (np.concatenate(c) for c in zip(old, new, strict=True))
            order = np.lexsort((who, d, row))
            row = row[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            return row[keep], who[order][keep], d[order][keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # per block of queries: its ids, the best so far and the distance beyond which nothing is wanted
            held: dict[int, tuple] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    block, tree = batch.column(0)[i].as_py(), Tree.from_bytes(batch.column(3)[i].as_py())
                    if not k:
                        qids, qs = np.asarray(batch.column(1)[i].values), vec.matrix(batch.column(2)[i].values)
                        for at in range(0, len(qids), 256):
                            yield rows(qids[at : at + 256], tree.search_many(qs[at : at + 256], 0, radius))
                        continue
                    if block not in held and len(held) == HELD:
                        old, best, _, _ = held.pop(next(iter(held)))
                        yield rows(old, best)
                    if block not in held:
                        qids = np.asarray(batch.column(1)[i].values)
                        held[block] = qids, None, np.full(len(qids), float(radius)), vec.matrix(batch.column(2)[i].values)
                    qids, best, bound, qs = held[block]
                    held[block] = qids, merged(best, tree.search_many(qs, k, radius, bound)), bound, qs
            for qids, best, _, _ in held.values():
                yield rows(qids, best)

        n = max(1, -(-queries.count() // 2048))
        blocks = packed(queries, "qid", "qv", n).select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vs").alias("qvs"))
        blocks = blocks.repartition(min(n, queries.sparkSession.sparkContext.defaultParallelism))
        return blocks.crossJoin(self.trees.select("tree")).mapInArrow(run, "qid long, id long, dist double")

    def k_nearest(self, queries: DataFrame, k: int = 10) -> DataFrame:
        order = Window.partitionBy("qid").orderBy("dist", "id")
        found = self._search(queries, k, np.inf).withColumn("rank", F.row_number().over(order))
        return found.where(F.col("rank") <= k).select("qid", "rank", "id", "dist")

    def nearest(self, queries: DataFrame) -> DataFrame:
        return self.k_nearest(queries, 1)

    def range_search(self, queries: DataFrame, r: float = 1.0) -> DataFrame:
        return self._search(queries, 0, r)

    def nodes(self) -> DataFrame:
        """block, id, parent, level, max_dist of every node."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    t = Tree.from_bytes(batch.column(2)[i].as_py())
                    here = np.flatnonzero(t.alive)
                    up = [int(t.ids[p]) if p >= 0 else None for p in t.parent[here]]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(here), pa.int64()), pa.array(t.ids[here]), pa.array(up, pa.int64()), pa.array(t.level[here]), pa.array(t.radius[here])], names=["block", "id", "parent", "level", "max_dist"])

        return self.trees.mapInArrow(run, "block long, id long, parent long, level long, max_dist double")

    def level_counts(self) -> DataFrame:
        return self.nodes().groupBy("level").agg(F.count(F.lit(1)).alias("n"))

    def test_covering(self) -> bool:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([Tree.from_bytes(t.as_py()).covering() for t in batch.column(2)], pa.bool_())], names=["ok"])

        return self.trees.mapInArrow(run, "ok boolean").where("not ok").limit(1).count() == 0

    def save(self, path: str) -> None:
        self.points.write.parquet(f"{path}/points")
        self.trees.write.parquet(f"{path}/trees")
        row = [(self.rows, self.blocks, self.built)]
        self.points.sparkSession.createDataFrame(row, "rows long, blocks long, built long").write.parquet(f"{path}/shape")

    @classmethod
    def load(cls, spark, path: str) -> CoverTree:
        return cls(spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/trees"), *spark.read.parquet(f"{path}/shape").first())
