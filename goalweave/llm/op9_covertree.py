"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared by cosine in double precision. On unit vectors a cosine of c or more is a distance of
at most sqrt(2 - 2c), so the pairs are those within a radius.

1. Equal vectors of a label become one point with a count and its smallest id. Per label, points are drawn as centers by
   their hash (about one per ``CELL`` points, about ``MOST_CELLS`` at most); every point belongs to its nearest center.
   A cell of many points is dealt into blocks, whose farthest point gives their covering radius.
2. Two blocks of a label are one group if their centers are no farther apart than both radii and the threshold. A group
   never holds more than two blocks, whatever the sizes of labels and cells.
3. Within a group each block becomes a cover tree: nested levels of centers with halving radii, every node with the true
   radius of its points. The two trees are traversed together: a pair of nodes is dropped when their centers are farther
   apart than both radii and the threshold, taken whole when even their farthest points are within the threshold, and
   opened otherwise. Pairs of points that remain are compared by the cosine itself.
4. A group gives counts per point and, instead of all its pairs, a forest of links that connects the same points.
   Counts are summed; components come from the forests by alternating large-star and small-star.

Null, zero or non-finite vectors, vectors of different lengths, and null labels link with nothing. A null vec_id links
with nothing and has a null component. Wholly equal rows count as one vector; rows that share a vec_id but not the vector
are one node of the components. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL, MOST_CELLS = 2500, 128
#: Points of one block, on average, and of a leaf.
BLOCK, LEAF = 2500, 24
#: Distances within this of a bound are not decided by it.
SLACK = 1e-6


class Tree:
    """A cover tree over unit vectors, in lists by node: center, true radius, children, and a range of ``order``."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.range: list[tuple[int, int]] = []
        self.gram = points @ points.T
        if len(points):
            self._grow(0, len(points), 2.0)
        del self.gram
        self.points = points
        self.at_center = points[self.center]
        self.reach = np.array(self.radius)
        self.leaf = np.array([not len(c) for c in self.children], dtype=bool)
        self.begin, self.end = np.array(self.range, dtype=np.int64).reshape(-1, 2).T

    def _away(self, center: int, some: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * self.gram[center, some], 0))

    def _grow(self, begin: int, end: int, reach: float) -> int:
        node, mine = len(self.center), self.order[begin:end].copy()
        away = self._away(mine[0], mine)
        away[0] = 0.0
        radius = float(away.max())
        self.center.append(int(mine[0]))
        self.radius.append(radius)
        self.range.append((begin, end))
        self.children.append(np.empty(0, dtype=np.int64))
        if end - begin <= LEAF or radius <= SLACK:
            return node
        while reach >= radius:
            reach /= 2
        # The net of this level: the first point that nothing covers becomes a center and covers what lies within reach.
        # The node's own center comes first, so levels are nested; it does not reach the farthest point.
        parts = []
        while len(mine):
            near = self._away(mine[0], mine) <= reach
            near[0] = True
            parts.append(mine[near])
            mine = mine[~near]
        self.order[begin:end] = np.concatenate(parts)
        children = []
        for part in parts:
            children.append(self._grow(begin, begin + len(part), reach / 2))
            begin += len(part)
        self.children[node] = np.array(children)
        return node

    def members(self, node: int) -> np.ndarray:
        begin, end = self.range[node]
        return self.order[begin:end]


class Links:
    """Counts of links per point and a forest over both blocks' points."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.counts = np.zeros(len(weights), dtype=np.int64)
        self.parent = list(range(len(weights)))
        self.leaves: list[tuple[np.ndarray, np.ndarray]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of a with every one of b, which have none in common."""
        self.counts[a] += self.weights[b].sum()
        self.counts[b] += self.weights[a].sum()
        for i in a.tolist():
            self.join(i, int(b[0]))
        for j in b.tolist():
            self.join(int(a[0]), j)

    def clique(self, a: np.ndarray) -> None:
        self.counts[a] += self.weights[a].sum() - self.weights[a]
        for i in a.tolist():
            self.join(i, int(a[0]))

    def settle(self, a: Tree, b: Tree, shift: int, vectors: np.ndarray, norms: np.ndarray, cosine: float) -> None:
        """Compare all points of the pairs of leaves that were put aside, many pairs at once."""
        for left, right in self.leaves:
            sizes = (a.end - a.begin)[left] * (b.end - b.begin)[right]
            for some in np.array_split(np.arange(len(left)), int(sizes.sum()) // 200_000 + 1):
                x, y, size = left[some], right[some], sizes[some]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                wide = np.repeat((b.end - b.begin)[y], size)
                u = a.order[np.repeat(a.begin[x], size) + inside // wide]
                v = b.order[np.repeat(b.begin[y], size) + inside % wide] + shift
                if a is b:  # within one leaf every pair comes twice, and each point with itself
                    once = (np.repeat(x, size) != np.repeat(y, size)) | (u < v)
                    u, v = u[once], v[once]
                near = np.einsum("ij,ij->i", vectors[u], vectors[v]) / (norms[u] * norms[v]) >= cosine
                u, v = u[near], v[near]
                np.add.at(self.counts, u, self.weights[v])
                np.add.at(self.counts, v, self.weights[u])
                for i, j in zip(u.tolist(), v.tolist()):
                    self.join(i, j)
        self.leaves = []


def traversed(a: Tree, b: Tree, shift: int, cosine: float, vectors: np.ndarray, links: Links) -> None:
    """All pairs of the two trees' points; b's points are numbered from ``shift`` on. ``a is b``: pairs within one tree."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    threshold = math.sqrt(max(2 - 2 * cosine, 0))

    stack = [(0, 0)] if len(a.order) and len(b.order) else []
    while stack:
        x, y = stack.pop()
        if a.leaf[x] and b.leaf[y]:
            links.leaves.append((np.array([x]), np.array([y])))
            continue
        if a is b and x == y:
            if 2 * a.radius[x] + SLACK <= threshold:
                links.clique(a.members(x))
                continue
            kids = a.children[x]
            links.leaves.append((kids[a.leaf[kids]], kids[a.leaf[kids]]))
            stack += [(k, k) for k in kids[~a.leaf[kids]].tolist()]
            _meet(a, b, kids, kids, True, threshold, shift, links, stack)
            continue
        kids_x, kids_y = a.children[x], b.children[y]
        # Both are opened where both have children; a leaf stays as it is.
        kids_x = kids_x if len(kids_x) else np.array([x])
        kids_y = kids_y if len(kids_y) else np.array([y])
        _meet(a, b, kids_x, kids_y, False, threshold, shift, links, stack)
    links.settle(a, b, shift, vectors, norms, cosine)


def _meet(a: Tree, b: Tree, xs: np.ndarray, ys: np.ndarray, once: bool, threshold: float, shift: int, links: Links, stack: list) -> None:
    """Bounds of all pairs of two sets of nodes: those that stay open go to the stack, pairs of leaves aside."""
    apart = np.sqrt(np.maximum(2 - 2 * (a.at_center[xs] @ b.at_center[ys].T), 0))
    radii = a.reach[xs][:, None] + b.reach[ys][None, :]
    possible = apart <= radii + threshold + SLACK
    if once:
        possible &= np.arange(len(xs))[:, None] < np.arange(len(ys))[None, :]
    leaves = possible & a.leaf[xs][:, None] & b.leaf[ys][None, :]
    i, j = np.nonzero(leaves)
    links.leaves.append((xs[i], ys[j]))
    possible &= ~leaves
    sure = possible & (apart + radii + SLACK <= threshold)
    for i, j in zip(*(x.tolist() for x in np.nonzero(sure))):
        links.whole(a.members(int(xs[i])), b.members(int(ys[j])) + shift)
    for i, j in zip(*(x.tolist() for x in np.nonzero(possible & ~sure))):
        stack.append((int(xs[i]), int(ys[j])))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


LINKED = "label long, point long, links long, root long"


def _group_links(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("point", "ascending")])
        names = table["point"].to_numpy()
        vectors = _matrix(table["vector"])
        first = int((table["side"].to_numpy() == 0).sum())
        unit = _unit(vectors)
        links = Links(table["n"].to_numpy())
        one = Tree(unit[:first])
        if first == len(names):
            traversed(one, one, 0, cosine, vectors, links)
        else:
            traversed(one, Tree(unit[first:]), first, cosine, vectors, links)
        hit = np.flatnonzero(links.counts > 0)
        roots = np.array([links.root(i) for i in hit.tolist()], dtype=np.int64)
        columns = [table["label"].to_numpy()[hit].astype(np.int64), names[hit], links.counts[hit], names[roots] if len(hit) else names[:0]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["label", "point", "links", "root"])

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


SPACE = ["label", "dims"]


def _placed(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Each point's nearest center of its space (of equally near ones the first) and its distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cell, away = np.zeros(n, dtype=np.int64), np.zeros(n)
            spaces: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                spaces.setdefault(key, []).append(i)
            for rows in spaces.values():
                at = pa.array(rows)
                vectors = _unit(_matrix(batch.column(4).take(at)))
                choice = _unit(np.array(batch.column(5)[rows[0]].as_py(), dtype=np.float64))
                for i in range(0, len(rows), 4096):
                    dots = vectors[i : i + 4096] @ choice.T
                    cell[rows[i : i + 4096]] = dots.argmax(axis=1)
                    away[rows[i : i + 4096]] = np.sqrt(np.maximum(2 - 2 * dots.max(axis=1), 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(cell), pa.array(away)], ["label", "dims", "point", "n", "vector", "cell", "away"]
            )

    met = points.join(centers, SPACE).select("label", "dims", "point", "n", "vector", "centers")
    return met.mapInArrow(run, "label long, dims int, point long, n long, vector array<double>, cell long, away double")


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id and kept."""
    scratch = common.Scratch(vectors.sparkSession, "covertree")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.size("embedding").alias("dims"),
        F.xxhash64("embedding").alias("h1"),
        F.xxhash64(F.lit(9), "embedding").alias("h2"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"))
    same = [*SPACE, "h1", "h2"]
    some = rows.where(usable)
    groups = some.select("vec_id", *same).distinct().groupBy(*same).agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("n"))
    groups = scratch.write(groups, "groups")
    first = some.join(groups, same).where("vec_id = point").dropDuplicates([*same, "point"])
    points = scratch.write(first.select(*SPACE, "point", "n", "vector"), "points")

    spaces = points.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("points"), F.min("point").alias("fallback"))
    every = F.greatest(F.lit(CELL), F.ceil(F.col("points") / MOST_CELLS))
    drawn = (F.pmod(F.xxhash64(F.lit(19), "point"), every) == 0) | (F.col("point") == F.col("fallback"))
    centers = points.join(spaces, SPACE).where(drawn)
    # About MOST_CELLS vectors for each label at most.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("point", "vector"))), lambda c: c["vector"])
    centers = scratch.write(centers.groupBy(*SPACE).agg(listed.alias("centers")), "centers")

    placed = scratch.write(_placed(points, centers), "placed")
    cells = placed.groupBy(*SPACE, "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    blocks = F.ceil(F.col("in_cell") / BLOCK).cast("long")
    dealt = placed.join(cells, [*SPACE, "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit(29), "point"), blocks))
    dealt = dealt.drop("in_cell")
    sizes = scratch.write(dealt.groupBy(*SPACE, "cell", "block").agg(F.max("away").alias("radius")), "blocks")

    pairs = scratch.write(_block_pairs(sizes, centers, cosine), "pairs")
    sides = [
        dealt.join(
            pairs.select(*SPACE, "pair", F.col(f"cell_{s}").alias("cell"), F.col(f"block_{s}").alias("block"), "alone")
            .where(F.lit(s == 0) | ~F.col("alone")),
            [*SPACE, "cell", "block"],
        ).select(*SPACE, "pair", F.lit(s).alias("side"), "point", "n", "vector")
        for s in (0, 1)
    ]
    groups_of = sides[0].unionByName(sides[1])
    linked = scratch.write(groups_of.groupBy(*SPACE, "pair").applyInArrow(_group_links(cosine), LINKED), "linked")
    found = common.components(scratch, linked.select(F.col("point").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy("label", "point").agg(F.sum("links").alias("links"))

    # Copies of one point are linked to each other; their component may also join others by a shared vec_id.
    all_rows = rows.select("vec_id", *same, usable.alias("usable"))
    met = all_rows.join(groups, same, "left").join(counts, ["label", "point"], "left").join(found, F.col("point") == F.col("node"), "left")
    n_links = F.when(F.col("usable"), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    component = F.when(F.col("usable"), F.coalesce("component", "point")).otherwise(F.col("vec_id"))
    met = met.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"))
    return met.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _block_pairs(blocks: DataFrame, centers: DataFrame, cosine: float) -> DataFrame:
    """Pairs of blocks of one space that can hold links: a row of two places and a radius for each block, not of points."""
    at = F.transform("centers", lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y))))
    placed = blocks.join(centers.select(*SPACE, at.alias("centers")), SPACE)
    placed = placed.select(*SPACE, "cell", "block", "radius", F.get("centers", F.col("cell")).alias("center"))
    a, b = (placed.select(*SPACE, *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "block", "radius", "center")]) for s in (0, 1))
    dot = F.aggregate(F.zip_with("center_0", "center_1", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
    ordered = (F.col("cell_0") < F.col("cell_1")) | ((F.col("cell_0") == F.col("cell_1")) & (F.col("block_0") <= F.col("block_1")))
    near = apart <= F.col("radius_0") + F.col("radius_1") + math.sqrt(max(2 - 2 * cosine, 0)) + SLACK
    alone = (F.col("cell_0") == F.col("cell_1")) & (F.col("block_0") == F.col("block_1"))
    pair = F.xxhash64("cell_0", "block_0", "cell_1", "block_1")
    return a.join(b, SPACE).where(ordered & near).select(*SPACE, "cell_0", "block_0", "cell_1", "block_1", alone.alias("alone"), pair.alias("pair"))
