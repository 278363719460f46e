"""Exact k-means on integer vectors, with kd-trees that settle whole boxes at once.

``blocks`` packs a partition's vectors into blocks of up to ``BLOCK`` rows, each
one row of a stored table: the points in the order of a kd-tree, and for each of
the tree's nodes its count, integer sums and bounding box. The trees are built
once; a round broadcasts the k centroids and walks each block's tree from the root,
all nodes of a level at once:

* of a node's candidates, the one nearest to the middle of the box strictly
  dominates every other one that is farther from all corners of the box; those go;
* a node with one candidate left is assigned whole, by its count and sums;
* a leaf with several is resolved exactly, point by point.

Tasks return counts and sums by centroid, which Spark adds up. All arithmetic is
on integers; products go through floats only where these are exact.

Defined results: vectors of another number of components, or with a component that
is null or not finite, are left out; equal vectors, and repeated or null ids, are
rows of their own; ties go to the smaller centroid number; a row with a null id can
only start as a centroid after all others; with fewer vectors than k there are as
many centroids; other columns are ignored; an empty table gives an empty result.
Components beyond 2^27 after scaling are an error, as distances no longer fit a long.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.scratch import spread

from . import runtime

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of a block, points of a leaf, and numbers of a step's largest array.
BLOCK, LEAF, STEP = 8192, 24, 1 << 21
LARGEST = 1 << 27
#: Below this, products of 64 components are exact as floats.
_EXACT = 1 << 52


class Tree(NamedTuple):
    ids: list
    points: np.ndarray  # (n, d), in tree order
    begin: np.ndarray  # of each node: its points are begin .. end
    end: np.ndarray
    child: np.ndarray  # its first child, the second follows; 0: a leaf
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray


_FIELDS = {"points": np.int32, "begin": np.int32, "end": np.int32, "child": np.int32, "sums": np.int64, "low": np.int32, "high": np.int32}
BLOCK_SCHEMA = "ids array<long>, dim int, points binary, begin binary, end binary, child binary, sums binary, low binary, high binary"


def kept(vectors: DataFrame, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """(id, v): the vectors of (id, vector) with ``dim`` finite components, as integers."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform("vector", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return vectors.where((F.size("vector") == dim) & finite).select("id", scaled.alias("v"))


def build(ids: list, points: np.ndarray) -> Tree:
    """The kd-tree of a block: boxes are split at the median of their widest side."""
    order = np.arange(len(points))
    todo, begin, end, child, low, high, sums = [(0, len(points))], [], [], [], [], [], []
    at = 0
    while at < len(todo):
        s, e = todo[at]
        p = points[order[s:e]]
        lo, hi = p.min(0), p.max(0)
        begin.append(s), end.append(e), low.append(lo), high.append(hi), sums.append(p.sum(0)), child.append(0)
        if e - s > LEAF and (hi > lo).any():
            half = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(p[:, np.argmax(hi - lo)], half)]
            child[at] = len(todo)
            todo += [(s, s + half), (s + half, e)]
        at += 1
    return Tree([ids[i] for i in order], points[order], *map(np.array, (begin, end, child, sums, low, high)))


def _blocks(batches):
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("dim", pa.int32()), *((n, pa.binary()) for n in _FIELDS)])
    for batch in batches:
        for b in (batch.slice(a, BLOCK) for a in range(0, batch.num_rows, BLOCK)):
            points = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            if np.abs(points).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST} after scaling")
            tree = build(b.column("id").to_pylist(), points)
            row = {n: np.ascontiguousarray(getattr(tree, n), t).tobytes() for n, t in _FIELDS.items()}
            yield pa.RecordBatch.from_pylist([{"ids": tree.ids, "dim": points.shape[1], **row}], schema)


def blocks(vectors: DataFrame) -> DataFrame:
    """The stored blocks of (id long, v array<long>)."""
    return runtime.stored(spread(vectors).mapInArrow(_blocks, BLOCK_SCHEMA), "trees")


def _trees(batches):
    for batch in batches:
        for row in batch.to_pylist():
            got = {n: np.frombuffer(row[n], t).astype(np.int64) for n, t in _FIELDS.items()}
            for n in ("points", "sums", "low", "high"):
                got[n] = got[n].reshape(-1, row["dim"])
            yield Tree(row["ids"], **got)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, (n, k)."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    p, c = points, centroids
    if 4 * points.shape[1] * int(most) ** 2 < _EXACT:
        p, c = points.astype(float), centroids.astype(float)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)


def walk(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Of a block: each point's centroid, each centroid's count and sums, and how
    many points were assigned with their node or one by one."""
    k, dim = centroids.shape
    labels = np.empty(len(tree.points), np.int64)
    n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    stats = {"whole": 0, "single": 0}
    step = max(1, STEP // (k * dim))
    todo = [(np.zeros(1, np.int64), np.ones((1, k), bool))]
    while todo:
        nodes, alive = todo.pop()
        if len(nodes) > step:
            todo += [(nodes[a : a + step], alive[a : a + step]) for a in range(0, len(nodes), step)]
            continue
        low, high = tree.low[nodes], tree.high[nodes]
        # Any candidate may dominate the others; this choice only decides how many.
        middle = (low + high) / 2
        near = np.where(alive, (centroids.astype(float) ** 2).sum(1) - 2 * (middle @ centroids.T), np.inf).argmin(1)
        best = centroids[near][:, None]
        apart = centroids[None] - best
        corner = np.where(apart > 0, high[:, None], low[:, None])
        # |c - x|^2 - |best - x|^2 at the corner where it is least.
        alive &= (apart * (centroids[None] + best - 2 * corner)).sum(2) <= 0
        one = alive.sum(1) == 1
        for i in np.flatnonzero(one):
            at, c = nodes[i], near[i]
            labels[tree.begin[at] : tree.end[at]] = c
            n[c] += tree.end[at] - tree.begin[at]
            sums[c] += tree.sums[at]
            stats["whole"] += int(tree.end[at] - tree.begin[at])
        leaf = ~one & (tree.child[nodes] == 0)
        if leaf.any():
            size = (tree.end - tree.begin)[nodes[leaf]]
            places = np.concatenate([np.arange(tree.begin[a], tree.end[a]) for a in nodes[leaf]])
            points = tree.points[places]
            d = distances(points, centroids)
            d[~np.repeat(alive[leaf], size, axis=0)] = np.iinfo(np.int64).max
            found = d.argmin(1)  # of equal ones the first
            labels[places] = found
            n += np.bincount(found, minlength=k)
            np.add.at(sums, found, points)
            stats["single"] += len(places)
        inner = ~one & ~leaf
        if inner.any():
            first = tree.child[nodes[inner]]
            todo.append((np.concatenate([first, first + 1]), np.concatenate([alive[inner], alive[inner]])))
    return labels, n, sums, stats


def _sums(held):
    def run(batches):
        centroids = held.value
        n, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for tree in _trees(batches):
            _, m, s, _ = walk(tree, centroids)
            n, sums = n + m, sums + s
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_pydict({"cluster": some, "n": n[some], "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    return run


def _labels(held):
    def run(batches):
        centroids = held.value
        for tree in _trees(batches):
            labels, *_ = walk(tree, centroids)
            apart = tree.points - centroids[labels]
            yield pa.RecordBatch.from_pydict({"id": pa.array(tree.ids, pa.int64()), "cluster": pa.array(labels, pa.int32()), "distance": (apart * apart).sum(1)})

    return run


def starts(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("v", order.alias("order")).orderBy(F.col("order").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def fit(trees: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds over the stored blocks. A round brings
    k rows to the driver; a centroid without vectors stays."""
    context = trees.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(centroids)
        part = trees.mapInArrow(_sums(held), "cluster long, n long, sums array<long>")
        total = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(centroids.shape[1])])
        new = centroids.copy()
        for row in total.collect():
            new[row[0]] = [s // row[1] for s in row[2:]]
        held.unpersist()
        if (new == centroids).all():
            break
        centroids = new
    return centroids


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of (id long, vector), stored, and the final centroids."""
    spark = vectors.sparkSession
    rows = kept(vectors, dim, scale)
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    trees = blocks(rows)
    centroids = fit(trees, centroids, rounds)
    found = trees.mapInArrow(_labels(spark.sparkContext.broadcast(centroids)), "id long, cluster int, distance long")
    return runtime.stored(found, "clusters"), centroids


def summary(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, cluster_inertia, inertia, centroid_sha256), one row a cluster."""
    per = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    inertia = sum(r.s for r in per)
    rows = [(r.cluster, r.s, inertia, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in per]
    return found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    vectors = runtime.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found, centroids = cluster(vectors)
    return found.join(F.broadcast(summary(found, centroids)), "cluster").withColumnRenamed("id", "vec_id")
