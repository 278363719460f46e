"""A stored vector index: cells with residual product codes, probed and reranked.

``VectorIndex.of`` fits on a bounded sample (``SAMPLE`` vectors, those with the
smallest hashes of their keys): k-means cells, and for each of ``PARTS`` parts of
a vector a codebook for what the cells leave over. Every vector is then assigned to
its cell and coded; the table (cell, domain, chunk_id, code, vector) is laid out by
cell, so that a search reads the folders of the cells that it probes. Crowded cells
are split over files by the adaptive planner, not gathered.

How many cells to probe and how many hits to rerank is measured at the fit: held-out
vectors of the sample ask for their exact neighbours, and both numbers are the
smallest that find ``TARGET`` of them. Clustered vectors need few probes; vectors
without any structure need most cells, and then only codes are saved.

``search`` sends the questions out in blocks, scores the codes of the probed cells
by table look-ups, and reranks the best ``depth`` times k by their exact products.
``exact`` is the same search over all vectors without codes (``search.dense``).

Defined results: rows without a vector, or of another number of components than the
sample's commonest, are not in the index; equal vectors and ties go by chunk_id; an
empty table makes an index that finds nothing.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import search as S
from quarry.operators.postings import small
from quarry.sources import scratch

SAMPLE, HELD_OUT, NEIGHBOURS = 20_000, 200, 10
PARTS, CODES, STEPS = 16, 256, 8
#: Sampled vectors a cell, and cells at most.
PER_CELL, MOST_CELLS = 40, 65_536
TARGET = 0.95


class Model(NamedTuple):
    cells: np.ndarray  # (c, d)
    books: list[np.ndarray]  # of each part (codes, width)
    cuts: np.ndarray  # bounds of the parts
    probes: int
    depth: int  # hits to rerank, as a multiple of k


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * points @ centres.T + (centres * centres).sum(1)).argmin(1)


def kmeans(points: np.ndarray, k: int, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    """Lloyd's steps on the sample, from distinct points."""
    start = np.unique(points, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(steps):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x, len(centres)) for x in points.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def coded(points: np.ndarray, cell: np.ndarray, model: Model) -> np.ndarray:
    left = points - model.cells[cell]
    return np.stack([nearest(left[:, a:b], book) for a, b, book in zip(model.cuts, model.cuts[1:], model.books)], 1).astype(np.uint8)


def tables(asked: np.ndarray, model: Model) -> np.ndarray:
    """Products of each question with each code, (questions, parts, codes)."""
    out = np.zeros((len(asked), len(model.books), max(map(len, model.books))), np.float32)
    for m, (a, b, book) in enumerate(zip(model.cuts, model.cuts[1:], model.books)):
        out[:, m, : len(book)] = asked[:, a:b] @ book.T
    return out


def approximate(asked: np.ndarray, look: np.ndarray, codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Products with coded vectors, (vectors, questions)."""
    out = np.zeros((len(codes), len(asked))) + np.atleast_2d(centres) @ asked.T
    for m in range(codes.shape[1]):
        out += look[:, m, codes[:, m]].T
    return out


def fit(sample: np.ndarray, cells: int | None = None, n: int | None = None, target: float = TARGET) -> Model:
    """The model of a sample of ``n`` vectors, with probes and depth measured on it."""
    n = len(sample) if n is None else n
    cells = cells or int(min(np.sqrt(n), len(sample) / PER_CELL, MOST_CELLS))
    centres = kmeans(sample, max(1, cells))
    cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
    left = sample - centres[nearest(sample, centres)]
    model = Model(centres, [kmeans(left[:, a:b], CODES) for a, b in zip(cuts, cuts[1:])], cuts, len(centres), 1)
    asked = sample[np.linspace(0, len(sample) - 1, min(HELD_OUT, len(sample))).astype(int)]
    cell = nearest(sample, centres)
    exact = asked @ sample.T
    k = min(NEIGHBOURS, len(sample))
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    order = np.argsort(-2 * asked @ centres.T + (centres * centres).sum(1), axis=1)
    place = np.argsort(order, axis=1)  # of each cell among a question's
    # Each of the two may lose half of what the target leaves.
    quantile = lambda x: int(np.ceil(np.quantile(x, 1 - (1 - target) / 2)))
    probes = quantile(np.take_along_axis(place, cell[best], 1)) + 1
    near = approximate(asked, tables(asked, model), coded(sample, cell, model), centres[cell]).T
    rank = np.argsort(np.argsort(-near, axis=1), axis=1)
    depth = -(-(quantile(np.take_along_axis(rank, best, 1)) + 1) // k)
    return model._replace(probes=min(probes, len(centres)), depth=depth)


def _assigned(held):
    def run(batches):
        model = held.value
        for batch in batches:
            points = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            if not len(points):
                continue
            cell = nearest(points, model.cells)
            codes = coded(points, cell, model)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *(batch.column(c) for c in ("domain", "chunk_id")), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vector")], ["cell", "domain", "chunk_id", "code", "vector"])

    return run


def _probed(held, model_held, k: int):
    """The best ``k`` of each question and domain by their codes, of each task."""

    def run(batches):
        asked, domains_of, look, asks_of = held.value
        model = model_held.value
        names: list = []
        kept: list = []
        for batch in (b.slice(a, S.SCORED_ROWS) for b in batches for a in range(0, b.num_rows, S.SCORED_ROWS)):
            cell = batch.column("cell").to_numpy()
            domain = batch.column("domain").dictionary_encode()
            code = domain.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for c in np.unique(cell):
                asks = asks_of.get(int(c))
                if asks is None:
                    continue
                for j, name in enumerate(domain.dictionary.to_pylist()):
                    at = np.flatnonzero((cell == c) & (code == j))
                    mine = asks if domains_of is None else np.array([q for q in asks if name in domains_of[q]], int)
                    if not len(at) or not len(mine):
                        continue
                    if name not in names:
                        names.append(name)
                    s = approximate(asked[mine], look[mine], codes[at], model.cells[c])
                    hit = np.ones_like(s, bool) if len(at) <= k else s >= np.partition(s, len(at) - k, axis=0)[len(at) - k]
                    row, q = np.nonzero(hit)
                    kept.append((mine[q], np.full(len(q), names.index(name)), batch.column("chunk_id").take(pa.array(at[row])), s[row, q], cell[at[row]]))
            if sum(len(x[0]) for x in kept) > S.HELD_HITS:
                kept = [_best(kept, k)]
        if kept:
            q, d, ids, x, cell = _best(kept, k)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(names, pa.string()).take(pa.array(d)), ids, pa.array(x, pa.float64()), pa.array(cell, pa.int32())], ["q", "domain", "chunk_id", "score", "cell"])

    return run


def _best(parts: list, k: int):
    q, d, x, cell = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4))
    ids = pa.concat_arrays([p[2] for p in parts])
    order = S.kept_places(q, d, ids, x, k)
    return q[order], d[order], ids.take(pa.array(order)), x[order], cell[order]


class VectorIndex:
    def __init__(self, model: Model | None, table: DataFrame):
        self.model, self.table = model, table

    @classmethod
    def of(cls, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> VectorIndex:
        """The index of (domain, chunk_id, vector)."""
        spark = vectors.sparkSession
        vectors = vectors.where("vector IS NOT NULL").select("domain", "chunk_id", "vector")
        n = vectors.count()
        rows = [r.vector for r in vectors.orderBy(F.xxhash64("domain", "chunk_id"), "domain", "chunk_id").select("vector").limit(sample).collect()]  # bounded
        if not rows:
            return cls(None, vectors)
        dim = Counter(map(len, rows)).most_common(1)[0][0]
        model = fit(np.array([r for r in rows if len(r) == dim], float), cells, n, target)
        kind = vectors.schema["vector"].dataType.simpleString()
        held = spark.sparkContext.broadcast(model)
        made = vectors.where(F.size("vector") == dim).mapInArrow(_assigned(held), f"cell int, domain string, chunk_id string, code binary, vector {kind}")
        path = scratch.table_path(spark, "cells")
        made.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
        return cls(model, spark.read.schema(f"domain string, chunk_id string, code binary, vector {kind}, cell int").parquet(path))

    def search(self, queries: DataFrame, k: int = S.TOP_K, wanted: DataFrame | None = None, probes: int | None = None, depth: int | None = None, block: int = S.QUERY_BLOCK) -> DataFrame:
        """(query_id, domain, chunk_id, score, rank), as ``search.dense``, for (query_id,
        vector): the k best of the hits that the probes find."""
        model = self.model
        if model is None:
            return S.dense(queries, self.table, k, wanted)
        spark = self.table.sparkSession
        probes, most = probes or model.probes, k * (depth or model.depth)
        ids = queries.where(F.size("vector") == model.cells.shape[1])
        if wanted is not None:
            ids = ids.join(wanted.groupBy("query_id").agg(F.collect_set("domain").alias("domains")), "query_id")
        blocks = max(1, -(-ids.count() // block))
        model_held = spark.sparkContext.broadcast(model)
        found = None
        for i in range(blocks):
            rows = (ids if blocks == 1 else ids.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).collect()  # about ``block`` rows
            if not rows:
                continue
            asked = np.array([r.vector for r in rows], float)
            order = np.argsort(-2 * asked @ model.cells.T + (model.cells**2).sum(1), axis=1)[:, :probes]
            asks_of = {int(c): np.flatnonzero((order == c).any(1)) for c in np.unique(order)}
            held = spark.sparkContext.broadcast((asked, None if wanted is None else [set(r.domains) for r in rows], tables(asked, model), asks_of))
            part = self.table if len(asks_of) == len(model.cells) else self.table.where(F.col("cell").isin(*asks_of))
            hits = part.select("cell", "domain", "chunk_id", "code").mapInArrow(_probed(held, model_held, most), "q long, domain string, chunk_id string, score double, cell int")
            names = spark.createDataFrame([(n, r.query_id, r.vector) for n, r in enumerate(rows)], T.struct_of(q="long", query_id=queries.schema["query_id"].dataType, asked="array<double>"))
            hits = S.ranked(hits.withColumnRenamed("q", "query_id"), most).select(F.col("query_id").alias("q"), "cell", "domain", "chunk_id")
            hits = scratch.stored(hits, "probed")
            # Few hits are sent to the vectors, which stay where they are.
            near = part.select("cell", "domain", "chunk_id", "vector").join(small(hits), ["cell", "domain", "chunk_id"]).join(F.broadcast(names), "q")
            near = near.select("query_id", "domain", "chunk_id", F.round(S.dot(F.col("asked"), F.col("vector")), 6).alias("score"))
            found = near if found is None else found.unionByName(near)
        if found is None:
            found = queries.limit(0).select("query_id").join(self.table.limit(0).select("domain", "chunk_id")).withColumn("score", F.lit(0.0))
        return S.ranked(found, k)
