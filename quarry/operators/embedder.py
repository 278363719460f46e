"""An embedder of our own: latent semantic vectors of texts.

``fit`` takes the truncated singular value decomposition of the chunks' tf-idf matrix
by block power iteration. A chunk's row has (1 + ln f) * idf for each of its tokens
in the vocabulary, scaled to length 1; idf = ln((1 + n) / (1 + df)) + 1. The
vocabulary is a parameter of the model: the ``VOCABULARY`` tokens of most chunks, with
``LEAST_DF`` chunks or more. Each step multiplies all rows with a block of
``dim`` + ``EXTRA`` columns: tasks stream their rows, as coded numbers, and give sums
by token, which are added up by ranges of the vocabulary, and the driver orthonormalises vocabulary x block
numbers. The factors come from the block's projection.

A text's vector is its row times the right singular vectors, scaled to length 1, so
that products are cosines. ``Embedder.column`` embeds a column of any texts; a task
loads the model once.

Defined results: a text without a known token, and a null one, have no vector; an
empty table makes a model without tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources import scratch

DIM, EXTRA, STEPS = 64, 10, 8
VOCABULARY, LEAST_DF = 20_000, 2
#: Rows of a slice.
SLICE = 512
#: Ranges of the vocabulary by which tasks' sums are added up.
RANGES = 16


class Vocabulary(NamedTuple):
    tokens: pa.Array
    idf: np.ndarray


def coded(listed: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms as sparse rows: (bounds, places in the vocabulary, values of length 1)."""
    n = np.diff(listed.offsets.to_numpy()) if not listed.null_count else np.array([len(x) if x else 0 for x in listed.to_pylist()])
    flat = listed.flatten()
    place = pc.index_in(flat.field("token"), value_set=v.tokens).fill_null(-1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)[place >= 0]
    value = (1 + np.log(flat.field("f").to_numpy()[place >= 0])) * v.idf[place[place >= 0]]
    length = np.sqrt(np.bincount(row, value**2, len(n)))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
    return bounds, place[place >= 0], value / length[row]


def times(bounds: np.ndarray, place: np.ndarray, value: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sparse rows times a block of columns."""
    out = np.zeros((len(bounds) - 1, block.shape[1]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(value[:, None] * block[place], bounds[some])
    return out


def _rows(held):
    def run(batches):
        for batch in batches:
            bounds, place, value = coded(batch.column("terms"), held.value)
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([lists(place, pa.int32()), lists(value, pa.float64())], ["place", "value"])

    return run


def _products(held):
    """A task's sums of row times row's product with the block, by token."""

    def run(batches):
        block = held.value
        out = np.zeros_like(block)
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            places = batch.column("place")
            bounds = places.offsets.to_numpy() - places.offsets[0].as_py()
            place, value = places.flatten().to_numpy(), batch.column("value").flatten().to_numpy()
            if not len(place):
                continue
            near = times(bounds, place, value, block)
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) > 0]))
            out[place[order][first]] += np.add.reduceat(value[order, None] * near[row[order]], first)
        for i, part in enumerate(np.array_split(out, RANGES)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"range": pa.array([i], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})

    return run


def _added(batches):
    """The tasks' sums of each range, added as they come."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column("range").to_pylist(), batch.column("sums")):
            part = np.frombuffer(x.as_buffer())
            held[i] = held[i] + part if i in held else part
    for i, part in held.items():
        yield pa.RecordBatch.from_pydict({"range": pa.array([i], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})


class Embedder(NamedTuple):
    vocabulary: Vocabulary
    basis: np.ndarray  # (tokens, dim)
    values: np.ndarray  # singular values

    def embed(self, listed: pa.Array) -> list:
        """Unit vectors of terms; none without a known token."""
        near = times(*coded(listed, self.vocabulary), self.basis)
        length = np.sqrt((near * near).sum(1))
        return [x / n if n > 1e-12 else None for x, n in zip(near, length)]

    def column(self, spark):
        """A column function: text to array<double>."""
        held = spark.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = held.value  # once a task
            for part in parts:
                rows = [sorted(Counter(x).items()) for x in part]
                listed = pa.array(rows, pa.list_(pa.struct([("token", pa.string()), ("f", pa.int32())])))
                yield pd.Series(model.embed(listed), dtype=object)

        def column(text: Column) -> Column:
            return run(T.tokens(F.coalesce(text, F.lit(""))))

        return column


def fit(index: DataFrame, dim: int = DIM, vocabulary: int = VOCABULARY, least_df: int = LEAST_DF, steps: int = STEPS, seed: int = 5) -> Embedder:
    """The embedder of an index with a column ``terms`` (see ``search.index``)."""
    spark = index.sparkSession
    n = index.count()
    df = index.select(F.explode("terms.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df)
    known = df.orderBy(F.desc("df"), "token").limit(vocabulary).collect()  # bounded by the parameter
    v = Vocabulary(pa.array([r.token for r in known], pa.string()), np.log((1 + n) / (1 + np.array([r.df for r in known], float))) + 1)
    if not known:
        return Embedder(v, np.zeros((0, dim)), np.zeros(dim))
    with scratch.batch_rows(spark, SLICE):
        rows = scratch.stored(index.select("terms").mapInArrow(_rows(spark.sparkContext.broadcast(v)), "place array<int>, value array<double>"), "rows")
    width = min(dim + EXTRA, len(known))
    block, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(known), width)))
    for step in range(steps + 1):
        held = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(_products(held), "range int, sums binary")
        total = {r.range: np.frombuffer(r.sums) for r in part.repartition(RANGES, "range").mapInArrow(_added, "range int, sums binary").collect()}
        sizes = [len(x) for x in np.array_split(np.zeros(len(block)), RANGES)]
        image = np.concatenate([total.get(i, np.zeros(n * width)).reshape(n, width) for i, n in enumerate(sizes)])
        held.unpersist()
        if step < steps:
            block, _ = np.linalg.qr(image)
    square = block.T @ image
    value, turn = np.linalg.eigh((square + square.T) / 2)
    best = np.argsort(-value)[:dim]
    return Embedder(v, block @ turn[:, best], np.sqrt(np.maximum(value[best], 0)))
