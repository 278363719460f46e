"""Near duplicates by SetSketch registers.

1. Each text becomes the set of its word shingles and a SetSketch: REGISTERS
   exponentially spaced truncated minima of independent hashes.
2. Documents with equal sets (128-bit) are one class, the smallest doc_id its
   representative; only representatives go on.
3. Bands of ROWS register values: representatives that share a band value are
   tied to the smallest one there (a star, never pairs). The components of the
   stars are families: a pair with similarity 0.85 shares one of the 24 bands
   with probability 1 - 1e-6 (0.80: 1 - 1e-4).
4. Each representative is compared with one other, its hub: the one that it
   shares most bands with. A pair is first estimated jointly by likelihood from
   the registers and the sets' sizes, then confirmed on the full sets. A hub's
   members are dealt over tasks of bounded size. The components of these links
   are clusters.
5. Families with several clusters are split into parts of bounded size, large
   clusters into parts of their own, and each pair of parts is one task that
   compares what is not connected yet. Pairs of parts that both belong to the
   family's largest cluster are left out. Only a spanning forest of the
   confirmed links leaves a task.
6. The components of all links, joined with the classes.

A family whose members mostly resemble their hubs costs time in proportion to
its size; R parts outside the largest cluster cost R times all the family's
parts. No pair of documents is emitted, no family is gathered in one task, and
nothing is capped.

Defined results: texts without words have an empty set, are linked with
nothing and kept; texts of fewer words than a shingle are one shingle; a null
doc_id has a null component and is kept; rows of one doc_id are judged each by
its own set and stand for one node where they represent a class; very long texts are
read whole; other columns are ignored; an empty table gives an empty result. A
shingle is known by a 64-bit hash, also where links are confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, runtime
from .words import hash_words, mix, words_of

REGISTERS, ROWS = 120, 5
BASE, RATE = 1.02, 20.0
#: An estimate this much below the threshold (4 standard errors) decides.
MARGIN = 0.14
PART_SHINGLES, PART_DOCS = 400_000, 2000
#: Rows of three numbers that may be broadcast.
BROADCAST_ROWS = 500_000

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def shingles(col, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, each text's sorted, and the n + 1 bounds."""
    w = words_of(col, lower=True)
    h = hash_words(w)
    n = np.diff(w.off)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(n)), size)
    first = w.off[doc] + np.arange(off[-1]) - off[doc]
    out = np.full(off[-1], 77, np.uint64)
    length = np.minimum(n, k)[doc]
    for j in range(k):
        more = length > j
        at = first[more] + j
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[at])
    order = np.lexsort((out, doc))
    out = out[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))])


def sketch(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Registers of each set, uint16; empty sets have zeros."""
    out = np.zeros((len(off) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    starts = off[:-1][full]
    least = np.empty((len(full), REGISTERS), np.uint64)
    for r in range(REGISTERS):
        y = x * _A[r]
        y += _B[r]
        y ^= y >> np.uint64(32)
        y *= np.uint64(0xD6E8FEB86659FD93)
        least[:, r] = np.minimum.reduceat(y, starts)
    u = (least.astype(float) + 0.5) / 2.0**64
    e = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, 65534)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.3, 1.0, 71)


def _p(x):
    return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)


def estimate(r: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity of one set with others: maximum likelihood on a grid."""
    more = (r > others).sum(1)[:, None]
    less = (r < others).sum(1)[:, None]
    u = (n / (n + sizes))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    a, b = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
    like = more * np.log(a) + less * np.log(b) + (REGISTERS - more - less) * np.log(np.maximum(1 - a - b, 1e-12))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _sketches(k: int):
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                x, off = shingles(part.column("text"), k)
                n = np.diff(off)
                regs = sketch(x, off)
                bands = regs.reshape(len(n), -1, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1), bands.shape[:2]).copy()
                for j in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
                c1, c2 = (np.concatenate([[np.uint64(0)], np.cumsum(mix(x ^ s))]) for s in (np.uint64(0x1234567), np.uint64(0x89ABCDEF01)))
                h1, h2 = ((c[off[1:]] - c[off[:-1]]).view(np.int64) for c in (c1, c2))
                flat = pa.array(key.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(n), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, key.shape[1], dtype=np.int32), flat)],
                    ["doc_id", "key", "n", "h1", "h2", "bands"],
                )

    return run


def _likely(regs: np.ndarray, n: np.ndarray, i: int, j: np.ndarray, percent: int) -> np.ndarray:
    """Of the sets ``j`` those whose estimated similarity with set ``i`` may reach the threshold."""
    floor = percent / 100 - MARGIN
    j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
    j = j[(regs[j] == regs[i]).sum(1) >= REGISTERS * (floor - 0.1)]
    return j[estimate(regs[i], int(n[i]), regs[j], n[j]) >= floor] if len(j) else j


def _spokes(k: int, percent: int):
    def run(key, table):
        """The members that are linked with the hub."""
        hub = table["is_hub"].to_numpy()
        ids = table["doc_id"].to_numpy()
        x, off = shingles(table["text"], k)
        n = np.diff(off)
        regs = sketch(x, off)
        a: list[int] = []
        for i in np.flatnonzero(hub & (n > 0)):
            j = _likely(regs, n, i, np.flatnonzero(~hub & (n > 0)), percent)
            c = np.concatenate([[0], np.cumsum(np.isin(x, x[off[i] : off[i + 1]]))]) if len(j) else np.zeros(1, int)
            both = c[off[j + 1]] - c[off[j]]
            a += ids[j[100 * both >= percent * (n[i] + n[j] - both)]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([key[0].as_py()] * len(a), pa.int64())})

    return run


def _links(k: int, percent: int):
    def run(key, table):
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if table.num_rows < 2:
            return empty
        table = table.sort_by("doc_id")
        ids = table["doc_id"].to_numpy()
        x, off = shingles(table["text"], k)
        n = np.diff(off)
        regs = sketch(x, off)
        _, x = np.unique(x, return_inverse=True)
        mark = np.zeros(int(x.max()) + 1 if len(x) else 1, bool)
        comp = np.unique(table["cluster"].to_numpy(), return_inverse=True)[1]
        a, b = [], []
        for i in range(len(ids) - 1):
            j = np.flatnonzero((comp[i + 1 :] != comp[i]) & (n[i + 1 :] > 0)) + i + 1
            j = _likely(regs, n, i, j, percent)
            if not len(j):
                continue
            mine = x[off[i] : off[i + 1]]
            mark[mine] = True
            for t in j:
                if comp[t] != comp[i]:
                    both = int(mark[x[off[t] : off[t + 1]]].sum())
                    if 100 * both >= percent * (int(n[i]) + int(n[t]) - both):
                        comp[comp == comp[t]] = comp[i]
                        a.append(ids[t])
                        b.append(ids[i])
            mark[mine] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _hub_links(docs: DataFrame, ties: DataFrame, sizes: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of each document with its hub, from band ties (a, b, shared)."""
    hub = ties.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")).join(sizes.withColumnRenamed("id", "a"), "a")
    deals = hub.groupBy("b").agg(_n_parts().alias("deals"))
    member = hub.select("a", "b").join(deals, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int").alias("deal"), F.lit(False).alias("is_hub"))
    center = deals.select(F.col("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(True).alias("is_hub"))
    asked = runtime.stored(member.unionByName(center), "hubs")
    return docs.join(few(asked), "doc_id").groupBy("b", "deal").applyInArrow(_spokes(k, percent), "a long, b long")


def _n_parts():
    """Parts of bounded size for the sets of a group."""
    return F.ceil(F.greatest(F.sum("n") / PART_SHINGLES, F.count(F.lit(1)) / PART_DOCS)).cast("int")


def _cross_links(docs: DataFrame, family: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between clusters of one family; family has id,
    component, cluster and n."""
    split = family.groupBy("component").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y"), _n_parts().alias("parts")).where("x < y").select("component", "parts")
    spread = family.groupBy("component", "cluster").agg(_n_parts().alias("spread"), F.sum("n").alias("weight"))
    largest = spread.groupBy("component").agg(F.max_by("cluster", F.struct("weight", "cluster")).alias("largest"))
    # A cluster's documents go to as many parts as it fills, the rest by hash of
    # the cluster; the largest one never shares a part.
    rows = family.join(spread.drop("weight"), ["component", "cluster"]).join(split, "component").join(largest, "component")
    big = F.col("cluster") == F.col("largest")
    p = F.when(big, -1 - F.pmod(F.xxhash64("id"), F.col("spread"))).otherwise(F.pmod(F.xxhash64("cluster") + F.pmod(F.xxhash64("id"), F.col("spread")), F.col("parts")))
    placed = runtime.stored(rows.select(F.col("id").alias("doc_id"), "component", "cluster", p.cast("int").alias("p")), "placed")
    parts = placed.select("component", "p").distinct()
    pairs = parts.where("p >= 0").withColumnRenamed("p", "q").join(parts, "component").select("component", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).distinct()
    ends = runtime.stored(pairs.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("p")), "ends")
    texts = docs.join(few(placed), "doc_id").join(few(ends), ["component", "p"])
    return texts.select("component", "i", "j", "doc_id", "text", "cluster").groupBy("component", "i", "j").applyInArrow(_links(k, percent), "a long, b long")


def _key():
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text")


def _judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, key, n, component_id of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key"))
    made = runtime.stored(docs.mapInArrow(_sketches(k), "doc_id long, key long, n long, h1 long, h2 long, bands array<long>"), "sketch")
    known = made.where("doc_id IS NOT NULL AND n > 0")
    first = known.groupBy("h1", "h2", "n").agg(F.min_by(F.struct("doc_id", "key", "bands"), F.struct("doc_id", "key")).alias("r")).select("h1", "h2", "n", "r.*")
    # A doc_id with different texts is no node: its rows that represent a class get one each.
    several = runtime.stored(known.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("doc_id"), "several")
    plain = several.isEmpty()
    if plain:
        reps = runtime.stored(first.withColumn("node", F.col("doc_id")), "reps")
        docs = docs.select("doc_id", "text")
    else:
        own = F.shiftrightunsigned(F.xxhash64("doc_id", "h1", "h2", "n"), 1)
        marked = first.join(few(several.withColumn("many", F.lit(True))), "doc_id", "left")
        reps = runtime.stored(marked.withColumn("node", F.when(F.col("many"), own).otherwise(F.col("doc_id"))).drop("many"), "reps")
        node = reps.join(few(several), "doc_id").select("doc_id", "key", "node")
        rows = docs.join(few(several.withColumn("many", F.lit(True))), "doc_id", "left")
        once = rows.where("many IS NULL").select("doc_id", "text")
        docs = once.unionByName(rows.where("many").join(few(node), ["doc_id", "key"]).select(F.col("node").alias("doc_id"), "text"))
    keys = reps.select(F.col("node").alias("doc_id"), F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("m")).where("b < m").select("key", "b")
    ties = runtime.stored(keys.join(least, "key").where("doc_id > b").groupBy(F.col("doc_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared")), "ties")
    sizes = reps.select(F.col("node").alias("id"), "n")
    near = runtime.stored(_hub_links(docs, ties, sizes, k, percent), "near")
    cluster = graph.components(near).withColumnRenamed("component", "cluster")
    family = graph.components(ties.select("a", "b")).join(sizes, "id").join(cluster, "id", "left")
    family = runtime.stored(family.select("id", "component", F.coalesce("cluster", "id").alias("cluster"), "n"), "family")
    joined = graph.components(near.unionByName(_cross_links(docs, family, k, percent))).select(F.col("id").alias("node"), "component")
    of_class = reps.select("h1", "h2", "n", "doc_id", "node").join(joined, "node", "left")
    if not plain:  # the smallest node need not be that of the smallest doc_id
        of_class = runtime.stored(of_class.withColumn("component", F.coalesce("component", "node")), "classes")
        of_class = of_class.join(of_class.groupBy("component").agg(F.min("doc_id").alias("least")), "component").withColumn("component", F.col("least"))
    of_class = of_class.select("h1", "h2", "n", F.coalesce("component", "doc_id").alias("component"))
    of_row = made.select("doc_id", "key", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    return of_row.select("doc_id", "key", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def classes(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: links are pairs with
    100 * |intersection| >= percent * |union| of the shingle sets."""
    return _judged(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that do not hold the smallest id of their component."""
    gone, key = runtime.free(docs, "_gone", "_key")
    out = runtime.stored(_judged(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(gone), F.col("key").alias(key)).distinct(), "gone")
    return docs.join(few(out), (F.col("doc_id") == F.col(gone)) & (_key() == F.col(key)), "left_anti")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = classes(runtime.read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
