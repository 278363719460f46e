"""A stored keyword index: postings in segments, searched without reading a text.

An index is a list of segments. A segment's chunks lie in shards of one domain and
up to ``SHARD`` chunks (or about ``POSTINGS`` postings), filled as the chunks are read, and each shard is one row: its chunk ids
in order, its tokens in order with their document frequencies, and their postings
(chunk, frequency) in chunk order, cut into blocks of ``BLOCK`` with each block's
largest frequency and smallest chunk length. A block's share of a score can't
exceed what these two give, whatever the average length is by then.

``TextIndex.search`` sends the questions' token weights to all shards and takes each
shard's k best chunks (``top``): tokens go by the most that they can add, until the
rest together can't lift a new chunk into the k best; the rest is only looked up for
the chunks left, and blocks that hold none of them, or can't lift one, are skipped.
The result equals an exhaustive one.

``add`` and ``remove`` keep the index up to date. An added chunk replaces the one of
its id; a removed one is marked in its segment. Statistics are sums over segments
without the marked chunks, read from postings. Segments are compacted at ``FANOUT``
of them, or when a segment's marks reach ``DEAD`` of its chunks. Each task holds
shards one by one, so that its memory does not depend on the size of the index.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources import scratch

K1, B, EPSILON = 1.5, 0.75, 0.25
SHARD, BLOCK = 8192, 128
#: Postings at which a shard ends, too: they are what a task's memory goes by.
POSTINGS = 1 << 19
#: Shards' worth of chunks or postings that a task holds before it ends them all.
HELD = 4
#: Chunks that come to a task at once.
READ_ROWS = 512
FANOUT, DEAD = 6, 0.25
#: Question tokens of a block: so many weights are collected and broadcast at once.
WEIGHTS = 1_000_000
#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 200_000
#: Scores are rounded to 6 places: sums that differ by less can be equal.
SLACK = 2e-6
_BINARY = {"dls": np.int32, "docs": np.int32, "fs": np.int32, "block_f": np.int32, "block_dl": np.int32}
SHARD_SCHEMA = "domain string, shard long, n int, total long, ids array<string>, tokens array<string>, dfs array<int>, dls binary, docs binary, fs binary, block_f binary, block_dl binary"
_ARROW = pa.schema([("domain", pa.string()), ("shard", pa.int64()), ("n", pa.int32()), ("total", pa.int64()), ("ids", pa.list_(pa.string())), ("tokens", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())), *((c, pa.binary()) for c in _BINARY)])
_TERM = pa.list_(pa.struct([("token", pa.string()), ("f", pa.int32())]))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast after a count of its rows; else joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def terms(tokens: Column) -> Column:
    """array<struct<token, f>>: the different tokens, in order, with their counts."""

    def counted(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (s[i] != s[F.greatest(i - 1, F.lit(0))]))
        runs = lambda a: F.zip_with(a, F.concat(F.slice(a, 2, n), F.array(n)), lambda x, y: F.struct(s[x].alias("token"), (y - x).cast("int").alias("f")))
        return F.when(n > 0, F.transform(F.array(first), runs)[0]).otherwise(F.array().cast("array<struct<token:string,f:int>>"))

    # The sorted array is bound once, for all of its readers.
    return F.transform(F.array(F.sort_array(tokens)), counted)[0]


def idf_of(corpus: DataFrame, df: DataFrame) -> DataFrame:
    """(domain, token, df, idf) of (domain, n, avgdl) and (domain, token, df). A
    negative idf becomes EPSILON times the domain's mean idf."""
    raw = df.join(corpus, "domain").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = scratch.stored(raw.select("domain", "token", "df", "raw"), "idf")
    mean = raw.groupBy("domain").agg(F.avg("raw").alias("mean"))
    return raw.join(mean, "domain").select("domain", "token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


# ---------------------------------------------------------------- shards


class Shard(NamedTuple):
    domain: str
    ids: pa.Array
    tokens: pa.Array
    dfs: np.ndarray
    dls: np.ndarray
    docs: np.ndarray
    fs: np.ndarray
    block_f: np.ndarray
    block_dl: np.ndarray
    dead: np.ndarray | None

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.dfs)])


def shard_row(domain: str, shard: int, ids: pa.Array, dls: np.ndarray, listed: pa.Array) -> pa.RecordBatch:
    """The row of chunks ``ids`` (ascending) with their terms."""
    flat = listed.flatten()
    docs = np.repeat(np.arange(len(ids)), np.diff(listed.offsets.to_numpy()))
    coded = flat.field("token").dictionary_encode()
    by = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by), np.int64)
    rank[by.to_numpy()] = np.arange(len(by))
    token = rank[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    order = np.argsort(token, kind="stable")  # chunks stay in order
    docs, fs = docs[order], flat.field("f").to_numpy()[order]
    dfs = np.bincount(token, minlength=len(by))
    begin = np.cumsum(dfs) - dfs
    blocks = -(-dfs // BLOCK)
    at = np.repeat(begin, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    most = np.maximum.reduceat(fs, at) if len(at) else fs
    least = np.minimum.reduceat(dls[docs], at) if len(at) else fs
    raw = {"dls": dls, "docs": docs, "fs": fs, "block_f": most, "block_dl": least}
    values = [[domain], [shard], [len(ids)], [int(dls.sum())], [ids.to_pylist()], [coded.dictionary.take(by).to_pylist()], [dfs.tolist()]]
    values += [[np.ascontiguousarray(raw[c], t).tobytes()] for c, t in _BINARY.items()]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)


def _dealt(limit: int):
    """Chunks as one row a shard: a task fills its domains' shards as it reads, and
    ends them at ``limit`` chunks or ``POSTINGS`` postings, or all when it holds
    ``HELD`` times as many."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        loads: dict[str, int] = {}

        def ended(domain: str):
            nonlocal made
            rows = pa.Table.from_batches(held.pop(domain)).combine_chunks()
            sizes.pop(domain)
            loads.pop(domain)
            rows = rows.take(pc.sort_indices(rows.column("chunk_id"))).combine_chunks().to_batches()[0]
            made += 1
            return shard_row(domain, (task << 32) + made, rows.column("chunk_id"), rows.column("dl").to_numpy(), rows.column("terms"))

        for batch in batches:
            batch = batch.filter(batch.column("domain").is_valid())
            coded = batch.column("domain").dictionary_encode()
            code = coded.indices.to_numpy()
            for j, domain in enumerate(coded.dictionary.to_pylist()):
                mine = batch.take(pa.array(np.flatnonzero(code == j)))
                while mine.num_rows:
                    part = mine.slice(0, limit - sizes.get(domain, 0))
                    mine = mine.slice(part.num_rows)
                    held.setdefault(domain, []).append(part)
                    sizes[domain] = sizes.get(domain, 0) + part.num_rows
                    loads[domain] = loads.get(domain, 0) + len(part.column("terms").flatten())
                    if sizes[domain] >= limit or loads[domain] >= POSTINGS:
                        yield ended(domain)
            if sum(sizes.values()) > HELD * limit or sum(loads.values()) > HELD * POSTINGS:
                for domain in list(held):
                    yield ended(domain)
        for domain in list(held):
            yield ended(domain)

    return run


def shards(batches):
    """The shards of Arrow batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            raw = {c: np.frombuffer(row.column(c)[0].as_buffer(), t).astype(np.int64) for c, t in _BINARY.items()}
            dead = row.column("dead")[0].values if "dead" in row.schema.names else None
            dead = None if dead is None else dead.to_numpy()
            yield Shard(row.column("domain")[0].as_py(), row.column("ids").flatten(), row.column("tokens").flatten(), row.column("dfs").flatten().to_numpy().astype(np.int64), *raw.values(), dead)


def build(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The stored segment of (domain, chunk_id, dl, terms). Nothing is shuffled: a
    shard is of chunks that one task reads."""
    with scratch.batch_rows(rows.sparkSession, READ_ROWS):
        return scratch.stored(rows.select("domain", "chunk_id", "dl", "terms").mapInArrow(_dealt(shard), SHARD_SCHEMA), "segment")


# ---------------------------------------------------------------- search


class Asked(NamedTuple):
    """The questions of one domain: question i has tokens tokens[ptr[i] : ptr[i + 1]]."""

    avgdl: float
    vocabulary: pa.Array
    queries: list
    ptr: np.ndarray
    tokens: np.ndarray  # places in the vocabulary
    weights: np.ndarray


def gain(f, dl, avgdl: float):
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def top(shard: Shard, asked: Asked, k: int | None):
    """For each question: (its number, places in the shard, scores) of the chunks that
    may be among its k best, and the counts of blocks read and of all blocks."""
    start, size = shard.starts, len(shard.ids)
    found = pc.index_in(asked.vocabulary, value_set=shard.tokens).fill_null(-1).to_numpy()
    gains = gain(shard.fs, shard.dls[shard.docs], asked.avgdl)
    first = np.concatenate([[0], np.cumsum(-(-shard.dfs // BLOCK))])  # a token's blocks
    bound = gain(shard.block_f, shard.block_dl, asked.avgdl)
    most = np.maximum.reduceat(bound, first[:-1]) if len(bound) else bound
    out, read, all_ = [], 0, 0
    for i in range(len(asked.queries)):
        at = found[asked.tokens[asked.ptr[i] : asked.ptr[i + 1]]]
        w = asked.weights[asked.ptr[i] : asked.ptr[i + 1]][at >= 0]
        at = at[at >= 0]
        if not len(at):
            continue
        all_ += int((first[at + 1] - first[at]).sum())
        limit = np.where(w > 0, w * most[at], 0.0)
        order = np.lexsort((-limit, w > 0))  # what lowers scores goes first
        at, w, limit = at[order], w[order], limit[order]
        rest = np.concatenate([np.cumsum(limit[::-1])[::-1], [0.0]])
        score = np.zeros(size)
        if shard.dead is not None:
            score[shard.dead] = -np.inf
        least, j = -np.inf, 0
        while j < len(at) and not (k is not None and k < size and least > rest[j] + SLACK):
            s, e = start[at[j]], start[at[j] + 1]
            score[shard.docs[s:e]] += w[j] * gains[s:e]
            read += int(first[at[j] + 1] - first[at[j]])
            j += 1
            if k is not None and k < size and score.max() > rest[j]:
                least = np.partition(score, size - k)[size - k]
        left = np.flatnonzero(score + rest[j] >= max(least - SLACK, 0)) if j < len(at) else np.flatnonzero(score > 0)
        mine = score[left]
        for j in range(j, len(at)):
            s, e, b = start[at[j]], start[at[j] + 1], first[at[j]]
            docs = shard.docs[s:e]
            place = np.minimum(np.searchsorted(docs, left), e - s - 1)
            # In the chunk's block the token can add this much at most.
            able = mine + w[j] * bound[b + place // BLOCK] + rest[j + 1] >= least - SLACK
            left, mine, place = left[able], mine[able], place[able]
            read += len(np.unique(place // BLOCK))
            hit = docs[place] == left
            mine = mine + np.where(hit, w[j] * gains[s + place], 0.0)
            if len(mine) > k:
                least = max(least, np.partition(mine, len(mine) - k)[len(mine) - k])
        mine = np.round(mine, 6)
        left, mine = left[mine > 0], mine[mine > 0]
        if k is not None and len(left) > k:
            best = np.lexsort((left, -mine))[:k]  # places are in the order of ids
            left, mine = left[best], mine[best]
        if len(left):
            out.append((i, left, mine))
    return out, read, all_


def _tops(held, k: int | None):
    def run(batches):
        asked_of = held.value
        for shard in shards(batches):
            asked = asked_of.get(shard.domain)
            if asked is None:
                continue
            found, _, _ = top(shard, asked, k)
            if found:
                n = [len(x) for _, x, _ in found]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat([i for i, _, _ in found], n)).cast(pa.int64()), "domain": pa.array([shard.domain] * sum(n), pa.string()),
                    "chunk_id": shard.ids.take(pa.array(np.concatenate([x for _, x, _ in found]))), "score": np.concatenate([x for _, _, x in found]),
                })

    return run


def _asked(rows: pa.Table) -> tuple[dict[str, Asked], list]:
    """By domain, from (domain, token, number, weight, avgdl)."""
    out = {}
    rows = rows.sort_by([("domain", "ascending"), ("number", "ascending"), ("token", "ascending")]).combine_chunks()
    names = rows.column("domain").to_pylist()
    cut = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    for s, e in zip(cut, [*cut[1:], len(names)]):
        part = rows.slice(s, e - s)
        coded = part.column("token").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        number = part.column("number").to_numpy()
        numbers, begin = np.unique(number, return_index=True)
        out[names[s]] = Asked(part.column("avgdl")[0].as_py(), coded.dictionary, numbers, np.append(begin, e - s), coded.indices.to_numpy().astype(np.int64), part.column("weight").to_numpy())
    return out


class TextIndex:
    """Segments of (shard rows, marks of removed chunks), and their statistics."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.segments: list[list] = []  # [rows, marks or None]
        self._stats: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def of(cls, rows: DataFrame) -> TextIndex:
        """The index of (domain, chunk_id, dl, terms), one segment."""
        made = cls(rows.sparkSession)
        made.segments.append([build(rows), None])
        return made

    def add(self, rows: DataFrame, replaced: DataFrame | None = None) -> None:
        """(domain, chunk_id, dl, terms), in place of the chunks of these ids and of
        ``replaced`` (domain, chunk_id): a changed file may have other chunks than before."""
        new = build(rows)
        gone = new.select("domain", F.explode("ids").alias("chunk_id"))
        self.remove(gone if replaced is None else gone.unionByName(replaced.select("domain", "chunk_id")))
        self.segments.append([new, None])
        if len(self.segments) >= FANOUT:
            self.compact()

    def remove(self, keys: DataFrame) -> None:
        """Marks the chunks of these (domain, chunk_id); unknown ones are none."""
        self._stats = None
        keys = small(keys.select("domain", "chunk_id").distinct())
        crowded = False
        for segment in self.segments:
            rows, marks = segment
            gone = rows.select("domain", "shard", F.posexplode("ids").alias("place", "chunk_id")).join(keys, ["domain", "chunk_id"], "left_semi").select("domain", "shard", "place")
            if marks is not None:
                gone = gone.unionByName(marks.select("domain", "shard", F.explode("dead").alias("place")))
            # A shard's marks are at most its chunks.
            gone = scratch.stored(gone.groupBy("domain", "shard").agg(F.sort_array(F.collect_set("place")).alias("dead")), "marks")
            n = gone.agg(F.sum(F.size("dead"))).first()[0] or 0
            if n:
                segment[1] = gone
                crowded |= n > DEAD * rows.agg(F.sum("n")).first()[0]
        if crowded:
            self.compact()

    def rows(self) -> DataFrame:
        """All shards, with the places of their removed chunks."""
        out = None
        for rows, marks in self.segments:
            none = F.lit(None).cast("array<int>").alias("dead")
            part = rows.select("*", none) if marks is None else rows.join(small(marks), ["domain", "shard"], "left").select(*rows.columns, "dead")
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], SHARD_SCHEMA + ", dead array<int>") if out is None else out

    def compact(self) -> None:
        """One segment of the chunks that are left, from postings alone."""
        kept = self.rows().mapInArrow(_unpacked, "domain string, chunk_id string, dl int, terms array<struct<token:string,f:int>>")
        with scratch.batch_rows(self.spark, 1):
            kept = scratch.stored(kept, "unpacked")
        old, self.segments = self.segments, [[build(kept), None]]
        self._stats = None
        for rows, marks in old:
            scratch.drop_stored(rows)
            if marks is not None:
                scratch.drop_stored(marks)

    def counts(self) -> tuple[DataFrame, DataFrame]:
        """(domain, n, avgdl) and (domain, token, df) of the chunks that are left."""
        whole, cut = [r for r, m in self.segments if m is None], TextIndex(self.spark)
        cut.segments = [s for s in self.segments if s[1] is not None]
        sums = [r.select("domain", F.col("n").cast("long").alias("n"), "total") for r in whole]
        dfs = [r.select("domain", F.explode(F.arrays_zip("tokens", "dfs")).alias("x")).select("domain", F.col("x.tokens").alias("token"), F.col("x.dfs").cast("long").alias("df")) for r in whole]
        if cut.segments or not whole:
            left = cut.rows()
            sums.append(left.mapInArrow(_left_sums, "domain string, n long, total long"))
            dfs.append(left.mapInArrow(_left_counts, "domain string, token string, df long"))
        both = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0].unionByName(both(parts[1:]))
        corpus = both(sums).groupBy("domain").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl")).where("n > 0")
        return corpus, both(dfs).groupBy("domain", "token").agg(F.sum("df").alias("df"))

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """(domain, n, avgdl) and (domain, token, df, idf), kept until a change."""
        if self._stats is None:
            with scratch.batch_rows(self.spark, 1):
                corpus, df = self.counts()
                corpus = scratch.stored(corpus, "corpus")
                self._stats = corpus, scratch.stored(idf_of(corpus, df), "stats")
        return self._stats

    def tables(self) -> list[DataFrame]:
        return [x for s in self.segments for x in s if x is not None] + list(self._stats or ())

    def search(self, queries: DataFrame, k: int | None, wanted: DataFrame | None = None) -> DataFrame:
        """(query_id, domain, chunk_id, score) of the k best chunks with a positive
        score in each shard, of which the k best of a domain are some. Questions go
        out in blocks of ``WEIGHTS`` weights."""
        corpus, idf = self.stats()
        asked = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qf"))
        if wanted is not None:
            asked = asked.join(wanted, "query_id")
        worth = idf.join(small(asked), ["token"] if wanted is None else ["domain", "token"]).join(small(corpus), "domain")
        worth = scratch.stored(worth.select("domain", "token", "query_id", (F.col("qf") * F.col("idf")).alias("weight"), "avgdl"), "asked")
        blocks = max(1, -(-worth.count() // WEIGHTS))
        found = None
        for i in range(blocks):
            rows = worth if blocks == 1 else worth.where(F.pmod(F.xxhash64("query_id", "domain"), F.lit(blocks)) == i)
            rows = rows.toArrow()  # about WEIGHTS rows
            ids = pc.unique(rows.column("query_id"))
            rows = rows.append_column("number", pc.index_in(rows.column("query_id"), value_set=ids).cast(pa.int64())).drop_columns(["query_id"])
            by = _asked(rows)
            held = self.spark.sparkContext.broadcast({d: a._replace(queries=a.queries.tolist()) for d, a in by.items()})
            # Numbers in place of ids, whatever their type.
            here = self.rows()
            if 0 < len(by) <= 100:
                here = here.where(F.col("domain").isin(*by))
            here = here.mapInArrow(_numbered(held, k), "number long, domain string, chunk_id string, score double")
            with scratch.batch_rows(self.spark, 1):  # a shard is one row
                here = scratch.stored(here, "found")
            names = self.spark.createDataFrame(pa.table({"number": pa.array(range(len(ids)), pa.int64()), "query_id": ids}))
            here = here.join(F.broadcast(names), "number").select(F.col("query_id").cast(queries.schema["query_id"].dataType).alias("query_id"), "domain", "chunk_id", "score")
            found = here if found is None else found.unionByName(here)
        return found


def _numbered(held, k):
    """Shard results under their questions' numbers."""

    def run(batches):
        for batch in _tops(held, k)(batches):
            asked = held.value[batch.column("domain")[0].as_py()]
            number = np.asarray(asked.queries, np.int64)[batch.column("query_id").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(number), *batch.columns[1:]], ["number", "domain", "chunk_id", "score"])

    return run


def _alive(shard: Shard) -> np.ndarray:
    alive = np.ones(len(shard.ids), bool)
    if shard.dead is not None:
        alive[shard.dead] = False
    return alive


def _left_sums(batches):
    for shard in shards(batches):
        alive = _alive(shard)
        yield pa.RecordBatch.from_pydict({"domain": [shard.domain], "n": [int(alive.sum())], "total": [int(shard.dls[alive].sum())]})


def _left_counts(batches):
    for shard in shards(batches):
        token = np.repeat(np.arange(len(shard.dfs)), shard.dfs)
        df = np.bincount(token[_alive(shard)[shard.docs]], minlength=len(shard.dfs))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([shard.domain] * len(some), pa.string()), shard.tokens.take(pa.array(some)), pa.array(df[some], pa.int64())], ["domain", "token", "df"])


def _unpacked(batches):
    """The chunks of shards with their terms."""
    for shard in shards(batches):
        alive = _alive(shard)
        token = np.repeat(np.arange(len(shard.dfs)), shard.dfs)
        keep = alive[shard.docs]
        docs, token, fs = shard.docs[keep], token[keep], shard.fs[keep]
        order = np.argsort(docs, kind="stable")
        ids = np.flatnonzero(alive)
        ptr = np.searchsorted(docs[order], np.append(ids, len(alive)))
        flat = pa.StructArray.from_arrays([shard.tokens.take(pa.array(token[order])), pa.array(fs[order], pa.int32())], fields=list(_TERM.value_type))
        listed = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array([shard.domain] * len(ids), pa.string()), shard.ids.take(pa.array(ids)), pa.array(shard.dls[ids], pa.int32()), listed], ["domain", "chunk_id", "dl", "terms"])
