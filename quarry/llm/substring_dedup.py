"""Substring dedup on a De Bruijn graph of word k-mers.

Nodes are runs of k - 1 words, edges runs of k words. An edge that starts in
several documents is repeated; its source is the smallest doc_id it starts in.
The steps:

1. Documents are dealt by doc_id into blocks of bounded bytes; the rows of one
   doc_id that fills blocks by itself, and those without a doc_id, are dealt over
   several by their texts. Each block sends
   its distinct edges (hashes, each with its smallest document in the block) to
   partitions of the edge space: at most one entry a block for any edge, so an
   edge that a third of all documents hold costs no task more than the number
   of blocks.
2. A partition finds each edge's smallest document and answers every block in
   the order of its entries.
3. Joined with the answers, each block compacts consecutive repeated edges with
   one source into paths: stretches along which a document and its source do
   not branch apart. A path covers the words of all its edges.
4. Paths are joined with their sources' blocks, where the source's own words at
   the path's coordinates must have the path's digest. A path that its source
   holds in several places is compared edge by edge. Edges that fail there (hash
   collisions: another edge's source hides the true one) are asked again by their
   exact words over all documents. Those that no smaller document holds are taken
   out and their documents done again, so that the result is exact.

Defined results: a null or empty text has no words and an empty remainder; a
row with null doc_id neither removes nor loses words; rows with equal doc_id
never remove each other's words, only those of larger ids do; other columns
are ignored. Very long texts are read whole. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import hash_words, window_hashes, words_of

BLOCK_BYTES = 8 << 20
#: Ids of 8 bytes that may be broadcast.
BROADCAST_IDS = 1_000_000
ALL_BITS = (1 << 64) - 1
_NONE = np.iinfo(np.int64).min
_EDGES = "block long, part long, hashes binary, docs binary, counts binary"
_ANSWERS = "block long, part long, sources binary"
_SPELT = "doc_id long, source long, digest binary, o int, words binary"
_PATHS = "doc_id long, n_words long, n_removed long, kept_sha256 string, paths array<struct<start:int,n:int,source:long,edge:long,digest:binary>>"


class _Block:
    """A block's documents in (doc_id, text) order and their edges."""

    def __init__(self, table: pa.Table, k: int, mask: int):
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"].to_pylist()
        self.texts = table["text"]
        w = words_of(self.texts)
        self.off = w.off
        self.edges, self.first = window_hashes(hash_words(w), w.off, k)
        self.edges &= np.uint64(mask)
        doc_of = np.searchsorted(w.off, self.first, side="right") - 1
        ids = np.array([_NONE if i is None else i for i in self.ids], np.int64)
        self.owner = ids[doc_of] if len(ids) else np.zeros(0, np.int64)
        known = self.owner != _NONE
        self.edges, self.first, self.owner = self.edges[known], self.first[known], self.owner[known]
        self.uniq, at, self.inverse = np.unique(self.edges, return_index=True, return_inverse=True)
        self.entries = np.argsort(at, kind="stable")  # of uniq, by first place
        self.own = self.owner[at]

    def by_part(self, parts: int):
        """(partition, entries) pairs, entries in the order of their places."""
        part = (self.uniq[self.entries] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(at, np.append(at[1:], len(order))):
            yield int(part[order[a]]), self.entries[order[a:b]]

    def words(self, i: int) -> list[bytes]:
        return (self.texts[i].as_py() or "").encode().split()


def _send(k: int, parts: int, mask: int):
    def send(key, table):
        pack = zstandard.ZstdCompressor(1).compress
        b = _Block(table, k, mask)
        rows = []
        for part, entries in b.by_part(parts):
            docs = b.own[entries]
            at = np.flatnonzero(np.diff(docs, prepend=_NONE))
            # The partition's number stands for the part of the hash that is left out.
            seven = (b.uniq[entries] // np.uint64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
            rows.append((key[0].as_py(), part, seven.tobytes(), pack(docs[at].tobytes()), pack(np.diff(np.append(at, len(docs))).astype(np.int32).tobytes())))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "part", "hashes", "docs", "counts"])

    return send


def _answer(key, table):
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(1).compress
    blocks, hashes, docs, sizes = [], [], [], []
    for row in table.select(["block", "hashes", "docs", "counts"]).to_batches():
        for block, h, d, c in zip(*(x.to_pylist() for x in row.columns)):
            blocks.append(block)
            wide = np.zeros((len(h) // 7, 8), np.uint8)
            wide[:, :7] = np.frombuffer(h, np.uint8).reshape(-1, 7)
            hashes.append(wide.view("<u8").ravel())
            docs.append(np.repeat(np.frombuffer(unpack(d), np.int64), np.frombuffer(unpack(c), np.int32)))
            sizes.append(len(wide))
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] + np.uint64(1)))
    least = np.minimum.reduceat(d[order], at)
    source = np.empty_like(d)
    source[order] = np.repeat(least, np.diff(np.append(at, len(h))))
    source[source >= d] = _NONE
    ends = np.cumsum(sizes)
    return pa.table({"block": pa.array(blocks, pa.int64()), "part": pa.array([key[0].as_py()] * len(blocks), pa.int64()), "sources": pa.array([pack(source[e - n : e].tobytes()) for e, n in zip(ends, sizes)], pa.binary())})


def _sources(b: _Block, answers: pa.Table, parts: int) -> np.ndarray:
    """The source of each of the block's edges (places), _NONE if not repeated."""
    unpack = zstandard.ZstdDecompressor().decompress
    given = dict(zip(answers["part"].to_pylist(), answers["sources"].to_pylist()))
    least = b.own.copy()
    for part, entries in b.by_part(parts):
        got = np.frombuffer(unpack(given[part]), np.int64)
        least[entries] = np.where(got == _NONE, least[entries], got)
    source = least[b.inverse]
    return np.where(source < b.owner, source, _NONE)


def _compact(k: int, parts: int, mask: int):
    def compact(key, docs, answers):
        b = _Block(docs, k, mask)
        source = _sources(b, answers, parts)
        out = []
        bounds = np.searchsorted(b.first, b.off)
        for i, doc_id in enumerate(b.ids):
            words = b.words(i)
            lo, hi = bounds[i], bounds[i + 1]
            src, first = source[lo:hi], b.first[lo:hi] - b.off[i]
            paths, gone = [], np.zeros(len(words) + 1, np.int64)
            cut = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else np.zeros(0, np.int64)
            for a, e in zip(cut, np.append(cut[1:], len(src))):
                if src[a] != _NONE:
                    s, n = int(first[a]), int(e - a)
                    gone[s] += 1
                    gone[s + n + k - 1] -= 1
                    paths.append({"start": s, "n": n, "source": int(src[a]), "edge": int(b.edges[lo + a].astype(np.int64)), "digest": hashlib.blake2b(b" ".join(words[s : s + n + k - 1]), digest_size=16).digest()})
            out.append(_result(doc_id, words, gone) | {"paths": paths})
        return pa.Table.from_pylist(out, _schema())

    return compact


def _result(doc_id, words: list[bytes], gone: np.ndarray) -> dict:
    keep = np.cumsum(gone)[: len(words)] == 0
    n = int(len(words) - keep.sum())
    kept = b" ".join(compress(words, keep) if n else words)
    return {"doc_id": doc_id, "n_words": len(words), "n_removed": n, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def _schema() -> pa.Schema:
    path = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("edge", pa.int64()), ("digest", pa.binary())])
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("paths", pa.list_(path))])


def _verify(k: int, mask: int):
    def verify(key, docs, asked):
        """Of the paths asked for, those that their source does not hold in one place."""
        rows = asked.select(["doc_id", "start", "n", "source", "edge", "digest"]).to_pylist()
        wanted = {r["source"] for r in rows}
        ids = docs["doc_id"].to_pylist()
        docs = docs.filter(pa.array([i in wanted for i in ids], pa.bool_()))
        b = _Block(docs, k, mask)
        places: dict = {}
        need = np.unique(np.array([r["edge"] for r in rows], np.int64).astype(np.uint64))
        for p in np.flatnonzero(np.isin(b.edges, need)) if len(need) else []:
            places.setdefault((int(b.owner[p]), int(b.edges[p].astype(np.int64))), []).append(int(b.first[p]))
        texts: dict = {}
        out = []
        for r in rows:
            for p in places.get((r["source"], r["edge"]), ()):
                i = int(np.searchsorted(b.off, p, side="right") - 1)
                if i not in texts:
                    texts.clear()
                    texts[i] = b.words(i)
                s = p - int(b.off[i])
                if hashlib.blake2b(b" ".join(texts[i][s : s + r["n"] + k - 1]), digest_size=16).digest() == r["digest"]:
                    break
            else:
                out.append(r)
        return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("digest", pa.binary())]))

    return verify


def _verify_edges(k: int):
    def verify(key, docs, asked):
        """Of single edges, given with their words, those that their source lacks."""
        rows = asked.select(["doc_id", "source", "digest", "o", "words"]).to_pylist()
        held: dict = {}
        for r in rows:
            held.setdefault(r["source"], set()).add(r["words"])
        found = set()
        for i, text in zip(docs["doc_id"].to_pylist(), docs["text"]):
            if i in held:
                words = (text.as_py() or "").encode().split()
                found.update((i, x) for j in range(len(words) - k + 1) if (x := b" ".join(words[j : j + k])) in held[i])
        return pa.Table.from_pylist([r for r in rows if (r["source"], r["words"]) not in found], pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("digest", pa.binary()), ("o", pa.int32()), ("words", pa.binary())]))

    return verify


def _spell(k: int):
    def spell(key, docs, asked):
        """The words of each edge of the paths asked for, from the document itself."""
        by: dict = {}
        for r in asked.select(["doc_id", "start", "n", "source", "digest"]).to_pylist():
            by.setdefault(r["doc_id"], []).append(r)
        out = []
        for i, text in zip(docs["doc_id"].to_pylist(), docs["text"]):
            if i in by:
                words = (text.as_py() or "").encode().split()
                for r in by[i]:
                    if hashlib.blake2b(b" ".join(words[r["start"] : r["start"] + r["n"] + k - 1]), digest_size=16).digest() == r["digest"]:
                        out += [{"doc_id": i, "source": r["source"], "digest": r["digest"], "o": o, "words": b" ".join(words[r["start"] + o : r["start"] + o + k])} for o in range(r["n"])]
        return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("digest", pa.binary()), ("o", pa.int32()), ("words", pa.binary())]))

    return spell


def _only(keyed: DataFrame, blocks: int, ids: DataFrame) -> DataFrame:
    """Blocks of the documents with these ids: few ids are broadcast, so that other
    texts are not dealt again; beyond ``BROADCAST_IDS`` all of them are."""
    ids = ids.toDF("doc_id").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return keyed.repartition(blocks, "block")
    return keyed.join(F.broadcast(ids), "doc_id", "left_semi").select("block", "doc_id", "text").repartition(blocks, "block")


class _Deal:
    """Which block holds a row: by doc_id, and by text for the rows of ``heavy`` ids
    (doc_id, deals), each of which fills several blocks."""

    def __init__(self, docs: DataFrame, block_bytes: int):
        size = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"))
        most = F.max(F.when(F.col("doc_id").isNotNull(), F.col("n")))
        r = size.agg(F.sum("n").alias("n"), most.alias("most")).first()
        self.blocks = runtime.block_count(r.n or 0, block_bytes)
        self.heavy = None
        if (r.most or 0) > 2 * block_bytes:  # fewer ids than half the blocks
            some = size.where(F.col("doc_id").isNotNull() & (F.col("n") > 2 * block_bytes))
            self.heavy = runtime.stored(some.select("doc_id", F.ceil(F.col("n") / block_bytes).cast("long").alias("deals")), "heavy")
            if self.heavy.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
                self.heavy = F.broadcast(self.heavy)

    def _block(self, column: str, salt):
        return F.pmod(F.xxhash64(F.col(column), salt), F.lit(self.blocks))

    def rows(self, docs: DataFrame) -> DataFrame:
        """(block, doc_id, text)"""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        deals = F.lit(1)
        if self.heavy is not None:
            docs, deals = docs.join(self.heavy, "doc_id", "left"), F.coalesce("deals", F.lit(1))
        salt = F.pmod(F.xxhash64("text"), F.when(F.col("doc_id").isNull(), F.lit(self.blocks)).otherwise(deals))
        return docs.select(self._block("doc_id", salt).alias("block"), "doc_id", "text")

    def ask(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with the block that holds the document named in ``column``: one
        row for each block of a heavy one."""
        salt = F.lit(0).cast("long")
        if self.heavy is not None:
            held = self.heavy.select(F.col("doc_id").alias("_id"), F.col("deals").alias("_deals"))
            rows = rows.join(held, F.col(column) == F.col("_id"), "left")
            rows = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_deals", F.lit(1)) - 1)))
            salt = F.col("_salt")
        return rows.withColumn("block", self._block(column, salt)).drop("_id", "_deals", "_salt").repartition(self.blocks, "block")

    def none(self, failed: DataFrame, column: str) -> DataFrame:
        """Of rows that failed in a block those that failed in all they were asked in."""
        if self.heavy is None:
            return failed
        held = self.heavy.select(F.col("doc_id").alias(column), F.col("deals").alias("_deals"))
        times = failed.groupBy(*failed.columns).agg(F.count(F.lit(1)).alias("_n")).join(held, column, "left")
        return times.where(F.col("_n") >= F.coalesce("_deals", F.lit(1))).select(*failed.columns)


def repeated_paths(docs: DataFrame, k: int = 13, block_bytes: int = BLOCK_BYTES, mask: int = ALL_BITS) -> tuple[DataFrame, DataFrame, _Deal]:
    """One row a document (doc_id, n_words, n_removed, kept_sha256, paths), stored;
    the documents with their blocks; the deal. Not verified yet."""
    spark = docs.sparkSession
    deal = _Deal(docs, block_bytes)
    parts = max(deal.blocks // 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = deal.rows(docs)
    dealt = keyed.repartition(deal.blocks, "block")
    edges = dealt.groupBy("block").applyInArrow(_send(k, parts, mask), _EDGES)
    answers = edges.repartition(parts, "part").groupBy("part").applyInArrow(_answer, _ANSWERS)
    found = dealt.groupBy("block").cogroup(answers.repartition(deal.blocks, "block").groupBy("block")).applyInArrow(_compact(k, parts, mask), _PATHS)
    return runtime.stored(found, "paths"), keyed, deal


def dedup_substrings(docs: DataFrame, k: int = 13, block_bytes: int = BLOCK_BYTES, mask: int = ALL_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and paths (start, n edges, source)
    of every document, after the paths' verification. ``mask`` keeps some bits of
    the edges' hashes only, for tests of collisions."""
    found, keyed, deal = repeated_paths(docs, k, block_bytes, mask)
    path = found.select("doc_id", F.explode("paths").alias("p")).select("doc_id", "p.*")

    def at(df: DataFrame, column: str):
        return deal.ask(df, column).groupBy("block")

    asked = path.groupBy("source", "edge", "digest", "n").agg(F.min(F.struct("doc_id", "start")).alias("d")).select("source", "edge", "digest", "n", "d.*")
    failed = _only(keyed, deal.blocks, path.select("source")).groupBy("block").cogroup(at(asked, "source")).applyInArrow(_verify(k, mask), "doc_id long, start int, n int, source long, digest binary")
    again = runtime.stored(deal.none(failed, "source"), "open")
    result = found
    if not again.isEmpty():
        side = _only(keyed, deal.blocks, again.select("doc_id").union(again.select("source"))).groupBy("block")
        spelt = side.cogroup(at(again, "doc_id")).applyInArrow(_spell(k), _SPELT).dropDuplicates(["doc_id", "source", "digest", "o"])
        lacking = side.cogroup(at(spelt, "source")).applyInArrow(_verify_edges(k), _SPELT)
        hidden = runtime.stored(deal.none(lacking, "source"), "hidden")
        if not hidden.isEmpty():
            wrong = runtime.stored(_not_repeated(docs, hidden, k), "wrong")
            if not wrong.isEmpty():
                result = _without(found, keyed, deal, wrong, k)
    return result


def _not_repeated(docs: DataFrame, hidden: DataFrame, k: int) -> DataFrame:
    """Of edges whose source lacks them (doc_id, source, digest, o, words: the edge at
    place ``o`` of a path) those that start in no smaller document. Documents are searched for the edges' words, at most
    ``BROADCAST_IDS`` of them at a time, by their exact bytes."""
    words = runtime.stored(hidden.select("words").distinct(), "words")
    turns = runtime.block_count(words.count(), BROADCAST_IDS)
    least = None
    for i in range(turns):
        part = words.where(F.pmod(F.xxhash64("words"), F.lit(turns)) == i)
        held = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.words) for r in part.collect()))

        def search(batches, held=held):
            # An edge's last word ends most searches at one look.
            last = {w.rsplit(b" ", 1)[-1] for w in held.value}
            for b in batches:
                best: dict = {}
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    own = (text.as_py() or "").encode().split() if doc_id is not None else []
                    for j in range(k - 1, len(own)):
                        if own[j] in last and (x := b" ".join(own[j - k + 1 : j + 1])) in held.value:
                            best[x] = min(best.get(x, doc_id), doc_id)
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.binary()), pa.array(list(best.values()), pa.int64())], ["words", "least"])

        here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "words binary, least long")
        least = here if least is None else least.unionByName(here)
    return hidden.join(least.groupBy("words").agg(F.min("least").alias("least")), "words").where("least >= doc_id").select("doc_id", "source", "digest", "o")


def _without(found, keyed, deal, wrong, k) -> DataFrame:
    """The documents with false edges done again without these. Only the smallest
    document with such an edge has it wrong: larger ones repeat that document's."""
    bad = wrong.groupBy("doc_id").agg(F.collect_set(F.struct("source", "digest", "o")).alias("w"))
    todo = found.join(bad, "doc_id").select("doc_id", "n_words", "paths", "w")

    def redo(key, docs, asked):
        by: dict = {}
        for r in asked.select(["doc_id", "n_words", "paths", "w"]).to_pylist():
            by.setdefault(r["doc_id"], []).append(r)

        def holds(words, p):
            return hashlib.blake2b(b" ".join(words[p["start"] : p["start"] + p["n"] + k - 1]), digest_size=16).digest() == p["digest"]

        out = []
        for i, text in zip(docs["doc_id"].to_pylist(), docs["text"]):
            if i in by:
                words = (text.as_py() or "").encode().split()
                # Rows of one doc_id are told apart by their words.
                r = next(r for r in by[i] if r["n_words"] == len(words) and all(holds(words, p) for p in r["paths"]))
                false = {(w["source"], w["digest"], w["o"]) for w in r["w"]}
                gone = np.zeros(len(words) + 1, np.int64)
                for p in r["paths"]:
                    for o in range(p["n"]):
                        if (p["source"], p["digest"], o) not in false:
                            gone[p["start"] + o] += 1
                            gone[p["start"] + o + k] -= 1
                out.append(_result(i, words, gone) | {"paths": r["paths"]})
        return pa.Table.from_pylist(out, _schema())

    redone = keyed.repartition(deal.blocks, "block").groupBy("block").cogroup(deal.ask(todo, "doc_id").groupBy("block")).applyInArrow(redo, _PATHS)
    return found.join(bad, "doc_id", "left_anti").unionByName(redone)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(runtime.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("paths").cast("long").alias("n_paths"))
