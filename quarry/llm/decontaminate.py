"""Benchmark decontamination under word edit distance.

A benchmark item of n words is found in a document if some run of the
document's words has an edit distance to it of at most n / 5.

1. Places worth a look: an item and a run within that distance share at least
   n + 1 - q - q * (n / 5) q-grams (q = 3; 2 for items under 10 words) on
   nearby diagonals. Regions of a document with fewer cannot match; this loses
   nothing. Of q-grams that many items share, as of a common opening, a run may
   share all; so they need not be looked up where an item has enough others, and the
   fewer that it must share of these are asked for. Hits are looked at in pieces.
2. Where a document has several regions for an item, their item-sized windows go
   through the CGK embedding: a random walk, the same for all texts, copies each
   word once or several times, so that edit distance becomes Hamming distance.
   ``WALKS`` walks, each with ``TABLES`` samples of ``SAMPLED`` positions: regions
   with more samples that agree with the item's come first. The embedding only
   orders the regions; it rejects none.
3. Regions are searched by the exact distance (bit-parallel, the run's ends free).
   Once a run at distance d is known, regions with fewer shared q-grams than a run
   at distance d needs are left out: none of them is as close.

Words are lower-cased runs of letters and digits. The benchmark's different items
are read in blocks of about ``ITEMS`` items and ``ITEM_BYTES`` of text, each
broadcast; the documents pass each block.

Defined results: items without words match nothing; null and empty texts hold
nothing; of several runs the closest, then first, is reported; a repeated item
or document row is reported once for each; a null doc_id or item_id is kept; very
long texts are searched whole; other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import NON_ALNUM, hash_words, window_hashes, words_of

DISTANCE = 0.2
WALKS, TABLES, SAMPLED = 4, 24, 3
ITEMS, ITEM_BYTES = 20_000, 32 << 20
#: Places among the items from which a q-gram is hot, and hits that are looked at at once.
HOT, PIECE = 64, 1 << 20
_SLOTS = 1 << 20


class Seeds:
    """Items' q-grams to look up in texts."""

    def __init__(self, q: int, g: np.ndarray, item: np.ndarray, offset: np.ndarray, least: np.ndarray, more: np.ndarray):
        order = np.lexsort((item, g))
        self.q, self.item, self.offset, self.least, self.more = q, item[order], offset[order], least, more
        self.grams, self.start = np.unique(g[order], return_index=True)
        self.start = np.append(self.start, len(g))
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[(g & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        self.stride = int(item.max()) + 1
        self.by_item = np.repeat(np.arange(len(self.grams)), np.diff(self.start)) * self.stride + self.item

    def hits(self, h: np.ndarray, off: np.ndarray):
        """(text, item, diagonal) of all places, in pieces of about ``PIECE``; a text and
        an item are in one piece."""
        x, pos = window_hashes(h, off, self.q)
        some = np.flatnonzero(self.slots[(x & np.uint64(_SLOTS - 1)).astype(np.int64)])
        x, pos = x[some], pos[some]
        gram = np.minimum(np.searchsorted(self.grams, x), len(self.grams) - 1)
        known = self.grams[gram] == x
        gram, pos = gram[known], pos[known]
        if not len(pos):
            return
        doc = np.searchsorted(off, pos, side="right") - 1
        count = np.cumsum(self.start[gram + 1] - self.start[gram])
        at = 0
        while at < len(pos):
            before = count[at - 1] if at else 0
            stop = int(np.searchsorted(count, before + PIECE, "right"))
            # Whole texts, one at least.
            stop = max(int(np.searchsorted(doc, doc[min(stop, len(doc) - 1)], "left")) if stop < len(doc) else stop, int(np.searchsorted(doc, doc[at], "right")))
            part = slice(at, stop)
            slices = max(1, -(-int(count[stop - 1] - before) // PIECE))
            cuts = np.unique(np.quantile(self.item, np.linspace(0, 1, slices + 1)[1:-1], method="nearest")) if slices > 1 else []
            for least, most in zip([0, *cuts], [*cuts, self.stride]):
                a = np.searchsorted(self.by_item, gram[part] * self.stride + least)
                n = np.searchsorted(self.by_item, gram[part] * self.stride + most) - a
                if n.sum():
                    which = np.repeat(np.arange(len(n)), n)
                    seed = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[which]
                    yield doc[part][which], self.item[seed], pos[part][which] - self.offset[seed]
            at = stop


class Index:
    """A block of benchmark items."""

    def __init__(self, ids: list, texts: list):
        w = words_of(pa.array(texts, pa.string()), NON_ALNUM, lower=True)
        h = hash_words(w)
        self.ids = ids
        self.items = [h[w.off[i] : w.off[i + 1]] for i in range(len(ids))]
        self.edits = np.array([int(DISTANCE * len(x)) for x in self.items], int)
        self.q = np.array([3 if len(x) >= 10 else min(2, max(len(x), 1)) for x in self.items], int)
        n = np.array([len(x) for x in self.items], int)
        self.least = np.maximum(1, n + 1 - self.q - self.q * self.edits) if len(ids) else n
        # Seeds by q: (q-grams in order, their item and offset, slots, tie of grams to
        # numbers, least shared q-grams, those that may be shared besides). A q-gram in
        # more than HOT places of the items is left out where an item has so many others
        # that a run must share some; only items mostly of hot ones keep them.
        self.seeds = []
        for q in (1, 2, 3):
            rows = [(g, i, o) for i, x in enumerate(self.items) if self.q[i] == q and len(x) for o, g in enumerate(window_hashes(x, np.array([0, len(x)]), q)[0])]
            if rows:
                g, i, o = (np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
                _, number, places = np.unique(g, return_inverse=True, return_counts=True)
                hot = places[number] > HOT
                n_hot = np.bincount(i[hot], minlength=len(ids))
                cold = self.least - n_hot >= 1
                for keep, least, more in ((cold[i] & ~hot, self.least - n_hot, n_hot), (~cold[i], self.least, np.zeros_like(n_hot))):
                    if keep.any():
                        self.seeds.append(Seeds(q, g[keep], i[keep], o[keep], least, more))
        self.rng = np.random.default_rng(11)
        self.walk_salt = self.rng.integers(1, 2**63, (WALKS, 64), dtype=np.uint64) | np.uint64(1)
        self.picks: dict[int, np.ndarray] = {}
        self.codes: dict[int, np.ndarray] = {}

    def samples(self, n: int) -> np.ndarray:
        if n not in self.picks:
            self.picks[n] = np.random.default_rng(n).integers(0, max(2 * n, 1), (WALKS, TABLES, SAMPLED))  # later ones are mostly past the end
        return self.picks[n]

    def embed(self, windows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Sampled positions of the CGK embeddings of windows of ``sizes`` words
        (shorter ones are padded): windows x WALKS x TABLES x SAMPLED. All walks of
        all windows take each step together."""
        m, longest = len(windows), int(sizes.max(initial=1))
        padded = np.zeros((m, longest + 1), np.uint64)
        for row, w in zip(padded, windows):
            row[: len(w)] = w
        rows, n = np.arange(m)[:, None], sizes[:, None]
        at = np.zeros((m, WALKS), np.int64)
        steps = np.empty((2 * longest, m, WALKS), np.uint64)
        for t in range(2 * longest):
            x = padded[rows, at]
            steps[t] = x
            move = ((x ^ self.walk_salt[:, t % 64]) * self.walk_salt[:, (t // 64 + 7 * t) % 64]) >> np.uint64(63)
            at = np.minimum(at + move.astype(np.int64), n)
        picks = np.stack([self.samples(int(k)) for k in sizes]) if m else np.zeros((0, WALKS, TABLES, SAMPLED), int)
        return steps[picks, rows[:, :, None, None], np.arange(WALKS)[None, :, None, None]]

    def item_code(self, i: int) -> np.ndarray:
        if i not in self.codes:
            self.codes[i] = self.embed([self.items[i]], np.array([len(self.items[i])]))[0]
        return self.codes[i]

    def places(self, h: np.ndarray, off: np.ndarray):
        """(text, item, least diagonal, greatest, a middle one, shared q-grams at most)
        of each region with enough shared q-grams close together."""
        for seeds in self.seeds:
            for doc, it, diag in seeds.hits(h, off):
                yield from self._regions(doc, it, diag, seeds)

    def _regions(self, doc: np.ndarray, it: np.ndarray, diag: np.ndarray, seeds: Seeds):
        """The regions among the hits of some texts and items."""
        order = np.lexsort((diag, it, doc))
        it, diag, doc = it[order], diag[order], doc[order]
        last = np.arange(len(it)) + seeds.least[it] - 1
        fits = last < len(it)
        last = np.minimum(last, len(it) - 1)
        fits &= (it[last] == it) & (doc[last] == doc) & (diag[last] - diag <= 2 * self.edits[it])
        s = np.flatnonzero(fits)
        if not len(s):
            return
        # Overlapping stretches of diagonals are one region.
        group = np.cumsum(np.concatenate([[0], (it[1:] != it[:-1]) | (doc[1:] != doc[:-1])]))
        wide = 2 * self.edits[it[s]]
        new = np.concatenate([[True], (group[s[1:]] != group[s[:-1]]) | (diag[s[1:]] > diag[s[:-1]] + wide[:-1])])
        first, final = s[new], np.concatenate([np.flatnonzero(new)[1:], [len(s)]]) - 1
        key = group * (int(diag.max() - diag.min()) + 2 * int(self.edits.max()) + 2) + diag
        stop = np.searchsorted(key, key[s[final]] + wide[final], "right")
        shared = stop - first + seeds.more[it[first]]
        yield from zip(*(c.tolist() for c in (doc[first], it[first], diag[first], diag[stop - 1], diag[(first + stop) // 2], shared)))

    def find(self, col) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance) of the closest runs."""
        w = words_of(col, NON_ALNUM, lower=True)
        h = hash_words(w)
        asked: dict[tuple[int, int], list] = {}
        for doc, i, *region in self.places(h, w.off):
            asked.setdefault((doc, i), []).append(region)
        several = [(doc, i, r) for (doc, i), regions in asked.items() if len(regions) > 1 for r in regions]
        for k in range(0, len(several), 4096):
            part = several[k : k + 4096]
            windows = [h[max(mid, int(w.off[doc])) : min(mid + len(self.items[i]), int(w.off[doc + 1]))] for doc, i, (_, _, mid, _) in part]
            codes = self.embed(windows, np.array([len(self.items[i]) for _, i, _ in part]))
            same = (codes == np.stack([self.item_code(i) for _, i, _ in part])).all(-1).sum((1, 2))
            for (_, _, r), n in zip(part, same.tolist()):
                r.append(n)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (doc, i), regions in asked.items():
            if len(regions) > 1:
                regions.sort(key=lambda r: (-r[4], -r[3], r[0]))
            for lo, hi, _, shared, *_ in regions:
                q, known = int(self.q[i]), best.get((doc, i))
                if known is None or shared >= len(self.items[i]) + 1 - q - q * known[0]:
                    self._confirm(best, h, w.off, doc, i, lo, hi)
        return [(doc, i, first, size, dist) for (doc, i), (dist, first, size) in sorted(best.items())]

    def _confirm(self, best: dict, h: np.ndarray, off: np.ndarray, doc: int, i: int, lo: int, hi: int) -> None:
        """Search the words that a run on the diagonals ``lo`` to ``hi`` can hold."""
        x, e, start = self.items[i], int(self.edits[i]), int(off[doc])
        a = max(lo - e, start)
        region = h[a : min(hi + len(x) + e, int(off[doc + 1]))]
        dist, end = search(x, region)
        if dist <= e:
            _, size = search(x[::-1], region[:end][::-1], whole=True)
            value = (dist, a + end - size - start, size)
            best[doc, i] = min(best.get((doc, i), value), value)


def search(item: np.ndarray, text: np.ndarray, whole: bool = False) -> tuple[int, int]:
    """The least edit distance of ``item`` to a run of ``text`` and the run's end
    (the first such); with ``whole`` the run starts at the text's start. Bit-parallel:
    the columns of the distance table are kept as differences in two integers."""
    m = len(item)
    where: dict[int, int] = {}
    for k, c in enumerate(item.tolist()):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1) if m else 0
    up, down, dist = full, 0, m
    best = (dist, 0)
    for j, c in enumerate(text.tolist()):
        eq = where.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp, hn = (down | ~(d0 | up)) & full, up & d0
        dist += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | whole) & full
        hn = hn << 1 & full
        up, down = (hn | ~(d0 | hp)) & full, hp & d0
        if dist < best[0]:
            best = (dist, j + 1)
    return best


def _blocks(benchmark: DataFrame):
    """Broadcast indexes of the different items, and how often each item stands in
    the benchmark."""
    items = benchmark.groupBy(F.col("item_id").cast("long").alias("item_id"), "text").agg(F.count(F.lit(1)).alias("copies"))
    items = runtime.stored(items, "items")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // ITEMS), -(-(size.bytes or 0) // ITEM_BYTES))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.collect()  # about a block
        yield benchmark.sparkSession.sparkContext.broadcast((Index([r.item_id for r in rows], [r.text for r in rows]), [r.copies for r in rows]))


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): one row for each item that
    a document holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for held in _blocks(benchmark):
        here = docs.mapInArrow(_finder(held), "doc_id long, item_id long, first_word long, n_words long, distance long")
        found = here if found is None else found.unionByName(here)
    return found


def _finder(held):
    def run(batches):
        index, copies = held.value
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                got = [g for g in index.find(part.column("text")) for _ in range(copies[g[1]])]
                ids = part.column("doc_id").to_pylist()
                cols = [[ids[g[0]] for g in got], [index.ids[g[1]] for g in got], *[[g[k] for g in got] for k in (2, 3, 4)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "first_word", "n_words", "distance"])

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item; decided where the row is read."""
    for held in _blocks(benchmark):

        def run(batches, held=held):
            index, _ = held.value
            for b in batches:
                for a in range(0, b.num_rows, 1024):
                    part = b.slice(a, 1024)
                    hit = {g[0] for g in index.find(part.column("text"))}
                    yield part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_items(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "benchmark"))
