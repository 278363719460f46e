"""Toxicity scores: gradient-boosted trees over dense features of a text.

Features: densities of a lexicon (fixed insults, and words that the training
rows show to be toxic), hits near a second-person word, capitals, punctuation
and obfuscated words. The trees (histogram splits, logistic loss) are fitted on
the driver to the features of a bounded sample of labelled rows: ``TRAIN_ROWS`` by
hash of doc_id, of which each class has at least ``CLASS_ROWS`` if there are as
many, with at most four times as many different texts where ids repeat.

Nothing is judged by a lexicon that has seen its own label: the sample is cut into
``FOLDS`` by hash, and a text's features for training come from the lexicon of the
other folds. Isotonic regression on out-of-fold scores of the trees calibrates
them; there each class weighs as much as among all labelled rows.

The lexicon's keys stand in a hundredth of the toxic texts or more, so there are
at most a hundred times as many as a toxic text has words and stems on average.

Defined results: null and empty texts have zero features and are scored like
any other; very long texts are read whole; a null doc_id counts as ''; without any
labelled row the score is 0.5 x the lexicon's verdict; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime
from .words import LOWER, NON_ALNUM, buffer_of, hash_one, hash_words, words_of

TRAIN_ROWS, CLASS_ROWS, FOLDS = 5000, 1000, 4
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting dumb fool jerk imbecile garbage filth filthy vermin bastard creep freak ugly".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vuestro".split()
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _LEET[_a] = _b
_INNER = NON_ALNUM.copy()
_INNER[list(b"@$!*.-_")] = False
_OUTER = np.zeros(256, bool)
_OUTER[list(b"@$!*.-_")] = True
NEAR = 5


#: Bytes of the word beginnings that may enter the lexicon: inflected languages repeat stems.
STEMS = (4, 5, 6, 7, 8)


def _starts(w) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes of each word, as a number, and its length."""
    size = w.end - w.start
    raw = np.append(w.buf, np.zeros(8, np.uint8))
    out = np.zeros(len(size), np.uint64)
    for k in range(8):
        out |= np.where(size > k, raw[w.start + k], 0).astype(np.uint64) << np.uint64(8 * k)
    return out, size


def _stem(start: np.ndarray, n: int) -> np.ndarray:
    return start & np.uint64((1 << 8 * n) - 1)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


class Lexicon:
    def __init__(self, weights: dict[str, float], stems: dict[bytes, float] | None = None):
        self.stems = []
        for n in STEMS:
            own = sorted((int.from_bytes(k, "little"), v) for k, v in (stems or {}).items() if len(k) == n)
            if own:
                keys = np.array([k for k, _ in own], np.uint64)
                slots = np.zeros(1 << 16, bool)
                slots[_slot(keys)] = True
                self.stems.append((n, keys, np.array([v for _, v in own]), slots))
        h = hash_one([w.encode() for w in weights]) if weights else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.keys, self.weights = h[order], np.array(list(weights.values()), float)[order] if weights else np.zeros(0)
        self.second = np.sort(hash_one([w.encode() for w in SECOND]))

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], 0.0)


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
    return c[off[1:]] - c[off[:-1]]


def _undone(w, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Hashes of the words ``at`` with outer signs stripped, look-alikes read as
    letters, and what is no letter then left out."""
    if not len(at):
        return np.zeros(0, np.uint64)
    solid = np.flatnonzero(~_OUTER[w.buf])
    lo, hi = np.searchsorted(solid, w.start[at]), np.searchsorted(solid, w.end[at])
    full = hi > lo
    start = np.where(full, solid[np.minimum(lo, len(solid) - 1)], w.start[at]) if len(solid) else w.start[at]
    end = np.where(full, solid[np.maximum(hi - 1, 0)] + 1, start) if len(solid) else start
    edge = np.zeros(len(w.buf) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    read = _LEET[LOWER[w.buf]]
    keep = (np.cumsum(edge[:-1], dtype=np.int8) > 0) & letter[read]
    c = np.concatenate([[0], np.cumsum(keep)])
    return hash_words(w._replace(buf=read[keep], start=c[start], end=c[end]))


def features(col, lex: Lexicon) -> np.ndarray:
    """One row a text."""
    w = words_of(col, NON_ALNUM, lower=True)
    h = hash_words(w)
    n = np.diff(w.off).astype(float)
    weight = lex.weigh(h)
    if lex.stems and len(h):
        start, size = _starts(w)
        for k, keys, values, slots in lex.stems:
            stem = _stem(start, k)
            at = np.flatnonzero(slots[_slot(stem)] & (size >= k))
            where = np.minimum(np.searchsorted(keys, stem[at]), len(keys) - 1)
            weight[at] = np.maximum(weight[at], np.where(keys[where] == stem[at], values[where], 0))
    hit = weight > 0
    second = np.isin(h, lex.second)
    c = np.concatenate([[0], np.cumsum(second)])
    doc = w.doc()
    pos = np.arange(len(h))
    near = hit & (c[np.minimum(pos + NEAR + 1, w.off[doc + 1])] > c[np.maximum(pos - NEAR, w.off[doc])]) if len(h) else hit
    # Words with signs or digits inside, and those that are hits once undone.
    o = words_of(col, _INNER)
    size = o.end - o.start
    raw = o.buf
    letter = ~NON_ALNUM & ~np.isin(np.arange(256), np.arange(48, 58))
    odd = ~letter[raw]
    cum = np.concatenate([[0], np.cumsum(odd)])
    inner = cum[np.maximum(o.end - 1, o.start)] - cum[np.minimum(o.start + 1, o.end)]
    odd_word = (inner > 0) & (size >= 3) & (cum[o.end] - cum[o.start] < size) if len(size) else np.zeros(0, bool)
    hidden = np.zeros(len(size))
    some = np.flatnonzero(odd_word)
    hidden[some] = lex.weigh(_undone(o, some, letter)) > 0
    buf, offs = buffer_of(col)
    chars = np.maximum(np.diff(offs), 1).astype(float)
    upper = np.zeros(256)
    upper[65:91] = 1
    punct = np.zeros(256)
    punct[[33, 63, 42, 35, 36, 37, 38]] = 1
    d = np.maximum(n, 1)
    hits = _sums(hit, w.off) + _sums(hidden, o.off)
    return np.c_[
        np.log1p(n), _sums(weight, w.off) / d, hits / d, np.log1p(hits), np.log1p(_sums(near, w.off)), _sums(second, w.off) / d,
        _sums(upper[buf], offs) / chars, _sums(punct[buf], offs) / chars, _sums(odd_word, o.off) / d, np.log1p(_sums(hidden, o.off)),
    ]


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c[c > 0], np.linspace(0, 1, BINS)[:-1])) if (c > 0).any() else np.zeros(0) for c in x.T]
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees = []
        b, f = self._bin(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            f += RATE * self._walk(tree, b)
        return self

    def _bin(self, x):
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def _grow(self, b, g, h, at, depth):
        leaf = g[at].sum() / (h[at].sum() + 1)
        if not depth or len(at) < 20:
            return leaf
        best = (1e-6, None, None)
        for j in range(b.shape[1]):
            gs = np.bincount(b[at, j], g[at], BINS + 1).cumsum()
            hs = np.bincount(b[at, j], h[at], BINS + 1).cumsum()
            gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            gain[(hs[:-1] < 0.5) | (hs[-1] - hs[:-1] < 0.5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is None:
            return leaf
        _, j, k = best
        low = b[at, j] <= k
        return (j, k, self._grow(b, g, h, at[low], depth - 1), self._grow(b, g, h, at[~low], depth - 1))

    def _walk(self, tree, b):
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        j, k, low, high = tree
        return np.where(b[:, j] <= k, self._walk(low, b), self._walk(high, b))

    def score(self, x):
        b = self._bin(x)
        return self.base + RATE * sum(self._walk(t, b) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising function; ``w`` weighs the points."""
    w = np.ones(len(x)) if w is None else w
    blocks: list[list[float]] = []
    for v, t, n in sorted(zip(x, y, w)):
        blocks.append([v, t * n, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            v2, t2, n2 = blocks.pop()
            v1, t1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), t1 + t2, n1 + n2])
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.05) / (b[2] + 0.1) for b in blocks])


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, col) -> np.ndarray:
        x = features(col, self.lexicon)
        if self.trees is None:
            return 0.5 * (x[:, 3] > 0)
        raw = self.trees.score(x)
        at, value = self.knots
        # Inside a flat stretch the raw score still orders the texts.
        return np.clip(0.98 * np.interp(raw, at, value) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def _word_counts(batches):
    """(kind, key, toxic and other texts of each fold) of one batch: kind 0 words, 1 stems."""
    table = bytes(np.where(NON_ALNUM, 32, LOWER).astype(np.uint8))
    for b in batches:
        for a in range(0, b.num_rows, 500):
            part = b.slice(a, 500)
            counts: tuple[dict, dict] = ({}, {})
            for text, toxic, fold in zip(part.column("text"), part.column("toxic").to_pylist(), part.column("fold").to_pylist()):
                own = set(text.as_py().encode().translate(table).split())
                for keys, df in zip((own, {w[:n] for w in own for n in STEMS if len(w) >= n}), counts):
                    for key in keys:
                        df.setdefault(key, [0] * 2 * FOLDS)[2 * fold + 1 - toxic] += 1
            rows = [(kind, key, *c) for kind, df in enumerate(counts) for key, c in df.items()]
            if rows:
                kind, key, *n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.binary()), *(pa.array(c, pa.int64()) for c in n)], ["kind", "key", *(f"{c}{i}" for i in range(FOLDS) for c in ("n1_", "n0_"))])


def _fold(h) -> int:
    return (h >> 7) % FOLDS  # not the bits that chose the sample


def lexicons(texts: DataFrame) -> list[Lexicon]:
    """The lexicon of all ``texts`` (text, toxic, h), then one without each fold:
    words and stems in at least a hundredth of the toxic texts and twelve times as
    often there as in others, weighed by their log odds."""
    fold = F.pmod(F.shiftright("h", 7), F.lit(FOLDS)).cast("int")
    # A text is counted once; its fold's counts are taken off the totals.
    size = {(r.fold, r.toxic): r.n for r in texts.groupBy(fold.alias("fold"), "toxic").agg(F.count("*").alias("n")).collect()}
    per = [f"{c}{i}" for i in range(FOLDS) for c in ("n1_", "n0_")]
    counts = texts.withColumn("fold", fold).mapInArrow(_word_counts, "kind int, key binary, " + ", ".join(f"{c} long" for c in per))
    counts = counts.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in per])
    weights = []
    for left_out in (None, *range(FOLDS)):
        own = [i for i in range(FOLDS) if i != left_out]
        n1, n0 = (sum(size.get((i, c), 0) for i in own) for c in (1, 0))
        c1, c0 = (sum((F.col(f"{c}{i}") for i in own), F.lit(0)) for c in ("n1_", "n0_"))
        odds = F.log((c1 + 0.5) / max(n1, 1)) - F.log((c0 + 0.5) / max(n0, 1))
        weights.append(F.when((c1 >= max(5, n1 / 100)) & (odds >= 2.5), F.least(odds, F.lit(6.0)) / 2))
    named = [w.alias(f"w{i}") for i, w in enumerate(weights)]
    found = counts.select("kind", "key", *named).where(F.coalesce(*[f"w{i}" for i in range(len(named))]).isNotNull()).orderBy("kind", "key").collect()
    made = []
    for i in range(len(named)):
        some = [(r.kind, bytes(r.key), r[f"w{i}"]) for r in found if r[f"w{i}"] is not None]
        words = {k.decode(errors="replace"): w for kind, k, w in some if not kind}
        made.append(Lexicon({w: 2.0 for w in INSULTS} | words, {k: w for kind, k, w in some if kind}))
    return made


def fit(x: np.ndarray, y: np.ndarray, lexicon: Lexicon, fold: np.ndarray | None = None, weight: np.ndarray | None = None) -> Model:
    """Trees on features ``x`` (made by lexicons that do not know the text's fold)."""
    if len(y) < 40 or y.sum() in (0, len(y)):
        return Model(lexicon, None, None)
    fold = np.arange(len(y)) % FOLDS if fold is None else fold
    out = np.zeros(len(y))
    for k in np.unique(fold):
        rest = fold != k
        out[~rest] = Trees().fit(x[rest], y[rest]).score(x[~rest])
    return Model(lexicon, Trees().fit(x, y), isotonic(out, y.astype(float), weight))


def _remainder(n: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _sample(known: DataFrame, of: dict[int, int]) -> DataFrame:
    """``TRAIN_ROWS`` rows by hash: each class in proportion, but the rarer one at
    least ``CLASS_ROWS`` if it has as many."""
    total = sum(of.values())
    least = {c: min(n, CLASS_ROWS, TRAIN_ROWS // 2) for c, n in of.items()}
    take = {c: min(n, max(least[c], min(TRAIN_ROWS * n // max(total, 1) + 1, TRAIN_ROWS - sum(v for k, v in least.items() if k != c)))) for c, n in of.items()}
    out = None
    for c, n in sorted(take.items()):
        part = known.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(n)
        out = part if out is None else out.unionByName(part)
    return known.limit(0) if out is None else out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From the labels of rows that are not held out; of equal texts one counts.
    Executors count words and make features of whole texts, the driver gets a
    row of numbers a text."""
    known = labels.where((_remainder(5) != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    of = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(_sample(known, of)), "doc_id")
    texts = rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("h").alias("h")).orderBy("h", F.xxhash64("text")).limit(4 * TRAIN_ROWS)
    texts = runtime.stored(texts.repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism), "h"), "toxic-sample")
    whole, *others = lexicons(texts)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 250):
                part = b.slice(a, 250)
                of_row = np.array([_fold(h) for h in part.column("h").to_pylist()], int)
                for k in np.unique(of_row):
                    own = part.filter(pa.array(of_row == k))
                    x = features(own.column("text"), others[k])
                    yield pa.RecordBatch.from_arrays([own.column("h"), own.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["h", "toxic", "x"])

    found = sorted((r.h, r.toxic, r.x) for r in texts.mapInArrow(run, "h long, toxic int, x array<double>").collect())
    runtime.drop_stored(texts)
    y = np.array([r[1] for r in found], int)
    # Among all labelled rows a class may be rarer than in the sample.
    share = {c: (of.get(c, 0) / max(sum(of.values()), 1)) / max((y == c).mean(), 1e-9) if len(y) else 1.0 for c in (0, 1)}
    return fit(np.array([r[2] for r in found], float), y, whole, np.array([_fold(r[0]) for r in found], int), np.array([share[c] for c in y], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity (0 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                s = held.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, "toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = runtime.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, runtime.read(spark, sf_dir, "labels")))
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
