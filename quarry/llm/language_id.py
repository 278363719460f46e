"""Language identification by string kernels.

A text is the set of its character n-grams (n = 1, 2, 3; lower-cased; hashed to
``BUCKETS`` bits): the blended-spectrum presence kernel of two texts is the
cosine of these sets. Nystroem landmarks, a few training texts of each
language, give explicit features; one-versus-rest kernel ridge regression on
them is solved on the driver. A batch is scored by two matrix products.

Every language of a labelled row is a class. Training reads a bounded sample, by
hash of doc_id and text: about ``PER_LANG`` labelled rows of each language, fewer
(``LEAST_ROWS`` or more) where there are so many languages that this exceeds
``SAMPLE`` rows, and ``RARE_ROWS`` or more beyond; a language of which this leaves
no row gives its first ones. Executors turn their whole texts, and two short pieces
of each, into sets of n-grams; only these bits reach the driver, ``CLASS_BLOCK``
languages at a time, each block is added to the sums of the ridge problem and
dropped. Landmarks are of all languages, or, beyond ``MOST_LANDMARKS`` in all, of
those with most labelled rows. So memory is bounded but for the weights, 4 bytes a
landmark and language (some 60 MB for 20,000 languages, whatever junk they are),
and scores are taken by blocks of languages. Predictions read whole texts, too.

Defined results: null texts and texts without a letter (of a Unicode letter category;
numerals are none) are ``und`` with score
0, and so is every text if no labelled row exists; a null doc_id counts as
''; repeated rows each get the same result; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime

BUCKETS = 1 << 14
PER_LANG, LEAST_ROWS, RARE_ROWS, SAMPLE = 300, 20, 2, 9600
#: Characters of the pieces from which short texts are learned.
PIECES = (120, 30)
#: Landmarks in all, and of each language at least.
LANDMARKS, LEAST_LANDMARKS, MOST_LANDMARKS = 96, 3, 768
#: Languages whose training sets are held at once, and whose scores are.
CLASS_BLOCK = 2048
RIDGE = 0.05
_LETTER = regex.compile(r"\p{L}")
_C = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def presence(texts: list[str]) -> np.ndarray:
    """One row of 0/1 a text: the n-grams that it holds."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts):
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        g = c * _C[0]
        for n in (1, 2, 3):
            if n > 1:
                if len(c) < n:
                    break
                g = (g[:-1] ^ (g[:-1] >> np.uint32(15))) * _C[1] + c[n - 1 :] * _C[2]
            row[(g ^ (g >> np.uint32(13))) * _C[0] >> np.uint32(18)] = 1
    return out


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """landmarks: BUCKETS x m, columns of length 1."""
    return (x @ landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def has_language(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


class Model:
    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        seen = [i for i, t in enumerate(texts) if has_language(t)] if self.langs else []
        for a in range(0, len(seen), 128):
            at = seen[a : a + 128]
            k = _kernel(presence([texts[i] for i in at]), self.landmarks)
            phi = np.c_[k, np.ones(len(at))]
            best, most, total = np.zeros(len(at), int), np.full(len(at), -np.inf), np.zeros(len(at))
            for b in range(0, len(self.langs), CLASS_BLOCK):
                s = phi @ self.weights[:, b : b + CLASS_BLOCK]
                top = s.argmax(1)
                value = np.maximum(most, s[np.arange(len(at)), top])
                total = total * np.exp(6 * (most - value)) + np.exp(6 * (s - value[:, None])).sum(1)
                best, most = np.where(value > most, b + top, best), value
            for i, j, p in zip(at, best, 1 / total):
                langs[i], scores[i] = self.langs[j], float(p)
        return langs, scores


def _pieces(text: str) -> list[str]:
    """The whole text and short runs of it, at places that depend on the text."""
    at = zlib.crc32(text.encode("utf-8", "replace"))
    return [text, *(text[(a := at % max(1, len(text) - n + 1)) : a + n] for n in PIECES)]


def _training_sets(batches):
    """(lang, h, bits): the n-gram sets of a text and its pieces, packed."""
    for b in batches:
        rows = [(lang, h, np.packbits(presence(_pieces(t)).astype(bool)).tobytes()) for lang, h, t in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "text"))) if _LETTER.search(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "bits"])


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(1 + len(PIECES), -1)


class Ridge:
    """The ridge problem of landmarks: sums over training texts, then the weights."""

    def __init__(self, marks: list[bytes]):
        land = np.unpackbits(np.stack([_unpacked(x)[0] for x in marks]), axis=1).astype(np.float32)
        self.land = (land / np.sqrt(land.sum(1, keepdims=True))).T.copy()
        value, vector = np.linalg.eigh(self.land.T.astype(float) @ self.land)
        self.half = vector / np.sqrt(np.maximum(value, 1e-6))  # Nystroem: K(L, L)^-1/2
        m = len(marks) + 1
        self.square, self.langs, self.sums, self.n = np.zeros((m, m)), [], [], 0

    def add(self, rows: list[tuple[str, bytes]]) -> None:
        """All rows of some languages: each language weighs the same in the sums."""
        number = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in rows}))}
        y = np.repeat(np.array([number[lang] for lang, _ in rows]), 1 + len(PIECES))
        flat = np.concatenate([_unpacked(x) for _, x in rows])
        weight = 1 / np.bincount(y, minlength=len(number))[y]
        sums = np.zeros((len(number), len(self.square)))
        for a in range(0, len(flat), 256):
            k = _kernel(np.unpackbits(flat[a : a + 256], axis=1).astype(np.float32), self.land).astype(float)
            phi = np.c_[k @ self.half, np.ones(len(k))]
            w = weight[a : a + 256, None]
            self.square += (phi * w).T @ phi
            np.add.at(sums, y[a : a + 256], phi * w)
        self.langs += number
        self.sums.append(sums)
        self.n += len(flat)

    def model(self) -> Model:
        share = self.n / len(self.langs)  # the weights of all texts add up to their number
        reg = RIDGE * np.eye(len(self.square)) * self.n / 1000
        b = np.linalg.solve(self.square * share + reg, np.concatenate(self.sums).T * share)
        weights = np.r_[self.half @ b[:-1], b[-1:]].astype(np.float32)
        order = sorted(range(len(self.langs)), key=self.langs.__getitem__)
        return Model([self.langs[i] for i in order], self.land, weights[:, order])


def _no_model() -> Model:
    return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((1, 0)))


def landmarks_each(n_langs: int) -> int:
    return max(LEAST_LANDMARKS, LANDMARKS // n_langs)


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """rows: (lang, packed sets of a text and its pieces), in a fixed order."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return _no_model()
    each = landmarks_each(len(langs))
    marks = [x for lang in langs for x in [x for own, x in rows if own == lang][:each]]
    ridge = Ridge(marks)
    ridge.add(rows)
    return ridge.model()


def _remainder(n: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def train(docs: DataFrame) -> Model:
    """The model from the labelled rows that are not held out."""
    spark = docs.sparkSession
    open_ = docs.where((_remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # By row, so that many rows of one doc_id are sampled like any others.
    row = F.xxhash64("doc_id", F.xxhash64("text"))
    counts = runtime.stored(open_.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    n_langs = counts.count()
    if not n_langs:
        return _no_model()
    most = max(LEAST_ROWS if n_langs * LEAST_ROWS <= SAMPLE else RARE_ROWS, min(PER_LANG, SAMPLE // n_langs))
    few = n_langs <= 100_000
    unit = F.pmod(row, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = counts.select("lang", (1.2 * most / F.col("n")).alias("share"))
    texts = open_.join(F.broadcast(share) if few else share, "lang").where(unit < F.col("share")).select("lang", row.alias("h"), "text")
    # The bound is by language, so that none is crowded out.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    texts = texts.withColumn("place", place).where(F.col("place") <= 2 * most).select("lang", "h", "text")
    got = runtime.stored(texts.mapInArrow(_training_sets, "lang string, h long, bits binary"), "sets")
    # Rare by chance, or of rows that are all equal: their first rows.
    without = counts.select("lang").join(got.select("lang").distinct(), "lang", "left_anti")
    rest = open_.join(F.broadcast(without) if few else without, "lang").select("lang", row.alias("h"), "text")
    rest = rest.withColumn("place", place).where(F.col("place") <= min(LEAST_ROWS, most)).select("lang", "h", "text")
    got = runtime.stored(got.unionByName(rest.mapInArrow(_training_sets, "lang string, h long, bits binary")), "sets")
    n_langs = got.select("lang").distinct().count()
    if not n_langs:
        return _no_model()
    each = landmarks_each(n_langs)
    marked = counts.join(got.select("lang").distinct(), "lang").orderBy(F.desc("n"), "lang").limit(MOST_LANDMARKS // each).select("lang")
    order = Window.partitionBy("lang").orderBy("h", "bits")
    marks = got.join(F.broadcast(marked), "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    ridge = Ridge([bytes(r.bits) for r in marks.orderBy("lang", "place").select("bits").collect()])
    blocks = -(-n_langs // CLASS_BLOCK)
    for i in range(blocks):
        part = got if blocks == 1 else got.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == i)
        rows = [(r.lang, bytes(r.bits)) for r in part.orderBy("h", "lang", "bits").select("lang", "bits").collect()]
        if rows:
            ridge.add(rows)
    return ridge.model()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; a column of these names is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                lang, score = held.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def reject_unknown(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a language, all columns as they were, but that ``model``
    predicts a ``lang`` (of strings) that is null. Null texts and texts without letters
    go: these are ``und``. A model without languages rejects the same and predicts
    nothing."""
    fill = bool(model.langs) and "lang" in docs.columns and docs.schema["lang"].dataType == T.StringType()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                part = part.filter(pa.array([has_language(t) for t in part.column("text").to_pylist()], pa.bool_()))
                if fill:
                    part = _filled(part, held.value)
                yield part

    return docs.mapInArrow(run, docs.schema)


def _filled(rows: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    at = rows.schema.get_field_index("lang")
    field, none = rows.schema.field(at), rows.column(at).is_null()
    pred, _ = model.predict(rows.column("text").filter(none).to_pylist())
    return rows.set_column(at, field, pc.replace_with_mask(rows.column(at), none, pa.array(pred, field.type)))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = runtime.read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")
