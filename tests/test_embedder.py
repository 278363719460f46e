"""The embedder against a dense singular value decomposition."""

import math
import random
from collections import Counter

import numpy as np

from quarry.operators import embedder as E
from quarry.operators import search as S

CHUNK = "domain string, chunk_id string, text string"


def corpus(n=240):
    rnd = random.Random(5)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    return [("a", f"c{i:04d}", " ".join(rnd.choice(topics[i % 6] if rnd.random() < 0.8 else rnd.choice(topics)) for _ in range(30)), i % 6) for i in range(n)]


def dense(texts, tokens):
    """The tf-idf matrix in the plain."""
    df = Counter(t for x in texts for t in set(x.split()))
    out = np.zeros((len(texts), len(tokens)))
    for i, x in enumerate(texts):
        for t, f in Counter(x.split()).items():
            if t in tokens:
                out[i, tokens.index(t)] = (1 + math.log(f)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1)
        if out[i].any():
            out[i] /= np.linalg.norm(out[i])
    return out


def test_equals_a_dense_decomposition(spark):
    rows = corpus()
    texts = [t for _, _, t, _ in rows]
    index = S.index(spark.createDataFrame([r[:3] for r in rows] + [("a", "z", "once only")], CHUNK).repartition(5))
    model = E.fit(index, dim=6, steps=30)
    tokens = model.vocabulary.tokens.to_pylist()
    assert len(tokens) == 72 and "once" not in tokens  # LEAST_DF
    x = dense([*texts, "once only"], tokens)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-6)
    for got, want in zip(model.basis.T, vt):
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-4  # up to sign
    near = x[:-1] @ vt[:6].T
    near /= np.linalg.norm(near, axis=1)[:, None]
    embed = model.column(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, "unknown words"), (901, None), (902, ""), (903, "T0W1, t0w1!")], "i int, text string")
    got = {r.i: r.v for r in df.select("i", embed(df.text).alias("v")).collect()}
    assert got[900] is None and got[901] is None and got[902] is None and abs(np.linalg.norm(got[903]) - 1) < 1e-9
    mine = np.array([got[i] for i in range(len(texts))])
    assert np.allclose(mine @ mine.T, near @ near.T, atol=1e-4)
    # Texts of one topic are near each other, those of two are not.
    topic = np.array([k for *_, k in rows])
    same = (topic[:, None] == topic) & ~np.eye(len(topic), dtype=bool)
    assert (mine @ mine.T)[same].mean() > 0.8 and (mine @ mine.T)[topic[:, None] != topic].mean() < 0.4


def test_empty(spark):
    model = E.fit(S.index(spark.createDataFrame([], CHUNK)))
    df = spark.createDataFrame([("a b",)], "text string")
    assert df.select(model.column(spark)(df.text).alias("v")).first().v is None
