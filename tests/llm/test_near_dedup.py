import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import graph
from quarry.llm import near_dedup as nd


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=3, percent=85):
    sets = [(i, shingle_set(t, k)) for i, t, *_ in rows]
    least = {i: i for i, _ in sets}
    find = lambda i: i if least[i] == i else find(least[i])
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                least[q] = p
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def run(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nd.classes(df, **kw).collect()), key=str)


def test_cases(spark, monkeypatch):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w), "c", 1))
    rows += [(2000 + i, " ".join(base).upper(), "c", 1) for i in range(20)]
    rows += [(1, None, "", 1), (2, "", "", 1), (3, "a", "", 1), (4, "A", "", 1), (5, "a b", "", 1), (None, "a", "", 1), (None, None, None, None), (6, " ".join(f"v{i}" for i in range(30000)), "", 1), (7, "a b c d", "", 1), (7, "a b c d", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, h1 int")
    want = brute(rows)
    assert run(df) == want
    monkeypatch.setattr(nd, "PART_DOCS", 20)
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 5)
    assert run(df) == want
    assert run(df.limit(0)) == []
    kept = nd.near_dedup(df)
    assert kept.columns == df.columns and kept.count() == sum(c is None or c == i for i, _, c in brute(rows, 5, 80))


def test_rows_of_one_id(spark, monkeypatch):
    rnd = random.Random(7)
    text = lambda: [f"w{rnd.randrange(9000)}" for _ in range(120)]
    near = lambda w: w[:60] + ["zz"] + w[61:]
    x, y, z, u = text(), text(), text(), text()
    own = [text() for _ in range(30)]
    rows = [(5, x), (5, y), (3, y), (5, z), (2, near(z)), (9, near(x)), (4, u), (6, u), (6, near(u)), (6, own[0])] + [(5, w) for w in own[1:]] + [(8, near(own[1])), (None, x)]
    gone = {1, 3, 5, 7, 8, len(rows) - 2}
    df = spark.createDataFrame([(i, " ".join(w), k) for k, (i, w) in enumerate(rows)], "doc_id long, text string, key long")
    want = sorted(k for k in range(len(rows)) if k not in gone)
    assert sorted(r.key for r in nd.near_dedup(df).collect()) == want
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 0)
    assert sorted(r.key for r in nd.near_dedup(df.repartition(7)).collect()) == want
    got = sorted(((r.doc_id, r.component_id) for r in nd.classes(df, 5, 80).where("doc_id <> 5").collect()))
    assert got == [(2, 2), (3, 3), (4, 4), (6, 4), (6, 4), (6, 6), (8, 5), (9, 5)]


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_estimates():
    a = np.arange(1000, dtype=np.uint64)
    from quarry.llm.words import mix

    x = mix(np.concatenate([a[:900], a[100:]]) + np.uint64(5))
    r = nd.sketch(x, np.array([0, 900, 1800]))
    assert abs(nd.estimate(r[0], 900, r[1:], np.array([900]))[0] - 0.8) < 0.15
    u = nd.sketch(mix(a + np.uint64(5)), np.array([0, 1000]))[0]
    assert (nd.merge(r[0], r[1]) == u).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(60) if i % 13] + [(100, 5), (100, 100), (3, 2), (3, 2)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {i: i for p in links for i in p}
    for _ in range(100):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {i: c for i, c in least.items()}
    assert pa.table({}).num_rows == graph.components(spark.createDataFrame([], "a long, b long")).count()


def test_components_must_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(links, rounds=2)
