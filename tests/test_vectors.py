"""The vector index against exhaustive search."""

import numpy as np

from quarry import catalogue
from quarry.operators import search as S
from quarry.operators import vectors as V
from quarry.sources import scratch

SCHEMA = "domain string, chunk_id string, vector array<float>, cell int"


def hits(df):
    return {(r.query_id, r.domain, r.chunk_id) for r in df.collect()}


def test_recall_on_the_tables(spark):
    """The registered query finds at least 0.9 of the exact one's hits."""
    for sf in ("sf0.01", "sf0.1"):
        want = hits(catalogue.QUERIES["m2_cosine_topk"](spark, f"/root/testdata/{sf}"))
        got = hits(catalogue.QUERIES["k2_vector_index"](spark, f"/root/testdata/{sf}"))
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
        scratch.clear(spark)


def clustered(n, dim=32, groups=40):
    rng = np.random.default_rng(2)
    heart = rng.normal(size=(groups, dim))
    x = heart[rng.integers(0, groups, n)] + rng.normal(scale=0.15, size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_clustered_vectors_need_few_probes(spark):
    x = clustered(6000)
    rows = [("ab"[i % 2], f"v{i:05d}", v.tolist(), 1) for i, v in enumerate(x)]
    rows += [("a", f"same{i}", x[0].tolist(), 1) for i in range(500)] + [("a", "none", None, 1), ("a", "short", [1.0], 1), (None, "nodomain", x[1].tolist(), 1), ("b", "zero", [0.0] * 32, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = V.VectorIndex.of(df)
    cells = len(held.model.cells)
    assert cells > 30 and held.model.probes < cells / 3
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 6000, 50)] + [(-1, None)], "query_id long, vector array<float>")
    want, got = S.dense(q, df.where("size(vector) = 32"), 8), held.search(q, 8)
    assert len(hits(want) & hits(got)) >= 0.9 * len(hits(want))
    scores = {(r.query_id, r.domain, r["rank"]): r.score for r in want.collect()}
    assert all(r.score <= scores[r.query_id, r.domain, r["rank"]] + 1e-6 for r in got.collect())
    # A search reads the folders of probed cells only.
    one = held.search(q.where("query_id = 0"), 8)
    assert 0 < len(held.table.where("cell < 0").inputFiles()) and hits(one)
    plan = held.table.where("cell IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    wanted = q.selectExpr("query_id", "'b' AS domain")
    routed = held.search(q, 8, wanted, block=50)
    assert {d for _, d, _ in hits(routed)} == {"b"} and len(hits(routed) & hits(S.dense(q, df.where("size(vector) = 32"), 8, wanted))) >= 0.9 * len(hits(routed))
    # All cells and a deep rerank are exact.
    full = held.search(q.where("query_id < 500"), 8, probes=cells, depth=1000)
    assert sorted(map(tuple, full.collect()), key=str) == sorted(map(tuple, S.dense(q.where("query_id < 500"), df.where("size(vector) = 32"), 8).collect()), key=str)


def test_empty_and_few(spark):
    df = spark.createDataFrame([("a", "x", [1.0, 0.0], 1)], SCHEMA)
    q = spark.createDataFrame([(1, [0.6, 0.8])], "query_id long, vector array<float>")
    assert hits(V.VectorIndex.of(df.limit(0)).search(q, 3)) == set()
    assert [(r.chunk_id, r.score) for r in V.VectorIndex.of(df).search(q, 3).collect()] == [("x", 0.6)]
    assert hits(V.VectorIndex.of(df).search(q.limit(0), 3)) == set()


def test_fit_measures_what_it_needs():
    apart = V.fit(clustered(4000))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    alike = V.fit(x / np.linalg.norm(x, axis=1)[:, None])
    assert apart.probes * 3 < alike.probes <= len(alike.cells)
    points = clustered(300)
    cell = V.nearest(points, apart.cells)
    codes = V.coded(points, cell, apart)
    near = V.approximate(points[:5], V.tables(points[:5], apart), codes, apart.cells[cell])
    assert np.abs(near - points @ points[:5].T).max() < 0.2
