import hashlib
import random

import numpy as np

from quarry.llm import centroids as ce

SCHEMA = "id long, vector array<float>, v int, cluster string"


def brute(rows, k, rounds, dim):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), cents


def run(df, **kw):
    found, cents = ce.cluster(df, **kw)
    return sorted(((r.id, r.cluster, r.distance) for r in found.collect()), key=str), cents


def made(dim):
    rnd = random.Random(3)
    heart = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [x + rnd.gauss(0, 0.02) for x in rnd.choice(heart)], 1, "x") for i in range(500)]
    rows += [(1000 + i, heart[0], 1, "x") for i in range(300)]
    rows += [(3, heart[1], 1, "x"), (None, heart[2], 1, None), (None, heart[2], None, None), (2000, None, 1, ""), (2001, [], 1, "")]
    rows += [(2002, heart[0][:-1] + [None], 1, ""), (2003, heart[0][:-1] + [float("nan")], 1, ""), (2004, heart[0][:-1] + [float("-inf")], 1, ""), (2005, heart[0] + [0.0], 1, "")]
    return rows


def test_brute(spark):
    for dim, k in ((4, 9), (64, 40)):
        rows = made(dim)
        df = spark.createDataFrame(rows, SCHEMA)
        want, cents = brute(rows, k, 5, dim)
        got, found = run(df, k=k, dim=dim)
        assert got == want and found.tolist() == cents
    assert run(df.limit(0))[0] == []
    few = [(1, [0.5] * 64, 1, ""), (2, [-0.25] * 64, 1, "")]
    assert run(spark.createDataFrame(few, SCHEMA))[0] == brute(few, 40, 5, 64)[0]


def test_trees():
    rnd = np.random.default_rng(1)
    heart = rnd.integers(-4000, 4000, (6, 8))
    points = heart[rnd.integers(0, 6, 3000)] + rnd.integers(-20, 20, (3000, 8))
    tree = ce.build(list(range(3000)), points)
    assert sorted(tree.ids) == list(range(3000)) and (tree.points == points[tree.ids]).all()
    labels, n, sums, stats = ce.walk(tree, heart)
    d = ((tree.points[:, None] - heart[None]) ** 2).sum(2)
    assert (labels == d.argmin(1)).all() and n.sum() == 3000 and (sums.sum(0) == points.sum(0)).all()
    assert stats["whole"] > 2000  # boxes apart from all but one centroid are not opened
    # Ties: of equal centroids the first, and none of them dominates the other strictly.
    twice = np.concatenate([heart, heart])
    assert (ce.walk(tree, twice)[0] == d.argmin(1)).all()
    same = ce.build(list(range(100)), np.repeat(heart[:1], 100, axis=0))
    assert len(same.begin) == 1 and (ce.walk(same, twice)[0] == 0).all()


def test_large_numbers():
    a, b = np.array([[ce.LARGEST, -ce.LARGEST]]), np.array([[-ce.LARGEST, ce.LARGEST], [ce.LARGEST, 1 - ce.LARGEST]])
    assert ce.distances(a, b).tolist() == [[2 * (2 * ce.LARGEST) ** 2, 1]]
