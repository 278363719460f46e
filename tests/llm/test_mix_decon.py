import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate as de
from quarry.llm import mixing as mx


def brute_targets(sizes):
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free = {}, set(order)
    total = 1.5 * sum(sizes.values())
    while True:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over


def check_mix(rows, got):
    sizes = {}
    for i, s, t, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = {}
    assert len(got) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in got:
        s = by[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2, (s, t, want[s])


def test_mixing(spark, sf_dir):
    rows = [(r.doc_id, r.source, r.text, 1) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_mix(rows, mx.op3_mixing(spark, sf_dir).collect())
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "Z", "é", "\U0001f600", None, "", "q"]), rnd.choice([None, "", " x \x0b y", "w " * rnd.randrange(300)]), 2) for i in range(400)]
    rows += [(1000, "big", "w " * 50000, 3), (1001, "none", None, 3), (1002, "none", " ", 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, taken int")
    got = mx.mix(df).collect()
    check_mix(rows, got)
    assert sorted(got) == sorted(mx.mix(df.repartition(5)).collect())
    assert mx.mix(df.limit(0)).collect() == []
    same = spark.createDataFrame([(None, "s", "a b c d")] * 9 + [(None, None, "a")], "doc_id long, source string, text string")
    assert sum(r.taken for r in mx.mix(same).collect()) >= 45


def profile(sizes, taken):
    """Mean length class of the document that a token of the mix comes from."""
    c = np.floor(np.log2(np.maximum(sizes, 1)))
    return (taken * c).sum() / taken.sum()


def test_dual(spark):
    """The rates solve the dual: source targets exactly, the profile up to the ridge."""
    rng = np.random.default_rng(0)
    cells = [(s, c, int(w), float(t)) for s, t in (("a", 0.4), ("b", 1.9), ("c", 2.0), ("d", 0.0), (None, 1.0)) for c, w in enumerate(rng.integers(0, 4000, 8) * (1 if s != "a" else np.arange(8)))]
    words = np.array([w for _, _, w, _ in cells], float)
    x = np.array([c for _, c, _, _ in cells], float)
    x = (x - (x * words).sum() / words.sum()) / np.sqrt((x * x * words).sum() / words.sum() - ((x * words).sum() / words.sum()) ** 2)
    size = {s: sum(w for q, _, w, _ in cells if q == s) for s in ("a", "b", "c", "d", None)}
    rows = [(s, c, w, float(v), t * size[s], size[s]) for (s, c, w, t), v in zip(cells, x)]
    df = spark.createDataFrame(rows, "source string, class int, words long, x double, target double, source_size long")

    def solve(ridge):
        got = {(r.source, r["class"]): r.rate for r in mx.rates(df, ridge=ridge).collect()}
        rate = np.array([got[s, c] for s, c, *_ in cells])
        for s, n in size.items():
            own = np.array([q == s for q, *_ in cells])
            want = next(t for q, _, _, t in cells if q == s) * n
            assert abs((rate * words)[own].sum() - want) <= 1e-6 * max(want, 1), s
        return rate

    rate, loose = solve(0.0), solve(1e9)
    assert abs((rate * words * x).sum()) < 1e-5 * words.sum() < abs((loose * words * x).sum())
    a = np.array([s == "a" for s, *_ in cells]) & (words > 0)
    logit = np.log(rate[a] / (2 - rate[a]))
    assert np.allclose(np.diff(logit) / np.diff(x[a]), (np.diff(logit) / np.diff(x[a]))[0]) and np.ptp(rate[a]) > 0.01 and np.ptp(loose[a]) < 1e-6


def test_profile_is_kept(spark):
    rnd = random.Random(3)
    rows = [(i, "long", "w " * rnd.randrange(20, 600), 1) for i in range(400)] + [(1000 + i, "short", "w " * rnd.randrange(1, 60), 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n int")
    got = mx.mix(df).collect()
    check_mix(rows, got)
    sizes, taken, target, own = (np.array([getattr(r, k) for r in got], float) for k in ("size", "taken", "target", "source_size"))
    flat = profile(sizes, sizes * target / own)
    assert abs(profile(sizes, taken) - profile(sizes, sizes)) < 0.6 * abs(flat - profile(sizes, sizes)) and abs(flat - profile(sizes, sizes)) > 0.1


def test_many_sources(spark):
    rows = [(i, f"s{i % 331:03d}" if i % 50 else None, "w " * (1 + i % 97), 1) for i in range(2000)]
    check_mix(rows, mx.mix(spark.createDataFrame(rows, "doc_id long, source string, text string, n int")).collect())


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_search():
    rnd = random.Random(4)
    for _ in range(200):
        a = [rnd.randrange(3) for _ in range(rnd.randrange(1, 9))]
        b = [rnd.randrange(3) for _ in range(rnd.randrange(14))]
        best = min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        d, end = de.search(np.array(a), np.array(b))
        assert d == best and any(distance(a, b[i:end]) == d for i in range(end + 1))
        assert de.search(np.array(a), np.array(b), True)[0] == min(distance(a, b[:j]) for j in range(len(b) + 1))


def test_planted(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 7, 9, 10, 12, 20, 33, 60] * 4)] + [(99, ""), (None, None)]
    docs, want = [], set()
    for k, (i, t) in enumerate(items[:-2]):
        w = t.split()
        for c in range(6):
            x = list(w)
            for _ in range(rnd.randrange(int(0.2 * len(w)) + 1)):
                p, op = rnd.randrange(len(x)), rnd.randrange(3)
                x[p : p + 1] = [[], ["zz"], [x[p], "zz"]][op]
            text = [word() for _ in range(rnd.randrange(50))] + x + [word() for _ in range(rnd.randrange(50))]
            docs.append((10 * k + c, ", ".join(text).title(), "x", 5))
            want.add((10 * k + c, i))
    docs += [(5000 + i, " ".join(word() for _ in range(400)), "x", 5) for i in range(60)] + [(9000, None, None, None), (9001, "", None, None), (None, " ".join(items[8][1].split() * 3), None, 3), (9002, "w1 " * 40000, "", 1)]
    schema = "doc_id long, text string, item_id string, distance int"
    df = spark.createDataFrame(docs, schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = de.find_items(df, bench).collect()
    texts, held = {d[0]: re.findall("[0-9a-z]+", (d[1] or "").lower()) for d in docs}, dict(items)
    for r in got:
        run = texts[r.doc_id][r.first_word : r.first_word + r.n_words]
        assert distance(held[r.item_id].split(), run) == r.distance <= 0.2 * len(held[r.item_id].split())
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert want <= pairs and (None, 8) in pairs and len(pairs) == len(got)
    clean = de.remove_contaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - {p[0] for p in pairs}
    assert de.find_items(df.limit(0), bench).collect() == [] and de.find_items(df, bench.limit(0)).collect() == []


def test_cgk_keeps_close_windows():
    ix = de.Index([0], [" ".join(f"a{i}" for i in range(20))])
    x = ix.items[0]
    y = np.concatenate([x[1:10], x[:1], x[10:], x[:1]])[:20]
    n = np.array([20])
    assert (ix.embed([x], n) == ix.item_code(0)).all() and (ix.embed([y], n)[0] == ix.item_code(0)).all(-1).any()
    assert (ix.embed([x, y], np.array([20, 20]))[1] == ix.embed([y], n)[0]).all()
    assert (ix.embed([x + np.uint64(1)], n)[0] == ix.item_code(0)).all(-1).mean() < 0.1


def test_long_items_and_cut_starts(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    items = {n: [word() for _ in range(n)] for n in (45, 100, 200, 400)}
    docs, want = [], set()
    for n, w in items.items():
        for c in range(6):
            x = list(w)
            for _ in range(n // 5):  # the full distance
                p, op = rnd.randrange(len(x)), rnd.randrange(3)
                x[p : p + 1] = [[], ["zz"], [x[p], "zz"]][op]
            docs.append((10 * n + c, " ".join([word() for _ in range(30)] + x + [word() for _ in range(30)])))
            docs.append((10 * n + 6, " ".join(w[n // 5 :] + [word() for _ in range(30)])))  # the text starts inside the item
            docs.append((10 * n + 7, " ".join([word() for _ in range(30)] + w[: n - n // 5])))
            want |= {(10 * n + c, n), (10 * n + 6, n), (10 * n + 7, n)}
    # A far copy first, a near one later: the closest is reported.
    near = items[100][:40] + ["zz"] + items[100][41:]
    docs.append((1, " ".join(items[100][:30] + ["q"] * 15 + items[100][45:] + [word() for _ in range(50)] + near)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in de.find_items(df, bench).collect()}
    assert want | {(1, 100)} == set(got) and (got[1, 100].distance, got[1, 100].n_words) == (1, 100)
    assert de.remove_contaminated(df, bench).count() == 0


def test_all_against_all(spark, monkeypatch):
    """Every pair of a text and an item by the distance table: nothing is lost, and
    nothing else is found, in any number of blocks."""
    rnd = random.Random(12)
    word = lambda: f"v{rnd.randrange(25)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 4, 5, 7, 10, 11, 15, 24, 40])))) for i in range(40)] + [(3, "v1 v2 v3 v4 v5")] * 3
    docs = []
    for k in range(120):
        x = items[rnd.randrange(40)][1].split()
        for _ in range(rnd.randrange(1 + len(x) // 4)):
            p, op = rnd.randrange(len(x)), rnd.randrange(3)
            x[p : p + 1] = [[], [word()], [x[p], word()]][op]
            x = x or [word()]
        docs.append((k, " ".join([word() for _ in range(rnd.randrange(15))] + x + [word() for _ in range(rnd.randrange(15))])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for k, text in docs:
        t = text.split()
        for i, it in items:
            x = it.split()
            # The least distance of the item to any run of the text.
            d = [0] * (len(t) + 1)
            for r, w in enumerate(x, 1):
                last, d[0] = d[0], r
                for j, y in enumerate(t, 1):
                    last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (w != y))
            if 5 * min(d) <= len(x):
                want[k, i, min(d)] += 1
    for limit in (20_000, 9):
        monkeypatch.setattr(de, "ITEMS", limit)
        assert Counter((r.doc_id, r.item_id, r.distance) for r in de.find_items(df, bench).collect()) == want
    assert sum(want.values()) > 300


@pytest.mark.parametrize("hot,piece", [(64, 1 << 20), (2, 50), (0, 1)])
def test_hot_grams_and_pieces_lose_nothing(monkeypatch, hot, piece):
    """Items that share openings, and near-identical ones, against an exhaustive search."""
    monkeypatch.setattr(de, "HOT", hot)
    monkeypatch.setattr(de, "PIECE", piece)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(60)}"
    opening = "which of the following is true of".split()
    items = [opening + [word() for _ in range(rnd.randrange(1, 25))] for _ in range(40)] + [opening[:n] for n in (1, 2, 4, 7)] + [["same"] * 12]
    items += [items[0][:-1] + [word()] for _ in range(8)]
    texts = []
    for i in range(40):
        w = [word() for _ in range(rnd.randrange(40))]
        for _ in range(rnd.randrange(3)):
            x = list(rnd.choice(items))
            for _ in range(rnd.randrange(3)):
                x[rnd.randrange(len(x))] = word()
            at = rnd.randrange(len(w) + 1)
            w[at:at] = x
        texts.append(" ".join(w + opening * rnd.randrange(3)))
    texts += ["same " * 30, " ".join(opening * 20), ""]
    index = de.Index(list(range(len(items))), [" ".join(x) for x in items])
    got = {(d, i): dist for d, i, _, _, dist in index.find(pa.array(texts))}
    want = {}
    for d, t in enumerate(texts):
        h = de.hash_words(de.words_of(pa.array([t]), de.NON_ALNUM, lower=True))
        for i, x in enumerate(index.items):
            dist, _ = de.search(x, h)
            if dist <= index.edits[i]:
                want[d, i] = dist
    assert got == want


def test_common_opening_in_bounded_memory():
    """20,000 items with one opening against a text that repeats it: the hits of the
    opening alone would be 2 * 10^8 for each of its q-grams."""
    import tracemalloc

    rnd = random.Random(1)
    items = ["which of the following " + " ".join(f"x{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(20000)]
    index = de.Index(list(range(20000)), items)
    text = "which of the following " * 10000 + items[77]
    tracemalloc.start()
    got = index.find(pa.array([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(g[1], g[4]) for g in got] == [(77, 0)] and peak < 200e6
