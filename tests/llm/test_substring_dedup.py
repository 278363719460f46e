import hashlib
import random

from quarry.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, source string, block string"


def brute(rows, k=13):
    least = {}
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in words:
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and least[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    got = sd.dedup_substrings(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str)


def test_cases(spark):
    rnd = random.Random(1)
    vocab = ["a", "b", "é", "\x85x", "word"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(60))), "s", "x") for i in range(60)]
    base = " ".join(f"w{i}" for i in range(80))
    rows += [(100, base, None, None), (101, base, None, None), (101, base + " tail", None, None), (102, "x " + " ".join(base.split()[40:]) + " y " + " ".join(base.split()[:40]), None, None)]
    rows += [(200, None, None, None), (201, "", None, None), (202, " \n ", None, None), (None, base, None, None), (50, " ".join(f"w{i}" for i in range(20000)), None, None)]
    for kw in ({}, {"block_bytes": 2000}, {"k": 3, "block_bytes": 3000}):
        assert run(spark, rows, **kw) == brute(rows, kw.get("k", 13))


def test_empty(spark):
    assert run(spark, []) == []


def test_collisions_are_found(spark):
    """With hashes of a few bits most edges collide, and the result is still exact."""
    rnd = random.Random(2)
    rows = [(rnd.randrange(40), " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(25))), "", "") for _ in range(50)]
    rows += [(100 + i, rows[rnd.randrange(50)][1] + " z y x", "", "") for i in range(20)] + [(None, "a b c d", "", ""), (3, None, "", "")]
    for mask in (0, 7, 255):
        assert run(spark, rows, k=3, mask=mask, block_bytes=400) == brute(rows, 3)


def test_hot_ids(spark):
    """One id, and the null id, with a third of all rows each: dealt over blocks."""
    rnd = random.Random(5)
    text = lambda: " ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(40)))
    rows = [(i, text(), "", "") for i in range(60)] + [(7, text(), "", "") for _ in range(60)] + [(None, text(), "", "") for _ in range(60)]
    deal = sd._Deal(spark.createDataFrame(rows, SCHEMA), 500)
    held = deal.rows(spark.createDataFrame(rows, SCHEMA)).groupBy("doc_id").agg({"block": "count"}).collect()
    assert deal.heavy.count() == 1 and len(held) == 61
    for mask in (15, sd.ALL_BITS):
        assert run(spark, rows, k=4, mask=mask, block_bytes=500) == brute(rows, 4)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.op1_substring_dedup(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
