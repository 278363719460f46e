"""The stored keyword index against exhaustive scoring, and kept up to date."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import postings as P
from quarry.operators import search as S
from quarry.sources import scratch

CHUNK = "domain string, chunk_id string, text string, terms_ int"


def corpus(seed, n, domains=("a", "b")):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    # Few frequent words, many rare ones, and chunks of very different lengths.
    text = lambda: " ".join(words[min(299, int(rnd.expovariate(1 / 30)))] for _ in range(rnd.choice([1, 5, 40, 200])))
    return [(rnd.choice(domains), f"c{i:05d}", text(), 1) for i in range(n)], [(q, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 4, 15])))) for q in range(40)]


def rows(df):
    return sorted((r.query_id, r.domain, r.chunk_id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)


def test_equals_exhaustive(spark, tiny, monkeypatch):
    chunks, questions = corpus(1, 900)
    chunks += [("a", f"same{i}", "w3 w4 w250", 1) for i in range(30)] + [("c", "only", "w1", 1), ("d", "empty", "", 1), ("d", "dots", "...", 1), (None, "x", "w1", 1), ("e", "long", "w5 " * 50000, 1)]
    ch = S.index(spark.createDataFrame(chunks, CHUNK))
    q = spark.createDataFrame([*questions, (40, ""), (41, None), (42, "unknown"), (43, "w3 w3 w250")], "query_id int, query string")
    held = P.TextIndex.of(ch)
    for k in (1, 7, None):
        assert rows(S.keyword_search(q, held, k)) == rows(S.bm25(q, ch, k))
    wanted = q.selectExpr("query_id", "if(query_id % 2 = 0, 'a', 'b') AS domain")
    assert rows(S.keyword_search(q, held, 5, wanted)) == rows(S.bm25(q, ch, 5, wanted))
    monkeypatch.setattr(P, "WEIGHTS", 50)  # blocks of questions
    assert rows(S.keyword_search(q, held, 5)) == rows(S.bm25(q, ch, 5))
    none = P.TextIndex.of(ch.limit(0))
    assert rows(S.keyword_search(q, none, 5)) == [] and rows(S.keyword_search(q.limit(0), held, 5)) == []


def shard_of(docs, n):
    """A shard of n chunks: token -> {chunk: frequency}."""
    terms = [[{"token": t, "f": f[c]} for t, f in sorted(docs.items()) if c in f] for c in range(n)]
    dls = np.array([sum(x["f"] for x in t) for t in terms])
    row = P.shard_row("a", 0, pa.array([f"{c:06d}" for c in range(n)]), dls, pa.array(terms, P._TERM))
    return next(P.shards([row]))


def test_blocks_are_skipped():
    rnd = random.Random(4)
    docs = {"common": {c: rnd.choice([1, 1, 2]) for c in range(4000)}, "often": {c: 1 for c in range(0, 4000, 2)}, "rare": {c: 3 for c in rnd.sample(range(4000), 25)}}
    shard = shard_of(docs, 4000)
    vocabulary = pa.array(["common", "often", "rare"])
    asked = P.Asked(2.0, vocabulary, [0], np.array([0, 3]), np.arange(3), np.array([0.05, 0.3, 5.0]))
    (got,), read, all_ = P.top(shard, asked, 8)
    exact = np.zeros(4000)
    for t, w in zip(("common", "often", "rare"), asked.weights):
        for c, f in docs[t].items():
            exact[c] += w * P.gain(f, shard.dls[c], 2.0)
    best = sorted(range(4000), key=lambda c: (-round(exact[c], 6), c))[:8]
    assert got[1].tolist() == best and np.allclose(got[2], exact[best])
    assert all_ == 32 + 16 + 1 and read < all_ / 2
    # Without a rare word every chunk may be among the best: nothing can be skipped.
    flat = asked._replace(weights=np.array([1.0, 1.0, 1.0]), tokens=np.array([0, 0, 0]), ptr=np.array([0, 1]))
    assert P.top(shard, flat, 4000)[1] == 32


def test_negative_weights(tiny):
    rnd = random.Random(6)
    docs = {f"t{i}": {c: rnd.randint(1, 4) for c in rnd.sample(range(200), rnd.randint(1, 150))} for i in range(12)}
    shard = shard_of(docs, 200)
    for _ in range(30):
        w = np.array([rnd.choice([-1.0, 0.0, 0.5, 3.0]) for _ in docs])
        asked = P.Asked(20.0, pa.array(sorted(docs)), [0], np.array([0, 12]), np.arange(12), w)
        exact = np.zeros(200)
        for t, x in zip(sorted(docs), w):
            for c, f in docs[t].items():
                exact[c] += x * P.gain(f, shard.dls[c], 20.0)
        exact = exact.round(6)
        best = [c for c in sorted(range(200), key=lambda c: (-exact[c], c)) if exact[c] > 0][:6]
        found = P.top(shard, asked, 6)[0]
        assert (found[0][1].tolist() if found else []) == best


def test_upkeep_equals_a_rebuilt_index(spark, tiny, monkeypatch):
    monkeypatch.setattr(P, "FANOUT", 3)
    rnd = random.Random(9)
    chunks, questions = corpus(2, 500)
    q = spark.createDataFrame(questions, "query_id int, query string")
    frame = lambda rows: S.index(spark.createDataFrame(rows, CHUNK))
    now = {(d, c): (d, c, t, 1) for d, c, t, _ in chunks[:300]}
    held = P.TextIndex.of(frame(list(now.values())))
    sizes = []
    for step in range(5):
        if step % 2 == 0:  # new chunks, and new texts for old ones
            add = chunks[300 + 40 * step : 340 + 40 * step] + [(d, c, f"w{rnd.randrange(300)} w7 neu", 1) for d, c in rnd.sample(sorted(now), 20)]
            held.add(frame(add))
            now.update({(d, c): (d, c, t, 1) for d, c, t, _ in add})
        else:
            gone = rnd.sample(sorted(now), 30 if step == 1 else 150)
            held.remove(spark.createDataFrame([*gone, ("a", "unknown")], "domain string, chunk_id string"))
            for key in gone:
                del now[key]
        sizes.append((len(held.segments), sum(m is not None for _, m in held.segments)))
        assert rows(S.keyword_search(q, held, 5)) == rows(S.bm25(q, frame(list(now.values())), 5))
        corpus_, idf = held.stats()
        want = S.bm25_stats(frame(list(now.values())))
        assert sorted(map(tuple, corpus_.collect())) == sorted(map(tuple, want[0].collect()))
        assert {(r.domain, r.token): (r.df, round(r.idf, 9)) for r in idf.collect()} == {(r.domain, r.token): (r.df, round(r.idf, 9)) for r in want[1].collect()}
    assert (2, 1) in sizes and (1, 0) in sizes  # marks are kept beside segments, and both are compacted
    plans = held.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plans.replace("context", "")


def test_terms(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"] * 5,)], "t array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(P.terms(F.col("t"))).collect()] == [[("a", 1), ("b", 2)], [], [("x", 5)]]


def test_changed_documents_are_removed_with_their_new_chunks(spark, tmp_path):
    """Document 21 has one chunk, and two once its text is changed; 56 has a last chunk
    that is too short to count before."""
    from quarry import catalogue

    docs = [(d, " ".join(f"w{d}x{i}" for i in range(n)), "en", "src") for d, n in ((21, 800), (22, 700), (23, 800))]
    docs += [(56, " ".join("a" for _ in range(806)), "en", "src"), (26, " ".join(f"v{i}" for i in range(800)), "en", "src")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "neu w21x799 w22x1 21"), (2, "a 56"), (3, "v0 neu")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["w3_w10_index_upkeep"](spark, str(tmp_path)).collect()
    assert {r.chunk_id for r in got} == {"en_doc_22_0000", "en_doc_26_0000", "en_doc_26_0001"}


def test_added_rows_replace_named_chunks(spark, tiny):
    frame = lambda rows: S.index(spark.createDataFrame(rows, CHUNK))
    old = [("a", "f_0", "w1 w2", 1), ("a", "f_1", "w1 w3", 1), ("a", "g_0", "w1 w4 w4", 1)]
    new = [("a", "f_0", "w1 w5", 1)]
    held = P.TextIndex.of(frame(old))
    held.add(frame(new), replaced=frame(old[:2]))
    q = spark.createDataFrame([(0, "w1 w2 w3 w5 w4")], "query_id int, query string")
    assert rows(S.keyword_search(q, held, 5)) == rows(S.bm25(q, frame(new + old[2:]), 5))


def test_shards_end_at_postings_and_come_one_by_one(spark, tiny, monkeypatch):
    """A task's memory goes by postings, not by chunks: shards of long chunks are of
    fewer, and a task is sent one at a time."""
    chunks, questions = corpus(3, 400)
    ch = S.index(spark.createDataFrame(chunks, CHUNK).coalesce(1))
    q = spark.createDataFrame(questions, "query_id int, query string")
    monkeypatch.setattr(P, "POSTINGS", 600)
    monkeypatch.setattr(P, "READ_ROWS", 8)
    held = P.TextIndex.of(ch)
    sizes = [sum(r.dfs) for r in held.segments[0][0].select("dfs").collect()]
    longest = max(len(r.terms) for r in ch.select("terms").collect())
    assert len(sizes) > 10 and max(sizes) <= 600 + 8 * longest
    assert rows(S.keyword_search(q, held, 5)) == rows(S.bm25(q, ch, 5))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    with scratch.batch_rows(spark, 1):
        got = scratch.stored(held.rows().mapInArrow(counted, "n long"), "counted")
    assert {r.n for r in got.collect()} == {1} and spark.conf.get(key) == before


def test_dense_arm_keeps_the_best_across_merges(spark, monkeypatch):
    """Waiting hits are merged often, and scores below the k-th held are not taken up."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 4)), 1)  # with ties
    rows_ = [("abc"[i % 3] if i < 500 else "d", f"v{i:04d}", v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows_, "domain string, chunk_id string, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(np.round(rng.normal(size=(7, 4)), 1))], "query_id long, vector array<double>")
    want = rows(S.ranked(S.dense(q, v, None).drop("rank"), 5))
    monkeypatch.setattr(S, "SCORED_ROWS", 16)
    monkeypatch.setattr(S, "WAITING_HITS", 50)
    assert rows(S.dense(q, v, 5)) == want and len(want) == 7 * 4 * 5
