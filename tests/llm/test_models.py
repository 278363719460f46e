import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarry.llm import language_id as li
from quarry.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = li.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 350 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    rows = [(i, t, lang, 1.0, "c") for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("12 ;\n", None), ("the and of that " * 9000, "en"), ("der und die das", "de"), ("the of", "en"), ("die und", "de"), ("the end", "en"), ("und so", "de"), ("and so the", "en")] * 2)] + [(None, "the and", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = li.train(df)
    got = li.identify(df, model).collect()
    assert len(got) == 21 and [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3].lang_pred == "en"
    kept = li.reject_unknown(df, model)
    assert kept.columns == df.columns and kept.count() == 15 and kept.first().score == 1.0
    assert {r.doc_id: r.lang for r in kept.collect()}[None] == "en"
    assert li.identify(df.limit(0), li.train(df.limit(0))).collect() == []
    assert {r.lang_pred for r in li.identify(df, li.fit([])).collect()} == {"und"}


def test_unknown_without_labels(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate([None, "", "12 ;\n", "the end", "é", "1 und"])], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in li.reject_unknown(df, li.fit([])).collect()) == [3, 4, 5]
    assert sorted(r.doc_id for r in cp.language(spark, df, None).collect()) == [3, 4, 5]


def test_missing_languages_are_predicted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    true = {r.doc_id: r.lang for r in docs.collect()}
    got = cp.language(spark, some, SF).collect()
    assert all(r.lang == true[r.doc_id] for r in got if r.doc_id % 3)
    assert np.mean([r.lang == true[r.doc_id] for r in got if r.doc_id % 3 == 0]) > 0.95
    dated = some.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))  # no strings: left alone
    assert {r.lang is None for r in li.reject_unknown(dated, li.train(some)).collect() if r.doc_id % 3 == 0} == {True}


def test_many_languages(spark):
    word = lambda k, i: "".join(chr(0x4E00 + 40 * k + (i * j) % 40) for j in (1, 3, 7))
    rows = [(100 * k + i, " ".join(word(k, i + j) for j in range(12)), f"l{k}") for k in range(70) for i in range(90 if k else 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df)
    got = li.identify(df, model).collect()
    assert len(model.langs) == 70 and np.mean([r.lang == r.lang_pred for r in got]) > 0.99


def test_a_language_a_row(spark, monkeypatch):
    """20,000 values of lang: bounded sums and landmarks, and the real ones still found."""
    rows = [(i, f"{'the and of' if i % 2 else 'der und die'} {i}", "en" if i % 2 else "de") for i in range(4000)]
    rows += [(10000 + i, f"{chr(0x4E00 + i)} {chr(0x4E00 + i // 7)}", f"x{i}") for i in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df)
    assert len(model.langs) > 14000 and model.landmarks.shape[1] <= li.MOST_LANDMARKS and model.weights.nbytes < 80e6
    got = li.identify(df.where("doc_id < 400"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    # Blocks of languages give the same as all at once.
    small = df.where("doc_id < 10060")
    whole = li.train(small)
    monkeypatch.setattr(li, "CLASS_BLOCK", 7)
    parts = li.train(small)
    assert parts.langs == whole.langs and np.allclose(parts.weights, whole.weights, atol=1e-3)
    texts = [r.text for r in df.where("doc_id % 100 = 7").collect()]
    by_block = whole.predict(texts)
    monkeypatch.setattr(li, "CLASS_BLOCK", 10**6)
    at_once = whole.predict(texts)
    assert by_block[0] == at_once[0] and np.allclose(by_block[1], at_once[1])


def test_numerals_are_no_letters(spark):
    assert not any(map(li.has_language, ["½ ²", "①②", "Ⅷ", "12_", "٣", None, "", "́"])) and all(map(li.has_language, ["a½", "ª", "ǅ", "中", "ʰ"]))


def test_one_doc_id(spark):
    """Rows are sampled, not ids: one id with many labelled rows still trains."""
    for i in [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:3]:
        rows = [(i, f"{'the and of' if k % 2 else 'der und die'} {k}", "en" if k % 2 else "de") for k in range(1000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = li.identify(df, li.train(df)).collect()
        assert li.train(df).langs == ["de", "en"] and np.mean([r.lang == r.lang_pred for r in got]) > 0.99


def test_presence_is_a_set():
    a, b = li.presence(["abc", "abcabc"])
    assert a.sum() <= 6 and (b >= a).all()


def test_toxicity_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = tx.op10_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97 and ((s >= 0) & (s <= 1)).all() and all(r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "you idiot", "x"), (3, "word " * 40000, None), (4, "you 1d10t!", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    got = tx.score(df, tx.train(df, labels)).collect()
    assert len(got) == 6 and got[0].toxicity == got[1].toxicity == 0 and got[3].toxicity == got[5].toxicity == 0.5
    assert tx.score(df.limit(0), tx.train(df.limit(0), labels.limit(0))).collect() == []


def test_trees_split_like_brute_force():
    """A tree's first split has the greatest gain of all splits on the bins."""
    rng = np.random.default_rng(1)
    x = np.round(rng.random((300, 4)) * 8)
    y = ((x[:, 2] > 3) ^ (rng.random(300) < 0.1)).astype(float)
    t = tx.Trees().fit(x, y)
    p = y.mean()
    base = np.log((p + 1e-3) / (1 - p + 1e-3))
    q = 1 / (1 + np.exp(-base))
    g, h = y - q, np.full(len(y), q * (1 - q))
    gains = {(j, c): g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1) for j in range(4) for c in np.unique(x[:, j])[:-1] if (m := x[:, j] <= c).any()}
    j, c = max(gains, key=gains.get)
    root = t.trees[0]
    left = t._bin(x)[:, root[0]] <= root[1]
    assert root[0] == j == 2 and (left == (x[:, j] <= c)).all()
    leaf = lambda m: g[m].sum() / (h[m].sum() + 1)
    one = tx.Trees()
    one.cuts = t.cuts
    tree = one._grow(t._bin(x), g, h, np.arange(len(y)), 1)
    assert abs(tree[2] - leaf(left)) < 1e-9 and abs(tree[3] - leaf(~left)) < 1e-9


def test_kernel_ridge_is_exact(spark):
    """With every training text a landmark the weights solve the weighted ridge problem."""
    texts = [f"the end of {w}" for w in ("all", "it", "this")] + [f"und das {w}" for w in ("ende", "wort", "haus")]
    bits = [np.packbits(li.presence([t] * 3).astype(bool)).reshape(-1).tobytes() for t in texts]
    model = li.fit(list(zip(["en"] * 3 + ["de"] * 3, bits)))
    sets = [set(np.flatnonzero(r)) for r in li.presence(texts)]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    order = [3, 4, 5, 0, 1, 2]  # landmarks by language
    assert np.allclose(li._kernel(li.presence(texts), model.landmarks), k[:, order], atol=1e-5)
    value, vector = np.linalg.eigh(k[np.ix_(order, order)])
    phi = np.c_[k[:, order] @ (vector / np.sqrt(np.maximum(value, 1e-6))), np.ones(6)]
    y = np.array([[0, 1]] * 3 + [[1, 0]] * 3, float)
    w = np.linalg.solve(3 * phi.T @ phi + li.RIDGE * np.eye(7) * 18 / 1000, 3 * phi.T @ y)
    assert np.allclose(np.c_[k[:, order], np.ones(6)] @ model.weights, phi @ w, atol=1e-3)
    assert model.predict(["the all", "das haus"])[0] == ["en", "de"]


def test_lexicons_do_not_see_their_fold(spark):
    rows = [(f"w{i} plain text {'vile' if i % 2 else 'kind'} only{i % 4}", i % 2, (i % tx.FOLDS) << 7) for i in range(400)]
    rows += [(f"marker{i} odd", 1, 2 << 7) for i in range(30)] + [(f"marker odd{i}", 1, 2 << 7) for i in range(30)]
    whole, *others = tx.lexicons(spark.createDataFrame(rows, "text string, toxic int, h long"))
    weigh = lambda lex, w: lex.weigh(tx.hash_one([w.encode()]))[0]
    assert weigh(whole, "vile") > 0 == weigh(whole, "kind") and weigh(whole, "marker") > 0
    assert [weigh(x, "marker") > 0 for x in others] == [True, True, False, True]
    assert [tx._fold(h) for _, _, h in rows[:4]] == [0, 1, 2, 3]


def test_rare_class(spark):
    """One toxic row in 200: enough of them are learned from, and scores stay calibrated."""
    rnd = np.random.default_rng(5)
    word = lambda: f"w{rnd.integers(900)}"
    rows = [(i, " ".join([word() for _ in range(30)] + (["scorn", "wretch"] if i % 100 == 0 else []))) for i in range(24000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 200 == 0)) for i, _ in rows], "doc_id long, toxic int")
    known = labels.select("doc_id", "toxic", tx.F.xxhash64("doc_id").alias("h"))
    got = {r.toxic: r.n for r in tx._sample(known, {0: 23880, 1: 120}).groupBy("toxic").agg(tx.F.count("*").alias("n")).collect()}
    assert got[1] == 120 and 4800 < got[0] <= 5000
    model = tx.train(docs, labels)
    s = model.score(pa.array([t for _, t in rows[:4000]]))
    hot = np.arange(4000) % 100 == 0
    assert 0.3 < s[hot].mean() < 0.7 and s[~hot].mean() < 0.02  # half of the marked texts are toxic


def test_features_and_isotonic():
    lex = tx.Lexicon({"idiot": 2.0}, {"vilest".encode()[:5]: 1.5})
    x = tx.features(pa.array(["you idiot", "idiot " + "a " * 20 + "you", "YOU 1d1ot", "vilester", None]), lex)
    assert np.expm1(x[:, 3]).round(3).tolist() == [1, 1, 1, 1, 0] and np.expm1(x[:, 4]).round(3).tolist() == [1, 0, 0, 0, 0]
    at, v = tx.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(v) >= 0).all() and len(at) == 3
