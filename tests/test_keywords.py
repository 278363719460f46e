"""Routing by keyword tables."""

import random

from quarry import catalogue
from quarry.operators import keywords as K
from quarry.operators import routing as R

NAMES = ["query_id", "domains", "intent_type", "is_related", "needs_clarification"]


def rows(df, names=NAMES):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_as_columns(spark, sf_dir, monkeypatch):
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query")
    q = q.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "THE end"), (-3, "THE end"), (-4, "a b")], "query_id long, query string"))
    table = spark.createDataFrame([(d, k) for d, ks in catalogue.KEYWORDS.items() for k in ks] + [("de", "UND"), (None, "x"), ("en", None)], "domain string, keyword string")
    order = list(catalogue.KEYWORDS)
    want = R.route(q, catalogue.KEYWORDS).withColumn("domains", R.domains(q.query, catalogue.KEYWORDS)).withColumn("guess", R.guess(q.query, catalogue.KEYWORDS))
    for block in (200_000, 5):
        monkeypatch.setattr(K, "BLOCK", block)
        got = K.route(q, table, order)
        some = [r for r in rows(got, [*NAMES, "guess"]) if r[0] != -1]
        assert some == [r for r in rows(want, [*NAMES, "guess"]) if r[0] != -1]
    null = got.where("query_id = -1").first()
    assert (null.domains, null.is_related, null.guess) == ([], False, "de")
    assert rows(K.route(q.limit(0), table, order)) == [] and {r.guess for r in K.route(q, table.limit(0)).collect()} == {None}


def test_100_000_keywords(spark):
    rnd = random.Random(3)
    word = lambda i: "".join(chr(97 + (i * 7919 + j * j * 31) % 26) for j in range(3)) + str(i)
    keys = [(f"d{i % 500}", word(i)) for i in range(100_000)]
    asked = [[rnd.randrange(100_000) for _ in range(4)] for _ in range(300)]
    q = spark.createDataFrame([(i, " and ".join(word(k) + "." for k in ks)) for i, ks in enumerate(asked)], "query_id long, query string")
    routed = K.route(q, spark.createDataFrame(keys, "domain string, keyword string"))
    got = {r.query_id: set(r.domains) for r in routed.collect()}
    for i, ks in enumerate(asked):
        assert {f"d{k % 500}" for k in ks} <= got[i]
    text = {r.query_id: r["query"] for r in q.collect()}
    for i in range(5):
        assert got[i] == {d for d, k in keys if k in text[i]}
    assert len(routed._jdf.queryExecution().optimizedPlan().toString()) < 20_000
