import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.streaming import batches

CASES = "query_id long, query string, category string, expected_intent string, expected array<string>"


def cases(spark, n):
    return spark.createDataFrame([(i, f"q{i}", [None, "a", "b c"][i % 3], "any", ["en"]) for i in range(n)], CASES)


def pipeline(q):
    en = F.when(F.col("query_id") % 4 == 0, F.array(F.lit("fr"))).otherwise(F.array(F.lit("en")))
    return q.select("query_id", en.alias("actual"), F.lit("single").alias("intent"), F.lit(False).alias("needs_clarification"), F.lit(True).alias("is_related"))


def test_progress_of_a_batch(spark, tmp_path):
    told = []
    got = batches.evaluate(cases(spark, 60), pipeline, told.append, str(tmp_path / "e"), parts=4)
    want = E.run_all(cases(spark, 60), pipeline)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    by = {r.c: (r.n, r.p) for r in want.groupBy(F.coalesce("category", F.lit("")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("p")).collect()}
    assert len(told) >= 3 and told[-1] == {c: (n, p, n) for c, (n, p) in by.items()}
    done = [sum(n for n, _, _ in t.values()) for t in told]
    assert done == sorted(done) and 0 < done[0] < 60 == done[-1]


def test_a_batch_that_broke_off_goes_on(spark, tmp_path):
    folder, told, asked = str(tmp_path / "e"), [], []

    def failing(q):
        asked.append(1)
        if len(asked) == 3:
            raise RuntimeError("lost")
        return pipeline(q)

    with pytest.raises(Exception, match="lost"):
        batches.evaluate(cases(spark, 40), failing, told.append, folder, parts=4)
    assert len(told) == 2
    before = sum(n for n, _, _ in told[-1].values())
    got = batches.evaluate(cases(spark, 40), failing, told.append, folder, parts=4)
    assert len(asked) == 5 and len(told) == 4  # two parts before, one that failed, two after
    assert sum(n for n, _, _ in told[2].values()) > before and sum(n for n, _, _ in told[-1].values()) == 40
    assert sorted(map(repr, got.collect())) == sorted(map(repr, E.run_all(cases(spark, 40), pipeline).collect()))


def test_more_files_than_parts(spark, tmp_path):
    told = []
    cases(spark, 60).repartition(20).write.parquet(str(tmp_path / "e" / "cases"))
    got = batches.evaluate(cases(spark, 60), pipeline, told.append, str(tmp_path / "e"), parts=3)
    assert got.count() == 60 and len(told) == 3


def test_no_cases_and_many_categories(spark, tmp_path, monkeypatch):
    told = []
    assert batches.evaluate(cases(spark, 0), pipeline, told.append, str(tmp_path / "e")).collect() == [] and told == []
    monkeypatch.setattr(batches, "MAX_CATEGORIES", 2)
    with pytest.raises(ValueError):
        batches.evaluate(cases(spark, 9), pipeline, folder=str(tmp_path / "m"))
