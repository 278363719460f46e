"""Answer metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import jsonx
from quarry.functions import text as T
from quarry.operators.search import dot


def hit_rate(keywords: Column, texts: Column) -> Column:
    """The share of keywords inside the joined texts."""
    joined = F.lower(F.array_join(texts, " "))
    found = F.size(F.filter(keywords, lambda k: F.contains(joined, F.lower(k))))
    return F.when((F.size(keywords) > 0) & (F.size(texts) > 0), T.exact_round(found / F.size(keywords), 3)).otherwise(F.lit(0.0))


def citation_accuracy(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, citation_accuracy) of (answer_id, answer) and (answer_id,
    source_num, pos, text): the share of citations whose first source of that
    number has a significant word of the citing sentence; 1 without citations."""
    first = sources.groupBy("answer_id", "source_num").agg(F.min_by(F.lower("text"), "pos").alias("source_text"))
    some = sources.select("answer_id").distinct().withColumn("some", F.lit(True))
    said = answers.select("answer_id", F.explode(T.sentences(F.col("answer"))).alias("s"))
    cited = said.select("answer_id", T.significant(F.col("s")).alias("w"), F.explode(T.citations(F.col("s"))).alias("source_num"))
    ok = F.exists("w", lambda w: F.contains(F.col("source_text"), w))
    per = cited.join(first, ["answer_id", "source_num"], "left").groupBy("answer_id").agg(T.exact_round(F.count_if(F.coalesce(ok, F.lit(False))) / F.count(F.lit(1)), 3).alias("acc"))
    out = answers.select("answer_id").join(per, "answer_id", "left").join(some, "answer_id", "left")
    return out.select("answer_id", F.when(F.col("some"), F.coalesce("acc", F.lit(1.0))).otherwise(F.lit(1.0)).alias("citation_accuracy"))


def head(answer: Column, sentences: int = 2, chars: int = 300) -> Column:
    return F.substring(F.array_join(F.slice(T.sentences(answer), 1, sentences), " "), 1, chars)


def mean_if(pred: Column, x: Column, digits: int = 4) -> Column:
    """The mean over rows where ``pred`` holds; 0 if there are none."""
    return F.coalesce(T.exact_mean(F.when(pred, x), digits), F.lit(0.0))


def percent(pred: Column) -> Column:
    return F.coalesce(T.exact_round(100 * F.count_if(pred) / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(0.0))


def case_verdict(cases: DataFrame) -> DataFrame:
    """Adds intent_ok, domain_ok and passed to (expected_intent, intent, expected,
    actual, needs_clarification, is_related, check_ok)."""
    intent = (F.col("expected_intent") == "any") | (F.col("expected_intent") == F.col("intent"))
    none = (F.size("actual") == 0) | F.col("needs_clarification") | ~F.col("is_related")
    domain = F.when(F.size("expected") == 0, none).otherwise(F.size(F.array_except("expected", "actual")) == 0)
    return cases.withColumn("intent_ok", intent).withColumn("domain_ok", domain).withColumn("passed", intent & domain & F.col("check_ok"))


def quality_floor(q: Column, has_evidence: Column, answer: Column, floor: float = 0.75) -> Column:
    return F.when(has_evidence & ~F.contains(F.lower(answer), F.lit("cannot find")), F.greatest(q, F.lit(floor))).otherwise(q)


def containment(answer: Column, evidence: Column) -> Column:
    """Offline stand-in for a faithfulness judge: the share of the answer's
    tokens that the evidence holds (1 for an empty answer)."""
    a = F.array_distinct(T.tokens(answer))
    return F.when(F.size(a) > 0, T.exact_round(F.size(F.array_intersect(a, T.tokens(evidence))) / F.size(a), 3)).otherwise(F.lit(1.0))


def faithfulness(answer: Column, texts: Column, reply: Column) -> Column:
    """A judge's score from 0 to 10 in ``reply``, as a share: 1 where there is
    nothing to check, 0.9 if the reply names no score, 0.85 if it failed (null)."""
    nothing = (F.coalesce(F.size(texts), F.lit(0)) == 0) | (F.trim(F.coalesce(answer, F.lit(""))) == "")
    said = F.from_json(jsonx.salvage(reply), "score double")["score"]
    score = F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(said, F.lit(9.0)).cast("int")))
    return F.when(nothing, F.lit(1.0)).when(reply.isNull(), F.lit(0.85)).otherwise(F.round(score / 10, 3))


def judged_excerpt(answer: Column, texts: Column) -> tuple[Column, Column]:
    """What a judge reads: 2000 characters of the answer and 1500 of each of the
    first eight texts."""
    return F.substring(answer, 1, 2000), F.array_join(F.transform(F.slice(texts, 1, 8), lambda x: F.substring(x, 1, 1500)), "\n---\n")


def latency_ms(start: Column, end: Column) -> Column:
    """Wall clock between two timestamps, to a tenth; 0 where one is missing."""
    return F.coalesce(F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000, 1), F.lit(0.0))


def relevance(query_vector: Column, head_vector: Column) -> Column:
    """Cosine of the question and the answer's head (see ``head``), at least 0; 0
    where either could not be embedded."""
    same = F.size(query_vector) == F.size(head_vector)
    return F.coalesce(F.when(same, F.greatest(F.lit(0.0), T.exact_round(dot(query_vector, head_vector), 3))), F.lit(0.0))


METRICS = ["quality_score", "coverage_score", "grounding_score", "retrieval_hit_rate", "citation_accuracy", "answer_relevance", "faithfulness", "latency_ms"]


def by_model(rows: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Means of each model's rows with a positive quality score; a metric counts
    only its numbers. Also how many rows there are and how many were revised."""
    good = rows.where(F.col("quality_score").try_cast("double") > 0)
    means = [T.exact_mean(F.col(m).try_cast("double"), 3).alias(m) for m in metrics]
    return good.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *means, F.count_if(F.col("revised")).alias("revised"))


def run_all(cases: DataFrame, pipeline) -> DataFrame:
    """All cases through ``pipeline`` (questions in, one row of results a question
    out) in one plan. A case without a result, or with an error, has failed."""
    got = pipeline(cases.select("query_id", "query"))
    both = cases.join(got, "query_id", "left")
    error = F.col("error") if "error" in got.columns else F.lit(None).cast("string")
    verdict = case_verdict(both.withColumn("check_ok", F.lit(True)))
    fine = error.isNull() & F.col("actual").isNotNull()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) & fine
    return verdict.select(*cases.columns, yes("intent_ok").alias("intent_ok"), yes("domain_ok").alias("domain_ok"), yes("passed").alias("passed"), F.when(fine, None).otherwise(F.coalesce(error, F.lit("no result"))).alias("error")).orderBy("query_id")
