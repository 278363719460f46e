"""JSON out of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salvage(text: Column) -> Column:
    """The JSON text of an answer: without code fences if that parses, else its
    outermost braces, else {}."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*```(?:json)?\s*", ""), r"(?m)\s*```\s*$", "")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(bare), ok(inner), F.lit("{}"))


ROUTE = "intent_type string, domains array<string>, is_course_related boolean, needs_clarification boolean"
SPLIT = "sub_questions array<struct<question:string,domain:string>>"
VERDICT = "is_satisfactory boolean, quality_score double, coverage_score double, grounding_score double, issues array<string>, revised_answer string"


def route(text: Column, domains: list[str]) -> Column:
    """A router's answer with defaults; unknown domains dropped."""
    j = F.from_json(salvage(text), ROUTE)
    known = F.filter(F.transform(F.coalesce(j["domains"], F.array().cast("array<string>")), F.upper), lambda d: d.isin([x.upper() for x in domains]))
    return F.struct(
        F.when(j["intent_type"].isin("single", "multi"), j["intent_type"]).otherwise("single").alias("intent_type"),
        known.alias("domains"),
        F.coalesce(j["is_course_related"], F.lit(True)).alias("is_course_related"),
        F.coalesce(j["needs_clarification"], F.lit(False)).alias("needs_clarification"),
    )


def parsed(text: Column) -> Column:
    """The reply was an object with some field."""
    return F.coalesce(~salvage(text).isin("{}", ""), F.lit(False))


def split_questions(text: Column) -> Column:
    j = F.from_json(salvage(text), SPLIT)["sub_questions"]
    named = F.transform(j, lambda q: F.struct(F.trim(q["question"]).alias("question"), F.upper(F.trim(q["domain"])).alias("domain")))
    return F.filter(named, lambda q: F.coalesce(q["question"], F.lit("")) != "")


def verdict(text: Column) -> Column:
    """A verifier's answer: scores default to 0.7 and are clamped to 0..1; the
    revision stays only with an unsatisfactory answer."""
    j = F.from_json(salvage(text), VERDICT)
    score = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(j[k], F.lit(0.7))))
    ok = F.coalesce(j["is_satisfactory"], F.lit(True))
    return F.struct(
        ok.alias("is_satisfactory"), score("quality_score").alias("quality"), score("coverage_score").alias("coverage"), score("grounding_score").alias("grounding"),
        F.coalesce(j["issues"], F.array().cast("array<string>")).alias("issues"),
        F.when(~ok & (F.trim(F.coalesce(j["revised_answer"], F.lit(""))) != ""), j["revised_answer"]).alias("revised_answer"),
    )
