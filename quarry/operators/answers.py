"""Answer assembly with pluggable generators and the deterministic offline ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import jsonx
from quarry.functions import text as T

NO_EVIDENCE = "No source material was found for this question."
CLARIFY = "Could you say more precisely what you are asking about?"
UNRELATED = "This question is outside the indexed material."
NO_FILES = "There are no files in this session yet."
NOT_IN_FILES = "The chosen files do not cover this: "
NOT_RELEVANT = "Nothing relevant enough was found in "
REFUSED = "I cannot find this in the chosen files."


def extract(text: Column, n: int = 2) -> Column:
    """Offline generator: the first ``n`` sentences of a source."""
    return F.array_join(F.slice(T.sentences(text), 1, n), " ")


def failure(error: Column) -> Column:
    """The text that stands for an answer whose generator failed."""
    kind = T.error_class(error)
    return F.concat(F.lit("No answer could be generated ("), kind, F.lit(")."))


def domain_answers(evidence: DataFrame, generate=extract, asked: DataFrame | None = None, unaided=None) -> DataFrame:
    """(query_id, domain, answer, citations, n_used, no_evidence) from reranked hits.
    Of pairs ``asked`` (query_id, domain, question) those without a hit are answered
    by ``unaided(question)``, marked as without evidence and cite nothing. A
    generator that gives null has failed: its answer says so."""
    said = F.coalesce(generate(F.col("text")), failure(F.lit("generator")))
    part = F.concat(said, F.lit(" [Source "), F.col("rerank_rank").cast("string"), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("rerank_rank", part.alias("part"), T.citation_label(F.col("source_file")).alias("label"))))
    out = evidence.groupBy("query_id", "domain").agg(rows.alias("r"))
    out = out.select("query_id", "domain", F.array_join(F.transform("r", lambda x: x["part"]), " ").alias("answer"), F.array_distinct(F.transform("r", lambda x: x["label"])).alias("citations"), F.size("r").alias("n_used"))
    if asked is None:
        return out.withColumn("no_evidence", F.lit(False))
    alone = F.coalesce(unaided(F.col("question")), failure(F.lit("generator"))) if unaided else F.lit(NO_EVIDENCE)
    both = asked.select("query_id", "domain", "question").join(out, ["query_id", "domain"], "left")
    none = F.col("n_used").isNull()
    return both.select(
        "query_id", "domain", F.coalesce("answer", alone).alias("answer"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
        F.coalesce("n_used", F.lit(0)).alias("n_used"), none.alias("no_evidence"),
    )


def study_answers(evidence: DataFrame, asked: DataFrame, generate=extract) -> DataFrame:
    """As ``domain_answers``, from the chosen files alone: what they do not cover is
    refused, never answered from general knowledge."""
    return domain_answers(evidence, generate, asked, lambda question: F.lit(REFUSED))


def synthesize(answers: DataFrame, queries: DataFrame, merge=None) -> DataFrame:
    """(query_id, answer): answers without evidence are left out; of none the text
    that says so, the only one as it is, several by ``merge(parts)`` or under their
    domains. A merge that gives null has failed: the error and the parts follow."""
    if "no_evidence" not in answers.columns:
        answers = answers.withColumn("no_evidence", F.lit(False))
    rows = F.array_sort(F.collect_list(F.struct("domain", "answer")))
    asked = answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    got = answers.where(~F.col("no_evidence")).groupBy("query_id").agg(rows.alias("r")).join(asked, "query_id")
    # A question that was split is merged even if one part alone has evidence.
    one = F.when((F.size("r") == 1) & ((F.col("asked") == 1) | F.lit(merge is None)), F.element_at("r", 1)["answer"])
    many = F.array_join(F.transform("r", lambda x: F.concat(F.lit("**"), x["domain"], F.lit("**\n"), x["answer"])), "\n\n")
    if merge:
        many = F.coalesce(merge(many), F.concat(failure(F.lit("generator")), F.lit("\n\n---\n\n"), many))
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce(one, F.when(F.size("r") > 0, many), F.lit(NO_EVIDENCE)).alias("answer"))


def with_references(answer: Column, citations: Column) -> Column:
    """The study answer: a reference list follows if there are citations."""
    lines = F.array_join(F.transform(citations, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    return F.when(F.size(citations) > 0, F.concat(answer, F.lit("\n\nReferences\n"), lines)).otherwise(answer)


def skipped_verdict() -> Column:
    """The verifier switched off: everything satisfactory."""
    return F.struct(F.lit(True).alias("is_satisfactory"), *[F.lit(1.0).alias(k) for k in ("quality", "coverage", "grounding")], F.lit(True).alias("skipped"))


def failed_verdict() -> Column:
    """The verifier's answer could not be read."""
    return F.struct(F.lit(True).alias("is_satisfactory"), F.lit(0.7).alias("quality"), F.lit(1.0).alias("coverage"), F.lit(1.0).alias("grounding"), F.lit(False).alias("skipped"))


def verify(reply: Column, enabled: bool = True) -> Column:
    """The verdict in a model's ``reply``: everything satisfactory if ``enabled`` is
    off, the failed verdict if the reply is null or unreadable."""
    if not enabled:
        return skipped_verdict()
    j, failed = jsonx.verdict(reply), failed_verdict()
    fields = [*("is_satisfactory", "quality", "coverage", "grounding")]
    read = jsonx.parsed(reply)
    return F.struct(*[F.when(read, j[k]).otherwise(failed[k]).alias(k) for k in fields], F.when(read, j["revised_answer"]).alias("revised_answer"), F.lit(False).alias("skipped"))


def final_answer(answer: Column, satisfactory: Column, revised: Column) -> Column:
    return F.when(~satisfactory & (F.length(revised) > 50), revised).otherwise(answer)


def canned(is_related: Column, needs_clarification: Column, hint: Column) -> Column:
    """Early exits: null where the question goes on."""
    return F.when(~is_related, F.lit(UNRELATED)).when(needs_clarification, F.concat(F.lit(CLARIFY), F.coalesce(F.concat(F.lit(" "), hint), F.lit(""))))
