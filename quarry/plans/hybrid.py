"""End-to-end plans: route, search, rerank, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.operators import evaluation as E
from quarry.operators import routing as R
from quarry.operators import search as S
from quarry.sources import scratch


def evidence(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, keywords: R.Keywords, threshold: float = S.THRESHOLD, held: S.TextIndex | None = None) -> DataFrame:
    """Reranked hits of each question in the domains that it is routed to."""
    wanted = R.searched(R.route(queries, keywords), keywords)
    return S.rerank(S.hybrid(queries, query_vectors, chunks, vectors, wanted=wanted, held=held), threshold=threshold)


def answer(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, keywords: R.Keywords, generate=A.extract, router=None, splitter=None, verifier=None, merge=None, held: S.TextIndex | None = None) -> DataFrame:
    """(query_id, intent_type, domains, answer, quality, n_used, early): the whole
    chat pipeline over all questions. ``router``, ``splitter`` and ``verifier`` are
    column functions that give a model's reply; without one, or where the reply is
    null or unreadable, the keyword form stands in. Questions outside the material
    and those that need clarification are answered without a search."""
    routed = R.route(queries, keywords) if router is None else R.route_by(queries, keywords, router(F.col("query")))
    clarify = R.should_clarify(F.size("domains"), F.col("needs_clarification"), F.col("is_related"), F.col("query"))
    routed = scratch.stored(routed.withColumn("early", A.canned(F.col("is_related"), clarify, F.lit(None).cast("string"))), "routed")
    go = routed.where("early IS NULL")
    parts = R.split(go, keywords) if splitter is None else R.split_by(go, keywords, splitter(F.col("query")))
    asked = parts.groupBy("query_id", "domain").agg(F.min_by("question", "pos").alias("question"))
    asked = scratch.stored(asked, "parts")
    hits = S.rerank(S.hybrid(queries, query_vectors, chunks, vectors, wanted=asked.select("query_id", "domain"), held=held))
    answers = scratch.stored(A.domain_answers(hits, generate, asked), "answers")
    said = A.synthesize(answers, go, merge)
    used = answers.groupBy("query_id").agg(F.sum("n_used").alias("n_used"))
    verdict = A.skipped_verdict() if verifier is None else A.verify(verifier(F.col("query"), F.col("answer")))
    done = go.join(said, "query_id").join(used, "query_id", "left").withColumn("v", verdict)
    revised = F.lit(None).cast("string") if verifier is None else F.col("v.revised_answer")
    done = done.select("query_id", "intent_type", "domains", A.final_answer(F.col("answer"), F.col("v.is_satisfactory"), revised).alias("answer"), F.col("v.quality").alias("quality"), F.coalesce("n_used", F.lit(0)).alias("n_used"), F.lit(False).alias("early"))
    short = routed.where("early IS NOT NULL").select("query_id", "intent_type", "domains", F.col("early").alias("answer"), F.lit(0.0).alias("quality"), F.lit(0).cast("long").alias("n_used"), F.lit(True).alias("early"))
    return done.unionByName(short)


def study(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 8, files: DataFrame | None = None, encoder=None, generate=A.extract, verifier=None, held: S.TextIndex | None = None) -> DataFrame:
    """(query_id, answer, quality, sources, n_used, stopped): the study pipeline over
    one session's chunks. No routing, six-fold candidates, the asked files strictly,
    a cross-encoder (or the keyword score) with a threshold of -5, and a verifier
    that only scores. A question without hits stops early and says why."""
    chunks = S.index(chunks)
    hits = scratch.stored(S.hybrid(queries, query_vectors, chunks, vectors, k, 6, files, strict=True, held=held), "study")
    best = scratch.stored(S.rerank(hits, k=max(k, S.RERANK_K), threshold=-5.0, keep=0, encoder=encoder), "study-best")
    said = A.domain_answers(best, generate)
    chosen = queries.select("query_id", "query").withColumn("names", F.lit(None).cast("array<string>")) if files is None else queries.select("query_id", "query").join(files, "query_id", "left")
    asks = F.coalesce(F.size("names"), F.lit(0)) > 0
    named = F.array_join("names", ", ")
    some = hits.select("query_id").distinct().withColumn("some", F.lit(True))
    sources = best.groupBy("query_id").agg(F.array_sort(F.collect_set(T.basename(F.col("source_file")))).alias("sources"))
    all_ = chosen.join(said, "query_id", "left").join(some, "query_id", "left").join(sources, "query_id", "left")
    empty = chunks.limit(1).count() == 0
    stopped = F.when(F.lit(empty), "empty").when(F.col("some").isNull() & asks, "filtered").when(F.col("answer").isNull(), "irrelevant")
    why = F.when(F.col("stopped") == "empty", A.NO_FILES).when(F.col("stopped") == "filtered", F.concat(F.lit(A.NOT_IN_FILES), named))
    why = why.otherwise(F.concat(F.lit(A.NOT_RELEVANT), F.when(asks, named).otherwise("the uploaded documents")))
    verdict = A.skipped_verdict() if verifier is None else A.verify(verifier(F.col("query"), F.col("answer")))
    full = A.with_references(F.col("answer"), F.col("citations"))
    quality = E.quality_floor(F.col("v.quality"), F.lit(True), F.col("answer"))
    out = all_.withColumn("stopped", stopped).withColumn("v", verdict)
    return out.select(
        "query_id", F.when(F.col("stopped").isNull(), full).otherwise(why).alias("answer"), F.when(F.col("stopped").isNull(), quality).otherwise(F.lit(0.0)).alias("quality"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("n_used", F.lit(0)).alias("n_used"), "stopped",
    )
