"""Keyword and dense search, fusion, reranking: many queries over many domains in one plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.postings import BROADCAST_ROWS, EPSILON, TextIndex, gain, idf_of, small, terms  # noqa: F401
from quarry.sources import scratch

SEMANTIC, KEYWORD, RRF_K = 0.60, 0.40, 60
RRF_WEIGHT, OVERLAP_WEIGHT = 0.60, 0.40
BONUS, BONUS_CAP, BONUS_CHARS = 0.05, 0.20, 4
TOP_K, RERANK_K, THRESHOLD, OVERFETCH = 8, 5, 0.20, 3
#: Queries of a block: their vectors are collected and broadcast.
QUERY_BLOCK = 2000
SCORED_ROWS = 2048
#: Hits that a task gathers before it cuts them to the k best.
HELD_HITS = 500_000
#: Hits of the dense arm that wait beside the k best.
WAITING_HITS = 100_000


def index(chunks: DataFrame) -> DataFrame:
    """``chunks`` with their terms (token, f) and number of tokens (dl), stored: each
    text is made and tokenised once, and every reader takes only the columns it needs."""
    if {"terms", "dl"} <= set(chunks.columns):
        return chunks
    counted = terms(T.tokens(F.col("text")))
    made = chunks.withColumn("terms", counted).withColumn("dl", F.aggregate("terms", F.lit(0), lambda n, x: n + x["f"]))
    return scratch.stored(made, "index")


class Indexes:
    """Indexes by name (a domain, a session), each made when it is first asked for
    and kept until it is evicted."""

    def __init__(self) -> None:
        self._held: dict[str, DataFrame] = {}

    def of(self, name: str, chunks: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._held:
            self._held[name] = index(chunks())
        return self._held[name]

    def evict(self, name: str) -> None:
        """Forget an index and remove its table; an unknown name is none."""
        if name in self._held:
            scratch.drop_stored(self._held.pop(name))


def bm25_stats(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (domain, chunk_id, text) or an index of it: per domain n and avgdl; per
    domain and token df and idf."""
    t = index(chunks)
    corpus = t.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = t.select("domain", F.explode("terms.token").alias("token")).groupBy("domain", "token").agg(F.count(F.lit(1)).alias("df"))
    return corpus, idf_of(corpus, df)


def bm25(queries: DataFrame, chunks: DataFrame, k: int | None, wanted: DataFrame | None = None) -> DataFrame:
    """(query_id, domain, chunk_id, score, rank) for (query_id, query): the k best
    of each domain with a positive score; with ``wanted`` (query_id, domain) only
    of these pairs. Scores every chunk that has an asked token, without postings:
    for chunks that are searched once, and to compare with."""
    chunks = index(chunks)
    corpus, idf = bm25_stats(chunks)
    asked = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qf"))
    if wanted is not None:
        asked = asked.join(wanted, "query_id")
    on = ["token"] if wanted is None else ["domain", "token"]
    # What a question's token is worth in each domain: the only side that is broadcast.
    worth = scratch.stored(asked.join(idf, on).join(corpus, "domain").select("domain", "token", "query_id", "qf", "idf", "avgdl"), "asked")
    tf = chunks.select("domain", "chunk_id", "dl", F.explode("terms").alias("t")).select("domain", "chunk_id", "dl", "t.token", "t.f")
    part = tf.join(small(worth), ["domain", "token"]).select("query_id", "domain", "chunk_id", (F.col("qf") * F.col("idf") * gain(F.col("f"), F.col("dl"), F.col("avgdl"))).alias("gain"))
    scores = part.groupBy("query_id", "domain", "chunk_id").agg(F.round(F.sum("gain"), 6).alias("score")).where("score > 0")
    return ranked(scores, k)


def keyword_search(queries: DataFrame, held: TextIndex, k: int | None, wanted: DataFrame | None = None) -> DataFrame:
    """As ``bm25``, from a stored index."""
    return ranked(held.search(queries, k, wanted), k)


def ranked(scores: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("query_id", "domain").orderBy(F.desc("score"), "chunk_id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def kept_places(q: np.ndarray, d: np.ndarray, ids: pa.Array, x: np.ndarray, k: int) -> np.ndarray:
    """Of hits (question, domain, id, score) the places of the k best of each question
    and domain; ties go by id."""
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((rank, -x, d, q))
    q, d = q[order], d[order]
    first = np.flatnonzero(np.concatenate([[len(q) > 0], (q[1:] != q[:-1]) | (d[1:] != d[:-1])]))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[place < k]


def _kept(q: np.ndarray, d: np.ndarray, ids: pa.Array, x: np.ndarray, k: int):
    at = kept_places(q, d, ids, x, k)
    return q[at], d[at], ids.take(pa.array(at)), x[at]


def _products(held, k: int | None):
    """Scores of each batch as one matrix product. A slice gives the k best of each
    question and domain by their thresholds, for all questions at once, and a task
    keeps the k best of these, and takes up no score below the k-th that it holds;
    without k every slice goes on at once."""

    def run(batches):
        asked, domains_of = held.value
        names: list = []
        kept, waiting, n = None, [], 0
        floors: dict[int, np.ndarray] = {}  # by domain the k-th score of each question

        def raise_floors():
            pair, first, count = np.unique(kept[0] * len(names) + kept[1], return_index=True, return_counts=True)
            floors.update({d: np.full(len(asked), -np.inf) for d in range(len(names))})
            for p, a in zip(pair[count == k], first[count == k]):  # a pair's hits lie together, best first
                floors[p % len(names)][p // len(names)] = kept[3][a + k - 1]

        def merged():
            parts = ([kept] if kept else []) + waiting
            return _kept(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), pa.concat_arrays([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), k)

        def rows(q, d, ids, x):
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(names, pa.string()).take(pa.array(d)), ids, pa.array(x, pa.float64())], ["q", "domain", "chunk_id", "score"])

        for batch in batches:
            batch = batch.filter(batch.column("vector").is_valid())
            # Slices, so that the table of scores stays small.
            for b in (batch.slice(a, SCORED_ROWS) for a in range(0, batch.num_rows, SCORED_ROWS)):
                v = b.column("vector")
                v = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                s = np.round(v @ asked.T, 6)
                coded = b.column("domain").dictionary_encode()
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for j, name in enumerate(coded.dictionary.to_pylist()):
                    at = np.flatnonzero(code == j)
                    part = s[at]
                    if domains_of is not None:
                        part = np.where([name in x for x in domains_of], part, -np.inf)
                    hit = part > -np.inf
                    if k is not None and len(at) > k:
                        hit &= part >= np.partition(part, len(at) - k, axis=0)[len(at) - k]
                    if name not in names:
                        names.append(name)
                    if names.index(name) in floors:
                        hit &= part >= floors[names.index(name)]
                    row, q = np.nonzero(hit)
                    found = q, np.full(len(q), names.index(name)), b.column("chunk_id").take(pa.array(at[row])), part[row, q]
                    if k is None:
                        yield rows(*found)
                        continue
                    found = _kept(*found, k)
                    waiting.append(found)
                    n += len(found[0])
                    if n > WAITING_HITS:
                        kept, waiting, n = merged(), [], 0
                        raise_floors()
        if k is not None and (kept or waiting):
            yield rows(*merged())

    return run


def dense(queries: DataFrame, vectors: DataFrame, k: int | None, wanted: DataFrame | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, domain, chunk_id, score, rank) by cosine of unit vectors: the
    query set, in broadcast blocks of ``block``, against all (domain, chunk_id,
    vector); with ``wanted`` (query_id, domain) only for these pairs. Rows without
    a vector are in no result."""
    spark = vectors.sparkSession
    ids = queries.where("vector IS NOT NULL")
    if wanted is not None:
        ids = ids.join(wanted.groupBy("query_id").agg(F.collect_set("domain").alias("domains")), "query_id")
    blocks = max(1, -(-ids.count() // block))
    found = None
    for i in range(blocks):
        part = ids if blocks == 1 else ids.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = part.collect()  # about ``block`` rows
        if not rows:
            continue
        asked = np.array([r.vector for r in rows], float)
        held = spark.sparkContext.broadcast((asked, None if wanted is None else [set(r.domains) for r in rows]))
        names = spark.createDataFrame([(n, r.query_id) for n, r in enumerate(rows)], T.struct_of(q="long", query_id=queries.schema["query_id"].dataType))
        here = vectors.select("domain", "chunk_id", "vector").mapInArrow(_products(held, k), "q long, domain string, chunk_id string, score double")
        here = here.join(F.broadcast(names), "q").select("query_id", "domain", "chunk_id", "score")
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = queries.limit(0).select("query_id").join(vectors.limit(0).select("domain", "chunk_id")).withColumn("score", F.lit(0.0))
    return ranked(found, k)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int = TOP_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists: the k best of each
    query and domain, with max-normalised keyword scores."""
    key = ["query_id", "domain", "chunk_id"]
    s = semantic.select(*key, F.col("score").alias("semantic_score"), F.col("rank").alias("rs"))
    b = keyword.select(*key, F.col("score").alias("raw"), F.col("rank").alias("rb"))
    both = s.join(b, key, "full")
    per = Window.partitionBy("query_id", "domain")
    rrf = F.coalesce(SEMANTIC / (RRF_K + F.col("rs")), F.lit(0.0)) + F.coalesce(KEYWORD / (RRF_K + F.col("rb")), F.lit(0.0))
    both = both.withColumn("rrf", F.round(rrf, 9)).withColumn("bm25_score", F.round(F.coalesce("raw", F.lit(0.0)) / T.or_one(F.max("raw").over(per)), 6))
    order = per.orderBy(F.desc("rrf"), F.col("rs").asc_nulls_last(), F.col("rb").asc_nulls_last(), "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*key, F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"), "bm25_score", "rrf", "rank")


def matches(source_file: Column, names: Column) -> Column:
    """The path holds one of ``names``."""
    return F.coalesce(F.exists(names, lambda n: F.contains(source_file, n)), F.lit(False))


def file_filter(hits: DataFrame, names: Column, strict: bool = False) -> DataFrame:
    """Hits in files whose path holds one of ``names``. Unless ``strict``, a query
    for which no hit does keeps all of its hits."""
    match = matches(F.col("source_file"), names)
    if strict:
        return hits.where(match)
    some = F.max(match).over(Window.partitionBy("query_id"))
    return hits.withColumn("_some", some).where(match | ~F.col("_some")).drop("_some")


def filter_arms(semantic: DataFrame, keyword: DataFrame, files: DataFrame, chunks: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both arms' ranked hits without those outside the files that their query asks
    for, ranked again. ``files`` (query_id, names): a query without names keeps all.
    Unless ``strict``, so does a query and domain that no hit of either arm fits."""
    both = semantic.withColumn("arm", F.lit("s")).unionByName(keyword.withColumn("arm", F.lit("k")))
    both = scratch.stored(both, "both")
    both = chunks.select("domain", "chunk_id", "source_file").join(small(both), ["domain", "chunk_id"]).join(small(files), "query_id", "left")
    asks = F.coalesce(F.size("names"), F.lit(0)) > 0
    fits = asks & matches(F.col("source_file"), F.col("names"))
    if strict:
        both = both.where(~asks | fits)
    else:
        some = F.max(fits).over(Window.partitionBy("query_id", "domain"))
        both = both.withColumn("_fits", fits).withColumn("_some", some).where(F.col("_fits") | ~F.col("_some"))
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("arm", "query_id", "domain").orderBy("rank")))
    both = scratch.stored(both.select("arm", "query_id", "domain", "chunk_id", "score", "rank"), "arms")
    return both.where("arm = 's'").drop("arm"), both.where("arm = 'k'").drop("arm")


def candidates(k: int, overfetch: int = OVERFETCH, filtered: bool = False) -> int:
    """Hits that each arm fetches: three times as many where files are asked for.
    A domain with fewer chunks gives all it has."""
    return k * overfetch * (3 if filtered else 1)


def overlap(query: Column, text: Column) -> Column:
    """Jaccard of the token sets, plus 0.05 for each query token of 4 characters
    or more inside the text (0.20 at most), 1 at most."""

    def score(x: Column) -> Column:
        q, c, low = x["q"], x["c"], x["low"]
        both = F.size(F.array_intersect(q, c))
        bonus = F.least(F.lit(BONUS_CAP), BONUS * F.size(F.filter(q, lambda w: (F.length(w) >= BONUS_CHARS) & F.contains(low, w))))
        made = F.least(F.lit(1.0), both / (F.size(q) + F.size(c) - both) + bonus)
        return F.when((F.size(q) > 0) & (F.size(c) > 0), made).otherwise(F.lit(0.0))

    # Bound once: the lower-cased text is not made again for each token.
    bound = F.struct(F.array_distinct(T.tokens(query)).alias("q"), F.array_distinct(T.tokens(text)).alias("c"), F.lower(text).alias("low"))
    return F.transform(F.array(bound), score)[0]


def keyword_score(hits: DataFrame) -> Column:
    return F.round(RRF_WEIGHT * F.col("rrf") + OVERLAP_WEIGHT * overlap(F.col("query"), F.col("text")), 6)


def rerank(hits: DataFrame, k: int = RERANK_K, threshold: float = THRESHOLD, keep: int = 1, by: tuple = ("query_id", "domain"), encoder=None) -> DataFrame:
    """The k best of (query, text, rrf, rank, ...) that reach ``threshold``; if none
    does, the best ``keep``. The score is ``encoder(query, text)``, a cross-encoder
    as a column function; where it gives null (it failed), and without one, 0.6 rrf
    + 0.4 overlap under the same threshold."""
    score = keyword_score(hits) if encoder is None else F.coalesce(encoder(F.col("query"), F.col("text")), keyword_score(hits))
    s = hits.withColumn("rerank_score", score)
    w = Window.partitionBy(*by)
    s = s.withColumn("rerank_rank", F.row_number().over(w.orderBy(F.desc("rerank_score"), "rank", "chunk_id")))
    any_ = F.max(F.col("rerank_score") >= threshold).over(w)
    s = s.withColumn("_any", any_).where(((F.col("rerank_score") >= threshold) & (F.col("rerank_rank") <= k)) | (~F.col("_any") & (F.col("rerank_rank") <= keep)))
    return s.drop("_any")


def score_summary(hits: DataFrame) -> DataFrame:
    """count, top, low, mean and the labels in rank order of each query's hits."""
    order = F.array_sort(F.collect_list(F.struct("rerank_rank", F.col("chunk_id").alias("label"))))
    return hits.groupBy("query_id", "domain").agg(
        F.count(F.lit(1)).alias("count"), T.exact_round(F.max("rerank_score"), 4).alias("top_score"), T.exact_round(F.min("rerank_score"), 4).alias("min_score"), T.exact_mean(F.col("rerank_score"), 4).alias("avg_score"),
        F.array_join(F.transform(order, lambda x: x["label"]), "|").alias("labels"),
    )


NO_CONTEXT = "(No source material found.)"


def prompt_context(hits: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The evidence block of each query and domain, sources in rank order; of pairs
    ``asked`` (query_id, domain) without evidence the line that says so. Scores are
    shown by their exact value, as Python and C print them: the JVM's format rounds the
    shortest decimal that names a score, half up."""
    score = T.exact_round(F.col("rerank_score").cast("double"), 3)
    line = F.format_string("[Source %d] — %s  (domain: %s, score: %.3f)\n%s", "rerank_rank", T.citation_label(F.col("source_file")), "domain", score, "text")
    order = F.array_sort(F.collect_list(F.struct("rerank_rank", line.alias("line"))))
    made = hits.groupBy("query_id", "domain").agg(F.array_join(F.transform(order, lambda x: x["line"]), "\n---\n").alias("context"))
    if asked is None:
        return made
    return asked.select("query_id", "domain").join(made, ["query_id", "domain"], "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def hybrid(
    queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = TOP_K, overfetch: int = OVERFETCH,
    files: DataFrame | None = None, strict: bool = False, wanted: DataFrame | None = None, held: TextIndex | None = None,
) -> DataFrame:
    """Both arms fused: the k best hits of each query and domain with query, text and
    file. ``files`` (query_id, names) asks for files (``filter_arms``), ``wanted``
    (query_id, domain) for domains; neither is searched further than asked. ``held``
    is the chunks' stored index; without one they are indexed first."""
    held = TextIndex.of(index(chunks)) if held is None else held
    plain = candidates(k, overfetch)
    n = candidates(k, overfetch, files is not None)
    if files is not None:
        files = scratch.stored(files.select("query_id", "names"), "files")
    semantic, keyword = dense(query_vectors, vectors, n, wanted), keyword_search(queries, held, n, wanted)
    if files is not None:
        # Only queries that ask for files fetch more.
        more = small(files.where(F.size("names") > 0).select("query_id", F.lit(True).alias("_more")))
        semantic, keyword = (arm.join(more, "query_id", "left").where(F.col("_more") | (F.col("rank") <= plain)).drop("_more") for arm in (semantic, keyword))
        semantic, keyword = filter_arms(semantic, keyword, files, chunks, strict)
    hits = scratch.stored(fuse(semantic, keyword, k), "hits")
    # Few hits are sent to the texts, which stay where they are.
    texts = chunks.select("domain", "chunk_id", "source_file", "text").join(small(hits), ["domain", "chunk_id"])
    return texts.join(small(queries.select("query_id", "query")), "query_id").select(*hits.columns, "source_file", "text", "query")
