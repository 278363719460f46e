"""All queries of the engine's own operators over the test tables, and their SQL.

Binding: documents are the corpus (domain = lang, one file each), benchmark the
questions, embeddings the vectors (vec_id = doc_id; a question's is that of its
item_id), conversations the message log, customer and orders a parent with
children, labels judged outcomes, events scores and times.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import jsonx, text as T
from quarry.operators import answers as A, clients as C, embedder as M, evaluation as E, keywords as W, reports as P, routing as R, search as S, vectors as V
from quarry.sources import files as L, scratch, store
from quarry.streaming import batches

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Routing keywords that occur in the corpus' prose.
KEYWORDS = {"de": ["und", "keit", "schaft"], "en": ["the", "tion", "with"], "es": ["ción", "que", "mente"], "fr": ["eau", "ment", "aux"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The test tables by name, and their search index."""

    #: (application, folder), and the stored chunks and index of the last folder asked for.
    _last: list | None = None

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def indexed(self, anew: bool = False) -> DataFrame:
        """The corpus' chunks with terms: made once a session, as users of a search
        index do, and replaced when another folder is asked for."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if anew or Tables._last is None or Tables._last[0] != key:
            if Tables._last is not None and Tables._last[0][0] == key[0]:
                held = Tables._last[2]
                for t in [Tables._last[1], *(held.tables() if held else ())]:
                    scratch.drop_stored(t)
            Tables._last = None
            ch = S.index(chunks(self))
            scratch.hold(ch)
            Tables._last = [key, ch, None]
        return Tables._last[1]

    def corpus(self, anew: bool = False) -> tuple[DataFrame, S.TextIndex]:
        """The corpus' chunks with terms, and their postings, for those who search them."""
        ch = self.indexed(anew)
        if Tables._last[2] is None:
            held = S.TextIndex.of(ch)
            held.stats()
            scratch.hold(*held.tables())
            Tables._last[2] = held
        return ch, Tables._last[2]


def query(name: str, sql: str | None):
    def add(f):
        def run(spark, sf_dir):
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs

_WORDS = r"list_filter(string_split_regex(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[\s\p{Z}\x{85}]+'), lambda x: x <> '')"
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def tok(x: str) -> str:
    return _TOK.format(x)


def files(t) -> DataFrame:
    return t("documents").select(F.col("lang").alias("domain"), F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("source_file"), F.lit(None).cast("int").alias("page"), "text", "doc_id")


def chunks(t) -> DataFrame:
    return T.chunks(scratch.spread(files(t)))


def indexed(t) -> DataFrame:
    return t.indexed()


CH = rf"""d AS (SELECT doc_id, lang AS domain, concat(source, '/doc_', doc_id, '.txt') AS source_file, {_WORDS} AS w FROM documents),
s AS (SELECT *, unnest(range(0, CAST(ceil(greatest(len(w) - 800, 0) / 650.0) AS BIGINT) + 1)) AS i FROM d WHERE len(w) > 0),
c0 AS (SELECT doc_id, domain, source_file, i, array_to_string(w[i * 650 + 1 : i * 650 + 800], ' ') AS text FROM s),
ch AS (SELECT doc_id, domain, source_file, text, CAST(row_number() OVER (PARTITION BY domain, source_file ORDER BY i) - 1 AS INTEGER) AS chunk_index,
       printf('%s_%s_%04d', domain, concat('doc_', doc_id), row_number() OVER (PARTITION BY domain, source_file ORDER BY i) - 1) AS chunk_id
       FROM c0 WHERE length(text) > 20)"""
BM = rf"""tk AS (SELECT domain, chunk_id, {tok('text')} AS t FROM ch),
st AS (SELECT domain, count(*) AS n, avg(len(t)) AS avgdl FROM tk GROUP BY domain),
dfr AS (SELECT domain, token, count(*) AS df FROM (SELECT domain, unnest(list_distinct(t)) AS token FROM tk) GROUP BY ALL),
idf0 AS (SELECT domain, token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfr JOIN st USING (domain)),
me AS (SELECT domain, avg(raw) AS m FROM idf0 GROUP BY domain),
idf AS (SELECT domain, token, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM idf0 JOIN me USING (domain)),
qtf AS (SELECT query_id, token, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS token FROM benchmark) GROUP BY ALL),
tf AS (SELECT domain, chunk_id, dl, token, count(*) AS f FROM (SELECT domain, chunk_id, len(t) AS dl, unnest(t) AS token FROM tk) GROUP BY ALL),
sc AS (SELECT query_id, domain, chunk_id, round(sum(qf * (idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
       FROM tf JOIN qtf USING (token) JOIN idf USING (domain, token) JOIN st USING (domain) GROUP BY ALL),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc WHERE score > 0)"""
SEM = """qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
cv AS (SELECT domain, chunk_id, embedding::DOUBLE[] AS v FROM ch JOIN embeddings ON vec_id = doc_id),
sem0 AS (SELECT query_id, domain, chunk_id, round(list_sum(list_transform(list_zip(qv, v), lambda x: x[1] * x[2])), 6) AS score FROM qv, cv),
sem AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sem0)"""
FUSED = """f0 AS (SELECT query_id, domain, chunk_id, s.score AS semantic, s.rank AS rs, b.score AS raw, b.rank AS rb
      FROM (SELECT * FROM sem WHERE rank <= 24) s FULL JOIN (SELECT * FROM bm WHERE rank <= 24) b USING (query_id, domain, chunk_id)),
f1 AS (SELECT *, round(coalesce(0.60 / (60 + rs), 0) + coalesce(0.40 / (60 + rb), 0), 9) AS rrf,
       round(coalesce(raw, 0) / coalesce(nullif(max(raw) OVER (PARTITION BY query_id, domain), 0), 1), 6) AS bm25_score FROM f0),
f2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, domain ORDER BY rrf DESC, rs NULLS LAST, rb NULLS LAST, chunk_id) AS INTEGER) AS rank FROM f1),
hits AS (SELECT query_id, f2.domain, chunk_id, coalesce(semantic, 0) AS semantic_score, bm25_score, rrf, rank, b.text AS query, ch.text, ch.source_file
         FROM f2 JOIN ch USING (domain, chunk_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 8)"""
OVERLAP = f"""CASE WHEN len(q) > 0 AND len(c) > 0 THEN least(1.0, len(list_intersect(q, c))::DOUBLE / (len(q) + len(c) - len(list_intersect(q, c)))
     + least(0.20, 0.05 * len(list_filter(q, lambda w: length(w) >= 4 AND contains(lower(text), w))))) ELSE 0.0 END"""
RR = f"""r0 AS (SELECT *, list_distinct({tok('query')}) AS q, list_distinct({tok('text')}) AS c FROM hits),
r1 AS (SELECT *, round(0.60 * rrf + 0.40 * ({OVERLAP}), 6) AS rerank_score FROM r0),
r2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, domain ORDER BY rerank_score DESC, rank, chunk_id) AS INTEGER) AS rerank_rank,
       max(rerank_score) OVER (PARTITION BY query_id, domain) >= $T AS passes FROM r1),
rr AS (SELECT * FROM r2 WHERE (rerank_score >= $T AND rerank_rank <= 5) OR (NOT passes AND rerank_rank <= 1))"""
LABEL = "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace({}, '[-_]+', ' ', 'g'), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '^[A-Z][A-Z0-9s]*$') THEN w ELSE concat(upper(w[1:1]), lower(w[2:])) END), ' ')"


def xr(x: str, k: int) -> str:
    """SQL that rounds the exact binary value of ``x``, halves to even."""
    m = f"(((abs({x}) - floor(abs({x}))) * 4611686018427387904)::HUGEINT * {10**k})"
    up = f"{m} % 4611686018427387904 > 2305843009213693952 OR ({m} % 4611686018427387904 = 2305843009213693952 AND ({m} // 4611686018427387904) % 2 = 1)"
    return f"(sign({x}) * (floor(abs({x})) * {10**k} + {m} // 4611686018427387904 + CASE WHEN {up} THEN 1 ELSE 0 END) / {float(10**k)})"


def benchmark(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(t, ch: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = t("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    qv = benchmark(t).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "vector")
    return qv, ch.join(e, F.col("doc_id") == F.col("vec_id")).select("domain", "chunk_id", "vector")


def hits(t) -> DataFrame:
    ch, held = t.corpus()
    qv, cv = vectors(t, ch)
    return S.hybrid(benchmark(t), qv, ch, cv, held=held)


# ---------------------------------------------------------------- text


@query("t1_tokenize_counts", f"SELECT doc_id, len({tok('text')})::INTEGER AS n_tokens, len(list_distinct({tok('text')}))::INTEGER AS n_distinct FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n_distinct"))


@query("t2_clean_text", r"""SELECT doc_id, md5(c) AS clean_md5, length(c)::INTEGER AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') AS c FROM documents)""")
def _(t):
    c = T.clean(F.col("text"))
    return t("documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).alias("n"))


@query("t3_t14_word_counts", f"SELECT doc_id, len({_WORDS})::INTEGER AS n_words FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"))


@query("t4_chunks", f"WITH {CH} SELECT chunk_id, domain, source_file, chunk_index, md5(text) AS text_md5, length(text)::INTEGER AS n FROM ch")
def _(t):
    return chunks(t).select("chunk_id", "domain", "source_file", "chunk_index", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


@query("t5_paged_chunk_ids", rf"""WITH d AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
s AS (SELECT *, unnest(range(0, CAST(ceil(greatest(len(w) - 20, 0) / 15.0) AS BIGINT) + 1)) AS i FROM d WHERE len(w) > 0),
c AS (SELECT conv_id, turn, i, array_to_string(w[i * 15 + 1 : i * 15 + 20], ' ') AS text FROM s)
SELECT printf('CHAT_conv_%d_%04d', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1) AS chunk_id, turn::INTEGER AS page, md5(text) AS text_md5 FROM c WHERE length(text) > 20""")
def _(t):
    f = t("conversations").select(F.lit("CHAT").alias("domain"), F.format_string("chats/conv_%d.txt", "conv_id").alias("source_file"), F.col("turn").cast("int").alias("page"), "text")
    return T.chunks(f, 20, 5).select("chunk_id", "page", F.md5("text").alias("text_md5"))


@query("t7_file_parts", r"""SELECT page_id, p AS path, regexp_extract(p, '([^/]*)$', 1) AS base, lower(regexp_extract(p, '(\.[^./]+)$', 1)) AS suffix, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\.[^.]+$', '') AS stem
 FROM (SELECT page_id, concat(regexp_replace(url, '\?.*$', ''), '/page_', page_id, CASE page_id % 3 WHEN 0 THEN '.v2.PDF' WHEN 1 THEN '.md' ELSE '' END) AS p FROM pages)""")
def _(t):
    ext = F.when(F.col("page_id") % 3 == 0, ".v2.PDF").when(F.col("page_id") % 3 == 1, ".md").otherwise("")
    p = t("pages").select("page_id", F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("/page_"), "page_id", ext).alias("path"))
    return p.select("page_id", "path", T.basename(F.col("path")).alias("base"), T.suffix(F.col("path")).alias("suffix"), T.stem(F.col("path")).alias("stem"))


_NAME = "concat(replace(p_name, ' ', '_'), '-', p_type, '__', replace(p_brand, '#', '-'))"


@query("t8_citation_label", f"SELECT p_partkey, concat({LABEL.format(_NAME)}, CASE WHEN p_size % 2 = 0 THEN concat(', p.', p_size) ELSE '' END) AS label FROM part")
def _(t):
    path = F.concat(F.lit("kb/"), F.translate("p_name", " ", "_"), F.lit("-"), "p_type", F.lit("__"), F.translate("p_brand", "#", "-"), F.lit(".pdf"))
    return t("part").select("p_partkey", T.citation_label(path, F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("label"))


_SENT = r"string_split(regexp_replace({}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("t9_sentences", f"SELECT item_id, (unnest(range(1, len(s) + 1)) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT item_id, {_SENT.format('text')} AS s FROM benchmark)")
def _(t):
    return t("benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("t10_t11_truncation", "SELECT doc_id, left(text, 60) AS title, md5(left(text, 1500)) AS evidence_md5, CASE WHEN length(text) > 500 THEN concat(left(text, 500), '…') ELSE text END AS preview FROM documents")
def _(t):
    x = F.col("text")
    return t("documents").select("doc_id", F.substring(x, 1, 60).alias("title"), F.md5(F.substring(x, 1, 1500)).alias("evidence_md5"), T.ellipsis(x, 500).alias("preview"))


@query("t12_t13_keyword_match", f"""SELECT item_id, contains(lower(text), 'tion') AS inside, len(list_filter({tok('text')}, lambda w: starts_with(w, 'th'))) > 0 AS prefix FROM benchmark""")
def _(t):
    return t("benchmark").select("item_id", F.contains(F.lower("text"), F.lit("tion")).alias("inside"), F.exists(T.tokens(F.col("text")), lambda w: F.startswith(w, F.lit("th"))).alias("prefix"))


@query("t15_citations", r"""SELECT conv_id, turn, array_to_string(regexp_extract_all(concat(text, ' [Source ', turn + 1, '] x [source  12] [Source x]'), '(?i)\[Source\s+(\d+)\]', 1), ',') AS cited FROM conversations""")
def _(t):
    x = F.concat("text", F.lit(" [Source "), F.col("turn") + 1, F.lit("] x [source  12] [Source x]"))
    return t("conversations").select("conv_id", "turn", F.array_join(T.citations(x), ",").alias("cited"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_SIG = "list_distinct(list_filter({}, lambda w: length(w) >= 4 AND w NOT IN ({})))"


def sig(x: str) -> str:
    return _SIG.format(tok(x), _STOP)


@query("t16_significant_words", f"SELECT item_id, array_to_string(list_sort({sig('text')}), ' ') AS words FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", F.array_join(F.array_sort(T.significant(F.col("text"))), " ").alias("words"))


@query("t17_exact_round", """SELECT event_id, sign(value) * (floor(abs(value)) * 100 + m // 4611686018427387904 + CASE WHEN m % 4611686018427387904 > 2305843009213693952 OR (m % 4611686018427387904 = 2305843009213693952 AND (m // 4611686018427387904) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS r
 FROM (SELECT event_id, value, ((abs(value) - floor(abs(value))) * 4611686018427387904)::HUGEINT * 100 AS m FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE floor(value) + (event_id % 200) / 200.0 END AS value FROM events))""")
def _(t):
    v = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.floor("value") + (F.col("event_id") % 200) / 200)
    return t("events").select("event_id", T.exact_round(v, 2).alias("r"))


@query("t22_sizes_and_escapes", """SELECT o_orderkey, CASE WHEN b < 1024 THEN concat(b, ' B') WHEN b < 1048576 THEN concat((b * 10 + 512) // 1024 // 10, '.', (b * 10 + 512) // 1024 % 10, ' KB') ELSE concat((b * 10 + 524288) // 1048576 // 10, '.', (b * 10 + 524288) // 1048576 % 10, ' MB') END AS size,
 CASE WHEN b < 1024 THEN concat(b, ' B') WHEN b < 1048576 THEN concat((b + 512) // 1024, ' KB') ELSE concat((b * 10 + 524288) // 1048576 // 10, '.', (b * 10 + 524288) // 1048576 % 10, ' MB') END AS size_short,
 concat('&lt;b a=&quot;', o_orderstatus, '&quot;&gt; &amp;amp; ', o_orderpriority) AS html FROM (SELECT *, (o_orderkey * o_orderkey * 7)::BIGINT AS b FROM orders)""")
def _(t):
    b = F.col("o_orderkey").cast("long") * F.col("o_orderkey") * 7
    html = F.concat(F.lit('<b a="'), "o_orderstatus", F.lit('"> &amp; '), "o_orderpriority")
    return t("orders").select("o_orderkey", T.size_label(b).alias("size"), T.size_label(b, 0).alias("size_short"), T.escape_html(html).alias("html"))


@query("t23_bands", "SELECT event_id, " + ", ".join(f"CASE WHEN value / 100 >= {h} THEN 'good' WHEN value / 100 >= {w} THEN 'fair' ELSE 'poor' END AS {n}" for n, (h, w) in T.BANDS.items()) + " FROM events")
def _(t):
    return t("events").select("event_id", *[T.band_of(n, F.col("value") / 100).alias(n) for n in T.BANDS])


@query("t17_t18_t20_t23_scores_api", "SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS clamped, value / coalesce(nullif(value, 0), 1) AS unit, CASE WHEN value / 100 >= 0.7 THEN 'good' WHEN value / 100 >= 0.4 THEN 'fair' ELSE 'poor' END AS band FROM events")
def _(t):
    v = F.col("value")
    return t("events").select("event_id", T.clamp(v / 100).alias("clamped"), (v / T.or_one(v)).alias("unit"), T.band(v / 100).alias("band"))


@query("t19_ordered_dedup", f"SELECT item_id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest({tok('text')}) AS w, unnest(range(len({tok('text')}))) AS p FROM benchmark) GROUP BY item_id, w) GROUP BY item_id")
def _(t):
    return t("benchmark").select("item_id", F.array_join(F.array_distinct(T.tokens(F.col("text"))), " ").alias("words"))


@query("t21_relative_time", """SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN concat(m, 'm ago') WHEN m < 1440 THEN concat(m // 60, 'h ago') ELSE concat(m // 1440, 'd ago') END AS ago
 FROM (SELECT event_id, epoch(TIMESTAMP '2024-02-01' - ts)::BIGINT // 60 AS m FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))""")
def _(t):
    m = F.floor((F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp"))) / 60)
    return t("events").select("event_id", T.ago(m).alias("ago"))


_ERRORS = ["429 Too Many: perday limit", "Rate limit reached", "401 denied", "API_KEY not set", "key not set", "Connection reset", "boom", "retry in 7.5s: quota"]


@query("t24_t26_errors", f"""SELECT event_id, CASE WHEN lim AND (contains(m, 'perday') OR contains(m, 'per_day') OR contains(m, 'daily')) THEN 'daily quota' WHEN lim THEN 'rate limit'
 WHEN contains(m, 'authentication') OR contains(m, '401') OR contains(m, 'api key') OR contains(m, 'api_key') THEN 'authentication' WHEN contains(m, 'not set') THEN 'missing key'
 WHEN contains(m, 'timeout') OR contains(m, 'connection') THEN 'timeout' ELSE 'other' END AS kind,
 coalesce(TRY_CAST(nullif(regexp_extract(m, 'retry in (\\d+(?:\\.\\d+)?)s', 1), '') AS DOUBLE) + 2, 15) AS wait
 FROM (SELECT *, contains(m, 'rate limit') OR contains(m, '429') OR contains(m, 'quota') OR contains(m, 'tokens per day') OR contains(m, 'tpd') AS lim
 FROM (SELECT event_id, lower({_ERRORS!r}[event_id % 8 + 1]) AS m FROM events))""")
def _(t):
    m = F.lower(F.element_at(F.array(*[F.lit(x) for x in _ERRORS]), (F.col("event_id") % 8 + 1).cast("int")))
    return t("events").select("event_id", T.error_class(m).alias("kind"), T.retry_seconds(m).alias("wait"))


@query("t25_k9_history_block", """SELECT conv_id, string_agg(concat(upper(role[1:1]), lower(role[2:]), ': ', left(text, 200)), chr(10) ORDER BY turn) AS history
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id""")
def _(t):
    return T.router_history(t("conversations"), "conv_id", "turn")


@query("t25_generator_history", f"""SELECT conv_id, concat({chr(39)}{T.HISTORY_HEAD}{chr(39)}, chr(10), coalesce(string_agg(concat(CASE WHEN role = 'user' THEN 'Student' ELSE 'Assistant' END, ': ', s, chr(10)), '' ORDER BY turn) FILTER (s <> ''), ''), {chr(39)}{T.HISTORY_FOOT}{chr(39)}) AS history
 FROM (SELECT *, trim(CASE WHEN turn % 4 = 1 THEN ' ' ELSE text END, ' ' || chr(10) || chr(9)) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id""")
def _(t):
    blank = F.when(F.col("turn") % 4 == 1, F.lit(" ")).otherwise(F.col("text"))
    return T.generator_history(t("conversations").withColumn("text", blank), "conv_id", "turn")


@query("t28_provider_prefix", "SELECT event_type, starts_with(event_type, 'pur') OR starts_with(event_type, 'cl') AS hosted, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t("events").groupBy("event_type", T.starts_with_any(F.col("event_type"), ["pur", "cl"]).alias("hosted")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- JSON


@query("j1_json_salvage", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k FROM events")
def _(t):
    e = F.col("event_id") % 4
    said = F.when(e == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e == 1, F.concat(F.lit("Sure: "), "props", F.lit(" as asked"))).when(e == 2, F.col("props")).otherwise(F.lit("no {json"))
    return t("events").select("event_id", F.get_json_object(jsonx.salvage(said), "$.k").cast("bigint").alias("k"))


@query("j2_router_json", """SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'multi' ELSE 'single' END AS intent_type, CASE item_id % 3 WHEN 0 THEN 'DE,EN' WHEN 1 THEN 'FR' ELSE '' END AS domains,
 item_id % 3 <> 1 AS is_course_related, item_id % 3 = 1 AS needs_clarification FROM benchmark""")
def _(t):
    i = F.col("item_id") % 3
    said = F.when(i == 0, '{"intent_type":"multi","domains":["de","EN","XX"]}').when(i == 1, '{"intent_type":"odd","domains":["fr"],"is_course_related":false,"needs_clarification":true}').otherwise("nothing")
    return t("benchmark").select("item_id", jsonx.route(said, list(KEYWORDS)).alias("r")).select("item_id", "r.intent_type", F.array_join("r.domains", ",").alias("domains"), "r.is_course_related", "r.needs_clarification")


@query("j3_splitter_json", "SELECT item_id, trim(text, ' ') AS question, 'DE' AS domain FROM benchmark WHERE trim(text, ' ') <> ''")
def _(t):
    said = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" "), "text").alias("question"), F.lit(" de ").alias("domain")), F.struct(F.lit(" ").alias("question"), F.lit("en").alias("domain"))).alias("sub_questions")))
    q = F.explode(jsonx.split_questions(said)).alias("q")
    return t("benchmark").select("item_id", q).select("item_id", "q.question", "q.domain")


@query("j4_verifier_json", """SELECT doc_id, quality = 1 AS ok, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS q, 0.25::DOUBLE AS c, CASE WHEN quality = 0 THEN 'better' END AS revised FROM labels""")
def _(t):
    good = F.col("quality") == 1
    said = F.when(good, '{"is_satisfactory":true,"quality_score":7,"coverage_score":0.25,"revised_answer":"x"}').otherwise('{"is_satisfactory":false,"coverage_score":0.25,"revised_answer":"better"}')
    return t("labels").select("doc_id", jsonx.verdict(said).alias("v")).select("doc_id", F.col("v.is_satisfactory").alias("ok"), F.col("v.quality").alias("q"), F.col("v.coverage").alias("c"), F.col("v.revised_answer").alias("revised"))


@query("j5_json_columns", "SELECT event_id, concat('{\"user_id\":', user_id, ',\"event_type\":\"', event_type, '\"}') AS j, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("j"), F.from_json("props", "k bigint")["k"].alias("k"))


# ---------------------------------------------------------------- filters, sets, DML, roll-ups

@query("f1_equality", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'de' AND source = 'src3'")
def _(t):
    return store.matching(t("documents"), lang="de", source="src3").select("doc_id", "source", "n_chars")


@query("f2_like", "SELECT doc_id, source FROM documents WHERE source ILIKE '%RC1%'")
def _(t):
    return store.containing(t("documents"), "source", "RC1").select("doc_id", "source")


@query("f7_optional_predicate", "SELECT doc_id, 'all' AS asked FROM documents UNION ALL SELECT doc_id, 'fr' FROM documents WHERE lang = 'fr'")
def _(t):
    d = t("documents")
    return store.matching(d, lang=None).select("doc_id", F.lit("all").alias("asked")).unionByName(store.matching(d, lang="fr").select("doc_id", F.lit("fr").alias("asked")))


@query("f10_with_chunks", "SELECT lang, count(*) AS n FROM documents WHERE n_chars > 100 GROUP BY lang")
def _(t):
    return store.with_chunks(t("documents").withColumn("chunk_count", F.floor(F.col("n_chars") / 101))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("f8_manual_override", f"SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'es' ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{d}' END" for d, ks in KEYWORDS.items()) + "], lambda x: x IS NOT NULL), ',') END AS domains FROM benchmark")
def _(t):
    manual = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("es"))).when(F.col("query_id") % 3 == 0, F.array().cast("array<string>"))
    r = R.route(benchmark(t), KEYWORDS)
    return r.select(F.col("query_id").alias("item_id"), F.array_join(R.override(manual, F.col("domains")), ",").alias("domains"))


_GENERAL = " OR ".join(f"contains(lower(text), '{w}')" for w in R.GENERAL)


@query("f9_general_query", f"SELECT conv_id, turn, NOT (contains(lower(text), 'report') OR contains(lower(text), 'the')) AND ({_GENERAL} OR len(string_split(text, ' ')) < 8) AS general FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", R.general_query(F.col("text"), F.array(F.lit("Report.v2.PDF".replace(".v2", "")), F.lit("the.md"))).alias("general"))


@query("w1_required_role", "SELECT role, min(turn) AS first FROM conversations WHERE role <> 'system' GROUP BY role")
def _(t):
    return store.require_role(t("conversations").where("role <> 'system'"), ("user", "assistant", "tool")).groupBy("role").agg(F.min("turn").alias("first"))


@query("w1_role_check_api", "SELECT role, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role")
def _(t):
    return store.check_role(t("conversations")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("w2_insert_or_ignore", "SELECT md5(text) AS text_key, min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text")
def _(t):
    d = t("documents").select("doc_id", "lang", "text")
    return store.new_rows(d, d.where("lang = 'en'"), ["text"], ["doc_id"]).select(F.md5("text").alias("text_key"), "doc_id")


@query("w3_chunk_upsert", f"WITH {CH}, old AS (SELECT chunk_id FROM ch WHERE source_file LIKE 'src1/%'), a AS (SELECT domain, chunk_id, text FROM ch ANTI JOIN old USING (chunk_id)) SELECT 'chunk' AS kind, domain, chunk_id, NULL::BIGINT AS v FROM ch UNION ALL SELECT 'vector', domain, chunk_id, length(text) FROM a")
def _(t):
    c = scratch.stored(chunks(t), "chunks")
    all_, vectors = store.upsert_chunks(c.where("source_file LIKE 'src1/%'"), c, F.length)
    return all_.select(F.lit("chunk").alias("kind"), "domain", "chunk_id", F.lit(None).cast("long").alias("v")).unionByName(vectors.select(F.lit("vector").alias("kind"), "domain", "chunk_id", F.col("vector").cast("long").alias("v")))


_MESSAGES = "id long, session_id long, role string, content string, timestamp timestamp, intent_type string, detected_domains string, quality_score double, pipeline_meta string"


@query("w4_append_message", """WITH m AS (SELECT *, row_number() OVER (ORDER BY event_id) AS id FROM events WHERE event_id % 2 = 0),
n AS (SELECT *, (SELECT count(*) FROM m) + row_number() OVER (ORDER BY ts, user_id, CASE WHEN event_id % 4 = 1 THEN 'user' ELSE 'assistant' END, props, event_id) AS id FROM events WHERE event_id % 2 = 1),
a AS (SELECT id, user_id, NULL AS domains, NULL AS meta, ts, event_id, 0 AS new FROM m UNION ALL SELECT id, user_id, CASE WHEN event_id % 3 = 0 THEN '["' || event_type || '","x"]' END, '{"k":' || event_id || '}', ts, event_id, 1 FROM n)
SELECT 'message' AS kind, user_id AS session_id, count(*)::BIGINT AS n, max(CASE WHEN new = 1 THEN domains END) AS domains, max(meta) AS meta, max(id)::BIGINT AS last_id, NULL::TIMESTAMP AS at FROM a GROUP BY user_id
UNION ALL SELECT 'session', user_id, NULL, NULL, NULL, NULL, greatest(TIMESTAMP '2024-01-01', max(ts) FILTER (new = 1)) FROM a GROUP BY user_id""")
def _(t):
    e = t("events").select("event_id", F.col("user_id").cast("long").alias("session_id"), F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "props")
    role = F.when(F.col("event_id") % 4 == 1, "user").otherwise("assistant")
    none = F.lit(None).cast("string")
    old = e.where("event_id % 2 = 0").select(F.row_number().over(Window.orderBy("event_id")).cast("long").alias("id"), "session_id", F.lit("user").alias("role"), F.col("props").alias("content"), "timestamp", none.alias("intent_type"), none.alias("detected_domains"), F.lit(None).cast("double").alias("quality_score"), none.alias("pipeline_meta"))
    domains = F.when(F.col("event_id") % 3 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    new = e.where("event_id % 2 = 1").select("session_id", role.alias("role"), F.concat("props", F.format_string("%09d", "event_id")).alias("content"), "timestamp", none.alias("intent_type"), domains.alias("detected_domains"), F.lit(None).cast("double").alias("quality_score"), F.struct(F.col("event_id").alias("k")).alias("pipeline_meta"))
    sessions = e.select("session_id").distinct().withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    m, s = store.append_messages(old, sessions, new)
    m = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("detected_domains").alias("domains"), F.max("pipeline_meta").alias("meta"), F.max("id").cast("long").alias("last_id"))
    s = s.select(F.lit("session").alias("kind"), "session_id", F.lit(None).cast("long").alias("n"), none.alias("domains"), none.alias("meta"), F.lit(None).cast("long").alias("last_id"), F.col("updated_at").cast("timestamp_ntz").alias("at"))
    return m.select(F.lit("message").alias("kind"), "session_id", "n", "domains", "meta", "last_id", F.lit(None).cast("timestamp_ntz").alias("at")).unionByName(s)


@query("w4_touch_parent", "SELECT c_custkey, max(o_orderdate) AS updated_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return store.rollup(t("customer").select("c_custkey"), o, "c_custkey", updated_at=F.max("o_orderdate"))


@query("w5_update", "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND quality = 0 THEN 'low' ELSE source END AS source FROM documents LEFT JOIN labels l USING (doc_id)")
def _(t):
    changes = t("labels").where("quality = 0").select("doc_id", F.lit("low").alias("source"))
    return store.update(t("documents").select("doc_id", "source"), changes, ["doc_id"], ["source"])


@query("w6_truncate_tail", "SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn >= conv_id % 5)")
def _(t):
    c = t("conversations").select("conv_id", "turn")
    cuts = c.where("conv_id % 3 = 0").select("conv_id", (F.col("conv_id") % 5).alias("cut")).distinct()
    return store.truncate_tail(c, cuts, "conv_id", "turn")


@query("w7_cascade_delete", "SELECT 'documents' AS tbl, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'labels', count(*) FROM labels WHERE toxic <> 1")
def _(t):
    left = store.cascade_delete({"documents": t("documents"), "labels": t("labels")}, t("labels").where("toxic = 1"), "doc_id")
    return left["documents"].agg(F.lit("documents").alias("tbl"), F.count(F.lit(1)).alias("n")).unionByName(left["labels"].agg(F.lit("labels").alias("tbl"), F.count(F.lit(1)).alias("n")))


@query("w8_w10_delete_by_source", "SELECT source ILIKE '%src1%' AS gone, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    stays, goes = store.delete_where(t("documents"), F.col("source").ilike("%src1%"))
    return stays.agg(F.lit(False).alias("gone"), F.count(F.lit(1)).alias("n")).unionByName(goes.agg(F.lit(True).alias("gone"), F.count(F.lit(1)).alias("n")))


@query("w9_document_records", "SELECT p_partkey AS id, p_name AS filename FROM part WHERE p_partkey <= 20 UNION ALL SELECT 20 + row_number() OVER (ORDER BY s_name), s_name FROM supplier")
def _(t):
    old = t("part").where("p_partkey <= 20").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("filename"))
    return store.add_document(old, t("supplier").select(F.col("s_name").alias("filename")))


@query("w10_remove_document", "SELECT 'chunk' AS kind, count(*) AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT 'vector', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1') UNION ALL SELECT 'record', count(DISTINCT source) FROM documents WHERE source <> 'src1'")
def _(t):
    d = t("documents").select("doc_id", F.col("source").alias("source_file"))
    left = store.remove_document(d, t("embeddings").withColumnRenamed("vec_id", "doc_id"), d.select(F.col("source_file").alias("filename")).distinct(), F.col("source_file") == "src1", "doc_id")
    n = [x.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, x in zip(("chunk", "vector", "record"), left)]
    return n[0].unionByName(n[1]).unionByName(n[2])


@query("w11_reset", "SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_linestatus <> 'F'")
def _(t):
    left = store.reset({"orders": t("orders").withColumnRenamed("o_orderstatus", "space"), "lineitem": t("lineitem").withColumnRenamed("l_linestatus", "space"), "nation": t("nation")}, "space", "F")
    n = [x.agg(F.lit(k).alias("tbl"), F.count(F.lit(1)).alias("n")) for k, x in left.items()]
    return n[0].unionByName(n[1])


@query("w12_csv_sink", "SELECT doc_id, source, md5(nullif(text, '')) AS text_md5 FROM documents")
def _(t):
    d = t("documents").select("doc_id", "source", "text")
    path = scratch.table_path(d.sparkSession, "csv")
    store.write_csv(d, path)
    return store.read_csv(d.sparkSession, path, "doc_id long, source string, text string").select("doc_id", "source", F.md5("text").alias("text_md5"))


@query("w13_create_all", """SELECT name AS tbl, n_columns, CASE WHEN name = 'chat_sessions' THEN (SELECT count(*) FROM nation) ELSE 0 END AS n_rows FROM (VALUES
 ('self_study_sessions', 6), ('self_study_documents', 7), ('self_study_chunks', 8), ('self_study_messages', 7), ('chat_sessions', 5), ('chat_messages', 9), ('uploaded_documents', 7), ('document_chunks', 8)) v(name, n_columns)""")
def _(t):
    old = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("s").alias("session_id"), F.col("n_name").alias("title"), *[F.lit(None).cast("timestamp").alias(c) for c in ("created_at", "updated_at")])
    spark = old.sparkSession
    folder = scratch.table_path(spark, "store")
    store.create_all(spark, folder)
    old.write.mode("append").parquet(f"{folder}/chat_sessions")
    store.create_all(spark, folder)
    tables = {name: store.read_table(spark, folder, name) for name in store.SCHEMAS}
    out = [x.agg(F.lit(n).alias("tbl"), F.lit(len(x.columns)).alias("n_columns"), F.count(F.lit(1)).alias("n_rows")) for n, x in tables.items()]
    return reduce(DataFrame.unionByName, out)


@query("w14_replace_table", "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch.table_path(o.sparkSession, "orders")
    store.replace_table(o, path)
    now = o.sparkSession.read.parquet(path)
    store.replace_table(now.where("o_orderstatus <> 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), path)
    return o.sparkSession.read.parquet(path).select("o_orderkey", "o_totalprice")


@query("s1_s5_s9_text_folder", "SELECT md5(concat(text, chr(10))) AS text_md5, strlen(text) + 1 AS size_bytes, '.txt' AS extension, true AS whole FROM benchmark")
def _(t):
    b = t("benchmark").select("text")
    spark = b.sparkSession
    folder = scratch.table_path(spark, "folder")
    b.write.option("maxRecordsPerFile", 1).text(folder, lineSep="\n")
    found = L.scan(spark, folder)
    names = L.listing(found).withColumnRenamed("name", "at")
    read = L.segments(found, "D").select(T.basename(F.col("source_file")).alias("at"), "text", F.isnull("page").alias("whole"))
    # Name by name, as the texts and the sizes come from two readers.
    return names.join(read, "at").select(F.md5("text").alias("text_md5"), "size_bytes", "extension", "whole")


@query("s11_served_files", """SELECT concat(CASE WHEN n_regionkey = 1 THEN 'a/' WHEN n_regionkey = 2 THEN '..\\' ELSE '' END, n_name) AS name, CASE WHEN n_regionkey IN (1, 2) THEN 403 WHEN n_nationkey % 2 = 1 THEN 404 ELSE 200 END AS status,
 CASE WHEN n_regionkey NOT IN (1, 2) AND n_nationkey % 2 = 0 THEN concat('/kb/', n_name) END AS source_file FROM nation""")
def _(t):
    n = t("nation")
    way = F.when(F.col("n_regionkey") == 1, "a/").when(F.col("n_regionkey") == 2, "..\\").otherwise("")
    held = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/kb/"), "n_name").alias("source_file"))
    return L.served(n.select(F.concat(way, "n_name").alias("name")), held)


#: Characters that XML cannot hold, and line ends that its readers change.
_NOT_XML = r"[\x00-\x08\x0b-\x1f]"


def _made_files(batches):
    """Documents as files of the kind that their names say."""
    for b in (part for batch in batches for part in L.slices(batch, "text")):
        data = [L.docx_of(x) if n.endswith(".docx") else x.encode() for n, x in zip(b.column("source_file").to_pylist(), b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("source_file"), pa.array(data, pa.binary())], ["source_file", "content"])


@query("s3_s4_formats", rf"""SELECT concat('doc_', doc_id, ['.txt', '.MD', '.docx', '.csv'][doc_id % 4 + 1]) AS source_file, md5(c) AS text_md5, true AS whole
 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_NOT_XML}', '', 'g') AS c FROM documents) WHERE doc_id % 4 < 2 OR (doc_id % 4 = 2 AND regexp_matches(c, '[^\s\p{{Z}}\x{{85}}]'))""")
def _(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".MD", ".docx", ".csv")]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = t("documents").select(F.concat(F.lit("doc_"), "doc_id", kind).alias("source_file"), F.regexp_replace(F.coalesce("text", F.lit("")), _NOT_XML, "").alias("text"))
    made = d.mapInArrow(_made_files, "source_file string, content binary")
    return L.segments(made, "D").select("source_file", F.md5("text").alias("text_md5"), F.isnull("page").alias("whole"))


@query("s6_domain_scan", "SELECT doc_id, source FROM documents WHERE lang = 'fr' ORDER BY doc_id")
def _(t):
    return store.chunks_of(t("documents"), "lang", "fr", "doc_id").select("doc_id", "source")


@query("s7_session_scan", "SELECT turn, role, text FROM conversations WHERE conv_id = 7 ORDER BY turn")
def _(t):
    return store.chunks_of(t("conversations"), "conv_id", 7, "turn").select("turn", "role", "text")


@query("s8_id_set", "SELECT vec_id FROM embeddings WHERE label = 3 GROUP BY vec_id")
def _(t):
    return store.ids_of(t("embeddings"), "label", 3, "vec_id")


@query("s10_point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (17, -17)")
def _(t):
    c = t("customer").select("c_custkey", "c_name")
    return store.lookup(c, "c_custkey", 17).unionByName(store.lookup(c, "c_custkey", -17))


@query("s8_s10_sorted_layout", f"WITH {CH} SELECT domain, chunk_id, md5(text) AS text_md5 FROM ch WHERE chunk_id IN (SELECT min(chunk_id) FROM ch GROUP BY domain) OR chunk_id IN (SELECT max(chunk_id) FROM ch GROUP BY domain)")
def _(t):
    """The chunks laid out by chunk_id; each domain's first and last one looked up."""
    path = scratch.table_path(t.spark, "sorted")
    store.write_sorted(indexed(t).select("domain", "chunk_id", "source_file", "text"), path, "chunk_id", ("source_file",))
    back = t.spark.read.parquet(path)
    ids = [x for r in back.groupBy("domain").agg(F.min("chunk_id"), F.max("chunk_id")).collect() for x in r[1:]]
    return back.where(F.col("chunk_id").isin(ids)).select("domain", "chunk_id", F.md5("text").alias("text_md5"))


@query("jn1_a1_session_rollup", "SELECT c_custkey, c_name, count(o_orderkey) AS n_messages, max(o_orderdate) AS updated_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY updated_at DESC NULLS LAST, c_custkey LIMIT 20")
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    r = store.rollup(t("customer").select("c_custkey", "c_name"), o, "c_custkey", n=F.count("o_orderkey"), updated_at=F.max("o_orderdate"))
    return r.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_messages"), "updated_at").orderBy(F.col("updated_at").desc_nulls_last(), "c_custkey").limit(20)


@query("jn1_zero_match", "SELECT d.doc_id, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id")
def _(t):
    return store.rollup(t("documents").select("doc_id"), t("labels"), "doc_id", n=F.count("quality")).select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn2_a2_study_rollup", "SELECT c_custkey, count(DISTINCT o_orderkey) AS n_docs, coalesce(sum(length(o_orderpriority)), 0)::BIGINT AS n_chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    r = store.rollup(t("customer").select("c_custkey"), o, "c_custkey", d=F.count_distinct("o_orderkey"), s=F.sum(F.length("o_orderpriority")))
    return r.select("c_custkey", F.coalesce("d", F.lit(0)).alias("n_docs"), F.coalesce("s", F.lit(0)).alias("n_chunks"))


@query("jn3_u3_anti", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def _(t):
    return store.missing(t("documents"), t("labels"), "doc_id")


@query("a3_chunk_counts", f"WITH {CH} SELECT domain, count(*) AS n_chunks, count(DISTINCT source_file) AS n_files FROM ch GROUP BY domain")
def _(t):
    return chunks(t).groupBy("domain").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("source_file").alias("n_files"))


@query("a7_filtered_averages", f"SELECT source, coalesce({xr('g', 4)}, 0.0) AS avg_good, coalesce({xr('x', 4)}, 0.0) AS avg_toxic FROM (SELECT source, avg(CASE WHEN quality > 0 THEN n_chars END) AS g, avg(CASE WHEN toxic = 1 THEN n_chars END) AS x FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def _(t):
    return t("documents").join(t("labels"), "doc_id").groupBy("source").agg(E.mean_if(F.col("quality") > 0, F.col("n_chars")).alias("avg_good"), E.mean_if(F.col("toxic") == 1, F.col("n_chars")).alias("avg_toxic"))


@query("a8_a9_a14_by_category", f"SELECT category, total, passed, failed, {xr('p', 1)} AS pass_rate FROM (SELECT lang AS category, count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality <> 1) AS failed, (100 * (count(*) FILTER (quality = 1)))::DOUBLE / count(*) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def _(t):
    ok = F.col("quality") == 1
    return t("documents").join(t("labels"), "doc_id").groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), E.percent(ok).alias("pass_rate"))


_M10 = {"quality_score": "value / 100", "coverage_score": "CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE CAST(value AS VARCHAR) END", "latency_ms": "CASE WHEN event_id % 7 > 0 THEN CAST(event_id AS VARCHAR) END"}


@query("a10_by_model", "SELECT model, n, revised, " + ", ".join(f"{xr(m, 3)} AS {m}" for m in _M10) + " FROM (SELECT event_type AS model, count(*) AS n, " + ", ".join(f"favg(TRY_CAST({x} AS DOUBLE)) AS {m}" for m, x in _M10.items()) + ", count(*) FILTER (event_id % 4 = 0) AS revised FROM events WHERE value > 0 GROUP BY event_type)")
def _(t):
    rows = t("events").select(F.col("event_type").alias("model"), (F.col("event_id") % 4 == 0).alias("revised"), *[F.expr(x.replace("VARCHAR", "STRING")).cast("string").alias(m) for m, x in _M10.items()])
    return E.by_model(rows, list(_M10))


@query("a13_a16_client_sums", "SELECT c_mktsegment, sum(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0)) AS total, greatest(1, (count(*) // 30)::INT) AS per_file FROM customer GROUP BY c_mktsegment")
def _(t):
    some = t("customer").select("c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("amount"))
    return P.total(some, "c_mktsegment", "amount").select("c_mktsegment", "total", P.chunks_per_file(F.col("n"), F.lit(30)).alias("per_file"))


@query("a17_kb_status", """SELECT d AS domain, (SELECT count(*) FROM documents WHERE lang = d) AS n_chunks, (SELECT coalesce(string_agg(DISTINCT source, '|' ORDER BY source), '') FROM documents WHERE lang = d) AS files,
 (SELECT coalesce(string_agg(name, '|' ORDER BY since DESC, name DESC), '') FROM (SELECT n_name AS name, n_nationkey % 5 AS since, CASE n_regionkey WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'none' END AS dom FROM nation) WHERE dom = d) AS uploads FROM (VALUES ('de'), ('fr'), ('xx')) v(d)""")
def _(t):
    dom = F.when(F.col("n_regionkey") == 0, "de").when(F.col("n_regionkey") == 1, "fr").otherwise("none")
    uploads = t("nation").select(dom.alias("domain"), F.col("n_name").alias("filename"), (F.col("n_nationkey") % 5).alias("upload_timestamp"))
    d = t("documents").select(F.col("lang").alias("domain"), F.col("source").alias("name"))
    domains = t("documents").sparkSession.createDataFrame([("de",), ("fr",), ("xx",)], "domain string")
    k = P.knowledge_base(d, d, uploads, domains)
    return k.select("domain", F.col("chunk_count").alias("n_chunks"), F.array_join("kb_files", "|").alias("files"), F.array_join("uploaded_docs", "|").alias("uploads"))


@query("k7_recent_sessions", "SELECT o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) <= 20")
def _(t):
    return store.recent(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20)


@query("k8_transcript", "SELECT conv_id, turn, role, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn)::INTEGER AS n FROM conversations a")
def _(t):
    return store.transcript(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "n")


@query("k9_last_user_messages", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 4")
def _(t):
    return store.last_n(t("conversations").where("role = 'user'"), "conv_id", ["turn"], 4).select("conv_id", "turn")


@query("k10_head_sentences", f"SELECT item_id, left(array_to_string(({_SENT.format('text')})[1:2], ' '), 300) AS head FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", E.head(F.col("text")).alias("head"))


@query("u1_union_all", "SELECT doc_id AS id, lang AS x FROM documents UNION ALL SELECT page_id, url FROM pages")
def _(t):
    return store.both_lists(t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("x")), t("pages").select("page_id", "url"))


@query("u2_token_sets", f"SELECT item_id, len(list_intersect(a, b))::INTEGER AS both_, len(list_distinct(list_concat(a, b)))::INTEGER AS any_ FROM (SELECT item_id, list_distinct({tok('b.text')}) AS a, list_distinct({tok('d.text')}) AS b FROM benchmark b JOIN documents d ON doc_id = item_id)")
def _(t):
    a, b = T.tokens(F.col("text")), T.tokens(F.col("other"))
    j = t("benchmark").join(t("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("other")), "item_id")
    return j.select("item_id", F.size(F.array_intersect(a, b)).alias("both_"), F.size(F.array_union(a, b)).alias("any_"))


# ---------------------------------------------------------------- search


@query("a4_bm25_stats", f"WITH {CH}, {BM} SELECT domain, count(*) AS n_tokens, sum(df)::BIGINT AS postings, round(min(idf), 6) AS min_idf, round(max(idf), 6) AS max_idf FROM idf GROUP BY domain")
def _(t):
    return S.bm25_stats(indexed(t))[1].groupBy("domain").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("df").alias("postings"), F.round(F.min("idf"), 6).alias("min_idf"), F.round(F.max("idf"), 6).alias("max_idf"))


@query("c7_index_registry", f"WITH {CH} SELECT domain, count(*) AS n, max(CASE WHEN domain = 'fr' THEN 2 ELSE 1 END) AS made FROM ch GROUP BY domain")
def _(t):
    ch, held, made = chunks(t), S.Indexes(), []

    def of(domain):
        return held.of(domain, lambda: made.append(domain) or ch.where(F.col("domain") == domain))

    of("fr")
    held.evict("fr")
    found = [of(d) for _ in range(2) for d in KEYWORDS][: len(KEYWORDS)]
    return reduce(DataFrame.unionByName, [x.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.lit(made.count(d)).alias("made")) for d, x in zip(KEYWORDS, found)])


@query("m1_bm25_topk", f"WITH {CH}, {BM} SELECT query_id, domain, chunk_id, score, rank FROM bm WHERE rank <= 8")
def _(t):
    return S.keyword_search(benchmark(t), t.corpus()[1], S.TOP_K)


@query("m1_bm25_scan", f"WITH {CH}, {BM} SELECT query_id, domain, chunk_id, score, rank FROM bm WHERE rank <= 8")
def _(t):
    return S.bm25(benchmark(t), indexed(t), S.TOP_K)


_EDITED = "(SELECT * REPLACE (CASE WHEN doc_id % 5 = 1 THEN concat(text, ' neu ', doc_id) ELSE text END AS text) FROM documents WHERE doc_id % 7 <> 0)"


@query("w3_w10_index_upkeep", f"WITH {CH.replace('FROM documents', 'FROM ' + _EDITED + ' documents')}, {BM} SELECT query_id, domain, chunk_id, score, rank FROM bm WHERE rank <= 8")
def _(t):
    """Four documents of five are indexed; then the fifth is added, one in five is
    replaced by a changed text, and one in seven is removed: its chunks of the old text,
    and of the changed one, which can have more."""
    ch, i = indexed(t), F.col("doc_id")
    held = S.TextIndex.of(ch.where(i % 5 != 0))
    held.add(ch.where(i % 5 == 0))
    changed = files(t).where(i % 5 == 1).withColumn("text", F.concat("text", F.lit(" neu "), "doc_id"))
    new = S.index(T.chunks(scratch.spread(changed)))
    held.add(new, replaced=ch.where(i % 5 == 1))
    held.remove(ch.where(i % 7 == 0).select("domain", "chunk_id").unionByName(new.where(i % 7 == 0).select("domain", "chunk_id")))
    return S.keyword_search(benchmark(t), held, S.TOP_K)


@query("m2_cosine_topk", """WITH s AS (SELECT q.vec_id AS query_id, concat('L', v.label % 2) AS domain, printf('%06d', v.vec_id) AS chunk_id, round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda x: x[1] * x[2])), 6) AS score
 FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM s) WHERE rank <= 8""")
def _(t):
    e = t("embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return S.dense(q, e.select(F.concat(F.lit("L"), F.col("label") % 2).alias("domain"), F.format_string("%06d", "vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), S.TOP_K)


@query("k2_vector_index", None)
def _(t):
    """As m2, from cells and codes: approximate, so without SQL; recall is tested."""
    e = t("embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    held = V.VectorIndex.of(e.select(F.concat(F.lit("L"), F.col("label") % 2).alias("domain"), F.format_string("%06d", "vec_id").alias("chunk_id"), F.col("embedding").alias("vector")))
    return held.search(q, S.TOP_K)


@query("m3_rrf_hybrid", f"WITH {CH}, {BM}, {SEM}, {FUSED} SELECT query_id, domain, chunk_id, semantic_score, bm25_score, rrf, rank FROM hits")
def _(t):
    return hits(t).select("query_id", "domain", "chunk_id", "semantic_score", "bm25_score", "rrf", "rank")


@query("m5_overlap", f"WITH {CH}, {BM}, x AS (SELECT query_id, domain, chunk_id, b.text AS query, ch.text FROM bm JOIN ch USING (domain, chunk_id) JOIN benchmark b ON item_id = query_id WHERE rank <= 3), y AS (SELECT *, list_distinct({tok('query')}) AS q, list_distinct({tok('text')}) AS c FROM x) SELECT query_id, domain, chunk_id, round({OVERLAP}, 6) AS overlap FROM y")
def _(t):
    c, held = t.corpus()
    top = c.select("domain", "chunk_id", "text").join(S.small(S.keyword_search(benchmark(t), held, 3)), ["domain", "chunk_id"]).join(S.small(benchmark(t)), "query_id")
    return top.select("query_id", "domain", "chunk_id", F.round(S.overlap(F.col("query"), F.col("text")), 6).alias("overlap"))


def _reranked(name: str, threshold: float):
    @query(name, f"WITH {CH}, {BM}, {SEM}, {FUSED}, {RR.replace('$T', str(threshold))} SELECT query_id, domain, chunk_id, rerank_score, rerank_rank FROM rr")
    def _(t):
        return S.rerank(hits(t), threshold=threshold).select("query_id", "domain", "chunk_id", "rerank_score", "rerank_rank")


_reranked("m6_f6_rerank", S.THRESHOLD)
_reranked("m6_rerank_low_threshold", 0.05)
_reranked("m7_study_rerank", -5.0)


def _arms(asks: str, fits: str, keep: str) -> str:
    """Both arms, filtered by file and ranked again, fused."""
    arms = f"""fc AS (SELECT query_id, domain, chunk_id, score, rank, 's' AS arm FROM sem UNION ALL SELECT query_id, domain, chunk_id, score, rank, 'k' FROM bm),
fm AS (SELECT fc.*, {asks} AND ({fits}) AS fits FROM fc JOIN ch USING (domain, chunk_id) WHERE rank <= CASE WHEN {asks} THEN 72 ELSE 24 END),
fs AS (SELECT *, bool_or(fits) OVER (PARTITION BY query_id, domain) AS any_fits FROM fm),
fr AS (SELECT arm, query_id, domain, chunk_id, score, row_number() OVER (PARTITION BY arm, query_id, domain ORDER BY rank) AS rank FROM fs WHERE {keep})"""
    fused = FUSED.replace("FROM sem WHERE rank <= 24", "FROM fr WHERE arm = 's'").replace("FROM bm WHERE rank <= 24", "FROM fr WHERE arm = 'k'")
    return f"WITH {CH}, {BM}, {SEM}, {arms}, {fused} SELECT query_id, domain, chunk_id, semantic_score, bm25_score, rrf, rank FROM hits"


def _filtered(t, names, strict):
    ch, held = t.corpus()
    qv, cv = vectors(t, ch)
    q = benchmark(t)
    return S.hybrid(q, qv, ch, cv, held=held, files=q.select("query_id", names.alias("names")), strict=strict).select("query_id", "domain", "chunk_id", "semantic_score", "bm25_score", "rrf", "rank")


@query("f3_soft_filter", _arms("query_id % 3 > 0", "contains(source_file, CASE WHEN query_id % 3 = 1 THEN 'src1/' ELSE 'none' END)", "fits OR NOT any_fits"))
def _(t):
    i = F.col("query_id") % 3
    return _filtered(t, F.when(i == 1, F.array(F.lit("src1/"))).when(i == 2, F.array(F.lit("none"))), False)


@query("f4_strict_filter", _arms("query_id % 3 > 0", "contains(source_file, CASE WHEN query_id % 3 = 1 THEN 'src1/' ELSE 'none' END) OR (query_id % 3 = 1 AND contains(source_file, 'src2/'))", "fits OR NOT query_id % 3 > 0"))
def _(t):
    i = F.col("query_id") % 3
    return _filtered(t, F.when(i == 1, F.array(F.lit("src1/"), F.lit("src2/"))).when(i == 2, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>")), True)


_RRL = f"{CH}, {BM}, {SEM}, {FUSED}, {RR.replace('$T', '0.05')}"


@query("a5_score_summary", f"WITH {_RRL} SELECT query_id, domain, count, {xr('hi', 4)} AS top_score, {xr('lo', 4)} AS min_score, {xr('mid', 4)} AS avg_score, labels FROM (SELECT query_id, domain, count(*) AS count, max(rerank_score) AS hi, min(rerank_score) AS lo, favg(rerank_score) AS mid, string_agg(chunk_id, '|' ORDER BY rerank_rank) AS labels FROM rr GROUP BY query_id, domain)")
def _(t):
    return S.score_summary(S.rerank(hits(t), threshold=0.05))


@query("a12_sources_used", f"WITH {_RRL} SELECT query_id, string_agg(DISTINCT regexp_extract(source_file, '([^/]*)$', 1), '|' ORDER BY regexp_extract(source_file, '([^/]*)$', 1)) AS files FROM rr GROUP BY query_id")
def _(t):
    return S.rerank(hits(t), threshold=0.05).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(T.basename(F.col("source_file")))), "|").alias("files"))


_STEM = "regexp_replace(regexp_extract(source_file, '([^/]*)$', 1), '\\.[^.]+$', '')"


@query("a15_t27_prompt_context", f"WITH {_RRL} SELECT query_id, domain, md5(string_agg(concat('[Source ', rerank_rank, '] — ', {LABEL.format(_STEM)}, '  (domain: ', domain, ', score: ', printf('%.3f', rerank_score), ')', chr(10), text), chr(10) || '---' || chr(10) ORDER BY rerank_rank)) AS context_md5 FROM rr GROUP BY query_id, domain")
def _(t):
    return S.prompt_context(S.rerank(hits(t), threshold=0.05)).select("query_id", "domain", F.md5("context").alias("context_md5"))


@query("t27_empty_context", f"WITH {_RRL} SELECT i.item_id AS query_id, d.domain, max(rr.chunk_id) IS NULL AS empty FROM benchmark i CROSS JOIN (VALUES ('de'), ('xx')) d(domain) LEFT JOIN rr ON rr.query_id = i.item_id AND rr.domain = d.domain GROUP BY ALL")
def _(t):
    asked = benchmark(t).select("query_id", F.explode(F.array(F.lit("de"), F.lit("xx"))).alias("domain"))
    return S.prompt_context(S.rerank(hits(t), threshold=0.05), asked).select("query_id", "domain", (F.col("context") == S.NO_CONTEXT).alias("empty"))


_LOGIT = "CASE WHEN length(r1.text) % 3 > 0 THEN (length(r1.text) % 90) / 10.0 - 6 END"


@query("m7_cross_encoder", f"WITH {CH}, {BM}, {SEM}, {FUSED}, {RR.replace('$T', '-5.0').replace('r2 AS (SELECT *,', 'e1 AS (SELECT * REPLACE (coalesce(CAST(' + _LOGIT + ' AS DOUBLE), rerank_score) AS rerank_score) FROM r1), r2 AS (SELECT *,').replace('FROM r1),' + chr(10) + 'rr', 'FROM e1),' + chr(10) + 'rr')} SELECT query_id, domain, chunk_id, rerank_score, rerank_rank FROM rr")
def _(t):
    return S.rerank(hits(t), threshold=-5.0, encoder=C.task_model(_load_encoder, "double")).select("query_id", "domain", "chunk_id", "rerank_score", "rerank_rank")


def _load_encoder():
    """A stand-in for a cross-encoder, loaded once a task: scores by length, and no
    score for every third text."""
    return lambda queries, texts: [(len(x) % 90) / 10.0 - 6 if len(x) % 3 else None for x in texts]


# ---------------------------------------------------------------- routing and answers

_LOW = "lower(text)"
_N = {d: " + ".join(f"contains({_LOW}, '{k}')::INT" for k in ks) for d, ks in KEYWORDS.items()}
_DOMS = "list_filter([" + ", ".join(f"CASE WHEN {n} > 0 THEN '{d}' END" for d, n in _N.items()) + "], lambda x: x IS NOT NULL)"
_GUESS = "CASE " + " ".join(f"WHEN greatest({', '.join(_N.values())}) = {n} THEN '{d}'" for d, n in _N.items()) + " END"


@query("c1_keyword_route", f"SELECT item_id AS query_id, array_to_string(d, ',') AS domains, CASE WHEN len(d) > 1 THEN 'multi' ELSE 'single' END AS intent_type, len(d) > 0 AS is_related, len({_WORDS}) < 4 AND len(d) = 0 AS needs_clarification FROM (SELECT *, {_DOMS} AS d FROM benchmark)")
def _(t):
    return R.route(benchmark(t), KEYWORDS).select("query_id", F.array_join("domains", ",").alias("domains"), "intent_type", "is_related", "needs_clarification")


@query("c3_clarify", f"SELECT conv_id, turn, CASE WHEN len({_DOMS}) > 0 THEN FALSE ELSE len({_WORDS}) < 4 END AS clarify FROM conversations")
def _(t):
    r = R.route(t("conversations").select("conv_id", "turn", F.col("text").alias("query")), KEYWORDS)
    return r.select("conv_id", "turn", R.should_clarify(F.size("domains"), F.col("needs_clarification"), F.col("is_related"), F.col("query")).alias("clarify"))


@query("a11_guess_domain", f"SELECT item_id, {_GUESS} AS domain FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", R.guess(F.col("text"), KEYWORDS).alias("domain"))


@query("c5_c6_fallback_split", f"""WITH q AS (SELECT item_id AS query_id, text, {_DOMS} AS d, list_filter({_SENT.format('text')}, lambda x: trim(x) <> '') AS s, {_GUESS} AS g FROM benchmark)
SELECT query_id, (unnest(range(len(s))))::INTEGER AS pos, trim(unnest(s)) AS question, unnest(list_transform(range(len(s)), lambda i: d[i % len(d) + 1])) AS domain FROM q WHERE len(d) > 1 AND len(s) > 1
UNION ALL SELECT query_id, 0, text, coalesce(d[1], g) FROM q WHERE NOT (len(d) > 1 AND len(s) > 1)""")
def _(t):
    return R.split(R.route(benchmark(t), KEYWORDS), KEYWORDS)


@query("c4_canned_responses", f"SELECT item_id, CASE WHEN len({_DOMS}) = 0 THEN '{A.UNRELATED}' WHEN item_id % 2 = 0 THEN '{A.CLARIFY} Which file?' END AS answer FROM benchmark")
def _(t):
    r = R.route(benchmark(t), KEYWORDS)
    return r.select(F.col("query_id").alias("item_id"), A.canned(F.col("is_related"), F.col("query_id") % 2 == 0, F.lit("Which file?")).alias("answer"))


_ANS = f"""{_RRL}, an AS (SELECT query_id, domain, string_agg(concat(array_to_string(({_SENT.format('text')})[1:2], ' '), ' [Source ', rerank_rank, ']'), ' ' ORDER BY rerank_rank) AS answer, count(*)::INTEGER AS n_used FROM rr GROUP BY query_id, domain)"""


@query("c9_domain_answers", f"WITH {_ANS} SELECT query_id, domain, md5(answer) AS answer_md5, n_used FROM an")
def _(t):
    return A.domain_answers(S.rerank(hits(t), threshold=0.05)).select("query_id", "domain", F.md5("answer").alias("answer_md5"), "n_used")


@query("c10_synthesis", f"WITH {_ANS} SELECT item_id AS query_id, md5(CASE count(answer) WHEN 0 THEN '{A.NO_EVIDENCE}' WHEN 1 THEN max(answer) ELSE string_agg(concat('**', domain, '**', chr(10), answer), chr(10) || chr(10) ORDER BY domain) END) AS answer_md5 FROM benchmark LEFT JOIN an ON query_id = item_id GROUP BY item_id")
def _(t):
    a = A.domain_answers(S.rerank(hits(t), threshold=0.05))
    return A.synthesize(a, benchmark(t)).select("query_id", F.md5("answer").alias("answer_md5"))


@query("c2_router_replies", f"""SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'de,en' WHEN 2 THEN '' ELSE array_to_string(d, ',') END AS domains, CASE item_id % 4 WHEN 0 THEN 'multi' WHEN 1 THEN 'single' WHEN 2 THEN 'single' ELSE CASE WHEN len(d) > 1 THEN 'multi' ELSE 'single' END END AS intent_type,
 CASE WHEN item_id % 4 IN (0, 1) THEN TRUE WHEN item_id % 4 = 2 THEN FALSE ELSE len(d) > 0 END AS is_related FROM (SELECT *, {_DOMS} AS d FROM benchmark)""")
def _(t):
    i = F.col("query_id") % 8
    said = F.when(i % 4 == 0, '{"intent_type":"multi","domains":["DE","en","XX"]}').when(i % 4 == 1, '```json\n{"intent_type":"odd","domains":["nowhere"]}\n```').when(i % 4 == 2, '{"domains":[],"is_course_related":false}').when(i == 3, "no json here")
    return R.route_by(benchmark(t), KEYWORDS, said).select("query_id", F.array_join("domains", ",").alias("domains"), "intent_type", "is_related")


@query("c5_splitter_replies", f"""WITH q AS (SELECT item_id AS query_id, text, {_DOMS} AS d, {_GUESS} AS g, list_filter({_SENT.format('text')}, lambda x: trim(x) <> '') AS s FROM benchmark),
m AS (SELECT * FROM q WHERE len(d) > 1)
SELECT query_id, 0 AS pos, text AS question, coalesce(d[1], g) AS domain FROM q WHERE len(d) <= 1
UNION ALL SELECT query_id, 0, 'what about it', 'de' FROM m WHERE query_id % 3 = 0 UNION ALL SELECT query_id, 1, 'les eaux', 'fr' FROM m WHERE query_id % 3 = 0
UNION ALL SELECT query_id, (unnest(range(len(s))))::INTEGER, trim(unnest(s)), unnest(list_transform(range(len(s)), lambda i: d[i % len(d) + 1])) FROM m WHERE query_id % 3 > 0 AND len(s) > 1
UNION ALL SELECT query_id, 0, text, d[1] FROM m WHERE query_id % 3 > 0 AND len(s) <= 1""")
def _(t):
    i = F.col("query_id") % 3
    said = F.when(i == 0, '{"sub_questions":[{"question":" what about it ","domain":"de"},{"question":"les eaux","domain":"MARS"},{"question":" ","domain":"en"}]}').when(i == 1, '{"sub_questions":[]}')
    return R.split_by(R.route(benchmark(t), KEYWORDS), KEYWORDS, said)


@query("c11_verifier_replies", """SELECT item_id, CASE item_id % 4 WHEN 0 THEN FALSE ELSE TRUE END AS is_satisfactory, CASE item_id % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 1.0 ELSE 0.7 END::DOUBLE AS quality, CASE item_id % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.7 ELSE 1.0 END::DOUBLE AS coverage,
 CASE item_id % 4 WHEN 0 THEN 'better' END AS revised FROM benchmark""")
def _(t):
    i = F.col("item_id") % 4
    said = F.when(i == 0, '{"is_satisfactory":false,"quality_score":0.4,"revised_answer":"better"}').when(i == 1, '{"quality_score":3,"revised_answer":"unused"}').when(i == 2, "I think it is fine")
    return t("benchmark").select("item_id", A.verify(said).alias("v")).select("item_id", "v.is_satisfactory", "v.quality", "v.coverage", F.col("v.revised_answer").alias("revised"))


@query("c14_client_fallback", "SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'big-a' WHEN 3 THEN NULL ELSE 'other-b' END AS model, CASE WHEN item_id % 4 = 3 THEN 'Connection reset' END AS error, CASE WHEN item_id % 4 < 3 THEN length(text) END::INTEGER AS n, TRUE AS timed FROM benchmark")
def _(t):
    prompts = benchmark(t).select("query_id", F.concat((F.col("query_id") % 4).cast("string"), "query").alias("prompt"))
    r = C.replies(prompts, ["big-a", "other-b"], {"x": _first, "y": _second}, {"big": "x"}, "y", sleep=_no_wait)
    return r.select("query_id", "model", "error", (F.length("reply") - 1).alias("n"), (F.col("latency_ms") >= 0).alias("timed"))


def _first(model: str, prompt: str) -> str:
    """A stand-in for a model: rate limits, daily limits and failures by the prompt."""
    errors = {"1": "429 retry in 0s", "2": "429 perday", "3": "boom"}
    if prompt[0] in errors:
        raise RuntimeError(errors[prompt[0]])
    return prompt


def _second(model: str, prompt: str) -> str:
    if prompt[0] == "3":
        raise RuntimeError("Connection reset")
    return prompt


def _no_wait(seconds: float) -> None:
    pass


@query("c16_run_all", f"""WITH q AS (SELECT item_id, {_DOMS} AS d, CASE WHEN item_id % 2 = 0 THEN 'any' ELSE 'multi' END AS ei FROM benchmark)
SELECT item_id AS query_id, item_id % 5 > 0 AND (ei = 'any' OR len(d) > 1) AS intent_ok, item_id % 5 > 0 AND list_contains(d, 'en') AS domain_ok, item_id % 5 > 0 AND (ei = 'any' OR len(d) > 1) AND list_contains(d, 'en') AS passed, CASE WHEN item_id % 10 = 0 THEN 'no result' WHEN item_id % 5 = 0 THEN 'broken' END AS error FROM q""")
def _(t):
    cases = benchmark(t).withColumn("expected_intent", F.when(F.col("query_id") % 2 == 0, "any").otherwise("multi")).withColumn("expected", F.array(F.lit("en")))

    def pipeline(q):
        r = R.route(q.where("query_id % 10 <> 0"), KEYWORDS)
        error = F.when(F.col("query_id") % 5 == 0, "broken")
        return r.select("query_id", F.col("domains").alias("actual"), F.col("intent_type").alias("intent"), "needs_clarification", "is_related", error.alias("error"))

    return E.run_all(cases, pipeline).select("query_id", "intent_ok", "domain_ok", "passed", "error")


@query("c16_in_parts", f"""WITH q AS (SELECT item_id, {_DOMS} AS d FROM benchmark)
SELECT item_id AS query_id, concat('c', item_id % 3) AS category, item_id % 5 > 0 AND list_contains(d, 'en') AS passed, CASE WHEN item_id % 5 = 0 THEN 'broken' END AS error FROM q""")
def _(t):
    cases = benchmark(t).select("query_id", "query", F.concat(F.lit("c"), F.col("query_id") % 3).alias("category"), F.lit("any").alias("expected_intent"), F.array(F.lit("en")).alias("expected"))

    def pipeline(q):
        error = F.when(F.col("query_id") % 5 == 0, "broken")
        return R.route(q, KEYWORDS).select("query_id", F.col("domains").alias("actual"), F.col("intent_type").alias("intent"), "needs_clarification", "is_related", error.alias("error"))

    return batches.evaluate(cases, pipeline, parts=3).select("query_id", "category", "passed", "error")


_DA = f"""{_RRL}, ad AS (SELECT item_id AS query_id, a.domain, string_agg(concat(array_to_string(({_SENT.format('rr.text')})[1:2], ' '), ' [Source ', rerank_rank, ']'), ' ' ORDER BY rerank_rank) AS answer, count(chunk_id)::INTEGER AS n_used
 FROM (SELECT item_id, unnest(['de', 'xx', 'fr'][1:item_id % 4]) AS domain FROM benchmark) a LEFT JOIN (SELECT * FROM rr WHERE query_id % 5 > 0) rr ON rr.query_id = item_id AND rr.domain = a.domain GROUP BY item_id, a.domain)"""


def _asked_evidence(t) -> tuple[DataFrame, DataFrame]:
    names = F.slice(F.array(F.lit("de"), F.lit("xx"), F.lit("fr")), 1, (F.col("query_id") % 4).cast("int"))
    asked = benchmark(t).select("query_id", F.explode(names).alias("domain"), F.col("query").alias("question"))
    return S.rerank(hits(t), threshold=0.05).where("query_id % 5 > 0"), asked


def _asked_answers(t) -> DataFrame:
    evidence, asked = _asked_evidence(t)
    return A.domain_answers(evidence, asked=asked, unaided=lambda q: F.concat(F.lit("unaided "), F.length(q).cast("string")))


@query("c9_unaided_answers", f"WITH {_DA} SELECT query_id, domain, CASE WHEN n_used > 0 THEN md5(answer) ELSE md5(concat('unaided ', length(b.text))) END AS answer_md5, n_used, n_used = 0 AS no_evidence FROM ad JOIN benchmark b ON item_id = query_id")
def _(t):
    return _asked_answers(t).select("query_id", "domain", F.md5("answer").alias("answer_md5"), "n_used", "no_evidence")


@query("c10_no_evidence_dropped", f"""WITH {_DA} SELECT item_id AS query_id, md5(CASE WHEN count(*) FILTER (n_used > 0) = 0 THEN '{A.NO_EVIDENCE}' WHEN count(*) FILTER (n_used > 0) = 1 THEN max(answer) FILTER (n_used > 0) ELSE string_agg(concat('**', domain, '**', chr(10), answer), chr(10) || chr(10) ORDER BY domain) FILTER (n_used > 0) END) AS answer_md5
 FROM benchmark LEFT JOIN ad ON query_id = item_id GROUP BY item_id""")
def _(t):
    return A.synthesize(_asked_answers(t), benchmark(t)).select("query_id", F.md5("answer").alias("answer_md5"))


_BETTER = "A better answer, which is long enough to take the place of the first one."


def _verifier(query, answer):
    """A stand-in for a verifier: rejects, scores or chats by the answer's length."""
    n = F.length(answer) % 3
    said = f'{{"is_satisfactory":false,"quality_score":0.4,"revised_answer":"{_BETTER}"}}'
    return F.when(n == 0, said).when(n == 1, '{"quality_score":0.9}').otherwise("I think it is fine")


_QUALITY = "CASE length(answer) % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.9 ELSE 0.7 END"
_FIRST2 = f"array_to_string(({_SENT.format('text')})[1:2], ' ')"


@query("c17_pipeline", f"""WITH {_ANS.replace('>= 0.05', '>= 0.2')}, rt AS (SELECT item_id AS query_id, text, {_DOMS} AS d, list_filter({_SENT.format('text')}, lambda x: trim(x) <> '') AS s FROM benchmark),
asked AS (SELECT DISTINCT query_id, domain FROM (SELECT query_id, unnest(CASE WHEN len(d) > 1 AND len(s) > 1 THEN list_transform(range(len(s)), lambda i: d[i % len(d) + 1]) ELSE [d[1]] END) AS domain FROM rt WHERE len(d) > 0)),
said AS (SELECT a.query_id, sum(n_used)::BIGINT AS n_used, CASE count(answer) WHEN 0 THEN '{A.NO_EVIDENCE}' WHEN 1 THEN max(answer) ELSE string_agg(concat('**', a.domain, '**', chr(10), answer), chr(10) || chr(10) ORDER BY a.domain) FILTER (answer IS NOT NULL) END AS answer
 FROM asked a LEFT JOIN an ON an.query_id = a.query_id AND an.domain = a.domain GROUP BY a.query_id)
SELECT rt.query_id, CASE WHEN len(d) > 1 THEN 'multi' ELSE 'single' END AS intent_type, array_to_string(d, ',') AS domains, coalesce(n_used, 0)::BIGINT AS n_used, len(d) = 0 AS early,
 CASE WHEN len(d) = 0 THEN 0.0 ELSE {_QUALITY} END::DOUBLE AS quality, md5(CASE WHEN len(d) = 0 THEN '{A.UNRELATED}' WHEN length(answer) % 3 = 0 THEN '{_BETTER}' ELSE answer END) AS answer_md5 FROM rt LEFT JOIN said USING (query_id)""")
def _(t):
    from quarry.plans import hybrid

    ch, held = t.corpus()
    qv, cv = vectors(t, ch)
    r = hybrid.answer(benchmark(t), qv, ch, cv, KEYWORDS, held=held, verifier=_verifier)
    return r.select("query_id", "intent_type", F.array_join("domains", ",").alias("domains"), "n_used", "early", "quality", F.md5("answer").alias("answer_md5"))


@query("c18_study_pipeline", f"""WITH {CH.replace('lang AS domain', chr(39) + 'S' + chr(39) + ' AS domain')}, {BM}, {SEM}, fc AS (SELECT query_id, domain, chunk_id, score, rank, 's' AS arm FROM sem UNION ALL SELECT query_id, domain, chunk_id, score, rank, 'k' FROM bm),
fm AS (SELECT fc.*, query_id % 3 = 1 AS asks, (query_id % 3 = 1 AND contains(source_file, CASE WHEN query_id % 2 = 0 THEN 'src2/' ELSE 'none' END)) AS fits FROM fc JOIN ch USING (domain, chunk_id)),
fr AS (SELECT arm, query_id, domain, chunk_id, score, row_number() OVER (PARTITION BY arm, query_id, domain ORDER BY rank) AS rank FROM fm WHERE rank <= CASE WHEN asks THEN 144 ELSE 48 END AND (fits OR NOT asks)),
{FUSED.replace("FROM sem WHERE rank <= 24", "FROM fr WHERE arm = 's'").replace("FROM bm WHERE rank <= 24", "FROM fr WHERE arm = 'k'")},
{RR.replace('$T', '-5.0').replace('rerank_rank <= 5', 'rerank_rank <= 8')},
an AS (SELECT query_id, string_agg(concat({_FIRST2}, ' [Source ', rerank_rank, ']'), ' ' ORDER BY rerank_rank) AS answer, count(*)::INTEGER AS n_used, list({LABEL.format(_STEM)} ORDER BY rerank_rank) AS l,
 list_sort(list_distinct(list(regexp_extract(source_file, '([^/]*)$', 1)))) AS sources FROM rr GROUP BY query_id),
ar AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS labels FROM an)
SELECT item_id AS query_id, coalesce(n_used, 0)::INTEGER AS n_used, CASE WHEN n_used > 0 THEN NULL WHEN item_id % 3 = 1 THEN 'filtered' ELSE 'irrelevant' END AS stopped, CASE WHEN n_used > 0 THEN greatest({_QUALITY}, 0.75) ELSE 0.0 END::DOUBLE AS quality,
 md5(CASE WHEN n_used > 0 THEN concat(answer, chr(10), chr(10), 'References', chr(10), array_to_string(list_transform(labels, lambda x, i: concat(i, '. ', x)), chr(10)))
     WHEN item_id % 3 = 1 THEN concat('{A.NOT_IN_FILES}', CASE WHEN item_id % 2 = 0 THEN 'src2/' ELSE 'none' END) ELSE '{A.NOT_RELEVANT}the uploaded documents' END) AS answer_md5, coalesce(array_to_string(sources, '|'), '') AS sources
FROM benchmark LEFT JOIN ar ON query_id = item_id""")
def _(t):
    from quarry.plans import hybrid

    ch = S.index(T.chunks(scratch.spread(files(t).withColumn("domain", F.lit("S")))))
    qv, cv = vectors(t, ch)
    q = benchmark(t)
    names = F.when(F.col("query_id") % 3 == 1, F.array(F.when(F.col("query_id") % 2 == 0, "src2/").otherwise("none")))
    r = hybrid.study(q, qv, ch, cv, files=q.select("query_id", names.alias("names")), verifier=_verifier)
    return r.select("query_id", "n_used", "stopped", "quality", F.md5("answer").alias("answer_md5"), F.array_join("sources", "|").alias("sources"))


@query("c13_refusals", f"WITH {_DA} SELECT query_id, domain, md5(CASE WHEN n_used > 0 THEN answer ELSE '{A.REFUSED}' END) AS answer_md5, n_used = 0 AS no_evidence FROM ad")
def _(t):
    evidence, asked = _asked_evidence(t)
    return A.study_answers(evidence, asked).select("query_id", "domain", F.md5("answer").alias("answer_md5"), "no_evidence")


@query("jn6_keyword_table", f"""WITH k AS (SELECT DISTINCT lang AS domain, ({tok('text')})[-1] AS keyword FROM documents),
n AS (SELECT item_id, domain, count(*) AS n FROM benchmark JOIN k ON contains(lower(text), keyword) GROUP BY ALL)
SELECT b.item_id AS query_id, coalesce(string_agg(domain, ',' ORDER BY domain), '') AS domains, coalesce(first(domain ORDER BY n DESC, domain), (SELECT min(domain) FROM k WHERE keyword IS NOT NULL)) AS guess FROM benchmark b LEFT JOIN n USING (item_id) GROUP BY b.item_id""")
def _(t):
    """Each document's last token as a keyword of its language."""
    keywords = t("documents").select(F.col("lang").alias("domain"), F.try_element_at(T.tokens(F.col("text")), F.lit(-1)).alias("keyword"))
    return W.route(benchmark(t), keywords).select("query_id", F.array_join("domains", ",").alias("domains"), "guess")


@query("c12_c13_final_answer", "SELECT doc_id, CASE WHEN quality = 0 THEN concat(repeat('better ', 9), toxic) ELSE 'short' END AS answer, concat('x', chr(10), chr(10), 'References', chr(10), '1. Doc ', doc_id) AS study FROM labels")
def _(t):
    better = F.concat(F.lit("better " * 9), F.col("toxic").cast("string"))
    return t("labels").select("doc_id", A.final_answer(F.lit("short"), F.col("quality") == 1, better).alias("answer"), A.with_references(F.lit("x"), F.array(F.concat(F.lit("Doc "), "doc_id"))).alias("study"))


# ---------------------------------------------------------------- evaluation


@query("m8_hit_rate", "SELECT item_id, round(len(list_filter(['the', 'tion', 'keit', 'ción', 'zzz'], lambda k: contains(lower(text), k))) / 5.0, 3) AS hit_rate FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", E.hit_rate(F.array(*[F.lit(k) for k in ("the", "tion", "keit", "ción", "zzz")]), F.array("text")).alias("hit_rate"))


@query("m9_citation_accuracy", rf"""WITH a AS (SELECT item_id, concat(text, ' [Source 1] [Source ', item_id % 3 + 1, '] last [source 2].') AS answer FROM benchmark),
src AS (SELECT item_id, item_id % 3 + 1 AS source_num, 0 AS pos, lower(text) AS st FROM benchmark UNION ALL SELECT item_id, 2, 1, 'nothing' FROM benchmark),
f AS (SELECT item_id, source_num, arg_min(st, pos) AS st FROM src GROUP BY ALL),
s AS (SELECT item_id, unnest({_SENT.format('answer')}) AS s FROM a),
c AS (SELECT item_id, {sig('s')} AS w, unnest(list_transform(regexp_extract_all(s, '(?i)\[Source\s+(\d+)\]', 1), lambda x: x::INT)) AS source_num FROM s)
SELECT item_id AS answer_id, round(sum(CASE WHEN len(list_filter(w, lambda x: contains(f.st, x))) > 0 THEN 1 ELSE 0 END) / count(*), 3) AS citation_accuracy FROM c LEFT JOIN f USING (item_id, source_num) GROUP BY item_id""")
def _(t):
    b = t("benchmark").withColumnRenamed("item_id", "answer_id")
    answer = F.concat("text", F.lit(" [Source 1] [Source "), F.col("answer_id") % 3 + 1, F.lit("] last [source 2]."))
    src = b.select("answer_id", (F.col("answer_id") % 3 + 1).cast("int").alias("source_num"), F.lit(0).alias("pos"), "text").unionByName(b.select("answer_id", F.lit(2).alias("source_num"), F.lit(1).alias("pos"), F.lit("nothing").alias("text")))
    return E.citation_accuracy(b.select("answer_id", answer.alias("answer")), src)


@query("m10_answer_relevance", "SELECT v.vec_id, greatest(0, round(list_sum(list_transform(list_zip(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), lambda x: x[1] * x[2])), 3)) AS relevance FROM embeddings v JOIN embeddings w ON w.vec_id = v.vec_id + 1")
def _(t):
    e = t("embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.greatest(F.lit(0.0), F.round(S.dot(F.col("embedding"), F.col("other")), 3)).alias("relevance"))


@query("m10_relevance_of_heads", "SELECT v.vec_id, CASE WHEN v.vec_id % 5 = 0 THEN 0.0 ELSE greatest(0, round(list_sum(list_transform(list_zip(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), lambda x: x[1] * x[2])), 3)) END AS relevance FROM embeddings v JOIN embeddings w ON w.vec_id = v.vec_id + 2")
def _(t):
    e = t("embeddings").select("vec_id", F.when(F.col("vec_id") % 5 > 0, F.col("embedding")).alias("vector"))
    n = t("embeddings").select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("head"))
    return e.join(n, "vec_id").select("vec_id", E.relevance(F.col("vector"), F.col("head")).alias("relevance"))


@query("m10_embedded_relevance", None)
def _(t):
    """Questions and the heads of the documents of the same number, both embedded by
    the model of the corpus: without SQL, as it needs a decomposition (tested)."""
    embed = M.fit(indexed(t)).column(t.spark)
    said = t("documents").select(F.col("doc_id").alias("query_id"), E.head(F.col("text")).alias("head"))
    both = benchmark(t).join(said, "query_id")
    return both.select("query_id", E.relevance(embed(F.col("query")), embed(F.col("head"))).alias("relevance"))


@query("m11_faithfulness", """SELECT item_id, CASE WHEN item_id % 6 = 0 THEN 1.0 WHEN item_id % 6 = 1 THEN 0.7 WHEN item_id % 6 = 2 THEN 1.0 WHEN item_id % 6 = 3 THEN 0.9 ELSE 0.85 END::DOUBLE AS faithfulness, md5(left(text, 2000)) AS answer_md5 FROM benchmark""")
def _(t):
    i = F.col("item_id") % 6
    said = F.when(i == 1, '{"score": 7}').when(i == 2, 'so: {"score": 12}').when(i == 3, '{"reasoning": "none"}')
    held = F.when(i == 0, F.array().cast("array<string>")).otherwise(F.array("text"))
    answer, _ = E.judged_excerpt(F.col("text"), held)
    return t("benchmark").select("item_id", E.faithfulness(F.col("text"), held, said).alias("faithfulness"), F.md5(answer).alias("answer_md5"))


@query("m11_faithfulness_offline", f"SELECT item_id, CASE WHEN len(a) > 0 THEN {xr('x', 3)} ELSE 1.0 END AS faithfulness FROM (SELECT *, len(list_intersect(a, b))::DOUBLE / nullif(len(a), 0) AS x FROM (SELECT item_id, list_distinct({tok('b.text')}) AS a, {tok('d.text')} AS b FROM benchmark b JOIN documents d ON doc_id = item_id))")
def _(t):
    j = t("benchmark").join(t("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("other")), "item_id")
    return j.select("item_id", E.containment(F.col("text"), F.col("other")).alias("faithfulness"))


@query("m13_latency", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round((event_id % 1000) * 1.75::DOUBLE, 1) END::DOUBLE AS latency_ms FROM events")
def _(t):
    took = F.make_dt_interval(secs=((F.col("event_id") % 1000) * 1750 / 1000000).cast("decimal(18,6)"))
    end = F.when(F.col("event_id") % 5 > 0, F.col("ts") + took)
    return t("events").select("event_id", E.latency_ms(F.col("ts"), end).alias("latency_ms"))


@query("m12_quality_floor", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN greatest(value / 100, 0.75) ELSE value / 100 END AS quality FROM events")
def _(t):
    said = F.when(F.col("event_id") % 3 == 0, "I Cannot Find it").otherwise("here")
    return t("events").select("event_id", E.quality_floor(F.col("value") / 100, F.col("event_id") % 2 == 0, said).alias("quality"))


@query("c15_case_verdict", f"""SELECT item_id, i AS intent_ok, o AS domain_ok, i AND o AND item_id % 7 <> 0 AS passed FROM (SELECT item_id, item_id % 4 = 0 OR (item_id % 4 = 1) = (len(d) > 1) AS i,
 CASE WHEN item_id % 5 = 0 THEN len(d) = 0 OR (len({_WORDS}) < 4 AND len(d) = 0) ELSE list_contains(d, 'en') END AS o FROM (SELECT *, {_DOMS} AS d FROM benchmark))""")
def _(t):
    i = F.col("query_id")
    r = R.route(benchmark(t), KEYWORDS).withColumn("actual", F.col("domains")).withColumn("intent", F.col("intent_type"))
    r = r.withColumn("expected_intent", F.when(i % 4 == 0, "any").when(i % 4 == 1, "multi").otherwise("single")).withColumn("expected", F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("en")))).withColumn("check_ok", i % 7 != 0)
    return E.case_verdict(r).select(i.alias("item_id"), "intent_ok", "domain_ok", "passed")


@query("p1_hybrid_search_e2e", f"""WITH {CH}, {BM}, {SEM}, {FUSED}, {RR.replace('$T', '0.2')},
rt AS (SELECT item_id AS query_id, unnest(CASE WHEN len(d) > 0 THEN d ELSE [g] END) AS domain FROM (SELECT item_id, {_DOMS} AS d, {_GUESS} AS g FROM benchmark))
SELECT query_id, domain, chunk_id, semantic_score, bm25_score, rrf, rerank_score, rerank_rank FROM rr JOIN rt USING (query_id, domain)""")
def _(t):
    from quarry.plans import hybrid

    ch, held = t.corpus()
    qv, cv = vectors(t, ch)
    return hybrid.evidence(benchmark(t), qv, ch, cv, KEYWORDS, held=held).select("query_id", "domain", "chunk_id", "semantic_score", "bm25_score", "rrf", "rerank_score", "rerank_rank")
