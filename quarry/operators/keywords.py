"""Routing by keyword tables of any size, through multi-pattern automata.

``routing`` compares a question with each keyword by an expression of its own, which
suits a handful. Here the keywords are rows (domain, keyword), read in blocks of
``BLOCK``; a task makes a block's Aho-Corasick automaton once and runs the questions
of its batches through it, each in one pass whatever the number of keywords. Counts
of the blocks are added up. Keywords match as substrings, whatever their case.

Defined results: a null question has no keyword; repeated keywords of a domain count
once, one keyword may count for several domains; an empty keyword is in every
question; rows without a domain or keyword are ignored.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.postings import small
from quarry.sources import scratch

BLOCK = 200_000


def _automaton(rows: list[tuple[str, str]]):
    """Keyword -> domains; and the domains of the empty keyword."""
    domains: dict[str, set[str]] = {}
    for domain, keyword in rows:
        domains.setdefault(keyword, set()).add(domain)
    everywhere = domains.pop("", set())
    made = ahocorasick.Automaton()
    for keyword, of in domains.items():
        made.add_word(keyword, (keyword, tuple(of)))
    made.make_automaton()
    return made, everywhere


def _found(held):
    def run(batches):
        automaton, everywhere = _automaton(held.value)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("_row").to_pylist(), batch.column("_low").to_pylist()):
                if text is None:
                    continue
                hits = {of for _, of in automaton.iter(text)} if len(automaton) else set()
                counts = Counter(d for _, of in hits for d in of) + Counter(everywhere)
                rows += [(i, d, n) for d, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.string(), pa.int64()))], ["_row", "domain", "n"])

    return run


def counts(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(_row, domain, n): how many of a domain's keywords are in a question, for
    (_row long, query)."""
    spark = queries.sparkSession
    known = keywords.where("domain IS NOT NULL AND keyword IS NOT NULL").select("domain", F.lower("keyword").alias("keyword")).distinct()
    known = scratch.stored(known, "keywords")
    blocks = max(1, -(-known.count() // BLOCK))
    asked = queries.select("_row", F.lower("query").alias("_low"))
    found = None
    for i in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("domain", "keyword"), F.lit(blocks)) == i)
        rows = [tuple(r) for r in part.collect()]  # about a block
        here = asked.mapInArrow(_found(spark.sparkContext.broadcast(rows)), "_row long, domain string, n long")
        found = here if found is None else found.unionByName(here)
    return found if blocks == 1 else found.groupBy("_row", "domain").agg(F.sum("n").alias("n"))


def route(queries: DataFrame, keywords: DataFrame, order: list[str] | None = None) -> DataFrame:
    """As ``routing.route``, with the best guess as ``guess``: of (query_id, query) and
    keywords (domain, keyword). Domains come in ``order``, others by name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in order or []]).cast("array<string>"), F.col("domain")), F.lit(0))
    place = F.when(place > 0, place).otherwise(F.lit(len(order or []) + 1))
    rows = scratch.stored(queries.withColumn("_row", F.monotonically_increasing_id()), "asked")
    per = counts(rows, keywords).withColumn("_place", place)
    first = keywords.where("domain IS NOT NULL AND keyword IS NOT NULL").select("domain").distinct().withColumn("_place", place)
    first = first.agg(F.min_by("domain", F.struct("_place", "domain")).alias("_first"))
    per = per.groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_place", "domain"))), lambda x: x["domain"]).alias("domains"),
        F.min_by("domain", F.struct(-F.col("n"), F.col("_place"), F.col("domain"))).alias("guess"),
    )
    n = F.size("domains")
    out = rows.join(per, "_row", "left").join(small(first), how="cross")  # one row
    out = out.withColumn("domains", F.coalesce("domains", F.array().cast("array<string>"))).withColumn("guess", F.coalesce("guess", "_first"))
    out = out.withColumn("intent_type", F.when(n > 1, "multi").otherwise("single")).withColumn("is_related", n > 0)
    return out.withColumn("needs_clarification", (F.size(T.words(F.col("query"))) < 4) & (n == 0)).select(*queries.columns, "domains", "intent_type", "is_related", "needs_clarification", "guess")
