"""Counts and groupings that status pages show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks_per_file(n_chunks: Column, n_files: Column) -> Column:
    """An estimate, at least 1."""
    return F.greatest(F.lit(1), F.floor(n_chunks / F.greatest(n_files, F.lit(1))).cast("int"))


def total(rows: DataFrame, group: str, amount: str) -> DataFrame:
    """(group, total, n) with null amounts as 0."""
    return rows.groupBy(group).agg(F.sum(F.coalesce(amount, F.lit(0))).alias("total"), F.count(F.lit(1)).alias("n"))


def knowledge_base(chunks: DataFrame, files: DataFrame, uploads: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, chunk_count, kb_files, uploaded_docs) of every domain: its chunks,
    the sorted names of its files and its uploads, the newest first."""
    n = chunks.groupBy("domain").agg(F.count(F.lit(1)).alias("chunk_count"))
    names = files.groupBy("domain").agg(F.array_sort(F.collect_set("name")).alias("kb_files"))
    order = F.sort_array(F.collect_list(F.struct("upload_timestamp", "filename")), asc=False)
    docs = uploads.groupBy("domain").agg(F.transform(order, lambda x: x["filename"]).alias("uploaded_docs"))
    none = F.array().cast("array<string>")
    out = domains.join(n, "domain", "left").join(names, "domain", "left").join(docs, "domain", "left")
    return out.select("domain", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("kb_files", none).alias("kb_files"), F.coalesce("uploaded_docs", none).alias("uploaded_docs"))
