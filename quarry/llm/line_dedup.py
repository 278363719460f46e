"""Line dedup over levelled sorted runs of line hashes.

A run is a table (a, b, n) in hash order, in buckets by hash: the 128-bit line hashes
of some batches, and how many of their documents hold the line. All runs have the
same buckets, so that a batch meets each of them by sorted bucket, without another
shuffle. ``LineIndex.add`` takes a batch:

1. the batch's documents are counted by line (combined before the one shuffle);
2. a merge anti-join with every run takes out the lines that the run has settled,
   those in ``min_docs`` documents already: a hot line enters no further run;
3. the others make the batch's own run at level 0;
4. ``FANOUT`` runs of a level are compacted into one of the next by merge joins.

A line is hot if its counts reach ``min_docs`` over the runs that hold it. The text
is read once for all batches: its hashes are written by batch, each batch then reads
its own. All steps are DataFrame operations; the tables lie in the shared folder.

The key of a line is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z
lower-cased.

Defined results: a null or empty text is one empty line; empty keys are never
dropped; each row counts as a document of its own, also with a repeated or null
doc_id; very long texts are cut into lines whole; an empty table gives an empty
result; other columns are ignored or, in ``drop_lines``, kept, but for its own
n_lines and n_dropped.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

MIN_DOCS = 10
FANOUT = 4
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Hot lines (16 bytes each) that may be broadcast.
BROADCAST_LINES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    bare = F.trim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def hashed(k: Column) -> Column:
    return F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(17), k).alias("b"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame) -> Column:
    """The distinct keys' hashes of a text."""
    keys = F.array_distinct(F.filter(F.transform(lines(F.col("text")), key), lambda k: k != ""))
    return F.transform(keys, hashed)


@contextmanager
def merging(spark: SparkSession):
    """Plans made inside rely on the order of bucketed tables with one file a bucket,
    as runs are, so that joins merge them without sorting (which takes a page of
    memory for each side of each join)."""
    before = spark.conf.get(_ORDERED)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


class LineIndex:
    """The runs, by level."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.tables: list[str] = []

    def _run(self, rows: DataFrame) -> str:
        """A table of ``rows``, which lie in the buckets already."""
        name = f"quarry_run_{uuid.uuid4().hex[:12]}"
        path = runtime.table_path(self.spark, "run")
        with merging(self.spark):
            rows.write.format("parquet").option("path", path).bucketBy(self.buckets, "a", "b").sortBy("a", "b").saveAsTable(name)
        self.tables.append(name)
        return name

    def _drop(self, name: str) -> None:
        runtime.drop_stored(self.spark.table(name))
        self.spark.sql(f"DROP TABLE {name}")
        self.tables.remove(name)

    def add(self, hashes: DataFrame) -> None:
        """A batch: one row (a, b) for each document and distinct line."""
        batch = self._run(hashes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
        self._put(0, self._run(self.open_lines(self.spark.table(batch))))
        self._drop(batch)

    def _put(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._run(self._merged(old)))
            for name in old:
                self._drop(name)

    def _merged(self, runs: list[str]) -> DataFrame:
        """Merge of runs, in which counts add up. Two runs are joined as they lie; what
        comes of a full join has no buckets, and is dealt to them for the next one."""
        out = self.spark.table(runs[0])
        for name in runs[1:]:
            more = self.spark.table(name).withColumnRenamed("n", "m")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            out = out.join(more.hint("merge"), ["a", "b"], "full").select("a", "b", n.alias("n"))
        return out

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def counts(self) -> DataFrame:
        """(a, b, n) over all batches so far; of a settled line what settled it."""
        return self._merged(self.runs()) if self.runs() else self.spark.createDataFrame([], "a long, b long, n long")

    def open_lines(self, counts: DataFrame) -> DataFrame:
        """The batch's lines that no run has settled: a merge anti-join with each."""
        for run in self.runs():
            hot = self.spark.table(run).where(F.col("n") >= self.min_docs).select("a", "b")
            counts = counts.join(hot.hint("merge"), ["a", "b"], "left_anti")
        return counts

    def close(self) -> None:
        for name in list(self.tables):
            self._drop(name)
        self.levels = [[]]


def hot_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = 1) -> DataFrame:
    """(a, b) of the lines in at least ``min_docs`` documents, stored."""
    index = LineIndex(docs.sparkSession, min_docs)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int") if batches > 1 else F.lit(0)
    hashes = docs.select(F.explode(line_hashes(docs)).alias("h"), batch.alias("batch")).select("h.a", "h.b", "batch")
    path = runtime.table_path(docs.sparkSession, "lines")
    hashes.write.partitionBy("batch").parquet(path)
    made = docs.sparkSession.read.schema("a long, b long, batch int").parquet(path)
    try:
        for i in range(batches):
            index.add(made.where(F.col("batch") == i).select("a", "b"))  # its folder alone
        with merging(docs.sparkSession):
            return runtime.stored(index.counts().where(F.col("n") >= min_docs).select("a", "b"), "hot")
    finally:
        index.close()
        runtime.drop_stored(made.select("a"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = 1, report: bool = True) -> DataFrame:
    """``docs`` with text without its hot lines, and with ``report`` n_lines and
    n_dropped (a column of one of these names is replaced). A document's hot lines
    come back as their numbers, so that its lines are parted in one pass."""
    hot = hot_lines(docs, min_docs, batches)
    own, text_, kept_, hot_ = runtime.free(docs, "_row", "_text", "_kept", "_hot")
    names = [c for c in docs.columns if not report or c.lower() not in ("n_lines", "n_dropped")]
    n_lines = "n_lines" if report else runtime.free(docs, "_n_lines")[0]
    docs = docs.select(*names)
    # A row's identity is its content: equal rows get equal answers.
    row = F.xxhash64(F.col("doc_id"), F.xxhash64("text"))
    hashes = F.transform(lines(F.col("text")), lambda x: hashed(key(x)))
    found = docs.select(row.alias("row"), F.posexplode(hashes).alias("place", "h")).select("row", "place", "h.a", "h.b")
    found = _among(found, hot).groupBy(F.col("row").alias(own)).agg(F.collect_set("place").alias(hot_))
    joined = docs.withColumn(own, row).join(found, own, "left")

    def without(all_: Column) -> Column:
        """Lines less those at the hot places, which are looked up by hash."""
        left = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(hot_))
        return F.transform(left, lambda i: all_[i])

    all_ = lines(F.col("text"))
    kept = F.when(F.col(hot_).isNull(), all_).otherwise(F.transform(F.array(all_), without)[0])  # the lines are bound once
    out = joined.select(*[c for c in names if c.lower() != "text"], F.col("text").alias(text_), kept.alias(kept_), F.size(all_).cast("long").alias(n_lines))
    text = F.when(F.col(text_).isNull(), F.col(text_)).otherwise(F.array_join(kept_, "\n"))
    counts = [F.col(n_lines), (F.col(n_lines) - F.size(kept_)).alias("n_dropped")] if report else []
    return out.select(*[text.alias(c) if c.lower() == "text" else F.col(c) for c in names], *counts)


def _among(found: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of ``found`` whose line is hot. Beyond ``BROADCAST_LINES`` hot lines only
    the commonest are broadcast, those in more than 1 / BROADCAST_LINES of all places
    (so there are fewer than that); of the others none is enough to fill a task."""
    if hot.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        return found.join(F.broadcast(hot), ["a", "b"])
    places = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(hot, ["a", "b"])
    places = runtime.stored(places, "places")
    all_ = places.agg(F.sum("n")).first()[0]
    many = F.col("n") * BROADCAST_LINES > all_
    top, rest = places.where(many).select("a", "b"), places.where(~many).select("a", "b")
    common = found.join(F.broadcast(top), ["a", "b"])
    return common.unionByName(found.join(F.broadcast(top), ["a", "b"], "left_anti").join(rest, ["a", "b"]))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_lines(runtime.read(spark, sf_dir, "documents").select("doc_id", "text"), batches=FANOUT + 1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
