"""Evaluation in parts: a batch of cases that tells how far it is and goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.sources import scratch

#: Categories that a batch may count; each is two observed sums.
MAX_CATEGORIES = 500

#: By category: cases done, cases passed, cases in all.
Progress = dict[str, tuple[int, int, int]]


def _exists(df: DataFrame, path: str) -> bool:
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)


def evaluate(cases: DataFrame, pipeline, on_progress: Callable[[Progress], None] | None = None, folder: str | None = None, parts: int = 8) -> DataFrame:
    """``evaluation.run_all`` over cases with a ``category``, part by part.

    The cases are written as files and read as a stream in ``parts`` micro-batches
    at most. The counts by category are observed while a part's results are
    written, without a pass of their own, and ``on_progress`` gets the sums so far
    after each part, in the driver. Results go to one folder a part, which a repeated
    part replaces. Called again with the ``folder`` of a run that broke off, the
    finished parts stay and are counted, and the others run; a folder belongs to one
    set of cases. It must be one that all executors share (default: a new one in
    ``spark.checkpoint.dir``).

    Defined results: a null category counts as ``""``; repeated and equal cases stay
    as ``run_all`` leaves them; without cases the result is empty and nothing is reported.
    More than ``MAX_CATEGORIES`` categories are an error.
    """
    spark = cases.sparkSession
    folder = folder or scratch.table_path(spark, "evaluation")
    inbox, out, marks = f"{folder}/cases", f"{folder}/results", f"{folder}/marks"
    if not _exists(cases, f"{inbox}/_SUCCESS"):
        cases.repartition(parts, "query_id").write.mode("overwrite").parquet(inbox)
    held = spark.read.parquet(inbox)
    label = F.coalesce("category", F.lit(""))
    totals = {r.c: r.n for r in held.groupBy(label.alias("c")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CATEGORIES + 1).collect()}
    if len(totals) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    names = sorted(totals)
    done: dict[int, list[tuple[int, int]]] = {}

    def sums() -> list:
        of = [F.col("category").isNull() | (F.col("category") == "") if c == "" else F.col("category") == c for c in names]
        return [F.count_if(c).alias(f"n{i}") for i, c in enumerate(of)] + [F.count_if(c & F.col("passed")).alias(f"p{i}") for i, c in enumerate(of)]

    if _exists(cases, out):
        kept = spark.read.parquet(out).groupBy("part").agg(*sums())
        done = {r.part: [(r[f"n{i}"], r[f"p{i}"]) for i in range(len(names))] for r in kept.collect()}

    def step(batch: DataFrame, part: int) -> None:
        seen = Observation()
        E.run_all(batch, pipeline).observe(seen, F.count(F.lit(1)).alias("n"), *sums()).write.mode("overwrite").parquet(f"{out}/part={part}")
        got = seen.get
        done[part] = [(got[f"n{i}"], got[f"p{i}"]) for i in range(len(names))]
        if on_progress and names:
            on_progress({c: (sum(d[i][0] for d in done.values()), sum(d[i][1] for d in done.values()), totals[c]) for i, c in enumerate(names)})

    files = -(-len(held.inputFiles()) // parts)  # a cluster may write other than ``parts`` files
    stream = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", files).parquet(inbox)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("part")
