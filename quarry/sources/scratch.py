"""Tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names the folder. A local session without that setting
gets a temporary folder of its own; any other master without it is an error, as
executors would write to their own disks.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}
_held: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """What is stored inside the block comes to Python tasks ``n`` rows at a time, for
    rows so large that Spark's 10,000 (or 64 MB) at once fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _table(df: DataFrame) -> str | None:
    """The name of the stored table behind a frame."""
    files = df.inputFiles()[:1]
    return files[0].rsplit("/", 1)[0].rsplit("/", 1)[-1] if files else None


def drop_stored(df: DataFrame) -> None:
    """Remove the table behind a frame that ``stored`` returned."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])
        _held.discard(_table(df))


def hold(*tables: DataFrame) -> None:
    """``clear`` leaves these tables: they go with ``drop_stored`` only."""
    _held.update(t for t in map(_table, tables) if t)


def mark(spark: SparkSession) -> int:
    """How many tables there are: what is made later can be cleared by itself."""
    return len(_made.setdefault(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the session's tables, or those made ``since`` a mark, except the one
    behind ``keep`` and those on hold: call it once the results that read them are written."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    held = _held | ({_table(keep)} if keep is not None else set())
    for path in made[since:]:
        if path.rsplit("/", 1)[-1] not in held:
            _delete(spark, path)
    made[since:] = [p for p in made[since:] if p.rsplit("/", 1)[-1] in held]


#: Inputs below this size a core are dealt out.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input is small and may lie in fewer parts
    than these, as a table in one row group does. Tables of many files and large inputs (by the
    planner's estimate of their size) are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * cores else df
