"""Extension: incremental ingest of chunk files, each micro-batch an insert-or-ignore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources import store

FILES = "domain string, source_file string, page int, text string"


def ingest(spark: SparkSession, inbox: str, table: str, checkpoint: str):
    """A query that chunks new Parquet files of segments and appends unseen chunks to ``table``."""

    def add(batch: DataFrame, _: int) -> None:
        made = T.chunks(batch)
        path = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path)
        old = batch.sparkSession.read.parquet(table) if there else made.limit(0)
        store.new_rows(made, old, ["domain", "chunk_id"], [F.col("page")]).write.mode("append").partitionBy("domain").parquet(table)

    return spark.readStream.schema(FILES).parquet(inbox).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
