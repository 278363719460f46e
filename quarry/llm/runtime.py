"""Tables in the shared folder, block counts and column names for the operators here."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.scratch import clear, drop_stored, mark, shared_dir, stored, table_path  # noqa: F401


def block_count(n_bytes: int, per_block: int) -> int:
    return max(1, math.ceil(n_bytes / per_block))


def free(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
