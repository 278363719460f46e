"""Connected components by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _least(pairs: DataFrame) -> DataFrame:
    """(a, m): the smallest of each node and its neighbours. ``a`` is a new column, so
    that a join deals both sides anew: of two plain shuffles the adaptive planner
    splits a node whose rows fill a task, which it can't next to an aggregate."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not(F.bitwise_not("a")).alias("a"), F.least("a", "m").alias("m"))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): component is the smallest
    id reachable. Each round is written to the shared folder; the rows of a node
    with very many links are only ever aggregated and joined, not gathered. Links
    that ``rounds`` rounds do not settle are an error, never a split component."""
    edges = runtime.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        large = both.join(_least(both), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(_least(large), "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        before, edges = edges, runtime.stored(small, "links")
        runtime.drop_stored(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components still changed in round {rounds}")
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.union(edges.select("b", "b").distinct())
