"""Calls to a language model, if one is plugged in: each prompt is one reply row.

A client is a Python function ``(model, prompt) -> text`` that raises on errors.
Nothing here opens a connection.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import scratch

Client = Callable[[str, str], str]
# Attempts, and the words of a limit that passes and of one that lasts
# for the day.
ATTEMPTS = 3
_LIMIT = re.compile(r"rate limit|429|quota|tokens per day|tpd|resource_exhausted")
_DAILY = re.compile("perday|per_day|daily")
#: Calls in flight in a task.
POOL = 16


def provider_of(model: str, prefixes: Mapping[str, str], default: str) -> str:
    """The provider whose prefix the model's name has."""
    return next((p for prefix, p in prefixes.items() if model.startswith(prefix)), default)


def wait_seconds(error: str, default: float = 15.0) -> float:
    m = re.search(r"retry in (\d+(?:\.\d+)?)s", error.lower())
    return float(m[1]) + 2 if m else default


def call(prompt: str, models: list[str], client_of: Callable[[str], Client], sleep=time.sleep) -> tuple[str | None, str | None, str | None]:
    """(reply, model, error): the models in turn. A rate limit is tried again after
    the wait that it names, ``ATTEMPTS`` times in all; a daily limit or any other
    error goes on to the next model. The last error is returned if none replies."""
    error = "no model"
    for model in models:
        for attempt in range(ATTEMPTS):
            try:
                return client_of(model)(model, prompt), model, None
            except Exception as e:  # whatever a client raises is a failed call
                error = str(e)
            low = error.lower()
            if not _LIMIT.search(low) or _DAILY.search(low):
                break
            if attempt + 1 < ATTEMPTS:
                sleep(wait_seconds(error))
    return None, None, error


class Pace:
    """At most ``rate`` calls a second of a task; a wait that one call is told holds
    back the others of its model, so that they do not run into the same limit."""

    def __init__(self, rate: float | None, sleep=time.sleep, clock=time.monotonic):
        self.gap, self.sleep, self.clock = 1 / rate if rate else 0.0, sleep, clock
        self.lock, self.next, self.until = threading.Lock(), 0.0, {}

    def start(self, model: str) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next, self.until.get(model, 0.0))
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)

    def hold(self, model: str, seconds: float) -> None:
        with self.lock:
            self.until[model] = max(self.until.get(model, 0.0), self.clock() + seconds)


def replies(prompts: DataFrame, models: list[str], clients: Mapping[str, Client], prefixes: Mapping[str, str], default: str, sleep=time.sleep, pool: int = POOL, rate: float | None = None) -> DataFrame:
    """(query_id, reply, model, error, latency_ms, attempts) of (query_id, prompt),
    stored, so that nothing is asked again when a later step fails. Equal prompts are
    one call. A task has ``pool`` calls in flight, and with ``rate`` (calls a second
    over all tasks) starts no more than its share. The wall clock of a call, waits
    included, is its latency."""
    spark = prompts.sparkSession
    share = rate / spark.sparkContext.defaultParallelism if rate else None

    def run(batches):
        pace = Pace(share, sleep)

        def one(prompt):
            tries: list[str] = []

            def client_of(model):
                def paced(m, p):
                    pace.start(m)
                    tries.append(m)
                    return clients[provider_of(m, prefixes, default)](m, p)

                return paced

            start = time.perf_counter()
            # The model that named a wait is held for the task's other calls, too.
            got = call(prompt, models, client_of, lambda s: (pace.hold(tries[-1], s), sleep(s)))
            return (*got, round(1000 * (time.perf_counter() - start), 1), len(tries))

        with ThreadPoolExecutor(pool) as threads:
            for b in batches:
                asked = b.column("prompt").to_pylist()
                rows = [(p, *r) for p, r in zip(asked, threads.map(one, asked))]
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], ["prompt", "reply", "model", "error", "latency_ms", "attempts"])

    prompts = prompts.selectExpr("cast(query_id AS long) AS query_id", "coalesce(prompt, '') AS prompt")
    distinct = prompts.select("prompt").distinct().repartition(spark.sparkContext.defaultParallelism)
    said = scratch.stored(distinct.mapInArrow(run, "prompt string, reply string, model string, error string, latency_ms double, attempts long"), "replies")
    return prompts.join(said, "prompt").select("query_id", "reply", "model", "error", "latency_ms", "attempts")


def task_model(load: Callable[[], Callable[..., list]], returns: str) -> Callable[..., Column]:
    """A column function by a model of any kind: ``load()`` gives a function from lists
    of argument values to a list of results, and is called once a task."""

    @F.pandas_udf(returns)
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield pd.Series(model(*(x.tolist() for x in part)), dtype=object if "array" in returns or returns == "string" else None)

    return run
