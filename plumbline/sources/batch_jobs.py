"""Provider batch jobs as a driver state machine around the table of missing requests.

Only misses are submitted. The state file is keyed by the set of requests, so a restart finds the running job
instead of paying twice. A job that fails or loses a request gives failure rows, never an exception.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.identity import digest
from plumbline.sources import storage

DONE, FAILED = "completed", "failed"


class BatchClient(Protocol):
    """What a provider must offer; requests and replies are JSON-lines files in a shared folder."""

    def submit(self, requests_folder: str) -> str:
        """Start a job over exported requests and return its id."""

    def poll(self, job: str) -> str:
        """State of a job; ``completed`` and ``failed`` end it."""

    def fetch(self, job: str) -> str:
        """Folder of reply lines (custom_id, raw_text, finish_reason, error)."""


def request_set(misses: DataFrame) -> str:
    """Key of a set of requests, free of their order: count and sum of hashes of the cache keys."""
    r = misses.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("cache_key").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"), F.coalesce(F.bit_xor(F.xxhash64("cache_key", F.lit(1))), F.lit(0)).alias("x")).first()
    return f"{r['n']}-{r['s']}-{r['x']}"


def run_batch(misses: DataFrame, client: BatchClient, folder: str, every: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(cache_key, status, raw_text, finish_reason, error_message) of every missing request; no requests give no job."""
    spark = misses.sparkSession
    schema = "custom_id string, raw_text string, finish_reason string, error string"
    state_path = storage.join(folder, "batch_state.json")
    key = request_set(misses)
    if key.startswith("0-"):
        return spark.createDataFrame([], "cache_key string, status string, raw_text string, finish_reason string, error_message string")
    state = storage.read_json(state_path) if storage.exists(state_path) else {}
    if state.get("key") != key:
        out = f"{folder}/requests-{digest(key)[:16]}"
        misses.select(F.col("cache_key").alias("custom_id"), "prompt").write.mode("overwrite").json(out)
        state = {"key": key, "job": client.submit(out)}
        storage.write_json(state_path, state)
    while (now := client.poll(state["job"])) not in (DONE, FAILED):
        sleep(every)
    if now == DONE:
        replies = spark.read.schema(schema).json(client.fetch(state["job"])).dropDuplicates(["custom_id"])
    else:
        replies = spark.createDataFrame([], schema)
    joined = misses.select("cache_key").join(replies.withColumnRenamed("custom_id", "cache_key"), "cache_key", "left")
    good = F.col("error").isNull() & (F.trim(F.coalesce("raw_text", F.lit(""))) != "")
    out = joined.select("cache_key", F.when(good, "success").otherwise("failure").alias("status"), F.when(good, F.col("raw_text")).alias("raw_text"), "finish_reason", F.when(~good, F.coalesce("error", F.lit(f"job {now}, no usable reply"))).alias("error_message"))
    return out


def clear_state(folder: str) -> None:
    """Forget a finished job."""
    storage.remove(storage.join(folder, "batch_state.json"))
