"""Models as a source: responders that answer prompts inside the plan.

``dummy`` is built of literals. ``recorded`` joins a table of stored responses. ``cached`` asks only for what
a content-addressed table misses. ``client_responder`` runs any Python client, each prompt once, with retries; a
call that fails is a row, never an exception.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.identity import cache_key
from plumbline.sources import storage
from plumbline.sources.scratch import Scratch

# Fixed values of the dummy model.
DUMMY_TEXT = "The answer is A."
DUMMY_SCORES = {"A": -0.1, "B": -1.5, "C": -2.0, "D": -2.5}
DUMMY_OTHER = -5.0

_FIELDS = "status string, raw_text string, finish_reason string, latency_seconds double, error_type string, error_message string"


def dummy(df: DataFrame) -> DataFrame:
    """The dummy model: always answers A, with fixed scores for each label of ``options``."""
    scores = F.lit(DUMMY_OTHER)
    fixed = F.create_map(*[x for k, v in DUMMY_SCORES.items() for x in (F.lit(k), F.lit(v))])
    return df.select(
        "*",
        F.lit("success").alias("status"),
        F.lit(DUMMY_TEXT).alias("raw_text"),
        F.lit("stop").alias("finish_reason"),
        F.lit(0.0).alias("latency_seconds"),
        F.transform("options", lambda o: F.coalesce(F.try_element_at(fixed, o["label"]), scores)).alias("logprobs"),
    )


def recorded(responses: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Answers from a table of stored responses by ``keys``; a prompt without one is a failure row."""
    columns = ["status", "raw_text", "finish_reason", "latency_seconds", "logprobs"]
    have = [c for c in columns if c in responses.columns]

    def respond(df: DataFrame) -> DataFrame:
        joined = df.join(responses.select(*keys, *have), keys, "left")
        out = joined.withColumn("status", F.coalesce("status", F.lit("failure"))) if "status" in have else joined
        kinds = {"latency_seconds": "double", "logprobs": "array<double>"}
        return out.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in columns if c not in have})

    return respond


def call_with_retries(call: Callable[[str], str], prompt: str, attempts: int = 3, base: float = 5.0, most: float = 300.0, retryable: tuple = (TimeoutError, ConnectionError), sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(status, raw_text, finish_reason, latency, error_type, error_message) of one call.

    Waits base * 2^(attempt - 1) seconds, at most ``most``, give or take a quarter, between attempts, only after
    retryable errors. Blank text is an error.
    """
    for attempt in range(1, attempts + 1):
        began = time.monotonic()
        try:
            text = call(prompt)
            if not (text or "").strip():
                raise ValueError("blank text")
            return "success", text, "stop", time.monotonic() - began, None, None
        except Exception as error:  # noqa: BLE001
            if attempt == attempts or not isinstance(error, retryable):
                return "failure", None, None, time.monotonic() - began, type(error).__name__, str(error)
            sleep(min(most, base * 2 ** (attempt - 1)) * random.uniform(0.75, 1.25))
    raise AssertionError("unreachable")


_CLIENTS: dict[str, Callable[[str], str]] = {}


def shared_client(key: str, make: Callable[[], Callable[[str], str]]) -> Callable[[str], str]:
    """One client per Python worker and key (model and execution mode), however many partitions it serves."""
    if key not in _CLIENTS:
        _CLIENTS[key] = make()
    return _CLIENTS[key]


def client_responder(make_client: Callable[[], Callable[[str], str]], concurrency: int = 4, limit: int = 32, key: str | None = None, **retry) -> Callable[[DataFrame], DataFrame]:
    """A responder around a Python client that asks each distinct prompt once.

    At most ``limit`` calls of the model are under way in the whole cluster, ``concurrency`` of them in one task: so
    many tasks hold the prompts, by a hash of them. With ``key`` (model and execution mode) a worker makes one client
    for all its tasks. The answers are written before anything reads them, so no plan that uses them twice asks twice;
    only a task that is lost before it ends asks its prompts again.
    """

    def respond(df: DataFrame) -> DataFrame:
        def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = shared_client(key, make_client) if key else make_client()
            with ThreadPoolExecutor(concurrency) as pool:
                for part in parts:
                    rows = list(pool.map(lambda p: call_with_retries(client, p, **retry), part["prompt"]))
                    yield pd.concat([part.reset_index(drop=True), pd.DataFrame(rows, columns=["status", "raw_text", "finish_reason", "latency_seconds", "error_type", "error_message"])], axis=1)

        once = df.select("prompt").where(F.col("prompt").isNotNull()).distinct().repartition(max(1, limit // concurrency), "prompt")
        answered = Scratch(df.sparkSession).keep(once.mapInPandas(ask, f"prompt string, {_FIELDS}"), "responses")
        return df.join(answered, "prompt", "left").withColumn("logprobs", F.lit(None).cast("array<double>"))

    return respond


def with_cache_key(df: DataFrame, provider: str, model: str, temperature: float, max_tokens: int, seed: int | None) -> DataFrame:
    """``df`` plus cache_key of each prompt."""
    return df.withColumn("cache_key", cache_key(F.lit(provider), F.lit(model), F.col("prompt"), F.lit(temperature), F.lit(max_tokens), F.lit(seed)))


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requests without a usable cache row: only successes whose digest verifies count."""
    return requests.join(usable_cache(cache).select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def usable_cache(cache: DataFrame) -> DataFrame:
    """Cache rows that are successes and whose payload digest agrees; anything else is a miss."""
    return cache.where((F.col("status") == "success") & (F.col("payload_digest") == F.sha2(F.coalesce("raw_text", F.lit("")), 256)))


def cache_rows(responses: DataFrame) -> DataFrame:
    """Successful responses as rows to append to the cache."""
    return responses.where(F.col("status") == "success").select("cache_key", "status", "raw_text", "finish_reason", F.sha2(F.coalesce("raw_text", F.lit("")), 256).alias("payload_digest"))


class ResponseCache:
    """A content-addressed table of paid-for responses in a shared folder; parts are only ever added."""

    SCHEMA = "cache_key string, status string, raw_text string, finish_reason string, payload_digest string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        """All cached responses."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder) if storage.exists(self.folder) else self.spark.createDataFrame([], self.SCHEMA)

    def append(self, responses: DataFrame) -> None:
        """Add the successful ones of ``responses`` (cache_key, status, raw_text, finish_reason)."""
        cache_rows(responses).write.mode("append").parquet(self.folder)


def cached(respond: Callable[[DataFrame], DataFrame], cache: DataFrame | ResponseCache, **identity) -> Callable[[DataFrame], DataFrame]:
    """A responder that asks ``respond`` only for what the cache misses and, given a :class:`ResponseCache`, adds what it paid for."""

    def answer(df: DataFrame) -> DataFrame:
        keyed = with_cache_key(df, **identity)
        have = cache.read() if isinstance(cache, ResponseCache) else cache
        fields = ["cache_key", "status", "raw_text", "finish_reason"]
        scratch = Scratch(df.sparkSession)
        # Known first: what is added below must not be read back as known and fresh.
        known = scratch.keep(usable_cache(have).join(keyed.select("cache_key").distinct(), "cache_key", "left_semi").select(*fields).dropDuplicates(["cache_key"]), "known")
        fresh = scratch.keep(respond(cache_misses(keyed, known.withColumn("payload_digest", F.sha2(F.coalesce("raw_text", F.lit("")), 256)))).select(*fields), "fresh")
        if isinstance(cache, ResponseCache):
            cache.append(fresh)
        return keyed.join(known.unionByName(fresh), "cache_key", "left").withColumn("latency_seconds", F.lit(None).cast("double")).withColumn("logprobs", F.lit(None).cast("array<double>"))

    return answer
