"""Runs: strict configurations, the condition grid, manifests, state and resumption, all on the driver but for the data."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from itertools import product
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.identity import digest, is_credential_key, short_id
from plumbline.functions.text import RUN_ID
from plumbline.operators.methods import resolve_method
from plumbline.sources import storage
from plumbline.sources.scratch import Scratch
from plumbline.sources.storage import read_json, write_json

MANIFEST_VERSION = "plumbline.manifest.v1"
STATUSES = ("pending", "completed", "failed", "gated")
#: Model kinds that give option scores, and providers that take batch jobs.
SCORING_KINDS = ("local", "dummy")
BATCH_PROVIDERS = ("openai", "anthropic", "together", "deepinfra")
RESERVED_PARAMS = ("model", "prompt", "messages", "seed", "temperature", "max_tokens")


class ConfigError(ValueError):
    """A configuration that cannot be run."""


@dataclass(frozen=True)
class Sampling:
    """How rows of a benchmark are chosen."""

    n_samples: int | None = None
    group_by: str | None = None
    n_per_group: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class Benchmark:
    """One benchmark of the grid."""

    name: str
    split: str = "test"
    subjects: list[str] = field(default_factory=list)
    sampling: Sampling = field(default_factory=Sampling)
    question_id_manifest: str | None = None


@dataclass(frozen=True)
class Model:
    """One model of the grid; all settings are part of its identity."""

    name: str
    kind: str = "api"
    provider: str = ""
    temperature: float = 0.0
    max_tokens: int = 256
    execution: str = "sync"
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class MethodChoice:
    """One method of the grid."""

    name: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Experiment:
    """A whole configuration."""

    run_id: str
    benchmarks: list[Benchmark]
    models: list[Model]
    methods: list[MethodChoice]
    metrics: list[str] = field(default_factory=lambda: ["accuracy", "mad"])
    prompt_version: str = "v1"
    seed: int = 42
    checkpoint_every: int = 1000


def _typed(kind: Any, value: Any, at: str) -> Any:
    if is_dataclass(kind):
        if not isinstance(value, dict):
            raise ConfigError(f"{at} must be a mapping")
        hints = get_type_hints(kind)
        if unknown := sorted(set(value) - set(hints)):
            raise ConfigError(f"unknown keys in {at}: {', '.join(map(str, unknown))}")
        for f in fields(kind):
            if f.name not in value and f.default is MISSING and f.default_factory is MISSING:
                raise ConfigError(f"{at} lacks {f.name}")
        return kind(**{k: _typed(hints[k], v, f"{at}.{k}") for k, v in value.items()})
    origin, args = get_origin(kind), get_args(kind)
    if origin is list:
        if not isinstance(value, list):
            raise ConfigError(f"{at} must be a list")
        return [_typed(args[0], v, f"{at}[{i}]") for i, v in enumerate(value)]
    if type(None) in args:
        return None if value is None else _typed(next(a for a in args if a is not type(None)), value, at)
    if kind is Any or origin is dict:
        return value
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if type(value) is not kind:
        raise ConfigError(f"{at} must be {kind.__name__}")
    return value


def load_config(source: str | Path | dict) -> Experiment:
    """A configuration from YAML text, a YAML file or a mapping; unknown keys, wrong types and bad combinations are errors."""
    if not isinstance(source, dict):
        import yaml

        text = Path(source).read_text() if isinstance(source, Path) else source
        source = yaml.safe_load(text)
    config = _typed(Experiment, source, "experiment")
    check(config)
    return config


def check(config: Experiment) -> None:
    """Every refusal that needs no work: names, duplicates, reserved and credential parameters, capabilities."""
    if not re.match(RUN_ID, config.run_id):
        raise ConfigError("bad run id")
    for m in config.models:
        if bad := [k for k in m.params if k in RESERVED_PARAMS or is_credential_key(k)]:
            raise ConfigError(f"parameters of {m.name} may not set {', '.join(bad)}")
        if m.execution == "batch" and m.provider not in BATCH_PROVIDERS:
            raise ConfigError(f"{m.provider or m.name} takes no batch jobs")
    for what, keys in (("benchmarks", [digest(_plain(b)) for b in config.benchmarks]), ("models", [digest(_plain(m)) for m in config.models]), ("methods", [digest(_plain(m)) for m in config.methods])):
        if not keys:
            raise ConfigError(f"no {what}")
        if len(set(keys)) != len(keys):
            raise ConfigError(f"{what} are given twice")
    for choice in config.methods:
        try:
            needs_scores = resolve_method(choice.name)[1]
        except ValueError as e:
            raise ConfigError(str(e)) from e
        if needs_scores and (weak := [m.name for m in config.models if m.kind not in SCORING_KINDS]):
            raise ConfigError(f"{choice.name} needs option scores; {', '.join(weak)} has none")


def _plain(value: Any) -> Any:
    if is_dataclass(value):
        return {f.name: _plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def condition_rows(config: Experiment) -> list[dict[str, str]]:
    """The grid of benchmarks, methods and models with content-hashed ids, sorted by condition id."""
    rows = []
    for b, m, model in product(config.benchmarks, config.methods, config.models):
        parts = {"benchmark": _plain(b), "method": _plain(m), "model": _plain(model), "prompt": config.prompt_version, "seed": config.seed}
        rows.append(
            {"condition_id": short_id("cond", parts), "benchmark_name": b.name, "benchmark_split": b.split, "method_name": m.name, "method_id": short_id("meth", _plain(m)), "model_name": model.name, "model_id": short_id("model", _plain(model)), "prompt_id": short_id("prompt", config.prompt_version)}
        )
    if len({r["condition_id"] for r in rows}) != len(rows):
        raise ConfigError("conditions repeat")
    return sorted(rows, key=lambda r: r["condition_id"])


def condition_grid(benchmarks: DataFrame, methods: DataFrame, models: DataFrame) -> DataFrame:
    """The same product over small tables (benchmark_name), (method_name), (provider, model_name)."""
    grid = benchmarks.distinct().crossJoin(methods.distinct()).crossJoin(models.distinct())
    key = F.concat_ws("|", "benchmark_name", "method_name", "provider", "model_name")
    return grid.withColumn("condition_id", F.substring(F.sha2(key, 256), 1, 16))


def manifest(config: Experiment, artifacts: dict[str, str] | None = None) -> dict:
    """The immutable description of a run; its experiment id covers every section."""
    sections = {"version": MANIFEST_VERSION, "config": _plain(config), "conditions": condition_rows(config), "artifacts": dict(sorted((artifacts or {}).items()))}
    return {**sections, "experiment_id": short_id("exp", sections)}


def ensure_manifest(folder: str | Path, wanted: dict) -> dict:
    """Create the manifest or verify that the stored one is the same; names the sections that differ."""
    path = storage.join(folder, "manifest.json")
    if not storage.exists(path):
        if storage.entries(folder):
            raise ConfigError("the folder holds something else")
        write_json(path, wanted)
        return wanted
    stored = read_json(path)
    body = {k: v for k, v in stored.items() if k != "experiment_id"}
    if stored.get("experiment_id") != short_id("exp", body):
        raise ConfigError("the stored manifest was changed")
    if stored["experiment_id"] != wanted["experiment_id"]:
        changed = sorted(k for k in wanted if stored.get(k) != wanted[k] and k != "experiment_id")
        raise ConfigError(f"the run differs in: {', '.join(changed)}")
    return stored


class RunState:
    """Status of each condition, written whole after every change."""

    def __init__(self, folder: str | Path, conditions: Iterable[str]):
        self.path = storage.join(folder, "run_state.json")
        known = read_json(self.path) if storage.exists(self.path) else {}
        self.status = {c: known.get(c, "pending") for c in conditions}
        if bad := [s for s in self.status.values() if s not in STATUSES]:
            raise ConfigError(f"unknown status {bad[0]}")

    def set(self, condition: str, status: str) -> None:
        """Record a status."""
        if status not in STATUSES or condition not in self.status:
            raise ConfigError(f"cannot set {condition} to {status}")
        self.status[condition] = status
        write_json(self.path, self.status)

    def reconcile(self, results: DataFrame, expected: DataFrame) -> dict[str, str]:
        """Bring the statuses in line with the stored ``results``; returns those that changed.

        ``expected`` is (condition_id, question_id). A completed condition that lacks a question goes back to pending; a
        pending or failed one that has them all is completed. Gated conditions have no results and stay.
        """
        have = results.select("condition_id", "question_id").distinct().withColumn("h", F.lit(1))
        gaps = expected.select("condition_id", "question_id").distinct().join(have, ["condition_id", "question_id"], "left").groupBy("condition_id").agg(F.count_if(F.col("h").isNull()).alias("n"))
        missing = {r["condition_id"]: r["n"] for r in gaps.collect()}  # one row for each condition
        changed = {}
        for c, status in self.status.items():
            n = missing.get(c)
            if status != "gated" and n is not None and (now := "pending" if n and status == "completed" else status if n else "completed") != status:
                self.status[c] = changed[c] = now
        if changed:
            write_json(self.path, self.status)
        return changed

    def evaluable(self) -> list[str]:
        """Completed conditions; pending ones are an error, gated and failed ones are listed without metrics."""
        if pending := [c for c, s in self.status.items() if s == "pending"]:
            raise ConfigError(f"{len(pending)} conditions are pending")
        return sorted(c for c, s in self.status.items() if s == "completed")


def run_conditions(state: RunState, run: Callable[[str], None], gated: type[Exception] = ValueError, concurrent: int = 1) -> dict[str, str]:
    """Run pending and failed conditions apart from each other: one that raises is failed (or gated) and the others go on."""

    def one(condition: str) -> tuple[str, str]:
        try:
            run(condition)
            return condition, "completed"
        except gated:
            return condition, "gated"
        except Exception:  # noqa: BLE001
            return condition, "failed"

    todo = [c for c, s in sorted(state.status.items()) if s in ("pending", "failed")]
    with ThreadPoolExecutor(max(1, concurrent)) as pool:
        for condition, status in pool.map(one, todo):
            state.set(condition, status)
    return dict(state.status)


#: What a run folder may hold; anything else keeps it from being reset.
RUN_FILES = ("manifest.json", "run_state.json", "evaluation_report.json", "inputs", "results", "priors", "cache", "batch_state.json")


def reset_run(folder: str, run_id: str, keep: tuple[str, ...] = ("inputs", "cache")) -> list[str]:
    """Delete what a run made, but for ``keep``; returns the names deleted.

    Refused before anything is touched: a folder without a manifest, of another run, or that holds foreign files.
    """
    path = storage.join(folder, "manifest.json")
    if not storage.exists(path):
        raise ConfigError("no run in this folder")
    if read_json(path)["config"]["run_id"] != run_id:
        raise ConfigError("the folder belongs to another run")
    names = storage.entries(folder)
    if foreign := [n for n in names if n not in RUN_FILES and not n.startswith((".", "requests-"))]:
        raise ConfigError(f"the folder holds other files: {', '.join(foreign)}")
    # The manifest goes last: a reset that was broken off can be repeated.
    gone = sorted((n for n in names if n not in keep), key=lambda n: (n == "manifest.json", n))
    for name in gone:
        storage.remove(storage.join(folder, name), folder=not name.endswith(".json"))
    return gone


def resume(questions: DataFrame, sink_path: str, schema: str, every: int, process: Callable[[DataFrame], DataFrame]) -> int:
    """Process the questions that the sink lacks, chunk by chunk, appending each chunk; returns the chunks run.

    A chunk is processed once: its results are written apart, checked there and then moved to the sink. One whose result
    ids are not its question ids is an error before anything of it reaches the sink.
    """
    from plumbline.operators.selection import chunks, remaining

    spark = questions.sparkSession
    scratch = Scratch(spark)
    done = spark.read.schema(schema).parquet(sink_path) if storage.exists(sink_path) else spark.createDataFrame([], schema)
    # Written before the first chunk is added, as the sink it was read from grows.
    todo = scratch.keep(chunks(remaining(questions, done), every), "todo")
    last = todo.agg(F.max("chunk_number")).first()[0]
    for number in range((last if last is not None else -1) + 1):
        part = todo.where(F.col("chunk_number") == number).drop("chunk_number")
        out = scratch.keep(process(part), f"chunk-{number}")
        counted = part.select("question_id", F.lit(1).alias("n")).unionAll(out.select("question_id", F.lit(-1))).groupBy("question_id").agg(F.sum("n").alias("n"))
        if not counted.where(F.col("n") != 0).isEmpty():
            raise ValueError("results do not belong to the questions of the chunk")
        out.write.mode("append").parquet(sink_path)
    scratch.release()
    return (last if last is not None else -1) + 1


def snapshot(selection: DataFrame, prompts: dict[str, str], folder: str, name: str) -> dict[str, str]:
    """Archive a selection and the prompts in the run; returns their digests for the manifest."""
    from plumbline.sources.artifacts import content_digest

    selection.write.mode("overwrite").parquet(f"{folder}/inputs/{name}")
    write_json(storage.join(folder, "inputs", f"{name}_prompts.json"), prompts)
    return {f"{name}.questions": content_digest(selection), f"{name}.prompts": digest(prompts)}


def evaluation_report(results: DataFrame, state: RunState, metric_names: list[str], folder: str) -> dict:
    """Metrics of all completed conditions in one grouped pass, statuses of all, written once.

    A condition with half or more failed calls counts as ``infra_failure``; the run is complete iff none failed.
    """
    from plumbline.operators import metrics
    from plumbline.sources.artifacts import write_report

    completed = state.evaluable()
    rows = results.where(F.col("condition_id").isin(completed))
    health = {r["condition_id"]: r["status"] for r in metrics.transport_health(rows, ["condition_id"], F.coalesce(F.col("transport_status") == "failure", F.lit(False))).collect()}
    values = {r["condition_id"]: {k: v for k, v in r.asDict().items() if k != "condition_id"} for r in metrics.evaluate(rows, ["condition_id"], metric_names).collect()}
    status = {c: health.get(c, s) if s == "completed" else s for c, s in sorted(state.status.items())}
    body = {"metrics": sorted(metric_names), "conditions": {c: {"status": s, "values": values.get(c)} for c, s in status.items()}, "complete": not any(s in ("failed", "infra_failure") for s in status.values())}
    report = {"evaluation_id": short_id("eval", body), **body}
    write_report(storage.join(folder, "evaluation_report.json"), report)
    return report
