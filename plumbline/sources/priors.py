"""Stored calibration priors: reused only for exactly the same calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.functions.identity import digest
from plumbline.functions.vectors import EPSILON
from plumbline.sources.artifacts import ArtifactError, content_digest
from plumbline.sources.storage import exists, join, read_json, write_json

VERSION = "plumbline.prior.v1"


def prior_key(calibration: DataFrame, *, condition_id: str, seed: int, temperature: float, max_tokens: int, prompt_version: str, n_choices: int) -> dict:
    """Everything a prior depends on: the settings and the calibration questions themselves."""
    settings = {"version": VERSION, "condition_id": condition_id, "seed": seed, "temperature": temperature, "budget": max_tokens, "prompt_version": prompt_version, "n_choices": n_choices}
    return {**settings, "calibration": content_digest(calibration.select("ordinal", "question_id"))}


def load_or_compute(folder: str, key: dict, compute) -> dict[str, float]:
    """The stored prior of ``key``, or a new one from ``compute``; a changed file is an error."""
    path = join(folder, f"prior_{digest(key)[:16]}.json")
    if exists(path):
        stored = read_json(path)
        claimed = stored.pop("digest", None)
        if claimed != digest(stored) or stored["key"] != key:
            raise ArtifactError(f"{path} was changed")
        return stored["peprior"]
    prior = {k: float(v) for k, v in sorted(compute().items())}
    body = {"key": key, "peprior": prior, "epsilon": EPSILON}
    write_json(path, {**body, "digest": digest(body)})
    return prior
