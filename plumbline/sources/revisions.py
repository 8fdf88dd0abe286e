"""Revisions of datasets and models, pinned to a commit from a local hub cache; nothing is fetched.

The cache has the public layout ``<kind>s--<owner>--<name>/refs/<revision>`` (a file that holds the commit) and
``snapshots/<commit>`` (the files).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.identity import digest
from plumbline.sources import storage

_COMMIT = re.compile(r"[0-9a-f]{40,64}")


class RevisionError(ValueError):
    """A revision that the cache cannot pin."""


def cached_commit(cache: str, name: str, revision: str = "main", kind: str = "dataset") -> str:
    """The commit of a revision: itself if it is one, else what the cache's reference says; its snapshot must be there."""
    home = storage.join(cache, f"{kind}s--{name.replace('/', '--')}")
    commit = revision
    if not _COMMIT.fullmatch(revision):
        reference = storage.join(home, "refs", revision)
        if not storage.exists(reference):
            raise RevisionError(f"{name}@{revision} is not in the cache")
        commit = storage.read_text(reference).strip()
    if not _COMMIT.fullmatch(commit):
        raise RevisionError(f"{name}@{revision} does not name a commit")
    if not storage.exists(storage.join(home, "snapshots", commit)):
        raise RevisionError(f"the files of {name}@{commit} are not in the cache")
    return commit


def pinned_table(spark: SparkSession, cache: str, name: str, split: str, revision: str = "main", subset: str | None = None) -> tuple[DataFrame, dict]:
    """A split of a cached dataset as of one commit, and what pins it: commit, files and a fingerprint of both.

    Parquet files ``[<subset>/]<split>*.parquet`` of the snapshot are read; none is an error.
    """
    commit = cached_commit(cache, name, revision)
    folder = storage.join(cache, f"datasets--{name.replace('/', '--')}", "snapshots", commit, *([subset] if subset else []))
    files = [f for f in storage.entries(folder) if re.fullmatch(rf"{re.escape(split)}(?:[-.].*)?\.parquet|{re.escape(split)}\.parquet", f)]
    if not files:
        raise RevisionError(f"{name}@{commit} has no split {split}")
    pin = {"name": name, "subset": subset, "split": split, "commit": commit, "files": files}
    return spark.read.parquet(*[storage.join(folder, f) for f in files]), {**pin, "fingerprint": digest(pin)}
