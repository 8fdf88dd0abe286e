"""Prepared datasets and result sets as verified, content-addressed parquet tables.

Data goes through Spark's committer; the small metadata files are written whole and renamed. Order-sensitive
content digests are folded from one hash per block of ordinals, so no table ever meets on the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.identity import digest, row_digest, short_id
from plumbline.schemas import IDENTITY_COLUMNS
from plumbline.sources import storage
from plumbline.sources.storage import read_json, write_json

VERSION = "plumbline.dataset.v1"
RESULT_VERSION = "plumbline.results.v1"


class ArtifactError(ValueError):
    """An artifact that is missing, changed or not what its specification says."""


def write_report(path: object, value: object) -> None:
    """Write a JSON report once; different contents at the same place are an error."""
    if storage.exists(path) and read_json(path) != json.loads(json.dumps(value)):
        raise ArtifactError(f"a different report is already at {path}")
    write_json(path, value)


@contextmanager
def locked(path: object) -> Iterator[None]:
    """Exclusive lock of a file; a lock held by someone else is an error at once."""
    with ExitStack() as held:
        try:
            held.enter_context(storage.locked(path))
        except BlockingIOError as e:
            raise ArtifactError(f"{path} is locked") from e
        yield


def content_digest(df: DataFrame, order: str = "ordinal", block: int = 65_536) -> str:
    """Digest of all rows in order over the columns sorted by name.

    Rows are hashed where they are; each block of ordinals folds its hashes in order, and the driver folds one
    hash per block.
    """
    columns = sorted(df.columns)
    rows = df.select(F.floor(F.col(order) / block).cast("long").alias("b"), F.col(order).alias("o"), row_digest(*[F.col(c) for c in columns]).alias("h"))
    folded = rows.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256).alias("h")).orderBy("b")
    total = hashlib.sha256(",".join(columns).encode())
    for r in folded.toLocalIterator():
        total.update(f"{r['b']}:{r['h']};".encode())
    return total.hexdigest()


def dataset_path(root: str, spec: dict) -> str:
    """``name/split/norm-vN/src_<12 hex>`` below the root, the last part from the whole specification."""
    return storage.join(root, spec["name"], spec["split"], f"norm-v{spec.get('norm_version', 1)}", f"src_{digest(spec)[:12]}")


def write_dataset(df: DataFrame, root: str, spec: dict) -> dict:
    """Validate, write, read again, digest, then write the metadata; under a lock."""
    from plumbline.operators.quality import validation

    path = dataset_path(root, spec)
    with locked(f"{path}/.lock"):
        report = validation(df).first().asDict()
        if not report["n_rows"] or any(report[k] for k in ("null_ids", "blank_ids", "repeated_rows", "null_stems")):
            raise ArtifactError(f"dataset is not valid: {report}")
        df.write.mode("overwrite").parquet(f"{path}/data")
        back = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
        content = content_digest(back)
        meta = {"version": VERSION, "spec": spec, "rows": back.count(), "content_digest": content, "artifact_id": short_id("ds", {"spec": spec, "content": content})}
        write_json(f"{path}/metadata.json", {**meta, "metadata_digest": digest(meta)})
    return meta


def read_dataset(spark: SparkSession, root: str, spec: dict, schema) -> tuple[DataFrame, dict]:
    """The verified dataset of a specification: version, metadata digest, specification, rows and content digest must agree."""
    path = dataset_path(root, spec)
    if not storage.exists(f"{path}/metadata.json"):
        raise ArtifactError(f"no dataset at {path}")
    meta = read_json(f"{path}/metadata.json")
    claimed = meta.pop("metadata_digest", None)
    df = spark.read.schema(schema).parquet(f"{path}/data")
    checks = {"version": meta["version"] == VERSION, "metadata": claimed == digest(meta), "specification": meta["spec"] == spec, "rows": meta["rows"] == df.count(), "content": meta["content_digest"] == content_digest(df)}
    if bad := [k for k, ok in checks.items() if not ok]:
        raise ArtifactError(f"dataset at {path} fails: {', '.join(bad)}")
    return df, meta


def identity_problems(results: DataFrame, columns: tuple[str, ...] = IDENTITY_COLUMNS) -> DataFrame:
    """(condition_id, problem) of identity columns that are null or have several values in a condition."""
    stats = results.groupBy("condition_id").agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns], *[(~F.min(c).eqNullSafe(F.max(c))).alias(f"d_{c}") for c in columns if c != "condition_id"])
    found = [F.when(F.col(f"n_{c}") > 0, F.lit(f"{c} is null")) for c in columns] + [F.when(F.col(f"d_{c}"), F.lit(f"{c} has several values")) for c in columns if c != "condition_id"]
    return stats.select("condition_id", F.explode(F.array_compact(F.array(*found))).alias("problem"))


def write_results(results: DataFrame, folder: str) -> dict:
    """Append results, partitioned by condition and spread by question, so that a repeated task writes the same rows; empty results, missing identity columns and bad identities are errors."""
    if missing := [c for c in IDENTITY_COLUMNS if c not in results.columns]:
        raise ArtifactError(f"missing identity columns: {', '.join(missing)}")
    if results.isEmpty():
        raise ArtifactError("no results to write")
    if bad := identity_problems(results).limit(20).collect():
        raise ArtifactError("; ".join(f"{r['condition_id']}: {r['problem']}" for r in bad))
    results.repartition("condition_id", F.pmod(F.xxhash64("question_id"), F.lit(8))).write.mode("append").partitionBy("condition_id").parquet(folder)
    return {"version": RESULT_VERSION, "columns_digest": digest(sorted((f.name, f.dataType.simpleString()) for f in results.schema.fields))}


def read_results(spark: SparkSession, folder: str, schema: str, conditions: list[str]) -> DataFrame:
    """Results of the declared, completed conditions only: a literal list, so other partitions are never opened."""
    return spark.read.schema(schema).parquet(folder).where(F.col("condition_id").isin(conditions))


def resume_problem(existing: list[str], wanted: list[str], methods: list[str], method: str, exact: bool = True) -> str | None:
    """Why rows of ``method`` cannot be appended to a sink with the given header and methods, else null."""
    if exact and existing != wanted:
        return "the header differs"
    if not exact and (missing := sorted(set(wanted) - set(existing))):
        return f"missing columns: {', '.join(missing)}"
    if methods and set(methods) != {method}:
        return "the sink holds another method"
    return None


def membership_problems(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(condition_id, question_id, problem): questions missing from, not expected in, or repeated in a condition; expected is (condition_id, question_id)."""
    have = results.groupBy("condition_id", "question_id").agg(F.count(F.lit(1)).alias("n"))
    want = expected.select("condition_id", "question_id").distinct().withColumn("w", F.lit(1))
    both = have.join(want, ["condition_id", "question_id"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "not expected").when(F.col("n") > 1, "repeated")
    return both.select("condition_id", "question_id", problem.alias("problem")).where(F.col("problem").isNotNull())
