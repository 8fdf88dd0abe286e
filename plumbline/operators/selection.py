"""Selections: subject filters, id lists, seeded samples, calibration splits, leakage checks."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids the exact modes may hold on the driver.
EXACT_IDS = 5_000_000


def subject_filter(df: DataFrame, subjects: list[str]) -> DataFrame:
    """Rows of the subjects; an empty result is an error; without a subject column nothing is filtered."""
    if "subject" not in df.columns:
        return df
    out = df.where(F.col("subject").isin(subjects))
    if out.isEmpty():
        raise ValueError("no rows of these subjects")
    return out


def missing_ids(df: DataFrame, ids: DataFrame, key: str = "question_id") -> DataFrame:
    """(key) of listed ids that the dataset lacks, each once; a null id is never found."""
    return ids.select(key).distinct().join(df.select(key), key, "left_anti")


def id_list(df: DataFrame, ids: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows whose id is listed, in dataset order of ``ordinal``; a listed id that is missing is an error."""
    if not missing_ids(df, ids, key).isEmpty():
        raise ValueError("listed ids are missing from the dataset")
    return df.join(ids.select(key).distinct(), key, "left_semi")


def require_disjoint(calibration: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """``calibration``, if none of its rows has a key of ``evaluation``; else an error with the number of rows that leak."""
    if n := overlap(calibration, evaluation, key).count():
        raise ValueError(f"{n} calibration rows are among the evaluation questions")
    return calibration


def hash_rank(key: Column, seed: int) -> Column:
    """A sampling order that any engine reproduces: SHA-256 of seed and key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def hash_sample(df: DataFrame, n: int, seed: int, key: str = "ordinal") -> DataFrame:
    """The ``n`` rows of the smallest ranks; more than there are is an error.

    A threshold from a 65,536-bucket histogram of the rank's first digits leaves a few rows to rank, so no
    task sorts the table.
    """
    rank = hash_rank(F.col(key), seed)
    marked = df.withColumn("__rank", rank).withColumn("__b", F.conv(F.substring("__rank", 1, 4), 16, 10).cast("int"))
    counts = sorted((r["__b"], r["count"]) for r in marked.groupBy("__b").count().collect())
    if sum(c for _, c in counts) < n:
        raise ValueError("the sample is larger than the table")
    left, cut = n, -1
    for b, c in counts:
        cut = b
        if c >= left:
            break
        left -= c
    whole = marked.where(F.col("__b") < cut)
    edge = marked.where(F.col("__b") == cut).orderBy("__rank").limit(left)
    return whole.unionByName(edge).select(*df.columns) if n else df.limit(0)


def exact_indices(n_rows: int, n: int, seed: int) -> list[int]:
    """Row numbers of a sample without replacement from the legacy generator's permutation, in drawn order."""
    if n > n_rows:
        raise ValueError("the sample is larger than the table")
    return np.random.RandomState(seed).permutation(n_rows)[:n].tolist()


def exact_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Seeded sample drawn on the driver over row numbers in ``ordinal`` order, joined back."""
    ids = [r[0] for r in df.select("ordinal").orderBy("ordinal").limit(EXACT_IDS + 1).collect()]
    if len(ids) > EXACT_IDS:
        raise ValueError("too many rows for the exact mode; use hash_sample")
    drawn = [(ids[i],) for i in exact_indices(len(ids), n, seed)]
    return df.join(df.sparkSession.createDataFrame(drawn, "ordinal long"), "ordinal", "left_semi")


def calibration_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows; 0 gives none."""
    return hash_sample(df, min(n, df.count()), seed) if n else df.limit(0)


def group_sample(df: DataFrame, group: str, n: int, seed: int, key: str = "ordinal") -> DataFrame:
    """``n`` rows of each group by hash rank; a missing column or a smaller group is an error.

    Spark keeps the first ``n`` of each group before the shuffle, so a hot group costs no more than others.
    """
    if group not in df.columns:
        raise ValueError(f"no column {group}")
    if not df.groupBy(group).count().where(F.col("count") < n).isEmpty():
        raise ValueError("a group has fewer rows than wanted")
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(hash_rank(F.col(key), seed), key)))
    return ranked.where(F.col("__n") <= n).drop("__n")


def shuffled_pick(n_rows: int, k: int, seed: int) -> list[int]:
    """Row numbers of the first ``k`` after a seeded shuffle, sorted; all if ``k`` is at least ``n_rows``."""
    numbers = list(range(n_rows))
    if k >= n_rows:
        return numbers
    random.Random(seed).shuffle(numbers)
    return sorted(numbers[:k])


def alpha_ids(ids: list[str], alpha: float, seed: int) -> list[str]:
    """floor(alpha * N) of the sorted ids by the PCG64 generator, sorted; none, alpha outside (0, 1] or a bad seed is an error."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if isinstance(seed, bool) or not isinstance(seed, int) or seed < 0:
        raise ValueError("seed must be a whole number of at least 0")
    ordered = sorted(ids)
    k = int(alpha * len(ordered))
    if not k:
        raise ValueError("alpha gives no calibration question")
    return sorted(ordered[i] for i in np.random.default_rng(seed).choice(len(ordered), size=k, replace=False))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in source order."""
    return df.orderBy("ordinal").limit(n)


def remaining(df: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows whose id is not among the completed ones."""
    return df.join(done.select(key), key, "left_anti")


def overlap(calibration: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """Calibration rows whose identity also occurs in the evaluation set; any row is a leak."""
    return calibration.join(evaluation.select(key), key, "left_semi")


def chunks(df: DataFrame, every: int, order: str = "ordinal") -> DataFrame:
    """``df`` plus chunk_number: consecutive chunks of ``every`` rows in source order, without sorting in one task.

    Rows are numbered within blocks of 65,536 consecutive ordinals; the counts of the blocks before give the offset. Only
    these counts, one for each block, meet in one task. Rows without an ordinal come last.
    """
    at = F.coalesce(F.col(order).cast("long"), F.lit(2**62))
    blocked = df.withColumn("__block", F.floor(at / 65536).cast("long"))
    before = F.sum("count").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocked.groupBy("__block").count().select("__block", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = blocked.withColumn("__i", F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1).join(offsets, "__block")
    return numbered.select(*df.columns, F.floor((F.col("__before") + F.col("__i")) / every).cast("long").alias("chunk_number"))
