"""Problem 3: duplicates hidden by formatting.

Records become canonical keys, are range-partitioned and sorted externally by Spark, and each
partition is scanned once, comparing full keys of neighbours. The range key is (hash of the key, id),
so even one group holding a third of all rows is cut into many ranges; the at most few runs that touch
a partition's edge are stitched by their full keys afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import FIELD_SEP, Scratch, option_texts, table

#: Everything that is not a letter or digit goes, but for a point between digits and a minus that
#: follows white space (or starts the text) and precedes a digit.
_NOISE = r"(?U)[^\p{L}\p{N}.\-]|(?<!\p{Nd})\.|\.(?!\p{Nd})|(?<!\s)(?<!^)-|-(?!\p{Nd})"

_RUN_SCHEMA = "table_name string, id long, first_id long, run long, edge_key string"


def canonical_text(text: Column) -> Column:
    """``text`` without letter case, white space and punctuation; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _NOISE, ""))


def question_key(question_text: Column, choices_json: Column) -> Column:
    """Canonical key of a question: stem, then every option text in list order."""
    return F.concat_ws(FIELD_SEP, canonical_text(question_text), F.transform(option_texts(choices_json), canonical_text))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent runs of one sorted partition: every row with its run's first id, then the edge runs."""
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    last: tuple | None = None  # hash, table, key of the row before
    run, first_id = base - 1, 0
    first_hash: int | None = None
    head: list[tuple] = []  # runs that share the partition's first hash
    tail: list[tuple] = []  # runs that share the hash seen last

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h = batch.column("h").to_numpy(zero_copy_only=False)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        names, keys = batch.column("table_name"), batch.column("key")
        start = np.ones(n, dtype=bool)
        if n > 1:
            same = (h[1:] == h[:-1]) & ~pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            start[1:] = ~(same & ~pc.not_equal(names.slice(1), names.slice(0, n - 1)).to_numpy(zero_copy_only=False))
        if last is not None:
            start[0] = not (last[0] == h[0] and last[1] == names[0].as_py() and last[2] == keys[0].as_py())
        runs = run + np.cumsum(start)
        where = np.maximum.accumulate(np.where(start, np.arange(n), -1))
        firsts = np.where(where >= 0, ids[np.maximum(where, 0)], first_id)
        if first_hash is None:
            first_hash = int(h[0])
        starts = np.flatnonzero(start)
        for i in starts[h[starts] == first_hash]:
            head.append((names[i].as_py(), int(ids[i]), int(runs[i]), keys[i].as_py()))
        if int(h[-1]) != (last[0] if last else None):
            tail = []
        for i in starts[h[starts] == h[-1]]:
            tail.append((names[i].as_py(), int(ids[i]), int(runs[i]), keys[i].as_py()))
        run, first_id = int(runs[-1]), int(firsts[-1])
        last = (int(h[-1]), names[n - 1].as_py(), keys[n - 1].as_py())
        yield pa.RecordBatch.from_arrays(
            [names.cast(pa.string()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(runs, pa.int64()), pa.nulls(n, pa.string())],
            names=["table_name", "id", "first_id", "run", "edge_key"],
        )
    edges = list(dict.fromkeys(head + tail))
    if edges:
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in edges], pa.string()), pa.nulls(len(edges), pa.int64()), pa.array([e[1] for e in edges], pa.int64()), pa.array([e[2] for e in edges], pa.int64()), pa.array([e[3] for e in edges], pa.string())],
            names=["table_name", "id", "first_id", "run", "edge_key"],
        )


def duplicate_runs(records: DataFrame) -> DataFrame:
    """(table_name, id, first_id) of every record; records are (table_name, id, key).

    Two records are copies iff table and full key are equal; ``first_id`` is the smallest id of the
    set. Null ids are dropped (nothing could name them), a null key counts as empty; records with
    nothing left after normalisation are copies of each other. An empty input gives no rows. Other
    columns of the input are ignored, whatever their names.
    """
    spark = records.sparkSession
    keyed = records.where(F.col("id").isNotNull()).select(
        F.coalesce("table_name", F.lit("")).alias("table_name"), F.col("id").cast("long").alias("id"), F.coalesce("key", F.lit("")).alias("key")
    )
    # Written once: range boundaries are sampled in a pass of its own, which would make every key again.
    scratch = Scratch(spark)
    hashed = scratch.keep(keyed.withColumn("h", F.xxhash64("table_name", "key")), "keys")
    ordered = hashed.repartitionByRange("h", "id").sortWithinPartitions("h", "table_name", "key", "id")
    runs = scratch.keep(ordered.mapInArrow(_scan, _RUN_SCHEMA), "runs")
    # At most the runs at the two edges of each partition: the broadcast is bounded by the partition count.
    edges = runs.where(F.col("edge_key").isNotNull())
    true_first = edges.groupBy("table_name", "edge_key").agg(F.min("first_id").alias("set_first"), F.collect_set("run").alias("runs"))
    stitched = true_first.where(F.size("runs") > 1).select(F.explode("runs").alias("run"), "set_first")
    return (
        runs.where(F.col("edge_key").isNull())
        .join(F.broadcast(stitched), "run", "left")
        .select("table_name", "id", F.coalesce("set_first", "first_id").alias("first_id"))
    )


def copies(runs: DataFrame) -> DataFrame:
    """(table_name, first_id, copy_id): every record that repeats an earlier one."""
    return runs.where(F.col("id") != F.col("first_id")).select("table_name", "first_id", F.col("id").alias("copy_id"))


def representatives(runs: DataFrame) -> DataFrame:
    """(table_name, first_id, n_copies): one representative of each set and its exact number of records."""
    return runs.groupBy("table_name", "first_id").agg(F.count(F.lit(1)).alias("n_copies"))


def test_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of toy_normalized and mmlu_strict_dupes with their canonical keys."""
    questions = table(spark, folder, "toy_normalized").select(
        F.lit("toy_normalized").alias("table_name"), F.col("ordinal").alias("id"), question_key(F.col("question_text"), F.col("choices_json")).alias("key")
    )
    previews = table(spark, folder, "mmlu_strict_dupes").select(
        F.lit("mmlu_strict_dupes").alias("table_name"), F.col("group_id").alias("id"), canonical_text(F.col("stem_preview")).alias("key")
    )
    return questions.unionByName(previews)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies(duplicate_runs(test_records(spark, folder)))


def p3_representatives(spark: SparkSession, folder: str) -> DataFrame:
    return representatives(duplicate_runs(test_records(spark, folder)))


_SQL_MARK = r"regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(2) || '\2', 'g'), '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(2) || '\2', 'g'), '(^|[\s\v\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{85}}\x{{1680}}])-(\p{{Nd}})', '\1' || chr(3) || '\2', 'g')"
_SQL_CANON = r"lower(regexp_replace(" + _SQL_MARK + r", '[^\p{{L}}\p{{N}}\x02\x03]', '', 'g'))"


def _sql_keys() -> str:
    canon = _SQL_CANON.format
    return f"""
WITH options AS (
  SELECT ordinal, row_number() OVER (PARTITION BY ordinal ORDER BY pos) AS pos, {canon("o")} AS o
  FROM (SELECT ordinal, unnest(json_extract_string(choices_json, '$[*].text')) AS o, unnest(range(json_array_length(choices_json)::BIGINT)) AS pos FROM toy_normalized)
), keys AS (
  SELECT 'toy_normalized' AS table_name, q.ordinal AS id, {canon("q.question_text")} || chr(31) || coalesce((SELECT string_agg(o, chr(31) ORDER BY pos) FROM options x WHERE x.ordinal = q.ordinal), '') AS key
  FROM toy_normalized q
  UNION ALL
  SELECT 'mmlu_strict_dupes', group_id, {canon("stem_preview")} FROM mmlu_strict_dupes
), sets AS (SELECT table_name, id, min(id) OVER (PARTITION BY table_name, key) AS first_id FROM keys)"""


QUERIES = {"p3_found": p3_found, "p3_representatives": p3_representatives}
ORACLE_SQL = {
    "p3_found": _sql_keys() + " SELECT table_name, first_id, id AS copy_id FROM sets WHERE id <> first_id",
    "p3_representatives": _sql_keys() + " SELECT table_name, first_id, count(*) AS n_copies FROM sets GROUP BY ALL",
}
