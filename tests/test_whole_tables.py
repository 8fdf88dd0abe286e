"""Queries that take whole tables where a part would look the same to their SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import methods, metrics, selection
from plumbline.plans import lenses
from plumbline.plans import metric_queries as MQ
from plumbline.plans import question_queries as Q
from plumbline.sources.tables import table
from tests.conftest import SF


def test_leakage_by_meaning_takes_all_questions(spark, tmp_path):
    toy, held = table(spark, SF, "toy_normalized"), table(spark, SF, "eval_items")
    options = F.to_json(F.transform(F.reverse("choices"), lambda c: F.struct(F.upper(c).alias("text"), F.lit(0).alias("source_index"))))
    copies = held.where(F.col("item_id") % 7 == 0).select((F.col("item_id") + 10_000_000).alias("ordinal"), "subject", F.upper(F.concat(F.lit("  "), "question")).alias("question_text"), options.alias("choices_json"))
    stem_only = held.where(F.col("item_id") % 7 == 1).select((F.col("item_id") + 20_000_000).alias("ordinal"), "subject", F.col("question").alias("question_text"), F.lit('[{"text": "x"}, {"text": "y"}]').alias("choices_json"))
    planted = copies.unionByName(stem_only).withColumn("n_choices", F.size(F.from_json("choices_json", "array<struct<text:string>>")))
    toy.unionByName(planted, allowMissingColumns=True).write.parquet(f"{tmp_path}/toy_normalized.parquet")
    held.write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {r.ordinal for r in Q.leakage_semantic(spark, str(tmp_path)).collect() if r.ordinal >= 10_000_000}
    assert got == {r.ordinal for r in copies.collect()} and got


def test_bootstrap_takes_all_resamples(spark):
    full = metrics.mad_bootstrap(lenses.results(spark, SF), MQ.BY, resamples=10_000)
    assert sorted(MQ.mad_bootstrap(spark, SF).collect()) == sorted(full.collect())


def test_pride_gate_sees_all_questions(spark, monkeypatch):
    seen, run = [], methods.run_method
    monkeypatch.setattr(methods, "run_method", lambda *a, **k: seen.append(run(*a, **k)) or seen[-1])
    rows = Q.pride_dummy(spark, SF).count()
    gate = seen[0].first()
    assert gate.gate_n_evaluated == rows and gate.gate_n_excluded > 0
    assert gate.gate_n_total == Q._one_each(spark, SF).count() == rows + gate.gate_n_excluded


def test_a_leak_is_an_error(spark):
    a = spark.createDataFrame([(1, "k"), (2, "l")], "ordinal long, key string")
    assert selection.require_disjoint(a, a.where("ordinal > 5"), "key").count() == 2
    with pytest.raises(ValueError, match="1 calibration rows"):
        selection.require_disjoint(a, a.where("ordinal = 2"), "key")
    with pytest.raises(ValueError, match="missing"):
        selection.id_list(a, spark.createDataFrame([("k",), ("x",)], "key string"), "key")
