from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import epoch_sampling as es
from plumbline.llm import proportional_sampling as ps
from plumbline.llm.common import seeded_uniform
from tests.conftest import SF, oracle_rows, same_rows


def rows(spark, n, first=0, month=1):
    return spark.range(first, first + n).select(F.concat(F.lit("q"), F.col("id")).alias("question_id"), F.make_timestamp(F.lit(2026), F.lit(month), F.lit(3), F.lit(0), F.lit(0), F.lit(0)).alias("ingested_at"), F.lit(0.9).alias("rate"), F.lit("x").alias("epoch"))


def ids(df):
    return {r.question_id for r in df.select("question_id").collect()}


def test_sample_only_gains_members(spark):
    epoch = es.month_epoch(F.col("ingested_at"))
    first = rows(spark, 2000)
    ledger = es.extend_ledger(first, "question_id", epoch, rate=0.3)
    later = first.unionByName(rows(spark, 3000, first=1000, month=2))
    grown = es.extend_ledger(later, "question_id", epoch, {"2026-02": 0.05}, 0.3, ledger)
    anew = es.extend_ledger(later.repartition(9), "question_id", epoch, {"2026-02": 0.05}, 0.3)
    before, after = ids(es.selected(ledger, "question_id")), ids(es.selected(grown, "question_id"))
    assert before <= after == ids(es.selected(anew, "question_id"))
    assert abs(len(before) / 2000 - 0.3) < 0.05 and abs(len(after - before) / 2000 - 0.05) < 0.03
    kept = es.sample_rows(later, "question_id", grown)
    assert ids(kept) == after and kept.count() > len(after)


def test_stored_ledger_keeps_what_was_frozen(spark, tmp_path):
    epoch = es.month_epoch(F.col("ingested_at"))
    first, second = rows(spark, 1000).select("question_id", "ingested_at"), rows(spark, 1500, first=500, month=2).select("question_id", "ingested_at")
    ledger = es.StoredLedger(spark, str(tmp_path / "ledger"), "question_id")
    assert ledger.read().count() == 0
    before = ids(es.selected(ledger.enter("a", first, epoch, rate=0.3), "question_id"))
    # A changed rate, a repeated delivery and a late row without a time touch nothing that is stored.
    again = ids(es.selected(ledger.enter("a", first, epoch, rate=0.9), "question_id"))
    late = spark.createDataFrame([("q7", None), ("new", None)], "question_id string, ingested_at timestamp")
    grown = es.StoredLedger(spark, str(tmp_path / "ledger"), "question_id").enter("b", second.unionByName(late), epoch, {"2026-02": 0.05}, 0.0)
    entry = {r.question_id: (r.epoch, r.rate) for r in grown.collect()}
    assert len(entry) == 2001 and entry["q7"] == ("2026-01", 0.3) and entry["q1700"] == ("2026-02", 0.05) and entry["new"] == ("", 0.0)
    after = ids(es.selected(grown, "question_id"))
    assert before == again and before < after


def test_an_unfinished_delivery_is_entered_anew(spark, tmp_path):
    epoch = es.month_epoch(F.col("ingested_at"))
    data = rows(spark, 50).select("question_id", "ingested_at")
    ledger = es.StoredLedger(spark, str(tmp_path / "ledger"), "question_id")
    ledger.enter("a", data, epoch, rate=0.9)
    (tmp_path / "ledger" / "a" / "_SUCCESS").unlink()
    assert ledger.read().count() == 0
    assert {r.rate for r in ledger.enter("a", data, epoch, rate=0.2).collect()} == {0.2}


def test_epoch_edges(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("a", None), ("", None)], "question_id string, ingested_at timestamp")
    got = es.extend_ledger(df, "question_id", es.month_epoch(F.col("ingested_at")))
    assert {(r.question_id, r.epoch) for r in got.collect()} == {("a", ""), ("", "")}
    assert es.extend_ledger(df.where(F.lit(False)), "question_id", es.month_epoch(F.col("ingested_at"))).count() == 0
    assert es.selected(got.withColumn("rate", F.lit(1.0)), "question_id").count() == 2 and es.selected(got.withColumn("rate", F.lit(0.0)), "question_id").count() == 0


def test_uniform_is_uniform(spark):
    u = np.array([r.u for r in spark.range(4000).select(seeded_uniform("id", seed=1).alias("u")).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    assert np.abs(np.sort(u) - (np.arange(4000) + 0.5) / 4000).max() < 1.6 / math.sqrt(4000)


@pytest.mark.parametrize("module", [es, ps])
def test_sql(spark, module):
    for name, sql in module.ORACLE_SQL.items():
        assert same_rows(module.QUERIES[name](spark, SF).toPandas(), oracle_rows(sql)), name


def test_rake():
    # The third row is out of reach: the other goals are scaled up and both margins are met.
    counts = np.array([[10.0, 5.0], [2.0, 8.0], [0.0, 0.0]])
    fitted, error = ps.rake(counts, np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]))
    assert error < 1e-8 and np.allclose(fitted.sum(axis=1), [0.625, 0.375, 0]) and np.allclose(fitted.sum(axis=0), [0.6, 0.4])
    odds = lambda m: m[0, 0] * m[1, 1] / (m[0, 1] * m[1, 0])
    assert np.isclose(odds(fitted), odds(counts))


def test_rake_says_where_margins_contradict():
    fitted, error = ps.rake(np.array([[10.0, 0.0], [0.0, 8.0]]), np.array([0.5, 0.5]), np.array([0.9, 0.1]))
    assert error > 0.1 and np.allclose(fitted.sum(axis=1), [0.5, 0.5])
    assert ps.rake(np.zeros((2, 2)), np.array([0.5, 0.5]), np.zeros(2))[1] == 0.0


def test_quotas():
    assert ps.quotas([0.5, 0.3, 0.2], [0, 0, 0], [100, 100, 100], 10) == [5, 3, 2]
    assert ps.quotas([0.9, 0.1], [0, 3], [100, 100], 10) == [7, 3]
    assert ps.quotas([0.5, 0.5], [0, 4], [100, 2], 10) == [5, 2]
    assert ps.quotas([], [], [], 10) == [] and ps.quotas([0.0], [5], [100], 0) == [5]


def sample(spark, data, targets, seed=1):
    d = spark.createDataFrame(data, "id string, category string, attribute int, key string")
    t = spark.createDataFrame(targets, "plan_id int, category string, target_share double, min_rows int, plan_rows long")
    return ps.ProportionalSample(d, t, seed)


def test_sample_meets_targets(spark):
    data = [(f"i{i}", ["big one", "Big_One", "BIG-ONE"][i % 3] if i % 4 else "small", i % 5, "x") for i in range(2000)] + [("rare", "rare", None, "x"), ("rare", "rare", 1, "x"), (None, "rare", 1, "x"), ("nocat", None, 1, "x")]
    s = sample(spark, data, [(1, "big_one", 0.2, 5, 100), (1, "small", 0.7, 5, 100), (1, "rare", 0.1, 5, 100), (1, None, 0.1, 5, 100), (2, "gone", 1.0, 1, 10)])
    got = s.sample().collect()
    sizes = {(p, c): len({r.id for r in got if (r.plan_id, r.subject) == (p, c)}) for p, c in {(r.plan_id, r.subject) for r in got}}
    assert sizes == {(1, "big_one"): 20, (1, "small"): 70, (1, "rare"): 1} and len(got) == 91
    report = {(r.plan_id, r.subject): r for r in s.report().collect()}
    assert report[1, "rare"].short and report[1, "rare"].gap_rows == 9.0 and report[2, "gone"].short and not report[1, "small"].short
    assert sorted(got) == sorted(s.sample().collect())
    assert all(r.drawn == r.quota == sizes.get((r.plan_id, r.subject), 0) for r in report.values())
    margins = s.margins().where("plan_id = 1").collect()
    assert {m: round(sum(r.target_share for r in margins if r.margin == m), 9) for m in ("category", "attribute")} == {"category": 1.0, "attribute": 1.0}
    assert all(abs(r.fitted_share - r.target_share) <= r.margin_error + 1e-12 for r in margins)
    assert max(abs(r.gap) for r in margins if r.margin == "category") < 0.12
    # The second margin keeps the population's shares.
    attribute = {d[0]: d[2] for d in data}
    small = [attribute[r.id] for r in got if r.subject == "small"]
    assert max(small.count(a) for a in range(5)) <= 28


def test_empty_sample(spark):
    s = sample(spark, [], [(1, "a", 1.0, 1, 10)])
    assert s.sample().count() == 0 and s.report().first().short
    assert s.margins().collect()[0].gap == 0.0
    none = sample(spark, [("i", "a", 1, "x")], [])
    assert none.report().count() == none.sample().count() == none.margins().count() == 0
