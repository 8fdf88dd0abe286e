from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import grid
from plumbline.operators.selection import alpha_ids


def one(spark, ddl, value, expr):
    return spark.createDataFrame([(value,)], f"v {ddl}").select(expr.alias("o")).first().o


def test_equation_invariants(spark):
    rng, rows = np.random.default_rng(1), []
    for n in range(2, 11):
        gold = int(rng.integers(n))
        perfect = [[1.0 if (k + j) % n == gold else 0.0 for j in range(n)] for k in range(n)]
        noisy = [[x * 0.6 + 0.4 / n for x in r] for r in perfect]
        p = rng.dirichlet(np.ones(n), size=n).tolist()
        rows.append((n, gold, perfect, noisy, p, [[x * 0.3 for x in r] for r in p], rng.dirichlet(np.ones(n)).tolist()))
    m = "array<array<double>>"
    df = spark.createDataFrame(rows, f"n int, gold int, perfect {m}, noisy {m}, p {m}, scaled {m}, o array<double>")
    uniform = F.transform("o", lambda x: F.lit(1.0) / F.size("o"))
    prior = V.prior_from_rollouts(F.col("p"))
    got = df.select(
        "*", V.first_max(V.content_probabilities(F.col("perfect"))).alias("a"), V.first_max(V.content_probabilities(F.col("noisy"))).alias("b"), V.content_probabilities(F.col("p")).alias("c"), prior.alias("pr"),
        V.prior_from_rollouts(F.col("scaled")).alias("ps"), V.debiased(F.col("o"), uniform).alias("d"), V.debiased(F.col("o"), prior).alias("e"), V.debiased(F.col("o"), F.transform(prior, lambda x: x * 7)).alias("f"),
    ).collect()
    for r in got:
        P = np.array(r.p)
        logs = np.log(P).mean(axis=0)
        content = [np.mean([P[k, (c - k) % r.n] for k in range(r.n)]) for c in range(r.n)]
        assert r.a == r.gold == r.b
        assert np.allclose(r.c, np.array(content) / sum(content)) and sum(r.c) == pytest.approx(1)
        assert np.allclose(r.pr, np.exp(logs) / np.exp(logs).sum()) and np.allclose(r.pr, r.ps)
        assert np.allclose(r.d, r.o) and np.allclose(r.e, r.f)


def test_shapes_are_refused(spark):
    assert one(spark, "array<array<double>>", [[0.5, 0.5]], V.content_probabilities(F.col("v"))) is None
    assert one(spark, "array<array<double>>", [[1.0]], V.prior_from_rollouts(F.col("v"))) is None
    assert one(spark, "array<double>", [0.5, 0.5], V.debiased(F.col("v"), F.array(F.lit(1.0)))) is None
    assert one(spark, "array<double>", [0.1], V.label_distribution(F.col("v"))) is None


def test_label_distribution_and_choice(spark):
    got = one(spark, "array<double>", [-0.1, None, -2.0], V.label_distribution(F.col("v")))
    raw = np.exp(np.array([-0.1, -30.0, -2.0]))
    assert np.allclose(got, np.clip(raw / raw.sum(), 1e-12, 1))
    prior = F.create_map(F.lit("A"), F.lit(0.9), F.lit("B"), F.lit(0.1))
    labels = F.array(F.lit("A"), F.lit("B"))
    assert one(spark, "array<double>", [0.6, 0.4], V.debiased_choice(F.col("v"), prior, labels)) == "B"
    assert one(spark, "array<double>", [0.6, 0.4], V.debiased_choice(F.col("v"), F.lit(None).cast("map<string,double>"), labels)) == "A"


def test_parse_matrix(spark):
    texts = ['[[0.5,0.5],[0.1,0.9]]', '[["a"]]', "[]", "x", None, "[[1],[1,2]]", "[1,2]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(V.parse_matrix(F.col("t")).alias("m")).collect()
    assert [r.m is not None for r in df] == [True, False, False, False, False, False, False]


def test_small_functions(spark):
    assert one(spark, "array<double>", [0.0, 0.0], V.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0)))) == -1.0
    assert one(spark, "array<double>", [0.4, 0.2, 0.4], V.top_two_tie(F.col("v"))) is True
    assert sum(one(spark, "array<double>", [0.1, 0.2, 0.3, 0.4], V.paired_forms(F.col("v")))) == pytest.approx(1)
    assert one(spark, "array<double>", [0.0, 0.0], V.normalised(F.col("v"))) == [0.5, 0.5]


DIRECT = {"q1": ("B", [0.6, 0.4]), "q2": ("A", [0.99, 0.01]), "q3": ("B", [0.2, 0.8]), "q4": ("A", [0.7, 0.3]), "q5": ("B", [0.3, 0.7])}


def inputs(spark, gold=None):
    ddl = "question_id string, correct_option string, answer_status string, option_distributions array<array<double>>"
    direct = spark.createDataFrame([(q, g, "success", [v]) for q, (g, v) in DIRECT.items()] + [("q6", "A", "failure", [[0.5, 0.5]]), ("q7", "A", "success", [[0.5, 0.5]])], ddl)
    half, lean = [[0.5, 0.5]] * 2, [[0.9, 0.1]] * 2
    cyclic = spark.createDataFrame([(q, gold or g, "success", lean if q in ("q4", "q5") else half) for q, (g, _) in DIRECT.items()] + [("q6", "A", "success", half)], ddl)
    return direct, cyclic


def test_flagship_grid(spark):
    direct, cyclic = inputs(spark)
    recs = grid.one_option_count(grid.records(direct, cyclic))
    ids = [r.question_id for r in recs.select("question_id").collect()]
    assert sorted(ids) == ["q1", "q2", "q3", "q4", "q5"]
    assert tuple(grid.excluded(direct, cyclic, recs).first()) == (1, 0, 1)
    rows = grid.exact_cells(ids, [0.4], [0])
    assert [q for _, _, q in rows] == ["q4", "q5"]
    answered = grid.answers(recs, spark.createDataFrame(rows, "alpha double, seed int, question_id string"))
    assert {r.question_id: r.parsed_choice for r in answered.collect()} == {"q1": "B", "q2": "A", "q3": "B", "q4": "A", "q5": "A"}
    r = grid.cell_metrics(answered, ["alpha", "seed"]).first()
    assert r.n_questions == 5 and r.accuracy == pytest.approx(80.0) and r.rstd == pytest.approx(16.66666666666667) and r.mad == pytest.approx(20.0)
    assert grid.by_alpha(grid.cell_metrics(answered, ["alpha", "seed"])).first().accuracy_std == 0.0
    assert grid.cell_metrics(grid.baselines(recs), ["method"]).count() == 2


def test_grid_errors(spark):
    direct, cyclic = inputs(spark, gold="A")
    with pytest.raises(Exception, match="gold letters differ"):
        grid.records(direct, cyclic).collect()
    for bad in (0.01, 0.0, 1.5):
        with pytest.raises(ValueError):
            alpha_ids(["a", "b"], bad, 0)
    with pytest.raises(ValueError):
        alpha_ids(["a", "b"], 0.5, -1)
    with pytest.raises(ValueError):
        grid.exact_cells(["a"], [0.4, 0.4], [0])
    mixed = spark.createDataFrame([(2,), (3,)], "n int")
    with pytest.raises(ValueError):
        grid.one_option_count(mixed)


def test_cutoffs_have_the_right_size(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("question_id"))
    recs = grid.ranked(ids, [0, 1]).cache()
    cutoffs = grid.rank_cutoffs(recs.select("ranks"), [0.1, 0.5], [0, 1], buckets=64)
    assert cutoffs == grid.rank_cutoffs(recs.repartition(5).select("ranks"), [0.1, 0.5], [0, 1])
    got = {(a, s): recs.where(F.get("ranks", F.lit(s)) <= cut).count() for a, s, cut in cutoffs}
    assert got == {(0.1, 0): 50, (0.1, 1): 50, (0.5, 0): 250, (0.5, 1): 250}
    for bad in ([0.1, 0.1], [0.0001]):
        with pytest.raises(ValueError):
            grid.rank_cutoffs(recs.select("ranks"), bad, [0, 1])


def test_hashed_answers_equal_listed_ones(spark):
    direct, cyclic = inputs(spark)
    recs = grid.ranked(grid.records(direct, cyclic), [0, 7]).cache()
    listed = [(a, s, r.question_id) for a, s, cut in grid.rank_cutoffs(recs.select("ranks"), [0.4, 0.6], [0, 7]) for r in recs.collect() if r.ranks[[0, 7].index(s)] <= cut]
    there = grid.answers(recs.drop("ranks"), spark.createDataFrame(listed, "alpha double, seed int, question_id string"))
    here = grid.hashed_answers(recs, [0.4, 0.6], [0, 7])
    assert sorted(here.collect()) == sorted(there.select(*here.columns).collect()) and here.count() == 20


def test_comparison(spark):
    ours = spark.createDataFrame([("a", 1.0)], "name string, ours double")
    targets = spark.createDataFrame([("a", 0.5), ("b", 2.0)], "name string, target double")
    assert {r.name: r.difference for r in grid.comparison(ours, targets).collect()} == {"a": 0.5, "b": None}
