from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.stats import clopper_pearson, counted_mad_bootstrap, exact_mad_bootstrap
from plumbline.operators import metrics as M


def results(spark, pairs):
    return spark.createDataFrame([("c", i, g, a) for i, (g, a) in enumerate(pairs)], "cond string, ordinal long, correct_option string, parsed_choice string")


def test_accuracy(spark):
    r = M.accuracy(results(spark, [("A", "A"), ("B", "C"), ("C", None)]), ["cond"]).first()
    assert r.accuracy == pytest.approx(1 / 3) and r.accuracy_conditional == 0.5
    e = M.accuracy(results(spark, [("A", "A")]).where(F.lit(False)), []).first()
    assert (e.accuracy, e.accuracy_conditional, e.n_total) == (0.0, 0.0, 0)


def test_clopper_pearson():
    # Fixed value: the published interval of 6,653 right answers in 13,564.
    low, high = clopper_pearson(6653, 13564)
    assert low == pytest.approx(0.48204257005438156, abs=1e-12) and high == pytest.approx(0.4989405739998935, abs=1e-12)
    assert clopper_pearson(0, 5)[0] == 0.0 and clopper_pearson(5, 5)[1] == 1.0 and clopper_pearson(0, 0) == (None, None)


def test_intervals_on_rows(spark):
    r = M.accuracy_intervals(results(spark, [("A", "A"), ("B", "C"), ("C", None)]), ["cond"]).first()
    assert r.ci_low < 1 / 3 < r.ci_high


def test_mad(spark):
    assert M.mad(results(spark, [("A", "A"), ("B", "A"), ("C", None), ("D", None)]), ["cond"]).first().mad == pytest.approx(25.0)
    assert M.mad(results(spark, [("A", None), ("B", None)]), ["cond"]).first().mad is None


def test_recalls(spark):
    # Recalls of 80, 25, 0 and 100: mean 51.25, so the deviations are 28.75, -26.25, -51.25 and 48.75.
    pairs = [("A", "A")] * 4 + [("A", "D")] + [("B", "B"), ("B", "C"), ("B", "C"), ("B", "A")] + [("C", "B")] + [("D", "D")] * 2 + [("D", None)]
    got = {r.letter: r.recall for r in M.recalls(results(spark, pairs), ["cond"]).collect()}
    assert got == {"A": 80.0, "B": 25.0, "C": 0.0, "D": 100.0}
    assert M.recall_rstd(results(spark, pairs), ["cond"]).first().rstd == pytest.approx(math.sqrt((28.75**2 + 26.25**2 + 51.25**2 + 48.75**2) / 4))
    one = results(spark, [("B", "B"), ("B", "D"), ("B", "B"), ("B", "B")])
    assert {r.letter: r.recall for r in M.recalls(one, ["cond"]).collect()} == {"B": 75.0, "D": None}
    assert M.recall_rstd(one, ["cond"]).first().rstd == 0.0
    assert M.recall_wide(one, ["cond"], ["B", "D"]).first().asDict() == {"cond": "c", "B": 75.0, "D": None}


def traces(spark, rows):
    return spark.createDataFrame([("c", f"q{i}", t, g) for i, (t, g) in enumerate(rows)], "cond string, question_id string, per_rotation_choices array<string>, correct_index int")


def test_order_sensitivity(spark):
    r = M.order_sensitivity_letters(traces(spark, [(["A", "B", "C", "D"], 0)]), ["cond"]).first()
    assert r.order_rstd == pytest.approx(0.4330127, abs=1e-6) and r.order_flip_rate == 1.0
    assert M.order_sensitivity_letters(traces(spark, [(["A", "A", None, "A"], 0)]), ["cond"]).first().order_flip_rate == 0.0
    r = M.order_sensitivity_letters(traces(spark, [([None] * 4, 0), (["A"] * 4, 0), (["A"] * 4, None)]), ["cond"]).first()
    assert (r.order_flip_rate, r.n_questions) == (0.0, 1)


def test_order_sensitivity_matrix_agrees_with_letters(spark):
    slots = [0, 3, 1, 2]
    matrix = [[0.7 if j == s else 0.1 for j in range(4)] for s in slots]
    letters = [chr(65 + (s + k) % 4) for k, s in enumerate(slots)]
    m = spark.createDataFrame([("c", "q", matrix, 2)], "cond string, question_id string, option_distributions array<array<double>>, correct_index int")
    assert M.order_sensitivity_matrix(m, ["cond"]).first() == M.order_sensitivity_letters(traces(spark, [(letters, 2)]), ["cond"]).first()
    single = m.withColumn("option_distributions", F.array(F.get("option_distributions", F.lit(0))))
    assert M.order_sensitivity_matrix(single, ["cond"]).count() == 0
    assert M.order_sensitivity_matrix(single, ["cond"], strict_compat=True).first().order_rstd == 0.0


def test_agreement(spark):
    def rate(answers):
        df = spark.createDataFrame([("q", a) for a in answers], "question_id string, parsed_choice string")
        return M.agreement(df, ["question_id"], []).first()

    assert (rate("CCCC").agreement_rate, rate("CCCC").n_groups) == (1.0, 1)
    assert (rate([None] * 4).agreement_rate, rate([None] * 4).n_fully_missing) == (1.0, 1)
    assert rate(["C", "C", None, "C"]).agreement_rate == 0.0
    assert rate(["C"]).agreement_rate is None


def test_health_boundary(spark):
    df = spark.createDataFrame([("c", "failure"), ("c", "success")], "cond string, status string")
    assert M.transport_health(df, ["cond"], F.col("status") == "failure").first().status == "infra_failure"


def test_bootstrap_modes_agree(spark):
    pairs = [("A", "A")] * 60 + [("B", "A")] * 25 + [("B", "B")] * 40 + [("C", None)] * 9
    gold, answers = [g for g, _ in pairs], [a for _, a in pairs]
    exact = exact_mad_bootstrap(gold, answers, 3000)
    import pandas as pd

    counts = pd.DataFrame(pairs, columns=["gold", "answer"]).groupby(["gold", "answer"], dropna=False).size().reset_index(name="n")
    assert counted_mad_bootstrap(counts, 3000) == pytest.approx(exact, rel=0.1)
    df = results(spark, pairs)
    assert M.mad_bootstrap_exact(df, ["cond"], 3000).first().mad_std == pytest.approx(exact)
    assert M.mad_bootstrap(df, ["cond"], 3000).first().mad_std == pytest.approx(exact, rel=0.1)


def test_evaluate_and_python_metric(spark):
    df = results(spark, [("A", "A"), ("B", "C"), ("C", None)])
    assert {"accuracy", "mad", "rstd"} <= set(M.evaluate(df, ["cond"]).columns)
    assert M.python_metric(df, ["cond"], lambda p: {"rows": len(p)}).first().value == 3.0
    with pytest.raises(ValueError):
        M.metric("mad")(lambda *_: None)


def test_one_pass_equals_single_metrics(spark):
    cases = [("A", "A"), ("B", "C"), ("C", None), ("A", "B"), ("D", "D"), ("A", "A"), ("", "A"), (None, "B")]
    df = results(spark, cases).unionByName(results(spark, [("A", None)]).withColumn("cond", F.lit("none"))).unionByName(results(spark, [("B", "B")]).withColumn("cond", F.lit(None).cast("string")))
    one = {r.cond: r for r in M.letter_metrics(df, ["cond"]).collect()}
    for metric, column in ((M.accuracy, "accuracy"), (M.accuracy, "n_scored"), (M.mad, "mad"), (M.recall_rstd, "rstd")):
        for r in metric(df, ["cond"]).collect():
            assert one[r.cond][column] == pytest.approx(r[column]) if r[column] is not None else one[r.cond][column] is None, (column, r.cond)


def test_paired(spark):
    df = spark.createDataFrame([("q", "A", "A", "B"), ("r", "A", "B", "A"), ("s", "A", "B", "C"), ("t", "A", None, None)], "q string, g string, a string, b string")
    assert tuple(M.paired(df, "q", "g", "a", "b").first()) == (4, 3, 1, 1, 1)
