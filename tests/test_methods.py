from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions.identity import resolve_tie
from plumbline.functions.options import labelled
from plumbline.operators import methods as M
from plumbline.operators.scoring import reparse
from plumbline.sources import responders
from plumbline.sources.files import toy_questions


def test_direct_on_toy(spark):
    out = M.run_method("direct_mcq", toy_questions(spark), responders.dummy)
    assert out.agg(F.avg(F.col("is_correct").cast("double"))).first()[0] == pytest.approx(0.3)
    assert set(out.select("answer_status").distinct().collect()) == {("success",)}
    assert M.run_method("direct_mcq", toy_questions(spark).where(F.lit(False)), responders.dummy).count() == 0


def failing(text: str | None, bad: list[str]):
    def respond(df):
        failed = F.col("question_id").isin(bad)
        return df.withColumns({"status": F.when(failed, "failure").otherwise("success"), "raw_text": F.when(~failed, text), "finish_reason": F.lit("stop"), "latency_seconds": F.lit(0.1), "logprobs": F.lit(None).cast("array<double>")})

    return respond


def test_failures_are_rows(spark):
    out = M.run_method("direct_mcq", toy_questions(spark), failing("Answer: B", ["toy_001"]))
    row = out.where("question_id = 'toy_001'").first()
    assert (row.transport_status, row.parsed_choice, row.is_correct, row.score_status, row.answer_status) == ("failure", None, None, "score_unscorable", "failure")
    assert out.where("parsed_choice = 'B'").count() == 9


def test_cyclic_votes(spark):
    out = M.run_method("cyclic_permutation", toy_questions(spark), responders.dummy, seed=3, benchmark="toy")
    for r in out.collect():
        assert r.per_rotation_choices == ["A", "B", "C", "D"] and r.n_permutations_total == 4
        assert r.parsed_choice == chr(65 + resolve_tie(range(4), seed=3, benchmark="toy", question=r.question_id, method="cyclic_permutation"))
    none = M.run_method("cyclic_permutation", toy_questions(spark), failing("nothing", ["toy_002"])).where("question_id = 'toy_002'").first()
    assert none.per_rotation_choices == [None] * 4 and none.n_permutations_failed == 4 and none.parsed_choice is None


def test_content_tracker_wins(spark):
    """A model that always picks the gold text gets it under every rotation and shuffle."""
    gold = toy_questions(spark).select("question_id", "correct_answer_text")

    def respond(df):
        joined = df.drop("correct_answer_text").join(gold, "question_id")
        letter = F.get(F.filter("options", lambda o: o["text"] == F.col("correct_answer_text")), F.lit(0))["label"]
        scores = F.transform("options", lambda o: F.when(o["text"] == F.col("correct_answer_text"), F.lit(-0.1)).otherwise(F.lit(-3.0)))
        return joined.withColumns({"status": F.lit("success"), "raw_text": F.concat(F.lit("Answer: "), letter), "finish_reason": F.lit("stop"), "latency_seconds": F.lit(0.0), "logprobs": scores})

    for name in ("direct_mcq", "shuffled_baseline", "cyclic_permutation", "direct_logprob", "cyclic_logprob", "two_stage"):
        assert M.run_method(name, toy_questions(spark), respond).where(F.col("is_correct")).count() == 10, name
    out = M.run_method("pride", toy_questions(spark), respond, calibration=toy_questions(spark).limit(4))
    assert out.where(F.col("is_correct")).count() == 10 and out.first().gate_n_evaluated == 10
    assert M.run_method("pride", toy_questions(spark), respond).first().peprior is None
    text = toy_questions(spark).select("question_id", F.col("correct_answer_text").alias("free_text_response"))
    assert M.stage_two_rotations(toy_questions(spark), text, respond).where(F.col("is_correct")).count() == 10


def test_all_failed_rotations(spark):
    out = M.run_method("cyclic_logprob", toy_questions(spark), failing(None, [f"toy_{i:03d}" for i in range(1, 11)])).first()
    assert out.parsed_choice is None and out.option_distributions[0] == [0.25] * 4
    with pytest.raises(Exception, match="all rotations"):
        M.run_method("pride", toy_questions(spark), failing(None, ["toy_001"]), calibration=toy_questions(spark)).collect()


def test_two_stage_paths(spark):
    def respond(df):
        first = F.startswith("prompt", F.lit("Question about")) & ~F.contains("prompt", F.lit("Give the letter"))
        match = F.contains("prompt", F.lit("Given answer"))
        text = F.when(first, "some words").when(match, "cannot tell").otherwise("Answer: A")
        status = F.when(first & (F.col("question_id") == "toy_003"), "failure").when(match & (F.col("question_id") == "toy_004"), "failure").otherwise("success")
        return df.withColumns({"status": status, "raw_text": text, "finish_reason": F.lit("stop"), "latency_seconds": F.lit(0.0), "logprobs": F.lit(None).cast("array<double>")})

    out = {r.question_id: r for r in M.run_method("two_stage", toy_questions(spark), respond).collect()}
    assert len(out) == 10 and out["toy_001"].fallback_used and out["toy_001"].parsed_choice == "A"
    assert (out["toy_003"].transport_status, out["toy_003"].parsed_choice, out["toy_003"].fallback_used) == ("failure", None, False)
    assert not out["toy_004"].fallback_used and out["toy_004"].parsed_choice is None


def test_capability_and_registry(spark):
    with pytest.raises(ValueError, match="option scores"):
        M.run_method("pride", toy_questions(spark), responders.dummy, supports_scores=False)
    with pytest.raises(ValueError):
        M.method("pride")(lambda *_: None)
    assert set(M.METHODS) == {"direct_mcq", "shuffled_baseline", "cyclic_permutation", "two_stage", "direct_logprob", "cyclic_logprob", "pride"}


def test_derived_and_reparsed(spark):
    q = toy_questions(spark).withColumn("options", labelled(F.col("choices")))
    saved = q.withColumns({"free_text_response": F.col("correct_answer_text"), "method_name": F.lit("two_stage"), "parsed_choice": F.lit(None).cast("string"), "is_correct": F.lit(None).cast("boolean"), "score_status": F.lit("x"), "parse_status": F.lit("x"), "parse_reason": F.lit("x"), "answer_status": F.lit("x")})
    out = M.from_free_text(saved)
    assert out.where(F.col("is_correct")).count() == 10 and out.first().derived_from_method_name == "two_stage" and len(out.first().per_rotation_choices) == 4
    stored = q.select("question_id", "options", "correct_option").withColumns({"method_name": F.when(F.col("question_id") == "toy_001", "two_stage").otherwise("direct_mcq"), "raw_text": F.lit("Answer: C"), "transport_status": F.lit("success"), "parsed_choice": F.lit("A"), "parse_status": F.lit("parse_ok"), "normalized_text": F.lit("A"), "parse_reason": F.lit("old"), "is_correct": F.lit(False), "score_status": F.lit("score_incorrect")})
    again = {r.question_id: r.parsed_choice for r in reparse(stored).collect()}
    assert again["toy_001"] == "A" and again["toy_002"] == "C" and len(again) == 10


def test_clients_and_cache(spark):
    waits: list[float] = []
    state = {"n": 0}

    def flaky(prompt):
        state["n"] += 1
        if state["n"] < 3:
            raise TimeoutError("slow")
        return "Answer: B"

    assert responders.call_with_retries(flaky, "p", sleep=waits.append)[:2] == ("success", "Answer: B") and len(waits) == 2 and 3.75 <= waits[0] <= 6.25 and 7.5 <= waits[1] <= 12.5
    assert responders.call_with_retries(lambda p: " ", "p")[4] == "ValueError"
    ask = responders.client_responder(lambda: lambda prompt: "Answer: D" if "plus" in prompt else "x")
    assert M.run_method("direct_mcq", toy_questions(spark), ask).where("parsed_choice = 'D'").count() == 10
    identity = dict(provider="p", model="m", temperature=0.0, max_tokens=5, seed=None)
    asked = responders.with_cache_key(M._asked(toy_questions(spark)).withColumn("prompt", F.col("question_text")), **identity)
    rows = responders.cache_rows(responders.dummy(asked.limit(4)))
    broken = rows.withColumn("payload_digest", F.lit("x"))
    assert responders.cache_misses(asked, rows).count() == 6 and responders.cache_misses(asked, broken).count() == 10
    full = responders.cached(responders.dummy, rows, **identity)(asked.drop("cache_key"))
    assert full.where("status = 'success'").count() == 10
    replay = responders.recorded(spark.createDataFrame([("toy_001", "success", "Answer: A")], "question_id string, status string, raw_text string"), ["question_id"])
    assert M.run_method("direct_mcq", toy_questions(spark), replay).where("transport_status = 'failure'").count() == 9
