from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import identity, options, text
from plumbline.operators import fanout, matching, normalize, quality, selection, voting


def questions(spark, rows):
    """rows: (question_id, subject, stem, texts, gold index)"""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, question_id string, subject string, question_text string, texts array<string>, correct_index int")
    return df.select(
        "ordinal", "question_id", "subject", "question_text", options.build_choices(F.col("texts")).alias("choices"), "correct_index", options.letter(F.col("correct_index")).alias("correct_option"),
        F.get("texts", F.col("correct_index")).alias("correct_answer_text"), F.size("texts").alias("n_choices"),
    )


def test_mmlu(spark):
    ddl = "subject string, question string, choices string, answer int"
    rows = [("s", "q?", "['a', \"b's\", 'c', 'd']", 1), ("s", "q?", '["a", "b", "c", "d"]', 3)]
    got = normalize.mmlu(spark.createDataFrame(rows, ddl)).collect()
    assert [o.text for o in got[1].choices] == ["a", "b", "c", "d"] and got[1].correct_option == "D"
    assert got[1].question_id == hashlib.sha256(b"s|q?|a|b|c|d").hexdigest()[:16]
    array = spark.createDataFrame([("s", "q?", ["a", "b", "c"], 0)], "subject string, question string, choices array<string>, answer int")
    with pytest.raises(Exception, match="not four options"):
        normalize.mmlu(array).collect()
    assert normalize.mmlu(array, problems=True).first().problem == "not four options"
    assert normalize.mmlu(array.where(F.lit(False))).count() == 0


def test_other_shapes(spark):
    arc = spark.createDataFrame([("q", (["x", "y"], ["1", "2"]), "B")], "question string, choices struct<text:array<string>,label:array<string>>, answerKey string")
    assert normalize.arc(arc).first().correct_answer_text == "y"
    pro = spark.createDataFrame([("q", [None, "a", None, "b"], 3, "c")], "question string, options array<string>, answer_index int, category string")
    assert (normalize.mmlu_pro(pro).first().correct_index, normalize.mmlu_pro(pro).first().n_choices) == (1, 2)
    with pytest.raises(Exception, match="gold option is null"):
        normalize.mmlu_pro(pro.withColumn("answer_index", F.lit(0))).collect()
    swag = spark.createDataFrame([("l", "ctx", ["a", "b", "c", "d"], 2)], "activity_label string, ctx string, endings array<string>, label int")
    assert normalize.hellaswag(swag).first().correct_option == "C"
    tqa = spark.createDataFrame([("q", (["a", "b", "c"], [0, 1, 0]))], "question string, mc1_targets struct<choices:array<string>,labels:array<int>>")
    assert normalize.truthful_qa(tqa).first().correct_option == "B"
    assert normalize.normaliser("cais/mmlu", "all") is normalize.mmlu
    with pytest.raises(KeyError):
        normalize.normaliser("nobody/nothing")


def test_options(spark):
    df = spark.createDataFrame([('[{"text": " a  b ", "source_index": 3}, {"text": ""}, {"text": "c"}]', "", 2), ("broken", " b ", 0), (None, None, None)], "j string, letter string, i int")
    rows = df.select(options.labelled(options.parse_choices(F.col("j"))).alias("o"), options.gold_letter(F.col("letter"), F.col("i")).alias("g")).collect()
    assert [(o.label, o.text, o.source_index) for o in rows[0].o] == [("A", "a b", 3), ("C", "c", 2)]
    assert rows[1].o is None and [r.g for r in rows] == ["C", "B", ""]
    assert df.select(options.letters(F.lit(3)).alias("l"), options.letters(F.lit(27)).alias("m")).first() == (["A", "B", "C"], None)


def test_permutation_filter(spark):
    match = ["all of the above", "NONE OF THE ABOVE.", "both B and D", "C and D", "Neither B nor A"]
    safe = ["Vitamin C and zinc", "a plan B and a plan C together", "Grade A eggs", "neither here nor there", "17"]
    q = questions(spark, [(f"q{i}", "s", "stem", ["x", t], 0) for i, t in enumerate(match + safe)])
    got = {r.question_id: r.matched_pattern for r in quality.permutation_safety(q).collect()}
    assert all(got[f"q{i}"] for i in range(len(match))) and not any(got[f"q{len(match) + i}"] for i in range(len(safe)))
    first = quality.permutation_safety(questions(spark, [("q", "s", "t", ["A, B and C", "all of the above"], 0)])).first()
    assert (first.matched_pattern, first.offending_option_text) == ("letter_list_and_letter", "A, B and C")


def test_duplicates_and_validation(spark):
    q = questions(spark, [("a", "s", "t", ["x", "y"], 0), ("a", "s", "t", ["x", "y"], 0), (None, "s", "u", ["x", "y"], 0), (" ", "s", None, ["x", "NaN"], 1)])
    assert [r.question_id for r in quality.without_duplicate_ids(q).orderBy("ordinal").collect()] == [None, " "]
    assert quality.validation(q).first().asDict() == {"n_rows": 4, "null_ids": 1, "blank_ids": 1, "repeated_rows": 2, "null_stems": 1}
    assert quality.null_options(q).first().kind == "gold"
    ladder = {r.rung: r for r in quality.dedup_ladder(q).collect()}
    assert len(ladder) == 7 and ladder["strict"].pairs == 1 and ladder["strict"].redundant_pct == 25.0
    assert quality.strict_groups(q).first().group_size == 2 and quality.strict_group_members(q).count() == 2
    assert quality.first_rows(q).count() == 3
    assert quality.validation(q.where(F.lit(False))).first().n_rows == 0


def test_modal_k(spark):
    q = questions(spark, [("a", "s", "t", ["1", "2", "3"], 0), ("b", "s", "t", ["1", "2"], 0), ("c", "s", "t", ["1", "2"], 0), ("d", "s", "t", ["1", "2", "3"], 0)])
    assert quality.modal_k(q).first().modal_k == 2
    assert quality.apply_modal_k_gate(q, 2, 0.5).count() == 2
    with pytest.raises(quality.ModalKGateError):
        quality.apply_modal_k_gate(q, 2, 0.51)
    assert quality.modal_k(q.where(F.lit(False))).first().modal_k is None


def test_selection(spark):
    df = spark.createDataFrame([(i, f"q{i}", "a" if i % 3 else "b") for i in range(300)], "ordinal long, question_id string, subject string")
    assert selection.hash_sample(df, 40, 1).count() == 40
    assert set(selection.hash_sample(df, 40, 1).collect()) == set(selection.hash_sample(df.repartition(7), 40, 1).collect())
    with pytest.raises(ValueError):
        selection.hash_sample(df, 301, 1)
    assert selection.hash_sample(df, 0, 1).count() == 0
    assert {r["count"] for r in selection.group_sample(df, "subject", 5, 1).groupBy("subject").count().collect()} == {5}
    with pytest.raises(ValueError):
        selection.group_sample(df, "subject", 101, 1)
    with pytest.raises(ValueError):
        selection.group_sample(df, "nothing", 1, 1)
    with pytest.raises(ValueError):
        selection.subject_filter(df, ["zzz"])
    listed = spark.createDataFrame([("q1",), ("q5",)], "question_id string")
    assert selection.id_list(df, listed).count() == 2 and selection.remaining(df, listed).count() == 298
    with pytest.raises(ValueError):
        selection.id_list(df, spark.createDataFrame([("none",)], "question_id string"))
    assert selection.exact_sample(df, 10, 3).count() == 10 and selection.calibration_sample(df, 500, 3).count() == 300
    numbers = selection.chunks(df, 64).groupBy("chunk_number").count().collect()
    assert sorted(r["count"] for r in numbers) == [44, 64, 64, 64, 64]
    spread = spark.createDataFrame([(i * 40_000,) for i in range(10)] + [(None,), (None,)], "ordinal long")
    assert [r.chunk_number for r in selection.chunks(spread, 5).orderBy(F.col("ordinal").asc_nulls_last()).collect()] == [0] * 5 + [1] * 5 + [2] * 2
    assert selection.shuffled_pick(5, 9, 0) == [0, 1, 2, 3, 4]
    order = list(range(8))
    random.Random(7).shuffle(order)
    assert selection.shuffled_pick(8, 3, 7) == sorted(order[:3])
    assert selection.alpha_ids(["q5", "q4", "q3", "q2", "q1"], 0.4, 0) == ["q4", "q5"]
    assert [r.ordinal for r in selection.first_rows(df, 2).collect()] == [0, 1]


def test_rotations_and_shuffles(spark):
    q = questions(spark, [("q", "my_subject", "stem {x}", ["a", "b", "c"], 1)])
    r = {x.rotation: x for x in fanout.rotations(q).collect()}
    assert [o.text for o in r[1].shown] == ["b", "c", "a"] and r[2].slot_to_canonical == [2, 0, 1]
    back = fanout.rotations(q).select("rotation", fanout.canonical_letter(F.lit("A"), F.col("slot_to_canonical")).alias("c")).collect()
    assert {x.rotation: x.c for x in back} == {0: "A", 1: "B", 2: "C"}
    order = [0, 1, 2]
    random.Random("5:q").shuffle(order)
    s = fanout.shuffled(q, 5).first()
    assert s.slot_to_canonical == order and [o.text for o in s.shown_options] == ["abc"[i] for i in order]
    prompt = q.select(fanout.direct_prompt(options.labelled(F.col("choices")), "{subject}: {question} {{z}}\n{options}").alias("p")).first().p
    assert prompt == "my subject: stem {x} {z}\nA. a\nB. b\nC. c"
    with pytest.raises(KeyError):
        fanout.render("{nope}", {})
    assert fanout.hypothesis_prompts(q).count() == 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 25), min_size=1, unique=True), st.integers(0, 5))
def test_tie_is_free_of_order(ids, seed):
    key = dict(seed=seed, benchmark="b", question="q", method="m")
    assert identity.resolve_tie(ids, **key) == identity.resolve_tie(ids[::-1], **key) and identity.resolve_tie(ids, **key) in ids


def test_votes(spark):
    df = spark.createDataFrame([("a", "A"), ("a", "A"), ("a", "B"), ("b", "A"), ("b", "C"), ("c", None)], "q string, v string")
    won = {r.q: (r.winner, r.n_tied) for r in voting.majority(df, ["q"], "v", F.lit("bench"), F.col("q"), 1, "m").collect()}
    expected = identity.resolve_tie([0, 2], seed=1, benchmark="bench", question="b", method="m")
    assert won == {"a": ("A", 1), "b": (chr(65 + expected), 2)}
    with pytest.raises(ValueError):
        identity.resolve_tie([], seed=1, benchmark="", question="", method="")


def test_matching(spark):
    opts = [{"label": "A", "text": "Nation 1", "source_index": 0}, {"label": "B", "text": "Nation 10", "source_index": 1}, {"label": "C", "text": "xy", "source_index": 2}]
    texts = ["nation  1", "The nation 10 it is", "ion 1", "xy", "", None, "nati"]
    df = spark.createDataFrame([(t, opts, [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0], [0.2, 0.9]]) for t in texts], "t string, o array<struct<label:string,text:string,source_index:int>>, v array<double>, vs array<array<double>>")
    staged = {r.t: (r.stage, r.tied) for r in matching.matched(df, "t", "o").collect()}
    assert staged["nation  1"] == ("exact", ["A"]) and staged["xy"] == ("exact", ["C"])
    assert staged["The nation 10 it is"] == (None, []) and staged[None] == (None, []) and staged["nati"] == (None, [])
    with_vectors = {r.t: (r.stage, r.matched) for r in matching.match_options(df, "t", "o", F.lit("b"), F.col("t"), 1, "m", "v", "vs").collect()}
    assert with_vectors["nati"] == ("cosine", "A") and with_vectors[""] == (None, None)


def test_text_functions(spark):
    df = spark.createDataFrame([("Ab  C", "incomplete", "max_output_tokens"), ("x/y Z", "completed", None)], "t string, s string, r string")
    got = df.select(text.ws_case_key(F.col("t")).alias("k"), text.slug(F.col("t")).alias("g"), text.finish_reason(F.col("s"), F.col("r")).alias("f"), text.valid_run_id(F.lit("a b")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("ab c", "ab-c", "length", False), ("x/y z", "x-y-z", "stop", False)]
    assert spark.range(1).select(text.json_safe(F.lit(float("nan"))).alias("x")).first().x is None


def test_identity(spark):
    assert identity.canonical_json({"b": -0.0, "a": {3, 1}}) == '{"a":[1,3],"b":0.0}'
    for bad in ({"api_key": 1}, {"x": float("nan")}):
        with pytest.raises(ValueError):
            identity.canonical_json(bad)
    assert not identity.is_credential_key("max_tokens") and identity.is_credential_key("Access-Token")
    assert identity.sanitized_url("https://u:p@h.org:8/x?token=1#f") == "https://h.org:8/x"
    red = spark.range(1).select(identity.redacted(F.lit("Bearer abc api_key=zz https://h/x?q=1")).alias("r")).first().r
    assert "abc" not in red and "zz" not in red and "q=1" not in red
    df = spark.createDataFrame([("Whät  is", ["b", "A"]), ("whät is", ["a", "B"]), (None, None)], "q string, c array<string>")
    ids = [r.i for r in df.select(identity.semantic_identity(F.col("q"), F.col("c")).alias("i")).collect()]
    assert ids[0] == ids[1] != ids[2]
