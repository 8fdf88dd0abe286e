from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions.parsing import AMBIGUOUS, MISSING, OK, parse_answer, parse_replies, unwrap

TOOLS = {"A": "Claw hammer", "B": "Torque wrench", "C": "Spirit level", "D": "Rip saw"}
CRAFT = {"A": "Weaving on a loom", "B": "Throwing clay", "C": "Blowing glass", "D": "Carving limewood"}
WEIGHTS = {"A": "7 kg", "B": "9 kg", "C": "70 kg", "D": "90 kg"}

CASES = [
    # One letter, in whatever dress.
    (TOOLS, "C", OK, "C"),
    (TOOLS, "\t d\n", OK, "D"),
    (TOOLS, "[A]!", OK, "A"),
    (TOOLS, "__C__", OK, "C"),
    (TOOLS, "<choice>D</choice>", OK, "D"),
    (TOOLS, "<note>Rip saw</note>", MISSING, None),
    # A selection goes before other mentions, the last one before earlier ones.
    (TOOLS, "Answer: D", OK, "D"),
    (TOOLS, "We go with A.", OK, "A"),
    (TOOLS, "Option B measures torque. My choice is C.", OK, "C"),
    (TOOLS, "Letter D was tempting. Final answer: B", OK, "B"),
    (TOOLS, "D cannot be it. Thus A", OK, "A"),
    (TOOLS, "Final answer is D, not C or B.", OK, "D"),
    # Several joined letters decide nothing.
    (TOOLS, "B and D", AMBIGUOUS, None),
    (TOOLS, "Answer: C or A", AMBIGUOUS, None),
    (TOOLS, "option B or C", AMBIGUOUS, None),
    (TOOLS, "My answer is perhaps A or D", AMBIGUOUS, None),
    (TOOLS, "Answer: C. On reflection, my answer is B or A.", AMBIGUOUS, None),
    # Option texts: given as the answer, not merely mentioned.
    (CRAFT, "Throwing clay", OK, "B"),
    (CRAFT, "They select Blowing glass.", MISSING, None),
    (CRAFT, "We select Blowing glass.", OK, "C"),
    (CRAFT, "I picked Throwing clay as it came first.", MISSING, None),
    (CRAFT, "The older trade is throwing clay.", OK, "B"),
    (CRAFT, "Carving limewood, obviously", OK, "D"),
    (CRAFT, "My pick: blowing glass", OK, "C"),
    (CRAFT, "Nobody here has tried Throwing clay before.", MISSING, None),
    (CRAFT, "It might be throwing clay, or carving limewood.", AMBIGUOUS, None),
    # Numbers inside other numbers are no mention; nothing to parse; no options.
    (WEIGHTS, "Together they come to 170 kg.", MISSING, None),
    (TOOLS, "", MISSING, None),
    (TOOLS, None, MISSING, None),
    ({}, "B", MISSING, None),
]


@pytest.mark.parametrize(("options", "text", "status", "choice"), CASES)
def test_grammar(options, text, status, choice):
    got = parse_answer(text, options)
    assert (got.status, got.final_choice) == (status, choice)


def test_unwrap_is_repeated_and_only_whole():
    assert unwrap("**`<final>B</final>`**") == "B"
    assert unwrap("**a** b") == "**a** b"
    assert unwrap("****") == "****"


def test_native_route_equals_python(spark):
    rows = [(t, [{"label": k, "text": v} for k, v in o.items()]) for o, t, _, _ in CASES]
    df = spark.createDataFrame(rows, "raw_text string, options array<struct<label:string,text:string>>")
    got = {(r.raw_text, len(r.options), (r.options or [{"text": ""}])[0]["text"] if r.options else ""): (r.status, r.final_choice) for r in parse_replies(df).collect()}
    for options, text, status, choice in CASES:
        assert got[(text, len(options), next(iter(options.values()), ""))] == (status, choice)


def test_null_options_and_clashing_columns(spark):
    df = spark.createDataFrame([("B", None, "x")], "raw_text string, options array<struct<label:string,text:string>>, letter string")
    row = parse_replies(df).first()
    assert row.status == MISSING and row.letter == "x"
    assert parse_replies(df.where(F.lit(False))).count() == 0
