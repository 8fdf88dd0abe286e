"""Fan-out of questions: rotations, seeded shuffles and rendered prompts."""

from __future__ import annotations

import random
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.options import labelled, options_block

_FIELD = re.compile(r"\{(\w+)\}|\{\{|\}\}")

#: Our default templates; a template folder replaces them.
TEMPLATES = {
    "direct_mcq": "Question about {subject}: {question}\n\n{options}\n\nGive the letter of the right option.",
    "free_text": "Question about {subject}: {question}\n\nAnswer in one short phrase.",
    "option_matching": "Question: {question}\nGiven answer: {response}\n\n{options}\n\nGive the letter of the option that says the same.",
    "independent_hypothesis": "Question: {question}\nProposed answer: {hypothesis}\n\nIs it right?",
}


def rotation(choices: Column, k: Column) -> Column:
    """Options as shown under rotation k: display slot j shows canonical option (k + j) mod n."""
    n = F.size(choices)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda j: F.get(choices, F.pmod(j + k, n).cast("int"))))


def rotations(df: DataFrame) -> DataFrame:
    """One row for each question and rotation: rotation, shown choices and slot_to_canonical; questions without options give none."""
    n = F.size("choices")
    fanned = df.where(n > 0).withColumn("rotation", F.explode(F.sequence(F.lit(0), n - 1)))
    slots = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.pmod(j + F.col("rotation"), n).cast("int"))
    return fanned.withColumn("shown", rotation(F.col("choices"), F.col("rotation"))).withColumn("slot_to_canonical", slots)


def canonical_letter(shown_letter: Column, slot_to_canonical: Column) -> Column:
    """The canonical letter behind a letter of the printed order, by slot; null for null or unknown letters."""
    at = F.get(slot_to_canonical, F.ascii(shown_letter) - 65)
    return F.when(shown_letter.isNotNull() & at.isNotNull(), F.char(at + 65))


def shuffle_order(seed: int):
    """Pandas UDF (question_id, n) -> permutation of 0..n-1 by the standard generator seeded with ``seed:question_id``."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def order(question_id: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for q, size in zip(question_id, n):
            numbers = list(range(int(size)))
            random.Random(f"{seed}:{q}").shuffle(numbers)
            out.append(numbers)
        return pd.Series(out)

    return order


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """``df`` plus slot_to_canonical of one seeded shuffle of the labelled options and the shown options."""
    marked = df.withColumn("__o", labelled(F.col("choices")))
    ordered = marked.withColumn("slot_to_canonical", shuffle_order(seed)(F.col("question_id"), F.size("__o")))
    shown = F.zip_with(F.col("__o"), F.col("slot_to_canonical"), lambda o, i: F.struct(o["label"].alias("label"), F.get(F.col("__o"), i)["text"].alias("text"), o["source_index"].alias("source_index")))
    return ordered.withColumn("shown_options", shown).withColumn("label_map", F.map_from_arrays(F.transform("__o", lambda o: o["label"]), F.transform("slot_to_canonical", lambda i: F.get(F.col("__o"), i)["label"]))).drop("__o")


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` fields; split once, so values may hold braces; unknown fields are an error."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m.group(1) is None:
            parts.append(F.lit(m.group(0)[0]))
        elif m.group(1) in fields:
            parts.append(F.coalesce(fields[m.group(1)].cast("string"), F.lit("")))
        else:
            raise KeyError(f"unknown template field {m.group(1)}")
    return F.concat(*parts, F.lit(template[at:]))


def direct_prompt(options: Column, template: str = TEMPLATES["direct_mcq"], question: Column | None = None, subject: Column | None = None) -> Column:
    """Prompt with all options; underscores of the subject become spaces."""
    question = F.col("question_text") if question is None else question
    subject = F.col("subject") if subject is None else subject
    return render(template, {"question": question, "subject": F.translate(F.coalesce(subject, F.lit("")), "_", " "), "options": options_block(options)})


def free_text_prompt(template: str = TEMPLATES["free_text"]) -> Column:
    """Prompt without options."""
    return render(template, {"question": F.col("question_text"), "subject": F.translate(F.coalesce("subject", F.lit("")), "_", " ")})


def matching_prompt(options: Column, response: Column, template: str = TEMPLATES["option_matching"]) -> Column:
    """Prompt that asks which option a free answer means."""
    return render(template, {"question": F.col("question_text"), "response": response, "options": options_block(options)})


def hypothesis_prompts(df: DataFrame, template: str = TEMPLATES["independent_hypothesis"]) -> DataFrame:
    """One prompt for each option, without the others."""
    each = df.withColumn("__o", F.explode(labelled(F.col("choices"))))
    return each.select("question_id", F.col("__o.label").alias("label"), render(template, {"question": F.col("question_text"), "hypothesis": F.col("__o.text")}).alias("prompt"))
