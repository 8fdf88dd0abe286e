"""Raw benchmark rows of five shapes to one question schema, as native projections in a registry.

A row that cannot be normalised is an error (fail closed) unless ``problems`` asks for the reasons instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import options as O

Normaliser = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[tuple[str, str | None], Normaliser] = {}


def benchmark(path: str, subset: str | None = None) -> Callable[[Normaliser], Normaliser]:
    """Register a normaliser for a dataset path and subset; a second one for the same is an error."""

    def register(function: Normaliser) -> Normaliser:
        if (path, subset) in _REGISTRY:
            raise ValueError(f"normaliser given twice: {path} {subset}")
        _REGISTRY[path, subset] = function
        return function

    return register


def normaliser(path: str, subset: str | None = None) -> Normaliser:
    """The registered normaliser of a dataset; unknown ones are an error."""
    found = _REGISTRY.get((path, subset)) or _REGISTRY.get((path, None))
    if found is None:
        raise KeyError(f"no normaliser for {path} {subset}")
    return found


def _row(subject: Column, question: Column, texts: Column, index: Column, problem: Column | None = None) -> list[Column]:
    wrong = F.when(F.coalesce(F.size(texts), F.lit(0)) < 1, "no options").when(index.isNull() | (index < 0) | (index >= F.size(texts)), "gold index out of range")
    return [
        O.question_id(subject, question, texts).alias("question_id"),
        subject.alias("subject"),
        question.alias("question_text"),
        O.build_choices(texts).alias("choices"),
        index.cast("int").alias("correct_index"),
        O.letter(index).alias("correct_option"),
        F.get(texts, index.cast("int")).alias("correct_answer_text"),
        F.size(texts).alias("n_choices"),
        (wrong if problem is None else F.coalesce(problem, wrong)).alias("__problem"),
    ]


def _checked(df: DataFrame, columns: list[Column]) -> DataFrame:
    out = df.select(*columns)
    return out.where(F.coalesce(F.assert_true(F.col("__problem").isNull(), F.col("__problem")).isNull(), F.lit(True))).drop("__problem")


def build(df: DataFrame, subject: Column, question: Column, texts: Column, index: Column, problem: Column | None = None, *, problems: bool = False) -> DataFrame:
    """Questions from expressions over ``df``; with ``problems`` bad rows stay, with their reason, and nothing is raised."""
    columns = _row(subject, question, texts, index, problem)
    return df.select(*columns).withColumnRenamed("__problem", "problem") if problems else _checked(df, columns)


def literal_list(text: Column) -> Column:
    """A list literal of quoted strings, single or double, as array<string>; null if it is none."""
    quoted = F.from_json(text, "array<string>")
    repaired = F.from_json(F.regexp_replace(F.regexp_replace(text, r"\"", "\\\\\""), r"(?<=[\[,]\s?)'|'(?=\s*[,\]])", "\""), "array<string>")
    return F.coalesce(quoted, repaired)


@benchmark("cais/mmlu")
def mmlu(df: DataFrame, **kw) -> DataFrame:
    """subject, question, choices (array or list literal, exactly four), answer."""
    texts = literal_list(F.col("choices")) if dict(df.dtypes)["choices"] == "string" else F.col("choices")
    return build(df, F.col("subject"), F.col("question"), texts, F.col("answer"), F.when(F.coalesce(F.size(texts), F.lit(0)) != 4, "not four options"), **kw)


@benchmark("allenai/ai2_arc")
def arc(df: DataFrame, subject: str = "science", **kw) -> DataFrame:
    """question, choices struct of labels and texts, answerKey; labels 1 to 5 count as A to E; gold is the first match."""
    name = lambda x: F.translate(F.upper(F.trim(x)), "12345", "ABCDE")
    at = F.array_position(F.transform(F.col("choices.label"), name), name(F.col("answerKey"))) - 1
    return build(df, F.lit(subject), F.col("question"), F.col("choices.text"), at, F.when(F.coalesce(at, F.lit(-1)) < 0, "answer key not among the labels"), **kw)


@benchmark("TIGER-Lab/MMLU-Pro")
def mmlu_pro(df: DataFrame, **kw) -> DataFrame:
    """category, question, options with nulls, answer_index; nulls are dropped and gold moves by the nulls before it."""
    kept = F.filter("options", lambda x: x.isNotNull())
    before = F.size(F.filter(F.slice("options", F.lit(1), F.greatest(F.col("answer_index"), F.lit(0))), lambda x: x.isNotNull()))
    gold = F.get("options", F.col("answer_index"))
    outside = (F.col("answer_index") < 0) | (F.col("answer_index") >= F.size("options"))
    return build(df, F.col("category"), F.col("question"), kept, F.when(outside, F.lit(-1)).when(F.col("answer_index").isNotNull(), before), F.when(~outside & gold.isNull(), "gold option is null"), **kw)


@benchmark("Rowan/hellaswag")
def hellaswag(df: DataFrame, **kw) -> DataFrame:
    """activity_label, ctx, four endings, label."""
    return build(df, F.col("activity_label"), F.col("ctx"), F.col("endings"), F.col("label").cast("int"), F.when(F.coalesce(F.size("endings"), F.lit(0)) != 4, "not four endings"), **kw)


@benchmark("truthfulqa/truthful_qa", "multiple_choice")
def truthful_qa(df: DataFrame, subject: str = "truthfulness", **kw) -> DataFrame:
    """question, mc1_targets struct of choices and labels; gold is the first label 1."""
    at = F.array_position(F.col("mc1_targets.labels"), F.lit(1)) - 1
    return build(df, F.lit(subject), F.col("question"), F.col("mc1_targets.choices"), at, F.when(F.coalesce(at, F.lit(-1)) < 0, "no option is marked"), **kw)


def from_table(df: DataFrame) -> DataFrame:
    """Delivered normalised rows (with choices_json) in the native schema; every row is kept."""
    choices = O.parse_choices(F.col("choices_json"))
    return df.select(
        "ordinal", "question_id", "subject", "question_text", choices.alias("choices"), "correct_index", O.gold_letter(F.col("correct_option"), F.col("correct_index")).alias("correct_option"), "correct_answer_text", "n_choices"
    )
