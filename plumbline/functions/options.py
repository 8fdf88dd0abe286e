"""Option lists as native arrays: normalisation, labels, maps, gold letters and the printed block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels come from positions, A to Z.
MOST_OPTIONS = 26


def squeeze(text: Column) -> Column:
    """Trim and collapse white space of any kind to single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", " "))


def letter(index: Column) -> Column:
    """The label of a 0-based position; null outside 0 to 25."""
    return F.when((index >= 0) & (index < MOST_OPTIONS), F.char(index + 65))


def letters(n: Column) -> Column:
    """Labels of ``n`` options; null unless 1 to 26."""
    return F.when((n >= 1) & (n <= MOST_OPTIONS), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: F.char(i + 65)))


def parse_choices(choices_json: Column) -> Column:
    """JSON list of objects to array<struct<text, source_index>>; a missing source_index is the position, bad JSON is null."""
    raw = F.from_json(choices_json, "array<struct<text:string,source_index:int>>")
    return F.transform(raw, lambda o, i: F.struct(o["text"].alias("text"), F.coalesce(o["source_index"], i).alias("source_index")))


def build_choices(texts: Column) -> Column:
    """Array of texts to choices whose source indexes are the positions."""
    return F.transform(texts, lambda t, i: F.struct(t.alias("text"), i.cast("int").alias("source_index")))


def labelled(choices: Column) -> Column:
    """array<struct<label, text, source_index>>: labels by position, then options with empty text dropped, so labels keep gaps."""
    every = F.transform(choices, lambda o, i: F.struct(F.char(i + 65).alias("label"), squeeze(o["text"]).alias("text"), o["source_index"].alias("source_index")))
    return F.filter(every, lambda o: o["text"] != "")


def option_map(options: Column) -> Column:
    """label -> text of labelled options."""
    return F.map_from_arrays(F.transform(options, lambda o: o["label"]), F.transform(options, lambda o: o["text"]))


def source_map(options: Column) -> Column:
    """label -> source index of labelled options."""
    return F.map_from_arrays(F.transform(options, lambda o: o["label"]), F.transform(options, lambda o: o["source_index"]))


def gold_letter(correct_option: Column, correct_index: Column) -> Column:
    """The stored letter, trimmed and in upper case, else the letter of the index, else empty."""
    return F.coalesce(F.nullif(F.upper(squeeze(correct_option)), F.lit("")), letter(correct_index), F.lit(""))


def options_problem(options: Column, gold: Column) -> Column:
    """Why labelled options cannot be asked (fewer than two, or gold not among them), else null."""
    return F.when(F.size(options) < 2, "fewer than two options").when(~F.exists(options, lambda o: o["label"] == gold), "gold not among the options")


def options_block(options: Column) -> Column:
    """One line for each option, in label order: ``A. text``."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "\n")


def question_id(subject: Column, question_text: Column, texts: Column) -> Column:
    """First 16 hex digits of SHA-256 over subject, stem and option texts joined by a bar; nulls count as empty."""
    none = F.lit("")
    parts = F.concat(F.array(F.coalesce(subject, none), F.coalesce(question_text, none)), F.transform(texts, lambda t: F.coalesce(t, none)))
    return F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 16)
