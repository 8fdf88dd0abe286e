"""What the training-data operators share: word rules, scratch tables, seeded uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.sources.scratch import Scratch
from plumbline.sources.tables import table

__all__ = ["FIELD_SEP", "Scratch", "option_texts", "seeded_uniform", "table"]

#: Separates the fields of a composed key; no canonical text can hold it.
FIELD_SEP = "\u001f"


def option_texts(choices_json: Column) -> Column:
    """Option texts of a JSON list of objects, in list order, whatever their field order or escapes.

    A null entry or text is an empty string; JSON that cannot be read counts as one option holding
    the raw string; a null column gives an empty array.
    """
    parsed = F.transform(F.from_json(choices_json, "array<struct<text:string>>"), lambda o: F.coalesce(o["text"], F.lit("")))
    raw = F.when(choices_json.isNull(), F.array().cast("array<string>")).otherwise(F.array(choices_json))
    return F.coalesce(parsed, raw)


def seeded_uniform(*parts: Column | str, seed: int, counter: int = 0) -> Column:
    """Counter-based uniform in [0, 1): the first 52 bits of SHA-256 over seed, counter and key.

    A pure function of its inputs, so it is the same in every run, layout and engine.
    """
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(str(counter)), *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
