"""Small text functions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def ws_key(text: Column) -> Column:
    """Text with white space of any kind collapsed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ws_case_key(text: Column) -> Column:
    """The same in lower case."""
    return F.lower(ws_key(text))


def slug(text: Column) -> Column:
    """Lower-case path part: runs of anything but letters, digits, points and underscores become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._]+", "-"), r"^-+|-+$", "")


def valid_run_id(text: Column) -> Column:
    """Whether a text can name a run."""
    return text.rlike(RUN_ID)


def finish_reason(status: Column, incomplete_reason: Column) -> Column:
    """Finish reason of a response object: incomplete for lack of output tokens is ``length``, otherwise its own reason or status; completed is ``stop``."""
    return (
        F.when((status == "incomplete") & (incomplete_reason == "max_output_tokens"), "length")
        .when(status == "incomplete", F.coalesce(incomplete_reason, status))
        .when(status == "completed", "stop")
        .otherwise(status)
    )


def json_safe(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
