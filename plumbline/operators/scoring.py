"""Scoring of parsed answers and assembly of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.parsing import OK, parse_replies
from plumbline.schemas import RESULTS_DDL

CORRECT, INCORRECT, UNSCORABLE = "score_correct", "score_incorrect", "score_unscorable"
#: Reasons of answers that no parser made; such rows are never parsed again.
DERIVED_REASONS = ("majority_vote", "debiased_probability", "content_average")


def scored(status: Column, choice: Column, gold: Column) -> tuple[Column, Column]:
    """(is_correct, score_status): anything but a parsed answer is unscorable and neither right nor wrong."""
    ok = (status == OK) & choice.isNotNull()
    right = F.coalesce(choice == gold, F.lit(False))
    return F.when(ok, right).alias("is_correct"), F.when(~F.coalesce(ok, F.lit(False)), UNSCORABLE).when(right, CORRECT).otherwise(INCORRECT).alias("score_status")


def score(df: DataFrame, status: str = "parse_status", choice: str = "parsed_choice", gold: str = "correct_option") -> DataFrame:
    """``df`` plus is_correct and score_status."""
    return df.select("*", *scored(F.col(status), F.col(choice), F.col(gold)))


def parsed_and_scored(df: DataFrame, raw_text: str = "raw_text", options: str = "options") -> DataFrame:
    """``df`` plus parsed_choice, parse_status, normalized_text, parse_reason, is_correct and score_status; failed calls have no parse."""
    failed = F.coalesce(F.col("status") == "failure", F.lit(False)) if "status" in df.columns else F.lit(False)
    renamed = df.withColumnRenamed("status", "transport_status") if "status" in df.columns else df
    read = parse_replies(renamed.withColumn("__bad", failed) if "status" not in df.columns else renamed.withColumn("__bad", F.coalesce(F.col("transport_status") == "failure", F.lit(False))), raw_text, options)
    named = read.withColumnsRenamed({"final_choice": "parsed_choice", "status": "parse_status", "reason": "parse_reason"})
    for c in ("parsed_choice", "parse_status", "normalized_text", "parse_reason"):
        named = named.withColumn(c, F.when(~F.col("__bad"), F.col(c)))
    return score(named.drop("__bad"))


def answer_status(choice: Column) -> Column:
    """success iff a final choice exists."""
    return F.when(choice.isNotNull(), "success").otherwise("failure").alias("answer_status")


def reparse(results: DataFrame, options: str = "options") -> DataFrame:
    """Results with direct single-call answers parsed again from their stored text; all other rows stay as they are."""
    eligible = (
        (F.col("method_name") == "direct_mcq") & ~F.coalesce(F.col("parse_reason").isin(*DERIVED_REASONS), F.lit(False)) & ~F.coalesce(F.col("transport_status") == "failure", F.lit(False))
    )
    replaced = ["parsed_choice", "parse_status", "normalized_text", "parse_reason", "is_correct", "score_status"]
    again = parsed_and_scored(results.where(eligible).drop(*replaced), options=options)
    return results.where(~eligible).unionByName(again.select(*results.columns))


def stamped(df: DataFrame, condition: dict[str, str], **trace: object) -> DataFrame:
    """Result rows with the identity columns of their condition and the constant trace columns of the run."""
    return df.withColumns({k: F.lit(v) for k, v in {**condition, **trace}.items()})


def assembled(df: DataFrame) -> DataFrame:
    """Rows in the wide result schema: columns of other methods are null, columns outside the schema are dropped.

    answer_status is success exactly where a final choice exists; transport_status is null where no call was made.
    """
    wide = df.sparkSession.createDataFrame([], RESULTS_DDL).schema
    cells = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wide]
    out = df.select(*cells)
    return out.withColumn("answer_status", answer_status(F.col("parsed_choice")))


def stamped_by_table(df: DataFrame, conditions: DataFrame) -> DataFrame:
    """The same for many conditions at once: a join with the condition table, one row for each condition."""
    return df.join(conditions, [c for c in ("benchmark_name", "method_name", "model_name") if c in df.columns and c in conditions.columns])
