"""Data quality over questions: validation, unsafe options, duplicates, option counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.options import squeeze
from plumbline.functions.text import ws_case_key, ws_key

# Options that refer to other options, as whole-string patterns over the letters A to J, in order.
UNSAFE_PATTERNS = {
    "all_of_the_above": r"^all of the above\.?$",
    "none_of_the_above": r"^none of the above\.?$",
    "both_and": r"^both [A-J] and [A-J]\.?$",
    "letter_and_letter": r"^[A-J] and [A-J]\.?$",
    "letter_list_and_letter": r"^[A-J](, [A-J])+,? and [A-J]\.?$",
    "neither_nor": r"^neither [A-J] nor [A-J]\.?$",
}


def unsafe_pattern(text: Column) -> Column:
    """Name of the first pattern the whole option matches, in any letter case, else null."""
    plain = squeeze(text)
    return F.coalesce(*[F.when(plain.rlike("(?i)" + p), name) for name, p in UNSAFE_PATTERNS.items()])


def permutation_safety(df: DataFrame) -> DataFrame:
    """``df`` plus matched_pattern and offending_option_text: the first unsafe option in order, null for safe rows."""
    hits = F.filter(F.transform("choices", lambda o: F.struct(unsafe_pattern(o["text"]).alias("name"), o["text"].alias("text"))), lambda h: h["name"].isNotNull())
    first = F.get(hits, F.lit(0))
    return df.withColumn("__hit", first).select(*df.columns, F.col("__hit.name").alias("matched_pattern"), F.col("__hit.text").alias("offending_option_text"))


def without_duplicate_ids(df: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows whose id occurs once; every row of a repeated id is dropped.

    Ids are counted with partial aggregation and anti-joined, so a hot id never meets in one task.
    """
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col(key).alias("__key"))
    return df.join(repeated, F.col(key).eqNullSafe(F.col("__key")), "left_anti")


def validation(df: DataFrame) -> DataFrame:
    """One row: rows, null ids, blank ids, rows of repeated ids, null stems; one scan and one aggregation by id."""
    per_id = df.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("question_text").isNull()).alias("null_stems"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per_id.agg(
        n.alias("n_rows"),
        total(F.col("question_id").isNull()).alias("null_ids"),
        total(F.trim("question_id") == "").alias("blank_ids"),
        total(F.col("n") > 1).alias("repeated_rows"),
        F.coalesce(F.sum("null_stems"), F.lit(0)).alias("null_stems"),
    )


def null_options(df: DataFrame) -> DataFrame:
    """Rows with an option that reads ``nan``: gold if it is the gold option, else distractor."""
    is_nan = lambda o: F.lower(squeeze(o["text"])) == "nan"
    gold = F.lower(squeeze(F.get("choices", F.col("correct_index"))["text"])) == "nan"
    return df.where(F.exists("choices", is_nan)).select("question_id", F.when(gold, "gold").otherwise("distractor").alias("kind"))


def choice_counts(df: DataFrame) -> DataFrame:
    """(n_choices, n): histogram of option counts."""
    return df.groupBy("n_choices").agg(F.count(F.lit(1)).alias("n"))


def modal_k(df: DataFrame) -> DataFrame:
    """One row (modal_k, n_modal, n_total, proportion); ties take the lowest k; no rows give nulls and 0."""
    counts = choice_counts(df)
    best = F.max_by(F.struct("n_choices", "n"), F.struct("n", -F.col("n_choices")))
    return counts.agg(best.alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total")).select(F.col("b.n_choices").alias("modal_k"), F.col("b.n").alias("n_modal"), "n_total", F.try_divide("b.n", "n_total").alias("proportion"))


class ModalKGateError(ValueError):
    """Too few questions have the modal number of options."""


def gate_report(df: DataFrame, k: int, threshold: float) -> DataFrame:
    """One row (modal_k, n_total, n_evaluated, n_excluded, proportion, passes); a proportion equal to the threshold passes."""
    total, kept = F.count(F.lit(1)), F.count_if(F.col("n_choices") == k)
    share = F.coalesce(F.try_divide(kept, total), F.lit(0.0))
    return df.agg(F.lit(k).alias("modal_k"), total.alias("n_total"), kept.alias("n_evaluated"), (total - kept).alias("n_excluded"), share.alias("proportion"), (share >= threshold).alias("passes"))


def apply_modal_k_gate(df: DataFrame, k: int, threshold: float = 0.95) -> DataFrame:
    """Rows with ``k`` options; raises where their share is below the threshold."""
    report = gate_report(df, k, threshold).first()
    if not report["passes"]:
        raise ModalKGateError(f"{report['proportion']:.4f} of the questions have {k} options; {threshold} are needed")
    return df.where(F.col("n_choices") == k)


#: The seven keys of the duplicate ladder: columns compared, from loose to strict.
LADDER = {
    "stem": ["stem"],
    "stem_ws": ["stem_ws"],
    "stem_ws_case": ["stem_case"],
    "stem_choices": ["stem", "texts"],
    "stem_choices_ws": ["stem_ws", "texts_ws"],
    "stem_choices_ws_case": ["stem_case", "texts_case"],
    "strict": ["subject", "stem", "texts", "correct_index"],
}


def ladder_keys(df: DataFrame) -> DataFrame:
    """Question rows with the columns of :data:`LADDER`; option texts are compared in order."""
    text = F.transform("choices", lambda o: F.coalesce(o["text"], F.lit("")))
    return df.select(
        "ordinal", "subject", "correct_index", F.col("question_text").alias("stem"), ws_key(F.col("question_text")).alias("stem_ws"), ws_case_key(F.col("question_text")).alias("stem_case"),
        text.alias("texts"), F.transform(text, ws_key).alias("texts_ws"), F.transform(text, ws_case_key).alias("texts_case"),
    )


def dedup_ladder(df: DataFrame) -> DataFrame:
    """(rung, groups, pairs, redundant, rows_in_groups, redundant_pct, rows_pct) of all rungs in one pass.

    Each row gives one 128-bit key per rung; one aggregation counts all rungs.
    """
    keyed = ladder_keys(df)
    rungs = [F.struct(F.lit(name).alias("rung"), F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in columns]).alias("h1"), F.md5(F.to_json(F.struct(*columns))).alias("h2")) for name, columns in LADDER.items()]
    sizes = keyed.select(F.explode(F.array(*rungs)).alias("r")).groupBy("r.rung", "r.h1", "r.h2").agg(F.count(F.lit(1)).alias("s"))
    more = F.col("s") > 1
    total = F.sum("s")
    whole = lambda c: F.coalesce(F.sum(F.when(more, c)), F.lit(0))
    redundant, inside = whole(F.col("s") - 1), whole(F.col("s"))
    return sizes.groupBy("rung").agg(
        F.count_if(more).alias("groups"),
        whole((F.col("s") * (F.col("s") - 1) / 2).cast("long")).alias("pairs"),
        redundant.alias("redundant"),
        inside.alias("rows_in_groups"),
        F.round(redundant * 100.0 / total, 3).alias("redundant_pct"),
        F.round(inside * 100.0 / total, 3).alias("rows_pct"),
    )


def strict_groups(df: DataFrame) -> DataFrame:
    """(first_ordinal, group_size, member_digest, subject, correct_index, stem_preview) of groups alike in all strict columns."""
    keyed = ladder_keys(df)
    return (
        keyed.groupBy(*LADDER["strict"])
        .agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("group_size"), F.max("ordinal").alias("last_ordinal"))
        .where(F.col("group_size") > 1)
        .select("first_ordinal", "last_ordinal", "group_size", "subject", "correct_index", F.substring("stem", 1, 80).alias("stem_preview"))
    )


def strict_group_members(df: DataFrame) -> DataFrame:
    """(first_ordinal, ordinal): membership of the strict groups, one row each, so a hot group is never one array."""
    keyed = ladder_keys(df).withColumn("key", F.md5(F.to_json(F.struct(*LADDER["strict"]))))
    first = keyed.groupBy("key").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key", "first_ordinal")
    return keyed.join(first, "key").select("first_ordinal", "ordinal")


def first_rows(df: DataFrame, key: str = "question_id", order: str = "ordinal") -> DataFrame:
    """One row of each key, the one with the smallest ``order``; partial aggregation keeps hot keys apart."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("__r")).select("__r.*")


def window_duplicates(df: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows numbered within their key, for reports on small selections."""
    return df.withColumn("copy_number", F.row_number().over(Window.partitionBy(key).orderBy("ordinal")))
