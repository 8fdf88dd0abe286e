"""Metrics over result rows, each one grouped aggregation over a small table of counts.

All letter metrics start from :func:`letter_counts`, one pass over the rows with partial aggregation: a hot
condition is counted on the executors before anything is shuffled. Deviations are population deviations.
Undefined values are null. A metric class registers itself; Python metrics run per group.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.stats import counted_mad_bootstrap, exact_mad_bootstrap, interval_udf
from plumbline.sources.scratch import Scratch

GOLD, ANSWER = "correct_option", "parsed_choice"
#: Metrics that one pass gives, with their columns.
_BUILT_IN = {"accuracy": ["n_total", "n_scored", "n_correct", "accuracy", "accuracy_conditional"], "mad": ["mad"], "recall_rstd": ["rstd"]}
_METRICS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}


def metric(name: str):
    """Register a metric: a function (letter counts, group columns) -> one row for each group."""

    def register(function):
        if name in _METRICS:
            raise ValueError(f"metric given twice: {name}")
        _METRICS[name] = function
        return function

    return register


def letter_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, gold, answer, n) of result rows; such a table is returned as it is, so metrics take either."""
    if {"gold", "answer", "n"} <= set(df.columns) and GOLD not in df.columns:
        return df
    return df.groupBy(*by, F.col(GOLD).alias("gold"), F.col(ANSWER).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@metric("accuracy")
def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_total, n_scored, n_correct, accuracy, accuracy_conditional); without scored rows the conditional one is 0."""
    counts = letter_counts(df, by)
    whole = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    total, scored, correct = whole(F.lit(True)), whole(F.col("answer").isNotNull()), whole(F.col("answer") == F.col("gold"))
    return counts.groupBy(*by).agg(
        total.alias("n_total"),
        scored.alias("n_scored"),
        correct.alias("n_correct"),
        F.coalesce(F.try_divide(correct, total), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(correct, scored), F.lit(0.0)).alias("accuracy_conditional"),
    )


def accuracy_intervals(df: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """:func:`accuracy` plus exact intervals of both shares, computed on the aggregated rows."""
    interval = interval_udf(alpha)
    out = accuracy(df, by).withColumn("__a", interval("n_correct", "n_total")).withColumn("__c", interval("n_correct", "n_scored"))
    return out.select("*", F.col("__a.low").alias("ci_low"), F.col("__a.high").alias("ci_high"), F.col("__c.low").alias("conditional_ci_low"), F.col("__c.high").alias("conditional_ci_high")).drop("__a", "__c")


def _labels(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, label): letters that occur as gold or answer, over all rows."""
    both = counts.select(*by, F.explode(F.array("gold", "answer")).alias("label"))
    return both.where(F.col("label").isNotNull() & (F.col("label") != "")).distinct()


@metric("mad")
def mad(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, mad): mean over letters of the difference of answer and gold share, in percent, over scored rows; null if none is scored."""
    counts = letter_counts(df, by)
    scored = counts.where(F.col("answer").isNotNull())
    sides = scored.select(*by, F.explode(F.array(F.struct(F.col("answer").alias("label"), F.col("n").alias("d")), F.struct(F.col("gold").alias("label"), (-F.col("n")).alias("d")))).alias("s"))
    zero = _labels(counts, by).select(*by, F.struct("label", F.lit(0).cast("long").alias("d")).alias("s"))
    gaps = sides.unionByName(zero).groupBy(*by, F.col("s.label").alias("label")).agg(F.abs(F.sum("s.d")).alias("gap"))
    used = gaps.where(F.col("label").isNotNull() & (F.col("label") != "")).groupBy(*by).agg(F.sum("gap").alias("g"), F.count(F.lit(1)).alias("k"))
    total = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("answer").isNotNull(), F.col("n"))), F.lit(0)).alias("scored"))
    joined = _join(total, used, by)
    return joined.select(*by, F.when(F.col("scored") > 0, 100.0 * F.col("g") / (F.col("scored") * F.col("k"))).alias("mad"))


def _join(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Left join on group columns, nulls equal."""
    if not by:
        return a.crossJoin(b)
    renamed = b.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in b.columns if c not in by])
    on = [a[c].eqNullSafe(renamed[f"__{c}"]) for c in by]
    return a.join(renamed, on, "left").drop(*[f"__{c}" for c in by])


def mad_bootstrap(df: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, mad_std): bootstrap deviation of the MAD from the table of counts, whose size does not follow the rows."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return part[by].head(1).assign(mad_std=counted_mad_bootstrap(part, resamples, seed))

    counts = letter_counts(df, by)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema.fields if f.name in by)
    return counts.groupBy(*by).applyInPandas(one, f"{fields}, mad_std double")


def mad_bootstrap_exact(df: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, mad_std) from the reference random stream over rows in ``ordinal`` order; needs a whole group in one task, for published numbers only."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ordinal")
        answers = [a if isinstance(a, str) else None for a in part[ANSWER]]
        return part[by].head(1).assign(mad_std=exact_mad_bootstrap(list(part[GOLD]), answers, resamples, seed))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by)
    return df.select(*by, "ordinal", GOLD, ANSWER).groupBy(*by).applyInPandas(one, f"{fields}, mad_std double")


def recalls(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, letter, n, recall): recall in percent of each letter over scored gold rows; null where there is none."""
    counts = letter_counts(df, by)
    n = F.coalesce(F.sum(F.when(F.col("answer").isNotNull(), F.col("n"))), F.lit(0))
    right = F.coalesce(F.sum(F.when(F.col("answer") == F.col("gold"), F.col("n"))), F.lit(0))
    as_gold = counts.select(*by, F.col("gold").alias("letter"), "answer", "gold", "n")
    only_answered = _labels(counts, by).select(*by, F.col("label").alias("letter"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("gold"), F.lit(0).cast("long").alias("n"))
    every = as_gold.unionByName(only_answered).where(F.col("letter").isNotNull() & (F.col("letter") != ""))
    return every.groupBy(*by, "letter").agg(n.alias("n"), F.when(n > 0, 100.0 * right / n).alias("recall"))


@metric("recall_rstd")
def recall_rstd(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, rstd): population deviation of the defined recalls; null if none is."""
    return recalls(df, by).groupBy(*by).agg(F.stddev_pop("recall").alias("rstd"))


def recall_wide(df: DataFrame, by: list[str], letters: list[str]) -> DataFrame:
    """Recalls with one column for each of the given letters."""
    return recalls(df, by).groupBy(*by).pivot("letter", letters).agg(F.first("recall").alias("recall"))


def _order(picks: DataFrame, by: list[str], question: str) -> DataFrame:
    """Order sensitivity from (by, question, position, right, canonical)."""
    per_position = picks.groupBy(*by, "position").agg(F.avg(F.col("right").cast("double")).alias("recall"))
    spread = per_position.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 1, F.stddev_pop("recall")).otherwise(F.lit(0.0)).alias("order_rstd"))
    flips = picks.groupBy(*by, question).agg((F.min("canonical") != F.max("canonical")).alias("flip")).groupBy(*by).agg(F.avg(F.col("flip").cast("double")).alias("order_flip_rate"), F.count(F.lit(1)).alias("n_questions"))
    return _join(spread, flips, by)


def order_sensitivity_letters(df: DataFrame, by: list[str], question: str = "question_id", strict_compat: bool = False) -> DataFrame:
    """(by, order_rstd, order_flip_rate, n_questions) from per_rotation_choices (canonical letters in rotation order) and correct_index.

    Under rotation k gold is printed at (correct_index - k) mod n. Null picks are skipped, questions without any pick or gold left out.
    """
    least = 1 if strict_compat else 2
    n = F.size("per_rotation_choices")
    base = df.where(F.col("correct_index").isNotNull() & (n >= least))
    each = base.select(*by, question, "correct_index", n.alias("n"), F.posexplode("per_rotation_choices").alias("k", "pick")).where(F.col("pick").isNotNull())
    canonical = F.ascii("pick") - 65
    return _order(each.select(*by, question, F.pmod(F.col("correct_index") - F.col("k"), F.col("n")).alias("position"), (canonical == F.col("correct_index")).alias("right"), canonical.alias("canonical")), by, question)


def order_sensitivity_matrix(df: DataFrame, by: list[str], question: str = "question_id", strict_compat: bool = False) -> DataFrame:
    """The same from option_distributions: row k is the distribution over printed slots, its first maximum the pick.

    Matrices that are not square are left out; ``strict_compat`` takes single rows as matrices of one rotation.
    """
    m, n = F.col("option_distributions"), F.size("option_distributions")
    good = F.forall(m, lambda r: F.size(r) == n) & (n >= 2)
    base = df.where(F.col("correct_index").isNotNull() & m.isNotNull() & (good | (F.lit(strict_compat) & (n == 1))))
    each = base.select(*by, question, "correct_index", n.alias("n"), F.posexplode(m).alias("k", "row"))
    slot = (F.array_position("row", F.array_max("row")) - 1).cast("int")
    canonical = F.pmod(slot + F.col("k"), F.col("n"))
    return _order(each.select(*by, question, F.pmod(F.col("correct_index") - F.col("k"), F.col("n")).alias("position"), (canonical == F.col("correct_index")).alias("right"), canonical.alias("canonical")), by, question)


def agreement(df: DataFrame, keys: list[str], by: list[str], answer: str = ANSWER) -> DataFrame:
    """(by, n_groups, n_unanimous, n_fully_missing, agreement_rate) over groups of two rows or more; null counts as a value of its own."""
    groups = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"), F.count(answer).alias("answered"), F.min(answer).alias("lo"), F.max(answer).alias("hi")).where(F.col("n") >= 2)
    missing = F.col("answered") == 0
    same = missing | ((F.col("answered") == F.col("n")) & (F.col("lo") == F.col("hi")))
    return groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(same).alias("n_unanimous"), F.count_if(missing).alias("n_fully_missing"), F.try_divide(F.count_if(same), F.count(F.lit(1))).alias("agreement_rate")
    )


def transport_health(df: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """(by, n_total, n_failed, failed_fraction, status): a half or more failed is ``infra_failure``."""
    n, bad = F.count(F.lit(1)), F.count_if(failed)
    return df.groupBy(*by).agg(n.alias("n_total"), bad.alias("n_failed"), (bad / n).alias("failed_fraction"), F.when(bad / n >= 0.5, "infra_failure").otherwise("completed").alias("status"))


def status_report(conditions: DataFrame) -> DataFrame:
    """One row: conditions by status and whether the run is complete (nothing failed, no infrastructure failure)."""
    count = lambda s: F.count_if(F.col("status") == s)
    failed = count("failed") + count("infra_failure")
    return conditions.agg(*[count(s).alias(f"n_{s}") for s in ("pending", "completed", "failed", "gated", "infra_failure")], (failed == 0).alias("complete"))


def letter_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_total, n_scored, n_correct, accuracy, accuracy_conditional, mad, rstd) of all groups in one pass.

    A group's table of letter pairs has at most 27 x 27 entries, so it is gathered and measured in one row.
    """
    where = lambda t, p: F.aggregate(F.filter(t, p), F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def sides(t: Column, label: Column) -> Column:
        answered = lambda x: x["answer"].isNotNull() & (x["gold"] == label)
        return F.struct(where(t, lambda x: x["answer"] == label).alias("pred"), where(t, answered).alias("gold"), where(t, lambda x: answered(x) & (x["answer"] == label)).alias("right"))

    letters = F.array_distinct(F.flatten(F.transform("t", lambda x: F.array(x["gold"], x["answer"]))))
    gathered = letter_counts(df, by).groupBy(*by).agg(F.collect_list(F.struct("gold", "answer", "n")).alias("t"))
    measured = gathered.select(
        *by,
        where(F.col("t"), lambda x: F.lit(True)).alias("n_total"),
        where(F.col("t"), lambda x: x["answer"].isNotNull()).alias("n_scored"),
        where(F.col("t"), lambda x: x["answer"] == x["gold"]).alias("n_correct"),
        F.transform(F.filter(letters, lambda x: x.isNotNull() & (x != "")), lambda x: sides(F.col("t"), x)).alias("s"),
    )
    gap = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.abs(x["pred"] - x["gold"]))
    recall = F.transform(F.filter("s", lambda x: x["gold"] > 0), lambda x: 100.0 * x["right"] / x["gold"])
    mean = lambda r: V.total(r) / F.size(r)
    spread = V.let(recall, lambda r: V.let(mean(r), lambda m: F.sqrt(mean(F.transform(r, lambda x: (x - m) * (x - m))))))
    return measured.select(
        *by,
        "n_total",
        "n_scored",
        "n_correct",
        F.coalesce(F.try_divide("n_correct", "n_total"), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide("n_correct", "n_scored"), F.lit(0.0)).alias("accuracy_conditional"),
        F.when(F.col("n_scored") > 0, 100.0 * gap / (F.col("n_scored") * F.size("s"))).alias("mad"),
        F.when(F.exists("s", lambda x: x["gold"] > 0), spread).alias("rstd"),
    )


def paired(df: DataFrame, question: str, gold: str, first: str, second: str) -> DataFrame:
    """One row: pairs, flips, right to wrong, wrong to right, both wrong but different."""
    a, b, g = F.col(first), F.col(second), F.col(gold)
    ra, rb = F.coalesce(a == g, F.lit(False)), F.coalesce(b == g, F.lit(False))
    different = ~a.eqNullSafe(b)
    return df.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(different).alias("flips"), F.count_if(ra & ~rb).alias("right_to_wrong"), F.count_if(~ra & rb).alias("wrong_to_right"), F.count_if(different & ~ra & ~rb).alias("both_wrong_different")
    )


def counted(df: DataFrame, by: list[str]) -> DataFrame:
    """The letter counts, written once: the rows are read a single time however many metrics follow."""
    return Scratch(df.sparkSession).keep(letter_counts(df, by), "letter-counts")


def evaluate(df: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """All metrics of the names, in name order, one row for each group; a later metric's column replaces an earlier one's."""
    if set(names or _METRICS) <= set(_BUILT_IN):
        kept = [c for n in sorted(names or _METRICS) for c in _BUILT_IN[n]]
        return letter_metrics(df, by).select(*by, *kept)
    counts = counted(df, by)
    out = counts.select(*by).distinct()
    for name in sorted(names or _METRICS):
        part = _METRICS[name](counts, by)
        out = _join(out.drop(*[c for c in part.columns if c not in by]), part, by)
    return out


def regraded(answers: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: answers whose text another label set knows, how many it grades otherwise, and right answers before and after.

    ``answers`` is (key, correct_option, parsed_choice), ``labels`` (key, label); texts must be equal. A text that the labels
    have with several letters grades nothing; null texts meet nothing.
    """
    one = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("label").alias("label"), (F.min("label") == F.max("label")).alias("sure")).where("sure")
    both = answers.select(key, "correct_option", "parsed_choice").join(one.select(key, "label"), key)
    right = lambda gold: F.count_if(F.coalesce(F.col("parsed_choice") == F.col(gold), F.lit(False)))
    return both.agg(F.count(F.lit(1)).alias("n_regraded"), F.count_if(~F.col("label").eqNullSafe(F.col("correct_option"))).alias("n_other_label"), right("correct_option").alias("right_before"), right("label").alias("right_after"))


def python_metric(df: DataFrame, by: list[str], compute: Callable[[pd.DataFrame], dict[str, float]]) -> DataFrame:
    """(by, metric, value) of any Python function over one group's rows."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        values = compute(part)
        return pd.DataFrame([{**{c: part[c].iloc[0] for c in by}, "metric": k, "value": float(v)} for k, v in sorted(values.items())])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by)
    return df.groupBy(*by).applyInPandas(one, f"{fields}, metric string, value double")
