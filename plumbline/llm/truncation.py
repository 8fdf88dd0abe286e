"""Problem 1: replies cut off by limits.

Lengths: for each source (provider and model) a mixture of two log-normals is fitted by maximum likelihood (EM)
in which replies at candidate limits are right-censored with their own posterior. Limits are lengths that many
more replies share than their neighbours. The censoring posterior at a reply's length is the prior of its cut;
away from limits, and where the token budget is used up, the prior is a rate of the source, fitted as well.

Endings: TESTDATA.md settles most of them (what is left open or marked is cut, a finished sentence is whole). The
others are weak evidence: a bare end, a letter or figure in running text, an end that no known question can
explain. Each has a likelihood ratio, and so has the finish reason; both are estimated for the source from its
settled replies and its limits. Log-odds of prior and evidence are added, and a reply is cut where they are
positive: of two replies with the same weak ending the one at a limit may be cut and the other whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, option_texts, table

#: Endings that TESTDATA.md settles, and the log-odds they stand for.
CUT, WHOLE, SETTLED = ("open", "marked"), ("sentence", "markup", "letter", "figure", "option"), 40.0
#: Endings that leave it to the posterior. A "loose" letter or figure stands in running text; "quoted" and
#: "unmatched" are bare ends of replies without a known question, by whether some question has that option text.
WEAK = ("bare", "loose_letter", "loose_figure", "quoted", "unmatched")
ENDINGS = (*CUT, *WHOLE, *WEAK)
REASONS = ("length", "done", "other")
#: A limit is a length with at least this many replies (fewer show nothing) and this many times its neighbours' level.
LIMIT_ROWS, LIMIT_RATIO, NEIGHBOURS = 4, 6.0, 15
#: Of the replies at a limit at least this share doesn't end whole; a fixed phrase is no limit.
LIMIT_UNFINISHED = 0.3
#: Prior of a source's rate of cuts away from limits: mean and weight in replies; the same for used-up token budgets.
RATE_PRIOR, BUDGET_PRIOR = (0.05, 20.0), (0.5, 4.0)
#: Shares of whole replies that quote an option in words no row of the question has, and of quoted options that no
#: known question has; share of cuts that stop where some option text happens to end.
MISQUOTED, UNSEEN, ACCIDENT = 1e-4, 0.05, 0.02
#: Weight, in replies, of the pooled share with which the shares of endings and reasons are smoothed.
SMOOTH = 20.0

_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)[^<>]*?(/?)>")
_PARTIAL_TAG = re.compile(r"</?[A-Za-z]?[^<>\n]*$")
_VOID = {"br", "hr", "img", "p", "li"}
_CUT_MARK = re.compile(r"(?:\[(?:truncated|cut|cut off|\.\.\.|…)\]|�+)$", re.I)
_SENTENCE = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*$")
_LIST_MARK = re.compile(r"(?:\n|^\s*[-*]\s*)\d+[.)]$")
_FIGURE = re.compile(r"\d[%°€$]?$")
_CLOSERS = re.compile(r"[\"'”’»)\]}*_`\s]+$")
_NUMBER = re.compile(r"[\d.,%°€$]+$")
_NAMING = re.compile(r"(?i)(?:^|\n|[.!?:])\W*(?:[A-Z][.)]|(?:[^\W_]+\W+){0,2}[^\W_]+)$")
_DRESS = " \t*_(\"'`[{“«-−+$€"
_LABEL = re.compile(r"^\W*[A-Z][.)]\s+")
_CUE = re.compile(r"(?:^|[.!?]\s+)\W*(?:[^\W_]+\s+)?[^\W_]+:\s+")
_INNER_END = re.compile(r"[.!?]\s")
_WORD = re.compile(r"[^\W_]+")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_OPENERS = set(_PAIRS.values())


def left_open(text: str) -> bool:
    """Whether a tag, bracket, quote, emphasis or code mark that the text opened is still open at its end."""
    if "<" in text:
        stack: list[str] = []
        for close, name, empty in _TAG.findall(text):
            name = name.lower()
            if close:
                if name in stack:
                    while stack.pop() != name:
                        pass
            elif not empty and name not in _VOID:
                stack.append(name)
        if stack:
            return True
        last = text.rfind("<")
        if text.find(">", last) < 0 and _PARTIAL_TAG.match(text, last) and (len(text) == last + 1 or text[last + 1] == "/" or text[last + 1].isalpha()):
            return True
    stack = []
    for c in text:
        if c in _OPENERS:
            stack.append(c)
        elif c in _PAIRS:
            if stack and stack[-1] == _PAIRS[c]:
                stack.pop()
            elif _PAIRS[c] in stack:
                while stack.pop() != _PAIRS[c]:
                    pass
    if stack or text.count('"') % 2:
        return True
    if "`" in text and (text.count("```") % 2 or text.replace("```", "").count("`") % 2):
        return True
    if "*" in text:
        stars = re.sub(r"(?m)^\s*\*\s", "", text)
        if stars.count("**") % 2 or stars.replace("**", "").count("*") % 2:
            return True
    return False


def ending(text: str) -> str:
    """What the end of a reply says: one of CUT, of WHOLE, a loose letter or figure, or bare (only an option text could make it whole)."""
    end = text.rstrip()
    if not end:
        return "bare"
    if _CUT_MARK.search(end):
        return "marked"
    if left_open(end):
        return "open"
    if end.endswith(("…", "...")):
        return "ellipsis"
    if (end[-1] == ">" and _TAG.search(end)) or end[-1] in "}`" or end.endswith("**"):
        return "markup"
    if _LIST_MARK.search(end):
        return "bare"
    if _SENTENCE.search(end):
        return "sentence"
    core = _CLOSERS.sub("", end)
    if _FIGURE.search(end) or (core != end and _FIGURE.search(core)):
        return "figure" if _named(core[: len(core) - len(_NUMBER.search(core)[0])]) else "loose_figure"
    if core and core[-1].isascii() and core[-1].isalpha() and (len(core) == 1 or not (core[-2].isalnum() or core[-2] == "_")):
        before = core[:-1].rstrip(_DRESS)
        if not before or before[-1] in ":>\n=":
            return "letter"
        if core[-1].isupper():
            return "letter" if _named(before) else "loose_letter"
    return "sentence" if core and core != end and _SENTENCE.search(core) else "bare"


def _named(before: str) -> bool:
    """Whether what stands before a last letter or figure gives it as the answer: nothing, a cue, or few words that name it."""
    before = before.rstrip(_DRESS)
    return not before or before[-1] in ":>\n=" or bool(_NAMING.search(before))


def quoted_tail(text: str) -> str | None:
    """Words of the last line where it may be an option text: all of a one-clause reply, or what a short cue introduces."""
    line = _LABEL.sub("", text.rstrip().rpartition("\n")[2])
    cue = _CUE.search(line)
    tail = line[cue.end() :] if cue else line if "\n" not in text.rstrip() and not _INNER_END.search(line) else None
    words = None if tail is None else " ".join(_WORD.findall(tail.lower()))
    return words or None


_ENDING_SCHEMA = "response_id long, provider string, model_name string, question_id string, length long, at_tokens boolean, reason string, ending string, bare_text string, tail string"


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    copied = ("response_id", "provider", "model_name", "question_id")
    for batch in batches:
        texts = batch.column("raw_text").to_pylist()
        kinds = [ending(t) for t in texts]
        open_ends = [k in ("bare", "ellipsis") for k in kinds]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in copied],
                pa.array([len(t) for t in texts], pa.int64()),
                batch.column("at_tokens"),
                batch.column("reason"),
                pa.array(kinds, pa.string()),
                pa.array([t if o else None for t, o in zip(texts, open_ends)], pa.string()),
                pa.array([quoted_tail(t) if o else None for t, o in zip(texts, open_ends)], pa.string()),
            ],
            names=[*copied, "length", "at_tokens", "reason", "ending", "bare_text", "tail"],
        )


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


_ERF = np.frompyfunc(math.erfc, 1, 1)


def _survival(z: np.ndarray) -> np.ndarray:
    return 0.5 * _ERF(np.asarray(z, dtype=float) / math.sqrt(2)).astype(float)


def candidate_limits(lengths: np.ndarray, counts: np.ndarray, unfinished: np.ndarray) -> np.ndarray:
    """Lengths that stand out of their neighbourhood and whose replies often end unfinished."""
    order = np.argsort(lengths)
    lengths, counts, unfinished = lengths[order], counts[order], unfinished[order]
    total = np.concatenate(([0], np.cumsum(counts)))
    low = np.searchsorted(lengths, lengths - NEIGHBOURS)
    high = np.searchsorted(lengths, lengths + NEIGHBOURS, side="right")
    level = (total[high] - total[low] - counts) / (2 * NEIGHBOURS)
    return lengths[(counts >= LIMIT_ROWS) & (counts >= LIMIT_RATIO * np.maximum(level, 1.0)) & (unfinished >= LIMIT_UNFINISHED * counts)]


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two log-normals by EM with right-censoring at ``limits``; returns weights, means, deviations, posterior of each limit.

    A reply at a limit is censored with posterior S(L) / (S(L) + f(L)), f the density of one more unit of length.
    """
    x = np.log(lengths + 1.0)
    at = np.isin(lengths, limits)
    spread = np.average(x, weights=counts)
    mean, dev, weight = np.array([x[x <= spread].mean() if (x <= spread).any() else spread, x[x > spread].mean() if (x > spread).any() else spread]), np.array([1.0, 0.7]), np.array([0.5, 0.5])
    posterior = np.where(at, 0.5, 0.0)
    for _ in range(rounds):
        z = (x[:, None] - mean) / dev
        density = weight * _phi(z) / dev
        survival = weight * np.maximum(_survival(z), 1e-300)
        f = density.sum(axis=1) / (lengths + 1.0)
        posterior = np.where(at, survival.sum(axis=1) / (survival.sum(axis=1) + f + 1e-300), 0.0)
        exact = density / (density.sum(axis=1, keepdims=True) + 1e-300) * (counts * (1 - posterior))[:, None]
        cut = survival / survival.sum(axis=1, keepdims=True) * (counts * posterior)[:, None]
        hazard = _phi(z) / np.maximum(_survival(z), 1e-300)
        first = mean + dev * hazard
        second = mean**2 + dev**2 + dev * (x[:, None] + mean) * hazard
        mass = exact.sum(axis=0) + cut.sum(axis=0) + 1e-9
        mean = ((exact * x[:, None]).sum(axis=0) + (cut * first).sum(axis=0)) / mass
        square = ((exact * x[:, None] ** 2).sum(axis=0) + (cut * second).sum(axis=0)) / mass
        dev = np.sqrt(np.maximum(square - mean**2, 0.01))
        weight = mass / mass.sum()
    return weight, mean, dev, posterior


def fit_evidence(prior: np.ndarray, budget: np.ndarray, endings: np.ndarray, reasons: np.ndarray, counts: np.ndarray, rounds: int = 30) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Rates of cuts away from limits and at used-up budgets, and log likelihood ratios of endings and of reasons, by EM.

    ``prior`` is the censoring posterior of each cell of replies and NaN away from limits; ``budget`` marks cells
    that used up their tokens; ``endings`` and ``reasons`` number ENDINGS and REASONS. Settled endings keep their
    side; the shares of the others are what settled replies and limits leave open.
    """
    cut, whole = np.isin(endings, [ENDINGS.index(e) for e in CUT]), np.isin(endings, [ENDINGS.index(e) for e in WHOLE])
    bare, option, quoted, unmatched = (ENDINGS.index(e) for e in ("bare", "option", "quoted", "unmatched"))
    at_limit, total = ~np.isnan(prior), counts.sum()
    pooled_ending = np.bincount(endings, counts, len(ENDINGS)) / total
    pooled_reason = np.bincount(reasons, counts, len(REASONS)) / total
    rate, spent = RATE_PRIOR[0], BUDGET_PRIOR[0]
    ending_odds, reason_odds = np.zeros(len(ENDINGS)), np.zeros((2, len(REASONS)))
    # Only cuts end bare, but for misquoted options: the start that the definition of a whole reply gives.
    ending_odds[[bare, unmatched]] = 5.0

    def smoothed(values: np.ndarray, weight: np.ndarray, pooled: np.ndarray) -> np.ndarray:
        return (np.bincount(values, weight, len(pooled)) + SMOOTH * pooled + 1e-9) / (weight.sum() + SMOOTH)

    for _ in range(rounds):
        p = np.clip(np.where(at_limit, prior, np.where(budget, spent, rate)), 1e-6, 1 - 1e-6)
        odds = np.log(p / (1 - p)) + ending_odds[endings] + reason_odds[budget.astype(int), reasons]
        r = np.where(cut, 1.0, np.where(whole, 0.0, 1 / (1 + np.exp(-np.clip(odds, -SETTLED, SETTLED)))))
        yes, no = counts * r, counts * (1 - r)
        if (apart := ~at_limit & ~budget).any():
            rate = (yes[apart].sum() + RATE_PRIOR[0] * RATE_PRIOR[1]) / (counts[apart].sum() + RATE_PRIOR[1])
        if (used := ~at_limit & budget).any():
            spent = (yes[used].sum() + BUDGET_PRIOR[0] * BUDGET_PRIOR[1]) / (counts[used].sum() + BUDGET_PRIOR[1])
        by_cut, by_whole = smoothed(endings, yes, pooled_ending), smoothed(endings, no, pooled_ending)
        stops = max(by_cut[bare] + by_cut[unmatched], 1e-3)
        ending_odds = np.log(by_cut / by_whole)
        ending_odds[bare] = math.log(stops / MISQUOTED)
        ending_odds[unmatched] = math.log(stops / (MISQUOTED + UNSEEN * by_whole[option]))
        ending_odds[quoted] = math.log(stops * ACCIDENT / max(by_whole[option], 1e-6))
        # A used-up budget has its own prior, so reasons are only weighed among replies alike in that.
        for i, side in enumerate((~budget, budget)):
            weigh = [smoothed(reasons[side], part[side], pooled_reason) for part in (yes, no)]
            reason_odds[i] = np.log(weigh[0] / weigh[1])
    ending_odds[[ENDINGS.index(e) for e in CUT]], ending_odds[[ENDINGS.index(e) for e in WHOLE]] = SETTLED, -SETTLED
    return rate, spent, ending_odds, reason_odds


_FIT_SCHEMA = "provider string, model_name string, typical_length double, rate double, budget_rate double, limits array<struct<length:long,replies:long,unfinished:long,posterior:double>>, ending_odds array<double>, reason_odds array<double>"


def _fit_source(part: pd.DataFrame) -> pd.DataFrame:
    part = part.assign(unfinished=np.where(part["ending"].isin(WHOLE), 0, part["n"]))
    lengths = part.groupby("length", sort=True)[["n", "unfinished"]].sum()
    at, counts = lengths.index.to_numpy(), lengths["n"].to_numpy().astype(float)
    limits = candidate_limits(at, counts, lengths["unfinished"].to_numpy())
    weight, mean, dev, posterior = fit_censored(at, counts, limits)
    found = {int(l): float(p) for l, p in zip(at, posterior) if l in limits}
    prior = part["length"].map(found).to_numpy(dtype=float)
    rate, spent, ending_odds, reason_odds = fit_evidence(
        prior, part["at_tokens"].to_numpy(dtype=bool), part["ending"].map(ENDINGS.index).to_numpy(), part["reason"].map(REASONS.index).to_numpy(), part["n"].to_numpy().astype(float)
    )
    described = [{"length": l, "replies": int(lengths.at[l, "n"]), "unfinished": int(lengths.at[l, "unfinished"]), "posterior": p} for l, p in found.items()]
    return pd.DataFrame(
        {"provider": [part["provider"].iloc[0]], "model_name": [part["model_name"].iloc[0]], "typical_length": [float(np.exp((weight * mean).sum()))], "rate": [rate], "budget_rate": [spent], "limits": [described], "ending_odds": [ending_odds], "reason_odds": [reason_odds.ravel()]}
    )


def source_fits(replies: DataFrame) -> DataFrame:
    """One row for each source of (provider, model_name, length, at_tokens, reason, ending) replies.

    Its limits with their replies and censoring posteriors, typical length, rates of cuts and log likelihood ratios in
    the order of ENDINGS and of REASONS (within the token budget, then beyond it). Only a source's histogram is ever in one task.
    """
    histogram = replies.groupBy("provider", "model_name", "length", "at_tokens", "reason", "ending").agg(F.count(F.lit(1)).alias("n"))
    return histogram.groupBy("provider", "model_name").applyInPandas(_fit_source, _FIT_SCHEMA)


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def _words(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")


def read_replies(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """(response_id, provider, model_name, length, at_tokens, reason, ending) of every reply, written once.

    Texts go on only where an option text may still make them whole, and questions are reduced to one row each before
    they meet. An option is quoted where its words end the reply; after dots of omission only where its text does.
    """
    scratch = Scratch(responses.sparkSession)
    said = F.lower("finish_reason")
    reason = F.when(said.isin("length", "max_tokens", "limit", "incomplete"), "length").when(said.isin("stop", "eos", "end_turn", "completed"), "done").otherwise("other")
    read = responses.where(F.col("raw_text").isNotNull()).select(
        F.col("response_id").cast("long").alias("response_id"),
        F.coalesce("provider", F.lit("")).alias("provider"),
        F.coalesce("model_name", F.lit("")).alias("model_name"),
        F.col("question_id").cast("string").alias("question_id"),
        F.coalesce(F.col("usage_info.completion_tokens") >= F.col("max_tokens"), F.lit(False)).alias("at_tokens"),
        reason.alias("reason"),
        "raw_text",
    )
    replies = scratch.keep(read.mapInArrow(_endings, _ENDING_SCHEMA), "replies")
    texts = option_texts(F.col("choices_json"))
    options = F.transform(texts, lambda o: F.struct(_plain(o).alias("plain"), _words(o).alias("words")))
    asked = questions.where(F.col("question_id").isNotNull()).select("question_id", options.alias("options"))
    known = asked.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_set("options"))).alias("options"))

    unsure = replies.where(F.col("bare_text").isNotNull()).withColumns({"plain": _plain(F.col("bare_text")), "spoken": F.concat(F.lit(" "), _words(F.col("bare_text")))})

    def quotes(o: Column) -> Column:
        before = F.substr(F.col("plain"), F.length("plain") - F.length(o["plain"]), F.lit(1))
        written = (F.length(o["plain"]) > 0) & F.col("plain").endswith(o["plain"]) & ((F.length("plain") == F.length(o["plain"])) | ~before.rlike(r"[\p{L}\p{N}]"))
        return written | ((F.col("ending") == "bare") & (o["words"] != "") & F.col("spoken").endswith(F.concat(F.lit(" "), o["words"])))

    settled = unsure.join(known, "question_id", "left").withColumn("ending", F.when(F.col("options").isNull(), "unmatched").when(F.exists("options", quotes), "option").otherwise("bare"))
    kept = ["response_id", "provider", "model_name", "length", "at_tokens", "reason", "ending"]
    # Ends without a known question: is what they quote an option text of any question?
    loose = settled.where((F.col("ending") == "unmatched") & F.col("tail").isNotNull())
    tails = loose.select("tail").distinct()
    anywhere = questions.select(F.explode(F.transform(texts, _words)).alias("tail")).join(tails, "tail", "left_semi").distinct().withColumn("elsewhere", F.lit(True))
    seen = settled.join(anywhere, "tail", "left").withColumn("ending", F.when((F.col("ending") == "unmatched") & F.col("elsewhere"), "quoted").otherwise(F.col("ending")))
    return scratch.keep(replies.where(F.col("bare_text").isNull()).select(*kept).unionByName(seen.select(*kept)), "settled")


def judged_replies(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """(response_id, provider, model_name, length, ending, limit_posterior, log_odds, truncated) of every stored reply.

    Rows without text are no replies and are left out, whatever their status; a reply of white space only is
    bare. ``limit_posterior`` is the prior of a cut at the reply's length, ``truncated`` is log_odds > 0. A null or
    unknown question has no option texts, so its bare endings are weaker evidence. Null providers and models form a
    source of their own; repeated rows are judged each.
    """
    return judged(read_replies(responses, questions))


def judged(replies: DataFrame) -> DataFrame:
    """The same from the rows of :func:`read_replies`."""
    # One row for each source.
    joined = replies.join(source_fits(replies), ["provider", "model_name"])
    censored = F.get(F.filter("limits", lambda x: x["length"] == F.col("length")), F.lit(0))["posterior"]
    cut = F.coalesce(censored, F.when(F.col("at_tokens"), F.col("budget_rate")).otherwise(F.col("rate")))
    held = F.least(F.greatest(cut, F.lit(1e-6)), F.lit(1 - 1e-6))
    place = lambda names, name: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(name)).cast("int") - 1
    beyond = F.when(F.col("at_tokens"), F.lit(len(REASONS))).otherwise(F.lit(0))
    odds = F.log(held / (1 - held)) + F.get("ending_odds", place(ENDINGS, "ending")) + F.get("reason_odds", place(REASONS, "reason") + beyond)
    return joined.select("response_id", "provider", "model_name", "length", "ending", cut.alias("limit_posterior"), odds.alias("log_odds")).withColumn("truncated", F.col("log_odds") > 0)


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return judged_replies(table(spark, folder, "model_responses"), table(spark, folder, "toy_normalized"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).where("truncated").select("response_id")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of truncated replies of each provider and model."""
    n = F.count(F.lit(1))
    return _judged(spark, folder).groupBy("provider", "model_name").agg(n.alias("replies"), F.count_if("truncated").alias("truncated"), (F.count_if("truncated") / n).alias("truncated_share"))


def _fits(spark: SparkSession, folder: str) -> DataFrame:
    return source_fits(read_replies(table(spark, folder, "model_responses"), table(spark, folder, "toy_normalized")))


def p1_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Length limits found for each source, with the replies of that length and those that don't end whole."""
    return _fits(spark, folder).select("provider", "model_name", F.explode("limits").alias("l")).select("provider", "model_name", F.col("l.length").alias("limit_length"), F.col("l.replies").alias("n_replies"), F.col("l.unfinished").alias("n_unfinished"))


def p1_posteriors(spark: SparkSession, folder: str) -> DataFrame:
    """What was fitted for each source: censoring posterior of each limit (null without one), rates of cuts, typical length."""
    each = _fits(spark, folder).select("provider", "model_name", "typical_length", "rate", "budget_rate", F.explode_outer("limits").alias("l"))
    return each.select("provider", "model_name", "typical_length", "rate", "budget_rate", F.col("l.length").alias("limit_length"), F.col("l.posterior").alias("limit_posterior"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_limits": p1_limits, "p1_posteriors": p1_posteriors}


def _found_sql() -> str:
    """The cases of TESTDATA.md by endings. On the test tables the posterior agrees: their weak endings are rare or lie where cuts are common."""
    space = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    closers = r"""["'”’»)\]}*_`\s]*$"""
    count = lambda mark, text="e": f"((length({text}) - length(replace({text}, '{mark}', ''))) // {len(mark)})"
    odd = [f"{count(m)} % 2 = 1" for m in ('"', "```", "**")] + [count("`", "replace(e, '```', '')") + " % 2 = 1", count("*", "replace(e, '**', '')") + " % 2 = 1"]
    more = [f"{count(o)} > {count(c)}" for o, c in (("{", "}"), ("[", "]"), ("“", "”"), ("«", "»"))]
    tags = [r"regexp_matches(e, '<(/?[A-Za-z][^<>\n]*|/)?$')", "len(regexp_extract_all(e, '<[A-Za-z][^<>]*>')) > len(regexp_extract_all(e, '</[A-Za-z][^<>]*>'))"]
    opened = " OR ".join([*odd, *more, *tags, r"regexp_matches(e, '\([^()]*$')"])
    quoted = closers.replace("'", "''")
    letter = r"(^|[^\p{L}\p{N}_])[A-H]" + quoted
    cued = r"(^|[:>\n=])[ \t*_(\"''`\[{“«]*[A-Za-z]" + quoted
    whole = " OR ".join(
        [r"regexp_matches(e, '(>|\}|`|\*\*)$')", r"(regexp_matches(e, '[.!?][\"''”’»)\]*_`]*$') AND NOT regexp_matches(e, '\n\d+\.$'))", r"regexp_matches(e, '\d[%°€$]?[\"''”’»)\]}*_`\s]*$')", f"regexp_matches(e, '{letter}')", f"regexp_matches(e, '{cued}')"]
    )
    plain = f"lower(trim(regexp_replace({{0}}, '{space}', ' ', 'g')))"
    words = "array_to_string(regexp_extract_all(lower({0}), '[\\p{L}\\p{N}]+'), ' ')"
    return f"""
WITH r AS (SELECT response_id, question_id, provider, model_name, raw_text, regexp_replace(raw_text, '[\\s\\x{{a0}}]+$', '') AS e FROM model_responses WHERE raw_text IS NOT NULL),
k AS (SELECT *, ({opened}) AS is_open, regexp_matches(e, '(?i)(\\[(truncated|cut|cut off|\\.\\.\\.|…)\\]|�)$') AS marked, e = '' OR regexp_matches(e, '(…|\\.\\.\\.)$') AS unended, ({whole}) AS ends FROM r),
o AS (SELECT DISTINCT question_id, {plain.replace("{0}", "x")} AS t, {words.replace("{0}", "x")} AS v FROM (SELECT question_id, unnest(json_extract_string(choices_json, '$[*].text')) AS x FROM toy_normalized WHERE question_id IS NOT NULL)),
b AS (SELECT *, {plain.replace("{0}", "raw_text")} AS p, ' ' || {words.replace("{0}", "raw_text")} AS u FROM k),
m AS (SELECT DISTINCT b.response_id FROM b JOIN o USING (question_id) WHERE (t <> '' AND ends_with(p, t) AND (length(p) = length(t) OR NOT regexp_matches(substr(p, length(p) - length(t), 1), '[\\p{{L}}\\p{{N}}]'))) OR (NOT unended AND v <> '' AND ends_with(u, ' ' || v)))
SELECT response_id, provider, model_name, marked OR is_open OR ((unended OR NOT ends) AND response_id NOT IN (SELECT response_id FROM m)) AS cut FROM b"""


_CASES = f"WITH c AS ({_found_sql()})"
ORACLE_SQL = {
    "p1_found": f"{_CASES} SELECT response_id FROM c WHERE cut",
    "p1_rates": f"{_CASES} SELECT coalesce(provider, '') AS provider, coalesce(model_name, '') AS model_name, count(*) AS replies, count(*) FILTER (cut) AS truncated, count(*) FILTER (cut) / count(*) AS truncated_share FROM c GROUP BY ALL",
    "p1_limits": f"""{_CASES}, n AS (SELECT coalesce(c.provider, '') AS provider, coalesce(c.model_name, '') AS model_name, length(raw_text) AS limit_length, count(*) AS n_replies, count(*) FILTER (cut) AS n_unfinished FROM c JOIN model_responses USING (response_id) GROUP BY ALL),
l AS (SELECT *, (sum(n_replies) OVER (PARTITION BY provider, model_name ORDER BY limit_length RANGE BETWEEN {NEIGHBOURS} PRECEDING AND {NEIGHBOURS} FOLLOWING) - n_replies) / {2 * NEIGHBOURS}.0 AS level FROM n)
SELECT provider, model_name, limit_length, n_replies, n_unfinished FROM l WHERE n_replies >= {LIMIT_ROWS} AND n_replies >= {LIMIT_RATIO} * greatest(level, 1) AND n_unfinished >= {LIMIT_UNFINISHED} * n_replies""",
}
