"""Evaluation methods as dataflows: questions and a responder in, result rows out.

A responder is a function from prompts to responses (see :mod:`plumbline.sources.responders`). It must be
deterministic for each prompt, as Spark may run a task again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.options import labelled
from plumbline.operators import fanout, matching, quality, voting
from plumbline.operators.plugins import plugin
from plumbline.operators.scoring import answer_status, parsed_and_scored, score
from plumbline.sources import priors
from plumbline.sources.scratch import Scratch

#: (rows with prompt and options) -> the same rows plus status, raw_text, finish_reason, latency_seconds and, for scores, logprobs.
Responder = Callable[[DataFrame], DataFrame]
#: name -> (method, needs option scores, is gated on the modal option count)
METHODS: dict[str, tuple[Callable[..., DataFrame], bool, bool]] = {}


def method(name: str, *, scores: bool = False, gated: bool = False):
    """Register a method with its capability flags."""

    def register(function):
        if name in METHODS:
            raise ValueError(f"method given twice: {name}")
        METHODS[name] = (function, scores, gated)
        return function

    return register


def _asked(questions: DataFrame) -> DataFrame:
    return questions.withColumn("options", labelled(F.col("choices")))


def _final(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("method_name", F.lit(name)).select("*", answer_status(F.col("parsed_choice")))


@method("direct_mcq")
def direct_mcq(questions: DataFrame, respond: Responder, template: str = fanout.TEMPLATES["direct_mcq"], **_) -> DataFrame:
    """One prompt, one reply, parsed against the question's own options."""
    prompted = _asked(questions).withColumn("prompt", fanout.direct_prompt(F.col("options"), template))
    return _final(parsed_and_scored(respond(prompted)), "direct_mcq")


@method("shuffled_baseline")
def shuffled_baseline(questions: DataFrame, respond: Responder, seed: int = 0, template: str = fanout.TEMPLATES["direct_mcq"], **_) -> DataFrame:
    """Option texts shuffled over the letters once; the reply is parsed against what was shown and mapped back."""
    shown = fanout.shuffled(questions, seed).withColumn("options", F.col("shown_options"))
    read = parsed_and_scored(respond(shown.withColumn("prompt", fanout.direct_prompt(F.col("options"), template))))
    mapped = read.withColumn("parsed_choice", F.try_element_at("label_map", "parsed_choice")).drop("is_correct", "score_status")
    return _final(score(mapped), "shuffled_baseline")


def _rotated_votes(rotated: DataFrame, respond: Responder) -> DataFrame:
    read = parsed_and_scored(respond(rotated))
    return read.withColumn("vote", fanout.canonical_letter(F.col("parsed_choice"), F.col("slot_to_canonical")))


def _collapsed(questions: DataFrame, votes: DataFrame, seed: int, benchmark: str, name: str) -> DataFrame:
    """One result for each question from its rotation votes, which are gathered once and written; the trace row is rotation 0.

    ``questions`` have one row for each id, so a question's votes are as few as its options.
    """
    trace = votes.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rotation", "vote"))), lambda x: x["vote"]).alias("per_rotation_choices"),
        F.min_by(F.struct("prompt", "raw_text", "transport_status", "finish_reason"), "rotation").alias("t"),
        F.count(F.lit(1)).alias("n_permutations_total"),
        F.count_if(F.col("transport_status") == "failure").alias("n_permutations_failed"),
    )
    trace = Scratch(questions.sparkSession).keep(trace, "votes")
    won = voting.elected(trace, "per_rotation_choices", F.lit(benchmark), F.col("question_id"), seed, name).withColumnRenamed("winner", "parsed_choice").drop("votes_for", "n_tied")
    joined = questions.join(won, "question_id")
    parsed = joined.select("*", "t.*").drop("t").withColumn("parse_status", F.when(F.col("parsed_choice").isNotNull(), "parse_ok").otherwise("parse_missing")).withColumn("parse_reason", F.lit("majority_vote"))
    return _final(score(parsed), name)


@method("cyclic_permutation")
def cyclic_permutation(questions: DataFrame, respond: Responder, seed: int = 0, benchmark: str = "", template: str = fanout.TEMPLATES["direct_mcq"], **_) -> DataFrame:
    """All n rotations, each parsed against its own map, mapped back by slot and voted; failed and unparsed rotations are null votes."""
    rotated = fanout.rotations(questions).withColumn("options", labelled(F.col("shown"))).withColumn("prompt", fanout.direct_prompt(F.col("options"), template))
    return _collapsed(questions, _rotated_votes(rotated, respond), seed, benchmark, "cyclic_permutation")


@method("two_stage")
def two_stage(questions: DataFrame, respond: Responder, fallback: bool = True, **_) -> DataFrame:
    """Free text without options, then its match to a letter; an unparsed second stage may fall back to the direct prompt.

    Each stage is written before the next one reads it. A failed first stage ends the row; a failed second stage does not fall back.
    """
    asked = _asked(questions)
    first = respond(asked.withColumn("prompt", fanout.free_text_prompt())).withColumnsRenamed({"prompt": "free_text_prompt", "raw_text": "free_text_response", "latency_seconds": "free_text_latency", "status": "free_status"})
    # Whatever else the responder says of the first call would meet the same columns of the next one.
    kept = first.drop(*[c for c in first.columns if c not in asked.columns and not c.startswith("free_")])
    kept = Scratch(questions.sparkSession).keep(kept, "first-stage")
    alive, ended = kept.where(F.col("free_status") != "failure"), kept.where(F.col("free_status") == "failure")
    second = Scratch(questions.sparkSession).keep(parsed_and_scored(respond(alive.withColumn("prompt", fanout.matching_prompt(F.col("options"), F.col("free_text_response"))))), "second-stage")
    unparsed = (F.col("transport_status") != "failure") & F.col("parsed_choice").isNull() & F.lit(fallback)
    done = second.where(~unparsed).withColumn("fallback_used", F.lit(False))
    again = second.where(unparsed).select(*kept.columns)
    direct = parsed_and_scored(respond(again.withColumn("prompt", fanout.direct_prompt(F.col("options"))))).withColumn("fallback_used", F.lit(True))
    answered = done.unionByName(direct, allowMissingColumns=True)
    every = answered.unionByName(ended.withColumn("transport_status", F.lit("failure")).withColumn("fallback_used", F.lit(False)).withColumn("score_status", F.lit("score_unscorable")), allowMissingColumns=True)
    return _final(every.drop("free_status"), "two_stage")


def stage_two_rotations(questions: DataFrame, free_text: DataFrame, respond: Responder, seed: int = 0, benchmark: str = "", **_) -> DataFrame:
    """The second stage over all rotations of a saved free text (question_id, free_text_response), voted."""
    rotated = fanout.rotations(questions.join(free_text, "question_id")).withColumn("options", labelled(F.col("shown")))
    prompted = rotated.withColumn("prompt", fanout.matching_prompt(F.col("options"), F.col("free_text_response")))
    return _collapsed(questions, _rotated_votes(prompted, respond), seed, benchmark, "two_stage_rotations")


def _letters(n):
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.char(i + 65))


@method("direct_logprob", scores=True)
def direct_logprob(questions: DataFrame, respond: Responder, **_) -> DataFrame:
    """One score vector, its label distribution, the first maximum; keeps the distribution as a matrix of one row."""
    asked = respond(_asked(questions).withColumn("prompt", fanout.direct_prompt(F.col("options"))))
    dist = asked.withColumn("__d", V.label_distribution(F.col("logprobs"))).withColumn("option_distributions", F.when(F.col("__d").isNotNull(), F.array("__d")))
    chosen = dist.withColumn("parsed_choice", F.get(F.transform("options", lambda o: o["label"]), V.first_max(F.col("__d"))))
    return _probability_result(chosen.drop("__d"), "direct_logprob", "label_probability")


def _probability_result(df: DataFrame, name: str, reason: str) -> DataFrame:
    named = df.withColumnRenamed("status", "transport_status") if "status" in df.columns else df
    parsed = named.withColumn("parse_status", F.when(F.col("parsed_choice").isNotNull(), "parse_ok").otherwise("parse_missing")).withColumn("parse_reason", F.lit(reason))
    return _final(score(parsed), name)


def rollouts(questions: DataFrame, respond: Responder) -> DataFrame:
    """(question_id, option_distributions, n_permutations_total, n_permutations_failed, first_error): score vectors of all rotations.

    A failed rotation is a uniform row.
    """
    rotated = fanout.rotations(questions).withColumn("options", labelled(F.col("shown")))
    scored = respond(rotated.withColumn("prompt", fanout.direct_prompt(F.col("options"))))
    n = F.size("choices")
    uniform = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(1.0) / n)
    failed = F.coalesce(F.col("status") == "failure", F.lit(False)) | F.col("logprobs").isNull()
    rows = scored.withColumn("__row", F.when(failed, uniform).otherwise(V.label_distribution(F.col("logprobs")))).withColumn("__failed", failed)
    return rows.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rotation", "__row"))), lambda x: x["__row"]).alias("option_distributions"), F.count(F.lit(1)).alias("n_permutations_total"), F.count_if("__failed").alias("n_permutations_failed")
    )


@method("cyclic_logprob", scores=True)
def cyclic_logprob(questions: DataFrame, respond: Responder, **_) -> DataFrame:
    """Score vectors of all rotations, content mass (Eq. 1), first maximum; no answer if every rotation failed."""
    joined = _asked(questions).join(rollouts(questions, respond), "question_id")
    usable = F.col("n_permutations_failed") < F.col("n_permutations_total")
    chosen = joined.withColumn("parsed_choice", F.when(usable, F.get(_letters(F.col("n_choices")), V.first_max(V.content_probabilities(F.col("option_distributions"))))))
    return _probability_result(chosen, "cyclic_logprob", "content_average")


def global_prior(matrices: DataFrame) -> DataFrame:
    """One row (peprior map<letter, double>): mean of the Eq. 7 vectors, clipped and normalised; no rows give null, that is uniform."""
    each = matrices.select(F.posexplode(V.prior_from_rollouts(F.col("option_distributions"))).alias("j", "p")).groupBy("j").agg(F.avg("p").alias("p"))
    whole = each.agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("v"))
    vector = V.normalised(V.clipped(F.transform("v", lambda x: x["p"])))
    return whole.select(F.when(F.size("v") > 0, F.map_from_arrays(F.transform("v", lambda x: F.char(x["j"] + 65)), vector)).alias("peprior"))


@method("pride", scores=True, gated=True)
def pride(questions: DataFrame, respond: Responder, calibration: DataFrame | None = None, threshold: float = 0.95, priors_folder: str | None = None, prior_settings: dict | None = None, **_) -> DataFrame:
    """Calibrate a position prior on ``calibration`` questions by rotations, then one debiased answer for each question (Eq. 8).

    Only questions with the modal number of options are answered (the gate raises below ``threshold``);
    calibration questions with another number are left out; a calibration question whose rotations all fail is
    an error; without calibration questions the prior is uniform. With ``priors_folder`` a prior stored for exactly these
    calibration questions and ``prior_settings`` (see :func:`plumbline.sources.priors.prior_key`) is used without a call,
    and a new one is stored.
    """
    modal = quality.modal_k(questions).first()["modal_k"]
    kept = quality.apply_modal_k_gate(questions, modal, threshold)
    report = quality.gate_report(questions, modal, threshold).first()
    if calibration is not None:
        usable = calibration.where(F.col("n_choices") == modal)

        def fresh() -> DataFrame:
            bad = F.assert_true(F.col("n_permutations_failed") < F.col("n_permutations_total"), "all rotations of a calibration question failed")
            return global_prior(rollouts(usable, respond).where(F.coalesce(bad.isNull(), F.lit(True))))

        if priors_folder is None:
            prior = fresh()
        else:
            stored = priors.load_or_compute(priors_folder, priors.prior_key(usable, n_choices=modal, **(prior_settings or {})), lambda: fresh().first()["peprior"] or {})
            prior = questions.sparkSession.createDataFrame([(stored or None,)], "peprior map<string,double>")
    else:
        prior = questions.sparkSession.createDataFrame([(None,)], "peprior map<string,double>")
    asked = respond(_asked(kept).withColumn("prompt", fanout.direct_prompt(F.col("options")))).crossJoin(F.broadcast(prior))
    labels = _letters(F.col("n_choices"))
    chosen = asked.withColumn("adjusted_choice", V.debiased_choice(F.col("logprobs"), F.col("peprior"), labels)).withColumn("parsed_choice", F.col("adjusted_choice"))
    stamped = chosen.withColumns({"gate_modal_k": F.lit(modal), "gate_n_total": F.lit(report["n_total"]).cast("long"), "gate_n_evaluated": F.lit(report["n_evaluated"]).cast("long"), "gate_n_excluded": F.lit(report["n_excluded"]).cast("long"), "option_logprobs": F.col("logprobs")})
    return _probability_result(stamped, "pride", "debiased_probability")


def from_free_text(results: DataFrame, seed: int = 0, benchmark: str = "") -> DataFrame:
    """Answers derived anew from saved free texts by option matching, without a call; provenance is kept, the trace repeats the answer."""
    staged = matching.match_options(results, "free_text_response", "options", F.lit(benchmark), F.col("question_id"), seed, "derived_match").drop("parsed_choice", "is_correct", "score_status", "parse_status", "parse_reason")
    renamed = staged.withColumnRenamed("matched", "parsed_choice").withColumnRenamed("method_name", "derived_from_method_name")
    traced = renamed.withColumn("per_rotation_choices", F.array_repeat("parsed_choice", F.size("options")))
    return _probability_result(traced.drop("stage", "answer_status"), "derived_match", "option_match")


def resolve_method(name: str) -> tuple[Callable[..., DataFrame], bool, bool]:
    """(function, needs option scores, is gated) of a registered name or of a plugin ``module:function``.

    A plugin takes (questions, respond, **parameters) and may set ``needs_scores`` and ``gated`` on itself.
    """
    if name in METHODS:
        return METHODS[name]
    function = plugin(name)
    return function, bool(getattr(function, "needs_scores", False)), bool(getattr(function, "gated", False))


def run_method(name: str, questions: DataFrame, respond: Responder, supports_scores: bool = True, **params) -> DataFrame:
    """Run a registered method or a plugin; one that needs option scores refuses a responder without them before any work."""
    function, scores, _ = resolve_method(name)
    if scores and not supports_scores:
        raise ValueError(f"{name} needs option scores")
    return function(questions, respond, **params)
