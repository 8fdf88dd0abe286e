"""Queries of normalisation, quality, selection, fan-out, parsing, matching, methods and run control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import identity, options, text
from plumbline.operators import fanout, matching, methods, metrics, normalize, quality, selection
from plumbline.operators.scoring import parsed_and_scored, stamped_by_table
from plumbline.plans import lenses, runs
from plumbline.sources import responders
from plumbline.sources.artifacts import identity_problems, membership_problems
from plumbline.sources.scratch import Scratch
from plumbline.sources.tables import table
from plumbline.streaming import results_stream

SUBJECTS = ["wave_mechanics", "contract_law", "tonal_harmony"]
#: Least share of questions with the modal number of options; 0.78 to 0.81 of the test tables have it.
PRIDE_THRESHOLD = 0.75


def _digest(array) -> F.Column:
    return F.array_join(F.transform(array, lambda o: F.concat_ws(":", o["label"], o["text"], o["source_index"].cast("string"))), "|")


def normalize_questions(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "eval_items")
    out = normalize.build(t, F.col("subject"), F.col("question"), F.col("choices"), F.col("answer"), problems=True)
    return out.select("question_id", "subject", "question_text", F.array_join(F.transform("choices", lambda o: o["text"]), "|").alias("options"), F.col("correct_index").cast("string").alias("correct_index"), "correct_option", "correct_answer_text", "n_choices", "problem")


def option_maps(spark: SparkSession, folder: str) -> DataFrame:
    q = lenses.questions(spark, folder)
    o = options.labelled(F.col("choices"))
    return q.select("ordinal", _digest(o).alias("options"), options.options_problem(o, F.col("correct_option")).alias("problem"))


def gold_letters(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "toy_normalized")
    return t.select("ordinal", options.gold_letter(F.col("correct_option"), F.col("correct_index")).alias("gold"), options.gold_letter(F.lit(None), F.col("correct_index")).alias("gold_of_index"))


def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.validation(lenses.questions(spark, folder))


def duplicate_id_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quality.without_duplicate_ids(lenses.questions(spark, folder)).select("ordinal", "question_id")


def null_option_scan(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_options(lenses.questions(spark, folder))


def permutation_filter(spark: SparkSession, folder: str) -> DataFrame:
    both = lenses.questions(spark, folder).select("question_id", "ordinal", "choices").unionByName(lenses.eval_questions(spark, folder).select("question_id", "ordinal", "choices"))
    marked = quality.permutation_safety(both).where(F.col("matched_pattern").isNotNull())
    return marked.select("question_id", "ordinal", "matched_pattern", "offending_option_text")


def choice_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.choice_counts(lenses.questions(spark, folder))


def modal_choice_count(spark: SparkSession, folder: str) -> DataFrame:
    return quality.modal_k(lenses.questions(spark, folder)).withColumn("proportion", F.round("proportion", 6))


def modal_k_gate(spark: SparkSession, folder: str) -> DataFrame:
    return quality.gate_report(lenses.questions(spark, folder), 4, 0.95).withColumn("proportion", F.round("proportion", 6))


def dedup_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return quality.dedup_ladder(lenses.questions(spark, folder))


def strict_groups(spark: SparkSession, folder: str) -> DataFrame:
    return quality.strict_groups(lenses.questions(spark, folder))


def strict_group_members(spark: SparkSession, folder: str) -> DataFrame:
    return quality.strict_group_members(lenses.questions(spark, folder))


def semantic_identities(spark: SparkSession, folder: str) -> DataFrame:
    q = lenses.questions(spark, folder)
    return q.select("ordinal", identity.semantic_identity(F.col("question_text"), F.transform("choices", lambda o: o["text"])).alias("identity"))


def subject_filter(spark: SparkSession, folder: str) -> DataFrame:
    return selection.subject_filter(table(spark, folder, "toy_normalized").select("ordinal", "subject"), SUBJECTS)


def group_sample(spark: SparkSession, folder: str) -> DataFrame:
    return selection.group_sample(table(spark, folder, "eval_items").select("item_id", "benchmark_name"), "benchmark_name", 25, 42, key="item_id")


def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return selection.hash_sample(table(spark, folder, "toy_normalized").select("ordinal", "question_id"), 150, 42)


def id_list_selection(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "agreement_input").select("question_id")
    known = table(spark, folder, "toy_normalized").select("ordinal", "question_id")
    return selection.id_list(known, listed.join(known, "question_id", "left_semi"))


def id_list_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of the responses that the dataset lacks: what makes their list an error."""
    listed = table(spark, folder, "model_responses").select("question_id").where(F.col("question_id").isNotNull())
    return selection.missing_ids(table(spark, folder, "toy_normalized"), listed)


def calibration_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    pool = table(spark, folder, "toy_normalized").select("ordinal", "question_id")
    return selection.remaining(pool, table(spark, folder, "agreement_input"))


def leakage_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of toy_normalized whose stem is that of a held-out question."""
    key = text.ws_case_key(F.col("question_text")).alias("key")
    calibration = lenses.questions(spark, folder).select("ordinal", "subject", key)
    return selection.overlap(calibration, lenses.eval_questions(spark, folder).select(key), "key").select("ordinal", "subject")


def leakage_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of toy_normalized whose stem and options, in any order and form, are those of a held-out question (OP-J5)."""
    key = identity.semantic_identity(F.col("question_text"), F.transform("choices", lambda o: o["text"])).alias("key")
    calibration = lenses.questions(spark, folder).select("ordinal", "subject", key)
    return selection.overlap(calibration, lenses.eval_questions(spark, folder).select(key), "key").select("ordinal", "subject")


def chunk_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return selection.chunks(table(spark, folder, "toy_normalized").select("ordinal"), 128)


def rotations_fanout(spark: SparkSession, folder: str) -> DataFrame:
    r = fanout.rotations(lenses.questions(spark, folder))
    return r.select("ordinal", "rotation", F.array_join(F.transform("shown", lambda o: o["text"]), "|").alias("shown"), F.array_join("slot_to_canonical", ",").alias("slots"))


def render_prompts(spark: SparkSession, folder: str) -> DataFrame:
    q = lenses.questions(spark, folder)
    return q.select("ordinal", fanout.direct_prompt(options.labelled(F.col("choices"))).alias("prompt"), fanout.free_text_prompt().alias("free_prompt"))


def seeded_shuffles(spark: SparkSession, folder: str) -> DataFrame:
    return fanout.shuffled(quality.first_rows(lenses.questions(spark, folder)), 42).select("question_id", F.array_join("slot_to_canonical", ",").alias("slots"))


def parse_replies(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_and_scored(lenses.replies(spark, folder)).select("response_id", "provider", "model_name", "parsed_choice", "parse_status", "correct_option", "is_correct", "score_status")


def parse_summary(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    return parsed_and_scored(lenses.replies(spark, folder)).groupBy("provider", "model_name", "parse_status", "score_status").agg(n)


def single_letter_replies(spark: SparkSession, folder: str) -> DataFrame:
    from plumbline.functions.parsing import single_letter

    r = lenses.replies(spark, folder)
    letter = single_letter(F.col("raw_text"), F.transform("options", lambda o: o["label"]))
    return r.select("response_id", letter.alias("letter")).where(F.col("letter").isNotNull())


def text_match(spark: SparkSession, folder: str) -> DataFrame:
    staged = matching.matched(lenses.replies(spark, folder), "raw_text", "options")
    return staged.select("response_id", "stage", F.array_join("tied", ",").alias("tied"))


def finish_reasons(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "model_responses")
    status = F.when(F.lower("finish_reason").isin("length", "max_tokens", "limit"), "incomplete").when(F.lower("finish_reason").isin("stop", "eos", "end_turn"), "completed").otherwise(F.col("finish_reason"))
    reason = text.finish_reason(status, F.when(F.lower("finish_reason").isin("length", "max_tokens"), "max_output_tokens"))
    return t.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def request_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "model_responses")
    key = identity.cache_key(F.col("provider"), F.col("model_name"), F.col("request_id"), F.lit(None).cast("double"), F.col("max_tokens"), F.lit(None).cast("int"))
    keyed = t.withColumn("cache_key", key)
    return responders.cache_misses(keyed, responders.cache_rows(keyed)).select("cache_key")


def _one_each(spark: SparkSession, folder: str) -> DataFrame:
    return quality.first_rows(lenses.questions(spark, folder).where(F.col("question_id").isNotNull()))


def direct_dummy(spark: SparkSession, folder: str) -> DataFrame:
    return methods.run_method("direct_mcq", _one_each(spark, folder), responders.dummy).select("question_id", "parsed_choice", "is_correct", "score_status", "answer_status")


def shuffled_dummy(spark: SparkSession, folder: str) -> DataFrame:
    return methods.run_method("shuffled_baseline", _one_each(spark, folder), responders.dummy, seed=42).select("question_id", "parsed_choice", "is_correct")


def cyclic_dummy(spark: SparkSession, folder: str) -> DataFrame:
    out = methods.run_method("cyclic_permutation", _one_each(spark, folder), responders.dummy, seed=42)
    return out.select("question_id", F.array_join("per_rotation_choices", ",").alias("trace"), "n_permutations_total", "parsed_choice")


def cyclic_traces(spark: SparkSession, folder: str) -> DataFrame:
    return cyclic_dummy(spark, folder).select("question_id", "trace", "n_permutations_total")


def logprob_dummy(spark: SparkSession, folder: str) -> DataFrame:
    out = methods.run_method("direct_logprob", _one_each(spark, folder), responders.dummy)
    return out.select("question_id", F.round(F.get(F.get("option_distributions", F.lit(0)), F.lit(0)), 6).alias("p_first"), "parsed_choice", "is_correct")


def cyclic_logprob_dummy(spark: SparkSession, folder: str) -> DataFrame:
    out = methods.run_method("cyclic_logprob", _one_each(spark, folder), responders.dummy)
    return out.select("question_id", "n_permutations_total", "n_permutations_failed", F.size("option_distributions").alias("n_rows"))


def pride_dummy(spark: SparkSession, folder: str) -> DataFrame:
    """The method's own gate leaves out questions without the modal number of options: about a fifth of the test tables."""
    every = _one_each(spark, folder)
    calibration = selection.hash_sample(every.where(F.col("n_choices") == 4), 100, 42)
    out = methods.run_method("pride", every, responders.dummy, calibration=calibration, threshold=PRIDE_THRESHOLD)
    return out.select("question_id", F.round(F.element_at("peprior", "A"), 6).alias("prior_a"), F.col("gate_n_evaluated").alias("n_evaluated"))


def two_stage_dummy(spark: SparkSession, folder: str) -> DataFrame:
    return methods.run_method("two_stage", _one_each(spark, folder), responders.dummy).select("question_id", "free_text_response", "fallback_used", "parsed_choice", "is_correct")


def condition_grid(spark: SparkSession, folder: str) -> DataFrame:
    models = table(spark, folder, "model_responses").select("provider", "model_name")
    names = spark.createDataFrame([(m,) for m in sorted(methods.METHODS)], "method_name string")
    return runs.condition_grid(table(spark, folder, "eval_items").select("benchmark_name"), names, models)


def resume_remaining(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "model_responses").where(F.col("status") == "success")
    return selection.remaining(table(spark, folder, "toy_normalized").select("ordinal", "question_id"), done)


def result_identity_problems(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "model_responses").select(F.concat_ws("/", "provider", "model_name").alias("condition_id"), "question_id", "max_tokens", "provider")
    return identity_problems(r, ("condition_id", "question_id", "max_tokens", "provider"))


def result_membership(spark: SparkSession, folder: str) -> DataFrame:
    have = table(spark, folder, "agreement_input").select("condition_id", "question_id")
    conditions = have.select("condition_id").distinct()
    expected = conditions.crossJoin(table(spark, folder, "eval_items").select(F.col("item_id").cast("string").alias("question_id")))
    problems = membership_problems(have, expected)
    return problems.groupBy("condition_id", "problem").agg(F.count(F.lit(1)).alias("n"))


def id_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "toy_normalized").select("question_id").where(F.col("question_id").isNotNull())
    b = table(spark, folder, "model_responses").select("question_id").where(F.col("question_id").isNotNull())
    sides = {"both": a.intersect(b), "only_questions": a.distinct().exceptAll(b.distinct()), "only_responses": b.distinct().exceptAll(a.distinct()), "union_all": a.unionAll(b)}
    out = None
    for name, df in sides.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("set"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def event_fields(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


def exact_stem_regrade(spark: SparkSession, folder: str) -> DataFrame:
    """Questions regraded by other rows with the same stem and options: how often the gold letter agrees."""
    q = lenses.questions(spark, folder).select("ordinal", "correct_option", F.md5(F.to_json(F.struct("question_text", F.transform("choices", lambda o: o["text"])))).alias("key"))
    per = q.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("correct_option").alias("lo"), F.max("correct_option").alias("hi"))
    return per.where(F.col("n") > 1).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("lo") != F.col("hi")).alias("n_disagreeing"))


def regraded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to all delivered questions, graded again by the labels that model outputs of the same text were checked against: those of the latest deliveries."""
    q = lenses.questions(spark, folder).withColumn("key", F.md5(F.to_json(F.struct("question_text", F.transform("choices", lambda o: o["text"])))))
    answers = q.select("key", "correct_option", F.char(F.col("ordinal") % F.greatest("n_choices", F.lit(1)) + 65).alias("parsed_choice"))
    latest = q.groupBy("key").agg(F.max_by("correct_option", "ordinal").alias("label"))
    return metrics.regraded(answers, latest, "key")


def _response_stream(spark: SparkSession, folder: str) -> DataFrame:
    import os

    t = table(spark, folder, "model_responses")
    path = f"{folder}/model_responses.parquet"
    reader = spark.readStream.schema(t.schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "model_responses.parquet").parquet(folder)


def streamed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Structured Streaming over the response table: failures by provider, equal to the batch result."""
    counts = _response_stream(spark, folder).groupBy("provider").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("status") == "failure").alias("n_failed"))
    return results_stream.run_once(counts, "counts", f"{Scratch(spark).root}/stream")


def streamed_health(spark: SparkSession, folder: str) -> DataFrame:
    """Failures of each provider and day of receipt (days since 1970, UTC); late rows are within the watermark."""
    health = results_stream.windowed_health(_response_stream(spark, folder), "received_at", "1 day", "3650 days")
    got = results_stream.run_once(health, "health", f"{Scratch(spark).root}/stream")
    return got.select(F.floor(F.unix_timestamp("window_start") / 86_400).alias("day"), "provider", "n_total", "n_failed")


def streamed_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every request once, however often it was stored; null request ids count as one."""
    once = results_stream.distinct_requests(_response_stream(spark, folder), "received_at", "3650 days")
    return results_stream.run_once(once.select("request_id"), "requests", f"{Scratch(spark).root}/stream", "append")


def source_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """Where each option came from: label to source index."""
    q = lenses.questions(spark, folder)
    found = options.source_map(options.labelled(F.col("choices")))
    return q.select("ordinal", F.explode(found).alias("label", "source_index"))


def stamped_results(spark: SparkSession, folder: str) -> DataFrame:
    """Responses stamped with the conditions of their model by one join; how many of each condition."""
    models = table(spark, folder, "model_responses").select("provider", "model_name")
    names = spark.createDataFrame([(m,) for m in sorted(methods.METHODS)], "method_name string")
    conditions = runs.condition_grid(table(spark, folder, "eval_items").select("benchmark_name"), names, models).drop("provider")
    rows = table(spark, folder, "model_responses").select("model_name", F.lit("direct_mcq").alias("method_name"), "status")
    return stamped_by_table(rows, conditions).groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failure").alias("n_failed"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_questions, option_maps, gold_letters, validation_report, duplicate_id_rows, null_option_scan, permutation_filter, choice_counts, modal_choice_count, modal_k_gate, dedup_ladder, strict_groups,
        strict_group_members, semantic_identities, subject_filter, group_sample, hash_sample, id_list_selection, id_list_gaps, calibration_disjoint, leakage_overlap, leakage_semantic, chunk_numbers, rotations_fanout, render_prompts, seeded_shuffles,
        parse_replies, parse_summary, single_letter_replies, text_match, finish_reasons, request_cache_misses, direct_dummy, shuffled_dummy, cyclic_dummy, cyclic_traces, logprob_dummy, cyclic_logprob_dummy, pride_dummy,
        two_stage_dummy, condition_grid, resume_remaining, result_identity_problems, result_membership, id_set_operations, event_fields, exact_stem_regrade, regraded_answers, streamed_counts, streamed_health, streamed_requests, source_indexes, stamped_results,
    )
}

_SPACE = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


class _Template(str):
    """SQL with a place for one expression; patterns in it may hold braces."""

    def format(self, expression: str) -> str:  # noqa: A003
        return self.replace("{0}", expression)


_WS = _Template("trim(regexp_replace({0}, '" + _SPACE + "', ' ', 'g'))")
_SQ = _Template("trim(regexp_replace(coalesce({0}, ''), '" + _SPACE + "', ' ', 'g'))")
_TEXTS = "json_extract_string(choices_json, '$[*].text')"
_Q = f"q AS (SELECT *, {_TEXTS} AS texts, json_extract(choices_json, '$[*].source_index') AS src FROM toy_normalized)"
_ONE = "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ordinal) AS rn FROM q) WHERE rn = 1 AND question_id IS NOT NULL)"
_LABELLED = f"""lab AS (SELECT ordinal, list_filter([CASE WHEN {_SQ.format("texts[i]")} <> '' THEN {{'label': chr(CAST(64 + i AS INT)), 'text': {_SQ.format("texts[i]")}, 'src': CAST(src[i] AS INT)}} END FOR i IN range(1, len(texts) + 1)], lambda z: z IS NOT NULL) AS opts FROM q)"""
_UNSAFE = _Template("CASE " + " ".join(f"WHEN regexp_matches({{0}}, '(?i){p}') THEN '{n}'" for n, p in quality.UNSAFE_PATTERNS.items()) + " END")
_LADDER_SQL = {
    "stem": "question_text", "stem_ws": _WS.format("question_text"), "stem_ws_case": f"lower({_WS.format('question_text')})",
    "stem_choices": "[question_text] || texts", "stem_choices_ws": f"[{_WS.format('x')} FOR x IN [question_text] || texts]", "stem_choices_ws_case": f"[lower({_WS.format('x')}) FOR x IN [question_text] || texts]",
    "strict": "[coalesce(subject, chr(1)), CAST(correct_index AS VARCHAR), question_text] || texts",
}
_A_LETTER = "CASE WHEN correct_option = 'A' THEN TRUE ELSE FALSE END"
_REPLIES = f"""{_Q}, {_LABELLED}, one AS (SELECT * FROM (SELECT q.question_id, lab.opts, row_number() OVER (PARTITION BY q.question_id ORDER BY q.ordinal) AS rn FROM q JOIN lab USING (ordinal) WHERE q.question_id IS NOT NULL) WHERE rn = 1),
rep AS (SELECT r.response_id, r.raw_text, one.opts FROM model_responses r JOIN one USING (question_id))"""
_PROMPT = "'Question about ' || translate(coalesce(subject, ''), '_', ' ') || ': ' || coalesce(question_text, '') || chr(10) || chr(10)"

ORACLE_SQL = {
    "normalize_questions": """SELECT substr(sha256(array_to_string([coalesce(subject, ''), coalesce(question, '')] || [coalesce(c, '') FOR c IN choices], '|')), 1, 16) AS question_id, subject, question AS question_text, array_to_string(choices, '|') AS options,
  CAST(answer AS VARCHAR) AS correct_index, CASE WHEN answer >= 0 THEN chr(65 + answer) END AS correct_option, choices[answer + 1] AS correct_answer_text, CAST(len(choices) AS INT) AS n_choices, CASE WHEN answer IS NULL OR answer < 0 OR answer >= len(choices) THEN 'gold index out of range' END AS problem FROM eval_items""",
    "option_maps": f"""WITH {_Q}, {_LABELLED} SELECT l.ordinal, array_to_string([x.label || ':' || x.text || ':' || x.src FOR x IN opts], '|') AS options,
  CASE WHEN len(opts) < 2 THEN 'fewer than two options' WHEN NOT list_contains([x.label FOR x IN opts], coalesce(nullif(upper(trim(correct_option)), ''), chr(65 + correct_index))) THEN 'gold not among the options' END AS problem FROM lab l JOIN q USING (ordinal)""",
    "gold_letters": "SELECT ordinal, coalesce(nullif(upper(trim(correct_option)), ''), chr(65 + correct_index), '') AS gold, coalesce(chr(65 + correct_index), '') AS gold_of_index FROM toy_normalized",
    "validation_report": """SELECT count(*) AS n_rows, count(*) FILTER (question_id IS NULL) AS null_ids, count(*) FILTER (trim(question_id) = '') AS blank_ids, count(*) FILTER (n > 1) AS repeated_rows, count(*) FILTER (question_text IS NULL) AS null_stems
FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM toy_normalized)""",
    "duplicate_id_rows": "SELECT ordinal, question_id FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM toy_normalized) WHERE n = 1",
    "null_option_scan": f"WITH {_Q} SELECT question_id, CASE WHEN lower({_SQ.format('texts[correct_index + 1]')}) = 'nan' THEN 'gold' ELSE 'distractor' END AS kind FROM q WHERE list_contains([lower({_SQ.format('x')}) FOR x IN texts], 'nan')",
    "permutation_filter": f"""WITH {_Q}, both_t AS (SELECT question_id, ordinal, texts FROM q UNION ALL SELECT CAST(item_id AS VARCHAR), item_id, choices FROM eval_items),
u AS (SELECT question_id, ordinal, texts[i] AS t, i, {_UNSAFE.format(_SQ.format("texts[i]"))} AS p FROM both_t, unnest(range(1, 30)) AS r(i) WHERE i <= len(texts))
SELECT question_id, ordinal, p AS matched_pattern, t AS offending_option_text FROM (SELECT *, row_number() OVER (PARTITION BY question_id, ordinal ORDER BY i) AS rn FROM u WHERE p IS NOT NULL) WHERE rn = 1""",
    "choice_counts": "SELECT n_choices, count(*) AS n FROM toy_normalized GROUP BY n_choices",
    "modal_choice_count": "SELECT n_choices AS modal_k, count(*) AS n_modal, (SELECT count(*) FROM toy_normalized) AS n_total, round(count(*) / (SELECT count(*) FROM toy_normalized), 6) AS proportion FROM toy_normalized GROUP BY n_choices ORDER BY count(*) DESC, n_choices LIMIT 1",
    "modal_k_gate": "SELECT 4 AS modal_k, count(*) AS n_total, count(*) FILTER (n_choices = 4) AS n_evaluated, count(*) FILTER (n_choices <> 4) AS n_excluded, round(count(*) FILTER (n_choices = 4) / count(*), 6) AS proportion, count(*) FILTER (n_choices = 4) / count(*) >= 0.95 AS passes FROM toy_normalized",
    "dedup_ladder": f"WITH {_Q}, k AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS rung, count(*) AS s FROM q GROUP BY {e}" for n, e in _LADDER_SQL.items())
    + """) SELECT rung, count(*) FILTER (s > 1) AS groups, CAST(coalesce(sum(s * (s - 1) // 2) FILTER (s > 1), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(s - 1) FILTER (s > 1), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(s) FILTER (s > 1), 0) AS BIGINT) AS rows_in_groups,
  round(coalesce(sum(s - 1) FILTER (s > 1), 0) * 100.0 / sum(s), 3) AS redundant_pct, round(coalesce(sum(s) FILTER (s > 1), 0) * 100.0 / sum(s), 3) AS rows_pct FROM k GROUP BY rung""",
    "strict_groups": f"WITH {_Q} SELECT min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, count(*) AS group_size, subject, correct_index, substr(question_text, 1, 80) AS stem_preview FROM q GROUP BY subject, correct_index, question_text, texts HAVING count(*) > 1",
    "strict_group_members": f"WITH {_Q} SELECT min(ordinal) OVER w AS first_ordinal, ordinal FROM q WINDOW w AS (PARTITION BY subject, correct_index, question_text, texts) QUALIFY count(*) OVER w > 1",
    "subject_filter": f"SELECT ordinal, subject FROM toy_normalized WHERE subject IN ({', '.join(repr(s) for s in SUBJECTS)})",
    "group_sample": "SELECT item_id, benchmark_name FROM eval_items QUALIFY row_number() OVER (PARTITION BY benchmark_name ORDER BY sha256('42|' || item_id), item_id) <= 25",
    "hash_sample": "SELECT ordinal, question_id FROM toy_normalized ORDER BY sha256('42|' || ordinal) LIMIT 150",
    "id_list_selection": "SELECT ordinal, question_id FROM toy_normalized WHERE question_id IN (SELECT question_id FROM agreement_input)",
    "calibration_disjoint": "SELECT ordinal, question_id FROM toy_normalized t WHERE NOT EXISTS (SELECT 1 FROM agreement_input a WHERE a.question_id = t.question_id)",
    "leakage_overlap": f"SELECT ordinal, subject FROM toy_normalized WHERE lower({_WS.format('question_text')}) IN (SELECT lower({_WS.format('question')}) FROM eval_items)",
    "leakage_semantic": f"""WITH {_Q}, k AS (SELECT DISTINCT lower({_SQ.format("replace(question, '…', '...')")}) AS s, list_sort([lower({_SQ.format("replace(x, '…', '...')")}) FOR x IN choices]) AS o FROM eval_items)
SELECT ordinal, subject FROM q JOIN k ON s = lower({_SQ.format("replace(question_text, '…', '...')")}) AND o = list_sort([lower({_SQ.format("replace(x, '…', '...')")}) FOR x IN texts])""",
    "id_list_gaps": "SELECT DISTINCT question_id FROM model_responses WHERE question_id IS NOT NULL AND question_id NOT IN (SELECT question_id FROM toy_normalized WHERE question_id IS NOT NULL)",
    "chunk_numbers": "SELECT ordinal, (row_number() OVER (ORDER BY ordinal) - 1) // 128 AS chunk_number FROM toy_normalized",
    "rotations_fanout": f"WITH {_Q} SELECT ordinal, CAST(k AS INT) AS rotation, array_to_string([texts[(j + k) % len(texts) + 1] FOR j IN range(0, len(texts))], '|') AS shown, array_to_string([(j + k) % len(texts) FOR j IN range(0, len(texts))], ',') AS slots FROM q, unnest(range(0, 30)) AS r(k) WHERE k < len(texts)",
    "render_prompts": f"WITH {_Q}, {_LABELLED} SELECT ordinal, {_PROMPT} || array_to_string([x.label || '. ' || x.text FOR x IN opts], chr(10)) || chr(10) || chr(10) || 'Give the letter of the right option.' AS prompt, {_PROMPT} || 'Answer in one short phrase.' AS free_prompt FROM q JOIN lab USING (ordinal)",
    "single_letter_replies": f"""WITH {_REPLIES}, x AS (SELECT response_id, opts, upper(regexp_extract(raw_text, '^[\\s\\x{{a0}}]*[()\\[\\]{{}}<>".,:;!?''“”‘’]*([A-Za-z])[()\\[\\]{{}}<>".,:;!?''“”‘’]*[\\s\\x{{a0}}]*$', 1)) AS letter FROM rep)
SELECT response_id, letter FROM x WHERE letter <> '' AND list_contains([o.label FOR o IN opts], letter)""",
    "text_match": f"""WITH {_REPLIES}, every AS (SELECT r.response_id, r.raw_text, coalesce(one.opts, []) AS opts FROM model_responses r LEFT JOIN one USING (question_id)),
n AS (SELECT response_id, lower({_WS.format('raw_text')}) AS t, [{{'label': o.label, 'x': lower({_WS.format('o.text')})}} FOR o IN opts] AS os FROM every),
h AS (SELECT response_id, coalesce(t, '') <> '' AS usable, [o.label FOR o IN os IF o.x = t] AS e, [o.label FOR o IN os IF length(o.x) >= 4 AND (contains(t, o.x) OR (contains(o.x, t) AND length(t) >= 4))] AS c FROM n)
SELECT response_id, CASE WHEN usable AND len(e) > 0 THEN 'exact' WHEN usable AND len(c) = 1 THEN 'contained' END AS stage, CASE WHEN usable AND len(e) > 0 THEN array_to_string(e, ',') WHEN usable AND len(c) = 1 THEN array_to_string(c, ',') ELSE '' END AS tied FROM h""",
    "finish_reasons": "SELECT CASE WHEN lower(finish_reason) IN ('length', 'max_tokens') THEN 'length' WHEN lower(finish_reason) = 'limit' THEN 'incomplete' WHEN lower(finish_reason) IN ('stop', 'eos', 'end_turn') THEN 'stop' ELSE finish_reason END AS reason, count(*) AS n FROM model_responses GROUP BY ALL",
    "request_cache_misses": """WITH k AS (SELECT *, sha256(array_to_string([coalesce(provider, chr(0)), coalesce(model_name, chr(0)), coalesce(request_id, chr(0)), chr(0), coalesce(CAST(max_tokens AS VARCHAR), chr(0)), chr(0)], chr(1))) AS cache_key FROM model_responses)
SELECT DISTINCT cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE status = 'success')""",
    "direct_dummy": f"WITH {_Q}, {_ONE} SELECT question_id, 'A' AS parsed_choice, {_A_LETTER} AS is_correct, CASE WHEN correct_option = 'A' THEN 'score_correct' ELSE 'score_incorrect' END AS score_status, 'success' AS answer_status FROM o",
    "cyclic_traces": f"WITH {_Q}, {_ONE} SELECT question_id, array_to_string([chr(CAST(65 + k AS INT)) FOR k IN range(0, len(texts))], ',') AS trace, len(texts) AS n_permutations_total FROM o",
    "logprob_dummy": f"WITH {_Q}, {_ONE} SELECT question_id, round(exp(-0.1) / list_sum([exp(coalesce([-0.1, -1.5, -2.0, -2.5][k], -5.0)) FOR k IN range(1, len(texts) + 1)]), 6) AS p_first, 'A' AS parsed_choice, {_A_LETTER} AS is_correct FROM o",
    "cyclic_logprob_dummy": f"WITH {_Q}, {_ONE} SELECT question_id, len(texts) AS n_permutations_total, CAST(0 AS BIGINT) AS n_permutations_failed, CAST(len(texts) AS INT) AS n_rows FROM o",
    "pride_dummy": f"WITH {_Q}, {_ONE} SELECT question_id, round(exp(-0.1) / (exp(-0.1) + exp(-1.5) + exp(-2.0) + exp(-2.5)), 6) AS prior_a, count(*) OVER () AS n_evaluated FROM o WHERE n_choices = 4",
    "two_stage_dummy": f"WITH {_Q}, {_ONE} SELECT question_id, 'The answer is A.' AS free_text_response, FALSE AS fallback_used, 'A' AS parsed_choice, {_A_LETTER} AS is_correct FROM o",
    "condition_grid": f"""WITH g AS (SELECT * FROM (SELECT DISTINCT benchmark_name FROM eval_items), (SELECT unnest({sorted(methods.METHODS)}) AS method_name), (SELECT DISTINCT provider, model_name FROM model_responses))
SELECT *, substr(sha256(array_to_string([benchmark_name, method_name, provider, model_name], '|')), 1, 16) AS condition_id FROM g""",
    "resume_remaining": "SELECT ordinal, question_id FROM toy_normalized t WHERE NOT EXISTS (SELECT 1 FROM model_responses r WHERE r.status = 'success' AND r.question_id = t.question_id)",
    "result_identity_problems": """WITH s AS (SELECT provider || '/' || model_name AS condition_id, count(*) FILTER (question_id IS NULL) AS nq, count(DISTINCT question_id) AS dq, count(DISTINCT max_tokens) AS dm FROM model_responses GROUP BY ALL)
SELECT condition_id, 'question_id is null' AS problem FROM s WHERE nq > 0 UNION ALL SELECT condition_id, 'question_id has several values' FROM s WHERE dq > 1 UNION ALL SELECT condition_id, 'max_tokens has several values' FROM s WHERE dm > 1""",
    "result_membership": """WITH h AS (SELECT condition_id, question_id, count(*) AS n FROM agreement_input GROUP BY ALL), w AS (SELECT condition_id, CAST(item_id AS VARCHAR) AS question_id FROM (SELECT DISTINCT condition_id FROM agreement_input), eval_items),
p AS (SELECT coalesce(h.condition_id, w.condition_id) AS condition_id, CASE WHEN h.n IS NULL THEN 'missing' WHEN w.condition_id IS NULL THEN 'not expected' WHEN h.n > 1 THEN 'repeated' END AS problem FROM h FULL JOIN w ON h.condition_id = w.condition_id AND h.question_id = w.question_id)
SELECT condition_id, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL""",
    "id_set_operations": """WITH a AS (SELECT DISTINCT question_id FROM toy_normalized WHERE question_id IS NOT NULL), b AS (SELECT DISTINCT question_id FROM model_responses WHERE question_id IS NOT NULL)
SELECT 'both' AS set, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_questions', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_responses', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT 'union_all', (SELECT count(question_id) FROM toy_normalized) + (SELECT count(question_id) FROM model_responses)""",
    "event_fields": "SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS INT)) AS largest FROM events GROUP BY event_type",
    "exact_stem_regrade": f"WITH {_Q}, p AS (SELECT count(*) AS n, min(correct_option) AS lo, max(correct_option) AS hi FROM q GROUP BY question_text, texts HAVING count(*) > 1) SELECT count(*) AS n_texts, count(*) FILTER (lo <> hi) AS n_disagreeing FROM p",
    "regraded_answers": f"""WITH {_Q}, k AS (SELECT *, coalesce(nullif(upper(trim(correct_option)), ''), chr(65 + correct_index), '') AS gold, chr(CAST(65 + ordinal % greatest(n_choices, 1) AS INT)) AS c FROM q),
l AS (SELECT question_text AS t, texts AS x, max_by(gold, ordinal) AS label FROM k GROUP BY question_text, texts)
SELECT count(*) AS n_regraded, count(*) FILTER (label <> gold) AS n_other_label, count(*) FILTER (c = gold) AS right_before, count(*) FILTER (c = label) AS right_after FROM k JOIN l ON l.t IS NOT DISTINCT FROM k.question_text AND l.x IS NOT DISTINCT FROM k.texts""",
    "streamed_counts": "SELECT provider, count(*) AS n_total, count(*) FILTER (status = 'failure') AS n_failed FROM model_responses GROUP BY provider",
    "streamed_health": "SELECT CAST(floor(epoch(received_at) / 86400) AS BIGINT) AS day, provider, count(*) AS n_total, count(*) FILTER (status = 'failure') AS n_failed FROM model_responses WHERE received_at IS NOT NULL GROUP BY ALL",
    "streamed_requests": "SELECT DISTINCT request_id FROM model_responses",
    "source_indexes": f"WITH {_Q}, {_LABELLED}, e AS (SELECT ordinal, unnest(opts) AS o FROM lab) SELECT ordinal, o.label AS label, o.src AS source_index FROM e",
    "stamped_results": """WITH g AS (SELECT DISTINCT e.benchmark_name, r.provider, r.model_name FROM (SELECT DISTINCT benchmark_name FROM eval_items) e, (SELECT DISTINCT provider, model_name FROM model_responses) r),
c AS (SELECT model_name, substr(sha256(array_to_string([benchmark_name, 'direct_mcq', provider, model_name], '|')), 1, 16) AS condition_id FROM g)
SELECT condition_id, count(*) AS n, count(*) FILTER (status = 'failure') AS n_failed FROM model_responses JOIN c USING (model_name) GROUP BY condition_id""",
}
