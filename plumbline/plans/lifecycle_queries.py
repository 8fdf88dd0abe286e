"""Queries of whole chains: raw shapes to questions, clients, caches, resumption, artifacts, batch jobs, derived answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import identity, vectors
from plumbline.functions.options import labelled, letter
from plumbline.operators import fanout, grid, matching, methods, metrics, normalize, quality, scoring, selection
from plumbline.plans import lenses, runs
from plumbline.schemas import IDENTITY_COLUMNS, RESULTS_DDL
from plumbline.sources import artifacts, batch_jobs, responders
from plumbline.sources.scratch import Scratch
from plumbline.sources.tables import table

PRIOR = {"A": 0.4, "B": 0.3, "C": 0.2, "D": 0.1}
CLIENT = dict(provider="local", model="smallest", temperature=0.0, max_tokens=16, seed=None)


def smallest_option() -> Callable[[str], str]:
    """A client that answers with the letter of the option whose text comes first; without options it says so."""

    def answer(prompt: str) -> str:
        block = prompt.split("\n\n")[-2].split("\n") if prompt.count("\n\n") > 1 else []
        lines = [line.partition(". ") for line in block if line[1:3] == ". "]
        return f"Answer: {min(lines, key=lambda p: p[2])[0]}" if lines else "no options were shown"

    return answer


def _ask(**options) -> Callable[[DataFrame], DataFrame]:
    return responders.client_responder(smallest_option, key="smallest/sync", **options)


def _one_each(spark: SparkSession, folder: str) -> DataFrame:
    return quality.first_rows(lenses.questions(spark, folder).where(F.col("question_id").isNotNull()))


def _chosen(df: DataFrame) -> DataFrame:
    text = F.get(F.filter(labelled(F.col("choices")), lambda o: o["label"] == F.col("parsed_choice")), F.lit(0))["text"]
    return df.select("question_id", text.alias("chosen_text"))


def direct_client(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(methods.run_method("direct_mcq", _one_each(spark, folder), _ask()))


def shuffled_client(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(methods.run_method("shuffled_baseline", _one_each(spark, folder), _ask(), seed=42))


def cyclic_client(spark: SparkSession, folder: str) -> DataFrame:
    """Every rotation names the same text, so no vote is tied."""
    return _chosen(methods.run_method("cyclic_permutation", _one_each(spark, folder), _ask(), seed=42))


def two_stage_client(spark: SparkSession, folder: str) -> DataFrame:
    out = methods.run_method("two_stage", _one_each(spark, folder), _ask())
    text = F.get(F.filter("options", lambda o: o["label"] == F.col("parsed_choice")), F.lit(0))["text"]
    return out.select("question_id", "free_text_response", "fallback_used", text.alias("chosen_text"))


def stage_two_client(spark: SparkSession, folder: str) -> DataFrame:
    """The second stage over all rotations of stored free texts."""
    every = _one_each(spark, folder)
    return _chosen(methods.stage_two_rotations(every, every.select("question_id", F.lit("some words").alias("free_text_response")), _ask(), seed=42))


def cached_client(spark: SparkSession, folder: str) -> DataFrame:
    """All questions of toy_normalized after those of model_responses were asked: the cache answers what it has."""
    every = _one_each(spark, folder)
    cache = responders.ResponseCache(spark, f"{Scratch(spark).root}/cache")
    ask = responders.cached(_ask(), cache, **CLIENT)
    known = table(spark, folder, "model_responses").select("question_id")
    methods.run_method("direct_mcq", every.join(known, "question_id", "left_semi"), ask)
    return _chosen(methods.run_method("direct_mcq", every, ask))


def resumed_client(spark: SparkSession, folder: str) -> DataFrame:
    """A sink that holds the questions of agreement_input already; the others are asked in chunks and appended."""
    scratch = Scratch(spark)
    every, sink = _one_each(spark, folder), f"{scratch.root}/sink"
    ask = _ask()
    process = lambda part: methods.run_method("direct_mcq", part, ask).select("question_id", "parsed_choice")
    held = every.join(table(spark, folder, "agreement_input").select("question_id"), "question_id", "left_semi")
    held.select("question_id", F.lit("held").alias("parsed_choice")).write.parquet(sink)
    runs.resume(every, sink, "question_id string, parsed_choice string", 10_000, process)
    return spark.read.schema("question_id string, parsed_choice string").parquet(sink).groupBy((F.col("parsed_choice") == "held").alias("held")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("question_id").alias("n_questions"))


class _FolderBatches:
    """A batch provider in the plan: replies are written beside the requests by Spark itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def submit(self, requests_folder: str) -> str:
        return requests_folder

    def poll(self, job: str) -> str:
        return batch_jobs.DONE

    def fetch(self, job: str) -> str:
        asked = self.spark.read.schema("custom_id string, prompt string").json(job)
        error = F.when(F.length("prompt") % 5 == 0, F.lit("too busy"))
        asked.select("custom_id", F.concat(F.lit("Answer to "), F.length("prompt").cast("string")).alias("raw_text"), F.lit("stop").alias("finish_reason"), error.alias("error")).write.mode("overwrite").json(f"{job}-replies")
        return f"{job}-replies"


def batch_replies(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select(F.col("question").alias("prompt"))
    misses = responders.with_cache_key(items, **CLIENT).dropDuplicates(["cache_key"])
    out = batch_jobs.run_batch(misses, _FolderBatches(spark), f"{Scratch(spark).root}/batch")
    return out.groupBy("status", "raw_text", "error_message").agg(F.count(F.lit(1)).alias("n"))


def _item(raw: DataFrame, path: str, subset: str | None = None) -> DataFrame:
    out = normalize.normaliser(path, subset)(raw, problems=True)
    return out.select("question_id", "subject", "question_text", F.col("correct_index").cast("string").alias("correct_index"), "correct_option", "correct_answer_text", "n_choices", "problem")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items")


def normalize_mmlu(spark: SparkSession, folder: str) -> DataFrame:
    """Choices delivered as list literals."""
    raw = _items(spark, folder).select("subject", "question", F.to_json("choices").alias("choices"), "answer")
    return _item(raw, "cais/mmlu")


def normalize_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Options labelled by figures, the key by a letter in lower case."""
    labels = F.transform("choices", lambda _, i: F.when(i < 5, (i + 1).cast("string")).otherwise(F.char(i + 65)))
    raw = _items(spark, folder).select("question", F.struct(labels.alias("label"), F.col("choices").alias("text")).alias("choices"), F.lower(letter(F.col("answer"))).alias("answerKey"))
    return _item(raw, "allenai/ai2_arc", "ARC-Easy")


def normalize_pro(spark: SparkSession, folder: str) -> DataFrame:
    """A null option before the others, so the gold index is one too high."""
    raw = _items(spark, folder).select(F.col("subject").alias("category"), "question", F.concat(F.array(F.lit(None).cast("string")), "choices").alias("options"), (F.col("answer") + 1).alias("answer_index"))
    return _item(raw, "TIGER-Lab/MMLU-Pro")


def normalize_hellaswag(spark: SparkSession, folder: str) -> DataFrame:
    raw = _items(spark, folder).select(F.col("subject").alias("activity_label"), F.col("question").alias("ctx"), F.col("choices").alias("endings"), F.col("answer").cast("string").alias("label"))
    return _item(raw, "Rowan/hellaswag")


def normalize_truthful(spark: SparkSession, folder: str) -> DataFrame:
    marks = F.transform("choices", lambda _, i: F.when(i == F.coalesce("answer", F.lit(-1)), 1).otherwise(0))
    raw = _items(spark, folder).select("question", F.struct(F.col("choices").alias("choices"), marks.alias("labels")).alias("mc1_targets"))
    return _item(raw, "truthfulqa/truthful_qa", "multiple_choice")


def reparsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Stored answers of three kinds: only those that a direct prompt gave are parsed again."""
    q = _one_each(spark, folder).withColumn("options", labelled(F.col("choices")))
    kind = F.col("ordinal") % 3
    stored = q.select(
        "question_id", "options", "correct_option", F.when(kind == 0, "two_stage").otherwise("direct_mcq").alias("method_name"), F.concat(F.lit("The option is "), F.char(F.col("n_choices") + 64), F.lit(".")).alias("raw_text"),
        F.when(kind == 1, "failure").otherwise("success").alias("transport_status"), F.lit("A").alias("parsed_choice"), F.lit("parse_ok").alias("parse_status"), F.lit("A").alias("normalized_text"), F.lit("old").alias("parse_reason"),
        F.lit(False).alias("is_correct"), F.lit("score_incorrect").alias("score_status"),
    )
    return scoring.reparse(stored).select("question_id", "method_name", "parsed_choice", "is_correct")


def derived_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers found anew from saved free texts, here the gold texts in capitals; null texts match nothing."""
    q = _one_each(spark, folder).withColumn("options", labelled(F.col("choices")))
    lit = F.lit
    saved = q.withColumns({"free_text_response": F.upper("correct_answer_text"), "method_name": lit("two_stage"), "parsed_choice": lit(None).cast("string"), "is_correct": lit(None).cast("boolean"), "score_status": lit("x"), "parse_status": lit("x"), "parse_reason": lit("x"), "answer_status": lit("x")})
    out = methods.from_free_text(saved)
    text = F.get(F.filter("options", lambda o: o["label"] == F.col("parsed_choice")), F.lit(0))["text"]
    return out.select("question_id", F.lower(text).alias("matched_text"), "derived_from_method_name")


def hypothesis_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return fanout.hypothesis_prompts(_one_each(spark, folder))


def semantic_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of one meaning (stem and sorted options, free of case and spacing) named by their smallest ordinal."""
    q = lenses.questions(spark, folder)
    keyed = q.select("ordinal", identity.semantic_identity(F.col("question_text"), F.transform("choices", lambda o: o["text"])).alias("identity"))
    return keyed.groupBy("identity").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n")).select("first_ordinal", "n")


def debiased_choices(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of a stored prior over score vectors."""
    prior = F.create_map(*[F.lit(x) for pair in PRIOR.items() for x in pair])
    labels = F.array(*[F.lit(c) for c in PRIOR])
    return lenses.logits(spark, folder).select("question_id", vectors.debiased_choice(F.col("scores"), prior, labels).alias("choice"))


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Questions of four options and a responder that replays their score vectors, those of rotations by their number."""
    rows = lenses.logits(spark, folder)
    blank = F.array(*[F.struct(F.lit(f"option {i}").alias("text"), F.lit(i).alias("source_index")) for i in range(4)])
    questions = rows.select(F.col("question_id").cast("long").alias("ordinal"), "question_id", F.lit("s").alias("subject"), F.lit("q").alias("question_text"), blank.alias("choices"), "correct_index", "correct_option", F.lit(4).alias("n_choices"))
    scores = rows.select("question_id", "matrix", "scores")

    def respond(df: DataFrame) -> DataFrame:
        vector = F.transform(F.get("matrix", F.col("rotation")), lambda p: F.log(p)) if "rotation" in df.columns else F.col("scores")
        return df.join(scores, "question_id").withColumns({"status": F.lit("success"), "raw_text": F.lit(None).cast("string"), "finish_reason": F.lit("stop"), "latency_seconds": F.lit(0.0), "logprobs": vector}).drop("matrix", "scores")

    return questions, respond


def direct_logprob_scores(spark: SparkSession, folder: str) -> DataFrame:
    questions, respond = _scored(spark, folder)
    return methods.run_method("direct_logprob", questions, respond).select("question_id", "parsed_choice", "is_correct")


def cyclic_logprob_scores(spark: SparkSession, folder: str) -> DataFrame:
    questions, respond = _scored(spark, folder)
    return methods.run_method("cyclic_logprob", questions, respond).select("question_id", "parsed_choice", "is_correct", "n_permutations_total")


def pride_logits(spark: SparkSession, folder: str) -> DataFrame:
    """The whole method over recorded score vectors: rotations of 100 calibration questions, then one answer for each question."""
    questions, respond = _scored(spark, folder)
    out = methods.run_method("pride", questions, respond, calibration=selection.hash_sample(questions, 100, 42, key="question_id"))
    return out.select("question_id", "adjusted_choice", "is_correct", F.col("gate_n_evaluated").alias("n_evaluated"))


def parsed_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """Score matrices written as JSON and read back; every third is spoiled in one of three ways and reads as null."""
    rows = lenses.logits(spark, folder).select("question_id", F.to_json("matrix").alias("text"))
    kind = F.col("question_id").cast("long") % 9
    spoiled = F.when(kind == 0, F.regexp_replace("text", r"\[\[[^,]*,", "[[")).when(kind == 3, F.regexp_replace("text", r"^\[\[[^,]*,", '[["x",')).when(kind == 6, F.lit("[]")).otherwise(F.col("text"))
    m = vectors.parse_matrix(spoiled)
    return rows.select("question_id", m.isNotNull().alias("usable"), F.coalesce(F.size(m), F.lit(-1)).alias("n_rows"), F.round(F.aggregate(F.get(m, F.lit(0)), F.lit(0.0), lambda a, x: a + x), 6).alias("first_sum"))


def grid_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and cyclic records that do not belong together."""
    rows = lenses.logits(spark, folder).withColumn("i", F.col("question_id").cast("long"))
    status = F.when(F.col("i") % 7 == 0, "failure").otherwise("success")
    direct = rows.where(F.col("i") % 3 != 0).select("question_id", "correct_option", status.alias("answer_status"), F.array("observed").alias("option_distributions"))
    cyclic = rows.where(F.col("i") % 5 != 0).select("question_id", "correct_option", F.lit("success").alias("answer_status"), F.col("matrix").alias("option_distributions"))
    return grid.excluded(direct, cyclic, grid.records(direct, cyclic))


def grid_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Measured accuracies of the plain and the cyclic answers against targets."""
    from plumbline.plans.metric_queries import grid_records

    ours = grid.cell_metrics(grid.baselines(grid_records(spark, folder)), ["method"]).select(F.col("method").alias("name"), F.round("accuracy", 5).alias("ours"))
    targets = spark.createDataFrame([("default", 25.0), ("cyclic", 30.0), ("absent", 50.0)], "name string, target double")
    return grid.comparison(ours, targets).withColumn("difference", F.round("difference", 5))


def cosine_best(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as a free answer, the next four as the vectors of its options: the labels of the best cosine of at least 0.30."""
    t = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    near = t.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "vec_id", "v").select((F.col("vec_id") - F.col("k")).alias("vec_id"), "k", F.col("v").alias("o"))
    four = near.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "o"))), lambda x: x["o"]).alias("vs"))
    options = F.transform("vs", lambda _, i: F.struct(F.char(i + 65).alias("label"), F.lit("").alias("text"), i.alias("source_index")))
    hits = t.join(four, "vec_id").withColumn("options", options).withColumn("hits", matching.cosine_hits(F.col("v"), F.col("options"), F.col("vs")))
    return hits.select("vec_id", F.array_join("hits", ",").alias("labels"))


def dataset_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out questions prepared, written, verified and read back; the artifact's row count beside each."""
    root, spec = f"{Scratch(spark).root}/datasets", {"name": "held_out", "split": "test"}
    questions = lenses.eval_questions(spark, folder)
    artifacts.write_dataset(questions, root, spec)
    back, meta = artifacts.read_dataset(spark, root, spec, questions.schema)
    return back.select("question_id", "subject", "question_text", F.array_join(F.transform("choices", lambda o: o["text"]), "|").alias("options"), "correct_option", F.lit(meta["rows"]).cast("long").alias("artifact_rows"))


def evaluation_run(spark: SparkSession, folder: str) -> DataFrame:
    """Preparation to report: dataset artifact, two conditions asked through a client, results sink, metrics of what was read back."""
    scratch = Scratch(spark)
    spec = {"name": "held_out", "split": "test"}
    artifacts.write_dataset(lenses.eval_questions(spark, folder), f"{scratch.root}/datasets", spec)
    questions, meta = artifacts.read_dataset(spark, f"{scratch.root}/datasets", spec, lenses.eval_questions(spark, folder).schema)
    sink, ask = f"{scratch.root}/results", _ask()
    for name in ("direct_mcq", "cyclic_permutation"):
        marks = {c: f"{c}-{name}" for c in IDENTITY_COLUMNS if c != "condition_id"} | {"condition_id": name, "run_id": uuid.uuid4().hex}
        artifacts.write_results(scoring.assembled(scoring.stamped(methods.run_method(name, questions, ask), marks, dataset_artifact_id=meta["artifact_id"])), sink)
    back = artifacts.read_results(spark, sink, RESULTS_DDL, ["direct_mcq", "cyclic_permutation"])
    report = metrics.evaluate(back, ["condition_id"], ["accuracy"])
    return report.select("condition_id", "n_total", "n_scored", "n_correct", F.round("accuracy", 6).alias("accuracy"))


QUERIES = {
    f.__name__: f
    for f in (
        direct_client, shuffled_client, cyclic_client, two_stage_client, stage_two_client, cached_client, resumed_client, batch_replies, normalize_mmlu, normalize_arc, normalize_pro, normalize_hellaswag, normalize_truthful,
        reparsed_answers, derived_answers, hypothesis_prompts, semantic_groups, debiased_choices, direct_logprob_scores, cyclic_logprob_scores, pride_logits, parsed_matrices, grid_excluded, grid_comparison, cosine_best, dataset_roundtrip, evaluation_run,
    )
}


def _oracle() -> dict[str, str]:
    from plumbline.plans import metric_queries as M
    from plumbline.plans import question_queries as Q

    one = f"WITH {Q._Q}, {Q._LABELLED}, {Q._ONE}, a AS (SELECT o.*, lab.opts, list_min([z.text FOR z IN opts]) AS chosen_text FROM o JOIN lab USING (ordinal))"
    smallest = f"{one} SELECT question_id, chosen_text FROM a"
    gold = "CASE WHEN answer >= 0 THEN chr(65 + answer) END"

    def item(subject: str, problem: str, options: str = "choices", usable: str = "TRUE") -> str:
        hashed = f"substr(sha256(array_to_string([coalesce({subject}, ''), coalesce(question, '')] || [coalesce(c, '') FOR c IN {options}], '|')), 1, 16)"
        return f"""SELECT {hashed} AS question_id, {subject} AS subject, question AS question_text, CAST({{index}} AS VARCHAR) AS correct_index, {gold} AS correct_option, choices[answer + 1] AS correct_answer_text, CAST(len(choices) AS INT) AS n_choices,
  {problem} AS problem FROM eval_items"""

    outside = "CASE WHEN answer IS NULL OR answer < 0 OR answer >= len(choices) THEN 'gold index out of range' END"
    return {
        "direct_client": smallest,
        "shuffled_client": smallest,
        "cyclic_client": smallest,
        "stage_two_client": smallest,
        "cached_client": smallest,
        "two_stage_client": f"{one} SELECT question_id, 'no options were shown' AS free_text_response, FALSE AS fallback_used, chosen_text FROM a",
        "resumed_client": """WITH q AS (SELECT DISTINCT question_id, question_id IN (SELECT question_id FROM agreement_input WHERE question_id IS NOT NULL) AS held FROM toy_normalized WHERE question_id IS NOT NULL)
SELECT held, count(*) AS n, count(*) AS n_questions FROM q GROUP BY held""",
        "batch_replies": """SELECT CASE WHEN length(question) % 5 = 0 THEN 'failure' ELSE 'success' END AS status, CASE WHEN length(question) % 5 <> 0 THEN 'Answer to ' || length(question) END AS raw_text,
  CASE WHEN length(question) % 5 = 0 THEN 'too busy' END AS error_message, count(DISTINCT question) AS n FROM eval_items GROUP BY ALL""",
        "normalize_mmlu": item("subject", f"CASE WHEN len(choices) <> 4 THEN 'not four options' ELSE {outside} END").format(index="answer"),
        "normalize_arc": item("'science'", "CASE WHEN answer IS NULL OR answer >= len(choices) THEN 'answer key not among the labels' END").format(index="answer"),
        "normalize_pro": item("subject", outside).format(index="answer"),
        "normalize_hellaswag": item("subject", f"CASE WHEN len(choices) <> 4 THEN 'not four endings' ELSE {outside} END").format(index="answer"),
        "normalize_truthful": item("'truthfulness'", "CASE WHEN answer IS NULL OR answer >= len(choices) THEN 'no option is marked' END").format(index="coalesce(answer, -1)"),
        "reparsed_answers": f"""WITH {Q._Q}, {Q._ONE}, m AS (SELECT *, CASE WHEN ordinal % 3 = 2 THEN chr(CAST(64 + n_choices AS INT)) ELSE 'A' END AS c, coalesce(nullif(upper(trim(correct_option)), ''), chr(65 + correct_index), '') AS gold FROM o)
SELECT question_id, CASE WHEN ordinal % 3 = 0 THEN 'two_stage' ELSE 'direct_mcq' END AS method_name, c AS parsed_choice, ordinal % 3 = 2 AND c = gold AS is_correct FROM m""",
        "derived_answers": f"""{one}, t AS (SELECT question_id, lower({Q._WS.format("correct_answer_text")}) AS g, [lower(z.text) FOR z IN opts] AS os FROM a),
h AS (SELECT *, [x FOR x IN os IF x = g] AS e, [x FOR x IN os IF length(x) >= 4 AND (contains(g, x) OR (contains(x, g) AND length(g) >= 4))] AS c FROM t)
SELECT question_id, CASE WHEN coalesce(g, '') = '' THEN NULL WHEN len(e) > 0 THEN e[1] WHEN len(c) = 1 THEN c[1] END AS matched_text, 'two_stage' AS derived_from_method_name FROM h""",
        "hypothesis_prompts": f"{one}, e AS (SELECT question_id, question_text, unnest(opts) AS z FROM a) SELECT question_id, z.label AS label, 'Question: ' || coalesce(question_text, '') || chr(10) || 'Proposed answer: ' || z.text || chr(10) || chr(10) || 'Is it right?' AS prompt FROM e",
        "semantic_groups": f"WITH {Q._Q} SELECT min(ordinal) AS first_ordinal, count(*) AS n FROM q GROUP BY lower({Q._SQ.format("replace(question_text, '…', '...')")}), list_sort([lower({Q._SQ.format("replace(x, '…', '...')")}) FOR x IN texts])",
        "debiased_choices": f"WITH {M._LOGITS} SELECT question_id, {M._ARG.format(v='[obs[j] / ([0.4, 0.3, 0.2, 0.1])[j] FOR j IN [1,2,3,4]]')} AS choice FROM g",
        "direct_logprob_scores": f"WITH {M._LOGITS}, t AS (SELECT question_id, gi, {M._ARG.format(v='obs')} AS c FROM g) SELECT question_id, c AS parsed_choice, c = chr(CAST(65 + gi AS INT)) AS is_correct FROM t",
        "cyclic_logprob_scores": f"WITH {M._LOGITS}, t AS (SELECT question_id, gi, {M._ARG.format(v='content')} AS c FROM g) SELECT question_id, c AS parsed_choice, c = chr(CAST(65 + gi AS INT)) AS is_correct, 4 AS n_permutations_total FROM t",
        "pride_logits": f"""WITH {M._LOGITS}, c AS (SELECT prior FROM g ORDER BY sha256('42|' || question_id) LIMIT 100), pr AS (SELECT [avg(prior[1]), avg(prior[2]), avg(prior[3]), avg(prior[4])] AS gp FROM c),
t AS (SELECT question_id, gi, {M._ARG.format(v="[obs[j] / gp[j] FOR j IN [1,2,3,4]]")} AS choice FROM g, pr)
SELECT question_id, choice AS adjusted_choice, choice = chr(CAST(65 + gi AS INT)) AS is_correct, count(*) OVER () AS n_evaluated FROM t""",
        "parsed_matrices": f"""WITH {M._LOGITS}, k AS (SELECT *, CAST(question_id AS BIGINT) % 9 IN (0, 3, 6) AS bad FROM g)
SELECT question_id, NOT bad AS usable, CASE WHEN NOT bad THEN 4 ELSE -1 END AS n_rows, CASE WHEN NOT bad THEN round(list_sum(p[1]), 6) END AS first_sum FROM k""",
        "grid_excluded": """WITH v AS (SELECT vec_id % 3 <> 0 AS d, vec_id % 5 <> 0 AS c, vec_id % 7 = 0 AS f FROM embeddings)
SELECT count(*) FILTER (d AND NOT c) AS only_direct, count(*) FILTER (c AND NOT d) AS only_cyclic, count(*) FILTER (d AND c AND f) AS unusable FROM v""",
        "grid_comparison": f"""WITH {M._LOGITS}, a AS (SELECT chr(CAST(65 + gi AS INT)) AS gold, {M._ARG.format(v="obs")} AS d, {M._ARG.format(v="content")} AS c FROM g),
o AS (SELECT 'default' AS name, round(100.0 * avg(CASE WHEN d = gold THEN 1 ELSE 0 END), 5) AS ours FROM a UNION ALL SELECT 'cyclic', round(100.0 * avg(CASE WHEN c = gold THEN 1 ELSE 0 END), 5) FROM a)
SELECT name, target, ours, round(ours - target, 5) AS difference FROM (VALUES ('default', 25.0::DOUBLE), ('cyclic', 30.0::DOUBLE), ('absent', 50.0::DOUBLE)) AS t(name, target) LEFT JOIN o USING (name)""",
        "cosine_best": """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
s AS (SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS k, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 4),
m AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS best FROM s)
SELECT vec_id, coalesce(string_agg(chr(CAST(64 + k AS INT)), ',' ORDER BY k) FILTER (s = best AND best >= 0.3), '') AS labels FROM m GROUP BY vec_id""",
        "dataset_roundtrip": f"SELECT CAST(item_id AS VARCHAR) AS question_id, subject, question AS question_text, array_to_string(choices, '|') AS options, {gold} AS correct_option, (SELECT count(*) FROM eval_items) AS artifact_rows FROM eval_items",
        "evaluation_run": f"""WITH t AS (SELECT answer, [{Q._SQ.format("c")} FOR c IN choices] AS os FROM eval_items), h AS (SELECT coalesce(os[answer + 1] = list_min(os), FALSE) AS hit FROM t)
SELECT unnest(['direct_mcq', 'cyclic_permutation']) AS condition_id, count(*) AS n_total, count(*) AS n_scored, count(*) FILTER (hit) AS n_correct, round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM h""",
    }


ORACLE_SQL = _oracle()
