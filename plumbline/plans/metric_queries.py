"""Queries of metrics, votes, vectors and the debiasing grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import grid, metrics, voting
from plumbline.plans import lenses
from plumbline.sources.scratch import Scratch
from plumbline.sources.tables import table

BY = ["method_name", "model_name"]
#: The published grid.
ALPHAS, SEEDS = [0.05, 0.4, 0.8], [0, 1, 2, 3, 4]


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def accuracy_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.accuracy(lenses.results(spark, folder), BY), "accuracy", "accuracy_conditional")


def accuracy_ci(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.accuracy_intervals(lenses.results(spark, folder), BY), "accuracy", "accuracy_conditional", "ci_low", "ci_high", "conditional_ci_low", "conditional_ci_high")


def mad_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.mad(lenses.results(spark, folder), BY), "mad")


def mad_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mad_bootstrap(lenses.results(spark, folder), BY)


def recall_by_letter(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.recalls(lenses.results(spark, folder), BY), "recall")


def recall_rstd(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.recall_rstd(lenses.results(spark, folder), BY), "rstd")


def order_sensitivity_letters(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.order_sensitivity_letters(lenses.rotation_traces(spark, folder), []), "order_rstd", "order_flip_rate")


def order_sensitivity_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = lenses.logits(spark, folder).select("question_id", "correct_index", F.col("matrix").alias("option_distributions"))
    return _rounded(metrics.order_sensitivity_matrix(rows, []), "order_rstd", "order_flip_rate")


def agreement_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.agreement(table(spark, folder, "agreement_input"), ["question_id"], ["condition_id"]), "agreement_rate")


def agreement_overall(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.agreement(table(spark, folder, "agreement_input"), ["question_id", "condition_id"], []), "agreement_rate")


def transport_health(spark: SparkSession, folder: str) -> DataFrame:
    health = metrics.transport_health(table(spark, folder, "model_responses"), ["provider", "model_name"], F.col("status") == "failure")
    return _rounded(health, "failed_fraction")


def status_report(spark: SparkSession, folder: str) -> DataFrame:
    health = metrics.transport_health(table(spark, folder, "model_responses"), ["provider", "model_name", "finish_reason"], F.col("status") == "failure")
    return metrics.status_report(health)


def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.evaluate(lenses.results(spark, folder), BY), "accuracy", "accuracy_conditional", "mad", "rstd")


def vote_counts(spark: SparkSession, folder: str) -> DataFrame:
    return voting.vote_counts(table(spark, folder, "agreement_input"), ["question_id", "condition_id"], "parsed_choice")


def vote_leaders(spark: SparkSession, folder: str) -> DataFrame:
    led = voting.leaders(table(spark, folder, "agreement_input"), ["question_id", "condition_id"], "parsed_choice")
    return led.select("question_id", "condition_id", "votes", F.array_join("tied", ",").alias("tied"))


def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    return voting.majority(table(spark, folder, "agreement_input"), ["question_id", "condition_id"], "parsed_choice", F.col("condition_id"), F.col("question_id"), 42, "majority")


def majority_clear(spark: SparkSession, folder: str) -> DataFrame:
    """Winners of the votes without a tie, and for the others how many letters share the lead."""
    return majority_vote(spark, folder).select("question_id", "condition_id", "votes", "n_tied", F.when(F.col("n_tied") == 1, F.col("winner")).alias("winner"))


def paired_flips(spark: SparkSession, folder: str) -> DataFrame:
    rows = lenses.logits(spark, folder)
    answers = rows.select("question_id", "correct_option", F.char(V.first_max(F.col("observed")) + 65).alias("a"), F.char(V.first_max(V.content_probabilities(F.col("matrix"))) + 65).alias("b"))
    return metrics.paired(answers, "question_id", "correct_option", "a", "b")


def _vector(df: DataFrame, v) -> DataFrame:
    return df.select("question_id", F.posexplode(v).alias("position", "p")).select("question_id", "position", F.round("p", 6).alias("p"))


def eq1_content(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(lenses.logits(spark, folder), V.content_probabilities(F.col("matrix")))


def eq7_prior(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(lenses.logits(spark, folder), V.prior_from_rollouts(F.col("matrix")))


def eq8_debiased(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(lenses.logits(spark, folder), V.debiased(F.col("observed"), V.prior_from_rollouts(F.col("matrix"))))


def global_prior(spark: SparkSession, folder: str) -> DataFrame:
    from plumbline.operators.methods import global_prior as prior

    one = prior(lenses.logits(spark, folder).select(F.col("matrix").alias("option_distributions")))
    return one.select(F.explode("peprior").alias("letter", "p")).select("letter", F.round("p", 6).alias("p"))


def logprob_choices(spark: SparkSession, folder: str) -> DataFrame:
    rows = lenses.logits(spark, folder)
    return rows.select(
        "question_id", F.char(V.first_max(F.col("observed")) + 65).alias("direct"), F.char(V.first_max(V.content_probabilities(F.col("matrix"))) + 65).alias("cyclic"), V.top_two_tie(F.col("observed")).alias("top_two_tie")
    )


def paired_token_forms(spark: SparkSession, folder: str) -> DataFrame:
    wide = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("question_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return _vector(wide, V.paired_forms(F.col("v")))


def cosine_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "embeddings")
    after = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return t.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 4).alias("similarity"))


def grid_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = lenses.logits(spark, folder)
    side = lambda m: rows.select("question_id", "correct_option", F.lit("success").alias("answer_status"), m.alias("option_distributions"))
    # Prepared once: every cell of the grid reads the written vectors.
    return Scratch(spark).keep(grid.ranked(grid.records(side(F.array("observed")), side(F.col("matrix"))), SEEDS), "records")


def debias_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: every (alpha, seed) cell of the offline debiasing grid with its metrics."""
    recs = grid_records(spark, folder)
    return _rounded(grid.cell_metrics(grid.hashed_answers(recs, ALPHAS, SEEDS), ["alpha", "seed"]), "accuracy", "rstd", "mad", digits=5)


def debias_by_alpha(spark: SparkSession, folder: str) -> DataFrame:
    recs = grid_records(spark, folder)
    measured = grid.cell_metrics(grid.hashed_answers(recs, ALPHAS, SEEDS), ["alpha", "seed"])
    return _rounded(grid.by_alpha(measured), *[f"{m}_{s}" for m in ("accuracy", "rstd", "mad") for s in ("mean", "std")], digits=5)


def debias_baselines(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(grid.cell_metrics(grid.baselines(grid_records(spark, folder)), ["method"]), "accuracy", "rstd", "mad", digits=5)


_RESULTS = """r AS (SELECT CAST(l_orderkey AS VARCHAR) AS question_id, l_returnflag AS method_name, l_linestatus AS model_name, chr(CAST(65 + l_orderkey % 4 AS INT)) AS gold,
  CASE WHEN l_suppkey % 10 <> 0 THEN chr(CAST(65 + l_partkey % 4 AS INT)) END AS answer FROM lineitem)"""
_MAD = """labels AS (SELECT DISTINCT method_name, model_name, unnest([gold, answer]) AS l FROM r), s AS (SELECT * FROM r WHERE answer IS NOT NULL),
n AS (SELECT method_name, model_name, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT l.method_name, l.model_name, l.l, (SELECT count(*) FROM s WHERE s.method_name = l.method_name AND s.model_name = l.model_name AND s.answer = l.l) AS a,
  (SELECT count(*) FROM s WHERE s.method_name = l.method_name AND s.model_name = l.model_name AND s.gold = l.l) AS g FROM labels l WHERE l.l IS NOT NULL),
mad AS (SELECT method_name, model_name, avg(abs(100.0 * a / n - 100.0 * g / n)) AS mad FROM p JOIN n USING (method_name, model_name) GROUP BY ALL)"""
_RECALL = """rec AS (SELECT method_name, model_name, gold AS letter, count(answer) AS n, CASE WHEN count(answer) > 0 THEN 100.0 * count(*) FILTER (answer = gold) / count(answer) END AS recall FROM r GROUP BY ALL)"""
_ACC = """acc AS (SELECT method_name, model_name, count(*) AS n_total, count(answer) AS n_scored, count(*) FILTER (answer = gold) AS n_correct,
  round(count(*) FILTER (answer = gold) / count(*), 6) AS accuracy, round(count(*) FILTER (answer = gold) / count(answer), 6) AS accuracy_conditional FROM r GROUP BY ALL)"""
_SOFT = "[x / list_sum({v}) FOR x IN {v}]"
_LOGITS = """e AS (SELECT CAST(vec_id AS VARCHAR) AS question_id, vec_id % 4 AS gi, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
x AS (SELECT question_id, gi, [[exp(y) FOR y IN v[4*k+1:4*k+4]] FOR k IN [0,1,2,3,4]] AS ex FROM e),
m AS (SELECT question_id, gi, [[y / list_sum(row) FOR y IN row] FOR row IN ex] AS p FROM x),
l AS (SELECT question_id, gi, p[5] AS obs, [(p[1][c+1] + p[2][(c+3)%4+1] + p[3][(c+2)%4+1] + p[4][(c+1)%4+1]) / 4 FOR c IN [0,1,2,3]] AS content,
  [exp((ln(p[1][j]) + ln(p[2][j]) + ln(p[3][j]) + ln(p[4][j])) / 4) FOR j IN [1,2,3,4]] AS geo, p FROM m),
f AS (SELECT question_id, gi, p, obs, [y / list_sum(content) FOR y IN content] AS content, [y / list_sum(geo) FOR y IN geo] AS prior FROM l),
g AS (SELECT *, [obs[j] / prior[j] FOR j IN [1,2,3,4]] AS ratio FROM f)"""
_UNNEST = "SELECT question_id, CAST(i AS INT) AS position, round(({v})[i + 1], 6) AS p FROM g, unnest([0,1,2,3]) AS t(i)"
_ARG = "chr(CAST(64 + list_position({v}, list_max({v})) AS INT))"
_CELLS = f"""cells AS (SELECT alpha, seed, question_id FROM (
  SELECT alpha, seed, question_id, row_number() OVER (PARTITION BY alpha, seed ORDER BY sha256(seed || '|' || question_id)) AS rk, count(*) OVER (PARTITION BY alpha, seed) AS n
  FROM g, (SELECT CAST(unnest({ALPHAS}) AS DOUBLE) AS alpha) a, (SELECT CAST(unnest({SEEDS}) AS INT) AS seed) s) WHERE rk <= floor(alpha * n)),
pr AS (SELECT alpha, seed, [avg(prior[1]), avg(prior[2]), avg(prior[3]), avg(prior[4])] AS gp FROM cells JOIN g USING (question_id) GROUP BY ALL),
ans AS (SELECT pr.alpha, pr.seed, g.question_id, chr(CAST(65 + gi AS INT)) AS gold,
  CASE WHEN c.question_id IS NOT NULL THEN {_ARG.format(v="content")} ELSE {_ARG.format(v="[obs[j] / gp[j] FOR j IN [1,2,3,4]]")} END AS answer
  FROM pr CROSS JOIN g LEFT JOIN cells c ON c.alpha = pr.alpha AND c.seed = pr.seed AND c.question_id = g.question_id)"""


def _cell_sql(source: str, keys: str) -> str:
    return f"""a1 AS (SELECT {keys}, count(*) AS n_questions, 100.0 * count(*) FILTER (answer = gold) / count(*) AS accuracy FROM {source} GROUP BY ALL),
r1 AS (SELECT {keys}, stddev_pop(rec) AS rstd FROM (SELECT {keys}, gold, 100.0 * count(*) FILTER (answer = gold) / count(*) AS rec FROM {source} GROUP BY ALL) GROUP BY ALL),
d1 AS (SELECT {keys}, l, sum(d) AS d FROM (SELECT {keys}, answer AS l, 1 AS d FROM {source} UNION ALL SELECT {keys}, gold, -1 FROM {source}) GROUP BY ALL),
m1 AS (SELECT {keys}, 100.0 * avg(abs(d)) AS madn FROM d1 GROUP BY ALL),
cm AS (SELECT {keys}, n_questions, accuracy, rstd, madn / n_questions AS mad FROM a1 JOIN r1 USING ({keys}) JOIN m1 USING ({keys}))"""


_ORDER = """pos AS (SELECT position, avg(hit) AS rec FROM picks GROUP BY position), fl AS (SELECT question_id, CASE WHEN min(canon) <> max(canon) THEN 1.0 ELSE 0.0 END AS f FROM picks GROUP BY question_id)
SELECT round(CASE WHEN (SELECT count(*) FROM pos) > 1 THEN (SELECT stddev_pop(rec) FROM pos) ELSE 0.0 END, 6) AS order_rstd, round((SELECT avg(f) FROM fl), 6) AS order_flip_rate, (SELECT count(*) FROM fl) AS n_questions"""
_LINES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

QUERIES = {
    f.__name__: f
    for f in (
        accuracy_by_condition, accuracy_ci, mad_by_condition, mad_bootstrap, recall_by_letter, recall_rstd, order_sensitivity_letters, order_sensitivity_matrix, agreement_rate, agreement_overall, transport_health,
        status_report, evaluation_report, vote_counts, vote_leaders, majority_vote, majority_clear, paired_flips, eq1_content, eq7_prior, eq8_debiased, global_prior, logprob_choices, paired_token_forms, cosine_neighbours, debias_grid,
        debias_by_alpha, debias_baselines,
    )
}

_AGREE = """g AS (SELECT question_id, condition_id, count(*) AS n, count(parsed_choice) AS a, count(DISTINCT parsed_choice) AS d FROM agreement_input GROUP BY ALL HAVING count(*) >= 2),
u AS (SELECT *, (a = 0 OR (a = n AND d = 1)) AS same FROM g)"""
_AGREE_OUT = "count(*) AS n_groups, count(*) FILTER (same) AS n_unanimous, count(*) FILTER (a = 0) AS n_fully_missing, round(count(*) FILTER (same) / count(*), 6) AS agreement_rate FROM u"
_HEALTH = "count(*) AS n_total, count(*) FILTER (status = 'failure') AS n_failed"
_VOTES = "v AS (SELECT question_id, condition_id, parsed_choice, count(*) AS votes FROM agreement_input WHERE parsed_choice IS NOT NULL GROUP BY ALL)"

def _interval(k: str, n: str, lower: bool) -> str:
    """Binomial tail at the middle of (lo, hi), and whether the bound lies above it."""
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln((lo + hi) / 2) + ({n} - i) * ln(1 - (lo + hi) / 2))"
    tail = f"list_sum([{term} FOR i IN range({k}, {n} + 1)])" if lower else f"list_sum([{term} FOR i IN range(0, {k} + 1)])"
    return f"{tail} < 0.025" if lower else f"{tail} > 0.025"


_CI = f"""bounds(method_name, model_name, kind, k, n, lo, hi, step) AS (
  SELECT method_name, model_name, kind, n_correct, CASE WHEN kind < 2 THEN n_total ELSE n_scored END, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM acc, (SELECT unnest([0, 1, 2, 3]) AS kind)
  UNION ALL SELECT method_name, model_name, kind, k, n, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END, step + 1
  FROM (SELECT *, CASE WHEN kind % 2 = 0 THEN {_interval("k", "n", True)} ELSE {_interval("k", "n", False)} END AS up FROM bounds WHERE step < 34)),
ci AS (SELECT method_name, model_name, kind, CASE WHEN n = 0 THEN NULL WHEN kind % 2 = 0 AND k = 0 THEN 0 WHEN kind % 2 = 1 AND k = n THEN 1 ELSE (lo + hi) / 2 END AS b FROM bounds WHERE step = 34)"""
_BOUND = "(SELECT round(b, 6) FROM ci WHERE ci.method_name = acc.method_name AND ci.model_name = acc.model_name AND kind = {0})"

ORACLE_SQL = {
    "accuracy_ci": f"WITH RECURSIVE {_RESULTS}, {_ACC}, {_CI} SELECT *, {_BOUND.format(0)} AS ci_low, {_BOUND.format(1)} AS ci_high, {_BOUND.format(2)} AS conditional_ci_low, {_BOUND.format(3)} AS conditional_ci_high FROM acc",
    "accuracy_by_condition": f"WITH {_RESULTS}, {_ACC} SELECT * FROM acc",
    "mad_by_condition": f"WITH {_RESULTS}, {_MAD} SELECT method_name, model_name, round(mad, 6) AS mad FROM mad",
    "recall_by_letter": f"WITH {_RESULTS}, {_RECALL} SELECT method_name, model_name, letter, n, round(recall, 6) AS recall FROM rec",
    "recall_rstd": f"WITH {_RESULTS}, {_RECALL} SELECT method_name, model_name, round(stddev_pop(recall), 6) AS rstd FROM rec GROUP BY ALL",
    "evaluation_report": f"""WITH {_RESULTS}, {_ACC}, {_MAD}, {_RECALL}, rs AS (SELECT method_name, model_name, round(stddev_pop(recall), 6) AS rstd FROM rec GROUP BY ALL)
SELECT acc.*, round(mad.mad, 6) AS mad, rs.rstd FROM acc JOIN mad USING (method_name, model_name) JOIN rs USING (method_name, model_name)""",
    "order_sensitivity_letters": f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
picks AS (SELECT l_orderkey AS question_id, ((l_orderkey % n) - k + n) % n AS position, l_partkey % n AS canon, CASE WHEN l_partkey % n = l_orderkey % n THEN 1.0 ELSE 0.0 END AS hit FROM t WHERE n >= 2 AND l_suppkey % 10 <> 0), {_ORDER}""",
    "order_sensitivity_matrix": f"""WITH {_LOGITS}, picks AS (SELECT question_id, (gi - k + 4) % 4 AS position, (list_position(p[k + 1], list_max(p[k + 1])) - 1 + k) % 4 AS canon,
  CASE WHEN (list_position(p[k + 1], list_max(p[k + 1])) - 1 + k) % 4 = gi THEN 1.0 ELSE 0.0 END AS hit FROM g, unnest([0,1,2,3]) AS t(k)), {_ORDER}""",
    "agreement_rate": f"WITH {_AGREE} SELECT condition_id, {_AGREE_OUT} GROUP BY condition_id",
    "agreement_overall": f"WITH {_AGREE} SELECT {_AGREE_OUT}",
    "transport_health": f"SELECT provider, model_name, {_HEALTH}, round(count(*) FILTER (status = 'failure') / count(*), 6) AS failed_fraction, CASE WHEN count(*) FILTER (status = 'failure') / count(*) >= 0.5 THEN 'infra_failure' ELSE 'completed' END AS status FROM model_responses GROUP BY provider, model_name",
    "status_report": """WITH h AS (SELECT provider, model_name, finish_reason, CASE WHEN count(*) FILTER (status = 'failure') / count(*) >= 0.5 THEN 'infra_failure' ELSE 'completed' END AS s FROM model_responses GROUP BY ALL)
SELECT CAST(0 AS BIGINT) AS n_pending, count(*) FILTER (s = 'completed') AS n_completed, CAST(0 AS BIGINT) AS n_failed, CAST(0 AS BIGINT) AS n_gated, count(*) FILTER (s = 'infra_failure') AS n_infra_failure, count(*) FILTER (s = 'infra_failure') = 0 AS complete FROM h""",
    "vote_counts": f"WITH {_VOTES} SELECT * FROM v",
    "vote_leaders": f"""WITH {_VOTES}, w AS (SELECT *, max(votes) OVER (PARTITION BY question_id, condition_id) AS top FROM v)
SELECT question_id, condition_id, top AS votes, string_agg(parsed_choice, ',' ORDER BY parsed_choice) AS tied FROM w WHERE votes = top GROUP BY ALL""",
    "majority_clear": f"""WITH {_VOTES}, w AS (SELECT *, max(votes) OVER (PARTITION BY question_id, condition_id) AS top FROM v)
SELECT question_id, condition_id, top AS votes, CAST(count(*) AS INT) AS n_tied, CASE WHEN count(*) = 1 THEN max(parsed_choice) END AS winner FROM w WHERE votes = top GROUP BY ALL""",
    "paired_flips": f"""WITH {_LOGITS}, a AS (SELECT {_ARG.format(v="obs")} AS a, {_ARG.format(v="content")} AS b, chr(CAST(65 + gi AS INT)) AS gold FROM g)
SELECT count(*) AS n_pairs, count(*) FILTER (a <> b) AS flips, count(*) FILTER (a = gold AND b <> gold) AS right_to_wrong, count(*) FILTER (a <> gold AND b = gold) AS wrong_to_right, count(*) FILTER (a <> b AND a <> gold AND b <> gold) AS both_wrong_different FROM a""",
    "eq1_content": f"WITH {_LOGITS} {_UNNEST.format(v='content')}",
    "eq7_prior": f"WITH {_LOGITS} {_UNNEST.format(v='prior')}",
    "eq8_debiased": f"WITH {_LOGITS} {_UNNEST.format(v='[y / list_sum(ratio) FOR y IN ratio]')}",
    "global_prior": f"WITH {_LOGITS} SELECT chr(CAST(65 + i AS INT)) AS letter, round(avg(prior[i + 1]), 6) AS p FROM g, unnest([0,1,2,3]) AS t(i) GROUP BY i",
    "logprob_choices": f"WITH {_LOGITS} SELECT question_id, {_ARG.format(v='obs')} AS direct, {_ARG.format(v='content')} AS cyclic, list_sort(obs)[4] = list_sort(obs)[3] AS top_two_tie FROM g",
    "paired_token_forms": """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS question_id, [exp(CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings)
SELECT question_id, CAST(i AS INT) AS position, round((v[i + 1] + v[i + 1 + len(v) // 2]) / list_sum(v), 6) AS p FROM (SELECT *, unnest(range(0, len(v) // 2)) AS i FROM e)""",
    "cosine_neighbours": """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""",
    "debias_grid": f"WITH {_LOGITS}, {_CELLS}, {_cell_sql('ans', 'alpha, seed')} SELECT alpha, seed, n_questions, round(accuracy, 5) AS accuracy, round(rstd, 5) AS rstd, round(mad, 5) AS mad FROM cm",
    "debias_by_alpha": f"""WITH {_LOGITS}, {_CELLS}, {_cell_sql('ans', 'alpha, seed')} SELECT alpha, count(*) AS n_seeds,
{", ".join(f"round({fn}({m}), 5) AS {m}_{s}" for m in ("accuracy", "rstd", "mad") for fn, s in (("avg", "mean"), ("stddev_pop", "std")))} FROM cm GROUP BY alpha""",
    "debias_baselines": f"""WITH {_LOGITS}, b AS (SELECT 'default' AS method, chr(CAST(65 + gi AS INT)) AS gold, {_ARG.format(v="obs")} AS answer FROM g UNION ALL SELECT 'cyclic', chr(CAST(65 + gi AS INT)), {_ARG.format(v="content")} FROM g),
{_cell_sql('b', 'method')} SELECT method, n_questions, round(accuracy, 5) AS accuracy, round(rstd, 5) AS rstd, round(mad, 5) AS mad FROM cm""",
}
