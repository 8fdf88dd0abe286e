"""The offline debiasing grid: join direct and cyclic records, calibrate for every (alpha, seed), answer, measure.

The grid is rows, not a loop: each record meets every calibration cell and all cells are evaluated by the same
grouped aggregations. Records are prepared once (Eq. 1 and Eq. 7 vectors) and reused by every cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import vectors as V
from plumbline.operators import metrics as M
from plumbline.operators.selection import alpha_ids, hash_rank


def records(direct: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(question_id, n, labels, correct_option, observed, content, prior) of questions with usable rows in both.

    Both sides are (question_id, correct_option, answer_status, option_distributions). Failed, one-sided and
    misshapen questions are left out; different gold letters of one question are an error.
    """
    d = direct.where((F.col("answer_status") == "success") & (F.size("option_distributions") == 1)).select("question_id", F.col("correct_option").alias("gold"), F.get("option_distributions", F.lit(0)).alias("observed"))
    c = cyclic.where((F.col("answer_status") == "success") & V.square(F.col("option_distributions"))).select("question_id", "correct_option", F.col("option_distributions").alias("m"))
    both = d.join(c, "question_id").where(F.size("observed") == F.size("m"))
    checked = both.withColumn("__ok", F.coalesce(F.assert_true(F.col("gold") == F.col("correct_option"), "gold letters differ").isNull(), F.lit(True))).where("__ok")
    n = F.size("m")
    labels = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(i + 65))
    return (
        checked.withColumn("n", n)
        .withColumn("labels", labels)
        .where(F.array_contains("labels", F.col("correct_option")))
        .select("question_id", "n", "labels", "correct_option", "observed", V.content_probabilities(F.col("m")).alias("content"), V.prior_from_rollouts(F.col("m")).alias("prior"))
    )


def excluded(direct: DataFrame, cyclic: DataFrame, used: DataFrame) -> DataFrame:
    """One row: questions only in one input, and questions in both that were not usable."""
    sides = direct.select("question_id", F.lit(1).alias("d"), F.lit(0).alias("c")).unionByName(cyclic.select("question_id", F.lit(0).alias("d"), F.lit(1).alias("c")))
    marked = sides.groupBy("question_id").agg(F.max("d").alias("d"), F.max("c").alias("c")).join(used.select("question_id", F.lit(1).alias("u")), "question_id", "left")
    return marked.agg(
        F.count_if((F.col("d") == 1) & (F.col("c") == 0)).alias("only_direct"), F.count_if((F.col("d") == 0) & (F.col("c") == 1)).alias("only_cyclic"), F.count_if((F.col("d") == 1) & (F.col("c") == 1) & F.col("u").isNull()).alias("unusable")
    )


def exact_cells(ids: list[str], alphas: list[float], seeds: list[int]) -> list[tuple[float, int, str]]:
    """Calibration rows (alpha, seed, question_id) by the reference generator; repeated alphas or seeds are errors."""
    if len(set(alphas)) != len(alphas) or len(set(seeds)) != len(seeds):
        raise ValueError("alphas and seeds must not repeat")
    return [(a, s, q) for a in alphas for s in seeds for q in alpha_ids(ids, a, s)]


def ranked(recs: DataFrame, seeds: list[int]) -> DataFrame:
    """``recs`` plus ranks: the hash rank of the question under each seed, in their order."""
    return recs.withColumn("ranks", F.array(*[hash_rank(F.col("question_id"), s) for s in seeds]))


def rank_cutoffs(ranks: DataFrame, alphas: list[float], seeds: list[int], buckets: int = 65_536) -> list[tuple[float, int, str]]:
    """(alpha, seed, largest rank) of the calibration questions: the floor(alpha * N) smallest ranks of each seed.

    ``ranks`` is (ranks array in the order of ``seeds``). Histograms of the ranks' first digits give the bucket that holds
    each cut-off; only the ranks of those buckets are ordered. What reaches the driver is one row for each cell.
    """
    if len(set(alphas)) != len(alphas) or len(set(seeds)) != len(seeds):
        raise ValueError("alphas and seeds must not repeat")
    spark = ranks.sparkSession
    each = ranks.select(F.posexplode("ranks").alias("s", "rank")).withColumn("bucket", F.floor(F.conv(F.substring("rank", 1, 4), 16, 10).cast("double") * (buckets / 65_536)).cast("int"))
    counts = each.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_seed = Window.partitionBy("s")
    upto = counts.select("s", "bucket", "n", F.sum("n").over(by_seed.orderBy("bucket")).alias("upto"), F.sum("n").over(by_seed).alias("total"))
    wanted = spark.createDataFrame([(i, float(a)) for i, a in enumerate(alphas)], "a int, alpha double")
    cells = upto.crossJoin(F.broadcast(wanted)).withColumn("goal", F.floor(F.col("alpha") * F.col("total")))
    holding = cells.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("n") < F.col("goal"))).select("s", "a", "bucket", (F.col("goal") - F.col("upto") + F.col("n")).alias("place"))
    near = each.join(F.broadcast(holding), ["s", "bucket"])
    placed = near.withColumn("at", F.row_number().over(Window.partitionBy("s", "a").orderBy("rank"))).where(F.col("at") == F.col("place"))
    found = [(alphas[r["a"]], seeds[r["s"]], r["rank"]) for r in placed.select("a", "s", "rank").collect()]
    if len(found) != len(alphas) * len(seeds):
        raise ValueError("alpha gives no calibration question")
    return sorted(found)


def _in_cells(recs: DataFrame, cutoffs: list[tuple[float, int, str]], seeds: list[int]) -> DataFrame:
    """One row for each record and cell: alpha, seed, calibrated."""
    cells = [F.struct(F.lit(float(a)).alias("alpha"), F.lit(s).alias("seed"), (F.get("ranks", F.lit(seeds.index(s))) <= F.lit(cut)).alias("calibrated")) for a, s, cut in cutoffs]
    return recs.select("*", F.explode(F.array(*cells)).alias("cell")).select("*", "cell.*").drop("cell", "ranks")


def _answered(rows: DataFrame) -> DataFrame:
    """(alpha, seed, question_id, correct_option, parsed_choice) of records in cells: calibration questions by Eq. 1, all others by Eq. 8."""
    each = rows.where("calibrated").select("alpha", "seed", "n", F.posexplode("prior").alias("j", "p")).groupBy("alpha", "seed", "n", "j").agg(F.avg("p").alias("p"))
    ordered = each.groupBy("alpha", "seed", "n").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("v"))
    # One short vector for each cell and option count.
    prior = ordered.select("alpha", "seed", "n", V.normalised(V.clipped(F.transform("v", lambda x: x["p"]))).alias("global_prior"))
    every = rows.join(F.broadcast(prior), ["alpha", "seed", "n"])
    chosen = F.when(F.col("calibrated"), V.first_max(F.col("content"))).otherwise(V.first_max(V.debiased(F.col("observed"), F.col("global_prior"))))
    return every.select("alpha", "seed", "question_id", "correct_option", F.get("labels", chosen).alias("parsed_choice"))


def answers(recs: DataFrame, cells: DataFrame) -> DataFrame:
    """Answers in all cells, whose calibration questions are listed: ``cells`` is (alpha, seed, question_id)."""
    every = recs.crossJoin(F.broadcast(cells.select("alpha", "seed").distinct()))
    return _answered(every.join(cells.withColumn("calibrated", F.lit(True)), ["alpha", "seed", "question_id"], "left").withColumn("calibrated", F.coalesce("calibrated", F.lit(False))))


def hashed_answers(recs: DataFrame, alphas: list[float], seeds: list[int]) -> DataFrame:
    """The same with the floor(alpha * N) questions of the smallest hash ranks of each seed as calibration.

    ``recs`` holds ``ranks`` (see :func:`ranked`) and is read several times, so give a written table. A question's part
    in a cell is told by its rank and the cell's cut-off, so no records are shuffled.
    """
    return _answered(_in_cells(recs, rank_cutoffs(recs.select("ranks"), alphas, seeds), seeds))


def baselines(recs: DataFrame) -> DataFrame:
    """(method, question_id, correct_option, parsed_choice) of the plain and the content-average answers."""
    one = recs.select(F.explode(F.array(F.struct(F.lit("default").alias("method"), F.get("labels", V.first_max(F.col("observed"))).alias("a")), F.struct(F.lit("cyclic").alias("method"), F.get("labels", V.first_max(F.col("content"))).alias("a")))).alias("r"), "question_id", "correct_option")
    return one.select("r.method", "question_id", "correct_option", F.col("r.a").alias("parsed_choice"))


def one_option_count(recs: DataFrame) -> DataFrame:
    """The records, if all have one option count; mixed counts are an error."""
    if recs.select("n").distinct().limit(2).count() > 1:
        raise ValueError("records have different option counts")
    return recs


def cell_metrics(answered: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_questions, accuracy, rstd, mad) of each cell; percentages."""
    every = M.letter_metrics(answered, by)
    return every.select(*by, F.col("n_total").alias("n_questions"), (F.col("accuracy") * 100).alias("accuracy"), "rstd", "mad")


def by_alpha(cells: DataFrame) -> DataFrame:
    """(alpha, n_seeds, mean and population deviation of accuracy, rstd and mad over seeds)."""
    stats = [f(m).alias(f"{m}_{name}") for m in ("accuracy", "rstd", "mad") for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return cells.groupBy("alpha").agg(F.count(F.lit(1)).alias("n_seeds"), *stats)


def comparison(ours: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with our number and the difference, by row name."""
    return targets.join(ours, "name", "left").select("name", "target", "ours", (F.col("ours") - F.col("target")).alias("difference"))
