"""Evaluation relations over the test tables. Every lens takes all rows of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.options import build_choices, labelled, letter
from plumbline.operators.normalize import from_table
from plumbline.sources.tables import table


def results(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as result rows: order = question, return flag = method, line status = model, gold and answer from keys, some unanswered."""
    t = table(spark, folder, "lineitem")
    return t.select(
        F.col("l_orderkey").cast("string").alias("question_id"),
        F.col("l_returnflag").alias("method_name"),
        F.col("l_linestatus").alias("model_name"),
        letter((F.col("l_orderkey") % 4).cast("int")).alias("correct_option"),
        F.when(F.col("l_suppkey") % 10 != 0, letter((F.col("l_partkey") % 4).cast("int"))).alias("parsed_choice"),
        (F.col("l_suppkey") % 20 == 0).alias("failed"),
    )


def rotation_traces(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as rotation traces: the lines of an order are its rotations, as many as the order has options."""
    t = table(spark, folder, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("lines"))
    pick = lambda x: F.when(x["l_suppkey"] % 10 != 0, letter((x["l_partkey"] % F.size("lines")).cast("int")))
    return lines.select(F.col("l_orderkey").alias("question_id"), F.transform("lines", pick).alias("per_rotation_choices"), (F.col("l_orderkey") % F.size("lines")).cast("int").alias("correct_index"))


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as score vectors of four letters: rows 0 to 3 of the matrix, then the plain vector; gold from the id."""
    v = lambda i: F.slice("embedding", 4 * i + 1, 4)
    wide = lambda a: F.transform(a, lambda x: x.cast("double"))
    rows = F.array(*[V.label_distribution(wide(v(k))) for k in range(4)])
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("question_id"), (F.col("vec_id") % 4).cast("int").alias("correct_index"), letter((F.col("vec_id") % 4).cast("int")).alias("correct_option"), rows.alias("matrix"), wide(v(4)).alias("scores"), V.label_distribution(wide(v(4))).alias("observed")
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """toy_normalized in the native question schema, every delivered row."""
    return from_table(table(spark, folder, "toy_normalized"))


def eval_questions(spark: SparkSession, folder: str) -> DataFrame:
    """eval_items as questions with native choices; n_choices and gold letter derived."""
    t = table(spark, folder, "eval_items")
    return t.select(
        F.col("item_id").alias("ordinal"), F.col("item_id").cast("string").alias("question_id"), "subject", F.col("question").alias("question_text"), build_choices(F.col("choices")).alias("choices"),
        F.col("answer").alias("correct_index"), letter(F.col("answer")).alias("correct_option"), F.get("choices", F.col("answer")).alias("correct_answer_text"), F.size("choices").alias("n_choices"),
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """model_responses with the options and gold letter of their question (null where the question is unknown).

    Questions are reduced to one row each before the join, so a question delivered often costs nothing more.
    """
    q = questions(spark, folder).where(F.col("question_id").isNotNull())
    one = q.groupBy("question_id").agg(F.min_by(F.struct(labelled(F.col("choices")).alias("options"), "correct_option", "n_choices"), F.col("ordinal")).alias("q")).select("question_id", "q.*")
    r = table(spark, folder, "model_responses").select("response_id", "question_id", "provider", "model_name", "status", "raw_text", "finish_reason")
    return r.join(one, "question_id", "left")
