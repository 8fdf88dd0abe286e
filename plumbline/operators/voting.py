"""Votes: counts, majority with deterministic tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.identity import TIE_NAMESPACE, tie_udf


def vote_counts(df: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """(keys, choice, votes): non-null votes of each letter."""
    return df.where(F.col(choice).isNotNull()).groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("votes"))


def leaders(df: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """(keys, votes, tied): the highest vote count and the sorted letters that reach it.

    Two aggregations: votes by letter, then a few letters by question, so a hot question is counted before it meets.
    """
    gathered = vote_counts(df, keys, choice).groupBy(*keys).agg(F.collect_list(F.struct(F.col("votes"), F.col(choice).alias("letter"))).alias("v"), F.max("votes").alias("votes"))
    return gathered.select(*keys, "votes", F.array_sort(F.transform(F.filter("v", lambda x: x["votes"] == F.col("votes")), lambda x: x["letter"])).alias("tied"))


def majority(df: DataFrame, keys: list[str], choice: str, benchmark: Column, question: Column, seed: int, method: str, sources: Column | None = None, namespace: str = TIE_NAMESPACE) -> DataFrame:
    """(keys, votes, n_tied, winner): the most frequent letter, ties by BLAKE2b over source indexes.

    ``sources`` maps letters to source indexes; by default a letter's position. Only tied rows reach Python.
    """
    led = leaders(df, keys, choice)
    index = (lambda x: F.ascii(x) - 65) if sources is None else (lambda x: F.element_at(sources, x))
    clear = led.where(F.size("tied") == 1).select(*keys, "votes", F.lit(1).alias("n_tied"), F.get("tied", F.lit(0)).alias("winner"))
    tied = led.where(F.size("tied") > 1).withColumn("__ids", F.transform("tied", lambda x: index(x).cast("int")))
    chosen = tied.withColumn("__w", tie_udf(seed, method, namespace)(benchmark, question, F.col("__ids")))
    broken = chosen.select(*keys, "votes", F.size("tied").alias("n_tied"), F.get("tied", F.array_position("__ids", F.col("__w")).cast("int") - 1).alias("winner"))
    return clear.unionByName(broken)


def elected(df: DataFrame, votes: str, benchmark: Column, question: Column, seed: int, method: str, namespace: str = TIE_NAMESPACE) -> DataFrame:
    """``df`` plus votes_for, n_tied and winner of its array of letters ``votes`` (nulls are no votes), ties as in :func:`majority`.

    For votes that are together already, as the rotations of one question: no aggregation. Only tied rows reach Python.
    """
    cast = F.filter(votes, lambda x: x.isNotNull())
    counted = F.transform(F.array_sort(F.array_distinct(cast)), lambda x: F.struct(F.size(F.filter(cast, lambda y: y == x)).alias("n"), x.alias("letter")))
    led = df.withColumn("__c", counted).withColumn("votes_for", F.array_max(F.transform("__c", lambda x: x["n"])))
    led = led.withColumn("__tied", F.transform(F.filter("__c", lambda x: x["n"] == F.col("votes_for")), lambda x: x["letter"])).drop("__c")
    clear = led.where(F.size("__tied") < 2).select(*df.columns, "votes_for", F.size("__tied").alias("n_tied"), F.get("__tied", F.lit(0)).alias("winner"))
    tied = led.where(F.size("__tied") > 1).withColumn("__ids", F.transform("__tied", lambda x: (F.ascii(x) - 65).cast("int")))
    chosen = tied.withColumn("__w", tie_udf(seed, method, namespace)(benchmark, question, F.col("__ids")))
    broken = chosen.select(*df.columns, "votes_for", F.size("__tied").alias("n_tied"), F.get("__tied", F.array_position("__ids", F.col("__w")).cast("int") - 1).alias("winner"))
    return clear.unionByName(broken)
