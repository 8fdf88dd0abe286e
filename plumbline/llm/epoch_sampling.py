"""Problem 4: a reproducible sample that only gains members.

A stored ledger keeps, for each identifier, the epoch in which it was first seen and that epoch's rate, frozen
when the epoch is entered. An identifier is in the sample iff its counter-based uniform, a pure function
of seed and identifier, lies below its ledger rate. Neither ever changes for an identifier once seen, so
reruns, layouts and later rows cannot remove it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, seeded_uniform, table

#: Rate of epochs without a rate of their own.
RATE = 0.1
#: Deliveries of the queries: the rows up to an epoch (null: all rows) and the rate in force when they arrive.
DELIVERIES = (("2026-02", 0.1), ("2026-04", 0.08), (None, 0.05))
SEED = 4


def month_epoch(at: Column) -> Column:
    """The calendar month of a timestamp as epoch; no timestamp counts as before all epochs."""
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(""))


def extend_ledger(rows: DataFrame, key: str, epoch: Column, rates: dict[str, float] | None = None, rate: float = RATE, ledger: DataFrame | None = None) -> DataFrame:
    """(key, epoch, rate) for every identifier: entries of ``ledger`` as they are, new ones appended.

    New identifiers get their smallest epoch in ``rows`` and that epoch's rate. Null identifiers are left
    out; repeated rows of an identifier are one entry; an empty input leaves the ledger as it is.
    """
    new = rows.where(F.col(key).isNotNull()).select(F.col(key), epoch.alias("epoch")).groupBy(key).agg(F.min("epoch").alias("epoch"))
    if ledger is not None:
        new = new.join(ledger.select(key), key, "left_anti")
    fixed = F.lit(float(rate))
    for name, value in (rates or {}).items():
        fixed = F.when(F.col("epoch") == name, F.lit(float(value))).otherwise(fixed)
    entries = new.withColumn("rate", fixed)
    return entries if ledger is None else ledger.select(key, "epoch", "rate").unionByName(entries)


class StoredLedger:
    """A ledger kept in a folder that all executors share: one part for each delivery, never written again.

    A delivery whose part is complete is not entered again, so a run that was broken off or repeated leaves every
    epoch and rate as they were frozen.
    """

    _SCHEMA = "{key} {kind}, epoch string, rate double"

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str = "string"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = self._SCHEMA.format(key=key, kind=kind)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, delivery: str) -> bool:
        return self._files.exists(self._path(f"{self.folder}/{delivery}/_SUCCESS"))

    def _complete(self) -> list[str]:
        root = self._path(self.folder)
        names = [s.getPath().getName() for s in self._files.listStatus(root)] if self._files.exists(root) else []
        return sorted(n for n in names if self._done(n))

    def read(self) -> DataFrame:
        """(key, epoch, rate) of all complete deliveries."""
        parts = [f"{self.folder}/{n}" for n in self._complete()]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def enter(self, delivery: str, rows: DataFrame, epoch: Column, rates: dict[str, float] | None = None, rate: float = RATE) -> DataFrame:
        """Append the identifiers of ``rows`` that the ledger lacks, at the rates in force now; returns the ledger."""
        if not self._done(delivery):
            known = self.read()
            new = extend_ledger(rows.join(known.select(self.key), self.key, "left_anti"), self.key, epoch, rates, rate)
            new.write.mode("overwrite").parquet(f"{self.folder}/{delivery}")
        return self.read()


def selected(ledger: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Ledger entries whose uniform lies below their frozen rate."""
    return ledger.where(seeded_uniform(key, seed=seed) < F.col("rate"))


def sample_rows(rows: DataFrame, key: str, ledger: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of all selected identifiers: rows of one identifier are in or out together."""
    return rows.join(selected(ledger, key, seed).select(key), key, "left_semi")


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger after all deliveries: each reads what the ones before it stored and appends to it."""
    ledger = StoredLedger(spark, f"{Scratch(spark).root}/ledger", "question_id")
    rows = table(spark, folder, "toy_normalized").select("question_id", month_epoch(F.col("ingested_at")).alias("epoch_of_row"))
    for number, (last, rate) in enumerate(DELIVERIES):
        ledger.enter(f"delivery-{number:06d}", rows if last is None else rows.where(F.col("epoch_of_row") <= last), F.col("epoch_of_row"), rate=rate)
    return ledger.read()


def p4_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Each identifier with the epoch in which it was first seen and the rate that was in force then."""
    return _ledger(spark, folder)


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the selected identifiers after the last delivery."""
    return sample_rows(table(spark, folder, "toy_normalized").select("ordinal", "question_id"), "question_id", _ledger(spark, folder))


QUERIES = {"p4_sample": p4_sample, "p4_ledger": p4_ledger}
_RATE_SQL = "CASE " + " ".join(f"WHEN epoch <= '{last}' THEN {rate}" for last, rate in DELIVERIES if last) + f" ELSE {DELIVERIES[-1][1]} END"
_LEDGER_SQL = f"SELECT question_id, epoch, CAST({_RATE_SQL} AS DOUBLE) AS rate FROM (SELECT question_id, min(coalesce(strftime(ingested_at, '%Y-%m'), '')) AS epoch FROM toy_normalized WHERE question_id IS NOT NULL GROUP BY question_id)"
ORACLE_SQL = {
    "p4_ledger": _LEDGER_SQL,
    "p4_sample": f"""
WITH ledger AS ({_LEDGER_SQL})
SELECT ordinal, question_id FROM toy_normalized WHERE question_id IN (
  SELECT question_id FROM ledger WHERE CAST(('0x' || substr(sha256('{SEED}|0|' || question_id), 1, 13)) AS BIGINT) / 4503599627370496.0 < rate)""",
}
