"""Problem 5: a sample that matches target category proportions.

Weights are raked by iterative proportional fitting over two margins (category and a second attribute
whose population shares are kept). Identifiers get weighted exponential keys, -ln(u) / weight; each
category takes its smallest keys up to its quota, quotas are repaired to the minimums, and what the sample
lacks of either margin is reported. Cells and key histograms are small tables; identifiers never leave executors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Scratch, seeded_uniform, table

#: Buckets of the key histogram of each category; only the cut-off bucket is ever ranked.
BUCKETS = 1024
SEED = 5


def category_key(category: Column) -> Column:
    """One key for spellings that differ in letter case, spaces, tabs, hyphens or underscores."""
    return F.lower(F.regexp_replace(category, r"[ \t\-_]", ""))


def rake(counts: np.ndarray, rows: np.ndarray, columns: np.ndarray, rounds: int = 1000, close: float = 1e-9) -> tuple[np.ndarray, float]:
    """Fit ``counts`` to both margins; returns the fitted table, whose cells add up to 1, and the largest margin error left.

    Rows and columns without any count or goal cannot be fitted: they stay empty, and the goals of the others are
    scaled to add up to 1, so both margins ask for the same total. An error is left only where empty cells make the
    two margins contradict each other.
    """
    fitted = np.where((rows > 0)[:, None] & (columns > 0)[None, :], counts, 0.0).astype(float)
    rows = np.where(fitted.sum(axis=1) > 0, rows, 0.0)
    columns = np.where(fitted.sum(axis=0) > 0, columns, 0.0)
    if not fitted.sum():
        return fitted, 0.0
    rows, columns = rows / rows.sum(), columns / columns.sum()
    worst = math.inf
    for _ in range(rounds):
        for axis, goal in ((0, columns), (1, rows)):
            sums = fitted.sum(axis=axis, keepdims=True)
            fitted = fitted * np.divide(np.expand_dims(goal, axis), sums, out=np.zeros_like(sums), where=sums > 0)
        worst = float(max(np.abs(fitted.sum(axis=0) - columns).max(), np.abs(fitted.sum(axis=1) - rows).max()))
        if worst < close:
            break
    return fitted, worst


def quotas(shares: list[float], minimums: list[int], available: list[int], wanted: int) -> list[int]:
    """Whole rows for each category: largest remainders of the shares, raised to the minimums, within supply.

    What minimums add is taken from the categories furthest above their share; what scarce categories lack
    stays missing, so the others keep their size.
    """
    raw = [max(0.0, s) * wanted for s in shares]
    got = [math.floor(r + 1e-9) for r in raw]
    for i in sorted(range(len(raw)), key=lambda i: (got[i] - raw[i], i))[: max(0, min(len(raw), wanted - sum(got)))]:
        got[i] += 1
    floor = [min(m, a) for m, a in zip(minimums, available)]
    got = [max(f, min(g, a)) for g, f, a in zip(got, floor, available)]
    excess = sum(got) - wanted
    while excess > 0:
        spare = [i for i in range(len(got)) if got[i] > floor[i]]
        if not spare:
            break
        i = max(spare, key=lambda i: (got[i] - raw[i], got[i], -i))
        got[i] -= 1
        excess -= 1
    return got


class ProportionalSample:
    """Samples of identifiers for the plans of a target table.

    ``rows`` is (id, category, attribute), ``targets`` (plan_id, category, target_share, min_rows,
    plan_rows). Null ids are left out, null categories match no target, a null attribute is a value of its
    own. An identifier seen in several categories counts as available in each but is drawn for its first
    category only. Null shares and minimums are 0. Other columns are ignored.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, seed: int = SEED):
        self.spark, self.seed, self.scratch = rows.sparkSession, seed, Scratch(rows.sparkSession)
        self._keys: DataFrame | None = None
        self._drawn_cells: dict[tuple, int] | None = None
        read = rows.where(F.col("id").isNotNull()).select(F.col("id"), category_key(F.col("category")).alias("ckey"), F.coalesce(F.col("attribute").cast("string"), F.lit("")).alias("attribute"))
        # One row per (id, category); ids are spread evenly whatever the category's share.
        pairs = read.where(F.col("ckey").isNotNull()).groupBy("id", "ckey").agg(F.min("attribute").alias("attribute"))
        self.ids = self.scratch.keep(pairs.withColumn("home", F.row_number().over(Window.partitionBy("id").orderBy("ckey")) == 1), "ids")
        wanted = targets.where(F.col("category").isNotNull()).select("plan_id", "category", category_key(F.col("category")).alias("ckey"), "target_share", "min_rows", "plan_rows")
        self.plans: dict[int, dict] = {}
        for t in wanted.orderBy("plan_id", "category").collect():
            self.plans.setdefault(t["plan_id"], {"targets": []})["targets"].append(t)
        # Only categories that a plan names are counted here: as many cells as those have attribute values.
        named = self.spark.createDataFrame([(k,) for k in sorted({t["ckey"] for p in self.plans.values() for t in p["targets"]})], "ckey string")
        cells = self.ids.join(named, "ckey", "left_semi").groupBy("ckey", "attribute").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).collect()
        self.attributes = sorted({c["attribute"] for c in cells})
        available: dict[str, int] = {}
        homes: dict[str, dict[str, int]] = {}
        for c in cells:
            available[c["ckey"]] = available.get(c["ckey"], 0) + c["n"]
            homes.setdefault(c["ckey"], {})[c["attribute"]] = c["homes"]
        for plan in self.plans.values():
            self._fit(plan, available, homes)

    def _fit(self, plan: dict, available: dict, homes: dict) -> None:
        goals = plan["targets"]
        plan["available"] = [available.get(t["ckey"], 0) for t in goals]
        supply = [sum(homes.get(t["ckey"], {}).values()) for t in goals]
        size = max([int(t["plan_rows"] or 0) for t in goals], default=0)
        shares = [float(t["target_share"] or 0) for t in goals]
        counts = np.array([[homes.get(t["ckey"], {}).get(a, 0) for a in self.attributes] for t in goals], dtype=float).reshape(len(goals), len(self.attributes))
        reachable = counts[np.array(shares) > 0].sum(axis=0) if goals else counts.sum(axis=0)
        plan["column_goal"] = reachable / reachable.sum() if reachable.sum() else reachable
        plan["fitted"], plan["margin_error"] = rake(counts, np.array(shares), plan["column_goal"])
        weights = np.divide(plan["fitted"], counts, out=np.zeros_like(counts), where=counts > 0)
        # A category of no share is drawn from only for its minimum: there all weigh alike.
        plan["weights"] = np.where(weights.sum(axis=1, keepdims=True) > 0, weights, 1.0) if goals else weights
        plan["quotas"] = quotas(shares, [int(t["min_rows"] or 0) for t in goals], supply, size)

    def _keyed(self) -> DataFrame:
        """(plan_id, category, id, home, key, bucket) of every identifier in reach of a plan, written once.

        Identifiers seen in several categories have a key in each; only that of their home can be drawn.
        """
        if self._keys is None:
            rows = [
                (plan_id, t["category"], t["ckey"], a, float(w) or 1.0, float(np.mean(plan["weights"][i][plan["weights"][i] > 0])))
                for plan_id, plan in self.plans.items()
                for i, t in enumerate(plan["targets"])
                for a, w in zip(self.attributes, plan["weights"][i])
            ]
            # As many rows as the plans have categories times attribute values.
            weights = self.spark.createDataFrame(rows, "plan_id int, category string, ckey string, attribute string, weight double, scale double")
            u = F.greatest(seeded_uniform("plan_id", "id", seed=self.seed), F.lit(2.0**-53))
            joined = self.ids.join(weights, ["ckey", "attribute"]).withColumn("key", -F.log(u) / F.col("weight"))
            bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.col("scale"))) * BUCKETS).cast("int"))
            self._keys = self.scratch.keep(joined.select("plan_id", "category", "attribute", "id", "home", "key", bucket.alias("bucket")), "keyed")
            counted = self._keys.groupBy("plan_id", "category", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
            self.histogram = self.scratch.keep(counted, "histogram")
        return self._keys

    def _drawn(self) -> DataFrame:
        keyed = self._keyed().where("home")
        quotas = [(plan_id, t["category"], quota) for plan_id, plan in self.plans.items() for t, quota in zip(plan["targets"], plan["quotas"])]
        upto = F.sum("homes").over(Window.partitionBy("plan_id", "category").orderBy("bucket"))
        reached = self.histogram.withColumn("upto", upto).join(self.spark.createDataFrame(quotas, "plan_id int, category string, quota long"), ["plan_id", "category"])
        before = F.col("upto") - F.col("homes")
        limits = reached.where((before < F.col("quota")) & (F.col("upto") >= F.col("quota"))).select("plan_id", "category", F.col("bucket").alias("cut"), (F.col("quota") - before).alias("left"))
        near = keyed.join(limits, ["plan_id", "category"]).where(F.col("bucket") <= F.col("cut"))
        whole = near.where(F.col("bucket") < F.col("cut"))
        edge = near.where(F.col("bucket") == F.col("cut")).withColumn("rank", F.row_number().over(Window.partitionBy("plan_id", "category").orderBy("key", "id"))).where(F.col("rank") <= F.col("left"))
        columns = ["plan_id", F.col("category").alias("subject"), "attribute", "id"]
        return whole.select(*columns).unionByName(edge.select(*columns))

    def sample(self) -> DataFrame:
        """(plan_id, subject, id): each plan's drawn identifiers."""
        return self._drawn().select("plan_id", "subject", "id")

    def _counts(self) -> dict[tuple, int]:
        """Drawn identifiers by (plan_id, subject, attribute): one row for each cell of the plans."""
        if self._drawn_cells is None:
            self._drawn_cells = {(r["plan_id"], r["subject"], r["attribute"]): r["count"] for r in self._drawn().groupBy("plan_id", "subject", "attribute").count().collect()}
        return self._drawn_cells

    def report(self) -> DataFrame:
        """(plan_id, subject, target_share, min_rows, plan_rows, available, quota, drawn, drawn_share, gap_rows, short) of every target.

        ``available`` counts the keys of the category, ``drawn`` the identifiers in the sample and ``drawn_share`` their
        share of it. ``gap_rows`` is what the sample lacks of its share or minimum, ``short`` whether the keys ran
        out before they were met.
        """
        counts = self._counts()
        keys = {(r["plan_id"], r["category"]): r["n"] for r in self.histogram.groupBy("plan_id", "category").agg(F.sum("n").alias("n")).collect()}
        rows = []
        for plan_id, plan in self.plans.items():
            drawn = [sum(counts.get((plan_id, t["category"], a), 0) for a in self.attributes) for t in plan["targets"]]
            whole = max(1, sum(drawn))
            for t, q, got in zip(plan["targets"], plan["quotas"], drawn):
                n = keys.get((plan_id, t["category"]), 0)
                share, least, size = float(t["target_share"] or 0), int(t["min_rows"] or 0), int(t["plan_rows"] or 0)
                goal = share * size
                rows.append((plan_id, t["category"], share, least, size, n, q, got, got / whole, float(max(0.0, max(goal, least) - got)), n < least or n < goal))
        return self.spark.createDataFrame(rows, "plan_id int, subject string, target_share double, min_rows int, plan_rows long, available long, quota long, drawn long, drawn_share double, gap_rows double, short boolean")

    def margins(self) -> DataFrame:
        """(plan_id, margin, value, target_share, fitted_share, sample_share, gap, margin_error) of both margins of each plan.

        Targets are those of the reachable categories and of the attribute's shares among them; ``gap`` is what the
        sample's share is above its target, ``margin_error`` what raking left of the plan's largest difference.
        """
        counts = self._counts()
        rows = []
        for plan_id, plan in self.plans.items():
            names = [t["category"] for t in plan["targets"]]
            cells = np.array([[counts.get((plan_id, c, a), 0) for a in self.attributes] for c in names], dtype=float).reshape(len(names), len(self.attributes))
            got = cells / max(1.0, cells.sum())
            shares = np.array([max(0.0, float(t["target_share"] or 0)) for t in plan["targets"]])
            shares = np.where(plan["fitted"].sum(axis=1) > 0, shares, 0.0)
            shares = shares / shares.sum() if shares.sum() else shares
            for margin, values, axis, goal in (("category", names, 1, shares), ("attribute", self.attributes, 0, plan["column_goal"])):
                for value, g, f, s in zip(values, goal, plan["fitted"].sum(axis=axis), got.sum(axis=axis)):
                    rows.append((plan_id, margin, value, float(g), float(f), float(s), float(s - g), plan["margin_error"]))
        return self.spark.createDataFrame(rows, "plan_id int, margin string, value string, target_share double, fitted_share double, sample_share double, gap double, margin_error double")


def test_sample(spark: SparkSession, folder: str) -> ProportionalSample:
    """question_ids of toy_normalized by subject, keeping the population's option counts as second margin."""
    rows = table(spark, folder, "toy_normalized").select(F.col("question_id").alias("id"), F.col("subject").alias("category"), F.col("n_choices").alias("attribute"))
    return ProportionalSample(rows, table(spark, folder, "subject_targets").withColumnRenamed("subject", "category"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return test_sample(spark, folder).report().where("short").select("plan_id", "subject")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Share, quota and drawn identifiers of every target, and what each lacks."""
    return test_sample(spark, folder).report()


def p5_margins(spark: SparkSession, folder: str) -> DataFrame:
    """Residual gaps of both margins."""
    return test_sample(spark, folder).margins()


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return test_sample(spark, folder).sample().withColumnRenamed("id", "question_id")


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_margins": p5_margins, "p5_sample": p5_sample}
_KEY = r"lower(regexp_replace({0}, '[ \t\-_]', '', 'g'))"
_AVAILABLE = f"""
WITH pairs AS (SELECT question_id AS id, {_KEY.format("subject")} AS k, row_number() OVER (PARTITION BY question_id ORDER BY {_KEY.format("subject")}) = 1 AS home
  FROM (SELECT DISTINCT question_id, {_KEY.format("subject")} AS subject FROM toy_normalized WHERE question_id IS NOT NULL AND subject IS NOT NULL)),
counts AS (SELECT k, count(*) AS n, count(*) FILTER (home) AS homes FROM pairs GROUP BY k),
goals AS (SELECT plan_id, subject, target_share, min_rows, plan_rows, coalesce(n, 0) AS n, coalesce(homes, 0) AS homes, row_number() OVER (PARTITION BY plan_id ORDER BY subject) AS i FROM subject_targets t LEFT JOIN counts c ON c.k = {_KEY.format("t.subject")})"""
ORACLE_SQL = {
    "p5_found": f"{_AVAILABLE} SELECT plan_id, subject FROM goals WHERE n < min_rows OR n < target_share * plan_rows",
    # Quotas: largest remainders, raised to the minimums within supply; what is too much leaves unit by unit, furthest above its share first.
    "p5_report": f"""{_AVAILABLE},
parts AS (SELECT *, target_share * plan_rows AS raw, floor(target_share * plan_rows + 1e-9) AS whole, least(min_rows, homes) AS lowest FROM goals),
rounded AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY plan_id ORDER BY whole - raw, i) <= plan_rows - sum(whole) OVER (PARTITION BY plan_id) THEN 1 ELSE 0 END AS want FROM parts),
held AS (SELECT *, CAST(greatest(lowest, least(want, homes)) AS BIGINT) AS got FROM rounded),
units AS (SELECT plan_id, i, row_number() OVER (PARTITION BY plan_id ORDER BY got - u - raw DESC, got - u DESC, i) AS turn FROM held, unnest(range(0, greatest(0, got - CAST(lowest AS BIGINT)))) AS x(u)),
surplus AS (SELECT plan_id, sum(got) - max(plan_rows) AS over FROM held GROUP BY plan_id),
taken AS (SELECT plan_id, i, count(*) AS less FROM units JOIN surplus USING (plan_id) WHERE turn <= over GROUP BY ALL),
q AS (SELECT h.*, CAST(got - coalesce(less, 0) AS BIGINT) AS quota FROM held h LEFT JOIN taken USING (plan_id, i))
SELECT plan_id, subject, target_share, min_rows, plan_rows, n AS available, quota, quota AS drawn, quota / sum(quota) OVER (PARTITION BY plan_id) AS drawn_share, CAST(greatest(0, greatest(raw, min_rows) - quota) AS DOUBLE) AS gap_rows, n < min_rows OR n < raw AS short FROM q""",
}
