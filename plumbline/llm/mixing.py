"""Problem 7: mixing sources to target weights as a min-cost flow.

Documents are added up by membership pattern (the set of sources that hold them). Each pattern offers
its tokens once for nothing, a second time at cost 1, a third at cost 2 and so on; the flow routes them
to the quotas of the sources. The network's size is that of the pattern table, never of the documents.
Documents are then chosen in a seeded order: each pattern is a line of tokens, walked as often as the
flow says, and each source owns one stretch of the walk.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Scratch, seeded_uniform, table

#: Public byte-level vocabulary and its split pattern (fixed values of that vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slices of a pattern's seeded order; prefix sums over slices go to the driver, those inside stay.
SLICES = 4096


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``tokens``: the exact number of tokens of the whole text; null and empty have none."""
    fields = [df.schema[name] for name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in keep], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(rows, schema)


class _Network:
    """Successive shortest paths with potentials; capacities are exact integers, costs small and not negative."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        number = len(self.head)
        for at, to, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[at].append(len(self.head))
            self.head.append(to)
            self.room.append(r)
            self.cost.append(c)
        return number

    def run(self, source: int, sink: int) -> None:
        potential = [0] * len(self.out)
        while True:
            dist: list[int | None] = [None] * len(self.out)
            via = [-1] * len(self.out)
            dist[source] = 0
            queue = [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > (dist[a] or 0):
                    continue
                for e in self.out[a]:
                    if self.room[e] > 0:
                        b = self.head[e]
                        nd = d + self.cost[e] + potential[a] - potential[b]
                        if dist[b] is None or nd < dist[b]:
                            dist[b], via[b] = nd, e
                            heapq.heappush(queue, (nd, b))
            if dist[sink] is None:
                return
            potential = [p + (d if d is not None else dist[sink]) for p, d in zip(potential, dist)]
            push, b = None, sink
            while b != source:
                push = self.room[via[b]] if push is None else min(push, self.room[via[b]])
                b = self.head[via[b] ^ 1]
            b = sink
            while b != source:
                self.room[via[b]] -= push
                self.room[via[b] ^ 1] += push
                b = self.head[via[b] ^ 1]


def route(patterns: list[tuple[tuple[str, ...], int]], targets: list[tuple[str, Fraction, int]], total: int) -> tuple[dict[tuple[int, str], Fraction], dict[str, Fraction]]:
    """Tokens each (pattern number, source) gets, and each source's unmet quota.

    ``patterns`` are (sources, tokens), ``targets`` (source, share, most uses). Quotas are share times
    ``total``; a pattern gives one source at most its uses times its tokens, and all sources together at
    most the largest of their uses times its tokens. Arithmetic is exact.
    """
    unit = 1
    for _, share, _ in targets:
        unit = unit * share.denominator // _gcd(unit, share.denominator)
    n, m = len(patterns), len(targets)
    net = _Network(n + m + 2)
    start, end = n + m, n + m + 1
    given: dict[tuple[int, str], int] = {}
    quotas: dict[str, int] = {}
    place = {source: n + j for j, (source, _, _) in enumerate(targets)}
    uses = {source: max(0, most) for source, _, most in targets}
    for i, (sources, tokens) in enumerate(patterns):
        mine = [s for s in sources if s in place]
        for level in range(max([uses[s] for s in mine], default=0)):
            net.arc(start, i, tokens * unit, level)
        for s in mine:
            given[i, s] = net.arc(i, place[s], uses[s] * tokens * unit, 0)
    for source, share, _ in targets:
        quotas[source] = net.arc(place[source], end, int(share * total * unit), 0)
    net.run(start, end)
    flow = {key: Fraction(net.room[e ^ 1], unit) for key, e in given.items()}
    return flow, {s: Fraction(net.room[e], unit) for s, e in quotas.items()}


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def _share(value: float | None) -> Fraction:
    return max(Fraction(0), Fraction(str(value))) if value is not None else Fraction(0)


class Mixture:
    """A routed mixture: ``documents`` is (doc_id, sources array, tokens), ``targets`` (plan_id, source, target_share, max_uses).

    Every row is a document of its own. Null or empty source lists belong to no source but count in the
    total; null token counts are 0. A null share or use count is 0; of a source named twice in a plan the
    largest share and use count hold. Without documents every positive share of a plan is short of nothing,
    as every quota is 0. Other columns are ignored.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame):
        self.spark = documents.sparkSession
        sources = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("sources", F.array().cast("array<string>")))))
        read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), sources.alias("sources"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        self.documents = Scratch(self.spark).keep(read, "documents")
        # Sources that no plan names decide nothing, so patterns are sets of named ones: their number is that of the plans' sources, not the data's.
        named = F.array(*[F.lit(r["source"]) for r in targets.where(F.col("source").isNotNull()).select("source").distinct().orderBy("source").collect()]).cast("array<string>")
        self.documents = self.documents.withColumn("sources", F.array_intersect("sources", named))
        sums = self.documents.groupBy("sources").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).orderBy("sources").collect()
        self.patterns = [(tuple(r["sources"]), int(r["tokens"])) for r in sums]
        self.total = sum(t for _, t in self.patterns)
        plans: dict = {}
        for r in targets.where(F.col("source").isNotNull()).groupBy("plan_id", "source").agg(F.max("target_share").alias("share"), F.max("max_uses").alias("uses")).orderBy("plan_id", "source").collect():
            plans.setdefault(r["plan_id"], []).append((r["source"], _share(r["share"]), int(r["uses"] or 0)))
        self.plans = plans
        self.routes = {plan: route(self.patterns, goals, self.total) for plan, goals in plans.items()}

    def shortfalls(self) -> DataFrame:
        """(plan_id, source, quota_tokens, routed_tokens, short_tokens, short): what the flow could not give."""
        rows = []
        for plan, goals in self.plans.items():
            flow, missing = self.routes[plan]
            for source, share, _ in goals:
                routed = sum((f for (_, s), f in flow.items() if s == source), Fraction(0))
                rows.append((plan, source, float(share * self.total), float(routed), float(missing[source]), missing[source] > 0))
        return self.spark.createDataFrame(rows, "plan_id int, source string, quota_tokens double, routed_tokens double, short_tokens double, short boolean")

    def selection(self, seed: int = 0) -> DataFrame:
        """(plan_id, source, doc_id, tokens, uses): how often each source uses each document of the mixture."""
        stretches = []
        for plan, (flow, _) in self.routes.items():
            for i, (sources, tokens) in enumerate(self.patterns):
                at = 0.0
                for s in sources:
                    length = float(flow.get((i, s), 0))
                    if tokens and length:
                        stretches.append((plan, list(sources), s, float(tokens), at, at + length))
                        at += length
        walks = self.spark.createDataFrame(stretches, "plan_id int, sources array<string>, source string, line double, low double, high double")
        drawn = self.documents.where(F.col("tokens") > 0).withColumn("u", seeded_uniform("doc_id", seed=seed)).withColumn("slice", F.floor(F.col("u") * SLICES).cast("int"))
        sums = drawn.groupBy("sources", "slice").agg(F.sum("tokens").alias("slice_tokens"))
        offsets = sums.withColumn("before", F.sum("slice_tokens").over(Window.partitionBy("sources").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("sources", "slice", F.coalesce("before", F.lit(0)).alias("before"))
        inside = Window.partitionBy("sources", "slice").orderBy("u", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
        placed = drawn.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["sources", "slice"]).withColumn("point", F.col("before") + F.col("within") + F.col("tokens") / 2)
        # Passes k with low <= point + k * line < high.
        uses = (F.ceil((F.col("high") - F.col("point")) / F.col("line")) - F.ceil((F.col("low") - F.col("point")) / F.col("line"))).cast("int")
        return placed.join(walks, "sources").withColumn("uses", uses).where(F.col("uses") > 0).select("plan_id", "source", "doc_id", "tokens", "uses")

    def shares(self, seed: int = 0) -> DataFrame:
        """(plan_id, source, target_share, reached_tokens, reached_share, mixture_tokens, wanted_share, most_uses, short_tokens) of the drawn mixture.

        ``reached_share`` is the source's share of the drawn mixture of ``mixture_tokens``, so shares of a plan add up to
        1; ``wanted_share`` is what was drawn in terms of the wanted size, the tokens of all documents.
        """
        drawn = self.selection(seed).groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached_tokens"), F.max("uses").alias("most_uses"))
        goals = self.spark.createDataFrame([(p, s, float(share)) for p, g in self.plans.items() for s, share, _ in g], "plan_id int, source string, target_share double")
        joined = goals.join(drawn, ["plan_id", "source"], "left").join(self.shortfalls().select("plan_id", "source", "short_tokens"), ["plan_id", "source"])
        reached = joined.withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)).cast("long"))
        # One row for each target.
        summed = reached.withColumn("mixture_tokens", F.sum("reached_tokens").over(Window.partitionBy("plan_id")))
        return summed.select(
            "plan_id", "source", "target_share", "reached_tokens", (F.col("reached_tokens") / F.greatest("mixture_tokens", F.lit(1))).alias("reached_share"), "mixture_tokens",
            (F.col("reached_tokens") / F.lit(max(1, self.total))).alias("wanted_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "short_tokens",
        )

    def totals(self) -> DataFrame:
        """(plan_id, n_patterns, quota_tokens, routed_tokens) of each plan: the most that any mixture can give."""
        rows = []
        for plan, goals in self.plans.items():
            flow, missing = self.routes[plan]
            quota = sum((q for q in (Fraction(int(share * self.total * 10**6), 10**6) for _, share, _ in goals)), Fraction(0))
            rows.append((plan, len(self.patterns), float(quota), float(sum(flow.values(), Fraction(0)))))
        return self.spark.createDataFrame(rows, "plan_id int, n_patterns int, quota_tokens double, routed_tokens double")


def test_mixture(spark: SparkSession, folder: str) -> Mixture:
    """The plans of source_targets over the documents table, each row in its one source."""
    counted = count_tokens(table(spark, folder, "documents"), "text", ["doc_id", "source"])
    return Mixture(counted.select("doc_id", F.array("source").alias("sources"), "tokens"), table(spark, folder, "source_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return test_mixture(spark, folder).shortfalls().where("short").select("plan_id", "source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return test_mixture(spark, folder).shares()


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return test_mixture(spark, folder).selection()


# The source that the last word of a title names.
TITLE_SOURCES = {"notes": "study_notes", "thread": "forum", "sheet": "exam_sheets", "log": "tutoring_logs", "paper": "run_reports", "set": "benchmark_cards"}


def overlapping_mixture(spark: SparkSession, folder: str) -> Mixture:
    """Documents that count for their own source and for the one that their title names; sizes are bytes, so that SQL can tell them."""
    kind = F.regexp_extract(F.lower("title"), "([a-z]+)$", 1)
    named = F.lit(None).cast("string")
    for word, source in TITLE_SOURCES.items():
        named = F.when(kind == word, F.lit(source)).otherwise(named)
    rows = table(spark, folder, "documents").select("doc_id", F.array("source", named).alias("sources"), F.octet_length("text").cast("long").alias("tokens"))
    return Mixture(rows, table(spark, folder, "source_targets"))


def p7_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """What plans can reach at most where documents belong to two sources."""
    t = overlapping_mixture(spark, folder).totals()
    return t.select("plan_id", "n_patterns", F.round("quota_tokens", 2).alias("quota_bytes"), F.round("routed_tokens", 2).alias("routed_bytes"))


def p7_overlap_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the mixture drawn where documents belong to two sources."""
    return overlapping_mixture(spark, folder).shares()


QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares, "p7_selection": p7_selection, "p7_overlap": p7_overlap, "p7_overlap_shares": p7_overlap_shares}
_TITLE_CASE = "CASE regexp_extract(lower(title), '([a-z]+)$', 1) " + " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in TITLE_SOURCES.items()) + " END"
# Tokens are not countable in SQL; bytes stand in for them, as any public tokenizer gives the same cases.
ORACLE_SQL = {
    "p7_found": """
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0)) AS n FROM documents GROUP BY source)
SELECT t.plan_id, t.source FROM source_targets t LEFT JOIN sizes s USING (source)
WHERE t.max_uses * coalesce(s.n, 0) < t.target_share * (SELECT sum(n) FROM sizes)""",
    # The largest flow is the smallest cut: over all sets of sources whose quotas are cut, the rest being cut at the patterns.
    "p7_overlap": f"""
WITH d AS (SELECT list_sort(list_distinct(list_intersect([source, {_TITLE_CASE}], (SELECT list(DISTINCT source) FROM source_targets)))) AS s, sum(coalesce(strlen(text), 0)) AS n FROM documents GROUP BY 1),
total AS (SELECT sum(n) AS n, count(*) AS patterns FROM d),
g AS (SELECT plan_id, source, target_share * total.n AS quota, max_uses, row_number() OVER (PARTITION BY plan_id ORDER BY source) - 1 AS bit FROM source_targets, total),
sets AS (SELECT DISTINCT plan_id, unnest(range(0, 512)) AS mask FROM g),
quotas AS (SELECT plan_id, mask, coalesce(sum(quota) FILTER (mask & (1 << CAST(bit AS INT)) > 0), 0) AS cut FROM sets JOIN g USING (plan_id) GROUP BY ALL),
pats AS (SELECT plan_id, mask, d.s, least(max(max_uses), coalesce(sum(max_uses) FILTER (mask & (1 << CAST(bit AS INT)) = 0), 0)) * max(d.n) AS cut FROM sets JOIN g USING (plan_id) JOIN d ON list_contains(d.s, g.source) GROUP BY ALL),
cuts AS (SELECT plan_id, mask, q.cut + coalesce(p.cut, 0) AS cut FROM quotas q LEFT JOIN (SELECT plan_id, mask, sum(cut) AS cut FROM pats GROUP BY ALL) p USING (plan_id, mask))
SELECT plan_id, CAST((SELECT patterns FROM total) AS INT) AS n_patterns, round((SELECT sum(quota) FROM g x WHERE x.plan_id = cuts.plan_id), 2) AS quota_bytes, round(min(cut), 2) AS routed_bytes FROM cuts GROUP BY plan_id""",
}
