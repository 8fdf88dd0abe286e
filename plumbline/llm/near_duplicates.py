"""Problem 2: near-duplicate records by an exact Jaccard metric-space join.

Top level. Jaccard distance over words concentrates near 0.9 here, and the window of the triangle
inequality at radius r is 2r wide, so document pivots would send nearly every document to every
region (README has the measurement). The pivots of the top level are therefore the words themselves,
rarest first: a document belongs to the region of each word in its prefix, which is the exact window
for this radius (two documents within r must share a word of both prefixes).

Regions too large to join directly are split recursively by document pivots: Voronoi cells, documents
replicated by the triangle inequality, a pair examined in the home cell of either member. What pivots
cannot split any more is joined in blocks, so no task ever holds a whole region and nothing is capped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Scratch, option_texts, table
from plumbline.llm.formatting_dedup import question_key

#: Similarity that TESTDATA.md sets for this problem.
THRESHOLD = 0.6
#: Regions of at most this many rows squared comparisons are joined directly.
REGION_ROWS = 2000
#: Pivots per split and the deepest split.
PIVOTS, DEPTH = 8, 3
#: Buckets of the word-frequency sketch, as bits: a fixed 4 MB, whatever the vocabulary.
SKETCH_BITS = 20


def words_of(*texts: Column) -> Column:
    """Distinct lower-case runs of letters and digits, as 64-bit hashes."""
    joined = F.lower(F.concat_ws(" ", *texts))
    words = F.array_distinct(F.regexp_extract_all(joined, F.lit(r"([\p{L}\p{N}]+)"), 1))
    return F.transform(words, lambda w: F.xxhash64(w))


def frequency_sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Word counts by hash bucket over all documents; it only sets the order of words, never a result.

    Each task counts into a dense array and hands on compressed slices; slices are added up apart, so
    neither a task nor the driver ever holds more than the fixed sketch.
    """
    slices = 16
    width = (1 << bits) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            flat = batch.column("words").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat & ((1 << bits) - 1), minlength=1 << bits)
        parts = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.int64)
        for counts in part.column("counts"):
            total += np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.int64)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("words").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").toArrow().to_pylist()
    sketch = np.zeros(1 << bits, dtype=np.int64)
    for row in rows:
        sketch[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], dtype=np.int64)
    return np.minimum(sketch, np.iinfo(np.int32).max).astype(np.int32)


def _prefix_rows(sketch_of, threshold: float):
    """Rows (token, cls, size, pos, heavy) of every document's prefix in rarest-first word order.

    The region is the low half of the word's hash: words that share it share a region, no pair is lost.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, limit = sketch_of.value
        mask = len(sketch) - 1
        for batch in batches:
            words = batch.column("words")
            sizes = np.diff(words.offsets.to_numpy())
            flat = words.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            freq = sketch[flat & mask]
            order = np.lexsort((flat, freq, owner))
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, dtype=np.int64)
            pos = np.arange(len(flat)) - np.repeat(starts, sizes)
            length = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            keep = pos < np.repeat(length, sizes)
            picked = order[keep]  # sorted within each owner, so positions line up
            who = owner[keep]
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[picked].astype(np.int32)), pa.array(cls[who]), pa.array(sizes[who].astype(np.int32)), pa.array(pos[keep].astype(np.int32)), pa.array(freq[picked] > limit)],
                names=["token", "cls", "size", "pos", "heavy"],
            )

    return rows


def _index_role(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of the shorter prefix that the smaller set of a pair needs; the larger probes with its whole prefix."""
    share = 2 * threshold / (1 + threshold)
    return rows.where(F.col("pos") < F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1)


def _met(threshold: float) -> Column:
    """Roles, size and position bounds of an index row ``a`` and a probe row ``b`` at their first common word; exact."""
    share = threshold / (1 + threshold)
    once = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.cls") < F.col("b.cls")))
    reach = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    return once & (F.col("a.size") >= threshold * F.col("b.size") - 1e-9) & (reach >= share * (F.col("a.size") + F.col("b.size")) - 1e-9)


def _pair() -> list[Column]:
    return [F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b")]


def _near(threshold: float) -> Column:
    """What the triangle inequality leaves of two members of one cell, one of them at home."""
    return (F.abs(F.col("a.dist") - F.col("b.dist")) <= 1 - threshold + 1e-9) & (F.col("a.home") | F.col("b.home"))


def _direct(rows: DataFrame, key: str, threshold: float, extra: Column | None = None) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the rows of one region."""
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & _met(threshold)
    # A region here is bounded by the comparisons that _comparisons allows it, so its exchange needs no skew splitting and
    # one serves both sides: the index filter stays above it as it is not deterministic to the optimiser.
    spread = rows.repartition(key)
    index = _index_role(spread.withColumn("pos", F.col("pos") + F.spark_partition_id() * 0), threshold)
    return index.alias("a").join(spread.alias("b"), on if extra is None else on & extra).select(*_pair())


def _in_blocks(rows: DataFrame, sizes: DataFrame, limit: int, threshold: float) -> DataFrame:
    """Candidate pairs of large cells, cut into blocks: one task sees two blocks, every pair of rows meets once."""
    blocked = rows.join(sizes.select("cell", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("blocks")), "cell").withColumn(
        "block", F.pmod(F.xxhash64("cls", F.lit(17)), F.col("blocks").cast("long")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = _index_role(blocked, threshold).withColumn("other", every).alias("a")
    right = blocked.withColumn("other", every).alias("b")
    on = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.block") == F.col("b.other")) & (F.col("a.other") == F.col("b.block"))
    return left.join(right, on & _near(threshold) & _met(threshold)).select(*_pair())


def _distance(x: Column, y: Column) -> Column:
    common = F.size(F.array_intersect(x, y))
    return F.lit(1.0) - common / (F.size(x) + F.size(y) - common)


def _split(rows: DataFrame, classes: DataFrame, pivots: int, threshold: float) -> DataFrame:
    """One Voronoi split of every cell: rows (cell, cls, size, pos, home, dist) of the sub-cells.

    A document goes home to its nearest pivot and is replicated to each cell whose pivot is at most
    2r farther: two documents within r always meet in the home cell of either.
    """
    radius = 1 - threshold
    full = rows.join(classes, "cls")
    chosen = (
        full.where("home")
        .withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("cls", "cell"), "cls")))
        .where(F.col("rank") <= pivots)
        .groupBy("cell")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "words"))), lambda s: s["words"]).alias("pivot_words"))
    )
    measured = full.join(chosen, "cell").withColumn("dists", F.transform("pivot_words", lambda p: _distance(F.col("words"), p)))
    nearest = F.array_min("dists")
    spread = measured.select("cell", "cls", "size", "pos", F.col("home").alias("was_home"), "dists", nearest.alias("nearest"), (F.array_position("dists", nearest) - 1).cast("int").alias("home_at"))
    cells = spread.select("*", F.posexplode("dists").alias("at", "dist")).where(F.col("dist") <= F.col("nearest") + 2 * radius + 1e-9)
    return cells.select(
        F.xxhash64("cell", "at").alias("cell"), "cls", "size", "pos", (F.col("was_home") & (F.col("at") == F.col("home_at"))).alias("home"), "dist", F.col("cell").alias("parent")
    )


def _comparisons(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, n, work): rows and index-by-probe comparisons of each region."""
    share = 2 * threshold / (1 + threshold)
    index = F.count_if(F.col("pos") < F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1)
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(n.alias("n"), (index.cast("double") * n).alias("work"))


def _large_pairs(regions: DataFrame, classes: DataFrame, scratch: Scratch, threshold: float, region_rows: int, pivots: int, depth: int) -> DataFrame:
    """Candidate pairs of the large regions, by recursive pivot splits and, at the end, blocks."""
    rows = scratch.keep(regions.select(F.col("token").alias("cell"), "cls", "size", "pos", F.lit(True).alias("home"), F.lit(0.0).alias("dist")), "cells-0")
    kept = scratch.keep(classes.join(rows.select("cls").distinct(), "cls", "left_semi"), "cell-classes")
    found: list[DataFrame] = []
    for level in range(depth + 1):
        cells = scratch.keep(_comparisons(rows, "cell", threshold), f"sizes-{level}")
        large = cells.where(F.col("work") > float(region_rows) ** 2)
        found.append(_direct(rows.join(large.select("cell"), "cell", "left_anti"), "cell", threshold, _near(threshold)))
        if large.isEmpty():
            break
        rows = rows.join(large.select("cell"), "cell", "left_semi")
        if level == depth:
            found.append(_in_blocks(rows, large, region_rows, threshold))
            break
        split = scratch.keep(_split(rows, kept, pivots, threshold), f"split-{level + 1}")
        # A split pays if its cells cost less than half the comparisons of the cell they came from.
        after = _comparisons(split, "cell", threshold).join(split.select("cell", "parent").distinct(), "cell").groupBy("parent").agg(F.sum("work").alias("after"))
        pays = scratch.keep(large.join(after.withColumnRenamed("parent", "cell"), "cell").where(F.col("after") < 0.5 * F.col("work")).select("cell"), f"pays-{level + 1}")
        found.append(_in_blocks(rows.join(pays, "cell", "left_anti"), large, region_rows, threshold))
        rows = split.join(pays.withColumnRenamed("cell", "parent"), "parent", "left_semi").select("cell", "cls", "size", "pos", "home", "dist")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, region_rows: int = REGION_ROWS, pivots: int = PIVOTS, depth: int = DEPTH, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """All pairs (cls_a, cls_b, shared, size_a, size_b), cls_a < cls_b, with Jaccard of at least ``threshold``.

    ``docs`` is (cls long, words array<long>), one or more rows per class with the same words; it is
    read several times, so give a written table. Classes without words are similar to nothing; no
    words, no classes or one class give no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    docs = docs.where(F.col("cls").isNotNull() & F.col("words").isNotNull() & (F.size("words") > 0))
    sketch = spark.sparkContext.broadcast((frequency_sketch(docs, sketch_bits), region_rows))
    prefix, schema = _prefix_rows(sketch, threshold), "token int not null, cls long not null, size int not null, pos int not null, heavy boolean not null"
    classes = docs.groupBy("cls").agg(F.first("words").alias("words"))
    regions = classes.mapInArrow(prefix, schema).select("token", "cls", "size", "pos")
    # A bucket's count bounds the size of its words' regions: only words of full buckets can have large ones.
    scratch = Scratch(spark)
    suspects = docs.mapInArrow(prefix, schema).where("heavy")
    large = scratch.keep(_comparisons(suspects, "token", threshold).where(F.col("work") > float(region_rows) ** 2).select("token"), "large-regions")
    if large.isEmpty():
        candidates = _direct(regions, "token", threshold)
    else:
        candidates = _direct(regions.join(large, "token", "left_anti"), "token", threshold).unionByName(
            _large_pairs(regions.join(large, "token", "left_semi"), classes, scratch, threshold, region_rows, pivots, depth)
        )
    met = candidates.distinct()
    left, right = classes.select(F.col("cls").alias("a"), F.col("words").alias("words_a")), classes.select(F.col("cls").alias("b"), F.col("words").alias("words_b"))
    checked = met.join(left, "a").join(right, "b").select(
        F.col("a").alias("cls_a"), F.col("b").alias("cls_b"), F.size(F.array_intersect("words_a", "words_b")).alias("shared"), F.size("words_a").alias("size_a"), F.size("words_b").alias("size_b")
    )
    return checked.where(F.col("shared") * (1 + threshold) >= threshold * (F.col("size_a") + F.col("size_b")) - 1e-9)


def question_words(questions: DataFrame) -> DataFrame:
    """(ordinal, copy_key, cls, words) of question rows: cls names the set of words, copy_key the formatting class."""
    keyed = questions.where(F.col("ordinal").isNotNull()).select(
        F.col("ordinal").cast("long").alias("ordinal"),
        F.xxhash64(question_key(F.col("question_text"), F.col("choices_json"))).alias("copy_key"),
        words_of(F.coalesce("question_text", F.lit("")), F.array_join(option_texts(F.col("choices_json")), " ")).alias("words"),
    )
    return keyed.withColumn("cls", F.xxhash64(F.array_sort("words")))


def _units(docs: DataFrame) -> DataFrame:
    """(cls, copy_key, first, n) of every set of copies with equal words; ``first`` is its smallest ordinal."""
    return docs.where(F.size("words") > 0).groupBy("cls", "copy_key").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))


def _side(df: DataFrame, mark: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{mark}") for c in df.columns])


def _unit_links(docs: DataFrame, units: DataFrame, threshold: float, **options) -> DataFrame:
    """Pairs of units (columns of ``units`` ending in _a and _b) that share enough words and are not copies; each pair once."""
    across = similar_classes(docs.select("cls", "words"), threshold, **options).select("cls_a", "cls_b")
    a, b = _side(units, "a"), _side(units, "b")
    between = across.join(a, "cls_a").join(b, "cls_b").where(F.col("copy_key_a") != F.col("copy_key_b"))
    within = a.join(b, (F.col("cls_a") == F.col("cls_b")) & (F.col("copy_key_a") < F.col("copy_key_b")))
    columns = [*a.columns, *b.columns]
    return between.select(*columns).unionByName(within.select(*columns))


def near_duplicates(questions: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Pairs (ordinal_a, ordinal_b), ordinal_a < ordinal_b, of rows that are not copies and share ``threshold`` of their words.

    Exact copies are compared once: pairs are found between sets of copies and only then expanded. A null stem or
    choice list counts as empty; rows without any word pair with nothing; rows with a null ordinal are left out;
    other columns are ignored. Where sets of copies are large, :func:`near_links` has the same links unexpanded.
    """
    docs = Scratch(questions.sparkSession).keep(question_words(questions), "documents")
    units = _units(docs).select("cls", "copy_key")
    linked = _unit_links(docs, units, threshold, **options)
    # The planner's own exchanges, so that a class with many copies is split where it is skewed.
    members = docs.where(F.size("words") > 0).select("cls", "copy_key", "ordinal")
    both = linked.join(_side(members, "a"), ["cls_a", "copy_key_a"]).join(_side(members, "b"), ["cls_b", "copy_key_b"])
    return both.select(F.least("ordinal_a", "ordinal_b").alias("ordinal_a"), F.greatest("ordinal_a", "ordinal_b").alias("ordinal_b"))


def near_links(questions: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Pairs (first_a, first_b), first_a < first_b, of linked sets of copies, each named by its smallest ordinal.

    Sets are of equal copies and equal words; with their members they say the same as all pairs of rows.
    """
    docs = Scratch(questions.sparkSession).keep(question_words(questions), "documents")
    linked = _unit_links(docs, _units(docs).select("cls", "copy_key", "first"), threshold, **options)
    return linked.select(F.least("first_a", "first_b").alias("first_a"), F.greatest("first_a", "first_b").alias("first_b"))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of every node's connected component, for the nodes of ``edges`` (a, b).

    Large-star and small-star in turn, each round a written table of at most as many edges as before: neither edges
    nor components meet in one task or the driver. Loops and repeated edges do nothing.
    """
    edge = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.keep(edge, "edges-0")
    state = None
    for number in range(1, most_rounds + 1):
        every = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = every.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = every.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.keep(small, f"edges-{number}")
        before, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(questions: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(ordinal, class_id, n_links, group_id) of every row with an ordinal: where it belongs.

    ``class_id`` is the smallest ordinal of its copies with equal words, ``n_links`` the number of such sets it is
    linked to, ``group_id`` the smallest ordinal of all that links and copies connect. Rows without any word have
    no links; those among them that are copies of each other form one class.
    """
    scratch = Scratch(questions.sparkSession)
    docs = scratch.keep(question_words(questions), "documents")
    units = scratch.keep(docs.groupBy("cls", "copy_key").agg(F.min("ordinal").alias("first"), F.max(F.size("words")).alias("n_words")), "units")
    links = scratch.keep(_unit_links(docs, units.where(F.col("n_words") > 0).select("cls", "copy_key", "first"), threshold, **options).select("first_a", "first_b"), "links")
    ends = links.select(F.col("first_a").alias("first")).unionAll(links.select("first_b"))
    degree = ends.groupBy("first").agg(F.count(F.lit(1)).alias("n_links"))
    # Copies with different words (a hyphen more or less) belong together as well.
    heads = units.groupBy("copy_key").agg(F.min("first").alias("head"))
    tied = units.join(heads, "copy_key").where(F.col("first") != F.col("head")).select(F.col("first").alias("a"), F.col("head").alias("b"))
    roots = components(links.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).unionByName(tied), scratch)
    named = units.join(degree, "first", "left").join(roots.withColumnRenamed("node", "first"), "first", "left")
    named = named.select("cls", "copy_key", F.col("first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "first").alias("group_id"))
    return docs.select("ordinal", "cls", "copy_key").join(named, ["cls", "copy_key"]).select("ordinal", "class_id", "n_links", "group_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "toy_normalized"))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    return near_links(table(spark, folder, "toy_normalized"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "toy_normalized"))


QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p2_groups": p2_groups}


def _oracle(result: str) -> str:
    from plumbline.llm.formatting_dedup import _sql_keys

    least = math.floor(THRESHOLD * 1000)
    return (
        _sql_keys().replace("WITH options", "WITH RECURSIVE options", 1)
        + f""", bags AS (
  SELECT q.ordinal, list_sort(list_distinct(regexp_extract_all(lower(coalesce(q.question_text, '') || ' ' || coalesce((SELECT string_agg(t, ' ') FROM (SELECT unnest(json_extract_string(q.choices_json, '$[*].text')) AS t)), '')), '[\\p{{L}}\\p{{N}}]+'))) AS bag
  FROM toy_normalized q
), words AS (SELECT ordinal, unnest(bag) AS w FROM bags), sizes AS (SELECT ordinal, len(bag) AS n FROM bags),
shared AS (SELECT a.ordinal AS x, b.ordinal AS y, count(*) AS c FROM words a JOIN words b ON a.w = b.w AND a.ordinal < b.ordinal GROUP BY ALL),
pairs AS (SELECT x AS ordinal_a, y AS ordinal_b FROM shared
  JOIN sizes s ON s.ordinal = x JOIN sizes t ON t.ordinal = y
  JOIN keys k ON k.table_name = 'toy_normalized' AND k.id = x JOIN keys l ON l.table_name = 'toy_normalized' AND l.id = y
  WHERE k.key <> l.key AND 1000 * c >= {least} * (s.n + t.n - c)),
classes AS (SELECT ordinal, min(ordinal) OVER (PARTITION BY bag, key) AS class_id, min(ordinal) OVER (PARTITION BY key) AS head FROM bags JOIN keys ON table_name = 'toy_normalized' AND id = ordinal),
links AS (SELECT DISTINCT ordinal_a AS first_a, ordinal_b AS first_b FROM pairs JOIN classes a ON a.ordinal = ordinal_a AND a.class_id = ordinal_a JOIN classes b ON b.ordinal = ordinal_b AND b.class_id = ordinal_b){result}"""
    )


ORACLE_SQL = {
    "p2_found": _oracle(" SELECT ordinal_a, ordinal_b FROM pairs"),
    "p2_links": _oracle(" SELECT first_a, first_b FROM links"),
    "p2_groups": _oracle(
        """,
edges AS (SELECT first_a AS x, first_b AS y FROM links UNION SELECT first_b, first_a FROM links UNION SELECT class_id, head FROM classes UNION SELECT head, class_id FROM classes),
reach(x, r) AS (SELECT DISTINCT class_id, class_id FROM classes UNION SELECT e.y, r FROM reach JOIN edges e ON e.x = reach.x),
roots AS (SELECT x, min(r) AS group_id FROM reach GROUP BY x), degree AS (SELECT x, count(*) AS n_links FROM (SELECT first_a AS x FROM links UNION ALL SELECT first_b FROM links) GROUP BY x)
SELECT ordinal, class_id, coalesce(n_links, 0) AS n_links, group_id FROM classes c JOIN roots ON roots.x = class_id LEFT JOIN degree d ON d.x = class_id"""
    ),
}
