"""Problem 8: subject areas of documents, by linear classifiers over hashed word n-grams.

One-versus-rest logistic classifiers are trained on the sentences of a bounded sample of questions and of
replies to them, weakly labelled by the subject path of the question. (Titles, shelves and sources say nothing about
the area of these documents, so no labels come from them; README has the figures.) Thresholds are calibrated for each
area on held-out sentences. Every sentence of every document is then scored, and a document has each area
that at least two of its sentences are about.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import seeded_uniform, table
from plumbline.llm.proportional_sampling import category_key

#: Questions per area in the training sample, and replies taken of one question.
SAMPLE_QUESTIONS, REPLIES_EACH = 1000, 3
#: Hashed features, and how often one must occur in the sample to be learned.
FEATURE_BITS, LEAST_COUNT = 20, 3
#: Labelled documents of no area in the training sample.
SAMPLE_NONE = 2000
#: Thresholds whose held-out gain is within this share of the best count as equal.
PLATEAU = 0.01
#: Log-odds among which thresholds are looked for.
THRESHOLDS = (-3.0, 3.0)
#: No word speaks against an area by more than this: sentences are told apart by the words of areas.
LEAST_WEIGHT = 0.25
#: A sentence is about its best area and about others within this many log-odds of it.
MARGIN = 1.0
#: Sentences that make an area (TESTDATA.md).
LEAST_SENTENCES = 2
SEED = 8

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_BREAK = re.compile(r"(?<=[.?!])[\s\"'”»)\]*_]+")
_OPTION = re.compile(r"^[\s>*-]*[A-Z][.)]\s")
_WORD = re.compile(r"[^\W\d_]+")


def sentences_of(text: str | None) -> list[list[str]]:
    """Words of each sentence; tags, lettered option lines and pieces of fewer than three words don't count."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("\n", text)
    lines = (line for line in text.split("\n") if line and not _OPTION.match(line))
    pieces = (_WORD.findall(s.lower()) for line in lines for s in _BREAK.split(line))
    return [p for p in pieces if len(p) >= 3]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def features(sentences: list[list[str]], cache: _Hashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all sentences, one after the other, and the number of each: single words, then pairs of neighbours."""
    lengths = np.array([len(s) for s in sentences], dtype=np.int64)
    h = np.fromiter((cache[w] for s in sentences for w in s), dtype=np.uint64, count=int(lengths.sum()))
    mask = np.uint64((1 << bits) - 1)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits) if len(h) > 1 else h[:0]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[:-1] == owner[1:] if len(h) > 1 else np.zeros(0, dtype=bool)
    return np.concatenate([h & mask, pairs[inside] & mask]).astype(np.int64), np.concatenate([owner, owner[:-1][inside]] if len(h) > 1 else [owner])


class AreaModel:
    """Column of each hashed feature, weights (columns by areas), biases and calibrated thresholds."""

    def __init__(self, areas: list[str], columns: np.ndarray, weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray, bits: int):
        self.areas, self.columns, self.weights, self.bias, self.thresholds, self.bits = areas, columns, weights, bias, thresholds, bits

    def scores(self, sentences: list[list[str]], cache: _Hashes) -> np.ndarray:
        """Log-odds of each sentence and area."""
        f, owner = features(sentences, cache, self.bits)
        at = self.columns[f]
        at, owner = at[at >= 0], owner[at >= 0]
        out = np.empty((len(sentences), len(self.areas)))
        for a in range(len(self.areas)):
            out[:, a] = np.bincount(owner, weights=self.weights[at, a], minlength=len(sentences)) + self.bias[a]
        return out

    def about(self, sentences: list[list[str]], cache: _Hashes) -> np.ndarray:
        """Which areas each sentence is about."""
        z = self.scores(sentences, cache)
        return (z >= self.thresholds) & (z >= z.max(axis=1, keepdims=True) - MARGIN)


def _fit_area(data: tuple, a: int, size: int, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias of one area against the rest, by gradient steps scaled by their history."""
    at, rows, y, sample_weight = data
    n, target = len(y), (y == a).astype(float)
    w, b = np.zeros(size), -2.2
    gw, gb = np.full(size, 1e-12), 1e-12
    for _ in range(rounds):
        z = np.bincount(rows, weights=w[at], minlength=n) + b
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - target) * sample_weight
        g = np.bincount(at, weights=error[rows], minlength=size) / n + penalty * w
        gw += g * g
        w = np.maximum(w - 0.5 * g / np.sqrt(gw), -LEAST_WEIGHT)
        g0 = error.mean()
        gb += g0 * g0
        b -= 0.2 * g0 / np.sqrt(gb)
    return w, float(b)


def _fit_areas(spark: SparkSession | None, data: tuple, present: np.ndarray, size: int, rounds: int, penalty: float) -> list[tuple[int, np.ndarray, float]]:
    """One classifier for each present area, each in a task of its own where there is a session."""
    if spark is None or not len(present):
        return [(int(a), *_fit_area(data, int(a), size, rounds, penalty)) for a in present]
    shared = spark.sparkContext.broadcast(data)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column("id").to_pylist():
                w, b = _fit_area(shared.value, a, size, rounds, penalty)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([b])], names=["area", "weights", "bias"])

    # One partition for each area; what comes back has the size of the bounded sample's features.
    each = spark.range(0, int(present.max()) + 1, 1, int(present.max()) + 1).where(F.col("id").isin([int(a) for a in present]))
    fitted = each.mapInArrow(fit, "area long, weights binary, bias double").collect()
    shared.unpersist()
    return [(r["area"], np.frombuffer(r["weights"], dtype=np.float32), r["bias"]) for r in fitted]


def train(
    texts: list[str], labels: list[str | None], areas: list[str], groups: list | None = None, spark: SparkSession | None = None, bits: int = FEATURE_BITS, least: int = LEAST_COUNT, rounds: int = 80, penalty: float = 2e-6
) -> AreaModel:
    """Fit one classifier for each area on the sentences of weakly labelled texts and calibrate its threshold.

    The label None means no area. Every fifth of ``groups`` (texts about one question; by default each text is its
    own) is held out, and of its sentences those that no training text has. Sentences count by the inverse size of
    their label, so labels weigh alike. An area without training texts is never given; without any texts no document
    has an area.
    """
    cache, place = _Hashes(), {a: i for i, a in enumerate(areas)} | {None: len(areas)}
    size = 1 << bits
    groups = list(range(len(texts))) if groups is None else groups
    parts = [(g, s, place[y]) for g, t, y in zip(groups, texts, labels) if y in place for s in sentences_of(t)]
    held = np.array([xxhash.xxh32_intdigest(str(g)) % 5 == 0 for g, _, _ in parts], dtype=bool)
    y = np.array([c for _, _, c in parts], dtype=np.int64)
    sentences = [s for _, s, _ in parts]
    columns, thresholds = np.full(size, -1, dtype=np.int32), np.full(len(areas), np.inf)
    if not parts or held.all():
        return AreaModel(areas, columns, np.zeros((1, len(areas)), dtype=np.float32), np.full(len(areas), -20.0), thresholds, bits)
    seen = {tuple(s) for s, h in zip(sentences, held) if not h}
    checked = np.array([h and tuple(s) not in seen for s, h in zip(sentences, held)], dtype=bool)
    f, owner = features(sentences, cache, bits)
    learned = ~held[owner]
    known = np.flatnonzero(np.bincount(f[learned], minlength=size) >= least)
    columns[known] = np.arange(len(known))
    use = learned & (columns[f] >= 0)
    y_train = y[~held]
    share = np.bincount(y_train, minlength=len(areas) + 1).astype(float)
    sample_weight = 1.0 / share[y_train]
    sample_weight *= len(y_train) / sample_weight.sum()
    weights, bias = np.zeros((max(1, len(known)), len(areas)), dtype=np.float32), np.full(len(areas), -20.0)
    present = np.flatnonzero(share[: len(areas)] > 0)
    data = (columns[f[use]], (np.cumsum(~held) - 1)[owner[use]].astype(np.int32), y_train, sample_weight)
    for a, w, b in _fit_areas(spark, data, present, len(known), rounds, penalty):
        weights[: len(known), a], bias[a] = w, b
    model = AreaModel(areas, columns, weights, bias, thresholds, bits)
    scored = model.scores([s for s, c in zip(sentences, checked) if c], cache)
    y_held = y[checked]
    weight_held = 1.0 / np.maximum(np.bincount(y_held, minlength=len(areas) + 1), 1)[y_held]
    for a in present:
        thresholds[a] = calibrated(scored[:, a], y_held == a, weight_held)
    return model


def calibrated(scores: np.ndarray, positive: np.ndarray, weight: np.ndarray, span: tuple[float, float] = THRESHOLDS) -> float:
    """The log-odds in ``span`` at which held-out hits of the area most outweigh the others; of equals the middle.

    That is where a sentence is as likely of the area as not. Unlike a wanted precision it can be met whatever share
    of the weak labels is wrong. "Equal" is within PLATEAU of the best.
    """
    grid = np.arange(span[0], span[1] + 1e-9, 0.1)
    gain = np.array([(weight * np.where(positive, 1.0, -1.0))[scores >= t].sum() for t in grid])
    good = grid[gain >= gain.max() - PLATEAU * abs(gain.max())]
    return float(good[(len(good) - 1) // 2])


def training_sample(questions: DataFrame, replies: DataFrame, subject_areas: dict[str, str], per_area: int = SAMPLE_QUESTIONS, each: int = REPLIES_EACH, seed: int = SEED) -> DataFrame:
    """(text, area, question): stems of about ``per_area`` questions of each area and at most ``each`` replies to each of them.

    ``subject_areas`` gives the area of each subject path.

    Questions are chosen by a uniform of their identifier, so questions and replies are cut down alike before
    they are joined, and the sample is the same in every run. Its size is bounded by the areas, not the data.
    """
    spark = questions.sparkSession
    known = spark.createDataFrame([(k.replace("_", ""), a) for k, a in subject_areas.items()], "ckey string, area string")
    labelled = questions.where(F.col("question_id").isNotNull()).select("question_id", "question_text", category_key(F.col("subject")).alias("ckey")).join(F.broadcast(known), "ckey")
    sizes = {r["area"]: r["count"] for r in labelled.groupBy("area").count().collect()}
    rate = F.lit(0.0)
    for area, n in sizes.items():
        rate = F.when(F.col("area") == area, F.lit(min(1.0, per_area / n))).otherwise(rate)
    u = seeded_uniform("question_id", seed=seed)
    # One row per question: which of its repeated rows is kept does not depend on their order.
    chosen = labelled.where(u < rate).groupBy("question_id").agg(F.min(F.struct("area", "question_text")).alias("q")).select("question_id", "q.area", F.col("q.question_text").alias("text"))
    most = max([min(1.0, per_area / n) for n in sizes.values()], default=0.0)
    near = replies.where(F.col("raw_text").isNotNull() & (u < F.lit(most))).select("question_id", "response_id", F.col("raw_text").alias("text"))
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.xxhash64("response_id"), "response_id"))).where(F.col("rank") <= each)
    answered = first.join(chosen.select("question_id", "area"), "question_id").select("text", "area", F.col("question_id").alias("question"))
    return chosen.select("text", "area", F.col("question_id").alias("question")).unionByName(answered)


def _labels(shared, least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, _Hashes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            split = [sentences_of(t) for t in batch.column("text").to_pylist()]
            flat = [s for doc in split for s in doc]
            if not flat:
                continue
            owner = np.repeat(np.arange(len(split)), [len(doc) for doc in split])
            about = model.about(flat, cache)
            doc, area, count = [], [], []
            for a in range(len(model.areas)):
                n = np.bincount(owner[about[:, a]], minlength=len(split))
                for d in np.flatnonzero(n >= least):
                    doc.append(ids[d])
                    area.append(model.areas[a])
                    count.append(int(n[d]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(area, pa.string()), pa.array(count, pa.int32())], names=["doc_id", "area", "n_sentences"])

    return rows


def document_areas(documents: DataFrame, model: AreaModel, least: int = LEAST_SENTENCES) -> DataFrame:
    """(doc_id, area, n_sentences) of every area with at least ``least`` sentences in the whole text.

    Null ids and null or empty texts give nothing; a repeated row of a document gives its areas once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    read = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(_labels(shared, least), "doc_id long, area string, n_sentences int").groupBy("doc_id", "area").agg(F.max("n_sentences").alias("n_sentences"))


def none_sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_NONE, seed: int = SEED) -> DataFrame:
    """(text, area null) of at most about ``most`` documents that a hand label gives no area and none gives one."""
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("area") == "none").alias("no_area"), (F.min("area") == "none").alias("only"))
    chosen = marked.where("no_area and only").select("doc_id")
    rate = min(1.0, most / max(1, chosen.count()))
    near = chosen.where(seeded_uniform("doc_id", seed=seed) < rate)
    return documents.select("doc_id", "text").join(near, "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text")).select("text", F.lit(None).cast("string").alias("area"))


# The area of each subject path.
SUBJECT_AREAS = {
    "wave_mechanics": "science",
    "cell_biology": "science",
    "reaction_chemistry": "science",
    "clinical_practice": "medicine",
    "anatomy_basics": "medicine",
    "drug_dosing": "medicine",
    "contract_law": "law",
    "criminal_procedure": "law",
    "public_law": "law",
    "monetary_policy": "economics",
    "trade_theory": "economics",
    "accounting_basics": "economics",
    "ancient_states": "history",
    "medieval_towns": "history",
    "modern_revolts": "history",
    "land_forms": "geography",
    "climate_regions": "geography",
    "map_reading": "geography",
    "track_athletics": "sport",
    "team_games": "sport",
    "rules_of_play": "sport",
    "query_languages": "software",
    "systems_programming": "software",
    "packet_networks": "software",
    "tonal_harmony": "music",
    "score_reading": "music",
    "instrument_making": "music",
    "kitchen_hygiene": "cooking",
    "bread_baking": "cooking",
    "regional_dishes": "cooking",
}


def test_model(spark: SparkSession, folder: str) -> AreaModel:
    """The model trained on toy_normalized, model_responses and labelled documents of no area."""
    areas = sorted(r["area"] for r in table(spark, folder, "subject_areas").select("area").collect())
    sample = training_sample(table(spark, folder, "toy_normalized"), table(spark, folder, "model_responses"), SUBJECT_AREAS)
    none = none_sample(table(spark, folder, "documents"), table(spark, folder, "document_labels"))
    rows = sample.unionByName(none.withColumn("question", F.sha2("text", 256))).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["area"] or "", r["question"], r["text"]))
    return train([r["text"] for r in rows], [r["area"] for r in rows], areas, [r["question"] for r in rows], spark)


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    return document_areas(table(spark, folder, "documents"), test_model(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder).select("doc_id", "area")


def composition(documents: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, documents, chars, document_share, char_share) of the corpus; ``none`` stands for documents without an area.

    A document counts whole under each of its areas, but its shares are split evenly among them, so they add up to 1.
    ``areas`` is (doc_id, area); null texts have no characters; repeated rows of a document count as they are.
    """
    given = areas.groupBy("doc_id").agg(F.collect_set("area").alias("given"))
    every = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")).join(given, "doc_id", "left")
    split = every.select("chars", F.size(F.coalesce("given", F.array(F.lit("none")))).alias("n"), F.explode(F.coalesce("given", F.array(F.lit("none")))).alias("area"))
    sums = split.groupBy("area").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"), F.sum(1 / F.col("n")).alias("d"), F.sum(F.col("chars") / F.col("n")).alias("c"))
    # One row for each area.
    whole = sums.agg(F.sum("d").alias("all_d"), F.sum("c").alias("all_c"))
    return sums.crossJoin(F.broadcast(whole)).select("area", "documents", "chars", (F.col("d") / F.col("all_d")).alias("document_share"), F.try_divide("c", "all_c").alias("char_share"))


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """What the corpus is about, documents of no area included."""
    return composition(table(spark, folder, "documents"), _areas(spark, folder).select("doc_id", "area"))


QUERIES = {"p8_found": p8_found, "p8_composition": p8_composition}
ORACLE_SQL: dict[str, str] = {}
