"""Problem 6: evaluation passages inside training documents, by spaced-seed hashing.

Fixed masks choose some positions of every window of words; the hash of the chosen words is the seed.
A seed ignores the words under the mask's gaps, so it still hits where single words were replaced.
Test seeds and document seeds are joined, and every hit is verified word by word along its diagonal.

Documents are read once. A bitmap of the test seeds, of a fixed size, lets only windows that can hit
leave the scan; false hits are removed by the join, so the bitmap decides nothing. Only windows around hits are verified.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table

#: Consecutive words that make a leak (TESTDATA.md).
LEAST_WORDS = 12
#: Masks over one window of words: 1 is compared, 0 is ignored. An overlap in which a replaced word costs 3 starts with 4
#: equal words before the first replaced word and 7 before the second: so its first 7 equal words are one of these.
MASKS = ("11111110", "11110111", "11111011", "11111101")
#: Bits of the seed bitmap: 2 MB, whatever the number of test items.
BITMAP_BITS = 24

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_BROKEN = re.compile(r"(?<=[^\W_])-[^\S\n]*\n[^\w\n]*(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; tags don't count and a word broken at a line end is one word."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower())


#: Odd multipliers of the places in a window; places further on get others.
_PLACE = [0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * k & 0xFFFFFFFFFFFFFFFF for k in range(16)]


class _Hashes(dict):
    """64-bit hash by word; emptied when it has grown, so its size is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _seeds(hashes: np.ndarray, lengths: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask: its number, then text number, word position and seed of every window of every text."""
    span = len(masks[0])
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    windows = np.maximum(lengths - span + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), windows)
    if not len(owner):
        return
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[owner] + pos
    # Every word of a window is hashed for its place once; a mask takes the ignored places off the sum of all.
    ignored = {o for m in masks for o, kept in enumerate(m) if kept == "0"}
    every, apart = np.zeros(len(at), dtype=np.uint64), {}
    for offset in range(span):
        term = hashes[at + offset] * np.uint64((_PLACE[offset % len(_PLACE)] + (offset // len(_PLACE)) * 2) & 0xFFFFFFFFFFFFFFFF)
        every += term
        if offset in ignored:
            apart[offset] = term
    for number, mask in enumerate(masks):
        seed = every + np.uint64(number + 1)
        for offset, kept in enumerate(mask):
            if kept == "0":
                seed -= apart[offset]
        seed = (seed ^ (seed >> np.uint64(29))) * np.uint64(_PLACE[0])
        yield number, owner, pos, seed ^ (seed >> np.uint64(32))


def _tokenised(texts: pa.Array, cache: _Hashes) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    words = [words_of(t) for t in texts.to_pylist()]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    hashes = np.fromiter((cache[w] for text in words for w in text), dtype=np.uint64, count=int(lengths.sum()))
    return words, lengths, hashes


def _item_seeds(masks: tuple[str, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            _, lengths, hashes = _tokenised(batch.column("text"), cache)
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            for _, owner, pos, seed in _seeds(hashes, lengths, masks):
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(ids[owner], pa.int64()), pa.array(pos, pa.int32()), pa.array(lengths[owner], pa.int32())], names=["seed", "item_id", "item_pos", "item_words"])

    return rows


def seed_bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Which of 2^bits buckets hold a seed: built per task and merged in compressed slices of fixed size."""
    size, slices = 1 << bits, 16
    width = size // slices

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=bool)
        for batch in batches:
            seen[batch.column("seed").to_numpy(zero_copy_only=False) & (size - 1)] = True
        parts = [zlib.compress(np.packbits(seen[i * width : (i + 1) * width]).tobytes(), 1) for i in range(slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "bitmap"])

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        total = np.zeros(width // 8, dtype=np.uint8)
        for bitmap in part.column("bitmap"):
            total |= np.frombuffer(zlib.decompress(bitmap.as_py()), dtype=np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([total.tobytes()], pa.binary())})

    rows = seeds.select("seed").mapInArrow(mark, "slice int, bitmap binary").groupBy("slice").applyInArrow(merge, "slice int, bitmap binary").toArrow().to_pylist()
    whole = np.zeros(size // 8, dtype=np.uint8)
    for row in rows:
        whole[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return whole


_HIT_SCHEMA = "doc_id long, words string, hits array<struct<seed:long,pos:int>>"


def _document_hits(bitmap, masks: tuple[str, ...], bits: int):
    """Documents with at least one window whose seed may be a test seed: their words and those windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packed, low = _Hashes(), bitmap.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            words, lengths, hashes = _tokenised(batch.column("text"), cache)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found: dict[int, list[dict]] = {}
            for _, owner, pos, seed in _seeds(hashes, lengths, masks):
                bucket = seed & low
                hit = np.flatnonzero((packed[bucket >> np.uint64(3)] >> (np.uint64(7) - (bucket & np.uint64(7))).astype(np.uint8)) & 1)
                for o, p, s in zip(owner[hit].tolist(), pos[hit].tolist(), seed[hit].view(np.int64).tolist()):
                    found.setdefault(o, []).append({"seed": s, "pos": p})
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[list(found)], pa.int64()), pa.array([" ".join(words[o]) for o in found], pa.string()), pa.array(list(found.values()), pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())])))],
                    names=["doc_id", "words", "hits"],
                )

    return rows


def _overlap(doc: list[str], item: list[str], shift: int, penalty: int) -> tuple[int, int, int]:
    """Along one diagonal: longest run of equal words; words and substitutions of the best tolerant overlap."""
    first, last = max(0, -shift), min(len(item), len(doc) - shift)
    longest = run = 0
    score = best = 0
    matched = replaced = 0
    best_pair, pending = (0, 0), (0, 0)
    for k in range(first, last):
        if item[k] == doc[k + shift]:
            run += 1
            longest = max(longest, run)
            if score <= 0:
                score, pending = 0, (0, 0)
            score += 1
            pending = (pending[0] + 1, pending[1])
            if score > best:
                best, best_pair = score, pending
        else:
            run = 0
            score -= penalty
            pending = (pending[0], pending[1] + 1)
    matched, replaced = best_pair
    return longest, matched, replaced


_WINDOW_SCHEMA = "doc_id long, item_id long, shift int, window string"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every document and diagonal the words that the item can lie on, and the diagonal within them."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("doc_id", "item_id", "shift", "window")}
        for doc_id, text, diagonals in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "words", "diagonals"))):
            words = text.split(" ")
            for d in diagonals:
                low = max(0, d["shift"])
                out["doc_id"].append(doc_id)
                out["item_id"].append(d["item_id"])
                out["shift"].append(d["shift"] - low)
                out["window"].append(" ".join(words[low : d["shift"] + d["item_words"]]))
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["item_id"], pa.int64()), pa.array(out["shift"], pa.int32()), pa.array(out["window"], pa.string())], names=list(out))


def _verified(penalty: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pydict()
            items = {t: words_of(t) for t in set(got["item_text"])}
            measured = [_overlap(w.split(" "), items[t], s, penalty) for w, t, s in zip(got["window"], got["item_text"], got["shift"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), *[pa.array([m[i] for m in measured], pa.int32()) for i in range(3)]], names=["doc_id", "item_id", "run_words", "same_words", "replaced_words"]
            )

    return rows


def leaked_passages(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, penalty: int = 3, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """(doc_id, item_id, run_words, same_words, replaced_words) of every document and item that share a seed.

    ``documents`` is (doc_id, text), ``items`` (item_id, text). ``run_words`` is the longest run of equal
    consecutive words; ``same_words`` and ``replaced_words`` describe the best overlap when single words
    may differ (a difference costs ``penalty`` equal words); an overlap of LEAST_WORDS equal words goes
    before others. Every run of ``len(mask)`` words is found, as its window hits under any mask. With MASKS
    and a penalty of 3 or more every overlap of 12 equal words is found, wherever words were replaced. Null ids and null, empty or shorter texts give nothing; repeated rows
    of one id are one document.
    """
    if len({len(m) for m in masks}) != 1:
        raise ValueError("masks must have one length")
    spark = documents.sparkSession
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    seeds = items.mapInArrow(_item_seeds(masks), "seed long, item_id long, item_pos int, item_words int").distinct()
    bitmap = spark.sparkContext.broadcast(seed_bitmap(seeds, bitmap_bits))
    read = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = Scratch(spark).keep(read.mapInArrow(_document_hits(bitmap, masks, bitmap_bits), _HIT_SCHEMA), "hits")
    diagonals = (
        hits.select("doc_id", F.explode("hits").alias("hit"))
        .select("doc_id", "hit.seed", "hit.pos")
        .join(seeds, "seed")
        .select("doc_id", F.struct("item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_words").alias("diagonal"))
        .groupBy("doc_id")
        .agg(F.collect_set("diagonal").alias("diagonals"))
    )
    # A document's words are carried once, however many diagonals it has; beyond that only the windows on them travel.
    windows = diagonals.join(hits.select("doc_id", "words"), "doc_id").mapInArrow(_windows, _WINDOW_SCHEMA)
    pairs = windows.join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "item_id", "shift", "window", "item_text")
    checked = pairs.mapInArrow(_verified(penalty), "doc_id long, item_id long, run_words int, same_words int, replaced_words int")
    best = F.max(F.struct((F.col("same_words") >= LEAST_WORDS).alias("long"), (F.col("same_words") - penalty * F.col("replaced_words")).alias("score"), "same_words", "replaced_words"))
    return checked.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), best.alias("best")).select("doc_id", "item_id", "run_words", "best.same_words", "best.replaced_words")


def _test_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", F.col("question").alias("text")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _test_leaks(spark, folder).where(F.col("run_words") >= LEAST_WORDS).select("doc_id", "item_id")


def p6_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps of at least 12 words when single words may be replaced, exact runs included."""
    return _test_leaks(spark, folder).where(F.col("same_words") >= LEAST_WORDS)


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Test items that leaked and the number of documents that hold each."""
    return p6_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def _sql() -> str:
    words = r"regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce({0}, ''), '</?[A-Za-z][^<>\n]*>', ' ', 'g'), '([\p{{L}}\p{{N}}])-[ \t\r\x{{a0}}]*\n[^\p{{L}}\p{{N}}_\n]*([\p{{L}}\p{{N}}])', '\1\2', 'g')), '[\p{{L}}\p{{N}}]+')"
    window = "array_to_string(list_slice(w, k, k + 11), ' ')"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {words.format("text")} AS w FROM documents), e AS (SELECT item_id, {words.format("question")} AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, {window} AS p FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS k FROM d)),
ew AS (SELECT DISTINCT item_id, {window} AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS k FROM e))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (p)"""


QUERIES = {"p6_found": p6_found, "p6_tolerant": p6_tolerant, "p6_items": p6_items}
ORACLE_SQL = {"p6_found": _sql(), "p6_items": f"SELECT item_id, count(*) AS n_documents FROM ({_sql()}) GROUP BY item_id"}
