"""File sources: id lists, calibration files, prompt folders, configs, toy questions."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import options as O


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """question_id list: the column of a CSV, or one id per line of any other file; blank lines are skipped."""
    if path.endswith(".csv"):
        ids = spark.read.option("header", True).csv(path).select("question_id")
    else:
        ids = spark.read.text(path).select(F.trim("value").alias("question_id"))
    return ids.where(F.col("question_id").isNotNull() & (F.trim("question_id") != ""))


def calibration_file(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The first ``n`` rows of a .jsonl (blank lines skipped) or .csv file in file order; other files are an error."""
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ordinal"), F.from_json("value", schema).alias("r")).select("ordinal", "r.*")
    elif path.endswith(".csv"):
        rows = spark.read.schema(schema).option("header", True).csv(path).select(F.monotonically_increasing_id().alias("ordinal"), "*")
    else:
        raise ValueError("calibration files are .jsonl or .csv")
    return rows.orderBy("ordinal").limit(n)


def prompt_folder(folder: str, version: str, required: tuple[str, ...] = ("direct_mcq", "free_text", "option_matching")) -> dict[str, str]:
    """Templates of one version by file stem: the required ones and any other ``*.txt``; the version is a plain name."""
    if not version or "/" in version or "\\" in version or version in (".", ".."):
        raise ValueError("a prompt version is a plain folder name")
    found = {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder, version).glob("*.txt"))}
    if missing := [name for name in required if name not in found]:
        raise ValueError(f"missing templates: {', '.join(missing)}")
    return found


def toy_questions(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Ten sums with four options; gold is A in rows 0, 7 and 8 and one of B, C and D in the others."""
    rng, rows = random.Random(seed), []
    for i, (a, b) in enumerate(rng.sample([(a, b) for a in range(2, 10) for b in range(a, 10)], 10)):
        wrong = [a + b + d for d in (1, -1, 2)]
        rng.shuffle(wrong)
        gold = 0 if i in (0, 7, 8) else rng.choice((1, 2, 3))
        texts = [str(w) for w in wrong]
        texts.insert(gold, str(a + b))
        rows.append((i, f"toy_{i + 1:03d}", "toy", f"How much is {a} plus {b}?", texts, gold))
    raw = spark.createDataFrame(rows, "ordinal long, question_id string, subject string, question_text string, texts array<string>, correct_index int")
    index = F.col("correct_index")
    return raw.select("ordinal", "question_id", "subject", "question_text", O.build_choices(F.col("texts")).alias("choices"), "correct_index", O.letter(index).alias("correct_option"), F.get("texts", index).alias("correct_answer_text"), F.size("texts").alias("n_choices"))


def named_files(spark: SparkSession, folder: str, run_id: str, benchmarks: list[str], schema: str) -> DataFrame:
    """Rows of flat files ``<run>_<method>_..._<benchmark>.csv`` plus method_name and benchmark_name read from the name; the longest benchmark that fits wins."""
    rows = spark.read.schema(schema).option("header", True).csv(folder).withColumn("__f", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))
    mine = rows.where(F.startswith("__f", F.lit(run_id + "_")))
    rest = F.substring("__f", len(run_id) + 2, 10_000)
    suffix = F.coalesce(*[F.when(F.endswith("__f", F.lit("_" + b)), b) for b in sorted(benchmarks, key=lambda b: (-len(b), b))], F.lit(None).cast("string"))
    return mine.withColumn("method_name", F.split_part(rest, F.lit("_"), F.lit(1))).withColumn("benchmark_name", suffix).drop("__f")


def payload_fields(provider: str):
    """Columns (raw_text, finish_reason, prompt_tokens, completion_tokens) of a JSON reply body in column ``body``, by provider shape.

    Shapes: ``messages`` (content blocks, stop_reason), ``responses`` (output items, status), ``candidates``
    (parts, finishReason) and ``chat`` (choices with message). Blank text is null: the caller's failure.
    """
    get = lambda path: F.get_json_object("body", path)
    join = lambda path, schema, text: F.array_join(F.transform(F.from_json(get(path), schema), text), "")
    if provider == "messages":
        text = join("$.content", "array<struct<type:string,text:string>>", lambda b: F.coalesce(b["text"], F.lit("")))
        finish, usage = get("$.stop_reason"), ("$.usage.input_tokens", "$.usage.output_tokens")
    elif provider == "responses":
        from plumbline.functions.text import finish_reason

        items = F.from_json(get("$.output"), "array<struct<type:string,content:array<struct<type:string,text:string>>>>")
        text = F.array_join(F.transform(F.flatten(F.transform(F.filter(items, lambda i: i["content"].isNotNull()), lambda i: i["content"])), lambda c: F.coalesce(c["text"], F.lit(""))), "")
        finish, usage = finish_reason(get("$.status"), get("$.incomplete_details.reason")), ("$.usage.input_tokens", "$.usage.output_tokens")
    elif provider == "candidates":
        text = join("$.candidates[0].content.parts", "array<struct<text:string>>", lambda p: F.coalesce(p["text"], F.lit("")))
        finish, usage = get("$.candidates[0].finishReason"), ("$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount")
    elif provider == "chat":
        text, finish = get("$.choices[0].message.content"), get("$.choices[0].finish_reason")
        usage = ("$.usage.prompt_tokens", "$.usage.completion_tokens")
    else:
        raise KeyError(f"unknown reply shape {provider}")
    return [F.when(F.trim(text) != "", text).alias("raw_text"), finish.alias("finish_reason"), get(usage[0]).cast("int").alias("prompt_tokens"), get(usage[1]).cast("int").alias("completion_tokens")]
