from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.plans import runs
from plumbline.sources import artifacts, files
from plumbline.sources.tables import table
from plumbline.streaming import results_stream
from tests.conftest import SF

CONFIG = """
run_id: demo
benchmarks: [{name: toy}]
models: [{name: dummy, kind: dummy}, {name: big, kind: api, provider: openai, execution: batch}]
methods: [{name: direct_mcq}, {name: cyclic_permutation}]
"""


def test_config_and_grid():
    config = runs.load_config(CONFIG)
    rows = runs.condition_rows(config)
    assert len(rows) == 4 and rows == sorted(rows, key=lambda r: r["condition_id"])
    assert runs.manifest(config)["experiment_id"] == runs.manifest(runs.load_config(CONFIG))["experiment_id"]
    base = {"run_id": "r", "benchmarks": [{"name": "t"}], "models": [{"name": "m"}], "methods": [{"name": "direct_mcq"}]}
    bad = [{"extra": 1}, {"run_id": "../x"}, {"methods": [{"name": "nope"}]}, {"methods": [{"name": "pride"}]}, {"models": [{"name": "m"}, {"name": "m"}]}, {"models": [{"name": "m", "params": {"api_key": "x"}}]}, {"models": [{"name": "m", "params": {"seed": 1}}]}, {"models": [{"name": "m", "execution": "batch"}]}, {"benchmarks": []}, {"seed": "1"}]
    for change in bad:
        with pytest.raises(runs.ConfigError):
            runs.load_config(base | change)


def test_manifest_and_state(tmp_path):
    config = runs.load_config(CONFIG)
    first = runs.ensure_manifest(tmp_path / "run", runs.manifest(config))
    assert runs.ensure_manifest(tmp_path / "run", runs.manifest(config)) == first
    with pytest.raises(runs.ConfigError, match="artifacts"):
        runs.ensure_manifest(tmp_path / "run", runs.manifest(config, {"toy": "x"}))
    stored = json.loads((tmp_path / "run/manifest.json").read_text())
    (tmp_path / "run/manifest.json").write_text(json.dumps(stored | {"version": "other"}))
    with pytest.raises(runs.ConfigError, match="changed"):
        runs.ensure_manifest(tmp_path / "run", runs.manifest(config))
    (tmp_path / "full").mkdir()
    (tmp_path / "full/x").write_text("")
    with pytest.raises(runs.ConfigError):
        runs.ensure_manifest(tmp_path / "full", runs.manifest(config))

    state = runs.RunState(tmp_path, ["a", "b", "c"])
    with pytest.raises(runs.ConfigError):
        state.evaluable()

    def run(condition):
        if condition == "b":
            raise RuntimeError
        if condition == "c":
            raise ValueError

    assert runs.run_conditions(state, run, concurrent=2) == {"a": "completed", "b": "failed", "c": "gated"}
    assert runs.RunState(tmp_path, ["a", "b", "c"]).evaluable() == ["a"]


def test_resume(spark, tmp_path):
    q = files.toy_questions(spark)
    sink = str(tmp_path / "sink")
    calls = []

    def process(part):
        calls.append(part.count())
        return part.select("question_id", F.lit("A").alias("parsed_choice"))

    q.limit(3).select("question_id", F.lit("A").alias("parsed_choice")).write.parquet(sink)
    assert runs.resume(q, sink, "question_id string, parsed_choice string", 4, process) == 2 and sorted(calls) == [3, 4]
    assert runs.resume(q, sink, "question_id string, parsed_choice string", 4, process) == 0
    assert spark.read.parquet(sink).select("question_id").distinct().count() == 10
    with pytest.raises(ValueError):
        runs.resume(q, str(tmp_path / "other"), "question_id string, parsed_choice string", 4, lambda p: process(p).limit(1))


def test_dataset_artifact(spark, tmp_path):
    q = files.toy_questions(spark)
    spec = {"name": "toy", "split": "test"}
    meta = artifacts.write_dataset(q, str(tmp_path), spec)
    df, again = artifacts.read_dataset(spark, str(tmp_path), spec, q.schema)
    assert again == meta and df.count() == 10
    assert artifacts.content_digest(q.repartition(3)) == meta["content_digest"]
    assert artifacts.content_digest(q.repartition(3)) == meta["content_digest"]
    assert artifacts.content_digest(q.withColumn("ordinal", 9 - F.col("ordinal"))) != meta["content_digest"]
    path = Path(artifacts.dataset_path(str(tmp_path), spec), "metadata.json")
    path.write_text(path.read_text().replace('"rows": 10', '"rows": 11'))
    with pytest.raises(artifacts.ArtifactError, match="metadata"):
        artifacts.read_dataset(spark, str(tmp_path), spec, q.schema)
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read_dataset(spark, str(tmp_path), {"name": "x", "split": "y"}, q.schema)
    with pytest.raises(artifacts.ArtifactError):
        artifacts.write_dataset(q.unionByName(q), str(tmp_path), {"name": "twice", "split": "test"})
    with artifacts.locked(tmp_path / "l"), pytest.raises(artifacts.ArtifactError), artifacts.locked(tmp_path / "l"):
        pass
    artifacts.write_report(tmp_path / "r.json", {"a": 1})
    artifacts.write_report(tmp_path / "r.json", {"a": 1})
    with pytest.raises(artifacts.ArtifactError):
        artifacts.write_report(tmp_path / "r.json", {"a": 2})


def test_results_sink(spark, tmp_path):
    columns = artifacts.IDENTITY_COLUMNS
    rows = files.toy_questions(spark).select("question_id", *[F.lit(c).alias(c) for c in columns if c != "condition_id"], F.when(F.col("ordinal") < 5, "c1").otherwise("c2").alias("condition_id"))
    artifacts.write_results(rows, str(tmp_path / "res"))
    schema = ", ".join(f"{c} string" for c in ["question_id", *columns])
    got = artifacts.read_results(spark, str(tmp_path / "res"), schema, ["c1"])
    assert got.count() == 5 and "PartitionFilters: [isnotnull(condition_id" in got._jdf.queryExecution().toString()
    for bad in (rows.drop("model_id"), rows.where(F.lit(False)), rows.withColumn("model_id", F.lit(None).cast("string")), rows.withColumn("model_id", F.col("question_id"))):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.write_results(bad, str(tmp_path / "bad"))
    expected = rows.select("condition_id", "question_id").unionByName(spark.createDataFrame([("c1", "extra")], "condition_id string, question_id string"))
    assert [tuple(r) for r in artifacts.membership_problems(rows, expected).collect()] == [("c1", "extra", "missing")]
    assert artifacts.resume_problem(["a"], ["a"], ["m"], "m") is None and artifacts.resume_problem(["a"], ["b"], [], "m") and artifacts.resume_problem(["a"], ["a"], ["n"], "m") and artifacts.resume_problem(["a"], ["a", "b"], [], "m", exact=False)


def test_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    (tmp_path / "ids.csv").write_text("question_id,x\na,1\n,2\n")
    assert files.id_list(spark, str(tmp_path / "ids.txt")).count() == 2 and files.id_list(spark, str(tmp_path / "ids.csv")).count() == 1
    (tmp_path / "c.jsonl").write_text('{"question_id": "a"}\n\n{"question_id": "b"}\n')
    assert [r.question_id for r in files.calibration_file(spark, str(tmp_path / "c.jsonl"), "question_id string", 1).collect()] == ["a"]
    with pytest.raises(ValueError):
        files.calibration_file(spark, "x.xml", "a string", 1)
    (tmp_path / "v1").mkdir()
    for name in ("direct_mcq", "free_text", "option_matching", "more"):
        (tmp_path / "v1" / f"{name}.txt").write_text(name)
    assert set(files.prompt_folder(str(tmp_path), "v1")) == {"direct_mcq", "free_text", "option_matching", "more"}
    for bad in ("../v1", "", "v2"):
        with pytest.raises(ValueError):
            files.prompt_folder(str(tmp_path), bad)
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat/run_direct_x_mmlu_pro.csv").write_text("a\n1\n")
    (tmp_path / "flat/other_direct_mmlu.csv").write_text("a\n1\n")
    row = files.named_files(spark, str(tmp_path / "flat"), "run", ["pro", "mmlu_pro"], "a int").collect()
    assert [(r.method_name, r.benchmark_name) for r in row] == [("direct", "mmlu_pro")]
    gold = [r.correct_option for r in files.toy_questions(spark).orderBy("ordinal").collect()]
    assert [i for i, g in enumerate(gold) if g == "A"] == [0, 7, 8]


def test_reply_payloads(spark):
    bodies = {
        "messages": '{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}],"stop_reason":"end_turn","usage":{"input_tokens":1,"output_tokens":2}}',
        "responses": '{"output":[{"type":"reasoning"},{"type":"message","content":[{"type":"output_text","text":"ab"}]}],"status":"incomplete","incomplete_details":{"reason":"max_output_tokens"},"usage":{"input_tokens":1,"output_tokens":2}}',
        "candidates": '{"candidates":[{"content":{"parts":[{"text":"ab"}]},"finishReason":"STOP"}],"usageMetadata":{"promptTokenCount":1,"candidatesTokenCount":2}}',
        "chat": '{"choices":[{"message":{"content":"ab"},"finish_reason":"stop"}],"usage":{"prompt_tokens":1,"completion_tokens":2}}',
    }
    finish = {"messages": "end_turn", "responses": "length", "candidates": "STOP", "chat": "stop"}
    for shape, body in bodies.items():
        assert tuple(spark.createDataFrame([(body,)], "body string").select(*files.payload_fields(shape)).first()) == ("ab", finish[shape], 1, 2), shape
    assert spark.createDataFrame([("{}",)], "body string").select(*files.payload_fields("chat")).first().raw_text is None
    with pytest.raises(KeyError):
        files.payload_fields("nobody")


def test_streams(spark, tmp_path):
    rows = table(spark, SF, "model_responses")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = results_stream.stream_results(spark, str(tmp_path / "in"), rows.schema)
    once = results_stream.run_once(results_stream.distinct_requests(stream, "received_at", "3650 days"), "once", str(tmp_path / "c1"), "append")
    assert once.count() == rows.select("request_id").distinct().count()
    health = results_stream.run_once(results_stream.windowed_health(stream, "received_at", late="3650 days"), "health", str(tmp_path / "c2"), "complete")
    assert health.agg(F.sum("n_total")).first()[0] == rows.count()
    counted = results_stream.condition_counts(stream.select(F.col("provider").alias("condition_id"), F.col("raw_text").alias("parsed_choice"), F.lit("B").alias("correct_option")))
    assert results_stream.run_once(counted, "counted", str(tmp_path / "c3")).agg(F.sum("n_total")).first()[0] == rows.count()


class FakeBatches:
    def __init__(self, folder, state="completed"):
        self.folder, self.state, self.submitted = folder, state, 0

    def submit(self, requests_folder):
        self.submitted += 1
        self.requests = requests_folder
        return "job"

    def poll(self, job):
        self.polls = getattr(self, "polls", 0) + 1
        return self.state if self.polls > 2 else "running"

    def fetch(self, job):
        ids = [json.loads(line)["custom_id"] for p in Path(self.requests).glob("*.json") for line in p.read_text().splitlines()]
        out = Path(self.folder, "replies.json")
        out.write_text("".join(json.dumps({"custom_id": i, "raw_text": "Answer: B"}) + "\n" for i in sorted(ids)[:-1]))
        return str(out)


def test_batch_jobs(spark, tmp_path):
    from plumbline.sources import batch_jobs

    misses = spark.createDataFrame([(f"k{i}", f"prompt {i}") for i in range(5)], "cache_key string, prompt string")
    client, waits = FakeBatches(str(tmp_path)), []
    out = batch_jobs.run_batch(misses, client, str(tmp_path), sleep=waits.append).collect()
    assert sorted(r.status for r in out) == ["failure"] + ["success"] * 4 and waits == [30.0, 30.0]
    batch_jobs.run_batch(misses.repartition(3), client, str(tmp_path), sleep=waits.append).count()
    assert client.submitted == 1
    batch_jobs.clear_state(str(tmp_path))
    bad = batch_jobs.run_batch(misses, FakeBatches(str(tmp_path), "failed"), str(tmp_path), sleep=waits.append)
    assert {r.status for r in bad.collect()} == {"failure"}
    assert batch_jobs.run_batch(misses.where(F.lit(False)), client, str(tmp_path)).count() == 0


def test_priors(spark, tmp_path):
    from plumbline.sources import priors

    q = files.toy_questions(spark)
    settings = dict(condition_id="c", seed=1, temperature=0.0, max_tokens=5, prompt_version="v1", n_choices=4)
    key = priors.prior_key(q, **settings)
    assert key == priors.prior_key(q.repartition(3), **settings) != priors.prior_key(q.where("ordinal > 2"), **settings)
    calls = []
    compute = lambda: calls.append(1) or {"A": 0.7, "B": 0.3}
    assert priors.load_or_compute(str(tmp_path), key, compute) == priors.load_or_compute(str(tmp_path), key, compute) == {"A": 0.7, "B": 0.3}
    assert len(calls) == 1
    path = next(tmp_path.glob("prior_*.json"))
    path.write_text(path.read_text().replace("0.7", "0.8"))
    with pytest.raises(artifacts.ArtifactError):
        priors.load_or_compute(str(tmp_path), key, compute)


def test_assembled_rows_report_and_snapshot(spark, tmp_path):
    from plumbline.operators import methods, scoring
    from plumbline.sources import responders

    q = files.toy_questions(spark)
    digests = runs.snapshot(q, {"direct_mcq": "x"}, str(tmp_path), "toy")
    assert set(digests) == {"toy.questions", "toy.prompts"}
    parts = []
    for name in ("direct_mcq", "cyclic_permutation"):
        identity = {c: f"{c}-{name}" for c in artifacts.IDENTITY_COLUMNS}
        parts.append(scoring.assembled(scoring.stamped(methods.run_method(name, q, responders.dummy), identity, run_id="r", benchmark_name="toy")))
    results = parts[0].unionByName(parts[1])
    artifacts.write_results(results, str(tmp_path / "res"))
    state = runs.RunState(tmp_path, ["condition_id-direct_mcq", "condition_id-cyclic_permutation", "gone"])
    for c in list(state.status):
        state.set(c, "failed" if c == "gone" else "completed")
    back = artifacts.read_results(spark, str(tmp_path / "res"), results._jdf.schema().toDDL(), list(state.status))
    report = runs.evaluation_report(back, state, ["accuracy", "mad"], str(tmp_path))
    assert report["conditions"]["condition_id-direct_mcq"]["values"]["accuracy"] == pytest.approx(0.3)
    assert report["conditions"]["gone"] == {"status": "failed", "values": None} and not report["complete"]
    assert runs.evaluation_report(back, state, ["accuracy", "mad"], str(tmp_path)) == report
    with pytest.raises(artifacts.ArtifactError):
        runs.evaluation_report(back, state, ["accuracy"], str(tmp_path))


def test_scratch_is_written_and_released(spark):
    from plumbline.sources.scratch import Scratch

    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(5), "five")
    assert kept.count() == 5 and kept.columns == ["id"]
    root = Path(scratch.root.removeprefix("file://"))
    assert root.exists()
    scratch.release()
    assert not root.exists()


def test_revisions_from_a_cache(spark, tmp_path):
    from plumbline.sources import revisions

    commit, home = "0123456789abcdef" * 2 + "01234567", tmp_path / "datasets--org--quiz"
    (home / "refs").mkdir(parents=True)
    (home / "refs/main").write_text(commit + "\n")
    with pytest.raises(revisions.RevisionError, match="files"):
        revisions.cached_commit(str(tmp_path), "org/quiz")
    snapshot = home / "snapshots" / commit / "all"
    snapshot.mkdir(parents=True)
    for name, n in (("test-00000-of-00002", 3), ("test-00001-of-00002", 4), ("tests", 9), ("dev", 5)):
        spark.range(n).toPandas().to_parquet(snapshot / f"{name}.parquet")
    assert revisions.cached_commit(str(tmp_path), "org/quiz") == commit == revisions.cached_commit(str(tmp_path), "org/quiz", commit)
    df, pin = revisions.pinned_table(spark, str(tmp_path), "org/quiz", "test", subset="all")
    assert df.count() == 7 and pin["commit"] == commit and len(pin["files"]) == 2
    assert revisions.pinned_table(spark, str(tmp_path), "org/quiz", "dev", subset="all")[1]["fingerprint"] != pin["fingerprint"]
    for bad in (("org/other", "main"), ("org/quiz", "v9"), ("org/quiz", "f" * 40)):
        with pytest.raises(revisions.RevisionError):
            revisions.cached_commit(str(tmp_path), *bad)
    with pytest.raises(revisions.RevisionError, match="split"):
        revisions.pinned_table(spark, str(tmp_path), "org/quiz", "train", subset="all")
    (home / "refs/odd").write_text("not a commit")
    with pytest.raises(revisions.RevisionError, match="commit"):
        revisions.cached_commit(str(tmp_path), "org/quiz", "odd")
