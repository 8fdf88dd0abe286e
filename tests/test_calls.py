"""Every prompt is asked once: counting clients, caches, priors, resumption, and storage beyond the local disk."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.operators import methods as M
from plumbline.plans import runs
from plumbline.sources import responders, storage
from plumbline.sources.files import toy_questions


class Counter:
    """Clients whose calls are counted in a folder, as workers are processes of their own."""

    def __init__(self, folder: Path, reply: str = "Answer: B"):
        folder.mkdir()
        self.folder, self.reply = folder, reply

    def make(self):
        folder, reply = str(self.folder), self.reply

        def client(prompt: str) -> str:
            Path(folder, uuid.uuid4().hex).write_text(prompt)
            return reply

        return client

    def prompts(self) -> list[str]:
        return sorted(p.read_text() for p in self.folder.iterdir())


@pytest.mark.parametrize(("name", "calls"), [("direct_mcq", 10), ("shuffled_baseline", 10), ("cyclic_permutation", 40), ("two_stage", 20)])
def test_one_call_for_each_prompt(spark, tmp_path, name, calls):
    counter = Counter(tmp_path / "calls")
    out = M.run_method(name, toy_questions(spark), responders.client_responder(counter.make, limit=6, concurrency=2))
    assert out.count() == 10 and out.where("answer_status = 'success'").count() == 10
    assert out.select("parsed_choice").distinct().count() >= 1
    assert len(counter.prompts()) == len(set(counter.prompts())) == calls


def test_two_stage_falls_back_with_a_client(spark, tmp_path):
    counter = Counter(tmp_path / "calls", "no idea")
    out = M.run_method("two_stage", toy_questions(spark), responders.client_responder(counter.make)).collect()
    assert len(out) == 10 and all(r.fallback_used and r.parsed_choice is None and r.free_text_response == "no idea" for r in out)
    assert len(counter.prompts()) == 30


def test_calls_under_way_are_bounded_by_tasks(spark, tmp_path):
    seen = []
    ask = responders.client_responder(Counter(tmp_path / "calls").make, limit=8, concurrency=4)
    df = toy_questions(spark).withColumn("prompt", F.col("question_text"))
    keep = responders.Scratch.keep
    try:
        responders.Scratch.keep = lambda self, d, name: seen.append(d.rdd.getNumPartitions()) or keep(self, d, name)
        ask(df)
    finally:
        responders.Scratch.keep = keep
    assert seen == [2]


def test_shared_client_is_made_once_for_a_worker():
    made = []
    for _ in range(3):
        responders.shared_client("model/sync", lambda: made.append(1) or (lambda p: p))
    assert made == [1]


def test_cache_fills_itself(spark, tmp_path):
    counter = Counter(tmp_path / "calls")
    cache = responders.ResponseCache(spark, str(tmp_path / "cache"))
    identity = dict(provider="p", model="m", temperature=0.0, max_tokens=5, seed=None)
    ask = responders.cached(responders.client_responder(counter.make), cache, **identity)
    first = M.run_method("direct_mcq", toy_questions(spark).where("ordinal < 6"), ask)
    assert first.where("parsed_choice = 'B'").count() == 6 and len(counter.prompts()) == 6
    again = M.run_method("direct_mcq", toy_questions(spark), ask)
    assert again.where("parsed_choice = 'B'").count() == 10 and len(counter.prompts()) == 10
    assert cache.read().count() == 10
    other = responders.cached(responders.client_responder(counter.make), cache, **{**identity, "model": "n"})
    assert M.run_method("direct_mcq", toy_questions(spark), other).count() == 10 and len(counter.prompts()) == 20


def test_failures_are_not_cached(spark, tmp_path):
    cache = responders.ResponseCache(spark, str(tmp_path / "cache"))
    ask = responders.cached(responders.client_responder(lambda: lambda p: " "), cache, provider="p", model="m", temperature=0.0, max_tokens=5, seed=None)
    assert M.run_method("direct_mcq", toy_questions(spark), ask).where("transport_status = 'failure'").count() == 10
    assert cache.read().count() == 0


def test_resume_asks_once_and_never_again(spark, tmp_path):
    counter = Counter(tmp_path / "calls")
    ask = responders.client_responder(counter.make)
    process = lambda part: M.run_method("direct_mcq", part, ask).select("question_id", "parsed_choice")
    schema, sink = "question_id string, parsed_choice string", (tmp_path / "sink").as_uri()
    assert runs.resume(toy_questions(spark), sink, schema, 4, process) == 3 and len(counter.prompts()) == 10
    assert runs.resume(toy_questions(spark), sink, schema, 4, process) == 0 and len(counter.prompts()) == 10
    assert spark.read.parquet(sink).count() == 10


def test_stored_prior_saves_its_calls(spark, tmp_path):
    asked = []

    def respond(df):
        asked.append(1)
        return responders.dummy(df)

    settings = dict(condition_id="c", seed=1, temperature=0.0, max_tokens=5, prompt_version="v1")
    out = [M.run_method("pride", toy_questions(spark), respond, calibration=toy_questions(spark).where("ordinal < 4"), priors_folder=str(tmp_path), prior_settings=settings).select("question_id", "parsed_choice", "peprior").collect() for _ in range(2)]
    assert sorted(map(str, out[0])) == sorted(map(str, out[1])) and len(asked) == 3
    M.run_method("pride", toy_questions(spark), respond, calibration=toy_questions(spark).where("ordinal < 4"), priors_folder=str(tmp_path), prior_settings={**settings, "seed": 2})
    assert len(asked) == 5


def shout(questions, respond, **_):
    """A plugin method."""
    return M.direct_mcq(questions, respond).withColumn("method_name", F.lit("shout"))


def test_plugins(spark):
    out = M.run_method("tests.test_calls:shout", toy_questions(spark), responders.dummy)
    assert {r.method_name for r in out.collect()} == {"shout"}
    base = {"run_id": "r", "benchmarks": [{"name": "t"}], "models": [{"name": "m"}], "methods": [{"name": "tests.test_calls:shout"}]}
    assert runs.load_config(base).methods[0].name == "tests.test_calls:shout"
    for bad in ("nothing", "tests.test_calls:gone", "no.such.module:x", "tests.test_calls:SETTING"):
        with pytest.raises(ValueError):
            M.run_method(bad, toy_questions(spark), responders.dummy)
        with pytest.raises(runs.ConfigError):
            runs.load_config(base | {"methods": [{"name": bad}]})


SETTING = 3


def test_state_is_reconciled_with_the_results(spark, tmp_path):
    state = runs.RunState(tmp_path, ["a", "b", "c", "d"])
    for c, s in {"a": "completed", "b": "pending", "c": "gated", "d": "failed"}.items():
        state.set(c, s)
    expected = spark.createDataFrame([(c, q) for c in "abcd" for q in "xy"], "condition_id string, question_id string")
    results = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("b", "y"), ("d", "x")], "condition_id string, question_id string")
    assert state.reconcile(results, expected) == {"a": "pending", "b": "completed"}
    assert runs.RunState(tmp_path, ["a", "b", "c", "d"]).status == {"a": "pending", "b": "completed", "c": "gated", "d": "failed"}


def test_reset_refuses_what_is_not_its_own(tmp_path):
    base = {"run_id": "demo", "benchmarks": [{"name": "t"}], "models": [{"name": "m"}], "methods": [{"name": "direct_mcq"}]}
    run = tmp_path / "run"
    with pytest.raises(runs.ConfigError, match="no run"):
        runs.reset_run(str(run), "demo")
    runs.ensure_manifest(str(run), runs.manifest(runs.load_config(base)))
    for name in ("inputs", "results"):
        (run / name).mkdir()
    runs.RunState(str(run), ["a"]).set("a", "failed")
    with pytest.raises(runs.ConfigError, match="another run"):
        runs.reset_run(str(run), "other")
    (run / "thesis.doc").write_text("x")
    with pytest.raises(runs.ConfigError, match="thesis.doc"):
        runs.reset_run(str(run), "demo")
    (run / "thesis.doc").unlink()
    assert runs.reset_run(str(run), "demo") == ["results", "run_state.json", "manifest.json"]
    assert [p.name for p in run.iterdir()] == ["inputs"]


@pytest.mark.parametrize("remote", [False, True])
def test_storage(spark, tmp_path, monkeypatch, remote):
    if remote:
        monkeypatch.setattr(storage, "_local", lambda path: None)
    at = storage.join(tmp_path.as_uri() if remote else tmp_path, "a/", "b.json")
    assert not storage.exists(at) and storage.entries(storage.join(tmp_path, "a")) == []
    for value in ({"x": "ü"}, {"x": 2}):
        storage.write_json(at, value)
        assert storage.read_json(at) == value
    assert [n for n in storage.entries(storage.join(tmp_path, "a")) if not n.endswith(".crc")] == ["b.json"]
    lock = storage.join(tmp_path, "lock")
    with storage.locked(lock), pytest.raises(BlockingIOError), storage.locked(lock):
        pass
    with storage.locked(lock):
        pass
    storage.remove(at)
    storage.remove(storage.join(tmp_path, "a"), folder=True)
    assert not storage.exists(storage.join(tmp_path, "a"))
    with pytest.raises(ValueError):
        storage.write_json(at, float("nan"))
    assert json.dumps(1) == "1"


def test_entry_names_a_missing_library(monkeypatch):
    """Only the subpackage itself may be missing; a library that it needs is an error."""
    import importlib
    import sys

    import __spark_entry__

    class Without:
        def __init__(self, name):
            self.name = name

        def find_spec(self, name, path=None, target=None):
            if name == self.name:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    def again(name):
        for m in [m for m in sys.modules if m == "plumbline.llm" or m.startswith("plumbline.llm.")]:
            monkeypatch.delitem(sys.modules, m)
        import plumbline

        if hasattr(plumbline, "llm"):
            monkeypatch.delattr(plumbline, "llm")
        monkeypatch.setattr(sys, "meta_path", [Without(name), *sys.meta_path])
        return importlib.reload(__spark_entry__)

    try:
        assert again("plumbline.llm").llm is None
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
