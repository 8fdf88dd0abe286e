from __future__ import annotations

import json

import numpy as np
import pytest

from plumbline.llm import subject_areas as sa
from plumbline.llm import truncation as tr
from plumbline.llm.common import table
from tests.conftest import SF

WHOLE = ["B", "  b  ", "Answer: C", "It is done.", 'He said "yes."', "**A**", "<answer>B</answer>", '{"answer": "A"}', "```\nC\n```", "- choice: A\n- score: 61", "9", "(D)", "A or B", "Is it?", "x <b>y</b>", "« Oui. »"]
OPEN = ["<answer>B</ans", "<answer>B", '{"answer": "A"', '{"answer": "', "```\nA\n``", "```\nA", "**A*", "patients (", "see (him", 'Hence "nine', "“Never", "<answer>C</", "text <"]
MARKED = ["the oth [truncated]", "compos�"]
BARE = ["It helps to draw", "That leaves A,", "the trials speak…", "the oth...", "Skipibak w", "speaks o", "\n7.", "Step by step:", "while the stem", "", "so C looks weak"]


LOOSE = ["It helps, and so the other clue points to option B", "My second thought was that it has to be A", "I have now counted all of them and found 516"]


def test_endings():
    kinds = {t: tr.ending(t) for t in WHOLE + OPEN + MARKED + BARE + LOOSE}
    assert all(kinds[t] in tr.WHOLE for t in WHOLE)
    assert all(kinds[t] == "open" for t in OPEN) and all(kinds[t] == "marked" for t in MARKED)
    assert {kinds[t] for t in BARE} == {"bare", "ellipsis"} and {kinds[t] for t in LOOSE} == {"loose_letter", "loose_figure"}


def test_quoted_tail():
    assert tr.quoted_tail("The  Red fox") == "the red fox" and tr.quoted_tail("B) red, fox") == "red fox"
    assert tr.quoted_tail("It is so. Final answer: Red Fox") == "red fox"
    assert tr.quoted_tail("It is so. Step by step: the red fox") is None and tr.quoted_tail("One is out.\n2. Two") is None and tr.quoted_tail("  ") is None


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(0)
    true = np.exp(rng.normal(5.0, 0.6, 60_000)).astype(int)
    seen, n = np.unique(np.minimum(true, 300), return_counts=True)
    limits = tr.candidate_limits(seen, n, np.where(seen == 300, n, 0))
    assert limits.tolist() == [300]
    weight, mean, dev, posterior = tr.fit_censored(seen, n.astype(float), limits)
    grand = (weight * mean).sum()
    assert abs(grand - 5.0) < 0.15
    share = (true > 300).sum() / (true >= 300).sum()
    assert abs(posterior[seen == 300][0] - share) < 0.02 and posterior[seen != 300].max() == 0
    assert len(tr.candidate_limits(seen, n, np.zeros(len(n)))) == 0


def test_judged_replies(spark):
    ddl = "response_id long, provider string, model_name string, question_id string, max_tokens int, usage_info struct<completion_tokens:int>, raw_text string, ending string, finish_reason string"
    texts = ["the red  Fox", "a red fox runs", "the RED fox", None, "   ", "Answer: A", "scans...", "the red fo", "x" * 200_000]
    rows = [(i, "p", None, "q" if i != 2 else None, 10, (10,), t, "clash", None) for i, t in enumerate(texts)] + [(5, "p", None, "q", 10, None, "Answer: A", "clash", "length")]
    options = json.dumps([{"text": "red fox"}, {"text": "Scans..."}, {"text": None}])
    questions = spark.createDataFrame([("q", options), ("q", options), ("q", None), (None, options)], "question_id string, choices_json string")
    got = tr.judged_replies(spark.createDataFrame(rows, ddl), questions).collect()
    assert len(got) == 9
    state = {r.response_id: r.truncated for r in got}
    assert state == {0: False, 1: True, 2: True, 4: True, 5: False, 6: False, 7: True, 8: True}
    empty = spark.createDataFrame([], ddl)
    assert tr.judged_replies(empty, questions).count() == 0


def test_option_needs_a_word_boundary(spark):
    ddl = "response_id long, provider string, model_name string, question_id string, max_tokens int, usage_info struct<completion_tokens:int>, raw_text string, finish_reason string"
    questions = spark.createDataFrame([("q", '[{"text": "ports"}]')], "question_id string, choices_json string")
    rows = [(1, "p", "m", "q", 1, None, "the airports", "stop"), (2, "p", "m", "q", 1, None, "the ports", ""), (3, "p", "m", "q", 1, None, 'I say "Ports"', None)]
    got = {r.response_id: r.truncated for r in tr.judged_replies(spark.createDataFrame(rows, ddl), questions).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_rates_and_limits_on_the_tables(spark):
    n = table(spark, SF, "model_responses").where("raw_text is not null").count()
    rates = tr.p1_rates(spark, SF).collect()
    assert sum(r.replies for r in rates) == n and 0 < sum(r.truncated for r in rates) < n / 2
    assert tr.p1_found(spark, SF).count() == sum(r.truncated for r in rates)
    assert set(tr.p1_limits(spark, SF).columns) == {"provider", "model_name", "limit_length", "n_replies", "n_unfinished"}
    fits = tr.p1_posteriors(spark, SF).collect()
    assert len({(r.provider, r.model_name) for r in fits}) == len(rates) and all(0 < r.rate < 0.5 for r in fits)


def replies_of_source(spark, limit: int, clean: int = 4000):
    """A source whose replies above ``limit`` are cut; one with the same weak ending at 300 and one at 200 letters."""
    rng = np.random.default_rng(3)
    rows = []
    for i, n in enumerate(np.exp(rng.normal(5.0, 0.7, clean)).astype(int) + 20):
        text = ("It is so. " * (n // 10 + 1))[:n]
        rows.append((i, text[: n - 1].rstrip() + "." if n < limit else "It is" + " ab" * limit, None))
    weak = " It helps, and so the other clue points to option B"
    rows = [(i, t[:limit] if len(t) > limit else t, q) for i, t, q in rows]
    for at in (200, 300):
        rows.append((10_000 + at, ("It is so. " * 60)[: at - len(weak)] + weak, None))
        rows.append((20_000 + at, ("It is so. " * 60)[: at - 3] + " ab", "unknown"))
    ddl = "response_id long, raw_text string, question_id string, provider string, model_name string, max_tokens int, usage_info struct<completion_tokens:int>, finish_reason string"
    return spark.createDataFrame([(i, t, q, "p", "m", None, None, None) for i, t, q in rows], ddl)


def test_moving_the_limit_flips_replies_with_weak_endings(spark):
    questions = spark.createDataFrame([("q", '[{"text": "ports"}]')], "question_id string, choices_json string")
    for limit in (200, 300):
        replies = replies_of_source(spark, limit)
        got = {r.response_id: r for r in tr.judged_replies(replies, questions).where("response_id >= 10000").collect()}
        other = 500 - limit
        assert got[10_000 + limit].truncated and got[20_000 + limit].truncated
        assert not got[10_000 + other].truncated
        assert got[20_000 + limit].log_odds > got[20_000 + other].log_odds + 5
        assert got[10_000 + limit].limit_posterior > 0.9


def test_evidence_fit_learns_rates_and_ratios():
    """2 % cuts away from limits, all of them bare, and one limit at which nearly all are cut."""
    e = tr.ENDINGS.index
    cells = [(np.nan, e("sentence"), 970), (np.nan, e("bare"), 20), (np.nan, e("option"), 10), (0.99, e("bare"), 95), (0.99, e("sentence"), 5)]
    prior, endings, counts = (np.array(x) for x in zip(*cells))
    rate, spent, odds, _ = tr.fit_evidence(prior, np.zeros(5, dtype=bool), endings, np.zeros(5, dtype=int), counts.astype(float))
    assert abs(rate - 0.02) < 0.002 and spent == tr.BUDGET_PRIOR[0]
    assert odds[e("bare")] > odds[e("unmatched")] > odds[e("quoted")] and odds[e("open")] == tr.SETTLED == -odds[e("sentence")]


def area_texts(n=60, seed=1):
    rng = np.random.default_rng(seed)
    words = {"music": ["oboe", "chord", "tempo", "violin"], "law": ["court", "clause", "appeal", "juror"]}
    filler = ["see also the other table.", "nobody asked for it.", "leave it out here."]
    texts, labels = [], []
    for i in range(n):
        area = ("music", "law")[i % 2]
        pick = lambda: rng.choice(words[area])
        texts.append(f"The {pick()} and the {pick()} were kept. {rng.choice(filler)} Which {pick()} is it?")
        labels.append(area)
    return texts, labels


def test_areas_by_sentences(spark):
    texts, labels = area_texts(400)
    model = sa.train(texts + ["please write the sheet number here."] * 40, labels + [None] * 40, ["law", "music", "sport"])
    docs = [
        (1, "The oboe was loud. A chord of the violin stood out. See also the other table.", "x"),
        (2, "The oboe was loud. Nobody asked for it.", "x"),
        (3, "Each court has a clause.\nThe appeal of a juror came.\nThe tempo of the violin was slow. An oboe and a chord.", "x"),
        (4, None, "x"),
        (5, "", "x"),
        (6, "please write the sheet number here. " * 20_000, "x"),
        (1, "The oboe was loud. A chord of the violin stood out. See also the other table.", "x"),
        (None, texts[0], "x"),
    ]
    got = sa.document_areas(spark.createDataFrame(docs, "doc_id long, text string, area string"), model)
    assert {(r.doc_id, r.area) for r in got.collect()} == {(1, "music"), (3, "law"), (3, "music")} and got.count() == 3
    assert sa.document_areas(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert sa.document_areas(spark.createDataFrame(docs[:1], "doc_id long, text string, area string"), sa.train([], [], ["law"])).count() == 0


def test_held_out_accuracy():
    texts, labels = area_texts(400)
    model = sa.train(texts, labels, ["law", "music"])
    fresh, truth = area_texts(100, seed=9)
    cache = sa._Hashes()
    right = sum(model.areas[int(model.scores(sa.sentences_of(t)[:1], cache)[0].argmax())] == a for t, a in zip(fresh, truth))
    assert right == 100


def test_sentences():
    assert sa.sentences_of("<p>One two three. Four five six!</p>\nA. option text here\nname: seven eight nine") == [["one", "two", "three"], ["four", "five", "six"], ["name", "seven", "eight", "nine"]]
    assert sa.sentences_of(None) == [] == sa.sentences_of("too short")


def test_found_on_the_tables(spark):
    got = sa.p8_found(spark, SF).collect()
    assert len(got) == len(set(got)) > 0
    none = {r.doc_id for r in table(spark, SF, "document_labels").where("area = 'none'").collect()}
    assert len(none & {r.doc_id for r in got}) <= len(none) / 2
    parts = sa.p8_composition(spark, SF).collect()
    assert {r.area for r in parts} <= {r.area for r in table(spark, SF, "subject_areas").collect()} | {"none"}
    assert abs(sum(r.document_share for r in parts) - 1) < 1e-9 and abs(sum(r.char_share for r in parts) - 1) < 1e-9


def test_composition_counts_every_document(spark):
    documents = spark.createDataFrame([(1, "abcd", "x"), (2, "ab", "x"), (3, None, "x"), (4, "ab", "x")], "doc_id long, text string, area string")
    areas = spark.createDataFrame([(1, "law"), (1, "music"), (2, "law")], "doc_id long, area string")
    got = {r.area: tuple(r)[1:] for r in sa.composition(documents, areas).collect()}
    assert got == {"law": (2, 6, 1.5 / 4, 0.5), "music": (1, 4, 0.5 / 4, 0.25), "none": (2, 2, 0.5, 0.25)}
    assert sa.composition(documents.where("doc_id > 9"), areas).count() == 0


def test_training_in_tasks_equals_training_here(spark):
    texts, labels = area_texts(200)
    here, there = sa.train(texts, labels, ["law", "music"]), sa.train(texts, labels, ["law", "music"], None, spark)
    assert np.allclose(here.weights, there.weights, atol=1e-6) and np.allclose(here.thresholds, there.thresholds) and (here.columns == there.columns).all()


def test_hold_out_shares_nothing_with_training(monkeypatch):
    texts, labels = area_texts(100)
    seen = []
    monkeypatch.setattr(sa, "calibrated", lambda scores, positive, weight: seen.append(len(scores)) or 0.0)
    sa.train(texts * 2, labels * 2, ["law", "music"], [i % 50 for i in range(200)])
    held = {i % 50 for i in range(200) if sa.xxhash.xxh32_intdigest(str(i % 50)) % 5 == 0}
    trained = {tuple(s) for i, t in enumerate(texts * 2) if i % 50 not in held for s in sa.sentences_of(t)}
    fresh = [s for i, t in enumerate(texts * 2) if i % 50 in held for s in sa.sentences_of(t) if tuple(s) not in trained]
    assert seen == [len(fresh)] * 2


def test_found_equals_sql(spark):
    from tests.conftest import oracle_rows, same_rows

    assert same_rows(tr.p1_found(spark, SF).toPandas(), oracle_rows(tr.ORACLE_SQL["p1_found"]))
