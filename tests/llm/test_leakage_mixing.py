from __future__ import annotations

import itertools
import random
from fractions import Fraction

import pytest

from plumbline.llm import leakage as lk
from plumbline.llm import mixing as mx
from tests.conftest import SF, oracle_rows, same_rows


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").withColumnRenamed("item_id", "seed")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in lk.leaked_passages(d, i, **kw).collect()}


W = [f"word{i}" for i in range(40)]


def test_words():
    assert lk.words_of("<p>Über-\n> all, a<br>b 2.5</p>") == ["überall", "a", "b", "2", "5"]
    assert lk.words_of("x < y and y > z") == ["x", "y", "and", "y", "z"]
    assert lk.words_of(None) == [] == lk.words_of("")


def test_runs_of_twelve(spark):
    item = [(1, " ".join(W[:30])), (2, " ".join(W[:11])), (3, None), (None, "x")]
    broken = W[3:15]
    broken[5] = broken[5][:3] + "-\n> " + broken[5][3:]
    docs = [
        (1, "before " + ", ".join(W[4:16]).upper() + " after", "x"),
        (2, " ".join(W[4:15]), "x"),
        (3, "<b>" + "</b> <i>".join(W[10:22]), "x"),
        (4, " ".join(broken), "x"),
        (5, " ".join(W[:6] + ["other"] + W[7:14]), "x"),
        (6, None, "x"),
        (7, "", "x"),
        (8, " ".join(W) + " filler" * 100_000, "x"),
        (1, "before " + ", ".join(W[4:16]).upper() + " after", "x"),
        (None, " ".join(W), "x"),
    ]
    got = leaks(spark, docs, item)
    assert {d for (d, i), r in got.items() if r.run_words >= 12} == {1, 3, 4, 8}
    assert got[8, 1].run_words == 30
    assert leaks(spark, [], item) == {} and leaks(spark, docs, []) == {}


def test_substitutions_are_tolerated(spark):
    item = [(1, " ".join(W[:36]))]
    changed = [w if i % 9 else "other" for i, w in enumerate(W[:36])]
    got = leaks(spark, [(1, " ".join(changed), "x")], item)[1, 1]
    assert got.run_words == 8 and got.same_words == 32 and got.replaced_words == 3
    with pytest.raises(ValueError):
        leaks(spark, [], item, masks=("11", "1"))


def test_every_run_is_found_and_bitmap_decides_nothing(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(30)]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(30)]
        if d % 2:
            source = rng.choice(items)[1].split()
            cut = rng.randrange(len(source))
            words[10:10] = source[cut : cut + rng.randint(8, 20)]
        docs.append((d, " ".join(words), "x"))

    def brute():
        grams = lambda t: {tuple(t[k : k + 12]) for k in range(len(t) - 11)}
        by_item = {i: grams(t.split()) for i, t in items}
        return {(d, i) for d, t, _ in docs for i, g in by_item.items() if g & grams(t.split())}

    for bits in (24, 8):
        assert {k for k, r in leaks(spark, docs, items, bitmap_bits=bits).items() if r.run_words >= 12} == brute()


def test_every_tolerant_overlap_is_found(spark):
    def overlaps(doc, item):
        return [lk._overlap(doc, item, shift, 3)[1] for shift in range(-len(item) + 1, len(doc))]

    docs, expected = [], set()
    for n in range(12, 18):
        for k in range(4):
            for at in itertools.combinations(range(n), k):
                doc = ["other" if i in at else w for i, w in enumerate(W[:n])]
                docs.append((len(docs), " ".join(doc), "x"))
                if max(overlaps(doc, W[:n])) >= 12:
                    expected.add((docs[-1][0], n))
    items = [(n, " ".join(W[:n])) for n in range(12, 18)]
    got = leaks(spark, docs, items)
    own = {(d, len(t.split())) for d, t, _ in docs}
    assert {k for k, r in got.items() if k in own and r.same_words >= 12} == expected and len(expected) == 620


def test_a_short_run_elsewhere_hides_no_overlap(spark):
    item = W[:30]
    doc = W[:4] + ["other"] + W[5:9] + ["other"] + W[10:14] + ["filler"] * 9 + W[16:27]
    got = leaks(spark, [(1, " ".join(doc), "x")], [(1, " ".join(item))])[1, 1]
    assert (got.run_words, got.same_words, got.replaced_words) == (11, 12, 2)


def test_sql(spark):
    for module, names in ((lk, lk.ORACLE_SQL), (mx, mx.ORACLE_SQL)):
        for name, sql in names.items():
            assert same_rows(module.QUERIES[name](spark, SF).toPandas(), oracle_rows(sql)), name


def test_flow_prefers_few_repetitions():
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 40)]
    flow, missing = mx.route(patterns, [("a", Fraction(1, 2), 2), ("b", Fraction(1, 2), 1)], 240)
    assert missing == {"a": 0, "b": 0}
    assert flow[0, "a"] == 100 and flow[2, "b"] == 40 and flow[1, "a"] == 20 and flow[1, "b"] == 80
    _, missing = mx.route(patterns, [("a", Fraction(9, 10), 1), ("c", Fraction(1, 10), 5)], 1000)
    assert missing == {"a": 700, "c": 100}


def test_flow_equals_the_smallest_cut():
    """Random overlapping patterns: the flow's total is the smallest cut over all sets of sources."""
    rng = random.Random(11)
    for _ in range(60):
        names = "abcd"
        patterns = [(tuple(s for s in names if rng.random() < 0.5), rng.randrange(1, 50)) for _ in range(rng.randrange(1, 8))]
        total = sum(n for _, n in patterns)
        targets = [(s, Fraction(rng.randrange(0, 40), 100), rng.randrange(0, 4)) for s in names]
        flow, missing = mx.route(patterns, targets, total)
        uses = {s: u for s, _, u in targets}
        cuts = []
        for mask in range(16):
            low = {s for i, s in enumerate(names) if mask >> i & 1}
            cuts.append(sum(f * total for s, f, _ in targets if s in low) + sum(n * min(max((uses[s] for s in p), default=0), sum(uses[s] for s in p if s not in low)) for p, n in patterns))
        assert abs(sum(flow.values()) - min(cuts)) < Fraction(1, 10) and sum(missing.values()) >= 0


def mixture(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, sources array<string>, tokens long, source string")
    t = spark.createDataFrame(targets, "plan_id int, source string, target_share double, max_uses int")
    return mx.Mixture(d, t)


def test_selection_keeps_caps_and_shares(spark):
    docs = [(i, ["a"] if i % 10 else ["a", "b"], 10 + i % 7, "x") for i in range(600)] + [(1000, [], 50, "x"), (1001, None, 50, "x"), (1002, ["b"], None, "x"), (1003, ["zzz"], 5, "x")]
    m = mixture(spark, docs, [(1, "a", 0.5, 1), (1, "b", 0.5, 3), (2, "a", 0.2, 1), (2, "b", 0.05, 2), (2, "none", 0.1, 1), (2, None, 0.1, 1)])
    short = {(r.plan_id, r.source): r.short for r in m.shortfalls().collect()}
    assert short == {(1, "a"): False, (1, "b"): True, (2, "a"): False, (2, "b"): False, (2, "none"): True}
    caps = {(1, "a"): 1, (1, "b"): 3, (2, "a"): 1, (2, "b"): 2}
    picked = m.selection(7).collect()
    assert all(r.uses <= caps[r.plan_id, r.source] for r in picked)
    assert sorted(picked) == sorted(m.selection(7).collect()) and sorted(picked) != sorted(m.selection(8).collect())
    reached = {(r.plan_id, r.source): r for r in m.shares(7).collect()}
    assert abs(reached[2, "a"].wanted_share - 0.2) < 0.01 and abs(reached[2, "b"].wanted_share - 0.05) < 0.01
    assert all(abs(sum(r.reached_share for k, r in reached.items() if k[0] == plan) - 1) < 1e-9 for plan in (1, 2))
    assert abs(reached[2, "a"].reached_share - 0.8) < 0.02 and {r.mixture_tokens for k, r in reached.items() if k[0] == 2} == {reached[2, "a"].reached_tokens + reached[2, "b"].reached_tokens}
    assert reached[2, "none"].reached_tokens == 0


def test_empty_mixture(spark):
    m = mixture(spark, [], [(1, "a", 0.5, 1)])
    assert m.shortfalls().first().short is False and m.selection().count() == 0 and m.shares().first().reached_tokens == 0
    assert mixture(spark, [(1, ["a"], 5, "x")], []).shortfalls().count() == 0


def test_token_counts(spark):
    texts = [(1, "The cat sat.  Ünï 12345\n"), (2, None), (3, ""), (4, "a" * 50_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("text", "tokens")
    got = {r.doc_id: r.tokens for r in mx.count_tokens(df, "tokens", ["doc_id"]).collect()}
    encoding = mx._encoding(mx.VOCABULARY)
    assert got == {i: len(encoding.encode_ordinary(t)) if t else 0 for i, t in texts}
    assert encoding.decode(encoding.encode_ordinary(texts[0][1])) == texts[0][1]
