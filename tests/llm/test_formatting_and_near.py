from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import formatting_dedup as fd
from plumbline.llm import near_duplicates as nd
from plumbline.llm.common import Scratch
from tests.conftest import SF, oracle_rows, same_rows


def q(spark, rows):
    """rows: (ordinal, stem, options or raw JSON)"""
    data = [(o, s, t if isinstance(t, str) or t is None else json.dumps([{"text": x, "source_index": i} for i, x in enumerate(t)])) for o, s, t in rows]
    return spark.createDataFrame(data, "ordinal long, question_text string, choices_json string")


def keyed(df):
    return df.select(F.lit("t").alias("table_name"), F.col("ordinal").alias("id"), fd.question_key(F.col("question_text"), F.col("choices_json")).alias("key"))


def found(spark, rows):
    return {(r.first_id, r.copy_id) for r in fd.copies(fd.duplicate_runs(keyed(q(spark, rows)))).collect()}


def test_what_counts_as_the_same(spark):
    base = ["Alpha 1.5", "beta"]
    same = [
        (1, "What is -5 plus 2.5?", base),
        (2, "what IS  -5 (plus) 2.5 !", ["ALPHA\t1.5", "“beta”"]),
        (3, "What is -5 plus 2.5?", '[{"source_index": 0, "text": "\\u0041lpha 1.5"}, {"text": "be\\u0074a"}]'),
    ]
    other = [
        (4, "What is 5 plus 2.5?", base),
        (5, "What is -5 plus 25?", base),
        (6, "What is -5 plus 2.5?", ["beta", "Alpha 1.5"]),
        (7, "What is -5 plus 2.5? Alpha 1.5", ["beta"]),
    ]
    assert found(spark, same + other) == {(1, 2), (1, 3)}


def test_edges_of_the_input(spark):
    rows = [(1, None, None), (2, "", "[]"), (3, "...", None), (4, "x", "not json"), (5, "X", "NOT json"), (6, "x" * 200_000, ["y"]), (7, "X" * 200_000, ["Y"]), (None, "x", ["y"]), (8, "a", [None, "b"]), (9, "a", ["", "b"])]
    assert found(spark, rows) == {(1, 2), (1, 3), (4, 5), (6, 7), (8, 9)}
    assert found(spark, []) == set()


def test_tables_do_not_mix_and_columns_may_clash(spark):
    df = spark.createDataFrame([("a", 1, "k", 0), ("b", 2, "k", 0), ("a", 3, "k", 0)], "table_name string, id long, key string, h int")
    runs = fd.duplicate_runs(df)
    assert [tuple(r) for r in fd.copies(runs).collect()] == [("a", 1, 3)]
    assert {tuple(r) for r in fd.representatives(runs).collect()} == {("a", 1, 2), ("b", 2, 1)}


def test_hot_set_over_many_ranges(spark):
    """A set of two thirds of all rows spans partitions and is stitched, whatever their number."""
    rng = random.Random(3)
    records = [("t", i, "hot" if i % 3 else f"k{rng.randrange(40)}") for i in range(3000)]
    expected: dict[str, list[int]] = {}
    for _, i, k in records:
        expected.setdefault(k, []).append(i)
    want = {(min(v), i) for v in expected.values() for i in v if i != min(v)}
    df = spark.createDataFrame(records, "table_name string, id long, key string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {(r.first_id, r.copy_id) for r in fd.copies(fd.duplicate_runs(df)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


WORD = re.compile(r"[^\W_]+")


def brute(rows, threshold=0.6):
    def words(stem, options):
        return frozenset(WORD.findall(((stem or "") + " " + " ".join(options)).lower()))

    sets = [(o, words(s, t), re.sub(r"[\W_]", "", (s or "").lower()) + "|" + "|".join(re.sub(r"[\W_]", "", x.lower()) for x in t)) for o, s, t in rows]
    out = set()
    for i, (a, wa, ka) in enumerate(sets):
        for b, wb, kb in sets[i + 1 :]:
            if ka != kb and wa and wb and len(wa & wb) >= threshold * len(wa | wb) - 1e-12:
                out.add((min(a, b), max(a, b)))
    return out


def fixture_rows(n=260, seed=5):
    rng, vocabulary = random.Random(seed), [f"w{i}" for i in range(160)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            _, stem, options = rng.choice(rows)
            words = stem.split(" ")
            for _ in range(rng.choice((0, 1, 2, 4))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(words)
            rows.append((i, " ".join(words), list(options)))
        else:
            rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))), [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))]))
    return rows


@pytest.mark.parametrize("setting", [{}, {"region_rows": 3, "pivots": 3, "depth": 2, "sketch_bits": 8}, {"region_rows": 5, "pivots": 4, "depth": 0, "sketch_bits": 6}])
def test_near_duplicates_equal_brute_force(spark, setting):
    rows = fixture_rows()
    got = nd.near_duplicates(q(spark, rows).withColumn("words", F.lit("clash")).withColumn("cls", F.lit(1)), **setting).collect()
    assert {(r.ordinal_a, r.ordinal_b) for r in got} == brute(rows) and len(got) == len(brute(rows))


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_other_thresholds(spark, threshold):
    rows = fixture_rows(120, 9)
    assert {(r.ordinal_a, r.ordinal_b) for r in nd.near_duplicates(q(spark, rows), threshold).collect()} == brute(rows, threshold)


def test_near_duplicates_edges(spark):
    rows = [(1, None, None), (2, "", "[]"), (3, "a b c d e f g h i j", ["k"]), (4, "a b c d e f g h i j", ["x"]), (5, "A, b c d e f g h i j!", ["k"]), (6, "k j i h g f e d c b a", []), (None, "a b c d e f g h i j", ["k"])]
    got = {(r.ordinal_a, r.ordinal_b) for r in nd.near_duplicates(q(spark, rows)).collect()}
    assert got == {(3, 4), (4, 5), (3, 6), (5, 6), (4, 6)}
    assert nd.near_duplicates(q(spark, [])).count() == 0
    long = " ".join(f"v{i}" for i in range(30_000))
    assert nd.near_duplicates(q(spark, [(1, long, []), (2, long + " more", [])])).count() == 1
    with pytest.raises(ValueError):
        nd.near_duplicates(q(spark, rows), 0.0)


@pytest.mark.parametrize("module", [fd, nd])
def test_equals_sql(spark, module):
    for name, sql in module.ORACLE_SQL.items():
        assert same_rows(module.QUERIES[name](spark, SF).toPandas(), oracle_rows(sql)), name


def groups_of(edges):
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(2)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "path": [(i, i + 1) for i in range(120)], "star": [(500, i) for i in range(400)]}[kind] + [(7, 7)]
    want = {x: r for x, r in groups_of([e for e in edges if e[0] != e[1]]).items()}
    got = nd.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    assert nd.components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_links_and_groups_say_the_same_as_pairs(spark):
    rows = [*fixture_rows(150, 4), (900, None, None), (901, "", []), (902, "mis-fire of one two three", []), (903, "misfire of one two three", [])]
    pairs = brute([r if r[1] is not None else (r[0], "", []) for r in rows])
    where = {r.ordinal: r for r in nd.near_groups(q(spark, rows)).collect()}
    links = {(r.first_a, r.first_b) for r in nd.near_links(q(spark, rows)).collect()}
    assert len(where) == len(rows)
    assert {tuple(sorted((where[a].class_id, where[b].class_id))) for a, b in pairs} == links
    assert all(r.n_links == sum(r.class_id in e for e in links) for r in where.values())
    edges = [*pairs, *((r.ordinal, r.class_id) for r in where.values()), (900, 901), (902, 903)]
    assert {o: r.group_id for o, r in where.items()} == groups_of(edges)
    assert where[902].class_id != where[903].class_id and where[900].n_links == 0


def test_a_class_with_a_third_of_all_rows(spark):
    """Copies meet as one set: the links stay few, whatever the number of copies."""
    rows = [(i, "one two three four five six seven eight", ["nine"]) for i in range(3000)] + [(4000, "one two three four five six seven eight", ["ten"])]
    rows += [(5000 + i, f"x{i} y{i} z{i} u{i}", [f"v{i}"]) for i in range(6000)]
    links = nd.near_links(q(spark, rows)).collect()
    assert [(r.first_a, r.first_b) for r in links] == [(0, 4000)]
    assert nd.near_duplicates(q(spark, rows)).count() == 3000


def test_production_parameters_reach_the_pivot_splits(spark, monkeypatch):
    """Variants of one question, and of a second: regions so large that pivots split them, with the default parameters."""
    seen = []
    split = nd._split
    monkeypatch.setattr(nd, "_split", lambda *a: seen.append(a) or split(*a))
    stems = [[f"a{i}" for i in range(9)], [f"b{i}" for i in range(9)]]
    rows = [(k * 10_000 + i, " ".join([*stems[k], f"own{k}x{i}"]), []) for k in range(2) for i in range(2600)]
    links = nd.near_links(q(spark, rows))
    assert links.count() == 2 * 2600 * 2599 // 2 and seen


def test_groups_of_nothing_and_of_rows_without_an_ordinal(spark):
    assert nd.near_groups(q(spark, [])).count() == 0 and nd.near_links(q(spark, [])).count() == 0
    rows = [(None, "one two three", ["four"]), (5, "one two three", ["four"]), (6, "one two three", ["five"])]
    got = {r.ordinal: (r.class_id, r.n_links, r.group_id) for r in nd.near_groups(q(spark, rows).withColumn("group_id", F.lit(9))).collect()}
    assert got == {5: (5, 1, 5), 6: (6, 1, 5)}
