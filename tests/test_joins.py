"""Hyperplanes, names in texts, set similarity and run figures against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.operators import graph, hyperplanes, linking, overlap, records
from lorewright.plans import metrics

# -- hyperplanes


def cache_of(spark, n=600, dims=16, seed=1):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    rows = [(f"k{i}", f"answer {i}", [float(x) for x in base[i].astype(np.float32)]) for i in range(n)]
    rows += [(f"z{i}", "copy", rows[7][2]) for i in range(200)] + [("n1", "x", None), ("n2", "x", [0.0] * dims)]
    near = [[float(x) for x in (base[i % n] + 0.05 * (i % 9) * r.normal(size=dims)).astype(np.float32)] for i in range(150)]
    asked = [(i, f"question {i}", v) for i, v in enumerate(near)] + [(900, "q", None), (901, "q", [0.0] * dims)]
    return spark.createDataFrame(rows, "cache_id string, response string, query_embedding array<float>"), spark.createDataFrame(asked, "question_id int, query string, query_vector array<float>")


def answers(df):
    return {r["question_id"]: (r["cache_id"], r["response"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.mark.parametrize(("least", "bits"), [(0.92, None), (0.92, 12), (0.7, 6)])
def test_lookup_finds_what_a_scan_finds(spark, least, bits):
    cache, asked = cache_of(spark)
    want = answers(records.answer_lookup(asked.where("question_id < 900"), cache, least))
    got = answers(hyperplanes.answer_lookup(asked, cache, least, bits=bits))
    assert len(want) > 50 and set(got) <= set(want)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.98 * len(want)
    assert set(answers(hyperplanes.answer_lookup(asked, cache, least, bits=bits, fallback=True))) == set(want)


def test_lookup_of_the_same_query_and_of_nothing(spark):
    cache, asked = cache_of(spark, 20)
    exact = asked.where("question_id = 3").select(hyperplanes.short_hash(F.col("query")).alias("cache_id"), F.lit("held").alias("response"), F.lit(None).cast("array<float>").alias("query_embedding"))
    assert answers(hyperplanes.answer_lookup(asked, cache.unionByName(exact)))[3] == answers(records.answer_lookup(asked.where("question_id = 3"), exact))[3]
    assert hyperplanes.answer_lookup(asked, cache.limit(0)).count() == 0
    assert hyperplanes.answer_lookup(asked.limit(0), cache).count() == 0


def test_tables_bring_the_chance_to_miss_below_the_bound():
    for least in (0.3, 0.92, 0.99):
        for bits in (4, 12, 24):
            p = 1 - math.acos(least) / math.pi
            found = p**bits + bits * p ** (bits - 1) * (1 - p)
            assert (1 - found) ** hyperplanes.tables_needed(bits, least) <= hyperplanes.MISS
    assert hyperplanes.tables_needed(8, 1.0) == 1


# -- names and texts


@pytest.mark.parametrize("sizes", [(100_000, 4_000_000), (7, 20)])
def test_names_in_texts_and_texts_in_names(spark, monkeypatch, sizes):
    monkeypatch.setattr(linking, "NAME_CHARS", sizes[0])
    monkeypatch.setattr(linking, "TEXT_CHARS", sizes[1])
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    names = sorted({word(1 + i % 6) for i in range(40)}) + ["", None, "aaa", "aa", "a"]
    texts = [(i, word(i % 9)) for i in range(60)] + [(100, "aaaa"), (101, None), (102, ""), (7, "ab"), (7, "ab")]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(texts, "query_id int, text string")
    real = {x for x in names if x}
    got = sorted(map(tuple, linking.names_in_texts(t, n).collect()))
    assert got == sorted({(i, x) for i, s in texts if s for x in real if x in s})
    got = sorted(map(tuple, linking.texts_in_names(t, n).collect()))
    assert got == sorted({(i, x) for i, s in texts if s for x in real if s in x})
    assert linking.names_in_texts(t.limit(0), n).count() == linking.texts_in_names(t, n.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(16_384, 256, 1_000_000), (7, 5, 9)])
def test_lists_of_names(spark, monkeypatch, sizes):
    for name, n in zip(("NAMES", "QUERIES", "LISTED"), sizes, strict=True):
        monkeypatch.setattr(linking, name, n)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    names = sorted({word(1 + i % 7) for i in range(60)})
    texts = [(i % 20 or None, word(i % 6)) for i in range(90)]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(texts, "query_id int, text string")
    want = {}
    for i, s in texts:
        want.setdefault(i, set()).update(x for x in names if s and s in x)
    got = {q: x for q, x in linking.name_lists(t, n).collect()}
    assert got == {i: sorted(x, key=str.encode) for i, x in want.items() if x}


def test_texts_that_many_queries_ask_for_are_matched_once(spark):
    n = linking.numbered(spark.range(50).select(F.concat(F.lit("the name "), "id").alias("name")), 50, 16)
    assert n.agg(F.max("part"), F.max("at")).first() == (3, 15)
    # 2,000 queries by 50 names, which were rows of a join before; 50 rows of three parts of names now
    asked = spark.range(2000).select(F.col("id").alias("query_id"), F.lit("name").alias("text"))
    seen = []
    plain = linking._matches
    try:
        linking._matches = lambda t, x: (lambda m: (seen.append(m.count()), m)[1])(plain(t, x))
        lists = linking.name_lists(asked, n.select("name"))
        assert lists.where("size(names) = 50").count() == 2000 and seen == [50]
    finally:
        linking._matches = plain


def test_graph_search_by_part_of_a_name(spark):
    nodes = spark.createDataFrame([("photon pair", "Photon pair", "Concepto", 3, ["c1"]), ("laser", "Laser", "Concepto", 5, ["c2"])], "node string, name string, type string, mentions long, chunk_ids array<string>")
    edges = spark.createDataFrame([("laser", "photon pair", 1.0, "CO_OCCURS", "c1")], "src string, dst string, weight double, relation string, chunk_id string")
    q = spark.createDataFrame([(1, "photon"), (2, "a laser beam and a photon pair"), (3, "nothing"), (4, None)], "query_id int, query string")
    got = [(r["query_id"], r["rank"], r["node"], r["related"]) for r in graph.search(q, nodes, edges).collect()]
    assert sorted(got) == [(1, 1, "photon pair", ["laser"]), (2, 1, "laser", ["photon pair"]), (2, 2, "photon pair", ["laser"])]


# -- sets


@pytest.mark.parametrize("measure", ["jaccard", "contained"])
@pytest.mark.parametrize("percent", [1, 50, 67, 80, 100])
def test_similar_sets(spark, measure, percent):
    r = random.Random(percent)
    make = lambda n: [(i, [f"w{min(int(r.paretovariate(0.6)), 30)}" for _ in range(r.randrange(0, 9))]) for i in range(n)]
    a, b = make(70) + [(70, None), (71, []), (72, [None]), (3, ["w1"])], make(60) + [(3, ["w1", None, "w1"])]
    left, right = spark.createDataFrame(a, "left_id int, words array<string>"), spark.createDataFrame(b, "right_id int, words array<string>")
    want = []
    for i, x in a:
        for j, y in b:
            p, q = {w for w in x or [] if w}, {w for w in y or [] if w}
            if p and q and 100 * len(p & q) >= percent * (len(p | q) if measure == "jaccard" else len(p)):
                want.append((i, j, len(p & q), len(p), len(q)))
    assert sorted(map(tuple, overlap.similar_sets(left, right, percent, measure=measure).collect())) == sorted(want)


def test_copies_cost_no_pairs(spark):
    left = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(500)], "left_id int, words array<string>")
    right = left.withColumnRenamed("left_id", "right_id")
    pairs, l, r = overlap.similar_classes(left, right, 90)
    assert (pairs.count(), l.count(), r.count()) == (1, 500, 500)
    with pytest.raises(ValueError, match="percent"):
        overlap.similar_classes(left, right, 0)


# -- figures of a run


def test_run_figures(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run_id, n in (("one", 10), ("two", 25)):
        run = metrics.Run(spark, run_id)
        d = run.watch(spark.range(n), "all", top=F.max("id"))
        even = run.watch(d.where("id % 2 = 0"), "even")
        with pytest.raises(ValueError, match="watched"):
            run.watch(even, "all")
        even.write.mode("overwrite").parquet(str(tmp_path / "out"))
        run.write(path)
    runs = spark.read.parquet(path)
    assert runs.count() == 6
    got = {(r["stage"], r["measure"]): (r["before"], r["after"], r["ratio"]) for r in metrics.changes(runs, "one", "two").collect()}
    assert got == {("all", "rows"): (10, 25, 2.5), ("all", "top"): (9, 24, 24 / 9), ("even", "rows"): (5, 13, 2.6)}
