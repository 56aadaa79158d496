"""Cuts by counting, and small steps between tables."""

import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators import graph, records, retrieval


@pytest.mark.parametrize("values", [[5], [-(1 << 63), (1 << 63) - 1, 0, -1, 1, -1, -1], [7] * 40, None])
def test_nth_smallest(spark, values):
    r = random.Random(1)
    values = values or [r.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [3] * 5
    d = spark.createDataFrame([(v,) for v in values], "v long")
    for n in {1, 2, len(values) // 2 + 1, len(values)}:
        if n <= len(values):
            want = sorted(values)[n - 1]
            assert records.nth_smallest(d, "v", n) == (want, sum(v < want for v in values))
    assert records.nth_smallest(d, "v", len(values) + 1) is None


def test_train_validation_sizes(spark):
    for n, keys in ((1, 1), (10, 10), (100, 3), (0, 1)):
        d = spark.createDataFrame([(i, i % keys) for i in range(n)], "i int, k int")
        split = records.train_validation(d, F.col("k"))
        got = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert got.get("validation", 0) == (max(1, n // 5) if n else 0) and sum(got.values()) == n
        assert sorted(r["i"] for r in split.collect()) == list(range(n))


def test_small_steps(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2), (2, "a", 0.4, 1)], "query_id int, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "p", "g"), ("b", None, "g")], "chunk_id string, parent_id string, grp string")
    key = lambda d, *c: sorted(map(tuple, d.select(*c).collect()), key=str)
    assert key(retrieval.above(hits, 0.5), "query_id", "chunk_id") == [(1, "a"), (1, "b")]
    assert key(retrieval.without(hits, hits.where("query_id = 1 and chunk_id = 'a'")), "query_id", "chunk_id") == [(1, "b"), (2, "a")]
    assert key(retrieval.within(hits, chunks.where("parent_id is null")), "query_id", "chunk_id") == [(1, "b")]
    assert key(retrieval.with_parents(hits, chunks.limit(1)), "query_id", "chunk_id", "parent_id") == [(1, "a", "p"), (1, "b", None), (2, "a", "p")]
    assert key(retrieval.best_groups(hits, chunks, "grp"), "query_id", "grp", "score", "n") == [(1, "g", 0.9, 2), (2, "g", 0.4, 1)]
    said = spark.createDataFrame([(1, "x [2] [2] [9]"), (2, "none")], "query_id int, answer string")
    assert key(retrieval.cited_hits(said, hits), "query_id", "chunk_id") == [(1, "b")]
    edges = spark.createDataFrame([("x", "n"), ("y", "n"), ("x", "n"), ("x", "m")], "src string, dst string")
    assert key(graph.members(edges), "node", "n", "nodes") == [("m", 1, ["x"]), ("n", 2, ["x", "y"])]


@pytest.mark.parametrize("most", [(10_000, 16 << 20), (3, 16 << 20), (10_000, 64)])
def test_search_in_blocks_gives_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", most[1])
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)], "chunk_id int, embedding array<double>")
    q = v.where("chunk_id < 10").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = retrieval.against(v, q, block=most[0])
    assert rows.count() == 400 and rows.select("chunk_id", "query_id").distinct().count() == 400
