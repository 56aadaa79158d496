"""Cosine search in blocks: what a plain comparison of all with all says, and no more than the best leaves a task."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorewright.functions.text import cosine
from lorewright.operators import nearest, retrieval


def plain(queries, vectors, k, least, digits):
    score = cosine(F.col("query_vector"), F.col("embedding"))
    hits = vectors.crossJoin(queries).select("query_id", "chunk_id", (F.round(score, digits) if digits is not None else score).alias("score"))
    return retrieval.top_k(hits.where(F.col("score") >= least), k)


def test_blocks_find_what_a_plain_search_finds(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "PAIRS", 50)
    r = random.Random(5)
    vectors = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(60)]
    vectors += [vectors[i % 7] for i in range(60)] + [[2 * x for x in vectors[3]]] * 9  # many copies, and ties but for rounding
    vectors += [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1.0] * 5, [1e-200] * 6, [1e200] * 6, [-0.0] * 6]
    ids = [None if i == 44 else (i * 37) % 997 for i in range(len(vectors))]
    v = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "chunk_id long, embedding array<double>")
    named = v.select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    q = v.where("chunk_id % 3 = 0 or size(embedding) != 6").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for rows, k, least, digits in ((v, 10, 0.2, 8), (v, 3, -2.0, None), (named, 5, 0.0, 8)):
        got, want = (sorted(map(str, d.select("query_id", "chunk_id", "score", "rank").collect())) for d in (retrieval.vector_search(q, rows, k, least, digits=digits), plain(q, rows, k, least, digits)))
        assert got == want
    assert retrieval.vector_search(q, v.where("false"), 3, 0.0).count() == retrieval.vector_search(q.where("false"), v, 3, 0.0).count() == 0


def test_a_task_hands_on_the_best_only():
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(20, 8)), rng.normal(size=(300, 8))
    c = np.concatenate([c] * 4)  # every score four times
    row = lambda ids, x: [pa.array([ids.tolist()]), pa.array([8], pa.int32()), pa.array([x.tobytes()])]
    batches = [pa.RecordBatch.from_arrays([*row(np.arange(i, i + 100), c[i : i + 100]), *row(np.arange(20), q)], names=list("abcdef")) for i in range(0, 1200, 100)]
    out = pa.Table.from_batches(nearest.search(10, 0.0, 1e-8)(iter(batches)))
    assert out.num_rows <= 20 * 12
    exact = (q @ c.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)
    for i in range(20):
        mine = sorted(((-round(s, 8), j) for j, x, s in zip(*(out.column(n).to_pylist() for n in ("chunk_id", "query_id", "score")), strict=True) if x == i))[:10]
        assert [j for _, j in mine] == np.lexsort((np.arange(1200), -exact[i].round(8)))[:10].tolist()
