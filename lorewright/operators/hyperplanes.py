"""Looking up similar questions by random hyperplanes, verified by their cosine.

The signs of a vector's products with `bits` random planes are its code. Two vectors at an angle a
agree on a plane with the probability p = 1 - a / pi. A lookup asks each of several tables for the
code of the question and all codes that differ from it in one bit, so a table finds a vector at the
threshold's angle with p**bits + bits * p**(bits - 1) * (1 - p), and there are as many tables as
bring the chance that all of them miss below `miss`. Closer vectors are missed less often.

Equal vectors are one row of the index, so a question that everybody asks is no hot bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import cosine, short_hash
from lorewright.operators import cells
from lorewright.operators.lineage import cut
from lorewright.operators.retrieval import against

#: Chance to miss a vector at the threshold, and the seed of the planes.
MISS, SEED = 0.005, 20_240
BITS = (4, 24)


def tables_needed(bits: int, least: float, miss: float = MISS) -> int:
    p = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    found = p**bits + bits * p ** (bits - 1) * (1 - p)
    return 1 if found >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-found)))


def bits_for(n: int) -> int:
    """About eight vectors a bucket, were they spread evenly."""
    return max(BITS[0], min(BITS[1], round(math.log2(max(n, 1))) - 3))


def codes(vectors: DataFrame, column: str, bits: int, tables: int, *, near: bool = False, seed: int = SEED) -> DataFrame:
    """`vectors` with a row for each table and code: the vector's own, or (near) also those one bit away. Vectors must be usable (`cells.usable`)."""
    width, at = len(vectors.columns), vectors.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = part.column(at)
                n = len(x)
                m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                planes = np.random.default_rng(seed).normal(size=(m.shape[1], tables * bits))
                code = ((m @ planes >= 0).reshape(n, tables, bits) * weights).sum(axis=2)
                if near:
                    code = np.concatenate([code[:, :, None], code[:, :, None] ^ weights], axis=2)
                else:
                    code = code[:, :, None]
                each = pa.array(np.repeat(np.arange(n), tables * code.shape[2]))
                table = np.broadcast_to(np.arange(tables)[None, :, None], code.shape)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(each) for c in range(width)), pa.array(table.ravel().astype(np.int32)), pa.array(code.ravel().astype(np.int64))], names=[*b.schema.names, "table", "code"])

    return vectors.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes) + ", table int, code long")


def answer_lookup(questions: DataFrame, cache: DataFrame, least: float = 0.92, *, miss: float = MISS, fallback: bool = False, bits: int | None = None) -> DataFrame:
    """As `records.answer_lookup`: the answer of the same query, else of the most similar one from the threshold on.

    A similar one is missed with a probability of at most `miss`; with `fallback`, questions that
    found none are compared with the whole cache. Questions and rows without a usable vector
    have only the first way. question_id must be unique.
    """
    q = cut(questions.withColumn("cache_id", short_hash(F.col("query"))))
    exact = q.join(cache.select("cache_id", "response"), "cache_id").select("question_id", "cache_id", "response", F.lit(1.0).alias("similarity"))
    rest = cut(cells.usable(q.join(exact.select("question_id"), "question_id", "left_anti").select("question_id", "query_vector"), "query_vector"))
    # of equal vectors the row with the greatest id answers, as in a scan
    held = cells.usable(cache, "query_embedding").groupBy("query_embedding").agg(F.max(F.struct("cache_id", "response")).alias("r"))
    held = cut(held.select("r.cache_id", "r.response", "query_embedding"))
    bits = bits or bits_for(held.count())
    n = tables_needed(bits, least, miss)
    stored = codes(held.select("cache_id", "query_embedding"), "query_embedding", bits, n).select("table", "code", "cache_id")
    asked = codes(rest, "query_vector", bits, n, near=True).select("question_id", "table", "code")
    pairs = stored.join(asked, ["table", "code"]).select("question_id", "cache_id").distinct()
    score = cosine(F.col("query_vector"), F.col("query_embedding"))
    near = pairs.join(held, "cache_id").join(rest, "question_id").select("question_id", "cache_id", "response", score.alias("similarity")).where(F.col("similarity") >= least)
    best = lambda d: d.groupBy("question_id").agg(F.max_by(F.struct("cache_id", "response", "similarity"), F.struct("similarity", "cache_id")).alias("b")).select("question_id", "b.*")
    found = best(near)
    if fallback:
        found = cut(found)
        left = rest.join(found.select("question_id"), "question_id", "left_anti")
        found = found.unionByName(best(against(held, left, "question_id").select("question_id", "cache_id", "response", score.alias("similarity")).where(F.col("similarity") >= least)))
    return exact.unionByName(found)
