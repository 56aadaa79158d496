"""A late-interaction index: exact sums of best cosines, with most chunks left out by bounds.

Token vectors are put into the cells of `operators.cells`. Of a chunk the index keeps, beside the
vectors, which cells they lie in and how far from the centre at most. For a query vector q and a
cell with centre c at distance r, no cosine lies above q.c + r and one lies at or above q.c - r, so a chunk's
score is bounded on both sides from its cells alone. Chunks whose upper bound stays below the
k-th best lower bound are out. A product of the others' vectors with the queries' leaves out what
can't be among the best (see `nearest`), and only the rest is scored sum by sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import cells, nearest
from lorewright.operators.lineage import cut
from lorewright.operators.retrieval import against, top_k

#: Chunks of a block and bytes of its vectors, query vectors of a block, and query blocks whose best chunks a task keeps.
CHUNKS, CHUNK_BYTES = 2048, 1 << 20
QUERY_VECTORS, HELD = 256, 256


@dataclass
class Interaction:
    spark: SparkSession
    path: str
    centres: np.ndarray

    def heads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/heads")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _flat(lists: pa.ListArray) -> np.ndarray:
    """All components of lists of vectors, one after another."""
    return lists.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _numbers(lists: pa.ListArray) -> np.ndarray:
    """How many components each row has."""
    ends = np.append(0, np.cumsum(lists.flatten().value_lengths().to_numpy().astype(np.int64)))
    last = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
    return np.diff(np.append(0, ends[last]))


def clean(lists: DataFrame, column: str) -> DataFrame:
    """Lists without null vectors and without those that hold a null, NaN or infinite component; rows with none left are dropped."""
    good = F.filter(column, lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return lists.withColumn(column, good).where(F.size(column) > 0)


def build(chunks: DataFrame, path: str, *, n_cells: int | None = None, rounds: int = cells.ROUNDS, block: int = CHUNKS) -> Interaction:
    """Indexes (chunk_id, vectors) below `path`; all vectors are of one length. chunk_id must be unique and not null."""
    spark = chunks.sparkSession
    c = cut(clean(chunks.select("chunk_id", "vectors").where("chunk_id is not null"), "vectors"))
    tokens = c.select("chunk_id", F.posexplode("vectors").alias("at", "embedding")).select(F.xxhash64("chunk_id", "at").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = tokens.count()
    centres = cells.fit(cells.usable(tokens), max(1, min(n_cells or int(4 * n**0.5), cells.MAX_CELLS)), rounds=rounds) if n else np.zeros((0, 1))
    held = spark.sparkContext.broadcast(centres)
    kind = dict(chunks.dtypes)["chunk_id"]

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heavy = np.cumsum(_numbers(b.column(1)) * 8) // CHUNK_BYTES
            ends = np.unique(np.concatenate([np.flatnonzero(np.diff(heavy)) + 1, np.arange(0, b.num_rows, block), [b.num_rows]]))
            for i, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = b.slice(i, end - i)
                at, radii, sizes = [], [], []
                for lists in part.column(1):
                    x = _unit(lists.as_py())
                    cell = np.argmax(x @ held.value.T, axis=1)
                    far = np.linalg.norm(x - held.value[cell], axis=1)
                    own, which = np.unique(cell, return_inverse=True)
                    r = np.zeros(len(own))
                    np.maximum.at(r, which, far)
                    at.append(own.astype(np.int32))
                    radii.append(r + 1e-12)
                    sizes.append(len(own))
                ids, own = part.column(0), part.column(1).value_lengths().to_numpy().astype(np.int32)
                packed = np.array(sizes, np.int32), np.concatenate(at), np.concatenate(radii), own, _flat(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()]) for x in packed)], names=["ids", "sizes", "cells", "radii", "lengths", "data"])

    c.mapInArrow(head, f"ids array<{kind}>, sizes binary, cells binary, radii binary, lengths binary, data binary").write.mode("overwrite").parquet(f"{path}/heads")
    c.write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Interaction:
    return Interaction(spark, path, np.array([r["centre"] for r in sorted(spark.read.parquet(f"{path}/centres").collect())]))


def bounds(near: np.ndarray, first: np.ndarray, cell: np.ndarray, radius: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, chunk) lower and upper bounds. near: (query vector, cell); first: each query's first vector; cell, radius: of all chunks, `sizes` of each."""
    start = np.cumsum(sizes) - sizes
    values = near[:, cell]
    out = []
    for x in (values - radius, values + radius):
        out.append(np.add.reduceat(np.maximum.reduceat(x, start, axis=1), first, axis=0))
    return out[0], out[1]


def products(q: np.ndarray, first: np.ndarray, d: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(query, chunk) scores up to nearest.ERROR for each of a query's vectors, NaN where that can't be said. first, start: each query's and each chunk's first vector."""
    close = nearest.cosines(q, d, nearest.lengths(q), nearest.lengths(d))
    return np.add.reduceat(np.maximum.reduceat(close, start, axis=1), first, axis=0)


def scored(q: np.ndarray, first: np.ndarray, d: np.ndarray, start: np.ndarray, who: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The scores of pairs of a query and a chunk, added up as `retrieval.late_interaction` adds them."""
    qn, dn = nearest.lengths(q), nearest.lengths(d)
    n, m = np.diff(np.append(first, len(q))), np.diff(np.append(start, len(d)))
    out = np.zeros(len(who))
    step = max(1, nearest.PAIRS // int(m.max(initial=1)))
    for i in range(0, len(who), step):
        w, a = who[i : i + step], at[i : i + step]
        begin = np.cumsum(m[a]) - m[a]
        vector = np.arange(m[a].sum()) - np.repeat(begin, m[a]) + np.repeat(start[a], m[a])
        for j in range(int(n[w].max())):
            has = n[w] > j
            mine = np.repeat(np.where(has, first[w] + j, first[w]), m[a])
            best = np.maximum.reduceat(nearest.scored(q, d, mine, vector, qn, dn), begin)
            out[i : i + step][has] += best[has]
    return out


def search(queries: DataFrame, index: Interaction, k: int = 10, *, digits: int | None = None) -> DataFrame:
    """(query_id, query_vectors) -> the k best chunks by the sum of each query vector's best cosine, as `retrieval.late_interaction` over all chunks.

    query_id must be unique; queries without a usable vector find nothing. Queries go in blocks of
    QUERY_VECTORS vectors or one query; a block meets every block of chunks, and each task keeps its
    own best k before the shuffle.
    """
    q = clean(queries.select("query_id", "query_vectors"), "query_vectors")
    kind = dict(q.dtypes)["query_id"]
    chunk = dict(index.vectors().dtypes)["chunk_id"]
    held = index.spark.sparkContext.broadcast(index.centres)
    margin = 0.0 if digits is None else 10.0**-digits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, x = b.column(0), b.column(1).value_lengths().to_numpy().astype(np.int32), _flat(b.column(1))
            width = len(x) // max(int(n.sum()), 1)
            i, at = 0, 0
            while i < len(n):
                end = i + max(1, int(np.searchsorted(np.cumsum(n[i:]), QUERY_VECTORS, side="right")))
                size = int(n[i:end].sum())
                own = ids.slice(i, end - i)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([(np.cumsum(n[i:end]) - n[i:end]).astype(np.int32).tobytes()]), pa.array([x[at * width : (at + size) * width].tobytes()])], names=["query_ids", "first", "query_data"])
                i, at = end, at + size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list] = {}

        def out(key: bytes) -> pa.RecordBatch:
            query_ids, *_, (who, ids, score) = kept.pop(key)
            return pa.RecordBatch.from_arrays([query_ids.take(pa.array(who)), ids, pa.array(score)], names=["query_id", "chunk_id", "score"])

        dims = held.value.shape[1]
        for b in batches:
            last = None
            for i in range(b.num_rows):
                row = {n: b.column(c)[i] for c, n in enumerate(b.schema.names)}
                raw, data, ids = row["query_data"].as_py(), row["data"].as_py(), row["ids"].values
                key = repr(row["query_ids"].values.to_pylist()).encode() + raw
                if key not in kept:
                    if len(kept) == HELD:
                        yield out(next(iter(kept)))
                    x, first = np.frombuffer(raw, np.float64).reshape(-1, dims), np.frombuffer(row["first"].as_py(), np.int32)
                    none = np.zeros(0, np.int64), ids.slice(0, 0), np.zeros(0)
                    error = nearest.ERROR * int(np.diff(np.append(first, len(x))).max())
                    kept[key] = [row["query_ids"].values, x, _unit(x), first, error, np.full(len(first), -np.inf), none]
                if last is None or last[0] != data:
                    sizes, cell, radius, n = (np.frombuffer(row[c].as_py(), t) for c, t in (("sizes", np.int32), ("cells", np.int32), ("radii", np.float64), ("lengths", np.int32)))
                    last = data, np.frombuffer(data, np.float64).reshape(-1, dims), n, np.cumsum(n) - n, sizes, *np.unique(cell, return_inverse=True), radius
                _, d, n, start, sizes, own, cell, radius = last
                _, x, unit, first, error, floor, had = kept[key]
                slack = margin + 2 * error
                low, high = bounds(unit @ held.value[own].T, first, cell, radius, sizes)
                limit = np.fmax(floor, np.partition(low, low.shape[1] - k, axis=1)[:, -k]) if low.shape[1] >= k else floor
                can = np.flatnonzero((high >= (limit - slack)[:, None]).any(axis=0))
                if not len(can):
                    continue
                every = np.repeat(start[can] - (np.cumsum(n[can]) - n[can]), n[can]) + np.arange(n[can].sum())
                part, begin = d[every], np.cumsum(n[can]) - n[can]
                who, at = nearest.candidates(products(x, first, part, begin), k, floor, margin + error)
                if not len(who):
                    continue
                score = scored(x, first, part, begin, who, at)
                *best, whose, kth = nearest.best(np.concatenate([had[0], who]), pa.concat_arrays([had[1], ids.take(pa.array(can[at]))]), np.concatenate([had[2], score]), k, margin)
                floor[whose] = np.fmax(floor[whose], kth)  # a NaN raises nothing
                kept[key][-1] = tuple(best)
        for key in list(kept):
            yield out(key)

    packed = q.mapInArrow(pack, f"query_ids array<{kind}>, first binary, query_data binary")
    # few but heavy rows, which go to as many tasks as there are
    heads = index.heads().repartition(max(1, int(index.spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    hits = against(heads, packed, "query_ids").mapInArrow(find, f"query_id {kind}, chunk_id {chunk}, score double")
    return top_k(hits.select("query_id", "chunk_id", (F.round("score", digits) if digits is not None else F.col("score")).alias("score")), k)
