"""Exact top-k search by inner product over quantised vectors.

Columnar branch-and-bound. Candidates are packed into blocks in vertical layout (a
row per dimension). Partial scores grow dimension block by dimension block; after
each, a candidate stays only while its partial score plus the largest value that the
remaining dimensions can add (the product of the two remaining norms) reaches the
query's k-th best score so far, and the survivors are compacted. Norms bound, they do
not approximate: the scores returned are exact integers.

Queries come in blocks too. Each (query block, candidate block) pair is one unit of
work of bounded size; its at most k rows per query are merged by a window whose
limit is pushed below the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Vectors of a block, and candidate blocks that one unit of work goes through.
CANDIDATES = 2048
QUERIES = 4096
BLOCKS = 4
#: Dimensions that are added between two compactions.
DIMENSIONS = 16
SCALE = 64
#: Query blocks whose best rows a task keeps.
HELD = 64


def quantise(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) / scale of each component, exact and finite whatever its size as the scale is a power of two; null where the vector or a component is null, NaN or infinite."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    x = F.transform(embedding, lambda v: v.cast("double"))
    good = embedding.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # doubles from 2**53 on are whole
    return F.when(good, F.transform(x, lambda v: F.when(F.abs(v) >= 2.0**53, v).otherwise((v * scale - F.pmod(v * scale, F.lit(1.0))) / scale)))


def whole(y: np.ndarray, scale: int, wide: int = 0) -> tuple[np.ndarray, int]:
    """scale * y for `quantise`d components, and the bytes that store one: whole doubles, or (16) integers of any length where products of doubles might not be exact."""
    if wide:
        flat = [int(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in y.ravel().tolist()]
        out = np.empty(len(flat), dtype=object)
        out[:] = flat
        return out.reshape(y.shape), 16
    q = y * scale
    return q, next(w for w in (1, 2, 4) if not q.size or w == 4 or max(-q.min() - 1, q.max()) < 1 << (8 * w - 1))


def products(q: np.ndarray, width: int) -> bytes:
    """The bytes of a block in vertical layout."""
    return json.dumps(q.tolist()).encode() if width == 16 else np.ascontiguousarray(q).astype(_KINDS[width]).tobytes()


def stored(raw: bytes, width: int, dims: int) -> np.ndarray:
    """What `products` stored."""
    if width < 16:
        return np.frombuffer(raw, _KINDS[width]).reshape(dims, -1 if dims else 0).astype(np.float64)
    rows = json.loads(raw)
    out = np.empty((dims, len(rows[0]) if rows else 0), dtype=object)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, *, scale: int = SCALE, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component take no part, nor
    does a row with a null vec_id. Vectors meet only those of the same length; a query
    with fewer than k partners returns all. A row is not its own partner, nor is another
    row with its vec_id; repeated candidate rows are listed each. Query rows with one
    vec_id share one list: the k best of all their scores. Components of any finite size are scored exactly;
    a score beyond the range of a long counts, and ranks, as the nearest long. Empty
    tables give no rows. Columns beyond vec_id and embedding are ignored.
    """
    v = vectors.select("vec_id", quantise(F.col("embedding"), scale).alias("q"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id is not null and q is not null")
    q = v.where("is_query")
    size = v.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    n_blocks, n_units = max(1, -(-size["q"] // queries)), max(1, -(-size["n"] // (candidates * BLOCKS)))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = "block int, ids binary, q binary, dims int, width int"
    qb = q.select("vec_id", "q", place.alias("block")).repartition(n_blocks, "block").mapInArrow(_pack(2 * queries, scale), blocks).select("*", every(n_units).alias("unit"))
    cb = v.select("vec_id", "q", F.lit(0).alias("block")).mapInArrow(_pack(candidates, scale), blocks)
    cb = cb.select(every(n_blocks).alias("block"), F.pmod(F.xxhash64("ids"), F.lit(n_units)).cast("int").alias("unit"), F.col("ids").alias("c_ids"), F.col("q").alias("c"), F.col("dims").alias("c_dims"), F.col("width").alias("c_width"))
    # dealt out by number, so that few but heavy pairs are not packed into one task
    parts = max(shuffle_partitions(vectors.sparkSession), min(n_blocks * n_units, 100_000))
    cb, qb = cb.repartition(parts, "block", "unit"), qb.repartition(parts, "block", "unit")
    pairs = cb.join(qb, ["block", "unit"]).where("dims = c_dims").select("ids", "q", "c_ids", "c", "dims", "width", "c_width")
    best = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: How whole numbers of a width in bytes are stored.
_KINDS = {1: "i1", 2: "i2", 4: "i4"}
_LONG = (1 << 63) - 1


def large(flat: np.ndarray, sizes: np.ndarray, scale: int) -> np.ndarray:
    """Which vectors have a component whose products might leave the doubles' whole numbers. They stand in blocks of their own, so that their neighbours stay fast."""
    top = np.zeros(len(sizes))
    np.maximum.at(top, np.repeat(np.arange(len(sizes)), sizes), np.abs(flat))
    return (top >= np.sqrt((1 << 53) / np.maximum(sizes, 1)) / scale).astype(np.int64)


def _pack(most: int, scale: int):
    """Rows to blocks of at most `most` vectors of one length, in vertical layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}

        def out(key):
            ids, y = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            q, width = whole(np.ascontiguousarray(y.T), scale, key[2])
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([ids.tobytes()]), pa.array([products(q, width)]), pa.array([key[1]], pa.int32()), pa.array([width], pa.int32())], names=["block", "ids", "q", "dims", "width"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            kinds = np.stack([batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), sizes, large(flat, sizes, scale)], axis=1)
            for key in {*map(tuple, kinds.tolist())}:
                at = np.flatnonzero((kinds == key).all(axis=1))
                for part in np.array_split(at, -(-len(at) // most)):
                    if key in held and sum(len(x[0]) for x in held[key]) + len(part) > most:
                        yield out(key)
                    held.setdefault(key, []).append((ids[part], flat[first[part][:, None] + np.arange(key[1])]))
        for key in list(held):
            yield out(key)

    return run


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, floor: np.ndarray, step: int = DIMENSIONS):
    """The k best of one candidate block for each query; floor: each query's k-th best score so far, raised in place."""
    dims = len(c)
    cuts = [*range(0, dims, step), dims]
    rest = lambda x: np.sqrt(np.maximum(0, np.cumsum((x * x)[::-1], axis=0)[::-1]))  # noqa: E731  norm of the dimensions from each on
    cr, qr = rest(c) if dims else c, rest(q) if dims else q
    n = c.shape[1]
    out = []
    head = q[: cuts[1]].T @ c[: cuts[1]] if dims else np.zeros((q.shape[1], n))
    for j in range(q.shape[1]):
        alive, part, own = np.arange(n), head[j], q[:, j]
        for at, end in zip(cuts[1:-1], cuts[2:], strict=True):
            if floor[j] > -np.inf:
                stay = np.flatnonzero(part + qr[at, j] * cr[at, alive] * (1 + 1e-9) >= floor[j])
                alive, part = alive[stay], part[stay]
            part = part + own[at:end] @ c[at:end, alive]
        other = (c_ids[alive] != q_ids[j]) & (part >= floor[j])
        alive, part = alive[other], part[other]
        if len(part) > k:
            kth = np.partition(part, len(part) - k)[len(part) - k]
            stay = np.flatnonzero(part >= kth)
            alive, part = alive[stay], part[stay]
        order = np.lexsort((c_ids[alive], -part))[:k]
        if len(order) == k:
            floor[j] = max(floor[j], part[order[-1]])
        out.append((c_ids[alive[order]], part[order].astype(np.int64)))
    return out


def search_exactly(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, floor: np.ndarray):
    """As `search_block`, for numbers whose scores may leave the doubles' whole numbers: in Python's integers."""
    rows = [[int(x) for x in col] for col in c.T]
    out = []
    for j in range(q.shape[1]):
        own = [int(x) for x in q[:, j]]
        scores = [max(-_LONG - 1, min(_LONG, sum(x * y for x, y in zip(own, row, strict=True)))) for row in rows]
        best = sorted((-s, i) for s, i in zip(scores, c_ids.tolist(), strict=True) if i != q_ids[j])[:k]
        if len(best) == k:
            floor[j] = max(floor[j], float(-best[-1][0]) * (1 - 1e-12) - 1 if best[-1][0] < 0 else float(-best[-1][0]) * (1 + 1e-12) - 1)
        out.append((np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)))
    return out


def merge(best: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([best[0], found[0]]), np.concatenate([best[1], found[1]])
    order = np.lexsort((ids, ~scores))[:k]  # ~: the reverse order, without leaving the range
    return ids[order], scores[order]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}  # of the last query blocks that this task has met: each query's k-th best score and its best rows

        def out(raw: bytes) -> pa.RecordBatch:
            _, best = held.pop(raw)
            ids = np.repeat(np.frombuffer(raw, np.int64), [len(x[0]) for x in best])
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.concatenate([x[i] for x in best]), pa.int64()) for i in (0, 1))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for ids, q, c_ids, c, *numbers in zip(*batch.columns, strict=True):
                raw, (d, width, c_width) = ids.as_py(), (x.as_py() for x in numbers)
                q_ids, cand = np.frombuffer(raw, np.int64), np.frombuffer(c_ids.as_py(), np.int64)
                if raw not in held:
                    if len(held) == HELD:
                        yield out(next(iter(held)))
                    nothing = np.zeros(0, np.int64)
                    held[raw] = [np.full(len(q_ids), -np.inf), [(nothing, nothing)] * len(q_ids)]
                floor, best = held[raw]
                a, b = stored(q.as_py(), width, d).reshape(d, len(q_ids)), stored(c.as_py(), c_width, d).reshape(d, len(cand))
                found = (search_block if max(width, c_width) < 16 else search_exactly)(a, q_ids, b, cand, k, floor)
                held[raw][1] = [merge(x, y, k) if len(y[0]) else x for x, y in zip(best, found, strict=True)]
        for raw in list(held):
            yield out(raw)

    return run
