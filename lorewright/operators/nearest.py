"""Best rows by cosine, block against block: a matrix product finds what can be among the best, and only that is scored as `functions.text.cosine` scores it, sum by sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, bytes of one, pairs that are scored at a time, and query blocks whose best rows a task keeps.
BLOCK, BLOCK_BYTES, PAIRS, HELD = 1024, 4 << 20, 1 << 20, 64
#: How far a product may be from a sum; and lengths beyond which products might overflow or vanish, so that such vectors' pairs are all scored.
ERROR, TINY, HUGE = 1e-9, 1e-100, 1e100


def whole(vector: Column) -> Column:
    """Neither null nor with a null: others have no cosine."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull())


def packed(rows: DataFrame, id_: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(ids, dims, data) of at most `block` whole vectors of one length each."""
    v = rows.where(whole(F.col(vector))).select(id_, F.col(vector).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)[id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dims: int) -> pa.RecordBatch:
            ids, x = zip(*held.pop(dims), strict=True)
            ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([dims], pa.int32()), pa.array([np.concatenate(x).tobytes()])], names=["ids", "dims", "data"])

        for b in batches:
            flat, sizes = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                most = max(1, min(block, BLOCK_BYTES // max(8 * dims, 1)))
                at = np.flatnonzero(sizes == dims)
                for i in range(0, len(at), most):
                    part = at[i : i + most]
                    if dims in held and sum(len(x) for x, _ in held[dims]) + len(part) > most:
                        yield out(dims)
                    held.setdefault(dims, []).append((b.column(0).take(pa.array(part)), flat[first[part][:, None] + np.arange(dims)]))
        for dims in list(held):
            yield out(dims)

    return v.mapInArrow(run, f"ids array<{kind}>, dims int, data binary")


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up dimension by dimension as Spark does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


@np.errstate(all="ignore")  # infinite and NaN components are scored as they are
def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def ratio(dot: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return np.where(norm == 0, 0.0, dot / np.where(norm == 0, 1.0, norm))


@np.errstate(all="ignore")
def cosines(q: np.ndarray, c: np.ndarray, qn: np.ndarray, cn: np.ndarray) -> np.ndarray:
    """All cosines of two blocks up to ERROR; NaN where that can't be said."""
    out = ratio(q @ c.T, qn[:, None] * cn)
    odd = lambda n: ~((n == 0) | (n > TINY) & (n < HUGE))
    out[odd(qn)] = np.nan
    out[:, odd(cn)] = np.nan
    return out


@np.errstate(all="ignore")
def scored(q: np.ndarray, c: np.ndarray, who: np.ndarray, at: np.ndarray, qn: np.ndarray, cn: np.ndarray) -> np.ndarray:
    parts = [ratio(dots(q[w], c[a]), qn[w] * cn[a]) for i in range(0, len(who), PAIRS) for w, a in [(who[i : i + PAIRS], at[i : i + PAIRS])]]
    return np.concatenate(parts) if parts else np.zeros(0)


def candidates(score: np.ndarray, k: int, floor: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores (NaN: unknown) that reach their row's floor and may be among its k best."""
    can = ~(score < (floor - margin - ERROR)[:, None])
    many = np.flatnonzero(can.sum(axis=1) > k)
    if len(many):
        kth = np.partition(score[many], score.shape[1] - k, axis=1)[:, score.shape[1] - k]  # NaN counts as the greatest
        can[many] &= ~(score[many] < (kth - margin - 2 * ERROR)[:, None])
    return np.nonzero(can)


def best(who: np.ndarray, ids: pa.Array, score: np.ndarray, k: int, margin: float, ties: str = "ascending") -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of each `who` what can be among its k best once scores are rounded by less than `margin`, ties to smaller ids (or greater ones, if descending); and everyone with the k-th score, if there is one."""
    nan = np.isnan(score)
    table = pa.table({"who": who, "known": ~nan, "score": np.where(nan, 0.0, score), "id": ids})
    order = pc.sort_indices(table, sort_keys=[("who", "ascending"), ("known", "ascending"), ("score", "descending"), ("id", ties)], null_placement="at_start" if ties == "ascending" else "at_end")
    ids, order = ids.take(order), order.to_numpy()
    who, score, nan = who[order], score[order], nan[order]
    new = np.append(True, who[1:] != who[:-1])[: len(who)]
    other = (new | np.append(True, ~((score[1:] == score[:-1]) | nan[1:] & nan[:-1]))[: len(who)])
    at = np.arange(len(who))
    start = np.maximum.accumulate(np.where(new, at, 0))
    group = np.maximum.accumulate(np.where(other, at, 0))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(who)))
    kth = np.where(size >= k, score[np.minimum(first + k - 1, max(len(who) - 1, 0))], -np.inf) if len(who) else np.zeros(0)
    limit = np.repeat(kth, size)
    # of equal scores the first k ids are enough
    keep = (at - group < k) & ((at - start < k) | (score >= limit - margin))
    return who[keep], ids.filter(pa.array(keep)), score[keep], who[first], kth


def search(k: int, least: float, margin: float, ties: str = "ascending"):
    """(ids, dims, data, query_ids, query_dims, query_data) -> (query_id, chunk_id, score): of each query what can be among its k best at `least` or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out(raw: bytes) -> pa.RecordBatch:
            query_ids, _, _, _, (who, ids, score) = held.pop(raw)
            return pa.RecordBatch.from_arrays([query_ids.take(pa.array(who)), ids, pa.array(score)], names=["query_id", "chunk_id", "score"])

        for b in batches:
            last = None
            for i in range(b.num_rows):
                ids, dims, data, query_ids, query_dims, query_data = (x[i] for x in b.columns)
                d, e = dims.as_py(), query_dims.as_py()
                ids, raw, data = ids.values, repr(query_ids.values.to_pylist()).encode() + query_data.as_py(), data.as_py()
                if raw not in held:
                    if len(held) == HELD:
                        yield out(next(iter(held)))
                    q = np.frombuffer(query_data.as_py(), np.float64).reshape(len(query_ids.values), e)
                    none = np.zeros(0, np.int64), ids.slice(0, 0), np.zeros(0)
                    held[raw] = [query_ids.values, q, lengths(q), np.full(len(q), least), none]
                if last is None or last[0] != data:
                    c = np.frombuffer(data, np.float64).reshape(len(ids), d)
                    last = data, c, lengths(c)
                _, c, cn = last
                _, q, qn, floor, had = held[raw]
                # of vectors of two lengths only a zero norm says something
                close = cosines(q, c, qn, cn) if d == e else np.where(qn[:, None] * cn == 0, 0.0, -np.inf)
                who, at = candidates(close, k, floor, margin)
                if not len(who):
                    continue
                score = scored(q, c, who, at, qn, cn) if d == e else np.zeros(len(who))
                *kept, whose, kth = best(np.concatenate([had[0], who]), pa.concat_arrays([had[1], ids.take(pa.array(at))]), np.concatenate([had[2], score]), k, margin, ties)
                floor[whose] = np.fmax(floor[whose], kth)  # a NaN raises nothing
                held[raw][4] = tuple(kept)
        for raw in list(held):
            yield out(raw)

    return run
