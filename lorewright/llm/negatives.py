"""Hard-negative mining: rows of another label whose score lies just below that of a positive.

Vector-approximation file. Vectors are packed into blocks; in each block every dimension is
quantised into cells, and a vector is stored as its cells besides its exact components. For an
anchor, two small tables give the least and the largest product with each cell of each
dimension, so adding up looked-up values bounds all scores of a block from below and above.
Only rows whose bounds let them enter a window (the best of the anchor's own label; the best of
other labels inside a positive's score range) are scored exactly, and what has been found or is
certain from the bounds raises the limit for the rest.

Anchors come in blocks too; each pair of an anchor block and a group of vector blocks is one unit
of work of bounded size. The file is written once and read by both searches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, shuffle_partitions
from .topk import BLOCKS, HELD, large, merge, products, quantise, stored, whole

#: Vectors of a block, anchors of a block, and cells of a dimension.
VECTORS = 4096
ANCHORS = 2048
CELLS = 64
SCALE = 256
BLOCK = "ids binary, names array<string>, codes binary, exact binary, dims int, width int, cells binary, lows binary, highs binary"
ASKED = "anchor_keys binary, anchor_ids binary, anchor_names array<string>, anchor_codes binary, anchor_exact binary, anchor_dims int, anchor_width int, counts binary, positive_ids binary, positive_scores binary"


def cells_of(q: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors in vertical layout: each component's cell, and each cell's least and largest component."""
    dims, n = q.shape
    c = max(1, min(cells, n))
    edges = np.sort(q, axis=1)[:, np.arange(c) * n // c]
    cell, highs = np.zeros((dims, n), np.uint8), edges.copy()
    for d in range(dims):
        cell[d] = np.searchsorted(edges[d], q[d], side="right") - 1
        np.maximum.at(highs[d], cell[d], q[d])
    return cell, edges, highs


def bounds(q: np.ndarray, place: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score with each vector; place: (dimension, vector) -> index of its cell in the flattened tables."""
    up = (q >= 0)[:, None]
    least, most = np.where(up, lows, highs) * q[:, None], np.where(up, highs, lows) * q[:, None]
    return np.take(least, place).sum(axis=0), np.take(most, place).sum(axis=0)


class Vectors:
    """One block of the file, as a task works on it."""

    def __init__(self, row: dict, scale: int):
        self.ids, self.scale, self.width, dims = np.frombuffer(row["ids"], np.int64), scale, row["width"], row["dims"]
        self.names, codes = row["names"], np.frombuffer(row["codes"], np.int32)
        edge = np.searchsorted(codes, np.arange(len(self.names) + 1))
        self.span = {name: (int(edge[i]), int(edge[i + 1])) for i, name in enumerate(self.names)}
        self.exact = stored(row["exact"], self.width, dims).reshape(dims, len(self.ids))
        self.place = None
        if row["cells"]:
            cell = np.frombuffer(row["cells"], np.uint8).reshape(dims, len(self.ids))
            self.lows, self.highs = (np.frombuffer(row[x], np.float64).reshape(dims, -1) for x in ("lows", "highs"))
            self.place = cell.astype(np.int32) + (np.arange(dims, dtype=np.int32) * self.lows.shape[1])[:, None]

    def bounds(self, q: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        return bounds(q, self.place[:, at], self.lows, self.highs)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def possible(least: np.ndarray, most: np.ndarray, k: int, low: float, high: float, floor: float) -> np.ndarray:
    """Which rows can be among the k best scores in [low, high], `floor` being the k-th best known so far."""
    sure = least[(least >= low) & (most <= high)]
    limit = max(low, floor, _kth(sure, k))
    return (most >= limit) & (least <= high)


def vector_file(rows: DataFrame, *, scale: int = SCALE, vectors: int = VECTORS, cells: int = CELLS) -> DataFrame:
    """Blocks of rows (vec_id, label as text, q), see BLOCK; a block's rows stand in order of their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, q, width in gather(batches, vectors, scale):
            names, codes = np.unique(labels, return_inverse=True)
            order = np.argsort(codes, kind="stable")
            ids, codes, q = ids[order], codes[order].astype(np.int32), q[:, order]
            has = width < 16 and len(q) > 0
            file = [x.tobytes() for x in cells_of(q, cells)] if has else [b"", b"", b""]
            values = [ids.tobytes(), names.tolist(), codes.tobytes(), products(q, width), len(q), width, *file]
            kinds = [pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

    return rows.select("vec_id", "label", "q").mapInArrow(run, BLOCK)


def gather(batches: Iterator[pa.RecordBatch], most: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, labels, scaled components in vertical layout, width) of at most `most` rows (id, label, q) of one length and magnitude."""
    held: dict[tuple[int, int], list] = {}

    def out(key):
        ids, labels, q = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        q, width = whole(np.ascontiguousarray(q.T), scale, key[1])
        return ids, labels, q, width

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(object)
        lists = batch.column(2)
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        wide_ones = large(flat, sizes, scale)
        for d, wide in {*zip(sizes.tolist(), wide_ones.tolist(), strict=True)}:
            at = np.flatnonzero((sizes == d) & (wide_ones == wide))
            for part in np.array_split(at, -(-len(at) // most)):
                key = (d, wide)
                if key in held and sum(len(x[0]) for x in held[key]) + len(part) > most:
                    yield out(key)
                held.setdefault(key, []).append((ids[part], labels[part], flat[first[part][:, None] + np.arange(d)]))
    for key in list(held):
        yield out(key)


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE, block: int = VECTORS, anchors: int = ANCHORS, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are integer inner products of floor(scale * x). An anchor's positives are its
    `positives` best other rows of its label; for each, the `negatives` best rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score. Fewer where there are
    fewer; ties go to the smaller vec_id.

    Rows whose vec_id, label or vector is null, or that hold a null or non-finite component, take
    no part. Vectors meet only those of the same length. Neither a row nor another with its vec_id
    is its own partner; other repeated rows are listed each. Anchor rows that share a vec_id
    are asked each, repeats of one only once. Components of any finite size are scored exactly; a
    score beyond a long counts as the nearest long. Empty tables give no rows. Columns beyond
    vec_id, label and embedding are ignored.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    v = vectors.select("vec_id", F.col("label").cast("string").alias("label"), quantise(F.col("embedding"), scale).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    v = v.where("vec_id is not null and label is not null and q is not null")
    file = vector_file(v, scale=scale, vectors=block, cells=cells).checkpoint()  # read by both searches
    asked = v.where("_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "q").distinct().withColumn("key", F.monotonically_increasing_id()).checkpoint()
    n_asked, n_rows = asked.count(), v.count()
    n_blocks, n_units = max(1, -(-n_asked // anchors)), max(1, -(-n_rows // (block * BLOCKS)))
    parts = max(shuffle_partitions(vectors.sparkSession), min(n_blocks * n_units, 100_000))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    units = file.select(every(n_blocks).alias("block"), F.pmod(F.xxhash64("ids", "codes"), F.lit(n_units)).cast("int").alias("unit"), "*").repartition(parts, "block", "unit")

    def search(found: DataFrame, kind: str, score) -> DataFrame:
        b = found.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block")
        b = b.select("key", "anchor_id", "label", "q", "positive_ids", "positive_scores", "block").mapInArrow(_ask(2 * anchors, scale), ASKED + ", block int")
        b = b.select("*", every(n_units).alias("unit")).repartition(parts, "block", "unit")
        pairs = units.join(b, ["block", "unit"]).where("dims = anchor_dims").drop("block", "unit", "anchor_dims")
        return pairs.mapInArrow(_search(score, scale), kind)

    none = F.array().cast("array<long>")
    own = search(asked.withColumns({"positive_ids": none, "positive_scores": none}), "key long, nth int, found_id long, score long", _positives(positives))
    best = lambda df, by, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "found_id"))).where(F.col("rank") <= k)
    own = best(own, ["key"], positives).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "found_id", "score"))).alias("_p"))
    own = own.select("key", F.col("_p.found_id").alias("positive_ids"), F.col("_p.score").alias("positive_scores")).checkpoint()
    asked = asked.join(own, "key")
    other = best(search(asked, "key long, nth int, found_id long, score long", _negatives(negatives, low, high)), ["key", "nth"], negatives)
    out = other.join(asked.select("key", "anchor_id", "positive_ids", "positive_scores"), "key")
    return out.select("anchor_id", F.get("positive_ids", F.col("nth")).alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.get("positive_scores", F.col("nth")).alias("positive_score"), F.col("score").alias("negative_score"))


def _ask(most: int, scale: int):
    """Anchors to blocks, see ASKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rows by number, so that `gather` may part them by length and magnitude
            number = pa.array(np.arange(batch.num_rows), pa.int64())
            inner = pa.RecordBatch.from_arrays([number, batch.column(2), batch.column(3)], names=["id", "label", "q"])
            for at, labels, q, width in gather(iter([inner]), most, scale):
                take = lambda i: batch.column(i).take(pa.array(at))  # noqa: E731,B023
                names, codes = np.unique(labels, return_inverse=True)
                ids, scores = take(4), take(5)
                for b in np.unique(take(6).to_numpy()):
                    on = np.flatnonzero(take(6).to_numpy() == b)
                    sub = pa.array(on)
                    counts = ids.take(sub).value_lengths().to_numpy().astype(np.int32)
                    values = [take(0).take(sub).to_numpy().tobytes(), take(1).take(sub).to_numpy().tobytes(), names.tolist(), codes[on].astype(np.int32).tobytes(), products(q[:, on], width), len(q), width, counts.tobytes(), ids.take(sub).flatten().to_numpy().astype(np.int64).tobytes(), scores.take(sub).flatten().to_numpy().astype(np.int64).tobytes(), int(b)]
                    kinds = [pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in ASKED.split(", ")] + ["block"])

    return run


class Anchors:
    def __init__(self, row: dict):
        self.keys, self.ids = (np.frombuffer(row[x], np.int64) for x in ("anchor_keys", "anchor_ids"))
        self.labels = [row["anchor_names"][c] for c in np.frombuffer(row["anchor_codes"], np.int32)]
        self.width, self.exact = row["anchor_width"], stored(row["anchor_exact"], row["anchor_width"], row["dims"]).reshape(row["dims"], len(self.keys))
        ends = np.cumsum(np.frombuffer(row["counts"], np.int32))
        self.scores = [x.tolist() for x in np.split(np.frombuffer(row["positive_scores"], np.int64), ends[:-1])]
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _search(score, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Anchors] = {}

        def out(key: bytes) -> pa.RecordBatch:
            a = held.pop(key)
            rows = [(a.keys[j], p, ids, scores) for (j, p), (ids, scores) in a.best.items()]
            sizes = [len(r[2]) for r in rows]
            flat = lambda i, t: pa.array(np.concatenate([r[i] for r in rows]) if rows else [], t)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([int(r[0]) for r in rows], sizes).astype(np.int64)), pa.array(np.repeat([r[1] for r in rows], sizes).astype(np.int32)), flat(2, pa.int64()), flat(3, pa.int64())], names=["key", "nth", "found_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(c)[i].as_py() for c, n in enumerate(batch.schema.names)}
                key = row["anchor_keys"]
                if key not in held:
                    if len(held) == HELD:
                        yield out(next(iter(held)))
                    held[key] = Anchors(row)
                score(held[key], Vectors(row, scale), scale)
        for key in list(held):
            yield out(key)

    return run


def _keep(a: Anchors, j: int, p: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    if len(ids):
        nothing = np.zeros(0, np.int64)
        a.best[j, p] = merge(a.best.get((j, p), (nothing, nothing)), (ids, scores), k)


def _floor(a: Anchors, j: int, p: int, k: int) -> float:
    held = a.best.get((j, p))
    return float(held[1][-1]) if held and len(held[1]) == k else -np.inf


def exactly(a: Anchors, j: int, v: Vectors, at: np.ndarray) -> np.ndarray:
    """Scores of an anchor with the rows `at`, as longs."""
    if max(a.width, v.width) < 16:
        return (a.exact[:, j] @ v.exact[:, at]).astype(np.int64)
    top, own = (1 << 63) - 1, [int(x) for x in a.exact[:, j]]
    return np.array([max(-top - 1, min(top, sum(x * int(y) for x, y in zip(own, v.exact[:, i], strict=True)))) for i in at.tolist()], np.int64)


def _positives(k: int):
    """The best rows of each anchor's label."""

    def run(a: Anchors, v: Vectors, scale: int) -> None:
        for j, label in enumerate(a.labels):
            s, e = v.span.get(label, (0, 0))
            at = s + np.flatnonzero(v.ids[s:e] != a.ids[j])
            if not len(at):
                continue
            if v.place is not None and a.width < 16:
                least, most = (x[at - s] for x in v.bounds(a.exact[:, j], slice(s, e)))
                at = at[possible(least, most, k, -np.inf, np.inf, _floor(a, j, 0, k))]
            _keep(a, j, 0, v.ids[at], exactly(a, j, v, at), k)

    return run


def _negatives(k: int, low: int, high: int):
    """For each positive of an anchor, the best rows of other labels in its score range."""

    def run(a: Anchors, v: Vectors, scale: int) -> None:
        for j, label in enumerate(a.labels):
            s, e = v.span.get(label, (0, 0))
            other = v.ids != a.ids[j]
            other[s:e] = False
            ranges = [(p, -(-low * x // 100), high * x // 100) for p, x in enumerate(a.scores[j])]
            ranges = [r for r in ranges if r[1] <= r[2]]
            at = np.flatnonzero(other)
            if not len(at) or not ranges:
                continue
            if v.place is not None and a.width < 16:
                least, most = (x[at] for x in v.bounds(a.exact[:, j], slice(None)))
                some = np.zeros(len(at), dtype=bool)
                for p, lo, hi in ranges:
                    some |= possible(least, most, k, lo, hi, _floor(a, j, p, k))
                at = at[some]
            scores, ids = exactly(a, j, v, at), v.ids[at]
            for p, lo, hi in ranges:
                # compared as long as Python's numbers where a limit passes a long
                inside = (scores >= max(lo, -(1 << 63))) & (scores <= min(hi, (1 << 63) - 1)) if lo < 1 << 63 and hi >= -(1 << 63) else np.zeros(len(scores), dtype=bool)
                _keep(a, j, p, ids[inside], scores[inside], k)

    return run
