"""A partitioned vector index: k-means cells, residual codes, probed or exact search by cosine.

Vectors are scaled to length 1 and put into the cell with the nearest centre. A cell is stored
in blocks of bounded size; a block holds the vectors themselves and, beside them, the residuals
(vector less centre) in one byte a dimension, each with the length of what the byte leaves out.
A search meets the codes of its cells first: code and error bound every cosine from both sides,
so only rows that can be among the k best are read in full and scored.

Probed search looks into the cells whose centres are nearest to the query. Exact search goes on
from there: a cell with centre c and radius r can hold no cosine above q.c + r, so cells whose
bound stays below the k-th best score are left out and all others are searched as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions.text import cosine
from lorewright.operators.lineage import cut
from lorewright.operators.retrieval import top_k

#: Vectors of a block, on average; centres are at most MAX_CELLS and at most CENTRE_BYTES together, so the driver and every task can hold them.
BLOCK = 1024
MAX_CELLS = 16_384
CENTRE_BYTES = 64 << 20
#: The centres are fitted on at most so many vectors for each cell, the first in a hash order of their ids, dealt to so many tasks.
FIT_PER_CELL, FIT_TASKS = 256, 256
ROUNDS = 10
#: Queries that meet a block at a time.
QUERIES = 1024


#: Probed searches look into so many cells that rows of the index, at most TRIALS of them, find this share of their TRIAL_K nearest others.
RECALL, TRIALS, TRIAL_K = 0.98, 200, 10


@dataclass
class Cells:
    """A stored index: its folder, its centres with their radii, how many cells a probed search looks into, and the type of its ids."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    radii: np.ndarray
    n_probes: int
    kind: str

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1."""
    n = len(lists)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there, finite and not all zeros: others have no cosine."""
    v = F.col(column)
    return vectors.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0))


def fit(vectors: DataFrame, n_cells: int, *, rounds: int = ROUNDS, per_cell: int = FIT_PER_CELL) -> np.ndarray:
    """Centres by Lloyd's rounds over a bounded sample; sums are folded by each task and then by cell, and only the centres come to the driver."""
    spark = vectors.sparkSession
    n = vectors.count()
    order = F.xxhash64("chunk_id")
    share = min(1.0, per_cell * n_cells / max(n, 1))
    sample = vectors if share == 1 else vectors.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = cut(sample.select("chunk_id", "embedding").repartition(min(FIT_TASKS, max(1, n // 2048)), "chunk_id"))
    first = sample.groupBy("embedding").agg(F.min(order).alias("o")).orderBy("o", F.col("embedding").cast("string")).limit(n_cells).select("embedding")
    centres = _matrix(pa.array([r[0] for r in first.collect()], pa.list_(pa.float64())))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centres)

        def fold(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            c = held.value
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                x = _matrix(b.column(0))
                cell = np.argmax(x @ c.T, axis=1)
                np.add.at(total, cell, x)
                count += np.bincount(cell, minlength=len(c))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["cell", "total"])

        def add(t: pa.Table) -> pa.Table:
            total = np.array(t.column("total").to_pylist()).sum(axis=0)
            return pa.table({"cell": t.column("cell").slice(0, 1), "total": pa.array([total], pa.list_(pa.float64()))})

        kind = "cell int, total array<double>"
        sums = sample.select("embedding").mapInArrow(fold, kind).groupBy("cell").applyInArrow(add, kind).collect()
        new = centres.copy()
        for r in sums:
            new[r["cell"]] = r["total"]
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-300)
        held.unpersist()
        moved = float(np.abs(new - centres).max(initial=0))
        centres = new
        if moved < 1e-6:
            break
    return centres


def build(vectors: DataFrame, path: str, *, n_cells: int | None = None, block: int = BLOCK, rounds: int = ROUNDS) -> Cells:
    """Indexes every usable row of (chunk_id, embedding), all of one length, below `path`. n_cells: about the square root of the rows where it is not given.

    Repeated rows stay; an empty table gives an index without cells, which finds nothing.
    """
    spark = vectors.sparkSession
    v = usable(vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).where("chunk_id is not null"))
    size = v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("most"), F.min(F.size("embedding")).alias("least")).first()
    if size["most"] != size["least"]:
        raise ValueError(f"vectors of {size['least']} to {size['most']} dimensions in one index")
    dims = size["most"] or 1
    wanted = n_cells or int(size["n"] ** 0.5) or 1
    centres = fit(v, max(1, min(wanted, MAX_CELLS, CENTRE_BYTES // (8 * dims))), rounds=rounds) if size["n"] else np.zeros((0, dims))
    held = spark.sparkContext.broadcast(centres)
    kind = dict(vectors.dtypes)["chunk_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.argmax(_matrix(b.column(1)) @ held.value.T, axis=1).astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["chunk_id", "embedding", "cell"])

    placed = v.mapInArrow(place, f"chunk_id {kind}, embedding array<double>, cell int")
    placed = cut(placed.withColumn("embedding", F.col("embedding").cast(dict(vectors.dtypes)["embedding"])))
    # one row a cell, and no more than MAX_CELLS
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")

    def code(t: pa.Table) -> pa.Table:
        c = held.value[t.column("cell")[0].as_py()]
        rest = _matrix(t.column("embedding").combine_chunks()) - c
        step = max(float(np.abs(rest).max(initial=0)) / 127, 1e-300)
        codes = np.rint(rest / step).astype(np.int8)
        error = np.linalg.norm(rest - codes * step, axis=1) + 1e-12
        values = {"n": len(rest), "radius": float(np.linalg.norm(rest, axis=1).max()) + 1e-12, "step": step, "codes": codes.tobytes(), "errors": error.tobytes()}
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table({"cell": t.column("cell").slice(0, 1), "block": t.column("block").slice(0, 1), **{k: [x] for k, x in values.items()}, "ids": lists(t.column("chunk_id").combine_chunks()), "vectors": lists(t.column("embedding").combine_chunks())})

    stored = f"cell int, block int, n long, radius double, step double, codes binary, errors binary, ids array<{kind}>, vectors array<{dict(vectors.dtypes)['embedding']}>"
    dealt.groupBy("cell", "block").applyInArrow(code, stored).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    blocks = spark.read.schema(stored).parquet(f"{path}/blocks")
    radii = {r["cell"]: r["radius"] for r in blocks.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}  # one row a cell
    rows = [(i, c.tolist(), radii.get(i)) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    n = calibrated(v, _read(spark, path, len(rows), kind)) if rows else 0
    spark.createDataFrame([(n, kind)], "n_probes int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    return load(spark, path)


def _read(spark: SparkSession, path: str, n_probes: int, kind: str) -> Cells:
    rows = sorted(spark.read.parquet(f"{path}/centres").collect())
    return Cells(spark, path, np.array([r["centre"] for r in rows]), np.array([-np.inf if r["radius"] is None else r["radius"] for r in rows]), n_probes, kind)


def load(spark: SparkSession, path: str) -> Cells:
    return _read(spark, path, *spark.read.parquet(f"{path}/settings").select("n_probes", "kind").first())


def calibrated(vectors: DataFrame, index: Cells, recall: float = RECALL) -> int:
    """The number of nearest cells in which a bounded set of rows, the first in a hash order, find the share `recall` of their nearest others."""
    trials = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(TRIALS).select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    q = cut(trials.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector")))
    hits = search(q, index, TRIAL_K + 1, -2.0, n_probes=1, exact=True).where("query_id != chunk_id")
    where = index.blocks().select("cell", F.explode("ids").alias("chunk_id"))
    found = where.join(hits, "chunk_id").select("query_id", "cell").collect()  # TRIALS * TRIAL_K rows, but for repeated ids
    q_of = {r["query_id"]: r["query_vector"] for r in q.collect()}
    near = {k: np.argsort(np.argsort(-(np.asarray(x, np.float64) @ index.centres.T), kind="stable"), kind="stable") for k, x in q_of.items()}
    at = np.sort([near[r["query_id"]][r["cell"]] for r in found])
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else 1


def probes(queries: DataFrame, index: Cells, n: int | None, limits: DataFrame | None = None, skip: int = 0) -> DataFrame:
    """(query_id, query_vector, cell): each query's n cells with the nearest centres; or, with `limits` (query_id, limit), all after the first `skip` whose bound reaches the limit."""
    held = index.spark.sparkContext.broadcast((index.centres, index.radii))
    kind, limited = dict(queries.dtypes), limits is not None
    q = queries.select("query_id", "query_vector") if not limited else queries.join(limits, "query_id").select("query_id", "query_vector", "limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = held.value
        for b in batches:
            for i in range(0, b.num_rows, QUERIES):
                part = b.slice(i, QUERIES)
                near = _matrix(part.column(1)) @ centres.T
                order = np.argsort(-near, axis=1, kind="stable")
                if not limited:
                    take = np.zeros(near.shape, dtype=bool)
                    np.put_along_axis(take, order[:, :n], True, axis=1)
                else:
                    take = near + radii >= part.column(2).to_numpy(zero_copy_only=False)[:, None] - 1e-9
                    np.put_along_axis(take, order[:, :skip], False, axis=1)
                take &= np.isfinite(radii)
                row, cell = np.nonzero(take)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(cell.astype(np.int32))], names=["query_id", "query_vector", "cell"])

    return q.mapInArrow(run, f"query_id {kind['query_id']}, query_vector {kind['query_vector']}, cell int")


def look(asked: DataFrame, index: Cells, k: int, threshold: float, digits: int | None) -> DataFrame:
    """(query_id, chunk_id, score) of the rows of the asked cells (query_id, query_vector, cell) that can be among a query's k best."""
    kind = dict(asked.dtypes)
    held = index.spark.sparkContext.broadcast(index.centres)
    margin = 1e-9 if digits is None else 10.0**-digits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(2).to_numpy()
            for c in np.unique(cells):
                at = np.flatnonzero(cells == c)
                for i in range(0, len(at), QUERIES):
                    sub = pa.array(at[i : i + QUERIES])
                    ids = b.column(0).take(sub)
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([_matrix(b.column(1).take(sub)).tobytes()])], names=["cell", "query_ids", "q"])

    packed = asked.repartition("cell").mapInArrow(pack, f"cell int, query_ids array<{kind['query_id']}>, q binary")
    heads = index.blocks().select("cell", "block", "n", "step", "codes", "errors")
    pairs = heads.join(packed, "cell").select("cell", "block", "n", "step", "codes", "errors", "query_ids", "q")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cell, block, n, step, codes, errors, ids, q = (b.column(c)[i] for c in range(8))
                centre = held.value[cell.as_py()]
                m = np.frombuffer(q.as_py(), np.float64).reshape(-1, len(centre))
                rest = np.frombuffer(codes.as_py(), np.int8).reshape(n.as_py(), -1).astype(np.float64) * step.as_py()
                about = m @ centre
                error = np.frombuffer(errors.as_py(), np.float64)
                score = m @ rest.T + about[:, None]
                low, high = score - error, score + error
                limit = np.partition(low, low.shape[1] - k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
                row, at = np.nonzero(high >= np.maximum(limit - margin, threshold - margin)[:, None])
                yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(row)), pa.array(np.full(len(row), cell.as_py(), np.int32)), pa.array(np.full(len(row), block.as_py(), np.int32)), pa.array(at.astype(np.int32)), pa.array(low[row, at]), pa.array(high[row, at])], names=["query_id", "cell", "block", "at", "low", "high"])

    near = cut(pairs.mapInArrow(bound, f"query_id {kind['query_id']}, cell int, block int, at int, low double, high double"))
    kth = top_k(near.select("query_id", "cell", "block", "at", "low"), k, score="low", tie="at").groupBy("query_id").agg(F.min("low").alias("limit"), F.count("*").alias("_k")).where(F.col("_k") >= k)
    can = near.join(kth, "query_id", "left").where(F.col("limit").isNull() | (F.col("high") >= F.col("limit") - margin)).select("query_id", "cell", "block", "at")
    full = index.blocks().select("cell", "block", "ids", "vectors").join(can.groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "at")).alias("asked")), ["cell", "block"])
    rows = full.select("ids", "vectors", F.inline("asked")).select("query_id", F.get("ids", F.col("at")).alias("chunk_id"), F.get("vectors", F.col("at")).alias("embedding"))
    score = cosine(F.col("query_vector"), F.col("embedding"))
    rows = rows.join(asked.select("query_id", "query_vector").dropDuplicates(["query_id"]), "query_id")
    return rows.select("query_id", "chunk_id", (F.round(score, digits) if digits is not None else score).alias("score")).where(F.col("score") >= threshold)


def search(queries: DataFrame, index: Cells, k: int = 10, threshold: float = 0.5, *, n_probes: int | None = None, exact: bool = False, digits: int | None = None) -> DataFrame:
    """As `retrieval.vector_search`, on an index: (query_id, query_vector) -> the k most similar rows at or above the threshold.

    Probed: of the n_probes nearest cells (as calibrated, where none are given). Exact: of all.
    query_id must be unique; queries without a usable vector find nothing, and no row without one
    is found, whatever the threshold.
    """
    n_probes = n_probes or (1 if exact else index.n_probes)
    q = cut(usable(queries.select("query_id", "query_vector"), "query_vector"))
    if not len(index.centres):
        return top_k(q.select("query_id", F.lit(None).cast(index.kind).alias("chunk_id"), F.lit(0.0).alias("score")).where("false"), k)
    hits = look(cut(probes(q, index, n_probes)), index, k, threshold, digits)
    if exact:
        hits = cut(top_k(hits, k).drop("rank"))
        kth = hits.groupBy("query_id").agg(F.min("score").alias("limit"), F.count("*").alias("_k"))
        limits = q.select("query_id").join(kth, "query_id", "left").select("query_id", F.greatest(F.lit(float(threshold)), F.when(F.col("_k") >= k, F.col("limit")).otherwise(-2.0)).alias("limit"))
        limits = limits.withColumn("limit", F.col("limit") - (1e-9 if digits is None else 10.0**-digits))
        hits = hits.unionByName(look(cut(probes(q, index, None, limits, n_probes)), index, k, threshold, digits))
    return top_k(hits, k)
