"""Shared pieces of the training-data operators.

Texts reach Python as Arrow buffers and are worked on in blocks of a few
megabytes, so a worker's memory depends on the block (or on the longest single
document), never on the partition.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of vectorised work covers (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20

U64 = np.uint64
#: Odd multiplier of the polynomial fingerprints (arithmetic is modulo 2**64).
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's spark.checkpoint.dir; sets one of our own only where none is set and all is one machine (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, by which shards are counted."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def row_key(*cols: Column) -> Column:
    """A 64-bit key of a row's content. Repeated rows share it; it is never null."""
    return F.xxhash64(*cols)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown on demand and kept by the worker."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        for name, base in (("p", BASE), ("q", pow(BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (in place where it can)."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = BASE**i * fingerprint of data[i:j]."""
    p, _ = powers(len(data) + 1)
    h = np.empty(len(data) + 1, dtype=U64)
    h[0] = 0
    v = data.astype(U64)
    v += U64(1)
    v *= p[: len(data)]
    np.cumsum(v, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(len(h))
    out = h[end] - h[start]
    out *= q[start]
    return mix(out)


def text_blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows with about `limit` bytes; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words_of(data: np.ndarray, off: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block, and each document's first word (one more entry than documents)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~is_sep[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def separators(spec: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(spec)] = True
    return t


#: The separators of the contract's words, blank and tab to carriage return.
BLANKS = separators(bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]))
#: A-Z to a-z, every other byte as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose results are checkpointed now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for undirected edges (a, b) of longs; component is the smallest node reachable.

    Alternating large-star and small-star passes, each cut by a reliable
    checkpoint. A pass joins every edge to the minimum of its node's
    neighbourhood, an aggregate with map-side combine, so a node with a third
    of all edges is an ordinary skewed join that adaptive execution splits.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    cur = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    last = None
    for _ in range(rounds):
        release(spark)
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("m", "n").alias("m"))
        # large star: neighbours above the node hang on the neighbourhood's minimum
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the node and its neighbours below hang on their minimum
        low2 = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        down = large.join(low2, F.col("u") == F.col("n")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = down.union(low2.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
        row = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == (row["n"], row["h"]):
            break
        last = (row["n"], row["h"])
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
