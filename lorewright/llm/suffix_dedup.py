"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

A *run* is a maximal stretch of window starts in one document whose windows (strings
of `length` bytes) share their seed, the smallest fingerprint among the windows'
`seed`-byte strings. Equal windows have equal seeds, so it is enough to compare runs
with one seed. Runs are the sampled suffixes: about two in a hundred positions.

Each task sends its runs in flushes to the shards of the seed space. A shard gathers them
to batches of a `Levels` family: a new batch is sorted by seed and
content into a suffix array and merge-scanned against every level for equal suffixes,
both sides are marked, and levels of equal size are merged, as in a binary counter. The order of suffixes is that of their fingerprints and not of their
bytes: only equality to the full depth counts here, and it spares the byte order.

A run whose whole content occurs elsewhere is repeated entirely. Where only the seed
occurs elsewhere (at the borders of repeated passages), a second, dense family decides
window by window. Copies of one run beyond the second in a batch, and contexts of one
seed beyond `CONTEXTS`, are already known to repeat: they are marked where they are
found and dealt out evenly, so a passage in a third of all documents fills no shard.

Fingerprints have 64 bits; equal fingerprints are taken as equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, prefix_hash, release, row_key, shuffle_partitions, span_hash, text_blocks, text_bytes

LENGTH = 200
SEED = 100
#: Entries that a map task holds before it sends its arrays.
FLUSH = 300_000
#: Contexts of one seed that a batch sends to the seed's own shard.
CONTEXTS = 64
#: Entries that a shard gathers from flushes before they become a batch of its family: the more text, the smaller a shard's part of a flush.
BATCH = 1 << 16
#: Bytes of text whose runs make a shard of the fingerprint space, and the least number of shards.
SHARD_TEXT = 6 << 20
SHARDS = 96

WHOLE, BORDER, SENT = 1, 2, 4  # content occurs elsewhere; seed occurs elsewhere with other content; takes no part in scans


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, U64)
    rows = -(-len(g) // w)
    pad = np.full(rows * w, np.iinfo(np.uint64).max, dtype=U64)
    pad[: len(g)] = g
    pad = pad.reshape(rows, w)
    before = np.minimum.accumulate(pad, axis=1).ravel()
    after = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """(seed value, content fingerprint, document, first window, windows, flag) of all runs of a block; starts count from the document's.

    The flag is BORDER where the seed stands more than once in the run, as then its own windows may repeat each other.
    """
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z.astype(U64), z, z, z, z.astype(np.uint8)
    h = prefix_hash(data)
    at = np.arange(n - seed + 1)
    w = length - seed + 1
    g = span_hash(h, at, at + seed)
    low = sliding_min(g, w)
    valid = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(off) >= length)
    valid[off[long]] += 1
    valid[off[long + 1] - length + 1] -= 1
    ok = np.cumsum(valid[: len(low)], dtype=np.int8) > 0
    new = np.empty(len(low), dtype=bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(low)))
    keep = ok[first]
    first, size = first[keep], size[keep]
    content = span_hash(h, first, first + size - 1 + length)
    doc = np.searchsorted(off, first, side="right") - 1
    # positions that are the minimum of some window: g equals the largest of the minima of the windows around it
    most = np.iinfo(np.uint64).max
    padded = np.concatenate([np.full(w - 1, most, U64), ~low, np.full(w - 1, most, U64)])
    spots = np.flatnonzero(g == ~sliding_min(padded, w))
    twice = (g[spots[1:]] == g[spots[:-1]]) & (np.diff(spots) <= w)  # w apart, they are the minima of neighbouring windows
    upto = np.append(0, np.cumsum(twice))  # pairs of equal neighbours before each spot
    lo = np.searchsorted(spots, first)
    hi = np.searchsorted(spots, first + size - 1 + w) - 1
    flag = np.where((hi > lo) & (upto[np.maximum(hi, 0)] > upto[np.minimum(lo, len(upto) - 1)]), BORDER, 0).astype(np.uint8)
    return low[first], content, doc, first - off[doc], size, flag


class Levels:
    """Suffix arrays whose sizes grow geometrically; entries are (k, c, key, at, n, flag), in the order of (k, c)."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, batch: list[np.ndarray]) -> None:
        """Sort a batch, mark what it repeats of itself and of every level (and there), then restore geometric sizes."""
        batch = [a[np.lexsort((batch[1], batch[0]))] for a in batch]
        mark_within(batch)
        for level in self.levels:
            mark_between(level, batch)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.lexsort((both[1], both[0]))  # stable: the older entry of equals comes first
            self.levels.append([x[order] for x in both])


def bounds(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)


def mark_within(e: list[np.ndarray]) -> None:
    k, c, flag = e[0], e[1], e[5]
    live = np.flatnonzero((flag & SENT) == 0)
    k, c = k[live], c[live]
    if len(k) < 2:
        return
    same_k = k[1:] == k[:-1]
    same = same_k & (c[1:] == c[:-1])
    whole = np.zeros(len(k), bool)
    whole[1:] |= same
    whole[:-1] |= same
    first = bounds(k)
    size = np.diff(np.append(first, len(k)))
    last = first + size - 1
    mixed = np.repeat(c[first] != c[last], size)
    later = np.append(False, same)  # an equal entry stands before it
    add = np.where(whole, WHOLE, 0) | np.where(mixed, BORDER, 0) | np.where(later, SENT, 0)
    flag[live] |= add.astype(flag.dtype)


def mark_between(a: list[np.ndarray], b: list[np.ndarray]) -> None:
    """Merge-scan of an older and a newer array; of equal entries, the older one stays in the scans."""
    la, lb = np.flatnonzero((a[5] & SENT) == 0), np.flatnonzero((b[5] & SENT) == 0)
    if not len(la) or not len(lb):
        return
    ka, ca, kb, cb = a[0][la], a[1][la], b[0][lb], b[1][lb]
    fa, fb = bounds(ka), bounds(kb)
    common, ia, ib = np.intersect1d(ka[fa], kb[fb], assume_unique=True, return_indices=True)
    if not len(common):
        return
    ends_a, ends_b = np.append(fa[1:], len(ka)), np.append(fb[1:], len(kb))
    span = lambda f, e, i: (f[i], e[i], np.repeat(np.arange(len(i)), e[i] - f[i]))
    (sa, ea, ga), (sb, eb, gb) = span(fa, ends_a, ia), span(fb, ends_b, ib)
    rows = lambda s, e: np.repeat(s - np.append(0, np.cumsum(e - s)[:-1]), e - s) + np.arange(int((e - s).sum()))
    ra, rb = rows(sa, ea), rows(sb, eb)
    add_a = np.where((cb[sb][ga] != ca[ra]) | (cb[eb - 1][ga] != ca[ra]), BORDER, 0)
    add_b = np.where((ca[sa][gb] != cb[rb]) | (ca[ea - 1][gb] != cb[rb]), BORDER, 0)
    pair = lambda g, c: np.rec.fromarrays([g, c], names="g,c")
    pa_, pb_ = pair(ga, ca[ra]), pair(gb, cb[rb])
    add_a |= np.where(np.isin(pa_, pb_), WHOLE, 0)
    add_b |= np.where(np.isin(pb_, pa_), WHOLE | SENT, 0)
    a[5][la[ra]] |= add_a.astype(np.uint8)
    b[5][lb[rb]] |= add_b.astype(np.uint8)


# -- transport: one row per shard and flush, the arrays end to end

_TYPES = (U64, U64, np.int64, np.int32, np.int32, np.uint8)


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: small and repeated values shrink when the shuffle compresses them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def pack(entries: list[np.ndarray], shard: np.ndarray) -> pa.RecordBatch:
    """One row per shard; inside, entries stand by document and place, and only the receiver sorts them by suffix."""
    order = np.lexsort((entries[3], entries[2], shard))
    shard = shard[order]
    entries = [a[order].astype(t) for a, t in zip(entries, _TYPES, strict=True)]
    first = bounds(shard)
    last = np.append(first[1:], len(shard))
    blobs = [b"".join(planes(a[i:j]) for a in entries) for i, j in zip(first, last, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int32()), pa.array((last - first).astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "n", "blob"])


def unpack(n: int, blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for t in _TYPES:
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, count=n * width, offset=at).reshape(width, n).T).view(t).ravel())
        at += n * width
    return out


def deal(entries: list[np.ndarray], n_shards: int) -> pa.RecordBatch:
    """Entries with their shards. What a batch alone shows to repeat is marked here and dealt out by content or document."""
    order = np.lexsort((entries[1], entries[0]))
    k, c, key, at, n, flag = (a[order] for a in entries)
    size = len(k)
    idx = np.arange(size)
    new_k = np.append(True, k[1:] != k[:-1])
    new_c = new_k | np.append(True, c[1:] != c[:-1])
    start_c = np.maximum.accumulate(np.where(new_c, idx, 0))
    start_k = np.maximum.accumulate(np.where(new_k, idx, 0))
    nth_context = np.cumsum(new_c) - np.cumsum(new_c)[start_k]
    copy = idx - start_c
    shard = ((k >> U64(24)) % U64(n_shards)).astype(np.int32)
    spare = copy >= 2  # two copies are enough to mark the others of this content
    flag = flag | np.where(spare, WHOLE | SENT, 0).astype(np.uint8)
    shard = np.where(spare, ((key.astype(U64) >> U64(7)) % U64(n_shards)).astype(np.int32), shard)
    many = ~spare & (nth_context >= CONTEXTS)
    flag = flag | np.where(many, BORDER, 0).astype(np.uint8)
    shard = np.where(many, (c % U64(n_shards)).astype(np.int32), shard)
    return pack([k, c, key, at, n, flag], shard)


class Sender:
    """Collects entries of a task and hands them over in flushes."""

    def __init__(self, n_shards: int):
        self.n_shards, self.held, self.size = n_shards, [], 0

    def add(self, entries: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append(entries)
        self.size += len(entries[0])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield deal([np.concatenate(x) for x in zip(*self.held, strict=True)], self.n_shards)
        self.held, self.size = [], 0


_SHARDS = "shard int, n int, blob binary"


def send_runs(n_shards: int, length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(n_shards)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, off in text_blocks(batch.column(1)):
                k, c, doc, at, n, flag = runs(data, off, length, seed)
                k &= ~U64(0xFFFFFF)  # the seed only proposes; five of its bytes do
                yield from out.add([k, c, keys[i + doc], at, n, flag])
        yield from out.flush()

    return run


def send_windows(n_shards: int, length: int):
    """Each window of the border runs, by its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(n_shards)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            row, (at, n, flag) = lists(batch.column(3))
            border = (flag & BORDER) > 0
            row, at, n = row[border], at[border], n[border]
            for i, j, data, off in text_blocks(batch.column(2)):
                mine = (row >= i) & (row < j)
                r, a, m = row[mine], at[mine], n[mine]
                if not len(r):
                    continue
                h = prefix_hash(data)
                step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                a, r = np.repeat(a, m) + step, np.repeat(r, m)
                # runs of repeated rows and of both marks come twice; a window of a row counts once
                spot = np.unique(off[r - i] + a)
                doc = np.searchsorted(off, spot, side="right") - 1
                w = span_hash(h, spot, spot + length)
                yield from out.add([w, np.zeros(len(w), U64), keys[i + doc], spot - off[doc], np.ones(len(w), np.int32), np.zeros(len(w), np.uint8)])
        yield from out.flush()

    return run


#: A marked run or window of a document on its way back to it.
SPAN = np.dtype([("at", "<i4"), ("n", "<i4"), ("mark", "u1")])


def lists(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row, at, n and mark of all spans of a list<binary> column; a null list is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    blobs = col.flatten()
    if not len(blobs):
        return np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3
    _, offsets, data = blobs.buffers()
    off = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    spans = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(SPAN)
    row = np.repeat(np.repeat(np.arange(len(col)), size), np.diff(off) // SPAN.itemsize)
    return row, [spans[f].astype(np.int64) for f in ("at", "n", "mark")]


def scan_shards():
    """Runs the family of each shard over its arrays; gives the marked entries, those of a document in one row."""

    def done(levels: Levels) -> Iterator[pa.RecordBatch]:
        if levels.levels:
            key, at, n, flag = (np.concatenate([level[i] for level in levels.levels]) for i in (2, 3, 4, 5))
            # of equal contents one (not SENT) goes into the dense scan; the others follow as WHOLE
            mark = (flag & WHOLE) | np.where((flag & SENT) == 0, flag & BORDER, 0).astype(np.uint8)
            keep = np.flatnonzero(mark > 0)
            keep = keep[np.lexsort((at[keep], key[keep]))]
            # repeated rows have one key: their runs become one
            new = np.append(True, (at[keep][1:] != at[keep][:-1]) | (key[keep][1:] != key[keep][:-1])) if len(keep) else np.zeros(0, bool)
            mark[keep[new]] = np.bitwise_or.reduceat(mark[keep], np.flatnonzero(new)) if len(keep) else 0
            keep = keep[new]
            spans = np.empty(len(keep), SPAN)
            spans["at"], spans["n"], spans["mark"] = at[keep], n[keep], mark[keep]
            first = bounds(key[keep])
            last = np.append(first[1:], len(keep)).astype(np.int64)
            border = np.add.reduceat((mark[keep] & BORDER) > 0, first) > 0 if len(first) else np.zeros(0, bool)
            for i in range(0, len(first), 50_000):
                f, e = first[i : i + 50_000], last[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[keep][f]), pa.array(border[i : i + 50_000]), pa.array([spans[x:y].tobytes() for x, y in zip(f, e, strict=True)], pa.binary())], names=["key", "border", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, current, held, size = Levels(), None, [], 0

        def add() -> None:
            nonlocal held, size
            if held:
                levels.add([np.concatenate(x) for x in zip(*held, strict=True)])
            held, size = [], 0

        for batch in batches:
            for shard, n, blob in zip(*batch.columns, strict=True):
                if shard.as_py() != current:
                    add()
                    yield from done(levels)
                    levels, current = Levels(), shard.as_py()
                held.append(unpack(n.as_py(), blob.as_py()))
                size += n.as_py()
                if size >= BATCH:
                    add()
        add()
        yield from done(levels)

    return run


def repeated(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(key, text, whole, dense): per document the runs and single windows that occur elsewhere, as lists of packed spans; and (copied) its key where its row is repeated, as then all its windows are."""
    parts = shuffle_partitions(docs.sparkSession)
    n_shards = max(parts, SHARDS, -(-text_bytes(docs) // SHARD_TEXT))
    # rows that repeat whole repeat all their windows: for them, only what others may border on has to come back
    copies = docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("copied")).checkpoint()
    marked = "key long, border boolean, spans binary"

    def family(sent: DataFrame) -> DataFrame:
        found = sent.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(scan_shards(), marked).join(copies, F.col("key") == F.col("copied"), "left").where("copied is null OR border")
        return found.groupBy("key").agg(F.max("border").alias("border"), F.collect_list("spans").alias("spans"))

    whole = family(docs.select("key", "text").mapInArrow(send_runs(n_shards, length, seed), _SHARDS)).checkpoint()
    release(docs.sparkSession)
    border = whole.where("border")
    # both joins take the same columns of the documents, so that texts are shuffled once
    dense = family(docs.join(border, "key").select("key", "doc_id", "text", "spans").mapInArrow(send_windows(n_shards, length), _SHARDS))
    out = docs.join(whole.select("key", F.col("spans").alias("whole")), "key", "left").join(copies, F.col("key") == F.col("copied"), "left")
    return out.join(dense.select("key", F.col("spans").alias("dense")), "key", "left")


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, seed: int | None = None, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with `with_text` the kept bytes).

    Every byte is removed that a string of `length` bytes covers which also starts
    anywhere else, in the same document or another; overlapping starts count, and strings
    are judged on the input. n_spans counts maximal removed runs.

    A null text is empty: 0 bytes, nothing removed. Repeated rows are documents of their
    own, so each loses everything if it has `length` bytes or more. A null doc_id is an id like any
    other. An empty table gives no rows; columns beyond doc_id and text are ignored.
    """
    from .common import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    seed = seed or max(1, length // 2)
    base = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, copied = [lists(batch.column(2)), lists(batch.column(3))], batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            rows: list[list] = [[], [], [], [], []]
            for i, j, data, off in text_blocks(batch.column(1)):
                change = np.zeros(len(data) + 1, np.int32)
                for (row, (at, n, mark)) in found:
                    mine = (row >= i) & (row < j) & ((mark & WHOLE) > 0)
                    start = off[row[mine] - i] + at[mine]
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n[mine] - 1 + length, -1)
                for r in np.flatnonzero(copied[i:j]).tolist():
                    if off[r + 1] - off[r] >= length:
                        change[off[r]] += 1
                        change[off[r + 1]] -= 1
                gone = np.cumsum(change[:-1]) > 0
                for a, b in zip(off[:-1], off[1:], strict=True):
                    g = gone[a:b]
                    removed = int(g.sum())
                    kept = (data[a:b][~g] if removed else data[a:b]).tobytes()
                    rows[0].append(int(b - a))
                    rows[1].append(removed)
                    rows[2].append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0)
                    rows[3].append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        rows[4].append(kept)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.string()), *([pa.array(rows[4], pa.binary())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return repeated(base, length, seed).select("doc_id", "text", "whole", "dense", "copied").mapInArrow(run, schema)
