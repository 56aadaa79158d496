"""Near-duplicate groups by min-max hashing.

Each document's set of word shingles is hashed under a number of permutations, of
which both the minimum and the maximum are kept: two signature values for one hash
evaluation, each equal for two sets with a probability that is their Jaccard
similarity. Bands of values propose candidates; links are confirmed on full sets.

Documents with one set form a class, whose rows are folded before anything is
shuffled by band. Classes that share a band value are tied to the value's smallest
class (never pair by pair); the components of those ties are the units of
confirmation. A unit is cut into blocks of bounded size, and each pair of blocks is one
task, so a group with a third of all documents is many tasks. Inside a task a bucket's
best connected member is compared first; what it links is one component, and only
members of still different components are compared further, so a tight group costs one
pass, while no link that would join two components is left out. A member is compared
once, with all sets of the task, whatever number of buckets it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, U64, connected_components, ensure_checkpoint_dir, mix, prefix_hash, release, row_key, shuffle_partitions, span_hash, text_blocks, words_of

#: Words of a shingle; percent of similarity that links.
SHINGLE = 5
SIMILARITY = 80
#: Values of a band and bands; a pair at 85 % is missed with a probability of 7e-9, at 80 % of 3e-6.
ROWS = 5
BANDS = 32
#: Sets and bytes of sets of one block of a unit.
BLOCK_SETS = 4096
BLOCK_BYTES = 24 << 20
#: Bytes of a task's matrix of frequent elements; sets that are compared with all others of a task at once.
DENSE_BYTES = 64 << 20
ROWS_AT_ONCE = 64

_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, size=(2, ROWS * BANDS // 2), dtype=np.uint64)
_FACTORS = np.random.default_rng(20240608).integers(1, 1 << 63, size=ROWS + BANDS, dtype=np.uint64) | U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each document of a block."""
    data = LOWER[data]
    starts, ends, first = words_of(data, off, BLANKS)
    w = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, U64)
    n = len(w) - width + 1
    s = np.zeros(max(n, 0), U64)
    for i in range(width if n > 0 else 0):
        s *= U64(0xD1342543DE82EF95)
        s += w[i : i + n]
    s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(s[a : b - width + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:  # fewer words: the whole sequence, never equal to a full shingle
            v = U64(b - a)
            for x in w[a:b]:
                v = U64((int(v) * 0xD1342543DE82EF95 + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([v ^ U64(0x5DEECE66D)])))
        else:
            out.append(np.zeros(0, U64))
    return out


def bands(sets: list[np.ndarray], rows: int = ROWS, n_bands: int = BANDS) -> np.ndarray:
    """(document, band) keys from the minima and maxima of rows * n_bands / 2 permutations; sets must not be empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    half = rows * n_bands // 2
    values = np.empty((2 * half, len(sets)), U64)
    for j in range(half):
        v = flat * (_SEEDS[0, j] | U64(1))
        v ^= _SEEDS[1, j]
        values[j] = np.minimum.reduceat(v, at)
        values[half + j] = np.maximum.reduceat(v, at)
    keys = np.empty((len(sets), n_bands), U64)
    for b in range(n_bands):
        x = np.full(len(sets), _FACTORS[ROWS + b], U64)
        for r in range(rows):
            x = mix(x + values[b * rows + r] * _FACTORS[r])
        keys[:, b] = x
    return keys


def features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n, set_id, bands): size, fingerprint and band keys of each document's set; no set_id and bands where it is empty."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_blocks(batch.column(2)):
                sets = shingle_sets(data, off, width)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                ids = np.zeros(len(sets), np.int64)
                keys = [None] * len(sets)
                if len(full):
                    found = [sets[k] for k in full]
                    at = np.cumsum([0, *[len(s) for s in found[:-1]]])
                    ids[full] = (np.add.reduceat(mix(np.concatenate(found) + U64(1)), at) + n[full].astype(U64)).view(np.int64)
                    b = bands(found).view(np.int64)
                    for k, x in zip(full, b, strict=True):
                        keys[k] = x
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids, pa.int64(), mask=n == 0), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "n", "set_id", "bands"],
                )

    return docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key long, n long, set_id long, bands array<long>")


class Group:
    """Exact linking inside one task."""

    def __init__(self, ids: np.ndarray, band_keys: np.ndarray, sets: list[np.ndarray], similarity: int):
        self.ids, self.similarity = ids, similarity
        self.m = len(sets)
        self.n = np.array([len(s) for s in sets])
        self.parent = np.arange(self.m)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(self.m, dtype=np.int32), self.n)
        order = np.argsort(flat, kind="stable")
        value = flat[order]
        new = np.append(True, value[1:] != value[:-1])
        term = np.empty(len(flat), np.int64)
        term[order] = np.cumsum(new) - 1
        first = np.append(np.flatnonzero(new), len(flat))
        # the most frequent elements as a matrix, the postings of the others
        often = np.diff(first)
        wide = np.argsort(-often, kind="stable")[: min(max(1, DENSE_BYTES // (4 * self.m)), np.count_nonzero(often > 1 + self.m // 64))]
        column = np.full(len(often), -1)
        column[wide] = np.arange(len(wide))
        at = column[term]
        self.dense = np.zeros((self.m, len(wide)), np.float32)
        self.dense[owner[at >= 0], at[at >= 0]] = 1
        self.first, self.posting = first, owner[order]
        self.terms = np.split(term[at < 0], np.cumsum(np.bincount(owner[at < 0], minlength=self.m))[:-1])
        key = band_keys.ravel()
        doc = np.repeat(np.arange(self.m), band_keys.shape[1])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        self.buckets = [doc[s : s + k] for s, k in zip(start, size, strict=True) if k > 1]
        self.buckets.sort(key=len, reverse=True)
        self.degree = np.bincount(doc, weights=np.repeat(size, size), minlength=self.m)
        self.done = np.zeros(self.m, bool)
        self.edges: list[tuple[int, int]] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent[x]]
            if (up == self.parent[x]).all():
                return up
            self.parent[x] = up

    def compare(self, rows: np.ndarray) -> None:
        """Links each of the rows with every member that is similar enough; once is enough."""
        self.done[rows] = True
        shared = self.dense[rows] @ self.dense.T
        for i, a in enumerate(rows.tolist()):
            t = self.terms[a]
            lo, size = self.first[t], self.first[t + 1] - self.first[t]
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            both = shared[i].astype(np.int64) + np.bincount(self.posting[at], minlength=self.m)
            good = np.flatnonzero(100 * both >= self.similarity * (self.n[a] + self.n - both))
            kinds, one = np.unique(self.roots(good), return_index=True)
            mine = self.roots(np.array([a]))[0]
            self.edges += [(a, int(b)) for b in good[one[kinds != mine]]]
            self.parent[kinds] = kinds[0]

    def link(self) -> list[tuple[int, int]]:
        for members in self.buckets:
            roots = self.roots(members)
            if (roots == roots[0]).all():
                continue
            hub = members[np.argmax(self.degree[members])]
            if not self.done[hub]:
                self.compare(np.array([hub]))
            while True:
                _, back, count = np.unique(self.roots(members), return_inverse=True, return_counts=True)
                # all components but the largest, the smallest first; where all of their members are compared, no link is left
                left = np.flatnonzero((back != np.argmax(count)) & ~self.done[members])
                if not len(left):
                    break
                self.compare(members[left[np.argsort(count[back[left]], kind="stable")[:ROWS_AT_ONCE]]])
        return [(int(self.ids[a]), int(self.ids[b])) for a, b in self.edges]


def confirm(similarity: int):
    """Confirmed links (a, b), at most one fewer than the sets of a task, of rows sorted by task."""

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list({r[1]: r for r in rows}.values())
        if len(rows) < 2:
            return
        edges = Group(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [np.frombuffer(r[3], U64) for r in rows], similarity).link()
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for unit, i, j, set_id, keys, blob in zip(*batch.columns, strict=True):
                task = (unit.as_py(), i.as_py(), j.as_py())
                if task != current:
                    yield from done(rows)
                    current, rows = task, []
                rows.append((task, set_id.as_py(), keys.values.to_numpy(), blob.as_py()))
        yield from done(rows)

    return run


def with_sets(width: int):
    """Adds each text's set of shingles as bytes, and drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_blocks(batch.column(0)):
                sets = [s.tobytes() for s in shingle_sets(data, off, width)]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[1:]], pa.array(sets, pa.binary())], names=[*batch.schema.names[1:], "set"])

    return run


def links(docs: DataFrame, classes: DataFrame, width: int, similarity: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to connect whatever all links connect."""
    parts = shuffle_partitions(docs.sparkSession)
    banded = classes.select(F.explode("bands").alias("band"), "set_id")
    heads = banded.groupBy("band").agg(F.min("set_id").alias("head"), F.count("*").alias("in_band")).where("in_band > 1").drop("in_band")
    ties = banded.join(heads, "band").where("set_id != head").select(F.col("set_id").alias("a"), F.col("head").alias("b"))
    units = connected_components(ties)
    wanted = classes.select("set_id", "carrier", "n", "bands").join(units, F.col("set_id") == F.col("node")).drop("node")
    per = wanted.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")).withColumnRenamed("component", "unit")
    wanted = wanted.join(per, F.col("component") == F.col("unit")).drop("component")
    mine = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    sets = docs.select("key", "text").join(wanted, F.col("key") == F.col("carrier")).select("text", "unit", "set_id", "blocks", "bands")
    sets = sets.mapInArrow(with_sets(width), "unit long, set_id long, blocks int, bands array<long>, set binary").withColumn("mine", mine)
    tasks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("unit", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "set_id", "bands", "set")
    return tasks.repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(confirm(similarity), "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at blanks; a set holds the distinct
    shingles of `width` words, or the whole sequence where there are fewer words. Two
    documents are linked where 100 * intersection >= similarity * union; component_id is the
    smallest doc_id reachable, kept says whether it is the document's own.

    A null, empty or word-free text has the empty set and no links: its component is itself.
    Repeated rows share set and component. A null doc_id is never the smallest; a group
    without any other has a null component, and is not kept. Empty tables give no rows;
    columns beyond doc_id and text are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    base = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    found = features(base, width).checkpoint()
    full = found.where("n > 0")
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("lead"), F.min("key").alias("carrier"), F.first("n").alias("n"), F.first("bands").alias("bands")).checkpoint()
    release(docs.sparkSession)
    joined = connected_components(links(base, classes, width, similarity))
    place = classes.select("set_id", "lead").join(joined, F.col("set_id") == F.col("node"), "left").select("set_id", "lead", F.coalesce("component", "set_id").alias("component"))
    least = place.groupBy("component").agg(F.min("lead").alias("component_id"))
    named = place.join(least, "component").select("set_id", "component_id")
    out = full.select("doc_id", "n", "set_id").join(named, "set_id").select("doc_id", "n", "component_id")
    out = out.unionByName(found.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", is_own().alias("kept"))


def is_own() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
