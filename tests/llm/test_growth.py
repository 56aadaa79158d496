"""Work that must not grow faster than the input."""

import tempfile

import numpy as np
import pyarrow as pa

from lorewright.llm import substring_dedup, suffix_dedup


def test_a_shard_gathers_small_flushes(monkeypatch):
    adds = []
    add = suffix_dedup.Levels.add
    monkeypatch.setattr(suffix_dedup.Levels, "add", lambda self, batch: (adds.append(len(batch[0])), add(self, batch))[1])
    rng = np.random.default_rng(1)
    batches, marked = [], set()
    seen: dict[int, list] = {}
    for i in range(500):
        k = rng.integers(0, 4000, 20).astype(np.uint64)
        at = np.arange(20)
        for x, a in zip(k.tolist(), at.tolist(), strict=True):
            seen.setdefault(x, []).append((i, a))
        batches.append(suffix_dedup.pack([k, k, np.full(20, i), at, np.ones(20), np.zeros(20)], np.zeros(20, np.int32)))
    marked = {p for places in seen.values() if len(places) > 1 for p in places}
    out = pa.Table.from_batches(suffix_dedup.scan_shards()(iter(batches)))
    spans = {(key, int(s["at"])) for key, blob in zip(out["key"].to_pylist(), out["spans"].to_pylist(), strict=True) for s in np.frombuffer(blob, suffix_dedup.SPAN)}
    assert spans == marked
    assert sum(adds) == 10_000 and len(adds) <= 2  # not one batch a flush, each of which meets all that went before


def test_members_of_a_large_crowd_meet_those_that_the_hub_covers(spark):
    """Copies of a hub with two changed words are like the copy with one of them only, which the hub covers."""
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    p = [f"w{i}" for i in range(50)]
    changed = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(p))
    texts = [changed(), changed(10), *[changed(10, i) for i in range(20, 28)]]
    lean = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    asked = spark.createDataFrame([(k, 7, 23, 0, 45) for k in range(len(texts))], "key long, crowd long, c int, low int, high int")
    for most in (4096, 9, 4, 1):
        found = {frozenset((r["key"], r["other"])) for r in substring_dedup.crowd_pairs(lean, asked, width=5, least=46, similarity=80, most=most).collect()}
        assert found == {frozenset((1, k)) for k in range(len(texts)) if k != 1}, most


def test_pairs_of_a_crowd_grow_with_its_members():
    """Copies that differ in their last word: the last window of each is like no other's, and no partner covers it. Most begin in another way than the hub."""
    rng = np.random.default_rng(4)
    base, start = (rng.integers(1, 1 << 46, n).astype(np.uint64) << np.uint64(16) for n in (91, 5))
    pairs = []
    for m in (20, 80):
        rows = []
        for k in range(m):
            x = base.copy()
            x[:5] = x[:5] if k % 3 == 0 else start
            x[-5:] = rng.integers(1, 1 << 46, 5).astype(np.uint64) << np.uint64(16)
            rows.append((k, 45, 0, 90, suffix_dedup.planes(x)[2 * len(x) :]))
        crowd = substring_dedup.Crowd(rows, 46, 80)
        found = crowd.link()
        assert {crowd.root(k) for k in range(m)} == {0} and {r[0] for r in found} | {r[3] for r in found} == set(range(m))
        pairs.append(len(found))
    assert pairs[0] <= 2 * 20 and pairs[1] <= 2 * 80


def test_members_around_a_common_line_meet_their_hub_only(spark, monkeypatch):
    """Nothing but a line of 30 words is common: no window can have a partner, so nobody is compared beyond the hub."""
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())

    def sent(least, similarity):  # rows that would be compared, as pairs
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array([0] * b.num_rows, pa.int64())] * 6, names=substring_dedup._PAIR_NAMES) for b in batches)

    monkeypatch.setattr(substring_dedup, "link_crowds", sent)
    line = [f"w{i}" for i in range(30)]
    own = lambda k, side: [f"x{k}{side}{i}" for i in range(40)]
    texts = [" ".join(own(k, "a") + line + own(k, "b")) for k in range(24)]
    lean = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    asked = spark.createDataFrame([(k, 7, 50, 10, 95) for k in range(len(texts))], "key long, crowd long, c int, low int, high int")
    assert substring_dedup.crowd_pairs(lean, asked, width=5, least=46, similarity=80, most=4).count() == 0
