"""Near-duplicate passages by compact windows.

A text is a sequence of word shingles. Under each of a few hash functions the Cartesian
tree over its shingles' hashes groups all passages that share a minimum into compact
windows: a place c with the widest stretch in which it is the minimum. Two passages
agree on a minimum with a probability that is their Jaccard similarity, so a similar pair
shares the value of a window under one of the hash functions but for (1 - similarity) to
the power of their number. Windows of one value propose pairs; an interval join over the
proposals of two documents finds the passages, which are verified on their shingles.

What meets in one value is never paired without bound. Windows whose surroundings (as far
as any least passage around c reaches) are equal are exact copies: each is tied to one of
another document. The different surroundings of a value, if they are few, are compared
with each other. Beyond that they are a crowd: their surroundings are cut out of the
texts and linked in one task (`Crowd`). Every member is first compared with a hub. Where
a member has a window that the hub does not cover, a partner for it shares a shingle that
the hub lacks; those are found by postings, until all its windows are covered or no
partner is left. A pair is noted only if it covers a window or joins what was apart, so the pairs of
a crowd grow with its members. A crowd beyond one task meets its hub row by row; then the
members with uncovered windows whose shingles others hold as well are compared with all
others block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, U64, connected_components, ensure_checkpoint_dir, mix, prefix_hash, release, row_key, shuffle_partitions, span_hash, text_blocks, text_bytes, words_of
from .suffix_dedup import bounds, planes, sliding_min

#: Words of a shingle and of the shortest passage; percent of similarity.
SHINGLE = 5
WORDS = 50
SIMILARITY = 80
#: Hash functions; a passage pair at 80 % has no minimum in common with a probability of 0.0016.
HASHES = 4
#: How far alignments of one passage may drift.
DRIFT = 32
FLUSH = 300_000
#: Different surroundings of a value that are compared pair by pair where they meet; more are a crowd.
FEW = 16
#: Members of a crowd in one task.
CROWD = 4096
#: Bytes of text whose windows make a shard.
SHARD_TEXT = 8 << 20
_FAR = 0xFFFF
MONOTONOUS = 255  # in place of a hash function
_PLACE = 0xFFFFFF  # low bits of a value, which hold a place while minima are sought

_SEEDS = np.random.default_rng(20240609).integers(1, 1 << 63, size=(2, 64), dtype=np.uint64)


def shingles(data: np.ndarray, off: np.ndarray, width: int):
    """Fingerprints of all shingles (those across two documents included), the first word and number of shingles of each document, and the words."""
    data = LOWER[data]
    starts, ends, first = words_of(data, off, BLANKS)
    h = prefix_hash(data)
    w = span_hash(h, starts, ends) if len(starts) else np.zeros(0, U64)
    n = max(0, len(w) - width + 1)
    s = np.zeros(n, U64)
    for i in range(width if n else 0):
        s *= U64(0xD1342543DE82EF95)
        s += w[i : i + n]
    return mix(s), first[:-1], np.maximum(0, np.diff(first) - width + 1), (h, starts, ends)


def reach(c: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each minimum, the nearest one before it that is not larger and the nearest smaller one after it in its document (-1, far): the Cartesian tree's bounds, by jumps over what is already known to be larger."""
    n = len(c)

    def nearest(step: int, over) -> np.ndarray:
        to = np.arange(n) + step
        active = np.arange(n)
        while len(active):
            j = to[active]
            there = (j >= 0) & (j < n)
            active, j = active[there], j[there]
            go = (doc[j] == doc[active]) & over(h[j], h[active])
            active = active[go]
            to[active] = to[j[go]]
        return to

    left, right = nearest(-1, np.greater), nearest(1, np.greater_equal)
    inside = lambda to: (to >= 0) & (to < n) & (doc[to.clip(0, n - 1)] == doc)
    return np.where(inside(left), c[left.clip(0)], -1), np.where(inside(right), c[right.clip(0, n - 1)], 1 << 40)


def thinned(s1: np.ndarray, s2: np.ndarray, c: np.ndarray, g: np.ndarray, least: int):
    """Of neighbouring windows with one value, as in periodic texts, only so many that each passage of the least length still has one."""
    same = np.append(False, (g[c[1:]] == g[c[:-1]]) & (s1[1:] == s2[:-1] + 1))
    first = np.flatnonzero(~same & np.append(same[1:], False))
    if not len(first):
        return s1, s2, c
    keep, s1 = ~same, s1.copy()
    ends = np.append(np.flatnonzero(~same), len(c))
    for i, end in zip(first.tolist(), ends[np.searchsorted(ends, first, side="right")].tolist(), strict=True):
        while i + 1 < end:
            j = max(i + 1, i + int(np.searchsorted(c[i:end], c[i] + least, side="right")) - 1)
            keep[j] = True
            s1[j] = s2[i] + 1
            i = j
    return s1[keep], s2[keep], c[keep]


def monotonous(s: np.ndarray, ok: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which passages of the least length have fewer different shingles than half their places; and runs of such with one set: set's fingerprint, first and last passage."""
    n = len(s)
    if n <= _PLACE:
        key = np.sort((s & ~U64(_PLACE)) | np.arange(n, dtype=U64))
        order, key = (key & U64(_PLACE)).astype(np.int64), key & ~U64(_PLACE)
    else:
        order = np.argsort(s, kind="stable")
        key = s[order]
    again = key[1:] == key[:-1]
    before = np.full(n, -1)
    before[order[1:][again]] = order[:-1][again]
    at = np.arange(n)
    begin = np.maximum(before + 1, at - least + 1).clip(0)  # the first passage in which a shingle stands for the first time
    x = mix(s + U64(1))
    count, total = np.zeros(n + 1, np.int64), np.zeros(n + 1, U64)
    count += np.bincount(begin, minlength=n + 1)
    count[1:] -= 1
    np.add.at(total, begin, x)
    total[1:] -= x
    few = (2 * np.cumsum(count)[: len(ok)] < least) & ok
    which = np.flatnonzero(few)
    sets = mix(np.cumsum(total)[which])
    new = np.append(True, (sets[1:] != sets[:-1]) | (which[1:] != which[:-1] + 1)) if len(which) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return few, sets[first], which[first], which[np.append(first[1:], len(which)) - 1] if len(first) else which


def compact_windows(data: np.ndarray, off: np.ndarray, width: int, least: int, hashes: int):
    """(hash function, value, surroundings, document, c, c - l, r - c) of a block; c counts from the document's first shingle."""
    s, first, count, (h, starts, ends) = shingles(data, off, width)
    out = [[] for _ in range(7)]
    long = np.flatnonzero(count >= least)
    if not len(long):
        return [np.zeros(0, U64 if i in (1, 2) else np.int64) for i in range(7)]
    valid = np.zeros(len(s) + 1, np.int32)
    valid[first[long]] += 1
    valid[first[long] + count[long] - least + 1] -= 1
    ok = np.cumsum(valid[: len(s) - least + 1]) > 0
    few, sets, a, b = monotonous(s, ok, least)
    if len(a):
        ok &= ~few
        doc = np.searchsorted(first, a, side="right") - 1
        for x, y in zip(out, (np.full(len(a), MONOTONOUS), sets, sets, doc, a - first[doc], np.zeros(len(a), np.int64), b - a + least - 1), strict=True):
            x.append(y)
    at = np.arange(len(s), dtype=U64) & U64(_PLACE)
    for f in range(hashes):
        g = mix(s * (_SEEDS[0, f] | U64(1)) + _SEEDS[1, f])
        low = sliding_min((g & ~U64(_PLACE)) | at, least)  # of equal minima the first
        new = np.append(True, (low[1:] != low[:-1]) | (ok[1:] != ok[:-1]))
        s1 = np.flatnonzero(new)
        s2 = np.append(s1[1:], len(low)) - 1
        keep = ok[s1]
        s1, s2 = s1[keep], s2[keep]
        c = s1 + (((low[s1] & U64(_PLACE)).astype(np.int64) - s1) & _PLACE)
        s1, s2, c = thinned(s1, s2, c, g, least)
        doc = np.searchsorted(first, c, side="right") - 1
        # documents without words share their first word with the next one
        left, right = reach(c, g[c], doc)
        begin, end = first[doc], first[doc] + count[doc] - 1
        l = np.where(s1 > c - least + 1, s1, np.maximum(left + 1, begin))
        r = np.where(s2 < c, s2 + least - 1, np.minimum(right - 1, end))
        a, b = np.maximum(begin, c - least + 1), np.minimum(end, c + least - 1) + width - 1
        for x, y in zip(out, (np.full(len(c), f), g[c], span_hash(h, starts[a], ends[b]), doc, c - begin, np.clip(c - l, 0, _FAR), r - c), strict=True):
            x.append(y)
    return [np.concatenate(x) for x in out]


# -- windows (value, surroundings, key, c, before, after, dealt) and ties (key, other, kind, c, low, high, shift) travel as arrays end to end

_WINDOW = (U64, U64, np.int64, np.int32, np.uint16, np.int32, np.uint8)
_TIE = (np.int64, np.int64, np.uint8, np.int32, np.int32, np.int32, np.int32)
EXACT, NEAR, ASKED, SAME_SET = 0, 1, 2, 3  # equal surroundings; to be verified; a crowd's request for surroundings (other: the crowd); a monotonous stretch with another's set (shift: its place)


def tie(w: list[np.ndarray], a: np.ndarray, b: np.ndarray, kind: int) -> list[np.ndarray]:
    """Ties of the windows a to the windows b of other documents, in the places of a."""
    ok = w[2][a] != w[2][b]
    a, b = a[ok], b[ok]
    c, x = w[3].astype(np.int64), [v.astype(np.int64) for v in (w[4], w[5])]
    return [w[2][a], w[2][b], np.full(len(a), kind), c[a], c[a] - np.minimum(x[0][a], x[0][b]), c[a] + np.minimum(x[1][a], x[1][b]), c[b] - c[a]]


def copies(w: list[np.ndarray]):
    """Of windows in the order of (value, surroundings, key, c): the first of each surroundings, the first of another document among them (or -1), each window's place among these groups, and whether it is of the first's document."""
    new = np.append(True, (w[0][1:] != w[0][:-1]) | (w[1][1:] != w[1][:-1]))
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    own = w[2] == w[2][first][group]
    other = np.flatnonzero(~own)
    second = np.full(len(first), -1)
    second[group[other][::-1]] = other[::-1]
    return first, second, group, own


def tie_copies(w: list[np.ndarray]) -> list[np.ndarray]:
    """Ties of every window to an exact copy in another document, where there is one."""
    first, second, group, own = copies(w)
    idx = np.flatnonzero(np.where(own, second[group] >= 0, True))
    partner = np.where(own, second[group], first[group])[idx]
    out = tie(w, idx, partner, EXACT)  # no tie is dropped: partners are of other documents
    same = w[6][idx] == MONOTONOUS
    a, b = idx[same], partner[same]
    out[2][same], out[4][same], out[5][same], out[6][same] = SAME_SET, w[3][a], w[3][a].astype(np.int64) + w[5][a], w[3][b]
    return out


def speakers(w: list[np.ndarray]) -> np.ndarray:
    """Windows that stand for all with their surroundings: two documents do; a document that is alone with its copies speaks with each of them."""
    first, second, group, _ = copies(w)
    some = (second < 0)[group]
    some[first] = True
    some[second[second >= 0]] = True
    return np.flatnonzero(some)


def places(new: np.ndarray) -> np.ndarray:
    """Of groups that begin where `new` holds: each entry's place in its group."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def tie_values(w: list[np.ndarray], few: int) -> Iterator[list[np.ndarray]]:
    """Ties between all different surroundings of a value that has at most `few`, and requests for all surroundings of the others."""
    some = speakers(w)
    if not len(some):
        return
    v, around = w[0][some], w[1][some]
    new = np.append(True, v[1:] != v[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(some)))
    dealt = np.logical_or.reduceat(w[6][some] == 1, at)
    alone = (np.minimum.reduceat(w[2][some], at) == np.maximum.reduceat(w[2][some], at)) & ~dealt
    crowd = np.repeat(((size > few) | dealt) & ~alone, size)
    place = places(new)
    index = np.flatnonzero(~crowd & ~np.repeat(alone, size))
    for back in range(1, few):
        index = index[place[index] >= back]
        if not len(index):
            break
        other = index - back
        differ = around[index] != around[other]
        yield tie(w, some[index[differ]], some[other[differ]], NEAR)
    # a second copy speaks only where the first one's document holds more of this value
    first = np.append(True, (v[1:] != v[:-1]) | (around[1:] != around[:-1]))
    by_key = np.lexsort((w[2][some], v))
    vk, kk = v[by_key], w[2][some][by_key]
    same = (vk[1:] == vk[:-1]) & (kk[1:] == kk[:-1])
    more = np.zeros(len(some), bool)
    more[by_key] = np.append(same, False) | np.append(False, same)
    needed = first | more[np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))] | np.repeat(dealt, size)
    asked = some[crowd & needed]
    if len(asked):
        c = w[3][asked].astype(np.int64)
        yield [w[2][asked], w[0][asked].view(np.int64), np.full(len(asked), ASKED), c, c - w[4][asked], c + w[5][asked], np.zeros(len(asked), np.int64)]


def blobs(arrays, types, shard: np.ndarray, kind: int, by: tuple[int, int]):
    """One row per shard; inside, the rows stand by document and place and their bytes in planes, which compress."""
    order = np.lexsort((arrays[by[1]], arrays[by[0]], shard))
    shard = shard[order]
    arrays = [a[order].astype(t) for a, t in zip(arrays, types, strict=True)]
    at = bounds(shard)
    end = np.append(at[1:], len(shard))
    data = [b"".join(planes(a[i:j]) for a in arrays) for i, j in zip(at, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int32()), pa.array((end - at).astype(np.int32), pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(data, pa.binary())], names=["shard", "n", "kind", "blob"])


def arrays_of(n: int, blob: bytes, types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, count=n * width, offset=at).reshape(width, n).T).view(t).ravel())
        at += n * width
    return out


def send(n_shards: int, width: int, least: int, hashes: int, few: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        w = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.lexsort((w[3], w[2], w[1], w[0]))
        w = [x[order].astype(t) for x, t in zip(w, _WINDOW, strict=True)]
        found = tie_copies(w)
        if len(found[0]):
            yield blobs(found, _TIE, (found[0].astype(U64) % U64(n_shards)).astype(np.int32), 1, (0, 3))
        w = [x[speakers(w)] for x in w]
        # the surroundings of a value that this task alone shows to be a crowd don't all go to the value's shard
        new = np.append(True, w[0][1:] != w[0][:-1])
        nth = np.cumsum(new | np.append(True, w[1][1:] != w[1][:-1]))
        w[6] = np.where(w[6] == MONOTONOUS, MONOTONOUS, nth - np.maximum.accumulate(np.where(new, nth, 0)) > few).astype(np.uint8)
        to = np.where(w[6] == 1, mix(w[0] ^ w[1]), w[0]) >> U64(32)
        yield blobs(w, _WINDOW, (to % U64(n_shards)).astype(np.int32), 0, (2, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, off in text_blocks(batch.column(1)):
                f, v, around, doc, c, before, after = compact_windows(data, off, width, least, hashes)
                if len(v):
                    held.append([v & ~U64(_PLACE), around, keys[i + doc], c, before, after, f])  # a value only proposes: five of its bytes do
                    size += len(v)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def meet(few: int):
    """Ties and requests of each shard's windows, and ties that come ready; as rows."""
    names = ["key", "other", "kind", "c", "low", "high", "shift"]

    def rows(t: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(t[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000].astype(np.int64 if k < 2 else np.int32)) for k, x in enumerate(t)], names=names)

    def done(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            w = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((w[3], w[2], w[1], w[0]))
            w = [x[order] for x in w]
            yield from rows(tie_copies(w))
            for t in tie_values(w, few):
                yield from rows(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for shard, n, kind, blob in zip(*batch.columns, strict=True):
                if shard.as_py() != current:
                    yield from done(held)
                    held, current = [], shard.as_py()
                if kind.as_py():
                    yield from rows(arrays_of(n.as_py(), blob.as_py(), _TIE))
                else:
                    held.append(arrays_of(n.as_py(), blob.as_py(), _WINDOW))
        yield from done(held)

    return run


def merged(t: list[np.ndarray], least: int, drift: int) -> list[np.ndarray]:
    """(key, low, high, other, other_low, other_high) of the passages that the ties of two documents make together, alignments within `drift` of each other."""
    key, other, _, c, low, high, shift = t
    order = np.lexsort((shift, other, key))
    key, other, c, low, high, shift = (x[order] for x in (key, other, c, low, high, shift))
    new = np.append(True, (key[1:] != key[:-1]) | (other[1:] != other[:-1]) | (shift[1:] - shift[:-1] > drift))
    pair = np.cumsum(new) - 1
    s1, s2 = np.maximum(low, c - least + 1), np.minimum(c, high - least + 1)
    ok = np.flatnonzero(s1 <= s2)
    pair, s1, s2, c, shift = pair[ok], s1[ok], s2[ok], c[ok], shift[ok]
    p = np.concatenate([pair, pair])
    at = np.concatenate([s1, s2 + 1])
    step = np.concatenate([np.ones(len(s1), np.int64), -np.ones(len(s2), np.int64)])
    order = np.lexsort((at, p))
    p, at, step = p[order], at[order], step[order]
    level = np.cumsum(step)
    final = np.append((p[1:] != p[:-1]) | (at[1:] != at[:-1]), True) if len(p) else np.zeros(0, bool)
    p, at, level = p[final], at[final], level[final]
    up = np.flatnonzero((level > 0) & (np.append(0, level[:-1]) == 0))
    down = np.flatnonzero((level == 0) & (np.append(0, level[:-1]) > 0))
    who, lo, hi = p[up], at[up], at[down] - 1 + least - 1
    # the alignment at both ends: that of the pair's ties next to them
    order = np.lexsort((c, pair))
    pc, cc, sh = pair[order], c[order], shift[order]
    big = np.int64(1) << np.int64(32)
    spot = pc * big + cc
    a = np.minimum(np.searchsorted(spot, who * big + lo), len(spot) - 1)
    b = np.maximum(np.searchsorted(spot, who * big + hi, side="right") - 1, 0)
    heads = np.flatnonzero(new)
    return [key[heads][who], lo, hi, other[heads][who], np.maximum(0, lo + sh[a]), hi + sh[b]]


def interval_join(least: int):
    """Passages of two documents that have ties, from ties sorted by document; requests as they are (other_low: c)."""
    names = ["key", "low", "high", "other", "other_low", "other_high", "kind"]

    def passages(t: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for kind in (EXACT, NEAR, ASKED, SAME_SET):
            mine = [x[t[2] == kind] for x in t]
            if len(mine[0]):
                key, other, _, c, low, high, shift = mine
                if kind == ASKED:
                    out = [key, low, high, other, c, shift]
                elif kind == SAME_SET:
                    out = [key, low, high, other, shift, shift + least - 1]
                else:
                    out = merged(mine, least, DRIFT if kind == NEAR else 0)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out), pa.array(np.full(len(out[0]), kind), pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            t = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns]
            cut = int(np.searchsorted(t[0], t[0][-1])) if len(t[0]) else 0  # sorted: the last document may go on
            if cut:
                held.append([x[:cut] for x in t])
                yield from passages([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            held.append([x[cut:] for x in t])
        if held and sum(len(x[0]) for x in held):
            yield from passages([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def asked_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, list]]:
    """(key, shingles, columns of what is asked) of each row (key, text, list of structs); a repeated row, which asks the same again, is left out."""
    last = None
    lists = batch.column(2)
    off = lists.offsets.to_numpy()
    fields = lists.values.flatten()
    for i, key in enumerate(batch.column(0).to_numpy(zero_copy_only=False).tolist()):
        if key != last:
            data = np.frombuffer((batch.column(1)[i].as_py() or "").encode(), np.uint8)
            yield key, shingles(data, np.array([0, len(data)]), width)[0], [f.slice(off[i], off[i + 1] - off[i]) for f in fields]
        last = key


def cut_passages(width: int):
    """(key, text, asked: low, high, other, other_low, other_high) -> each pair with its own passage: the upper six bytes of each fingerprint, in planes."""
    names = ["key", "low", "other", "other_low", "other_high", "passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, s, (low, high, *other) in asked_of(batch, width):
                parts = [s[i : j + 1] for i, j in zip(low.to_pylist(), high.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), key)), low, *other, pa.array([planes(x)[2 * len(x) :] for x in parts], pa.binary())], names=names)

    return run


def alike(a: list, b: list, common: set, least: int, similarity: int) -> tuple[int, int, int, int] | None:
    """The two sequences trimmed to their outermost common shingles (ends included), if long and similar enough."""
    i = next(k for k, x in enumerate(a) if x in common)
    j = len(a) - next(k for k, x in enumerate(reversed(a)) if x in common)
    p = next(k for k, x in enumerate(b) if x in common)
    q = len(b) - next(k for k, x in enumerate(reversed(b)) if x in common)
    if min(j - i, q - p) < least:
        return None
    both = len(common)
    return (i, j - 1, p, q - 1) if 100 * both >= similarity * (len(set(a[i:j])) + len(set(b[p:q])) - both) else None


def best_parts(a: np.ndarray, b: np.ndarray, least: int, similarity: int) -> list[tuple[int, int, int, int]]:
    """Similar parts of two aligned passages: the whole, or else the runs of its least-length windows that are dense in common shingles, or else halves of those down to single windows."""
    la, lb = a.tolist(), b.tolist()
    common = set(la).intersection(lb)
    if not common or min(len(la), len(lb)) < least:
        return []
    if whole := alike(la, lb, common, least, similarity):
        return [whole]
    match = np.fromiter((x in common for x in la), bool, len(la))
    total = np.append(0, np.cumsum(match))
    # similarity s of two windows of n shingles needs 2 n s / (1 + s) common ones
    starts = np.flatnonzero((total[least:] - total[:-least]) * (100 + similarity) >= 2 * least * similarity).tolist()
    if not starts:
        return []
    place = {x: k for k, x in reversed(list(enumerate(lb)))}
    out = []
    runs = [[starts[0], starts[0]]]
    for x in starts[1:]:
        if x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    while runs:
        first, last = runs.pop()
        if got := part(la, lb, first, last + least, place, least, similarity):
            out.append(got)
        elif first < last:
            half = (first + last) // 2
            runs += [[first, half], [half + 1, last]]
    return out


def part(a: list, b: list, lo: int, hi: int, place: dict, least: int, similarity: int) -> tuple[int, int, int, int] | None:
    mine = set(a[lo:hi])
    at = [place[x] for x in mine if x in place]
    # the other side reaches as far as the common shingles, and at least as far as a window
    first, last = min(at), max(at)
    if last - first + 1 < least:
        last = min(len(b) - 1, first + least - 1)
        first = max(0, last - least + 1)
    theirs = set(b[first : last + 1])
    both = len(mine & theirs)
    return (lo, hi - 1, first, last) if 100 * both >= similarity * (len(mine) + len(theirs) - both) else None


def sequence(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(6, -1).T
    return out.view(U64).ravel()


def verify(width: int, least: int, similarity: int):
    """(other, text, asked: other_low, other_high, key, low, passage) -> similar parts of the passages and of the text's."""
    names = ["key", "low", "high", "other", "other_low", "other_high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for other, s, asked in asked_of(batch, width):
                for j, other_hi, key, i, passage in zip(*(x.to_pylist() for x in asked), strict=True):
                    theirs = s[j : other_hi + 1] & ~U64(0xFFFF)
                    for p, q, r, t in best_parts(sequence(passage), theirs, least, similarity):
                        rows.append((key, i + p, i + q, other, j + r, j + t))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


# -- crowds: rows (crowd, key, c, low, high, around), around being the shingles from low to high, as far as they are within reach of c

_CONTEXT = "crowd long, key long, c int, low int, high int, around binary"
_PAIR = "key long, low long, high long, other long, other_low long, other_high long"
_PAIR_NAMES = ["key", "low", "high", "other", "other_low", "other_high"]


def cut_surroundings(width: int, least: int):
    """(key, text, asked: crowd, c, low, high) -> the shingles of each compact window as far as they are within reach of its c, as `cut_passages` packs them."""
    names = ["crowd", "key", "c", "low", "high", "around"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, s, (crowd, c, low, high) in asked_of(batch, width):
                at = c.to_numpy(zero_copy_only=False)
                lo, hi = np.maximum(low.to_numpy(zero_copy_only=False), at - least + 1), np.minimum(high.to_numpy(zero_copy_only=False), at + least - 1)
                parts = [s[i : j + 1] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([crowd, pa.array(np.full(len(at), key)), c, pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array([planes(x)[2 * len(x) :] for x in parts], pa.binary())], names=names)

    return run


def needed(least: int, similarity: int) -> int:
    """Common shingles of two similar windows."""
    return -(-2 * least * similarity // (100 + similarity))


class Crowd:
    """Surroundings of one value, a row of 2 * least - 1 places around c each, and their linking.

    Partners are sought for all windows of the rows that `asks` names (all without it). `want` has the windows of each
    row that nothing noted elsewhere covers (None: all), and the rows that `joined` names are linked with each other already.
    """

    def __init__(self, rows: list[tuple], least: int, similarity: int, asks: list[bool] | None = None, want: list[list[int] | None] | None = None, joined: list[bool] | None = None):
        self.least, self.similarity, m = least, similarity, len(rows)
        self.key = np.array([r[0] for r in rows])
        self.begin = np.array([r[1] - least + 1 for r in rows])  # the shingle of the first place, which may lie before the text
        self.from_ = np.array([r[2] for r in rows]) - self.begin
        self.to = np.array([r[3] for r in rows]) - self.begin
        wide = 2 * least - 1
        value = np.zeros((m, wide), U64)
        self.there = np.zeros((m, wide), bool)
        for i, r in enumerate(rows):
            x = sequence(r[4])
            a = r[2] - r[1] + least - 1
            value[i, a : a + len(x)] = x
            self.there[i, a : a + len(x)] = True
        self.value = value
        _, ids = np.unique(value[self.there], return_inverse=True)
        self.id = np.full((m, wide), -1, np.int64)
        self.id[self.there] = ids
        member, place = np.nonzero(self.there)
        order = np.argsort(ids, kind="stable")
        self.posting = member[order]
        self.first = np.searchsorted(ids[order], np.arange((ids.max() if len(ids) else -1) + 2))
        starts = np.arange(least)
        # windows by their first place, all of which hold c; those still without a partner here, and those that nothing covers
        self.every = (starts >= self.from_[:, None]) & (starts <= (self.to - least + 1)[:, None])
        self.want, self.bare = self.every.copy(), self.every.copy()
        for i, left in enumerate(want or []):
            if left is not None:
                self.bare[i] &= np.isin(starts, left)
        if asks is not None:
            self.want[~np.array(asks)] = False
        self.need = needed(least, similarity)
        self.parent = np.arange(m)
        together = np.flatnonzero(joined or [])
        self.parent[together] = together[:1]
        self.pairs: list[tuple[int, int, int, int, int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def dense(self, match: np.ndarray) -> np.ndarray:
        total = np.cumsum(np.pad(match, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        return total[:, self.least :] - total[:, : -self.least] >= self.need

    def verify(self, x: int, y: int) -> None:
        """Notes the similar passages of x and y that cover something new of either or join the two, and what they cover of both."""
        a, b = self.from_[x], np.flatnonzero(self.there[y])
        mine, theirs = self.value[x, a : self.to[x] + 1], self.value[y, b]
        for p, q, r, s in best_parts(mine, theirs, self.least, self.similarity):
            p, q, r, s = p + a, q + a, r + b[0], s + b[0]
            of_x, of_y = slice(p, q - self.least + 2), slice(r, s - self.least + 2)
            i, j = self.root(x), self.root(y)
            if i != j or self.bare[x, of_x].any() or self.bare[y, of_y].any():
                self.pairs.append((x, int(p), int(q), y, int(r), int(s)))
            self.want[x, of_x] = self.bare[x, of_x] = False
            self.want[y, of_y] = self.bare[y, of_y] = False
            self.parent[max(i, j)] = min(i, j)

    def of_shingles(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members that hold the shingles, and which of the shingles."""
        lo, size = self.first[ids], self.first[ids + 1] - self.first[ids]
        rows = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.posting[rows], np.repeat(np.arange(len(ids)), size)

    def link(self) -> list[tuple[int, int, int, int, int, int]]:
        """(key, low, high, other, other_low, other_high): passages that cover every window that has a partner, and join whatever has one."""
        m = len(self.key)
        size = np.diff(self.first)
        hub = int(np.argmax(np.where(self.there, size[self.id], 0).sum(axis=1)))
        held = np.zeros(len(size) + 1, bool)  # the hub's shingles; the last entry is for places outside a text
        held[self.id[hub][self.there[hub]]] = True
        held[-1] = False
        near = (self.dense(held[self.id]) & self.want).any(axis=1) & (self.key != self.key[hub])
        for y in np.flatnonzero(near).tolist():
            self.verify(y, hub)
        held_or_out = held.copy()
        held_or_out[-1] = True
        row = np.full(m, -1)
        for x in np.flatnonzero(self.want.any(axis=1)).tolist():
            rare = self.id[x][~held_or_out[self.id[x]]]
            with_one = np.unique(self.of_shingles(np.unique(rare))[0])
            with_one = with_one[self.key[with_one] != self.key[x]]
            if not len(with_one):
                continue
            row[with_one] = np.arange(len(with_one))
            cols = np.flatnonzero(self.there[x])
            who, which = self.of_shingles(self.id[x][cols])
            mine = row[who] >= 0
            match = np.zeros((len(with_one), self.id.shape[1]), bool)
            match[row[who[mine]], cols[which[mine]]] = True
            row[with_one] = -1
            dense = self.dense(match) & self.every[x]
            some = dense.any(axis=1)
            dense, partners = dense[some], with_one[some]
            while len(partners):
                gain = (dense & self.want[x]).sum(axis=1)
                if not gain.any():
                    gain = np.array([self.root(y) for y in partners.tolist()]) != self.root(x)
                    if not gain.any():
                        break
                k = int(np.argmax(gain))
                self.verify(x, int(partners[k]))
                dense, partners = np.delete(dense, k, axis=0), np.delete(partners, k)
        return self.noted()

    def noted(self) -> list[tuple[int, int, int, int, int, int]]:
        at = self.begin
        return [(int(self.key[x]), int(at[x] + p), int(at[x] + q), int(self.key[y]), int(at[y] + r), int(at[y] + s)) for x, p, q, y, r, s in self.pairs]


def link_crowds(least: int, similarity: int):
    """(crowd, i, j, asks, want, joined, key, c, low, high, around), sorted by the first three -> verified pairs."""

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len({r[3] for r in rows}) > 1 and any(r[0] for r in rows):
            asks, want, joined, *_ = zip(*rows, strict=True)
            found = Crowd([r[3:] for r in rows], least, similarity, asks, want, joined).link()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=_PAIR_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for crowd, i, j, *row in zip(*batch.columns, strict=True):
                task = (crowd.as_py(), i.as_py(), j.as_py())
                if task != current:
                    yield from done(rows)
                    current, rows = task, []
                rows.append(tuple(x.as_py() for x in row))
        yield from done(rows)

    return run


def meet_hub(least: int, similarity: int):
    """(crowd, key, c, low, high, around, hub's key, c, low, high, around) -> verified pairs; and each row as (crowd, key, c, first, last, want, joined, lacks): its first and last window, those that the hub does not cover, whether it is linked with the hub, and its shingles that the hub lacks, with their places."""
    kinds = dict(zip([*_PAIR_NAMES, "crowd", "c"], [pa.int64()] * 7 + [pa.int32()], strict=True)) | {"first": pa.int32(), "last": pa.int32(), "want": pa.list_(pa.int32()), "joined": pa.bool_(), "lacks": pa.list_(pa.struct({"at": pa.int32(), "s": pa.int64()}))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for crowd, *row in zip(*batch.columns, strict=True):
                row = [x.as_py() for x in row]
                two = Crowd([tuple(row[:5]), tuple(row[5:])], least, similarity)
                if row[0] != row[5]:
                    two.verify(0, 1)
                    if (two.dense(np.isin(two.id[1:], two.id[0][two.there[0]])) & two.bare[1]).any():
                        two.verify(1, 0)
                out += [dict(zip(_PAIR_NAMES, pair, strict=True)) for pair in two.noted()]
                hub = row[:2] == row[5:7]  # which needs nobody else, as all have met it
                lacks = np.flatnonzero(two.there[0] & ~np.isin(two.id[0], two.id[1][two.there[1]]))
                lacks = [{"at": i, "s": s} for i, s in zip(lacks.tolist(), two.value[0, lacks].view(np.int64).tolist(), strict=True)]
                out.append({"key": row[0], "crowd": crowd.as_py(), "c": row[1], "first": int(two.from_[0]), "last": int(two.to[0]) - least + 1, "want": [] if hub else np.flatnonzero(two.want[0]).tolist(), "joined": hub or bool(two.pairs), "lacks": lacks})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], k) for n, k in kinds.items()], names=list(kinds))

    return run


def with_texts(lean: DataFrame, asked: DataFrame, by: str, *cols: str) -> DataFrame:
    """(key, text, asked): each document that `by` names, with all that is asked of it; a document's own length bounds that."""
    of = asked.groupBy(F.col(by).alias("_key")).agg(F.collect_list(F.struct(*cols)).alias("asked"))
    return lean.join(of, F.col("key") == F.col("_key")).select("key", "text", "asked")


def crowd_pairs(lean: DataFrame, asked: DataFrame, *, width: int, least: int, similarity: int, most: int) -> DataFrame:
    """Verified pairs of the crowds that (key, crowd, c, low, high) rows ask for.

    Beyond `most` members a crowd is cut into blocks of at most half as many on average. A member with
    windows that the hub does not cover meets every block, so that no partner is lost; a task holds two blocks.
    Members none of whose windows has enough shingles that another document holds as well have no partner to seek.
    """
    parts = shuffle_partitions(lean.sparkSession)
    around = with_texts(lean, asked, "key", "crowd", "c", "low", "high").mapInArrow(cut_surroundings(width, least), _CONTEXT)
    sizes = asked.groupBy("crowd").agg(F.count("*").alias("n"), F.min(F.struct("key", "c")).alias("hub"))
    large = sizes.where(F.col("n") > most).withColumnRenamed("crowd", "_crowd").persist()
    whole = {"i": F.lit(0), "j": F.lit(0), "asks": F.lit(True), "want": F.lit(None).cast("array<int>"), "joined": F.lit(False)}
    cols = ["crowd", "i", "j", "asks", "want", "joined", "key", "c", "low", "high", "around"]
    tasks = around.withColumns(whole)
    ready = None
    if not large.isEmpty():
        around = around.checkpoint()
        release(lean.sparkSession)
        marked = around.join(large, F.col("crowd") == F.col("_crowd"))
        hubs = marked.where((F.col("key") == F.col("hub.key")) & (F.col("c") == F.col("hub.c")))
        hubs = hubs.select("_crowd", *[F.col(c).alias(f"h_{c}") for c in ("key", "c", "low", "high", "around")]).dropDuplicates(["_crowd"])
        met = around.join(hubs, F.col("crowd") == F.col("_crowd")).drop("_crowd").mapInArrow(meet_hub(least, similarity), f"{_PAIR}, crowd long, c int, first int, last int, want array<int>, joined boolean, lacks array<struct<at: int, s: long>>").checkpoint()
        ready = met.where("crowd is null").select(_PAIR_NAMES)
        met = met.where("crowd is not null")
        # shingles of one document only: their first and last place there (what stands between counts as held by others), each as the row's number and seven bits
        row = F.shiftleft(F.xxhash64("crowd", "key", "c"), 7)
        places = met.select("crowd", "key", F.when(F.size("want") > 0, row).alias("row"), F.inline("lacks")).select(F.xxhash64("crowd", "s").alias("h"), "key", (F.col("row") + F.col("at")).alias("place"))
        lone = places.groupBy("h").agg(F.min("key").alias("from"), F.max("key").alias("to"), F.min("place").alias("a"), F.max("place").alias("b")).where("from = to and a is not null").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("place"))
        own = lone.groupBy((F.col("place") - F.col("place").bitwiseAND(127)).alias("row")).agg(F.collect_set(F.col("place").bitwiseAND(127).cast("int")).alias("own"))
        members = met.groupBy("crowd", "key", "c").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_set("want")).alias("want"), F.max("joined").alias("joined")).withColumn("row", row).join(own, "row", "left")
        # a window with more shingles of its own than two similar ones may differ by has no partner
        inside = lambda w: F.size(F.filter(F.coalesce("own", F.array().cast("array<int>")), lambda p: (p >= w) & (p < w + least)))
        seeks = F.exists(F.sequence("first", "last"), lambda w: inside(w) <= least - needed(least, similarity))
        members = members.withColumn("alone", F.when((F.size("want") > 0) & (F.col("first") <= F.col("last")), seeks).otherwise(False)).select("crowd", "key", "c", "want", "joined", "alone").checkpoint()
        alone = members.where("alone")
        blocks = lambda n: F.ceil(F.col(n) / max(1, most // 2)).cast("int")
        counts = alone.groupBy("crowd").agg(F.count("*").alias("left")).join(large.select(F.col("_crowd").alias("crowd"), "n"), "crowd").select("crowd", blocks("left").alias("askers"), blocks("n").alias("others"))
        # member blocks j meet asking blocks i; who asks goes to all j of its i, and to the other i of its j as a member
        place = lambda of: F.pmod(F.xxhash64("key", "c"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        rows = around.join(counts, "crowd").join(members, ["crowd", "key", "c"]).withColumns({"mine": place("others"), "asking": F.when(F.col("alone"), place("askers"))})
        met_there = rows.withColumn("i", every("askers")).withColumns({"j": F.col("mine"), "asks": F.coalesce(F.col("asking") == F.col("i"), F.lit(False))})
        askers = rows.where("alone").withColumn("j", every("others")).where("j != mine").withColumns({"i": F.col("asking"), "asks": F.lit(True)})
        tasks = around.join(large.select("_crowd"), F.col("crowd") == F.col("_crowd"), "left_anti").withColumns(whole).select(cols).unionByName(met_there.select(cols)).unionByName(askers.select(cols))
    tasks = tasks.select(cols).repartition(parts, "crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")
    linked = tasks.mapInArrow(link_crowds(least, similarity), _PAIR)
    return linked if ready is None else linked.union(ready)


def passage_pairs(base: DataFrame, *, width: int, words: int, similarity: int, hashes: int, few: int, most: int) -> DataFrame:
    """Verified pairs (key, low, high, other, other_low, other_high) of passages, in shingles, ends included."""
    spark = base.sparkSession
    parts = shuffle_partitions(spark)
    least = words - width + 1
    lean = base.select("key", "text")
    n_shards = max(2 * parts, -(-text_bytes(base) // SHARD_TEXT))
    sent = lean.mapInArrow(send(n_shards, width, least, hashes, few), "shard int, n int, kind int, blob binary")
    tied = sent.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(meet(few), "key long, other long, kind int, c int, low int, high int, shift int")
    found = tied.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(interval_join(least), f"{_PAIR}, kind int").checkpoint()
    release(spark)
    exact = found.where(F.col("kind").isin(EXACT, SAME_SET)).select(_PAIR_NAMES)
    near = found.where(F.col("kind") == NEAR).select(_PAIR_NAMES)
    asked = found.where(F.col("kind") == ASKED).select("key", F.col("other").alias("crowd"), F.col("other_low").cast("int").alias("c"), F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")).distinct()
    # the passage travels to the other document; the joins take the same columns of the documents, so that texts are shuffled once
    mine = with_texts(lean, near, "key", "low", "high", "other", "other_low", "other_high").mapInArrow(cut_passages(width), "key long, low long, other long, other_low long, other_high long, passage binary")
    checked = with_texts(lean, mine, "other", "other_low", "other_high", "key", "low", "passage").mapInArrow(verify(width, least, similarity), _PAIR).checkpoint()
    del mine
    release(spark)
    return exact.union(checked).union(crowd_pairs(lean, asked, width=width, least=least, similarity=similarity, most=most))


def passages(docs: DataFrame, *, width: int = SHINGLE, words: int = WORDS, similarity: int = SIMILARITY, hashes: int = HASHES, few: int = FEW, most: int = CROWD, partners: bool = False) -> DataFrame:
    """Per document: doc_id, n_passages, n_repeated_words, spans, partner_id, class_id, n_links (and with `partners` partner_ids).

    spans lists the maximal runs of words that lie in a passage of at least `words` words
    which another document holds too, nearly or exactly: start:end in words (end
    exclusive), comma-joined. partner_id is the smallest doc_id of those the passages were
    verified against (exact copies against a representative, members of a crowd against
    enough others to cover and to join them), null where there is none; n_links counts the
    documents behind it, those with a null doc_id included, and partner_ids lists them in
    order, comma-joined. class_id is the smallest doc_id of all documents that verified
    pairs join, directly or through others.

    A monotonous stretch, one whose passages of the least length have fewer different
    shingles than half their places (a word over and over), counts as repeated where
    another document has such a passage with the same set of shingles; it is not compared
    for near copies.

    Null, empty and shorter texts have no passages. Repeated rows (one doc_id, one text)
    are one document with several rows; a null doc_id is no partner. An empty table gives
    no rows; columns beyond doc_id and text are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    base = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    pairs = passage_pairs(base, width=width, words=words, similarity=similarity, hashes=hashes, few=few, most=most).checkpoint()
    release(docs.sparkSession)
    spans = pairs.select("key", "low", "high").union(pairs.select("other", "other_low", "other_high")).distinct().withColumn("high", F.col("high") + width)
    w = Window.partitionBy("key").orderBy("low", "high")
    reach_before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("low") <= reach_before, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    said = runs.groupBy("key").agg(F.count("*").alias("n_passages"), F.sum(F.col("high") - F.col("low")).alias("n_repeated_words"), F.array_sort(F.collect_list(F.struct("low", "high"))).alias("s"))
    names = base.groupBy("key").agg(F.min("doc_id").alias("id"))
    links = pairs.select("key", "other").union(pairs.select("other", "key")).distinct()
    listed = [F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("partner_ids")] if partners else []
    linked = links.join(names.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("id").alias("partner_id"), F.count("*").alias("n_links"), *listed)
    nodes = connected_components(pairs.select(F.col("key").alias("a"), F.col("other").alias("b")))
    classes = nodes.join(names.withColumnRenamed("key", "node"), "node")
    classes = classes.join(classes.groupBy("component").agg(F.min("id").alias("class_id")), "component").select(F.col("node").alias("key"), "class_id")
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["low"], x["high"])), ",")
    out = base.select("doc_id", "key").join(said, "key", "left").join(linked, "key", "left").join(classes, "key", "left")
    out = out.select("doc_id", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_repeated_words", F.lit(0)).alias("n_repeated_words"), F.coalesce(text, F.lit("")).alias("spans"), "partner_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), *(["partner_ids"] if partners else []))
    return out.withColumn("partner_ids", F.coalesce("partner_ids", F.lit(""))) if partners else out
