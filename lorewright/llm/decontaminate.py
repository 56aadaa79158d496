"""Benchmark decontamination.

One Aho-Corasick automaton over the windows of all normalised benchmark items scans
every normalised document once. Its alphabet are the benchmark's words, so a window has
ten nodes and the offsets of the hits are those of words in the original text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Words of a window.
WINDOW = 10
#: Windows of one automaton, which bound its nodes (at most WINDOW each) and the driver's share; a larger benchmark is scanned in several passes.
MAX_WINDOWS = 400_000

#: ASCII that is part of a word after lower-casing; every byte of 0x80 and above is one too.
_WORD_ASCII = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_ASCII or b >= 0x80 else 32 for b in range(256))


def normalise(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def windows(words: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The item's windows: each n consecutive words, or all of them where there are fewer."""
    if not words:
        return []
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


class Automaton:
    """Aho-Corasick over words: each word of the windows is a number of a few digits, every other word the digits that no window has.

    Digits are to the base 64, as a node's successors are sought one by one, and those of each place have their own characters.
    """

    def __init__(self, items: list[tuple[object, str]], n: int = WINDOW):
        import ahocorasick

        found: dict[tuple[bytes, ...], set[int]] = {}
        for at, (_, text) in enumerate(items):
            for w in windows(normalise(text), n):
                found.setdefault(w, set()).add(at)
        words = dict.fromkeys(x for w in found for x in w)
        self.digits = next(d for d in itertools.count(1) if 64**d >= len(words))
        self.number = {w: "".join(chr(1 + 64 * d + i // 64**d % 64) for d in range(self.digits)) for i, w in enumerate(words)}
        self.auto = ahocorasick.Automaton() if found else None
        for w, ids in found.items():
            self.auto.add_word("".join(map(self.number.__getitem__, w)), (len(w), sorted(ids)))
        if found:
            self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Hit words of one document as a mask (empty: none), and the items found."""
        hits: list[tuple[int, int]] = []
        ids: set[int] = set()
        if self.auto is not None and words:
            for end, (n, found) in self.auto.iter("".join(map(self.number.get, words, itertools.repeat("\0" * self.digits)))):
                hits.append((end // self.digits, n))
                ids.update(found)
        if not hits:
            return np.zeros(0, bool), ids
        change = np.zeros(len(words) + 1, np.int64)
        for end, n in hits:
            change[end + 1] -= 1
            change[end + 1 - n] += 1
        return np.cumsum(change[:-1]) > 0, ids


def groups(benchmark: DataFrame, limit: int = MAX_WINDOWS) -> Iterator[list[tuple[object, str]]]:
    """The benchmark, in groups of at most `limit` words each (a single longer item is a group), one at a time."""
    group, size = [], 0
    for row in benchmark.select(F.col("item_id"), F.col("text")).where("text is not null").toLocalIterator():
        n = len(normalise(row[1]))
        if group and size + n > limit:
            yield group
            group, size = [], 0
        group.append((row[0], row[1]))
        size += n
    if group:
        yield group


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, limit: int = MAX_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids (+ `keep`).

    A null or word-free text has no words and no hits; null, empty and word-free items have no windows; equal item texts are all
    reported; a null item_id counts as the string 'null'. Repeated rows are reported
    each. A benchmark beyond `limit` words is scanned group by group, one group at a time
    on the driver and in each worker; the hits of a group are kept by document and
    united in the end.
    """
    keep = [c for c in keep or [] if c != "doc_id"]
    kept = {f"_keep_{c}": c for c in keep if c != "text"}
    base = docs.select("doc_id", "text", *[F.col(c).alias(k) for k, c in kept.items()])
    every = groups(benchmark, limit)
    parts = [next(every, []), *([x] if (x := next(every, None)) else [])]
    fields = lambda d, text: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if text or f.name != "text")
    found = ", n_words long, hits array<int>, item_ids array<string>"
    with_text = "text" in keep
    if len(parts) == 1:
        base = base.mapInArrow(_scanner(parts[0], window, with_text), fields(base, with_text) + found)
    else:
        ensure_checkpoint_dir(docs.sparkSession)
        base = base.withColumn("_key", F.xxhash64("doc_id", "text"))
        lean, hits = base.select("_key", "text"), None
        for group in itertools.chain(parts, every):
            one = lean.mapInArrow(_scanner(group, window, False), "_key long" + found).where(F.size("hits") > 0).dropDuplicates(["_key"]).select("_key", "hits", "item_ids").checkpoint()
            hits = one if hits is None else hits.unionByName(one)
        hits = hits.groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
        nothing = _scanner([], window, with_text)
        base = base.mapInArrow(nothing, fields(base, with_text) + found).drop("hits", "item_ids").join(hits, "_key", "left").drop("_key")
        base = base.withColumns({"hits": F.coalesce("hits", F.array().cast("array<int>")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    ids = F.array_sort("item_ids")
    return base.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), ids.alias("item_ids"), *(["text"] if "text" in keep else []), *[F.col(k).alias(c) for k, c in kept.items()],
    )


def _scanner(items: list[tuple[object, str]], window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(items, window)
        names = ["null" if i is None else str(i) for i, _ in items]
        for batch in batches:
            at = batch.schema.get_field_index("text")
            n_words, hits, found = [], [], []
            for text in batch.column(at):
                words = normalise(text.as_py())
                mask, ids = auto.scan(words)
                n_words.append(len(words))
                hits.append(np.flatnonzero(mask).astype(np.int32))
                found.append(sorted({names[i] for i in ids}))
            kept = [(f, c) for f, c in zip(batch.schema, batch.columns, strict=True) if with_text or f.name != "text"]
            own = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *own], names=[*[f.name for f, _ in kept], "n_words", "hits", "item_ids"])

    return run
