"""Packing documents into sequences of a fixed number of tokens.

Mixture-controlled packing: deficit round-robin over source queues. Every source is a queue of
tokens, its documents one after another in a hash order. Each window (sequence) adds its
length, times the source's target share, to every queue's credit, then serves the queues in
order of their credit, as much as they have earned but at least a grain, and takes what was
served off the credit; what a queue has earned and not got, or got too early, is carried to the
next window.

Windows are filled in packs of a few hundred, one group of bounded size each. A pack holds of
every queue the tokens whose ideal place in the mix lies in its span, so what it holds is known
from the queue's length alone; the credits at its start are what is due at its first token less
what earlier packs served, and its first window is the one that the pack before left open.
Packs so carry on from each other without waiting for each other.

Only lean rows (numbers) are windowed and grouped. The ids of a document are stored once,
compressed, and meet the document's list of pieces by a join on the row.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Tokens of a sequence, of a pack, and that a queue is served at least when its turn comes.
LENGTH = 1024
PACK = 256 * LENGTH
GRAIN = 64
#: Rows that one bucket of the prefix sums holds on average, and packs of one.
ROWS_PER_BUCKET = 4096
PACKS_PER_BUCKET = 4096
#: Bytes of text encoded at a time.
BLOCK = 4 << 20
#: Fixed value: how byte-level tokenizers part a text before they join bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A character that some version of Unicode may not class (letter, digit, blank) as others do: all but old, complete blocks.
UNSETTLED = re.compile("[^\u0000-\u017f\u0400-\u045f\u2010-\u2027\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts by a tokenizer's file.

    Where the file is a byte-level one whose merges stand in the order of their ids, the same
    ids come faster from the vocabulary as ranks; it takes the texts whose characters all Unicode
    versions class alike, and the tokenizer itself all others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ranks = self._ranked(json.loads(Path(path).read_text()))

    @staticmethod
    def _ranked(spec: dict):
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        ordinary = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not model.get("ignore_merges") and not model.get("dropout")
        if not ordinary or model.get("type", "BPE") != "BPE" or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t.get("special") for t in added):
            return None
        vocabulary, letters = model["vocab"], byte_letters()
        joined = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in joined or joined != sorted(set(joined)):
            return None
        import tiktoken

        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned numbers of `kind`."""
        fast = [self.ranks is not None and (t.isascii() or not UNSETTLED.search(t)) for t in texts]
        slow = iter(self.tokenizer.encode_batch_fast([t for t, f in zip(texts, fast, strict=True) if not f], add_special_tokens=False))
        return [np.array(self.ranks.encode(t, allowed_special="all", disallowed_special=()) if f else next(slow).ids, self.kind).tobytes() for t, f in zip(texts, fast, strict=True)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenised(docs: DataFrame, path: str, closing: int = 0) -> DataFrame:
    """(doc_id, queue, order, n, ids) of every document: n counts the closing id, ids are compressed without it."""
    kind = dict(docs.dtypes)["doc_id"]
    source = F.col("source").cast("string")
    base = docs.select("doc_id", F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("queue"), F.xxhash64("doc_id", "text").alias("order"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, small = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = batch.column(3).cast(pa.large_string()).fill_null("")
            size = np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]))
            i = 0
            while i < len(text):
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BLOCK, side="right")))
                ids = enc(text.slice(i, j - i).to_pylist())
                n = [len(x) // enc.kind.itemsize + 1 for x in ids]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(n, pa.int64()), pa.array([small.compress(x) for x in ids], pa.binary())], names=["doc_id", "queue", "order", "n", "ids"])
                i = j

    return base.mapInArrow(run, f"doc_id {kind}, queue string, order long, n long, ids binary")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _wide(c: Column) -> Column:
    """Decimals, as the products pass a long."""
    return c.cast("decimal(19,0)")


def _pack_of(at: Column, num: Column, den: Column) -> Column:
    """The pack of a queue's token: its ideal place, (at + 1/2) * den / num packs from the start."""
    return _div((2 * _wide(at) + 1) * _wide(den), 2 * _wide(num))


def _first_of(pack: Column, num: Column, den: Column) -> Column:
    """A queue's first token of a pack."""
    return _div(2 * _wide(num) * _wide(pack) + _wide(den) - 1, 2 * _wide(den))


def windows(start: int, end: int, total: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(sequence, offset, room, first token) of the parts of sequences that the tokens start..end of all tokens fill.

    All sequences are full but those of the last, less than `length` tokens, which go to
    sequences whose sizes are falling powers of two, so that nothing is padded.
    """
    full = total // length
    at = start
    while at < min(end, full * length):
        stop = min(end, (at // length + 1) * length)
        yield at // length, at % length, stop - at, at
        at = stop
    sequence, first, rest = full, full * length, total - full * length
    while rest:
        size = 1 << (rest.bit_length() - 1)
        a, b = max(first, start), min(first + size, end)
        if a < b:
            yield sequence, a - first, b - a, a
        sequence, first, rest = sequence + 1, first + size, rest - size


def deal(room: int, left: np.ndarray, share: np.ndarray, credit: np.ndarray, grain: int) -> list[tuple[int, int]]:
    """One window: (queue, tokens) in the order served; lowers `left` and moves `credit`. The queues hold at least `room` tokens."""
    has = left > 0
    credit[has] += room * share[has] / share[has].sum()
    out: dict[int, int] = {}
    while room:
        for q in np.argsort(np.where(left > 0, -credit, np.inf), kind="stable"):
            take = int(min(left[q], room, max(credit[q], grain)))
            left[q] -= take
            credit[q] -= take
            room -= take
            if take:
                out[int(q)] = out.get(int(q), 0) + take
            if not room:
                break
    return list(out.items())


def fill(table: pa.Table, total: int, length: int, grain: int) -> pa.Table:
    """One pack: its rows' tokens dealt to sequences, as arrays of pieces for each row."""
    get = lambda name: table.column(name).to_numpy()
    names, queue = np.unique(table.column("queue").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    low, size = get("low"), get("length")
    order = np.lexsort((low, queue))
    queue, low, size = queue[order], low[order], size[order]
    first = np.searchsorted(queue, np.arange(len(names)))
    begin = low[first]  # the queue's tokens that earlier packs served
    left = np.bincount(queue, weights=size, minlength=len(names)).astype(np.int64)
    num = get("num").astype(np.float64)[order][first]
    base = int(get("base")[0])
    share = num / num.sum()
    due = np.array([min(int(a), int(n)) for a, n in zip(base * (get("num")[order][first] / get("all_num")[order][first]), get("queue_size")[order][first], strict=True)], np.float64)
    credit = np.clip(due - begin, -length, length)
    taken = begin.copy()
    parts: list[list[int]] = [[] for _ in range(5)]
    for sequence, offset, room, _ in windows(base, base + int(size.sum()), total, length):
        for q, n in deal(room, left, share, credit, grain):
            for held, x in zip(parts, (q, int(taken[q]), n, sequence, offset), strict=True):
                held.append(x)
            taken[q] += n
            offset += n
    pq, pa_, pn, ps, po = (np.array(x, np.int64) for x in parts)
    order2 = np.lexsort((pa_, pq))
    pq, pa_, ps, po = pq[order2], pa_[order2], ps[order2], po[order2]
    # places inside the pack, queue after queue: cut where a window's part or a row begins
    shift = np.cumsum(left := np.bincount(queue, weights=size, minlength=len(names)).astype(np.int64)) - left
    part_at, row_at = pa_ - begin[pq] + shift[pq], low - begin[queue] + shift[queue]
    cuts = np.union1d(part_at, row_at)
    part, row = np.searchsorted(part_at, cuts, side="right") - 1, np.searchsorted(row_at, cuts, side="right") - 1
    lengths = np.diff(cuts, append=int(size.sum()))
    ends = np.searchsorted(row, np.arange(len(size) + 1))
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
    return pa.table({
        "key": table.column("key").combine_chunks().take(pa.array(order)), "start": table.column("start").combine_chunks().take(pa.array(order)),
        "lengths": lists(lengths, pa.int32()), "sequences": lists(ps[part], pa.int64()), "offsets": lists(po[part] + cuts - part_at[part], pa.int32()),
    })


def schedule(lean: DataFrame, *, weights: dict[str | None, int] | None = None, length: int = LENGTH, pack: int = PACK, grain: int = GRAIN, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(key, start, lengths, sequences, offsets) from rows (key, queue, order, n): pieces of a row's tokens from `start` on."""
    spark = lean.sparkSession
    nothing = lean.sparkSession.createDataFrame([], "key long, start long, lengths array<int>, sequences array<long>, offsets array<int>")
    per_queue = lean.groupBy("queue").agg(F.sum("n").alias("queue_size"), F.count("*").alias("_rows"))
    if weights:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("" if k is None else f"={k}", int(v))])
        per_queue = per_queue.withColumn("_w", F.coalesce(F.element_at(named, F.col("queue")), F.lit(1)).cast("long"))
    else:
        per_queue = per_queue.withColumn("_w", F.col("queue_size"))
    per_queue = per_queue.checkpoint()  # one row a source, read three times
    row = per_queue.agg(F.sum("queue_size").alias("total"), F.max("_rows").alias("rows"), F.sum("_w").alias("w")).first()
    total = row["total"]
    if not total:
        return nothing
    # a pack takes num / den tokens of a queue
    num, den = (F.col("_w") * pack, row["w"]) if weights else (F.col("_w"), max(1, -(-total // pack)))
    per_queue = per_queue.withColumn("num", num)
    den = F.lit(den).cast("long")
    n_buckets = 1 << max(0, (-(-row["rows"] // rows_per_bucket) - 1).bit_length())
    bucket = F.shiftrightunsigned("order", 64 - (n_buckets.bit_length() - 1)) if n_buckets > 1 else F.lit(0).cast("long")
    d = lean.withColumn("_b", bucket)
    sums = d.groupBy("queue", "_b").agg(F.sum("n").alias("_in"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.select("queue", "_b", F.coalesce(F.sum("_in").over(before(Window.partitionBy("queue").orderBy("_b"))), F.lit(0)).alias("_base")).join(per_queue.select("queue", "queue_size", "num"), "queue")
    d = d.withColumn("_local", F.coalesce(F.sum("n").over(before(Window.partitionBy("queue", "_b").orderBy("order", "key"))), F.lit(0)))
    d = d.join(plan, ["queue", "_b"]).withColumn("_at", F.col("_base") + F.col("_local"))
    d = d.withColumn("pack", F.explode(F.sequence(_pack_of(F.col("_at"), F.col("num"), den), _pack_of(F.col("_at") + F.col("n") - 1, F.col("num"), den))))
    d = d.withColumn("low", F.greatest(F.col("_at"), _first_of(F.col("pack"), F.col("num"), den)))
    d = d.withColumn("length", F.least(F.col("_at") + F.col("n"), _first_of(F.col("pack") + 1, F.col("num"), den)) - F.col("low")).where("length > 0")
    d = d.select("pack", "queue", "key", (F.col("low") - F.col("_at")).alias("start"), "low", "length", "queue_size", "num", F.lit(row["w"] * pack if weights else total).cast("double").alias("all_num")).checkpoint()
    per_pack = d.groupBy("pack").agg(F.sum("length").alias("_m")).withColumn("_pb", F.floor(F.col("pack") / PACKS_PER_BUCKET))
    groups = per_pack.groupBy("_pb").agg(F.sum("_m").alias("_g")).select("_pb", F.coalesce(F.sum("_g").over(before(Window.partitionBy(F.lit(0)).orderBy("_pb"))), F.lit(0)).alias("_g0"))
    bases = per_pack.withColumn("_l", F.coalesce(F.sum("_m").over(before(Window.partitionBy("_pb").orderBy("pack"))), F.lit(0))).join(groups, "_pb").select("pack", (F.col("_g0") + F.col("_l")).alias("base"))
    return d.join(bases, "pack").groupBy("pack").applyInArrow(lambda t: fill(t, total, length, grain), nothing.schema)


def pack_documents(docs: DataFrame, path: str, *, closing: int = 0, weights: dict[str | None, int] | None = None, length: int = LENGTH, pack: int = PACK, grain: int = GRAIN, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the id `closing`; every id lies in exactly one piece. All sequences
    have `length` tokens but those of the last few tokens, whose sizes are powers of two, so
    nothing is padded. A source takes part in each sequence by its share of all tokens (with
    `weights`, by whole numbers for each source, 1 where none is named; a source that has run
    out leaves its share to the others): up to any sequence, a source has been served what is
    due to it within about a grain and a pack's rounding.

    A null text is empty, a document of the closing id alone; a null source is a source; a null
    doc_id is an id like any other and repeated rows are packed each. Long texts are cut
    wherever sequences and packs end. An empty table gives no rows. Columns beyond doc_id,
    text and source are ignored. The result depends on the rows alone, not on partitions.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    # the row number is drawn once and kept; the ids are read again when the pieces are known
    tok = tokenised(docs.select("doc_id", "text", "source"), path).withColumn("key", F.monotonically_increasing_id()).checkpoint()
    pieces = schedule(tok.select("key", "queue", "order", "n"), weights=weights, length=length, pack=pack, grain=grain, rows_per_bucket=rows_per_bucket)
    pieces = pieces.groupBy("key").agg(F.collect_list(F.struct("start", "lengths", "sequences", "offsets")).alias("parts"))  # no more than a document's tokens
    both = tok.select("key", "doc_id", "n", "ids").join(pieces, "key").select("doc_id", "n", "ids", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, large = encoder(path).kind, zstandard.ZstdDecompressor()
        for batch in batches:
            parts = batch.column(3).flatten()  # of all rows, one after another
            per_row, per_part = batch.column(3).value_lengths().to_numpy(), parts.field("lengths").value_lengths().to_numpy()
            lengths = parts.field("lengths").flatten().to_numpy().astype(np.int64)
            inside = np.cumsum(lengths) - lengths
            first = np.cumsum(per_part) - per_part
            start = np.repeat(parts.field("start").to_numpy() - inside[first], per_part) + inside
            row = np.repeat(np.repeat(np.arange(batch.num_rows), per_row), per_part)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            starts, ends = (4 * start).tolist(), (4 * (start + lengths)).tolist()
            crc = []
            for i, ids in enumerate(batch.column(2)):
                raw = memoryview(np.append(np.frombuffer(large.decompress(ids.as_py()), width), closing).astype("<u4").tobytes())
                crc += [zlib.crc32(raw[starts[p] : ends[p]]) for p in range(bounds[i], bounds[i + 1])]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64()), batch.column(1).take(at), parts.field("sequences").flatten(), parts.field("offsets").flatten().cast(pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return both.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
