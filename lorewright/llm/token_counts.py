"""Exact token counts.

Every whole text is encoded once; documents are aggregated by encoded length into an
exact histogram, and suffix sums over it answer, for every context limit at once, how
many tokens there are in all, how many documents are longer, how many tokens are left
when each document is cut at the limit, and which quantile the limit is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Lengths that one task of the suffix sums holds.
SPAN = 4096
_KEPT: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    """The byte-pair encoder of a file with a base-64 token and its rank a line; kept by the worker."""
    if (path, pattern) not in _KEPT:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _KEPT[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _KEPT[path, pattern]


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null and empty texts have 0."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """n_tokens -> n_docs, and by suffix sums docs_at_least, tokens_at_least, truncated_total, cut_tokens, quantile.

    One row per length that occurs. For a context limit of n_tokens: truncated_total is
    what all documents hold when each is cut there, cut_tokens what is lost, quantile the
    share of documents no longer than it. A limit between two rows has truncated_total =
    the total - tokens_at_least + limit * docs_at_least of the next row. Repeated rows
    count each; an empty table gives no rows. The sums are two-level, so that no task holds
    more than `SPAN` lengths.
    """
    ensure_checkpoint_dir(counts.sparkSession)
    # the histogram is read twice below; the checkpoint keeps the texts from being encoded twice
    h = counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).checkpoint().withColumn("_b", F.floor(F.col("n_tokens") / SPAN))
    h = h.withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    per = h.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_s"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    per = per.select("_b", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_s").over(later), F.lit(0)).alias("_s0"), F.sum("_d").over(whole).alias("_docs"), F.sum("_s").over(whole).alias("_all"))
    up = Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.join(per, "_b").withColumn("docs_at_least", F.sum("n_docs").over(up) + F.col("_d0")).withColumn("tokens_at_least", F.sum("_t").over(up) + F.col("_s0"))
    cut = F.col("tokens_at_least") - F.col("docs_at_least") * F.col("n_tokens")
    return h.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("_all") - cut).alias("truncated_total"), cut.alias("cut_tokens"), (1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("_docs")).alias("quantile"))


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The length histogram of documents under one encoder; see `lengths` and `length_histogram`."""
    return length_histogram(lengths(docs, path, pattern).select("n_tokens"))
