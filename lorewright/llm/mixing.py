"""Mixing sources to target weights (DataFrame functions only).

A time-varying curriculum. Every source s has a weight schedule over training
time u in [0, 1], proportional to 1 + slope_s * (u - 1/2); its integral, scaled to
the source's target, is the cumulative token demand D_s(u). Documents of a source
are laid out one after another in a fixed pseudo-random order (as often as the
target asks, up to twice); the middle of the tokens that a pass over a document
fills, put through the inverse of D_s, is its training position, and the result is
range-sorted by the first position.

Prefix sums are two-level (bucket of the hash order, then inside the bucket), so a
source that holds a third of all rows is spread over as many tasks as there are
buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: The weights dealt to the sources in code point order.
WEIGHTS = (5, 2, 1)
#: Schedule slope for each of the weights: heavy sources come earlier, light ones later.
SLOPES = (-0.8, 0.0, 0.8)
#: Rows that one bucket of the prefix sums holds on average.
ROWS_PER_BUCKET = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    """60 bits of a digest of id and source: the order of documents inside their source."""
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """(source, source_size) -> source, source_size, weight, slope, target.

    target = min(2 * source_size, level * weight), with the one level at which the
    targets add up to 150 % of all sizes: stopping a source at its cap and resharing
    the excess by weight ends there. The sources stand in order of cap / weight and
    the first whose own level does not exceed its ratio fixes the level.
    """
    n = len(weights)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("i") % n + 1).cast("int"))
    s = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", pick(weights).cast("long")).withColumn("slope", pick(slopes))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "i")
    everything = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", (3 * F.sum("source_size").over(everything) - 4 * F.col("cap_before")) / (2 * F.col("weight_from")))
    ok = F.col("level") <= 2 * F.col("source_size") / F.col("weight")
    s = s.withColumn("top", F.min(F.when(ok, F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("i"), F.col("level").alias("v")))).over(everything))
    target = F.least((2 * F.col("source_size")).cast("double"), F.coalesce(F.col("top.v"), F.lit(0.0)) * F.col("weight"))
    return s.select("source", "source_size", "weight", "slope", target.alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, *, keep: list[str] | None = None, seed: int = 7, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_position, second_position (+ `keep`).

    `taken` counts words with repeats: whole passes over the source and, in the last
    one, the documents in order until the target is met, the one on the border in
    part. So a source's taken words differ from its target by less than one word, and
    no document exceeds twice its size. Order and result depend on the rows alone.

    Nulls: a null text has size 0 and is taken 0 times; null is a source of its own,
    after all others; a null doc_id is an id like any other. Repeated rows are mixed
    each on its own. Empty texts and empty tables give size 0 and no rows. Columns of
    `docs` beyond doc_id, text, source and `keep` are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    keep = [c for c in keep or [] if c not in ("doc_id",)]
    # sizes are used four times; the checkpoint keeps the texts from being read again
    d = docs.select("doc_id", F.col("source").alias("_source"), n_words(F.col("text")).alias("size"), order_key(seed).alias("_h"), *[F.col(c).alias(f"_keep_{c}") for c in keep]).checkpoint()
    lean = d.select("_source", "size", "_h")
    # one counted number sets how finely the hash order is cut
    per_source = lean.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    most = per_source.agg(F.max("_rows")).first()[0] or 1
    n_buckets = 1 << max(0, (-(-most // rows_per_bucket) - 1).bit_length())
    bits = n_buckets.bit_length() - 1
    bucket = F.shiftright("_h", 60 - bits)
    per_bucket = lean.withColumn("_b", bucket).groupBy("_source", "_b").agg(F.sum("size").alias("_in"))
    sums = per_bucket.select("_source", "_b", F.coalesce(F.sum("_in").over(Window.partitionBy("_source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    targets = source_targets(per_source.select(F.col("_source").alias("source"), "source_size"), weights, slopes).withColumnRenamed("source", "_s")
    plan = sums.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).select(F.col("_source").alias("_ps"), F.col("_b").alias("_pb"), "_base", "source_size", "slope", "target")
    inside = Window.partitionBy("_source", "_b").orderBy("_h", "size", *[F.col(f"_keep_{c}") for c in keep]).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_b", bucket).withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(plan, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb")))
    at = F.col("_base") + F.col("_local")
    want = F.round("target").cast("long")
    size = F.col("size")
    passed = lambda k: F.greatest(F.lit(0), F.least(size, want - k * F.col("source_size") - at))
    d = d.withColumn("_one", passed(0)).withColumn("_two", passed(1)).withColumn("taken", F.col("_one") + F.col("_two"))
    x = lambda k, took: (k * F.col("source_size") + at + took / 2) / F.greatest(want, F.lit(1))
    return d.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(F.col("_one") > 0, invert(x(0, F.col("_one")), F.col("slope"))).alias("first_position"),
        F.when(F.col("_two") > 0, invert(x(1, F.col("_two")), F.col("slope"))).alias("second_position"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def invert(x: Column, slope: Column) -> Column:
    """The time u at which a share x of the demand is met: x = u + slope * (u**2 - u) / 2."""
    b = 1 - slope / 2
    root = F.sqrt(b * b + 2 * slope * x)
    return F.when(F.abs(slope) < 1e-9, x).otherwise((root - b) / slope)
