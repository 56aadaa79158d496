"""Fill-in-middle transformation.

Run-length class encoding. The class of a character is the number of bytes that it takes in
UTF-8. A text is encoded once as its maximal runs of characters of one class, each with the
number of units (code points) and of bytes before it. A cut before a unit is then a binary
search for the run that holds the unit, and its byte offset is arithmetic inside that run,
so a text can be cut again under other seeds without being read. Plain ASCII is one run.

Encoding is an Arrow function over blocks of texts; cutting, joining and restoring are
DataFrame functions on bytes. Nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_blocks

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts: so many are transformed, and of those so many with the suffix first.
RATE = 90
SUFFIX_FIRST = 20
#: Steps of the binary search; a text has fewer than 2**31 bytes, so fewer runs.
STEPS = tuple(1 << b for b in range(30, -1, -1))
RUNS = T.StructType([T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("units", "bytes")])


def encode_block(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units and bytes before each run of each text, closed by the text's totals; and where each text's entries begin."""
    first = (data & 0xC0) != 0x80
    first[off[:-1][np.diff(off) > 0]] = True  # a text begins a unit, whatever its bytes
    at = np.flatnonzero(first)
    width = np.diff(at, append=len(data))
    unit0 = np.searchsorted(at, off)  # each text's first unit
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = width[1:] != width[:-1]
    opens[unit0[:-1][np.diff(unit0) > 0]] = True
    run = np.flatnonzero(opens)
    text = np.searchsorted(unit0, run, side="right") - 1
    run0 = np.searchsorted(run, unit0)
    n = len(off) - 1
    units, size = np.zeros(len(run) + n, np.int32), np.zeros(len(run) + n, np.int32)
    place, last = np.arange(len(run)) + text, run0[1:] + np.arange(n)
    units[place], size[place] = run - unit0[text], at[run] - off[text]
    units[last], size[last] = np.diff(unit0), np.diff(off)
    return units, size, run0 + np.arange(n + 1)


@F.arrow_udf(RUNS)
def runs(text: pa.Array) -> pa.Array:
    units, size, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for _, _, data, off in text_blocks(text):
        u, s, e = encode_block(data, off)
        units.append(u)
        size.append(s)
        ends.append(e[1:] + ends[-1][-1])
    at = pa.array(np.concatenate(ends), pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (units, size)], names=["units", "bytes"])


def offset(encoded: Column, unit: Column) -> Column:
    """The byte before which `unit` begins (the text's size for its number of units): binary search, then arithmetic in the run."""
    units, size = encoded["units"], encoded["bytes"]
    n = F.size(units) - 1
    step = lambda p, s: F.when((p + s < n) & (F.get(units, p + s) <= unit), p + s).otherwise(p)
    found = F.aggregate(F.array(*[F.lit(s) for s in STEPS]), F.lit(0), step)
    inside = lambda p: F.get(size, p) + (unit - F.get(units, p)) * ((F.get(size, p + 1) - F.get(size, p)) / (F.get(units, p + 1) - F.get(units, p))).cast("int")
    # one element, so that the search is written once
    return F.when(n > 0, F.get(F.transform(F.array(found), inside), F.lit(0))).otherwise(0).cast("int")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    overlap = any(a[i:] and b.startswith(a[i:]) for a in markers for b in markers for i in range(1, len(a)))
    if overlap or not all(markers) or len({*markers}) < 3 or any(a != b and a in b for a in markers for b in markers):
        raise ValueError("markers must be three texts none of which begins inside another or ends in one's beginning")
    return markers


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from which `output` was made."""
    part = F.split(output, "|".join(re.escape(m) for m in _checked(markers)))
    of = lambda *order: F.concat(*[F.get(part, F.lit(i)) for i in order])
    return F.when(form == "psm", of(1, 3, 2)).when(form == "spm", of(2, 3, 1)).otherwise(output)


def encode(docs: DataFrame) -> DataFrame:
    """`docs` with their encoding in the column `runs` (a null text counts as empty), for `cut`. The column must not be there yet."""
    return docs.withColumn("runs", runs(F.col("text")))


def cut(encoded: DataFrame, *, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS, keep: list[str] | None = None) -> DataFrame:
    """As `fill_in_middle`, of documents that `encode` encoded before."""
    keep = [c for c in keep or [] if c != "doc_id"]
    p, s, m = (F.lit(x.encode()) for x in _checked(markers))
    text = F.coalesce(F.col("text"), F.lit(""))
    d = encoded.select("doc_id", text.alias("_text"), F.col("runs").alias("_runs"), F.element_at(F.col("runs")["units"], -1).cast("long").alias("n"), *[h.alias(f"_h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))], *[F.col(c).alias(f"_keep_{c}") for c in keep])
    a, b = F.col("_h0") % (F.col("n") + 1), F.col("_h1") % (F.col("n") + 1)
    marked = F.lit(False)
    for x in markers:
        marked = marked | F.contains(F.col("_text"), F.lit(x))
    plain = (F.col("n") == 0) | (F.col("_h2") % 100 >= rate) | marked
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < suffix_first, "spm").otherwise("psm")
    d = d.withColumns({"_a": F.least(a, b).cast("int"), "_b": F.greatest(a, b).cast("int"), "form": form})
    d = d.withColumns({"_x": offset(F.col("_runs"), F.col("_a")), "_y": offset(F.col("_runs"), F.col("_b")), "_bytes": F.col("_text").cast("binary")})
    bits = lambda start, length: F.substring(F.col("_bytes"), start + 1, length)
    prefix, middle, suffix = bits(F.lit(0), F.col("_x")), bits(F.col("_x"), F.col("_y") - F.col("_x")), bits(F.col("_y"), F.octet_length("_text") - F.col("_y"))
    out = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("_bytes"))
    chars = lambda x: F.when(F.col("form") != "plain", x.cast("long"))
    return d.select("doc_id", "n", "form", chars(F.col("_a")).alias("prefix_chars"), chars(F.col("_b") - F.col("_a")).alias("middle_chars"), out.cast("string").alias("output"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n (code points), form, prefix_chars, middle_chars, output (+ `keep`).

    Two cuts drawn from seed and id part a text into prefix, middle and suffix. form is `psm`
    (prefix, suffix, middle in the output), `spm` (suffix first) or `plain` (the text as it is:
    it is empty, holds a marker, or isn't drawn); the lengths are null where it is plain.

    A null text counts as empty; a null id draws as an empty one; rows with one id are cut
    at the same shares of their draws, each on its own text; texts of any length are cut whole
    by code points, so combining marks may be parted from their letters. An empty table gives
    an empty one. Columns beyond doc_id, text and `keep` are ignored, whatever their names.
    """
    keep = [c for c in options.get("keep") or [] if c not in ("doc_id", "text")]
    hidden = docs.select("doc_id", "text", *[F.col(c).alias(f"_own_{c}") for c in keep])
    out = cut(encode(hidden), **(options | {"keep": [f"_own_{c}" for c in keep]}))
    return out.select(*out.columns[:6], *[F.col(f"_own_{c}").alias(c) for c in keep])
