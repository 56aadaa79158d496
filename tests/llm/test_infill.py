"""Fill-in-middle against a version by Python's own slices."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import infill

from .conftest import prose


def brute(doc_id, text, seed=1, rate=90, first=20, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in markers) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, s, m = markers
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    psm = h[3] % 100 >= first
    return doc_id, n, "psm" if psm else "spm", a, b - a, p + prefix + s + suffix + m + middle if psm else s + suffix + p + prefix + m + middle


MIXED = ["é" * 50 + "a" * 7, "aé" * 40, "日本語 text 日本" * 9, "\U0001f600a\U0001f600\U0001f600é" * 11, "a<P>b", "a<S", "P><M", "<<S>>", "<", "é" * 20, "x", "\r\n", "日", "\U0001f600"]


def key(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("options", [{}, {"seed": 7, "rate": 100, "suffix_first": 50}, {"rate": 0}, {"markers": ("[pre]", "[suf]", "[mid]")}])
def test_against_slices(frame, nasty, options):
    docs, rows = nasty
    rows = rows + [(100 + i, t) for i, t in enumerate(MIXED)] + [(200 + i, prose(i, 1 + i % 9) + MIXED[i % len(MIXED)]) for i in range(60)]
    got = infill.fill_in_middle(frame(rows), **options)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    names = {"seed": "seed", "rate": "rate", "suffix_first": "first", "markers": "markers"}
    want = [brute(r[0], r[1], **{names[k]: v for k, v in options.items()}) for r in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    back = got.select("doc_id", infill.restore(F.col("output"), F.col("form"), options.get("markers", infill.MARKERS)).alias("t")).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_one_encoding_many_cuts(frame):
    rows = [(i, prose(i, 30) + MIXED[i % len(MIXED)]) for i in range(40)]
    encoded = infill.encode(frame(rows))
    for seed in (1, 2, 3):
        got = sorted(map(tuple, infill.cut(encoded, seed=seed).collect()))
        assert got == sorted(brute(*r, seed=seed) for r in rows)


def test_empty_keep_and_clashes(frame, nasty):
    assert infill.fill_in_middle(frame([])).count() == 0
    docs = nasty[0].withColumns({"n": F.lit(1), "form": F.lit("x"), "runs": F.lit(2), "output": F.lit(3), "_text": F.lit(4)})
    assert infill.fill_in_middle(docs).count() == docs.count()
    kept = infill.fill_in_middle(nasty[0], keep=["lang", "source", "doc_id"])
    assert kept.columns[-2:] == ["lang", "source"] and kept.where("lang = 'en'").count() == nasty[0].where("lang = 'en'").count()


def test_runs_are_maximal():
    text = ["aaéé日", "", "bb", "é"]
    data = [t.encode() for t in text]
    off = np.cumsum([0, *map(len, data)])
    units, size, ends = infill.encode_block(np.frombuffer(b"".join(data), np.uint8), off)
    assert [units[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [[0, 2, 4, 5], [0], [0, 2], [0, 1]]
    assert [size[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [[0, 2, 6, 9], [0], [0, 2], [0, 2]]


def test_markers_that_could_be_mistaken():
    for bad in (("<P", "P>", "M"), ("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "a", "c")):
        with pytest.raises(ValueError):
            infill.restore(F.lit(""), F.lit("psm"), bad)
