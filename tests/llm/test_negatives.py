"""Hard negatives against a version over all pairs, in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import negatives


def brute(rows, is_anchor, scale=256, n_pos=5, n_neg=5, low=80, high=100):
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    exact = lambda x: math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale
    v = [(i, l, [exact(x) for x in e]) for i, l, e in rows if i is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, label, q in {(i, l, tuple(q)) for i, l, q in v if is_anchor(i)}:
        scored = [(clamp(sum(x * y for x, y in zip(q, w, strict=True))), j, m) for j, m, w in v if j != i and len(w) == len(q)]
        best = sorted((-s, j) for s, j, m in scored if m == label)[:n_pos]
        for s, j in best:
            inside = sorted((-t, k) for t, k, m in scored if m != label and low * -s <= 100 * t <= high * -s)[:n_neg]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, kind="float", **options):
    d = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumns({"q": F.lit(1), "key": F.lit(2), "score": F.lit("x"), "_anchor": F.lit(True)})
    got = negatives.hard_negatives(d, F.col("vec_id") % 5 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, dims, seed, labels=4):
    r = np.random.default_rng(seed)
    centre = r.normal(size=dims)
    x = (centre + r.normal(size=(n, dims))).astype(np.float32)
    return [(i, int(r.integers(labels)), [float(v) for v in x[i]]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"block": 16, "anchors": 4, "cells": 4}, {"cells": 1}, {"positives": 2, "negatives": 9, "low": 50, "high": 120}])
def test_against_all_pairs(spark, options):
    rows = vectors(300, 12, 1)
    names = {"positives": "n_pos", "negatives": "n_neg", "low": "low", "high": "high"}
    want = brute(rows, lambda i: i % 5 == 0, **{names[k]: v for k, v in options.items() if k in names})
    assert len(want) > 500 and run(spark, rows, **options) == want


def test_odd_rows(spark):
    rows = vectors(80, 3, 2, 2)
    rows += [(80, None, [1.0, 2.0, 3.0]), (81, 1, None), (85, 1, [1.0, None, 2.0]), (90, 1, [float("nan"), 0.0, 0.0]), (95, 0, [float("inf"), 0.0, 0.0]), (None, 1, [1.0, 1.0, 1.0])]
    rows += [(100, 0, []), (101, 0, []), (102, 1, []), (105, 0, [0.0, 0.0, 0.0]), (106, 0, [0.0] * 3), (107, 1, [0.0] * 3), (110, 9, [1.0] * 3), (115, 0, [1.0, 2.0])]
    rows += [rows[5], rows[5], rows[7], (10, 1, [0.5, 0.25, 1.0]), (0, rows[0][1], rows[0][2])]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_ties(spark):
    r = random.Random(3)
    rows = [(i, i % 3, [float(r.randrange(2)) for _ in range(4)]) for i in range(120)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert want and run(spark, rows, block=8) == want


def test_components_near_a_doubles_largest(spark):
    rows = vectors(40, 2, 5, 2)
    rows += [(45, 0, [1e308, -1e308]), (46, 0, [1.7e308, 1e308]), (47, 1, [1e300, 1.5]), (50, 1, [1e15, 3.25]), (51, 1, [1e15, 3.5]), (52, 0, [1e15, 3.125]), (55, 0, [3e4, 1.0]), (56, 0, [4e4, 1.0]), (57, 1, [3.7e4, 2.0])]
    assert run(spark, rows, "double") == brute(rows, lambda i: i % 5 == 0)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0]), (5, 2, [1.0])]) == []


def test_bounds_hold():
    r = np.random.default_rng(4)
    q = r.integers(-50, 50, (6, 500)).astype(float)
    cell, lows, highs = negatives.cells_of(q, 8)
    place = cell.astype(np.int32) + (np.arange(6, dtype=np.int32) * lows.shape[1])[:, None]
    for j in range(20):
        least, most = negatives.bounds(q[:, j], place, lows, highs)
        score = q[:, j] @ q
        assert (least <= score).all() and (score <= most).all()
