"""Positions against regular expressions, late interaction against all pairs, hierarchies against means over all chunks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright import queries_index
from lorewright.operators import interaction, nearest, positions, retrieval
from lorewright.plans import hierarchy

from .test_index import hits

TEXTS = ["Free software, free speech.", "free  software", "FREE SOFTWARE now", "free-software and C++ or c++x", "Ünïcode straße; ÜNÏCODE", "x_1 x 1", "", None, "software free software free software", "a.b.c a.b", ".NET x.net y .net z", "line\nbreak line break", "ends with free"]
TERMS = ["free software", "free", "software free software", "unicode", "ünïcode", "C++", "c++x", "x_1", "x", "a.b", "a.b.c", ".net", "net", "line break", "line\nbreak", "ends with", "free, ", "", "...", "nobody", "free software now", "software, free", "e"]


def stands(term, text):
    """Whether a term stands in a text between boundaries of words, as they are here."""
    if text is None or not re.search(r"\w", term):
        return False
    low, t = text.lower(), term.lower()
    word = lambda c: bool(re.match(r"\w", c))
    for m in re.finditer(f"(?={re.escape(t)})", low):
        a, b = m.start(), m.start() + len(t)
        left = word(t[0]) != (a > 0 and word(low[a - 1]))
        right = word(t[-1]) != (b < len(low) and word(low[b]))
        if left and right:
            return True
    return False


@pytest.mark.parametrize("block", [1, 512])
def test_terms_and_phrases(spark, tmp_path, block):
    r = random.Random(1)
    rows = [(i, f"d{i % 5}", t) for i, t in enumerate(TEXTS)] + [(100 + i, f"d{i % 7}", " ".join(r.choice("abc") + r.choice([" ", "  ", ", ", "-"]) + r.choice("abc") for _ in range(8))) for i in range(60)]
    terms = TERMS + ["a b", "b-c", "a, b c", "c  a", "a a a"]
    positions.store(positions.build(spark.createDataFrame(rows, "chunk_id int, doc_id string, content string"), block=block), str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate(terms)] + [(0, 99, None)], "query_id int, nth int, term string")
    got = {(x["nth"], x["chunk_id"], x["doc_id"]) for x in positions.find(asked, stored).collect()}
    assert got == {(i, c, d) for i, t in enumerate(terms) for c, d, text in rows if stands(t, text)}
    few = terms[:4] + ["free"]
    best = hits(positions.exact_terms(spark.createDataFrame([(7, few), (8, []), (9, ["nobody"])], "query_id int, terms array<string>"), stored, 6))
    want = sorted(((-sum(stands(t, x) for t in few) / len(few), c) for c, _, x in rows if any(stands(t, x) for t in few)))[:6]
    assert sorted(best, key=lambda x: x[3]) == [(7, c, -s, n) for n, (s, c) in enumerate(want, 1)]
    docs = positions.documents_with(spark.createDataFrame([(1, "free software")], "query_id int, term string"), stored).collect()
    assert {x["doc_id"] for x in docs} == {d for _, d, x in rows if stands("free software", x)}


def test_occurrences_are_shuffled_once(spark, tmp_path):
    """They had been sent by word and, as blocks, by bucket."""
    chunks = spark.createDataFrame([(i, "d", f"a b c{i}") for i in range(50)], "chunk_id int, doc_id string, content string")
    blocks = positions.build(chunks, block=8)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]
    assert len(sent) == 2  # the occurrences, and the words' counts
    positions.store(blocks, str(tmp_path))
    got = spark.read.parquet(str(tmp_path)).groupBy("word").agg(F.sum("n").alias("n"), F.max("parts").alias("parts")).where("n > 1").collect()
    assert sorted(map(tuple, got)) == [("a", 50, 7), ("b", 50, 7)]


def test_positions_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id int, doc_id string, content string")
    blocks = positions.build(none)
    assert positions.find(spark.createDataFrame([(1, 0, "a")], "query_id int, nth int, term string"), blocks).count() == 0


# -- late interaction


@pytest.mark.parametrize(("k", "block"), [(5, 2048), (3, 16), (500, 2048)])
def test_interaction_equals_all_pairs(spark, tmp_path, k, block):
    r = np.random.default_rng(2)
    centres = r.normal(size=(9, 8))
    vec = lambda: [float(x) for x in (centres[r.integers(9)] + 0.3 * r.normal(size=8)).astype(np.float32)]
    rows = [(i, [vec() for _ in range(1 + i % 7)]) for i in range(300)]
    dirty = rows + [(900, []), (901, None), (902, [[float("nan")] * 8]), (903, [[0.0] * 8]), (904, rows[5][1]), (905, [None, rows[6][1][0]])]
    c = spark.createDataFrame(dirty, "chunk_id int, vectors array<array<float>>")
    q = spark.createDataFrame([(i, [vec() for _ in range(1 + i % 4)]) for i in range(12)] + [(50, None), (51, [])], "query_id int, query_vectors array<array<float>>")
    index = interaction.build(c, str(tmp_path), block=block)
    clean = interaction.clean(c, "vectors")
    want = hits(retrieval.late_interaction(q.where("query_id < 50"), clean, 10_000).drop("rank").withColumn("score", F.round("score", 8)).transform(lambda d: retrieval.top_k(d, k)))
    assert hits(interaction.search(q, index, k, digits=8)) == want
    assert hits(interaction.search(q, interaction.load(spark, str(tmp_path)), k, digits=8)) == want
    assert interaction.search(q.limit(0), index).count() == 0


def test_interaction_scores_of_blocks_and_their_best(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(4)
    q, d = r.normal(size=(6, 5)), r.normal(size=(20, 5))
    q[1], d[3], d[7] = 0, 0, d[2]
    first, start = np.array([0, 1, 4]), np.array([0, 3, 4, 9])
    one = lambda x, y: 0.0 if not x.any() or not y.any() else float(nearest.dots(x[None], y[None])[0] / (nearest.lengths(x[None])[0] * nearest.lengths(y[None])[0]))
    want = np.array([[sum(max(one(x, y) for y in b) for x in a) for b in np.split(d, start[1:])] for a in np.split(q, first[1:])])
    assert np.abs(interaction.products(q, first, d, start) - want).max() < nearest.ERROR
    who, at = np.nonzero(want > -9)
    assert (interaction.scored(q, first, d, start, who, at) == want[who, at]).all()
    # far from their centres no chunk is out by its bounds: all 40,000 pairs had been joined with their vectors and sorted
    rows = [(i, [[float(x) for x in r.normal(size=6)] for _ in range(2)]) for i in range(2000)]
    c = spark.createDataFrame(rows, "chunk_id int, vectors array<array<double>>")
    ranked = []
    monkeypatch.setattr(interaction, "top_k", lambda h, k: (ranked.append(h.count()), retrieval.top_k(h, k))[1])
    got = interaction.search(c.where("chunk_id < 20").withColumnsRenamed({"chunk_id": "query_id", "vectors": "query_vectors"}), interaction.build(c, str(tmp_path), rounds=1), 5)
    assert hits(got) == hits(retrieval.late_interaction(c.where("chunk_id < 20").withColumnsRenamed({"chunk_id": "query_id", "vectors": "query_vectors"}), c, 5))
    assert ranked[0] <= 20 * 5 * 4


def test_interaction_bounds():
    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    c, d, q = unit(r.normal(size=(4, 6))), unit(r.normal(size=(30, 6))), unit(r.normal(size=(5, 6)))
    cell = np.argmax(d @ c.T, axis=1)
    far = np.linalg.norm(d - c[cell], axis=1)
    low, high = interaction.bounds(q @ c.T, np.array([0, 2]), cell.astype(np.int32), far, np.full(10, 3))
    score = np.add.reduceat((q @ d.T).reshape(5, 10, 3).max(axis=2), [0, 2], axis=0)
    assert (low <= score + 1e-12).all() and (score <= high + 1e-12).all()


# -- hierarchy


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, doc_title string, header_path string, seq int, content string")


def test_hierarchy_of_changed_documents_equals_one_built_at_once(spark):
    r = random.Random(5)
    row = lambda d, i, v: (f"{d}_{i}", d, f"Title {d}", None if i == 3 else f"S{i % 3} > part {i}", i, f"text {v} {d} {i} " + "x" * 400)
    new = [row(d, i, "new") for d in "abc" for i in range(12)]
    old = [row(d, i, "old") for d in "bcd" for i in range(7)]
    vectors = {c: [r.random() for _ in range(4)] for c in {x[0] for x in new + old} if not c.endswith("_5")}
    v = spark.createDataFrame(list(vectors.items()), "chunk_id string, embedding array<double>")
    held = hierarchy.states(chunks(spark, old), v)
    now = hierarchy.updated(held, chunks(spark, new), v, spark.createDataFrame([("d",)], "doc_id string"))
    docs, sections = (sorted(map(tuple, x.collect())) for x in hierarchy.summaries(now))
    at_once = sorted(map(tuple, hierarchy.summaries(hierarchy.states(chunks(spark, new), v))[0].collect()))
    assert [x[:5] for x in docs] == [x[:5] for x in at_once]
    assert [(d[0], d[1], d[2]) for d in docs] == [(d, f"Title {d}", 12) for d in "abc"]
    mean = lambda ids: np.mean([vectors[i] for i in ids if i in vectors], axis=0)
    for d in docs:
        mine = [x for x in new if x[1] == d[0]]
        assert np.allclose(d[5], mean([x[0] for x in mine]))
        assert d[3] == f"Documento: Title {d[0]}. " + " ".join(x[5][:100] for x in mine[:3])
        assert d[4] == [x[3] for x in mine if x[3]]
    assert len(sections) == 9
    for s in sections:
        mine = [x for x in new if x[1] == s[0] and (x[3] or "").startswith(s[2] + " >")]
        assert s[3] == len(mine) and np.allclose(s[6], mean([x[0] for x in mine]))
        assert s[4] == f"Sección: {s[2]}. " + mine[0][5][:200]


def test_hierarchy_with_a_provider_and_without_vectors(spark):
    rows = [("a_0", "a", "T", "S > x", 0, "hello"), ("a_1", "a", "T", "", 1, None), ("b_0", "b", None, "Q", 0, "there"), ("n", None, "T", "S", 0, "no document")]
    none = spark.createDataFrame([], "chunk_id string, embedding array<double>")
    d, s = hierarchy.summaries(hierarchy.states(chunks(spark, rows), none), provider=lambda p: [None if "there" in x else f"said {len(x) > 0}" for x in p])
    assert sorted((x["doc_id"], x["summary"], x["embedding"]) for x in d.collect()) == [("a", "said True", None), ("b", "Documento: . there", None)]
    assert sorted((x["doc_id"], x["section"], x["summary"]) for x in s.collect()) == [("a", "S", "said True"), ("b", "Q", "Sección: Q. there")]
    empty = hierarchy.summaries(hierarchy.states(chunks(spark, []), none))
    assert empty[0].count() == empty[1].count() == 0


def test_means_below_zero_keep_their_sign(spark, tmp_path):
    """As round() of DuckDB: -0.0 for a mean just below zero."""
    d = [(0, "s", "en", "a"), (1, "s", "en", "b"), (2, "r", "en", "c")]
    spark.createDataFrame(d, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [-2e-7, 2e-7, 0.5]), (1, [-4e-7, 2e-7, -0.25]), (2, [0.0, -0.0000126, 1.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["doc_id"]: repr(list(r["embedding"])) for r in queries_index.ret14_hierarchy_documents(spark, str(tmp_path)).collect()}
    assert got == {"s": "[-0.0, 0.0, 0.125]", "r": "[0.0, -1.3e-05, 1.0]"}


def test_two_searches_share_one_index(spark, monkeypatch):
    """The made-up answers ask the same index as the questions, and its postings are not stored."""
    built, real = [], retrieval.lexical_index
    monkeypatch.setattr(retrieval, "lexical_index", lambda c: built.append(real(c)) or built[-1])
    cuts = []
    monkeypatch.setattr(queries_index, "cut", lambda d: cuts.append(d.columns) or d)
    assert queries_index.ret11_hypothetical(spark, "/root/testdata/sf0.001").count() > 0
    assert len(built) == 1 and "tf" not in sum(cuts, [])
