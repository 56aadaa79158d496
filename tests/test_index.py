"""Stored indexes: segments against a rebuild, blocks by impact against a scan, cells against all vectors."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewright.operators import cells, lineage, postings, retrieval
from lorewright.plans import library, segments
from lorewright.streaming import jobs

WORDS = [f"w{i}" for i in range(300)]


def text(r: random.Random, n: int) -> str:
    return " ".join(WORDS[min(int(r.paretovariate(0.7)) - 1, 299)] for _ in range(n))


def hits(df):
    return sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(9)
    return spark.createDataFrame([(i, text(r, 6)) for i in range(25)] + [(90, None), (91, ""), (92, "unheard of")], "query_id int, query string")


# -- segments


def rebuilt(spark, held: dict, asked):
    c = spark.createDataFrame([(k, v) for k, v in held.items()], "chunk_id string, content string")
    full = retrieval.lexical_index(c)
    return full, hits(retrieval.bm25(asked, full, 5, digits=6))


@pytest.mark.parametrize("fanout", [2, 3])
def test_segments_equal_a_rebuild(spark, tmp_path, asked, fanout):
    r = random.Random(fanout)
    index, held, levels = segments.open_index(spark, str(tmp_path / "i"), segments.whole_documents, fanout), {}, set()
    for _ in range(5):
        given = {f"d{r.randrange(60)}": text(r, r.randrange(1, 40)) for _ in range(25)} | {k: held[k] for k in list(held)[:4]}
        gone = {f"d{r.randrange(60)}" for _ in range(6)} | {"nobody"}
        docs = spark.createDataFrame([*given.items(), (None, "x"), ("d0", None)], "doc_id string, text string")
        report = index.update(docs, spark.createDataFrame([(x,) for x in gone], "doc_id string"))
        want = {"new": sum(k not in held for k in given), "changed": sum(k in held and held[k] != v for k, v in given.items()), "unchanged": sum(held.get(k) == v for k, v in given.items()), "deleted": sum(k in held and k not in given for k in gone)}
        assert report == want
        held = {k: v for k, v in held.items() if k not in gone} | given
        levels |= {x["level"] for x in index.manifest()}
    full, best = rebuilt(spark, held, asked)
    index = segments.open_index(spark, str(tmp_path / "i"), segments.whole_documents, fanout)  # as another session finds it
    assert max(levels) >= 1 and len(index.manifest()) <= 2 * fanout
    counts = index.counts()
    assert sorted(map(tuple, counts["df"].select("term", "df").collect())) == sorted(map(tuple, full["df"].collect()))
    assert tuple(counts["corpus"].first()) == tuple(full["corpus"].first())
    assert sorted((x["doc_id"], x["content"]) for x in index.live("chunks").collect()) == sorted(held.items())
    assert hits(index.search(asked, 5, digits=6)) == best == hits(retrieval.bm25(asked, index.lexical(), 5, digits=6))


def test_a_batch_that_failed_leaves_the_index_as_it_was(spark, tmp_path, asked):
    index = segments.open_index(spark, str(tmp_path), segments.whole_documents)
    docs = spark.createDataFrame([("a", "w1 w2"), ("b", "w2 w3")], "doc_id string, text string")
    index.update(docs)
    before = hits(index.search(asked, 5, digits=6))
    more = spark.createDataFrame([("c", "w1 w1 w1"), ("a", "w9")], "doc_id string, text string")
    broken = segments.open_index(spark, str(tmp_path), segments.whole_documents)
    broken._commit = lambda segments_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        broken.update(more)
    again = segments.open_index(spark, str(tmp_path), segments.whole_documents)
    assert hits(again.search(asked, 5, digits=6)) == before
    assert again.update(more) == {"new": 1, "changed": 1, "unchanged": 0, "deleted": 0}
    assert hits(again.search(asked, 5, digits=6)) == rebuilt(spark, {"a": "w9", "b": "w2 w3", "c": "w1 w1 w1"}, asked)[1]


def test_an_index_may_be_emptied(spark, tmp_path):
    index = segments.open_index(spark, str(tmp_path), segments.whole_documents, 2)
    docs = spark.createDataFrame([("a", "w1 w2"), ("b", "w2")], "doc_id string, text string")
    assert index.update(docs)["new"] == 2
    assert index.update(docs)["unchanged"] == 2 and len(index.manifest()) == 1
    assert index.update(docs.limit(0), docs.select("doc_id"))["deleted"] == 2
    assert index.counts()["df"].count() == 0 and index.live("chunks").count() == 0
    assert index.search(spark.createDataFrame([(1, "w1")], "query_id int, query string")).count() == 0
    assert index.update(docs)["new"] == 2


def test_a_library_of_segments_answers_like_one_built_at_once(spark, tmp_path):
    body = lambda i: f"# Tema {i}\n" + f"El algoritmo de Shor y el qubit {i} tratan cosas número{i} distintas{i} de historia{i}. " * 6
    rows = [(f"d{i}", f"Libro {i}", body(i)) for i in range(6)]
    schema = "doc_id string, doc_title string, text string"
    index = segments.open_index(spark, str(tmp_path), fanout=2)
    index.update(spark.createDataFrame(rows[:3] + [("d5", "Libro 5", body(50))], schema))
    index.update(spark.createDataFrame(rows[3:], schema))
    index.update(spark.createDataFrame([], schema), spark.createDataFrame([("d1",)], "doc_id string"))
    whole = library.index(spark.createDataFrame([x for x in rows if x[0] != "d1"], schema), dedup_scope=None)
    part = index.library()
    q = spark.createDataFrame([(0, "algoritmo de Shor número4"), (1, "historia3 del qubit")], "query_id int, query string")
    key = lambda lib: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in library.retrieve(q, lib, 4, vector_least=0.1).collect())
    assert key(part) == key(whole) and len(key(part)) == 8
    for table in ("nodes", "edges"):
        assert sorted(map(str, getattr(part, table).collect())) == sorted(map(str, getattr(whole, table).collect()))


def test_a_stream_of_files_grows_the_index(spark, tmp_path):
    src, path = tmp_path / "in" / "lib", str(tmp_path / "index")
    src.mkdir(parents=True)
    body = lambda w: f"# Tema\n" + f"Esta sección trata de {w} y de otras materias parecidas con bastante detalle. " * 4  # noqa: E731,F541
    run = lambda: jobs.ingest_index(jobs.read_files(spark, str(src)), path, str(tmp_path / "cp")).awaitTermination()
    (src / "a.md").write_text(body("fotones"))
    (src / "b.md").write_text(body("espejos"))
    run()
    run()
    first = segments.open_index(spark, path)
    assert len(first.manifest()) == 1 and first.live("documents").count() == 2
    (src / "c.md").write_text(body("lentes"))
    run()
    index = segments.open_index(spark, path)
    q = spark.createDataFrame([(1, "lentes"), (2, "fotones")], "query_id int, query string")
    found = {(r["query_id"], r["chunk_id"]) for r in index.search(q, 3).collect()}
    assert {k for k, _ in found} == {1, 2} and len(index.manifest()) == 2


# -- blocks by impact


@pytest.fixture(scope="module")
def mixed(spark):
    """Chunks of common words, some with rare ones, and queries of both."""
    r = random.Random(4)
    line = lambda n: " ".join(f"c{min(int(r.paretovariate(0.8)), 40)}" for _ in range(n))
    rows = [(i, f"{line(r.randrange(1, 60))} {f'r{r.randrange(150)} ' * r.randrange(3)}") for i in range(2000)] + [(3000, None), (3001, "")]
    asked = [(i, f"r{i} r{i + 70} c1 c2 c{3 + i % 5}") for i in range(20)] + [(50, "c1 c2 c3"), (51, "c1"), (52, "r5"), (53, None), (54, ""), (55, "unheard")]
    c = spark.createDataFrame(rows, "chunk_id int, content string")
    return retrieval.lexical_index(c), spark.createDataFrame(asked, "query_id int, query string")


@pytest.mark.parametrize(("block", "k"), [(8, 5), (64, 1), (8, 3000)])
def test_blocks_equal_a_scan_and_are_skipped(spark, tmp_path, mixed, block, k):
    full, asked = mixed
    n = full["corpus"].first()
    postings.store(postings.to_blocks(full["postings"].withColumn("doc_id", F.col("chunk_id")), n["avgdl"], block=block), str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(map(str, postings.items(stored).select("term", "chunk_id", "tf", "length").collect())) == sorted(map(str, full["postings"].select("term", "chunk_id", "tf", "length").collect()))
    want = hits(retrieval.bm25(asked, full, k, digits=6))
    assert hits(postings.search(asked, stored, full["df"], full["corpus"], k, digits=6)) == want and len(want) > 20
    found = postings.find(postings.weighted_terms(asked, full["df"], full["corpus"]), stored, n["avgdl"], k, margin=1e-6, ahead=8)
    assert hits(retrieval.top_k(found.scores.withColumn("score", F.round("score", 6)).where("score > 0"), k)) == want
    read = found.blocks.agg(F.count_if("read"), F.count("*")).first()
    assert 0 < read[0] < (0.7 if block == 8 else 1.0) * read[1] or k > 100, read


def test_blocks_where_every_weight_is_negative(spark, tmp_path):
    c = spark.createDataFrame([(i, "w1 w2") for i in range(4)] + [(9, "w1")], "chunk_id int, content string")
    full = retrieval.lexical_index(c)
    postings.store(postings.to_blocks(full["postings"].withColumn("doc_id", F.col("chunk_id")), 2.0), str(tmp_path / "b"))
    q = spark.createDataFrame([(1, "w1 w2")], "query_id int, query string")
    assert hits(postings.search(q, spark.read.parquet(str(tmp_path / "b")), full["df"], full["corpus"], 2, digits=6)) == hits(retrieval.bm25(q, full, 2, digits=6))


# -- cells


def vectors(n, dims, seed, centres=12):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    return [(i, [float(v) for v in (c[i % centres] + 0.6 * r.normal(size=dims)).astype(np.float32)]) for i in range(n)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = vectors(1200, 16, 1) + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 15 + [None]), (None, [1.0] * 16)]
    rows += [(6000 + i, rows[7][1]) for i in range(300)] + [rows[3], rows[3]]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    path = str(tmp_path_factory.mktemp("cells"))
    return v, cells.build(v, path, block=64), path


def test_cells_hold_every_usable_row(spark, indexed):
    v, index, path = indexed
    good = cells.usable(v).where("chunk_id is not null")
    stored = index.blocks().select(F.explode("ids").alias("id"))
    assert sorted(r[0] for r in stored.collect()) == sorted(r["chunk_id"] for r in good.collect())
    assert index.blocks().agg(F.max("n")).first()[0] < 4 * 64 + 200
    again = cells.load(spark, path)
    assert again.n_probes == index.n_probes and np.array_equal(again.centres, index.centres)


def ask(spark, v, index, k, threshold, **options):
    q = v.where("chunk_id % 40 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector")).dropDuplicates(["query_id"])
    q = q.unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 16)], "query_id long, query_vector array<float>"))
    want = retrieval.vector_search(q.where("query_id >= 0"), cells.usable(v).where("chunk_id is not null"), k, threshold, digits=8)
    return hits(cells.search(q, index, k, threshold, digits=8, **options)), hits(want)


@pytest.mark.parametrize(("k", "threshold"), [(10, 0.2), (3, 0.9), (400, 0.0), (10, 2.0)])
def test_exact_search_equals_all_pairs(spark, indexed, k, threshold):
    got, want = ask(spark, indexed[0], indexed[1], k, threshold, exact=True)
    assert got == want and (want or threshold > 1)


def test_probed_search_finds_nine_of_ten(spark, indexed):
    got, want = ask(spark, indexed[0], indexed[1], 10, 0.2)
    pairs = lambda x: {(r[0], r[1]) for r in x}
    assert indexed[1].n_probes < len(indexed[1].centres)
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want))


def test_probed_search_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = cells.build(v, str(tmp_path))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {(r[0], r[1]) for r in hits(cells.search(q, index, 10, 0.2, digits=8))}
    want = {(r[0], r[1]) for r in hits(retrieval.vector_search(q, v, 10, 0.2, digits=8))}
    assert len(got & want) >= 0.9 * len(want)


def test_cells_of_nothing_and_of_mixed_lengths(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    index = cells.build(none, str(tmp_path / "none"))
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vector array<float>")
    assert cells.search(q, index, exact=True).count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id long, embedding array<float>")
    with pytest.raises(ValueError, match="dimensions"):
        cells.build(mixed, str(tmp_path / "mixed"))


def test_no_local_folder_on_a_cluster():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(spark)


def test_blocks_and_counts_are_gathered_over_batches():
    rows = [("a", 0, 0, 1, f"c{i}", i, 1 + i % 3, 9 - i) for i in range(5)] + [("a", 0, 1, 2, "c9", 9, 4, 2), ("b", 0, 1, 2, "c1", 1, 1, 7)]
    names = ["term", "level", "part", "parts", *postings.ITEM]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    for size in (1, 2, 3, 7):
        got = [x for b in postings.gather(batch.slice(i, size) for i in range(0, 7, size)) for x in b.to_pylist()]
        assert [(x["term"], x["part"], x["parts"], x["n"], x["max_tf"], x["min_length"]) for x in got] == [("a", 0, 1, 5, 3, 5), ("a", 1, 2, 1, 4, 2), ("b", 1, 2, 1, 1, 7)]
        assert [(y["chunk_id"], y["doc_id"], y["tf"], y["length"]) for x in got for y in x["items"]] == [r[4:] for r in rows]


def test_words_are_counted_where_a_chunk_is_read(spark):
    t = spark.createDataFrame([("a", 1, ["x", "y", "x"]), ("b", 2, []), ("c", 3, None), ("d", 4, ["y"])], "chunk_id string, doc_id int, t array<string>")
    counts = postings.counted(t)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [("a", 1, 3, "x", 2), ("a", 1, 3, "y", 1), ("d", 4, 1, "y", 1)]


def test_postings_are_shuffled_once(spark):
    """Texts are counted where they are read, also those of a repeated id, and blocks are made with one shuffle of packed rows."""
    rows = [(1, 1, ["a", "b", "a"]), (2, 2, ["a"]), (2, 2, ["a"]), (2, 2, ["a", "c"]), (None, None, ["b"]), (None, None, ["b"]), (3, 3, None), (4, 4, [])]
    t = spark.createDataFrame(rows, "chunk_id long, doc_id long, t array<string>")
    full = postings.counted_texts(t)
    assert sorted((str(r["chunk_id"]), r["length"], r["term"], r["tf"]) for r in full["postings"].collect()) == [("1", 3, "a", 2), ("1", 3, "b", 1), ("2", 1, "a", 2), ("2", 2, "a", 1), ("2", 2, "c", 1), ("None", 1, "b", 2)]
    assert {r["term"]: r["df"] for r in full["df"].collect()} == {"a": 3, "b": 2, "c": 1}
    blocks = postings.to_blocks(postings.counted(t.where("chunk_id = 1")), 2.0, block=1)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan
    assert sorted((r["term"], r["items"][0]["tf"]) for r in blocks.collect()) == [("a", 2), ("b", 1)]
