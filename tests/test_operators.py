"""Operators against hand-made tables."""

from pyspark.sql import functions as F

from lorewright.operators import chunking, graph, records, retrieval
from lorewright.sources import markdown


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sections(spark):
    body, short = "x" * 60, "y" * 40
    text = f"# A\n{body}\n## B\n{body}\n## C\n{short}\n# D\n{body}"
    d = spark.createDataFrame([(1, "t", text), (2, "u", "sin títulos"), (3, "v", None)], "doc_id int, doc_title string, text string")
    assert rows(markdown.sections(d), "doc_id", "header_path", "level") == [(1, "A", 1), (1, "A > B", 2), (1, "D", 1), (2, "u", 0)]
    assert rows(markdown.heading_lines(d), "doc_id", "header_path") == [(1, "A"), (1, "A > B"), (1, "A > C"), (1, "D")]


def test_preamble_and_ids(spark):
    d = spark.createDataFrame([(1, "t", "p" * 60 + "\n# A\n" + "x" * 60)], "doc_id int, doc_title string, text string")
    assert rows(markdown.sections(d), "header_path")[1] == ("t > Introducción",)
    p = spark.createDataFrame([("/lib/books/Libro Uno/Libro Uno.md",), ("/lib/papers/Cat/a-b.md",), ("/x/doc.md",)], "p string")
    assert rows(p.select(markdown.doc_id(F.col("p")).alias("i"), markdown.category(F.col("p")).alias("c")), "i", "c") == [("books_libro_uno", "Libro Uno"), ("cat_a_b", "Cat"), ("x_doc", "general")]


def test_read_library(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# T\ncuerpo")
    (tmp_path / "n.txt").write_text("no")
    d = markdown.read_library(spark, str(tmp_path))
    assert [r["text"] for r in d.collect()] == ["# T\ncuerpo"]
    assert d.select(markdown.title(F.col("text"), F.col("file_path"))).first()[0] == "T"


def test_blocks_and_images(spark):
    d = spark.createDataFrame([("a ```x``` $$y$$ ![alt](http://h/i.png) ![b](c.svg)",)], "t string")
    b = d.select(markdown.atomic_blocks(F.col("t")).alias("b")).first()["b"]
    assert [x["kind"] for x in b] == ["code", "latex_block"]
    assert [x["kind"] for x in d.select(markdown.images(F.col("t")).alias("i")).first()["i"]] == ["remote", "unsupported"]
    assert d.select(markdown.in_block(F.lit(3), markdown.atomic_blocks(F.col("t")))).first()[0]


def sections(spark, *contents):
    return spark.createDataFrame([("d", "t", i, "h", c) for i, c in enumerate(contents)], "doc_id string, doc_title string, section_seq int, header_path string, content string")


def test_chunk_cascade(spark):
    s = sections(spark, "a" * 300)
    assert rows(chunking.chunks(s), "level", "chunk_id", "parent_id") == [("macro", "d_macro_000001", None), ("meso", "d_meso_000002", "d_macro_000001"), ("micro", "d_micro_000003", "d_meso_000002")]
    assert rows(chunking.chunks(s, dedup_scope="global"), "level") == [("macro",)]


def test_chunk_sizes(spark):
    text = ". ".join(f"frase número {i} con algunas palabras" for i in range(200))
    c = chunking.chunks(sections(spark, text))
    assert c.where("level = 'meso'").agg(F.max("token_count")).first()[0] <= chunking.MESO
    micro = [r["content"] for r in c.where("level = 'micro'").orderBy("seq").collect()]
    assert all(len(m) // 3 <= chunking.MICRO + chunking.OVERLAP + 1 for m in micro)
    assert all(f"número {i} con" in " ".join(micro) for i in range(200))
    kids = {r["parent_id"]: r["children_ids"] for r in chunking.children(c).collect()}
    assert all(k == sorted(k) for k in kids.values())


def test_chunks_keep_formulas():
    parts = chunking.split("palabra " * 100 + "$$" + "x " * 50 + "$$ " + "fin " * 100, 100)
    assert sum("$$" + "x " * 50 + "$$" in p for p in parts) == 1


def test_semantic_blocks(spark):
    text = "Texto inicial bastante largo.\n```py\nx = 1\n```\n**Definición 1.1:** un qubit es algo.\n**Teorema 1.2** (x) dice."
    found = [(b["block_type"], b["is_atomic"]) for b in chunking.semantic_blocks(text, chunking.block_patterns())]
    assert found == [("regular", False), ("code_block", True), ("definition", True), ("theorem", True)]
    b = chunking.blocks(sections(spark, text))
    assert dict(rows(chunking.block_counts(b), "block_type", "n_blocks"))["definition"] == 1
    assert chunking.semantic_chunks(b).count() >= 3
    assert chunking.virtual_macros(chunking.semantic_chunks(b)).count() == 1


def test_bm25(spark):
    c = spark.createDataFrame([(1, "qubit estado"), (2, "qubit shor shor"), (3, "grover")], "chunk_id int, content string")
    q = lambda s: spark.createDataFrame([(0, s)], "query_id int, query string")
    i = retrieval.lexical_index(c)
    assert [(r["chunk_id"], round(r["score"], 6)) for r in retrieval.bm25(q("shor"), i).collect()] == [(2, 0.628708)]
    assert round(retrieval.bm25(q("shor shor"), i).first()["score"], 6) == 1.257417
    assert round({r["term"]: r["idf"] for r in retrieval.idf(i).collect()}["qubit"], 6) == 0.063853


def hits(spark, data, schema="query_id int, chunk_id string, source string, rank int, score double"):
    return spark.createDataFrame(data, schema)


def test_fusion(spark):
    v = [(0, "001", "vector", 1, 0.92), (0, "002", "vector", 2, 0.88), (0, "003", "vector", 3, 0.85)]
    b = [(0, "002", "bm25", 1, 8.5), (0, "004", "bm25", 2, 7.2), (0, "001", "bm25", 3, 6.8)]
    f = retrieval.fuse(hits(spark, v + b))
    got = {r["chunk_id"]: round(r["score"], 9) for r in f.collect()}
    assert got == {"002": 0.012982549, "001": 0.012958626, "003": 0.007936508, "004": 0.004838710}
    assert f.where("chunk_id = '002'").first()["source_scores"] == {"bm25": 8.5, "vector": 0.88}
    w = spark.createDataFrame([(0, "bm25", 1.0)], "query_id int, source string, weight double")
    assert retrieval.fuse(hits(spark, v + b), w).count() == 3


def test_variants_and_rerank(spark):
    d = spark.createDataFrame([(0, 1, "a", 1, 0.5), (0, 2, "a", 3, 0.4)], "query_id int, variant int, chunk_id string, rank int, score double")
    assert round(retrieval.fuse_variants(d).first()["score"], 9) == 0.035493104
    r = spark.createDataFrame([(0, "a", 0.012, 2.0), (0, "b", 0.010, 5.0), (0, "c", 0.011, 3.0)], "query_id int, chunk_id string, score double, ce double")
    assert {x["chunk_id"]: round(x["score"], 6) for x in retrieval.rerank(r).collect()} == {"a": 0.0036, "b": 0.703, "c": 0.236633}


def test_merges(spark):
    h = spark.createDataFrame([(0, "a", 0.9, 1), (0, "b", 0.8, 2), (0, "c", 0.7, 3), (0, "x", 0.6, 4)], "query_id int, chunk_id string, score double, rank int")
    c = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "P"), ("x", "Q"), ("y", "Q"), ("z", "Q")], "chunk_id string, parent_id string")
    assert rows(retrieval.merge_siblings(h.drop("rank"), c), "chunk_id", "score") == [("P", 0.9), ("x", 0.6)]
    assert rows(retrieval.merge_by_share(h, c), "rank", "chunk_id") == [(1, "P"), (2, "x")]


def test_context_budget_and_abstention(spark):
    c = spark.createDataFrame([(f"c{i}", "d", i, f"t{i}", 100) for i in range(1, 8)], "chunk_id string, doc_id string, seq int, content string, token_count int")
    h = spark.createDataFrame([(0, "c4", 0.001, 1), (0, "c1", 0.0005, 2)], "query_id int, chunk_id string, score double, rank int")
    e = {r["chunk_id"]: r["context"] for r in retrieval.expand_context(h.drop("rank"), c, 2).collect()}
    assert e == {"c4": "t2\n\nt3\n\nt4\n\nt5\n\nt6", "c1": "t1\n\nt2\n\nt3"}
    assert retrieval.token_budget(h.join(c.select("chunk_id", "token_count"), "chunk_id"), 150).count() == 1
    a = retrieval.abstain(h).first()
    assert (a["abstained"], a["closest"]) == (True, ["c4", "c1"])


def test_verify_claims(spark):
    c = spark.createDataFrame([(1, "Shor factoriza en tiempo polinómico")], "claim_id int, claim string")
    h = spark.createDataFrame([(1, "x", "Shor factoriza en tiempo récord"), (1, "y", "nada en común")], "claim_id int, chunk_id string, content string")
    r = retrieval.verify_claims(c, h).first()
    assert (r["status"], r["confidence"], r["supporting"]) == ("partial", 0.5, 1)


def test_late_interaction_and_blocks(spark):
    q = spark.createDataFrame([(0, [[1.0, 0.0], [0.0, 1.0]])], "query_id int, query_vectors array<array<double>>")
    c = spark.createDataFrame([("a", [[1.0, 0.0]]), ("b", [[1.0, 0.0], [0.0, 2.0]])], "chunk_id string, vectors array<array<double>>")
    assert [r["chunk_id"] for r in retrieval.late_interaction(q, c).orderBy("rank").collect()] == ["b", "a"]
    few, many = spark.range(5).toDF("query_id"), spark.range(7).toDF("chunk_id")
    assert retrieval.against(many, few, block=2).distinct().count() == 35


def test_graph(spark):
    c = spark.createDataFrame([(1, "Shor usa qubit"), (2, "qubit y Grover"), (3, "puerta Hadamard")], "chunk_id int, content string")
    g = graph.build(graph.mentions(c))
    nodes = {r["node"]: r for r in g["nodes"].collect()}
    assert nodes["qubit"]["mentions"] == 2
    assert nodes["qubit"]["chunk_ids"] == [1, 2]
    q = spark.createDataFrame([(0, "qué es qubit"), (1, "nada")], "query_id int, query string")
    found = {r["query_id"]: r["related"] for r in graph.search(q, g["nodes"], g["edges"]).collect()}
    assert {"shor", "grover"} <= set(found[0])
    p = graph.shortest_paths(spark.createDataFrame([("shor", "grover")], "src string, dst string"), g["edges"]).first()
    assert p["path"] == ["shor", "qubit", "grover"]
    comp = {r["node"]: r["component"] for r in graph.components(g["nodes"], g["edges"]).collect()}
    assert comp["shor"] == comp["grover"] != comp["hadamard"]
    assert graph.statistics(g["nodes"], g["edges"]).first()["n_nodes"] == len(nodes)


def test_lineage_and_levels(spark):
    d = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "c")], "entity string, source string")
    assert rows(graph.lineage(d, spark.createDataFrame([("c",)], "start string")), "entity", "distance") == [("a", 2), ("b", 1)]
    s = spark.createDataFrame([(1, 0, []), (1, 1, [0]), (1, 2, [0, 1]), (2, 0, [1]), (2, 1, [0])], "plan_id int, step_id int, depends_on array<int>")
    assert rows(graph.plan_levels(s), "plan_id", "step_id", "level") == [(1, 0, 0), (1, 1, 1), (1, 2, 2)]


def test_triples(spark):
    t = spark.createDataFrame([("Shor", "Algoritmo", "USA", "QFT", "Algoritmo", 0.9, "c1"), ("a", "X", "USA", "b", "Algoritmo", 0.9, "c1"), ("a", "Algoritmo", "USA", "b", "Algoritmo", 0.5, "c1")], "source string, source_type string, relation string, target string, target_type string, confidence double, chunk_id string")
    assert rows(graph.triples_to_edges(t, ["usa"], ["algoritmo"]), "src", "dst") == [("shor", "qft")]


def test_ledger(spark):
    l = spark.createDataFrame([("claude-sonnet-4-5", 4500, 800, "query", "p", "generation"), ("otro", 10, 10, "build", "q", "embedding")], "model string, tokens_input int, tokens_output int, usage_type string, provider string, operation string")
    c = records.with_cost(l)
    assert sorted(round(r["total_cost"], 6) for r in c.collect()) == [0.0, 0.0255]
    s = {(r["dimension"], r["value"]): r["calls"] for r in records.usage_summary(c).collect()}
    assert s[("total", None)] == 2
    assert s[("usage_type", "query")] == 1


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(records.upsert(old, new, "k"), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(records.delete(old, new, "k"), "k") == [(1,)]


def test_caches(spark):
    c = spark.createDataFrame([("q1", [1.0, 0.0], "r1"), ("q2", [0.0, 1.0], "r2")], "query string, query_embedding array<double>, response string").withColumn("cache_id", F.substring(F.sha2(F.col("query").cast("binary"), 256), 1, 16))
    q = spark.createDataFrame([(1, "q1", [0.0, 1.0]), (2, "z", [0.1, 1.0]), (3, "w", [1.0, 1.0])], "question_id int, query string, query_vector array<double>")
    assert rows(records.answer_lookup(q, c), "question_id", "response") == [(1, "r1"), (2, "r2")]


def test_pairs_and_lines(spark):
    p = spark.createDataFrame([(1, "Query 1", "a"), (2, "  query 1 ", "b"), (3, "otra", "c")], "pair_id int, query string, positive_passage string")
    assert rows(records.distinct_pairs(p), "pair_id", "query_hash")[0] == (1, "734728678c36")
    two = spark.createDataFrame([('{"prompt":"p","completion":"c"}',), ('{"prompt":"p","completion":"c"}',), ("",), ("x",)], "value string")
    v = records.validate_jsonl(two).first()
    assert (v["total_lines"], v["valid_lines"], v["duplicates"], v["errors"]) == (4, 2, 1, 1)
    s = records.train_validation(spark.range(100), F.col("id"))
    assert rows(s.groupBy("split").count(), "split", "count") == [("train", 80), ("validation", 20)]


def test_overall_score(spark):
    d = spark.createDataFrame([(0.8, 0.6, None, None), (0.9, 0.8, 0.7, 0.6), (None, None, None, None)], "faithfulness double, answer_relevancy double, context_precision double, context_recall double")
    assert [round(r[0], 6) for r in d.select(records.overall_score()).collect()] == [0.714286, 0.781818, 0.0]


def test_empty_tables(spark):
    c = spark.createDataFrame([], "chunk_id int, content string")
    q = spark.createDataFrame([(0, "shor")], "query_id int, query string")
    assert retrieval.bm25(q, retrieval.lexical_index(c)).count() == 0
    assert graph.mentions(c).count() == 0
    assert chunking.chunks(sections(spark).limit(0)).count() == 0


def test_lineage_and_paths_of_more_steps_than_ten(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(13)]
    d = spark.createDataFrame(chain, "entity string, source string")
    assert max(rows(graph.lineage(d, spark.createDataFrame([("n00",)], "start string")), "distance")) == (13,)
    e = spark.createDataFrame([(a, b, "r", 1) for a, b in chain], "src string, dst string, relation string, weight int")
    assert len(graph.shortest_paths(spark.createDataFrame([("n00", "n08")], "src string, dst string"), e).first()["path"]) == 9
