"""Flows beyond one search, readers and writers of files, evaluation, and arithmetic of formulas."""

import json

import pytest
from pyspark.sql import functions as F

from lorewright.functions import algebra
from lorewright.operators import formulas, graph, records, retrieval
from lorewright.plans import evaluation, flows
from lorewright.sources import stores


def rows(d, *cols):
    return sorted(tuple(r) for r in (d.select(*cols) if cols else d).collect())


@pytest.fixture(scope="module")
def search(spark):
    texts = ["el qubit guarda un bit cuántico en superposición", "la puerta Hadamard crea superposición de estados", "el protocolo BB84 reparte claves", "la medida colapsa el estado del qubit"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    index = retrieval.lexical_index(chunks)
    return lambda q, k: retrieval.bm25(q, index, k).join(chunks, "chunk_id")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "¿Qué es un qubit?"), (2, "protocolo de claves"), (3, "xyzzy plugh")], "query_id long, query string")


def test_multi_query_and_hypothetical(search, asked):
    many = flows.multi_query(asked, search, 3)
    assert {r[0] for r in rows(many, "query_id")} == {1, 2}
    assert [r["chunk_id"] for r in many.where("query_id = 2 AND rank = 1").collect()] == [2]
    made = flows.hypothetical(asked, search, 3, lambda prompts: [None if "xyzzy" in p else "un bit cuántico guardado" for p in prompts])
    assert {r[0] for r in rows(made, "query_id")} == {1, 2}


def test_corrected_takes_other_wordings(search, asked):
    out = flows.corrected(asked, search, 3)
    assert set(out.columns) >= {"query_id", "chunk_id", "action", "rank"}
    assert all(r[0] in (1, 2) for r in rows(out, "query_id"))


def test_self_checked_gives_one_answer_each(search, asked):
    out = flows.self_checked(asked, search, lambda prompts: ["El qubit guarda un bit cuántico en superposición [1]." for _ in prompts], 2, 2)
    assert [r[0] for r in rows(out, "query_id")] == [1, 2, 3]
    assert all(r["acceptable"] or r["round"] == 2 for r in out.collect())


def test_exhaustive_keeps_the_first_legs_score(spark):
    leg = lambda *x: spark.createDataFrame(list(x), "query_id long, chunk_id long, score double")
    out = flows.exhaustive([leg((1, 1, 0.5), (1, 2, 0.0001)), leg((1, 1, 9.0), (1, 2, 3.0), (1, 3, 0.7))], most=2)
    assert rows(out, "chunk_id", "score", "rank") == [(2, 3.0, 1), (3, 0.7, 2)]


def test_files_come_back(spark, tmp_path):
    m = spark.createDataFrame([("s1", 0, "user", "hola"), ("s1", 1, "assistant", "sí"), ("s2", 0, "user", "x")], "session_id string, turn int, role string, content string")
    stores.write_sessions(m, f"{tmp_path}/s")
    back = stores.messages_of(spark.read.schema(stores.SESSION).json(f"{tmp_path}/s"))
    assert rows(back) == rows(m)
    for n, day in (("a", "2024-01-01"), ("b", "2024-02-01")):
        (tmp_path / f"{n}.json").write_text(json.dumps({"session_id": n, "updated_at": day, "messages": []}, indent=1))
    assert [r["session_id"] for r in stores.read_sessions(spark, f"{tmp_path}/*.json", 1).collect()] == ["b"]
    u = spark.createDataFrame([("t", "llm", "p", "m", "o", 1, 2, 0.1, 0.2, 0.3, "q" * 150)], stores.USAGE)
    stores.write_usage(u, f"{tmp_path}/u")
    stores.write_usage(u, f"{tmp_path}/u")
    assert [(r["tokens_output"], len(r["query"])) for r in stores.read_usage(spark, f"{tmp_path}/u").collect()] == [(2, 100)] * 2
    (tmp_path / "suite").write_text(json.dumps({"name": "n", "description": "d", "test_cases": [{"query": "a", "tags": ["x"]}, {"query": "", "category": "edge"}]}))
    assert rows(stores.read_suite(spark, f"{tmp_path}/suite"), "case_id", "query", "category", "difficulty") == [(0, "a", "general", "medium"), (1, "", "edge", "medium")]
    (tmp_path / "o.yaml").write_text("entities:\n  Gate:\n    color: red\n  Autor: {}\nrelations:\n  USA:\nfinanzas:\n  entities:\n    Bono:\n  other:\n    No:\n")
    assert stores.read_ontology(spark, f"{tmp_path}/o.yaml") == {"entities": ["Gate", "Autor", "Bono"], "relations": ["USA"]}
    (tmp_path / "e.yaml").write_text("# nothing\n")
    assert stores.read_ontology(spark, f"{tmp_path}/e.yaml")["relations"] == stores.RELATION_TYPES
    c = spark.createDataFrame([(1, 7, 0.5, "a", 1), (1, 8, 0.9, "b", 2)], "query_id int, chunk_id int, score double, context string, n_parts int")
    stores.write_contexts(c, f"{tmp_path}/c")
    assert [x["chunk_id"] for x in spark.read.json(f"{tmp_path}/c").first()["contexts"]] == [8, 7]
    assert json.loads(stores.as_json(c.where("chunk_id = 7")).first()[0]) == {"query_id": 1, "chunk_id": 7, "score": 0.5, "context": "a", "n_parts": 1}


def test_evaluation_runs_and_reports(spark):
    cases = spark.createDataFrame([(0, "what does measurement collapse", "measurement collapses states", "factual"), (1, "", None, "edge"), (2, "unrelated question", None, "factual")], "case_id int, query string, ground_truth string, category string")
    rag = lambda q: q.select("query_id", F.lit("measurement does collapse states").alias("answer"), F.when(F.col("query_id") == 0, F.array(F.lit("measurement does collapse all states"))).otherwise(F.array().cast("array<string>")).alias("sources"))
    out = evaluation.run(cases, rag)
    by = {r["case_id"]: r for r in out.collect()}
    assert by[0]["faithfulness"] == 1.0 and by[0]["context_precision"] == 1.0 and by[2]["faithfulness"] is None and by[1]["answer"] is None
    text = evaluation.report(out, "suite")
    assert "# Benchmark Report: suite" in text and "| faithfulness | 1.000 | 1.000 | 1.000 | 1 |" in text and text.index("## Category: edge") < text.index("## Category: factual")


def test_comparison_of_expressions():
    assert algebra.compare("a*b", "b*a")["passed"]
    assert algebra.compare("1/(x - x)", "1") == {"passed": False, "conclusive": False, "test_points": 100, "failures": 0, "max_residual": 0.0}
    assert algebra.compare("open('x')", "1") is None and algebra.compare("x.y", "1") is None
    assert algebra.rename("x + x", "a + b", "2 x") is None and algebra.rename("x + y", "a + a", "x") is None
    assert algebra.rename("x + y", "b + a", r"\sin y - x") == r"\sin a - b"


def test_formula_store(spark):
    store = spark.createDataFrame([("x+1", "f", "algebra", [1])], "latex string, fingerprint string, domain string, source_chunks array<long>")
    found = formulas.extract(spark.createDataFrame([(2, "so $x+1$ and $$y + 22$$")], "chunk_id long, content string"))
    assert rows(formulas.add_formulas(store, found), "latex", "source_chunks") == [("x+1", [1, 2]), ("y + 22", [2])]
    rel = spark.createDataFrame([("a", "b", "equivalent", False)], "src string, dst string, relation string, verified boolean")
    new = spark.createDataFrame([("a", "b", "equivalent", False, "x + x", "2*x"), ("a", "c", "equivalent", False, "x", "y"), ("a", "d", "nonsense", True, "x", "x")], "src string, dst string, relation string, verified boolean, lhs string, rhs string")
    assert rows(formulas.add_relations(rel, new)) == [("a", "b", "equivalent", True), ("a", "c", "equivalent", False)]
    rules = spark.createDataFrame([("r", "x", "y", False, True)], "rule_id string, lhs string, rhs string, verified boolean, bidirectional boolean")
    assert rows(formulas.add_rules(rules, spark.createDataFrame([("r", "(x+1)**2", "x**2+2*x+1", False, True)], rules.schema)), "rule_id", "verified") == [("r", True)]


def test_splits_upserts_and_caches(spark):
    lines = spark.createDataFrame([("k",)] * 50 + [(str(i),) for i in range(50)], "v string")
    assert records.train_validation(lines, F.col("v"), 0.3).where("split = 'validation'").count() == 30
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 1)], old.schema)
    assert rows(records.upsert(old, new, "k", "t"), "k", "v") == [(1, "d"), (2, "b"), (3, "e")]
    cache = spark.createDataFrame([("x", [1.0], 1), ("x", [2.0], 2)], "cache_key string, embedding array<double>, created_at int")
    got, after = records.get_or_compute(spark.createDataFrame([("x",), ("y",), ("y",)], "cache_key string"), cache, lambda m: m.withColumn("embedding", F.array(F.lit(9.0))), now=F.lit(3))
    assert rows(got, "cache_key", "embedding") == [("x", [2.0]), ("y", [9.0]), ("y", [9.0])]
    assert after.where("cache_key = 'y'").count() == 1
    assert records.cache_statistics(spark.createDataFrame([(1,)], "access_count int"), 3, 1).first()["hit_rate"] == 0.75


def test_plans_deeper_than_ten(spark):
    steps = spark.createDataFrame([(1, i, [i - 1] if i else []) for i in range(14)], "plan_id int, step_id int, depends_on array<int>")
    assert rows(graph.plan_levels(steps), "step_id", "level") == [(i, i) for i in range(14)]


def test_plans_are_levelled_where_they_are_gathered(spark, monkeypatch):
    """Plans gathered and in rounds of joins have the same levels, and small plans need no rounds."""
    steps = [("a", 0, []), ("a", 1, [0]), ("a", 1, [0, 0]), ("a", 2, [1, None]), ("a", 3, [7]), ("a", None, []), ("b", 0, [1]), ("b", 1, [0]), ("b", 2, None), ("b", 3, [None]), ("b", 4, [2, 3]), (None, 0, []), (None, 1, [0]), ("c", 5, [4]), ("c", 4, [3]), ("c", 3, []), ("c", 2, [5, 3])]
    steps = spark.createDataFrame(steps, "plan_id string, step_id int, depends_on array<int>")
    of = lambda d: sorted((str(r["plan_id"]), str(r["step_id"]), r["level"]) for r in d.collect())
    want = of(graph._levels_in_rounds(steps))
    assert of(graph.plan_levels(steps, 4)) == want and ("c", "2", 3) in want and len(want) == 11  # 4 of c, 3 of b, 3 of a, 1 of none
    monkeypatch.setattr(graph, "_levels_in_rounds", None)
    assert of(graph.plan_levels(steps)) == want
