"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lorewright.functions import answers, intent, science, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_hashes(spark):
    c = F.col("t")
    assert one(spark, text.short_hash(c), t="Un qubit es la unidad básica de información cuántica.") == "b239b86b09ec0edd"
    assert one(spark, text.short_hash(c), t="¿Qué es un qubit?") == "32896c0940c63b21"
    assert int(one(spark, text.point_id(c), t="doc_micro_000001")) == 2442615860530953791


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="¿Cómo funciona el algoritmo de Shor (factorización-cuántica)?") == ["cómo", "funciona", "algoritmo", "shor", "factorizacióncuántica"]
    assert one(spark, text.token_estimate(F.col("t")), t="Este es un texto de prueba con varias palabras.") == 15


def test_whitespace_and_excerpt(spark):
    assert one(spark, text.clean_whitespace(F.col("t")), t="a   b \n\n\n\n c") == "a b\n\nc"
    assert one(spark, text.excerpt(F.col("t"), 10), t="uno dos tres cuatro") == "uno dos..."


def test_maths(spark):
    assert "trace" in one(spark, text.math_terms(F.col("t")), t=r"$\Tr(\rho)$")
    assert one(spark, text.formula_description(F.col("t")), t=r"\sum_{i}^{n} \frac{1}{i}") == "sumatorio con límites, fracción"
    assert one(spark, text.formula_description(F.col("t")), t="x") == "expresión matemática"
    assert one(spark, text.normalize_math_query(F.col("t")), t="qué es una matriz") == "qué es una matriz matrix matrices"
    assert one(spark, text.math_symbols(F.col("t")), t=r"\alpha \psi \alpha") == ["alpha", "psi"]


@pytest.mark.parametrize(
    ("t", "level", "confidence"),
    [("Este párrafo discute algunos aspectos del sistema", "introductory", 1.0), ("Recent work by Smith et al. (2024)", "research", 0.8)],
)
def test_difficulty(spark, t, level, confidence):
    d = one(spark, intent.difficulty(F.col("t")), t=t)
    assert (d["level"], round(d["confidence"], 6)) == (level, confidence)
    assert one(spark, intent.difficulty_number(intent.difficulty(F.col("t"))["level"]), t=t) == {"introductory": 1, "research": 4}[level]


def test_route(spark):
    r = one(spark, intent.route(F.col("t")), t="¿Qué es BB84?")
    assert (r["strategy"], r["vector_weight"], r["bm25_weight"], r["graph_weight"], r["top_k"]) == ("hybrid", 0.3, 0.6, 0.1, 10)
    r = one(spark, intent.route(F.col("t")), t="relación entre Shor y QFT")
    assert (r["strategy"], r["graph_weight"]) == ("hybrid_with_graph", 0.5)
    r = one(spark, intent.route(F.col("t")), t="explica el qubit, y también el entrelazamiento cuántico")
    assert (r["strategy"], r["top_k"], len(r["sub_queries"])) == ("multi_hop", 20, 2)


def test_plan(spark):
    steps = one(spark, intent.plan(F.col("t")), t="Compara BB84 con E91")
    assert [s["step_type"] for s in steps] == ["retrieve", "retrieve", "compare"]
    assert steps[2]["depends_on"] == [0, 1]
    assert [s["step_type"] for s in one(spark, intent.plan(F.col("t")), t="hola")] == ["retrieve"]
    chain = one(spark, intent.plan(F.col("t")), t="primero define qubit luego explica el entrelazamiento")
    assert [s["depends_on"] for s in chain] == [[], [0], [0, 1]]


def test_query_rules(spark):
    assert one(spark, intent.query_type(F.col("t")), t="¿Qué diferencia hay?") == "comparative"
    assert one(spark, intent.query_type(F.col("t")), t="hola") == "factual"
    assert one(spark, intent.decompose(F.col("t")), t="compara Shor con Grover") == ["¿Qué es Shor?", "¿Qué es Grover?", "Diferencias entre Shor y Grover"]
    assert one(spark, intent.variants(F.col("t")), t="¿qué es un qubit?") == ["definición de un qubit", "un qubit explicación", "¿qué es un bit cuántico?"]
    assert one(spark, intent.follow_up(F.col("t"), F.lit(True)), t="y eso") == "implicit"
    assert one(spark, intent.follow_up(F.col("t"), F.lit(False)), t="cuéntame más detalles") == "expansion"
    assert one(spark, intent.expand_follow_up(F.lit("más"), F.lit("expansion"), F.lit("u"), F.col("t")), t="el algoritmo de Shor factoriza") == "más sobre Shor"


def test_citations(spark):
    c = F.col("t")
    assert one(spark, answers.cited(c), t="a [1] b [1,2] c [1-3]") == [1, 1, 2, 1, 2, 3]
    r = one(spark, answers.citation_report(c, F.lit(2)), t="a [1] b [3]")
    assert (r["valid"], r["invalid"], r["used"], r["coverage"]) == (False, [3], [1], 0.5)
    assert one(spark, answers.uncited(c, F.array(F.lit("x"), F.lit("y"))), t="a [1]") == ["y"]
    assert one(spark, answers.inject_citations(c, F.array(F.lit("nada"), F.lit("Shor factoriza enteros grandes rápido"))), t="Shor factoriza enteros. Hola.") == "Shor factoriza enteros. Hola."
    assert one(spark, answers.inject_citations(c, F.array(F.lit("nada"), F.lit("shor factoriza enteros. grandes"))), t="Shor factoriza enteros. Hola.") == "Shor factoriza enteros [2]. Hola."
    assert [x["claim"] for x in one(spark, answers.claims(c), t="Shor factoriza [1]. Nada.")] == ["Shor factoriza"]
    assert one(spark, answers.cite("apa", F.lit("Nielsen & Chuang"), F.lit("Cap 5 > Shor"), F.lit("")), t="") == "Nielsen & Chuang, (Cap 5 > Shor)"
    assert one(spark, answers.cite("inline", F.lit("Nielsen & Chuang"), F.lit("Cap 5 > Shor"), F.lit(None).cast("string")), t="") == "Nielsen & Chuang — Cap 5 > Shor"


def test_checks(spark):
    c = F.col("t")
    o = one(spark, answers.relevance_overlap(F.lit("algoritmo de Shor cuántico"), c), t="El algoritmo de Shor factoriza números enteros en tiempo polinómico.")
    assert round(o, 6) == 0.666667
    assert one(spark, answers.verdict(F.lit(o)), t="") == "ambiguous"
    assert [one(spark, answers.correction(F.lit(x)), t="") for x in (0.2, 0.4, 0.5)] == ["pass", "filter", "reformulate"]
    assert one(spark, answers.unknown_numbers(c, F.array(F.lit("hay 12"))), t="12 y 345 y 7") == ["345"]
    assert one(spark, answers.completeness(c, F.lit("algoritmo cuántico")), t="un algoritmo") == 0.5
    assert one(spark, answers.source_coverage(c, F.lit(2)), t="a [1]") == 0.5
    assert one(spark, answers.citation_issues(c, F.array(F.lit("nada"))), t="Los fotones viajan rápido [1]")[0]["severity"] == "high"


def test_compression_keeps_formulas(spark):
    f = answers.compressor("light")
    assert one(spark, f(F.col("t")), t="a   b $x. y$  c") == "a b $x. y$ c"
    short = one(spark, answers.compressor("aggressive", 0.5)(F.col("t")), t="El qubit es un estado quantum. Hola a todos los de aquí presentes hoy.")
    assert short == "El qubit es un estado quantum."


def test_code_validation():
    assert science.code_issues("import os\nx = eval('1')") == [("error", "import os", 1), ("error", "call eval", 2)]
    assert science.code_issues("while True:\n    pass")[0][1] == "endless loop"
    assert science.code_issues("x = 1") == []


def test_quantum():
    import numpy as np

    bell = science.apply_gate(science.GATES["CNOT"] @ science.tensor(science.GATES["H"], science.GATES["I"]), np.array([1, 0, 0, 0]))
    rho = np.outer(bell, bell.conj())
    assert np.allclose(science.probabilities(bell), [0.5, 0, 0, 0.5])
    assert abs(science.entropy(science.partial_trace(rho, [2, 2], [0])) - 1) < 1e-9
    assert all(science.is_unitary(g) for g in science.GATES.values())
    assert abs(science.fidelity(rho, rho) - 1) < 1e-6
    assert np.allclose(science.commutator(science.GATES["X"], science.GATES["Y"]), 2j * science.GATES["Z"])
