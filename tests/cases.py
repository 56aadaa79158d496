"""Made inputs that reach every branch of an operator, dealt over the rows of a table; the SQL states the results, which were worked out by hand from the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewright.functions import algebra, intent, science, text
from lorewright.operators import formulas, graph, records, retrieval
from lorewright.plans import evaluation, models
from lorewright.queries import _S, Query, t
from lorewright.sources import markdown, stores

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def picked(values: list, key: str = "doc_id", step: int = 1) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col(key) / step) % len(values) + 1).cast("int"))


def _pick(values: list, key: str = "doc_id", step: int = 1) -> str:
    return "[" + ", ".join(_S(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in values) + f"][({key} // {step}) % {len(values)} + 1]"


def _text(s: str) -> str:
    """A string for SQL in which line ends are spelled out."""
    return "(" + " || chr(10) || ".join(_S(p) for p in s.split("\n")) + ")"


def cases(name: str, f: Callable[..., Column], table: list[tuple]) -> None:
    """Registers `f` over the documents' ids: row by row the inputs of `table` in turn, and in SQL its last column."""
    inputs, wanted = [list(x) for x in zip(*[r[:-1] for r in table], strict=True)], [r[-1] for r in table]

    def run(spark, sf):
        d = t(spark, sf, "documents").select("doc_id", *[picked(v).alias(f"in{i}") for i, v in enumerate(inputs)])
        return d.select("doc_id", f(*[F.col(f"in{i}") for i in range(len(inputs))]).alias("result"))

    run.__name__ = name
    listed = "[" + ", ".join("NULL" if w is None else _text(w) for w in wanted) + f"][doc_id % {len(wanted)} + 1]"
    _QUERIES[name], _SQL[name] = run, f"SELECT doc_id, {listed} AS result FROM documents"


def joined(c: Column) -> Column:
    return F.array_join(c, " / ")


cases("flt15_validate_code", lambda c: F.concat(science.validate_code(c)["valid"].cast("string"), F.transform(science.validate_code(c)["issues"], lambda i: F.format_string(" %s:%s:%d", i["severity"], i["what"], i["line"])).cast("string")), [
    ("x = 1 + 2", "true[]"), ("import os", "false[ error:import os:1]"), ("eval('1')", "false[ error:call eval:1]"), ("while True:\n    pass", "true[ warning:endless loop:1]"),
    ("def f(n):\n    return f(n - 1)", "true[ warning:recursion f:1]"), ("x.__class__", "false[ error:attribute __class__:1]"), ("from subprocess import run", "false[ error:import subprocess:1]"),
    ("if x", "false[ error:syntax:1]"), ("import math\nprint(math.pi)", "true[]"), ("while True:\n    break", "true[]"), ("y = 2\nimport numpy, os.path", "false[ error:import os.path:2]"),
])

cases("str5_searchable_text", text.searchable_text, [
    ("sin nada", "sin nada"),
    ("el qubit", "el qubit | Términos: bit cuántico, quantum bit, qubit"),
    ("con $\\sum x$", "con $\\sum x$ | Términos: sum, suma, sumatorio, summation"),
    ("", ""),
])

cases("str29_decompose", lambda c: joined(intent.decompose(c)), [
    ("Compara Shor y Grover", "¿Qué es Shor? / ¿Qué es Grover? / Diferencias entre Shor y Grover"),
    ("relación entre entropía y medida", "¿Qué es entropía? / ¿Qué es medida? / ¿Cómo se relacionan entropía y medida?"),
    ("qué es la medición y además cómo se usa", "qué es la medición / cómo se usa / qué es la medición y además cómo se usa"),
    ("explica primero el qubit luego la puerta", "explica / la puerta / explica primero el qubit luego la puerta"),
    ("¿Qué es un qubit?", "¿Qué es un qubit?"),
])

cases("str30_variants", lambda c: joined(intent.variants(c)), [
    ("¿Qué es un qubit?", "definición de un qubit / un qubit explicación / ¿Qué es un bit cuántico?"),
    ("¿Cómo funciona la medición?", "procedimiento para funciona la medición / pasos para funciona la medición / ¿Cómo funciona la medida?"),
    ("la diferencia de fase", "la comparación de fase / la diferencia de fase"),
    ("el algoritmo de Shor", "el protocolo de Shor"),
    ("nada", ""),
])

cases("str28_plan", lambda c: joined(F.transform(intent.plan(c), lambda s: F.concat_ws(":", s["step_id"].cast("string"), s["step_type"], s["query"], F.array_join(s["depends_on"].cast("array<string>"), "+")))), [
    ("Compara Shor y Grover", "0:retrieve:información sobre Shor: / 1:retrieve:información sobre Grover: / 2:compare:Compara Shor y Grover:0+1"),
    ("Primero explica los qubits y luego las puertas", "0:retrieve:Primero explica los qubits: / 1:retrieve:las puertas:0 / 2:synthesize:Primero explica los qubits y luego las puertas:0+1"),
    ("¿Qué es un qubit?", "0:retrieve:¿Qué es un qubit?:"),
])

cases("str32_topics", intent.topic, [("El algoritmo de Shor factoriza", "Shor"), ("la computación cuántica", "Computación"), ("el oráculo permite buscar", "Oráculo"), ("nada de eso", None), ("", None)])

cases("str34_compute_blocks", lambda c: F.concat_ws("|", F.array_join(science.compute_blocks(c), "+"), science.without_compute(c)), [
    ("  antes <COMPUTE>1 + 1</COMPUTE><RESULT>2</RESULT> ", "1 + 1|antes"), ("\na<COMPUTE>x\ny</COMPUTE>b<COMPUTE>z</COMPUTE>\t", "x\ny+z|ab"), ("sin nada", "|sin nada"), ("<RESULT>3\n4</RESULT> x", "|x"),
])

cases("str35_latex", lambda c: algebra.expression(c), [
    (r"$\frac{a}{b}$", "(a)/(b)"), (r"\sqrt{x}+2x", "sqrt(x)+2*x"), (r"\sqrt[3]{x}", "(x)**(1/3)"), (r"x^{2} \cdot y_1", "x**(2) * y"), (r"2\pi r", "2*pi*r"), (r"\left( x^2 \right)", "( x**2 )"), (r"\displaystyle \infty", "oo"), ("  x   y ", "x*y"),
])

cases("agg28_numeric_verification", lambda a, b: F.concat_ws(":", algebra.equivalent(a, b)["passed"].cast("string"), algebra.equivalent(a, b)["test_points"].cast("string"), algebra.equivalent(a, b)["failures"].cast("string")), [
    ("(x + 1)**2", "x**2 + 2*x + 1", "true:100:0"), ("x + 1", "x + 2", "false:100:100"), ("sin(x)**2 + cos(x)**2", "1", "true:100:0"), ("2 + 2", "4", "true:1:0"), ("2 + 2", "5", "false:1:1"), ("x +", "1", ""), ("__import__('os')", "1", ""),
])

cases("str19_reference_marks", lambda c: F.concat(evaluation.reference(F.length(c)), evaluation.reference(F.length(c), "footnote"), evaluation.reference(F.length(c), "endnote"), evaluation.reference(F.length(c), "other")), [("a", "[1][^1](1)[1]"), ("abc", "[3][^3](3)[3]")])



def _cited() -> Column:
    return F.array(*[F.struct(F.lit(c).alias("chunk_id"), F.lit(d).alias("doc_title"), F.lit(h).alias("header_path")) for c, d, h in (("k1", "Libro", "A > B"), ("k2", "Nota", "C"))])


cases("str19_linked_response", lambda c: F.concat_ws("@", evaluation.linked(c, _cited()), evaluation.linked(c, _cited(), "http://x")), [
    ("Uno [2] y [2].", "Uno [2](#ref-2) y [2].\n\n---\n\n**Referencias:**\n\n<a id='ref-2'></a>**[2]** Nota — _C_@Uno [2](http://x#k2) y [2].\n\n---\n\n**Referencias:**\n\n<a id='ref-2'></a>**[2]** Nota — _C_"),
    ("Sin citas [9].", "Sin citas [9].@Sin citas [9]."),
])


# -- entities: (phrase, name, type, place of the pattern) for two phrases of each text

_FIRST = [("Shor", "Shor", "Algoritmo", 1), ("algoritmo de Grover", "Grover", "Algoritmo", 0), ("puerta Toffoli", "Toffoli", "Gate", 9), ("BB84", "BB84", "Algoritmo", 1), ("Feynman", "Feynman", "Autor", 12), ("variational algorithm", "variational", "Algoritmo", 2), ("nothing here", None, None, None)]
_SECOND = [("qubit", "qubit", "Concepto", 7), ("entanglement", "entanglement", "Concepto", 8), ("protocolo SARG04", "SARG04", "Protocolo", 3), ("CNOT", "CNOT", "Gate", 10), ("protocol COW", "COW", "Protocolo", 4), ("H gate", None, None, None)]
_NAMED = " UNION ALL ".join(f"SELECT doc_id, {_pick([p[1] for p in ps], step=s)} AS name, {_pick([p[2] for p in ps], step=s)} AS type, {_pick([p[3] for p in ps], step=s)} AS pat FROM documents" for ps, s in ((_FIRST, 1), (_SECOND, 7)))


@query(f"SELECT doc_id, lower(name) AS node, name, type, row_number() OVER (PARTITION BY doc_id ORDER BY pat)::INT AS nth FROM ({_NAMED}) WHERE name IS NOT NULL")
def gra1_entity_mentions(spark, sf):
    """Every entity of made texts: name, type, and its place by pattern."""
    from pyspark.sql import Window

    said = F.concat_ws(" ; ", picked([p[0] for p in _FIRST]), picked([p[0] for p in _SECOND], step=7))
    m = graph.mentions(t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), said.alias("content")))
    return m.select(F.col("chunk_id").alias("doc_id"), "node", "name", "type", F.row_number().over(Window.partitionBy("chunk_id").orderBy("ord")).alias("nth"))


_SAID = "¿Qué es el algoritmo de Shor?"
_TOLD = "El algoritmo de shor factoriza.\n1. Primero\n2. Segundo"
_ASKED = [
    ("cuéntame más", "expansion", "cuéntame más sobre Shor"), ("y si hay ruido", "conditional", f"En el contexto de '{_SAID}', y si hay ruido"), ("compara con Grover", "comparison", "compara con Grover"),
    ("explica el punto 2", "reference", "Explica más sobre: Segundo"), ("explica el punto 7", "reference", "explica el punto 7"), ("no entiendo", "clarification", f"{_SAID}: no entiendo"), ("vale gracias", "implicit", f"{_SAID}: vale gracias"),
    ("Describe la transformada de Fourier cuántica completa", "none", "Describe la transformada de Fourier cuántica completa"),
]


@query(f"SELECT c::VARCHAR AS session_id, 0 AS turn, 'none' AS follow_up, {_S(_SAID)} AS expanded FROM (SELECT DISTINCT conv_id AS c FROM conversations) UNION ALL SELECT c::VARCHAR, 2, {_pick([a[1] for a in _ASKED], 'c')}, {_pick([a[2] for a in _ASKED], 'c')} FROM (SELECT DISTINCT conv_id AS c FROM conversations)")
def str31_follow_ups(spark, sf):
    """Sessions of three messages, the last of which is of one of the kinds."""
    s = t(spark, sf, "conversations").select("conv_id").distinct()
    turn = lambda n, role, content: F.struct(F.lit(n).alias("turn"), F.lit(role).alias("role"), content.alias("content"))
    m = s.select(F.col("conv_id").cast("string").alias("session_id"), F.inline(F.array(turn(0, "user", F.lit(_SAID)), turn(1, "assistant", F.lit(_TOLD)), turn(2, "user", picked([a[0] for a in _ASKED], "conv_id")))))
    return records.follow_ups(m).select("session_id", "turn", "follow_up", "expanded")


_X, _Y = "Este es un texto de prueba con bastante longitud para ser una sección.", "Otro texto de prueba que también supera los cincuenta caracteres pedidos."
_MADE = [
    (f"# A\n\n{_X}\n\n## B\n\n{_Y}", [("A", 1, _X), ("A > B", 2, _Y)]), (f"# A\n\n### C\n\n{_X}\n\n## B\n\n{_Y}\n\n# D\n\ncorto", [("A > C", 3, _X), ("A > B", 2, _Y)]),
    (f"{_X}\n\n{_Y}", [("t", 0, f"{_X}\n\n{_Y}")]), (f"# A\n\n{_X}\n\n# B\n\n{_Y}\n\n## E\n\n{_X}", [("A", 1, _X), ("B", 1, _Y), ("B > E", 2, _X)]), ("# A\n\ncorto", []),
]
_PARTS = ", ".join(f"({i}, {n}, {_S(p)}, {lv}, {_text(c)})" for i, (_, parts) in enumerate(_MADE) for n, (p, lv, c) in enumerate(parts))


@query(f"SELECT doc_id, n AS section_seq, p AS header_path, lv AS level, sha256(c) AS section_hash FROM documents JOIN (VALUES {_PARTS}) AS m(i, n, p, lv, c) ON doc_id % {len(_MADE)} = i")
def prj1_sections(spark, sf):
    """Sections of nested headings, of a text without any, and of short texts."""
    d = t(spark, sf, "documents").select("doc_id", F.lit("t").alias("doc_title"), picked([m[0] for m in _MADE]).alias("text"))
    return markdown.sections(d).select("doc_id", "section_seq", "header_path", "level", "section_hash")


_LINES = ['{"prompt": "a", "completion": "b"}', '{"query": "q", "pos": "p", "neg": "n"}', '{"prompt": "a"}', "", "no json", '{"prompt": "c", "completion": "d"}', "  "]


@query("WITH n AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (event_id % {len(_LINES)} = {i}) AS n{i}" for i in range(len(_LINES))) + " FROM events) SELECT total AS total_lines, n0 + n1 + n5 AS valid_lines, n0 + n1 + n5 - 3 AS duplicates, n0 + n5 AS pairs, n1 AS triplets, n2 + n4 AS errors FROM n")
def agg25_validate_jsonl(spark, sf):
    """Pairs, triplets, repeated, broken and blank lines."""
    return records.validate_jsonl(t(spark, sf, "events").select(picked(_LINES, "event_id").alias("value")))


@query("SELECT doc_id AS id, s.step, s.rule_id, s.expression FROM documents JOIN (VALUES (0, 1, 'r1', '2 a'), (0, 2, 'r2', 'a 2'), (3, 1, 'r1', 'z + z'), (4, 1, 'r4', 'b + a')) AS s(i, step, rule_id, expression) ON doc_id % 5 = s.i")
def gra7_rewrite(spark, sf):
    """Rules apply to an expression with other names of variables, not to one of another shape or with two names for one."""
    rules = spark.createDataFrame([("r1", "x + x", "2 x", True, True), ("r2", "2 x", "x 2", True, False), ("r3", "q - 1", "q", False, True), ("r4", "x + 3 y", "y + x", True, False)], "rule_id string, lhs string, rhs string, verified boolean, bidirectional boolean")
    e = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), picked(["a + a", "q - 1", "a + b", "2 z", "a + 3 b"]).alias("expression"))
    return formulas.rewrite(e, rules, 2)


@query("SELECT doc_id AS plan_id, s.step_id, s.level FROM documents JOIN (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0)) AS s(i, step_id, level) ON doc_id % 3 = s.i")
def gra9_plan_levels(spark, sf):
    """A chain, two steps that a third one needs, and a cycle beside a free step."""
    steps = lambda *needs: F.array(*[F.struct(F.lit(i).alias("step_id"), F.array(*[F.lit(x) for x in n]).cast("array<int>").alias("depends_on")) for i, n in enumerate(needs)])
    plans = F.element_at(F.array(steps([], [0], [1]), steps([], [], [0, 1]), steps([], [2], [1])), (F.col("doc_id") % 3 + 1).cast("int"))
    s = t(spark, sf, "documents").select(F.col("doc_id").alias("plan_id"), F.inline(plans))
    return graph.plan_levels(s)


_COMPLETIONS = [
    ('{"chunks": [{"index": 0, "queries": [{"query": "what is a qubit", "type": "factual", "difficulty": "easy"}, "how are qubits read", {"query": "short"}]}, {"index": 1, "queries": ["why entanglement matters"]}]}', [("a", "what is a qubit", "factual", "easy"), ("a", "how are qubits read", "general", "medium"), ("b", "why entanglement matters", "general", "medium")]),
    ("no json", []), ('[{"queries": ["first of the list here"]}, {"index": 9, "queries": ["of no chunk at all"]}, 5]', [("a", "first of the list here", "general", "medium")]), ('{"other": [{"index": 1, "queries": [{"query": "under another name"}, 7]}]}', [("b", "under another name", "general", "medium")]),
]


@query(f"SELECT s.chunk_id, s.query, s.query_type, s.difficulty, count(*) AS n FROM documents JOIN (VALUES {', '.join(f'({i}, {_S(c)}, {_S(q)}, {_S(k)}, {_S(d)})' for i, (_, rows) in enumerate(_COMPLETIONS) for c, q, k, d in rows)}) AS s(i, chunk_id, query, query_type, difficulty) ON doc_id % {len(_COMPLETIONS)} = s.i GROUP BY ALL")
def udf18_parse_queries(spark, sf):
    """Generated training queries in all the shapes that answers come in."""
    a = t(spark, sf, "documents").select(F.array(F.lit("a"), F.lit("b")).alias("chunk_ids"), picked([c for c, _ in _COMPLETIONS]).alias("completion"))
    return stores.parse_queries(a).groupBy("chunk_id", "query", "query_type", "difficulty").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT item_id AS query_id FROM benchmark), h AS (SELECT item_id AS query_id, d AS chunk_id, (item_id % 7) / 1000 + d / 100000 AS score FROM benchmark, (VALUES (1), (2), (3), (4)) AS x(d) WHERE item_id % 3 > 0) SELECT q.query_id, round(max(score), 9) AS best, coalesce(max(score) < 0.002, true) AS abstained, coalesce(string_agg(chunk_id::VARCHAR, ',' ORDER BY score DESC) FILTER (chunk_id > 1), '') AS closest FROM q LEFT JOIN h USING (query_id) GROUP BY q.query_id")
def flt14_abstain(spark, sf):
    """Queries with good, with bad and without any hits."""
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    h = q.where("query_id % 3 > 0").select("query_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("chunk_id"))
    h = h.withColumn("score", (F.col("query_id") % 7) / 1000 + F.col("chunk_id") / 100000)
    return retrieval.abstain(h, queries=q).select("query_id", F.round("best", 9).alias("best"), "abstained", F.array_join(F.col("closest").cast("array<string>"), ",").alias("closest"))


# -- steps that a model may take over: the model repeats the last column it is shown, which here is its reply


def echoed(prompts: list[str]) -> list[str | None]:
    return [p.split("\n\n")[-1].partition(": ")[2] for p in prompts]


def replies(name: str, step: models.Step, table: list[tuple]) -> None:
    """Registers a step over the documents' ids, each reply of `table` in turn, and in SQL the results as JSON and whether they are the model's."""
    inputs, wanted, own = (list(x) for x in zip(*table, strict=True))

    def run(spark, sf):
        shown = [(picked(inputs) if c == step.shows[-1] else F.lit("a > b" if c == "header_path" else "qubit")).alias(c) for c in step.shows]
        out = models.take(t(spark, sf, "documents").select("doc_id", *shown), step, "result", echoed)
        return out.select("doc_id", F.to_json(F.struct("result")).alias("result"), "by_model")

    run.__name__ = name
    _QUERIES[name] = run
    _SQL[name] = f"SELECT doc_id, {_pick(wanted)} AS result, {_pick(own)} AS by_model FROM documents"


replies("udf9_difficulty", models.DIFFICULTY, [
    ('{"level": "advanced", "confidence": 0.9, "reasoning": "proofs"}', '{"result":{"level":"advanced","confidence":0.9,"reasoning":"proofs"}}', True),
    ('Sure: {"level": "hard"}', '{"result":{"level":"intermediate","confidence":0.7,"reasoning":"llm_classified"}}', True),
])
replies("udf10_route", models.ROUTE, [
    ('{"strategy": "BM25_ONLY", "top_k": 5}', '{"result":{"strategy":"bm25_only","vector_weight":0.5,"bm25_weight":0.3,"graph_weight":0.2,"top_k":5,"sub_queries":[]}}', True),
    ('{"strategy": "MULTI_HOP", "vector_weight": 0.25, "sub_queries": ["a", "b"]}', '{"result":{"strategy":"multi_hop","vector_weight":0.25,"bm25_weight":0.3,"graph_weight":0.2,"top_k":10,"sub_queries":["a","b"]}}', True),
    ("no idea", '{"result":{"strategy":"hybrid","vector_weight":0.5,"bm25_weight":0.3,"graph_weight":0.2,"top_k":10,"sub_queries":[]}}', False),
    ('{"strategy": "GUESS"}', '{"result":{"strategy":"hybrid","vector_weight":0.5,"bm25_weight":0.3,"graph_weight":0.2,"top_k":10,"sub_queries":[]}}', False),
])
replies("udf5_section", models.SECTION, [
    ('{"section_hierarchy": ["Part", "Gates"], "section_number": "2.1"}', '{"result":{"section_hierarchy":["Part","Gates"],"section_number":"2.1","topic_summary":"","confidence":1.0}}', True),
    ("Section 3.2 says that gates are reversible. It ends.", '{"result":{"section_hierarchy":["a","b"],"section_number":"3.2","topic_summary":"Section 3.2 says that gates are reversible","confidence":0.5}}', False),
])
replies("udf6_prefix", models.PREFIX, [("  It opens the chapter.  ", '{"result":"It opens the chapter."}', True), ("   ", '{"result":"Este fragmento pertenece al documento \'qubit\', sección \'a > b\'."}', False)])
replies("udf4_image", models.IMAGE, [("a circuit of two gates", '{"result":"a circuit of two gates"}', True), ("", '{"result":"[Imagen no procesada: ]"}', False)])
replies("udf7_propositions", models.PROPOSITION, [
    ('["A qubit holds a superposition of states.", "short", "A qubit holds a superposition of states."]', '{"result":["A qubit holds a superposition of states."]}', True),
    ('{"0": ["Measurement makes a qubit collapse at once."]}', '{"result":["Measurement makes a qubit collapse at once."]}', True),
    ("A plain reply.", '{"result":["A plain reply."]}', False),
])
replies("udf8_triples", models.TRIPLES, [
    ('{"entities": [{"name": "Shor"}, {"name": "", "type": "x"}], "triples": [{"source": "Shor", "target": "RSA", "relation": "BREAKS", "confidence": 0.75}, {"source": "A"}]}',
     '{"result":{"entities":[{"name":"Shor","type":"Concepto"}],"triples":[{"source":"Shor","source_type":"Concepto","relation":"BREAKS","target":"RSA","target_type":"Concepto","confidence":0.75},{"source":"A","source_type":"Concepto","relation":"CO_OCCURS","target":"","target_type":"Concepto","confidence":0.5}]}}', True),
    ("{broken", '{"result":{"entities":[],"triples":[]}}', False),
])
replies("udf11_relevance", models.RELEVANT, [
    ('{"verdict": "CORRECT", "confidence": "0.8"}', '{"result":{"verdict":"correct","confidence":0.8}}', True), ("a qubit", '{"result":{"verdict":"correct","confidence":1.0}}', False),
    ('{"verdict": "maybe", "confidence": "high"}', '{"result":{"verdict":"incorrect","confidence":0.0}}', False), ('{"verdict": "maybe"}', '{"result":{"verdict":"ambiguous","confidence":0.5}}', True),
])
replies("udf12_needs_search", models.NEEDS_SEARCH, [('{"decision": "NO_RETRIEVE"}', '{"result":"no_retrieve"}', True), ("no", '{"result":"retrieve"}', False)])
replies("res18_reflection", models.REFLECTION, [
    ('{"is_sufficient": true, "missing_aspects": ["dates"]}', '{"result":{"is_sufficient":true,"confidence":0.3,"missing_aspects":["dates"],"reasoning":""}}', True),
    ("yes", '{"result":{"is_sufficient":false,"confidence":0.3,"missing_aspects":["unreadable reflection"],"reasoning":"unreadable reply"}}', False),
])
replies("res19_sub_questions", models.SUB_QUESTION, [('Here: ["a?", "b?", "c?", "d?", "e?"]', '{"result":["a?","b?","c?","d?"]}', True), ("what is a gate", '{"result":["what is a gate"]}', False)])
replies("udf11_reworded", models.REWORDED, [('"which gates"', '{"result":"which gates"}', True), ("  ", "{}", False)])
