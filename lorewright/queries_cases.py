"""Registered queries of the functions and steps whose rules need texts of a certain form: the texts are made of the tables' own words, and SQL works the results out again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions import algebra, answers, intent, science, text
from lorewright.operators import formulas, graph, records, retrieval
from lorewright.plans import evaluation, flows, models
from lorewright.queries import _COS, _INDEX, _LABELS, _S, _TERMS, Query, _bm25, _label_hits, _sentences, _vector_hits, sessions, t

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


# -- the documents with three of their words (a, b, c), their text without line ends (x) and its length (n)

_WORDS = "[a-z]{3,}"
_D = rf"d AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, coalesce(text, '') AS text, coalesce(length(text), 0) AS n, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x, 'q' || coalesce(w[1], 'nada') AS a, 'r' || coalesce(w[2], 'nada') AS b, 's' || coalesce(w[3], 'nada') AS c FROM (SELECT *, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM documents))"


def docs(spark, sf) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0))
    word = lambda i, first: F.concat(F.lit(first), F.coalesce(F.get(F.col("w"), F.lit(i)), F.lit("nada")))
    d = t(spark, sf, "documents").withColumn("w", w)
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    full = F.coalesce("text", F.lit(""))
    return d.select("doc_id", none("source"), none("lang"), full.alias("text"), F.length(full).alias("n"), F.trim(F.regexp_replace(full, r"\s+", " ")).alias("x"), word(0, "q").alias("a"), word(1, "r").alias("b"), word(2, "s").alias("c"))


def says(name: str, f: Callable[[], Column], wanted: str) -> None:
    """Registers `f` over the documents, and the SQL expression that says the same of them."""

    def run(spark, sf):
        return docs(spark, sf).select("doc_id", f().alias("result"))

    run.__name__ = name
    _QUERIES[name], _SQL[name] = run, f"WITH {_D} SELECT doc_id, {wanted} AS result FROM d"


def cat(*parts: str) -> Column:
    """Columns by name; what stands in quotes is text."""
    return F.concat(*[F.lit(p[1:-1]) if p.startswith("'") else F.col(p).cast("string") for p in parts])


def odd(yes: Column, no: Column) -> Column:
    return F.when(F.col("n") % 2 == 1, yes).otherwise(no)


def joined(c: Column) -> Column:
    return F.array_join(c, " / ")


def _code() -> Column:
    code = F.concat(cat("'# '", "a", "'\nimport '", "a", "', os.'", "b", "'\ny = eval(\"'", "c", "'\")\ndef '", "a", "'(n):\n    return '"), odd(F.col("a"), F.col("b")), F.lit("(n - 1)"))
    v = science.validate_code(code)
    return F.concat(v["valid"].cast("string"), F.lit(" "), F.array_join(F.transform(v["issues"], lambda i: F.format_string("%s:%s:%d", i["severity"], i["what"], i["line"])), ", "))


says("flt15_validate_code", _code, "'false error:import os.' || b || ':2, error:call eval:3' || CASE WHEN n % 2 = 1 THEN ', warning:recursion ' || a || ':4' ELSE '' END")

_LATEX = "list_concat(" + ", ".join(f"CASE WHEN contains(text, {_S(c)}) THEN [{', '.join(map(_S, v))}] ELSE [] END" for c, v in text.LATEX_TERMS.items()) + f", {_TERMS})"
says("str5_searchable_text", lambda: F.sha2(text.searchable_text(cat("text", "' el qubit $'", "a", "' + \\sum_{'", "b", "'}$'")), 256), f"(SELECT sha256(y || CASE WHEN len(m) = 0 THEN '' ELSE ' | Términos: ' || array_to_string(m[1:30], ', ') END) FROM (SELECT y, list_sort(list_distinct({_LATEX.replace('text', 'y')}))[1:50] AS m FROM (SELECT text || ' el qubit $' || a || ' + \\sum_{{' || b || '}}$' AS y)))")

says("str28_plan", lambda: joined(F.transform(intent.plan(odd(cat("'Primero explica '", "a", "' y luego '", "b"), cat("'Compara '", "a", "' y '", "b"))), lambda s: F.concat_ws(":", s["step_id"].cast("string"), s["step_type"], s["query"], F.array_join(s["depends_on"].cast("array<string>"), "+")))),
     "CASE WHEN n % 2 = 1 THEN '0:retrieve:Primero explica ' || a || ': / 1:retrieve:' || b || ':0 / 2:synthesize:Primero explica ' || a || ' y luego ' || b || ':0+1' ELSE '0:retrieve:información sobre ' || a || ': / 1:retrieve:información sobre ' || b || ': / 2:compare:Compara ' || a || ' y ' || b || ':0+1' END")

says("str29_decompose", lambda: joined(intent.decompose(F.when(F.col("n") % 4 == 0, cat("'Compara '", "a", "' y '", "b")).when(F.col("n") % 4 == 1, cat("'relación entre '", "a", "' y '", "b")).when(F.col("n") % 4 == 2, cat("a", "' '", "b", "' y además '", "c")).otherwise(cat("a", "' '", "b")))),
     "CASE n % 4 WHEN 0 THEN '¿Qué es ' || a || '? / ¿Qué es ' || b || '? / Diferencias entre ' || a || ' y ' || b WHEN 1 THEN '¿Qué es ' || a || '? / ¿Qué es ' || b || '? / ¿Cómo se relacionan ' || a || ' y ' || b || '?' WHEN 2 THEN a || ' ' || b || ' / ' || c || ' / ' || a || ' ' || b || ' y además ' || c ELSE a || ' ' || b END")

says("str30_variants", lambda: joined(intent.variants(odd(cat("'¿Qué es '", "a", "' del algoritmo?'"), cat("'¿Cómo medir '", "b", "'?'")))),
     "CASE WHEN n % 2 = 1 THEN 'definición de ' || a || ' del algoritmo / ' || a || ' del algoritmo explicación / ¿Qué es ' || a || ' del protocolo?' ELSE 'procedimiento para medir ' || b || ' / pasos para medir ' || b END")

says("str32_topics", lambda: intent.topic(cat("'El algoritmo de '", "a", "' '", "x")), "upper(substr(a, 1, 1)) || substr(a, 2)")

says("str34_compute_blocks", lambda: F.concat_ws("|", F.array_join(science.compute_blocks(cat("' '", "a", "' <COMPUTE>'", "b", "' = '", "n", "'</COMPUTE>'", "x", "'<RESULT>'", "n", "'</RESULT><COMPUTE>'", "c", "'</COMPUTE> '")), "+"), F.sha2(science.without_compute(cat("' '", "a", "' <COMPUTE>'", "b", "' = '", "n", "'</COMPUTE>'", "x", "'<RESULT>'", "n", "'</RESULT><COMPUTE>'", "c", "'</COMPUTE> '")), 256)),
     "b || ' = ' || n || '+' || c || '|' || sha256(trim(a || ' ' || x))")

says("str35_latex", lambda: algebra.expression(cat("'$\\frac{'", "a", "'}{'", "b", "'} + \\sqrt{'", "c", "'}^{'", "n", "'}$'")), "'(' || a || ')/(' || b || ') + sqrt(' || c || ')**(' || n || ')'")


def _same() -> Column:
    k, m = (F.col("n") % 50 + 1).cast("string"), F.col("n") % 50 + 1
    e = algebra.equivalent(F.concat(F.lit("(x + "), k, F.lit(")**2")), F.concat(F.lit("x**2 + "), (2 * m).cast("string"), F.lit("*x + "), (m * m + F.col("n") % 2).cast("string")))
    return F.concat_ws(":", e["passed"].cast("string"), e["test_points"].cast("string"), e["failures"].cast("string"))


says("agg28_numeric_verification", _same, "CASE WHEN n % 2 = 1 THEN 'false:100:100' ELSE 'true:100:0' END")

says("str19_reference_marks", lambda: F.concat(*[evaluation.reference(F.col("n"), s) for s in ("inline", "footnote", "endnote", "other")]), "'[' || n || '][^' || n || '](' || n || ')[' || n || ']'")


def _linked() -> Column:
    cited = F.array(F.struct(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_title"), F.col("lang").alias("header_path")), F.struct(F.lit("k").alias("chunk_id"), F.col("b").alias("doc_title"), F.col("c").alias("header_path")))
    said = F.concat(cat("a", "' [1] y [7] '", "b"), odd(F.lit(" [2] [1]."), F.lit(".")))
    return F.concat_ws("@", evaluation.linked(said, cited), evaluation.linked(said, cited, "http://x"))


def _linked_sql(one: str, two: str) -> str:
    entry = lambda n, title, path: f"chr(10) || '<a id=''ref-{n}''></a>**[{n}]** ' || {title} || ' — _' || {path} || '_'"
    return f"a || ' [1]' || {one} || ' y [7] ' || b || CASE WHEN n % 2 = 1 THEN ' [2]' || {two} || ' [1].' ELSE '.' END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Referencias:**' || chr(10) || {entry(1, 'source', 'lang')} || CASE WHEN n % 2 = 1 THEN {entry(2, 'b', 'c')} ELSE '' END"


says("str19_linked_response", _linked, f"{_linked_sql(_S('(#ref-1)'), _S('(#ref-2)'))} || '@' || {_linked_sql(chr(39) + '(http://x#' + chr(39) + ' || doc_id || ' + _S(')'), _S('(http://x#k)'))}")

_F = r"CASE n % 4 WHEN 0 THEN '\sum_{' || a || '}^{' || n || '} \frac{' || b || '}{2}' WHEN 1 THEN '\int_0^' || n || ' \sqrt{' || a || '}' WHEN 2 THEN '|' || a || '\rangle \otimes \langle ' || b || '|' ELSE '\lim ' || a || ' + \rho \hat{H} + \int ' || b || ' \sum ' || c END"


@query(rf"WITH {_D} SELECT doc_id, CASE WHEN n % 4 = 0 THEN 'sumatorio con límites, fracción' WHEN n % 4 = 1 THEN 'integral definida, raíz cuadrada' WHEN n % 4 = 2 THEN 'estado cuántico ket, bra estado dual, producto tensorial' ELSE 'sumatorio, integral, límite, Hamiltoniano u operador Hadamard, matriz de densidad' END AS description FROM d")
def str3_formula_description(spark, sf):
    """All ten rules, on formulas with the documents' words."""
    n = F.col("n") % 4
    f = F.when(n == 0, cat("'\\sum_{'", "a", "'}^{'", "n", "'} \\frac{'", "b", "'}{2}'")).when(n == 1, cat("'\\int_0^'", "n", "' \\sqrt{'", "a", "'}'")).when(n == 2, cat("'|'", "a", "'\\rangle \\otimes \\langle '", "b", "'|'")).otherwise(cat("'\\lim '", "a", "' + \\rho \\hat{H} + \\int '", "b", "' \\sum '", "c"))
    return docs(spark, sf).select("doc_id", text.formula_description(f).alias("description"))


@query("SELECT doc_id, CASE WHEN k <= 4000 THEN 'none' WHEN 4000 / k > 0.8 THEN 'light' WHEN 4000 / k > 0.5 THEN 'medium' ELSE 'aggressive' END AS level FROM (SELECT doc_id, coalesce(length(text), 0) AS k FROM documents)")
def str14_compression_level(spark, sf):
    """The level for each document, were its characters tokens."""
    return docs(spark, sf).select("doc_id", answers.compression_level(F.col("n")).alias("level"))


# -- entities of whole texts, with some named before them

_W = r"[\p{L}\p{N}\p{M}_]"
_ALL_PATTERNS = [(k, p) for k, ps in graph.ENTITY_PATTERNS.items() for p in ps]
_ENTITIES = " UNION ALL ".join(f"SELECT doc_id, {i} AS pat, generate_subscripts(l, 1) AS i, trim(unnest(l)) AS name, {_S(k)} AS type FROM (SELECT doc_id, regexp_extract_all(y, {_S(p.replace(chr(92) + 'w', _W))}, 1, 'i') AS l FROM s)" for i, (k, p) in enumerate(_ALL_PATTERNS))


@query(f"WITH {_D}, s AS (SELECT doc_id, 'El algoritmo de ' || a || '. Un Qubit, protocol ' || b || ' y la puerta ' || c || '. ' || text AS y FROM d), e AS ({_ENTITIES}), f AS (SELECT * FROM e WHERE length(name) > 1 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pat, i) = 1) SELECT doc_id, lower(name) AS node, name, type, row_number() OVER (PARTITION BY doc_id ORDER BY pat, i)::INT AS nth FROM f")
def gra1_entity_mentions(spark, sf):
    said = cat("'El algoritmo de '", "a", "'. Un Qubit, protocol '", "b", "' y la puerta '", "c", "'. '", "text")
    m = graph.mentions(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), said.alias("content")))
    return m.select(F.col("chunk_id").alias("doc_id"), "node", "name", "type", F.row_number().over(Window.partitionBy("chunk_id").orderBy("ord")).alias("nth"))


# -- follow-ups to what a conversation's user said first

_SAID = "c AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS said, 'z' || coalesce(arg_min(regexp_extract(lower(text), '[a-z]{3,}'), turn) FILTER (role = 'assistant'), 'nada') AS w FROM conversations GROUP BY conv_id HAVING said IS NOT NULL)"


@query(
    f"WITH {_SAID} SELECT conv_id::VARCHAR AS session_id, CASE conv_id % 6 WHEN 0 THEN 'expansion' WHEN 1 THEN 'conditional' WHEN 2 THEN 'comparison' WHEN 3 THEN 'reference' WHEN 4 THEN 'clarification' ELSE 'implicit' END AS follow_up, CASE conv_id % 6 WHEN 0 THEN 'cuéntame más sobre ' || upper(substr(w, 1, 1)) || substr(w, 2) WHEN 1 THEN 'En el contexto de ''' || said || ''', y si ' || w WHEN 2 THEN 'compara con ' || w WHEN 3 THEN 'Explica más sobre: ' || w || ' dos' WHEN 4 THEN said || ': no entiendo ' || w ELSE said || ': ' || w || ' gracias' END AS expanded FROM c"
)
def str31_follow_ups(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("said"), F.min_by(F.when(F.col("role") == "assistant", F.regexp_extract(F.lower("text"), "[a-z]{3,}", 0)), F.when(F.col("role") == "assistant", F.col("turn"))).alias("w"))
    c = c.where("said is not null").withColumn("w", F.concat(F.lit("z"), F.coalesce("w", F.lit("nada"))))
    n = F.col("conv_id") % 6
    asked = F.when(n == 0, F.lit("cuéntame más")).when(n == 1, cat("'y si '", "w")).when(n == 2, cat("'compara con '", "w")).when(n == 3, F.lit("explica el punto 2")).when(n == 4, cat("'no entiendo '", "w")).otherwise(cat("w", "' gracias'"))
    turn = lambda i, role, content: F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role"), content.alias("content"))
    m = c.select(F.col("conv_id").cast("string").alias("session_id"), F.inline(F.array(turn(0, "user", F.col("said")), turn(1, "assistant", cat("'El algoritmo de '", "w", "'\n1. '", "w", "' uno\n2. '", "w", "' dos'")), turn(2, "user", asked))))
    return records.follow_ups(m).where("turn = 2").select("session_id", "follow_up", "expanded")


# -- sections of documents with headings of their own words over the two halves of the text

_STRIP = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query(
    f"""WITH {_D}, h AS (SELECT doc_id, a, b, {_STRIP("replace(substr(text, 1, n // 2), '#', '')")} AS one, {_STRIP("replace(substr(text, n // 2 + 1), '#', '')")} AS two FROM d),
    p AS (SELECT doc_id, 0 AS o, a AS header_path, 1 AS level, one AS c FROM h UNION ALL SELECT doc_id, 1, a || ' > ' || b, 2, two FROM h)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS section_seq, header_path, level::INT AS level, sha256(c) AS section_hash FROM p WHERE length(c) >= 50"""
)
def prj1_sections(spark, sf):
    half = lambda start, size: F.replace(F.substring("text", start, size), F.lit("#"), F.lit(""))
    m = F.floor(F.col("n") / 2).cast("int")
    md = F.concat(cat("'# '", "a", "'\n\n'"), half(F.lit(1), m), cat("'\n\n## '", "b", "'\n\n'"), half(m + 1, F.col("n")))
    d = docs(spark, sf).select("doc_id", F.lit("t").alias("doc_title"), md.alias("text"))
    return markdown.sections(d).select("doc_id", "section_seq", "header_path", "level", "section_hash")


@query(
    f"""WITH {_D}, l AS (SELECT CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 'q' || a || b || c ELSE 'p' || x || lang END AS v, n % 5 AS k FROM d)
    SELECT count(*) AS total_lines, count(v) AS valid_lines, count(v) - count(DISTINCT v) AS duplicates, count(v) FILTER (k > 1) AS pairs, count(v) FILTER (k = 1) AS triplets, count(*) FILTER (k = 0 AND a <> '') AS errors FROM l, (SELECT 'x' AS a)"""
)
def agg25_validate_jsonl(spark, sf):
    """Pairs of texts and languages, triplets of words, and lines that are cut off."""
    k = F.col("n") % 5
    pair, triplet = F.to_json(F.struct(F.col("x").alias("prompt"), F.col("lang").alias("completion"))), F.to_json(F.struct(F.col("a").alias("query"), F.col("b").alias("pos"), F.col("c").alias("neg")))
    return records.validate_jsonl(docs(spark, sf).select(F.when(k == 0, F.substring(pair, 1, 12)).when(k == 1, triplet).otherwise(pair).alias("value")))


@query(f"WITH {_D}, l AS (SELECT doc_id, n, substr(a, 2, 1) AS l FROM d) SELECT doc_id AS id, 1 AS step, CASE WHEN n % 2 = 1 THEN 'r1' ELSE 'r4' END AS rule_id, CASE WHEN n % 2 = 1 THEN '2 ' || l ELSE l || ' - 7' END AS expression FROM l UNION ALL SELECT doc_id, 2, 'r2', l || ' 2' FROM l WHERE n % 2 = 1")
def gra7_rewrite(spark, sf):
    """A document's letter, doubled or less than seven, rewritten by rules with other names."""
    rules = spark.createDataFrame([("r1", "x + x", "2 x", True, False), ("r2", "2 x", "x 2", True, False), ("r3", "7 y", "y", False, True), ("r4", "k + 7", "k - 7", True, False)], "rule_id string, lhs string, rhs string, verified boolean, bidirectional boolean")
    letter = F.substring("a", 2, 1)
    e = docs(spark, sf).select(F.col("doc_id").alias("id"), odd(F.concat(letter, F.lit(" + "), letter), F.concat(letter, F.lit(" + 7"))).alias("expression"))
    return formulas.rewrite(e, rules, 3)


@query(
    """WITH l AS (SELECT l_orderkey AS plan_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS step_id, l_quantity > 25 AS after FROM lineitem)
    SELECT plan_id, step_id, (step_id - max(CASE WHEN step_id = 0 OR NOT after THEN step_id END) OVER (PARTITION BY plan_id ORDER BY step_id))::INT AS level FROM l"""
)
def gra9_plan_levels(spark, sf):
    """An order's lines as steps: those of large quantities wait for the line before."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.row_number().over(by) - 1).alias("step_id"), (F.col("l_quantity") > 25).alias("after"))
    needs = F.when((F.col("step_id") > 0) & F.col("after"), F.array(F.col("step_id") - 1)).otherwise(F.array().cast("array<int>"))
    return graph.plan_levels(l.select("plan_id", "step_id", needs.alias("depends_on"))).select("plan_id", "step_id", F.col("level").cast("int").alias("level"))


@query(f"WITH {_D} SELECT doc_id::VARCHAR AS chunk_id, a || ' or ' || b AS query, lang AS query_type, 'medium' AS difficulty FROM d WHERE length(a || ' or ' || b) >= 10 UNION ALL SELECT 'n' || doc_id, x, 'general', 'hard' FROM d WHERE length(x) >= 10")
def udf18_parse_queries(spark, sf):
    """Generated queries as JSON of a document's words, language and whole text."""
    one = F.struct(F.lit(0).alias("index"), F.array(F.struct(cat("a", "' or '", "b").alias("query"), F.col("lang").alias("type"))).alias("queries"))
    two = F.struct(F.lit(1).alias("index"), F.array(F.struct(F.col("x").alias("query"), F.lit("hard").alias("difficulty"))).alias("queries"))
    body = F.concat(F.lit('{"chunks": ['), F.to_json(one), F.lit(", "), F.to_json(two), F.lit("]}"))
    d = docs(spark, sf).select(F.array(F.col("doc_id").cast("string"), cat("'n'", "doc_id")).alias("chunk_ids"), F.when(F.col("n") >= 0, body).alias("completion"))
    return stores.parse_queries(d)


@query(f"WITH {_INDEX}, h AS (SELECT * FROM bm WHERE query_id % 3 > 0) SELECT i.item_id AS query_id, max(score) AS best, coalesce(max(score) < 60, true) AS abstained, coalesce(string_agg(chunk_id::VARCHAR, ',' ORDER BY score DESC, chunk_id) FILTER (rank <= 3), '') AS closest FROM benchmark i LEFT JOIN h ON query_id = item_id GROUP BY i.item_id")
def flt14_abstain(spark, sf):
    """Lexical hits of the benchmark's items, a third of which are taken away."""
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    h = _bm25(spark, sf).where("query_id % 3 > 0").select("query_id", "chunk_id", "score")
    return retrieval.abstain(h, 60, queries=q).select("query_id", "best", "abstained", F.array_join(F.col("closest").cast("array<string>"), ",").alias("closest"))


# -- steps that a model may take over: the model repeats the last column it is shown, which here is its reply, made of the document's words


def echoed(prompts: list[str]) -> list[str | None]:
    return [p.split("\n\n")[-1].partition(": ")[2] for p in prompts]


def replies(name: str, step: models.Step, reply: Callable[[], Column], wanted: str, by_model: str = "true") -> None:
    """Registers a step over the documents, whose reply `reply` makes; in SQL, the result as JSON and whether it is the model's."""

    def run(spark, sf):
        shown = {"doc_title": F.col("source"), "header_path": F.concat_ws(" > ", "source", "lang"), "query": F.col("c"), "content": F.col("x"), "context": F.col("x"), "answer": F.col("x"), "path": F.col("x")} | {step.shows[-1]: reply()}
        out = models.take(docs(spark, sf).select("doc_id", *[shown[c].alias(c) for c in step.shows]), step, "result", echoed)
        return out.select("doc_id", F.to_json(F.struct("result")).alias("result"), "by_model")

    run.__name__ = name
    _QUERIES[name], _SQL[name] = run, f"WITH {_D} SELECT doc_id, {wanted} AS result, {by_model} AS by_model FROM d"


_ODD = "n % 2 = 1"
replies("udf9_difficulty", models.DIFFICULTY, lambda: odd(cat("'{\"level\": \"advanced\", \"confidence\": 0.5, \"reasoning\": \"'", "a", "'\"}'"), cat("'Sure, '", "a", "': {\"level\": \"'", "b", "'\"}'")),
        """'{"result":{"level":"' || CASE WHEN n % 2 = 1 THEN 'advanced","confidence":0.5,"reasoning":"' || a ELSE 'intermediate","confidence":0.7,"reasoning":"llm_classified' END || '"}}'""")  # fmt: skip
replies("udf10_route", models.ROUTE, lambda: cat("'{\"strategy\": \"MULTI_HOP\", \"vector_weight\": 0.25, \"top_k\": '", "n", "', \"sub_queries\": [\"'", "a", "'\", \"'", "b", "'\"]}'"),
        """'{"result":{"strategy":"multi_hop","vector_weight":0.25,"bm25_weight":0.3,"graph_weight":0.2,"top_k":' || n || ',"sub_queries":["' || a || '","' || b || '"]}}'""")  # fmt: skip
replies("udf5_section", models.SECTION, lambda: cat("'{\"section_hierarchy\": [\"'", "a", "'\", \"'", "b", "'\"], \"section_number\": \"'", "n", "'.1\", \"topic_summary\": \"'", "c", "'\"}'"),
        """'{"result":{"section_hierarchy":["' || a || '","' || b || '"],"section_number":"' || n || '.1","topic_summary":"' || c || '","confidence":1.0}}'""")  # fmt: skip
replies("udf6_prefix", models.PREFIX, lambda: odd(cat("'  It is about '", "a", "' and '", "b", "'.  '"), F.lit("   ")),
        """'{"result":"' || CASE WHEN n % 2 = 1 THEN 'It is about ' || a || ' and ' || b || '.' ELSE 'Este fragmento pertenece al documento ''' || source || ''', sección ''' || source || ' > ' || lang || '''.' END || '"}'""", _ODD)  # fmt: skip
replies("udf4_image", models.IMAGE, lambda: odd(cat("a", "'/'", "b", "'.png'"), F.lit("")), """'{"result":"' || CASE WHEN n % 2 = 1 THEN a || '/' || b || '.png' ELSE '[Imagen no procesada: ]' END || '"}'""", _ODD)
_LONG = "a || ' holds what ' || b || ' says of it, and ' || c || ' too.'"
replies("udf7_propositions", models.PROPOSITION, lambda: odd(cat("'[\"'", "a", "' holds what '", "b", "' says of it, and '", "c", "' too.\", \"'", "a", "'\"]'"), cat("'{\"0\": [\"'", "a", "' holds what '", "b", "' says of it, and '", "c", "' too.\"]}'")), f"""'{{"result":["' || {_LONG} || '"]}}'""")
replies("udf8_triples", models.TRIPLES, lambda: cat("'{\"entities\": [{\"name\": \"'", "a", "'\"}, {\"name\": \"\"}], \"triples\": [{\"source\": \"'", "a", "'\", \"target\": \"'", "b", "'\", \"relation\": \"'", "c", "'\", \"confidence\": 0.75}, {\"source\": \"'", "c", "'\"}]}'"),
        """'{"result":{"entities":[{"name":"' || a || '","type":"Concepto"}],"triples":[{"source":"' || a || '","source_type":"Concepto","relation":"' || c || '","target":"' || b || '","target_type":"Concepto","confidence":0.75},{"source":"' || c || '","source_type":"Concepto","relation":"CO_OCCURS","target":"","target_type":"Concepto","confidence":0.5}]}}'""")  # fmt: skip
# a verdict with and without a number; a number that can't be read, and no JSON at all: then the overlap with the query (c) decides
_REPLY = lambda: F.when(F.col("n") % 4 == 0, cat("'{\"verdict\": \"'", "a", "'\"}'")).when(F.col("n") % 4 == 1, cat("'{\"verdict\": \"CORRECT\", \"confidence\": \"0.8\", \"why\": \"'", "a", "'\"}'")).when(F.col("n") % 4 == 2, cat("'{\"verdict\": \"'", "b", "'\", \"confidence\": \"high\"}'")).otherwise(cat("a", "' '", "c"))
replies("udf11_relevance", models.RELEVANT, _REPLY, """'{"result":{"verdict":"' || CASE n % 4 WHEN 0 THEN 'ambiguous","confidence":0.5' WHEN 1 THEN 'correct","confidence":0.8' WHEN 2 THEN 'incorrect","confidence":0.0' ELSE 'correct","confidence":1.0' END || '}}'""", "n % 4 < 2")
replies("udf12_needs_search", models.NEEDS_SEARCH, lambda: odd(cat("'{\"decision\": \"NO_RETRIEVE\", \"why\": \"'", "a", "'\"}'"), F.col("a")), """'{"result":"' || CASE WHEN n % 2 = 1 THEN 'no_retrieve' ELSE 'retrieve' END || '"}'""", _ODD)
replies("res18_reflection", models.REFLECTION, lambda: odd(cat("'{\"is_sufficient\": true, \"missing_aspects\": [\"'", "a", "'\"], \"reasoning\": \"'", "b", "'\"}'"), F.col("a")),
        """CASE WHEN n % 2 = 1 THEN '{"result":{"is_sufficient":true,"confidence":0.3,"missing_aspects":["' || a || '"],"reasoning":"' || b || '"}}' ELSE '{"result":{"is_sufficient":false,"confidence":0.3,"missing_aspects":["unreadable reflection"],"reasoning":"unreadable reply"}}' END""", _ODD)  # fmt: skip
replies("res19_sub_questions", models.SUB_QUESTION, lambda: cat("'Here: [\"'", "a", "'?\", \"'", "b", "'?\", \"'", "c", "'?\", \"d?\", \"e?\"]'"), """'{"result":["' || a || '?","' || b || '?","' || c || '?","d?"]}'""")
replies("udf11_reworded", models.REWORDED, lambda: cat("'\"'", "a", "' '", "b", "'\"'"), """'{"result":"' || a || ' ' || b || '"}'""")


replies("udf10_plan", models.PLAN, lambda: F.when(F.col("n") % 3 == 0, cat("'{\"steps\": [{\"step_type\": \"RETRIEVE\", \"query\": \"'", "a", "'\"}, {\"step_id\": 7, \"step_type\": \"COMPARE\", \"query\": \"'", "b", "'\", \"depends_on\": [0]}], \"reasoning\": \"'", "c", "'\"}'")).when(F.col("n") % 3 == 1, cat("'{\"steps\": [{\"step_type\": \"GUESS\"}], \"reasoning\": \"'", "a", "'\"}'")).otherwise(cat("'no plan for '", "a")),
        """CASE n % 3 WHEN 0 THEN '{"result":{"steps":[{"step_id":0,"step_type":"retrieve","query":"' || a || '","depends_on":[]},{"step_id":7,"step_type":"compare","query":"' || b || '","depends_on":[0]}],"reasoning":"' || c || '"}}'
        WHEN 1 THEN '{"result":{"steps":[{"step_id":0,"step_type":"retrieve","query":"{\\"steps\\": [{\\"step_type\\": \\"GUESS\\"}], \\"reasoning\\": \\"' || a || '\\"}","depends_on":[]}],"reasoning":"heuristic"}}' ELSE '{"result":{"steps":[{"step_id":0,"step_type":"retrieve","query":"no plan for ' || a || '","depends_on":[]}],"reasoning":"heuristic"}}' END""", "n % 3 = 0")  # fmt: skip
replies("udf10_critic", models.CRITIC, lambda: odd(cat("'{\"issues\": [{\"type\": \"missing\", \"severity\": \"high\", \"description\": \"'", "a", "'\"}, {\"type\": \"style\", \"description\": \"'", "b", "'\", \"suggestion\": \"'", "c", "'\"}], \"suggestions\": [\"'", "c", "'\"]}'"), cat("'fine, '", "a")),
        """CASE WHEN n % 2 = 1 THEN '{"result":{"issues":[{"category":"incomplete","severity":"high","description":"' || a || '"},{"category":"quality","severity":"medium","description":"' || b || '","suggestion":"' || c || '"}],"suggestions":["' || c || '"]}}' ELSE '{"result":{"issues":[],"suggestions":[]}}' END""", _ODD)  # fmt: skip
replies("udf12_critique", models.CRITIQUE, lambda: odd(cat("'{\"support_score\": \"CONTRADICTS\", \"usefulness_score\": \"useful\", \"confidence\": 0.25, \"reasoning\": \"'", "a", "'\", \"suggestions\": [\"'", "b", "'\"]}'"), cat("'well, '", "a", "': {\"support_score\": \"'", "b", "'\"}'")),
        """CASE WHEN n % 2 = 1 THEN '{"result":{"support":"contradicts","usefulness":"useful","confidence":0.25,"reasoning":"' || a || '","suggestions":["' || b || '"]}}' ELSE '{"result":{"support":"partially_supported","usefulness":"partial","confidence":0.7,"reasoning":"","suggestions":[]}}' END""")  # fmt: skip

says("res11_section_citation", lambda: answers.section_citation(F.col("source"), odd(F.array(cat("a", "' '", "n"), F.col("b"), F.col("c")), F.array("a")), F.col("n").cast("string")), "source || ' — ' || CASE WHEN n % 2 = 1 THEN a || ' ' || n || ', ' || b ELSE a || ' — §' || n END")


@query("SELECT conv_id::VARCHAR AS session_id, count(*) AS message_count, 'T' || (conv_id % 5) AS topic, array_to_string(words, ',') AS entities FROM conversations JOIN (SELECT conv_id, list(w ORDER BY first, w) AS words FROM (SELECT conv_id, w, min(turn) AS first FROM (SELECT conv_id, turn, regexp_extract(lower(text), '[a-z]{3,}') AS w FROM conversations) WHERE w <> '' GROUP BY ALL) GROUP BY conv_id) USING (conv_id) WHERE conv_id % 3 <> 0 GROUP BY ALL")
def res13_sessions(spark, sf):
    """Conversations as sessions: opened, noted with topics and words, a third closed, and listed."""
    m = t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "conv_id", "turn", F.nullif(F.regexp_extract(F.lower("text"), "[a-z]{3,}", 0), F.lit("")).alias("entity"))
    none = spark.createDataFrame([], "session_id string, created_at timestamp, updated_at timestamp, topic string, entities array<string>")
    s = records.open_sessions(none, m, F.lit("2024-01-01").cast("timestamp"))
    s = records.note(s, m.select("session_id", F.concat(F.lit("T"), (F.col("conv_id") % 5).cast("string")).alias("topic")), m.select("session_id", "entity", F.struct("turn", "entity").alias("seq")))
    s, left = records.close_sessions(s, m, m.where("conv_id % 3 = 0"))
    listed = records.list_sessions(s, left, 1_000_000).select("session_id", "message_count", "topic")
    return listed.join(s.select("session_id", F.array_join("entities", ",").alias("entities")), "session_id")


@query(f"WITH {_INDEX} SELECT query_id, chunk_id, score, rank, 'bm25' AS source, d.source AS doc_id, coalesce(lang, '') AS header_path, sha256(coalesce(text, '')) AS content_sha256 FROM bm JOIN documents d ON d.doc_id = chunk_id")
def res22_common_results(spark, sf):
    c = t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.lit("t").alias("doc_title"), F.col("lang").alias("header_path"), F.col("text").alias("content"))
    return retrieval.common(_bm25(spark, sf), c, "bm25").select("query_id", "chunk_id", "score", "rank", "source", "doc_id", "header_path", F.sha2("content", 256).alias("content_sha256"))


# -- operators that stood in queries only


@query("WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN quality END AS q, CASE WHEN doc_id % 5 > 0 THEN toxic END AS x FROM labels) SELECT doc_id, CASE WHEN q IS NULL AND x IS NULL THEN 0::DOUBLE ELSE (coalesce(q * 2.0::DOUBLE, 0) + coalesce(x * 1.5::DOUBLE, 0)) / (CASE WHEN q IS NULL THEN 0 ELSE 2.0::DOUBLE END + CASE WHEN x IS NULL THEN 0 ELSE 1.5::DOUBLE END) END AS score FROM l")
def agg16_overall_score(spark, sf):
    """Metrics of which one, the other or both are missing."""
    l = t(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 5 > 0, F.col("toxic")).alias("toxic"))
    return l.select("doc_id", records.overall_score({"quality": 2.0, "toxic": 1.5}).alias("score"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 2 = 0 AND doc_id % 3 = 1")
def flt11_case_filters(spark, sf):
    c = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"), F.array(F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")).alias("tags"))
    return records.cases_with(c, "en", ["even", "m1"]).select("doc_id")


@query(f"WITH {_COS}, {_LABELS}, u AS (SELECT query_id, chunk_id, score, 0 AS o FROM v WHERE score >= 0.3 UNION ALL SELECT query_id, chunk_id, score, 1 FROM l), f AS (SELECT query_id, chunk_id, score FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY o) = 1) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f QUALIFY rank <= 12")
def set2_exhaustive(spark, sf):
    return flows.exhaustive([_vector_hits(spark, sf), _label_hits(spark, sf)], least=0.3, most=12).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_COS}, {_LABELS}, u AS (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS s FROM v UNION ALL SELECT query_id, chunk_id, 0.4 / (60 + rank) FROM l), f AS (SELECT query_id, chunk_id, sum(s) AS score FROM u GROUP BY ALL) SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f QUALIFY rank <= 8")
def ret5_unified(spark, sf):
    """Two legs, the second one of propositions, with its own weight."""
    u = flows.unified({"vector": _vector_hits(spark, sf), "propositions": _label_hits(spark, sf)}, {"propositions": 0.4}, 8)
    return u.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
    {_COS[_COS.index('c AS'):_COS.index('v AS')]} p AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'p' || chunk_id) AS n FROM c WHERE score >= 0.2),
    f AS (SELECT query_id, chunk_id // 4 AS chunk_id, max(score) AS score, count(*) AS n_propositions FROM p WHERE n <= 16 GROUP BY ALL) SELECT query_id, chunk_id, score, n_propositions, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f QUALIFY rank <= 8""")
def ret6_proposition_search(spark, sf):
    """Vectors as propositions, four to a chunk."""
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    p = e.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("proposition_id"), F.floor(F.col("vec_id") / 4).alias("parent_chunk_id"), F.lit("x").alias("content"), "embedding")
    chunks = e.select(F.floor(F.col("vec_id") / 4).alias("chunk_id"), F.lit("y").alias("content")).distinct()
    return flows.proposition_search(q, p, chunks, 8, 0.2, digits=8).select("query_id", "chunk_id", "score", "n_propositions", "rank")


@query(f"""WITH s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents), k AS (SELECT doc_id, list_filter(s, lambda x: length(x) / 3 >= 10) AS s FROM s),
    u AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM k), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n FROM u GROUP BY doc_id, s)
    SELECT doc_id, (n - 1)::INT AS nth, md5(s) AS digest FROM r WHERE n <= 15""")
def flt10_propositions(spark, sf):
    p = flows.propositions(t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
    return p.select(F.col("parent_chunk_id").alias("doc_id"), F.substring_index("proposition_id", "_p", -1).cast("int").alias("nth"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("SELECT conv_id::VARCHAR AS session_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id")
def win9_last_messages(spark, sf):
    return records.last_messages(sessions(spark, sf))


@query("SELECT event_type, avg(value) AS mean, min(value) AS min, max(value) AS max, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type")
def agg17_latency(spark, sf):
    return records.latency_summary(t(spark, sf, "events").withColumnRenamed("value", "latency_ms"), "event_type")
