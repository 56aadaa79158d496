"""Steps that a model can take over from a heuristic: its reply is read leniently, and rows whose reply can't be read fall back.

Without a provider a step is its heuristic alone and stays in the JVM. With one, the
prompts of a partition go to it in Arrow batches (`providers.complete`), and replies are
read by SQL functions. A null input asks nothing and takes the heuristic's result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions import answers, intent, text
from lorewright.operators import graph
from lorewright.plans import library, providers

# Names and defaults that replies are read with.
LEVELS = ["introductory", "intermediate", "advanced", "research"]
STRATEGIES = ["vector_only", "bm25_only", "hybrid", "hybrid_with_graph", "multi_hop"]
VERDICTS = ["correct", "ambiguous", "incorrect"]
DECISIONS = ["retrieve", "no_retrieve", "uncertain"]
RELEVANCE = ["fully", "partially", "not"]
DEFAULT_ENTITY, DEFAULT_RELATION, DEFAULT_CONFIDENCE = "Concepto", "CO_OCCURS", 0.5
PROPOSITION_TOKENS, PROPOSITIONS, SUB_QUESTIONS = 10, 15, 4


@dataclass(frozen=True)
class Step:
    """What a model is told, the columns it is shown, how its reply becomes a result (null: unreadable), and what stands in for it."""

    task: str
    shows: tuple[str, ...]
    result: str
    read: Callable[[Column], Column]
    otherwise: Callable[[], Column]
    shown: int = 2000  # characters of each column that a prompt quotes, as models read no more


def fields(reply: Column, schema: str) -> Column:
    """The reply's outermost JSON object, null where there is none that can be read."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def strings(reply: Column) -> Column:
    """The reply's JSON array of strings, or the first array that an object holds; null where there is none."""
    listed = text.json_items(reply, "array<string>")
    inner = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "map<string,array<string>>")
    return F.coalesce(listed, F.get(F.map_values(inner), 0))


def plain(reply: Column) -> Column:
    """The reply without white space around it; null where nothing is left."""
    return F.nullif(text.strip(reply), F.lit(""))


def known(value: Column, names: list[str], default: str | None) -> Column:
    """The lower-case value if it is one of the names; the default if it is missing or (with a default) unknown."""
    v = F.lower(value)
    return F.when(v.isin(names), v) if default is None else F.when(v.isin(names), v).otherwise(default)


def prompt(step: Step) -> Column:
    shown = [F.concat(F.lit(f"{c}: "), F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, step.shown)) for c in step.shows]
    return F.concat_ws("\n\n", F.lit(step.task), *shown)


def take(df: DataFrame, step: Step, out: str, provider: providers.Complete | None = None) -> DataFrame:
    """Adds `out`, and `by_model`: whether it is the model's. Other columns pass through, but for these two names."""
    heuristic = step.otherwise().cast(step.result)
    if provider is None:
        return df.withColumn(out, heuristic).withColumn("by_model", F.lit(False))
    asked = providers.complete(df.withColumn("_prompt", prompt(step)), "_prompt", "_reply", provider)
    subject = F.col(step.shows[-1])
    asked = asked.withColumn("_read", F.when(subject.isNotNull(), step.read(F.col("_reply"))).cast(step.result))
    made = asked.withColumn(out, F.coalesce("_read", heuristic)).withColumn("by_model", F.col("_read").isNotNull())
    return made.drop("_prompt", "_reply", "_read")


def _number(value: Column, default: float) -> Column:
    """A JSON value as a number: the default if it is missing, null if it is none."""
    return F.when(value.isNull(), F.lit(default)).otherwise(value.try_cast("double"))


def _difficulty(reply: Column) -> Column:
    r = fields(reply, "level string, confidence string, reasoning string")
    sure = _number(r["confidence"], 0.7)
    return F.when(r.isNotNull() & sure.isNotNull(), F.struct(known(F.coalesce(r["level"], F.lit("intermediate")), LEVELS, "intermediate"), sure, F.coalesce(r["reasoning"], F.lit("llm_classified"))))


def _difficulty_otherwise() -> Column:
    d = intent.difficulty(F.col("content"))
    return F.struct(d["level"], d["confidence"], F.lit("heuristic"))


DIFFICULTY = Step('Rate how hard this passage is. Reply with JSON only: {"level": "introductory|intermediate|advanced|research", "confidence": 0 to 1, "reasoning": "..."}', ("header_path", "content"), "struct<level:string,confidence:double,reasoning:string>", _difficulty, _difficulty_otherwise)


def _route(reply: Column) -> Column:
    r = fields(reply, "strategy string, vector_weight double, bm25_weight double, graph_weight double, top_k int, sub_queries array<string>")
    s = known(F.coalesce(r["strategy"], F.lit("hybrid")), STRATEGIES, None)
    weights = [F.coalesce(r[c], F.lit(d)) for c, d in (("vector_weight", 0.5), ("bm25_weight", 0.3), ("graph_weight", 0.2))]
    return F.when(r.isNotNull() & s.isNotNull(), F.struct(s, *weights, F.coalesce(r["top_k"], F.lit(10)), F.coalesce(r["sub_queries"], F.array().cast("array<string>"))))


def _route_otherwise() -> Column:
    r = intent.route(F.col("query"))
    return F.struct(*[r[c] for c in ("strategy", "vector_weight", "bm25_weight", "graph_weight", "top_k", "sub_queries")])


ROUTE = Step('Choose how to search for this question. Reply with JSON only: {"strategy": "VECTOR_ONLY|BM25_ONLY|HYBRID|HYBRID_WITH_GRAPH|MULTI_HOP", "vector_weight": 0.5, "bm25_weight": 0.3, "graph_weight": 0.2, "top_k": 10, "sub_queries": []}', ("query",), "struct<strategy:string,vector_weight:double,bm25_weight:double,graph_weight:double,top_k:int,sub_queries:array<string>>", _route, _route_otherwise)


def _section(reply: Column) -> Column:
    r = fields(reply, "section_hierarchy array<string>, section_number string, topic_summary string")
    return F.when(r.isNotNull(), F.struct(F.coalesce(r["section_hierarchy"], F.array().cast("array<string>")), F.coalesce(r["section_number"], F.lit("")), F.coalesce(r["topic_summary"], F.lit("")), F.lit(1.0)))


def _section_otherwise() -> Column:
    hierarchy, number, topic = library.section_data(F.col("header_path"), F.col("content"))
    return F.struct(hierarchy, number, topic, F.lit(0.5))


SECTION = Step('Say where in its document this passage stands. Reply with JSON only: {"section_hierarchy": ["...", "..."], "section_number": "1.2", "topic_summary": "at most 15 words"}', ("doc_title", "header_path", "content"), "struct<section_hierarchy:array<string>,section_number:string,topic_summary:string,confidence:double>", _section, _section_otherwise)


def _prefix_otherwise() -> Column:
    return library.context_prefix(F.col("doc_title"), F.col("header_path"))


PREFIX = Step("Write one or two sentences that place this passage in its document, for search. Reply with the sentences only.", ("doc_title", "header_path", "content"), "string", plain, _prefix_otherwise)
SUMMARY = Step("Summarise in two or three sentences what this document is about. Reply with the summary only.", ("doc_title", "content"), "string", plain, lambda: F.concat(F.lit("Documento: "), F.col("doc_title")))
IMAGE = Step("Describe this image in at most three sentences; write formulas in LaTeX. Reply with the description only.", ("path",), "string", plain, lambda: F.concat(F.lit("[Imagen no procesada: "), F.element_at(F.split("path", "/"), -1), F.lit("]")))
SHORTER = Step("Shorten this text and keep every fact that the question needs. Reply with the text only.", ("query", "content"), "string", plain, lambda: answers.compressor("aggressive")(F.col("content")), shown=100_000)


def _propositions(reply: Column) -> Column:
    said = F.transform(strings(reply), text.strip)
    return F.slice(F.array_distinct(F.filter(said, lambda s: F.floor(F.length(s) / 3) >= PROPOSITION_TOKENS)), 1, PROPOSITIONS)


PROPOSITION = Step("Split this passage into statements of one fact each that can be understood on their own. Reply with a JSON array of strings only.", ("doc_title", "header_path", "content"), "array<string>", _propositions, lambda: F.array(F.col("content")), shown=100_000)


def _triples(reply: Column) -> Column:
    r = fields(reply, "entities array<struct<name:string,type:string>>, triples array<struct<source:string,source_type:string,relation:string,target:string,target_type:string,confidence:string>>")
    entity = lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], F.lit(DEFAULT_ENTITY)).alias("type"))
    or_default = lambda t, c, d: F.coalesce(t[c], F.lit(d)).alias(c)
    triple = lambda t: F.struct(or_default(t, "source", ""), or_default(t, "source_type", DEFAULT_ENTITY), or_default(t, "relation", DEFAULT_RELATION), or_default(t, "target", ""), or_default(t, "target_type", DEFAULT_ENTITY), _number(t["confidence"], DEFAULT_CONFIDENCE).alias("confidence"))
    named = F.filter(F.coalesce(r["entities"], F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.coalesce(e["name"], F.lit("")) != "")
    none = F.array().cast("array<struct<source:string,source_type:string,relation:string,target:string,target_type:string,confidence:string>>")
    return F.when(r.isNotNull(), F.struct(F.transform(named, entity), F.transform(F.coalesce(r["triples"], none), triple)))


def _triples_otherwise() -> Column:
    found = F.transform(graph.entities(F.col("content")), lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type")))
    return F.struct(found, F.array())


TRIPLES = Step('List the entities of this passage and how they relate. Reply with JSON only: {"entities": [{"name": "...", "type": "..."}], "triples": [{"source": "...", "source_type": "...", "relation": "...", "target": "...", "target_type": "...", "confidence": 0 to 1}]}', ("content",), "struct<entities:array<struct<name:string,type:string>>,triples:array<struct<source:string,source_type:string,relation:string,target:string,target_type:string,confidence:double>>>", _triples, _triples_otherwise)


def _relevance(reply: Column) -> Column:
    r = fields(reply, "verdict string, confidence string")
    sure = _number(r["confidence"], 0.5)
    return F.when(r.isNotNull() & sure.isNotNull(), F.struct(known(F.coalesce(r["verdict"], F.lit("ambiguous")), VERDICTS, "ambiguous"), sure))


def _relevance_otherwise() -> Column:
    share = answers.relevance_overlap(F.col("query"), F.col("content"))
    return F.struct(answers.verdict(share), share)


RELEVANT = Step('Does this passage answer the question? Reply with JSON only: {"verdict": "correct|ambiguous|incorrect", "confidence": 0 to 1}', ("query", "content"), "struct<verdict:string,confidence:double>", _relevance, _relevance_otherwise)
REWORDED = Step("Word this question so that a search finds better passages: more specific terms, or synonyms. Reply with the question only.", ("query",), "string", lambda r: F.nullif(F.trim(text.strip(r), F.lit('"')), F.lit("")), lambda: F.lit(None))
SUB_QUESTION = Step("Split this question into at most four simpler ones, or repeat it if it is simple. Reply with a JSON array of strings only.", ("query",), "array<string>", lambda r: F.slice(strings(r), 1, SUB_QUESTIONS), lambda: intent.sub_queries(F.col("query")))
NEEDS_SEARCH = Step('Can this question be answered without a search? Reply with JSON only: {"decision": "retrieve|no_retrieve|uncertain"}', ("query",), "string", lambda r: known(fields(r, "decision string")["decision"], DECISIONS, None), lambda: F.lit("retrieve"))
USEFULNESS = Step('How well does this passage support an answer to the question? Reply with JSON only: {"score": "fully|partially|not"}', ("query", "content"), "string", lambda r: known(fields(r, "score string")["score"], RELEVANCE, None), lambda: F.lit("partially"))


def _reflection(reply: Column) -> Column:
    r = fields(reply, "is_sufficient boolean, confidence string, missing_aspects array<string>, suggested_reformulation string, suggested_strategy string, reasoning string")
    return F.when(
        r.isNotNull(),
        F.struct(F.coalesce(r["is_sufficient"], F.lit(False)), F.coalesce(_number(r["confidence"], 0.3), F.lit(0.3)), F.coalesce(r["missing_aspects"], F.array().cast("array<string>")), r["suggested_reformulation"], r["suggested_strategy"], F.coalesce(r["reasoning"], F.lit(""))),
    )


REFLECTION = Step(
    'Are these passages enough to answer the question? Reply with JSON only: {"is_sufficient": true or false, "confidence": 0 to 1, "missing_aspects": ["..."], "suggested_reformulation": "...", "suggested_strategy": "...", "reasoning": "..."}',
    ("query", "content"),
    "struct<is_sufficient:boolean,confidence:double,missing_aspects:array<string>,suggested_reformulation:string,suggested_strategy:string,reasoning:string>",
    _reflection,
    lambda: F.struct(F.lit(False), F.lit(0.3), F.array(F.lit("unreadable reflection")), F.lit(None), F.lit(None), F.lit("unreadable reply")),
)


# Kinds of plan steps, of a critic's issues (by the model's name for them), and of support and usefulness.
STEP_TYPES = ["retrieve", "filter", "aggregate", "compare", "synthesize"]
ISSUES = {"hallucination": "hallucination", "missing": "incomplete", "inconsistent": "inconsistent"}
OTHER_ISSUE = "quality"
SUPPORT = {"fully_supported": "fully_supported", "partially": "partially_supported", "no_support": "no_support", "contradicts": "contradicts"}
USEFUL = ["useful", "partial", "not_useful"]


def _plan(reply: Column) -> Column:
    """A plan with a step of an unknown kind can't be read; one without steps is a single search."""
    r = fields(reply, "steps array<struct<step_id:int,step_type:string,query:string,depends_on:array<int>>>, reasoning string")
    steps = F.slice(F.coalesce(r["steps"], F.array().cast("array<struct<step_id:int,step_type:string,query:string,depends_on:array<int>>>")), 1, intent.MAX_STEPS)
    none = F.array().cast("array<int>")
    made = F.transform(steps, lambda s, i: F.struct(F.coalesce(s["step_id"], i).alias("step_id"), F.lower(F.coalesce(s["step_type"], F.lit("retrieve"))).alias("step_type"), F.coalesce(s["query"], F.col("query")).alias("query"), F.coalesce(s["depends_on"], none).alias("depends_on")))
    alone = F.array(F.struct(F.lit(0).alias("step_id"), F.lit("retrieve").alias("step_type"), F.col("query").alias("query"), none.alias("depends_on")))
    good = F.forall(made, lambda s: s["step_type"].isin(STEP_TYPES))
    return F.when(r.isNotNull() & good, F.struct(F.when(F.size(made) > 0, made).otherwise(alone), F.coalesce(r["reasoning"], F.lit(""))))


PLAN = Step(
    'Split this question into steps, at most five. Reply with JSON only: {"steps": [{"step_id": 0, "step_type": "RETRIEVE|FILTER|AGGREGATE|COMPARE|SYNTHESIZE", "query": "...", "depends_on": []}], "reasoning": "..."}',
    ("query",), "struct<steps:array<struct<step_id:int,step_type:string,query:string,depends_on:array<int>>>,reasoning:string>", _plan, lambda: F.struct(intent.plan(F.col("query")), F.lit("heuristic")),
)


def _issues(reply: Column) -> Column:
    kind = "array<struct<type:string,severity:string,description:string,suggestion:string>>"
    r = fields(reply, f"issues {kind}, suggestions array<string>")
    named = F.create_map(*[F.lit(x) for kv in ISSUES.items() for x in kv])
    issue = lambda i: F.struct(F.coalesce(F.element_at(named, F.coalesce(i["type"], F.lit(""))), F.lit(OTHER_ISSUE)).alias("category"), F.coalesce(i["severity"], F.lit("medium")).alias("severity"), F.coalesce(i["description"], F.lit("")).alias("description"), i["suggestion"].alias("suggestion"))
    return F.when(r.isNotNull(), F.struct(F.transform(F.coalesce(r["issues"], F.array().cast(kind)), issue), F.coalesce(r["suggestions"], F.array().cast("array<string>"))))


CRITIC = Step(
    'Find what is wrong with this answer: statements that the sources don\'t make, what is missing, contradictions. Reply with JSON only: {"issues": [{"type": "hallucination|missing|inconsistent", "severity": "low|medium|high", "description": "...", "suggestion": "..."}], "suggestions": ["..."]}',
    ("query", "context", "answer"), "struct<issues:array<struct<category:string,severity:string,description:string,suggestion:string>>,suggestions:array<string>>", _issues, lambda: F.struct(F.array(), F.array()), shown=4000,
)


def _critique(reply: Column) -> Column:
    r = fields(reply, "support_score string, usefulness_score string, confidence string, suggestions array<string>, reasoning string")
    sure = _number(r["confidence"], 0.7)
    named = F.create_map(*[F.lit(x) for kv in SUPPORT.items() for x in kv])
    support = F.coalesce(F.element_at(named, F.lower(F.coalesce(r["support_score"], F.lit("")))), F.lit("partially_supported"))
    return F.when(r.isNotNull() & sure.isNotNull(), F.struct(support, known(r["usefulness_score"], USEFUL, "partial"), sure, F.coalesce(r["reasoning"], F.lit("")), F.coalesce(r["suggestions"], F.array().cast("array<string>"))))


CRITIQUE = Step(
    'Is this answer supported by its context, and does it answer the question? Reply with JSON only: {"support_score": "fully_supported|partially|no_support|contradicts", "usefulness_score": "useful|partial|not_useful", "confidence": 0 to 1, "suggestions": ["..."], "reasoning": "..."}',
    ("query", "context", "answer"), "struct<support:string,usefulness:string,confidence:double,reasoning:string,suggestions:array<string>>", _critique, lambda: F.struct(F.lit("partially_supported"), F.lit("partial"), F.lit(0.5), F.lit("unreadable reply"), F.array()), shown=4000,
)


def acceptable(critique: Column) -> Column:
    """Whether a critique lets an answer pass: support, use and a confidence of 0.6."""
    return ~critique["support"].isin("no_support", "contradicts") & (critique["usefulness"] != "not_useful") & (critique["confidence"] >= 0.6)


def proposition_rows(chunks: DataFrame, provider: providers.Complete | None = None) -> DataFrame:
    """(chunk_id, doc_title, header_path, content) -> one row per statement: proposition_id, parent_chunk_id, content, token_count, content_hash. The same statement of several chunks stays with the smallest chunk."""
    said = take(chunks, PROPOSITION, "said", provider).select("chunk_id", F.posexplode("said").alias("n", "content")).where("content is not null")
    once = said.groupBy("content").agg(F.min(F.struct("chunk_id", "n")).alias("first")).select("first.*", "content")
    number = F.concat(F.col("chunk_id").cast("string"), F.lit("_prop_"), F.lpad((F.col("n") + 1).cast("string"), 3, "0"))
    return once.select(number.alias("proposition_id"), F.col("chunk_id").alias("parent_chunk_id"), "content", F.floor(F.length("content") / 3).cast("int").alias("token_count"), text.short_hash(F.col("content")).alias("content_hash"))
