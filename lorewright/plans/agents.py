"""Loops around retrieval and answers: agentic search, self-checked answers, refinement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions import answers, intent
from lorewright.operators import retrieval
from lorewright.operators.lineage import cut

#: Confidence from which gathered hits are enough.
ENOUGH = 0.7


def confidence(n_results: Column) -> Column:
    """What the number of hits is worth without a model's opinion."""
    return F.least(F.lit(0.9), n_results * 0.15)


def agentic(queries: DataFrame, search: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """(query_id, query): searches until each query has enough hits, other wordings in later rounds; all queries of a round are one job."""
    asked, found = queries.select("query_id", "query"), None
    for k in range(rounds):
        hits = search(asked).select("query_id", "chunk_id", "score").withColumn("round", F.lit(k))
        found = cut(hits if found is None else retrieval.union_first(found, hits))
        n = found.groupBy("query_id").agg(F.count("*").alias("n"))
        short = queries.join(n, "query_id", "left").where(confidence(F.coalesce("n", F.lit(0))) < ENOUGH)
        asked = cut(short.select("query_id", F.get(intent.variants(F.col("query")), F.lit(k)).alias("query")).where("query is not null"))
        if asked.isEmpty():
            break
    n = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return found.join(n, "query_id").select("query_id", "chunk_id", "score", "round", F.round(confidence(F.col("n")), 6).alias("confidence"))


def self_critique(answered: DataFrame) -> DataFrame:
    """(query, answer, sources): support, usefulness and whether the answer is acceptable."""
    g, c = answers.grounding(F.col("answer"), F.col("sources")), answers.completeness(F.col("answer"), F.col("query"))
    out = answered.withColumn("grounding", g).withColumn("completeness", c)
    out = out.withColumn("support", F.when(F.col("grounding") >= 0.8, "fully_supported").when(F.col("grounding") >= 0.4, "partially_supported").otherwise("no_support"))
    out = out.withColumn("usefulness", F.when(F.col("completeness") >= 0.7, "useful").when(F.col("completeness") >= 0.3, "partial").otherwise("not_useful"))
    out = out.withColumn("confidence", (F.col("grounding") + F.col("completeness")) / 2)
    return out.withColumn("acceptable", (F.col("support") != "no_support") & (F.col("usefulness") != "not_useful") & (F.col("confidence") >= 0.6))


def criticise(answered: DataFrame) -> DataFrame:
    """(query, answer, sources) with coverage, grounding, issues and the overall score."""
    sources, answer = F.col("sources"), F.col("answer")
    issues = answers.citation_issues(answer, sources)
    numbers = answers.unknown_numbers(answer, sources)
    out = answered.withColumn("issues", issues).withColumn("numbers", numbers).withColumn("coverage", answers.source_coverage(answer, F.size(sources))).withColumn("grounded", answers.grounding(answer, sources))
    weight = lambda i: F.when(i["severity"] == "high", 0.4).when(i["severity"] == "medium", 0.25).otherwise(0.1)
    penalty = F.aggregate(F.transform("issues", weight), F.lit(0.0), lambda s, v: s + v) + F.size("numbers") * answers.PENALTIES["low"]
    return out.withColumn("score", answers.critique_score(penalty, F.col("coverage"), F.col("grounded")))


def refine(answered: DataFrame, improve: Callable[[DataFrame], DataFrame], rounds: int = 3, least: float = 0.8) -> DataFrame:
    """Answers below the threshold are improved and criticised again, at most so often; the best version of each stays."""
    best = cut(criticise(answered))
    for _ in range(rounds):
        low = best.where(F.col("score") < least)
        if low.isEmpty():
            break
        tried = criticise(improve(low.select(*answered.columns)))
        both = best.unionByName(tried.select(best.columns))
        best = cut(both.groupBy("query_id").agg(F.max_by(F.struct(*[c for c in best.columns if c != "query_id"]), "score").alias("b")).select("query_id", "b.*").select(best.columns))
    return best


def ensure_grounded(answered: DataFrame, least: float = 0.5) -> DataFrame:
    """Claims of each answer with the support of the sources they cite; an answer's tier by its share of supported claims (1 without claims)."""
    c = answered.select("query_id", "sources", F.explode_outer(answers.claims(F.col("answer"))).alias("c")).select("query_id", "sources", F.col("c.claim").alias("claim"), F.explode_outer("c.citations").alias("n"))
    source = F.get("sources", F.col("n") - 1)
    ok = F.when(F.col("claim").isNotNull(), F.coalesce(answers.claim_support(F.col("claim"), source)["is_supported"], F.lit(False)))
    share = c.withColumn("ok", ok).groupBy("query_id").agg(F.count("ok").alias("n"), F.count_if("ok").alias("k"))
    score = F.when(F.col("n") == 0, 1.0).otherwise(F.col("k") / F.col("n"))
    tier = F.when(score >= 0.9, "high").when(score >= 0.7, "medium").when(score >= least, "low").otherwise("insufficient")
    return share.select("query_id", score.alias("grounding_score"), tier.alias("tier"))


# Openings of prompts by query type.
OPENINGS = {
    "factual": "Responde con precisión y brevedad.",
    "explanatory": "Explica el concepto paso a paso, de lo general a lo concreto.",
    "comparative": "Compara los elementos: semejanzas, diferencias y cuándo usar cada uno.",
    "procedural": "Describe el procedimiento en pasos numerados.",
    "synthesis": "Resume las ideas principales y cómo se relacionan.",
    "mathematical": "Resuelve paso a paso y justifica cada transformación.",
}


def prompt(query: Column, contexts: Column, kind: Column) -> Column:
    """System opening, numbered contexts and the question, as one text."""
    opening = F.element_at(F.create_map(*[F.lit(x) for kv in OPENINGS.items() for x in kv]), kind)
    numbered = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    return F.concat(F.coalesce(opening, F.lit(OPENINGS["factual"])), F.lit("\nCita las fuentes con [n].\n\nContexto:\n\n"), numbered, F.lit("\n\nPregunta: "), query)
