"""Retrieval flows that go beyond one search: exhaustive retrieval, propositions, several wordings, hypothetical answers, correction, self-checked answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions import answers, intent
from lorewright.operators import retrieval
from lorewright.operators.lineage import cut
from lorewright.plans import agents, library, providers

Search = Callable[[DataFrame, int], DataFrame]
#: Width of each leg of an exhaustive retrieval, shares of a query and its hypothetical answer, growth of a search that lacked support.
WIDE = 100
QUERY_SHARE, HYPOTHETICAL_SHARE = 0.3, 0.7
WIDEN = 1.5
#: Sentences of a document that stand as propositions: tokens of the least, and how many.
PROPOSITION_TOKENS, PROPOSITIONS = 10, 15


def exhaustive(legs: list[DataFrame], *, least: float = 0.001, most: int | None = None) -> DataFrame:
    """Hits of several wide searches, in the order of precedence: each chunk once, with the score of the first search that found it at `least` or more; ordered by score, at most `most`."""
    found = retrieval.union_first(*[leg.where(F.col("score") >= least).select("query_id", "chunk_id", "score") for leg in legs])
    return retrieval.top_k(found, most) if most else retrieval.ranked(found)


def retrieve_chunks(queries: DataFrame, lib: library.Library, *, wide: bool = False, least: float = 0.001, most: int = 50, context: int = 0) -> DataFrame:
    """(query_id, query) -> chunks with content: one fused search, or (`wide`) the union of a vector, a lexical and a fused search; with `context` neighbours on both sides."""
    if wide:
        asked = providers.embed(queries, "query", "query_vector").select("query_id", "query_vector")
        legs = [retrieval.vector_search(asked, lib.vectors, WIDE, 0.0), retrieval.bm25(queries, lib.lexical, WIDE), library.retrieve(queries, lib, WIDE)]
        hits = exhaustive(legs, least=least, most=most)
    else:
        hits = retrieval.top_k(library.retrieve(queries, lib, most).select("query_id", "chunk_id", "score").where(F.col("score") >= least), most)
    if context:
        wider = retrieval.expand_context(hits.drop("rank"), lib.chunks.where("level = 'micro'"), context).select("query_id", "chunk_id", F.col("context").alias("content"))
        return hits.join(wider, ["query_id", "chunk_id"])
    return hits.join(lib.chunks.select("chunk_id", "content"), "chunk_id")


def propositions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content) -> (proposition_id, parent_chunk_id, content): sentences of ten tokens or more, without repetitions, the first fifteen of a chunk."""
    said = F.filter(answers.sentences(F.col("content")), lambda s: F.length(s) / 3 >= PROPOSITION_TOKENS)
    p = chunks.select("chunk_id", F.posexplode(F.slice(F.array_distinct(said), 1, PROPOSITIONS)).alias("n", "content"))
    return p.select(F.concat_ws("_p", F.col("chunk_id").cast("string"), F.col("n").cast("string")).alias("proposition_id"), F.col("chunk_id").alias("parent_chunk_id"), "content")


def proposition_search(asked: DataFrame, embedded: DataFrame, chunks: DataFrame, k: int = 10, least: float = 0.5, *, digits: int | None = None) -> DataFrame:
    """(query_id, query_vector) against propositions (proposition_id, parent_chunk_id, content, embedding): the best, folded to their chunks."""
    hits = retrieval.vector_search(asked, embedded.withColumnRenamed("proposition_id", "chunk_id"), 2 * k, least, digits=digits).withColumnRenamed("chunk_id", "proposition_id")
    hits = hits.join(embedded.select("proposition_id", "parent_chunk_id", "content"), "proposition_id")
    return retrieval.top_k(retrieval.propositions_to_parents(hits, chunks), k)


def unified(legs: dict[str, DataFrame], weights: DataFrame | dict | None = None, k: int = 10) -> DataFrame:
    """Ranked hits (query_id, chunk_id, rank, score) by source -> one fused list; propositions or any other source weigh what `weights` says."""
    every = None
    for source, hits in legs.items():
        one = hits.select("query_id", "chunk_id", "rank", F.col("score").cast("double").alias("score")).withColumn("source", F.lit(source))
        every = one if every is None else every.unionByName(one)
    return retrieval.fuse(every, weights, k)


def multi_query(queries: DataFrame, search: Search, k: int = 10, method: str = "rrf", wordings: int = 3) -> DataFrame:
    """Each query in its own and up to `wordings` other wordings, all of which are one search, and the fused hits."""
    every = queries.select("query_id", F.posexplode(F.concat(F.array("query"), intent.variants(F.col("query"), wordings))).alias("variant", "query"))
    every = cut(every.withColumn("part", F.concat_ws("/", F.col("query_id").cast("string"), "variant")))
    hits = search(every.select(F.col("part").alias("query_id"), "query"), k).withColumnRenamed("query_id", "part")
    return retrieval.fuse_variants(hits.join(every.select("part", "query_id", "variant"), "part"), k, method)


def hypothetical(queries: DataFrame, search: Search, k: int = 10, provider=None) -> DataFrame:
    """Searches with the query and a made-up answer, whose scores weigh 0.3 and 0.7; where the provider fails, the query stands in for the answer."""
    asked = queries.withColumn("prompt", F.concat(F.lit("Question: "), "query", F.lit("\n\nWrite a passage that answers it:")))
    made = cut(providers.complete(asked, "prompt", "_text", provider).select("query_id", "query", F.coalesce("_text", "query").alias("_text")))
    both = [(F.col("query"), QUERY_SHARE), (F.col("_text"), HYPOTHETICAL_SHARE)]
    hits = [search(made.select("query_id", text.alias("query")), 2 * k).select("query_id", "chunk_id", "score").withColumn("weight", F.lit(share)) for text, share in both]
    return retrieval.weighted_mean(hits[0].unionByName(hits[1]), k)


def corrected(queries: DataFrame, search: Search, k: int = 10) -> DataFrame:
    """Hits with content; where most of a query's are irrelevant, its other wordings are searched and merged in, and the irrelevant ones go. `action` says what was done."""
    hits = cut(search(queries, k).select("query_id", "chunk_id", "score", "content").join(queries, "query_id"))
    judged = cut(retrieval.assess(hits))
    todo = retrieval.corrective_action(judged).select("query_id", "action")
    good = judged.where("verdict != 'incorrect'").select("query_id", "chunk_id", "score", "content")
    again = cut(queries.join(todo.where(F.col("action") != "none"), "query_id").select("query_id", F.get(intent.variants(F.col("query")), F.lit(0)).alias("query")).where("query is not null"))
    if not again.isEmpty():
        good = retrieval.union_first(good, search(again, k).select("query_id", "chunk_id", "score", "content"))
    return retrieval.top_k(good, k).join(todo, "query_id", "left").withColumn("action", F.coalesce("action", F.lit("none")))


def self_checked(queries: DataFrame, search: Search, provider=None, k: int = 10, rounds: int = 3) -> DataFrame:
    """(query_id, query) -> the first acceptable answer, or the last one: a search without support is widened by half, a useless answer's query is put differently."""
    left = queries.select("query_id", "query", F.col("query").alias("asked"), F.lit(k).alias("width"))
    kept = None
    for n in range(1, rounds + 1):
        left = cut(left)
        if left.isEmpty():
            break
        hits = search(left.select("query_id", F.col("asked").alias("query")), int(k * WIDEN**rounds) + 1).join(left.select("query_id", "width"), "query_id").where("rank <= width")
        listed = F.array_sort(F.collect_list(F.struct("rank", "content")))
        src = hits.groupBy("query_id").agg(F.transform(listed, lambda x: x["content"]).alias("sources"))
        q = left.join(src, "query_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
        q = q.withColumn("prompt", F.concat(F.lit("Pregunta: "), "query", F.lit("\n\nContexto:\n\n"), F.array_join("sources", "\n\n")))
        done = providers.complete(q, "prompt", "answer", provider).withColumn("answer", answers.inject_citations(F.coalesce("answer", F.lit("")), F.col("sources")))
        judged = cut(agents.self_critique(done).withColumn("round", F.lit(n)).select("query_id", "query", "asked", "width", "answer", "support", "usefulness", "acceptable", "round"))
        last = judged if n == rounds else judged.where("acceptable")
        result = last.select("query_id", "query", "answer", "support", "usefulness", "acceptable", "round")
        kept = result if kept is None else kept.unionByName(result)
        no_support = F.col("support") == "no_support"
        asked = F.when(no_support, F.col("asked")).when(F.col("usefulness") == "not_useful", F.coalesce(F.get(intent.variants(F.col("asked")), F.lit(0)), F.col("asked"))).otherwise(F.col("asked"))
        left = judged.where("NOT acceptable").select("query_id", "query", asked.alias("asked"), F.when(no_support, (F.col("width") * WIDEN).cast("int")).otherwise(F.col("width")).alias("width"))
    return kept
