"""End-to-end flows on tables: index a library, ask it, and the six calls of its interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions import answers, intent, text
from lorewright.operators import chunking, graph, records, retrieval
from lorewright.operators.lineage import cut
from lorewright.plans import providers
from lorewright.sources import markdown


@dataclass
class Library:
    """The tables of an indexed library."""

    chunks: DataFrame
    vectors: DataFrame
    lexical: dict[str, DataFrame]
    nodes: DataFrame
    edges: DataFrame


def parse(files: DataFrame) -> DataFrame:
    """(file_path, text) -> documents with id, title, category, hash and size."""
    path = F.col("file_path")
    return files.select(markdown.doc_id(path).alias("doc_id"), markdown.title(F.col("text"), path).alias("doc_title"), "file_path", markdown.category(path).alias("category"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.length("text").alias("total_chars"), "text")


def section_data(header_path: Column, content: Column) -> tuple[Column, Column, Column]:
    """The levels of a header path, the section number in it or in the content's beginning, and the first proper sentence as the topic."""
    parts = F.transform(F.split(header_path, ">"), text.strip)
    number = F.coalesce(F.nullif(F.regexp_extract(F.array_join(F.filter(parts, lambda p: p.rlike(r"^\d")), "|"), r"^(\d+(?:\.\d+)*)", 1), F.lit("")), F.nullif(F.regexp_extract(F.substring(content, 1, 500), r"(?iu)(?:Chapter|Capítulo|Section|Sección)\s*(\d+(?:\.\d+)*)", 1), F.lit("")), F.lit(""))
    first = F.filter(F.transform(F.split(F.substring(content, 1, 500), r"[.!?]\s+"), text.strip), lambda s: (F.length(s) > 20) & ~s.rlike(r"^[#\-*]"))
    topic = F.coalesce(F.get(first, 0), F.lit(""))
    return parts, number, F.when(F.length(topic) > 100, F.concat(F.substring(topic, 1, 100), F.lit("..."))).otherwise(topic)


def context_prefix(doc_title: Column, header_path: Column) -> Column:
    return F.format_string("Este fragmento pertenece al documento '%s', sección '%s'.", doc_title, header_path)


def enrich(micro: DataFrame, *, context: bool = False) -> DataFrame:
    """Difficulty, maths terms and section data of chunks; `embedding_text` is what is embedded."""
    d = intent.difficulty(F.col("content"))
    parts, number, topic = section_data(F.col("header_path"), F.col("content"))
    out = micro.withColumn("_d", d).withColumn("difficulty_level", F.col("_d.level")).withColumn("difficulty_confidence", F.col("_d.confidence")).drop("_d")
    out = out.withColumn("math_terms", text.math_terms(F.col("content"))).withColumn("section_hierarchy", parts).withColumn("section_number", number)
    out = out.withColumn("topic_summary", topic)
    prefix = context_prefix(F.col("doc_title"), F.col("header_path"))
    return out.withColumn("embedding_text", F.concat(prefix, F.lit("\n\n"), F.col("content")) if context else text.searchable_text(F.col("content")))


def index(docs: DataFrame, *, embedder: Callable | None = None, context: bool = False, **sizes) -> Library:
    """Documents (doc_id, doc_title, text) to sections, chunks, vectors, lexical index and graph. Only micro chunks are searched."""
    chunks = cut(chunking.chunks(markdown.sections(docs), **sizes))  # every leg of every search reads them
    micro = enrich(chunks.where("level = 'micro'"), context=context)
    vectors = cut(providers.embed(micro.select("chunk_id", "embedding_text"), "embedding_text", provider=embedder).select("chunk_id", "embedding"))
    found = graph.build(graph.mentions(micro))
    lexical = retrieval.lexical_index(micro.select("chunk_id", "content"))
    lexical = {name: cut(table) for name, table in lexical.items()}  # counted once, not by each search
    return Library(chunks, vectors, lexical, found["nodes"], found["edges"])


def save(lib: Library, path: str) -> None:
    for name, table in tables(lib).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Library:
    t = {n: spark.read.parquet(f"{path}/{n}") for n in ("chunks", "vectors", "postings", "df", "corpus", "nodes", "edges")}
    return Library(t["chunks"], t["vectors"], {k: t[k] for k in ("postings", "df", "corpus")}, t["nodes"], t["edges"])


def tables(lib: Library) -> dict[str, DataFrame]:
    return {"chunks": lib.chunks, "vectors": lib.vectors, **lib.lexical, "nodes": lib.nodes, "edges": lib.edges}


def retrieve(queries: DataFrame, lib: Library, k: int = 10, *, vector_least: float = 0.5, embedder: Callable | None = None) -> DataFrame:
    """(query_id, query) -> fused hits with content: router weights, three legs, reciprocal ranks."""
    routed = queries.withColumn("route", intent.route(F.col("query"), k))
    weights = routed.select("query_id", F.explode(F.create_map(F.lit("vector"), "route.vector_weight", F.lit("bm25"), "route.bm25_weight", F.lit("graph"), "route.graph_weight")).alias("source", "weight"))
    expanded = queries.withColumn("query", text.normalize_math_query(F.col("query")))
    asked = providers.embed(expanded, "query", "query_vector", embedder).select("query_id", "query_vector")
    legs = retrieval.vector_search(asked, lib.vectors, 2 * k, vector_least).withColumn("source", F.lit("vector"))
    legs = legs.unionByName(retrieval.bm25(expanded, lib.lexical, 2 * k).withColumn("source", F.lit("bm25")))
    named = graph.search(queries, lib.nodes, lib.edges, k).select("query_id", "rank", F.col("mentions").cast("double").alias("score"), F.explode(F.slice("chunk_ids", 1, 3)).alias("chunk_id"))
    legs = legs.unionByName(named.withColumn("source", F.lit("graph")))
    cols = [c for c in ("chunk_id", "doc_id", "doc_title", "header_path", "parent_id", "token_count", "content") if c in lib.chunks.columns]
    return retrieval.fuse(legs, weights, k).join(lib.chunks.select(*cols), "chunk_id")


def ask(queries: DataFrame, lib: Library, k: int = 10, *, provider=None, budget: int = 4000, least: float = 0.002) -> DataFrame:
    """(query_id, query) -> answer with its sources, grounding and whether it abstained."""
    hits = retrieve(queries, lib, k)
    room = retrieval.token_budget(hits, budget)
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content")))
    src = room.groupBy("query_id").agg(F.transform(listed, lambda x: x["content"]).alias("sources"), F.transform(listed, lambda x: x["chunk_id"]).alias("source_ids"), F.max("score").alias("best"))
    q = queries.join(src, "query_id", "left").withColumn("query_type", intent.query_type(F.col("query")))
    numbered = F.array_join(F.transform("sources", lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s)), "\n\n")
    q = q.withColumn("abstained", F.coalesce("best", F.lit(0.0)) < least).withColumn("prompt", F.concat(F.lit("Pregunta: "), F.col("query"), F.lit("\n\nContexto:\n\n"), F.coalesce(numbered, F.lit(""))))
    out = providers.complete(q, "prompt", "answer", provider)
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    out = out.withColumn("answer", F.when(~F.col("abstained"), answers.inject_citations(F.coalesce("answer", F.lit("")), sources)))
    return out.select("query_id", "query", "query_type", "answer", "abstained", F.col("source_ids"), F.when(~F.col("abstained"), answers.grounding(F.col("answer"), sources)).alias("grounding"))


def explore(topics: DataFrame, lib: Library) -> DataFrame:
    """Hits of each topic by document and section."""
    return retrieval.explore_tree(retrieve(topics, lib, 50))


def verify(claims: DataFrame, lib: Library, k: int = 20) -> DataFrame:
    """(claim_id, claim) -> status and confidence."""
    asked = claims.select(F.col("claim_id").alias("query_id"), F.col("claim").alias("query"))
    return retrieval.verify_claims(claims, retrieve(asked, lib, k).select(F.col("query_id").alias("claim_id"), "chunk_id", "content"))


def cite(lib: Library, chunk_ids: list[str], style: str = "apa") -> DataFrame:
    """References of chunks; unknown ids are left out."""
    c = lib.chunks.where(F.col("chunk_id").isin(chunk_ids))
    return c.select("chunk_id", answers.cite(style, F.col("doc_title"), F.col("header_path"), F.lit("")).alias("reference"))


def stats(lib: Library) -> DataFrame:
    return records.corpus_statistics(lib.chunks)


def research(question: DataFrame, lib: Library, k: int = 10, rounds: int = 3) -> DataFrame:
    """Deep research on each question: sub-queries in rounds, until it has a good hit and enough chunks or nothing new comes; all questions of a round are one job."""
    ask = lambda q, words: q.select("query_id", F.posexplode(words(F.col("query"))).alias("n", "query")).withColumn("part", F.concat_ws("/", F.col("query_id").cast("string"), "n"))
    wanted, left, found = ask(question, intent.decompose), question, None
    for _ in range(rounds):
        wanted = cut(wanted)
        hits = retrieve(wanted.select(F.col("part").alias("query_id"), "query"), lib, k).select(F.col("query_id").alias("part"), "chunk_id", "score")
        hits = hits.join(wanted.select("part", "query_id"), "part").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        size = lambda d: d.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
        before = size(found).select("query_id", F.col("n").alias("was")) if found is not None else None
        found = cut(hits if found is None else retrieval.union_first(found, hits))
        now = left.select("query_id", "query").join(size(found), "query_id", "left")
        now = now.withColumn("was", F.lit(0)) if before is None else now.join(before, "query_id", "left")
        grown = F.coalesce("n", F.lit(0)) > F.coalesce("was", F.lit(0))
        enough = (F.coalesce("n", F.lit(0)) >= k) & (F.coalesce("best", F.lit(0.0)) >= 0.6)
        left = cut(now.where(grown & ~enough).select("query_id", "query"))
        if left.isEmpty():
            break
        wanted = ask(left, intent.variants)
    return retrieval.ranked(found)
