"""Batch retrieval: every function takes a table of queries and answers all of them in one plan.

Hit lists share one long form: query_id, chunk_id, score (and rank). Ties go to the smaller
chunk_id, so results don't depend on partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.answers import relevance_overlap, verdict
from lorewright.functions.text import cosine, tokens
from lorewright.operators import nearest
from lorewright.operators.lineage import cut, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Distinct terms of a query set up to which they are broadcast.
QUERY_TERMS = 100_000
RRF_K = 60
#: Queries, and bytes of them, up to which the query side is broadcast; more of them go in blocks of this size.
QUERY_BLOCK = 10_000
QUERY_BYTES = 16 << 20


def against(rows: DataFrame, queries: DataFrame, key: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """All rows with all queries of a given set. The set is computed once and measured: up to `block` queries of QUERY_BYTES together are broadcast, more are cut into blocks that the rows meet by equality."""
    queries = cut(queries)
    kinds = dict(queries.dtypes)
    # what a row takes: eight bytes a number, a text's bytes; of arrays, their elements (those of arrays of arrays as wide as the first)
    width = lambda c, t: F.octet_length(c) if t in ("string", "binary") else 8 * F.size(c) * (F.coalesce(F.size(F.get(c, F.lit(0))), F.lit(1)) if t.startswith("array<array") else 1) if t.startswith("array") else F.lit(8)
    weight = reduce(lambda a, b: a + b, [F.coalesce(width(F.col(c), t).cast("long"), F.lit(0)) for c, t in kinds.items()])
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first()
    n = size["n"]
    if n <= block and size["bytes"] <= QUERY_BYTES:
        return rows.join(F.broadcast(queries))
    blocks = max(-(-n // block), -(-size["bytes"] // QUERY_BYTES))
    parted = queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(parted, "_block").drop("_block")


def ranked(hits: DataFrame, by: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(w))


def top_k(hits: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    return ranked(hits, by, score, tie).where(F.col("rank") <= k)


# -- lexical


def lexical_index(chunks: DataFrame) -> dict[str, DataFrame]:
    """(chunk_id, content) -> postings (term, chunk_id, tf, length), document frequencies and the corpus line; all mergeable counts.

    Texts are cut into tokens once; the token lists are kept as a table, as all parts of the index and every search read them.
    """
    t = written(chunks.select("chunk_id", tokens(F.col("content")).alias("t")), "tokens")
    lengths = t.select("chunk_id", F.size("t").alias("length"))
    postings = t.select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("chunk_id", "length", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    return {"postings": postings, "df": df, "corpus": corpus}


def idf(index: dict[str, DataFrame]) -> DataFrame:
    """(term, idf): ln((N - df + 0.5) / (df + 0.5)); negative ones become a quarter of the mean over all terms."""
    raw = index["df"].join(F.broadcast(index["corpus"].select("n"))).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, index: dict[str, DataFrame], k: int = 10, *, pad_zero: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, query) -> the k best chunks of each; query terms count as often as they occur. Scores must be positive (or, with pad_zero, none negative)."""
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # a given set of queries has few terms: the index is cut to them before anything is weighed or shuffled
    wanted = q.select("term").distinct()
    if wanted.count() <= QUERY_TERMS:
        wanted = F.broadcast(wanted)
    index = {**index, "postings": index["postings"].join(wanted, "term", "left_semi")}
    weights = q.join(idf(index), "term")
    avg = index["corpus"].select("avgdl")
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    scored = index["postings"].join(weights, "term").join(F.broadcast(avg)).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return top_k(scored.where("score >= 0" if pad_zero else "score > 0"), k)


def exact_terms(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, terms) -> chunks with any of the terms as whole words (any case); score is the share of terms found. Queries are a small, given set."""
    hit = lambda t: F.rlike(F.col("content"), F.concat(F.lit(r"(?iU)\b\Q"), t, F.lit(r"\E\b")))
    n = F.size(F.filter("terms", hit))
    return top_k(against(chunks, queries).select("query_id", "chunk_id", (n / F.size("terms")).alias("score")).where("score > 0"), k)


def documents_with_term(chunks: DataFrame, term: str) -> DataFrame:
    return chunks.where(F.col("content").rlike(rf"(?iU)\b\Q{term}\E\b")).select("doc_id").distinct()


# -- vectors


def where_metadata(hits: DataFrame, equal: dict | None = None, difficulty: str | None = None) -> DataFrame:
    """Equality filters, all of which must hold, and a comma-separated list of levels."""
    if equal:
        hits = hits.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in equal.items()]))
    return hits.where(F.col("difficulty_level").isin([d.strip() for d in difficulty.split(",")])) if difficulty else hits


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, threshold: float = 0.5, *, digits: int | None = None) -> DataFrame:
    """(query_id, query_vector) x (chunk_id, embedding) -> the k most similar of each by cosine, at or above the threshold.

    A given query set against all rows (see `against`), in blocks of both: a product of two blocks
    leaves out what can't be among the best (see `nearest`), and each task keeps its own best k
    before the shuffle.
    """
    score = F.col("score")
    hits = nearest_rows(queries, vectors, k, threshold, margin=0.0 if digits is None else 10.0**-digits)
    return top_k(hits.select("query_id", "chunk_id", (F.round(score, digits) if digits is not None else score).alias("score")).where(F.col("score") >= threshold), k)


def nearest_rows(queries: DataFrame, vectors: DataFrame, k: int, threshold: float, *, margin: float = 0.0, ties: str = "ascending") -> DataFrame:
    """(query_id, query_vector) x (chunk_id, embedding) -> (query_id, chunk_id, score): the k best of each by cosine are among them, with what may tie once rounded by less than `margin`."""
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    asked = nearest.packed(queries, "query_id", "query_vector").select(F.col("ids").alias("query_ids"), F.col("dims").alias("query_dims"), F.col("data").alias("query_data"))
    # few but heavy rows, which go to as many tasks as there are
    rows = nearest.packed(vectors, "chunk_id", "embedding").repartition(max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    return against(rows, asked, "query_ids").mapInArrow(nearest.search(k, threshold, margin, ties), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def late_interaction(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Sum over query token vectors of the best cosine with a chunk's token vectors. Both sides: (id, vectors ARRAY<ARRAY>)."""
    best = lambda q: F.array_max(F.transform("vectors", lambda d: cosine(q, d)))
    score = F.aggregate(F.transform("query_vectors", best), F.lit(0.0), lambda s, v: s + v)
    return top_k(against(chunks, queries).select("query_id", "chunk_id", score.alias("score")), k)


def sparse_search(query_terms: DataFrame, postings: DataFrame, k: int = 10, *, digits: int | None = None) -> DataFrame:
    """Dot products of sparse vectors: (query_id, term, weight) with (chunk_id, term, weight)."""
    total = F.sum("contribution")
    return top_k(explain_sparse(query_terms, postings).groupBy("query_id", "chunk_id").agg((F.round(total, digits) if digits is not None else total).alias("score")), k)


def explain_sparse(query_terms: DataFrame, postings: DataFrame) -> DataFrame:
    q = query_terms.select("query_id", "term", F.col("weight").alias("query_weight"))
    return postings.join(q, "term").select("query_id", "chunk_id", "term", (F.col("weight") * F.col("query_weight")).alias("contribution"))


# -- fusion

WEIGHTS = {"vector": 0.5, "bm25": 0.3, "graph": 0.2}


def fuse(hits: DataFrame, weights: dict[str, float] | DataFrame | None = None, k: int | None = 10, *, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, chunk_id, source, rank, score); a union and one aggregation, no joins of the lists.

    weights: by source, or a table (query_id, source, weight). A chunk that a source lists
    more than once counts at its best rank. source_scores keeps each source's own score.
    """
    best = hits.groupBy("query_id", "chunk_id", "source").agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"))
    if isinstance(weights, DataFrame):
        best = best.join(weights, ["query_id", "source"])
    else:
        table = {**WEIGHTS, **(weights or {})}
        best = best.withColumn("weight", F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("source")))
    fused = best.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") / (rrf_k + F.col("rank"))).alias("score"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "score")))).alias("source_scores"),
    )
    return top_k(fused, k) if k else ranked(fused)


def fuse_variants(hits: DataFrame, k: int = 10, method: str = "rrf") -> DataFrame:
    """Fusion over variants of a query (query_id, variant, chunk_id, rank, score): reciprocal ranks or the best score, raised by 10 % for each further variant."""
    base = F.sum(1 / (RRF_K + F.col("rank"))) if method == "rrf" else F.max("score")
    fused = hits.groupBy("query_id", "chunk_id").agg(base.alias("base"), F.countDistinct("variant").alias("n_variants"))
    return top_k(fused.withColumn("score", F.col("base") * (1 + 0.1 * (F.col("n_variants") - 1))).drop("base"), k)


def weighted_mean(hits: DataFrame, k: int = 10) -> DataFrame:
    """Hits of the original and hypothetical texts (text, weight): scores times weight, averaged over the texts that found the chunk."""
    return top_k(hits.groupBy("query_id", "chunk_id").agg(F.avg(F.col("score") * F.col("weight")).alias("score")), k)


# Weight of the reranker and width by preset.
PRESETS = {"fast": (0.6, 50), "balanced": (0.7, 100), "quality": (0.75, 150), "max_quality": (0.8, 200)}


def rerank(hits: DataFrame, preset: str = "balanced", k: int = 10) -> DataFrame:
    """Mixes a reranker's score (ce, scaled to 0..1 in each query, 0.5 where constant) with the original one; single hits keep theirs."""
    weight, width = PRESETS[preset]
    w = Window.partitionBy("query_id")
    wide = top_k(hits, width).drop("rank")
    low, high, n = F.min("ce").over(w), F.max("ce").over(w), F.count("*").over(w)
    scaled = F.when(high == low, 0.5).otherwise((F.col("ce") - low) / (high - low))
    return top_k(wide.withColumn("score", F.when(n == 1, F.col("score")).otherwise(weight * scaled + (1 - weight) * F.col("score"))), k)


# -- hierarchy


def merge_siblings(hits: DataFrame, chunks: DataFrame, *, least: int = 3) -> DataFrame:
    """Three or more hits of one parent become the parent, with their best score and ids."""
    by_parent = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id")
    n = F.count("parent_id").over(Window.partitionBy("query_id", "parent_id"))
    marked = by_parent.withColumn("merge", F.col("parent_id").isNotNull() & (n >= least))
    merged = marked.where("merge").groupBy("query_id", F.col("parent_id").alias("chunk_id")).agg(F.max("score").alias("score"), F.array_sort(F.collect_list("chunk_id")).alias("merged_from"))
    alone = marked.where("NOT merge").select("query_id", "chunk_id", "score", F.array().cast("array<string>").alias("merged_from"))
    return ranked(merged.unionByName(alone))


def merge_by_share(hits: DataFrame, chunks: DataFrame, *, share: float = 0.5) -> DataFrame:
    """A parent of whose children at least this share was hit stands in for them, once, at its first child's rank."""
    kids = chunks.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"))
    h = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id").join(kids, "parent_id", "left")
    h = h.withColumn("hit", F.count("parent_id").over(Window.partitionBy("query_id", "parent_id")))
    to = F.when(F.col("parent_id").isNotNull() & (F.col("hit") / F.col("n_children") >= share), F.col("parent_id")).otherwise(F.col("chunk_id"))
    first = h.withColumn("to", to).groupBy("query_id", "to").agg(F.min("rank").alias("first_rank"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("first_rank")
    return first.select("query_id", F.col("to").alias("chunk_id"), "score", F.row_number().over(w).alias("rank"))


def propositions_to_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, proposition_id, parent_chunk_id, content, score) -> best score, number, ids and content (the parent's, or the propositions')."""
    found = F.array_sort(F.collect_list(F.struct("proposition_id", "content")))
    by = hits.groupBy("query_id", F.col("parent_chunk_id").alias("chunk_id")).agg(F.max("score").alias("score"), F.count("*").alias("n_propositions"), found.alias("p"))
    parents = chunks.select("chunk_id", F.col("content").alias("parent_content"))
    text = F.coalesce("parent_content", F.array_join(F.transform("p", lambda x: x["content"]), "\n"))
    return by.join(parents, "chunk_id", "left").select("query_id", "chunk_id", "score", "n_propositions", F.transform("p", lambda x: x["proposition_id"]).alias("proposition_ids"), text.alias("content"))


def expand_context(hits: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """Each hit with the chunks up to `width` places before and after it in its document, in order, as one text. The neighbourhood is a band join on equal keys: each hit asks for 2 * width + 1 places."""
    placed = chunks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")))
    centre = hits.join(placed.select("chunk_id", "doc_id", "place"), "chunk_id")
    wanted = centre.withColumn("at", F.explode(F.sequence(F.col("place") - width, F.col("place") + width)))
    found = wanted.join(placed.select("doc_id", F.col("place").alias("at"), F.col("content").alias("part")), ["doc_id", "at"])
    text = F.array_sort(F.collect_list(F.struct("at", "part")))
    return found.groupBy("query_id", "chunk_id", "score").agg(F.count("*").alias("n_parts"), F.array_join(F.transform(text, lambda x: x["part"]), "\n\n").alias("context"))


def route_hierarchy(queries: DataFrame, documents: DataFrame, sections: DataFrame, *, docs: int = 3, doc_least: float = 0.5, section_least: float = 0.4, n_sections: int = 5) -> DataFrame:
    """Summaries (doc_id or section_id, embedding): the best documents (or the best three where none reaches the threshold), then their best sections."""
    d = against(documents, queries).select("query_id", "doc_id", cosine(F.col("query_vector"), F.col("embedding")).alias("score"))
    d = top_k(d, docs, tie="doc_id").withColumn("any", F.max(F.col("score") >= doc_least).over(Window.partitionBy("query_id")))
    d = d.where(~F.col("any") | (F.col("score") >= doc_least)).select("query_id", "doc_id")
    s = sections.join(d, "doc_id").join(queries, "query_id").select("query_id", "doc_id", "section_id", cosine(F.col("query_vector"), F.col("embedding")).alias("score"))
    return top_k(s.where(F.col("score") >= section_least), n_sections, tie="section_id")


def boost_candidates(hits: DataFrame, candidates: DataFrame, factor: float = 1.1) -> DataFrame:
    """Hits of candidate chunks (query_id, chunk_id) gain by the factor; the others fill up."""
    flagged = hits.join(candidates.select("query_id", "chunk_id").distinct().withColumn("candidate", F.lit(True)), ["query_id", "chunk_id"], "left")
    return ranked(flagged.withColumn("score", F.when(F.col("candidate"), F.col("score") * factor).otherwise(F.col("score"))).drop("rank"))


# -- correction and merging


def assess(hits: DataFrame, correct: float = 0.7, incorrect: float = 0.3) -> DataFrame:
    """(query_id, query, chunk_id, content) with overlap and verdict."""
    h = hits.withColumn("overlap", relevance_overlap(F.col("query"), F.col("content")))
    return h.withColumn("verdict", verdict(F.col("overlap"), correct, incorrect))


def corrective_action(assessed: DataFrame) -> DataFrame:
    """Per query: counts of the verdicts and what to do."""
    from lorewright.functions.answers import correction

    n = assessed.groupBy("query_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "ambiguous", "incorrect")])
    return n.withColumn("action", correction(F.col("incorrect") / F.col("n")))


def union_first(*lists: DataFrame) -> DataFrame:
    """Union by chunk; where several lists have one, the earliest list's row stays."""
    every = reduce(lambda a, b: a.unionByName(b), [x.withColumn("_list", F.lit(i)) for i, x in enumerate(lists)])
    w = Window.partitionBy("query_id", "chunk_id").orderBy("_list", F.desc("score"))
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_list")


def abstain(hits: DataFrame, least: float = 0.002, closest: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """Per query: whether its best score is too low to answer, and the closest chunks. With `queries` (query_id), those without any hit abstain too."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id"))), 1, closest)
    out = top_k(hits.drop("rank") if "rank" in hits.columns else hits, closest).groupBy("query_id").agg(F.max("score").alias("best"), (F.max("score") < least).alias("abstained"), F.transform(top, lambda x: x["chunk_id"]).alias("closest"))
    if queries is None:
        return out
    nothing = F.array().cast(out.schema["closest"].dataType)
    return queries.select("query_id").distinct().join(out, "query_id", "left").select("query_id", "best", F.coalesce("abstained", F.lit(True)).alias("abstained"), F.coalesce("closest", nothing).alias("closest"))


def coverage(hits: DataFrame) -> DataFrame:
    """Per query: distinct documents, distinct sections and tokens of its hits (doc_id, header_path, token_count)."""
    return hits.groupBy("query_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("doc_id", "header_path").alias("sections"), F.sum("token_count").alias("tokens"))


def explore_tree(hits: DataFrame) -> DataFrame:
    """Hits by document and by top section: best score and number, in one aggregation over grouping sets."""
    top = F.split("header_path", " > ")[0]
    return (
        hits.withColumn("section", top)
        .groupingSets([["query_id", "doc_id"], ["query_id", "doc_id", "section"]], "query_id", "doc_id", "section")
        .agg(F.max("score").alias("score"), F.count("*").alias("n_chunks"), F.grouping("section").alias("is_document"))
    )


def token_budget(hits: DataFrame, budget: int = 4000) -> DataFrame:
    """Hits in rank order while their tokens fit; the first that does not ends the list."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("tokens_so_far", F.sum("token_count").over(w)).where(F.col("tokens_so_far") <= budget)


def verify_claims(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(claim_id, claim) with hits (claim_id, chunk_id, content): supporting (overlap above 0.5) and related ones, status and confidence."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    h = claims.join(hits, "claim_id", "left").withColumn("overlap", F.size(F.array_intersect(words(F.col("claim")), words(F.col("content")))) / F.size(words(F.col("claim"))))
    n = h.groupBy("claim_id").agg(F.count_if(F.col("overlap") > 0.5).alias("supporting"), F.count_if((F.col("overlap") > 0.2) & (F.col("overlap") <= 0.5)).alias("related"), F.count("chunk_id").alias("n"))
    status = F.when(F.col("supporting") >= 2, "supported").when(F.col("supporting") == 1, "partial").when(F.col("related") > 0, "partial").otherwise("not_found")
    sure = F.when(F.col("supporting") >= 2, F.least(F.col("supporting") / F.col("n"), F.lit(0.8))).when(F.col("supporting") == 1, 0.5).when(F.col("related") > 0, 0.3).otherwise(0.0)
    return n.select("claim_id", "supporting", "related", status.alias("status"), sure.alias("confidence"))


def hard_negatives(pairs: DataFrame, index: dict[str, DataFrame], n: int = 3, *, digits: int | None = None) -> DataFrame:
    """(query_id, query, chunk_id): the best lexical hits that are not the pair's own chunk."""
    found = bm25(pairs.select("query_id", "query"), index, n + 1, digits=digits).select("query_id", F.col("chunk_id").alias("negative_id"), "score")
    other = found.join(pairs.select("query_id", "chunk_id"), "query_id").where(F.col("negative_id") != F.col("chunk_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "negative_id")
    return other.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "negative_id", "rank", "score")


def with_category(chunks: DataFrame, path: Column) -> DataFrame:
    from lorewright.sources.markdown import category

    return chunks.withColumn("category", category(path))


# -- small steps between hit lists and tables


def above(hits: DataFrame, least: float, score: str = "score") -> DataFrame:
    return hits.where(F.col(score) >= least)


def within(hits: DataFrame, ids: DataFrame, on: str | list[str] = "chunk_id") -> DataFrame:
    """Hits that another table names."""
    return hits.join(ids.select(*([on] if isinstance(on, str) else on)), on, "left_semi")


def without(hits: DataFrame, other: DataFrame) -> DataFrame:
    """Hits of chunks that are not among another list's of the same query."""
    return hits.join(other.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def with_parents(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Hits with their chunk's parent and further columns, null where the chunk is not known."""
    return hits.join(chunks.select("chunk_id", "parent_id", *columns), "chunk_id", "left")


def best_groups(hits: DataFrame, chunks: DataFrame, by: str, k: int = 3) -> DataFrame:
    """(query_id, `by`, score, n, rank): each query's k best groups of chunks, by their best hit."""
    h = hits.join(chunks.select("chunk_id", by), "chunk_id").groupBy("query_id", by).agg(F.max("score").alias("score"), F.count("*").alias("n"))
    return top_k(h, k, tie=by)


def cited_hits(answered: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer) -> the query's hits whose rank the answer cites as [n]."""
    from lorewright.functions.answers import cited

    return hits.join(answered.select("query_id", F.explode(cited(F.col("answer"))).alias("rank")).distinct(), ["query_id", "rank"])


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of rows with equal keys the first one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def common(hits: DataFrame, chunks: DataFrame, source: str) -> DataFrame:
    """Any search's hits (query_id, chunk_id, score, rank) as the common result: with source, document, title, path and content, empty where the chunk is not known."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    c = chunks.select("chunk_id", "doc_id", "doc_title", "header_path", "content")
    return hits.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), "rank").join(c, "chunk_id", "left").select("query_id", "chunk_id", "score", "rank", F.lit(source).alias("source"), *[text(x) for x in ("doc_id", "doc_title", "header_path", "content")])
