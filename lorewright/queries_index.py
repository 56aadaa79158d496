"""Registered queries of the stored indexes: each writes its index below the shared folder, reads it again and must say what a scan of the tables says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import tokens
from lorewright.operators import cells, chunking, expressions, formulas, hyperplanes, interaction, linking, overlap, positions, postings, retrieval
from lorewright.operators.lineage import cut, shared_folder, written
from lorewright.plans import flows, hierarchy, metrics, segments
from lorewright.queries import _COS, _INDEX, Query, _tokens, docs_as_chunks, items_as_queries, t
from lorewright.queries_cases import _D, docs

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


# -- segments: all documents; then all again, those with even ids changed; then a fifth deleted and a third given as at first

_CHANGED = "CASE WHEN doc_id % 2 = 0 THEN text || ' ' || source || ' ' || lang ELSE text END"
_LEFT = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE {_CHANGED} END AS text FROM documents WHERE text IS NOT NULL AND (doc_id % 5 <> 1 OR doc_id % 3 = 0)"
_REBUILT = _INDEX.replace("FROM documents", f"FROM ({_LEFT})", 1).replace("doc_id AS chunk_id", "doc_id::VARCHAR AS chunk_id", 1)


def _grown(spark, sf, fanout: int = segments.FANOUT) -> segments.Segments:
    d = t(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    index = segments.open_index(spark, shared_folder(spark, "segments"), segments.whole_documents, fanout)
    index.update(d)
    index.update(d.withColumn("text", F.expr(_CHANGED)))
    index.update(d.where("doc_id % 3 = 0"), d.where("doc_id % 5 = 1"))
    return index


@query(f"WITH {_REBUILT} SELECT query_id, chunk_id, score, rank FROM bm")
def idx1_segments_search(spark, sf) -> DataFrame:
    """Lexical search over an index of three batches."""
    return _grown(spark, sf).search(items_as_queries(spark, sf), 10, digits=6).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_REBUILT} SELECT term, df, (SELECT sum(tf) FROM p WHERE p.term = df.term)::BIGINT AS tf, (SELECT n FROM corpus)::BIGINT AS n, round((SELECT avgdl FROM corpus), 6) AS avgdl FROM df")
def idx1_segments_counts(spark, sf) -> DataFrame:
    """Document frequencies and corpus line as sums over segments."""
    c = _grown(spark, sf).counts()
    return c["df"].crossJoin(F.broadcast(c["corpus"])).select("term", "df", "tf", "n", F.round("avgdl", 6).alias("avgdl"))  # one line


@query(f"SELECT doc_id, sha256(text) AS content_hash, len({_tokens('text')})::BIGINT AS length FROM ({_LEFT})")
def idx1_segments_documents(spark, sf) -> DataFrame:
    """The documents that hold after three batches."""
    return _grown(spark, sf).live("documents").select("doc_id", "content_hash", F.col("length").cast("long").alias("length"))


# -- postings in blocks by impact


@query(f"WITH {_INDEX} SELECT query_id, chunk_id, score, rank FROM bm")
def ret2_impact_blocks(spark, sf) -> DataFrame:
    c = docs_as_chunks(spark, sf)
    full = postings.counted_texts(written(c.select("chunk_id", F.col("chunk_id").alias("doc_id"), tokens(F.col("content")).alias("t")), "tokens"))
    path = shared_folder(spark, "postings")
    n = full["corpus"].first()
    postings.store(postings.to_blocks(full["postings"], n["avgdl"] or 1.0), path)
    return postings.search(items_as_queries(spark, sf), spark.read.parquet(path), cut(full["df"]), full["corpus"], 10, digits=6).select("query_id", "chunk_id", "score", "rank")


# -- vectors in cells


def _cells(spark, sf) -> tuple[DataFrame, cells.Cells]:
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return q, cells.build(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), shared_folder(spark, "cells"))


@query(f"WITH {_COS} SELECT query_id, chunk_id, score, rank FROM v")
def ret1_cells_exact(spark, sf) -> DataFrame:
    q, index = _cells(spark, sf)
    return cells.search(q, index, 10, 0.2, exact=True, digits=8).select("query_id", "chunk_id", "score", "rank")


@query()  # finds at least nine of ten of the exact ones; tests/test_index.py measures it
def ret1_cells_probed(spark, sf) -> DataFrame:
    q, index = _cells(spark, sf)
    return cells.search(q, index, 10, 0.2, digits=8).select("query_id", "chunk_id", "score", "rank")


# -- positions: of each benchmark item its first word, its second and third, its fourth to eighth with what stands between them, and one that is nowhere

_W = r"[\p{L}\p{N}\p{M}_]"
_ITEM_TERMS = rf"list_filter([regexp_extract(text, '{_W}+', 0), regexp_extract(text, '^[^\p{{L}}\p{{N}}\p{{M}}_]*{_W}+[^\p{{L}}\p{{N}}\p{{M}}_]+({_W}+[^\p{{L}}\p{{N}}\p{{M}}_]+{_W}+)', 1), regexp_extract(text, '^(?:[^\p{{L}}\p{{N}}\p{{M}}_]*{_W}+){{3}}[^\p{{L}}\p{{N}}\p{{M}}_]+((?:{_W}+[^\p{{L}}\p{{N}}\p{{M}}_]+){{4}}{_W}+)', 1), 'nowhere to be found'], lambda x: x <> '')"


def _item_terms(spark, sf) -> DataFrame:
    n = f"[^{_W[1:-1]}]"
    first = [rf"{_W}+", rf"^{n}*{_W}+{n}+({_W}+{n}+{_W}+)", rf"^(?:{n}*{_W}+){{3}}{n}+((?:{_W}+{n}+){{4}}{_W}+)"]
    found = [F.regexp_extract("text", p, min(i, 1)) for i, p in enumerate(first)]
    terms = F.filter(F.array(*found, F.lit("nowhere to be found")), lambda x: x != "")
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))


def _positions(spark, sf) -> DataFrame:
    path = shared_folder(spark, "positions")
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("text").alias("content"))
    positions.store(positions.build(d), path)
    return spark.read.parquet(path)


# words of a term stand in a row, with the same separators, and are whole: every word gets a mark at either end
_MARKED = lambda c: rf"regexp_replace(lower({c}), '({_W}+)', chr(2) || '\1' || chr(3), 'g')"
_FOUND = f"q AS (SELECT item_id AS query_id, {_ITEM_TERMS} AS terms FROM benchmark), u AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM q), d AS (SELECT doc_id, source, {_MARKED('text')} AS m FROM documents), h AS (SELECT query_id, n, term, doc_id, source FROM u JOIN d ON contains(m, {_MARKED('term')}))"


@query(f"WITH {_FOUND} SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT query_id, doc_id AS chunk_id, count(*) / any_value(n) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) / any_value(n) DESC, doc_id) AS rank FROM h GROUP BY query_id, doc_id) WHERE rank <= 10")
def flt6_positions(spark, sf) -> DataFrame:
    """Words and phrases of benchmark items as whole words of documents, by joining places."""
    return positions.exact_terms(_item_terms(spark, sf), _positions(spark, sf)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_FOUND} SELECT DISTINCT query_id, source AS doc_id FROM h")
def flt7_positions(spark, sf) -> DataFrame:
    """The sources in which any of an item's words and phrases stands."""
    return positions.documents_with(_item_terms(spark, sf).select("query_id", F.explode("terms").alias("term")).withColumn("query_id", F.struct("query_id", "term")), _positions(spark, sf)).select("query_id.query_id", "doc_id").distinct()


# -- late interaction: five vectors a chunk; the first three of every twentieth chunk ask


_PARTS = "c AS (SELECT vec_id // 5 AS chunk_id, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), g AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM c)"


@query(
    f"""WITH {_PARTS}, m AS (SELECT q.chunk_id AS query_id, q.vec_id, d.chunk_id, max(CASE WHEN q.n * d.n = 0 THEN 0 ELSE list_inner_product(q.e, d.e) / (q.n * d.n) END) AS best FROM g q JOIN g d ON q.chunk_id % 20 = 0 AND q.vec_id % 5 < 3 GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, round(sum(best), 8) AS score FROM m GROUP BY ALL)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10"""
)
def ret8_interaction_index(spark, sf) -> DataFrame:
    e = t(spark, sf, "embeddings").withColumn("chunk_id", F.floor(F.col("vec_id") / 5))
    lists = lambda d, name: d.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).select("chunk_id", F.transform("v", lambda x: x["embedding"]).alias(name))
    index = interaction.build(lists(e, "vectors"), shared_folder(spark, "interaction"))
    asked = lists(e.where("chunk_id % 20 = 0 AND vec_id % 5 < 3"), "query_vectors").withColumnRenamed("chunk_id", "query_id")
    return interaction.search(asked, index, 10, digits=8).select("query_id", "chunk_id", "score", "rank")


# -- hierarchy: sources are documents, languages their sections, documents the chunks; vectors by id. One source is built in a second step

_H = """h AS (SELECT doc_id AS chunk_id, source AS doc_id, lang AS section, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = documents.doc_id WHERE source IS NOT NULL)"""
_MEAN = lambda by: f"(SELECT {by}, list(round(x, 6) ORDER BY i) AS embedding FROM (SELECT {by}, i, avg(x) AS x FROM (SELECT {by}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM h WHERE embedding IS NOT NULL) GROUP BY ALL) GROUP BY ALL)"


def _rounded(x: Column, digits: int) -> Column:
    """As round() of the SQL: what is below zero keeps its sign, so a mean just below it is -0.0."""
    return F.when(x < 0, -F.round(-x, digits)).otherwise(F.round(x, digits))


def _hierarchy(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = t(spark, sf, "documents").where("source is not null")
    c = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.upper("source").alias("doc_title"), F.concat_ws(" > ", "lang", F.lit("part")).alias("header_path"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    one = d.agg(F.min("source")).first()[0]
    # what is there of the source is wrong at first, and mended by the second step
    first = cut(hierarchy.states(c.withColumn("content", F.when(F.col("doc_id") == one, "old").otherwise(F.col("content"))), v))
    return hierarchy.summaries(cut(hierarchy.updated(first, c.where(F.col("doc_id") == one), v)))


@query(f"WITH {_H}, s AS (SELECT doc_id, count(*) AS n, 'Documento: ' || upper(doc_id) || '. ' || array_to_string(list_transform(list(text ORDER BY chunk_id)[1:3], lambda t: substr(t, 1, 100)), ' ') AS summary FROM h GROUP BY doc_id) SELECT s.doc_id, n, summary, embedding FROM s LEFT JOIN {_MEAN('doc_id')} m USING (doc_id)")
def ret14_hierarchy_documents(spark, sf) -> DataFrame:
    return _hierarchy(spark, sf)[0].select("doc_id", "n", "summary", F.transform("embedding", lambda x: _rounded(x, 6)).alias("embedding"))


_COSINE = "list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)))"


@query(
    f"""WITH {_H}, q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE vec_id % 100 = 0),
    d AS (SELECT query_id, doc_id, {_COSINE} AS score FROM (SELECT query_id, x, doc_id, embedding AS y FROM q, {_MEAN('doc_id')} m)),
    best AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3),
    k AS (SELECT query_id, doc_id FROM best WHERE top < 0.3 OR score >= 0.3),
    s AS (SELECT query_id, doc_id, 'sec_' || doc_id || '_' || substr(sha256(section), 1, 16) AS section_id, {_COSINE} AS score FROM (SELECT q.query_id, x, k.doc_id, section, embedding AS y FROM k JOIN q USING (query_id) JOIN {_MEAN('doc_id, section')} m USING (doc_id)))
    SELECT query_id, doc_id, section_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id)::INT AS rank FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) <= 5"""
)
def ret14_hierarchy_route(spark, sf) -> DataFrame:
    six = lambda d: d.where("embedding is not null").withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))
    d, s = (six(x) for x in _hierarchy(spark, sf))
    q = t(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.route_hierarchy(q, d, s, doc_least=0.3, section_least=0.1).select("query_id", "doc_id", "section_id", F.round("score", 6).alias("score"), "rank")


# -- similar questions by hyperplanes: every hundredth vector, in coarse steps, asks all others and itself

_COARSE = "list_transform(embedding, lambda x: round(x::DOUBLE * 16) / 16)"


@query(
    f"""WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id, {_COARSE} AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS question_id, c.vec_id::VARCHAR AS cache_id, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS similarity FROM q, c)
    SELECT question_id, cache_id, round(similarity, 8) AS similarity FROM s WHERE similarity >= 0.92 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, cache_id DESC) = 1"""
)
def cache2_hyperplanes(spark, sf) -> DataFrame:
    e = t(spark, sf, "embeddings")
    coarse = F.transform("embedding", lambda x: F.round(x.cast("double") * 16) / 16)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.lit("").alias("query"), coarse.alias("query_vector"))
    cache = e.select(F.col("vec_id").cast("string").alias("cache_id"), F.lit("").alias("response"), F.col("embedding").alias("query_embedding"))
    return hyperplanes.answer_lookup(q, cache, 0.92).select("question_id", "cache_id", F.round("similarity", 8).alias("similarity"))


# -- names: all words of five letters or more of the benchmark, and all pairs of words in a row

_BW = "SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark"
_NAMES = f"n AS (SELECT DISTINCT name FROM (SELECT unnest(w) AS name FROM ({_BW}) UNION ALL SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM ({_BW}) WHERE len(w) > 1) WHERE length(name) >= 5)"


def _names(spark, sf) -> DataFrame:
    w = t(spark, sf, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return w.where("w is not null").select(F.explode(F.concat("w", pairs)).alias("name")).where(F.length("name") >= 5).distinct()


@query(f"WITH {_NAMES} SELECT doc_id, count(*) AS n, sha256(string_agg(name, ',' ORDER BY name)) AS names_sha256 FROM documents JOIN n ON contains(lower(text), name) GROUP BY doc_id")
def gra2_names_in_texts(spark, sf) -> DataFrame:
    """The benchmark's names in every whole document."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.lower("text").alias("text"))
    hits = linking.names_in_texts(d, _names(spark, sf)).groupBy(F.col("query_id").alias("doc_id"))
    return hits.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ","), 256).alias("names_sha256"))


@query(rf"WITH {_NAMES}, q AS (SELECT conv_id * 1000 + turn AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS text FROM conversations) SELECT query_id, count(*) AS n, sha256(string_agg(name, ',' ORDER BY name)) AS names_sha256 FROM (SELECT DISTINCT query_id, name FROM q JOIN n ON contains(name, q.text)) GROUP BY query_id")
def gra2_texts_in_names(spark, sf) -> DataFrame:
    """The names of which a word of a conversation is part."""
    q = t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("text"))
    hits = linking.name_lists(q, _names(spark, sf))
    return hits.select("query_id", F.size("names").cast("long").alias("n"), F.sha2(F.array_join("names", ","), 256).alias("names_sha256"))


# -- sentences of documents that say what a sentence of the benchmark says: half of all their words in common

_SAID = lambda t, i: f"SELECT {i}, k, unnest(list_distinct(regexp_extract_all(s, '[a-z0-9]+'))) AS word FROM (SELECT {i}, generate_subscripts(x, 1) AS k, unnest(x) AS s FROM (SELECT {i}, string_split_regex(lower(text), '[.!?]\\s+') AS x FROM {t} WHERE text IS NOT NULL))"


@query(
    f"""WITH a AS ({_SAID('documents', 'doc_id')}), b AS ({_SAID('benchmark', 'item_id')}), an AS (SELECT doc_id, k, count(*) AS n FROM a GROUP BY ALL), bn AS (SELECT item_id, k, count(*) AS n FROM b GROUP BY ALL),
    c AS (SELECT doc_id, a.k AS ak, item_id, b.k AS bk, count(*) AS common FROM a JOIN b USING (word) GROUP BY ALL)
    SELECT doc_id, item_id, count(*) AS n_pairs, sum(common)::BIGINT AS common FROM c JOIN an USING (doc_id) JOIN bn USING (item_id) WHERE an.k = ak AND bn.k = bk AND 100 * common >= 50 * (an.n + bn.n - common) GROUP BY ALL"""
)
def joi10_sentence_sets(spark, sf) -> DataFrame:
    def said(table: str, i: str, name: str) -> DataFrame:
        s = t(spark, sf, table).select(i, F.posexplode(F.split(F.lower("text"), r"[.!?]\s+")).alias("k", "s"))
        return s.select(F.struct(i, "k").alias(name), F.regexp_extract_all("s", F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))

    pairs = overlap.similar_sets(said("documents", "doc_id", "left_id"), said("benchmark", "item_id", "right_id"), 50)
    return pairs.groupBy("left_id.doc_id", "right_id.item_id").agg(F.count("*").alias("n_pairs"), F.sum("common").alias("common"))


# -- figures of a run


@query(
    f"""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]\\s+')) AS s FROM documents WHERE text IS NOT NULL), k AS (SELECT unnest({_tokens('s')}) AS w FROM s)
    SELECT 'documents' AS stage, 'rows' AS measure, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'documents', 'chars', sum(length(text)) FROM documents UNION ALL SELECT 'documents', 'without_text', count(*) FILTER (text IS NULL) FROM documents
    UNION ALL SELECT 'sentences', 'rows', count(*) FROM s UNION ALL SELECT 'sentences', 'longest', max(length(s)) FROM s UNION ALL SELECT 'tokens', 'rows', count(*) FROM k UNION ALL SELECT 'tokens', 'chars', sum(length(w)) FROM k"""
)
def res16_run_metrics(spark, sf) -> DataFrame:
    """A flow of three stages, written once, and what its stages saw on the way."""
    run = metrics.Run(spark)
    d = run.watch(t(spark, sf, "documents").select("doc_id", "text"), "documents", chars=F.sum(F.length("text")), without_text=F.count_if(F.col("text").isNull()))
    s = run.watch(d.select("doc_id", F.explode(F.split("text", r"[.!?]\s+")).alias("s")), "sentences", longest=F.max(F.length("s")))
    k = run.watch(s.select("doc_id", F.explode(tokens(F.col("s"))).alias("w")), "tokens", chars=F.sum(F.length("w")))
    k.write.mode("overwrite").parquet(shared_folder(spark, "tokens"))
    path = shared_folder(spark, "metrics")
    run.write(path)
    return spark.read.parquet(path).select("stage", "measure", "value")


# -- flows over lexical search: several wordings of a question, and a made-up answer

_ABOUT = "array_to_string(string_split(regexp_replace(text, '[?¿]', '', 'g'), ' ')[1:3], ' ')"
_ASKED = f"a AS (SELECT item_id, lower({_ABOUT}) AS x, '¿Qué es ' || {_ABOUT} || '?' AS query FROM benchmark)"
_WORDED = f"(SELECT item_id || '/' || i AS item_id, CASE i WHEN 0 THEN query WHEN 1 THEN 'definición de ' || trim(x) ELSE trim(x) || ' explicación' END AS text FROM a, (VALUES (0), (1), (2)) AS v(i))"


def _asked(spark, sf) -> DataFrame:
    about = F.array_join(F.slice(F.split(F.regexp_replace("text", "[?¿]", ""), " "), 1, 3), " ")
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("¿Qué es "), about, F.lit("?")).alias("query"))


def _lexical(spark, sf):
    """A search over one index, whose postings each search counts from the table of tokens, for its terms only: all of them would be many times the texts."""
    full = retrieval.lexical_index(docs_as_chunks(spark, sf))
    full = {**full, "df": cut(full["df"]), "corpus": cut(full["corpus"])}
    return lambda q, k: retrieval.bm25(q, full, k, digits=6)


@query(
    f"WITH {_ASKED}, {_INDEX.replace('FROM benchmark)', f'FROM {_WORDED})')}, f AS (SELECT split_part(query_id, '/', 1)::BIGINT AS query_id, chunk_id, sum(1 / (60 + rank)) * (1 + 0.1::DOUBLE * (count(DISTINCT split_part(query_id, '/', 2)) - 1)) AS score, count(DISTINCT split_part(query_id, '/', 2)) AS n_variants FROM bm GROUP BY ALL)"
    " SELECT query_id, chunk_id, round(score, 9) AS score, n_variants FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM f) WHERE r <= 10"
)
def ret10_multi_query(spark, sf) -> DataFrame:
    hits = flows.multi_query(_asked(spark, sf), _lexical(spark, sf), 1000)
    hits = retrieval.top_k(hits.drop("rank").withColumn("score", F.round("score", 9)), 10)
    return hits.where("rank <= 10").select("query_id", "chunk_id", "score", "n_variants")


def _made_up(prompts: list[str]) -> list[str | None]:
    """A stand-in for a model: the question without its first two words, three times; no answer where one word is all that is left."""
    left = [p.split("\n\n")[0].split(" ")[3:] for p in prompts]
    return [" ".join(x * 3) if len(x) > 1 else None for x in left]


_GIVEN = f"(SELECT item_id || '/0' AS item_id, query AS text FROM a UNION ALL SELECT item_id || '/1', CASE WHEN len(w) > 1 THEN array_to_string(list_concat(w, w, w), ' ') ELSE query END FROM (SELECT item_id, query, string_split(query, ' ')[3:] AS w FROM a))"


@query(
    f"WITH {_ASKED}, {_INDEX.replace('FROM benchmark)', f'FROM {_GIVEN})').replace('rank <= 10', 'rank <= 16')}, f AS (SELECT split_part(query_id, '/', 1)::BIGINT AS query_id, chunk_id, round(avg(score * CASE WHEN split_part(query_id, '/', 2) = '0' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END), 6) AS score FROM bm GROUP BY ALL)"
    " SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM f) WHERE r <= 8"
)
def ret11_hypothetical(spark, sf) -> DataFrame:
    """With a stand-in for the model, as its answer must be known."""
    search = _lexical(spark, sf)
    hits = flows.hypothetical(_asked(spark, sf), lambda q, k: search(q, 16), 1000, _made_up)
    return retrieval.top_k(hits.drop("rank").withColumn("score", F.round("score", 6)), 8).select("query_id", "chunk_id", "score")


# -- chunks: nothing of a text is lost or repeated on the levels without overlap


@query(r"SELECT doc_id, level, sha256(regexp_replace(text, '[ \t\n\r\x0B\f]+', '', 'g')) AS covered_sha256 FROM documents, (VALUES ('macro'), ('meso')) AS l(level) WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> ''")
def prj5_chunk_coverage(spark, sf) -> DataFrame:
    """All chunks of a document and level, one after another without white space."""
    d = t(spark, sf, "documents").select("doc_id", F.lit("t").alias("doc_title"), F.lit(0).alias("section_seq"), F.lit("t").alias("header_path"), F.col("text").alias("content"))
    c = chunking.chunks(d, dedup_scope=None).where("level != 'micro'")
    one = c.groupBy("doc_id", "level").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c"))
    text = F.regexp_replace(F.array_join(F.transform("c", lambda x: x["content"]), ""), r"[ \t\n\r\x0B\f]+", "")
    return one.select("doc_id", "level", F.sha2(text, 256).alias("covered_sha256"))


# -- expressions of the documents' letters and lengths, written in two ways

_E = f"{_D}, e AS (SELECT doc_id, n, substr(a, 2, 1) AS l, substr(b, 2, 1) AS m FROM d)"


def _expressions(spark, sf) -> DataFrame:
    letter = lambda c: F.substring(c, 2, 1)
    n = F.col("n").cast("string")
    one, two = F.concat(letter("a"), F.lit("*"), n, F.lit(" + sin("), letter("b"), F.lit(")")), F.concat(F.lit("sin("), letter("b"), F.lit(") + "), n, F.lit("*"), letter("a"))
    return docs(spark, sf).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, one).otherwise(two).alias("expression"))


def _first_of_class(c: DataFrame) -> DataFrame:
    return c.join(c.groupBy("class").agg(F.min("id").alias("first")), "class").select(F.col("id").alias("doc_id"), "first")


@query(f"WITH {_E} SELECT doc_id, min(doc_id) OVER (PARTITION BY l, m, n) AS first FROM e")
def res1_expression_classes(spark, sf) -> DataFrame:
    """Expressions that are equal up to the order of sums and products, by the first document of each class."""
    return _first_of_class(expressions.classes(_expressions(spark, sf)))


@query(f"WITH {_E} SELECT doc_id, min(doc_id) OVER (PARTITION BY translate(l, 'eiou', 'aaaa'), translate(m, 'eiou', 'aaaa'), n) AS first FROM e")
def res2_congruence(spark, sf) -> DataFrame:
    """The same under equalities that make all vowels one, two by two."""
    known = spark.createDataFrame([("a", "e"), ("i", "e"), ("o", "u"), ("sin(i)", "sin(o)"), ("o", "i")], "lhs string, rhs string")
    return _first_of_class(expressions.classes(_expressions(spark, sf), known))


@query(f"WITH {_E}, f AS (SELECT doc_id, l = m AS one, n, '$' || l || ' \\cdot ' || n || ' + \\sin(' || m || ')$' AS latex FROM e), q AS (SELECT DISTINCT one, n, doc_id AS query_id FROM f WHERE doc_id % 100 = 0) SELECT DISTINCT query_id, latex FROM q JOIN f USING (one, n)")
def joi15_equal_formulas(spark, sf) -> DataFrame:
    """Formulas that are a query's with other names; every hundredth document asks."""
    letter = lambda c: F.substring(c, 2, 1)
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("$"), letter("a"), F.lit(" \\cdot "), F.col("n").cast("string"), F.lit(" + \\sin("), letter("b"), F.lit(")$")).alias("latex"))
    return formulas.equal_formulas(d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "latex"), d)
