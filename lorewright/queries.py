"""Registered queries of the library's own operators, each with SQL that says the same on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions import answers, intent, science, text
from lorewright.operators import chunking, graph, records, retrieval
from lorewright.sources import markdown
from lorewright.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
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


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs_as_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("parent_id"))


def items_as_queries(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# -- SQL pieces

_S = lambda s: "'" + s.replace("'", "''") + "'"
_WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_STOP = "[" + ", ".join(_S(w) for w in text.STOPWORDS) + "]"


def _tokens(col: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({col}), {_S(text.PUNCTUATION)}, ''), '\\s+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"


def _sentences(col: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({col}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {_WS})), lambda s: s <> '')"


def _count(col: str, patterns, flags: str = "i") -> str:
    return "(" + " + ".join(f"regexp_matches({col}, {_S(p)}, '{flags}')::INT" if flags else f"regexp_matches({col}, {_S(p)})::INT" for p in patterns) + ")"


def _case(pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} THEN {v}" for w, v in pairs) + f" ELSE {other} END"


def _plain(col: str) -> str:
    return f"translate(lower({col}), {_S(text.ACCENTED)}, {_S(text.PLAIN)})"


# -- scalar functions on documents


@query(f"SELECT doc_id, len(k)::INT AS n_tokens, len(list_distinct(k))::INT AS n_distinct, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS k FROM documents)")
def str1_tokens(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").alias("n_tokens"), F.size(F.array_distinct("k")).alias("n_distinct"), F.md5(F.array_join("k", " ").cast("binary")).alias("digest"))


@query("SELECT doc_id, floor(length(text) / 3)::INT AS n_tokens, md5(substr(text, 1, 600)) AS cut FROM documents")
def prj4_token_estimate(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", text.token_estimate(c).alias("n_tokens"), F.md5(text.truncate_tokens(c, 200).cast("binary")).alias("cut"))


@query("SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 16) AS chunk_hash, substr(sha256(lower(trim(text))), 1, 12) AS query_hash, substr(sha256('model:' || text), 1, 32) AS cache_key FROM documents")
def hsh1_hashes(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", F.sha2(c.cast("binary"), 256).alias("full_hash"), text.short_hash(c).alias("chunk_hash"), records.query_hash(c).alias("query_hash"), records.embedding_key(F.lit("model"), c).alias("cache_key"))


@query(r"SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda s: trim(s, (' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))), chr(10))) AS cleaned FROM documents")
def str11_clean_whitespace(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(text.clean_whitespace(F.col("text")).cast("binary")).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN regexp_replace(substr(text, 1, 150), ' [^ ]*$', '') || '...' ELSE text END AS excerpt FROM documents")
def prj18_excerpt(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


_TERMS = "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(text, {_S(p)}, 'i') THEN [{', '.join(map(_S, v))}] ELSE [] END" for p, v in text.CONCEPTS.items()) + f", CASE WHEN regexp_matches(text, {_S(text.DIRAC_PATTERN)}) THEN [{', '.join(map(_S, text.DIRAC))}] ELSE [] END)"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_TERMS})), '|') AS concepts, len(regexp_extract_all(text, '\\$([^$]+)\\$', 1))::INT AS n_formulas FROM documents")
def str4_math_concepts(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", F.array_join(text.math_concepts(c), "|").alias("concepts"), F.size(F.regexp_extract_all(c, F.lit(r"\$([^$]+)\$"), F.lit(1))).alias("n_formulas"))


_EXPANDED = "(SELECT conv_id, turn, text, text AS x FROM conversations)"
for _w, _x in text.EXPANSIONS.items():
    _EXPANDED = f"(SELECT conv_id, turn, text, CASE WHEN regexp_matches(text, '\\b{_w}\\b', 'i') THEN regexp_replace(x, '\\b{_w}\\b', {_S(_x)}, 'gi') ELSE x END AS x FROM {_EXPANDED})"


@query(f"SELECT conv_id, turn, x AS expanded FROM {_EXPANDED}")
def str2_normalize_query(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", text.normalize_math_query(F.col("text")).alias("expanded"))


_M = _count("text", intent.COMPLEX_MATH, "")
_INTRO = f"{_count('text', intent.INTRODUCTORY)} * 1.0::DOUBLE + CASE WHEN {_M} = 0 THEN 0.5::DOUBLE ELSE 0 END"
_ADV = f"{_count('text', intent.ADVANCED)} * 1.5::DOUBLE + CASE WHEN {_M} BETWEEN 3 AND 5 THEN 1.5::DOUBLE WHEN {_M} > 5 THEN 2 ELSE 0 END + CASE WHEN length(text) > 0 AND len(regexp_extract_all(text, '\\$[^$]+\\$|\\$\\$[^$]+\\$\\$')) / (length(text) / 100) > 5 THEN 1.0::DOUBLE ELSE 0 END"


@query(
    f"""WITH s AS (SELECT doc_id, {_INTRO} AS a, CASE WHEN {_M} BETWEEN 1 AND 2 THEN 1.0::DOUBLE ELSE 0 END AS b, {_ADV} AS c, {_count('text', intent.RESEARCH)} * 2.0::DOUBLE AS d FROM documents),
    m AS (SELECT *, greatest(a, b, c, d) AS top FROM s)
    SELECT doc_id, CASE WHEN a = top THEN 'introductory' WHEN b = top THEN 'intermediate' WHEN c = top THEN 'advanced' ELSE 'research' END AS level, round(top / (a + b + c + d), 9) AS confidence FROM m"""
)
def str6_difficulty(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", intent.difficulty(F.col("text")).alias("d"))
    return d.select("doc_id", "d.level", F.round("d.confidence", 9).alias("confidence"))


@query(
    f"""SELECT level, {_case([(f"level = '{k}'", f"'{v}'") for k, v in intent.LABELS.items()], "'Desconocido'")} AS label, count(*) AS n FROM (
    SELECT CASE WHEN a >= greatest(b, c, d) THEN 'introductory' WHEN b >= greatest(c, d) THEN 'intermediate' WHEN c >= d THEN 'advanced' ELSE 'research' END AS level FROM (
    SELECT {_INTRO} AS a, CASE WHEN {_M} BETWEEN 1 AND 2 THEN 1.0::DOUBLE ELSE 0 END AS b, {_ADV} AS c, {_count('text', intent.RESEARCH)} * 2.0::DOUBLE AS d FROM documents)) GROUP BY level"""
)
def agg13_difficulty_distribution(spark, sf):
    d = t(spark, sf, "documents").select(intent.difficulty(F.col("text"))["level"].alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    return d.select("level", intent.difficulty_label(F.col("level")).alias("label"), "n")


_RANKED = _case([(" OR ".join(f"contains(lower(text), '{w}')" for w in v), f"'{k}'") for k, v in science.DOMAINS.items()], "'general'")


@query(f"SELECT doc_id, {_RANKED} AS domain FROM documents")
def str36_formula_domain(spark, sf):
    return t(spark, sf, "documents").select("doc_id", science.domain(F.col("text")).alias("domain"))


_IMP = "[" + ", ".join(map(_S, answers.IMPORTANT)) + "]"


@query(
    f"""WITH s AS (SELECT doc_id, unnest({_sentences('text')}) AS s FROM documents),
    w AS (SELECT doc_id, s, list_distinct(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda x: x <> '')) AS w FROM s),
    i AS (SELECT doc_id, least(1.0::DOUBLE, len(list_intersect(w, {_IMP})) / 5 * CASE WHEN len(w) < 5 THEN 0.5::DOUBLE WHEN len(w) > 50 THEN 0.8 ELSE 1 END
          + CASE WHEN contains(s, '$') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(s, '\\[\\d+\\]') THEN 0.2::DOUBLE ELSE 0 END) AS v FROM w)
    SELECT doc_id, count(*) AS n_sentences, round(sum(v), 6) AS total_importance, count(*) FILTER (v >= 0.3) AS n_kept FROM i GROUP BY doc_id"""
)
def str12_sentence_importance(spark, sf):
    s = t(spark, sf, "documents").select("doc_id", F.explode(answers.sentences(F.col("text"))).alias("s")).withColumn("v", answers.importance(F.col("s")))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.round(F.sum("v"), 6).alias("total_importance"), F.count_if(F.col("v") >= 0.3).alias("n_kept"))


# -- rules on queries and conversations

_LOW = "lower(text)"
_QT = _case([(f"regexp_matches({_plain('text')}, {_S(p)})", f"'{k}'") for k, p in intent.QUERY_TYPES.items()], "'factual'")


@query(f"SELECT conv_id, turn, {_QT} AS query_type FROM conversations")
def str25_query_type(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", intent.query_type(F.col("text")).alias("query_type"))


def _route_sql(value) -> str:
    fits = {k: f"{_count('text' if k == 'exact_term' else _LOW, intent.ROUTES[k], 'i' if k == 'exact_term' else '')} > 0" for k in intent.ROUTES}
    return _case([(fits[k], value(k)) for k in ("multi_hop", "relational", "exact_term", "comparative")], value("default"))


@query(
    f"""SELECT conv_id, turn, {_route_sql(lambda k: _S(intent.STRATEGIES[k][0]))} AS strategy, {_route_sql(lambda k: f"{intent.STRATEGIES[k][1]}::DOUBLE")} AS vector_weight,
    {_route_sql(lambda k: f"{intent.STRATEGIES[k][2]}::DOUBLE")} AS bm25_weight, {_route_sql(lambda k: f"{intent.STRATEGIES[k][3]}::DOUBLE")} AS graph_weight,
    {_route_sql(lambda k: str({'multi_hop': 20, 'comparative': 15}.get(k, 10)))} AS top_k FROM conversations"""
)
def str26_route(spark, sf):
    r = t(spark, sf, "conversations").select("conv_id", "turn", intent.route(F.col("text")).alias("r"))
    return r.select("conv_id", "turn", "r.strategy", "r.vector_weight", "r.bm25_weight", "r.graph_weight", "r.top_k")


_PARTS = f"list_filter(list_transform(regexp_split_to_array(text, {_S(intent.CONNECTORS)}), lambda p: trim(p, {_WS})), lambda p: length(p) > 10)"


@query(f"SELECT conv_id, turn, array_to_string(CASE WHEN len({_PARTS}) > 1 THEN {_PARTS} ELSE [text] END, '|') AS parts FROM conversations")
def str27_sub_queries(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(intent.sub_queries(F.col("text")), "|").alias("parts"))


_CMP, _SEQ = f"{_count(_LOW, intent.PLAN_COMPARATIVE, '')} > 0", f"{_count(_LOW, intent.PLAN_SEQUENTIAL, '')} > 0"
_TWO = f"{_count('text', intent.COMPARED)} > 0"
_STEPS = f"least(5, len(list_filter(list_transform(regexp_split_to_array(text, {_S(intent.STEPS_SPLIT)}), lambda p: trim(p, {_WS})), lambda p: p <> ''))) + 1"


_FT = _case([(f"regexp_matches({_LOW}, {_S(p)})", f"'{k}'") for k, p in intent.FOLLOW_UP_TYPES.items()], "'clarification'")


def sessions(spark, sf):
    return t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query("SELECT session_id, turn, role FROM (SELECT conv_id::VARCHAR AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10")
def win8_history(spark, sf):
    return records.history(sessions(spark, sf)).select("session_id", "turn", "role")


@query(
    """SELECT session_id, string_agg(line, chr(10) ORDER BY turn) AS summary FROM (
    SELECT conv_id::VARCHAR AS session_id, turn, CASE WHEN role = 'user' THEN 'Usuario' ELSE 'Asistente' END || ': ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY session_id"""
)
def win8_summary(spark, sf):
    return records.conversation_summary(sessions(spark, sf))


# -- lexical retrieval

_INDEX = f"""t AS (SELECT doc_id AS chunk_id, {_tokens('text')} AS k FROM documents),
    p AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(k) AS len, unnest(k) AS term FROM t) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term), corpus AS (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM t),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus), idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
    q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM p JOIN q USING (term) JOIN idf USING (term), corpus GROUP BY ALL),
    bm AS (SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10)"""


def _bm25(spark, sf, k=10):
    return retrieval.bm25(items_as_queries(spark, sf), retrieval.lexical_index(docs_as_chunks(spark, sf)), k, digits=6)


@query(f"WITH {_INDEX} SELECT term, df, (SELECT sum(tf) FROM p WHERE p.term = df.term)::BIGINT AS tf FROM df")
def agg1_lexical_index(spark, sf):
    i = retrieval.lexical_index(docs_as_chunks(spark, sf))
    return i["postings"].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {_INDEX} SELECT * FROM bm")
def ret2_bm25(spark, sf):
    return _bm25(spark, sf).select("query_id", "chunk_id", "score", "rank")


@query("SELECT DISTINCT source AS doc_id FROM documents WHERE regexp_matches(text, '\\blicense\\b', 'i')")
def flt7_documents_with_term(spark, sf):
    return retrieval.documents_with_term(t(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("text").alias("content")), "license")


_WANTED = ["license", "token", "version", "reserved"]


@query(
    f"""WITH s AS (SELECT doc_id AS chunk_id, len(list_filter([{', '.join(map(_S, _WANTED))}], lambda w: regexp_matches(text, '\\b' || w || '\\b', 'i'))) / 4 AS score FROM documents)
    SELECT 1 AS query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
)
def flt6_exact_terms(spark, sf):
    q = spark.createDataFrame([(1, _WANTED)], "query_id int, terms array<string>")
    return retrieval.exact_terms(q, docs_as_chunks(spark, sf)).select("query_id", "chunk_id", "score", "rank")


# -- vector retrieval; queries are the rows whose id is divisible by 100

_COS = """q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
    c AS (SELECT query_id, vec_id AS chunk_id, round(list_inner_product(list_transform(a, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))
          / (sqrt(list_inner_product(list_transform(a, lambda x: x::DOUBLE), list_transform(a, lambda x: x::DOUBLE))) * sqrt(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)))), 8) AS score FROM q, embeddings),
    v AS (SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM c WHERE score >= 0.2) WHERE rank <= 10)"""


def _vector_hits(spark, sf, k=10):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.vector_search(q, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), k, 0.2, digits=8)


@query(f"WITH {_COS} SELECT * FROM v")
def ret1_vector_search(spark, sf):
    return _vector_hits(spark, sf)


_MERGE = """h AS (SELECT v.*, label::VARCHAR AS parent_id, count(*) OVER (PARTITION BY query_id, label) AS hit FROM v JOIN embeddings ON vec_id = chunk_id)"""


@query(f"WITH {_COS}, {_MERGE} SELECT query_id, CASE WHEN hit >= 3 THEN parent_id ELSE chunk_id::VARCHAR END AS chunk_id, max(score) AS score, (CASE WHEN hit >= 3 THEN count(*) ELSE 0 END)::INT AS n_merged FROM h GROUP BY query_id, CASE WHEN hit >= 3 THEN parent_id ELSE chunk_id::VARCHAR END, hit")
def agg8_merge_siblings(spark, sf):
    hits = _vector_hits(spark, sf).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    chunks = t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("parent_id"))
    return retrieval.merge_siblings(hits.drop("rank"), chunks).select("query_id", "chunk_id", "score", F.size("merged_from").alias("n_merged"))


@query(f"WITH {_COS}, d AS (SELECT query_id, label, vec_id % 3 AS part, 1 + vec_id % 7 AS tokens FROM v JOIN embeddings ON vec_id = chunk_id) SELECT query_id, count(DISTINCT label) AS documents, count(DISTINCT (label, part)) AS sections, sum(tokens)::BIGINT AS tokens FROM d WHERE label IS NOT NULL GROUP BY query_id")
def agg10_coverage(spark, sf):
    e = t(spark, sf, "embeddings").where("label is not null").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), (F.col("vec_id") % 3).alias("header_path"), (1 + F.col("vec_id") % 7).alias("token_count"))
    return retrieval.coverage(_vector_hits(spark, sf).join(e, "chunk_id"))


# -- fusion

_LABELS = """l AS (SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT q.query_id, e.vec_id AS chunk_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY e.vec_id) AS rank
    FROM q JOIN embeddings s ON s.vec_id = q.query_id JOIN embeddings e ON e.label = s.label) WHERE rank <= 10)"""


def _label_hits(spark, sf):
    e = t(spark, sf, "embeddings")
    s = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # all rows of a label score alike, so a query's first ten are its label's
    first = retrieval.top_k(e.select(F.col("vec_id").alias("chunk_id"), "label", F.lit(1.0).alias("score")).where("label is not null"), 10, by="label").drop("rank")
    return retrieval.top_k(first.join(s, "label").select("query_id", "chunk_id", "score"), 10)


@query(
    f"""WITH {_COS}, {_LABELS}, u AS (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS s, 'vector' AS source FROM v UNION ALL SELECT query_id, chunk_id, 0.3 / (60 + rank), 'bm25' FROM l),
    f AS (SELECT query_id, chunk_id, sum(s) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY ALL)
    SELECT query_id, chunk_id, round(score, 9) AS score, sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM f) WHERE rank <= 10"""
)
def ret4_fusion(spark, sf):
    hits = _vector_hits(spark, sf).withColumn("source", F.lit("vector")).unionByName(_label_hits(spark, sf).withColumn("source", F.lit("bm25")))
    f = retrieval.fuse(hits, k=None).drop("rank").withColumn("score", F.round("score", 12))
    return retrieval.top_k(f, 10).select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


@query(
    f"""WITH {_COS}, {_LABELS}, u AS (SELECT *, 1 AS variant FROM v UNION ALL SELECT *, 2 FROM l)
    SELECT query_id, chunk_id, round(sum(1 / (60 + rank)) * (1 + 0.1 * (count(DISTINCT variant) - 1)), 9) AS score FROM u GROUP BY ALL"""
)
def agg5_multi_query(spark, sf):
    hits = _vector_hits(spark, sf).withColumn("variant", F.lit(1)).unionByName(_label_hits(spark, sf).withColumn("variant", F.lit(2)))
    return retrieval.fuse_variants(hits, 1000).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_COS}, e AS (SELECT *, (chunk_id % 7)::DOUBLE AS ce FROM v), x AS (SELECT *, min(ce) OVER w AS lo, max(ce) OVER w AS hi, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, chunk_id, round(CASE WHEN n = 1 THEN score ELSE 0.7 * CASE WHEN hi = lo THEN 0.5 ELSE (ce - lo) / (hi - lo) END + (1 - 0.7) * score END, 9) AS score FROM x"""
)
def ret9_rerank(spark, sf):
    hits = _vector_hits(spark, sf).drop("rank").withColumn("ce", (F.col("chunk_id") % 7).cast("double"))
    return retrieval.rerank(hits, "balanced", 100).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query(f"WITH {_COS}, u AS (SELECT *, 1 AS w FROM v UNION ALL SELECT *, 2 FROM l), {_LABELS} SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY w, score DESC) AS n FROM u) WHERE n = 1".replace(f", u AS (SELECT *, 1 AS w FROM v UNION ALL SELECT *, 2 FROM l), {_LABELS}", f", {_LABELS}, u AS (SELECT *, 1 AS w FROM v UNION ALL SELECT *, 2 FROM l)"))
def set1_union_first(spark, sf):
    return retrieval.union_first(_vector_hits(spark, sf).drop("rank"), _label_hits(spark, sf).drop("rank")).select("query_id", "chunk_id", "score")


@query(
    f"""WITH {_COS}, b AS (SELECT v.*, sum(chunk_id % 500 + 100) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM v) SELECT query_id, chunk_id, rank, so_far::BIGINT AS tokens_so_far FROM b WHERE so_far <= 1000"""
)
def win4_token_budget(spark, sf):
    h = _vector_hits(spark, sf).withColumn("token_count", F.col("chunk_id") % 500 + 100)
    return retrieval.token_budget(h, 1000).select("query_id", "chunk_id", "rank", "tokens_so_far")


@query(
    f"""WITH {_COS}, c AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings)
    SELECT v.query_id, v.chunk_id, count(*) AS n_parts, string_agg(b.vec_id::VARCHAR, chr(10) || chr(10) ORDER BY b.place) AS context FROM v JOIN c ON c.vec_id = v.chunk_id JOIN c b ON b.label = c.label AND b.place BETWEEN c.place - 2 AND c.place + 2 GROUP BY ALL""".replace(", c AS (SELECT vec_id, label", ", cc AS (SELECT vec_id, label").replace("JOIN c ON c.vec_id", "JOIN cc c ON c.vec_id").replace("JOIN c b ON", "JOIN cc b ON")
)
def ret13_expand_context(spark, sf):
    c = t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("vec_id").alias("seq"), F.col("vec_id").cast("string").alias("content"))
    return retrieval.expand_context(_vector_hits(spark, sf).drop("rank"), c, 2).select("query_id", "chunk_id", "n_parts", "context")


# -- correction, verification, negatives: benchmark items against the documents that the lexical leg finds

_TERMSET = "list_distinct(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]{{3,}}'))"
_OV = f"""WITH {_INDEX}, o AS (SELECT query_id, chunk_id, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END AS overlap FROM (
    SELECT bm.query_id, bm.chunk_id, {_TERMSET.format(_plain('i.text'))} AS a, {_TERMSET.format(_plain('d.text'))} AS b FROM bm JOIN benchmark i ON i.item_id = query_id JOIN documents d ON d.doc_id = chunk_id))"""


def _assessed(spark, sf):
    hits = _bm25(spark, sf).join(items_as_queries(spark, sf), "query_id").join(docs_as_chunks(spark, sf), "chunk_id")
    return retrieval.assess(hits)


@query(f"{_OV} SELECT query_id, chunk_id, round(overlap, 9) AS overlap, CASE WHEN overlap >= 0.7 THEN 'correct' WHEN overlap <= 0.3 THEN 'incorrect' ELSE 'ambiguous' END AS verdict FROM o")
def str24_relevance(spark, sf):
    return _assessed(spark, sf).select("query_id", "chunk_id", F.round("overlap", 9).alias("overlap"), "verdict")


@query(
    f"""{_OV}, n AS (SELECT query_id, count(*) AS n, count(*) FILTER (overlap >= 0.7) AS correct, count(*) FILTER (overlap > 0.3 AND overlap < 0.7) AS ambiguous, count(*) FILTER (overlap <= 0.3) AS incorrect FROM o GROUP BY query_id)
    SELECT *, CASE WHEN incorrect / n <= 0.2 THEN 'pass' WHEN incorrect / n >= 0.5 THEN 'reformulate' ELSE 'filter' END AS action FROM n"""
)
def ret12_corrective_action(spark, sf):
    return retrieval.corrective_action(_assessed(spark, sf))


_WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query(
    f"""WITH {_INDEX}, o AS (SELECT bm.query_id AS claim_id, len(list_intersect({_WORDSET.format('i.text')}, {_WORDSET.format('d.text')})) / len({_WORDSET.format('i.text')}) AS overlap
    FROM bm JOIN benchmark i ON i.item_id = query_id JOIN documents d ON d.doc_id = chunk_id),
    n AS (SELECT claim_id, count(*) FILTER (overlap > 0.5) AS supporting, count(*) FILTER (overlap > 0.2 AND overlap <= 0.5) AS related, count(*) AS n FROM o GROUP BY ALL)
    SELECT claim_id, supporting, related, CASE WHEN supporting >= 2 THEN 'supported' WHEN supporting = 1 OR related > 0 THEN 'partial' ELSE 'not_found' END AS status,
    CASE WHEN supporting >= 2 THEN least(supporting / n, 0.8) WHEN supporting = 1 THEN 0.5 WHEN related > 0 THEN 0.3 ELSE 0 END::DOUBLE AS confidence FROM n"""
)
def ret19_verify(spark, sf):
    claims = items_as_queries(spark, sf).select(F.col("query_id").alias("claim_id"), F.col("query").alias("claim"))
    hits = _bm25(spark, sf).join(docs_as_chunks(spark, sf), "chunk_id").select(F.col("query_id").alias("claim_id"), "chunk_id", "content")
    return retrieval.verify_claims(claims, hits)


@query(
    f"""WITH {_INDEX}, p4 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s WHERE score > 0),
    o AS (SELECT query_id, chunk_id AS negative_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p4 WHERE r <= 4 AND chunk_id <> query_id)
    SELECT query_id, negative_id, rank::INT AS rank, score FROM o WHERE rank <= 3"""
)
def top6_hard_negatives(spark, sf):
    pairs = items_as_queries(spark, sf).withColumn("chunk_id", F.col("query_id"))
    return retrieval.hard_negatives(pairs, retrieval.lexical_index(docs_as_chunks(spark, sf)), 3, digits=6)


# -- answers and citations: every document text stands for an answer, with citations of numbers made from its id

_ANS = "text || ' [' || (doc_id % 4 + 1)::VARCHAR || '] x [' || (doc_id % 3 + 1)::VARCHAR || ',' || (doc_id % 7 + 1)::VARCHAR || ']'"


def _answers(spark, sf):
    d = t(spark, sf, "documents")
    n = lambda k: (F.col("doc_id") % k + 1).cast("string")
    return d.select("doc_id", "text", F.concat("text", F.lit(" ["), n(4), F.lit("] x ["), n(3), F.lit(","), n(7), F.lit("]")).alias("answer"))


@query(
    f"""WITH a AS (SELECT doc_id, list_transform(string_split(array_to_string(regexp_extract_all({_ANS}, '\\[(\\d+(?:,\\d+)*)\\]', 1), ','), ','), lambda x: x::INT) AS c FROM documents)
    SELECT doc_id, len(list_filter(c, lambda i: i > 5)) = 0 AS valid, array_to_string(list_filter(c, lambda i: i > 5), ',') AS invalid, array_to_string(list_sort(list_distinct(list_filter(c, lambda i: i <= 5))), ',') AS used,
    len(list_distinct(list_filter(c, lambda i: i <= 5))) / 5 AS coverage FROM a"""
)
def str18_citation_report(spark, sf):
    r = _answers(spark, sf).select("doc_id", answers.citation_report(F.col("answer"), F.lit(5)).alias("r"))
    said = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return r.select("doc_id", "r.valid", said("r.invalid").alias("invalid"), said("r.used").alias("used"), "r.coverage")


@query(f"SELECT doc_id, len(regexp_extract_all({_ANS}, '([^.!?\\[\\]]+)\\s*\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]'))::INT AS n_claims FROM documents")
def str21_claims(spark, sf):
    return _answers(spark, sf).select("doc_id", F.size(answers.claims(F.col("answer"))).alias("n_claims"))


_KEY = "list_filter(list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda w: NOT list_contains([" + ", ".join(map(_S, answers.SUPPORT_STOPWORDS)) + "], w))"


@query(
    f"""WITH p AS (SELECT item_id, lower(d.text) AS s, {_KEY.format('i.text')} AS k FROM benchmark i JOIN documents d ON d.doc_id = i.item_id),
    r AS (SELECT item_id, CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda w: contains(s, w))) / len(k) ELSE 0 END AS ratio FROM p)
    SELECT item_id, ratio >= 0.5 AS is_supported, round(least(ratio * 1.2, 1.0), 9) AS support_score FROM r"""
)
def str22_claim_support(spark, sf):
    p = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("claim")).join(t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    r = p.select("item_id", answers.claim_support(F.col("claim"), F.col("text")).alias("r"))
    return r.select("item_id", "r.is_supported", F.round("r.support_score", 9).alias("support_score"))


_LONG = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{5,}}')"


@query(
    f"""WITH p AS (SELECT item_id, {_LONG.format('i.text')} AS a, list_distinct({_LONG.format('d.text')}) AS s FROM benchmark i JOIN documents d ON d.doc_id = i.item_id)
    SELECT item_id, round(CASE WHEN len(a) = 0 THEN 0.5 ELSE len(list_filter(a, lambda w: list_contains(s, w))) / len(a) END, 9) AS grounding FROM p"""
)
def str23_grounding(spark, sf):
    p = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("claim")).join(t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return p.select("item_id", F.round(answers.grounding(F.col("claim"), F.array("text")), 9).alias("grounding"))


@query("SELECT doc_id, source || ', §' || doc_id::VARCHAR || ', (' || lang || ')' AS apa, source || ' — ' || lang || ' — §' || doc_id::VARCHAR AS inline FROM documents")
def str20_cite(spark, sf):
    n = F.col("doc_id").cast("string")
    return t(spark, sf, "documents").select("doc_id", answers.cite("apa", F.col("source"), F.col("lang"), n).alias("apa"), answers.cite("inline", F.col("source"), F.col("lang"), n).alias("inline"))


@query()
def str13_compress(spark, sf):
    c = answers.compressor("aggressive", 0.5)
    return t(spark, sf, "documents").select("doc_id", F.length("text").alias("before"), F.length(c("text")).alias("after"))


# -- Markdown: documents under a heading made of source and language

_MD = "'# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || text"


def _markdown(spark, sf):
    nl = F.lit("\n\n")
    return t(spark, sf, "documents").select("doc_id", F.col("source").alias("doc_title"), F.concat(F.lit("# "), F.col("source"), nl, F.lit("## "), F.col("lang"), nl, F.col("text")).alias("text"))


@query("SELECT doc_id, 'books' AS found, lower(source || '_' || doc_id::VARCHAR) AS id FROM documents")
def scn3_doc_id(spark, sf):
    path = F.concat(F.lit("/library/books/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    d = t(spark, sf, "documents").select("doc_id", path.alias("p"))
    return d.select("doc_id", F.when(markdown.category(F.col("p")).startswith("src"), F.lit("books")).alias("found"), markdown.doc_id(F.col("p")).alias("id"))


@query()
def prj5_chunks(spark, sf):
    return chunking.chunks(markdown.sections(_markdown(spark, sf))).select("chunk_id", "doc_id", "level", "parent_id", "token_count", "content_hash")


@query()
def prj11_semantic_blocks(spark, sf):
    return chunking.block_counts(chunking.blocks(markdown.sections(_markdown(spark, sf))))


# -- graph: suppliers and customers hang on nations, nations on regions

_EDGES = """e AS (SELECT 'n:' || n_name AS src, 'r:' || r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 's:' || s_suppkey, 'n:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'c:' || c_custkey, 'n:' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


def _edges(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(tag("n:", "n_name").alias("src"), tag("r:", "r_name").alias("dst"))
    e = e.unionByName(t(spark, sf, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey).select(tag("s:", "s_suppkey").alias("src"), tag("n:", "n_name").alias("dst")))
    e = e.unionByName(t(spark, sf, "customer").join(n, F.col("c_nationkey") == n.n_nationkey).select(tag("c:", "c_custkey").alias("src"), tag("n:", "n_name").alias("dst")))
    return e.withColumn("relation", F.lit("PART_OF"))


@query(f"WITH {_EDGES}, one AS (SELECT DISTINCT a.src AS start, a.dst AS node FROM b a WHERE a.src LIKE 'r:%'), two AS (SELECT DISTINCT one.start, b.dst AS node FROM one JOIN b ON b.src = one.node WHERE b.dst <> one.start) SELECT start, node, 1 AS distance FROM one UNION ALL SELECT start, node, 2 FROM two")
def gra3_neighbours(spark, sf):
    starts = t(spark, sf, "region").select(F.concat(F.lit("r:"), F.col("r_name")).alias("start"))
    return graph.neighbours(starts, _edges(spark, sf), 2).select("start", "node", "distance")


@query(f"WITH {_EDGES}, x AS (SELECT DISTINCT src FROM e WHERE src LIKE 's:%') SELECT x.src, m2.dst, x.src || '>' || m1.dst || '>' || m2.dst AS path FROM x JOIN e m1 ON m1.src = x.src JOIN e m2 ON m2.src = m1.dst")
def gra4_shortest_paths(spark, sf):
    e = _edges(spark, sf)
    suppliers = e.where("src LIKE 's:%'").select("src").distinct()
    regions = t(spark, sf, "region").select(F.concat(F.lit("r:"), F.col("r_name")).alias("dst"))
    p = graph.shortest_paths(suppliers.join(F.broadcast(regions)), e, 2)  # the regions are five rows
    return p.select("src", "dst", F.array_join("path", ">").alias("path"))


@query(f"WITH {_EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM e)::DOUBLE / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)) AS density")
def agg19_graph_statistics(spark, sf):
    e = _edges(spark, sf)
    return graph.statistics(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e)


@query(f"WITH {_EDGES}, up AS (SELECT src, dst FROM e), a AS (SELECT src AS start, dst AS entity, 1 AS distance FROM up WHERE src LIKE 's:%'), z AS (SELECT a.start, up.dst AS entity, 2 AS distance FROM a JOIN up ON up.src = a.entity) SELECT * FROM a UNION ALL SELECT * FROM z")
def gra8_lineage(spark, sf):
    e = _edges(spark, sf)
    starts = e.where("src LIKE 's:%'").select(F.col("src").alias("start")).distinct()
    return graph.lineage(e.select(F.col("src").alias("entity"), F.col("dst").alias("source")), starts).select("start", "entity", "distance")


# -- ledger: events stand for usage records


def _ledger(spark, sf):
    e = t(spark, sf, "events")
    models = ["gpt-4o", "gpt-4.1-mini", "mistral", "text-embedding-3-large"]
    model = F.element_at(F.array(*[F.lit(m) for m in models]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select("ts", F.col("event_type").alias("usage_type"), model.alias("model"), (F.col("event_id") % 1000).alias("tokens_input"), (F.col("user_id") % 100).alias("tokens_output"))
    rows = records.with_cost(rows).withColumn("provider", records.provider_of(F.col("model"), "generation")).withColumn("operation", F.lit("generation"))
    return rows.withColumn("total_cost", F.round("total_cost", 9))


_LEDGER = """l AS (SELECT ts, event_type AS usage_type, ['gpt-4o', 'gpt-4.1-mini', 'mistral', 'text-embedding-3-large'][event_id % 4 + 1] AS model, event_id % 1000 AS tokens_input, user_id % 100 AS tokens_output FROM events),
    c AS (SELECT *, CASE WHEN contains(model, 'gpt') THEN 'openai' ELSE 'ollama' END AS provider, round(tokens_input / 1000 * CASE model WHEN 'gpt-4o' THEN 0.0025 WHEN 'gpt-4.1-mini' THEN 0.0004 WHEN 'mistral' THEN 0 ELSE 0.00013 END::DOUBLE
    + tokens_output / 1000 * CASE model WHEN 'gpt-4o' THEN 0.01 WHEN 'gpt-4.1-mini' THEN 0.0016 ELSE 0 END::DOUBLE, 9) AS total_cost FROM l)"""


@query(f"WITH {_LEDGER}, g AS (SELECT 'usage_type' AS dimension, usage_type AS value, * EXCLUDE usage_type FROM c UNION ALL BY NAME SELECT 'provider' AS dimension, provider AS value, * FROM c UNION ALL BY NAME SELECT 'model' AS dimension, model AS value, * FROM c UNION ALL BY NAME SELECT 'operation' AS dimension, 'generation' AS value, * FROM c UNION ALL BY NAME SELECT 'total' AS dimension, NULL AS value, * FROM c) SELECT dimension, value, count(*) AS calls, sum(tokens_input)::BIGINT AS tokens_input, sum(tokens_output)::BIGINT AS tokens_output, round(sum(total_cost), 4) AS total_cost FROM g GROUP BY dimension, value")
def agg14_usage_summary(spark, sf):
    return records.usage_summary(_ledger(spark, sf)).withColumn("total_cost", F.round("total_cost", 4))


@query(f"WITH {_LEDGER} SELECT date_trunc('day', ts)::TIMESTAMP AS day, usage_type, count(*) AS calls, round(sum(total_cost), 4) AS total_cost FROM c GROUP BY ALL")
def stm4_usage_by_day(spark, sf):
    """The streaming job's aggregate, on a table instead of a stream."""
    l = jobs.usage_by_day(_ledger(spark, sf))
    return l.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "usage_type", "calls", F.round("total_cost", 4).alias("total_cost"))


# -- evaluation: label values stand for judged metrics


@query("SELECT metric, avg(value) AS mean, min(value) AS min, max(value) AS max, count(value) AS n FROM (SELECT 'quality' AS metric, quality::DOUBLE AS value FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) GROUP BY metric")
def agg15_metric_summary(spark, sf):
    return records.metric_summary(t(spark, sf, "labels"), ["quality", "toxic"])


@query("WITH m AS (SELECT lang, avg(quality) AS q, avg(toxic) AS x FROM labels JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') GROUP BY lang) SELECT 'quality' AS metric, a.q AS baseline, b.q AS current, b.q - a.q AS delta FROM m a, m b WHERE a.lang = 'en' AND b.lang = 'de' UNION ALL SELECT 'toxic', a.x, b.x, b.x - a.x FROM m a, m b WHERE a.lang = 'en' AND b.lang = 'de'")
def joi16_compare_runs(spark, sf):
    l = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    run = lambda k: records.metric_summary(l.where(F.col("lang") == k), ["quality", "toxic"])
    return records.compare_runs(run("en"), run("de"))


# -- training pairs


@query("SELECT min(conv_id * 1000 + turn) AS pair_id, substr(sha256(lower(trim(text))), 1, 12) AS query_hash FROM conversations WHERE role = 'user' GROUP BY 2")
def set8_distinct_pairs(spark, sf):
    p = t(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("query"))
    return records.distinct_pairs(p).select("pair_id", "query_hash")


@query("SELECT CASE WHEN split = 1 THEN 'validation' ELSE 'train' END AS split, n FROM (SELECT 1 AS split, greatest(1, floor(count(*) * 0.2))::BIGINT AS n FROM documents UNION ALL SELECT 0, (count(*) - greatest(1, floor(count(*) * 0.2)))::BIGINT FROM documents)")
def udf20_train_validation(spark, sf):
    d = records.train_validation(t(spark, sf, "documents").select("doc_id"), F.col("doc_id"))
    return d.groupBy("split").agg(F.count("*").alias("n"))


# -- more retrieval: term vectors, propositions, routing, caches


def _term_vectors(spark, sf):
    i = retrieval.lexical_index(docs_as_chunks(spark, sf))["postings"].select("chunk_id", "term", (F.col("tf") / F.col("length")).alias("weight"))
    q = items_as_queries(spark, sf).select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term")).withColumn("weight", F.lit(1.0))
    return q, i


@query(
    f"""WITH {_INDEX}, c AS (SELECT query_id, chunk_id, sum(tf / len) AS score FROM p JOIN (SELECT DISTINCT query_id, term FROM q) USING (term) GROUP BY ALL)
    SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM c) WHERE rank <= 10"""
)
def ret7_sparse_search(spark, sf):
    q, i = _term_vectors(spark, sf)
    return retrieval.sparse_search(q, i, 10, digits=6).select("query_id", "chunk_id", "score")


@query(f"WITH {_INDEX} SELECT query_id, term, count(*) AS n_chunks, round(sum(tf / len), 6) AS contribution FROM p JOIN (SELECT DISTINCT query_id, term FROM q) USING (term) GROUP BY ALL")
def joi9_explain_match(spark, sf):
    q, i = _term_vectors(spark, sf)
    return retrieval.explain_sparse(q, i).groupBy("query_id", "term").agg(F.count("*").alias("n_chunks"), F.round(F.sum("contribution"), 6).alias("contribution"))


@query(f"WITH {_COS} SELECT query_id, label::VARCHAR AS chunk_id, max(score) AS score, count(*) AS n_propositions, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id::VARCHAR) AS ids FROM v JOIN embeddings ON vec_id = chunk_id GROUP BY query_id, label")
def agg6_propositions(spark, sf):
    e = t(spark, sf, "embeddings")
    hits = _vector_hits(spark, sf).join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("parent_chunk_id")), "chunk_id")
    hits = hits.select("query_id", F.col("chunk_id").cast("string").alias("proposition_id"), "parent_chunk_id", F.lit("").alias("content"), "score")
    parents = e.select(F.col("label").cast("string").alias("chunk_id")).distinct().withColumn("content", F.lit("p"))
    return retrieval.propositions_to_parents(hits, parents).select("query_id", "chunk_id", "score", "n_propositions", F.array_join("proposition_ids", ",").alias("ids"))


@query(
    f"""WITH {_COS}, kids AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), h AS (SELECT v.*, label, n, count(*) OVER (PARTITION BY query_id, label) AS hit FROM v JOIN embeddings ON vec_id = chunk_id JOIN kids USING (label)),
    g AS (SELECT query_id, CASE WHEN hit / n >= 0.02 THEN 'L' || label::VARCHAR ELSE chunk_id::VARCHAR END AS chunk_id, min(rank) AS r, max(score) AS score FROM h GROUP BY ALL)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r)::INT AS rank FROM (SELECT query_id, chunk_id, min(r) AS r, max(score) AS score FROM g GROUP BY ALL)"""
)
def agg7_merge_by_share(spark, sf):
    hits = _vector_hits(spark, sf).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    chunks = t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("parent_id"))
    return retrieval.merge_by_share(hits, chunks, share=0.02)


@query(
    f"""WITH {_COS}, d AS (SELECT v.query_id, v.score, 'd' || (label // 5)::VARCHAR AS doc_id, 's' || label::VARCHAR AS section FROM v JOIN embeddings ON vec_id = chunk_id)
    SELECT query_id, doc_id, section, max(score) AS score, count(*) AS n_chunks, 0::TINYINT AS is_document FROM d GROUP BY query_id, doc_id, section UNION ALL SELECT query_id, doc_id, NULL, max(score), count(*), 1 FROM d GROUP BY query_id, doc_id"""
)
def agg9_explore_tree(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("d"), F.floor(F.col("label") / 5).cast("string")).alias("doc_id"), F.concat(F.lit("s"), F.col("label").cast("string"), F.lit(" > x")).alias("header_path"))
    return retrieval.explore_tree(_vector_hits(spark, sf).join(e, "chunk_id"))


def _labels(spark, sf):
    """Mean vectors of the labels, as summaries: each label is a section, five of them a document."""
    e = t(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("x"))
    return e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))


@query()
def ret14_route_hierarchy(spark, sf):
    s = _labels(spark, sf).select(F.floor(F.col("label") / 5).alias("doc_id"), F.col("label").alias("section_id"), "embedding")
    d = s.groupBy("doc_id").agg(F.min_by("embedding", "section_id").alias("embedding"))
    q = t(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.route_hierarchy(q, d, s, doc_least=0.2, section_least=0.1)


@query(f"WITH {_COS}, {_LABELS} SELECT v.query_id, v.chunk_id, CASE WHEN l.chunk_id IS NULL THEN v.score ELSE v.score * 1.1 END AS score, l.chunk_id IS NOT NULL AS candidate FROM v LEFT JOIN l ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id")
def joi6_boost_candidates(spark, sf):
    return retrieval.boost_candidates(_vector_hits(spark, sf), _label_hits(spark, sf)).select("query_id", "chunk_id", "score", F.coalesce("candidate", F.lit(False)).alias("candidate"))


@query("SELECT cache_key, embedding_is_hit FROM (SELECT substr(sha256('m:' || text), 1, 32) AS cache_key, bool_or(item_id % 2 = 0) AS embedding_is_hit FROM benchmark GROUP BY 1)")
def cache1_embedding_lookup(spark, sf):
    r = t(spark, sf, "benchmark").select("item_id", records.embedding_key(F.lit("m"), F.col("text")).alias("cache_key"))
    known = r.where("item_id % 2 = 0").select("cache_key", F.array(F.lit(1.0)).alias("embedding")).distinct()
    hits, misses = records.cache_lookup(r, known)
    return hits.select("cache_key", F.lit(True).alias("embedding_is_hit")).distinct().unionByName(misses.select("cache_key", F.lit(False).alias("embedding_is_hit")))


@query(
    """WITH c AS (SELECT vec_id, embedding, sqrt(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) AS n FROM embeddings),
    s AS (SELECT q.vec_id AS question_id, c.vec_id AS cache_id, list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(c.embedding, lambda x: x::DOUBLE)) / (q.n * c.n) AS sim FROM c q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id % 100 <> 0)
    SELECT question_id, arg_max(cache_id, sim)::VARCHAR AS cache_id, round(max(sim), 8) AS similarity FROM s WHERE sim >= 0.3 GROUP BY question_id"""
)
def cache2_answer_lookup(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("query_vector"))
    cache = e.where("vec_id % 100 != 0").select(F.col("vec_id").cast("string").alias("cache_id"), F.lit("").alias("response"), F.col("embedding").alias("query_embedding"))
    return records.answer_lookup(q, cache, 0.3).select("question_id", "cache_id", F.round("similarity", 8).alias("similarity"))


@query("SELECT event_id::VARCHAR AS cache_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-15' AND user_id % 10 < 5)")
def cache3_evict(spark, sf):
    c = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("cache_id"), F.col("ts").alias("created_at"), F.col("ts").alias("last_accessed"), (F.col("user_id") % 10).alias("access_count"))
    return records.evict(c, most=10_000_000, days=0, now=F.expr("TIMESTAMP '2024-01-15 00:00:00'")).select("cache_id")


@query(
    """WITH s AS (SELECT conv_id, turn, 'k' || (turn % 4)::VARCHAR AS source, 0 AS pos FROM conversations UNION ALL SELECT conv_id, turn, 'm' || (conv_id % 3 + turn % 5)::VARCHAR, 1 FROM conversations),
    f AS (SELECT conv_id, source, min(turn * 10 + pos) AS first FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first DESC) AS n FROM f)
    SELECT conv_id::VARCHAR AS session_id, string_agg(source, ',' ORDER BY first) AS sources FROM r WHERE n <= 5 GROUP BY conv_id"""
)
def win10_source_history(spark, sf):
    c = t(spark, sf, "conversations")
    said = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    m = c.select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.array(said("k", F.col("turn") % 4), said("m", F.col("conv_id") % 3 + F.col("turn") % 5)).alias("sources"))
    return records.source_history(m).select("session_id", F.array_join("sources", ",").alias("sources"))


_MENTION = "(SELECT conv_id * 1000 + turn AS chunk_id, ['Shor', 'Grover', 'CNOT', 'Hadamard'][turn % 4 + 1] AS a, ['qubit', 'BB84', 'entanglement'][conv_id % 3 + 1] AS b FROM conversations)"


def _mentioned(spark, sf):
    c = t(spark, sf, "conversations")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    said = F.concat_ws(" ; ", pick(["Shor", "Grover", "CNOT", "Hadamard"], F.col("turn") % 4), pick(["qubit", "BB84", "entanglement"], F.col("conv_id") % 3))
    return graph.mentions(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), said.alias("content")))


@query(f"SELECT node, count(*) AS mentions FROM (SELECT lower(a) AS node FROM {_MENTION} UNION ALL SELECT lower(b) FROM {_MENTION}) GROUP BY node")
def agg18_graph_nodes(spark, sf):
    return graph.build(_mentioned(spark, sf))["nodes"].select("node", "mentions")


_ORDER = "CASE x WHEN 'Shor' THEN 1 WHEN 'Grover' THEN 1 WHEN 'BB84' THEN 2 WHEN 'qubit' THEN 3 WHEN 'entanglement' THEN 4 ELSE 5 END"


@query(
    f"""WITH m AS (SELECT chunk_id, a AS x, 0 AS pos FROM {_MENTION} UNION ALL SELECT chunk_id, b, 1 FROM {_MENTION}), o AS (SELECT *, {_ORDER} * 10 + pos AS ord FROM m)
    SELECT lower(l.x) AS src, lower(r.x) AS dst, count(*)::DOUBLE AS weight, min(l.chunk_id) AS chunk_id FROM o l JOIN o r ON l.chunk_id = r.chunk_id AND (CASE WHEN l.x IN ('Shor', 'Grover', 'BB84') THEN 1 ELSE l.ord END, l.pos) < (CASE WHEN r.x IN ('Shor', 'Grover', 'BB84') THEN 1 ELSE r.ord END, r.pos) GROUP BY ALL"""
)
def agg18_graph_edges(spark, sf):
    return graph.build(_mentioned(spark, sf))["edges"].select("src", "dst", "weight", "chunk_id")


@query("SELECT page_id, len(regexp_extract_all(html, '!\\[([^\\]]*)\\]\\(([^)]+)\\)'))::INT AS n_images FROM pages")
def scn13_images(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.size(markdown.images(F.col("html"))).alias("n_images"))


@query(
    f"""WITH s AS (SELECT item_id, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM (SELECT item_id, {_sentences('text')} AS s FROM benchmark)),
    w AS (SELECT *, list_filter(list_distinct(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda x: x <> '')), lambda x: NOT list_contains([{', '.join(map(_S, answers.OVERLAP_STOPWORDS))}], x)) AS w FROM s),
    o AS (SELECT a.item_id, a.i, max(len(list_intersect(a.w, list_distinct(regexp_split_to_array(lower(b.text), '\\s+'))))) AS best FROM w a JOIN benchmark b ON b.item_id IN (a.item_id, a.item_id + 1) GROUP BY ALL)
    SELECT item_id, count(*) FILTER (best >= 3) AS n_cited FROM o GROUP BY item_id"""
)
def str17_inject_citations(spark, sf):
    b = t(spark, sf, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    x = b.join(nxt, "item_id", "left").withColumn("sources", F.array_compact(F.array("text", "next")))
    return x.select("item_id", F.size(F.regexp_extract_all(answers.inject_citations(F.col("text"), F.col("sources")), F.lit(r"\[\d+\]"), F.lit(0))).cast("long").alias("n_cited"))


@query(f"SELECT doc_id, array_to_string(list_slice(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: trim(s, {_WS})), lambda s: length(s) > 30 AND NOT regexp_matches(s, '\\[\\d+\\]') AND NOT regexp_matches(lower(s), '^({'|'.join(answers.CONNECTIVES)})')), lambda s: substr(s, 1, 100)), 1, 5), '|') AS uncited FROM documents")
def str21_uncited_claims(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(answers.uncited_claims(F.col("text")), "|").alias("uncited"))


@query("SELECT to_json({'prompt': u.text, 'completion': a.text}) AS value FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'".replace("SELECT to_json({'prompt': u.text, 'completion': a.text}) AS value", "SELECT md5(u.text || '|' || a.text) AS pair"))
def snk4_training_lines(spark, sf):
    c = t(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    p = records.as_jsonl(u.join(c.select("conv_id", "turn", F.col("text").alias("positive_passage")), ["conv_id", "turn"]))
    back = F.from_json("value", "prompt string, completion string")
    return p.select(F.md5(F.concat_ws("|", back["prompt"], back["completion"]).cast("binary")).alias("pair"))


# -- tables


@query("SELECT source AS doc_id, count(*) AS n_chunks, 1::BIGINT AS n_documents FROM documents GROUP BY source UNION ALL SELECT NULL, count(*), count(DISTINCT source) FROM documents")
def agg11_corpus_statistics(spark, sf):
    return records.corpus_statistics(t(spark, sf, "documents").select(F.col("source").alias("doc_id")))


@query("SELECT doc_id, 'new' AS lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def snk1_upsert(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang")
    return records.upsert(d, d.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), "doc_id")


@query("SELECT doc_id AS file_path, sha256(text) AS content_hash, doc_id % 5 = 0 AS is_new FROM documents WHERE doc_id % 5 IN (0, 1)")
def flt8_changed_files(spark, sf):
    f = t(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    old = f.where("file_path % 5 > 0").withColumn("content_hash", F.when(F.col("file_path") % 5 == 1, F.lit("old")).otherwise(F.col("content_hash")))
    return records.changed_files(f, old)


@query("SELECT doc_id, source, lang FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1'")
def flt2_metadata_filters(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "lang", F.col("lang").alias("difficulty_level"))
    return retrieval.where_metadata(d, {"source": "src1"}, "en, fr").select("doc_id", "source", "lang")
