"""Further registered queries, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.functions import answers, intent, science, text
from lorewright.operators import formulas, graph, records, retrieval
from lorewright.plans import agents, library
from lorewright.queries import _COS, _INDEX, _LABELS, _S, _WS, Query, _bm25, _label_hits, _sentences, _vector_hits, docs_as_chunks, items_as_queries, sessions, t
from lorewright.sources import markdown

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


# -- sources


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id::VARCHAR ELSE source END AS title FROM documents")
def scn4_title(spark, sf):
    n = F.col("doc_id").cast("string")
    d = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n# T"), n, F.lit("\nx"))).otherwise(F.lit("none")).alias("md"), F.concat(F.lit("/a/"), "source", F.lit(".md")).alias("p"))
    return d.select("doc_id", markdown.title(F.col("md"), F.col("p")).alias("title"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE 'general' END AS category FROM documents")
def scn5_category(spark, sf):
    p = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/l/books/"), "source", F.lit("/x.md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("papers/"), "lang", F.lit("/y/z.md"))).otherwise(F.lit("/l/books/z.md"))
    return t(spark, sf, "documents").select("doc_id", markdown.category(p).alias("category"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props)::INT AS n FROM events")
def jsn1_json_fields(spark, sf):
    """An event's properties as the only item of a list that stands in a sentence."""
    item = text.json_items(F.concat(F.lit("Props: ["), "props", F.lit("], no more")), "array<struct<k:string>>")
    return t(spark, sf, "events").select("event_id", F.get(item, 0)["k"].alias("k"), F.length("props").alias("n"))


@query("SELECT doc_id, count(*) AS n_blocks, sum(length(b)) AS size FROM (SELECT doc_id, unnest(regexp_extract_all('a ```' || source || '``` b $$' || lang || '$$', '```[^`]*```|\\$\\$[^$]*\\$\\$')) AS b FROM documents) GROUP BY doc_id")
def prj2_atomic_blocks(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("a ```"), "source", F.lit("``` b $$"), "lang", F.lit("$$")).alias("m"))
    return d.select("doc_id", F.explode(markdown.atomic_blocks(F.col("m"))).alias("b")).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.col("b.end") - F.col("b.start")).alias("size"))


@query("SELECT doc_id, substr(text, 1, 24573) = text AS whole FROM documents")
def prj17_truncate(spark, sf):
    return t(spark, sf, "documents").select("doc_id", (text.truncate_tokens(F.col("text")) == F.col("text")).alias("whole"))


@query("SELECT doc_id, source || ' — ' || lang || ' > ' || source || ' — §' || doc_id::VARCHAR AS citation FROM documents")
def prj16_rich_citation(spark, sf):
    h = F.array("lang", "source", F.lit("deep"))
    return t(spark, sf, "documents").select("doc_id", answers.rich_citation(F.col("source"), h, F.lit("x"), F.col("doc_id").cast("string")).alias("citation"))


@query(
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(substr(text, 1, 500), '[.!?]\\s+'), lambda s: trim(s, {_WS})), lambda s: length(s) > 20 AND NOT regexp_matches(s, '^[#\\-*]')) AS s FROM documents)
    SELECT doc_id, CASE WHEN len(s) = 0 THEN '' WHEN length(s[1]) > 100 THEN substr(s[1], 1, 100) || '...' ELSE s[1] END AS topic FROM s"""
)
def str8_section_topic(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.lit("1.2 A > B").alias("header_path"), F.lit("t").alias("doc_title"))
    return library.enrich(d).select("doc_id", F.col("topic_summary").alias("topic"))


@query("SELECT doc_id, 'Este fragmento pertenece al documento ''' || source || ''', sección ''' || lang || '''.' || chr(10) || chr(10) || text AS embedding_text FROM documents")
def str9_context_prefix(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("header_path"), F.col("source").alias("doc_title"))
    return library.enrich(d, context=True).select("doc_id", "embedding_text")


# -- filters


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def flt1_level_filter(spark, sf):
    return retrieval.where_metadata(t(spark, sf, "documents"), {"lang": "fr"}).select("doc_id", "lang")


@query(f"WITH {_COS} SELECT query_id, chunk_id, score FROM v WHERE score >= 0.6")
def flt4_threshold(spark, sf):
    return retrieval.above(_vector_hits(spark, sf), 0.6).select("query_id", "chunk_id", "score")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (7, 70, 199)")
def flt5_point_lookup(spark, sf):
    return records.by_id(t(spark, sf, "documents"), "doc_id", [7, 70, 199]).select("doc_id", "lang", "source")


@query("SELECT 's' || s_suppkey AS src, lower(n_name) AS dst, round(sum(s_acctbal / 10000), 6) AS weight, 'located_in' AS relation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 1) AND s_acctbal / 10000 >= 0.3 GROUP BY ALL")
def flt9_ontology_types(spark, sf):
    """Triples of suppliers and nations: of a known relation, between known types and sure enough."""
    n = t(spark, sf, "nation")
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    region = F.concat(F.lit("Region"), F.col("n_regionkey").cast("string"))
    triples = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source"), F.lit("SUPPLIER").alias("source_type"), F.lit("located_in").alias("relation"), F.col("n_name").alias("target"), region.alias("target_type"), (F.col("s_acctbal") / 10000).alias("confidence"), F.col("s_suppkey").alias("chunk_id"))
    return graph.triples_to_edges(triples, ["LOCATED_IN"], ["Supplier", "region0", "REGION1"], 0.3).select("src", "dst", F.round("weight", 6).alias("weight"), "relation")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def flt12_usage_between(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.col("event_type").alias("usage_type"), F.col("ts").alias("timestamp"))
    return records.usage_between(e, "click", "2024-01-05", "2024-01-20").select("event_id")


@query("SELECT page_id, regexp_matches(html, '__|(^|[^\\p{L}\\p{N}_])((import|exec|eval|open|lambda)($|[^\\p{L}\\p{N}_])|(os|sys)\\.)') AS unsafe FROM pages")
def flt16_unsafe_expressions(spark, sf):
    return t(spark, sf, "pages").select("page_id", science.unsafe_expression(F.col("html")).alias("unsafe"))


# -- joins


@query(f"WITH {_COS} SELECT query_id, chunk_id, label AS parent FROM v LEFT JOIN embeddings ON vec_id = chunk_id")
def joi1_parent_of_hit(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("parent_id"))
    return retrieval.with_parents(_vector_hits(spark, sf), e).select("query_id", "chunk_id", F.col("parent_id").alias("parent"))


@query(
    f"""WITH {_INDEX}, x AS (SELECT bm.query_id, rank, chunk_id, regexp_extract_all('[' || (query_id % 3 + 1)::VARCHAR || ']', '\\[(\\d+)\\]', 1) AS c FROM bm)
    SELECT query_id, chunk_id, rank FROM x WHERE rank = c[1]::INT"""
)
def joi12_citations_by_position(spark, sf):
    said = items_as_queries(spark, sf).select("query_id", F.concat(F.lit("x ["), (F.col("query_id") % 3 + 1).cast("string"), F.lit("]")).alias("answer"))
    return retrieval.cited_hits(said, _bm25(spark, sf)).select("query_id", "chunk_id", "rank")


@query(f"WITH {_COS}, {_LABELS} SELECT query_id, chunk_id FROM v WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.query_id = v.query_id AND l.chunk_id = v.chunk_id)")
def joi7_not_candidates(spark, sf):
    return retrieval.without(_vector_hits(spark, sf), _label_hits(spark, sf)).select("query_id", "chunk_id")


# -- aggregations and order


@query("SELECT source AS category, count(*) AS n_chunks FROM documents GROUP BY source")
def agg12_categories(spark, sf):
    return records.categories(t(spark, sf, "documents"), "source")


@query(f"WITH {_COS}, {_LABELS}, u AS (SELECT *, 0.7 AS w FROM v UNION ALL SELECT *, 0.3 FROM l) SELECT query_id, chunk_id, round(avg(score * w::DOUBLE), 9) AS score FROM u GROUP BY ALL")
def agg4_hypothetical_mean(spark, sf):
    h = _vector_hits(spark, sf).withColumn("weight", F.lit(0.7)).unionByName(_label_hits(spark, sf).withColumn("weight", F.lit(0.3)))
    return retrieval.weighted_mean(h, 1000).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("SELECT count(*) AS entries, sum(user_id % 10)::BIGINT AS accesses FROM events")
def agg26_cache_statistics(spark, sf):
    return records.cache_statistics(t(spark, sf, "events").select((F.col("user_id") % 10).alias("access_count")))


@query(
    """WITH p AS (SELECT a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    d AS (SELECT list_transform(x, lambda v: v::DOUBLE) AS x, list_transform(y, lambda v: v::DOUBLE) AS y FROM p)
    SELECT count(*) AS n, round(avg(list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)))), 9) AS mean_cosine FROM d"""
)
def agg27_paired_cosine(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return records.mean_similarity(p).select("n", F.round("mean_cosine", 9).alias("mean_cosine"))


@query(
    f"""WITH {_INDEX} SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS chunks, max(score) AS best FROM bm GROUP BY query_id"""
)
def win1_ranked_lists(spark, sf):
    b = _bm25(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"), F.max("score").alias("best"))
    return b.select("query_id", F.array_join(F.transform("c", lambda x: x["chunk_id"].cast("string")), ",").alias("chunks"), "best")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def win6_first_of_content(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return retrieval.first_of(d, ["content_hash"], "doc_id").select("doc_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 1000")
def win11_recent_entries(spark, sf):
    c = t(spark, sf, "events").select("event_id", F.col("event_id").alias("cache_id"), F.col("ts").alias("created_at"), F.col("ts").alias("last_accessed"), F.lit(9).alias("access_count"))
    e = records.evict(c.withColumn("created_at", F.col("ts") if "ts" in c.columns else F.col("created_at")), most=1000, days=0, now=F.expr("TIMESTAMP '1970-01-01'"))
    return e.select("event_id")


@query(f"WITH {_COS}, d AS (SELECT query_id, label, max(score) AS score FROM v JOIN embeddings ON vec_id = chunk_id GROUP BY ALL) SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS n FROM d) WHERE n <= 3")
def top3_best_groups(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return retrieval.best_groups(_vector_hits(spark, sf), e, "label").select("query_id", "label")


# -- sets


@query("SELECT query, conv_id FROM (SELECT lower(trim(text)) AS query, conv_id, row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n = 1")
def set7_distinct_variants(spark, sf):
    c = t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.lower(F.trim("text")).alias("query"))
    return retrieval.first_of(c, ["conv_id", "query"], "turn").select("query", "conv_id")


@query(f"WITH {_INDEX} SELECT query_id, list_sort(list(chunk_id))::VARCHAR AS both FROM bm WHERE chunk_id IN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') GROUP BY query_id")
def set5_intersection(spark, sf):
    b = retrieval.within(_bm25(spark, sf), t(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id")))
    return b.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("c")).select("query_id", F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: x.cast("string")), ", "), F.lit("]")).alias("both"))


# -- functions


@query(f"SELECT item_id, 'Responde con precisión y brevedad.' || chr(10) || 'Cita las fuentes con [n].' || chr(10) || chr(10) || 'Contexto:' || chr(10) || chr(10) || '[1] ' || text || chr(10) || chr(10) || '[2] x' || chr(10) || chr(10) || 'Pregunta: ' || text AS prompt FROM benchmark")
def str33_prompt(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", agents.prompt(F.col("text"), F.array("text", F.lit("x")), F.lit("factual")).alias("prompt"))


@query("SELECT doc_id, lang AS code FROM documents")
def str37_code_fences(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("x\n```python\n"), "lang", F.lit("```\ny")).alias("m"))
    return d.select("doc_id", markdown.code_fences(F.col("m"))[0].alias("code"))


@query(f"WITH s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents) SELECT doc_id, len(s)::INT AS n, s[1] AS first FROM s")
def str13_sentences(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", answers.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.get("s", 0).alias("first"))


@query("SELECT item_id, round(len(list_filter(k, lambda w: contains(lower(d), w))) / len(k), 9) AS completeness FROM (SELECT i.item_id, d.text AS d, list_distinct(regexp_extract_all(lower(i.text), '[\\p{L}\\p{N}_]{4,}')) AS k FROM benchmark i JOIN documents d ON d.doc_id = i.item_id)")
def str23_completeness(spark, sf):
    p = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("q")).join(t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return p.select("item_id", F.round(answers.completeness(F.col("text"), F.col("q")), 9).alias("completeness"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS n FROM documents")
def str7_difficulty_number(spark, sf):
    level = F.element_at(F.create_map(*[F.lit(x) for kv in zip(("en", "de", "fr", "es"), intent.LEVELS, strict=True) for x in kv]), F.col("lang"))
    return t(spark, sf, "documents").select("doc_id", intent.difficulty_number(level).alias("n"))


@query("SELECT vec_id, round(sqrt(list_inner_product(x, x)), 6) AS norm, round(list_inner_product(x, x) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(x, x))), 9) AS self FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)")
def num1_cosine(spark, sf):
    e = t(spark, sf, "embeddings")
    dot = F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return e.select("vec_id", F.round(F.sqrt(dot), 6).alias("norm"), F.round(text.cosine(F.col("embedding"), F.col("embedding")), 9).alias("self"))


@query("SELECT event_id, round(user_id / 1000 * 0.003::DOUBLE + (event_id % 100) / 1000 * 0.015::DOUBLE, 9) AS cost FROM events")
def num2_cost(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.lit("m").alias("model"), F.col("user_id").alias("tokens_input"), (F.col("event_id") % 100).alias("tokens_output"))
    return records.with_cost(e, {"m": (0.003, 0.015)}).select("event_id", F.round("total_cost", 9).alias("cost"))


@query("SELECT event_type, CASE WHEN contains(event_type, 'gpt') THEN 'openai' ELSE 'ollama' END AS a, CASE WHEN contains(event_type, 'gpt') THEN 'openai' ELSE 'anthropic' END AS b FROM (SELECT DISTINCT event_type || CASE WHEN event_id % 2 = 0 THEN '-gpt' ELSE '' END AS event_type FROM events)")
def res14_providers(spark, sf):
    e = t(spark, sf, "events").select(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "-gpt").otherwise("")).alias("event_type")).distinct()
    return e.select("event_type", records.provider_of(F.col("event_type"), "generation").alias("a"), records.provider_of(F.col("event_type"), "routing").alias("b"))


# -- graph and formulas


@query()
def gra2_graph_search(spark, sf):
    from lorewright.queries import _mentioned

    g = graph.build(_mentioned(spark, sf))
    q = spark.createDataFrame([(1, "Shor y qubit"), (2, "BB84"), (3, "nothing")], "query_id int, query string")
    return graph.search(q, g["nodes"], g["edges"])


@query("SELECT 'n:' || n_name AS node, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def gra5_node_members(spark, sf):
    n = t(spark, sf, "nation")
    e = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey).select(F.col("s_suppkey").cast("string").alias("src"), F.concat(F.lit("n:"), "n_name").alias("dst"))
    return graph.members(e).select("node", "n")


@query("SELECT 'c' || c_custkey AS src, 'r' || n_regionkey AS dst, 3 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def gra6_derivations(spark, sf):
    n = t(spark, sf, "nation")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = t(spark, sf, "customer").join(n, F.col("c_nationkey") == n.n_nationkey)
    e = c.select(tag("c", "c_custkey").alias("src"), tag("n", "n_nationkey").alias("dst"), F.lit("derives_from").alias("relation"))
    e = e.unionByName(n.select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst"), F.lit("equivalent").alias("relation")))
    pairs = c.select(tag("c", "c_custkey").alias("src"), tag("r", "n_regionkey").alias("dst"))
    return formulas.derivations(pairs, e, 2).select("src", "dst", F.size("path").alias("n"))


@query("SELECT 'region ' || r_name AS node, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def gra11_provenance(spark, sf):
    """Suppliers come from nations by an activity, nations derive from regions; each region's number of derived suppliers."""
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey)
    acts = s.select(F.array(tag("nation ", "n_name")).alias("used"), F.array(tag("supplier ", "s_suppkey")).alias("generated"))
    derived = n.join(r, n.n_regionkey == r.r_regionkey).select(tag("nation ", "n_name").alias("entity"), tag("region ", "r_name").alias("source"))
    o = formulas.origins(acts, derived, s.select(tag("supplier ", "s_suppkey").alias("start")), 3)
    return o.where("is_origin").groupBy(F.col("entity").alias("node")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 1::BIGINT AS n, length(source)::INT + 1 AS size FROM documents")
def ret15_formulas(spark, sf):
    c = t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("text $$"), "source", F.lit("+$$ and $a$")).alias("content"))
    return formulas.extract(c).groupBy(F.col("chunk_id").alias("doc_id")).agg(F.count("*").alias("n"), F.max(F.length("latex")).alias("size"))


# -- answers as loops


def _answered(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("source"))
    b = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return b.join(d, "query_id").select("query_id", "query", F.concat("query", F.lit(" [1]")).alias("answer"), F.array("source").alias("sources"))


@query()
def ret23_self_critique(spark, sf):
    return agents.self_critique(_answered(spark, sf)).select("query_id", "support", "usefulness", "acceptable")


@query()
def agg21_criticism(spark, sf):
    return agents.criticise(_answered(spark, sf)).select("query_id", "coverage", "grounded", F.round("score", 9).alias("score"))


@query()
def agg22_grounding_tiers(spark, sf):
    return agents.ensure_grounded(_answered(spark, sf))


@query()
def ret22_agentic(spark, sf):
    index = retrieval.lexical_index(docs_as_chunks(spark, sf))
    return agents.agentic(items_as_queries(spark, sf), lambda q: retrieval.bm25(q, index, 5, digits=6))
