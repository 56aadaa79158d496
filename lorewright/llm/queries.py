"""One query per operator, on its whole intended table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, infill, language_id, licenses, minmax_dedup, mixing, negatives, packing, secrets, substring_dedup, suffix_dedup, token_counts, topk
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_ids")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, a folder of 16 ids, the id."""
    docs = read(spark, sf_dir, "documents")
    folder = F.floor(F.col("doc_id") / 16).cast("string")
    path = F.concat_ws("/", "source", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.license_scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


def op10_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=3, similarity=85)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(read(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "embeddings")
    d = d.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(d, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    every = (op1_topk, op2_decontaminate, op3_token_counts, op4_language_id, op5_suffix_dedup, op6_substring_dedup, op7_mixing, op8_secrets, op9_licenses, op10_minmax_dedup, op11_infill, op12_packing, op13_negatives)
    return {f.__name__: f for f in every}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(k)}, {quoted(x)})" for i, (k, x) in enumerate(licenses.TEMPLATES))

    def weights(by: str, t: str) -> str:
        return f"(SELECT {by}, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY {by})) AS w FROM (SELECT {by}, term, count(*) AS tf FROM {t} GROUP BY ALL) JOIN idf USING (term))"

    return rf"""
        WITH f AS (SELECT doc_id, concat_ws('/', source, lang, floor(doc_id / 16)::BIGINT::VARCHAR, doc_id::VARCHAR || '.txt') AS path,
                          list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS every,
                          list_filter(list_transform(flatten(list_transform(list_transform(list_filter(regexp_split_to_array(regexp_replace(chr(10) || coalesce(text, ''), {quoted(licenses.COMMENT)}, chr(10), 'g'), '\n\n+'), lambda p: contains(trim(p, chr(10)), chr(10))), lambda p: replace(p, chr(10), ' ')), lambda p: string_split(regexp_replace(p, '([.!?])\s+', '' || chr(10), 'g'), chr(10)))), lambda s: trim(s)), lambda s: s <> '') AS joined FROM documents),
        g AS (SELECT doc_id, regexp_replace(path, '/?[^/]*$', '') AS dir, len(every) AS n, len(list_filter(every, lambda s: regexp_matches(lower(s), {quoted(licenses.MENTION)}))) AS n_own, list_concat(list_filter(every, lambda s: regexp_matches(lower(s), {quoted(licenses.MENTION)})), list_distinct(list_filter(joined, lambda s: regexp_matches(lower(s), {quoted(licenses.MENTION)}) AND NOT list_contains(every, s)))) AS said FROM f),
        m AS (SELECT doc_id, n_own, generate_subscripts(said, 1) AS nth, unnest(said) AS sentence FROM g),
        d AS (SELECT sentence, count(*) AS times FROM m GROUP BY sentence),
        tpl(template, license, sentence) AS (VALUES {templates}),
        st AS (SELECT sentence, times, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS term FROM d),
        tt AS (SELECT template, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS term FROM tpl),
        df AS (SELECT term, sum(times) AS df FROM (SELECT DISTINCT sentence, times, term FROM st) GROUP BY term),
        idf AS (SELECT term, ln((1 + (SELECT coalesce(sum(times), 0) FROM d)) / (1 + coalesce(df, 0))) + 1 AS idf FROM df FULL JOIN (SELECT DISTINCT term FROM tt) USING (term)),
        scored AS (SELECT a.sentence, tpl.license, round(sum(a.w * b.w), 6) AS score FROM {weights('sentence', 'st')} a JOIN {weights('template', 'tt')} b USING (term) JOIN tpl USING (template)
                   GROUP BY a.sentence, template, tpl.license HAVING round(sum(a.w * b.w), 6) >= {licenses.COSINE}),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY score DESC, license) = 1),
        own AS (SELECT doc_id, license, score, hits FROM (SELECT *, count(*) FILTER (nth <= n_own) OVER (PARTITION BY doc_id) AS hits FROM m JOIN best USING (sentence)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
        x AS (SELECT g.doc_id, dir, n, license, score, hits FROM g LEFT JOIN own USING (doc_id)),
        by_dir AS (SELECT dir AS above, license AS l, score AS s FROM x WHERE license IS NOT NULL AND 2 * hits >= n QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
        up AS (SELECT dir, unnest(list_prepend('', list_transform(generate_series(1, len(string_split(dir, '/'))), lambda i: array_to_string(string_split(dir, '/')[1:i], '/')))) AS above FROM (SELECT DISTINCT dir FROM x)),
        near AS (SELECT up.dir, above, l, s FROM up JOIN by_dir USING (above) QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY length(above) DESC) = 1)
        SELECT doc_id, coalesce(license, l) AS license, CASE WHEN license IS NOT NULL THEN score ELSE s END AS score,
               CASE WHEN license IS NOT NULL THEN 'own' WHEN l IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN license IS NULL THEN above END AS directory FROM x LEFT JOIN near USING (dir)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op9_licenses": _license_sql(),
        "op1_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
                  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
            SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20""",
        "op2_decontaminate": f"""
            WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
            b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
            bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
                     SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
            g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
                     SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
            h AS (SELECT g.doc_id, g.i, g.n, bw.item_id FROM g JOIN bw ON g.n = bw.n AND g.k = bw.k),
            hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY 1),
            hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
            SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
                   sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
        "op7_mixing": r"""
            WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                              ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|7'), 1, 15))::BIGINT AS h FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
            w AS (SELECT *, [5, 2, 1][i % 3 + 1] AS weight, [-0.8::DOUBLE, 0, 0.8][i % 3 + 1] AS slope FROM s),
            c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
                         (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weight_from,
                         (sum(source_size) OVER ())::BIGINT AS everything FROM w),
            l AS (SELECT *, (3 * everything - 4 * cap_before) / (2 * weight_from) AS level FROM c),
            t AS (SELECT source, source_size, slope, least((2 * source_size)::DOUBLE,
                         coalesce((SELECT level FROM l WHERE level <= 2 * source_size / weight ORDER BY source_size / weight, i LIMIT 1), 0.0) * weight) AS target FROM l),
            p AS (SELECT d.doc_id, d.size, t.source_size, t.slope, t.target, round(t.target)::BIGINT AS want,
                         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
                  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            k AS (SELECT *, greatest(0, least(size, want - pos)) AS one, greatest(0, least(size, want - source_size - pos)) AS two FROM p),
            x AS (SELECT *, (pos + one / 2) / greatest(want, 1) AS x1, (source_size + pos + two / 2) / greatest(want, 1) AS x2, 1 - slope / 2 AS b FROM k)
            SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
                   CASE WHEN one > 0 THEN CASE WHEN abs(slope) < 1e-9 THEN x1 ELSE (sqrt(b * b + 2 * slope * x1) - b) / slope END END AS first_position,
                   CASE WHEN two > 0 THEN CASE WHEN abs(slope) < 1e-9 THEN x2 ELSE (sqrt(b * b + 2 * slope * x2) - b) / slope END END AS second_position FROM x""",
        "op11_infill": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
            e AS (SELECT doc_id, t, length(t)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in [0, 1, 2, 3]] AS h FROM d),
            f AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
            g AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM f)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
                   sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
                   sha256(t) AS restored_sha256 FROM g""",
        "op13_negatives": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
                  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
            p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
            n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS n, s.vec_id AS negative_id, positive_score, s.score AS negative_score
                  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
            SELECT anchor_id, positive_id, n::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE n <= 5""",
    }
