"""Readers and writers of the operational files: sessions, usage, suites of questions, ontologies, contexts and results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION = "session_id string, created_at string, updated_at string, messages array<struct<role:string,content:string,timestamp:string>>"
USAGE = "timestamp string, usage_type string, provider string, model string, operation string, tokens_input long, tokens_output long, cost_per_1k_input double, cost_per_1k_output double, total_cost double, query string"
CASE = "query:string,ground_truth:string,category:string,difficulty:string,tags:array<string>,expected_sources:array<string>"
# Types where an ontology gives none.
ENTITY_TYPES = ["Algoritmo", "Protocolo", "Concepto", "Gate", "Autor", "Teorema", "Ecuación", "Hardware", "Documento"]
RELATION_TYPES = ["MEJORA", "DEPENDE_DE", "USA", "DEFINE", "IMPLEMENTA", "DEMUESTRA", "PROPONE", "ES_CASO_DE", "EQUIVALE_A", "CO_OCCURS"]


def read_sessions(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Session files (one JSON object each), newest first; `newest` of them."""
    s = spark.read.schema(SESSION).option("multiLine", True).json(path).where("session_id is not null").orderBy(F.desc("updated_at"), "session_id")
    return s.limit(newest) if newest is not None else s


def messages_of(sessions: DataFrame) -> DataFrame:
    """(session_id, turn, role, content), as the session operators take them."""
    return sessions.select("session_id", F.posexplode("messages").alias("turn", "m")).select("session_id", "turn", "m.role", "m.content")


def write_sessions(messages: DataFrame, path: str) -> None:
    """(session_id, turn, role, content) as one line of JSON for each session."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    s = messages.groupBy("session_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    s.write.mode("overwrite").json(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE).option("header", True).csv(path)


def write_usage(ledger: DataFrame, path: str) -> None:
    """Appends rows; queries are cut to 100 characters."""
    cols = [c.split()[0] for c in USAGE.split(", ")]
    ledger.withColumn("query", F.substring("query", 1, 100)).select(cols).write.mode("append").option("header", True).csv(path)


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """A suite's cases, one row each, with the suite's name; missing fields take their defaults."""
    s = spark.read.schema(f"name string, description string, created_at string, test_cases array<struct<{CASE}>>").option("multiLine", True).json(path)
    c = s.select(F.col("name").alias("suite"), F.posexplode("test_cases").alias("case_id", "c")).select("suite", "case_id", "c.*")
    none = F.array().cast("array<string>")
    return c.withColumns({"category": F.coalesce("category", F.lit("general")), "difficulty": F.coalesce("difficulty", F.lit("medium")), "tags": F.coalesce("tags", none), "expected_sources": F.coalesce("expected_sources", none)})


def nested_keys(text: str) -> dict[str, list[str]]:
    """Keys under `entities` and `relations` of a YAML mapping, those inside other blocks included."""
    out, stack = {"entities": [], "relations": []}, []
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith(("#", "-")) or ":" not in bare:
            continue
        depth, key = len(bare) - len(bare.lstrip()), bare.strip().split(":")[0].strip("'\"")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack and len(stack) <= 2 and stack[-1][1] in out:
            out[stack[-1][1]].append(key)
        stack.append((depth, key))
    return out


def read_ontology(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Entity and relation types of an ontology file; the fixed ones where it lists none. A file of types is small by nature."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    found = nested_keys(text)
    return {"entities": found["entities"] or list(ENTITY_TYPES), "relations": found["relations"] or list(RELATION_TYPES)}


def as_json(results: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias(out))


def write_contexts(expanded: DataFrame, path: str) -> None:
    """(query_id, chunk_id, score, context, n_parts): one object for each query with its contexts in the order of score."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "n_parts", "context")))
    c = F.transform(listed, lambda x: F.struct(x["chunk_id"].alias("chunk_id"), (-x["s"]).alias("score"), x["n_parts"].alias("n_parts"), x["context"].alias("content")))
    expanded.groupBy("query_id").agg(F.count("*").alias("n_contexts"), c.alias("contexts")).write.mode("overwrite").json(path)


def query_requests(chunks: DataFrame, per_chunk: int = 3, batch: int = 5) -> DataFrame:
    """(chunk_id, doc_title, header_path, content) -> prompts that ask for search queries of `batch` chunks each, with the chunks' ids in order."""
    text = lambda x, i: F.concat(F.lit("\n--- Chunk "), i.cast("string"), F.lit(" ---\nDocumento: "), x["doc_title"], F.lit("\nSección: "), x["header_path"], F.lit("\nContenido: "), F.substring(x["content"], 1, 600), F.lit("\n"))
    g = chunks.withColumn("batch", F.pmod(F.xxhash64("doc_title"), F.lit(1 << 20)) if "doc_id" not in chunks.columns else F.col("doc_id"))
    n = F.row_number().over(Window.partitionBy("batch").orderBy("chunk_id")) - 1
    g = g.withColumn("part", F.floor(n / batch)).groupBy("batch", "part").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "doc_title", "header_path", "content"))).alias("c"))
    ask = F.concat(F.lit("Chunks:"), F.array_join(F.transform("c", text), ""), F.lit(f"\n\nPara CADA chunk, genera {per_chunk} preguntas que serían respondidas por ese chunk. Responde con JSON: "), F.lit(json.dumps({"chunks": [{"index": 0, "queries": [{"query": "...", "type": "factual", "difficulty": "easy"}]}]})))
    return g.select(F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"), ask.alias("prompt"))


def parse_queries(answered: DataFrame, least: int = 10, per_chunk: int = 3) -> DataFrame:
    """(chunk_ids, completion) -> (chunk_id, query, query_type, difficulty): the queries of each JSON answer; what is no JSON, too short or of no chunk gives none."""
    def queries(raw: str | None) -> list[tuple[int, str, str, str]]:
        try:
            data = json.loads(raw or "")
        except json.JSONDecodeError:
            return []
        if isinstance(data, dict):
            data = data["chunks"] if isinstance(data.get("chunks"), list) else next((v for v in data.values() if isinstance(v, list)), [])
        out: list[tuple[int, str, str, str]] = []
        for item in data if isinstance(data, list) else []:
            if not isinstance(item, dict):
                continue
            at = item.get("index", len(out) // per_chunk)
            for q in item.get("queries") or []:
                q = {"query": q} if isinstance(q, str) else q
                if isinstance(q, dict) and len(q.get("query") or "") >= least:
                    out.append((at, q["query"], q.get("type", "general"), q.get("difficulty", "medium")))
        return out

    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("at", "query", "query_type", "difficulty"), x, strict=True)) for x in queries(r)] for r in raw], dtype=object)

    parsed = F.pandas_udf(run, "array<struct<at:int,query:string,query_type:string,difficulty:string>>")(F.col("completion"))
    q = answered.select("chunk_ids", F.explode(parsed).alias("q"))
    return q.select(F.get("chunk_ids", F.col("q.at")).alias("chunk_id"), "q.query", "q.query_type", "q.difficulty").where("chunk_id is not null")
