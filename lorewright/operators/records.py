"""Operational tables: usage ledger, caches, sessions, evaluation results, training pairs, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.intent import expand_follow_up, follow_up
from lorewright.functions.text import cosine, short_hash
from lorewright.operators.retrieval import nearest_rows

# -- usage ledger

# Price of a thousand input and output tokens by model.
PRICES = {
    "text-embedding-3-large": (0.00013, 0.0),
    "text-embedding-3-small": (0.00002, 0.0),
    "gpt-4.1": (0.002, 0.008),
    "gpt-4.1-mini": (0.0004, 0.0016),
    "gpt-4.1-nano": (0.0001, 0.0004),
    "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006),
    "claude-sonnet-4-5-20250929": (0.003, 0.015),
    "claude-sonnet-4-5": (0.003, 0.015),
    "claude-sonnet-4-20250514": (0.003, 0.015),
    "claude-3-5-sonnet-20241022": (0.003, 0.015),
    "claude-3-5-haiku-20241022": (0.0008, 0.004),
    "claude-3-opus-20240229": (0.015, 0.075),
    "claude-opus-4-5-20251101": (0.0, 0.0),
    "claude-haiku-4-5-20251001": (0.0, 0.0),
    "llama3.2": (0.0, 0.0),
    "mistral": (0.0, 0.0),
    "qwen2.5": (0.0, 0.0),
}


def price(model: Column, side: int, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """Price of a thousand tokens (side 0: input, 1: output); 0 for unknown models."""
    table = F.create_map(*[F.lit(x) for k, v in (prices or PRICES).items() for x in (k, v[side])])
    return F.coalesce(F.element_at(table, model), F.lit(0.0))


def with_cost(ledger: DataFrame, prices=None) -> DataFrame:
    """(model, tokens_input, tokens_output) with both rates and the cost of each row."""
    rates = ledger.withColumn("cost_per_1k_input", price(F.col("model"), 0, prices)).withColumn("cost_per_1k_output", price(F.col("model"), 1, prices))
    return rates.withColumn("total_cost", F.col("tokens_input") / 1000 * F.col("cost_per_1k_input") + F.col("tokens_output") / 1000 * F.col("cost_per_1k_output"))


def provider_of(model: Column, operation: str) -> Column:
    """The provider that a record of this operation stands for; the three rules differ on purpose."""
    low = F.lower(model)
    if operation == "embedding":
        return F.when(F.contains(model, F.lit("embedding")), F.lit("openai")).otherwise(F.lit("unknown"))
    if operation == "routing":
        return F.when(F.contains(low, F.lit("gpt")), F.lit("openai")).otherwise(F.lit("anthropic"))
    return F.when(F.contains(low, F.lit("claude")), F.lit("anthropic")).when(F.contains(low, F.lit("gpt")), F.lit("openai")).otherwise(F.lit("ollama"))


def usage_between(ledger: DataFrame, usage_type: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of a type and period, both ends included."""
    if usage_type is not None:
        ledger = ledger.where(F.col("usage_type") == usage_type)
    if start is not None:
        ledger = ledger.where(F.col("timestamp") >= F.lit(start))
    return ledger.where(F.col("timestamp") <= F.lit(end)) if end is not None else ledger


USAGE_KEYS = ("usage_type", "provider", "model", "operation")


def usage_summary(ledger: DataFrame, keys: tuple[str, ...] = USAGE_KEYS) -> DataFrame:
    """Totals, and totals by each key: (dimension, value, calls, tokens_input, tokens_output, total_cost), in one pass over grouping sets."""
    g = ledger.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.count("*").alias("calls"), F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"), F.sum("total_cost").alias("total_cost"), *[F.grouping(k).alias(f"_{k}") for k in keys]
    )
    name = reduce(lambda out, k: F.when(F.col(f"_{k}") == 0, F.lit(k)).otherwise(out), keys, F.lit("total"))
    value = reduce(lambda out, k: F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(out), keys, F.lit(None).cast("string"))
    return g.select(name.alias("dimension"), value.alias("value"), "calls", "tokens_input", "tokens_output", "total_cost")


# -- caches


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Last write wins: rows of `new` replace those of `old` with their key; of several new ones the one with the largest `order` (any one where it is not given)."""
    if order is None:
        new = new.dropDuplicates([key])
    else:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))).where("_n = 1").drop("_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def embedding_key(model: Column, text: Column) -> Column:
    return short_hash(F.concat_ws(":", model, text), 32)


def cache_lookup(requests: DataFrame, cache: DataFrame, *, max_age: str | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(cache_key, ...) -> hits with their embeddings, and misses to be computed once per key."""
    fresh = cache.where(F.col("created_at") >= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {max_age}")) if max_age else cache
    last = F.max_by("embedding", "created_at") if "created_at" in cache.columns else F.max("embedding")
    known = fresh.groupBy("cache_key").agg(last.alias("embedding"))
    return requests.join(known, "cache_key"), requests.join(known.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def get_or_compute(requests: DataFrame, cache: DataFrame, compute, *, now: Column, max_age: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests with their embeddings, and the cache with what `compute` (misses -> misses with `embedding`) has added."""
    hits, misses = cache_lookup(requests, cache, max_age=max_age, now=now)
    made = compute(misses).select("cache_key", "embedding")
    both = hits.unionByName(requests.join(made, "cache_key"))
    added = made.withColumn("created_at", now)
    for c in cache.columns:
        if c not in added.columns:
            added = added.withColumn(c, F.lit(None).cast(cache.schema[c].dataType))
    return both, upsert(cache, added.select(cache.columns), "cache_key", "created_at")


def cache_statistics(cache: DataFrame, hits: int | None = None, misses: int | None = None) -> DataFrame:
    """Entries and accesses, and with the counts of hits and misses their rate (0 without any)."""
    rate = [] if hits is None else [F.lit(hits / (hits + misses) if hits + misses else 0.0).alias("hit_rate")]
    return cache.agg(*rate, F.count("*").alias("entries"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("accesses"))


def answer_lookup(questions: DataFrame, cache: DataFrame, least: float = 0.92) -> DataFrame:
    """(question_id, query, query_vector): the answer of the same query, else of the most similar one from the threshold on. Questions are a small, given set."""
    q = questions.withColumn("cache_id", short_hash(F.col("query")))
    exact = q.join(cache.select("cache_id", "response"), "cache_id").select("question_id", "cache_id", "response", F.lit(1.0).alias("similarity"))
    rest = q.join(exact.select("question_id"), "question_id", "left_anti").select("question_id", "query_vector")
    asked = rest.withColumnRenamed("question_id", "query_id")
    hits = nearest_rows(asked, cache.select(F.col("cache_id").alias("chunk_id"), F.col("query_embedding").alias("embedding")), 1, least, ties="descending").select("query_id", "chunk_id").distinct()
    # the answers of those few, whose ids may stand for several
    near = hits.join(rest, F.col("query_id") == F.col("question_id")).join(cache, F.col("chunk_id").eqNullSafe(F.col("cache_id")))
    near = near.select("question_id", "cache_id", "response", cosine(F.col("query_vector"), F.col("query_embedding")).alias("similarity")).where(F.col("similarity") >= least)
    return exact.unionByName(near.groupBy("question_id").agg(F.max_by(F.struct("cache_id", "response", "similarity"), F.struct("similarity", "cache_id")).alias("b")).select("question_id", "b.*"))


def touch(cache: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Counts accesses (cache_id, one row each) and stamps them."""
    n = used.groupBy("cache_id").agg(F.count("*").alias("_n"))
    hit = F.col("_n").isNotNull()
    out = cache.join(n, "cache_id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
    return out.withColumn("last_accessed", F.when(hit, now).otherwise(F.col("last_accessed"))).drop("_n")


def evict(cache: DataFrame, *, most: int = 1000, days: int = 30, least_used: int = 5, now: Column | None = None) -> DataFrame:
    """Drops entries that are old and seldom used, then the least recently used beyond `most`."""
    old = F.col("created_at") < (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {days} DAYS")
    kept = cache.where(~(old & (F.col("access_count") < least_used)))
    order = [F.desc_nulls_last("last_accessed"), F.desc("created_at"), F.asc("cache_id")]
    return kept.orderBy(*order).limit(most)


# -- sessions: (session_id, turn, role, content)


def history(messages: DataFrame, most: int = 10) -> DataFrame:
    """The last messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def conversation_summary(messages: DataFrame, last: int = 4, cut: int = 500) -> DataFrame:
    """One text per session: its last messages with their roles, long ones cut."""
    label = F.when(F.col("role") == "user", "Usuario").otherwise("Asistente")
    said = F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content"))
    line = history(messages, last).select("session_id", "turn", F.concat(label, F.lit(": "), said).alias("line"))
    return line.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def last_messages(messages: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """(session_id, last_<role>...): the last message of each role."""
    last = lambda r: F.max_by(F.when(F.col("role") == r, F.col("content")), F.when(F.col("role") == r, F.col("turn")))
    return messages.groupBy("session_id").agg(*[last(r).alias(f"last_{r}") for r in roles])


def follow_ups(messages: DataFrame) -> DataFrame:
    """Every user message with its kind of follow-up and the expanded query, from the last messages before it."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("content")), ignorenulls=True).over(w)
    m = messages.withColumn("_user", last("user")).withColumn("_assistant", last("assistant")).withColumn("_before", F.count("*").over(w) > 0).where(F.col("role") == "user")
    m = m.withColumn("follow_up", follow_up(F.col("content"), F.col("_before")))
    return m.select("session_id", "turn", "content", "follow_up", expand_follow_up(F.col("content"), F.col("follow_up"), F.col("_user"), F.col("_assistant")).alias("expanded"))


def source_history(messages: DataFrame, last: int = 5) -> DataFrame:
    """(session_id, turn, sources): the most recent distinct sources by first use, in that order."""
    seen = messages.select("session_id", "turn", F.posexplode("sources").alias("pos", "source")).groupBy("session_id", "source").agg(F.min(F.struct("turn", "pos")).alias("first"))
    w = Window.partitionBy("session_id").orderBy(F.desc("first"))
    recent = seen.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    return recent.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]).alias("sources"))


# -- evaluation

# Weight of each metric in the overall score.
METRICS = {"faithfulness": 2.0, "answer_relevancy": 1.5, "context_precision": 1.0, "context_recall": 1.0}


def overall_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the metrics that are there; 0 where none is."""
    weights = weights or METRICS
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in weights.items()])
    share = reduce(lambda a, b: a + b, [F.when(F.col(m).isNotNull(), w).otherwise(0.0) for m, w in weights.items()])
    return F.when(share == 0, F.lit(0.0)).otherwise(total / share)


def latency_summary(runs: DataFrame, by: str | None = None) -> DataFrame:
    """Mean, least and largest latency_ms, and their number, of the runs that have one (of each value of `by`)."""
    some = runs.where("latency_ms > 0")
    return (some.groupBy(by) if by else some.groupBy()).agg(F.avg("latency_ms").alias("mean"), F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"), F.count("*").alias("n"))


def metric_summary(results: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, min, max, n) without nulls."""
    long = results.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def compare_runs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Means of two runs by metric, and their difference."""
    a, b = baseline.select("metric", F.col("mean").alias("baseline")), current.select("metric", F.col("mean").alias("current"))
    return a.join(b, "metric").withColumn("delta", F.col("current") - F.col("baseline"))


def cases_with(cases: DataFrame, category: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Cases of a category that have all of the tags."""
    if category:
        cases = cases.where(F.col("category") == category)
    return cases.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0) if tags else cases


# -- training pairs


def query_hash(query: Column) -> Column:
    return short_hash(F.lower(F.trim(query)), 12)


def distinct_pairs(pairs: DataFrame, order: str = "pair_id") -> DataFrame:
    """The first pair of each query, whatever its case and outer blanks."""
    w = Window.partitionBy("query_hash").orderBy(order)
    return pairs.withColumn("query_hash", query_hash(F.col("query"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def as_jsonl(pairs: DataFrame, negatives: str | None = None) -> DataFrame:
    """Lines {prompt, completion}, or one {query, pos, neg} for each negative."""
    if negatives is None:
        return pairs.select(F.to_json(F.struct(F.col("query").alias("prompt"), F.col("positive_passage").alias("completion"))).alias("value"))
    return pairs.select("query", F.col("positive_passage").alias("pos"), F.explode(negatives).alias("neg")).select(F.to_json(F.struct("query", "pos", "neg")).alias("value"))


def validate_jsonl(lines: DataFrame) -> DataFrame:
    """One line about (value): total, valid and duplicate lines, and each format's count; blank lines only count in the total."""
    j = F.from_json("value", "prompt string, completion string, query string, pos string, neg string")
    l = lines.select("value", F.trim("value").alias("v"), j.alias("j"))
    pair, triplet = F.col("j.prompt").isNotNull() & F.col("j.completion").isNotNull(), F.col("j.query").isNotNull() & F.col("j.pos").isNotNull() & F.col("j.neg").isNotNull()
    l = l.select(F.when(F.col("v") == "", "blank").when(pair, "pair").when(triplet, "triplet").otherwise("invalid").alias("kind"), short_hash(F.col("v")).alias("h"))
    by = l.groupBy("kind", "h").agg(F.count("*").alias("n"))
    count = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"), count("pair", "triplet").alias("valid_lines"), F.coalesce(F.sum(F.when(F.col("kind").isin("pair", "triplet"), F.col("n") - 1)), F.lit(0)).alias("duplicates"), count("pair").alias("pairs"), count("triplet").alias("triplets"), count("invalid").alias("errors"))


def nth_smallest(values: DataFrame, column: str, n: int) -> tuple[int, int] | None:
    """The n-th smallest long of a column and how many are smaller, by counting sixteen bits at a time; null where there are fewer. No more than 65,536 counts come to the driver at a time."""
    at, before = 0, 0
    bits = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # longs in the order of unsigned numbers
    for shift in (48, 32, 16, 0):
        here = values if shift == 48 else values.where(F.shiftrightunsigned(bits, shift + 16) == at)
        counts = here.groupBy(F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF)).alias("b")).agg(F.count("*").alias("n")).collect()
        for b, k in sorted((r["b"], r["n"]) for r in counts):
            if before + k >= n:
                at = at << 16 | b
                break
            before += k
        else:
            return None
    return at - (1 << 63), before


def train_validation(lines: DataFrame, key: Column, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Marks max(1, floor(n * fraction)) lines as validation, those with the smallest hashes of the key."""
    h = lines.withColumn("_h", F.xxhash64(F.lit(seed), key))
    n = h.count()
    wanted = max(1, int(n * fraction))
    cut = nth_smallest(h.select("_h"), "_h", wanted)
    if cut is None:
        return h.withColumn("split", F.lit("train")).drop("_h")
    edge, before = cut
    # rows on the cut share a key: as many of them as are still wanted
    at = h.where(F.col("_h") == edge).withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy(F.xxhash64(*lines.columns))))
    at = at.withColumn("split", F.when(F.col("_n") <= wanted - before, "validation").otherwise("train")).drop("_n")
    rest = h.where(F.col("_h") != edge).withColumn("split", F.when(F.col("_h") < edge, "validation").otherwise("train"))
    return rest.unionByName(at).drop("_h")


# -- corpus statistics


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks of each document and, in the row without document, of all."""
    return chunks.groupingSets([["doc_id"], []], "doc_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (file_path, content_hash) that are new or changed since the manifest; unchanged ones are left out."""
    old = manifest.select("file_path", F.col("content_hash").alias("_old"))
    return files.join(old, "file_path", "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).withColumn("is_new", F.col("_old").isNull()).drop("_old")


def by_id(table: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows with any of a few given keys."""
    return table.where(F.col(key).isin(ids))


def categories(chunks: DataFrame, column: str = "category") -> DataFrame:
    """Distinct categories with their number of chunks."""
    return chunks.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n_chunks"))


def mean_similarity(pairs: DataFrame) -> DataFrame:
    """(a, b), two vectors -> one line: number of pairs and their mean cosine."""
    return pairs.agg(F.count("*").alias("n"), F.avg(cosine(F.col("a"), F.col("b"))).alias("mean_cosine"))


# -- sessions: (session_id, created_at, updated_at, topic, entities)


def session_id(seed: Column) -> Column:
    return short_hash(seed, 12)


def open_sessions(sessions: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Adds sessions (session_id); one that is there stays as it is."""
    fresh = new.select("session_id").distinct().join(sessions.select("session_id"), "session_id", "left_anti")
    return sessions.unionByName(fresh.select("session_id", now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("topic"), F.array().cast("array<string>").alias("entities")))


def close_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without those of the sessions named."""
    ids = gone.select("session_id").distinct()
    return sessions.join(ids, "session_id", "left_anti"), messages.join(ids, "session_id", "left_anti")


def note(sessions: DataFrame, topics: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Sets topics (session_id, topic) and adds entities (session_id, entity, seq) that are not there yet, in order of seq; unknown sessions are left out."""
    out = sessions
    if topics is not None:
        t = topics.groupBy("session_id").agg(F.max("topic").alias("_topic"))
        out = out.join(t, "session_id", "left").withColumn("topic", F.coalesce("_topic", "topic")).drop("_topic")
    if entities is not None:
        first = entities.where("entity is not null").groupBy("session_id", "entity").agg(F.min("seq").alias("seq"))
        e = first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entity"))), lambda x: x["entity"]).alias("_new"))
        out = out.join(e, "session_id", "left").withColumn("entities", F.array_distinct(F.concat(F.coalesce("entities", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>"))))).drop("_new")
    return out


def list_sessions(sessions: DataFrame, messages: DataFrame, most: int = 10) -> DataFrame:
    """The sessions that were changed last, with their number of messages."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    return sessions.join(n, "session_id", "left").select("session_id", "created_at", "updated_at", F.coalesce("message_count", F.lit(0)).alias("message_count"), "topic").orderBy(F.desc("updated_at"), "session_id").limit(most)
