"""Entity graph: extraction, building, neighbours, paths, lineage and statistics, on node and edge tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.operators import linking
from lorewright.operators.lineage import cut

#: Rows of a plan that are gathered.
PLAN_STEPS = 1000

# Patterns (any case) of each entity type, in order; group 1 is the name, or the whole match without one.
ENTITY_PATTERNS = {
    "Algoritmo": [r"algoritmo\s+de?\s*(\w+(?:\s+\w+)?)", "(Shor|Grover|Deutsch|Simon|BB84|E91|B92|QKD)", r"(\w+(?:-\w+)?)\s+algorithm"],
    "Protocolo": [r"protocolo\s+(\w+(?:\s+\w+)?)", "(BB84|E91|B92|SARG04|COW|DPS)", r"protocol\s+(\w+)"],
    "Concepto": ["(entrelazamiento|superposición|decoherencia|teleportación)", "(qubit|qutrit|qudit)", "(entanglement|superposition|decoherence)"],
    "Gate": [r"puerta\s+(\w+)", "(Hadamard|CNOT|Pauli|Toffoli|SWAP)", r"(H|X|Y|Z|T|S)\s+gate"],
    "Autor": ["(Bennett|Brassard|Ekert|Shor|Grover|Deutsch|Feynman|Nielsen|Chuang)"],
}


def _entity(kind: str, n: int):
    return lambda name, i: F.struct((F.lit(n * 1_000_000) + i).alias("ord"), F.trim(name).alias("name"), F.lit(kind).alias("type"))


# Letters of which one is in every match of a pattern, in the same order, folded as below.
ENTITY_STEMS = {
    "Algoritmo": [["algoritmo"], ["shor", "grover", "deutsch", "simon", "bb84", "e91", "b92", "qkd"], ["algorithm"]],
    "Protocolo": [["protocolo"], ["bb84", "e91", "b92", "sarg04", "cow", "dps"], ["protocol"]],
    "Concepto": [["entrelazamiento", "superposición", "decoherencia", "teleportación"], ["qubit", "qutrit", "qudit"], ["entanglement", "superposition", "decoherence"]],
    "Gate": [["puerta"], ["hadamard", "cnot", "pauli", "toffoli", "swap"], ["gate"]],
    "Autor": [["bennett", "brassard", "ekert", "shor", "grover", "deutsch", "feynman", "nielsen", "chuang"]],
}


def _folded(text: Column) -> Column:
    """Lower case, with the letters outside ASCII that patterns of any case take for an s or i."""
    for a, b in (("ſ", "s"), ("ı", "i"), ("İ", "i")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.lower(text)


def entities(text: Column) -> Column:
    """{name, type, ord} of a text's entities: by pattern and then place, the first of a name (any case), longer than one character. Patterns run only over texts with one of their stems."""

    def found(folded: Column) -> Column:
        out, n = [], 0
        for kind, patterns in ENTITY_PATTERNS.items():
            for p, stems in zip(patterns, ENTITY_STEMS[kind], strict=True):
                can = reduce(or_, [F.contains(folded, F.lit(x)) for x in stems])
                names = F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1))
                out.append(F.transform(F.when(~can, F.array().cast("array<string>")).otherwise(names), _entity(kind, n)))
                n += 1
        return F.flatten(F.array(*out))

    # folded once a text: what lambdas take is not computed again
    return F.filter(F.flatten(F.transform(F.array(_folded(text)), found)), lambda e: F.length(e["name"]) > 1)


def mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content) -> (chunk_id, node, name, type, ord), one row per entity and chunk."""
    e = chunks.select("chunk_id", F.explode(entities(F.col("content"))).alias("e")).select("chunk_id", F.lower("e.name").alias("node"), "e.*")
    return e.groupBy("chunk_id", "node").agg(F.min_by(F.struct("name", "type", "ord"), "ord").alias("f")).select("chunk_id", "node", "f.name", "f.type", "f.ord")


def build(m: DataFrame, order: str = "chunk_id", chunks: int = 3) -> dict[str, DataFrame]:
    """Nodes with the number of their mentions and their first chunks (all are in the mentions themselves); one edge for each ordered pair in a chunk, weighted by its number of chunks, with the first one's id.

    A chunk's entities are bounded by the patterns' matches in it, so the pairs are formed per chunk.
    """
    nodes = m.groupBy("node").agg(F.min_by("name", order).alias("name"), F.min_by("type", order).alias("type"), F.count("*").alias("mentions"))
    first = m.select("node", "chunk_id").withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("chunk_id"))).where(F.col("_n") <= chunks)
    nodes = nodes.join(first.groupBy("node").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids")), "node")
    a, b = m.select("chunk_id", F.col("node").alias("src"), F.col("ord").alias("i")), m.select("chunk_id", F.col("node").alias("dst"), F.col("ord").alias("j"))
    pairs = a.join(b, "chunk_id").where("i < j")
    edges = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"), F.lit("CO_OCCURS").alias("relation"), F.min("chunk_id").alias("chunk_id"))
    return {"nodes": nodes, "edges": edges}


def triples_to_edges(triples: DataFrame, relations: list[str], entity_types: list[str], least: float = 0.7) -> DataFrame:
    """Extracted triples with known relations and types (any case) and enough confidence, as edges."""
    known = lambda c, names: F.array_contains(F.array(*[F.lit(n.lower()) for n in names]), F.lower(c))
    good = triples.where((F.col("confidence") >= least) & known(F.col("relation"), relations) & known(F.col("source_type"), entity_types) & known(F.col("target_type"), entity_types))
    return good.groupBy(F.lower("source").alias("src"), F.lower("target").alias("dst")).agg(F.sum("confidence").alias("weight"), F.min_by("relation", "chunk_id").alias("relation"), F.min("chunk_id").alias("chunk_id"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", "relation")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))


def neighbours(starts: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(start) -> (start, node, distance, relation): everything within `depth` steps in any direction, each node at its first reach."""
    e = both_ways(edges)
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("relation"))
    front = seen
    for k in range(1, depth + 1):
        step = front.select("start", F.col("node").alias("src")).join(e, "src").groupBy("start", F.col("dst").alias("node")).agg(F.min("relation").alias("relation"))
        front = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(k).alias("distance"), "relation")
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def shortest_paths(pairs: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst) -> (src, dst, path) with the fewest steps, the smallest node names first on ties; no row where none has at most `most` steps (any number, where it is not given).

    Breadth first on distinct nodes: a node reached keeps one path, so a level has no more rows than nodes for each source.
    With `most`, only nodes are kept from which some wanted end is within the steps that are left; a source whose ends are all found goes no further.
    """
    e = cut(both_ways(edges).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    near = None if most is None else steps_to(pairs.select(F.col("dst").alias("at")).distinct(), e, most - 1)
    front = pairs.select("src").distinct().select("src", F.col("src").alias("at"), F.array("src").alias("path"))
    seen, wanted = front, cut(pairs.where("src != dst").select("src", "dst").distinct())
    for k in count(1) if most is None else range(1, most + 1):
        step = front.join(wanted.select("src").distinct(), "src", "left_semi").join(e, "at")
        if near is not None:
            step = step.join(near.where(F.col("steps") <= most - k).select(F.col("at").alias("to")), "to", "left_semi")
        step = step.groupBy("src", F.col("to").alias("at")).agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        front = cut(step.join(seen.select("src", "at"), ["src", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        wanted = cut(wanted.join(front.select("src", F.col("at").alias("dst")), ["src", "dst"], "left_anti"))
    return pairs.join(seen.withColumnRenamed("at", "dst"), ["src", "dst"]).select("src", "dst", "path")


def steps_to(ends: DataFrame, e: DataFrame, most: int) -> DataFrame:
    """(at, steps): the nodes within `most` steps of any of the ends (at), over edges (at, to) both ways, one row a node."""
    near = ring = cut(ends.withColumn("steps", F.lit(0)))
    for k in range(1, most + 1):
        ring = cut(e.join(ring.select(F.col("at").alias("to")), "to").select("at").distinct().join(near.select("at"), "at", "left_anti").withColumn("steps", F.lit(k)))
        if ring.isEmpty():
            break
        near = near.unionByName(ring)
    return near


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10, depth: int = 2) -> DataFrame:
    """(query_id, query) -> the k most mentioned nodes that the query names, with their neighbours' names and chunks.

    A query without entities matches nodes by substring, either way round.
    """
    named = queries.select("query_id", F.explode(entities(F.col("query"))).alias("e")).select("query_id", F.lower("e.name").alias("node")).distinct()
    rest = queries.join(named.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lower("query").alias("q"))
    rest, names = cut(rest.withColumnRenamed("q", "text")), nodes.select(F.col("node").alias("name"))
    part = linking.names_in_texts(rest, names).unionByName(linking.texts_in_names(rest, names)).withColumnRenamed("name", "node")
    hits = named.unionByName(part).distinct().join(nodes, "node")
    w = Window.partitionBy("query_id").orderBy(F.desc("mentions"), "node")
    hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    near = neighbours(hits.select(F.col("node").alias("start")).distinct(), edges, depth).groupBy(F.col("start").alias("node")).agg(F.array_sort(F.collect_set("node")).alias("related"))
    return hits.join(near, "node", "left").select("query_id", "rank", "node", "type", "mentions", "chunk_ids", F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected components by the smallest name, with pointer jumping, until nothing changes; each round is cut by a checkpoint."""
    e = cut(both_ways(edges).select("src", "dst").distinct())
    labels = nodes.select("node", F.col("node").alias("component"))
    for _ in count():
        near = e.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("n")).agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("node") == F.col("n"), "left").select("node", "component", F.least("component", F.coalesce("m", "component")).alias("new"))
        jump = step.select(F.col("node").alias("j"), F.col("new").alias("up"))
        nxt = cut(step.join(jump, F.col("new") == F.col("j"), "left").select("node", "component", F.least("new", "up").alias("new")))
        changed = nxt.where("component != new").limit(1).count()
        labels = nxt.select("node", F.col("new").alias("component"))
        if not changed:
            break
    return labels


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line: nodes, edges, density."""
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    return n.join(e).select("n_nodes", "n_edges", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("density"))


def types(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n_nodes"))


def lineage(derived: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(entity, source) -> everything that each start (start) goes back to, with its distance; closed backwards (at most `most` steps, where given), cycles included once."""
    seen = cut(starts.select("start", F.col("start").alias("entity"), F.lit(0).alias("distance")))
    front = seen
    for k in count(1) if most is None else range(1, most + 1):
        up = front.select("start", "entity").join(derived, "entity").select("start", F.col("source").alias("entity")).distinct()
        front = cut(up.join(seen.select("start", "entity"), ["start", "entity"], "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def plan_levels(steps: DataFrame, most: int = PLAN_STEPS) -> DataFrame:
    """(plan_id, step_id, depends_on) -> level of each step: 0 without dependencies, else one more than the largest; steps on a cycle have none.

    Plans of up to `most` rows are levelled where they are gathered; larger ones in rounds of joins.
    """
    kind = {f.name: f.dataType for f in steps.schema.fields}
    if kind["depends_on"].elementType != kind["step_id"]:
        return _levels_in_rounds(steps)
    large = cut(steps.groupBy("plan_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col("plan_id").alias("_p")))
    none, same = large.isEmpty(), F.col("plan_id").eqNullSafe(F.col("_p"))
    needs = F.coalesce("depends_on", F.array().cast(kind["depends_on"])).alias("needs")
    small = steps if none else steps.join(large, same, "left_anti")
    plans = small.groupBy("plan_id").agg(F.collect_list(F.struct("step_id", needs)).alias("steps"))
    done = plans.mapInArrow(_levelled, f"plan_id {kind['plan_id'].simpleString()}, step_id {kind['step_id'].simpleString()}, level int")
    return done if none else done.unionByName(_levels_in_rounds(steps.join(large, same, "left_semi")))


def _levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(plan_id, steps: list of step_id and needs) -> (plan_id, step_id, level), all plans of a batch in the same rounds."""
    for b in batches:
        each = b.column(1).flatten()
        if not len(each):
            continue
        plan = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
        ids, needs = (pc.struct_field(each, i) for i in (0, 1))
        known = pc.unique(ids.drop_null())
        # a null step is one by itself, which nothing can need; nor can anything be met in a null plan
        width = len(known) + 1
        place = lambda x, other: pc.fill_null(pc.index_in(x, known, skip_nulls=True), other).to_numpy(zero_copy_only=False).astype(np.int64)
        key, first, step = np.unique(plan * width + place(ids, len(known)), return_index=True, return_inverse=True)
        size, flat = needs.value_lengths().to_numpy(), needs.flatten()
        waits, where, need = np.repeat(step, size), np.repeat(plan, size), place(flat, -1)
        at = np.searchsorted(key, where * width + need) % len(key)
        at[(need < 0) | b.column(0).is_null().to_numpy(zero_copy_only=False)[where] | (key[at] != where * width + need)] = -1
        level = np.where(np.bincount(waits[flat.is_valid().to_numpy(zero_copy_only=False)], minlength=len(key)) == 0, 0, -1)
        for k in count(1):
            waits, at = (x[level[waits] < 0] for x in (waits, at))
            ready = np.zeros(len(key), bool)
            ready[waits] = True
            ready[waits[(at < 0) | (level[at] < 0)]] = False
            if not ready.any():
                break
            level[ready] = k
        has = np.flatnonzero(level >= 0)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(plan[first[has]])), ids.take(pa.array(first[has])), pa.array(level[has].astype(np.int32))], names=["plan_id", "step_id", "level"])


def _levels_in_rounds(steps: DataFrame) -> DataFrame:
    every = cut(steps.select("plan_id", "step_id", F.explode_outer("depends_on").alias("needs")))
    done = every.groupBy("plan_id", "step_id").agg(F.count("needs").alias("n")).where("n = 0").select("plan_id", "step_id", F.lit(0).alias("level"))
    for k in count(1):
        left = every.join(done.select("plan_id", "step_id"), ["plan_id", "step_id"], "left_anti")
        met = left.join(done.select("plan_id", F.col("step_id").alias("needs"), F.lit(1).alias("ok")), ["plan_id", "needs"], "left")
        ready = met.groupBy("plan_id", "step_id").agg(F.count("*").alias("n"), F.count("ok").alias("k")).where("n = k").select("plan_id", "step_id", F.lit(k).alias("level"))
        ready = cut(ready)
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
    return done


def members(edges: DataFrame) -> DataFrame:
    """(node, n, nodes): how many nodes lead to each node, and the first hundred of them by name."""
    e = edges.select("src", "dst").distinct()
    first = e.withColumn("_n", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("_n") <= 100).groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("nodes"))
    return e.groupBy("dst").agg(F.count("*").alias("n")).join(first, "dst").withColumnRenamed("dst", "node")
