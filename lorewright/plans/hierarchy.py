"""Summaries of documents and their sections, built from the chunks upwards and kept up to date.

A section's state is a handful of things that merge: number of chunks, tokens, the sum of their
vectors, the first chunks and headings in order. A document's state is the merged state of its
sections. Summaries and mean vectors are read off the states, so a changed document costs the
chunks of that document alone, and nothing is collected for a level but a bounded number of
texts. `retrieval.route_hierarchy` routes queries over the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.plans import providers

#: Chunks whose beginnings a state keeps, headings it keeps, and characters of each beginning.
FIRST, HEADINGS, BEGINNING = 8, 20, 300
KEY = ["doc_id", "section"]


def top_section(header_path: Column) -> Column:
    return F.coalesce(F.get(F.split(header_path, " > "), 0), F.lit(""))


def smallest(rows: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """Per key the n smallest structs of a column, in order; the limit is kept before and after the shuffle, so no group is collected whole."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    few = rows.select(*keys, column).withColumn("_nth", nth).where(F.col("_nth") <= n)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias(column))


def added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the sums of (i, x), as an array by i, and the number of vectors."""
    sums = rows.groupBy(*keys, "i").agg(F.sum("x").alias("x"), F.sum("m").alias("m"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("total"), F.max("m").alias("n_vectors"))


def states(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, doc_title, header_path, seq, content) and (chunk_id, embedding) -> one row a document and top section.

    Chunks without a vector count but add nothing to the sum. Vectors of one document must be of
    one length. The first chunks are those with the smallest seq, ties by chunk_id. A null
    header_path is no section; documents and sections are told apart by doc_id, which must not be null.
    """
    c = chunks.where("doc_id is not null").withColumn("section", top_section(F.col("header_path")))
    c = c.withColumn("first", F.struct("seq", "chunk_id", F.substring("content", 1, BEGINNING).alias("beginning"), "doc_title"))
    heads = c.where("header_path is not null").groupBy(*KEY, "header_path").agg(F.min(F.struct("seq", "chunk_id")).alias("at")).select(*KEY, F.struct("at", "header_path").alias("headings"))
    sums = added(c.join(vectors.select("chunk_id", "embedding"), "chunk_id").select(*KEY, F.posexplode("embedding").alias("i", "e")).select(*KEY, "i", F.col("e").cast("double").alias("x"), F.lit(1).alias("m")), KEY)
    n = c.groupBy(*KEY).agg(F.count("*").alias("n"))
    return n.join(smallest(c, KEY, "first", FIRST), KEY).join(smallest(heads, KEY, "headings", HEADINGS), KEY, "left").join(sums, KEY, "left")


def documents(sections: DataFrame) -> DataFrame:
    """Section states -> one state a document."""
    doc = ["doc_id"]
    n = sections.groupBy("doc_id").agg(F.sum("n").alias("n"))
    parts = lambda name, most: smallest(sections.select("doc_id", F.explode(name).alias(name)), doc, name, most)
    # a section's number of vectors counts once in each place of the sum
    sums = added(sections.select("doc_id", F.col("n_vectors").alias("m"), F.posexplode("total").alias("i", "x")), doc)
    return n.join(parts("first", FIRST), "doc_id").join(parts("headings", HEADINGS), "doc_id", "left").join(sums, "doc_id", "left")


def _mean() -> Column:
    return F.transform("total", lambda x: x / F.col("n_vectors"))


def summaries(sections: DataFrame, *, provider: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Section states -> (documents, sections) with summary and embedding, the mean of the chunks' vectors.

    Without a provider a document's summary is its title and the beginnings of its first three
    chunks, a section's its title and its first chunk's beginning; chunks before any heading belong
    to no section. A provider gets title, headings and beginnings, and its answer, where it gives one, holds.
    """
    begin = lambda n, size: F.array_join(F.transform(F.slice("first", 1, n), lambda c: F.substring(c["beginning"], 1, size)), " ")
    title = F.get("first", F.lit(0))["doc_title"]
    d = documents(sections).withColumn("summary", F.concat(F.lit("Documento: "), F.coalesce(title, F.lit("")), F.lit(". "), begin(3, 100)))
    s = sections.where("section != ''").withColumn("summary", F.concat(F.lit("Sección: "), F.col("section"), F.lit(". "), begin(1, 200)))
    if provider is not None:
        toc = F.array_join(F.transform("headings", lambda h: h["header_path"]), "\n")
        sample = F.array_join(F.transform("first", lambda c: c["beginning"]), "\n---\n")
        ask = lambda df, title: _told(df.withColumn("_prompt", F.concat_ws("\n\n", title, toc, sample)), provider)
        d, s = ask(d, title), ask(s, F.concat_ws(" > ", title, "section"))
    d = d.select("doc_id", title.alias("doc_title"), "n", "summary", F.transform("headings", lambda h: h["header_path"]).alias("headings"), _mean().alias("embedding"))
    return d, s.select("doc_id", section_id(F.col("doc_id"), F.col("section")).alias("section_id"), "section", "n", "summary", F.transform("headings", lambda h: h["header_path"]).alias("headings"), _mean().alias("embedding"))


def _told(df: DataFrame, provider: Callable) -> DataFrame:
    out = providers.complete(df.select(*KEY[: 1 + ("section" in df.columns)], "_prompt"), "_prompt", "_said", provider).drop("_prompt")
    on = KEY[: 1 + ("section" in df.columns)]
    return df.drop("_prompt").join(out, on, "left").withColumn("summary", F.coalesce(F.nullif(F.trim("_said"), F.lit("")), "summary")).drop("_said")


def section_id(doc_id: Column, section: Column) -> Column:
    return F.concat(F.lit("sec_"), doc_id.cast("string"), F.lit("_"), F.substring(F.sha2(section.cast("binary"), 256), 1, 16))


def updated(held: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Section states after documents changed: `chunks` and `vectors` hold all chunks of the new and changed ones, `gone` (doc_id) names removed ones."""
    touched = chunks.select("doc_id").distinct()
    if gone is not None:
        touched = touched.unionByName(gone.select("doc_id")).distinct()
    return held.join(touched, "doc_id", "left_anti").unionByName(states(chunks, vectors))
