"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm import decontaminate, language_id, minmax_dedup, mixing, secrets
from lorewright.llm.common import ensure_checkpoint_dir, read

#: What stands in the text in place of a secret.
REDACTED = "[SECRET]"


def fresh(cols: list[str], name: str) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in cols}:
        name += "_"
    return name


def hidden(docs: DataFrame, *own: str) -> tuple[DataFrame, list]:
    """The documents with all columns but `own` under names that no operator has, and the columns that bring the names back."""
    names = {c: f"_col{i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.select(*own, *[F.col(c).alias(n) for c, n in names.items()]), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no recognisable language go: null, empty and letterless texts. lang becomes the language that was found, which is learned from the stage's own input.

    Repeated rows are judged each and alike; a null doc_id or source is kept; other columns
    pass through; an empty table gives an empty one.
    """
    plain, back = hidden(docs, "doc_id", "text", "lang")
    found = language_id.identify(plain, keep=[c for c in plain.columns if c != "lang"]).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    It is the one with the smallest doc_id; of repeated rows of it, one. Documents with a null
    doc_id can't be told apart and stay, as do texts without words (they are alike with
    nothing). Other columns pass through, whatever their names; an empty table gives an empty one.
    """
    own, nth = fresh(docs.columns, "_kept"), fresh(docs.columns, "_nth")
    kept = minmax_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own)).distinct()
    rows = docs.join(kept, F.col("doc_id") == F.col(own)).drop(own)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or word-free text holds none and stays; repeated rows are judged each and alike; other
    columns pass through; an empty table or benchmark changes nothing.
    """
    plain, back = hidden(docs, "doc_id", "text")
    return decontaminate.contamination(plain, read(spark, sf_dir, "benchmark"), keep=plain.columns).where(~F.col("contaminated")).select(back)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays, with its length counted again.

    A null text stays null, an empty one empty; repeated rows are treated each and alike; other
    columns pass through; an empty table gives an empty one.
    """
    plain, back = hidden(docs, "doc_id", "text")
    out = secrets.secrets(plain, keep=plain.columns[2:], redact=REDACTED).withColumn("text", F.col("redacted")).select(back)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document with the words that the curriculum takes of it and its training positions.

    A null text has no words, so nothing is taken of it; a null source is a source; repeated
    rows take part each; an empty table gives an empty mix.
    """
    return mixing.mix_sources(docs, keep=["source", "lang"])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("secrets", without_secrets), ("mix", mixed)]

#: SQL can't express the language stage; tests/llm/test_dedup.py holds every stage against a brute-force version.
ORACLE_SQL = None


def stored(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """The rows written as Parquet and read again: the next stage starts from files, whatever executors are lost, and reads only the columns it needs."""
    docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table, each result but the last written as Parquet to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(spark, docs, f"{folder}/{k}-{name}")
    return docs
