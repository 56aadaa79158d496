"""Structured Streaming forms of the incremental flows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.plans.library import parse
from lorewright.plans.segments import FANOUT, Make, library_tables, open_index
from lorewright.sources.markdown import sections


def read_files(spark: SparkSession, path: str, pattern: str = "*.md", per_trigger: int = 1000) -> DataFrame:
    """New Markdown files of a folder as (file_path, text)."""
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger)
    return stream.load(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def ingest(files: DataFrame, target: str, checkpoint: str):
    """Files to sections, one Parquet folder per batch; a batch that is run again replaces its own folder, so sections appear once."""

    def write(batch: DataFrame, n: int) -> None:
        sections(parse(batch)).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_index(files: DataFrame, path: str, checkpoint: str, make: Make = library_tables, fanout: int = FANOUT):
    """Files to an index of segments below `path`: each batch is one update, and one that is run again finds its documents unchanged. What a removed file leaves goes with `Segments.update(..., deleted)`."""

    def update(batch: DataFrame, n: int) -> None:
        open_index(batch.sparkSession, path, make, fanout).update(parse(batch))

    return files.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_sections(spark: SparkSession, target: str) -> DataFrame:
    """The sections that hold now: of a document that several batches brought, those of the last one."""
    every = spark.read.parquet(target)
    last = every.groupBy("doc_id").agg(F.max("batch").alias("_last"))
    return every.join(last, "doc_id").where("batch = _last").drop("_last")


def usage_by_day(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(ts, usage_type, total_cost): running totals by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "usage_type").agg(F.count("*").alias("calls"), F.sum("total_cost").alias("total_cost"))


SESSION = "session_id string, n_messages int, last_user string, summary string"


def bounded_sessions(messages: DataFrame, most: int = 10, ttl: str | None = None) -> DataFrame:
    """(session_id, turn, role, content): each session's state holds its last messages only, and goes after `ttl` ('2 hours') without any, for which the stream has to run on a timed trigger; one row per update."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    number, unit = (ttl or "0 days").split()
    life = int(float(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])

    def update(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        for f in frames:
            held += [[int(t), r, c] for t, r, c in zip(f["turn"], f["role"], f["content"], strict=True)]
        held = sorted(held)[-most:]
        state.update((json.dumps(held),))
        if life:
            state.setTimeoutDuration(life)
        user = next((c for _, r, c in reversed(held) if r == "user"), None)
        yield pd.DataFrame([(key[0], len(held), user, "\n".join(f"{r}: {c[:500]}" for _, r, c in held[-4:]))], columns=["session_id", "n_messages", "last_user", "summary"])

    return messages.groupBy("session_id").applyInPandasWithState(update, SESSION, "held string", "update", GroupStateTimeout.ProcessingTimeTimeout if life else GroupStateTimeout.NoTimeout)


def to_ledger(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Appends usage rows; queries are cut to 100 characters."""
    rows = transform(stream) if transform else stream
    if "query" in rows.columns:
        rows = rows.withColumn("query", F.substring("query", 1, 100))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
