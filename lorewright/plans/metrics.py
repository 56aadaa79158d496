"""What a run's stages saw: counts and sums that Spark takes while the rows pass, kept in a table.

A stage is watched where its rows pass, so counting costs no pass of its own. The figures are
there once an action has run through the stage.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TABLE = "run_id string, stage string, place int, measure string, value double, seconds double"


@dataclass
class Run:
    """One run: watch its stages, run it, then read or write its table."""

    spark: SparkSession
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    stages: list[tuple[str, Observation]] = field(default_factory=list)
    began: float = field(default_factory=time.time)

    def watch(self, df: DataFrame, stage: str, **measures: Column) -> DataFrame:
        """The same rows; the stage's `rows` and further aggregates are taken as they pass. Stage names must differ."""
        if stage in {s for s, _ in self.stages}:
            raise ValueError(f"stage {stage} is watched already")
        seen = Observation(f"{stage}-{self.run_id}")
        self.stages.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()])

    def table(self) -> DataFrame:
        """A row for each stage and measure, see TABLE. Waits for the figures of stages that an action has begun to run."""
        took = time.time() - self.began
        rows = [(self.run_id, stage, i, m, None if v is None else float(v), took) for i, (stage, seen) in enumerate(self.stages) for m, v in seen.get.items()]
        return self.spark.createDataFrame(rows, TABLE)

    def write(self, path: str) -> None:
        """Adds the run to the table of all runs."""
        self.table().coalesce(1).write.mode("append").partitionBy("run_id").parquet(path)


def changes(runs: DataFrame, before: str, after: str) -> DataFrame:
    """(stage, measure, before, after, ratio) of two runs, stages that only one has included."""
    one = lambda i, n: runs.where(F.col("run_id") == i).select("stage", "measure", F.col("value").alias(n))
    return one(before, "before").join(one(after, "after"), ["stage", "measure"], "full").select("stage", "measure", "before", "after", F.try_divide("after", "before").alias("ratio"))
