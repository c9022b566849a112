"""Rows and times of a run's steps, taken while it runs, as a table.

A step is computed once: it is written to the shared folder and read back, and on the way a named
observation counts its rows and whatever else is asked for, without a job of its own. Of every step
the table has its status, rows, counts, start, end and seconds; a step that fails leaves a row with
its error. The table has a row for each step, so it is as small as the plan.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from themelift.sizing import scratch_dir

METRICS = (
    "job_id string, step_no int, step string, status string, rows long, counts map<string, long>, "
    "started_at timestamp, finished_at timestamp, elapsed_sec double, error string"
)
ERROR_CHARS = 500


class RunMetrics:
    """The steps of one job so far."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job = spark, job
        self.steps: list[tuple] = []

    def step(self, name: str, df: DataFrame, **counts: Column) -> DataFrame:
        """Compute a table as a step of this name and give what was stored. ``counts`` are aggregates
        over its rows."""
        seen = Observation(f"{self.job} {len(self.steps)} {name}")
        aggregates = [F.count(F.lit(1)).alias("rows"), *[c.cast("long").alias(n) for n, c in counts.items()]]
        path = scratch_dir(self.spark, f"step-{name}")
        began = datetime.now(UTC)
        try:
            df.observe(seen, *aggregates).write.parquet(path)
        except Exception as error:
            self._note(name, "error", began, None, {}, str(error)[:ERROR_CHARS])
            raise
        found = dict(seen.get)
        self._note(name, "done", began, found.pop("rows"), found, None)
        return self.spark.read.schema(df.schema).parquet(path)

    def _note(self, name: str, status: str, began: datetime, rows: int | None, counts: dict, error: str | None) -> None:
        ended = datetime.now(UTC)
        seconds = (ended - began).total_seconds()
        self.steps.append((self.job, len(self.steps), name, status, rows, counts, began, ended, seconds, error))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.steps, METRICS)

    def write(self, path: str) -> None:
        """Add the steps to a metrics table, beside those of other jobs; a job that is written again
        replaces its own."""
        self.table().drop("job_id").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/job_id={self.job}")


def job_times(metrics: DataFrame) -> DataFrame:
    """job_id, created_at, finished_at, elapsed_sec and status of each job of a metrics table."""
    return metrics.groupBy("job_id").agg(
        F.min("started_at").alias("created_at"),
        F.max("finished_at").alias("finished_at"),
        F.round(F.sum("elapsed_sec"), 3).alias("elapsed_sec"),
        F.when(F.count_if(F.col("status") == "error") > 0, "error").otherwise("done").alias("status"),
    )


def step_summary(metrics: DataFrame) -> DataFrame:
    """Runs, rows and seconds by step and status, over all jobs of a metrics table."""
    return metrics.groupBy("step", "status").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("rows").alias("rows"), F.round(F.sum("elapsed_sec"), 2).alias("elapsed_sec")
    )
