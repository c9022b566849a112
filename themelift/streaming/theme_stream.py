"""Theme requests as a stream: each micro-batch is matched as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from themelift.plans.pipeline import keywords_of, match_themes
from themelift.schemas import THEME_KEY, THEME_REQUEST


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of theme requests from JSON files that land in a folder."""
    return (
        spark.readStream.schema(THEME_REQUEST)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def start_theme_stream(
    spark: SparkSession,
    in_dir: str,
    log: DataFrame,
    out_dir: str,
    checkpoint: str,
    stats: DataFrame | None = None,
    files_per_batch: int = 100,
    events_dir: str | None = None,
    q_stats: DataFrame | None = None,
) -> StreamingQuery:
    """Match arriving theme requests against a stored log and write results per micro-batch.

    A theme arrives whole in one request, so ranking and merging need no state across batches.
    Every batch replaces its own folder: a batch that is run again after a failure leaves the same
    files; so do the progress lines of its themes, if a folder is named for them. The run ends when
    all files present have been read.
    """

    def match(batch: DataFrame, batch_no: int) -> None:
        # The requests are read several times: for their size, their grams and the match.
        keywords = keywords_of(batch).persist()
        results = match_themes(keywords, log, stats=stats, q_stats=q_stats)
        place = f"{out_dir.rstrip('/')}/batch={batch_no}"
        results.write.mode("overwrite").parquet(place)
        if events_dir:
            done = batch.sparkSession.read.schema(results.schema).parquet(place)
            lines = theme_lines(match_counts(done, keywords))
            lines.write.mode("overwrite").parquet(f"{events_dir.rstrip('/')}/batch={batch_no}")
        keywords.unpersist()

    return (
        read_requests(spark, in_dir, files_per_batch)
        .writeStream.foreachBatch(match)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def match_counts(results: DataFrame, keywords: DataFrame) -> DataFrame:
    """theme_pos, theme, market, expanded_keywords (in order) and match_count of every theme, those
    without matches included. A theme's keyword list is what its one request carried."""
    ordered = F.array_sort(F.collect_list(F.struct("kw_pos", "keyword")))
    words = keywords.groupBy(*THEME_KEY).agg(
        F.transform(ordered, lambda s: s["keyword"]).alias("expanded_keywords")
    )
    counted = results.groupBy(*THEME_KEY).agg(F.count(F.lit(1)).alias("match_count"))
    return words.join(counted, THEME_KEY, "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))


def theme_lines(counts: DataFrame) -> DataFrame:
    """One progress line for each theme of ``counts`` (see ``match_counts``)."""
    data = F.struct("theme", "expanded_keywords", "match_count").alias("data")
    return counts.select(
        F.col("theme_pos").cast("bigint").alias("event_pos"),
        F.lit("theme_result").alias("type"),
        F.to_json(F.struct(F.lit("theme_result").alias("type"), data)).alias("line"),
    )


def progress_events(job: str, themes: DataFrame) -> DataFrame:
    """Progress lines of a job as JSON text: its start, the lines of its themes, its end.
    ``event_pos`` orders the lines."""

    def line(kind: str, place: int) -> DataFrame:
        text = F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(job).alias("job_id")))
        return themes.sparkSession.range(1).select(
            F.lit(place).cast("bigint").alias("event_pos"), F.lit(kind).alias("type"), text.alias("line")
        )

    return line("job_start", -(2**62)).unionByName(themes).unionByName(line("complete", 2**62))
