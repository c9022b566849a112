"""Run history: jobs, theme tasks, validation batches, and the counts derived from a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelift.functions.ids import batch_id, theme_id
from themelift.operators.merge import result_order
from themelift.operators.positions import topk_per, with_position
from themelift.operators.run_metrics import job_times
from themelift.schemas import THEME_KEY, VERDICT
from themelift.sizing import lookup_join

PREVIEW = 50


def themes_of(keywords: DataFrame) -> DataFrame:
    """The themes of a keyword table."""
    return keywords.select(*THEME_KEY).distinct()


def _for_all(themes: DataFrame, counted: DataFrame, key: list[str], zeros: list[str]) -> DataFrame:
    """A row for every theme; what has no row in ``counted`` counts 0."""
    return themes.join(counted, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})


def theme_counts(final: DataFrame, keywords: DataFrame) -> DataFrame:
    """Matched, valid and invalid rows of every theme that has keywords; invalid is everything not
    valid."""
    valid = F.count_if(F.col("AI_Valid")).cast("bigint")
    counted = final.groupBy(*THEME_KEY).agg(
        F.count(F.lit(1)).alias("match_count"),
        valid.alias("valid_count"),
        (F.count(F.lit(1)) - valid).alias("invalid_count"),
    )
    return _for_all(themes_of(keywords), counted, THEME_KEY, ["match_count", "valid_count", "invalid_count"])


def batch_counts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    valid = F.count_if(F.coalesce(F.col("is_valid"), F.lit(False))).cast("bigint")
    return verdicts.groupBy(*keys).agg(
        valid.alias("valid_count"), (F.count(F.lit(1)) - valid).alias("invalid_count")
    )


def job_status(tasks: DataFrame) -> DataFrame:
    """A job is ``error`` if any of its theme tasks failed, otherwise ``done``."""
    failed = F.bool_or(F.col("status") == "error")
    return tasks.groupBy("job_id").agg(
        F.when(failed, "error").otherwise("done").alias("status"),
        F.count(F.lit(1)).alias("n_tasks"),
    )


def theme_rollup(final: DataFrame, keywords: DataFrame) -> DataFrame:
    """Page views, clicks and revenue of every theme that has keywords, over all rows and over the
    valid ones."""

    def over_valid(c: str) -> Column:
        return F.when(F.col("AI_Valid"), F.col(c)).otherwise(F.lit(0))

    sums = {
        "SRPV": F.sum("SRPV"),
        "AdClick": F.sum("AdClick"),
        "revenue": F.round(F.sum("revenue"), 2),
        "valid_SRPV": F.sum(over_valid("SRPV")),
        "valid_AdClick": F.sum(over_valid("AdClick")),
        "valid_revenue": F.round(F.sum(over_valid("revenue")), 2),
    }
    counted = final.groupBy(*THEME_KEY).agg(*[c.alias(n) for n, c in sums.items()])
    rows = _for_all(themes_of(keywords), counted, THEME_KEY, list(sums))
    return rows.select("theme_pos", F.col("theme").alias("SearchTheme"), "market", *sums)


def timing_summary(metrics: DataFrame) -> DataFrame:
    """Tasks, matched rows and elapsed seconds of a run by status."""
    return metrics.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum("match_count").alias("match_count"),
        F.round(F.sum("elapsed_sec"), 2).alias("elapsed_sec"),
    )


def theme_task_items(keywords: DataFrame, final: DataFrame) -> DataFrame:
    """The lists of every theme task, one row per item with its position: ``list`` is keyword or
    query; ``valid`` tells which queries are also validated ones."""
    words = keywords.select(
        *THEME_KEY,
        F.lit("keyword").alias("list"),
        F.col("kw_pos").cast("bigint").alias("pos"),
        F.col("keyword").alias("item"),
        F.lit(None).cast("boolean").alias("valid"),
    )
    matched = with_position(final, THEME_KEY, result_order(), "pos").select(
        *THEME_KEY, F.lit("query").alias("list"), "pos", F.col("normalized_query").alias("item"), F.col("AI_Valid").alias("valid")
    )
    return words.unionByName(matched)


def run_tasks(job: str, keywords: DataFrame, final: DataFrame) -> DataFrame:
    """Theme task rows of a finished run, themes without matches included."""
    words = keywords.groupBy(*THEME_KEY).agg(F.count(F.lit(1)).alias("n_keywords"))
    rows = words.join(theme_counts(final, keywords), THEME_KEY)
    return rows.select(
        F.lit(job).alias("job_id"),
        theme_id(F.lit(job), F.col("theme_pos")).alias("theme_id"),
        *THEME_KEY,
        F.lit("done").alias("status"),
        "n_keywords",
        "match_count",
        "valid_count",
        "invalid_count",
    )


def timed_tasks(tasks: DataFrame, metrics: DataFrame) -> DataFrame:
    """Task rows with the times of their job's run so far (see ``run_metrics``): created_at,
    finished_at and elapsed_sec. All themes of a run are matched together, so its times are theirs."""
    return tasks.join(F.broadcast(job_times(metrics).drop("status")), "job_id")  # a row for each job


def failed_tasks(job: str, keywords: DataFrame) -> DataFrame:
    """Theme task rows of a run that failed."""
    words = keywords.groupBy(*THEME_KEY).agg(F.count(F.lit(1)).alias("n_keywords"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("match_count", "valid_count", "invalid_count")]
    task = theme_id(F.lit(job), F.col("theme_pos")).alias("theme_id")
    return words.select(F.lit(job).alias("job_id"), task, *THEME_KEY, F.lit("error").alias("status"), "n_keywords", *none)


def run_batches(job: str, requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Validation batch rows of a run: the queries of each request, at most a batch of them, and
    the verdicts of its reply as a map. ``verdicts``: theme_pos, batch_index, normalized_query,
    is_valid, reason."""
    entry = F.struct("normalized_query", F.struct(*[F.col(f.name) for f in VERDICT.fields]).alias("verdict"))
    results = verdicts.groupBy("theme_pos", "batch_index").agg(F.map_from_entries(F.collect_list(entry)).alias("results"))
    task = theme_id(F.lit(job), F.col("theme_pos"))
    return requests.join(results, ["theme_pos", "batch_index"], "left").select(
        F.lit(job).alias("job_id"),
        task.alias("theme_id"),
        batch_id(task, F.col("batch_index")).alias("batch_id"),
        "batch_index",
        "queries",
        "results",
        F.when(F.col("results").isNull(), "error").otherwise("done").alias("status"),
    )


def encode_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """List and map columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def decode_lists(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON text columns back to the given types."""
    return df.withColumns({c: F.from_json(c, kind) for c, kind in columns.items()})


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The latest jobs, newest first."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id")).limit(limit)


def job_detail(jobs: DataFrame, tasks: DataFrame, batches: DataFrame) -> DataFrame:
    """Theme tasks of each job, in creation order, with their batches in index order: one row per
    batch, and one row without a batch for a task that has none.

    ``jobs``: job_id, job_status; ``tasks``: job_id, theme_id, theme, status, created_at;
    ``batches``: theme_id, batch_index, batch_id, n_queries.
    """
    placed = with_position(
        batches, ["theme_id"], [F.col("batch_index"), F.col("batch_id")], "batch_pos"
    )
    ordered = with_position(
        tasks, ["job_id"], [F.col("created_at"), F.col("theme_id")], "task_pos"
    )
    named = lookup_join(ordered, jobs, ["job_id"], "left")
    return named.join(placed, "theme_id", "left")


def preview(items: DataFrame, n: int = PREVIEW) -> DataFrame:
    """The first ``n`` queries of every theme as a list, and how many more there are."""
    queries = items.where(F.col("list") == "query")
    first = topk_per(queries, THEME_KEY, [F.col("pos")], n).groupBy(*THEME_KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("preview")
    )
    counted = queries.groupBy(*THEME_KEY).agg((F.count(F.lit(1)) - n).alias("n_more"))
    rows = themes_of(items).join(first, THEME_KEY, "left").join(counted, THEME_KEY, "left")
    return rows.select(
        *THEME_KEY,
        F.coalesce("preview", F.array().cast("array<string>")).alias("preview"),
        F.greatest(F.coalesce("n_more", F.lit(0)), F.lit(0)).cast("bigint").alias("n_more"),
    )
