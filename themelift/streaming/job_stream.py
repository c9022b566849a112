"""Jobs as streams: requests wait for their replies, themes are matched as they are answered, and a
job ends once, after its last theme or when its themes stay away.

Two streams meet by job and theme: theme requests and the replies of the language model. Either may
come first. A request that has no reply within ``patience`` of event time leaves the join without
one. Each micro-batch of answers is matched and its results, keywords and theme events are written
to folders of the batch's own, so that a batch that runs again replaces them.

The theme events are a stream again, grouped by job. A job's state is six numbers however many
themes it has: the themes expected, done and failed, their matches, the lines told and whether it
has ended. Themes that were told twice, because a batch ran again, are counted once. The last theme
ends the job with ``complete``, or with ``error`` if a theme failed; a job whose themes stay away
for ``patience`` ends with ``error``. State goes ``patience`` after the end; the sink is exactly-once.

Every partition of every stateful step writes its files in every micro-batch, and they are not
coalesced. So state is kept in ``state_partitions``, not in as many parts as the session's shuffles,
and micro-batches are matched in the session of the log, whose plans adapt to their sizes.

Defined results: a reply without a usable list stands for the theme itself; null content does, too.
Of several replies to one request the first that arrives holds. Events later than the watermark are
dropped, as everywhere in Structured Streaming.
"""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from themelift.operators.inference import parse_expansion
from themelift.plans.pipeline import match_themes
from themelift.schemas import THEME_KEY
from themelift.sizing import stage

# The task code below travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Partitions of a stream's state where the cluster has no more cores.
STATE_PARTITIONS = 16
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
_STARTING = threading.Lock()

JOB_THEME = ["job_id", "theme_pos"]
REQUEST = "job_id string, theme_pos long, theme string, market string, n_themes long, asked_at timestamp"
REPLY = "job_id string, theme_pos long, content string, replied_at timestamp"
EVENT = "job_id string, theme_pos long, theme string, market string, n_themes long, status string, n_keywords long, match_count long, at timestamp"
LINES = "job_id string, line_no long, type string, n_themes long, done long, failed long, match_count long, line string"
STATE = "n_themes long, done long, failed long, match_count long, lines long, ended boolean"


def names_of(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def read_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of JSON files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def answered(requests: DataFrame, replies: DataFrame, patience: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Every request once, with ``content`` and ``replied_at`` of its reply, or, after ``patience``
    without one, with nulls. ``delay`` is how far either stream may be out of order."""
    asked = requests.withWatermark("asked_at", delay).dropDuplicatesWithinWatermark(JOB_THEME)
    told = replies.withWatermark("replied_at", delay).dropDuplicatesWithinWatermark(JOB_THEME)
    told = told.select(*[F.col(c).alias(f"reply_{c}") for c in JOB_THEME], "content", "replied_at")
    same = (F.col("job_id") == F.col("reply_job_id")) & (F.col("theme_pos") == F.col("reply_theme_pos"))
    soon = F.expr(f"replied_at >= asked_at - INTERVAL {delay} AND replied_at <= asked_at + INTERVAL {patience}")
    return asked.join(told, same & soon, "leftOuter").drop("reply_job_id", "reply_theme_pos")


def state_partitions(spark: SparkSession) -> int:
    """Parts of a stream's state: as many as the cluster has cores, or ``STATE_PARTITIONS`` if those
    are fewer, but not more than the session's shuffles have."""
    return min(int(spark.conf.get(SHUFFLE_PARTITIONS)), max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism))


def _start(spark: SparkSession, writer: DataStreamWriter, partitions: int | None) -> StreamingQuery:
    """Start a stream that keeps its state in ``partitions``. It takes the number from its session
    as it starts, and later from its checkpoint; the session's own is put back."""
    with _STARTING:
        own = spark.conf.get(SHUFFLE_PARTITIONS)
        spark.conf.set(SHUFFLE_PARTITIONS, partitions or state_partitions(spark))
        try:
            return writer.trigger(availableNow=True).start()
        finally:
            spark.conf.set(SHUFFLE_PARTITIONS, own)


def start_matches(
    answers: DataFrame,
    log: DataFrame,
    out_dir: str,
    checkpoint: str,
    patience: str = "1 hour",
    partitions: int | None = None,
    **stored: DataFrame | None,
) -> StreamingQuery:
    """Match the answers of each micro-batch with a log and write ``results``, ``keywords`` and
    ``themes`` (events) below ``out_dir``. ``partitions`` of the state: see ``state_partitions``; a
    checkpoint keeps its number. ``stored``: stats, q_stats and typos of ``match_themes``."""
    spark = log.sparkSession

    def match(batch: DataFrame, batch_no: int) -> None:
        # Themes are numbered over all jobs of the batch; the rows are read several times.
        rows = stage(batch.withColumn("row", F.monotonically_increasing_id()), "answers", spark)
        if rows.isEmpty():  # a batch that only moves the watermark
            return
        replies = rows.where("replied_at is not null").select(
            F.col("row").alias("theme_pos"), "theme", "market", F.lit(0).alias("brand_pos"), F.col("theme").alias("brand"), "content"
        )
        keywords = stage(parse_expansion(replies).drop("brand_pos"), "keywords")
        results = match_themes(keywords, log, **stored)
        own = rows.select("row", "job_id", F.col("theme_pos").alias("own_pos"))
        named = results.join(own, F.col("theme_pos") == F.col("row")).withColumn("theme_pos", F.col("own_pos")).drop("row", "own_pos")
        place = {name: f"{out_dir.rstrip('/')}/{name}/batch={batch_no}" for name in ("results", "keywords", "themes")}
        named.write.mode("overwrite").parquet(place["results"])
        words = keywords.join(own, F.col("theme_pos") == F.col("row"))
        words.select("job_id", F.col("own_pos").alias("theme_pos"), "kw_pos", "keyword").write.mode("overwrite").parquet(place["keywords"])
        done = spark.read.schema(named.schema).parquet(place["results"])
        matches = done.groupBy(*JOB_THEME).agg(F.count(F.lit(1)).alias("match_count"))
        counts = keywords.groupBy(F.col("theme_pos").alias("row")).agg(F.count(F.lit(1)).alias("n_keywords"))
        late = F.expr(f"asked_at + INTERVAL {patience}")
        events = rows.join(counts, "row", "left").join(matches, JOB_THEME, "left").select(
            "job_id", *THEME_KEY, "n_themes",
            F.when(F.col("replied_at").isNull(), "error").otherwise("done").alias("status"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_keywords", "match_count")],
            F.coalesce("replied_at", late).alias("at"),
        )
        events.select(names_of(EVENT)).write.mode("overwrite").json(place["themes"])

    return _start(answers.sparkSession, answers.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint), partitions)


def _line(job: str, kind: str, **data) -> str:
    return json.dumps({"type": kind, "job_id": job} | data, ensure_ascii=False)


def follow(patience_ms: int):
    """The state function of a job: lines in their order, the end once."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = key[0]
        n, done, failed, matches, lines, ended = state.get if state.exists else (0, 0, 0, 0, 0, False)
        out = []

        def tell(kind: str, **data) -> None:
            nonlocal lines
            out.append((job, lines, kind, n, done, failed, matches, _line(job, kind, **data)))
            lines += 1

        if state.hasTimedOut:
            if ended:
                state.remove()
                return
            ended = True
            tell("error", missing=n - done - failed)
            last = state.getCurrentWatermarkMs()
        else:
            last = 0
            for frame in frames:
                for row in frame.sort_values(["at", "theme_pos"]).itertuples():
                    last = max(last, int(row.at.timestamp() * 1000))
                    if ended:
                        continue
                    n = max(n, row.n_themes)
                    if not lines:
                        tell("job_start")
                    done, failed, matches = done + (row.status == "done"), failed + (row.status != "done"), matches + row.match_count
                    tell("theme_result", theme=row.theme, status=row.status, n_keywords=row.n_keywords, match_count=row.match_count)
                    if done + failed >= n:
                        ended = True
                        tell("error" if failed else "complete")
        state.update((n, done, failed, matches, lines, ended))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + patience_ms)
        yield pd.DataFrame(out, columns=names_of(LINES))

    return step


def job_lines(events: DataFrame, patience_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """Lines of every job, from a stream of theme events."""
    once = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(JOB_THEME)
    return once.groupBy("job_id").applyInPandasWithState(
        follow(patience_ms), LINES, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def start_jobs(
    spark: SparkSession,
    out_dir: str,
    lines_dir: str,
    checkpoint: str,
    patience_ms: int = 3_600_000,
    delay: str = "10 minutes",
    partitions: int | None = None,
) -> StreamingQuery:
    """Follow the theme events below ``out_dir`` and append the jobs' lines to ``lines_dir``."""
    events = spark.readStream.schema(EVENT).json(f"{out_dir.rstrip('/')}/themes/*")
    lines = job_lines(events, patience_ms, delay)
    return _start(spark, lines.writeStream.format("parquet").option("path", lines_dir).option("checkpointLocation", checkpoint), partitions)
