"""Matching of whole theme lists, from keywords and log to scored results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themelift.operators.gram_match import gram_topk
from themelift.operators.hard_match import hard_match
from themelift.operators.history import failed_tasks, run_tasks, timed_tasks
from themelift.operators.inference import merge_verdicts, validation_requests, verdict_defaults
from themelift.operators.lexical import lexical_topk
from themelift.operators.merge import MIN_RELEVANCE, hits_per_keyword, in_theme_order, merge_hits, relevance_floor, union_hits
from themelift.operators.run_metrics import RunMetrics
from themelift.operators.typo_match import typo_hits, typo_join
from themelift.operators.vector_match import MIN_SIM, TOP_K, vector_topk, vector_verify
from themelift.operators.verdicts import apply_verdicts
from themelift.schemas import THEME_KEY
from themelift.sources.query_log import attach_metrics, with_match_text
from themelift.sources.sinks import result_layout, write_results


def match_hits(
    keywords: DataFrame,
    log: DataFrame,
    kw_vecs: DataFrame | None = None,
    q_vecs: DataFrame | None = None,
    stats: DataFrame | None = None,
    k: int = TOP_K,
    min_sim: float = MIN_SIM,
    lexical: bool = False,
    q_stats: DataFrame | None = None,
    typos: DataFrame | None = None,
    hard_keywords: DataFrame | None = None,
) -> DataFrame:
    """Substring hits and verified vector hits of all themes; ``hard_keywords`` are the keywords of
    the substring match where they are not all of them. With vector tables the neighbours
    come from them, with ``lexical`` from text relevance, otherwise from the texts' character
    grams. Grams miss typos of short keywords, so there every typo is a hit too, at the higher of
    both similarities; ``typos`` is the stored ``typo_index`` of the log."""
    log = with_match_text(log)
    hard = hard_match(keywords if hard_keywords is None else hard_keywords, log, stats)
    if q_vecs is not None and kw_vecs is not None:
        near = vector_topk(kw_vecs, q_vecs, k, min_sim)
        candidates = attach_metrics(near, log, max_hits=k * kw_vecs.count())
    elif lexical:
        near = lexical_topk(keywords, log, k).drop("score", "distance")
        candidates = attach_metrics(near, log, max_hits=k * keywords.count())
    else:
        near = vector_verify(gram_topk(keywords, log, k, min_sim, counts=q_stats), min_sim)
        both = union_hits(near, typo_hits(typo_join(keywords, log, typos)))
        key = [c for c in both.columns if c != "relevance"]
        return union_hits(hard, both.groupBy(*key).agg(F.max("relevance").alias("relevance")))
    return union_hits(hard, vector_verify(candidates, min_sim))


def distinct_texts(keywords: DataFrame) -> DataFrame:
    """The first of the keywords of a theme that have one text. The substring hits of the others are
    the same but for ``kw_pos``, so merged results do not depend on them; a theme with a text a
    thousand times would have every hit a thousand times."""
    first = F.min(F.struct("kw_pos")).alias("first")
    kept = keywords.groupBy(*THEME_KEY, "keyword").agg(first)
    return kept.select(*THEME_KEY, F.col("first.kw_pos").alias("kw_pos"), "keyword")


def match_themes(
    keywords: DataFrame,
    log: DataFrame,
    kw_vecs: DataFrame | None = None,
    q_vecs: DataFrame | None = None,
    stats: DataFrame | None = None,
    k: int = TOP_K,
    min_sim: float = MIN_SIM,
    min_rel: float = MIN_RELEVANCE,
    q_stats: DataFrame | None = None,
    typos: DataFrame | None = None,
) -> DataFrame:
    """Scored results of all themes: one row per theme and query text. ``stats`` and ``q_stats``
    are gram counts stored with the log, of its match texts and of its padded texts, ``typos`` its
    typo index."""
    hits = match_hits(
        keywords, log, kw_vecs, q_vecs, stats, k, min_sim, q_stats=q_stats, typos=typos, hard_keywords=distinct_texts(keywords)
    )
    return relevance_floor(merge_hits(hits), min_rel).drop("score_hard", "score_vector")


def finish(results: DataFrame, requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Results with their verdict columns: replies are read, requests without a readable one get
    their defaults, and of several verdicts on a query that of the last batch holds."""
    return apply_verdicts(results, merge_verdicts(verdict_defaults(requests, replies)))


@dataclass
class JobRun:
    """The tables of a run as they were stored, its task rows with times, and what failed."""

    metrics: DataFrame
    tasks: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    error: str | None = None


def run_job(
    spark: SparkSession,
    job: str,
    keywords: DataFrame,
    log: DataFrame,
    reply: Callable[[DataFrame], DataFrame],
    min_rel: float = MIN_RELEVANCE,
    **stored: DataFrame | None,
) -> JobRun:
    """A whole run as observed steps: keywords, hits, hits of each keyword, results, requests,
    replies (``reply`` adds content and finish_reason to the requests) and final rows. A run that
    fails has error rows for its themes instead, and the steps it came through."""
    run, tables = RunMetrics(spark, job), {}

    def step(name: str, df: DataFrame, **counts: Column) -> DataFrame:
        tables[name] = run.step(name, df, **counts)
        return tables[name]

    def method(name: str) -> Column:
        return F.count_if(F.col("method") == name)

    try:
        words = step("keywords", keywords)
        hits = step("hits", match_hits(words, log, **stored), hard=method("hard"), vector=method("vector"))
        step("keyword_hits", hits_per_keyword(hits, words), hard=F.sum("hard_hits"), vector=F.sum("vector_hits"))
        results = step("results", relevance_floor(merge_hits(hits), min_rel).drop("score_hard", "score_vector"))
        requests = step("requests", validation_requests(results))
        replies = step("replies", reply(requests))
        final = step("final", finish(results, requests, replies), valid=F.count_if(F.col("AI_Valid")))
        tasks, error = run_tasks(job, words, final), None
    except Exception as failure:  # what failed is in the metrics
        tasks, error = failed_tasks(job, keywords), str(failure)
    return JobRun(run.table(), timed_tasks(tasks, run.table()), tables, error)


def write_final(final: DataFrame, path: str) -> None:
    """Results of a whole run as CSV, themes in input order and each in result order."""
    write_results(result_layout(in_theme_order(final)), path)


def keywords_of(requests: DataFrame) -> DataFrame:
    """Keyword rows of theme requests that carry their keyword list."""
    return requests.select(
        "theme_pos", "theme", "market", F.posexplode("keywords").alias("kw_pos", "keyword")
    )
