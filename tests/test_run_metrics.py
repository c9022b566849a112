"""Metrics of a run, and of one that fails."""

import pytest
from pyspark.sql import functions as F

from themelift.operators import history, merge
from themelift.operators.run_metrics import RunMetrics, job_times, step_summary
from themelift.plans import pipeline
from themelift.plans.pipeline import match_hits, run_job
from themelift.schemas import KEYWORDS, QUERY_LOG

TEXTS = ["google", "google maps", "chat gpt", "chatgpt", "gmail"]


@pytest.fixture(scope="module")
def inputs(spark):
    log = spark.createDataFrame([(i, t, 10 - i, 1, 1.0, "Australia") for i, t in enumerate(TEXTS)], QUERY_LOG)
    words = [(0, "google", 0, "google"), (1, "chatgpt", 0, "chat gpt"), (1, "chatgpt", 1, "gpt"), (2, "none", 0, "zzz")]
    return spark.createDataFrame([(p, t, "Australia", k, w) for p, t, k, w in words], KEYWORDS), log


def answered(requests):
    reply = F.concat(F.lit('{"'), F.element_at("queries", 1), F.lit('": {"is_valid": false, "reason": "x"}}'))
    return requests.withColumns({"content": reply, "finish_reason": F.lit("stop")})


def test_steps_of_a_run(spark, inputs, tmp_path):
    words, log = inputs
    run = run_job(spark, "j1", words, log, answered)
    assert run.error is None
    steps = {r.step: r for r in run.metrics.collect()}
    assert list(steps) == ["keywords", "hits", "keyword_hits", "results", "requests", "replies", "final"]
    assert all(r.status == "done" and r.error is None and r.finished_at >= r.started_at and r.elapsed_sec > 0 for r in steps.values())
    hits = match_hits(words, log)
    assert steps["hits"].rows == hits.count() and steps["hits"].counts["hard"] == hits.where("method = 'hard'").count()
    observed, counted = run.tables["keyword_hits"], merge.hits_per_keyword(hits, words)
    assert sorted(observed.collect()) == sorted(counted.select(observed.columns).collect())
    assert steps["keyword_hits"].counts["hard"] == steps["hits"].counts["hard"]
    tasks = {r.theme: r for r in run.tasks.collect()}
    assert tasks["none"].match_count == 0 and tasks["google"].invalid_count == 1
    assert all(r.status == "done" and r.finished_at > r.created_at and r.elapsed_sec > 0 for r in tasks.values())
    summary = history.timing_summary(run.tasks).first()
    assert summary.n_tasks == 3 and summary.match_count == run.tables["final"].count() and summary.elapsed_sec > 0


def test_a_failing_reply_leaves_error_rows(spark, inputs):
    words, log = inputs
    broken = lambda requests: requests.withColumn("content", F.raise_error(F.lit("no answer")).cast("string")).withColumn("finish_reason", F.lit("x"))
    run = run_job(spark, "j2", words, log, broken)
    assert "no answer" in run.error
    last = run.metrics.orderBy(F.desc("step_no")).first()
    assert (last.step, last.status, last.rows) == ("replies", "error", None) and "no answer" in last.error
    assert {(r.theme, r.status, r.n_keywords) for r in run.tasks.collect()} == {("google", "error", 1), ("chatgpt", "error", 2), ("none", "error", 1)}
    assert job_times(run.metrics).first().status == "error" and "results" in run.tables and "final" not in run.tables


def test_metrics_table_of_several_jobs(spark, tmp_path):
    for job, n in (("a", 3), ("b", 5), ("a", 4)):  # a is run again
        run = RunMetrics(spark, job)
        assert run.step("numbers", spark.range(n), even=F.count_if(F.col("id") % 2 == 0)).count() == n
        assert run.step("none", spark.range(0)).count() == 0
        run.write(str(tmp_path))
    table = spark.read.parquet(str(tmp_path))
    assert {(r.job_id, r.step, r.rows, r.counts.get("even")) for r in table.collect()} == {("a", "numbers", 4, 2), ("b", "numbers", 5, 3), ("a", "none", 0, None), ("b", "none", 0, None)}
    assert {(r.step, r.n_runs, r.rows) for r in step_summary(table).collect()} == {("numbers", 2, 9), ("none", 2, 0)}
    assert job_times(table).count() == 2


def test_a_text_of_many_keywords_is_matched_once_a_theme(spark, monkeypatch):
    log = spark.createDataFrame([(n, t, 1, 1, 0.5, "A") for n, t in enumerate(["red ring", "red rings", "a ring"])], QUERY_LOG)
    kw = spark.createDataFrame([(t, f"t{t}", "A", n, w) for t in (0, 1) for n in range(40) for w in ("red ring", "ring")], KEYWORDS)
    want = merge.relevance_floor(merge.merge_hits(match_hits(kw, log))).drop("score_hard", "score_vector")
    asked, match = [], pipeline.hard_match
    monkeypatch.setattr(pipeline, "hard_match", lambda words, *a: asked.append(words) or match(words, *a))
    got = pipeline.match_themes(kw, log)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    assert asked[0].count() == 4  # not 160: hits would be as many times those of one keyword
