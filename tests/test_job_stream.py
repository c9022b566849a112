"""Jobs over two streams that arrive out of order, against the batch, and over restarts."""

import json

import pytest

from themelift.plans.pipeline import match_themes
from themelift.schemas import KEYWORDS, QUERY_LOG
from themelift.streaming import job_stream as js

TEXTS = ["google", "google maps", "chat gpt", "chatgpt", "gmail", "chatgbt"]
#: job, theme_pos, theme, minute of the request, minute of the reply, reply
THEMES = [
    ("a", 0, "google", 0, 9, '["google", "gogle"]'),
    ("a", 1, "chatgpt", 1, 2, 'Sure: ["chat gpt"]'),
    ("b", 0, "gmail", 2, 3, "no list"),
    ("b", 1, "never", 3, None, None),
    ("c", 0, "nothing", 4, 5, '["zzzz"]'),
]
SIZES = {"a": 2, "b": 2, "c": 3}  # a theme of c is never asked


def at(minute):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00.000Z"


@pytest.fixture
def place(tmp_path):
    for name in ("requests", "replies"):
        (tmp_path / name).mkdir()
    return tmp_path


def request(job, pos, theme, minute):
    return {"job_id": job, "theme_pos": pos, "theme": theme, "market": "Australia", "n_themes": SIZES.get(job, 1), "asked_at": at(minute)}


def drop(place, name, number, rows):
    (place / name / f"{number}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(spark, place, log):
    answers = js.answered(
        js.read_files(spark, str(place / "requests"), js.REQUEST, 1), js.read_files(spark, str(place / "replies"), js.REPLY, 1)
    )
    js.start_matches(answers, log, str(place / "out"), str(place / "state")).awaitTermination()
    js.start_jobs(spark, str(place / "out"), str(place / "lines"), str(place / "job-state")).awaitTermination()
    rows = spark.read.parquet(str(place / "lines")).orderBy("job_id", "line_no").collect()
    return [r for r in rows if r.job_id != "clock"]


def clock(place, number, minute):
    """Rows that move both streams' event time on."""
    drop(place, "requests", number, [request("clock", number, "none", minute)])
    drop(place, "replies", number, [{"job_id": "clock", "theme_pos": number, "content": "[]", "replied_at": at(minute)}])


def test_out_of_order_and_restarts(spark, place):
    log = spark.createDataFrame([(i, t, 10 - i, 1, 1.0, "Australia") for i, t in enumerate(TEXTS)], QUERY_LOG)
    replies = [{"job_id": j, "theme_pos": p, "content": c, "replied_at": at(m)} for j, p, _, _, m, c in THEMES if m is not None]
    requests = [request(j, p, t, m) for j, p, t, m, _, _ in THEMES]
    drop(place, "replies", 0, replies[2:])  # before their requests
    drop(place, "requests", 0, requests[3:])
    first = run(spark, place, log)
    assert [r.type for r in first if r.job_id == "c"] == ["job_start", "theme_result"]
    drop(place, "requests", 1, requests[:3] + requests[:1])  # one comes twice
    drop(place, "replies", 1, [*replies[:2], replies[0] | {"content": '["gmail"]'}])
    second = run(spark, place, log)
    assert [r.type for r in second if r.job_id == "a"] == ["job_start", "theme_result", "theme_result", "complete"]
    assert len(run(spark, place, log)) == len(second)  # nothing new
    for number, minute in ((2, 200), (3, 400), (4, 600)):
        clock(place, number, minute)
        rows = run(spark, place, log)
    ends = {r.job_id: r for r in rows if r.type in ("complete", "error")}
    assert sum(r.type in ("complete", "error") for r in rows) == 3
    assert {j: (r.type, r.n_themes, r.done, r.failed) for j, r in ends.items()} == {
        "a": ("complete", 2, 2, 0), "b": ("error", 2, 1, 1), "c": ("error", 3, 1, 0),
    }
    assert json.loads(ends["c"].line)["missing"] == 2
    for job in "abc":
        own = [r for r in rows if r.job_id == job]
        assert [r.line_no for r in own] == list(range(len(own))) and own[0].type == "job_start"
    words = {("a", 0): ["google", "gogle"], ("a", 1): ["chat gpt"], ("b", 0): ["gmail"], ("c", 0): ["zzzz"]}
    keys = list(words)
    kw = spark.createDataFrame([(k, t, "Australia", i, w) for k, key in enumerate(keys) for t in [next(x[2] for x in THEMES if x[:2] == key)] for i, w in enumerate(words[key])], KEYWORDS)
    want = sorted((*keys[r.theme_pos], r.normalized_query, r.Score, r.Relevance) for r in match_themes(kw, log).collect())
    got = spark.read.parquet(str(place / "out" / "results")).where("job_id <> 'clock'")
    assert sorted((r.job_id, r.theme_pos, r.normalized_query, r.Score, r.Relevance) for r in got.collect()) == want
    assert {j: r.match_count for j, r in ends.items()} == {j: sum(x[0] == j for x in want) for j in "abc"}
    asked = spark.read.parquet(str(place / "out" / "keywords")).where("job_id <> 'clock'").collect()
    assert sorted((r.job_id, r.theme_pos, r.kw_pos, r.keyword) for r in asked) == sorted((*k, i, w) for k, ws in words.items() for i, w in enumerate(ws))


def test_a_batch_that_runs_again_counts_once(spark, place):
    """Theme events of a replaced folder are read again under other names."""
    rows = [("j", 0, "t", "m", 2, "done", 1, 5, at(1)), ("j", 1, "u", "m", 2, "done", 1, 7, at(2))]

    def write(name, some):
        folder = place / "out" / "themes" / "batch=0"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("".join(json.dumps(dict(zip(js.names_of(js.EVENT), r, strict=True))) + "\n" for r in some))

    def told():
        js.start_jobs(spark, str(place / "out"), str(place / "lines"), str(place / "job-state")).awaitTermination()
        return [(r.type, r.match_count) for r in spark.read.parquet(str(place / "lines")).orderBy("line_no").collect()]

    write("a.json", rows[:1])
    assert told() == [("job_start", 0), ("theme_result", 5)]
    write("b.json", rows)
    assert told() == [("job_start", 0), ("theme_result", 5), ("theme_result", 12), ("complete", 12)]
    write("c.json", rows)
    assert len(told()) == 4


def test_state_does_not_follow_the_shuffles(spark, place, monkeypatch):
    """State has its own number of parts, kept over restarts; batches are matched as the session says."""
    log = spark.createDataFrame([(i, t, 10 - i, 1, 1.0, "Australia") for i, t in enumerate(TEXTS)], QUERY_LOG)
    seen, own = [], spark.conf.get(js.SHUFFLE_PARTITIONS)

    def matched(keywords, *args, **stored):
        seen.append(tuple(keywords.sparkSession.conf.get(c) for c in (js.SHUFFLE_PARTITIONS, "spark.sql.adaptive.enabled")))
        return match_themes(keywords, *args, **stored)

    monkeypatch.setattr(js, "match_themes", matched)
    drop(place, "requests", 0, [request("a", 0, "google", 0)])
    drop(place, "replies", 0, [{"job_id": "a", "theme_pos": 0, "content": '["google"]', "replied_at": at(1)}])
    try:
        for number, shuffles in ((1, 40), (2, 60)):
            spark.conf.set(js.SHUFFLE_PARTITIONS, shuffles)
            rows = run(spark, place, log)
            assert spark.conf.get(js.SHUFFLE_PARTITIONS) == str(shuffles)
            drop(place, "requests", number, [request("a", number, "chatgpt", number)])
            drop(place, "replies", number, [{"job_id": "a", "theme_pos": number, "content": '["chat gpt"]', "replied_at": at(number + 1)}])
    finally:
        spark.conf.set(js.SHUFFLE_PARTITIONS, own)
    assert [r.type for r in rows] == ["job_start", "theme_result", "theme_result", "complete"]
    assert seen[0] == ("40", "true") and seen[-1] == ("60", "true")
    want = max(js.STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    for state in ("state", "job-state"):
        for step in (place / state / "state").iterdir():
            assert len([p for p in step.iterdir() if p.name.isdigit()]) == want
