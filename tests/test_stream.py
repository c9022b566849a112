import json

from themelift.plans.pipeline import match_themes
from themelift.schemas import KEYWORDS, QUERY_LOG
from themelift.streaming.theme_stream import progress_events, start_theme_stream, theme_lines


def test_stream_equals_batch_and_adds_only_new_files(spark, tmp_path):
    texts = ["google", "google maps", "chat gpt", "chatgpt", "gmail"]
    log = spark.createDataFrame([(i, t, 10 - i, 1, 1.0, "Australia") for i, t in enumerate(texts)], QUERY_LOG)
    themes = {0: ("google", ["google"]), 1: ("chatgpt", ["chat gpt", "gpt"]), 2: ("nothing", ["zzz"])}
    dirs = {name: str(tmp_path / name) for name in ("in", "out", "state", "events")}
    (tmp_path / "in").mkdir()

    def drop(pos):
        theme, words = themes[pos]
        line = json.dumps({"theme_pos": pos, "theme": theme, "market": "Australia", "keywords": words})
        (tmp_path / "in" / f"{pos}.json").write_text(line + "\n")

    def run():
        start_theme_stream(
            spark, dirs["in"], log, dirs["out"], dirs["state"], files_per_batch=1, events_dir=dirs["events"]
        ).awaitTermination()
        return sorted(map(str, spark.read.parquet(dirs["out"]).drop("batch").collect()))

    drop(0)
    drop(1)
    run()
    drop(2)
    got = run()
    kw = spark.createDataFrame(
        [(p, t, "Australia", i, w) for p, (t, words) in themes.items() for i, w in enumerate(words)], KEYWORDS
    )
    assert got == sorted(map(str, match_themes(kw, log).collect()))
    assert got == run()
    lines = [json.loads(r.line)["data"] for r in spark.read.parquet(dirs["events"]).orderBy("event_pos").collect()]
    assert lines == [
        {"theme": t, "expanded_keywords": words, "match_count": sum(f"theme_pos={p}," in row for row in got)}
        for p, (t, words) in themes.items()
    ]
    assert lines[2]["match_count"] == 0


def test_progress_lines(spark):
    counts = spark.createDataFrame(
        [(-3, "nike", ["a"], 3)], "theme_pos long, theme string, expanded_keywords array<string>, match_count long"
    )
    lines = [json.loads(r.line) for r in progress_events("j1", theme_lines(counts)).orderBy("event_pos").collect()]
    assert [x["type"] for x in lines] == ["job_start", "theme_result", "complete"]
    assert lines[1]["data"] == {"theme": "nike", "expanded_keywords": ["a"], "match_count": 3}
