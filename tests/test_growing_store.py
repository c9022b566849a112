"""Increments of a store against one scan of all files."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from themelift.operators.gram_match import query_gram_stats
from themelift.operators.hard_match import gram_stats, hard_match
from themelift.operators.posting_blocks import block_match
from themelift.operators.typo_match import typo_join
from themelift.plans.catalog import REGISTRY, _quoted_log
from themelift.plans.pipeline import match_themes
from themelift.schemas import KEYWORDS
from themelift.sources import growing_store as gs
from themelift.sources.query_log import read_query_log

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HEAD = "normalized_query,SRPV,AdClick,revenue\n"
FILES = {
    "a.csv": ["google,5,1,1.5", ",1,1,1", "chat gpt,4,1,2"],
    "b.csv": ["chatgpt,3,0,0", '"maps, google",2,0,0', ",0,0,0"],
    "c.csv": ["gogle,1,0,0", "google,7,0,0"],
}


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def drop(place, *names):
    for name in names:
        (place / "in" / name).write_text(HEAD + "\n".join(FILES[name]) + "\n")


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_increments_equal_one_scan(spark, place):
    store, source = str(place / "store"), str(place / "in")
    drop(place, "a.csv")
    assert gs.ingest(spark, store, "Australia", source) == 0
    assert gs.ingest(spark, store, "Australia", source) is None  # a repeated file adds nothing
    drop(place, "b.csv", "c.csv")
    assert gs.ingest(spark, store, "Australia", source) == 1
    whole = read_query_log(spark, source, "Australia", row_id=True)
    log = gs.read_table(spark, store, "rows")
    own = ["id", "normalized_query", "SRPV", "AdClick", "revenue", "market"]
    assert rows(log, *own) == rows(whole, *own) and log.count() == 6
    for name, make in (("gram_stats", gram_stats), ("query_gram_stats", query_gram_stats)):
        assert rows(gs.read_table(spark, store, name), "market", "gram", "n") == rows(make(whole), "market", "gram", "n")
    kw = spark.createDataFrame([(0, "t", "Australia", k, w) for k, w in enumerate(["google", "gpt", "o", "maps,g"])], KEYWORDS)
    hit = ["kw_pos", "id", "relevance"]
    assert rows(block_match(kw, gs.read_table(spark, store, "blocks"), log), *hit) == rows(hard_match(kw, whole), *hit)
    typos = gs.read_table(spark, store, "typos")
    assert rows(typo_join(kw, log, typos), "kw_pos", "id", "edits") == rows(typo_join(kw, whole), "kw_pos", "id", "edits")
    stored = match_themes(kw, log, stats=gs.read_table(spark, store, "gram_stats"), q_stats=gs.read_table(spark, store, "query_gram_stats"), typos=typos)
    assert rows(stored, "normalized_query", "Score", "Relevance") == rows(match_themes(kw, whole), "normalized_query", "Score", "Relevance")


def test_markets_and_unfinished_increments(spark, place):
    store, source = str(place / "store"), str(place / "in")
    drop(place, "a.csv")
    gs.ingest(spark, store, "Australia", source)
    gs.ingest(spark, store, "Japan", source)
    spark.range(3).write.parquet(gs._place(store, "rows", "Japan", 1))  # cut off before its manifest
    assert gs.read_table(spark, store, "rows").groupBy("market").count().where("count <> 2").count() == 0
    drop(place, "b.csv")
    assert gs.ingest(spark, store, "Japan", source) == 1
    assert sorted(r.id for r in gs.read_table(spark, store, "rows").where("market = 'Japan'").collect()) == [0, 2, 3, 4]


def test_a_changed_file_raises(spark, place):
    drop(place, "a.csv")
    gs.ingest(spark, str(place / "store"), "Australia", str(place / "in"))
    (place / "in" / "a.csv").write_text(HEAD + "other,1,1,1\n")
    with pytest.raises(ValueError, match="bytes"):
        gs.ingest(spark, str(place / "store"), "Australia", str(place / "in"))
    with pytest.raises(ValueError, match="nothing"):
        gs.read_table(spark, str(place / "none"), "rows")


def test_last_answers(spark, tmp_path):
    answers = spark.createDataFrame([("m", "a", "one", 1), ("m", "a", "two", 2), ("n", "a", "three", 1)], "market string, request_key string, answer string, answered_at long")
    gs.add_answers(answers, str(tmp_path))
    gs.add_answers(answers.where("market = 'n'").withColumn("answer", F.lit("four")), str(tmp_path))
    assert rows(gs.last_answers(spark, str(tmp_path)), "market", "request_key", "answer") == sorted(
        ["Row(market='m', request_key='a', answer='two')", "Row(market='n', request_key='a', answer='three')"]
    )


def test_increments_of_the_query_are_dealt_over_files(spark, monkeypatch):
    places, ingest = [], gs.ingest
    monkeypatch.setattr(gs, "ingest", lambda s, store, market, source: places.append(source) or ingest(s, store, market, source))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {r.id: r.normalized_query for r in REGISTRY["growing_store"](spark, SF).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(list(Path(places[0].removeprefix("file:"), n).glob("*.csv"))) > 1 for n in "01")
    texts = [r.normalized_query for r in _quoted_log(spark, SF).orderBy("id").collect()]
    assert rows == dict(enumerate(texts))
