"""Sources, positions, joins under skew, requests and replies, rules, history."""

import json

import pytest
from pyspark.sql import functions as F

from themelift.operators import history, inference, verdicts
from themelift.operators.positions import topk_per, with_position
from themelift.sizing import lookup_join, measure, stage
from themelift.sources import query_log, sinks, themes
from themelift.sources.markets import language_plan, markets, resolve_market

WIDE = "　"


# Sources


def test_csv_with_quotes_and_missing_looking_texts(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        'normalized_query,SRPV,AdClick,revenue\n"a ""b"", c",1,2,3\nNA,1,1,1\nnull,2,2,2\n"",3,3,3\n'
        f"ナイキ{WIDE}シューズ,4,4,4\n",
        encoding="utf-8",
    )
    rows = query_log.read_query_log(spark, str(path), "Japan").collect()
    assert [r.normalized_query for r in rows] == ['a "b", c', "NA", "null", f"ナイキ{WIDE}シューズ"]
    placed = query_log.read_query_log(spark, str(path), "Japan", row_id=True).collect()
    assert sorted(r.id for r in placed) == [0, 1, 2, 4]


def test_multi_line_is_opt_in(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('normalized_query,SRPV,AdClick,revenue\n"a\nb",1,2,3\n', encoding="utf-8")
    rows = query_log.read_query_log(spark, str(path), "m", multi_line=True).collect()
    assert [r.normalized_query for r in rows] == ["a\nb"]


def test_row_id_over_many_blocks(spark, tmp_path):
    for part in range(3):
        lines = [f"query {part} {i:04d},{i},0,0" for i in range(400)]
        (tmp_path / f"part-{part}.csv").write_text(
            "normalized_query,SRPV,AdClick,revenue\n" + "\n".join(lines) + "\n"
        )
    before = {
        k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    }
    try:
        for size in ("1500b", "100000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10b")
            log = query_log.read_query_log(spark, str(tmp_path), "m")
            rows = query_log.with_row_id(log).orderBy("id").collect()
            assert [r.id for r in rows] == list(range(1200))
            assert [r.normalized_query for r in rows] == [
                f"query {p} {i:04d}" for p in range(3) for i in range(400)
            ]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_materialize_skips_finished_and_repeats_cut_off(spark, tmp_path):
    rows = [(0, "A b", 1, 1, 1.0, "Japan"), (1, "C", 1, 1, 1.0, "India")]
    log = spark.createDataFrame(
        rows, "id long, normalized_query string, SRPV long, AdClick long, revenue double, market string"
    )
    path = str(tmp_path / "store")
    assert query_log.materialize(log, path, "Japan")
    assert not query_log.materialize(log, path, "Japan")
    assert query_log.materialize(log, path, "India")
    (tmp_path / "store" / "market=India" / "_SUCCESS").unlink()
    assert query_log.materialize(log, path, "India")
    got = query_log.read_store(spark, path)
    assert sorted((r.market, r.match_text) for r in got.collect()) == [("India", "c"), ("Japan", "ab")]


def test_market_fallback(spark):
    dim = markets(spark, "/logs", {"China": "cn_only"})
    asked = spark.createDataFrame([("Japan",), ("Narnia",), ("China",)], "market string")
    rows = {r.market: r for r in resolve_market(asked, dim).collect()}
    assert rows["Narnia"].log_path == "/logs/market=Australia"
    assert rows["Narnia"].languages == ["English"]
    assert rows["Narnia"].search_index == "keywords-narnia"
    assert rows["Japan"].encoder == "paraphrase-multilingual-MiniLM-L12-v2"
    assert rows["China"].dedicated_table == "cn_only"
    plan = {r.market: r for r in language_plan(dim).collect()}
    assert plan["Australia"].english_only and not plan["India"].english_only
    assert plan["Singapore"].language_list == "English, Chinese, Malay"


def test_external_log(spark):
    ext = spark.createDataFrame(
        [(1, "au", "q", 5, "pc"), (2, "jp", "r", 6, "pc")],
        "Id long, TargetMarket string, Query string, Srpv long, DeviceType string",
    )
    dim = spark.createDataFrame(
        [("Australia", "au", None), ("Japan", "jp", "log_jp")], "market string, code string, dedicated_table string"
    )
    rows = query_log.adapt_external(query_log.market_slice(ext, "jp"), dim).collect()
    assert [(r.id, r.normalized_query, r.SRPV, r.AdClick, r.revenue, r.market) for r in rows] == [(2, "r", 6, 0, 0.0, "Japan")]
    own = spark.createDataFrame([(7, "jp", "s", 1, "pc")], ext.schema)
    log = query_log.external_log(ext, {"log_jp": own}, dim)
    assert sorted((r.id, r.market) for r in log.collect()) == [(1, "Australia"), (7, "Japan")]
    assert query_log.market_slice(ext, None, dedicated=True).count() == 2
    both = query_log.append_logs(
        query_log.adapt_external(ext, dim), spark.createDataFrame([("s", 1)], "normalized_query string, id long")
    )
    assert both.count() == 3


def test_theme_files(spark, tmp_path):
    path = tmp_path / "themes.txt"
    path.write_text(f" nike \n\n{WIDE}\nadidas{WIDE}\n", encoding="utf-8")
    assert sorted(r.theme for r in themes.read_themes(spark, str(path)).collect()) == ["adidas", "nike"]
    raw = spark.createDataFrame([(" 耐克 / nike ",), ("/x",), (" ",), ("puma",)], "raw_input string")
    got = {(r.raw_input, r.brand) for r in themes.clean_theme(raw).collect()}
    assert got == {("耐克 / nike", "耐克"), ("puma", "puma")}


def test_empty_result_still_has_header(spark, tmp_path):
    df = spark.createDataFrame(
        [],
        "theme string, normalized_query string, Relevance double, SRPV long, AdClick long, revenue double, "
        "Score int, matched_keyword string, AI_Valid boolean, AI_Reason string, market string",
    )
    path = str(tmp_path / "out")
    sinks.write_results(sinks.result_layout(df, with_market=True), path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 0
    assert sinks.result_layout(df).columns[0] == "SearchTheme"


# Positions and joins


@pytest.mark.parametrize("window_rows", [10**6, 10])
def test_positions_of_hot_groups(spark, window_rows):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(-1).alias("g"),
        ((F.col("id") * 7919) % 3001).alias("v"),
    )
    got = with_position(df, ["g"], [F.col("v").desc()], window_rows=window_rows).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.pos, -r.v))
    assert sum(map(len, groups.values())) == 3000
    for rows in groups.values():
        rows.sort()
        assert [p for p, _ in rows] == list(range(len(rows)))
        assert [v for _, v in rows] == sorted(v for _, v in rows)


def test_topk_above_the_limited_rank(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    got = topk_per(df, ["g"], [F.col("v").desc()], 1200)
    assert sorted(r.v for r in got.collect()) == list(range(3800, 5000))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit, hot_rows", [(1 << 20, 1), (0, 50), (0, 1000)])
def test_lookup_join_with_a_hot_key(spark, how, limit, hot_rows):
    big = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(7, "x"), (8, "y"), (999, "z")], "k long, v string")
    big = big.union(spark.createDataFrame([(900, None)], "id long, k long"))
    got = lookup_join(big, small, ["k"], how, limit=limit, salts=4, hot_rows=hot_rows)
    want = big.join(small, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_measure_and_stage(spark):
    df = spark.createDataFrame([("abc", [1.0, 2.0], ["x"], 1)], "a string, b array<double>, c array<string>, d long")
    assert measure(df).rows == 1 and measure(df).bytes > 10
    assert measure(df.where("false")).bytes == 0
    assert stage(df).collect() == df.collect()


# Requests and replies


def test_expansion_reply_branches(spark):
    replies = {
        0: '```json\n["a", "b", "a"]\n```',
        1: '["a b"]',
        2: 'Sure: ["x"] ok',
        3: '["x", ',
        4: "",
        5: None,
        6: "[]",
        7: '```\n["y", null]\n```',
        8: "['single']",
    }
    df = spark.createDataFrame(
        [(0, "t", "India", p, f"brand{p}", c) for p, c in replies.items()],
        "theme_pos long, theme string, market string, brand_pos long, brand string, content string",
    )
    got = {}
    for r in inference.parse_expansion(df).orderBy("brand_pos", "kw_pos").collect():
        got.setdefault(r.brand_pos, []).append(r.keyword)
    assert got == {
        0: ["a", "b"],
        1: ["a b"],
        2: ["x"],
        3: ["brand3"],
        4: ["brand4"],
        5: ["brand5"],
        6: ["brand6"],
        7: ["y"],
        8: ["brand8"],
    }


def test_space_variants_in_japan_only(spark):
    df = spark.createDataFrame([("ナイキ シューズ ", "Japan"), ("a b ", "India"), (" ", "Japan")], "k string, m string")
    got = [r.v for r in df.select(inference.space_variants(F.col("k"), F.col("m")).alias("v")).collect()]
    assert got == [["ナイキ シューズ", f"ナイキ{WIDE}シューズ"], ["a b "], []]


def test_verdict_reply_branches(spark):
    requests = spark.createDataFrame(
        [(0, b, [f"q{b}", f"r{b}"]) for b in range(7)], "theme_pos long, batch_index long, queries array<string>"
    )
    replies = spark.createDataFrame(
        [
            (0, 0, 'x {"q0": {"is_valid": false, "reason": "no"}, "z": {"is_valid": true, "reason": ""}} y', "stop"),
            (0, 1, "", "length"),
            (0, 2, "nothing", "stop"),
            (0, 3, '{"q3": {"is_valid"}', "stop"),
            (0, 4, '{"q4": 1}', "stop"),
            (0, 5, None, None),
        ],
        "theme_pos long, batch_index long, content string, finish_reason string",
    )
    rows = {
        r.normalized_query: (r.is_valid, r.reason)
        for r in inference.verdict_defaults(requests, replies).collect()
    }
    assert rows["q0"] == (False, "no") and rows["z"] == (True, "") and "r0" not in rows
    assert rows["r1"] == (True, "Validation failed (Empty Response: length)")
    assert rows["q2"] == (True, "Validation failed (Parse Error)")
    assert rows["q3"] == rows["q4"] == rows["r6"] == (True, "Validation failed (API Error)")
    assert rows["q5"] == (True, "Validation failed (Empty Response: None)")


def test_last_batch_wins_and_missing_verdict_is_valid(spark):
    verdict_rows = spark.createDataFrame(
        [(0, 0, "q", True, "a"), (0, 1, "q", False, "b"), (0, 1, "n", None, None)],
        "theme_pos long, batch_index long, normalized_query string, is_valid boolean, reason string",
    )
    results = spark.createDataFrame([(0, "q"), (0, "n"), (0, "other")], "theme_pos long, normalized_query string")
    final = verdicts.apply_verdicts(results, inference.merge_verdicts(verdict_rows))
    got = {r.normalized_query: (r.AI_Valid, r.AI_Reason) for r in final.collect()}
    assert got == {"q": (False, "b"), "n": (True, ""), "other": (True, "")}


def _results(spark, n):
    return spark.createDataFrame(
        [(0, "nike", "India", f"q{i:03d}", 2, 0.5, 100 - i) for i in range(n)],
        "theme_pos long, theme string, market string, normalized_query string, Score int, Relevance double, SRPV long",
    )


def test_validation_requests_and_reply_hook(spark):
    requests = inference.validation_requests(_results(spark, 60))
    assert sorted((r.batch_index, r.n_queries) for r in requests.collect()) == [(0, 25), (1, 25), (2, 10)]

    def model(batches):
        for pdf in batches:
            answers = [
                json.dumps({q: {"is_valid": not q.endswith("7"), "reason": "r"} for q in qs})
                for qs in pdf["queries"]
            ]
            yield pdf.assign(content=answers, finish_reason="stop")

    replies = inference.reply_with(requests, model)
    rows = inference.merge_verdicts(inference.verdict_defaults(requests, replies)).collect()
    assert len(rows) == 60 and sum(not r.is_valid for r in rows) == 6


def test_request_reuse(spark):
    asked = spark.createDataFrame([("Nike ", "au"), ("nike", "au"), ("puma", "au")], "theme string, market string")
    done = spark.createDataFrame([("NIKE", "au", "old", 1), ("nike", "au", "new", 2)], "theme string, market string, answer string, at long")
    pending = inference.pending_requests(asked, done, "theme", ["market"]).collect()
    assert [r.request_key for r in pending] == ["puma"]
    reused = inference.reused_requests(asked, done, "theme", ["market"], "answer", "at").collect()
    assert [(r.theme, r.answer) for r in sorted(reused)] == [("Nike ", "new"), ("nike", "new")]


# Brand rules


@pytest.fixture(scope="module")
def brand_dims(spark):
    brands = spark.createDataFrame(
        [("gmail", "google", False), ("google", None, False), ("aami", None, False), ("apple", None, True), ("google maps", "google", False)],
        "brand string, parent string, is_common_word boolean",
    )
    aliases = spark.createDataFrame([("gmail", "ジーメール"), ("gmail", "gmail.com")], "brand string, alias string")
    off_topic = spark.createDataFrame([("aami", "park"), ("apple", "pie")], "brand string, term string")
    return brands, aliases, off_topic


@pytest.mark.parametrize(
    "theme, query, reason",
    [
        ("gmail", "gmail login", ""),
        ("gmail", "ジーメール", ""),
        ("gmail", "google gmail", ""),
        ("gmail", "outlook", "Brand not named"),
        ("gmail", "aami gmail", "Other brand"),
        ("gmail", "gmail vs aami", "Comparison with other brand"),
        ("gmail", "gmail vs google", ""),
        ("gmail", "gmail vs nothing", ""),
        ("aami", "aami park", "Unrelated concept"),
        ("aami", "aamipark", "Unrelated concept"),
        ("aami", "aami parking", ""),
        ("apple", "apple pie", "Unrelated concept"),
        ("unlisted", "unlisted aami", "Other brand"),
        ("google maps", "googlemaps aami", "Other brand"),
    ],
)
def test_rules(spark, brand_dims, theme, query, reason):
    rows = spark.createDataFrame([(0, theme, query)], "theme_pos long, theme string, normalized_query string")
    got = verdicts.rule_labels(rows, *brand_dims).first()
    assert (got.reason, got.is_valid) == (reason, reason == "")


def test_keyword_guard(spark, brand_dims):
    words = [("apple", "apple watch"), ("apple", "iphone"), ("apple", "apple pie"), ("gmail", "google"), ("gmail", "inbox")]
    df = spark.createDataFrame(words, "theme string, keyword string")
    kept = {(r.theme, r.keyword) for r in verdicts.keyword_guard(df, *brand_dims).collect()}
    assert kept == {("apple", "apple watch"), ("gmail", "inbox")}


# History


def test_theme_lists(spark):
    final = _results(spark, 60).withColumn("AI_Valid", F.col("SRPV") % 2 == 0)
    kw = spark.createDataFrame(
        [(0, "nike", "India", p, f"k{p}") for p in range(3)],
        "theme_pos long, theme string, market string, kw_pos long, keyword string",
    )
    items = history.theme_task_items(kw, final)
    rows = {(r.list, r.pos): (r.item, r.valid) for r in items.collect()}
    assert rows == {("keyword", p): (f"k{p}", None) for p in range(3)} | {
        ("query", i): (f"q{i:03d}", i % 2 == 0) for i in range(60)
    }
    shown = history.preview(items).first()
    assert shown.preview == [f"q{i:03d}" for i in range(50)] and shown.n_more == 10


def test_preview_of_a_long_list(spark):
    queries = spark.range(25_000).selectExpr(
        "0L as theme_pos", "'nike' as theme", "'India' as market", "'query' as list", "id as pos",
        "concat('q', id) as item", "if(id < 0, null, true) as valid",
    )
    words = spark.createDataFrame([(1, "adidas", "India", "keyword", 0, "k", None)], queries.schema)
    shown = {r.theme: r for r in history.preview(queries.unionByName(words)).collect()}
    assert shown["nike"].preview == [f"q{i}" for i in range(50)] and shown["nike"].n_more == 24_950
    assert shown["adidas"].preview == [] and shown["adidas"].n_more == 0


def test_counts_and_status(spark):
    final = _results(spark, 4).withColumn("AI_Valid", F.col("SRPV") == 100)
    words = final.select("theme_pos", "theme", "market").unionByName(
        spark.createDataFrame([(9, "idle", "India")], "theme_pos long, theme string, market string")
    )
    rows = {r.theme: r for r in history.theme_counts(final, words).collect()}
    row = rows.pop(final.first().theme)
    assert (row.match_count, row.valid_count, row.invalid_count) == (4, 1, 3)
    assert [(r.theme, r.match_count, r.valid_count, r.invalid_count) for r in rows.values()] == [("idle", 0, 0, 0)]
    tasks = spark.createDataFrame([("j", "done"), ("j", "error"), ("k", "done")], "job_id string, status string")
    assert {(r.job_id, r.status) for r in history.job_status(tasks).collect()} == {("j", "error"), ("k", "done")}


def test_history_lists_round_trip(spark):
    df = spark.createDataFrame([(["ナイキ", 'a "b"'],)], "items array<string>")
    text = history.encode_lists(df, ["items"])
    assert text.first()["items"] == '["ナイキ","a \\"b\\""]'
    assert history.decode_lists(text, {"items": "array<string>"}).collect() == df.collect()
