import random

import numpy as np
import pyarrow as pa
import pytest
from brute import gram_near, hard, merge
from pyspark.sql import functions as F

from themelift.operators.gram_match import gram_topk
from themelift.operators.hard_match import (
    gram_index,
    gram_stats,
    hard_match,
    hard_match_indexed,
    write_gram_index,
)
from themelift.operators.keywords import blank_keywords, dedup_keywords, prepare_keywords
from themelift.operators.lexical import lexical_topk
from themelift.operators.merge import merge_hits, relevance_floor
from themelift.operators import posting_blocks as posting_blocks_module
from themelift.operators.keywords import gram_counts
from themelift.plans import fixtures
from themelift.operators.posting_blocks import block_candidates, block_match, posting_blocks, write_blocks
from themelift.plans.pipeline import match_hits, match_themes
from themelift.schemas import KEYWORDS, QUERY_LOG

WIDE = "　"
SAMPLE = [
    (0, "google", 140000, 10, 10.0),
    (1, "youtube", 110000, 9, 9.0),
    (2, "chat gpt", 80000, 8, 8.0),
    (3, "gmail", 70000, 7, 7.0),
    (4, "facebook", 40004, 6, 6.0),
    (5, "google maps", 30000, 5, 5.0),
    (6, "chatgpt", 20000, 4, 4.0),
]


def log_of(spark, rows):
    return spark.createDataFrame(rows, QUERY_LOG)


def kw_of(spark, rows):
    return spark.createDataFrame(rows, KEYWORDS)


def hard_rows(df):
    return sorted(
        (r.theme_pos, r.kw_pos, r.id, round(r.relevance, 9)) for r in df.collect()
    )


@pytest.fixture(scope="module")
def skewed():
    """Random texts of few letters; a third of all rows is one text, another text dominates one
    market, and some have spaces of both kinds, wildcards, quotes and upper case."""
    rng = random.Random(5)
    log = []
    for i in range(900):
        market = rng.choice(["Japan", "Australia"])
        if i % 3 == 0:
            text = "hot hot key"
        else:
            text = "".join(rng.choice("abАé  " + WIDE + "B%_'耐克") for _ in range(rng.randint(1, 14)))
        log.append((i, text, i * 3 % 17, i % 5, float(i % 7), market))
    log = [r for r in log if r[1].strip()]
    words = ["a", "B", "ab", "hot", "hothotkey", "耐克", "耐", "b%", "_'", "  ", "", "éab", "hot " + WIDE + "key", "zzz", "aab b", "b耐克a"]
    kw = [
        (t, f"theme {t}", market, p, w)
        for t, market in enumerate(["Japan", "Australia"])
        for p, w in enumerate(words)
    ]
    return kw, log


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_hard_match_equals_brute_force(spark, skewed, limit):
    kw, log = skewed
    got = hard_match(kw_of(spark, kw), log_of(spark, log), limit=limit, salts=3)
    assert hard_rows(got) == hard(kw, log)


def test_hard_match_with_stored_stats(spark, skewed):
    kw, log = skewed
    stats = gram_stats(log_of(spark, log))
    assert hard_rows(hard_match(kw_of(spark, kw), log_of(spark, log), stats)) == hard(kw, log)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_indexed_match_equals_brute_force(spark, skewed, limit, tmp_path):
    kw, log = skewed
    rows = log_of(spark, log)
    got = hard_match_indexed(kw_of(spark, kw), gram_index(rows), rows, limit=limit, salts=3)
    assert hard_rows(got) == hard(kw, log)
    path = str(tmp_path / "index")
    write_gram_index(gram_index(rows), path, buckets=4)
    stored = spark.read.parquet(path)
    got = hard_match_indexed(kw_of(spark, kw), stored, rows, buckets=4, limit=limit, salts=3)
    assert hard_rows(got) == hard(kw, log)


def test_result_does_not_depend_on_partitions(spark, skewed):
    kw, log = skewed
    spread = log_of(spark, log).repartition(7, "normalized_query")
    assert hard_rows(hard_match(kw_of(spark, kw), spread)) == hard(kw, log)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_wildcards(spark, limit):
    texts = ["google maps", "go", "100% cotton", "gXgle", "a\\b", "_"]
    log = [(i, t, 1, 1, 1.0, "Australia") for i, t in enumerate(texts)]
    words = ["g%s", "go_", "%", "__", "_", "g_gl%", "0%c", "\\", "zz%"]
    kw = [(0, "t", "Australia", p, w) for p, w in enumerate(words)]
    got = hard_match(kw_of(spark, kw), log_of(spark, log), wildcards=True, limit=limit, salts=2)
    pairs = sorted((words[r.kw_pos], texts[r.id]) for r in got.collect())
    import re

    def like(word, text):
        parts = [".*" if c == "%" else "." if c == "_" else re.escape(c) for c in word.lower()]
        return re.search("".join(parts), text.replace(" ", "").lower()) is not None

    assert pairs == sorted((w, t) for w in words for t in texts if like(w, t))


@pytest.mark.parametrize("limit", [1 << 30, 0])
@pytest.mark.parametrize("floor, k", [(0.8, 100), (0.5, 4), (0.0, 5)])
def test_gram_topk_equals_brute_force(spark, skewed, limit, floor, k):
    kw, log = skewed
    got = gram_topk(kw_of(spark, kw), log_of(spark, log), k, floor, limit=limit, salts=3)
    rows = sorted((r.theme_pos, r.kw_pos, r.id, r.similarity) for r in got.collect())
    assert rows == gram_near(kw, log, k, floor)


def test_gram_topk_with_repeated_grams(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    log = [(i, t, 1, 1, 1.0, "Australia") for i, t in enumerate(texts)]
    kw = [(0, "t", "Australia", p, w) for p, w in enumerate(["aaaa", "abab", "aab", "bbbbbbb", "a"])]
    got = gram_topk(kw_of(spark, kw), log_of(spark, log), 1500, 0.7)
    rows = sorted((r.theme_pos, r.kw_pos, r.id, r.similarity) for r in got.collect())
    assert rows == gram_near(kw, log, 1500, 0.7)


@pytest.mark.parametrize(("floor", "k"), [(0.6, 100), (0.0, 7)])
def test_gram_scan_equals_the_joins(spark, skewed, floor, k):
    kw, log = skewed
    log = [*log, *[(900_000 + n, t, 1, 1, 0.0, "Australia") for n, t in enumerate(["aaaa aaaa", "日本語 日本語ñ", "x"])]]
    kw = [*kw, *[(90, "t90", "Australia", n, t) for n, t in enumerate(["aaaaaa", "日本語日本"])], (91, "t91", "nowhere", 0, "aaaa")]
    scan, join = (gram_topk(kw_of(spark, kw), log_of(spark, log), k, floor, scan_texts=n) for n in (4096, 0))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # no row for each gram of the log
    assert sorted(map(str, scan.collect())) == sorted(map(str, join.collect())) != []


def test_merge_equals_brute_force(spark, skewed):
    kw, log = skewed
    hits = match_hits(kw_of(spark, kw), log_of(spark, log))
    rows = [r.asDict() for r in hits.collect()]
    got = {
        (r.theme_pos, r.normalized_query): (r.Score, r.Relevance, r.matched_keyword, r.SRPV)
        for r in merge_hits(hits).collect()
    }
    assert got == merge(rows)


def test_contained_vector_hits_are_hard_hits(spark, skewed):
    """Except for wide spaces outside the market that strips them."""
    kw, log = skewed
    hits = match_hits(kw_of(spark, kw), log_of(spark, log)).where(
        ~F.contains("normalized_query", F.lit(WIDE)) | (F.col("market") == "Japan")
    )
    keys = ["theme_pos", "kw_pos", "id"]
    hard_hits = hits.where("method = 'hard'").select(*keys)
    clean = F.translate("normalized_query", " " + WIDE, "")
    contained = hits.where("method = 'vector'").where(
        F.contains(clean, F.translate("keyword", " " + WIDE, ""))
    )
    assert contained.count() > 0
    assert contained.join(hard_hits, keys, "left_anti").count() == 0


def test_sample_log(spark):
    log = log_of(spark, [(*r, "Australia") for r in SAMPLE])
    kw = [(0, "chatgpt", "Australia", 0, "chat gpt"), (1, "google", "Australia", 0, "google")]
    got = {
        (r.theme_pos, r.normalized_query): (r.Score, r.Relevance, r.matched_keyword)
        for r in match_themes(kw_of(spark, kw), log).collect()
    }
    assert got == {
        (0, "chat gpt"): (3, 1.0, "chat gpt"),
        (0, "chatgpt"): (3, 1.0, "chat gpt"),
        (1, "google"): (3, 1.0, "google"),
        (1, "google maps"): (2, 0.6, "google"),
    }


def test_repeated_themes_stay_apart(spark):
    log = log_of(spark, [(*r, "Australia") for r in SAMPLE])
    kw = [(p, "google", "Australia", 0, "google") for p in (0, 1)]
    assert match_themes(kw_of(spark, kw), log).groupBy("theme_pos").count().count() == 2


def test_relevance_floor_keeps_its_value(spark):
    df = spark.createDataFrame([(0.4,), (0.399999999,)], "Relevance double")
    assert [r.Relevance for r in relevance_floor(df).collect()] == [0.4]


def test_blank_keywords_are_counted(spark, skewed):
    kw, _ = skewed
    assert {r.blank_keywords for r in blank_keywords(kw_of(spark, kw)).collect()} == {2}


def test_dedup_keeps_brand_order(spark):
    rows = [(0, "t", "m", b, p, w) for b, p, w in [(1, 0, "x"), (0, 1, "y"), (0, 0, "x"), (1, 1, "z")]]
    df = spark.createDataFrame(rows, "theme_pos long, theme string, market string, brand_pos long, kw_pos long, keyword string")
    got = dedup_keywords(df).orderBy("kw_order").collect()
    assert [(r.keyword, r.brand_pos, r.kw_pos) for r in got] == [("x", 0, 0), ("y", 0, 1), ("z", 1, 1)]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_lexical_topk(spark, limit):
    log = log_of(spark, [(*r, "Australia") for r in SAMPLE])
    kw = kw_of(spark, [(0, "t", "Australia", 0, "google maps"), (0, "t", "Australia", 1, "none")])
    got = lexical_topk(kw, log, 1, limit=limit, salts=2).collect()
    assert [(r.id, r.similarity, r.distance) for r in got] == [(5, 1.0, 0.0)]


def test_posting_blocks_equal_brute_force(spark, skewed, tmp_path):
    kw, log = skewed
    rows = log_of(spark, log).repartition(3)
    for chunk, limit, rare in ((1 << 16, 1 << 26, 3), (40, 0, 2), (7, 1 << 26, 1)):
        write_blocks(posting_blocks(rows, chunk=chunk), str(tmp_path / f"{chunk}"), buckets=3)
        blocks = spark.read.parquet(str(tmp_path / f"{chunk}"))
        got = block_match(kw_of(spark, kw), blocks, rows, rare=rare, limit=limit, salts=3)
        assert hard_rows(got) == hard(kw, log)


def test_posting_blocks_hold_every_gram_once(spark, skewed):
    _, log = skewed
    blocks = posting_blocks(log_of(spark, log).coalesce(1), chunk=100).collect()
    found = []
    for b in blocks:
        ids = posting_blocks_module._decoded(b.first_id, b.n, b.steps).tolist()
        assert b.last_id == ids[-1] and all(x < y for x, y in zip(ids, ids[1:], strict=False))
        found += [(b.market, b.gram, i) for i in ids]
    index = gram_index(log_of(spark, log)).select("market", "gram", "id").collect()
    assert sorted(found) == sorted(map(tuple, index))


@pytest.mark.parametrize("ids", [[5], [0, 1, 2], [7, 300, 301], [1, 1 << 20], [3, 1 << 40, (1 << 62) + 1]])
def test_steps_in_as_few_bytes_as_needed(ids):
    coded = posting_blocks_module._coded(np.array(ids))
    assert posting_blocks_module._decoded(ids[0], len(ids), coded).tolist() == ids
    assert len(coded) == 0 if len(ids) == 1 else len(coded) // (len(ids) - 1) in (1, 2, 4, 8)


def test_posting_blocks_of_nothing(spark):
    empty, kw = log_of(spark, []), kw_of(spark, [(1, "t", "Japan", 0, "a")])
    assert posting_blocks(empty).collect() == []
    assert block_match(kw, posting_blocks(empty), empty).collect() == []
    assert block_match(kw_of(spark, []), posting_blocks(log_of(spark, [SAMPLE[0] + ("Japan",)])), empty).collect() == []


def test_intersection_reads_no_text(spark, skewed):
    kw, log = skewed
    found = block_candidates(prepare_keywords(kw_of(spark, kw)), posting_blocks(log_of(spark, log)))
    assert found.columns == ["market", "kw_fold", "id"]
    assert found.count() == found.distinct().count()


@pytest.mark.parametrize(("chunk", "limit", "rare"), [(1 << 16, 1 << 26, 3), (40, 0, 2), (7, 1 << 26, 2)])
def test_long_grams_equal_brute_force(spark, skewed, chunk, limit, rare):
    kw, log = skewed
    rows = log_of(spark, log).repartition(3)
    blocks = posting_blocks(rows, (1, 2, 3, posting_blocks_module.LONG), chunk)
    got = block_match(kw_of(spark, kw), blocks, rows, rare=rare, limit=limit, salts=3, long=posting_blocks_module.LONG)
    assert hard_rows(got) == hard(kw, log)


def test_blocks_are_not_copied_for_each_keyword(spark, skewed):
    """The blocks of a chunk meet once, however many keywords ask for them."""
    kw, log = skewed
    found = block_candidates(prepare_keywords(kw_of(spark, kw)), posting_blocks(log_of(spark, log)))
    assert "collect_list(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_block_hits_are_found_where_the_blocks_meet(spark, skewed, monkeypatch):
    """Neither candidates nor hits are joined, also where keywords are cut into groups."""
    kw, log = skewed
    kw, rows = kw[:40], log_of(spark, log)
    monkeypatch.setattr(posting_blocks_module, "LEAST_GROUP", 2000)
    got = block_match(kw_of(spark, kw), posting_blocks(rows, chunk=40), rows, limit=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") > 2
    assert hard_rows(got) == hard(kw, log)


def test_rows_of_one_id_stand_in_one_chunk(spark):
    log = [(k // 7, f"t{k % 7}", 0, 0, 0.0, "Japan") for k in range(20_005)]
    blocks = posting_blocks(log_of(spark, log).coalesce(1), (1,), chunk=10).select("chunk", "first_id", "last_id").distinct().collect()
    ends = {}
    for b in blocks:
        low, high = ends.get(b.chunk, (b.first_id, b.last_id))
        ends[b.chunk] = min(low, b.first_id), max(high, b.last_id)
    ends = sorted(ends.values())
    assert len(ends) > 1 and all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_keywords_that_fit_scan_the_log(spark, skewed):
    """No row for every letter of the log, neither to count grams nor to match."""
    kw, log = skewed
    rows = log_of(spark, log)
    got = hard_match(kw_of(spark, kw), rows)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert hard_rows(got) == hard(kw, log)
    wanted = spark.createDataFrame([("Japan", "abc"), (None, "abc")], "market string, gram string")
    assert "Generate" not in gram_counts(rows, "normalized_query", (3,), wanted, True)._jdf.queryExecution().optimizedPlan().toString()


def test_gram_scan_counts_no_grams(spark, skewed, monkeypatch):
    """Few keywords with a floor are compared in one scan, so the log's grams are not counted before."""
    kw, log = skewed
    words, rows = kw_of(spark, kw), log_of(spark, log)
    key = ["kw_pos", "theme_pos", "id", "similarity"]
    joined = sorted(map(tuple, gram_topk(words, rows, 5, 0.5, scan_texts=0).select(key).collect()))

    def counted(*_):
        raise AssertionError("grams of the log are counted")

    monkeypatch.setattr("themelift.operators.gram_match.gram_counts", counted)
    assert sorted(map(tuple, gram_topk(words, rows, 5, 0.5).select(key).collect())) == joined and joined


def test_scan_of_hidden_and_repeated_texts(spark):
    """A keyword several times in a text, across two texts, beyond the first plane, and null texts."""
    texts = ["aaaa", "aa", "a😀b😀b", None, "", "xa", "ab"]
    log = [(i, t, 0, 0, 0.0, "Japan") for i, t in enumerate(texts)]
    kw = [(1, "t", "Japan", i, k) for i, k in enumerate(["aa", "aaa", "😀b", "xaa", "b"])]
    got = hard_match(kw_of(spark, kw), log_of(spark, log)).select("keyword", "id").collect()
    assert sorted(map(tuple, got)) == [("aa", 0), ("aa", 1), ("aaa", 0), ("b", 2), ("b", 6), ("😀b", 2)]


def test_word_pairs_leave_a_batch_once(monkeypatch):
    docs = [(7, ["a", "b", "a", "b"]), (None, ["c", "a", "b"]), (3, ["b", "a", "b"])]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "words": [w for _, w in docs]})
    got = [tuple(r.values()) for b in fixtures.counted_pairs([batch]) for r in b.to_pylist()]
    assert sorted(got) == [("a b", 4, 3, None, 1), ("b a", 2, 2, 3, 0), ("c a", 1, 1, None, 0)]
    monkeypatch.setattr(fixtures, "WORDS", 4)
    split = [tuple(r.values()) for b in fixtures.counted_pairs([batch]) for r in b.to_pylist()]
    assert sorted(split, key=str) == sorted([("a b", 2, 1, 7, 0), ("b a", 1, 1, 7, 1), ("a b", 1, 1, None, 1), ("c a", 1, 1, None, 0), ("a b", 1, 1, 3, 1), ("b a", 1, 1, 3, 0)], key=str)
