import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from themelift.operators.vector_match import lsh_pairs, vector_topk, vector_topk_lsh, vector_verify
from themelift.plans.pipeline import match_hits
from themelift.sources.query_log import attach_metrics
from themelift.sources.vectors import build_vectors, encode
from themelift.schemas import KEYWORD_KEY

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KW = "theme_pos long, theme string, market string, kw_pos long, keyword string, vec array<float>"
DIM = 8


@pytest.fixture(scope="module")
def tables(spark):
    """Unit vectors; a third of the log are copies of one vector."""
    rng = np.random.default_rng(1)
    log = rng.normal(size=(1500, DIM)).astype(np.float32)
    log[::3] = log[0]
    log /= np.linalg.norm(log, axis=1, keepdims=True)
    words = np.concatenate([log[:1], log[1:3], rng.normal(size=(9, DIM)).astype(np.float32)])
    words /= np.linalg.norm(words, axis=1, keepdims=True)
    markets = ["A" if i % 2 else "B" for i in range(len(log))]
    q = spark.createDataFrame(
        [(m, i, v.tolist()) for i, (m, v) in enumerate(zip(markets, log))],
        "market string, id long, vec array<float>",
    )
    kw = spark.createDataFrame(
        [(0, "t", "AB"[p % 2], p, f"k{p}", v.tolist()) for p, v in enumerate(words)], KW
    )
    return kw, q, words, log, markets


def brute(words, log, markets, k, floor=None):
    out = []
    for p, w in enumerate(words):
        sims = np.round(log.astype(float) @ w.astype(float), 9)
        rows = [(-s, i) for i, s in enumerate(sims) if markets[i] == "AB"[p % 2]]
        rows = [r for r in rows if floor is None or -r[0] >= floor]
        out += [(p, i, -s) for s, i in sorted(rows)[:k]]
    return sorted(out)


def rows_of(df):
    return sorted((r.kw_pos, r.id, r.similarity) for r in df.collect())


@pytest.mark.parametrize("chunk_bytes", [1 << 25, 400])
@pytest.mark.parametrize("k, floor", [(10, None), (100, 0.8), (2000, None)])
def test_topk_is_exact(spark, tables, chunk_bytes, k, floor):
    kw, q, words, log, markets = tables
    got = vector_topk(kw, q.repartition(5), k, floor, chunk_bytes)
    ours, want = rows_of(got), brute(words, log, markets, k, floor)
    assert [r[:2] for r in ours] == [r[:2] for r in want]
    assert [r[2] for r in ours] == pytest.approx([r[2] for r in want], abs=1e-8)


def test_empty_keywords(spark, tables):
    kw, q, *_ = tables
    assert vector_topk(kw.where("kw_pos < 0"), q).count() == 0


def test_lsh_recall(spark, tables):
    kw, q, *_ = tables
    exact = vector_topk(kw, q, 10, 0.7).select("kw_pos", "id")
    near = vector_topk_lsh(kw, q, 10, 0.7, bits=6).select("kw_pos", "id")
    found = exact.join(near, ["kw_pos", "id"]).count()
    assert found / exact.count() > 0.9


def test_lsh_compares_few_pairs(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(200, 64))
    rows = np.repeat(centers, 10, axis=0) + rng.normal(size=(2000, 64)) * 0.4
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    q = spark.createDataFrame([("B", i, v.tolist()) for i, v in enumerate(rows)], "market string, id long, vec array<float>")
    kw = spark.createDataFrame([(i, f"t{i}", "B", 0, f"k{i}", rows[10 * i].tolist()) for i in range(100)], KW)
    pairs = lsh_pairs(kw, q, 0.8, 12).select("theme_pos", "id")
    assert pairs.count() == pairs.distinct().count() <= 0.1 * 100 * 2000
    exact = vector_topk(kw, q, 100, 0.8).select("theme_pos", "id", "similarity")
    near = vector_topk_lsh(kw, q, 100, 0.8).select("theme_pos", "id", "similarity")
    both = exact.join(near, ["theme_pos", "id", "similarity"]).count()
    assert both == near.count() and both >= 0.95 * exact.count() > 500


def test_lsh_shuffles_and_copies_no_vector(spark, tables):
    """The log is scanned, whatever the number of tables, and groups of keywords give the same pairs."""
    kw, q, *_ = tables
    pairs = lsh_pairs(kw, q, 0.7, 8)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    key = ["theme_pos", "kw_pos", "id", "similarity"]
    whole = sorted(map(tuple, pairs.select(key).collect()))
    parts = lsh_pairs(kw, q, 0.7, 8, chunk_bytes=1 << 11)
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") > 1
    assert sorted(map(tuple, parts.select(key).collect())) == whole and whole


def test_attach_drops_unknown_ids(spark, tables):
    kw, q, *_ = tables
    log = spark.createDataFrame(
        [("B", 0, "q", 1, 2, 3.0)], "market string, id long, normalized_query string, SRPV long, AdClick long, revenue double"
    )
    hits = vector_topk(kw.where("kw_pos = 1"), q, 2000)
    for bound in (None, 2000):
        assert [r.id for r in attach_metrics(hits, log, bound).collect()] == [0]


def test_verify_floor_and_rules(spark):
    cols = KEYWORD_KEY + ["id", "normalized_query", "SRPV", "AdClick", "revenue", "similarity"]
    rows = [
        (0, "t", "m", 0, "abcdef", 1, "abcdex", 1, 1, 1.0, 0.8),
        (0, "t", "m", 0, "abcdef", 2, "abcdex", 1, 1, 1.0, 0.799999999),
        (0, "t", "m", 0, "abcdef", 3, "xx abc def", 1, 1, 1.0, 0.9),
        (0, "t", "m", 0, "abcdef", 4, "ABCDEF", 1, 1, 1.0, 0.9),
    ]
    got = vector_verify(spark.createDataFrame(rows, cols)).collect()
    assert sorted((r.id, r.relevance) for r in got) == [(1, 0.8), (3, 0.9)]


def _letters(texts):
    out = np.zeros((len(texts), 26), dtype=np.float32)
    for i, text in enumerate(texts):
        for c in text:
            if "a" <= c <= "z":
                out[i, ord(c) - 97] += 1
    return out


def test_encoder_hook_feeds_the_match(spark):
    log = spark.createDataFrame(
        [("m", 0, "chat gpt", 1, 1, 1.0), ("m", 1, "chatgqt", 1, 1, 1.0), ("m", 2, "zzz", 1, 1, 1.0)],
        "market string, id long, normalized_query string, SRPV long, AdClick long, revenue double",
    )
    vecs = build_vectors(log, _letters)
    assert vecs.select(F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 5).alias("n")).distinct().first()["n"] == 1.0
    kw = spark.createDataFrame([(0, "t", "m", 0, "chatgpt")], KW.rsplit(",", 1)[0])
    kw_vecs = build_vectors(
        kw.withColumn("id", F.col("kw_pos")).withColumn("normalized_query", F.col("keyword")), _letters
    ).join(kw, "market")
    hits = match_hits(kw, log, kw_vecs, vecs)
    got = sorted((r.id, r.method) for r in hits.collect())
    assert got == [(0, "hard"), (0, "vector"), (1, "vector")]


def test_encode_batches(spark):
    df = spark.createDataFrame([("ab",), ("b",)], "t string")
    assert [r.v[1] for r in encode(df, _letters, "t", "v").collect()] == [1.0, 1.0]


def test_grid_scans_each_side_once(spark, tables):
    kw, q, *_ = tables
    plan = vector_topk(kw, q, 5, None, 400)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "FlatMapCoGroupsInArrow" in plan


def test_grid_with_one_sided_markets_and_nulls(spark):
    kw = spark.createDataFrame([(0, "t", m, p, f"k{p}", v) for p, (m, v) in enumerate([("A", [1.0, 0.0]), ("C", [1.0, 0.0]), ("A", None), ("A", [0.0, 1.0])])], KW)
    q = spark.createDataFrame([("A", 1, [1.0, 0.0]), ("A", 2, [0.0, 1.0]), ("B", 3, [1.0, 0.0]), ("A", 4, None)], "market string, id long, vec array<float>")
    for chunk_bytes in (1 << 25, 40):
        assert rows_of(vector_topk(kw, q, 1, None, chunk_bytes)) == [(0, 1, 1.0), (3, 2, 1.0)]
    assert vector_topk(kw, q.limit(0), 1, None, 40).collect() == []
