"""Ranked search over blocks against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare, connect

from themelift.llm import lexical_blocks as lb
from themelift.llm.queries import ORACLE, QUERIES

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string, doc_id string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t, _ in docs]
    found = [x for x in found if x[2]]
    n, total = len(found), sum(x[2] for x in found)
    df = Counter(t for x in found for t in x[1])
    out = []
    for item, text, _ in items:
        asked, scored = Counter(terms(text)), []
        for i, own, size in found:
            m = 25 + 75 * size * n // total
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m))
                for t, c in asked.items()
                if own[t]
            )
            if score > 0:
                scored.append((-score, lb.NO_ID if i is None else i))
        out += [(item, rank, None if i == lb.NO_ID else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def tables(seed, n):
    rng = random.Random(seed)
    topics = [[f"{a}{t}{k}" for k in range(12) for a in ("É", "w", "Q日")] for t in range(6)]
    common = ["the", "The", "of", "and1", "ñ"]

    def text(size):
        topic = rng.choice(topics)
        return " ".join(rng.choice(common if rng.random() < 0.4 else topic) for _ in range(size))

    docs = [(k, text(rng.randrange(60)), 7) for k in range(n)]
    copy = text(50)
    docs += [(1000 + k, copy + rng.choice(["", ".", "!"]), None) for k in range(n // 3)]
    docs += [(None, text(20), 1), (5, None, 1), (6, "", 1), (7, " .-\n", 1), (8, "the " * 3000 + text(4000), 1), (3, docs[3][1], 2)]
    items = [(k, text(rng.randrange(1, 30)), "x") for k in range(25)]
    items += [(90, copy, None), (91, None, None), (92, "", None), (93, "nowhere", None), (94, "the the of", None), (90, copy, None), (None, "the wt01 w11", None)]
    return docs, items


@pytest.mark.parametrize("shape", [{}, {"block": 3, "short": 4, "shard_rows": 40}, {"block": 1, "short": 1, "shard_rows": 1000}, {"short": 10**6}])
def test_equals_scores_of_all(spark, shape):
    docs, items = tables(len(shape), 400)
    found = lb.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **shape)
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items)


def test_items_in_parts_and_other_k(spark):
    docs, items = tables(8, 150)
    found = lb.ranked_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=3, item_bytes=2000, block=4, short=6)
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = tables(1, 20)
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lb.ranked_search(none[0], spark.createDataFrame(items, ITEMS)).collect() == []
    assert lb.ranked_search(spark.createDataFrame(docs, DOCS), none[1]).collect() == []


def test_sql(spark, tmp_path):
    docs, items = tables(21, 300)
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = connect("/root/testdata/sf0.001")
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(QUERIES["op11_ranked_search"](spark, str(tmp_path)), con, ORACLE["op11_ranked_search"]) == ""


def shard_of(seed, rows=300, size=80, **shape):
    rng = np.random.default_rng(seed)
    each = [np.unique(rng.integers(0, size, rng.integers(0, 15))) for _ in range(rows)]
    at = np.append(0, np.cumsum([len(x) for x in each]))
    found = np.concatenate(each)
    values = lb.component(rng.integers(1, 5, len(found)), rng.integers(25, 400, len(found)))
    weights = rng.integers(0, 9000, size)
    return lb.build_shard(np.arange(rows) * 7, at, found, values, weights, **shape), weights


def test_blocks_partition_lists_and_summaries_bound_them():
    shard, weights = shard_of(1, block=5, short=6)
    shard = lb.Shard.unpack(dict(zip(lb.Shard.KINDS, shard.pack(), strict=True)))
    vectors = np.zeros((len(shard.ids), len(weights)), np.int64)
    vectors[np.repeat(np.arange(len(shard.ids)), np.diff(shard.at)), shard.terms] = shard.values
    summaries, own = shard.summaries(), np.cumsum(shard.bounded) - 1
    lists = [[] for _ in weights]
    for b, t in enumerate(shard.block_term):
        rows = shard.members[shard.block_at[b] : shard.block_at[b + 1]]
        lists[t] += rows.tolist()
        if shard.bounded[b]:
            highest = vectors[rows].max(axis=0)
            level = summaries[own[b]].astype(np.int64) * lb.LEVEL
            assert (level >= highest).all() and (level - highest < lb.LEVEL).all()
    assert [sorted(x) for x in lists] == [np.flatnonzero(vectors[:, t]).tolist() for t in range(len(weights))]
    assert (np.bincount(shard.block_term, minlength=len(weights)) > 1).any()


def test_blocks_are_skipped():
    """Documents of one topic share blocks, so items of another topic skip them."""
    topics, each = 8, 60
    rows = [np.sort(np.append(0, 1 + t * 10 + np.random.default_rng(k * topics + t).permutation(10)[:6])) for t in range(topics) for k in range(each)]
    at = np.append(0, np.cumsum([len(x) for x in rows]))
    found = np.concatenate(rows)
    weights = np.full(1 + 10 * topics, 5000)
    shard = lb.build_shard(np.arange(len(rows)), at, found, np.full(len(found), 500_000), weights, block=16, short=16)
    item = np.array([0, 1, 2, 3, 4, 5, 6]), np.ones(7, np.int64)
    best = lb.Best([item], weights, 10)
    best.search(shard)
    assert best.walked["skipped"] > 0 and best.walked["scored"] < len(rows)
    score = [int(np.isin(r, item[0]).sum()) * 5000 * 500_000 for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (-score[k], k))[:10]
    assert best.found[0][1].tolist() == order
