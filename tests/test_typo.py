"""The typo join against the edit distance of every pair."""

import random

import pytest
from pyspark.sql import functions as F

from themelift.operators import typo_match, typo_scan
from themelift.operators.keywords import prepare_keywords

LOG = "market string, id long, normalized_query string, SRPV long, AdClick long, revenue double"
KW = "theme_pos long, theme string, market string, kw_pos long, keyword string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def cleaned(t):
    return t.replace(" ", "").replace("　", "")


def edited(rng, text, edits, letters):
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        case = rng.randrange(3)
        if case == 0:
            text = text[:at] + rng.choice(letters) + text[at:]
        elif text:
            at = min(at, len(text) - 1)
            text = text[:at] + (rng.choice(letters) if case == 1 else "") + text[at + 1 :]
    return text


def made(seed, letters, lengths, per=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in lengths for _ in range(per)]
    texts = list(words)
    for w in words:
        most = -(-len(w) // 5) - 1
        texts += [edited(rng, w, rng.randrange(most + 2), letters) for _ in range(8)]
    texts = [t[:k] + " " + t[k:] for t in texts for k in [rng.randrange(len(t) + 1)]]
    return words, texts


def tables(spark, words, texts):
    kw = [(k % 3, f"t{k % 3}", "m" if k % 5 else "n", k, w) for k, w in enumerate(words)]
    log = [("m" if k % 7 else "n", k, t, 1, 2, 0.5) for k, t in enumerate(texts)] + [("m", 10**6, None, 1, 1, 0.0), ("m", 10**6 + 1, " ", 1, 1, 0.0)]
    return spark.createDataFrame(kw, KW), spark.createDataFrame(log, LOG), kw, log


def plain(kw, log):
    out = []
    for pos, theme, market, k, w in kw:
        for m, i, t, *_ in log:
            if m == market and t is not None and w and cleaned(w):
                a, b = cleaned(t), cleaned(w)
                if abs(len(a) - len(b)) < len(b) / 5 and (e := distance(a, b)) < len(b) / 5:
                    out.append((pos, theme, market, k, w, i, e))
    return sorted(out)


def rows(found):
    return sorted((r.theme_pos, r.theme, r.market, r.kw_pos, r.keyword, r.id, r.edits) for r in found.collect())


@pytest.mark.parametrize(("seed", "letters"), [(1, "ab"), (2, "abcdefghij"), (3, "aéß日ñ"), (4, "a")])
def test_all_lengths(spark, seed, letters):
    words, texts = made(seed, letters, range(1, 34))
    kw, log, *raw = tables(spark, [*words, "", " "], texts)
    want = plain(*raw)
    assert rows(typo_match.typo_join(kw, log)) == want and len(want) > 200
    assert max(e for *_, e in want) >= 4


def test_long_texts_shuffled_and_stored(spark, tmp_path):
    words, texts = made(9, "abcdefghijklmnop", (45, 58, 81), 2)
    kw, log, *raw = tables(spark, words, texts)
    typo_match.typo_index(log).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    want = plain(*raw)
    assert rows(typo_match.typo_join(kw, log, index)) == want
    assert rows(typo_match.typo_join(kw, log, limit=0)) == want


def test_scan_makes_no_row_for_a_part(spark, monkeypatch):
    """Neither parts nor candidates are exploded, joined or shuffled, and groups of keywords, whose
    lengths and slices are many, give the same typos; so do keywords that are too long for the scan."""
    words, texts = made(7, "abcdef", (6, 12, 17), 4)
    kw, log, *raw = tables(spark, words, texts)
    want = plain(*raw)
    monkeypatch.setattr(typo_scan, "LEAST_GROUP", 4_000)
    found = typo_match.typo_join(kw, log, limit=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Generate", "Join", "Aggregate", "Repartition")) and plan.count("MapInArrow") > 3
    assert rows(found) == want
    assert any(slices > 1 for *_, slices in typo_scan._groups({n: 4 for n in (6, 12, 17)}, 0))
    for module in (typo_scan, typo_match):
        monkeypatch.setattr(module, "LONGEST", 16)
    assert rows(typo_match.typo_join(kw, log)) == want


def test_similarity_and_repeated_keywords(spark):
    kw = spark.createDataFrame([(1, "a", "m", 0, "running"), (2, "b", "m", 0, "run ning"), (2, "b", "m", 1, "running")], KW)
    log = spark.createDataFrame([("m", 1, "runing", 5, 1, 0.5), ("m", 2, "run nin　gs", 5, 1, 0.5), ("m", 2, "runnin", 7, 1, 0.5), ("x", 3, "running", 5, 1, 0.5)], LOG)
    found = typo_match.typo_join(kw, log)
    assert found.count() == 9
    assert {r.similarity for r in found.collect()} == {round(6 / 7, 9)}


def test_index_rows_grow_with_letters(spark):
    log = spark.createDataFrame([("m", n, "x" * 0 + "".join(chr(97 + (k * k + n) % 26) for k in range(n)), 1, 1, 0.0) for n in (6, 12, 40, 300)], LOG)
    for r in typo_match.typo_index(log).groupBy("id").agg(F.count("part").alias("n")).collect():
        assert r.n <= 1.5 * r.id + 2


def test_keyword_parts_stay_few(spark):
    words = ["abcdefgh", "abcdefghijkl", "abcdefghijklmnopqrstuvwx"]
    kw = prepare_keywords(spark.createDataFrame([(1, "t", "m", k, w) for k, w in enumerate(words)], KW))
    assert {r.kw_clean: r["count"] < 3000 for r in typo_match.keyword_parts(kw).groupBy("kw_clean").count().collect()} == dict.fromkeys(words, True)
    assert typo_match.typo_join(kw.drop("kw_clean", "kw_fold").limit(0), spark.createDataFrame([], LOG)).collect() == []


def test_no_nested_loop(spark):
    words, texts = made(5, "abcdef", (8, 14))
    kw, log, *_ = tables(spark, words, texts)
    plan = typo_match.typo_join(kw, log)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keyword_parts_are_made_by_many_tasks(spark):
    kw = prepare_keywords(spark.createDataFrame([(1, "t", "m", k, f"abcdefgh{k}") for k in range(50)], KW))
    assert "REPARTITION_BY_NUM" in typo_match.keyword_parts(kw)._jdf.queryExecution().executedPlan().toString()


def test_parts_are_made_of_rows_within_reach(spark):
    """Few keywords: a row whose length or letters no keyword allows is not taken apart."""
    log = spark.createDataFrame([("m", i, t, 0, 0, 0.0) for i, t in enumerate(["abcdef", "abcdeg", "abcdefgh", "uvwxyz", "", "abcdeyz"])], LOG)
    kw = prepare_keywords(spark.createDataFrame([(0, "t", "m", 0, "abcdef"), (0, "t", None, 1, "uvwxyz")], KW))
    assert sorted(r.id for r in typo_match._alike(typo_match._lettered(log), kw).collect()) == [0, 1]
