import pytest
from pyspark.sql import functions as F

from themelift.functions import text, vectors

WIDE = "　"


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first()["x"]


def test_clean_strips_both_spaces(spark):
    assert one(spark, text.clean(F.col("q")), q=f"ナイキ{WIDE}シュ ーズ") == "ナイキシューズ"


@pytest.mark.parametrize(
    "market, expected", [("Japan", "ナイキシューズ"), ("Australia", f"ナイキ{WIDE}シューズ")]
)
def test_stored_text_keeps_wide_space_outside_japan(spark, market, expected):
    got = one(spark, text.clean_for_market(F.col("q"), F.col("m")), q=f"ナイ キ{WIDE}シューズ", m=market)
    assert got == expected


def test_fold_touches_ascii_only(spark):
    assert one(spark, text.fold(F.col("q")), q="NIKE É") == "nike É"


@pytest.mark.parametrize(
    "q, k, expected",
    [
        ("nike running shoes", "nike", 0.25),
        ("nikeairmax", "nike air max", 1.0),
        ("耐克鞋", "耐克", 2 / 3),
        ("", "nike", 0.0),
        ("nike", " " + WIDE, 0.0),
        ("a", "abcd", 1.0),
    ],
)
def test_hard_relevance(spark, q, k, expected):
    assert one(spark, text.hard_relevance(F.col("q"), F.col("k")), q=q, k=k) == expected


@pytest.mark.parametrize(
    "q, k, plain, wild",
    [
        ("Google Maps", "glem", True, True),
        ("google maps", "g%s", False, True),
        ("100% cotton", "0%c", True, True),
        ("google", "go_gle", False, True),
        ("o'brien", "O'B", True, True),
        ("a\\b", "\\", True, True),
        ("É", "é", False, False),
    ],
)
def test_hard_predicate(spark, q, k, plain, wild):
    args = F.col("q"), F.col("k"), F.lit("Australia")
    assert one(spark, text.hard_predicate(*args), q=q, k=k) is plain
    assert one(spark, text.hard_predicate(*args, wildcards=True), q=q, k=k) is wild


@pytest.mark.parametrize(
    "q, k, expected",
    [
        ("abcde", "abcde", True),
        ("abcdx", "abcde", False),
        ("abcdex", "abcdef", True),
        ("abcdefghix", "abcdefghij", True),
        ("abcdefghxx", "abcdefghij", False),
        ("abcdefghijx", "abcdefghxxk", False),
        ("abcdefghixx", "abcdefghijk", True),
        ("chat gpt", "chatgpt", True),
        ("é", "e", False),
    ],
)
def test_typo_lengths(spark, q, k, expected):
    assert one(spark, text.typo(F.col("q"), F.col("k")), q=q, k=k) is expected


def test_strip_is_unicode_aware(spark):
    assert one(spark, text.strip(F.col("q")), q=f"{WIDE}\t nike air \n{WIDE}") == "nike air"


def test_l2_keeps_zero_vector(spark):
    assert one(spark, vectors.l2(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.l2(F.col("v")), v=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.to_similarity(vectors.to_distance(F.lit(0.8))), v=1) == 0.8
