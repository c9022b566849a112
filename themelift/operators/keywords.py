"""Preparation of keyword tables: clean forms, probe grams, de-duplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelift.functions.grams import GRAM, counted_grams, explode_grams
from themelift.functions.text import clean, fold
from themelift.schemas import KEYWORD_KEY
from themelift.sizing import BROADCAST_BYTES, Size


# Upper estimate of a (market, gram) row in memory.
GRAM_ROW_BYTES = 64


def prepare_keywords(keywords: DataFrame) -> DataFrame:
    """Keyword rows with their clean and folded forms; keywords that clean to '' are dropped."""
    return (
        keywords.select(*KEYWORD_KEY)
        .withColumn("kw_clean", clean(F.col("keyword")))
        .withColumn("kw_fold", fold(F.col("kw_clean")))
        .where(F.length("kw_clean") > 0)
    )


def blank_keywords(keywords: DataFrame) -> DataFrame:
    """Per theme, the number of keywords that ``prepare_keywords`` drops."""
    blank = F.coalesce(F.length(clean(F.col("keyword"))), F.lit(0)) == 0
    return keywords.groupBy("theme_pos", "theme").agg(
        F.count_if(blank).cast("bigint").alias("blank_keywords")
    )


@dataclass(frozen=True)
class KeywordProfile:
    size: Size
    gram_sizes: tuple[int, ...]
    has_free: bool

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        return self.size.fits(limit)


def profile_keywords(prepared: DataFrame, literal: str) -> KeywordProfile:
    """Size of a keyword table and the probe-gram sizes that its texts need: one small job.

    ``literal`` is the column the probe grams are taken from. Texts shorter than a gram are probed
    whole; an empty literal (a keyword of wildcards only) is ``has_free``.
    """
    length = F.length(literal)
    # A keyword row, and one for each gram of its text.
    width = F.octet_length("keyword") * 4 + F.octet_length("theme") + 96 + length * GRAM_ROW_BYTES
    row = prepared.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(width), F.lit(0)).alias("b"),
        *[F.count_if(length == n).alias(f"n{n}") for n in range(GRAM)],
        F.count_if(length >= GRAM).alias(f"n{GRAM}"),
    ).first()
    sizes = tuple(n for n in range(1, GRAM + 1) if row[f"n{n}"]) or (GRAM,)
    return KeywordProfile(Size(int(row["n"]), int(row["b"])), sizes, bool(row["n0"]))


def keyword_grams(prepared: DataFrame, literal: str, long: int | None = None) -> DataFrame:
    """Distinct (market, literal) texts with every gram of size 3, or the whole text if shorter, or,
    of texts that have ``long`` letters, every gram of that size; ``gram_at`` is the 1-based place of
    the gram in the literal."""
    texts = prepared.select("market", literal).distinct().where(F.length(literal) > 0)
    size = F.least(F.length(literal), F.lit(GRAM))
    if long:
        size = F.when(F.length(literal) >= long, F.lit(long)).otherwise(size)
    return texts.withColumn(
        "gram_at", F.explode(F.sequence(F.lit(1), F.length(literal) - size + 1))
    ).withColumn("gram", F.substr(F.col(literal), F.col("gram_at"), size))


def gram_counts(
    texts: DataFrame, text: str, sizes: tuple[int, ...], wanted: DataFrame | None, fits: bool
) -> DataFrame:
    """(market, gram, n): occurrences of grams in the log, of the ``wanted`` grams only if given.

    A wanted set that fits a broadcast is counted in one scan of the texts. Otherwise all grams are
    counted first, because their partial sums take the weight out of hot grams.
    """
    if wanted is not None and fits:
        return counted_grams(texts, text, wanted)
    grams = explode_grams(texts.select("market", text), text, sizes).select("market", "gram")
    counts = grams.groupBy("market", "gram").agg(F.count(F.lit(1)).alias("n"))
    if wanted is not None:
        counts = counts.join(wanted, ["market", "gram"], "left_semi")
    return counts


def rarest_gram(grams: DataFrame, counts: DataFrame, literal: str) -> DataFrame:
    """One probe gram per (market, literal): the rarest one in the log. Texts with a gram that the
    log lacks cannot match and drop out."""
    counted = grams.join(counts, ["market", "gram"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
    return (
        counted.groupBy("market", literal)
        .agg(F.min(F.struct("n", "gram_at", "gram")).alias("probe"))
        .where(F.col("probe.n") > 0)
        .select("market", literal, "probe.gram", "probe.gram_at")
    )


def dedup_keywords(keywords: DataFrame) -> DataFrame:
    """Keep the first occurrence of each keyword of a theme; brands are taken in brand order.

    Input: theme_pos, theme, market, brand_pos, kw_pos, keyword. The result orders by
    (brand_pos, kw_pos), and ``kw_order`` packs both into one number.
    """
    first = F.min(F.struct("brand_pos", "kw_pos"))
    return (
        keywords.groupBy("theme_pos", "theme", "market", "keyword")
        .agg(first.alias("first"))
        .select(
            "theme_pos",
            "theme",
            "market",
            "keyword",
            F.col("first.brand_pos").cast("bigint").alias("brand_pos"),
            F.col("first.kw_pos").cast("bigint").alias("kw_pos"),
            (F.col("first.brand_pos").cast("bigint") * 1_000_000 + F.col("first.kw_pos")).alias(
                "kw_order"
            ),
        )
    )
