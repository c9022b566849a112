"""Validity labels: verdicts joined with defaults, and table-driven brand rules.

The rules label rows and never remove them. Dimension tables:
``brands(brand, parent, is_common_word)``, ``aliases(brand, alias)``, ``off_topic(brand, term)``.
Every rule adds one boolean column. A result row's brand is its theme.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelift.functions.text import clean, strip
from themelift.operators.positions import topk_per
from themelift.schemas import THEME_KEY
from themelift.sizing import Size, lookup_join, measure, stage

# Words that mark a comparison.
COMPARISON_WORDS = ["vs", "versus"]

# Reason texts of the rule labels, in the order in which the rules are tried.
REASONS = [
    ("no_identity", "Brand not named"),
    ("other_brand", "Other brand"),
    ("comparison", "Comparison with other brand"),
    ("off_topic", "Unrelated concept"),
]

# What ``with_brand`` adds to a result row.
BRAND_COLUMNS = ["forms", "form_words", "parent", "is_common_word", "terms", "clean_terms"]


def apply_verdicts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add ``AI_Valid`` and ``AI_Reason``; a row without a verdict is valid with an empty reason.

    ``verdicts``: theme_pos, normalized_query, is_valid, reason; one row per key. The key is
    unique on both sides, so the join has no hot key.
    """
    picked = verdicts.select("theme_pos", "normalized_query", "is_valid", "reason")
    return results.join(picked, ["theme_pos", "normalized_query"], "left").select(
        *results.columns,
        F.coalesce("is_valid", F.lit(True)).alias("AI_Valid"),
        F.coalesce("reason", F.lit("")).alias("AI_Reason"),
    )


def _lower(c: Column | str) -> Column:
    return F.lower(strip(F.col(c) if isinstance(c, str) else c))


def _words(c: Column | str) -> Column:
    return F.filter(F.split(_lower(c), r"(?U)\s+"), lambda w: F.length(w) > 0)


def brand_table(brands: DataFrame, aliases: DataFrame, off_topic: DataFrame | None = None) -> DataFrame:
    """One row per brand: its cleaned name forms with the longest first, the words of those forms,
    its parent, and its unrelated concepts. The lists are the brand's dictionary entries."""
    names = brands.select("brand", F.col("brand").alias("name")).unionByName(
        aliases.select("brand", F.col("alias").alias("name"))
    )
    form = clean(_lower("name"))
    longest_first = F.array_sort(F.collect_set(F.struct(-F.length(form), form.alias("form"))))
    forms = (
        names.where(F.length(form) > 0)
        .groupBy("brand")
        .agg(
            F.transform(longest_first, lambda s: s["form"]).alias("forms"),
            F.array_distinct(F.flatten(F.collect_set(_words("name")))).alias("form_words"),
        )
    )
    facts = brands.groupBy("brand").agg(
        F.min(clean(_lower("parent"))).alias("parent"),
        F.bool_or(F.coalesce("is_common_word", F.lit(False))).alias("is_common_word"),
    )
    table = facts.join(forms, "brand")
    if off_topic is None:
        none = F.lit(None).cast("array<string>")
        table = table.withColumn("terms", none).withColumn("clean_terms", none)
    else:
        concepts = off_topic.groupBy("brand").agg(
            F.collect_set(_lower("term")).alias("terms"),
            F.collect_set(clean(_lower("term"))).alias("clean_terms"),
        )
        table = table.join(concepts, "brand", "left")
    return table.select(F.col("brand").alias("theme"), *BRAND_COLUMNS)


def with_brand(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Attach the brand's entries to rows with a ``theme``; an unlisted theme is its own form."""
    if "forms" in rows.columns:
        return rows
    return (
        lookup_join(rows, table, ["theme"], "left")
        .withColumn("forms", F.coalesce("forms", F.array(clean(_lower("theme")))))
        .withColumn("form_words", F.coalesce("form_words", _words("theme")))
    )


def _residual(query: str) -> Column:
    """What is left of the cleaned lower-case text when the brand's forms are taken out."""
    return F.aggregate(
        F.col("forms"), clean(_lower(query)), lambda text, form: F.replace(text, form, F.lit(""))
    )


def _residual_words(query: str) -> Column:
    return F.filter(
        _words(query),
        lambda w: ~F.array_contains("forms", w) & ~F.array_contains("form_words", w),
    )


def label_identity(results: DataFrame, table: DataFrame) -> DataFrame:
    """``no_identity``: the query carries none of the brand's forms."""
    text = clean(_lower("normalized_query"))
    return with_brand(results, table).withColumn(
        "no_identity", ~F.exists("forms", lambda f: F.contains(text, f))
    )


def other_names(brands: DataFrame) -> tuple[DataFrame, Size]:
    """Cleaned names of all brands, and their size."""
    names = brands.select(clean(_lower("brand")).alias("_other")).distinct()
    return names.withColumn("_known", F.lit(True)), measure(brands.select("brand"))


def _names_other_brand(
    rows: DataFrame, others: tuple[DataFrame, Size], text: Column, name: str
) -> DataFrame:
    """Boolean ``name``: ``text`` is the cleaned name of another brand than the row's parent."""
    names, size = others
    keyed = rows.withColumn("_other", F.when(F.length(text) > 0, text))
    found = lookup_join(keyed, names, ["_other"], "left", size=size)
    is_parent = F.coalesce(F.col("_other") == F.col("parent"), F.lit(False))
    return found.withColumn(name, F.coalesce("_known", F.lit(False)) & ~is_parent).drop(
        "_other", "_known"
    )


def label_residual_brand(
    results: DataFrame, table: DataFrame, others: tuple[DataFrame, Size]
) -> DataFrame:
    """``other_brand``: without the brand the query is the name of another brand. The parent brand
    is allowed."""
    rows = with_brand(results, table)
    return _names_other_brand(rows, others, _residual("normalized_query"), "other_brand")


def label_comparison(
    results: DataFrame, table: DataFrame, others: tuple[DataFrame, Size]
) -> DataFrame:
    """``comparison``: the query has a comparison word, and the words besides it and the brand
    name another brand."""
    rows = with_brand(results, table)
    marks = F.array(*[F.lit(w) for w in COMPARISON_WORDS])
    rest = F.filter(_residual_words("normalized_query"), lambda w: ~F.array_contains(marks, w))
    compared = F.when(
        F.arrays_overlap(_words("normalized_query"), marks), F.array_join(rest, "")
    ).otherwise("")
    return _names_other_brand(rows, others, compared, "comparison")


def label_off_topic(results: DataFrame, table: DataFrame) -> DataFrame:
    """``off_topic``: a word of the query, or all that is left without the brand, is a listed
    unrelated concept of the brand."""
    hit = F.arrays_overlap(_residual_words("normalized_query"), F.col("terms")) | F.array_contains(
        F.col("clean_terms"), _residual("normalized_query")
    )
    return with_brand(results, table).withColumn("off_topic", F.coalesce(hit, F.lit(False)))


def rule_labels(
    results: DataFrame, brands: DataFrame, aliases: DataFrame, off_topic: DataFrame
) -> DataFrame:
    """Add ``is_valid`` and ``reason`` by the first failing rule; rows that pass all are valid."""
    table = stage(brand_table(brands, aliases, off_topic), "brands")
    others = other_names(brands)
    rows = label_identity(results, table)
    rows = label_residual_brand(rows, table, others)
    rows = label_comparison(rows, table, others)
    rows = label_off_topic(rows, table)
    reason = F.coalesce(*[F.when(F.col(flag), F.lit(text)) for flag, text in REASONS])
    return rows.select(
        *results.columns,
        reason.isNull().alias("is_valid"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def keyword_guard(
    keywords: DataFrame, brands: DataFrame, aliases: DataFrame, off_topic: DataFrame
) -> DataFrame:
    """Drop expanded keywords that lose or widen the brand: keywords of a common-word brand must
    contain the brand and none of its unrelated concepts, and no keyword may be the parent."""
    rows = with_brand(keywords, brand_table(brands, aliases, off_topic))
    text = clean(_lower("keyword"))
    named = F.contains(text, clean(_lower("theme")))
    unrelated = F.coalesce(F.arrays_overlap(_words("keyword"), F.col("terms")), F.lit(False))
    upward = F.coalesce(text == F.col("parent"), F.lit(False))
    common = F.coalesce("is_common_word", F.lit(False))
    return rows.where((~common | (named & ~unrelated)) & ~upward).select(*keywords.columns)


def keyword_cap(keywords: DataFrame, n: int = 15) -> DataFrame:
    """At most ``n`` keywords per theme, shorter ones first. Opt-in: the cap is a request to the
    model, the matcher itself takes every keyword."""
    return topk_per(
        keywords, THEME_KEY, [F.length("keyword"), F.col("kw_pos"), F.col("keyword")], n
    )
