"""Request and reply tables of the external language model.

Requests go out as rows and replies come back as rows; the model itself is never called here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.functions.text import FULL_SPACE, HALF_SPACE, strip
from themelift.operators.merge import rank
from themelift.schemas import THEME_KEY, VERDICT_MAP
from themelift.sizing import lookup_join
from themelift.sources.markets import language_plan

BATCH_SIZE = 25

# Reasons of verdicts that stand in for a missing or unreadable reply.
EMPTY_REASON = "Validation failed (Empty Response: {})"
PARSE_REASON = "Validation failed (Parse Error)"
API_REASON = "Validation failed (API Error)"

# Markets whose keywords are also needed with the other kind of space.
SPACE_VARIANT_MARKETS = ("Japan",)


def expansion_requests(brands: DataFrame, dim: DataFrame) -> DataFrame:
    """One request text per brand. ``brands``: theme_pos, theme, market, brand_pos, brand."""
    plan = language_plan(dim)
    rows = lookup_join(brands, plan, ["market"], "left")
    languages = F.when(
        F.coalesce("english_only", F.lit(True)), F.lit("Write every keyword in English.")
    ).otherwise(
        F.format_string(
            "Write keywords in %s. Put %s first and add English forms of international names.",
            F.col("language_list"),
            F.col("primary_language"),
        )
    )
    text = F.format_string(
        "List up to 15 short search keywords for the brand or product \"%s\" as people in %s "
        "would type them. %s Answer with a JSON array of strings and nothing else.",
        F.col("brand"),
        F.col("market"),
        languages,
    )
    return rows.select("theme_pos", "theme", "market", "brand_pos", "brand", text.alias("request"))


def validation_chunks(results: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Result rows with ``rank_pos`` and ``batch_index``: consecutive groups of ``size`` in result
    order, per theme."""
    return rank(results).withColumn(
        "batch_index", F.floor(F.col("rank_pos") / F.lit(size)).cast("bigint")
    )


def validation_requests(results: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """One request per chunk: the brand and the JSON list of its queries, which is ``size`` long
    at most."""
    chunks = validation_chunks(results, size)
    ordered = F.array_sort(F.collect_list(F.struct("rank_pos", "normalized_query")))
    return (
        chunks.groupBy(*THEME_KEY, "batch_index")
        .agg(F.transform(ordered, lambda s: s["normalized_query"]).alias("queries"))
        .withColumn("queries_json", F.to_json("queries"))
        .withColumn("n_queries", F.size("queries").cast("bigint"))
        .withColumn(
            "request", F.concat(F.lit("Brand: "), F.col("theme"), F.lit("\nQueries: "), F.col("queries_json"))
        )
    )


def reply_with(
    requests: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
) -> DataFrame:
    """Hook for a model client: ``fn`` gets batches of the request table and yields them with the
    columns ``content`` and ``finish_reason`` added."""
    schema = T.StructType(
        requests.schema.fields
        + [T.StructField("content", T.StringType()), T.StructField("finish_reason", T.StringType())]
    )
    return requests.mapInPandas(fn, schema)


def _json_array(content: Column) -> Column:
    """Array of the text between the first [ and the last ], code fences removed; null if there is
    none, if it is broken, or if it is empty."""
    bare = F.replace(F.replace(content, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    inner = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    items = F.from_json(
        F.nullif(inner, F.lit("")), "array<string>", {"allowSingleQuotes": "false"}
    )
    return F.when(F.exists(items, lambda x: x.isNotNull()), items)


def space_variants(keyword: Column, market: Column) -> Column:
    """Array of a keyword's spellings. In the listed markets the stripped keyword is followed by
    its forms with the other kind of space; blank keywords give no spelling there."""
    word = strip(keyword)
    spellings = F.array_distinct(
        F.array(
            word,
            F.replace(word, F.lit(HALF_SPACE), F.lit(FULL_SPACE)),
            F.replace(word, F.lit(FULL_SPACE), F.lit(HALF_SPACE)),
        )
    )
    none = F.filter(spellings, lambda w: F.length(w) > 0)
    return F.when(market.isin(*SPACE_VARIANT_MARKETS), none).otherwise(F.array(keyword))


def parse_expansion(replies: DataFrame) -> DataFrame:
    """Keyword rows of expansion replies. ``replies``: theme_pos, theme, market, brand_pos, brand,
    content. A reply without a usable list stands for the brand itself."""
    keywords = F.coalesce(_json_array(F.col("content")), F.array(F.col("brand")))
    spelled = F.flatten(
        F.transform(
            F.filter(keywords, lambda k: k.isNotNull()),
            lambda k: space_variants(k, F.col("market")),
        )
    )
    key = ["theme_pos", "theme", "market", "brand_pos"]
    return replies.select(*key, F.posexplode(F.array_distinct(spelled)).alias("kw_pos", "keyword"))


def _json_object(content: Column) -> Column:
    return F.regexp_extract(content, r"(?s)\{.*\}", 0)


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """Verdict rows of validation replies: one per entry of the object between the first { and
    the last }. ``replies``: theme_pos, batch_index, content."""
    verdicts = F.from_json(
        F.nullif(_json_object(F.col("content")), F.lit("")),
        VERDICT_MAP,
        {"allowSingleQuotes": "false"},
    )
    return replies.select(
        "theme_pos", "batch_index", F.explode(verdicts).alias("normalized_query", "verdict")
    ).select("theme_pos", "batch_index", "normalized_query", "verdict.is_valid", "verdict.reason")


def merge_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per theme and query; the one of the last batch wins."""
    return (
        verdicts.groupBy("theme_pos", "normalized_query")
        .agg(F.max_by(F.struct("is_valid", "reason"), "batch_index").alias("v"))
        .select("theme_pos", "normalized_query", "v.is_valid", "v.reason")
    )


def verdict_defaults(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdict rows of every request, readable reply or not.

    ``requests``: theme_pos, batch_index, queries. ``replies``: theme_pos, batch_index, content,
    finish_reason. Queries of a request without a readable reply are valid, with the reason that
    tells what went wrong; a readable reply gives its own entries.
    """
    content = strip(F.col("content"))
    found = _json_object(content)
    verdicts = F.from_json(F.nullif(found, F.lit("")), VERDICT_MAP, {"allowSingleQuotes": "false"})
    missing = F.coalesce(F.length("content"), F.lit(0)) == 0
    reason = (
        F.when(F.col("answered").isNull(), F.lit(API_REASON))
        .when(
            missing,
            F.format_string(EMPTY_REASON.format("%s"), F.coalesce("finish_reason", F.lit("None"))),
        )
        .when(F.length(found) == 0, F.lit(PARSE_REASON))
        .when(verdicts.isNull(), F.lit(API_REASON))
    )
    # Of several replies to one request (a retry) one is read, the longest and then the last in order.
    reply = F.struct(F.coalesce(F.length("content"), F.lit(0)), "content", "finish_reason")
    answers = (
        replies.groupBy("theme_pos", "batch_index")
        .agg(F.max(reply).alias("reply"))
        .select("theme_pos", "batch_index", "reply.content", "reply.finish_reason", F.lit(True).alias("answered"))
    )
    joined = requests.select("theme_pos", "batch_index", "queries").join(
        answers, ["theme_pos", "batch_index"], "left"
    )
    default = F.map_from_arrays(
        F.array_distinct("queries"),
        F.transform(
            F.array_distinct("queries"),
            lambda _: F.struct(F.lit(True).alias("is_valid"), reason.alias("reason")),
        ),
    )
    chosen = F.when(reason.isNull(), verdicts).otherwise(default)
    return joined.select(
        "theme_pos", "batch_index", F.explode(chosen).alias("normalized_query", "v")
    ).select("theme_pos", "batch_index", "normalized_query", "v.is_valid", "v.reason")


def _request_key(theme: Column) -> Column:
    return F.lower(strip(theme))


def pending_requests(requests: DataFrame, answered: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Distinct requests that have no answer yet: the text is compared stripped and lower-cased.

    Both sides are reduced to distinct keys first, so repeated requests cost one row per task.
    """
    on = [*keys, "request_key"]
    wanted = requests.withColumn("request_key", _request_key(F.col(text))).select(*on).distinct()
    have = answered.withColumn("request_key", _request_key(F.col(text))).select(*on).distinct()
    return wanted.join(have, on, "left_anti")


def reused_requests(
    requests: DataFrame, answered: DataFrame, text: str, keys: list[str], answer: str, latest: str
) -> DataFrame:
    """Requests that were answered before, with their latest answer."""
    on = [*keys, "request_key"]
    have = (
        answered.withColumn("request_key", _request_key(F.col(text)))
        .groupBy(*on)
        .agg(F.max_by(answer, latest).alias(answer))
    )
    wanted = requests.withColumn("request_key", _request_key(F.col(text)))
    return lookup_join(wanted, have, on)
