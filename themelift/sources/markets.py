"""The market dimension: languages, codes, encoders and table names per market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelift.sizing import lookup_join

# Market, two-letter code, languages with the primary one first, encoder.
ENGLISH_ENCODER = "all-MiniLM-L6-v2"
MULTILINGUAL_ENCODER = "paraphrase-multilingual-MiniLM-L12-v2"
MARKETS = [
    ("Australia", "au", ["English"], ENGLISH_ENCODER),
    ("Japan", "jp", ["Japanese", "English"], MULTILINGUAL_ENCODER),
    ("India", "in", ["English", "Hindi"], MULTILINGUAL_ENCODER),
    ("Singapore", "sg", ["English", "Chinese", "Malay"], MULTILINGUAL_ENCODER),
    ("Malaysia", "my", ["Malay", "English", "Chinese"], MULTILINGUAL_ENCODER),
    ("Thailand", "th", ["Thai", "English"], MULTILINGUAL_ENCODER),
    ("Philippines", "ph", ["English", "Filipino"], ENGLISH_ENCODER),
    ("Indonesia", "id", ["Indonesian", "English"], MULTILINGUAL_ENCODER),
    ("Vietnam", "vn", ["Vietnamese", "English"], MULTILINGUAL_ENCODER),
    ("China", "cn", ["Chinese", "English"], MULTILINGUAL_ENCODER),
]
DEFAULT_MARKET = "Australia"
DEFAULT_LANGUAGES = ["English"]

MARKET_SCHEMA = (
    "market string, code string, languages array<string>, encoder string, "
    "log_path string, dedicated_table string, search_index string"
)


def markets(
    spark: SparkSession, root: str = "", dedicated_tables: dict[str, str] | None = None
) -> DataFrame:
    """The shipped market dimension. ``root`` is the folder of the materialised logs."""
    tables = dedicated_tables or {}
    rows = [
        (name, code, languages, encoder, f"{root}/market={name}", tables.get(name), f"keywords-{code}")
        for name, code, languages, encoder in MARKETS
    ]
    return spark.createDataFrame(rows, MARKET_SCHEMA)


def resolve_market(
    themes: DataFrame, dim: DataFrame, default_market: str = DEFAULT_MARKET
) -> DataFrame:
    """Attach the market's settings to every row of ``themes``.

    A market without an entry reads the default market's log, speaks English, uses the English
    encoder, has no dedicated table and names its search index after itself.
    """
    default_path = dim.where(F.col("market") == default_market).select(
        F.col("log_path").alias("_default_path")
    )
    settings = dim.withColumn("is_configured", F.lit(True))
    joined = lookup_join(themes, settings, ["market"], "left")
    # The default entry is one literal row; it is read once and becomes a constant of the plan.
    row = default_path.first()
    fallback = F.lit(row["_default_path"] if row else None)
    return joined.select(
        *[F.col(f"`{c}`") for c in themes.columns],
        F.coalesce("is_configured", F.lit(False)).alias("is_configured"),
        F.coalesce("code", F.lower("market")).alias("code"),
        F.coalesce("languages", F.array(*[F.lit(x) for x in DEFAULT_LANGUAGES])).alias("languages"),
        F.coalesce("encoder", F.lit(ENGLISH_ENCODER)).alias("encoder"),
        F.coalesce("log_path", fallback).alias("log_path"),
        F.col("dedicated_table"),
        F.coalesce("search_index", F.concat(F.lit("keywords-"), F.lower("market"))).alias(
            "search_index"
        ),
    )


def language_plan(dim: DataFrame) -> DataFrame:
    """Per market: whether expansion is English only, the language list and the primary one."""
    english_only = (F.size("languages") == 1) & (F.element_at("languages", 1) == "English")
    return dim.select(
        "market",
        english_only.alias("english_only"),
        F.array_join("languages", ", ").alias("language_list"),
        F.element_at("languages", 1).alias("primary_language"),
        F.size("languages").cast("bigint").alias("n_languages"),
    )
