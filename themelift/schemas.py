"""Column layouts of the tables that enter and leave the library."""

from __future__ import annotations

from pyspark.sql import types as T

# One row of a market's query-log CSV, in file column order.
QUERY_LOG_CSV = T.StructType(
    [
        T.StructField("normalized_query", T.StringType()),
        T.StructField("SRPV", T.LongType()),
        T.StructField("AdClick", T.LongType()),
        T.StructField("revenue", T.DoubleType()),
    ]
)

QUERY_LOG = T.StructType(
    [T.StructField("id", T.LongType())]
    + QUERY_LOG_CSV.fields
    + [T.StructField("market", T.StringType())]
)

KEYWORDS = T.StructType(
    [
        T.StructField("theme_pos", T.LongType()),
        T.StructField("theme", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("kw_pos", T.LongType()),
        T.StructField("keyword", T.StringType()),
    ]
)

THEME_REQUEST = T.StructType(
    [
        T.StructField("theme_pos", T.LongType()),
        T.StructField("theme", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)
VERDICT_MAP = T.MapType(T.StringType(), VERDICT)

# Columns that name one theme, one keyword, and the metrics of a log row.
THEME_KEY = ["theme_pos", "theme", "market"]
KEYWORD_KEY = THEME_KEY + ["kw_pos", "keyword"]
METRICS = ["SRPV", "AdClick", "revenue"]
HIT_COLUMNS = KEYWORD_KEY + ["id", "normalized_query"] + METRICS + ["method", "relevance"]

# Column order of a result file.
RESULT_COLUMNS = [
    "SearchTheme",
    "normalized_query",
    "Relevance",
    "SRPV",
    "AdClick",
    "revenue",
    "Score",
    "matched_keyword",
    "AI_Valid",
    "AI_Reason",
]

RESULT_CSV = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in zip(
            RESULT_COLUMNS,
            [T.StringType(), T.StringType(), T.DoubleType(), T.LongType(), T.LongType(), T.DoubleType(),
             T.IntegerType(), T.StringType(), T.BooleanType(), T.StringType()],
            strict=True,
        )
    ]
)
