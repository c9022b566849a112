"""Result layout and CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelift.schemas import RESULT_COLUMNS, RESULT_CSV
from themelift.sources.query_log import with_row_id


def result_layout(
    final: DataFrame, with_market: bool = False, raw_input: str | None = None
) -> DataFrame:
    """Columns of a result file in their fixed order: theme first, market last on request, and
    the raw input line after the theme when ``raw_input`` names its column."""
    columns = [F.col("theme").alias("SearchTheme")]
    if raw_input:
        columns.append(F.col(raw_input).alias("RawInput"))
    columns += [F.col(c) for c in RESULT_COLUMNS[1:]]
    if with_market:
        columns.append(F.col("market").alias("Market"))
    return final.select(*columns)


def write_results(df: DataFrame, path: str) -> None:
    """Write a result table as CSV parts with header; an empty table still writes the header."""
    df.write.mode("overwrite").options(header=True, escape='"', encoding="UTF-8").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result file, with ``row_no``, the place of each row in it."""
    rows = spark.read.schema(RESULT_CSV).options(header=True, escape='"', nullValue="", encoding="UTF-8").csv(path)
    return with_row_id(rows).withColumnRenamed("id", "row_no").withColumn("AI_Reason", F.coalesce("AI_Reason", F.lit("")))


def concat_runs(*runs: DataFrame) -> DataFrame:
    """Rows of several runs under each other; columns that a run lacks are null there."""
    out = runs[0]
    for other in runs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
