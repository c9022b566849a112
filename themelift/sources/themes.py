"""Theme lists: one theme per line, and raw lines of the form ``brand/suffix``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelift.functions.text import strip


def read_themes(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a UTF-8 text file, white space stripped at both ends."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("theme"))
    return lines.where(F.length("theme") > 0)


def clean_theme(df: DataFrame, raw: str = "raw_input") -> DataFrame:
    """Brand = stripped text before the first slash; raw text kept, empty brands dropped."""
    line = strip(F.col(raw))
    return (
        df.withColumn(raw, line)
        .withColumn("brand", strip(F.split_part(F.col(raw), F.lit("/"), F.lit(1))))
        .where((F.length(raw) > 0) & (F.length("brand") > 0))
    )
