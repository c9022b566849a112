"""Size checks that decide between a broadcast and a salted shuffle, and staging of tables.

Nothing in the library broadcasts a side by assumption: the side is measured first, and every
caller has a shuffle form for the case that the measurement is above the limit.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
# Rows of one key that are too many for one task.
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        return self.bytes <= limit


def _width(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(column, "")), F.lit(0)) + 24 * F.greatest(
                F.coalesce(F.size(column), F.lit(0)), F.lit(0)
            )
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * 8 + 16
    if isinstance(field.dataType, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 32
    return F.lit(8)


def measure(df: DataFrame) -> Size:
    """Row count and approximate bytes of a table: one small aggregate job."""
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        width = width + _width(field)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return Size(int(row["n"]), int(row["b"]))


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
    size: Size | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join whose left side may have one key on a third of its rows.

    The right side is broadcast when it measures below ``limit``. Beyond that the keys of the left
    side are counted. Rows of keys with over ``hot_rows`` rows are dealt in turn over salts, one for
    every ``hot_rows`` rows of the key and ``salts`` at least, and only the right side's rows of those
    keys, which are few, are copied once per salt; all other rows are joined as they are. ``how`` is
    one of inner, left, left_semi, left_anti.
    """
    size = size or measure(small)
    if size.fits(limit):
        return big.join(F.broadcast(small), on, how)
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    # Not more than one row for every ``hot_rows`` rows of the left side.
    needed = F.greatest(F.lit(salts), F.ceil(F.col("_n") / hot_rows)).cast("int").alias("_salts")
    hot = stage(counts.where((F.col("_n") > hot_rows) & _whole(on)).select(*on, needed), "hot-keys")
    if hot.isEmpty():
        return big.join(small, on, how)
    # By row number, so that equal rows part too.
    in_turn = F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int")
    salt = F.when(F.col("_salts").isNotNull(), in_turn).otherwise(0)
    spread_big = big.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_salts")
    every = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    copied = small.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return spread_big.join(copied, on + ["_salt"], how).drop("_salt")


def _whole(on: list[str]) -> Column:
    """Keys that can match at all."""
    test = F.lit(True)
    for c in on:
        test = test & F.col(f"`{c}`").isNotNull()
    return test


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared checkpoint folder of the session.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, and where that is unset a
    folder below the session's warehouse, which executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", reader: SparkSession | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut in the lineage that survives
    the loss of executors, and a scan that later jobs can repeat cheaply. It is read in the session
    ``reader``, by default that of the table."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)
