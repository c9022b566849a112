"""Query-log ingest: CSV scan, row ids, materialised store and external logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelift.functions.text import clean_for_market, fold
from themelift.schemas import METRICS, QUERY_LOG_CSV
from themelift.sizing import BROADCAST_BYTES, lookup_join, stage

# Upper estimate of one hit row in memory, for bounds that are known before the hits are.
HIT_BYTES = 256


def read_query_log(
    spark: SparkSession, path: str, market: str, multi_line: bool = False, row_id: bool = False
) -> DataFrame:
    """Scan a query-log CSV with header. Rows without query text are dropped; texts such as
    ``NA`` or ``null`` are data. Files split across tasks unless ``multi_line`` is set, which
    only logs with line breaks inside quotes need. ``row_id`` adds the row's place in the file,
    dropped rows counted."""
    rows = (
        spark.read.schema(QUERY_LOG_CSV)
        .options(header=True, escape='"', nullValue="", multiLine=multi_line, encoding="UTF-8")
        .csv(path)
        .withColumn("market", F.lit(market))
    )
    if row_id:
        rows = with_row_id(rows)
    return rows.where(F.length("normalized_query") > 0)


def with_row_id(scan: DataFrame) -> DataFrame:
    """Add ``id``: the 0-based position of the row in its files, files taken in path order.

    Works on a file scan. Rows of one file block are consecutive within one task, so the position
    is the block's offset plus the place inside the block; offsets come from one count per block.
    """
    placed = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_seq", F.monotonically_increasing_id())
    blocks = placed.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first")
    )
    # Running sums in three levels, none of which meets one task whole: blocks within a file, files
    # within a range of files, and the ranges, of which there are as many as tasks.
    blocks = stage(blocks, "blocks")
    before = "rows between unbounded preceding and 1 preceding), 0)"
    files = blocks.groupBy("_file").agg(F.sum("_rows").alias("_file_rows"))
    ranged = stage(files.repartitionByRange("_file").withColumn("_range", F.spark_partition_id()), "files")
    ranges = ranged.groupBy("_range").agg(F.sum("_file_rows").alias("_range_rows"))
    range_start = ranges.selectExpr("_range", f"coalesce(sum(_range_rows) over (order by _range {before} as _range_start")
    file_start = ranged.selectExpr(
        "_file", "_range", f"coalesce(sum(_file_rows) over (partition by _range order by _file {before} as _file_start"
    ).join(F.broadcast(range_start), "_range")
    block_start = blocks.selectExpr(
        "_file",
        "_block",
        "_first",
        f"coalesce(sum(_rows) over (partition by _file order by _block {before} as _block_start",
    )
    shift = F.col("_range_start") + F.col("_file_start") + F.col("_block_start") - F.col("_first")
    offsets = block_start.join(file_start, "_file").select("_file", "_block", shift.alias("_shift"))
    # Staged, so that the count scan runs once for the size check and the join together.
    return lookup_join(placed, stage(offsets, "row-offsets"), ["_file", "_block"]).select(
        (F.col("_seq") + F.col("_shift")).alias("id"), *[F.col(f"`{c}`") for c in scan.columns]
    )


def with_match_text(log: DataFrame) -> DataFrame:
    """Add the text that the substring match reads, so that it is computed once at ingest."""
    if "match_text" in log.columns:
        return log
    return log.withColumn(
        "match_text", fold(clean_for_market(F.col("normalized_query"), F.col("market")))
    )


def _is_complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def materialize(log: DataFrame, path: str, market: str) -> bool:
    """Write one market's log below ``path`` unless a finished copy is there already.

    Only the presence of the commit marker counts as finished, so a write that was cut off is
    done again. Returns True when this call wrote the data.
    """
    target = f"{path.rstrip('/')}/market={market}"
    if _is_complete(log.sparkSession, target):
        return False
    rows = with_match_text(log.where(F.col("market") == market)).drop("market")
    rows.write.mode("overwrite").parquet(target)
    return True


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The materialised logs of all markets; a filter on ``market`` prunes folders."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/market=*")


def adapt_external(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Bring an external log (``Id, TargetMarket, Query, Srpv``) to the query-log columns; metrics
    that it does not carry are 0. The market dimension (market, code) names the market of a code;
    rows of other codes are not of a known market and go."""
    codes = dim.select(F.col("code").alias("TargetMarket"), "market").distinct()
    return lookup_join(df, codes, ["TargetMarket"]).select(
        F.col("Id").cast("bigint").alias("id"),
        F.col("Query").alias("normalized_query"),
        F.col("Srpv").cast("bigint").alias("SRPV"),
        F.lit(0).cast("bigint").alias("AdClick"),
        F.lit(0.0).alias("revenue"),
        "market",
    )


def external_log(shared: DataFrame, dedicated: dict[str, DataFrame], dim: DataFrame) -> DataFrame:
    """The external logs of all markets as one query log: a market whose dimension row names a
    dedicated table is read from that, whole, every other market from the shared table."""
    own = dim.where(F.col("dedicated_table").isNotNull())
    common = adapt_external(shared, dim.where(F.col("dedicated_table").isNull()))
    logs = [common]
    for name, table in dedicated.items():
        logs.append(adapt_external(table, own.where(F.col("dedicated_table") == name)))
    return append_logs(*logs)


def market_slice(df: DataFrame, code: str | None, dedicated: bool = False) -> DataFrame:
    """Rows of one market of a shared table; a dedicated table is taken whole."""
    return df if dedicated else df.where(F.col("TargetMarket") == code)


def append_logs(*logs: DataFrame) -> DataFrame:
    """Union of logs whose optional columns may differ."""
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def attach_metrics(hits: DataFrame, log: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Add query text and metrics to (market, id) rows; ids without a log row vanish.

    ``max_hits`` is the caller's proven bound on the rows of ``hits`` (k times the number of
    keywords for a top-k). When that many rows fit a broadcast the log is not shuffled.
    """
    rows = log.select("market", "id", "normalized_query", *METRICS)
    if max_hits is not None and max_hits * HIT_BYTES <= BROADCAST_BYTES:
        hits = F.broadcast(hits)
    return rows.join(hits, ["market", "id"]).select(*_names(hits), "normalized_query", *METRICS)


def _names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("normalized_query", *METRICS)]
