"""A query-log store that grows by increments.

An increment takes the files below a path that the store does not have yet, gives their rows ids
after those of the rows before, and writes the rows and what is derived from them (gram counts,
posting blocks, typo index) to folders of its own; nothing written earlier is touched. The manifest
names the increment's files, and it is written last: an increment that is not in it is not there for
any reader, and the next one replaces it. Derived tables of increments add up: counts are summed,
blocks and index rows stand beside each other.

Answers of the language model are kept in the same way: writers only append, and a reader takes the
last answer of each request.

Defined results: a file is known by its path; one that is known and has another length raises, for
its rows are stored already. A call without new files writes nothing. Files are taken in path order,
and rows without text count for the ids but are not kept, as in one scan of all files. One writer at
a time for each market.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.operators.gram_match import query_gram_stats, with_gram_text
from themelift.operators.hard_match import gram_stats
from themelift.operators.posting_blocks import posting_blocks
from themelift.operators.typo_match import typo_index
from themelift.schemas import QUERY_LOG_CSV
from themelift.sources.query_log import read_query_log, with_match_text

MANIFEST = "market string, batch int, path string, length long, first_id long, n_rows long"
#: Tables of an increment, made from its stored rows.
DERIVED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "gram_stats": gram_stats,
    "query_gram_stats": query_gram_stats,
    "blocks": posting_blocks,
    "typos": typo_index,
}
BATCH_BITS = 44  # above the numbers of an increment's own chunks


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _place(store: str, table: str, market: str, batch: int) -> str:
    return f"{store.rstrip('/')}/{table}/market={market}/batch={batch}"


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """market, batch, path, length, first_id and n_rows (of the increment) of every file that is in."""
    path = f"{store.rstrip('/')}/manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def new_files(spark: SparkSession, store: str, market: str, paths: str | list[str]) -> DataFrame:
    """path and length of the files that the market does not have."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")
    known = manifest(spark, store).where(F.col("market") == market).select("path", F.col("length").alias("known"))
    rows = listed.join(known, "path", "left")
    changed = rows.where(F.col("known").isNotNull() & (F.col("known") != F.col("length"))).first()
    if changed:
        raise ValueError(f"{changed['path']} is stored with {changed['known']} bytes and has {changed['length']} now")
    return rows.where(F.col("known").isNull()).select("path", "length")


def ingest(spark: SparkSession, store: str, market: str, paths: str | list[str]) -> int | None:
    """Add the files below ``paths`` that are new to a market's log; the increment's number, or
    nothing if there are none."""
    files = new_files(spark, store, market, paths).orderBy("path").collect()  # names, as a scan takes them
    if not files:
        return None
    past = manifest(spark, store).where(F.col("market") == market)
    last = past.select(F.max(F.struct("batch", "first_id", "n_rows")).alias("x")).first()["x"]
    batch, first_id = (last["batch"] + 1, last["first_id"] + last["n_rows"]) if last else (0, 0)
    names = [f["path"] for f in files]
    n_rows = spark.read.schema(QUERY_LOG_CSV).options(header=True, escape='"', nullValue="", encoding="UTF-8").csv(names).count()
    rows = read_query_log(spark, names, market, row_id=True).withColumn("id", F.col("id") + first_id)
    rows = with_gram_text(with_match_text(rows))
    rows.drop("market").write.mode("overwrite").parquet(_place(store, "rows", market, batch))
    stored = spark.read.schema(rows.drop("market").schema).parquet(_place(store, "rows", market, batch)).withColumn("market", F.lit(market))
    for name, make in DERIVED.items():
        make(stored).drop("market").write.mode("overwrite").parquet(_place(store, name, market, batch))
    entries = [(f["path"], f["length"], first_id, n_rows) for f in files]
    lines = spark.createDataFrame(entries, "path string, length long, first_id long, n_rows long")
    lines.coalesce(1).write.mode("overwrite").parquet(_place(store, "manifest", market, batch))
    return batch


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """``rows`` or a derived table over all increments of the manifest, gram counts summed."""
    there = manifest(spark, store).select("market", "batch").distinct().collect()  # a row for each increment
    parts = [_place(store, name, r["market"], r["batch"]) for r in there]
    if not parts:
        raise ValueError(f"nothing was ingested into {store}")
    table = spark.read.option("basePath", f"{store.rstrip('/')}/{name}").parquet(*parts)
    table = table.withColumn("market", F.col("market").cast(T.StringType()))
    if name in ("gram_stats", "query_gram_stats"):
        return table.groupBy("market", "gram").agg(F.sum("n").alias("n"))
    if name == "blocks":
        table = table.withColumn("chunk", F.shiftleft(F.col("batch").cast("long"), BATCH_BITS) + F.col("chunk"))
    return table.drop("batch")


def add_answers(answers: DataFrame, store: str) -> None:
    """Append answered requests: market, request_key, answer and answered_at."""
    answers.select("market", "request_key", "answer", "answered_at").write.mode("append").parquet(f"{store.rstrip('/')}/answers")


def last_answers(spark: SparkSession, store: str) -> DataFrame:
    """The last answer of each request; of several at one time the last in text order."""
    rows = spark.read.parquet(f"{store.rstrip('/')}/answers")
    best = F.max(F.struct("answered_at", "answer")).alias("x")
    return rows.groupBy("market", "request_key").agg(best).select("market", "request_key", "x.answer", "x.answered_at")
