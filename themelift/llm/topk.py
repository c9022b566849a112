"""Exact top-k search by tiled matrix products of queries and shards of vectors.

Vectors become integers (floor of ``SCALE`` times each component); scores are integer inner
products. Queries and vectors are dealt over a grid: a query goes to one row of tiles, a vector to
one column, and each tile is a task that multiplies its queries with its vectors block by block and
keeps k candidates for each query by partial selection. The lists of a query are then merged by a
tree: lists of a few columns at a time, until one is left. The grid's rows are as many as queries
need to fit in a tile, its columns as many as vectors need.

Products run in floating point while that is exact (all partial sums below 2**53), otherwise in
Python's integers.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
neither do rows without an id. Vectors of another length than the query's are no candidates.
Repeated ids: a row is a candidate of a query if their ids differ; a query id that occurs in
several rows is searched for each of them, and its best results are those of all of them. Every pair
of a query row and a vector row counts: copies of a row take a rank each, as in the SQL. Scores
beyond 64 bits are given as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelift.llm.common import tidy

SCALE = 256
TILE_QUERIES = 8192
TILE_VECTORS = 65_536
BLOCK = 2048  # vectors multiplied at once
FAN_IN = 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v, the integer components as doubles, of vectors that take part. A double of 2**52 or
    more has no fraction, so that its floor is itself."""
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("x") > 0) & finite)

    def floor(c: Column) -> Column:
        c = c * SCALE
        return F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)

    return rows.select("id", F.transform("x", floor).alias("v"))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows given as doubles."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    if most < 2.0**53:
        return queries @ vectors.T
    return np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in v] for v in vectors], object).T


def best_of(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple[int, int, object]]:
    """The k best candidates of each query; of equal scores the smaller ids."""
    if scores.dtype == object:
        for q, row in zip(queries.tolist(), scores, strict=True):
            found = sorted((-s, i) for s, i in zip(row, ids.tolist(), strict=True) if i != q)[:k]
            yield from ((q, i, -s) for s, i in found)
        return
    scores = np.where(queries[:, None] == ids[None, :], -np.inf, scores)
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    n = len(ids)
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
    else:
        least = np.full(len(queries), -np.inf)
    for at, q in enumerate(queries.tolist()):
        found = np.flatnonzero((scores[at] >= least[at]) & (scores[at] > -np.inf))
        for place in found[np.argsort(-scores[at][found], kind="stable")][:k].tolist():
            yield q, int(ids[place]), int(scores[at][place])


def merged(rows: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """The k best of each query among rows of query, id and score."""
    by: dict[int, list[tuple[int, int]]] = {}
    for q, i, s in rows:
        by.setdefault(q, []).append((-s, i))
    return [(q, i, -s) for q, found in by.items() for s, i in sorted(found)[:k]]


def tile_lists(dealt: DataFrame, k: int) -> DataFrame:
    """Rows of query_id, tile_column, vec_id and score: the lists of every tile. A task reads the
    queries of a tile first and then its vectors, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, queries, block, found = None, [], [], []

        def multiply() -> None:
            nonlocal found
            for width in {len(v) for _, v in block}:
                own = [(i, v) for i, v in queries if len(v) == width]
                vectors = [(i, v) for i, v in block if len(v) == width]
                if own:
                    q = np.array([i for i, _ in own], np.int64)
                    ids = np.array([i for i, _ in vectors], np.int64)
                    scores = products(np.array([v for _, v in own]), np.array([v for _, v in vectors]))
                    found += best_of(q, ids, scores, k)
            block.clear()
            if len(found) > 4 * k * max(len(queries), 1):
                found = merged(found, k)

        def lists() -> Iterator[pa.RecordBatch]:
            multiply()
            rows = [(q, here[1], i, min(max(s, LEAST), MOST)) for q, i, s in merged(found, k)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "tile_column", "vec_id", "score"])

        for batch in batches:
            r, c, side, ids = (batch.column(i).to_pylist() for i in range(4))
            values = batch.column(4)
            flat, ends = values.flatten().to_numpy(), np.cumsum(values.value_lengths().to_numpy())
            for at in range(len(r)):
                if here != (r[at], c[at]):
                    if here is not None:
                        yield from lists()
                    here, queries, block, found = (r[at], c[at]), [], [], []
                v = flat[ends[at - 1] if at else 0 : ends[at]]
                if side[at] == 0:
                    queries.append((ids[at], v))
                elif queries:
                    block.append((ids[at], v))
                    if len(block) >= BLOCK:
                        multiply()
        if here is not None:
            yield from lists()

    return dealt.mapInArrow(tidy(run), "query_id long, tile_column long, vec_id long, score long")


def merge_tree(lists: DataFrame, k: int, columns: int) -> DataFrame:
    """Merge the lists of each query, a few columns at a time, until each query has one list."""
    entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("order"), "vec_id", "score")
    rows = lists.select("query_id", "tile_column", entry.alias("e"))
    while True:
        columns = -(-columns // FAN_IN)
        rows = rows.groupBy("query_id", F.floor(F.col("tile_column") / FAN_IN).alias("tile_column")).agg(
            F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("best")
        )
        if columns <= 1:
            return rows.select("query_id", F.posexplode("best").alias("at", "e")).select(
                "query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score"
            )
        rows = rows.select("query_id", "tile_column", F.explode("best").alias("e"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, tile_queries: int = TILE_QUERIES, tile_vectors: int = TILE_VECTORS) -> DataFrame:
    """query_id, rank, vec_id and score. Both tables have columns id and v (see
    ``integer_vectors``); a query is no candidate of itself."""
    spark = vectors.sparkSession
    least_tasks = spark.sparkContext.defaultParallelism
    n = vectors.count()
    tile_rows = max(1, -(-queries.count() // tile_queries))
    tile_columns = max(1, -(-n // tile_vectors), min(least_tasks, -(-n // BLOCK)))
    spread = F.xxhash64("id", "v")
    across = F.explode(F.sequence(F.lit(0), F.lit(tile_columns - 1))).alias("c")
    down = F.explode(F.sequence(F.lit(0), F.lit(tile_rows - 1))).alias("r")
    asked = queries.select(F.pmod(spread, F.lit(tile_rows)).cast("int").alias("r"), across, F.lit(0).alias("side"), "id", "v")
    held = vectors.select(down, F.pmod(spread, F.lit(tile_columns)).cast("int").alias("c"), F.lit(1).alias("side"), "id", "v")
    dealt = asked.select("r", "c", "side", "id", "v").union(held.select("r", "c", "side", "id", "v"))
    dealt = dealt.repartition(tile_rows * tile_columns, "r", "c").sortWithinPartitions("r", "c", "side")
    return merge_tree(tile_lists(dealt, k), k, tile_columns)
