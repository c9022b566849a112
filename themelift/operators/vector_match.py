"""Nearest neighbours of keyword vectors among log vectors, and their verification."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelift.functions.text import contained, typo
from themelift.functions.vectors import DIGITS
from themelift.operators.positions import topk_per
from themelift.schemas import HIT_COLUMNS, KEYWORD_KEY
from themelift.sizing import measure

# The task code below travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_SIM = 0.8
TOP_K = 100
RECALL = 0.97
CHUNK_BYTES = 32 * 1024 * 1024


# Elements of one block product.
BLOCK = 4_000_000
# Candidate pairs whose vectors are multiplied at a time.
COMPARED = 50_000


class _BestPerKeyword:
    """Running top-k rows per keyword of one task, for one market's keyword matrix."""

    def __init__(self, matrix: np.ndarray, k: int, floor: float):
        self.matrix, self.k = matrix, k
        self.bar = np.full(len(matrix), floor)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, BLOCK // len(self.matrix))
        for at in range(0, len(ids), step):
            self._add_block(ids[at : at + step], vectors[at : at + step])

    def _add_block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scale = 10.0**DIGITS
        sims = np.rint(self.matrix @ vectors.T.astype(np.float64) * scale) / scale
        if sims.shape[1] > self.k:
            kth = np.partition(sims, -self.k, axis=1)[:, -self.k]
            self.bar = np.maximum(self.bar, kth)
        kw, at = np.nonzero(sims >= self.bar[:, None])
        if len(kw):
            self.kept.append((kw, ids[at], sims[kw, at]))
            self.pending += len(kw)
            if self.pending > 4 * self.k * len(self.matrix):
                self.compact()

    def compact(self) -> None:
        if not self.kept:
            return
        kw, ids, sims = (np.concatenate(part) for part in zip(*self.kept))
        order = np.lexsort((ids, -sims, kw))
        kw, ids, sims = kw[order], ids[order], sims[order]
        place = np.arange(len(kw)) - np.searchsorted(kw, kw, side="left")
        last = place == self.k - 1
        self.bar[kw[last]] = np.maximum(self.bar[kw[last]], sims[last])
        keep = place < self.k
        self.kept = [(kw[keep], ids[keep], sims[keep])]
        self.pending = int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.compact()
        return self.kept[0] if self.kept else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as an (n, d) array; all lists have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _scan_chunk(
    q_vecs: DataFrame, kw_vecs: DataFrame, k: int, min_sim: float | None
) -> DataFrame:
    """Per task, the k best log rows of every keyword of one chunk.

    The chunk's size was measured by the caller. The scan of the log is a single pass without a
    shuffle; at most k rows per keyword leave a task, none of them below the floor.
    """
    chunk = kw_vecs.select(*KEYWORD_KEY, "vec").toArrow()
    by_market = {}
    for market in pc.unique(chunk["market"]).to_pylist():
        part = chunk.filter(pc.equal(chunk["market"], market))
        by_market[market] = (part.select(KEYWORD_KEY), _matrix(part["vec"]).astype(np.float64))
    shared = q_vecs.sparkSession.sparkContext.broadcast(by_market)
    floor = -np.inf if min_sim is None else min_sim
    schema = kw_vecs.select(*KEYWORD_KEY).schema.add("id", "long").add("similarity", "double")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, _BestPerKeyword] = {}
        for batch in batches:
            for market in pc.unique(batch.column("market")).to_pylist():
                if market not in shared.value:
                    continue
                rows = batch.filter(
                    pc.and_(pc.equal(batch.column("market"), market), pc.is_valid(batch.column("vec")))
                )
                if market not in state:
                    state[market] = _BestPerKeyword(shared.value[market][1], k, floor)
                if rows.num_rows:
                    state[market].add(rows.column("id").to_numpy(), _matrix(rows.column("vec")))
        for market, running in state.items():
            kw, ids, sims = running.result()
            out = shared.value[market][0].take(pa.array(kw))
            out = out.append_column("id", pa.array(ids, pa.int64()))
            out = out.append_column("similarity", pa.array(sims, pa.float64()))
            yield from out.to_batches()

    return q_vecs.select("market", "id", "vec").mapInArrow(best, schema)


def _best_of_tile(keywords: pa.Table, rows: pa.Table, k: int, floor: float, schema: list[str]) -> pa.Table:
    """The k best rows of a tile's log vectors for each of its keywords."""
    running = _BestPerKeyword(_matrix(keywords["vec"]).astype(np.float64), k, floor)
    running.add(rows["id"].to_numpy(), _matrix(rows["vec"]))
    kw, ids, sims = running.result()
    out = keywords.select(KEYWORD_KEY).take(pa.array(kw))
    out = out.append_column("id", pa.array(ids, pa.int64())).append_column("similarity", pa.array(sims, pa.float64()))
    return out.select(schema)


def _grid(q_vecs: DataFrame, kw: DataFrame, k: int, min_sim: float | None, blocks: int, stripes: int) -> DataFrame:
    """Each tile's k best rows of every keyword: keywords are dealt into blocks and log vectors into
    stripes of a measured size, and a task has one of each. A side is scanned once and copied to the
    tiles of its row or column of the grid."""
    kw = kw.withColumn("_block", F.pmod(F.xxhash64(*KEYWORD_KEY), F.lit(blocks)).cast("int"))
    kw = kw.withColumn("_stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    rows = q_vecs.select("market", "id", "vec").where(F.col("vec").isNotNull())
    rows = rows.withColumn("_stripe", F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int"))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = kw.select(*KEYWORD_KEY).schema.add("id", "long").add("similarity", "double")
    floor, names = (-np.inf if min_sim is None else min_sim), schema.fieldNames()
    none = pa.table({f.name: pa.array([], {"string": pa.string(), "double": pa.float64()}.get(f.dataType.typeName(), pa.int64())) for f in schema.fields})

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_of_tile(left, right, k, floor, names) if len(left) and len(right) else none

    tile = ["market", "_block", "_stripe"]
    return kw.groupBy(*tile).cogroup(rows.groupBy(*tile)).applyInArrow(best, schema)


def vector_topk(
    kw_vecs: DataFrame,
    q_vecs: DataFrame,
    k: int = TOP_K,
    min_sim: float | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The ``k`` log rows nearest to each keyword by cosine of unit vectors, exact.

    ``kw_vecs``: keyword columns and ``vec``; ``q_vecs``: market, id, ``vec``. Keywords that fit
    ``chunk_bytes`` go to every task of the log's scan, which compares them in block products, so
    neither side is shuffled. More keywords meet the log in a grid of tiles of measured size (see
    ``_grid``). Either way a task hands on k rows for each keyword at most, and the lists are cut
    again before and after their shuffle. A floor is applied inside the tasks too: rows below it
    never rank before rows above it, so the result is the one of filtering afterwards. Ties go to
    the lower id. Null vectors take no part.
    """
    kw = kw_vecs.select(*KEYWORD_KEY, "vec").where(F.col("vec").isNotNull())
    blocks = -(-measure(kw).bytes // chunk_bytes) or 1
    if blocks == 1:
        best = _scan_chunk(q_vecs, kw, k, min_sim)
    else:
        stripes = -(-measure(q_vecs.select("id", "vec")).bytes // chunk_bytes) or 1
        best = _grid(q_vecs, kw, k, min_sim, blocks, stripes)
    return topk_per(best, KEYWORD_KEY, [F.col("similarity").desc(), F.col("id")], k)


def tables_for(bits: int, min_sim: float, recall: float) -> int:
    """Signature tables that find a pair at the floor with probability ``recall``, if a table finds
    it where at most one of its bits differs."""
    agree = 1.0 - math.acos(min_sim) / math.pi
    once = agree**bits + bits * (1.0 - agree) * agree ** (bits - 1)
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - once)))


def _signs(matrix: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Of each vector and table the sides of ``bits`` planes that the vector lies on."""
    sides = (matrix @ planes[: matrix.shape[1]] >= 0).reshape(len(matrix), -1, bits)
    return (sides * (1 << np.arange(bits))).sum(axis=2)


def _asked_signs(signs: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By table the signatures that the keywords ask for, their own and those with one bit turned,
    ascending, and the keyword of each."""
    turns = np.append(0, 1 << np.arange(bits))
    kw = np.repeat(np.arange(len(signs), dtype=np.int32), len(turns))
    lists = []
    for own in signs.T:
        asked = (own[:, None] ^ turns).ravel().astype(np.int32)
        order = np.argsort(asked, kind="stable")
        lists.append((asked[order], kw[order]))
    return lists


def _agreeing(lists: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, n_kw: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keywords and rows that agree in all but at most one bit of some table, each pair once, for
    some rows at a time."""
    sizes = [np.searchsorted(asked, own, "right") - np.searchsorted(asked, own) for (asked, _), own in zip(lists, signs.T, strict=True)]
    ends, start = np.cumsum(np.sum(sizes, axis=0)), 0
    while start < len(signs):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, "right")))
        pairs = []
        for (asked, kw), own, n in zip(lists, signs[start:end].T, sizes, strict=True):
            n, low = n[start:end], np.searchsorted(asked, own)
            at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            pairs.append(np.repeat(np.arange(start, end), n) * n_kw + kw[at])
        pair = np.unique(np.concatenate(pairs))
        yield pair % n_kw, pair // n_kw
        start = end


def lsh_pairs(
    kw_vecs: DataFrame,
    q_vecs: DataFrame,
    min_sim: float,
    bits: int,
    recall: float = RECALL,
    seed: int = 7,
    floor: float | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Keyword and log rows that agree in all but at most one bit of some table, each pair once, with
    their exact cosine; with ``floor`` those alone that reach it.

    A keyword asks for its own signature of each table and for those with one bit turned. What is
    asked for is broadcast, in groups of keywords of a measured size, and one scan of the log for each
    group looks the rows' signatures up, so neither side is shuffled or copied for its tables.
    """
    tables = tables_for(bits, min_sim, recall)
    row = q_vecs.select(F.size("vec").alias("n")).where("n > 0").first()
    planes = np.random.default_rng(seed).normal(size=(row["n"] if row else 1, tables * bits))
    kw = kw_vecs.select(*KEYWORD_KEY, "vec").where(F.size("vec") > 0)
    size = measure(kw)
    groups = -(-(size.bytes + size.rows * tables * (bits + 1) * 8) // chunk_bytes) or 1
    own = F.pmod(F.xxhash64(*KEYWORD_KEY), F.lit(groups))
    schema = kw.select(*KEYWORD_KEY).schema.add("id", "long").add("similarity", "double")
    scale = 10.0**DIGITS

    def scanned(part: DataFrame) -> DataFrame:
        rows = part.toArrow()
        by_market = {}
        for market in pc.unique(rows["market"]).drop_null().to_pylist():
            held = rows.filter(pc.equal(rows["market"], market))
            by_market[market] = held.select(KEYWORD_KEY), _matrix(held["vec"]).astype(np.float64)
        shared = q_vecs.sparkSession.sparkContext.broadcast((planes, by_market))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides, asked_by = shared.value
            lists = {}
            for batch in batches:
                for market in pc.unique(batch.column("market")).to_pylist():
                    if market not in asked_by:
                        continue
                    names, words = asked_by[market]
                    if market not in lists:
                        lists[market] = _asked_signs(_signs(words, sides, bits), bits)
                    held = batch.filter(pc.equal(batch.column("market"), market))
                    matrix = _matrix(held.column("vec")).astype(np.float64)
                    for at_kw, at in _agreeing(lists[market], _signs(matrix, sides, bits), len(words)):
                        sims = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", words[at_kw[k : k + COMPARED]], matrix[at[k : k + COMPARED]]) for k in range(0, len(at), COMPARED)])
                        sims = np.rint(sims * scale) / scale
                        if floor is not None:
                            near = sims >= floor
                            at_kw, at, sims = at_kw[near], at[near], sims[near]
                        out = names.take(pa.array(at_kw)).append_column("id", held.column("id").take(pa.array(at)))
                        yield from out.append_column("similarity", pa.array(sims)).to_batches()

        return q_vecs.select("market", "id", "vec").where(F.size("vec") > 0).mapInArrow(scan, schema)

    return reduce(DataFrame.unionByName, [scanned(kw.where(own == g) if groups > 1 else kw) for g in range(groups)])


def vector_topk_lsh(
    kw_vecs: DataFrame,
    q_vecs: DataFrame,
    k: int = TOP_K,
    min_sim: float = MIN_SIM,
    bits: int | None = None,
    recall: float = RECALL,
    seed: int = 7,
) -> DataFrame:
    """Approximate nearest neighbours above a floor, for keyword sets too large to compare with
    every log row.

    Signs of random projections bucket both sides (see ``lsh_pairs``); ``bits`` grows with the log
    unless it is given. Candidates are ranked by their exact cosine, found where the log is scanned, so
    that every similarity is the exact one; a pair at the floor is found with probability ``recall``, nearer pairs more surely.
    """
    if bits is None:
        bits = min(24, max(12, math.ceil(math.log2(max(q_vecs.count(), 1)))))
    near = lsh_pairs(kw_vecs, q_vecs, min_sim, bits, recall, seed, floor=min_sim)
    return topk_per(near, KEYWORD_KEY, [F.col("similarity").desc(), F.col("id")], k)


def vector_verify(candidates: DataFrame, min_sim: float = MIN_SIM) -> DataFrame:
    """Keep candidates at or above the similarity floor whose text contains the keyword or is a
    typo of it; score part 1, relevance is the similarity.

    ``candidates``: keyword columns, log columns and ``similarity``.
    """
    query, keyword = F.col("normalized_query"), F.col("keyword")
    return (
        candidates.where(F.col("similarity") >= min_sim)
        .where(contained(query, keyword) | typo(query, keyword))
        .withColumn("method", F.lit("vector"))
        .withColumn("relevance", F.col("similarity"))
        .select(*HIT_COLUMNS)
    )
