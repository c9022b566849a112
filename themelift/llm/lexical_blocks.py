"""Exact ranked lexical search with posting lists cut into blocks of similar documents.

A document is a vector over the terms asked for: tf components of a BM25 with whole-number
arithmetic (``component``), which items weigh by how rare their terms are (``weight``). Documents
are indexed in shards of consecutive rows. In a shard, each term's posting list is cut by a shallow
clustering: evenly spaced members of the list stand for its blocks, and each document goes to the one
its vector is most similar to (by a signed random projection, which only shapes blocks). A block's
summary is the coordinatewise maximum of its documents' vectors, rounded up to 8 bits, so the
product of an item and a summary is never below the score of a document in the block.

An item is asked shard by shard. Terms whose largest components together stay below the item's
k-th score so far cannot lift a document on their own, so only the lists of the other terms are
walked; of these, blocks whose bound is below the k-th score are skipped, the rest is scored in full
from the stored vectors, best bounds first. Bounds are compared in whole numbers and equal scores
are not skipped, so the result is that of scoring every document.

The corpus is read once and never shuffled: a task counts the asked terms of its texts, a second
job takes the counts of documents and terms from the stored vectors, tasks build and store shards,
and tasks search them, each keeping k documents for an item. Items go out in parts of measured
size, with an index for the terms of each part. A term that every document has, a hot source or a
group of copies makes longer lists in each shard but no larger shard; shards have at most
``SHARD_ROWS`` rows and fewer where terms or entries are many (``CELLS``, ``VALUES``).

Defined results: a null or empty text has no terms, matches nothing and is not counted. Rows with
equal ids are separate documents. Equal scores rank by ascending id, null ids last. Items without
terms, or whose terms no document has, have no rows; each row of a repeated item has its own
results. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.llm.common import NO_ID, row_groups, text_buffer, tidy
from themelift.llm.terms import LETTERS_AND_DIGITS, term_codes
from themelift.sizing import measure, scratch_dir, stage

TOP = 10
ITEM_BYTES = 4 << 20  # of the items that are asked in one pass
SHARD_ROWS = 2048
CELLS = 1 << 24  # rows times terms of a shard at most
VALUES = 1 << 20  # entries of the vectors of a shard, and fewer where the terms are many
SUMMARY_BYTES = 1 << 27  # of all summaries of a shard when they are laid out
BLOCK = 64  # documents of a block on average
SHORT = 32  # shorter lists have no blocks, their documents are scored
SKETCH = 32
LEVEL = 3_922  # a step of a summary; 255 of them are over the largest component
FIRST_BLOCKS = 4
#: A row is a whole shard, so a reader is to take few of them at a time.
FEW_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def component(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term with tf occurrences adds per weight in a document of length number m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def terms_of(texts: list[str | None]) -> list[list[bytes]]:
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    codes, bounds, terms = term_codes(data, offsets, LETTERS_AND_DIGITS)
    return [terms[codes[a:b]].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


@dataclass(frozen=True)
class Asked:
    """Items as numbers of their terms (ascending) and how often each stands in the item."""

    ids: list
    terms: list[bytes]
    items: list[tuple[np.ndarray, np.ndarray]]


def asked(rows: list) -> Asked:
    """The items (id, text) and the distinct terms they hold."""
    found = terms_of([text for _, text in rows])
    numbers = {t: k for k, t in enumerate(sorted({t for terms in found for t in terms}))}
    items = []
    for terms in found:
        count = sorted(Counter(numbers[t] for t in terms).items())
        items.append((np.array([t for t, _ in count], np.int64), np.array([n for _, n in count], np.int64)))
    return Asked([i for i, _ in rows], list(numbers), items)


VECTORS = "id long, n long, terms array<int>, tf array<int>"


def vectors(docs: DataFrame, terms: list[bytes], id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id (never null), n (terms of the whole text, with repeats), and of the given terms that it
    has the numbers (ascending) and occurrences. Texts without terms have no row."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_groups(offsets, 4 << 20):
                codes, bounds, words = term_codes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], LETTERS_AND_DIGITS)
                number = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))[codes]
                n = np.diff(bounds)
                row = np.repeat(np.arange(last - first), n)[number >= 0]
                pair, tf = np.unique(row * max(len(numbers), 1) + number[number >= 0], return_counts=True)
                rows = np.flatnonzero(n)
                at = np.searchsorted(pair, np.append(rows, last - first) * max(len(numbers), 1))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (pair % max(len(numbers), 1), tf)]
                ids = batch.column(0).slice(first, last - first).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[rows], pa.int64()), *lists], ["id", "n", "terms", "tf"])

    ids = F.coalesce(F.col(id_).cast("long"), F.lit(NO_ID)).alias("id")
    return docs.select(ids, F.col(text)).mapInArrow(tidy(run), VECTORS)


@dataclass(frozen=True)
class Statistics:
    """Of all documents: how many have a term, their terms with repeats, and how many have each."""

    documents: int
    length: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([weight(self.documents, int(n)) if n else 0 for n in self.df], np.int64)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """The length number of documents of n terms."""
        return np.array([25 + 75 * x * self.documents // self.length for x in n.tolist()], np.int64)


def statistics(vectors: DataFrame, terms: int) -> Statistics:
    """The counts over all stored vectors; the list has an entry for each term asked for."""
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(terms, np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    return Statistics(int(row["n"]), int(row["l"]), df)


@dataclass
class Shard:
    """Documents, their vectors row by row, blocks of posting lists and the blocks' summaries."""

    ids: np.ndarray  # of the rows
    at: np.ndarray  # where each row's vector begins, and the last one's end
    terms: np.ndarray
    values: np.ndarray
    block_term: np.ndarray  # blocks by term
    block_at: np.ndarray
    members: np.ndarray  # rows, block by block
    bounded: np.ndarray  # whether the block has a summary
    summary_bits: np.ndarray  # of each block with a summary, which terms it has, packed
    summary_levels: np.ndarray  # and their levels, end to end
    list_max: np.ndarray  # largest component of each term

    KINDS = {
        "ids": np.int64, "at": np.int32, "terms": np.int32, "values": np.int32, "block_term": np.int32,
        "block_at": np.int32, "members": np.uint16, "bounded": np.bool_, "summary_bits": np.uint8,
        "summary_levels": np.uint8, "list_max": np.int32,
    }

    def pack(self) -> list[bytes]:
        return [getattr(self, c).astype(kind).tobytes() for c, kind in self.KINDS.items()]

    @classmethod
    def unpack(cls, row: dict[str, bytes]) -> Shard:
        return cls(**{c: np.frombuffer(row[c], kind) for c, kind in cls.KINDS.items()})

    def summaries(self) -> np.ndarray:
        """The levels of each block with a summary, a column for each term."""
        size, blocks = len(self.list_max), int(self.bounded.sum())
        bits = np.unpackbits(self.summary_bits.reshape(blocks, -1), axis=1, count=size) if blocks else np.zeros((0, size), np.uint8)
        bits[bits > 0] = self.summary_levels
        return bits


SHARDS = ", ".join(f"{c} binary" for c in Shard.KINDS)


def sketches(at: np.ndarray, terms: np.ndarray, strength: np.ndarray, size: int) -> np.ndarray:
    """Unit vectors of a few signed sums of each row's vector."""
    rows = np.zeros((len(at) - 1, SKETCH), np.float32)
    signs = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (size, SKETCH))
    full = np.flatnonzero(np.diff(at))
    for some in np.array_split(full, max(len(full) // 512, 1)):
        if len(some):
            own = slice(at[some[0]], at[some[-1] + 1])
            rows[some] = np.add.reduceat(signs[terms[own]] * strength[own, None], at[some] - at[some[0]], axis=0)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def clusters(sketch: np.ndarray, block: int) -> np.ndarray:
    """The block of each document of a list: of evenly spaced documents the most similar one."""
    heads = np.linspace(0, len(sketch) - 1, math.ceil(len(sketch) / block)).astype(np.int64)
    return np.argmax(sketch @ sketch[heads].T, axis=1)


def build_shard(ids: np.ndarray, at: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray, block: int = BLOCK, short: int = SHORT) -> Shard:
    size, rows = len(weights), len(ids)
    row = np.repeat(np.arange(rows), np.diff(at))
    order = np.argsort(terms, kind="stable")
    list_at = np.searchsorted(terms[order], np.arange(size + 1))
    members = row[order]
    group = np.zeros(len(members), np.int64)
    sketch = sketches(at, terms, (weights[terms] * values).astype(np.float32), size)
    long = np.flatnonzero(np.diff(list_at) >= short)
    for t in long.tolist():
        own = slice(list_at[t], list_at[t + 1])
        group[own] = clusters(sketch[members[own]], block)
    term = terms[order]
    order = np.lexsort((members, group, term))
    members, key = members[order], term[order].astype(np.int64) * (rows + 1) + group[order]
    block_at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    block_term = key[block_at] // (rows + 1)
    bounded = np.isin(block_term, long)
    block_at = np.append(block_at, len(members))
    levels = np.zeros((rows, size), np.uint8)
    levels[row, terms] = -(-values // LEVEL)
    bits, found = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
    for b in np.flatnonzero(bounded).tolist():
        top = levels[members[block_at[b] : block_at[b + 1]]].max(axis=0)
        bits.append(np.packbits(top > 0))
        found.append(top[top > 0])
    list_max = np.zeros(size, np.int64)
    np.maximum.at(list_max, terms, values)
    return Shard(ids, at, terms, values, block_term, block_at, members, bounded, np.concatenate(bits), np.concatenate(found), list_max)


def ranges(at: np.ndarray, rows: int, entries: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many rows and entries; a row with more entries stands alone."""
    for first, last in row_groups(at, entries):
        for k in range(first, last, rows):
            yield k, min(k + rows, last)


def index(vectors: DataFrame, stats: Statistics, block: int = BLOCK, short: int = SHORT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The shards of stored vectors, a row each."""
    sent = vectors.sparkSession.sparkContext.broadcast((stats, stats.weights()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = sent.value
        asked = max(len(weights), 1)
        rows = max(min(shard_rows, CELLS // asked, 1 << 16), 1)
        entries = min(VALUES, SUMMARY_BYTES * short // asked)
        for batch in batches:
            ids, n = (batch.column(k).to_numpy() for k in (0, 1))
            terms, tf = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            at = np.append(0, np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())).astype(np.int64)
            for first, last in ranges(at, rows, entries):
                each = slice(at[first], at[last])
                values = component(tf[each], np.repeat(own.lengths(n[first:last]), np.diff(at[first : last + 1])))
                shard = build_shard(ids[first:last], at[first : last + 1] - at[first], terms[each], values, weights, block, short)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.pack()], list(Shard.KINDS))

    return vectors.mapInArrow(tidy(run), SHARDS)


class Best:
    """The k best documents of each item so far, and what was walked."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, k: int):
        self.items = [(terms, n * weights[terms]) for terms, n in items]
        self.k, self.size = k, len(weights)
        none = np.zeros(0, np.int64)
        self.found = [(none, none) for _ in items]
        self.walked = {"blocks": 0, "skipped": 0, "scored": 0, "rows": 0}

    def least(self, item: int) -> int:
        """The score a document needs to come among the best; with an equal one its id decides."""
        scores = self.found[item][0]
        return max(int(scores[-1]), 1) if len(scores) == self.k else 1

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least(item)
        scores, ids = (np.concatenate([a, b[keep]]) for a, b in zip(self.found[item], (scores, ids), strict=True))
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[item] = scores[order], ids[order]

    def search(self, shard: Shard) -> None:
        rows, summary = len(shard.ids), shard.summaries()
        summary_of = np.cumsum(shard.bounded) - 1
        first_block = np.searchsorted(shard.block_term, np.arange(self.size + 1))
        factor = np.zeros(self.size, np.int64)
        for item, (terms, each) in enumerate(self.items):
            self.walked["rows"] += rows
            highest = each * shard.list_max[terms]
            order = np.argsort(highest, kind="stable")
            essential = terms[order[np.cumsum(highest[order]) >= self.least(item)]]
            if not len(essential):
                continue
            own = np.concatenate([np.arange(first_block[t], first_block[t + 1]) for t in essential.tolist()])
            if not len(own):
                continue
            factor[terms] = each
            seen = np.zeros(rows, bool)
            self.score(item, shard, own[~shard.bounded[own]], seen, factor)
            own = own[shard.bounded[own]]
            bound = (summary[np.ix_(summary_of[own], terms)].astype(np.int64) * (each * LEVEL)).sum(axis=1)
            order = np.argsort(-bound, kind="stable")
            own, bound = own[order], bound[order]
            self.walked["blocks"] += len(own)
            at, step = 0, FIRST_BLOCKS
            while at < (open_ := int(np.searchsorted(-bound, -self.least(item), "right"))):
                self.score(item, shard, own[at : min(at + step, open_)], seen, factor)
                at, step = min(at + step, open_), 2 * step
            self.walked["skipped"] += len(own) - at
            factor[terms] = 0

    def score(self, item: int, shard: Shard, blocks: np.ndarray, seen: np.ndarray, factor: np.ndarray) -> None:
        """Score the documents of these blocks that were not scored before."""
        if not len(blocks):
            return
        rows = np.unique(np.concatenate([shard.members[shard.block_at[b] : shard.block_at[b + 1]] for b in blocks.tolist()])).astype(np.int64)
        rows = rows[~seen[rows]]
        if not len(rows):
            return
        seen[rows] = True
        self.walked["scored"] += len(rows)
        start, size = shard.at[rows].astype(np.int64), np.diff(shard.at)[rows].astype(np.int64)
        begin = np.append(0, np.cumsum(size))
        place = np.repeat(start - begin[:-1], size) + np.arange(begin[-1])
        scores = np.add.reduceat(factor[shard.terms[place]] * shard.values[place], begin[:-1])
        self.add(item, scores, shard.ids[rows])


def write_index(shards: DataFrame, path: str) -> DataFrame:
    """Store shards, a few MB in each row group, and give them as they are read back."""
    shards.write.options(**FEW_ROWS).parquet(path)
    return shards.sparkSession.read.schema(shards.schema).parquet(path)


def found_in(shards: DataFrame, items: Asked, weights: np.ndarray, id_type: T.DataType, k: int = TOP) -> DataFrame:
    """item (its number), item_id, id and score: each task's k best of every item."""
    sent = shards.sparkSession.sparkContext.broadcast((items, weights))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = sent.value
        best = Best(own.items, weights, k)
        kind = None
        for batch in batches:
            for row in range(batch.num_rows):
                best.search(Shard.unpack({c: batch.column(j)[row].as_buffer() for j, c in enumerate(Shard.KINDS)}))
        sizes = [len(scores) for scores, _ in best.found]
        item = np.repeat(np.arange(len(sizes)), sizes)
        if len(item):
            kind = pa.array([own.ids[i] for i in item.tolist()])
            scores, ids = (np.concatenate([f[j] for f in best.found]) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), kind, pa.array(ids), pa.array(scores)], ["item", "item_id", "id", "score"])

    return shards.mapInArrow(tidy(run), schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES, **shape: int) -> DataFrame:
    """item_id, rank, doc_id and score: of every row of ``items`` (item_id, text) the k documents of
    ``docs`` (doc_id, text) with the highest scores above 0. ``shape``: block, short, shard_rows."""
    items = items.select("item_id", "text")
    parts = max(math.ceil(measure(items).bytes / item_bytes), 1)
    each = [items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p) if parts > 1 else items for p in range(parts)]
    return reduce(DataFrame.unionAll, [_search_part(docs, rows, k, shape) for rows in each])


def _search_part(docs: DataFrame, items: DataFrame, k: int, shape: dict[str, int]) -> DataFrame:
    part = asked([(r["item_id"], r["text"]) for r in items.collect()])
    rows = stage(vectors(docs, part.terms), "lexical-vectors")
    stats = statistics(rows, len(part.terms))
    shards = write_index(index(rows, stats, **shape), scratch_dir(docs.sparkSession, "lexical-shards"))
    found = found_in(shards, part, stats.weights(), items.schema["item_id"].dataType, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")
