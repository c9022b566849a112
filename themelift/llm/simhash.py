"""Near copies by SimHash fingerprints, with BK-trees over shards of them.

A fingerprint has a bit for each bit that is set in over half of the document's shingle hashes. Two
fingerprints within ``radius`` bits agree on all but ``radius`` of any blocks that the 64 bits are
cut into. So distinct fingerprints are sharded by each choice of the agreeing blocks, and a shard
holds a BK-tree: children are keyed by their integer distance to the parent, and a search follows
only the edges whose key differs from its own distance by at most the radius. A shard beyond a
bound is split into several trees; its fingerprints then search each of them once. A tree reports
only links that join two groups not yet joined in it, which leaves components as they are.

Defined results: a null or empty text, or one of white space, has fingerprint zero, linked like
any other; a text with fewer words than a shingle is one shingle. Repeated rows have one row each
in the result. A null id has a row but is never a component's id, unless a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.llm.common import numbered, row_groups, text_buffer, tidy, with_columns, word_bounds
from themelift.llm.components import components
from themelift.sizing import lookup_join, stage

SEED = 42
SHINGLE = 4
RADIUS = 4
TREE_NODES = 4096  # fingerprints in one tree
SHARD_MEAN = 64  # wanted fingerprints in an ordinary shard

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of each row, and the row of each."""
    starts, ends, row = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = data.tobytes()
    text = b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    end = np.cumsum(ends - starts + 1) - 1
    begin = np.append(0, end[:-1] + 1)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    words = np.diff(np.append(first, len(row)))
    at = np.arange(len(row)) - np.repeat(first, words)
    many = np.repeat(words, words)
    heads = np.flatnonzero((at + shingle <= many) | ((at == 0) & (many < shingle)))
    tails = heads + np.minimum(shingle, many[heads]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(text[a:b], SEED) for a, b in zip(begin[heads].tolist(), end[tails].tolist(), strict=True)]
    return np.array(hashes, np.uint64), row[heads]


def majority_bits(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprint of each row: bits set in over half of its hashes."""
    total = np.bincount(row, minlength=rows)
    prints = np.zeros(rows, np.uint64)
    for byte in range(8):
        value = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        for first in range(0, rows, 1024):  # 1,024 rows' histograms at a time
            last = min(first + 1024, rows)
            a, b = np.searchsorted(row, (first, last))
            seen = np.bincount((row[a:b] - first) * 256 + value[a:b], minlength=(last - first) * 256)
            bits = (seen.reshape(-1, 256) @ BYTE_BITS) * 2 > total[first:last, None]
            prints[first:last] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return prints


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint of the whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_groups(offsets):
                part = lowered(data[offsets[first] : offsets[last]])
                hashes, row = shingle_hashes(part, offsets[first : last + 1] - offsets[first], shingle)
                prints = majority_bits(hashes, row, last - first).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(prints)], ["doc_id", "fp"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def with_prints(docs: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    """All columns, and _fp, the fingerprint of the column ``text``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for first, last in row_groups(offsets):
                part = lowered(data[offsets[first] : offsets[last]])
                hashes, row = shingle_hashes(part, offsets[first : last + 1] - offsets[first], shingle)
                prints = majority_bits(hashes, row, last - first).astype(np.int64)
                rows = [c.slice(first, last - first) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(prints)], [*batch.schema.names, "_fp"])

    return docs.mapInArrow(tidy(run), with_columns(docs, tuple(docs.columns), {"_fp": T.LongType()}))


class Tree:
    """A BK-tree of 64-bit numbers, and the groups that its links have made so far."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []

    def group(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = self.parent[self.parent[node]]
            node = self.parent[node]
        return node

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within the radius."""
        found, waiting = [], [0] if self.values else []
        while waiting:
            node = waiting.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if -radius <= edge - distance <= radius:
                    waiting.append(child)
        return found

    def insert(self, value: int) -> int:
        new = len(self.values)
        if new:
            node = 0
            while True:
                edge = (self.values[node] ^ value).bit_count()
                child = self.children[node].get(edge)
                if child is None:
                    self.children[node][edge] = new
                    break
                node = child
        self.values.append(value)
        self.children.append({})
        self.parent.append(new)
        return new

    def join(self, value: int, near: list[int]) -> Iterator[int]:
        """Values to link with: a near node of each group that has one; the groups become one."""
        groups = {self.group(n): n for n in near}
        first = min(groups, default=-1)
        for group, node in groups.items():
            self.parent[group] = first
            yield self.values[node]


def shard_masks(count: int, radius: int, mean: int = SHARD_MEAN) -> list[int]:
    """Masks of the bits that must agree: all choices of all but ``radius`` blocks, with as many
    blocks as keep ordinary shards of ``count`` fingerprints small. Any number of blocks over the
    radius finds every link."""
    blocks = radius + 1
    while blocks < radius + 4 and count / 2 ** (64 * (blocks - radius) // blocks) > mean:
        blocks += 1
    cut = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]
    masks = [sum(choice) for choice in combinations(block, blocks - radius)]
    assert len(masks) == comb(blocks, radius)
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, radius: int = RADIUS, count: int | None = None, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column fp) that differ in at most
    ``radius`` bits, enough of them to join what all such links join."""
    prints = prints.select("fp").distinct()
    masks = shard_masks(prints.count() if count is None else count, radius)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    rows = prints.select("fp", F.posexplode(keys).alias("choice", "key"))
    sizes = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = stage(sizes.where(F.col("n") > tree_nodes), "shards")
    rows = lookup_join(rows, large, ["choice", "key"], "left")
    trees = F.coalesce(F.ceil(F.col("n") / tree_nodes), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), trees).cast("int")
    rows = rows.select("choice", "key", "fp", own.alias("own")).select(
        "choice", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("tree")
    )
    rows = rows.select("choice", "key", "tree", (F.col("own") > F.col("tree")).alias("asks"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = Tree(), None
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [c.to_pylist() for c in batch.columns]
            for choice, key, part, asks, fp in zip(*columns, strict=True):
                if shard != (choice, key, part):
                    tree, shard = Tree(), (choice, key, part)
                value = fp & 0xFFFFFFFFFFFFFFFF
                near = tree.near(value, radius)
                found += [(value, other) for other in tree.join(value, near)]
                if not asks:
                    new = tree.insert(value)
                    if near:
                        tree.parent[new] = tree.group(near[0])
            pairs = np.array(found, np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    shards = rows.repartition("choice", "key", "tree").sortWithinPartitions("choice", "key", "tree", "asks", "fp")
    return shards.mapInArrow(tidy(run), "a long, b long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that is reachable by links of fingerprints
    within ``radius`` bits."""
    return grouped(docs, shingle, radius).drop("part")


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The same and ``part``, a fingerprint that stands for the component: two components can have
    the same smallest doc_id."""
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    joined = components(links(distinct, radius, distinct.count()))
    member = joined.join(distinct, joined["node"] == distinct["fp"])
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = stage(member.join(least, "root").select("fp", "component_id", "root"), "members")
    named = distinct.join(moved, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("part")
    )
    return lookup_join(prints, stage(named, "components"), ["fp"])


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: that with the
    smallest id. Of rows with that id and in that component one stays, the first by fingerprint and
    hashes of the row; rows with a null id stay."""
    found = stage(grouped(docs, shingle, radius), "copies")
    again = stage(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    once = lookup_join(docs, again, ["doc_id"], "left_anti")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = lookup_join(once, stage(gone, "gone"), ["doc_id"], "left_anti")

    # Of an id with several rows each row is judged by its own text.
    repeated, names = numbered(lookup_join(docs, again, ["doc_id"], "left_semi"))
    id_, text = (repeated.columns[docs.columns.index(n)] for n in ("doc_id", "text"))
    rows = with_prints(repeated, text, shingle)
    parts = lookup_join(found, again, ["doc_id"], "left_semi").select(F.col("fp").alias("_fp"), F.col("component_id").alias("_component"), F.col("part").alias("_part")).distinct()
    rows = lookup_join(rows, stage(parts, "parts"), ["_fp"]).where(F.col(id_).cast("long") == F.col("_component"))
    hashed = [f.name for f in repeated.schema.fields if not isinstance(f.dataType, T.MapType)]
    order = F.struct("_fp", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), F.xxhash64(*hashed))
    first = rows.groupBy(id_, "_part").agg(F.min_by(F.struct(*repeated.columns), order).alias("_row"))
    return kept.unionByName(first.select("_row.*").select(*names))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
