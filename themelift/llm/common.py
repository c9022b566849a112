"""What the operators of this subpackage share: reading tables, words of text buffers, hashes.

A word is a longest run of bytes other than the six ASCII white space characters
(``[^\\x20\\x09-\\x0D]+``); the same runs come out of the UTF-8 bytes as out of the characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_ID = (1 << 63) - 1  # stands for a null id: after all others, never a smaller document
GROUP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


_held: dict[str, object] = {}


def hold(name: str, make: Callable[[], object]) -> object:
    """What a Python worker remembers from one task to the next, made where it is missing. A worker
    remembers one such thing at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def _give_back() -> None:
    """Return freed memory to the system: workers serve one operator after the other."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], holds: str = "") -> Callable[[Iterator], Iterator]:
    """A task's function that first forgets what other operators hold, and at the end gives back
    what it has freed itself."""

    def tidied(batches: Iterator) -> Iterator:
        for name in _held.keys() - {holds}:
            del _held[name]
        yield from run(batches)
        _give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for the function of a group."""

    def tidied(table: pa.Table) -> pa.Table:
        _held.clear()
        out = run(table)
        _give_back()
        return out

    return tidied


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0; a null
    id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def numbered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The table with columns named by number, so that columns of any name can be carried along,
    and the expressions that give them their names back."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{n}`").alias(f"_column_{k}") for k, n in enumerate(names)])
    return rows, [F.col(f"_column_{k}").alias(n) for k, n in enumerate(names)]


def with_columns(docs: DataFrame, keep: tuple[str, ...], new: dict[str, T.DataType]) -> T.StructType:
    """A schema of some columns of a table, of whatever type, and of new columns."""
    old = [T.StructField(n, docs.schema[n].dataType) for n in keep]
    return T.StructType(old + [T.StructField(n, kind) for n, kind in new.items()])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def some_rows(column: pa.Array, limit: int = 4 << 20) -> Iterator[list[bytes]]:
    """Texts of a column as bytes, null as empty, a few MB at a time."""
    data, offsets = text_buffer(column)
    for first, last in row_groups(offsets, limit):
        raw = data[offsets[first] : offsets[last]].tobytes()
        at = (offsets[first : last + 1] - offsets[first]).tolist()
        yield [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; no word reaches over the end of its row."""
    return run_bounds(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)


def run_bounds(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each longest run of marked bytes within a row."""
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    at, end = offsets[:-1][full], offsets[1:][full] - 1
    first[at], last[end] = word[at], word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64) + np.uint64((salt * BASE + BASE) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each of these stretches of bytes, equal for equal bytes and only for them, and
    the distinct stretches by number. The stretches don't overlap and are in order."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    own = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    coded = own.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)


def hashes_of(words: np.ndarray) -> np.ndarray:
    """Two independent 64-bit halves of the XXH3 hash of each of these byte strings."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64)
    return raw.reshape(-1, 2)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The two halves of the hash of each word."""
    codes, words = word_codes(data, starts, ends)
    return hashes_of(words)[codes]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums over word hashes, from which those of windows follow. Windows of so many words that
    powers of the base repeat their patterns (1,024 and more) are not to be told apart by them."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` values from each position on, given their prefix sums."""
    return (sums[at + length] - sums[at]) * powers(BASE_INVERSE, len(sums))[at]


def packed(kind: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Rows dealt by ``kind`` (a part number for each) into one binary per part, column after
    column, in the order given."""
    order = np.argsort(kind, kind="stable")
    at = np.searchsorted(kind[order], np.arange(parts + 1))
    for part in np.flatnonzero(at[1:] > at[:-1]):
        rows = order[at[part] : at[part + 1]]
        yield int(part), np.int64(len(rows)).tobytes() + b"".join(c[rows].tobytes() for c in columns)


def unpacked(blobs: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """The columns of several such binaries, one after the other."""
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        rows, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for column, kind in zip(columns, kinds, strict=True):
            column.append(np.frombuffer(blob, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, kinds, strict=True)]


class Flat:
    """Short arrays, one after the other, that are fetched by their numbers."""

    def __init__(self, kind: type):
        self.values = np.zeros(1 << 16, kind)
        self.ends = np.zeros(1 << 16, np.int64)
        self.count = 0

    def add(self, values: np.ndarray, bounds: np.ndarray) -> None:
        """Arrays given end to end, with where each begins and the last ends."""
        used, more = int(self.ends[self.count - 1]) if self.count else 0, len(bounds) - 1
        while used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.count + more > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[used : used + len(values)] = values
        self.ends[self.count : self.count + more] = used + bounds[1:]
        self.count += more

    def clear(self) -> None:
        self.count = 0

    def fetch(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers, end to end, and where each of them begins and the last
        ends."""
        ends = self.ends[numbers]
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        at = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        return self.values[np.repeat(starts - at[:-1], ends - starts) + np.arange(at[-1])], at


class WordNumbers:
    """Numbers the distinct words that a task meets; beyond a bound it starts anew, so that the
    memory for what is known of each word is bounded. Words of some rows are told apart by their
    bytes, remembered ones by both halves of their hash; a word that shares the first half with
    another one is new each time."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.second, self.count = np.zeros(1 << 16, np.uint64), 0  # second halves by number

    def full(self) -> bool:
        return self.count > self.limit

    def number(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], bool]:
        """Of some rows of text: the number of each word, where the words of each row begin (and the
        last row's end), the words that are new, in the order of their numbers, and whether the
        numbers began anew."""
        starts, ends, row = word_bounds(data, offsets)
        cleared = self.full()
        if cleared:
            self.clear()
        codes, words = word_codes(data, starts, ends)
        hashes = hashes_of(words)
        order = np.argsort(hashes[:, 0], kind="stable")
        hashes, words = hashes[order], words[order]
        known, place = len(self.hashes), np.searchsorted(self.hashes, hashes[:, 0])
        at = np.minimum(place, max(known - 1, 0))
        taken = self.hashes[at] == hashes[:, 0] if known else np.zeros(len(words), bool)
        old = taken.copy()
        old[taken] = self.second[self.numbers[at[taken]]] == hashes[taken, 1]
        numbers = np.zeros(len(words), np.int32)
        numbers[old] = self.numbers[at[old]]
        fresh = np.flatnonzero(~old)
        numbers[fresh] = self.count + np.arange(len(fresh))
        self.count += len(fresh)
        while self.count > len(self.second):
            self.second = np.concatenate([self.second, np.zeros_like(self.second)])
        self.second[numbers[fresh]] = hashes[fresh, 1]
        first = np.append(True, hashes[1:, 0] != hashes[:-1, 0])[: len(words)]
        kept = np.flatnonzero(~taken & first)
        if len(kept):
            self.hashes = np.insert(self.hashes, place[kept], hashes[kept, 0])
            self.numbers = np.insert(self.numbers, place[kept], numbers[kept])
        each = np.zeros(len(words), np.int64)
        each[order] = numbers
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        return each[codes], bounds, words[fresh].tolist(), cleared
