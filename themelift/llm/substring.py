"""Removal of passages that a document with a smaller id has too, by difference-cover anchors.

A passage is a window of ``WINDOW`` consecutive words. Positions whose remainder modulo the period
lies in a perfect difference set are anchors: wherever two equal windows stand in their documents,
some offset below the period makes both positions anchors, and the anchor words from there on lie
in both windows. So anchors alone are hashed and dealt by their hash. Around anchors that two
documents share, the match is extended: the whole windows that hold such an anchor are hashed,
dealt by their hash, and a window is removable if a smaller document has it.

Rows travel as packed arrays, dealt into parts of at most about ``PART_BYTES``, by the counted bytes
of the texts; a task holds one part at a time. Before they are dealt, a task keeps one row for each hash: what its own documents already decide needs no
shuffle, and a passage that a third of all documents hold costs one row a task. Window hashes have
96 bits. The texts are shuffled once; both joins use the same exchange.

Defined results: a null or empty text has no words; a text with fewer words than a window keeps
all. Rows with equal doc_id are the same document and never remove words from each other; a null
id stands after all others, and rows with a null id never remove words from each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.llm.common import (
    NO_ID,
    mixed,
    packed,
    prefix_sums,
    row_groups,
    shuffle_partitions,
    text_buffer,
    tidy,
    tidy_group,
    unpacked,
    window_hashes,
    with_columns,
    word_bounds,
    word_hashes,
)

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every remainder modulo 31 is a difference of two of these
PART_BYTES = 48 << 20  # of dealt rows: there is about a byte of them for a byte of text
HELD_ROWS = 1 << 19  # anchors or windows that a task holds before it deals them
DEALT, DECIDED = 0, 1
KINDS = [np.int64, np.int64, np.int64, np.int32]  # hash, id, row key, position

in_cover = np.zeros(PERIOD, bool)
in_cover[list(COVER)] = True


@dataclass
class Words:
    """Words of some rows: hash (two halves) and row of each, where each row's words begin, prefix
    sums over the first halves."""

    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sums: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sums = prefix_sums(self.hashes[:, 0])
        self.place = np.arange(len(self.row)) - self.first[self.row]

    def left(self) -> np.ndarray:
        """Words from each word to the end of its row."""
        return self.count[self.row] - self.place


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, row = word_bounds(data, offsets)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    return Words(word_hashes(data, starts, ends), row, bounds[:-1], np.diff(bounds))


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word index of each anchor of the rows that have a window."""
    length = window - PERIOD + 1
    at = np.flatnonzero(
        in_cover[words.place % PERIOD] & (words.left() >= length) & (words.count[words.row] >= window)
    )
    return window_hashes(words.sums, at, length), at


def groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(batch.column(column))
    for first, last in row_groups(offsets):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def firsts(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where, in this order, a new value of the keys begins."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return new


def least_and_most(new: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest id of the run that each row is in."""
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return np.minimum.reduceat(ids, start)[run], np.maximum.reduceat(ids, start)[run]


def deal(parts: int, kind: int, by: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    part = (mixed(by, 7) % np.uint64(parts)).astype(np.int64)
    for number, blob in packed(part, parts, columns):
        yield number, kind, blob


def deal_anchors(a: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """One row for each anchor that one document has here; of an anchor that several documents
    have, a witness (position -1), and all its places as decided."""
    order = np.argsort(a, kind="stable")
    new = firsts(order, a)
    least, most = least_and_most(new, ids[order])
    shared = least < most
    if shared.any():
        rows = np.sort(order[shared])
        yield from deal(parts, DECIDED, keys[rows], [a[rows], ids[rows], keys[rows], at[rows]])
    rows = order[firsts(order, a, keys) & ~shared | new & shared]
    witness = np.zeros(len(a), bool)
    witness[order[new & shared]] = True
    rows = np.sort(rows)
    yield from deal(parts, DEALT, a[rows], [a[rows], ids[rows], keys[rows], np.where(witness[rows], -1, at[rows]).astype(np.int32)])


def send(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for part, kind, blob in rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())],
            ["part", "kind", "blob"],
        )


BLOBS = "part int, kind int, blob binary"


def anchor_rows(docs: DataFrame, window: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, last, data, offsets in groups(batch, 2):
                words = words_of(data, offsets)
                a, at = anchors(words, window)
                row = words.row[at] + first
                held.append((a.astype(np.int64), ids[row], keys[row], words.place[at].astype(np.int32)))
                rows += len(a)
                if rows >= HELD_ROWS:
                    yield from send(deal_anchors(*map(np.concatenate, zip(*held, strict=True)), parts))
                    held, rows = [], 0
        if rows:
            yield from send(deal_anchors(*map(np.concatenate, zip(*held, strict=True)), parts))

    return docs.select("id", "row_key", "text").mapInArrow(tidy(run), BLOBS)


def columns_of(table: pa.Table, kind: int, kinds: list[type]) -> list[np.ndarray]:
    return unpacked(table.filter(pc.equal(table["kind"], kind))["blob"].to_pylist(), kinds)


def shared_anchors(dealt: DataFrame, parts: int) -> DataFrame:
    """The places of anchors that two documents have, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        a, ids, keys, at = columns_of(table, DEALT, KINDS)
        out = columns_of(table, DECIDED, KINDS)[1:]
        if len(a):
            order = np.argsort(a, kind="stable")
            new = firsts(order, a)
            least, most = least_and_most(new, ids[order])
            told = np.maximum.reduceat(at[order] < 0, np.flatnonzero(new))[np.cumsum(new) - 1]
            rows = order[((least < most) | told) & (at[order] >= 0)]
            out = [np.concatenate([x, y[rows]]) for x, y in zip(out, (ids, keys, at), strict=True)]
        return pa.Table.from_batches(list(send(deal(parts, DECIDED, out[1], out))), BLOB_SCHEMA)

    return dealt.groupBy("part").applyInArrow(tidy_group(run), BLOBS)


BLOB_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def by_document(dealt: DataFrame) -> DataFrame:
    """One row for each document: id, row_key and its places as 32-bit numbers."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, at = columns_of(table, DECIDED, KINDS[1:])
        order = np.lexsort((at, keys, ids))
        ids, keys, at = ids[order], keys[order], at[order]
        start = np.flatnonzero(firsts(np.arange(len(ids)), ids, keys))
        places = [at[a:b].tobytes() for a, b in zip(start, [*start[1:], len(at)], strict=True)] if len(ids) else []
        return pa.table({"id": ids[start], "row_key": keys[start], "places": pa.array(places, pa.binary())})

    return dealt.groupBy("part").applyInArrow(tidy_group(run), "id long, row_key long, places binary")


def places_of(column: pa.Array, first: int, last: int, words: Words) -> np.ndarray:
    """Word indexes of the places of some rows."""
    raw = column.slice(first, last - first).to_pylist()
    each = [np.frombuffer(x, np.int32) for x in raw if x]
    rows = np.repeat(np.arange(last - first), [len(x) // 4 if x else 0 for x in raw])
    return words.first[rows] + np.concatenate(each) if each else np.zeros(0, np.int64)


def alike(values: np.ndarray, row: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which of these values equal a chosen one of their row; ``chosen`` are indexes."""
    key = mixed(values ^ mixed(row, 3))
    return np.isin(key, key[chosen])


def covered(at: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a stretch of ``length`` from one of these positions on."""
    edge = np.zeros(total + length + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[:total] > 0


WINDOW_KINDS = [np.int64, np.int32, np.int64, np.int64, np.int32]  # hash, more of it, id, key, position


def deal_windows(h: np.ndarray, more: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """A window that a smaller document has here is decided; the smallest document's is dealt."""
    order = np.lexsort((more, h))
    new = firsts(order, h, more)
    least, _ = least_and_most(new, ids[order])
    removable = ids[order] > least
    if removable.any():
        rows = np.sort(order[removable])
        yield from deal(parts, DECIDED, keys[rows], [h[rows], more[rows], ids[rows], keys[rows], at[rows]])
    same = order[~removable]
    rows = np.sort(same[firsts(same, h, more, keys)])
    yield from deal(parts, DEALT, h[rows], [h[rows], more[rows], ids[rows], keys[rows], at[rows]])


def window_rows(marked: DataFrame, window: int, parts: int) -> DataFrame:
    """The windows that hold a marked anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, last, data, offsets in groups(batch, 2):
                words = words_of(data, offsets)
                a, at = anchors(words, window)
                marks = np.searchsorted(at, places_of(batch.column(3), first, last, words))
                near = at[alike(a, words.row[at], marks)]
                begins = covered(np.maximum(near - PERIOD + 1, 0), PERIOD, len(words.row))
                at = np.flatnonzero(begins & (words.left() >= window))
                h = window_hashes(words.sums, at, window)
                again = prefix_sums(words.hashes[:, 1])
                more = mixed(window_hashes(again, at, window)).astype(np.uint32).view(np.int32)
                row = words.row[at] + first
                held.append((h.astype(np.int64), more, ids[row], keys[row], words.place[at].astype(np.int32)))
                rows += len(h)
                if rows >= HELD_ROWS:
                    yield from send(deal_windows(*map(np.concatenate, zip(*held, strict=True)), parts))
                    held, rows = [], 0
        if rows:
            yield from send(deal_windows(*map(np.concatenate, zip(*held, strict=True)), parts))

    return marked.mapInArrow(tidy(run), BLOBS)


def removable_windows(dealt: DataFrame, parts: int) -> DataFrame:
    """The places of windows that a smaller document has, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        h, more, ids, keys, at = columns_of(table, DEALT, WINDOW_KINDS)
        out = columns_of(table, DECIDED, WINDOW_KINDS)[2:]
        if len(h):
            order = np.lexsort((more, h))
            least, _ = least_and_most(firsts(order, h, more), ids[order])
            rows = order[ids[order] > least]
            out = [np.concatenate([x, y[rows]]) for x, y in zip(out, (ids, keys, at), strict=True)]
        return pa.Table.from_batches(list(send(deal(parts, DECIDED, out[1], out))), BLOB_SCHEMA)

    return dealt.groupBy("part").applyInArrow(tidy_group(run), BLOBS)


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """id (never null), row_key (a hash of id and text, never null), text and more."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(id_.alias("id"), F.xxhash64("doc_id", "text").alias("row_key"), "text", *more)


def part_count(docs: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts for the rows that these texts can deal, and one for each shuffle partition at least.
    Two bytes of rows are counted for a byte of text: windows have 32 bytes for a word at most, but
    only around anchors that documents share, and anchors are a fifth of the words."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(shuffle_partitions(docs.sparkSession), -(-2 * int(size) // part_bytes))


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, row_key and places: the first words of removable windows; a document without any has
    no row. Equal windows of a document are named once."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    parts = part_count(docs)
    docs = keyed(docs)
    marks = by_document(shared_anchors(anchor_rows(docs, window, parts), parts))
    marked = docs.join(marks, ["id", "row_key"]).select("id", "row_key", "text", "places")
    return by_document(removable_windows(window_rows(marked, window, parts), parts))


def remove_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one space."""
    joined = keyed(docs).join(removals(docs, window), ["id", "row_key"], "left")
    out = _kept(joined.select("id", "text", "places"), window, ())
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")


def without_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns: text as it is where nothing is removed, otherwise the
    words that stay, joined by one space; n_chars, if there is one, counts the new text."""
    names = docs.columns
    others = {n: f"c{k}" for k, n in enumerate(names) if n != "text"}
    row = F.struct(F.col("text").isNull().alias("no_text"), *[F.col(f"`{n}`").alias(c) for n, c in others.items()])
    rows = keyed(docs, row.alias("row"))
    joined = rows.join(removals(docs, window), ["id", "row_key"], "left")
    out = _kept(joined.select("id", "text", "places", "row"), window, ("row",), verbatim=True)
    columns = {n: F.col(f"row.{c}") for n, c in others.items()}
    columns["text"] = F.when(~F.col("row.no_text"), F.col("kept"))
    if "n_chars" in columns:
        size = F.length("kept").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, size).otherwise(columns["n_chars"])
    return out.select(*[columns[n].alias(n) for n in names])


def _kept(joined: DataFrame, window: int, carry: tuple[str, ...], verbatim: bool = False) -> DataFrame:
    """Counts and kept text of each row; with ``verbatim`` a text that loses nothing stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in groups(batch, 1):
                words, removed, texts = kept_words(batch.column(2), first, last, data, offsets, window, verbatim)
                own = [batch.column(k).slice(first, last - first) for k in (0, *range(3, 3 + len(carry)))]
                new = [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([own[0], *new, *own[1:]], ["id", "n_words", "n_removed", "kept", *carry])

    new = {"id": T.LongType(), "n_words": T.LongType(), "n_removed": T.LongType(), "kept": T.StringType()}
    schema = with_columns(joined, (), new | {c: joined.schema[c].dataType for c in carry})
    return joined.mapInArrow(tidy(run), schema)


def kept_words(
    places: pa.Array, first: int, last: int, data: np.ndarray, offsets: np.ndarray, window: int, verbatim: bool
) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word count, removed words and kept text of some rows."""
    starts, ends, row = word_bounds(data, offsets)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    gone = np.zeros(len(row), bool)
    if places.slice(first, last - first).null_count < last - first:
        words = Words(word_hashes(data, starts, ends), row, bounds[:-1], np.diff(bounds))
        at = np.flatnonzero(words.left() >= window)
        marks = np.searchsorted(at, places_of(places, first, last, words))
        hit = at[alike(window_hashes(words.sums, at, window), words.row[at], marks)]
        gone = covered(hit, window, len(row))
    lost = np.zeros(len(row) + 1, np.int64)
    np.cumsum(gone, out=lost[1:])
    removed = lost[bounds[1:]] - lost[bounds[:-1]]
    raw, texts = data.tobytes(), []
    for k in range(last - first):
        if removed[k]:
            own = np.arange(bounds[k], bounds[k + 1])[~gone[bounds[k] : bounds[k + 1]]]
            texts.append(b" ".join([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
        else:
            whole = raw[offsets[k] : offsets[k + 1]]
            texts.append(whole if verbatim else b" ".join(whole.split()))
    return np.diff(bounds), removed, texts
