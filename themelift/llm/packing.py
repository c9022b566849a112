"""Hierarchical packing of tokenised documents into sequences of several context sizes.

A document's ids are those of its whole text and a final id. Whole long windows of the longest size
stand alone; what is left of a document is routed to the shortest tier (context size, a power of
two) that holds it. From the longest tier down, every tier is packed best fit first; gaps of its
sequences are filled from shorter tiers, cutting a document where none fits. What no shorter
document can fill is laid end to end and cut into powers of two, so that no sequence needs padding.
Sequences are dealt to step groups of about equal token counts.

Every task packs the documents it reads, a few million tokens at a time: nothing is shuffled and
no task holds more than that, whatever the sources look like. A sequence id carries the task's
number.

Defined results: a null or empty text is the final id alone; repeated rows are packed each; a null
id is kept as null.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelift.llm.common import Flat, WordNumbers, hold, row_groups, text_buffer, tidy

TIERS = (256, 512, 1024, 2048)
FINAL_ID = 1
CHUNK_TOKENS = 1 << 22
STEP_TOKENS = 1 << 17
WORDS_KEPT = 1_200_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, sequence_tokens long, step_id long"
)

Piece = tuple[int, int, int]  # length, document, start


class Pool:
    """Pieces that wait for a place, in order of length."""

    def __init__(self) -> None:
        self.pieces: list[Piece] = []

    def add(self, piece: Piece) -> None:
        insort(self.pieces, piece)

    def fill(self, gap: int) -> list[Piece]:
        """Take pieces for a gap: the longest that fit, then the head of one that is cut."""
        taken: list[Piece] = []
        while gap and self.pieces:
            at = bisect_right(self.pieces, (gap + 1, -1, -1)) - 1
            if at >= 0:
                piece = self.pieces.pop(at)
            else:
                length, doc, start = self.pieces.pop(0)
                piece = (gap, doc, start)
                self.add((length - gap, doc, start + gap))
            taken.append(piece)
            gap -= piece[0]
        return taken


def best_fit(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Bins of at most ``size`` tokens, the longest pieces first, each into the fullest bin that
    holds it."""
    bins: list[list[Piece]] = []
    free: list[tuple[int, int]] = []
    for piece in sorted(pieces, reverse=True):
        at = bisect_left(free, (piece[0], -1))
        if at == len(free):
            bins.append([piece])
            left, bin_ = size - piece[0], len(bins) - 1
        else:
            left, bin_ = free.pop(at)
            bins[bin_].append(piece)
            left -= piece[0]
        if left:
            insort(free, (left, bin_))
    return bins


def laid_out(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Pieces end to end, cut into full sequences of ``size`` and of smaller powers of two."""
    total = sum(p[0] for p in pieces)
    sizes = [size] * (total // size)
    sizes += [1 << b for b in reversed(range(size.bit_length())) if total % size >> b & 1]
    out: list[list[Piece]] = []
    waiting = list(reversed(pieces))
    for want in sizes:
        row: list[Piece] = []
        while want:
            length, doc, start = waiting.pop()
            if length > want:
                waiting.append((length - want, doc, start + want))
                length = want
            row.append((length, doc, start))
            want -= length
        out.append(row)
    return out


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces for documents of these token counts; each sequence's total is a power of
    two and at most the longest tier."""
    longest = tiers[-1]
    sequences: list[list[Piece]] = []
    routed: dict[int, list[Piece]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        sequences += [[(longest, doc, start)] for start in range(0, whole, longest)]
        if n > whole:
            routed[next(t for t in tiers if n - whole <= t)].append((n - whole, doc, whole))
    for k in range(len(tiers) - 1, -1, -1):
        size, shorter = tiers[k], Pool()
        shorter.pieces = sorted(p for t in tiers[:k] for p in routed[t])
        loose: list[Piece] = []
        for row in best_fit(routed[size], size):
            row += shorter.fill(size - sum(p[0] for p in row))
            if sum(p[0] for p in row) == size:
                sequences.append(row)
            else:
                loose += row
        sequences += laid_out(loose, size)
        for t in tiers[:k]:
            routed[t] = []
        for piece in shorter.pieces:
            routed[next(t for t in tiers if piece[0] <= t)].append(piece)
    return sequences


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence: the longest first, each to the step with the fewest tokens."""
    steps = [(0, k) for k in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, step = heapq.heappop(steps)
        out[at] = step
        heapq.heappush(steps, (load + sizes[at], step))
    return out


class Ids:
    """Ids of texts by the tokenizers library. White-space separated words never share a token, so
    each distinct word is encoded once and remembered, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.ids = WordNumbers(WORDS_KEPT), Flat(np.uint32)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each row's ids and the final id, as little-endian 32-bit numbers."""
        numbers, bounds, new, cleared = self.words.number(data, offsets)
        if cleared:
            self.ids.clear()
        if new:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            self.ids.add(np.fromiter(chain.from_iterable(found), np.uint32, ends[-1]), np.append(0, ends))
        flat, at = self.ids.fetch(numbers)
        raw, cut = flat.astype("<u4").tobytes(), (4 * at[bounds]).tolist()
        end = FINAL_ID.to_bytes(4, "little")
        return [raw[a:b] + end for a, b in zip(cut, cut[1:], strict=False)]


def packed_batch(doc_ids: list, ids: list[bytes], tiers: tuple[int, ...], first: int) -> tuple[pa.RecordBatch, int]:
    """Rows of the pieces of some documents; sequences are numbered from ``first``. Also the next
    free number."""
    lengths = [len(x) // 4 for x in ids]
    sequences = pack(lengths, tiers)
    sizes = [sum(p[0] for p in row) for row in sequences]
    steps = step_groups(sizes)
    rows = [
        (doc_ids[doc], start, n, zlib.crc32(ids[doc][4 * start : 4 * (start + n)]), lengths[doc], first + k, at, sizes[k], first + steps[k])
        for k, row in enumerate(sequences)
        for (n, doc, start), at in zip(row, accumulate((p[0] for p in row), initial=0), strict=False)
    ]
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), first + len(sequences)


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    sequence_tokens (the sequence's length, a power of two) and step_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hold(f"packing {path}", lambda: Ids(path))
        next_id = TaskContext.get().partitionId() << 40
        doc_ids: list = []
        ids: list[bytes] = []
        size = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_groups(offsets):
                doc_ids += batch.column(0).slice(first, last - first).to_pylist()
                new = own.of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                ids += new
                size += sum(map(len, new)) // 4
                if size >= CHUNK_TOKENS:
                    out, next_id = packed_batch(doc_ids, ids, tiers, next_id)
                    yield out
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield packed_batch(doc_ids, ids, tiers, next_id)[0]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run, f"packing {path}"), SCHEMA)
