"""Counts over the words, characters and lines of whole texts, a few MB of text at a time.

A word is a longest run without ASCII white space, a line is what stands between line feeds. All
counts of a null or empty text are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.llm.common import row_groups, text_buffer, tidy, with_columns, word_bounds, word_codes

SYMBOLS = b"#*$%&|<>"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
    "n_bytes", "n_upper", "n_digits", "n_exclaims", "n_bars", "n_stops", "n_commas", "n_wide",
    "n_short_words", "n_long_words", "n_word_repeats", "n_pairs_again", "longest_word",
)


def table_of(values: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(values)] = True
    return found


TABLES = {
    "n_symbols": table_of(SYMBOLS),
    "n_upper": table_of(bytes(range(65, 91))),
    "n_digits": table_of(bytes(range(48, 58))),
    "n_exclaims": table_of(b"!"),
    "n_bars": table_of(b"|"),
    "n_stops": table_of(b".?"),
    "n_commas": table_of(b",;:"),
    "n_wide": table_of(bytes(range(0xC0, 256))),
}


def per_row(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeats(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values (small numbers) stand twice or more in their row, and which of these are not
    the first."""
    key = row * (int(values.max(initial=0)) + 1) + values
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    last = np.append(new[1:], True)[: len(key)]
    twice, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order], again[order] = ~(new & last), ~new
    return twice, again


def joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A small number for each pair, equal for equal pairs and only for them."""
    key = left * (int(right.max(initial=0)) + 1) + right
    return np.unique(key, return_inverse=True)[1]


def line_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them that equal an earlier line of their row."""
    rows = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offsets, feeds, "right") - 1]))
    holds = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends, row = begins[holds], ends[holds], row[holds]
    _, again = repeats(word_codes(data, begins, ends)[0], row)
    return np.bincount(row, minlength=rows), np.bincount(row[again], minlength=rows)


def covered_words(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row that lie in a window of three words that the row holds twice or more."""
    at = np.arange(max(len(row) - 2, 0))
    at = at[row[at] == row[at + 2]]
    twice, _ = repeats(joint(joint(words[at], words[at + 1]), words[at + 2]), row[at])
    edge = np.zeros(len(row) + 4, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 3, -1)
    return np.bincount(row[np.cumsum(edge)[: len(row)] > 0], minlength=rows)


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of each row of text."""
    rows = len(offsets) - 1
    starts, ends, row = word_bounds(data, offsets)
    size = ends - starts
    out = {"n_bytes": np.diff(offsets), "n_words": np.bincount(row, minlength=rows)}
    for name, table in TABLES.items():
        out[name] = per_row(table[data], offsets)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    out["word_chars"] = per_row(((data & 0xC0) != 0x80) & ~blank, offsets)
    out["n_lines"], out["n_dup_lines"] = line_counts(data, offsets, starts)
    words, _ = word_codes(data, starts, ends)
    out["n_repeat_words"] = covered_words(words, row, rows)
    _, again = repeats(words, row)
    out["n_distinct_words"] = out["n_words"] - np.bincount(row[again], minlength=rows)
    out["n_short_words"] = np.bincount(row[size <= 3], minlength=rows)
    out["n_long_words"] = np.bincount(row[size > 12], minlength=rows)
    follows = np.zeros(len(row), bool)
    follows[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    out["n_word_repeats"] = np.bincount(row[follows], minlength=rows)
    pair = np.flatnonzero(row[1:] == row[:-1])
    _, again = repeats(joint(words[pair], words[pair + 1]), row[pair])
    out["n_pairs_again"] = np.bincount(row[pair][again], minlength=rows)
    out["longest_word"] = np.zeros(rows, np.int64)
    np.maximum.at(out["longest_word"], row, size)
    return out


def measured(
    docs: DataFrame, names: tuple[str, ...] = COUNTS, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` and a long for each count of the whole text; ``keep`` may hold the text
    and any other column, but none that is named like a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            for first, last in row_groups(offsets):
                found = counts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                rows = [batch.column(k).slice(first, last - first) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    rows + [pa.array(found[n], pa.int64()) for n in names], [*keep, *names]
                )

    schema = with_columns(docs, keep, {n: T.LongType() for n in names})
    return docs.select(*keep, F.col("text")).mapInArrow(tidy(run), schema)
