"""Terms of text buffers: longest runs of some ASCII characters and of all characters beyond ASCII,
with A-Z in lower case. Bytes of a character beyond ASCII are all beyond ASCII, so the runs are the
same in UTF-8 as in characters."""

from __future__ import annotations

import numpy as np

from themelift.llm.common import run_bounds, word_codes


def byte_table(ascii_letters: str) -> np.ndarray:
    table = np.arange(256) >= 128
    table[[ord(c) for c in ascii_letters]] = True
    return table


DIGITS = "0123456789"
SMALL = "abcdefghijklmnopqrstuvwxyz"
LETTERS = byte_table(SMALL + SMALL.upper())
LETTERS_AND_DIGITS = byte_table(SMALL + SMALL.upper() + DIGITS)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_codes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of text: a number for each term, where the terms of each row begin (and the last
    row's end), and the distinct terms by number."""
    starts, ends, row = run_bounds(table[data], offsets)
    codes, terms = word_codes(_LOWER[data], starts, ends)
    return codes, np.searchsorted(row, np.arange(len(offsets))), terms
