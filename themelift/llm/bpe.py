"""Byte-level BPE with word ends: encoding by batched numpy merge rounds, and decoding.

The symbols of many words stand in one flat array. In each round every adjacent pair of symbols
becomes a 64-bit key, its rank is found by binary search over the sorted keys of the merge list,
and the pair of lowest rank of every word is merged at all its places, from the left. Words without
a known pair leave the array. The rounds end when it is empty.

Defined results: a null or empty text has no ids and decodes to an empty text; a text of white
space only as well. Texts and words of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.llm.common import Flat, WordNumbers, hold, row_groups, text_buffer, tidy, with_columns

# Letters and numbers (hexadecimal ranges) that are newer than the Unicode version by which the
# tokenizer's patterns class characters, and lower-case forms newer than this Python's.
NEW_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 "
    "1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
NEW_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
NEW_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}

NO_RANK = np.iinfo(np.int64).max
WORDS_KEPT = 1_200_000  # words whose ids a task remembers
FLAT_SYMBOLS = 1 << 16  # symbols of one flat array, unless a word is longer; small enough for caches


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable in Latin-1, otherwise the
    next free letter from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in shown else free))
        free += byte not in shown
    return letters


@dataclass(frozen=True)
class Vocabulary:
    tokens: list[str]
    pair_keys: np.ndarray  # sorted; left symbol * 2**32 + right symbol
    pair_ranks: np.ndarray
    pair_symbols: np.ndarray
    inner: np.ndarray  # symbol of a byte inside a word
    final: np.ndarray  # symbol of a byte that ends a word
    special: dict[str, int]
    words: str  # the pattern of words


def dated(pattern: str) -> str:
    """The pattern with white space, letters and numbers as the tokenizer's own engine has them."""

    def without(kind: str, ranges: str) -> str:
        new = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())
        return f"[\\p{{{kind}}}--[{new}]]"

    for old, own in (
        ("\\s", "\\p{White_Space}"),
        ("\\p{L}", without("L", NEW_LETTERS)),
        ("\\p{N}", without("N", NEW_NUMBERS)),
    ):
        pattern = pattern.replace(old, own)
    return pattern


def load_vocabulary(path: str) -> Vocabulary:
    """From a tokenizer file: BPE with a word-end suffix over byte letters, words cut by a pattern."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["post_processor"]:
        raise ValueError("a BPE file with a word-end suffix and no post-processor is needed")
    ids, suffix = model["vocab"], model["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in [*ids.items(), *special.items()]:
        tokens[i] = token
    rows = []
    for rank, merge in enumerate(model["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        rows.append((ids[left] << 32 | ids[right], rank, ids[left + right]))
    table = np.array(rows, np.int64).reshape(-1, 3)
    _, first = np.unique(table[:, 0], return_index=True)
    table = table[first]
    letters = byte_letters()
    pattern = next(
        p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
    )
    return Vocabulary(
        tokens,
        np.ascontiguousarray(table[:, 0]),
        np.ascontiguousarray(table[:, 1]),
        np.ascontiguousarray(table[:, 2]),
        np.array([ids.get(x, -1) for x in letters], np.int64),
        np.array([ids.get(x + suffix, -1) for x in letters], np.int64),
        special,
        dated(pattern),
    )


def merge_rounds(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words (each at least one byte long), end to end, and where each word's ids
    begin and the last word's end."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    symbols = vocabulary.inner[raw]
    symbols[ends - 1] = vocabulary.final[raw[ends - 1]]
    word = np.repeat(np.arange(len(words)), lengths)
    known = symbols >= 0
    symbols, word = symbols[known], word[known]
    done: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    keys, made_of = vocabulary.pair_keys, vocabulary.pair_symbols

    def ranks(at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; none at the end of a word."""
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] << 32 | symbols[after]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        fits = (keys[place] == key) & (word[at] == word[after]) & (after > at)
        return np.where(fits, vocabulary.pair_ranks[place], NO_RANK)

    rank = ranks(np.arange(len(symbols))) if len(keys) else np.full(len(symbols), NO_RANK)
    while len(symbols):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        count = np.diff(np.append(first, len(word)))
        lowest = np.minimum.reduceat(rank, first)
        over = np.repeat(lowest == NO_RANK, count)
        if over.any():
            done.append(symbols[over])
            done_word.append(word[over])
            symbols, word, rank = symbols[~over], word[~over], rank[~over]
            count, lowest = count[lowest < NO_RANK], lowest[lowest < NO_RANK]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, count))
        if len(at) > 1:  # of overlapping places in a row, every second from the left
            run = np.cumsum(np.append(True, np.diff(at) > 1)) - 1
            start = at[np.searchsorted(run, np.arange(run[-1] + 1))]
            at = at[(at - start[run]) % 2 == 0]
        symbols[at] = made_of[np.searchsorted(keys, symbols[at] << 32 | symbols[at + 1])]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, word, rank = symbols[stays], word[stays], rank[stays]
        at = at - np.arange(len(at))
        touched = np.zeros(len(symbols), bool)  # the pairs that the new symbols belong to
        touched[at] = touched[np.maximum(at - 1, 0)] = True
        at = np.flatnonzero(touched)
        rank[at] = ranks(at)
    symbols, word = np.concatenate(done), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.searchsorted(word[order], np.arange(len(words) + 1))


def lowered(text: str) -> str:
    """NFC and lower case, character by character (a final sigma is an ordinary one)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(NEW_LOWER)


class Encoder:
    """Ids of texts. White-space separated chunks never share a token; each distinct one is encoded
    once and remembered, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(vocabulary.words, regex.V1)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.chunks, self.ids = WordNumbers(WORDS_KEPT), Flat(np.int32)

    def pieces(self, chunk: str) -> list[bytes | int]:
        """Words of a chunk as bytes, special tokens as their ids."""
        parts = self.special.split(chunk) if self.special and "<" in chunk else [chunk]
        out: list[bytes | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.vocabulary.special[part])
            elif part:
                low = lowered(part)
                if low.isalpha():  # one word for sure, and the common case
                    out.append(low.encode())
                elif low[-1] in ".," and low[:-1].isalpha():
                    out += (low[:-1].encode(), low[-1].encode())
                else:
                    out += [w.encode() for w in self.pattern.findall(low)]
        return out

    def learn(self, chunks: list[bytes]) -> None:
        """Remember the ids of these chunks, under the next numbers."""
        cut = [self.pieces(c.decode()) for c in chunks]
        numbers: dict[bytes | int, int] = {}
        each = np.array([numbers.setdefault(p, len(numbers)) for pieces in cut for p in pieces], np.int64)
        pieces, own = Flat(np.int32), list(numbers)
        first = size = 0
        for k, piece in enumerate(own):
            special = isinstance(piece, int)
            size += 0 if special else len(piece)
            if special or size >= FLAT_SYMBOLS or k + 1 == len(own):
                if words := own[first : k + (not special)]:
                    pieces.add(*merge_rounds(self.vocabulary, words))
                if special:
                    pieces.add(np.array([piece], np.int32), np.array([0, 1]))
                first, size = k + 1, 0
        ids, at = pieces.fetch(each)
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        self.ids.add(ids, at[np.append(0, ends)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of text, end to end, and where each row's ids begin and the last row's end."""
        numbers, bounds, new, cleared = self.chunks.number(data, offsets)
        if cleared:
            self.ids.clear()
        if new:
            self.learn(new)
        ids, at = self.ids.fetch(numbers)
        return ids, at[bounds]


class Digests:
    """SHA-256 of rows of ids, as decimal text and as decoded text."""

    def __init__(self, vocabulary: Vocabulary):
        self.decimal, self.decoded = Flat(np.uint8), Flat(np.uint8)
        for flat, texts in (
            (self.decimal, [f"{i} " for i in range(len(vocabulary.tokens))]),
            (self.decoded, [t + " " for t in vocabulary.tokens]),
        ):
            raw = [t.encode() for t in texts]
            flat.add(
                np.frombuffer(b"".join(raw), np.uint8),
                np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))),
            )

    def of(self, flat: Flat, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        text, at = flat.fetch(ids)
        cut = at[bounds].tolist()
        return [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The tokens, special ones too, joined by one space: the file names no decoder."""
    return " ".join([vocabulary.tokens[i] for i in ids])


def encoder(path: str) -> tuple[Encoder, Digests]:
    """One of each for a vocabulary file and Python worker."""

    def make() -> tuple[Encoder, Digests]:
        vocabulary = load_vocabulary(path)
        return Encoder(vocabulary), Digests(vocabulary)

    return hold(f"bpe {path}", make)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = encoder(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            for first, last in row_groups(offsets):
                ids, at = own.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                rows = [batch.column(k).slice(first, last - first) for k in range(len(keep))]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows, lists], [*keep, "ids"])

    schema = with_columns(docs, keep, {"ids": T.ArrayType(T.IntegerType())})
    return docs.select(*keep, F.col(text)).mapInArrow(tidy(run, f"bpe {path}"), schema)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the decoded text; null ids decode to null."""
    names, at = encoded.columns, encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path)[0].vocabulary
        for batch in batches:
            texts = [None if x is None else decode(vocabulary, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return encoded.mapInArrow(tidy(run, f"bpe {path}"), with_columns(encoded, tuple(names), {out: T.StringType()}))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 of
    every whole text, in one pass: what ``encode_texts`` and ``decode_ids`` give, without sending
    ids and decoded texts out of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digests = encoder(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_groups(offsets):
                ids, at = own.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(digests.of(digests.decimal, ids, at), pa.string()),
                        pa.array(digests.of(digests.decoded, ids, at), pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidy(run, f"bpe {path}"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
